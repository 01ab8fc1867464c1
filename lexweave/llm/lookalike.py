"""Visually identical text with different characters: confusables skeletons.

The skeleton of a text: decompose it, replace every character by its prototype in the look-alike table, decompose
again. The table is the public one of Unicode's security mechanisms (UTS 39), as the ICU library that Spark comes with
has it, restricted to what a reader sees: letter case, accents, digits, superscripts, signs, punctuation and wording
stay apart. So ASCII and Latin-1 characters are their own prototypes, a letter's prototype is never a digit or a sign,
and capitals never have small prototypes. Runs of blanks become one, characters without width or look vanish. The
skeleton is written composed again, as one consistent form. Two texts look the same if and only if their skeletons are
equal.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave import session
from lexweave.functions.html import TAG_JAVA
from lexweave.functions.keys import digest, norm_key
from lexweave.operators.snapshots import held

# Shapes of the apostrophe and of the hyphen.
APOSTROPHES = "‘’‛ʼʻʽˈ＇"
HYPHENS = "‐‑﹣－−"
#: Bases whose characters are the ASCII ones in another shape, by compatibility decomposition.
SHAPES = ("<wide>", "<font>", "<noBreak>", "<compat>")


# Fixed value: a letter that the public table lacks.
MISSING = {"Ԛ": "Q"}
#: Letters as this library compares them: the public table has one prototype for "l", "I" and "1", and one for "O" and "0".
_CAPITAL, _SMALL = {"l": "I"}, {"O": "o"}


def letters(spark: SparkSession) -> dict[int, str]:
    """Letters above Latin-1 and their prototypes, one letter each, from the public table (see `_letters`)."""
    icu = spark._jvm.com.ibm.icu
    version = icu.util.VersionInfo.ICU_VERSION.toString()
    if version not in _letters_by_version:
        _letters_by_version[version] = _letters(icu.text.SpoofChecker.Builder().build().getSkeleton)
    return _letters_by_version[version]


_letters_by_version: dict[str, dict[int, str]] = {}


def _letters(public) -> dict[int, str]:  # type: ignore[no-untyped-def]
    """Letters (Lu, Ll, Lt, Lo) whose skeleton is one letter, by a function from text to the public skeleton.

    A capital's prototype is no small letter, and the other way round, but for the stroke that the public table writes
    "l": as a capital it is "I". A letter without case takes what the table says. Modifier letters, which are raised,
    superscripts and subscripts, and the letters of Latin print up to U+017F keep their look; the dotless i is an i.
    Letters that decompose need no prototype.
    """
    points = [c for c in range(0x100, 0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo") and unicodedata.decomposition(chr(c)).startswith(("<compat>", "<font>")) | (not unicodedata.decomposition(chr(c)))]
    table = {ord(k): v for k, v in MISSING.items()}
    for c, form in zip(points, public("\n".join(map(chr, points))).split("\n")):
        kind = unicodedata.category(chr(c))
        if kind in ("Lu", "Lt"):
            form = _CAPITAL.get(form, form)
        elif kind == "Ll":
            form = _SMALL.get(form, form)
        if len(form) != 1 or ord(form) == c or (c <= 0x17F and c != 0x131):
            continue
        to = unicodedata.category(form)
        if to[0] == "L" and to != "Lm" and not {kind.replace("Lt", "Lu"), to} == {"Lu", "Ll"}:
            table[c] = form
    return table


@cache
def shapes() -> dict[int, str | None]:
    """What is known without the public table: code point -> prototype, None if it vanishes.

    Wide and mathematical forms and ligatures have the prototype that their compatibility decomposition names, unless
    that is a superscript, subscript or fraction, which look different. Space separators are blanks. Format characters,
    variation selectors and other ignorable characters vanish.
    """
    table: dict[int, str | None] = {}
    for code in (*range(0x80, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x11000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE01F0)):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Zs" or code in (0x85, 0x2028, 0x2029):
            table[code] = " "
        elif kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D):
            table[code] = None
        elif (form := unicodedata.decomposition(c)).startswith(SHAPES):
            points = [chr(int(p, 16)) for p in form.split()[1:]]
            letters = unicodedata.normalize("NFKC", "".join(points))
            # spacing accents, ellipses, fractions and the like keep their own look; letters, digits and signs are shapes
            if form.startswith(("<wide>", "<font>")) or (0xFB00 <= code <= 0xFB06) or (0x2160 <= code <= 0x217F) or code in (0x2011,):
                table[code] = letters
    table |= {ord(c): "'" for c in APOSTROPHES} | {ord(c): "-" for c in HYPHENS}
    for code in range(0x09, 0x0E):
        table[code] = " "
    for code in [*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]:
        table[code] = None
    return table


def prototypes(spark: SparkSession) -> dict[int, str | None]:
    """The look-alike table: code point -> prototype, None if it vanishes. Prototypes are their own prototypes."""
    table = letters(spark) | shapes()
    for _ in range(4):  # a shape of a letter that has a prototype, and so on
        table |= {c: "".join(table.get(ord(x), x) or "" for x in p) for c, p in table.items() if p and any(ord(x) in table for x in p)}
    return table


_RUN = re.compile(" +")


def skeleton(text: str, table: dict[int, str | None]) -> str:
    """The consistent form of a text: `prototypes` of its decomposition, decomposed again, then composed."""
    text = unicodedata.normalize("NFD", text).translate(table)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", _RUN.sub(" ", text).strip(" ")))


#: Stands for a tag; a private character (a text that holds it is read as if a tag stood there).
TAG_MARK = "\ue000"
#: Finds a character that is not its own skeleton in composed form: all but printable ASCII and the precomposed Latin
#: letters and signs of Western European print. Texts without one don't leave the JVM.
ODD = "[^ -~\\n\\r\\t\\u00A0\\uE000ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜŒÆàáâäçèéêëìíîïñòóôöùúûüœæß°²³«»€§–—…”“’]"
_BLANK_RUN = "[ \\u00A0\\uE000\\n\\r\\t]+"


def with_form(rows: DataFrame, text: str, form: str, is_html: bool = False) -> DataFrame:
    """rows plus `form`, the skeleton of column `text`; null stays null. TAG_MARK counts as a blank; is_html: the text
    holds character references, read as their characters.

    Texts of plain characters are brought to form by built-in functions; only the others go through Arrow to Python.
    Each step is a column of its own, so that nothing is computed twice.
    """
    table = prototypes(rows.sparkSession)

    @F.pandas_udf("string")
    def slow(batch):  # type: ignore[no-untyped-def]
        read = (lambda x: skeleton(_html.unescape(x.replace(TAG_MARK, " ")), table)) if is_html else (lambda x: skeleton(x.replace(TAG_MARK, " "), table))
        return batch.map(read, na_action="ignore")

    odd = F.col(text).rlike(ODD)
    if is_html:
        odd = odd | F.contains(text, F.lit("&"))
    rows = rows.withColumn("_odd", odd)
    rows = rows.withColumn("_slow", slow(F.when(F.col("_odd"), F.col(text))))
    fast = F.btrim(F.regexp_replace(F.replace(text, F.lit("’"), F.lit("'")), _BLANK_RUN, " "), F.lit(" "))
    return rows.withColumn(form, F.when(F.col("_odd"), F.col("_slow")).otherwise(fast)).drop("_odd", "_slow")


# --- the project's texts ---------------------------------------------------------------------------------------------


def _marked_forms(rows: DataFrame) -> DataFrame:
    """rows plus `_marked`, texteHtml with TAG_MARK for every tag, and `_form`, its skeleton."""
    return with_form(rows.withColumn("_marked", F.regexp_replace("texteHtml", TAG_JAVA, TAG_MARK)), "_marked", "_form", is_html=True)


def corpus_forms(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    """(text_table, key, form) of every text of both tables in its consistent form, what stands between the tags of an
    article; null stays null.

    Articles have the key cid#snapshot, as in `article_twins`, and all that were delivered count, held or not. A key that
    has several texts has a row for each; repeated rows count once.
    """
    a = articles.select(F.concat(norm_key("cid"), F.lit("#"), F.col("snapshot_no").cast("string")).alias("key"), "texteHtml").distinct()
    c = with_form(chunks.select(F.col("chunk_id").alias("key"), "text").distinct(), "text", "form")
    a = _marked_forms(a).select(F.lit("articles").alias("text_table"), "key", F.col("_form").alias("form"))
    return a.unionByName(c.select(F.lit("fiche_chunks").alias("text_table"), "key", "form"))


def article_forms(articles: DataFrame) -> DataFrame:
    """(snapshot_no, cid, original, form) of all held articles with a texteHtml, as digests of 128 bits: of the
    characters between the tags as they are, and of the skeleton with every tag as a blank.

    The texts are reduced to two digests where they are read; only these are shuffled.
    """
    rows = _marked_forms(articles)
    payload = {"original": digest(F.replace("_marked", F.lit(TAG_MARK), F.lit(""))), "form": digest("_form")}
    return held(rows, payload).where("form IS NOT NULL").select("snapshot_no", "cid", "original", "form")


def article_twins(articles: DataFrame) -> DataFrame:
    """Articles whose text between the tags differs from the next snapshot's in characters but looks the same."""
    following = Window.partitionBy("cid").orderBy("snapshot_no")  # a row per snapshot
    rows = article_forms(articles).withColumn("b", F.lead(F.struct("snapshot_no", "original", "form")).over(following))
    both = rows.where("b.snapshot_no = snapshot_no + 1 AND b.form = form AND b.original <> original")
    return both.select(F.concat_ws("#", "cid", "snapshot_no").alias("key_a"), F.concat_ws("#", "cid", F.col("snapshot_no") + 1).alias("key_b"))


def classes(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(form, original, key, n_keys, n_originals): one row per key and text, with its class `form`, the digest of the
    skeleton; how many rows the class has and how many different originals, of which `original` is the digest.

    Null texts or keys are left out; a key that has several texts has a row for each; repeated rows count once. Classes
    of one original are copies of each other. The digests are written to the shared folder, since they are read twice.
    """
    rows = with_form(texts.select(F.col(key).alias("key"), F.col(text).alias("t")).where("key IS NOT NULL AND t IS NOT NULL"), "t", "f")
    rows = session.cut(rows.select("key", digest("t").alias("original"), digest("f").alias("form")).distinct())
    originals = rows.groupBy("form", "original").agg(F.count(F.lit(1)).alias("n"))
    sizes = originals.groupBy("form").agg(F.sum("n").alias("n_keys"), F.count(F.lit(1)).alias("n_originals"))
    return rows.join(sizes, "form").select("form", "original", "key", "n_keys", "n_originals")


def representatives(members: DataFrame) -> DataFrame:
    """(form, original_a, original_b, key_a, key_b, n_a, n_b): of every class with different originals the first one,
    by digest, with each other one; `key_a` and `key_b` are the least keys and n_a, n_b the numbers of keys that have
    them. With `classes` as membership these say all there is about who looks like whom, in as many rows as there are
    originals.
    """
    held_by = members.where("n_originals > 1").groupBy("form", "original").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))
    first = held_by.groupBy("form").agg(F.min(F.struct("original", "key", "n")).alias("a"))
    both = held_by.join(first, "form").where("original <> a.original")
    return both.select("form", F.col("a.original").alias("original_a"), F.col("original").alias("original_b"), F.col("a.key").alias("key_a"), F.col("key").alias("key_b"), F.col("a.n").alias("n_a"), F.col("n").alias("n_b"))


#: Rows of a class on one side of a task's share of its pairs, about.
SHARE = 4096


def twins(members: DataFrame) -> DataFrame:
    """Pairs (key_a, key_b), key_a < key_b, of rows of different keys whose texts look the same but differ: `classes`
    written out. Copies of one original are never paired with each other.

    How many rows that gives is the data's matter (n_keys squared at most), so a class is divided among tasks: one side
    is parted by a hash of its key into parts of about SHARE rows, the other goes to each part.
    """
    rows = members.where("n_originals > 1").withColumn("parts", F.ceil(F.col("n_keys") / SHARE).cast("int"))
    a = rows.select("form", F.col("key").alias("key_a"), F.col("original").alias("original_a"), F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    b = rows.select("form", F.col("key").alias("key_b"), F.col("original").alias("original_b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["form", "part"]).where("original_a <> original_b AND key_a < key_b").select("key_a", "key_b").distinct()


def corpus_twins(articles: DataFrame, chunks: DataFrame) -> DataFrame:
    a = article_twins(articles).select(F.lit("articles").alias("text_table"), "key_a", "key_b")
    return a.unionByName(twins(classes(chunks, "chunk_id", "text")).select(F.lit("fiche_chunks").alias("text_table"), "key_a", "key_b"))
