"""Splitting oversized items at natural boundaries, by recursive bisection.

An item is a text of words (maximal runs of other characters than space, tab, line feed and carriage return). An item
of at most `limit` words is one piece. A longer one is cut in two at the strongest boundary near its middle, and each
half again while it has more than `limit - overlap` words; then every piece but the first gets the `overlap` words
before it. The cores of the pieces are consecutive and cover the item, so nothing is lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.html import segments
from lexweave.functions.keys import BLANKS, norm_key
from lexweave.operators.records import current
from lexweave.operators.snapshots import IN_FORCE, latest
from lexweave.sources.xmltree import parse

LIMIT, OVERLAP = 512, 32
WORD = re.compile(f"[^{BLANKS}]+")
#: Strength of the place before a word.
WORDS, CLAUSE, SENTENCE, BLOCK = 0, 1, 2, 3
NAMES = np.array(["word", "clause", "sentence", "block"])
#: Stands for a block limit while a text is put together; it can't occur in XML, and in HTML it's replaced.
_LIMIT_MARK = "\x00"
_SENTENCE_END = re.compile(r"[.?!…][\"'»”’)\]]*$")
_SENTENCE_START = re.compile(r"[\"'«“‘(\[]*(?:[A-ZÀ-ÖØ-Þ0-9«“\-–•]|\d)")
_CLAUSE_END = re.compile(r"[,;:][\"'»”’)\]]*$")
#: Elements of a consumer guide that don't limit a block.
INLINE = ("MiseEnEvidence", "LienIntra", "LienExterne", "LienInterne", "Exposant", "Indice", "Expression", "Valeur")

PIECES = "item_kind string, item_key string, piece_no int, n_pieces int, first_word int, last_word int, overlap_words int, n_words int, cut string, text string"


def bisect(strength: np.ndarray, core: int) -> list[int]:
    """First words of the pieces of an item of len(strength) words, none of more than `core` words, in order.

    strength[i] is that of the place before word i. A range is cut at the strongest place in its middle half, the one
    nearest to the middle and then the earlier one among equals; so every cut leaves each side a quarter at least, and
    the work is in proportion to n log n.
    """
    starts, open_ = [], [(0, len(strength))]
    while open_:
        a, b = open_.pop()
        if b - a <= core:
            starts.append(a)
            continue
        quarter, middle = (b - a) // 4, (a + b) / 2
        low, high = max(a + 1, a + quarter), max(a + 2, b - quarter)
        part = strength[low:high]
        best = np.flatnonzero(part == part.max()) + low
        cut = int(best[np.argmin(np.abs(best - middle))])
        open_ += [(cut, b), (a, cut)]
    return starts


def flatten(parts: Iterable[tuple[str, str]]) -> str:
    """One text of pairs (kind, text): every tag is a blank, a block limit is the mark."""
    out: list[str] = []
    for kind, text in parts:
        out.append(text.replace(_LIMIT_MARK, "�") if kind == "text" else f" {_LIMIT_MARK} " if kind == "block" else " ")
    return "".join(out)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int, str, str]]:
    """Pieces of a text: (first word of the core, end of the core, overlap words, words, cut before it, text).

    Block limits are the marks set by `flatten` and empty lines, line feeds and carriage returns; sentence limits lie
    after . ? ! … before a capital, digit, dash or quotation mark, clause limits after , ; and :. A piece's text is
    the item's own characters from its first to its last word, with marks taken out. An empty text has no pieces.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    words = [m.span() for m in WORD.finditer(text)]
    marks = [i for i, (a, b) in enumerate(words) if b - a == 1 and text[a] == _LIMIT_MARK] if _LIMIT_MARK in text else []
    if marks:
        drop = np.zeros(len(words), bool)
        drop[marks] = True
        real = np.flatnonzero(~drop)
        limits = set(np.searchsorted(real, np.array(marks)).tolist())
        words = [words[i] for i in real.tolist()]
    else:
        limits = set()
    n = len(words)
    if not n:
        return []
    if n <= limit:
        return [(0, n, 0, n, "start", _own(text, words, 0, n))]
    strength = np.zeros(n, np.int8)
    for i in range(1, n):
        (a, b), (c, d) = words[i - 1], words[i]
        if i in limits or "\n" in text[b:c] or "\r" in text[b:c]:
            strength[i] = BLOCK
        elif _SENTENCE_END.search(text, max(a, b - 6), b) and _SENTENCE_START.match(text, c, d):
            strength[i] = SENTENCE
        elif text[b - 1] in ",;:" or _CLAUSE_END.search(text, max(a, b - 6), b):
            strength[i] = CLAUSE
    starts = bisect(strength, limit - overlap)
    return [
        (a, b, min(overlap, a), b - a + min(overlap, a), "start" if not a else str(NAMES[strength[a]]), _own(text, words, a - min(overlap, a), b))
        for a, b in zip(starts, [*starts[1:], n])
    ]


def _own(text: str, words: list[tuple[int, int]], a: int, b: int) -> str:
    return re.sub(f" ?{_LIMIT_MARK} ?", "\n", text[words[a][0] : words[b - 1][1]])


def read_text(text: str) -> str:
    return text.replace(_LIMIT_MARK, "�")


def read_html(fragment: str) -> str:
    """Text of an HTML fragment for splitting: without tables, references read as their characters."""
    return flatten(segments(fragment, tables=False))


def read_texte(xml: bytes) -> str | None:
    """Text of the Texte elements that are direct children of the root; None where nothing parses."""
    doc = parse(xml, body=("Texte",), inline=INLINE, content=False)
    return None if doc is None else flatten(doc.body)


def pieces(items: DataFrame, reader: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All pieces of the items (item_kind, item_key, body): `PIECES`.

    reader: how `body` is read, "text", "html" or "texte" (the XML of a guide). Items that are null, empty or don't
    parse have no pieces. Each item is cut by itself, whole: no exchange, and memory for one batch of items.
    """
    read = {"text": read_text, "html": read_html, "texte": read_texte}[reader]
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.string(), pa.string(), *[pa.int32()] * 6, pa.string(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for kind, key, body in zip(*(batch.column(i) for i in range(3))):
                text = None if not body.is_valid else read(body.as_py())
                found = split_text(text, limit, overlap) if text else []
                for no, (a, b, o, w, c, t) in enumerate(found, 1):
                    for col, v in zip(out, (kind.as_py(), key.as_py(), no, len(found), a, b, o, w, c, t)):
                        col.append(v)
                    size += len(t)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                    out, size = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return items.select("item_kind", "item_key", "body").mapInArrow(cut, PIECES)


# --- the project's items ---------------------------------------------------------------------------------------------


def _at_least(text: Column, limit: int) -> Column:
    """Whether a text may have more than `limit` words: a word and its blank take two characters, and runs are counted."""
    return (F.length(text) > 2 * limit) & (F.regexp_count(text, F.lit(f"[^{BLANKS}]+")) > limit)


#: No more than what is a tag to the exact reader, which also takes quoted values that hold "<" or ">".
_TAG_AT_MOST = r"(?s)<!--.*?-->|<[/!?a-zA-Z][^<>]*>"


def _html_words_at_most(fragment: Column) -> Column:
    """The fragment with so many words that it has no fewer than after exact reading: whole tables go, a tag or a
    reference is a blank. What Java's simpler patterns leave standing only adds words."""
    hidden = F.contains(fragment, F.lit("<!--")) | fragment.rlike("=\\s*[\"'][^\"'>]*<")  # what looks like a table may be none
    hidden = hidden | fragment.rlike("(?i)<table\\s[^<]*/[^/<>a-z0-9\"']*>")  # a table closed in its own tag, with a quoted ">" too
    bare = F.when(hidden, fragment).otherwise(F.regexp_replace(fragment, r"(?is)<table(?:\s[^<>]*)?>.*?</table\s*>", " "))
    bare = F.regexp_replace(bare, _TAG_AT_MOST, " ")
    return F.regexp_replace(bare, "&#?[0-9A-Za-z]+;?", " x ")


def article_items(articles: DataFrame, snapshot: int, limit: int = 0) -> DataFrame:
    """(item_kind, item_key, body) of the articles that a snapshot holds; body is null where it can't exceed the limit.

    Sizes are estimated from above where the rows are read, so that only what may be oversized is shuffled.
    """
    body = F.col("texteHtml") if not limit else F.when(_at_least(_html_words_at_most(F.col("texteHtml")), limit), F.col("texteHtml"))
    rows = articles.where(F.col("snapshot_no") == snapshot).select(norm_key("cid").alias("item_key"), "delivered_at", "etat", body.alias("body"))
    best = latest(rows, ["item_key"], ["delivered_at"], ["etat", "body"])
    return best.where(F.col("etat") == IN_FORCE).select(F.lit("article").alias("item_kind"), "item_key", "body")


def fiche_items(fiches: DataFrame) -> DataFrame:
    return current(fiches).select(F.lit("fiche").alias("item_kind"), F.col("fiche_id").alias("item_key"), F.col("xml").alias("body"))


def chunk_items(chunks: DataFrame, limit: int = 0) -> DataFrame:
    """Items of the pieces cut earlier, one per chunk_id and text: repeated rows count once, and of different texts under
    one chunk_id each is an item, so that what comes out doesn't depend on the limit."""
    rows = chunks.select(F.col("chunk_id").alias("item_key"), F.col("text").alias("body")).where("item_key IS NOT NULL AND body IS NOT NULL")
    if limit:
        rows = rows.where(_at_least(F.col("body"), limit))
    return rows.distinct().select(F.lit("chunk").alias("item_kind"), "item_key", "body")


def corpus_pieces(articles: DataFrame, fiches: DataFrame, chunks: DataFrame, snapshot: int = 6, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of all oversized articles, fiches and chunks."""
    parts = [
        pieces(article_items(articles, snapshot, limit).where("body IS NOT NULL"), "html", limit, overlap),
        pieces(fiche_items(fiches), "texte", limit, overlap),
        pieces(chunk_items(chunks, limit), "text", limit, overlap),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("n_pieces > 1")
