"""Operators around annotated items: working sets, reading lists, shortlists, disagreements, progress, ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.gates import MULTI_TURN, WITHOUT_ARTICLE

ID_FORM = "gs-%03d"
#: Rows (cid, term) and (id, term) of one block of the shortlist by terms; articles that share a bound; cells of a dense part.
ARTICLE_TERMS, ITEM_TERMS, GROUP, CELLS = 1_000_000, 500_000, 64, 4_000_000


def _some(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def working_set(items: DataFrame) -> DataFrame:
    """Single-turn items that name a gold guide or article."""
    return items.where(~_some("history") & (_some("gold_fiches") | _some("gold_articles")))


def article_set(items: DataFrame) -> DataFrame:
    """Of the working set, the items with gold articles."""
    return working_set(items).where(_some("gold_articles"))


def floor_set(items: DataFrame) -> DataFrame:
    """Of the working set, the items that are to be answered without an article."""
    return working_set(items).where(F.col("expected_state") == WITHOUT_ARTICLE)


def articles_by_section(articles: DataFrame) -> DataFrame:
    """(section_id, place, cid): the articles (cid, section_id) of each section, each once; null sections are left out.

    A group stays rows: a section may hold a tenth of all articles, which must not become one array. `place` is a hash
    order that needs no sort of a whole section; order by cid where a section is shown.
    """
    rows = articles.where("section_id IS NOT NULL AND cid IS NOT NULL").select("section_id", "cid").distinct()
    return rows.select("section_id", F.xxhash64("cid").alias("place"), "cid")


def reading_list(guides: DataFrame, sections: DataFrame, articles: DataFrame) -> DataFrame:
    """(fiche_id, place, section_id, title, cid): the sections a guide (fiche_id, section_ids) names, in its order, with
    their titles (section_id, titre) and articles. A section that isn't known keeps its id as title and has no article."""
    named = guides.select("fiche_id", F.posexplode("section_ids").alias("place", "section_id"))
    titles = sections.where("section_id IS NOT NULL").groupBy("section_id").agg(F.max("titre").alias("titre"))
    rows = named.join(titles, "section_id", "left").join(articles.select("cid", "section_id").distinct(), "section_id", "left")
    return rows.select("fiche_id", "place", "section_id", F.coalesce("titre", "section_id").alias("title"), "cid")


def _sections(items: DataFrame, guides: DataFrame) -> DataFrame:
    """(id, section_id): the sections that an item's gold guides name."""
    wanted = items.select("id", F.explode("gold_fiches").alias("fiche_id")).distinct()
    return wanted.join(guides.select("fiche_id", F.explode("section_ids").alias("section_id")), "fiche_id").select("id", "section_id").distinct()


def section_shortlist(items: DataFrame, guides: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, cid): the articles of all sections that an item's gold guides name, each once."""
    return _sections(items, guides).join(articles.select("cid", "section_id"), "section_id").select("id", "cid").distinct()


def in_sections(pairs: DataFrame, items: DataFrame, guides: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, cid): of the pairs those that `section_shortlist` has, found from their own articles. A shortlist has a row per
    item and article of its sections, so it isn't made where only some of them are asked for."""
    of = pairs.select("id", "cid").distinct().join(articles.select("cid", "section_id"), "cid")
    return of.join(_sections(items, guides), ["id", "section_id"], "left_semi").select("id", "cid").distinct()


def outside_sections(items: DataFrame, shortlist: DataFrame) -> DataFrame:
    """(id, cid): gold articles that no section of the item's guides holds."""
    return items.select("id", F.explode("gold_articles").alias("cid")).distinct().join(shortlist, ["id", "cid"], "left_anti")


class _Counts:
    """Rows of (id, term number, count) as a sparse matrix with a row per id; the rows of greatest length come first."""

    def __init__(self, ids: pa.Array, terms: np.ndarray, counts: np.ndarray, width: int):
        coded = ids.dictionary_encode()
        row, self.ids, self.width = coded.indices.to_numpy(), coded.dictionary, width
        place = np.empty(len(self.ids), np.int64)
        place[np.argsort(-np.bincount(row, counts.astype(float) ** 2, len(self.ids)), kind="stable")] = np.arange(len(place))
        self.ids = self.ids.take(pa.array(np.argsort(place)))
        cells, of = np.unique(place[row] * width + terms, return_inverse=True)
        self.row, self.term, self.count = cells // width, cells % width, np.zeros(len(cells), np.int64)
        np.add.at(self.count, of, counts)
        self.start = np.searchsorted(self.row, np.arange(len(self.ids) + 1))

    def dense(self, low: int, high: int, kind: type, group: int = 1) -> np.ndarray:
        """Rows low to high as a matrix, or the greatest counts of every `group` of them."""
        part = slice(self.start[low], self.start[min(high, len(self.ids))])
        out = np.zeros((-(-(min(high, len(self.ids)) - low) // group), self.width), kind)
        np.maximum.at(out.reshape(-1), (self.row[part] - low) // group * self.width + self.term[part], self.count[part].astype(kind))
        return out


def _nearest(articles: _Counts, items: _Counts, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, article, score): for every item the `limit` articles of greatest score over nought, of equal scores those
    with the lesser id. Exact: a group of articles is passed over only for items whose score with the greatest counts of
    the group is less than that of the last article they have. Long articles come first, so most groups are."""
    n, width = len(articles.ids), articles.width
    most = int(np.bincount(items.row, items.count.astype(float)).max()) * int(articles.count.max())
    if most >= 2**53 or most * n >= 2**62:
        raise OverflowError("scores of the shortlist by terms are too large for exact sums")
    kind = np.float32 if most < 2**24 else np.float64  # sums of whole numbers are exact below these
    order = np.empty(n, np.int64)
    order[pc.array_sort_indices(articles.ids).to_numpy()] = np.arange(n)[::-1]  # the lesser id is the greater number
    step, found = max(1, min(2_000, CELLS // width)), []
    for first in range(0, len(items.ids), step):
        x = items.dense(first, first + step, kind)
        best = np.full((len(x), limit), -1, np.int64)  # score * n + order; the least comes first
        for low in range(0, n, GROUP * step):
            bounds = x @ articles.dense(low, low + GROUP * step, kind, GROUP).T
            for i in range(bounds.shape[1]):
                of = np.flatnonzero((bounds[:, i] > 0) & (bounds[:, i] >= best[:, 0] // n))
                for start in range(low + i * GROUP, min(low + i * GROUP + GROUP, n) if len(of) else 0, min(GROUP, step)):
                    stop = min(start + min(GROUP, step), low + i * GROUP + GROUP, n)
                    scores = (x[of] @ articles.dense(start, stop, kind).T).astype(np.int64)
                    both = np.hstack([best[of], np.where(scores > 0, scores * n + order[start:stop], -1)])
                    best[of] = np.partition(both, both.shape[1] - limit, axis=1)[:, -limit:]
        item, k = np.nonzero(best >= 0)
        found.append((item + first, best[item, k]))
    item, key = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return item, np.argsort(order)[key % n], key // n


def term_shortlist(weights: DataFrame, terms: DataFrame, limit: int = 10) -> DataFrame:
    """(id, cid, score, rank): the articles (cid, term, n occurrences) nearest to each item (id, term, w weight) by the sum
    of weight times occurrences; ties go to the lesser cid. Terms that no item asks for are best left out beforehand.

    Weights and occurrences are whole numbers over nought, others are an error. Exact, and no pair of an item and an
    article is a row: both are hashed to blocks, each pair of blocks meets in one task as matrices over the terms they
    share, and gives `limit` rows an item at most. Both inputs are read twice, once for their size.
    """
    terms, weights = terms.where("cid IS NOT NULL AND term IS NOT NULL").select("cid", "term", F.col("n").cast("long").alias("n")), weights.where("id IS NOT NULL AND term IS NOT NULL").select("id", "term", F.col("w").cast("long").alias("w"))
    n, m = terms.count(), weights.count()
    # a few blocks more than needed, so that small tables still use the cores there are
    blocks, ways = max(-(-n // ARTICLE_TERMS), min(8, -(-n // 20_000)), 1), max(1, -(-m // ITEM_TERMS))
    of = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = terms.select(of("cid", blocks).alias("ab"), every(ways).alias("ib"), "cid", "term", "n")
    right = weights.select(every(blocks).alias("ab"), of("id", ways).alias("ib"), "id", "term", "w")
    kinds = dict(weights.dtypes)["id"], dict(terms.dtypes)["cid"]

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        for t, c in ((a, "n"), (b, "w")):
            if pc.any(pc.less(t.column(c), 1)).as_py() or t.column(c).null_count:
                raise ValueError(f"{c} must be a whole number over nought")
        shared = pc.unique(a.column("term").combine_chunks())
        shared = shared.filter(pc.is_in(shared, value_set=pc.unique(b.column("term").combine_chunks())))
        sides = []
        for t, key, c in ((a, "cid", "n"), (b, "id", "w")):
            number = pc.index_in(t.column("term").combine_chunks(), value_set=shared)
            t, number = t.filter(pc.is_valid(number)).combine_chunks(), number.drop_null().to_numpy().astype(np.int64)
            sides.append((t.column(key).combine_chunks(), number, t.column(c).to_numpy()))
        if not len(shared):
            return pa.table([sides[1][0], sides[0][0], pa.array([], pa.int64())], names=["id", "cid", "score"])
        articles, items = (_Counts(*side, len(shared)) for side in sides)
        item, article, score = _nearest(articles, items, limit)
        return pa.table([items.ids.take(pa.array(item)), articles.ids.take(pa.array(article)), pa.array(score)], names=["id", "cid", "score"])

    scores = left.groupBy("ab", "ib").cogroup(right.groupBy("ab", "ib")).applyInArrow(cell, f"id {kinds[0]}, cid {kinds[1]}, score long")
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "cid")))
    return ranked.where(F.col("rank") <= limit).select("id", "cid", "score", F.col("rank").cast("int").alias("rank"))


def shortlist_union(by_section: DataFrame, by_terms: DataFrame) -> DataFrame:
    """(id, cid, provenance): both shortlists, each article once with where it comes from."""
    rows = by_section.select("id", "cid", F.lit(1).alias("s"), F.lit(0).alias("l")).unionByName(by_terms.select("id", "cid", F.lit(0).alias("s"), F.lit(1).alias("l")))
    one = rows.groupBy("id", "cid").agg(F.max("s").alias("s"), F.max("l").alias("l"))  # numbers, which a hash aggregate combines
    return one.select("id", "cid", F.array_compact(F.array(F.when(F.col("l") == 1, "lexical"), F.when(F.col("s") == 1, "section"))).alias("provenance"))


def disagreements(gold: DataFrame, picks: DataFrame, shortlist: DataFrame) -> DataFrame:
    """(id, only_gold, only_picks, explained, needs_review) of items whose gold articles (id, cid) differ from a second
    annotator's picks: a missing pick that no section offered is explained, any other difference is to be reviewed. Of the
    shortlist only gold pairs matter, so `in_sections` of these does."""
    rows = gold.select("id", "cid", F.lit(1).alias("g"), F.lit(0).alias("m"), F.lit(0).alias("s")).unionByName(picks.select("id", "cid", F.lit(0).alias("g"), F.lit(1).alias("m"), F.lit(0).alias("s"))).unionByName(shortlist.select("id", "cid", F.lit(0).alias("g"), F.lit(0).alias("m"), F.lit(1).alias("s")))
    one = rows.groupBy("id", "cid").agg(*(F.max(c).alias(c) for c in "gms"))
    of = lambda cond: F.array_sort(F.collect_set(F.when(F.expr(cond), F.col("cid"))))  # noqa: E731  an item's articles
    out = one.where("g + m > 0").groupBy("id").agg(of("g = 1 AND m = 0").alias("only_gold"), of("g = 0 AND m = 1").alias("only_picks"), of("g = 1 AND m = 0 AND s = 0").alias("explained"), of("(g = 1 AND m = 0 AND s = 1) OR (g = 0 AND m = 1)").alias("needs_review"))
    return out.where((F.size("only_gold") > 0) | (F.size("only_picks") > 0))


def overlap(items: DataFrame, held_out: DataFrame) -> DataFrame:
    """(id, fiche_id): guides of items that a held-out set uses too."""
    used = held_out.select(F.explode("gold_fiches").alias("fiche_id")).distinct()
    return items.select("id", F.explode("gold_fiches").alias("fiche_id")).distinct().join(used, "fiche_id", "left_semi")


def unused_guides(guides: DataFrame, items: DataFrame, n: int, seed: int) -> DataFrame:
    """`n` guides that no item uses, drawn by a seeded hash, so the draw is the same on any cluster."""
    used = items.select(F.explode("gold_fiches").alias("fiche_id")).distinct()
    return guides.select("fiche_id").distinct().join(used, "fiche_id", "left_anti").orderBy(F.xxhash64("fiche_id", F.lit(seed)), "fiche_id").limit(n)


def progress(items: DataFrame) -> DataFrame:
    """(kind, name, n): items by state and by tag, and in all."""
    total = items.agg(F.count(F.lit(1)).alias("n")).select(F.lit("all").alias("kind"), F.lit("all").alias("name"), "n")
    states = items.groupBy(F.lit("state").alias("kind"), F.col("expected_state").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    tags = items.select("id", F.explode(F.array_distinct("tags")).alias("name")).groupBy(F.lit("tag").alias("kind"), "name").agg(F.count(F.lit(1)).alias("n"))
    return total.unionByName(states).unionByName(tags)


def derived_tags(items: DataFrame) -> DataFrame:
    """Items whose multi-turn tag follows their history."""
    rest = F.array_remove(F.coalesce("tags", F.array().cast("array<string>")), MULTI_TURN)
    return items.withColumn("tags", F.when(_some("history"), F.array_append(rest, F.lit(MULTI_TURN))).otherwise(rest))


def next_id(items: DataFrame, last_given: int = 0) -> str:
    """The id after the greatest one in use and the last one given, so that none is given twice."""
    top = items.select(F.max(F.expr("try_cast(regexp_extract(id, '^gs-([0-9]+)$', 1) AS int)"))).first()[0]
    return ID_FORM % (max(top or 0, last_given) + 1)


def pick(lines: Column, ids: Column) -> Column:
    """For each line of a model's answer, the first id in order that it holds; lines without one give nothing."""
    found = F.transform(lines, lambda x: F.get(F.filter(F.array_sort(ids), lambda i: F.contains(x, i)), F.lit(0)))
    return F.array_distinct(F.filter(found, lambda i: i.isNotNull()))
