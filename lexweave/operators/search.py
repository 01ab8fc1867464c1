"""Exact retrieval over a table of queries: legs, fusion, expansion, merge, rank, rescoring and quota.

Candidates are rows (qid, rank, id, score, register, provenance): one pool of ranked candidates per query. Scores are
rounded to SCORE_DIGITS before they order anything, and ids break ties, so every pool has one order on any cluster.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 6
# Sizes of pools, depths, weights (dense, sparse), quotas and the floor.
LEG_LIMIT, TOP_K, EXPANSION_DEPTH, EXPANSION_CAP = 20, 8, 3, 40
FICHE_WEIGHTS, ARTICLE_WEIGHTS = (2 / 3, 1 / 3), (1 / 3, 2 / 3)
FICHE_QUOTA, ARTICLE_QUOTA, FLOOR, MARGIN = 4, 4, 0.5, 0.1
MARKER = "no-article-marker"
#: Points and queries of one block of the similarity join.
POINT_BLOCK, QUERY_BLOCK = 50_000, 2_000

CANDIDATES = ["qid", "rank", "id", "score", "register", "provenance"]


def top(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows of every query as its pool. Spark prunes each task to `limit` rows a query before the shuffle."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit)


def _pool(rows: DataFrame, limit: int, provenance: str = "search") -> DataFrame:
    """Pools of the best `limit` rows of each register per query, from one window."""
    rows = rows.withColumn("score", F.round("score", SCORE_DIGITS))
    order = Window.partitionBy("qid", "register").orderBy(F.desc("score"), F.asc("id"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.withColumn("provenance", F.array(F.lit(provenance))).select(*CANDIDATES)


@dataclass
class Shape:
    """Sizes that a similarity join is planned by: points, queries, and the width of vectors."""

    points: int
    queries: int
    width: int


def shape_of(points: DataFrame, queries: DataFrame) -> Shape:
    """One width holds for the whole job, the most frequent one of the points, the smaller among equals. One pass."""
    both = points.select(F.size("vector").alias("w"), F.lit(0).alias("q")).unionByName(queries.select(F.size("vector").alias("w"), F.lit(1).alias("q")))
    sizes = both.groupBy("q", "w").agg(F.count(F.lit(1)).alias("n"))
    r = sizes.agg(F.sum(F.when(F.col("q") == 0, F.col("n"))).alias("n"), F.sum(F.when(F.col("q") == 1, F.col("n"))).alias("m"), F.min(F.when((F.col("q") == 0) & (F.col("w") > 0), F.struct(-F.col("n"), "w"))).alias("most")).first()
    return Shape(r["n"] or 0, r["m"] or 0, r["most"][1] if r["most"] else 0)


def _matrix(t: pa.Table, width: int) -> tuple[pa.Table, np.ndarray]:
    """The rows of a table with a finite vector of this width that isn't zero, and the vectors, without Python objects."""
    if not width:
        return t.slice(0, 0), np.zeros((0, 0))
    t = t.filter(pc.fill_null(pc.equal(pc.list_value_length(t.column("vector")), width), False)).combine_chunks()
    x = np.zeros((0, width)) if not t.num_rows else pc.list_flatten(t.column("vector")).to_numpy().reshape(-1, width)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return (t, x) if good.all() else (t.filter(pa.array(good)), x[good])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(qs: np.ndarray, ids: np.ndarray, scores: np.ndarray, limit: int) -> np.ndarray:
    """Places of the `limit` best entries of every query, by score and then id."""
    order = np.lexsort((ids, -scores, qs))
    q = qs[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else q
    return order[np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q))) < limit]


#: Points that are multiplied with a block of queries at once.
CHUNK = 4096


def similarity(points: DataFrame, queries: DataFrame, limit: int, shape: Shape | None = None, within: str | None = None) -> DataFrame:
    """(qid, id, register, score): per query and register at least its `limit` most similar points by cosine.

    points: (id, register, vector), queries: (qid, vector); ids and qids are numbers or texts. Exact. Points and queries
    are hashed to blocks, each pair of blocks meets in one task, is multiplied as matrices, and gives `limit` rows a
    query and register at most; no side is broadcast and none is collected. With `within`, a column of both sides, a
    query meets only the points of its own group (it may have rows in several); a large group is several blocks.
    Vectors that are null, not finite, of another width than the `shape`'s or zero have no similarity and are left out.
    """
    shape = shape or shape_of(points, queries)
    qb = max(1, -(-shape.queries // QUERY_BLOCK))
    many = lambda n: F.greatest(F.ceil(n / POINT_BLOCK), F.lit(1)).cast("int")
    left, right = points.where("vector IS NOT NULL"), queries.where("vector IS NOT NULL")
    keys = ["g", "pb", "qb"]
    if within is None:
        # a few blocks more than needed, so that small tables still use the cores there are
        blocks = F.lit(max(-(-shape.points // POINT_BLOCK), min(8, -(-shape.points // 500)), 1))
        left, right = left.withColumn("g", F.lit(0)), right.withColumn("g", F.lit(0)).withColumn("blocks", blocks)
        left = left.withColumn("blocks", blocks)
    elif shape.points <= POINT_BLOCK:  # no group can be more than a block
        left, right = (df.where(F.col(within).isNotNull()).withColumn("g", F.col(within)).withColumn("blocks", F.lit(1)) for df in (left, right))
    else:
        sizes = left.where(F.col(within).isNotNull()).groupBy(F.col(within).alias("g")).agg(many(F.count(F.lit(1))).alias("blocks"))
        left = left.withColumn("g", F.col(within)).join(sizes, "g")
        right = right.withColumn("g", F.col(within)).join(sizes, "g")
    left = left.select("g", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"), "id", "register", "vector")
    right = right.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("pb"), F.pmod(F.xxhash64("qid"), F.lit(qb)).cast("int").alias("qb"), "qid", "vector")
    width = shape.width

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        a, x = _matrix(a, width)
        b, y = _matrix(b, width)
        ids, qids = a.column("id").combine_chunks(), b.column("qid").combine_chunks()
        found = []
        if len(x) and len(y):
            y, place = _unit(y), np.empty(len(x), np.int64)
            place[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(x))  # ids in order, whatever their type
            register = a.column("register").combine_chunks().dictionary_encode()
            kinds = register.indices.fill_null(-1).to_numpy()
            for kind in np.unique(kinds):
                of = np.flatnonzero(kinds == kind)
                of, parts = of[np.argsort(place[of])], []
                for low in range(0, len(of), CHUNK):
                    some = of[low : low + CHUNK]
                    scores = np.round(y @ _unit(x[some]).T, SCORE_DIGITS)
                    k = min(limit, len(some))
                    least = np.partition(scores, len(some) - k, axis=1)[:, len(some) - k, None]
                    above, equal = scores > least, scores == least
                    equal &= np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)  # of equal scores those with the first ids
                    q, p = np.nonzero(above | equal)
                    parts.append((q, some[p], scores[q, p]))
                q, p, sc = (np.concatenate([x[i] for x in parts]) for i in range(3))
                best = _best(q, place[p], sc, limit)
                found.append((q[best], p[best], sc[best]))
        q, p, s = (np.concatenate([f[i] for f in found]) if found else np.empty(0, (np.int64, np.int64, float)[i]) for i in range(3))
        names = ["qid", "id", "register", "score"]
        return pa.table([qids.take(pa.array(q)), ids.take(pa.array(p)), a.column("register").combine_chunks().take(pa.array(p)), pa.array(s, pa.float64())], names=names)

    kinds = dict(points.dtypes)["id"], dict(queries.dtypes)["qid"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, f"qid {kinds[1]}, id {kinds[0]}, register string, score double")


def dense_leg(points: DataFrame, queries: DataFrame, register: str, limit: int = LEG_LIMIT) -> DataFrame:
    """The most similar points of a register per query."""
    return _pool(similarity(points.where(F.col("register") == register), queries, limit), limit)


def dense_legs(points: DataFrame, queries: DataFrame, limit: int = LEG_LIMIT, shape: Shape | None = None) -> DataFrame:
    """The legs of all registers, from one similarity join and one window."""
    return _pool(similarity(points, queries, limit, shape), limit)


#: Parts that the postings of one token are divided into where they meet the queries'.
TOKEN_PARTS = 8


def sparse_legs(postings: DataFrame, query_postings: DataFrame, limit: int = LEG_LIMIT) -> DataFrame:
    """Points by sparse dot product. postings: (id, register, token, weight), query_postings: (qid, token, weight).

    Points that share no token with the query aren't candidates. A frequent token's postings are divided by a hash of
    the point into TOKEN_PARTS, each of which meets all queries that hold the token; products of one point are summed
    where they arise before they are shuffled.
    """
    q = query_postings.select("qid", "token", F.col("weight").alias("w"), F.explode(F.sequence(F.lit(0), F.lit(TOKEN_PARTS - 1))).alias("part"))
    p = postings.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(TOKEN_PARTS)).cast("int"))
    rows = p.join(q, ["token", "part"]).groupBy("qid", "id", "register").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))
    return _pool(rows, limit)


def sparse_leg(postings: DataFrame, query_postings: DataFrame, register: str, limit: int = LEG_LIMIT) -> DataFrame:
    """`sparse_legs` of one register."""
    return sparse_legs(postings.where(F.col("register") == register), query_postings, limit)


def fuse(dense: DataFrame, sparse: DataFrame, weights: tuple[float, float] | dict[str, tuple[float, float]], limit: int = LEG_LIMIT) -> DataFrame:
    """Weighted sum of two pools' scores; a candidate missing on one side counts nought there. One shuffle.

    weights: (dense, sparse), or such a pair by register.
    """

    def weight(side: int) -> Column:
        if not isinstance(weights, dict):
            return F.lit(weights[side])
        return reduce(lambda c, r: c.when(F.col("register") == r, weights[r][side]), weights, F)

    both = dense.withColumn("w", weight(0)).unionByName(sparse.withColumn("w", weight(1)))
    rows = both.groupBy("qid", "id", "register").agg(F.sum(F.col("w") * F.col("score")).alias("score"))
    return _pool(rows, limit)


def expand(fiche_pool: DataFrame, fiche_sections: DataFrame, articles: DataFrame, queries: DataFrame, depth: int = EXPANSION_DEPTH, cap: int = EXPANSION_CAP, shape: Shape | None = None) -> DataFrame:
    """Articles of the sections that the first `depth` fiche candidates name, by similarity, `cap` at most.

    fiche_sections: (id, section_ids), articles: (id, section_id, vector). The sections gate, similarity orders; a query
    whose fiches name no section has no row. It's the similarity join with the section as group, so a section that holds
    a tenth of all articles is several blocks, and a query gives `cap` rows a block.
    """
    wanted = fiche_pool.where(F.col("rank") <= depth).join(fiche_sections, "id").select("qid", F.explode("section_ids").alias("section_id")).distinct()
    asked = wanted.where("section_id IS NOT NULL").join(queries.select("qid", "vector"), "qid")
    points = articles.select("id", F.lit("article").alias("register"), "section_id", "vector")
    rows = similarity(points, asked, cap, shape, within="section_id").groupBy("qid", "id", "register").agg(F.max("score").alias("score"))
    return _pool(rows, cap, "expansion")


def merge(*pools: DataFrame) -> DataFrame:
    """Candidates of all pools, each once: score and register of the first pool that has it, provenance of all.

    `rank` is the place of first occurrence over the pools in the order given.
    """
    rows = None
    for i, p in enumerate(pools):
        p = p.withColumn("at", F.struct(F.lit(i).alias("pool"), F.col("rank").alias("rank")))
        rows = p if rows is None else rows.unionByName(p)
    one = rows.groupBy("qid", "id").agg(
        F.min(F.struct("at", "score", "register")).alias("f"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("provenance")))).alias("provenance"),  # one entry a pool at most
    )
    one = one.select("qid", "id", F.col("f.at").alias("at"), F.col("f.score").alias("score"), F.col("f.register").alias("register"), "provenance")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("at"))).select(*CANDIDATES)


def rank(candidates: DataFrame, limit: int = TOP_K) -> DataFrame:
    """The best of merged candidates over all registers; equal scores keep the merged order."""
    return top(candidates.withColumnRenamed("rank", "old"), limit, F.desc("score"), F.asc("old")).select(*CANDIDATES)


def rescore(candidates: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replaces the scores by those of a model: `score` gets the candidates and returns (qid, id, new_score)."""
    fresh = score(candidates).select("qid", "id", F.round("new_score", SCORE_DIGITS).alias("new_score"))
    return candidates.join(fresh, ["qid", "id"]).withColumn("score", F.col("new_score")).select(*CANDIDATES)


def quota(candidates: DataFrame, qids: DataFrame, fiches: int = FICHE_QUOTA, articles: int = ARTICLE_QUOTA, floor: float = FLOOR, margin: float = MARGIN) -> DataFrame:
    """Contexts (qid, slot, id, score, register, provenance): the best fiches without floor, then the best articles.

    An article must reach the floor with its own score; expansion gives it `margin` in the order only. A query without
    any such article gets the marker row. Equal scores keep the merged order.
    """
    article = F.col("register") == "article"
    own = candidates.where((F.col("register") == "fiche") | (article & (F.col("score") >= floor)))
    bonus = F.when(article & F.array_contains("provenance", "expansion"), margin).otherwise(0.0)
    order = Window.partitionBy("qid", "register").orderBy(F.round(F.col("score") + bonus, SCORE_DIGITS).desc(), F.asc("old"))
    kept = own.withColumnRenamed("rank", "old").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.when(article, articles).otherwise(fiches))
    none = qids.select("qid").distinct().join(kept.where(article).select("qid").distinct(), "qid", "left_anti")
    id_type = dict(candidates.dtypes)["id"]
    marker = none.select("qid", F.lit(1).alias("rank"), F.lit(None).cast(id_type).alias("id"), F.lit(0.0).alias("score"), F.lit(MARKER).alias("register"), F.array().cast("array<string>").alias("provenance"))
    rows = kept.select(*CANDIDATES, F.when(article, 1).otherwise(0).alias("part")).unionByName(marker.withColumn("part", F.lit(1)))
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy("qid").orderBy("part", "rank"))).select("qid", "slot", "id", "score", "register", "provenance")


def floor_met(contexts: DataFrame) -> DataFrame:
    return contexts.groupBy("qid").agg((~F.bool_or(F.col("register") == MARKER)).alias("floor_met"))


def by_key(points: DataFrame, keys: DataFrame) -> DataFrame:
    """All pieces of the articles that queries name: keys (qid, lookup_key), points (id, lookup_key, chunk_index)."""
    rows = points.join(keys, "lookup_key").withColumn("score", F.lit(1.0)).withColumn("register", F.lit("article")).withColumn("provenance", F.array(F.lit("lookup")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_index", "id"))).select(*CANDIDATES)


def short_circuit(turns: DataFrame, known: DataFrame, text: str, reference: Callable[[Column], Column]) -> DataFrame:
    """turns plus (path, lookup_key): resolved, membership_failed or no_reference by the first reference of each text."""
    rows = turns.withColumn("_ref", reference(F.col(text)))
    keys = known.select(F.col("lookup_key").alias("_key")).where("_key IS NOT NULL").distinct()
    rows = rows.join(keys, F.col("_ref") == F.col("_key"), "left")
    path = F.when(F.col("_ref").isNull(), "no_reference").when(F.col("_key").isNull(), "membership_failed").otherwise("resolved")
    return rows.withColumn("path", path).withColumn("lookup_key", F.col("_key")).drop("_ref", "_key")
