"""Registered retrieval and evaluation queries over the table of embeddings, with SQL.

Roles: a vector's label gives its register (even: guides, odd: articles) and section; every vector whose id is divisible
by 20 is a query, against all vectors. The sparse side holds the components above 0.1. The rescoring model stands in
for one: a logistic function of the similarity of the first sixteen components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import sigmoid
from lexweave.operators import metrics, search
from lexweave.plans.arms import ARMS, Index, _by_register, _dense, _expanded, _hybrid
from lexweave.session import cut, read


def index(spark: SparkSession, d: str) -> Index:
    rows = read(spark, d, "embeddings").where("vec_id IS NOT NULL AND label IS NOT NULL")
    points = rows.select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "fiche").otherwise("article").alias("register"), F.col("embedding").alias("vector"), F.col("label").alias("section_id"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    components = points.select("id", "register", F.posexplode("vector").alias("token", "w")).select("id", "register", "token", F.round(F.col("w").cast("double"), 3).alias("weight")).where("weight > 0.1")
    asked = components.where("id % 20 = 0").select(F.col("id").alias("qid"), "token", "weight")
    sections = points.where("register = 'fiche'").select("id", F.array(F.col("section_id") + 1, (F.col("section_id") + 3) % 10).alias("section_ids"))

    def score(candidates: DataFrame) -> DataFrame:
        pairs = candidates.select("qid", "id").join(points.select("id", F.slice("vector", 1, 16).alias("a")), "id").join(queries.select("qid", F.slice("vector", 1, 16).alias("b")), "qid")
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
        near = dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))
        return pairs.select("qid", "id", sigmoid(3 * near - 1).alias("new_score"))

    return Index(points, queries, components, asked, sections, score)


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("qid", F.col("rank").cast("int").alias("rank"), "id", "score", "register", F.array_join("provenance", "+").alias("provenance"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_dense(index(spark, d)))


def sparse_topk(spark: SparkSession, d: str) -> DataFrame:
    x = index(spark, d)
    return _flat(search.sparse_legs(x.postings, x.query_postings))


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_hybrid(index(spark, d)))


def section_expansion(spark: SparkSession, d: str) -> DataFrame:
    x = index(spark, d)
    return _flat(search.expand(_hybrid(x).where("register = 'fiche'"), x.fiche_sections, x.points.where("register = 'article'").select("id", "section_id", "vector"), x.queries, shape=x.shape()))


def merged_pool(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_expanded(index(spark, d)))


def _arm(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _flat(ARMS[name](index(spark, d)))

    return run


#: Gold documents of each register per query.
GOLD = 5


def _items(spark: SparkSession, d: str, x: Index) -> DataFrame:
    """Annotated queries: gold are the GOLD vectors of each register that are nearest by the first sixteen components,
    over all vectors; a fifth of the queries are to be answered without an article."""
    short = lambda rows: rows.withColumn("vector", F.slice("vector", 1, 16))
    near = cut(search.dense_legs(short(x.points), short(x.queries), GOLD))
    gold = near.groupBy("qid").agg(*(F.array_sort(F.collect_set(F.when(F.col("register") == r, F.col("id").cast("string")))).alias(n) for r, n in (("fiche", "f"), ("article", "a"))))  # GOLD entries
    none = F.array().cast("array<string>")
    f, a = F.coalesce("f", none), F.coalesce("a", none)
    floor = F.col("qid") % 100 >= 80
    return x.queries.select("qid").join(gold, "qid", "left").select("qid", F.when(floor, metrics.STATE_WITHOUT_ARTICLE).otherwise("reponse").alias("expected_state"), f.alias("gold_fiches"), F.when(floor, none).otherwise(a).alias("gold_articles"), F.transform(f, lambda i: F.concat(F.lit("point "), i, F.lit("."))).alias("gold_spans"))


def _scores(spark: SparkSession, d: str, arm: str) -> DataFrame:
    """Scores of the first or the last arm; the merged pool is written once, since contexts and candidates come of it."""
    x = index(spark, d)
    pool = cut(search.merge(*_by_register(_dense(x)))) if arm == "rung1" else _expanded(x)
    contexts = search.rank(pool).withColumn("slot", F.col("rank")) if arm == "rung1" else search.quota(search.rescore(pool, x.score), x.queries)
    return metrics.score_items(_items(spark, d, x), contexts.withColumn("text", F.concat(F.lit("point "), F.col("id").cast("string"), F.lit("."))), pool)


def item_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The nine metrics of the first arm, per query."""
    rows = _scores(spark, d, "rung1")
    return rows.select("qid", *(F.round(F.col(m).cast("double"), 9).alias(m) for m in metrics.METRICS))


def paired_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Paired comparison of the first and the last arm, with the exact sign test."""
    return metrics.compare(metrics.long_scores(_scores(spark, d, "rung1")), metrics.long_scores(_scores(spark, d, "rung5")))


def adoption(spark: SparkSession, d: str) -> DataFrame:
    return metrics.verdict(paired_comparison(spark, d), metrics.primary_of("rung5"))


def floor_choices(spark: SparkSession, d: str) -> DataFrame:
    """How many items each floor of the grid gets right."""
    x = index(spark, d)
    pool = search.rescore(_expanded(x), x.score).where("register = 'article'")
    pool = pool.select("qid", "id", F.col("id").alias("doc"), "score", F.array_contains("provenance", "expansion").alias("expansion"), "rank")
    return metrics.floor_sweep(pool, _items(spark, d, x), [round(0.025 * i, 3) for i in range(21)])


def chosen_floor(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_floor(floor_choices(spark, d))


QUERIES = {f.__name__: f for f in (dense_topk, sparse_topk, hybrid_fusion, section_expansion, merged_pool)}
QUERIES |= {f"{name}_arm": _arm(name) for name in ARMS}
QUERIES |= {f.__name__: f for f in (item_metrics, paired_comparison, adoption, floor_choices, chosen_floor)}

# --- SQL -------------------------------------------------------------------------------------------------------------

_BASE = """
pts AS (SELECT vec_id AS id, CASE WHEN label % 2 = 0 THEN 'fiche' ELSE 'article' END AS register, label, embedding::DOUBLE[] AS v FROM embeddings),
qs AS (SELECT vec_id AS qid, label, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0),
sims AS (SELECT qid, id, register, pts.label, round(list_cosine_similarity(q, v), 6) AS score FROM qs, pts),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, register ORDER BY score DESC, id) AS rank FROM sims) WHERE rank <= 20),
post AS (SELECT * FROM (SELECT id, register, unnest(range(1, 65)) AS token, round(unnest(v), 3) AS weight FROM pts) WHERE weight > 0.1),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, register ORDER BY score DESC, id) AS rank FROM (
  SELECT q.id AS qid, p.id AS id, p.register, round(sum(p.weight * q.weight), 6) AS score FROM post p JOIN post q ON p.token = q.token AND q.id % 20 = 0 GROUP BY 1, 2, 3)) WHERE rank <= 20),
hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, register ORDER BY score DESC, id) AS rank FROM (
  SELECT qid, id, register, round(sum(w * score), 6) AS score FROM (
    SELECT qid, id, register, score, CASE register WHEN 'fiche' THEN 2.0::DOUBLE / 3 ELSE 1.0::DOUBLE / 3 END AS w FROM dense
    UNION ALL SELECT qid, id, register, score, CASE register WHEN 'fiche' THEN 1.0::DOUBLE / 3 ELSE 2.0::DOUBLE / 3 END FROM sparse) GROUP BY 1, 2, 3)) WHERE rank <= 20),
wanted AS (SELECT DISTINCT qid, unnest([label + 1, (label + 3) % 10]) AS section FROM hybrid JOIN pts USING (id) WHERE hybrid.register = 'fiche' AND rank <= 3),
expansion AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.qid ORDER BY score DESC, id) AS rank FROM sims s JOIN wanted w ON w.qid = s.qid AND w.section = s.label WHERE s.register = 'article') WHERE rank <= 40),
"""


def _merged(name: str, *pools: str) -> str:
    union = " UNION ALL ".join(f"SELECT qid, id, register, score, rank, {i} AS pool, '{p}' AS prov FROM {src} WHERE register = '{r}'" for i, (src, r, p) in enumerate(x.split(":") for x in pools))
    return f"""{name} AS (SELECT qid, id, register, score, prov AS provenance, row_number() OVER (PARTITION BY qid ORDER BY pool, old) AS rank FROM (
  SELECT qid, id, arg_min(register, pool) AS register, arg_min(score, pool) AS score, min(pool) AS pool, arg_min(rank, pool) AS old, array_to_string(list_sort(list_distinct(list(prov))), '+') AS prov FROM ({union}) GROUP BY 1, 2)),
"""


_TOP = """{name} AS (SELECT qid, id, register, score, provenance, rank FROM (SELECT qid, id, register, score, provenance, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rank FROM {src}) WHERE rank <= 8),
"""
_RESCORED = """rescored AS (SELECT m.qid, m.id, m.register, m.rank, m.provenance, round(1 / (1 + exp(-(3 * list_cosine_similarity(qs.q[1:16], pts.v[1:16]) - 1))), 6) AS score FROM m3 m JOIN pts ON pts.id = m.id JOIN qs ON qs.qid = m.qid),
"""
_QUOTA = """qf AS (SELECT *, 0 AS part FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS n FROM rescored WHERE register = 'fiche') WHERE n <= 4),
qa AS (SELECT *, 1 AS part FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score + CASE WHEN provenance LIKE '%expansion%' THEN 0.1 ELSE 0 END, 6) DESC, rank) AS n FROM rescored WHERE register = 'article' AND score >= 0.5) WHERE n <= 4),
r5 AS (SELECT qid, id, register, score, provenance, row_number() OVER (PARTITION BY qid ORDER BY part, n) AS rank FROM (
  SELECT qid, id, register, score, provenance, part, n FROM qf UNION ALL SELECT qid, id, register, score, provenance, part, n FROM qa
  UNION ALL SELECT qid, NULL, 'no-article-marker', 0.0, '', 1, 1 FROM qs WHERE qid NOT IN (SELECT qid FROM qa))),
"""
_ALL = (
    "WITH " + _BASE + _merged("m1", "dense:fiche:search", "dense:article:search") + _merged("m2", "hybrid:fiche:search", "hybrid:article:search")
    + _merged("m3", "hybrid:fiche:search", "hybrid:article:search", "expansion:article:expansion")
    + _TOP.format(name="r1", src="m1") + _TOP.format(name="r2", src="m2") + _TOP.format(name="r3", src="m3") + _RESCORED + _TOP.format(name="r4", src="rescored") + _QUOTA
)
_FLAT = "done AS (SELECT 1) SELECT qid, rank::INT AS rank, id, score, register, {p} AS provenance FROM {src}"
_GOLD = """
near AS (SELECT qid, id, register, row_number() OVER (PARTITION BY qid, register ORDER BY round(list_cosine_similarity(q[1:16], v[1:16]), 6) DESC, id) AS n FROM qs, pts),
gold AS (SELECT qid, list(id) FILTER (register = 'fiche') AS f, list(id) FILTER (register = 'article') AS a FROM near WHERE n <= 5 GROUP BY 1),
items AS (SELECT qid, CASE WHEN qid % 100 >= 80 THEN 'reponse_sans_article' ELSE 'reponse' END AS state, coalesce(f, []) AS gf, CASE WHEN qid % 100 >= 80 THEN [] ELSE coalesce(a, []) END AS ga FROM qs LEFT JOIN gold USING (qid)),
"""


def _measured(name: str, contexts: str, pool: str) -> str:
    rec = lambda x, g: f"CASE WHEN len({g}) > 0 THEN len(list_intersect({x}, {g}))::DOUBLE / len({g}) END"
    return f"""c_{name} AS (SELECT i.qid, i.state, i.gf, i.ga,
    coalesce((SELECT list(id ORDER BY rank) FROM {contexts} c WHERE c.qid = i.qid AND c.register = 'fiche'), []) AS f, coalesce((SELECT list(id ORDER BY rank) FROM {contexts} c WHERE c.qid = i.qid AND c.register = 'article'), []) AS a,
    (SELECT list(id) FROM {pool} p WHERE p.qid = i.qid AND p.register = 'fiche') AS pf, (SELECT list(id) FROM {pool} p WHERE p.qid = i.qid AND p.register = 'article') AS pa FROM items i),
s_{name} AS (SELECT qid, {rec('f[1:4]', 'gf')} AS fiche_recall_at_4, {rec('f[1:10]', 'gf')} AS fiche_recall_at_10, {rec('pf', 'gf')} AS fiche_recall_at_candidate,
    {rec('a[1:4]', 'ga')} AS article_recall_at_4, {rec('a[1:10]', 'ga')} AS article_recall_at_10, {rec('pa', 'ga')} AS article_recall_at_candidate,
    CASE WHEN len(ga) > 0 THEN (len(a) = 0)::INT::DOUBLE END AS zero_articles, CASE WHEN state = 'reponse_sans_article' THEN (len(a) = 0)::INT::DOUBLE END AS floor_correct, {rec('f[1:4]', 'gf')} AS span_containment_at_4 FROM c_{name}),
"""


_SIGN = "CASE WHEN i + r = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, least(i, r) + 1), lambda k: exp(lgamma(i + r + 1) - lgamma(k + 1) - lgamma(i + r - k + 1) - (i + r) * ln(2))))) END"
_COMPARED = (
    _ALL + _GOLD + _measured("one", "r1", "m1") + _measured("five", "r5", "m3")
    + "cells AS (" + " UNION ALL ".join(f"SELECT qid, '{m}' AS metric, o.{m} AS a, f.{m} AS b FROM s_one o JOIN s_five f USING (qid)" for m in metrics.METRICS) + "),"
    + """counts AS (SELECT metric, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_paired, count(*) FILTER (CASE metric WHEN 'zero_articles' THEN b < a ELSE b > a END) AS i,
     count(*) FILTER (CASE metric WHEN 'zero_articles' THEN b > a ELSE b < a END) AS r FROM cells GROUP BY 1)
"""
)

SQL = {name: _ALL + _FLAT.format(src=src, p="'search'") for name, src in (("dense_topk", "dense"), ("sparse_topk", "sparse"), ("hybrid_fusion", "hybrid"))}
SQL |= {"section_expansion": _ALL + _FLAT.format(src="expansion", p="'expansion'"), "merged_pool": _ALL + _FLAT.format(src="m3", p="provenance")}
SQL |= {f"rung{i}_arm": _ALL + _FLAT.format(src=f"r{i}", p="provenance") for i in range(1, 6)}
SQL |= {
    "item_metrics": _ALL + _GOLD + _measured("one", "r1", "m1") + "done AS (SELECT 1) SELECT qid, " + ", ".join(f"round({m}, 9) AS {m}" for m in metrics.METRICS) + " FROM s_one",
    "paired_comparison": _COMPARED + f"SELECT metric, n_paired, i AS improved, r AS regressed, i - r AS net, round({_SIGN}, 9) AS p FROM counts",
    "adoption": _COMPARED
    + """SELECT primary_metric, net, net >= 4 AS threshold_met, guards, net >= 4 AND guards = '' AS adopt FROM (
  SELECT 'zero_articles' AS primary_metric, max(i - r) FILTER (metric = 'zero_articles') AS net,
    coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (metric IN ('fiche_recall_at_4', 'article_recall_at_4', 'floor_correct') AND r - i > 1), '') AS guards FROM counts)""",
    "floor_choices": _ALL
    + _GOLD
    + """grid AS (SELECT round(0.025 * i, 3) AS floor FROM range(21) t(i)),
kept AS (SELECT * FROM (SELECT qid, floor, id, row_number() OVER (PARTITION BY qid, floor ORDER BY round(score + CASE WHEN provenance LIKE '%expansion%' THEN 0.1 ELSE 0 END, 6) DESC, rank) AS n
  FROM rescored, grid WHERE register = 'article' AND score >= floor) WHERE n <= 4),
got AS (SELECT qid, floor, list(id) AS got FROM kept GROUP BY 1, 2)
SELECT floor::DOUBLE AS floor, count(*) AS n_items, count(*) FILTER (CASE state WHEN 'reponse_sans_article' THEN got IS NULL ELSE coalesce(list_has_any(got, ga), false) END) AS n_correct
FROM items CROSS JOIN grid LEFT JOIN got USING (qid, floor) GROUP BY 1""",
}
SQL["chosen_floor"] = f"SELECT floor, n_correct FROM ({SQL['floor_choices']}) ORDER BY n_correct DESC, floor DESC LIMIT 1"
