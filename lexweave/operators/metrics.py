"""Evaluation of retrieval plans: recall family, paired comparison, sign test, floor sweep, judge calibration.

Undefined isn't nought: a metric without a gold set is null and stays null through joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators.search import ARTICLE_QUOTA, FLOOR, MARGIN, MARKER, SCORE_DIGITS

# The nine scored fields, those a decision rests on, the inverted one, and the adoption rule.
METRICS = (
    "fiche_recall_at_4", "fiche_recall_at_10", "fiche_recall_at_candidate", "article_recall_at_4", "article_recall_at_10",
    "article_recall_at_candidate", "zero_articles", "floor_correct", "span_containment_at_4",
)
DECISION = ("fiche_recall_at_4", "article_recall_at_4", "zero_articles", "floor_correct")
INVERTED = ("zero_articles",)
ADOPT_FROM, GUARD_LOSS = 4, 1
# The primary metric of each registered change; none for the first arm.
PRIMARY = {
    "rung1": None, "rung2": "article_recall_at_4", "rung3": "article_recall_at_4", "rung4": "fiche_recall_at_4", "rung5": "zero_articles", "rung6": "fiche_recall_at_4",
    "ab_article_breadcrumb": "article_recall_at_4", "ab_fiche_header": "fiche_recall_at_4",
}
STATE_WITHOUT_ARTICLE = "reponse_sans_article"


def recall(present: Column, gold: Column) -> Column:
    """Share of the gold set that is present; null where the gold set is null or empty. Repeats count once."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(F.coalesce(present, F.array().cast("array<string>")), g)) / F.size(g))


def ranked_keys(contexts: DataFrame, register: str, key: str, order: str = "slot") -> DataFrame:
    """(qid, keys): the distinct documents of a register in order of their first piece; the marker is never one."""
    first = contexts.where(F.col("register") == register).where(F.col(key).isNotNull()).groupBy("qid", key).agg(F.min(order).alias("at"))
    return first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col(key).cast("string").alias("k")))), lambda x: x["k"]).alias("keys"))  # one entry a context


def score_items(items: DataFrame, contexts: DataFrame, candidates: DataFrame, key: str = "id") -> DataFrame:
    """One row per item with the metrics of METRICS.

    items: (qid, expected_state, gold_fiches, gold_articles, gold_spans, all arrays of strings); contexts: (qid, slot,
    register, key, text); candidates: (qid, register, key, rank), all pools before the cut. Items without contexts count
    as having found nothing. An item without any candidate pool has null at-candidate metrics.
    """
    fiches = ranked_keys(contexts, "fiche", key).withColumnRenamed("keys", "f")
    articles = ranked_keys(contexts, "article", key).withColumnRenamed("keys", "a")
    pool = candidates.groupBy("qid").agg(
        F.collect_set(F.when(F.col("register") == "fiche", F.col(key).cast("string"))).alias("pf"),  # a pool's size at most
        F.collect_set(F.when(F.col("register") == "article", F.col(key).cast("string"))).alias("pa"),
    )
    pieces = contexts.where("register = 'fiche'").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("slot"))).where("n <= 4").groupBy("qid").agg(F.collect_list("text").alias("texts"))
    rows = items.join(fiches, "qid", "left").join(articles, "qid", "left").join(pool, "qid", "left").join(pieces, "qid", "left")
    none = F.array().cast("array<string>")
    f, a, texts = (F.coalesce(F.col(c), none) for c in ("f", "a", "texts"))
    no_articles = F.size(a) == 0
    at = lambda x, g, k: recall(F.slice(x, 1, k), F.col(g))
    spans = F.array_distinct(F.col("gold_spans"))
    held = F.filter(spans, lambda s: F.exists(texts, lambda t: F.contains(t, s)))
    return rows.select(
        "qid",
        at(f, "gold_fiches", 4).alias("fiche_recall_at_4"),
        at(f, "gold_fiches", 10).alias("fiche_recall_at_10"),
        F.when(F.col("pf").isNotNull(), recall(F.col("pf"), F.col("gold_fiches"))).alias("fiche_recall_at_candidate"),
        at(a, "gold_articles", 4).alias("article_recall_at_4"),
        at(a, "gold_articles", 10).alias("article_recall_at_10"),
        F.when(F.col("pa").isNotNull(), recall(F.col("pa"), F.col("gold_articles"))).alias("article_recall_at_candidate"),
        F.when(F.size("gold_articles") > 0, no_articles).alias("zero_articles"),
        F.when(F.col("expected_state") == STATE_WITHOUT_ARTICLE, no_articles).alias("floor_correct"),
        F.when(F.size(spans) > 0, F.size(held) / F.size(spans)).alias("span_containment_at_4"),
    )


def long_scores(scores: DataFrame, key: str = "qid", metrics: Sequence[str] = METRICS) -> DataFrame:
    """(key, metric, value DOUBLE): one row per item and metric, nulls kept; truth values are 1 and 0."""
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return scores.select(key, cells.alias("c")).select(key, "c.metric", "c.value")


def sign_test(improved: Column, regressed: Column) -> Column:
    """Two-sided exact sign test: twice the binomial tail of the smaller count, at most 1; 1 without any pair.

    The terms are built as products of ratios from one over two to the n, taken as logarithms, so n isn't limited.
    """
    n, k = improved + regressed, F.least(improved, regressed)
    steps = F.transform(F.sequence(F.lit(0), k), lambda i: i)
    # sum of C(n, i) / 2^n for i = 0..k, with the running log of C(n, i)
    total = F.aggregate(
        steps,
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            F.when(i == 0, F.lit(0.0)).otherwise(s["log"] + F.log((n - i + 1) / i)).alias("log"),
            (s["sum"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(s["log"] + F.log((n - i + 1) / i)) - n * F.log(F.lit(2.0)))).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def outcomes(incumbent: DataFrame, challenger: DataFrame, key: str = "qid") -> DataFrame:
    """(key, metric, incumbent, challenger, outcome) of two long score tables; outcome is null where a side is undefined.

    The tables must hold the same items: an item of one side only raises an error when it's read.
    """
    both = incumbent.withColumnRenamed("value", "incumbent").withColumn("_l", F.lit(1)).join(challenger.withColumnRenamed("value", "challenger").withColumn("_r", F.lit(1)), [key, "metric"], "full_outer")
    total = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("the runs do not score the same items"))).otherwise(F.lit(True))
    a, b = F.col("incumbent"), F.col("challenger")
    better = F.when(F.col("metric").isin(*INVERTED), b < a).otherwise(b > a)
    outcome = F.when(a.isNull() | b.isNull(), None).when(a == b, "tied").when(better, "improved").otherwise("regressed")
    return both.where(total).select(key, "metric", "incumbent", "challenger", outcome.alias("outcome"))


def compare(incumbent: DataFrame, challenger: DataFrame, key: str = "qid") -> DataFrame:
    """(metric, n_paired, improved, regressed, net, p) per metric."""
    rows = outcomes(incumbent, challenger, key).groupBy("metric").agg(F.count("outcome").alias("n_paired"), F.count_if(F.col("outcome") == "improved").alias("improved"), F.count_if(F.col("outcome") == "regressed").alias("regressed"))
    return rows.withColumn("net", F.col("improved") - F.col("regressed")).withColumn("p", F.round(sign_test(F.col("improved"), F.col("regressed")), 9))


def verdict(comparison: DataFrame, primary: str) -> DataFrame:
    """One row (primary, net, threshold_met, guards, adopt): adopt if the primary metric gains ADOPT_FROM items net and
    no other decision metric loses more than GUARD_LOSS."""
    if primary not in DECISION:
        raise ValueError(f"the primary metric must be one of {DECISION}")
    rows = comparison.where(F.col("metric").isin(*DECISION))
    guard = (F.col("metric") != primary) & (-F.col("net") > GUARD_LOSS)
    out = rows.agg(F.max(F.when(F.col("metric") == primary, F.col("net"))).alias("net"), F.array_join(F.array_sort(F.collect_set(F.when(guard, F.col("metric")))), ",").alias("guards"))  # four metrics
    met = F.col("net") >= ADOPT_FROM
    return out.select(F.lit(primary).alias("primary_metric"), "net", met.alias("threshold_met"), "guards", (met & (F.col("guards") == "")).alias("adopt"))


def primary_of(change: str) -> str:
    """The registered primary metric of a change; unknown changes and the first arm are refused."""
    if change not in PRIMARY:
        raise ValueError(f"{change!r} is not registered")
    if (found := PRIMARY[change]) is None:
        raise ValueError(f"{change!r} has nothing to be compared with")
    return found


def floor_sweep(pools: DataFrame, items: DataFrame, grid: Sequence[float], limit: int = ARTICLE_QUOTA, margin: float = MARGIN) -> DataFrame:
    """(floor, n_items, n_correct): how many items each floor gets right.

    pools: (qid, id, doc, score, expansion BOOLEAN, rank), items: (qid, expected_state, gold_articles). At a floor, the
    articles that reach it, best `limit` with `margin` for expansion, are what the item gets; right is none at all where
    no article is expected, else a gold article among them. Each item is spread over the grid, not joined with it.
    """
    floors = F.explode(F.array(*map(F.lit, grid)))
    spread = items.select("qid", "expected_state", F.array_distinct("gold_articles").alias("gold"), floors.alias("floor"))
    rows = pools.select("*", floors.alias("floor")).where(F.col("score") >= F.col("floor"))
    order = F.round(F.col("score") + F.when(F.col("expansion"), margin).otherwise(0.0), SCORE_DIGITS)
    kept = rows.withColumn("n", F.row_number().over(Window.partitionBy("qid", "floor").orderBy(order.desc(), "rank"))).where(F.col("n") <= limit)
    got = kept.groupBy("qid", "floor").agg(F.collect_set(F.col("doc").cast("string")).alias("got"))  # limit entries
    both = spread.join(got, ["qid", "floor"], "left")
    right = F.when(F.col("expected_state") == STATE_WITHOUT_ARTICLE, F.col("got").isNull()).otherwise(F.coalesce(F.arrays_overlap("got", "gold"), F.lit(False)))
    return both.groupBy("floor").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(right).alias("n_correct"))


def best_floor(sweep: DataFrame) -> DataFrame:
    """The floor with most items right, the higher one among equals."""
    return sweep.agg(F.max(F.struct("n_correct", "floor")).alias("m")).select(F.col("m.floor").alias("floor"), F.col("m.n_correct").alias("n_correct"))


def error_direction(score: Column, label: Column, threshold: float) -> Column:
    """false_pass or false_fail of a judge's score against a human label pass/fail, null where they agree."""
    return F.when((score >= threshold) & (label == "fail"), "false_pass").when((score < threshold) & (label == "pass"), "false_fail")


def calibration(pairs: DataFrame, threshold: float, bar: tuple[int, int] = (10, 12)) -> DataFrame:
    """One row over pairs (metric, clean_score, clean_label, faulted_score, faulted_label): pairs, detected (the faulted
    twin scores strictly less), required, false passes and fails, and whether the judge passes. Any false pass fails it."""
    rows = pairs.select(
        (F.col("faulted_score") < F.col("clean_score")).alias("detected"),
        F.array(error_direction(F.col("clean_score"), F.col("clean_label"), threshold), error_direction(F.col("faulted_score"), F.col("faulted_label"), threshold)).alias("errors"),
    )
    of = lambda kind: F.coalesce(F.sum(F.size(F.filter("errors", lambda e: e == kind))), F.lit(0))
    out = rows.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("detected").alias("n_detected"), of("false_pass").alias("false_passes"), of("false_fail").alias("false_fails"))
    out = out.withColumn("n_required", F.ceil(F.col("n_pairs") * bar[0] / bar[1]))
    return out.withColumn("passed", (F.col("n_detected") >= F.col("n_required")) & (F.col("false_passes") == 0))


def errors_by_metric(pairs: DataFrame, metrics: Sequence[str], threshold: float) -> DataFrame:
    """(metric, direction, n) with a row for every metric and direction, also where there is no error."""
    spark = pairs.sparkSession
    grid = spark.createDataFrame([(m, d) for m in metrics for d in ("false_pass", "false_fail")], "metric string, direction string")
    both = F.explode(F.array(error_direction(F.col("clean_score"), F.col("clean_label"), threshold), error_direction(F.col("faulted_score"), F.col("faulted_label"), threshold)))
    found = pairs.select("metric", both.alias("direction")).where("direction IS NOT NULL").groupBy("metric", "direction").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(found, ["metric", "direction"], "left").select("metric", "direction", F.coalesce("n", F.lit(0)).alias("n"))


def point_coverage(verdicts: Column, points: Column) -> Column:
    """Share of expected points asserted; verdicts ARRAY<STRUCT<index, asserted>> must number the points from 1, each
    once, else it's an error. Null without points."""
    n = F.size(points)
    numbers = F.array_sort(F.transform(verdicts, lambda v: v["index"].cast("int")))
    whole = numbers == F.sequence(F.lit(1), n)
    share = F.size(F.filter(verdicts, lambda v: v["asserted"])) / n
    return F.when(n > 0, F.when(whole, share).otherwise(F.raise_error(F.lit("the verdicts do not number the points")).cast("double")))


__all__ = [n for n in dir() if not n.startswith("_")] + ["FLOOR", "MARKER"]
