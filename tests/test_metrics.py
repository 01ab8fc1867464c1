import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexweave.operators import metrics as m
from lexweave.operators.search import MARKER


def test_undefined_is_not_nought(spark):
    items = spark.createDataFrame([(0, "reponse", ["1", "2", "2"], ["10"], ["x"]), (1, "reponse_sans_article", ["1"], [], []), (2, "refus:hors_corpus", None, None, None), (3, "reponse", ["1"], ["10"], ["absent"])], "qid long, expected_state string, gold_fiches array<string>, gold_articles array<string>, gold_spans array<string>")
    contexts = spark.createDataFrame([(0, 1, "fiche", 1, "a x b"), (0, 2, "fiche", 1, "c"), (0, 3, MARKER, None, None), (1, 1, "article", 10, "t")], "qid long, slot int, register string, id long, text string")
    pools = spark.createDataFrame([(0, "fiche", 1, 1), (0, "fiche", 2, 2), (0, "article", 10, 1)], "qid long, register string, id long, rank int")
    got = {r.qid: r for r in m.score_items(items, contexts, pools).collect()}
    assert (got[0].fiche_recall_at_4, got[0].fiche_recall_at_candidate, got[0].article_recall_at_4, got[0].article_recall_at_candidate, got[0].zero_articles, got[0].span_containment_at_4, got[0].floor_correct) == (0.5, 1.0, 0.0, 1.0, True, 1.0, None)
    assert got[1].floor_correct is False and got[1].zero_articles is None and got[1].article_recall_at_4 is None and got[1].fiche_recall_at_candidate is None
    assert all(got[2][x] is None for x in m.METRICS)
    assert got[3].zero_articles is True and got[3].fiche_recall_at_4 == 0.0 and got[3].span_containment_at_4 == 0.0


def test_sign_test(spark):
    pairs = [(a, b) for a in range(16) for b in range(16)] + [(30, 70), (400, 300)]

    def exact(a, b):
        n, k = a + b, min(a, b)
        return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)

    df = spark.createDataFrame(pairs, "a int, b int").select("a", "b", m.sign_test(F.col("a"), F.col("b")).alias("p"))
    assert all(r.p == pytest.approx(exact(r.a, r.b), rel=1e-9) for r in df.collect())


# Published outcomes: net change, discordant pairs and p of registered comparisons.
@pytest.mark.parametrize("net,p", [(-3, 0.25), (10, 0.0020), (14, 0.0001)])
def test_published_p_values(spark, net, p):
    a, b = (net, 0) if net > 0 else (0, -net)
    got = spark.range(1).select(m.sign_test(F.lit(a), F.lit(b))).first()[0]
    assert round(got, 4) == p


def long(spark, values, metric="article_recall_at_4"):
    return spark.createDataFrame([(i, metric, v) for i, v in enumerate(values)], "qid long, metric string, value double")


def test_comparison_and_verdict(spark):
    def run(base, fiche, zero, floor):
        frames = [long(spark, base), long(spark, fiche, "fiche_recall_at_4"), long(spark, zero, "zero_articles"), long(spark, floor, "floor_correct")]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    old = run([0.0] * 6, [1.0] * 6, [0.0] * 6, [None] * 6)
    new = run([1.0] * 5 + [None], [1.0] * 5 + [0.0], [0.0] * 6, [1.0] * 6)
    table = m.compare(old, new)
    assert rows(table.select("metric", "n_paired", "improved", "regressed", "net")) == [("article_recall_at_4", 5, 5, 0, 5), ("fiche_recall_at_4", 6, 0, 1, -1), ("floor_correct", 0, 0, 0, 0), ("zero_articles", 6, 0, 0, 0)]
    assert m.verdict(table, "article_recall_at_4").first().adopt is True
    worse = m.compare(old, run([1.0] * 6, [1.0] * 6, [1.0, 1.0] + [0.0] * 4, [None] * 6))
    v = m.verdict(worse, "article_recall_at_4").first()
    assert (v.threshold_met, v.guards, v.adopt) == (True, "zero_articles", False)
    with pytest.raises(ValueError):
        m.verdict(table, "span_containment_at_4")
    with pytest.raises(Exception, match="same items"):
        m.compare(old, new.where("qid < 3")).collect()
    for bad in ("rung1", "rung9"):
        with pytest.raises(ValueError):
            m.primary_of(bad)


def test_floor_sweep(spark):
    pools = spark.createDataFrame([(0, 1, "a", 0.3, False, 1), (0, 2, "b", 0.25, True, 2), (1, 3, "c", 0.2, False, 1)], "qid long, id long, doc string, score double, expansion boolean, rank int")
    items = spark.createDataFrame([(0, "reponse", ["b"]), (1, "reponse_sans_article", []), (2, "reponse", ["z"])], "qid long, expected_state string, gold_articles array<string>")
    sweep = m.floor_sweep(pools, items, [0.0, 0.2, 0.25, 0.3], limit=1)
    assert rows(sweep) == [(0.0, 3, 1), (0.2, 3, 1), (0.25, 3, 2), (0.3, 3, 1)]
    assert m.best_floor(sweep).first().floor == 0.25 and m.best_floor(sweep.where("floor < 0.25")).first().floor == 0.2


def test_calibration(spark):
    pairs = spark.createDataFrame([("faithfulness", 0.9, "pass", 0.2, "fail"), ("faithfulness", 0.9, "pass", 0.9, "fail"), ("coverage", 0.1, "pass", 0.0, "fail")], "metric string, clean_score double, clean_label string, faulted_score double, faulted_label string")
    assert tuple(m.calibration(pairs, 0.5).first()) == (3, 2, 1, 1, 3, False)
    assert rows(m.errors_by_metric(pairs, ["faithfulness", "coverage"], 0.5)) == [("coverage", "false_fail", 1), ("coverage", "false_pass", 0), ("faithfulness", "false_fail", 0), ("faithfulness", "false_pass", 1)]


def test_point_coverage(spark):
    df = spark.createDataFrame([([(2, True), (1, False)], ["a", "b"]), ([], [])], "v array<struct<index:int,asserted:boolean>>, p array<string>")
    assert [r[0] for r in df.select(m.point_coverage(F.col("v"), F.col("p"))).collect()] == [0.5, None]
    bad = spark.createDataFrame([([(1, True), (1, False)], ["a", "b"])], "v array<struct<index:int,asserted:boolean>>, p array<string>")
    with pytest.raises(Exception, match="number the points"):
        bad.select(m.point_coverage(F.col("v"), F.col("p"))).collect()
