from conftest import rows
from pyspark.sql import functions as F

from lexweave.operators import answers as a
from lexweave.operators.search import MARKER


def envelopes(spark, *data):
    return spark.createDataFrame([(q, (kind, "e", [(i, "g") for i in ids], basis, motif)) for q, kind, ids, basis, motif in data], f"qid long, envelope {a.ENVELOPE}")


def contexts(spark):
    s = "qid long, slot int, register string, citation_id string, document string, title string, chapitre_titre string, cas_label string, breadcrumb string, text string"
    return spark.createDataFrame([(0, 2, "fiche", None, None, "T", "", "C", None, "f"), (0, 3, "article", "L1", "A1", None, None, None, "Root > B", "x"), (0, 1, "fiche", None, None, None, None, None, None, "g"), (1, 1, MARKER, None, None, None, None, None, None, None)], s)


def test_citations(spark):
    env = envelopes(spark, (0, "reponse", ["L1", "L9", "L1"], None, None), (1, "reponse", ["L9"], None, None), (2, "refus", [], None, "hors_corpus"), (3, "reponse", [], "none", None))
    both = env.join(a.retrieved_citations(contexts(spark)), "qid", "left")
    wrong = a.fabricated(F.col("envelope"), F.col("retrieved"))
    fixed = both.select("qid", wrong.alias("w"), a.repair(F.col("envelope"), wrong).alias("e"), a.state(F.col("envelope")).alias("s"))
    got = {r.qid: r for r in fixed.collect()}
    assert [got[q].w for q in range(4)] == [["L9"], ["L9"], [], []] and [got[q].s for q in range(4)] == ["reponse", "reponse", "refus:hors_corpus", "reponse_sans_article"]
    assert [c.article_id for c in got[0].e.fondement_juridique] == ["L1", "L1"] and got[0].e.aucun_fondement is None
    assert got[1].e.fondement_juridique == [] and got[1].e.aucun_fondement == a.NO_BASIS and got[3].e.aucun_fondement == "none"


def test_scores(spark):
    items = spark.createDataFrame([(0, "reponse", ["A1", "A2"]), (2, "refus:hors_corpus", [])], "qid long, expected_state string, gold_articles array<string>")
    env = envelopes(spark, (0, "reponse", ["L1", "L9"], None, None), (2, "refus", [], None, "hors_corpus"))
    assert rows(a.score_answers(items, env, contexts(spark)).select("qid", "state_correct", "citation_valid", "citation_correctness")) == [(0, True, False, 0.5), (2, True, True, None)]


def test_rendering(spark):
    got = {r.qid: r.context for r in a.render_contexts(contexts(spark)).collect()}
    assert got[0] == "### Fiches\n\ng\n\n— T · C\nf\n\n### Articles\n\n— L1 · B\nx" and got[1] == f"### Articles\n\n{a.NO_BASIS}"
    m = spark.range(1).select(a.messages("sys", F.array(F.struct(F.lit("user").alias("role"), F.lit("h").alias("content"))), F.lit("now"))).first()[0]
    assert [(t.role, t.content) for t in m] == [("system", "sys"), ("user", "h"), ("user", "now")]


def test_condensing(spark):
    h = [("user", "before")]
    data = [(0, "q", [], "x"), (1, "voir L1", h, "x"), (2, "q", h, None), (3, "q", h, "a\nb"), (4, " q ", h, "q"), (5, "q", h, " better "), (6, "q L9", h, "y L9"), (7, "q", None, "x")]
    turns = spark.createDataFrame(data, "qid long, raw_turn string, history array<struct<role:string,content:string>>, rewritten string")
    known = spark.createDataFrame([("L1",), (None,)], "lookup_key string")
    got = rows(a.condense(turns, known).select("qid", "condense_status", "query", "condensed_query"))
    assert got == [(0, a.NO_HISTORY, "q", None), (1, a.SHORT_CIRCUIT, "voir L1", None), (2, a.FALLBACK_ERROR, "q", None), (3, a.FALLBACK_SANITIZER, "q", "a\nb"), (4, a.UNCHANGED, " q ", "q"), (5, a.REWRITTEN, "better", "better"), (6, a.REWRITTEN, "y L9", "y L9"), (7, a.NO_HISTORY, "q", None)]


def test_views_links_and_labels(spark):
    env = envelopes(spark, (0, "reponse", ["L1", "L9"], None, None), (1, "refus", [], None, "m"), (2, "reponse", [], "x", None), (3, "refus", [], None, "hors_corpus"))
    assert rows(env.select("qid", a.view_state(F.col("envelope")))) == [(0, "reponse"), (1, "refus_regule"), (2, "reponse_sans_article"), (3, "hors_corpus")]
    ctx = spark.createDataFrame([(0, 2, "article", "L1", "v2"), (0, 1, "article", "L1", "v1")], "qid long, slot int, register string, citation_id string, version string")
    assert rows(a.citation_links(env, ctx, "https://legi.example/%s")) == [(0, "L1", "https://legi.example/v1")]
    labels = spark.createDataFrame([(" P ",), ("fail",), ("",), ("x",), (None,)], "r string").select(a.human_label(F.col("r"), F.lit("pass")))
    assert [r[0] for r in labels.collect()] == ["pass", "fail", "pass", None, None]
