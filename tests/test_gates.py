import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexweave.operators import gates as g


def checks(df):
    return {r[0] for r in rows(df.select("check"))}


def test_articles(spark):
    s = "cid string, etat string, citation_id string"
    assert g.article_gate(spark.createDataFrame([("a", "VIGUEUR", "L1"), ("b", "VIGUEUR", "Annexe"), ("c", "VIGUEUR", "Annexe")], s)).count() == 0
    bad = g.article_gate(spark.createDataFrame([("a", "VIGUEUR", "L. 1"), ("a", "ABROGE", "L1"), ("b", None, ""), ("c", "VIGUEUR", None)], s))
    assert checks(bad) == {"one version per article", "in force", "lookup keys unique", "citation present"} and bad.count() == 6
    with pytest.raises(ValueError, match="in force: 2"):
        g.enforce(bad)
    g.enforce(bad.where("false"))


def test_sections(spark):
    f = spark.createDataFrame([("F1", "s1"), ("F1", "s9"), ("F2", "s9")], "fiche_id string, section_id string")
    assert rows(g.sections_gate(f, spark.createDataFrame([("s1",), (None,)], "section_id string")).select("key")) == [("F2",)]


def test_chunks(spark):
    docs = spark.createDataFrame([("a", 600), ("b", 40), ("c", 20), ("d", 40), ("e", 600)], "cid string, n int")
    chunks = spark.createDataFrame([("a", 500, False), ("a", 102, False), ("b", 10, False), ("c", 60, True), ("e", 513, False), ("e", 200, False)], "cid string, tokens int, is_stub boolean")
    bad = g.chunk_gate(docs, chunks, "cid", F.col("n"), stub=F.col("is_stub"))
    assert rows(bad.select("check", "key")) == [("at least one chunk", "d"), ("chunks meet the floor", "b"), ("no chunk over the band", "e"), ("no content lost", "b"), ("no content lost", "e")]


def test_golden(spark):
    s = "id string, question string, history array<map<string,string>>, expected_state string, gold_fiches array<string>, gold_spans array<string>, gold_articles array<string>, expected_points array<string>, tags array<string>"
    ok = ("gs-1", "q", None, "reponse", ["F1"], ["span"], ["A"], ["p"], None)
    data = [ok, ("gs-2", "q", [{"role": "user", "content": "fondement_juridique"}], "refus:hors_corpus", [], [], None, [], ["multi_turn"])]
    fiches, cids, texts = spark.createDataFrame([("F1",)], "fiche_id string"), spark.createDataFrame([("A",)], "cid string"), spark.createDataFrame([("F1", "a span b"), ("F2", "other"), ("F1", None)], "fiche_id string, text string")
    assert g.golden_gate(spark.createDataFrame(data, s), fiches, cids, texts).count() == 0
    bad = [ok, ok, ("x1", "q", [{"role": "assistant", "content": "fondement_juridique"}], "??", ["F9"], ["other"], ["Z"], [], []), ("gs-3", "q", None, "refus:hors_corpus", ["F1"], None, None, ["p"], ["multi_turn"]), ("gs-4", "q", None, "reponse_sans_article", None, None, ["A"], ["p"], None), ("gs-5", "q", None, "reponse", None, None, None, ["p"] * 4, None), (None, None, None, None, None, None, None, None, None)]
    assert checks(g.golden_gate(spark.createDataFrame(bad, s), fiches, cids, texts)) == {"ids unique", "id shape", "state known", "gold fiches resolve", "gold articles resolve", "spans verbatim", "out of corpus has no gold", "without article has no gold article", "gold fiche needed", "gold article needed", "number of points", "history stripped", "multi-turn tag"}


def test_calibration(spark):
    from lexweave.operators.answers import ENVELOPE

    def env(kind, text, ids=(), motif=None):
        return ((kind, text, [(i, "g") for i in ids], None, motif),)

    s = f"golden_id string, archetype string, question string, expected_points array<string>, retrieved array<string>, clean struct<envelope:{ENVELOPE}>, faulted struct<envelope:{ENVELOPE}>"
    golden = spark.createDataFrame([("gs-1", "q", ["p"]), ("gs-2", "q", ["p"])], "id string, question string, expected_points array<string>")
    ok = [("gs-1", "fabricated_citation", "q", ["p"], ["L1"], env("reponse", "a", ["L1"]), env("reponse", "a", ["L1", "L2"])), ("gs-2", "refusal_without_explanation", "q", ["p"], [], env("refus", "long text", motif="m"), env("refus", "short", motif="m"))]
    assert g.calibration_gate(spark.createDataFrame(ok, s), golden).count() == 0
    bad = [("gs-1", "fabricated_citation", "other", [], ["L1"], env("reponse", "a", ["L9"]), env("reponse", "a", ["L1"])), ("gs-9", "dropped_expected_point", "q", [], [], env("reponse", "a"), env("reponse", "a")), ("gs-2", "refusal_without_explanation", "q", ["p"], [], env("refus", "x", motif="m"), env("refus", "longer", motif="n")), ("gs-2", "refusal_without_explanation", "q", ["p"], [], env("reponse", "x"), env("refus", "y"))]
    assert checks(g.calibration_gate(spark.createDataFrame(bad, s), golden)) == {"one pair per item", "item known", "same question", "same points", "twin differs", "twin cites outside", "clean cites inside", "points needed", "both refuse", "same motif", "twin explains less"}
