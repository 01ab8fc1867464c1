import json

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.functions import models
from lexweave.operators import annotation as a
from lexweave.operators import gates
from lexweave.plans import evaluate, ingest
from lexweave.sources import index, readers

EMBED, SCORE = (lambda: models.hash_embedder(16)), models.overlap_scorer


def corpus(spark):
    s = "cid string, id string, citation_id string, sectionParentId string, sectionParentTitre string, fullSectionsTitre string, dateDebut string, etat string, texteHtml string"
    words = lambda t: f"<p>{t} " + "texte de loi " * 12 + "</p>"
    articles = spark.createDataFrame([("A1", "v1", "L. 1-2", "LEGISCTA1", "S", "Root > S", "2020-01-01", "VIGUEUR", words("grêle et vigne")), ("A2", "v2", "L3", "LEGISCTA2", "T", None, "2020-01-01", "VIGUEUR", words("moteur et volant"))], s)
    body = lambda t: "".join(f"<Paragraphe>{t} guide pour tous les assurés du pays</Paragraphe>" for _ in range(6))
    xml = lambda i, sec, t: f'<P xmlns:d="http://purl.org/dc/elements/1.1/" ID="{i}" type="t" spUrl="u"><d:title>{t}</d:title><d:date>modified 2024-01-02</d:date><d:source>{sec}</d:source><Texte>{body(t)}</Texte></P>'.encode()
    fiches = spark.createDataFrame([("F1", bytearray(xml("F1", "LEGISCTA1", "grêle"))), ("F2", bytearray(xml("F2", "LEGISCTA2", "moteur")))], "fiche_id string, xml binary")
    return articles, fiches


def test_ingest_search_and_answer(spark, tmp_path):
    articles, fiches = corpus(spark)
    home = f"file://{tmp_path}/home"
    bad = articles.withColumn("etat", F.lit("ABROGE"))
    with pytest.raises(ValueError, match="in force"):
        ingest.run_ingest(spark, bad, fiches, EMBED, home, "index-1")
    assert index.pointers(spark, home) == {}
    for _ in range(2):  # the second run changes nothing
        assert ingest.run_ingest(spark, articles, fiches, EMBED, home, "index-1", width=16) == {"fiches": 2, "articles": 2}
    assert index.pointers(spark, home) == {"fiches": "fiches__index-1", "articles": "articles__index-1"}
    items = spark.createDataFrame([(0, "grêle vigne", "reponse", ["F1"], ["A1"], ["grêle guide"]), (1, "moteur volant", "reponse", ["F2"], ["A2"], [])], "qid long, text string, expected_state string, gold_fiches array<string>, gold_articles array<string>, gold_spans array<string>")
    for arm in ("rung1", "rung3", "rung5"):
        got = rows(ingest.run_experiment(spark, home, items, EMBED, SCORE, arm).select("qid", "fiche_recall_at_4", "fiche_recall_at_candidate"))
        assert got == [(0, 1.0, 1.0), (1, 1.0, 1.0)], arm
    turns = spark.createDataFrame([(0, "voir L. 1-2 svp", None), (1, "moteur ?", [("user", "avant")])], "qid long, raw_turn string, history array<struct<role:string,content:string>>")
    said = lambda: lambda prompts: [json.dumps({"type": "reponse", "explanation": "oui", "fondement_juridique": [{"article_id": i, "gloss": "g"} for i in ("L. 1-2", "L9")]}) if "voir" in p else "oui" for p in prompts]
    out = {r.qid: r for r in ingest.run_chain(spark, home, turns, EMBED, SCORE, lambda: lambda p: [x.upper() for x in p], said).collect()}
    assert out[0].context.startswith("### Articles\n\n— L. 1-2 · S\n") and "Fiches" not in out[0].context and out[0].retrieved == ["L. 1-2"]
    assert out[0].fabricated_ids == ["L9"] and not out[0].citation_valid and [c.article_id for c in out[0].shown.fondement_juridique] == ["L. 1-2"] and (out[0].state, out[0].view_state, out[0].error) == ("reponse", "reponse", None)
    assert out[1].query == "MOTEUR ?" and out[1].condense_status == "rewritten" and out[1].context.count("— ") == 4
    assert (out[1].answer, out[1].envelope, out[1].error) == ("oui", None, "the answer is not an envelope")
    seen = []
    traced = ingest.trace(*ingest.chain(spark, home, turns, EMBED, SCORE, lambda: lambda p: p, said, on_stage=seen.append)).collect()
    assert seen == list(ingest.STAGES) and sorted((r.qid, r.place) for r in traced) == [(q, i) for q in (0, 1) for i in range(3)]
    assert [c["id"] for c in json.loads(next(r.output for r in traced if (r.qid, r.stage) == (0, "retrieve")))] == [r.id for r in index.live(spark, home, "articles").where("payload.lookup_key = 'L1-2'").collect()]
    golden = spark.createDataFrame([("gs-1", "voir L. 1-2 svp", None, "reponse", ["A1"], ["p", "q"]), ("gs-2", "moteur ?", None, "reponse", ["A2"], None)], "id string, question string, history array<struct<role:string,content:string>>, expected_state string, gold_articles array<string>, expected_points array<string>")
    judge = lambda: lambda prompts: ['{"score": 2}' if "share of the claims" in p else '{"verdicts": [{"index": 1, "asserted": true}, {"index": 2, "asserted": false}]}' for p in prompts]
    scores = evaluate.run_answers(spark, home, golden, EMBED, SCORE, lambda: lambda p: p, said, judge).collect()
    assert [(r.item_id, r.state_correct, r.citation_valid, r.fabricated_ids, r.citation_correctness, r.faithfulness, r.point_coverage, r.judge_error) for r in scores] == [("gs-1", True, False, ["L9"], 1.0, None, 0.5, "faithfulness: no score from 0 to 1")]
    other = f"file://{tmp_path}/other"
    ingest.run_ingest(spark, articles, fiches, EMBED, other, "index-2", enriched=True, check=False)
    table, verdict = ingest.run_ab(spark, (home, other), items, EMBED, SCORE, "ab_article_breadcrumb")
    assert table.count() == 9 and verdict.first().adopt is False
    ids = lambda h: rows(index.live(spark, h, "articles").select("id"))
    assert ids(home) == ids(other)


def test_two_models_and_a_tokenizer(spark, tmp_path):
    """Dense vectors of one model beside the sparse ones of another, chunks sized by characters."""
    articles, fiches = corpus(spark)
    home, wide = f"file://{tmp_path}/home", lambda: models.hash_embedder(32)
    size = lambda t: len(t) // 3
    made = ingest.run_ingest(spark, articles, fiches, wide, home, "index-1", width=32, size=size, load_sparse=EMBED, check=False)
    row = index.live(spark, home, "articles").first()
    want = models.hash_embedder(16)([row.payload.text])[0]
    assert len(row.dense) == 32 and dict(zip(row.sparse_indices, row.sparse_values)).keys() == want[1].keys() and made["articles"] == 2
    items = spark.createDataFrame([(0, "grêle vigne", "reponse", ["F1"], ["A1"], [])], "qid long, text string, expected_state string, gold_fiches array<string>, gold_articles array<string>, gold_spans array<string>")
    assert ingest.run_experiment(spark, home, items, wide, SCORE, "rung2", EMBED).first().fiche_recall_at_4 == 1.0
    assert ingest.gate(articles, fiches, size).where("check = 'no content lost'").count() == ingest.gate(articles, fiches).where("check = 'no content lost'").count() == 0


def test_calibration_picks_and_drafts(spark, tmp_path):
    s = f"golden_id string, metric string, question string, expected_points array<string>, context string, clean struct<envelope:{schemas.ENVELOPE}, label:string>, faulted struct<envelope:{schemas.ENVELOPE}, label:string>"
    said = lambda x: ("reponse", x, [], None, None)
    pairs = spark.createDataFrame([("g1", "faithfulness", "q", ["p"], "c", (said("good"), "pass"), (said("bad"), "fail")), ("g2", "point_coverage", "q", ["p"], "c", (said("good"), "pass"), (said("good"), "fail"))], s)
    judge = lambda: lambda prompts: [json.dumps({"score": 0.9 if "good" in p else 0.1}) if "share" in p else json.dumps({"verdicts": [{"index": 1, "asserted": "good" in p}]}) for p in prompts]
    scored, summary, errors = evaluate.run_calibration(pairs, judge)
    assert rows(scored.select("golden_id", "clean_score", "faulted_score", "error")) == [("g1", 0.9, 0.1, None), ("g2", 1.0, 1.0, None)]
    assert summary.select("n_detected", "false_passes", "passed").first() == (1, 1, False) and errors.where("n > 0").first()[:2] == ("point_coverage", "false_pass")
    articles = spark.createDataFrame([("A1", "s1", "grêle"), ("A2", "s1", "x" * 900), ("A3", "s2", None)], "cid string, section_id string, texte string")
    guides = spark.createDataFrame([("F1", ["s1"]), ("F2", ["s2"]), ("F3", [])], "fiche_id string, section_ids array<string>")
    items = spark.createDataFrame([("gs-001", "grêle ?", ["F1"], ["A2"]), ("gs-002", "rien", ["F3"], [])], "id string, question string, gold_fiches array<string>, gold_articles array<string>")
    pick = lambda: lambda prompts: ["- A1\n- A9" if len(p) < 900 else "too long" for p in prompts]
    assert rows(evaluate.disagreement_pass(items, guides, articles, pick)) == [("gs-001", ["A2"], ["A1"], [], ["A1", "A2"])]
    why = lambda: lambda prompts: ["A1: hail: no\nA1: again\nA7: never shown"]
    assert rows(evaluate.rejection_reasons(items, spark.createDataFrame([("gs-001", "A1")], "id string, cid string"), articles, why)) == [("gs-001", "A1", "hail: no")]
    texts = spark.createDataFrame([("F1", "t"), ("F2", "deux"), ("F3", "trois")], "fiche_id string, text string")

    def ask():
        def run(prompts):
            if "trois" in prompts[0]:
                raise RuntimeError("no")
            return ["- Question ?\nmore"]

        return run

    drafts = evaluate.draft_items(texts, guides, articles, items.where("id = 'gs-001'"), ask, lambda: lambda p: ["A3"], 5, 1)
    assert rows(drafts.select("id", "fiche_id", "question", "expected_state", "gold_articles", "error")) == [("gs-002", "F2", "Question ?", "reponse", ["A3"], None), ("gs-003", "F3", None, None, [], "RuntimeError: no")]


def test_what_is_kept(spark, tmp_path):
    one = ("no_reference", 0.5, None, None, 0.5, None, None, True, None, None)
    runs = [readers.write_run({"run_id": r}, spark.createDataFrame([(f"i{i}", *one[:1], v, *one[2:]) for i in range(6)], schemas.ITEM_SCORES), str(tmp_path)) for r, v in (("a", 0.5), ("b", 1.0))]
    _, verdict = evaluate.compare_files(spark, str(runs[0]), str(runs[1]), "rung4", str(tmp_path / "report.json"))
    assert verdict.first().adopt and json.loads((tmp_path / "report.json").read_text())["verdict"][0]["net"] == 6
    sweep = spark.createDataFrame([(0.5, 3, 2), (0.6, 3, 2), (0.7, 3, 1)], "floor double, n_items long, n_correct long")
    assert json.loads(open(evaluate.write_sweep(sweep, str(tmp_path / "sweep.json"))).read())["best"] == [{"floor": 0.6, "n_correct": 2}]
    item = lambda i, q: spark.createDataFrame([(i, q, None, "reponse", None, None, None, None, None)], schemas.GOLDEN)
    check = lambda df: gates.repeated(df, "ids unique", "id").unionByName(gates.violations(df.where("question = ''"), "question", "id"))
    path = str(tmp_path / "set.json")
    for i, q in (("gs-1", "a"), ("gs-2", "b"), ("gs-1", "c")):
        evaluate.save_items(item(i, q), path, check)
    with pytest.raises(ValueError, match="question: 1"):
        evaluate.save_items(item("gs-3", ""), path, check)
    assert rows(readers.annotated_set(spark, path).select("id", "question")) == [("gs-1", "c"), ("gs-2", "b")]
    held = spark.createDataFrame([("x", ["F1"])], "id string, gold_fiches array<string>")
    mine = spark.createDataFrame([("gs-1", "reponse", ["F1"])], "id string, expected_state string, gold_fiches array<string>")
    assert rows(evaluate.floor_gate(mine, held).select("check", "key")) == [("guides not held out", "gs-1"), ("items without article", "set")]


def test_models_record_errors_and_check_width(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")

    def fails():
        def ask(prompts):
            raise RuntimeError("no")

        return ask

    assert [tuple(r[0]) for r in df.select(models.ask(F.col("t"), fails)).collect()] == [(None, "RuntimeError: no"), (None, None)]
    with pytest.raises(Exception, match="16 are expected|dimensions"):
        df.select(models.embed(F.col("t"), lambda: models.hash_embedder(8), 16)).collect()
    assert [r[0].dense is None for r in df.select(models.embed(F.col("t"), EMBED)).collect()] == [False, True]


def test_annotation(spark):
    s = "id string, expected_state string, history array<map<string,string>>, gold_fiches array<string>, gold_articles array<string>, tags array<string>"
    items = spark.createDataFrame([("gs-001", "reponse", None, ["F1", "F1"], ["A1", "A9"], None), ("gs-007", "reponse_sans_article", [], ["F2"], [], ["t", "t"]), ("gs-003", "reponse", [{"role": "user"}], ["F1"], ["A1"], ["multi_turn"]), ("bad", "refus:hors_corpus", None, None, None, [])], s)
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    assert (ids(a.working_set(items)), ids(a.article_set(items)), ids(a.floor_set(items))) == (["gs-001", "gs-007"], ["gs-001"], ["gs-007"])
    articles = spark.createDataFrame([("A1", "s1"), ("A2", "s1"), ("A3", None)], "cid string, section_id string")
    guides = spark.createDataFrame([("F1", ["s1", "s9"]), ("F2", []), ("F3", ["s1"])], "fiche_id string, section_ids array<string>")
    sections = spark.createDataFrame([("s1", "One"), ("s1", "One")], "section_id string, titre string")
    assert rows(a.articles_by_section(articles).select("section_id", "cid")) == [("s1", "A1"), ("s1", "A2")]
    assert rows(a.reading_list(guides.where("fiche_id = 'F1'"), sections, articles)) == [("F1", 0, "s1", "One", "A1"), ("F1", 0, "s1", "One", "A2"), ("F1", 1, "s9", "s9", None)]
    short = a.section_shortlist(items, guides, articles)
    assert rows(a.outside_sections(items, short)) == [("gs-001", "A9")]
    lexical = spark.createDataFrame([("gs-001", "A1"), ("gs-001", "A7")], "id string, cid string")
    assert ("gs-001", "A1", ["lexical", "section"]) in rows(a.shortlist_union(short, lexical))
    gold = items.select("id", F.explode("gold_articles").alias("cid"))
    picks = spark.createDataFrame([("gs-001", "A2"), ("gs-003", "A1")], "id string, cid string")
    assert rows(a.disagreements(gold, picks, short)) == [("gs-001", ["A1", "A9"], ["A2"], ["A9"], ["A1", "A2"])]
    assert rows(a.overlap(items, items.where("id = 'gs-007'")).select("id")) == [("gs-007",)]
    assert rows(a.unused_guides(guides, items, 5, 1)) == [("F3",)]
    assert ("tag", "t", 1) in rows(a.progress(items)) and ("all", "all", 4) in rows(a.progress(items))
    assert {r.id: r.tags for r in a.derived_tags(items).collect()}["gs-003"] == ["multi_turn"]
    assert a.next_id(items) == "gs-008" and a.next_id(items, 41) == "gs-042" and a.next_id(items.limit(0)) == "gs-001"
    assert spark.range(1).select(a.pick(F.array(F.lit("- A2 or A1"), F.lit("none"), F.lit("A1")), F.array(F.lit("A2"), F.lit("A1")))).first()[0] == ["A1"]


def test_nearest_by_terms(monkeypatch):
    """Groups and parts of any size against brute force, with many equal scores and an item without a shared term."""
    rng = np.random.default_rng(3)
    n, w = rng.poisson(0.4, (90, 12)) * rng.integers(1, 9, (90, 1)), rng.integers(0, 3, (25, 12))
    n[:, 0], w[:, 0], w[7] = 0, 3, 0
    w[7, 0] = 1
    sides = [a._Counts(pa.array([f"{c}{i:03d}" for i in np.nonzero(m)[0]]), np.nonzero(m)[1], m[np.nonzero(m)], 12) for c, m in (("a", n), ("i", w))]
    want = {f"i{i:03d}": [(-s, c) for s, c in sorted((-int(w[i] @ n[j]), f"a{j:03d}") for j in range(90)) if s][:4] for i in range(25)}
    for group, cells in ((1, 24), (7, 60), (64, 5), (500, 4_000_000)):
        monkeypatch.setattr(a, "GROUP", group)
        monkeypatch.setattr(a, "CELLS", cells)
        got = {f"i{i:03d}": [] for i in range(25)}
        for i, c, s in sorted(zip(*(x.tolist() for x in a._nearest(*sides, 4)), strict=True), key=lambda r: (-r[2], sides[0].ids[r[1]].as_py())):
            got[sides[1].ids[i].as_py()].append((s, sides[0].ids[c].as_py()))
        assert got == want


def test_term_shortlist_makes_no_row_per_pair(spark, monkeypatch):
    """Every item shares a term with every article: one row per item and article would be many."""
    items = spark.range(40).select(F.format_string("i%02d", "id").alias("id"), F.explode(F.array(F.lit("les"), F.concat(F.lit("t"), F.col("id") % 7))).alias("term"), F.lit(2).alias("w"))
    held = spark.range(300).select(F.format_string("a%03d", "id").alias("cid"), F.explode(F.array(F.lit("les"), F.concat(F.lit("t"), F.col("id") % 11))).alias("term"), (1 + F.col("id") % 5).alias("n"))
    want = {}
    for i in range(40):
        scores = [(-2 * (1 + j % 5) * (1 + (i % 7 == j % 11)), f"a{j:03d}") for j in range(300)]
        want |= {(f"i{i:02d}", c): (-s, k) for k, (s, c) in enumerate(sorted(scores)[:10], 1)}
    for sizes in ((1_000_000, 500_000), (90, 30)):
        monkeypatch.setattr(a, "ARTICLE_TERMS", sizes[0])
        monkeypatch.setattr(a, "ITEM_TERMS", sizes[1])
        got = a.term_shortlist(items, held)
        assert {(r.id, r.cid): (r.score, r["rank"]) for r in got.collect()} == want
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert a.term_shortlist(items.limit(0), held).count() == 0 == a.term_shortlist(items, held.limit(0)).count()
    with pytest.raises(Exception, match="w must be a whole number over nought"):
        a.term_shortlist(items.withColumn("w", F.lit(0)), held).collect()


def test_gold_pairs_in_sections(spark):
    """Of the pairs those of the whole shortlist, which isn't made."""
    items = spark.createDataFrame([("1", ["F1", "F1"]), ("2", ["F2"]), ("3", None)], "id string, gold_fiches array<string>")
    guides = spark.createDataFrame([("F1", ["s1", "s9"]), ("F2", ["s2", "s1"])], "fiche_id string, section_ids array<string>")
    articles = spark.createDataFrame([("A1", "s1"), ("A1", "s1"), ("A2", "s2"), ("A3", None), ("A1", "s2")], "cid string, section_id string")
    pairs = spark.createDataFrame([("1", "A1"), ("1", "A2"), ("2", "A2"), ("2", "A1"), ("2", "A3"), ("3", "A1"), ("1", "A1")], "id string, cid string")
    got = rows(a.in_sections(pairs, items, guides, articles))
    assert got == [("1", "A1"), ("2", "A1"), ("2", "A2")] == rows(a.section_shortlist(items, guides, articles).join(pairs, ["id", "cid"], "left_semi"))


def test_shortlist_union_keeps_no_lists(spark):
    """Where an article comes from is two numbers until the end: a list per pair sorts all pairs where they are many."""
    pair = "id string, cid string"
    by_section = spark.createDataFrame([("1", "A1"), ("1", "A2"), ("2", "A1")], pair)
    got = a.shortlist_union(by_section, spark.createDataFrame([("1", "A1"), ("1", "A1"), ("2", "A9")], pair))
    assert rows(got) == [("1", "A1", ["lexical", "section"]), ("1", "A2", ["section"]), ("2", "A1", ["section"]), ("2", "A9", ["lexical"])]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan
