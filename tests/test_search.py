import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexweave.operators import search as s
from lexweave.plans import arms

CAND = "qid long, rank int, id long, score double, register string, provenance array<string>"


def pool(spark, *data):
    return spark.createDataFrame([(q, r, i, sc, reg, list(p)) for q, r, i, sc, reg, p in data], CAND)


def test_similarity_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(s, "POINT_BLOCK", 60)
    monkeypatch.setattr(s, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(20, 8))
    x[10] = x[11]
    points = spark.createDataFrame([(i, "fiche" if i % 2 else "article", v.tolist()) for i, v in enumerate(x)] + [(900, "fiche", None), (901, "fiche", [0.0] * 8)], "id long, register string, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "qid long, vector array<double>")
    got = rows(s.dense_leg(points, queries, "fiche", 5).select("qid", "rank", "id", "score"))
    want = []
    for i, v in enumerate(q):
        sc = {j: round(float(v @ x[j] / np.linalg.norm(v) / np.linalg.norm(x[j])), 6) for j in range(1, 300, 2)}
        want += [(i, r, j, sc[j]) for r, j in enumerate(sorted(sc, key=lambda j: (-sc[j], j))[:5], 1)]
    assert got == sorted(want, key=repr)
    assert s.dense_leg(points.limit(0), queries, "fiche").count() == 0 == s.dense_leg(points, queries.limit(0), "fiche").count()


def test_wide_vectors_and_text_ids(spark, monkeypatch):
    """The width of a real model, ids that are texts, and groups."""
    monkeypatch.setattr(s, "CHUNK", 16)
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(120, 1024)).astype(np.float32), rng.normal(size=(3, 1024)).astype(np.float32)
    points = spark.createDataFrame([(f"p{i:03d}", "article", f"s{i % 3}", v.tolist()) for i, v in enumerate(x)], "id string, register string, section_id string, vector array<float>")
    queries = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "qid string, vector array<float>")
    sc = np.round((q.astype(float) / np.linalg.norm(q.astype(float), axis=1)[:, None]) @ (x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]).T, 6)
    top = lambda i, ids: [(f"q{i}", f"p{j:03d}") for j in sorted(ids, key=lambda j: (-sc[i, j], j))[:4]]
    assert rows(s.dense_leg(points, queries, "article", 4).select("qid", "id")) == sorted(p for i in range(3) for p in top(i, range(120)))
    monkeypatch.setattr(s, "POINT_BLOCK", 10)  # a group of several blocks
    own = queries.crossJoin(spark.createDataFrame([("s0",), ("s2",)], "section_id string"))
    got = s.similarity(points, own, 4, within="section_id")
    best = s._pool(got, 4)
    assert rows(best.select("qid", "id")) == sorted(p for i in range(3) for p in top(i, [j for j in range(120) if j % 3 != 1]))


def test_copies_of_one_vector_are_cut_by_id(spark, monkeypatch):
    """A third of all points alike, more than a chunk."""
    monkeypatch.setattr(s, "CHUNK", 50)
    points = spark.createDataFrame([(i, "fiche", [1.0, 0.0] if i % 3 == 0 else [1.0, float(i)]) for i in range(600)], "id long, register string, vector array<double>")
    queries = spark.createDataFrame([(q, [1.0, 0.0]) for q in range(3)], "qid long, vector array<double>")
    assert rows(s.dense_leg(points, queries, "fiche", 7).select("qid", "rank", "id")) == [(q, r + 1, 3 * r) for q in range(3) for r in range(7)]


def test_similarity_of_mixed_widths(spark):
    """A malformed vector that comes first in its block doesn't drop the others."""
    good = [(i, "fiche", [1.0, float(i)]) for i in range(1, 6)]
    points = spark.createDataFrame([(0, "fiche", [1.0]), (9, "fiche", []), *good], "id long, register string, vector array<double>").coalesce(1)
    queries = spark.createDataFrame([(7, [1.0]), (8, [0.0, 1.0])], "qid long, vector array<double>").coalesce(1)
    assert rows(s.similarity(points, queries, 5).select("qid", "id")) == [(8, i) for i in range(1, 6)]
    assert s.similarity(points.where("id = 9"), queries, 5).count() == 0


def test_sparse_and_fusion(spark):
    post = spark.createDataFrame([(1, "fiche", 5, 0.5), (2, "fiche", 5, 0.2), (2, "fiche", 6, 1.0), (3, "fiche", 9, 9.0)], "id long, register string, token int, weight double")
    asked = spark.createDataFrame([(0, 5, 1.0), (0, 6, 0.1)], "qid long, token int, weight double")
    assert rows(s.sparse_leg(post, asked, "fiche").select("id", "score")) == [(1, 0.5), (2, 0.3)]
    dense = pool(spark, (0, 1, 1, 0.9, "fiche", ["search"]), (0, 2, 7, 0.6, "fiche", ["search"]))
    fused = s.fuse(dense, s.sparse_leg(post, asked, "fiche"), (0.5, 0.5), 2)
    assert rows(fused.select("rank", "id", "score")) == [(1, 1, 0.7), (2, 7, 0.3)]


def test_merge_keeps_the_first_pool_and_all_provenance(spark):
    a = pool(spark, (0, 1, 1, 0.5, "article", ["search"]), (0, 2, 2, 0.4, "article", ["search"]))
    b = pool(spark, (0, 1, 2, 0.9, "article", ["expansion"]), (0, 2, 3, 0.8, "article", ["expansion"]))
    assert rows(s.merge(a, b).select("rank", "id", "score", "provenance")) == [(1, 1, 0.5, ["search"]), (2, 2, 0.4, ["expansion", "search"]), (3, 3, 0.8, ["expansion"])]
    tied = pool(spark, (0, 1, 9, 0.5, "fiche", ["search"]), (0, 2, 1, 0.5, "fiche", ["search"]))
    assert [r.id for r in s.rank(tied, 2).orderBy("rank").collect()] == [9, 1]


def test_expansion_is_gated_by_sections(spark):
    fiches = pool(spark, *((0, r, r, 1.0 - r / 10, "fiche", ["search"]) for r in range(1, 5)), (1, 1, 50, 1.0, "fiche", ["search"]))
    sections = spark.createDataFrame([(1, [7]), (4, [8]), (50, [])], "id long, section_ids array<int>")
    articles = spark.createDataFrame([(100, 7, [1.0, 0.0]), (101, 8, [1.0, 0.0]), (102, 7, [0.0, 1.0]), (103, 7, None)], "id long, section_id int, vector array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.1]), (1, [1.0, 0.0])], "qid long, vector array<double>")
    assert rows(s.expand(fiches, sections, articles, queries).select("qid", "rank", "id")) == [(0, 1, 100), (0, 2, 102)]


def test_quota(spark):
    data = [(0, 1, 1, 0.2, "fiche", ["search"]), (0, 2, 10, 0.55, "article", ["search"]), (0, 3, 11, 0.5, "article", ["expansion"]), (0, 4, 12, 0.45, "article", ["expansion"]), (1, 1, 10, 0.49, "article", ["expansion"]), (3, 1, 10, 0.6, "article", ["search"]), (3, 2, 11, 0.5, "article", ["expansion"])]
    qids = spark.createDataFrame([(q,) for q in (0, 1, 2, 3)], "qid long")
    got = s.quota(pool(spark, *data), qids)
    assert rows(got.select("qid", "slot", "id", "register")) == sorted([(0, 1, 1, "fiche"), (0, 2, 11, "article"), (0, 3, 10, "article"), (1, 1, None, s.MARKER), (2, 1, None, s.MARKER), (3, 1, 10, "article"), (3, 2, 11, "article")], key=repr)
    assert rows(s.floor_met(got)) == [(0, True), (1, False), (2, False), (3, True)]


def test_short_circuit_and_lookup(spark):
    from lexweave.functions.text import first_reference

    turns = spark.createDataFrame([(0, "L. 1-2 ?"), (1, "L9"), (2, "rien"), (3, None)], "qid long, t string")
    points = spark.createDataFrame([(5, "L1-2", 1), (6, "L1-2", 0), (7, None, 0)], "id long, lookup_key string, chunk_index int")
    got = s.short_circuit(turns, points, "t", first_reference)
    assert rows(got.select("qid", "path", "lookup_key")) == [(0, "resolved", "L1-2"), (1, "membership_failed", None), (2, "no_reference", None), (3, "no_reference", None)]
    found = s.by_key(points, got.where("path = 'resolved'").select("qid", "lookup_key"))
    assert rows(found.select("qid", "rank", "id", "score", "provenance")) == [(0, 1, 6, 1.0, ["lookup"]), (0, 2, 5, 1.0, ["lookup"])]


def test_arms(spark):
    pts = spark.createDataFrame([(i, "fiche" if i % 2 else "article", [float(i % 3), 1.0], i % 4) for i in range(30)], "id long, register string, vector array<double>, section_id int")
    qs = spark.createDataFrame([(0, [1.0, 1.0])], "qid long, vector array<double>")
    x = arms.Index(pts, qs, pts.select("id", "register", F.lit(1).alias("token"), F.lit(1.0).alias("weight")), spark.createDataFrame([(0, 1, 0.5)], "qid long, token int, weight double"), pts.where("register = 'fiche'").select("id", F.array("section_id").alias("section_ids")), lambda c: c.select("qid", "id", F.lit(0.7).alias("new_score")))
    assert all(arms.retrieve(x, a).where("qid = 0").count() == 8 for a in arms.ARMS)
    with pytest.raises(KeyError, match="rung1"):
        arms.retrieve(x, "rung9")
