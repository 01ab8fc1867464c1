import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexweave.functions import ids, text

KEYS = [("L113-3", "L113-3"), ("R*113-4", "R113-4"), ("L. 113-2", "L113-2"), ("A.121-1", "A121-1"), (" L132-9-3-1 ", "L132-9-3-1"), ("L500", "L500"), ("l113-3", None), ("Annexe à l'article A121-1", None), ("Annexe R344-7", None), ("X113-3", None), ("", None), ("  ", None), (None, None), ("L113-15bis", None), ("L 113-2", "L 113-2")]
FIRST = [("voir L. 113-2 et R*113-4.", "L113-2", "L113-2"), ("rien", None, None), (None, None, None), ("", None, None), ("L113-2é", "L113", None), ("L113-15-2bis", "L113-15", None), ("(A112)", "A112", "A112"), ("l113-2", None, None), ("ÉL113", None, None)]


def test_lookup_keys(spark):
    df = spark.createDataFrame(KEYS, "t string, want string").withColumn("got", text.lookup_key(F.col("t")))
    for t, want, got in df.collect():
        assert got == want, t


def test_references(spark):
    df = spark.createDataFrame(FIRST, "t string, a string, b string").select("*", text.first_reference(F.col("t")).alias("x"), text.first_reference(F.col("t"), strict=True).alias("y"), text.all_references(F.col("t")).alias("all"))
    for r in df.collect():
        assert (r.x, r.y) == (r.a, r.b), r.t
    assert df.first()["all"] == ["L113-2", "R113-4"] and all(r["all"] is not None for r in df.collect())


@pytest.mark.parametrize("n,want", [(0, 0), (1, 1), (6, 6), (7, 6), (200, 6)])
def test_history(spark, n, want):
    h = [("user", f"{i}" + "x" * 3000) for i in range(n)]
    got = spark.createDataFrame([(h,)], "h array<struct<role:string,content:string>>").select(text.trim_history(F.col("h"))).first()[0]
    assert len(got) == want and all(len(t.content) == 2000 for t in got)
    assert [t.content.split("x")[0] for t in got] == [str(i) for i in range(n)][-want:] if want else got == []


def test_sanitizer(spark):
    cases = [("a L113-2", " b L113-2 ", "b L113-2"), ("a", "b L113-2", None), ("a", "b\nc", None), ("a", " ", None), ("a", None, None), ("a", "x" * 301, None), ("a", "x" * 300, "x" * 300)]
    for r in spark.createDataFrame(cases, "r string, c string, w string").select("w", text.sanitize_condensed(F.col("r"), F.col("c")).alias("g")).collect():
        assert r.g == r.w


def test_small_functions(spark):
    df = spark.createDataFrame([("A > B > C", "  a  b ", " - x\n\n• y ", ["one", "two"])], "b string, w string, l string, i array<string>")
    got = df.select(text.strip_breadcrumb_root(F.col("b")), text.collapse(F.col("w")), text.clean_lines(F.col("l")), text.numbered(F.col("i")), text.fill_template("<{{a}}|{{b}}>", {"a": F.col("b"), "b": F.lit(None).cast("string")}), text.enriched([F.lit(""), F.lit("t"), F.lit(None).cast("string"), F.lit("c")]), text.terms(F.lit("L'été où 12 345")), text.verbatim(F.array(F.lit("a"), F.lit(""), F.lit("z"), F.lit("a")), F.array(F.lit("bab"))), text.epoch_ms_date(F.lit(86_400_000)).cast("string"), text.http_date(F.lit("Wed, 21 Oct 2015 07:28:00 GMT")).cast("string")).first()
    assert list(got) == ["B > C", "a b", ["x", "y"], "1. one\n\n2. two", "<A > B > C|>", "t\nc", ["été", "345"], ["a"], "1970-01-02", "2015-10-21"]
    assert df.select(text.strip_breadcrumb_root(F.lit("root"))).first()[0] == ""


def test_uuid5(spark):
    names = ["LEGIARTI1#0", "é#12", "", *map(str, range(50))]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u"))
    assert all(str(uuid.uuid5(ids.NAMESPACE, r.n)) == r.u for r in df.collect())
    assert rows(spark.createDataFrame([("a", 1)], "k string, i int").select(ids.point_id(F.col("k"), F.col("i")))) == [(str(uuid.uuid5(ids.NAMESPACE, "a#1")),)]


def test_history_with_tighter_limits(spark):
    h = [("user", "x" * 100), ("assistant", "b"), ("user", "c" * 61)]
    got = spark.createDataFrame([(h,)], "h array<struct<role:string,content:string>>").select(text.trim_history(F.col("h"), 2, 60)).first()[0]
    assert [(t.role, len(t.content)) for t in got] == [("assistant", 1), ("user", 60)]
