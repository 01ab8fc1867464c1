import datetime as dt

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexweave.operators import snapshots

T = dt.datetime(2024, 1, 1)
SCHEMA = "snapshot_no int, snapshot_date date, delivered_at timestamp, cid string, etat string, texteHtml string, _r string, field string"


def article(k, cid, html, hour=0, etat="VIGUEUR"):
    return (k, dt.date(2024, k, 1), T + dt.timedelta(days=31 * k, hours=hour), cid, etat, html, "clash", "clash")


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_latest_delivery_counts_and_keys_are_normalised(spark):
    t = table(spark, [article(1, " a1 ", "old"), article(1, "A1", "new", 2), article(1, "A1", "new", 2), article(1, "b", "x", 0), article(1, "B", None, 1, "ABROGE"), article(1, None, "x"), article(1, "  ", "x")])
    from pyspark.sql import functions as F

    assert [(r.cid, r.h) for r in snapshots.held(t, {"h": F.col("texteHtml")}).collect()] == [("A1", "new")]


def test_changes(spark):
    t = table(spark, [article(1, "same", "x"), article(2, "same", "x"), article(1, "gone", "x"), article(2, "new", "x"), article(1, "edit", "x"), article(2, "edit", "x​"), article(1, "null", None), article(2, "null", None), article(1, "tonull", ""), article(2, "tonull", None), article(1, "lapse", "x"), article(2, "lapse", "x", etat="ABROGE"), article(4, "far", "x")])
    assert rows(snapshots.article_changes(t).drop("changed_fields")) == [(1, 2, "EDIT", "changed"), (1, 2, "GONE", "removed"), (1, 2, "LAPSE", "removed"), (1, 2, "NEW", "added"), (1, 2, "TONULL", "changed")]


def test_snapshot_that_holds_nothing_removes_all(spark):
    t = table(spark, [article(1, "a", "x"), article(2, "a", "x", etat="ABROGE")])
    assert rows(snapshots.article_changes(t).select("cid", "change_kind")) == [("A", "removed")]


def test_changed_fields_and_empty(spark):
    rows_ = spark.createDataFrame([(1, "k", "a", None), (2, "k", "b", "y")], "p int, k string, f string, g string")
    assert rows(snapshots.snapshot_changes(rows_, "p", "k", ["f", "g"]).select("changed_fields")) == [(["f", "g"],)]
    assert snapshots.article_changes(table(spark, [])).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.integers(1, 4), st.sampled_from("abcd")), st.one_of(st.none(), st.sampled_from(["", "x", "y"]))))
def test_against_brute_force(spark, state):
    want = []
    present = {p for p, _ in state}
    for p in sorted(present):
        if p + 1 in present:
            for k in "abcd":
                o, n = (p, k) in state, (p + 1, k) in state
                if o != n:
                    want.append((p, k, "removed" if o else "added"))
                elif o and state[p, k] != state[p + 1, k]:
                    want.append((p, k, "changed"))
    df = spark.createDataFrame([(p, k, v) for (p, k), v in state.items()], "p int, k string, v string")
    assert rows(snapshots.snapshot_changes(df, "p", "k", ["v"]).select("old_snapshot", "k", "change_kind")) == sorted(want, key=repr)
