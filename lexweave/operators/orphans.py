"""References to records that do not exist: keyed pending-orphan state, advanced batch by batch.

The state holds, by key, the parents and the references that wait for one. A batch of events may bring references,
parents and deletions of any date, also late ones; it gives the references that dangle from then on and those that no
longer do.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave import session
from lexweave.functions.keys import norm_key
from lexweave.operators.records import current
from lexweave.operators.snapshots import held
from lexweave.sources.xmltree import parse

REF_TABLES = ("fiches", "articles", "golden_set")
#: Stands for the beginning of time.
ALWAYS = dt.date(1000, 1, 1)


# --- what refers to what -------------------------------------------------------------------------------------------


def fiche_references(fiches: DataFrame) -> DataFrame:
    """(ref_table, space, record_key, missing_key, at) of the current fiches.

    Every id of the form LEGISCTA and digits, in any letter case, in any dc:source of the root is a reference, once per
    fiche; its date is the first YYYY-MM-DD in dc:date. Fiches that don't parse or have no such date give none.
    """
    ids = r"(?i)LEGISCTA\d+"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dates, sources = [], [], []
            for k, x in zip(batch.column(0), batch.column(1)):
                if (doc := parse(x.as_py(), content=False)) is not None:
                    keys.append(k.as_py())
                    dates.append(" ".join(doc.headers.get("date", ())))
                    sources.append(" ".join(doc.headers.get("source", ())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (keys, dates, sources)], ["k", "d", "s"])

    rows = current(fiches).select("fiche_id", "xml").mapInArrow(read, "k string, d string, s string")
    return rows.select(
        F.lit("fiches").alias("ref_table"),
        F.lit("section").alias("space"),
        F.col("k").alias("record_key"),
        F.explode(F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(ids), F.lit(0)), F.upper))).alias("missing_key"),
        F.expr("try_cast(regexp_extract(d, '[0-9]{4}-[0-9]{2}-[0-9]{2}', 0) AS date)").alias("at"),
    ).where("at IS NOT NULL")


def article_references(held_articles: DataFrame) -> DataFrame:
    """The sections that held articles name (payload column `section`), one check per snapshot, on its date."""
    return held_articles.where("section IS NOT NULL AND snapshot_date IS NOT NULL").select(
        F.lit("articles").alias("ref_table"), F.lit("section").alias("space"), F.col("cid").alias("record_key"), F.col("section").alias("missing_key"), F.col("snapshot_date").alias("at")
    )


def golden_references(golden: DataFrame) -> DataFrame:
    """The articles that golden items name, on the date of their annotation; blank ids and null lists are none."""
    return (
        golden.where("id IS NOT NULL AND annotated_at IS NOT NULL")
        .select(F.lit("golden_set").alias("ref_table"), F.lit("article").alias("space"), F.col("id").alias("record_key"), F.explode("gold_articles").alias("k"), F.to_date("annotated_at").alias("at"))
        .select("ref_table", "space", "record_key", norm_key("k").alias("missing_key"), "at")
        .where("missing_key IS NOT NULL")
        .distinct()
    )


def section_lifetimes(sections: DataFrame) -> DataFrame:
    """(space, key, at, delta): plus one on the first day of a section's period, minus one on the day it ends."""
    rows = sections.select(norm_key("section_id").alias("key"), F.coalesce("valid_from", F.lit(ALWAYS)).alias("a"), F.col("valid_to").alias("b")).where("key IS NOT NULL AND (b IS NULL OR b > a)").distinct()
    return _lifetimes(rows, "section")


def article_lifetimes(held_articles: DataFrame, snapshots: Sequence[dt.date]) -> DataFrame:
    """An article exists from the date of a snapshot that holds it until the date of the next snapshot."""
    days = sorted(set(snapshots))
    ends = F.create_map(*(x for a, b in zip(days, days[1:]) for x in (F.lit(a), F.lit(b)))) if len(days) > 1 else F.create_map(F.lit(ALWAYS), F.lit(ALWAYS))
    rows = held_articles.where("snapshot_date IS NOT NULL").select(F.col("cid").alias("key"), F.col("snapshot_date").alias("a"), ends[F.col("snapshot_date")].alias("b")).distinct()
    return _lifetimes(rows, "article")


def _lifetimes(rows: DataFrame, space: str) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("b").alias("at"), F.lit(-1).alias("delta"))))
    return rows.select(F.lit(space).alias("space"), "key", both.alias("e")).select("space", "key", "e.at", "e.delta").where("at IS NOT NULL")


# --- the state -----------------------------------------------------------------------------------------------------

_REF = ("ref_table", "space", "record_key", "missing_key", "at")
_KEY = ("space", "missing_key")
#: Parts that the references of one key and date are divided into where they are matched.
PARTS = 16


@dataclass
class State:
    """What is known after some batches, by key: `parents`, the index (space, key, at, delta) of how many parents come
    or go on a date; `waiting`, the references (ref_table, space, record_key, missing_key, at) that have no parent on
    their date; and `settled`, those that have one. A frame that isn't used is not computed."""

    parents: DataFrame
    waiting: DataFrame
    settled: DataFrame


@dataclass
class Step:
    """One advance: the state after it, and what changed: (ref_table, record_key, missing_key, at, change), plus one for
    a reference that dangles now, minus one for a waiting one that a parent was found for."""

    state: State
    changes: DataFrame


def _probe(refs: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(waiting, settled): distinct references without and with a parent in the index as of their date.

    References are reduced to the dates on which a key is asked for, and a running sum over a key's distinct dates tells
    how many parents it has then; what happens to a parent on a day counts before that day's references. So a key that
    a third of all references name is a few rows there. Where references are matched with the dates without parent, each
    date goes to PARTS parts.
    """
    asked = refs.groupBy(*_KEY, "at").agg(F.lit(0).cast("long").alias("delta"), F.lit(1).alias("asked"))
    events = parents.select("space", F.col("key").alias("missing_key"), "at", F.col("delta").cast("long").alias("delta"), F.lit(0).alias("asked"))
    timeline = asked.unionByName(events).groupBy(*_KEY, "at").agg(F.sum("delta").alias("delta"), F.max("asked").alias("asked"))
    running = F.sum("delta").over(Window.partitionBy(*_KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    gone = timeline.withColumn("open", running).where("asked = 1 AND open <= 0").select(*_KEY, "at", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    parted = refs.withColumn("_part", F.pmod(F.xxhash64("record_key"), F.lit(PARTS)).cast("int"))
    return tuple(parted.join(gone, [*_KEY, "at", "_part"], how).drop("_part") for how in ("left_semi", "left_anti"))  # type: ignore[return-value]


def advance(state: State | None, refs: DataFrame, parents: DataFrame) -> Step:
    """Applies one batch of references and of parents' comings and goings, of any dates, to the state (None: empty).

    New references probe the parent index as of their date. Arriving parents resolve the references that wait for them,
    also those of earlier batches (a parent that arrives late retracts what was reported), deletions reopen settled
    ones: all held references of the keys that the batch touches are probed again, the others stay as they are. So the
    state after some batches doesn't depend on how events are divided among them or ordered. References that the state
    holds already change nothing, those without key or date are none; a parent event counts as often as it comes.
    """
    refs = refs.select(*_REF).where("missing_key IS NOT NULL AND at IS NOT NULL").distinct()
    parents = parents.where("key IS NOT NULL AND at IS NOT NULL").groupBy("space", "key", "at").agg(F.sum("delta").cast("long").alias("delta")).where("delta <> 0")
    if state is None:
        refs = session.cut(refs)
        waiting, settled = _probe(refs, parents)
        return Step(State(parents, waiting, settled), waiting.select("ref_table", "record_key", "missing_key", "at", F.lit(1).alias("change")))
    parents = session.cut(parents)
    touched = parents.select("space", F.col("key").alias("missing_key")).distinct()
    held_ = state.waiting.withColumn("was", F.lit(1)).unionByName(state.settled.withColumn("was", F.lit(0)))
    fresh = refs.join(held_, list(_REF), "left_anti").withColumn("was", F.lit(0))
    asked = session.cut(fresh.unionByName(held_.join(touched, list(_KEY), "left_semi").select(*_REF, "was")))
    index = state.parents.unionByName(parents.select(*state.parents.columns))
    keys = asked.select("space", F.col("missing_key").alias("key")).distinct()
    waiting, settled = _probe(asked, index.join(keys, ["space", "key"], "left_semi"))
    changed = waiting.where("was = 0").withColumn("change", F.lit(1)).unionByName(settled.where("was = 1").withColumn("change", F.lit(-1)))
    after = State(
        index.groupBy("space", "key", "at").agg(F.sum("delta").alias("delta")).where("delta <> 0"),
        state.waiting.join(touched, list(_KEY), "left_anti").select(*_REF).unionByName(waiting.select(*_REF)),
        state.settled.join(touched, list(_KEY), "left_anti").select(*_REF).unionByName(settled.select(*_REF)),
    )
    return Step(after, changed.select("ref_table", "record_key", "missing_key", "at", "change"))


def save(state: State, folder: str) -> None:
    for name in ("parents", "waiting", "settled"):
        getattr(state, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str) -> State:
    return State(*(spark.read.parquet(f"{folder}/{name}") for name in ("parents", "waiting", "settled")))


def counts(state: State, bounds: Sequence[dt.date], ref_tables: Sequence[str] = REF_TABLES) -> DataFrame:
    """The periodic counts: (ref_table, until, arrived, resolved, reopened, pending) at the end of every period between
    `bounds` (ends, exclusive; the last period is open).

    A reference waits at the end of a period if its key then has no parent, whatever it had on the reference's own date:
    those that arrived in the period, the waiting ones that it resolved, those it reopened, and all that wait. Per key
    and period with an event the change is taken, and the changes are summed over the periods.
    """
    ends = [*sorted(set(bounds)), None]
    period = lambda c: F.size(F.filter(F.array(*map(F.lit, ends[:-1])).cast("array<date>"), lambda b: b <= c))
    refs = state.waiting.unionByName(state.settled).groupBy("space", F.col("missing_key").alias("key"), period(F.col("at")).alias("p")).agg(F.lit(0).cast("long").alias("delta"), *(F.count(F.when(F.col("ref_table") == t, 1)).alias(t) for t in ref_tables))
    events = state.parents.groupBy("space", "key", period(F.col("at")).alias("p")).agg(F.sum("delta").alias("delta"), *(F.lit(0).cast("long").alias(t) for t in ref_tables))
    rows = refs.unionByName(events).groupBy("space", "key", "p").agg(F.sum("delta").alias("delta"), *(F.sum(t).alias(t) for t in ref_tables))
    sofar = Window.partitionBy("space", "key").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("open", F.sum("delta").over(sofar))
    for t in ref_tables:
        rows = rows.withColumn(f"_{t}", F.sum(t).over(sofar))
    gone, was = F.col("open") <= 0, F.col("open") - F.col("delta") <= 0

    def of(t: str) -> Column:
        old, now = F.col(f"_{t}") - F.col(t), F.col(f"_{t}")
        return F.struct(
            F.lit(t).alias("ref_table"),
            F.col(t).alias("arrived"),
            F.when(was & ~gone, old).otherwise(0).alias("resolved"),
            F.when(~was & gone, old).otherwise(0).alias("reopened"),
            (F.when(gone, now).otherwise(0) - F.when(was, old).otherwise(0)).alias("pending"),
        )

    names = ("arrived", "resolved", "reopened", "pending")
    changes = rows.select("p", F.explode(F.array(*map(of, ref_tables))).alias("c")).groupBy("c.ref_table", "p").agg(*(F.sum(f"c.{x}").alias(x) for x in names))
    grid = state.waiting.sparkSession.createDataFrame([(t, p, end or dt.date(9999, 12, 31)) for t in ref_tables for p, end in enumerate(ends)], "ref_table string, p int, until date")
    all_ = grid.join(changes, ["ref_table", "p"], "left").fillna(0, list(names))
    before = Window.partitionBy("ref_table").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)  # a row per period
    return all_.select("ref_table", "arrived", "resolved", "reopened", F.sum("pending").over(before).alias("pending"), "until")


def run(parents: DataFrame, refs: DataFrame, bounds: Sequence[dt.date], ref_tables: Sequence[str] = REF_TABLES) -> tuple[DataFrame, DataFrame]:
    """All events as one batch: the dangling references (ref_table, record_key, missing_key, at), each distinct one once,
    which are those that wait in the state, and the `counts` per period. Batches give the same (`advance`)."""
    state = advance(None, refs, parents).state
    return state.waiting.select("ref_table", "record_key", "missing_key", "at"), counts(state, bounds, ref_tables)


def corpus_orphans(articles: DataFrame, sections: DataFrame, fiches: DataFrame, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`run` over the project's own references; a period of the counts ends with the date of each snapshot."""
    holding = session.cut(held(articles, {"section": norm_key("sectionParentId")}))
    snapshots = [r[0] for r in articles.where("snapshot_date IS NOT NULL").select("snapshot_date").distinct().collect()]  # one row per snapshot
    refs = article_references(holding).unionByName(fiche_references(fiches)).unionByName(golden_references(golden))
    parents = section_lifetimes(sections).unionByName(article_lifetimes(holding, snapshots))
    return run(parents, refs, snapshots)
