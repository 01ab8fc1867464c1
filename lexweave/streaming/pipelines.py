"""Streams: idempotent upsert of arriving points, the orphan state advanced per micro-batch, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lexweave.operators import orphans
from lexweave.sources import index
from lexweave.sources.files import Files


def upsert_points(stream: DataFrame, folder: str, name: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True) -> StreamingQuery:
    """Writes arriving points into a version of an index. Ids are deterministic, so a batch that's run again after a
    failure leaves the same table. `prepare` turns documents into points (id, ...), chunking and embedding included."""

    def write(batch: DataFrame, _: int) -> None:
        index.upsert(batch.sparkSession, folder, name, prepare(batch) if prepare else batch)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def orphan_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Advances the orphan state with every micro-batch of events (ref_table, space, record_key, missing_key, at, delta):
    a row with ref_table is a reference, one with delta a parent that comes (plus) or goes (minus) with key missing_key.

    The state after batch n lies in `folder`/state-n, what changed in it in `folder`/changes-n: references that dangle
    now and, where a parent arrived late, those that no longer do. Each batch reads the state of the one before, so a
    batch that's run again writes the same; a missing state is an error, not an empty one. A batch reads and writes the
    whole state, so let triggers be far apart where it is large.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n and not Files(spark, folder).exists(f"state-{n - 1}/settled/_SUCCESS"):
            raise FileNotFoundError(f"{folder}/state-{n - 1}: the state before batch {n} is missing")
        refs = batch.where("ref_table IS NOT NULL")
        parents = batch.where("ref_table IS NULL AND delta IS NOT NULL").select("space", F.col("missing_key").alias("key"), "at", "delta")
        done = orphans.advance(orphans.load(spark, f"{folder}/state-{n - 1}") if n else None, refs, parents)
        done.changes.write.mode("overwrite").parquet(f"{folder}/changes-{n}")
        orphans.save(done.state, f"{folder}/state-{n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events per window and type with sums of their values; later events than `late` are left out in a stream, and none
    in a batch. An extension beside the retrieval operators: it's the plan that a stream of usage events needs."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")
