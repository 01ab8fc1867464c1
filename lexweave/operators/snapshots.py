"""Full snapshots: the rows a snapshot holds, and what changed between consecutive snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.keys import digest, norm_key

IN_FORCE = "VIGUEUR"


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Of the rows of one key, the one greatest in `order`; columns keys + order + payload.

    One aggregate over a struct: it combines on the map side, so a key that holds a third of all rows sends one row per
    task. Ties in `order` are broken by the payload, in its order, so the result never depends on the input's order.
    Rows with a null key column are left out; nulls elsewhere sort first.
    """
    rows = df.select(*keys, F.struct(*order, *payload).alias("_r")).where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    best = rows.groupBy(*keys).agg(F.max("_r").alias("_r"))
    return best.select(*keys, *(F.col(f"_r.`{c}`").alias(c) for c in (*order, *payload)))


def held(articles: DataFrame, payload: dict[str, Column] | None = None) -> DataFrame:
    """The articles each snapshot holds: (snapshot_no, cid, snapshot_date, delivered_at, *payload).

    Of the rows of one cid in one snapshot the latest delivery counts, and it must be in force. `cid` comes out trimmed
    and in upper case; rows without cid or snapshot are left out. `payload` maps output names to expressions over the
    input; they are computed before the shuffle, so give digests or sizes rather than texts where these do.
    """
    payload = payload or {}
    rows = articles.select("snapshot_no", norm_key("cid").alias("cid"), "delivered_at", "etat", "snapshot_date", *(c.alias(n) for n, c in payload.items()))
    best = latest(rows, ["snapshot_no", "cid"], ["delivered_at"], ["etat", "snapshot_date", *payload])
    return best.where(F.col("etat") == IN_FORCE).select("snapshot_no", "cid", "snapshot_date", "delivered_at", *payload)


def snapshot_changes(rows: DataFrame, period: str, key: str, fields: Sequence[str], periods: DataFrame | None = None) -> DataFrame:
    """What changed between consecutive snapshots: (old_snapshot, new_snapshot, key, change_kind, changed_fields).

    `rows` has at most one row per (period, key); a snapshot k is compared with k + 1, where `period` is an integer.
    Every row is unpivoted into signed cells (key, field, value) plus a marker that the key is present: minus one in the
    comparison where it is the old side, plus one where it is the new side. Cells whose grouped sum is not zero remain:
    a marker of +1 is an added key, of -1 a removed one; of a key without marker the remaining fields have changed.
    A null value is a value of its own, equal to null only. A comparison takes place between k and k + 1 where both
    are in `periods` (one column, default: the periods that have a row); two snapshots with a gap between them aren't
    consecutive. Values become digests, so the cells are narrow; two exchanges, both on near-unique keys. Empty input
    gives no rows.
    """
    periods = (rows.select(period) if periods is None else periods).toDF("_p").distinct()
    pairs = F.broadcast(periods.join(periods.select((F.col("_p") - 1).alias("_p")), "_p"))  # one row per snapshot
    cell = "struct<field:string,value:binary>"
    cells = rows.select(
        F.col(key).alias("_key"),
        F.explode(F.array(F.struct((F.col(period) - 1).alias("old"), F.lit(1).alias("sign")), F.struct(F.col(period).alias("old"), F.lit(-1).alias("sign")))).alias("_side"),
        F.array(
            F.struct(F.lit(None), F.lit(None)).cast(cell),
            *(F.struct(F.lit(f), digest(F.col(f).cast("string"))).cast(cell) for f in fields),
        ).alias("_cells"),
    ).select("_key", F.col("_side.old").alias("old_snapshot"), "_side.sign", F.explode("_cells").alias("_c"))
    cells = cells.join(pairs.select(F.col("_p").alias("old_snapshot")), "old_snapshot")
    sums = cells.groupBy("old_snapshot", "_key", F.col("_c.field").alias("field"), F.col("_c.value").alias("value")).agg(F.sum("sign").alias("n")).where("n <> 0")
    kinds = sums.groupBy("old_snapshot", "_key").agg(
        F.sum(F.when(F.col("field").isNull(), F.col("n")).otherwise(0)).alias("present"),
        F.array_sort(F.collect_set("field")).alias("changed_fields"),  # at most len(fields) per key
    )
    kind = F.when(F.col("present") > 0, "added").when(F.col("present") < 0, "removed").otherwise("changed")
    return kinds.select(
        F.col("old_snapshot").cast("int").alias("old_snapshot"),
        (F.col("old_snapshot") + 1).cast("int").alias("new_snapshot"),
        F.col("_key").alias(key),
        kind.alias("change_kind"),
        F.when(kind == "changed", F.col("changed_fields")).otherwise(F.array().cast("array<string>")).alias("changed_fields"),
    )


def article_changes(articles: DataFrame, fields: Sequence[str] = ("texteHtml",)) -> DataFrame:
    """`snapshot_changes` of the held articles over the named fields. The texts are digested before any shuffle."""
    # the digest of the value is taken in the map task; null keeps its own cell
    rows = held(articles, {f: F.hex(digest(F.col(f).cast("string"))) for f in fields})
    return snapshot_changes(rows, "snapshot_no", "cid", fields, articles.select("snapshot_no"))
