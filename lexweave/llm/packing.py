"""Filling fixed-capacity containers with items: bulk-synchronous best fit.

Items and the gaps of containers are kept in order of size. Since sizes are whole numbers up to the capacity, items of
one size form one run of that order and are interchangeable, and so are containers with equal gaps; both are therefore
held as runs (size, first rank, number). A superstep takes the largest run of items not yet placed, sweeps to the
successor among the gap runs (the smallest gap that the size fits in), and matches items and containers rank by rank: the
j-th item of the run goes to the j-th container. What is matched gets its new gap and goes back in order; what is left
sweeps on; containers are opened when no gap fits. The runs number no more than the capacity whatever the corpus holds,
so the sweep's state is bounded and only ranks are looked up for each document, without a sort of the whole corpus.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave import session
from lexweave.llm import tokens as T

CAPACITY = 2048
#: Greatest capacity: the sweep's state is a row per size at most, and its work grows with the square of the sizes there are.
MOST = 1 << 14
#: Rows of one size that one task ranks, about.
RUN = 100_000


@dataclass
class Match:
    """Items of a size with ranks first..first+number-1 go to the containers of ids container + (rank - first) // each."""

    size: int
    first: int
    number: int
    container: int
    each: int


def sweep(histogram: dict[int, int], capacity: int) -> tuple[list[Match], int]:
    """Matches for all items of the histogram (size -> number), and how many containers they take.

    Sizes are from 1 to the capacity, which is at most MOST. A run of containers takes as many items of a size each as fit, the fullest first,
    which is what best fit in decreasing order does one item at a time.
    """
    if not 1 <= capacity <= MOST:
        raise ValueError(f"the capacity is from 1 to {MOST}")
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs (first container, number)
    order: list[int] = []  # heap of gaps that may have runs
    matches, opened = [], 0

    def put(gap: int, first: int, number: int) -> None:
        if gap and number:
            if not gaps[gap]:
                heapq.heappush(order, gap)
            gaps[gap].append((first, number))

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        if not 1 <= size <= capacity:
            raise ValueError("sizes are from 1 to the capacity")
        # the gaps that fit, smallest first; those too small for this size wait for smaller items
        fitting = sorted(g for g in gaps if g >= size and gaps[g])
        for gap in fitting:
            each = gap // size
            while left and gaps[gap]:
                first, number = gaps[gap].pop()
                used = min(number, left // each)
                if used:
                    matches.append(Match(size, rank, used * each, first, each))
                    put(gap - each * size, first, used)
                    rank, left = rank + used * each, left - used * each
                if used < number:
                    if left and left < each:  # the last items of the size share one container
                        matches.append(Match(size, rank, left, first + used, left))
                        put(gap - left * size, first + used, 1)
                        rank, left, used = rank + left, 0, used + 1
                    put(gap, first + used, number - used)
                    if not left:
                        break
            if not left:
                break
        if left:
            each = capacity // size
            used, rest = divmod(left, each)
            if used:
                matches.append(Match(size, rank, used * each, opened, each))
                put(capacity - each * size, opened, used)
                rank, opened = rank + used * each, opened + used
            if rest:
                matches.append(Match(size, rank, rest, opened, rest))
                put(capacity - rest * size, opened, 1)
                opened += 1
    return matches, opened


def sized(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = T.DEFAULT) -> DataFrame:
    """(doc_id, part_no, n_parts, tokens): the items of the documents, null and empty texts left out.

    A text that alone exceeds the capacity becomes full parts and a remainder; any other is one item.
    """
    rows = documents.where(F.length(text) > 0).select(F.col(key).alias("doc_id"), T.count(F.col(text), tokenizer).alias("n")).where("n > 0")
    whole = F.ceil(F.col("n") / capacity).cast("int")
    rows = rows.withColumn("n_parts", whole)
    return rows.select("doc_id", F.explode(F.sequence(F.lit(1), "n_parts")).alias("part_no"), "n_parts", "n").select(
        "doc_id", "part_no", "n_parts", F.least(F.lit(capacity), F.col("n") - (F.col("part_no") - 1) * capacity).cast("int").alias("tokens")
    )


def pack(items: DataFrame, key: str = "doc_id", part: str = "part_no", size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """(container_id, key, part, size): every item in one container, no container above the capacity.

    items: (key, part, size), size from 1 to the capacity; they are written once to the shared folder, since their
    ranks have to be the same on every read. Ranks are taken within parts of a size, by a hash of the key, that hold
    about RUN rows each; so a size that a third of all items has is ranked by many tasks. Their number, and so which
    of several items of one size goes to which container, follows from RUN; how full the containers are doesn't. Rows that agree in key and
    part share a rank order but are separate items. Empty input gives no rows.
    """
    items = session.cut(items.select(key, part, size))
    spark = items.sparkSession
    counts = items.groupBy(size).agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.collect()}  # at most one row per size up to the capacity
    matches, _ = sweep(histogram, capacity)
    parts = {s: max(1, -(-n // RUN)) for s, n in histogram.items()}
    many = max(parts.values(), default=1)
    if many > 1:
        of = F.create_map(*(x for s, n in parts.items() if n > 1 for x in (F.lit(s), F.lit(n))))
        salt = F.pmod(F.xxhash64(key, part), F.coalesce(of[F.col(size)], F.lit(1)))
    else:
        salt = F.lit(0).cast("long")
    rows = items.withColumn("_salt", salt)
    inner = F.row_number().over(Window.partitionBy(size, "_salt").orderBy(F.xxhash64(key, part), key, part)) - 1
    rows = rows.withColumn("_rank", inner.cast("long"))
    if many > 1:
        held = rows.groupBy(size, "_salt").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(size).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
        offsets = held.select(size, "_salt", F.coalesce(before, F.lit(0)).alias("_before"))  # rows / RUN + capacity rows
        rows = rows.join(offsets, [size, "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    by_size: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for m in matches:
        by_size[m.size].append((m.first, m.container, m.each))
    table = spark.createDataFrame([(s, [x[0] for x in sorted(v)], sorted(v)) for s, v in by_size.items()], "_size int, _firsts array<long>, _matches array<struct<first:long,container:long,each:long>>")
    placed = rows.join(F.broadcast(table), F.col(size) == F.col("_size"))  # at most capacity rows
    m = F.element_at("_matches", F.size(F.filter("_firsts", lambda x: x <= F.col("_rank"))))
    placed = placed.withColumn("_m", m)
    return placed.select((F.col("_m.container") + F.floor((F.col("_rank") - F.col("_m.first")) / F.col("_m.each"))).cast("long").alias("container_id"), key, part, size)


def fill(packed: DataFrame, size: str = "tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the least number of containers possible, and the share of room used."""
    per = packed.groupBy("container_id").agg(F.sum(size).alias("used"), F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.ceil(F.sum("used") / capacity), F.lit(0)).alias("least_containers"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 6).alias("fill"),
    )
