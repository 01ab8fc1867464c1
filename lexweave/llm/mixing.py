"""Mixing sources to target weights: Poisson replication.

Every document gets a uniform number by a hash of its id and the seed; its count is the inverse of the Poisson
distribution at that number, with the source's mean repetition rate, and at most the source's cap. Documents are
exploded by their counts and shuffled globally by another hash. The rate is what makes the source's tokens come to its
target: since counts only grow with the rate, it's found by bisection over the source's tokens by uniform number, a
histogram of BINS cells a source, so that cap and chance are both allowed for.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave import session
from lexweave.llm import tokens as T

BINS = 4096
#: Of the largest total at which every source can still reach its share, the part that is drawn by default.
FILL = 0.9
SEED = 17


def _below(rate: float, cap: int) -> np.ndarray:
    """P(X <= k - 1) of a Poisson variable for k = 1..cap: a document is used k times or more if its number is above."""
    terms = [math.exp(-rate)]
    for k in range(1, cap):
        terms.append(terms[-1] * rate / k)
    return np.minimum(np.cumsum(terms), 1.0)


def _drawn(histogram: np.ndarray, rate: float, cap: int) -> float:
    """Tokens drawn at a rate; a bin that a threshold cuts counts in part."""
    upper = np.concatenate([[0.0], np.cumsum(histogram)])
    places = np.linspace(0, 1, len(histogram) + 1)
    return float(sum(upper[-1] - np.interp(b, places, upper) for b in _below(rate, cap)))


def rates(histograms: dict[str, np.ndarray], shares: dict[str, float], caps: dict[str, int], total: float | None = None, fill: float = FILL) -> dict[str, tuple[float, float]]:
    """source -> (rate, target tokens). Shares are taken relative to the sources that have tokens.

    Without a total, `fill` of the largest one that all sources can supply within their caps is aimed at; a source that
    can't supply its part of a given total gives all it may.
    """
    usable = {s: shares[s] for s in histograms if shares.get(s, 0) > 0 and caps.get(s, 0) > 0 and histograms[s].sum() > 0}
    if not usable:
        return {}
    scale = sum(usable.values())
    supply = {s: float(histograms[s].sum()) * caps[s] for s in usable}
    if total is None:
        total = fill * min(supply[s] * scale / w for s, w in usable.items())
    found = {}
    for s, w in usable.items():
        target = total * w / scale
        low, high = 0.0, 1.0
        while high < 1e3 and _drawn(histograms[s], high, caps[s]) < target:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if _drawn(histograms[s], mid, caps[s]) < target else (low, mid)
        found[s] = (high, target)
    return found


def prepare(documents: DataFrame, targets: DataFrame, tokenizer: str = T.DEFAULT, seed: int = SEED) -> DataFrame:
    """(doc_id, source, tokens, u) of the documents whose source has a target, written to the shared folder.

    Sources compare without surrounding white space and letter case, and come out in lower case. Null sources, texts and
    ids, and empty texts, are left out; of repeated ids the row with most tokens counts.
    """
    name = F.lower(F.btrim("source", F.lit(" \t\n\r ")))
    wanted = targets.select(name.alias("source")).where("source IS NOT NULL").distinct()
    rows = documents.where(F.length("text") > 0).select("doc_id", name.alias("source"), "text").where("doc_id IS NOT NULL").join(wanted, "source", "left_semi")
    rows = rows.select("doc_id", F.struct(T.count(F.col("text"), tokenizer).alias("tokens"), F.col("source")).alias("r")).groupBy("doc_id").agg(F.max("r").alias("r")).where("r.tokens > 0")
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return session.cut(rows.select("doc_id", "r.source", "r.tokens", u.alias("u")))


def _targets(targets: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    """Shares and caps by source: of repeated sources the first by share counts; a null share or cap is nought."""
    shares, caps = {}, {}
    for r in targets.select(F.lower(F.btrim("source", F.lit(" \t\n\r "))).alias("s"), "target_share", "max_repeats").where("s IS NOT NULL").orderBy("s", "target_share", "max_repeats").collect():
        shares.setdefault(r[0], float(r[1] or 0))
        caps.setdefault(r[0], int(r[2] or 0))
    return shares, caps


def plan(prepared: DataFrame, targets: DataFrame, total: float | None = None, fill: float = FILL) -> tuple[dict[str, tuple[float, float]], dict[str, int], dict[str, float]]:
    """(rates, caps, shares) of the sources."""
    shares, caps = _targets(targets)
    cells = prepared.groupBy("source", F.least(F.floor(F.col("u") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.sum("tokens").alias("n")).collect()  # BINS rows a source at most
    histograms: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(BINS))
    for s, b, n in cells:
        histograms[s][b] += n
    return rates(histograms, shares, caps, total, fill), caps, shares


def replicate(prepared: DataFrame, found: dict[str, tuple[float, float]], caps: dict[str, int]) -> DataFrame:
    """(source, doc_id, tokens, n_copies) of the documents that are used at all."""
    if not found:
        return prepared.select("source", "doc_id", "tokens", F.lit(0).alias("n_copies")).where("false")
    table = prepared.sparkSession.createDataFrame([(s, [float(x) for x in _below(rate, caps[s])]) for s, (rate, _) in found.items()], "source string, below array<double>")
    rows = prepared.join(F.broadcast(table), "source")  # one row a source with a target
    n = F.size(F.filter("below", lambda b: b < F.col("u")))
    return rows.select("source", "doc_id", "tokens", n.alias("n_copies")).where("n_copies > 0")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = T.DEFAULT, total: float | None = None, seed: int = SEED, fill: float = FILL) -> DataFrame:
    """(source, doc_id, copy_no, tokens, place): the mix in its global order, place being the hash that it's sorted by."""
    prepared = prepare(documents, targets, tokenizer, seed)
    found, caps, _ = plan(prepared, targets, total, fill)
    rows = replicate(prepared, found, caps).select("source", "doc_id", F.explode(F.sequence(F.lit(1), "n_copies")).alias("copy_no"), "tokens")
    return rows.withColumn("place", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1))).orderBy("place", "doc_id", "copy_no")


def shares(documents: DataFrame, targets: DataFrame, tokenizer: str = T.DEFAULT, total: float | None = None, seed: int = SEED, fill: float = FILL) -> DataFrame:
    """One row per target: its share, the share aimed at (relative to the sources with documents), the share reached,
    the documents there are and that are used, copies, most copies of one document, tokens and the Poisson rate."""
    prepared = prepare(documents, targets, tokenizer, seed)
    found, caps, wanted = plan(prepared, targets, total, fill)
    used = replicate(prepared, found, caps).groupBy("source").agg(F.count(F.lit(1)).alias("n_used"), F.sum("n_copies").alias("n_copies"), F.max("n_copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("n_copies")).alias("n_tokens")).collect()
    there = dict(tuple(r) for r in prepared.groupBy("source").count().collect())
    by, whole = {r[0]: r for r in used}, sum(r[4] for r in used)
    scale = sum(t for _, t in found.values())
    rows = []
    for s, w in sorted(wanted.items()):
        r = by.get(s)
        rows.append((s, w, found[s][1] / scale if s in found else 0.0, r[4] / whole if r else 0.0, caps[s], there.get(s, 0), r[1] if r else 0, r[2] if r else 0, r[3] if r else 0, r[4] if r else 0, found[s][0] if s in found else 0.0))
    return documents.sparkSession.createDataFrame(rows, "source string, target_share double, aimed_share double, actual_share double, max_repeats int, n_documents long, n_used long, n_copies long, most_copies int, n_tokens long, rate double")
