"""Seams for models: what a model is given and gives, as Arrow functions that load it once per worker.

No model comes with the library. `hash_embedder`, `overlap_scorer` and `extractive_answer` stand in where the plans are
to be run without one; they say nothing about the quality of retrieval or answers.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (texts) -> [(dense, {token: weight})], in order.
Embed = Callable[[Sequence[str]], list[tuple[list[float], dict[int, float]]]]
#: (query, texts) -> scores.
Score = Callable[[Sequence[str], Sequence[str]], list[float]]
#: (prompts) -> answers; what it raises is recorded for the batch's rows.
Ask = Callable[[Sequence[str]], list[str]]

EMBEDDING = "struct<dense:array<float>,sparse_indices:array<bigint>,sparse_values:array<float>>"
_WORD = re.compile(r"[^\W_]{2,}")


def embed(text: Column, load: Callable[[], Embed], width: int | None = None) -> Column:
    """Embeddings of a text column; null for null. `load` gives the model once per worker. Vectors of another width than
    asked for are an error. Passages and queries of an asymmetric model are two calls with two loaders."""

    @F.pandas_udf(EMBEDDING)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            there = batch.notna()
            found = iter(model(batch[there].tolist()) if there.any() else [])
            out = []
            for t in there:
                dense, sparse = next(found) if t else (None, {})
                if t and width is not None and len(dense) != width:
                    raise ValueError(f"the model gave {len(dense)} dimensions, {width} are expected")
                keys = sorted(sparse)
                out.append((dense, keys if t else None, [sparse[k] for k in keys] if t else None))
            yield pd.DataFrame(out, columns=["dense", "sparse_indices", "sparse_values"])

    return run.asNondeterministic()(text)


def score(query: Column, text: Column, load: Callable[[], Score]) -> Column:
    """Scores of pairs as DOUBLE. Not moved below a limit by the optimizer."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for q, t in batches:
            yield pd.Series(model(q.fillna("").tolist(), t.fillna("").tolist()) if len(q) else [], dtype=float)

    return run.asNondeterministic()(query, text)


def ask(prompt: Column, load: Callable[[], Ask]) -> Column:
    """STRUCT<answer, error> of a generating or judging model; an error is kept per row and the rest go on."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            out = []
            for p in batch:
                try:
                    out.append((None if p is None else model([p])[0], None))
                except Exception as e:  # noqa: BLE001  whatever the model raises belongs to the row
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["answer", "error"])

    return run.asNondeterministic()(prompt)


def hash_embedder(width: int = 64) -> Embed:
    """Words hashed to signed axes, as a unit vector, and to tokens with their share of the words."""

    def run(texts: Sequence[str]) -> list[tuple[list[float], dict[int, float]]]:
        out = []
        for text in texts:
            dense, sparse = [0.0] * width, {}
            words = _WORD.findall(text.lower())
            for w in words:
                h = zlib.crc32(w.encode())
                dense[h % width] += 1.0 if h & 0x10000 else -1.0
                sparse[h % 1_000_003] = sparse.get(h % 1_000_003, 0.0) + 1.0 / len(words)
            norm = math.sqrt(sum(x * x for x in dense)) or 1.0
            out.append(([x / norm for x in dense], sparse))
        return out

    return run


def overlap_scorer() -> Score:
    """A logistic function of the share of the query's words that the text has."""

    def run(queries: Sequence[str], texts: Sequence[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts):
            words = set(_WORD.findall(q.lower()))
            share = len(words & set(_WORD.findall(t.lower()))) / max(1, len(words))
            out.append(1 / (1 + math.exp(3 - 6 * share)))
        return out

    return run


def extractive_answer() -> Ask:
    """The label of the first context of the prompt."""
    return lambda prompts: [next((x for x in p.splitlines() if x.startswith("— ")), "") for p in prompts]
