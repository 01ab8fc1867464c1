"""Token counts of a public tokenizer. The vocabulary file is a parameter; it's read on the workers, never copied."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary of the byte-level BPE for many languages lies by default.
DEFAULT = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenizer pattern of these vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[str], int]:
    """A function that counts the tokens of a text; the file is read where it lies, or where the job brought it."""
    import tiktoken

    if not os.path.exists(path):
        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def bring(spark: SparkSession, path: str) -> None:
    """Sends a vocabulary file of this machine along with the job, once, for workers that don't have it at this path."""
    sent = spark.sparkContext.__dict__.setdefault("_lexweave_files", set())
    if path not in sent and os.path.exists(path):
        spark.sparkContext.addFile(path)
        sent.add(path)


def count(text: Column, path: str = DEFAULT) -> Column:
    """Tokens of a text as BIGINT; null for a null text, 0 for an empty one. Whole texts are read."""
    if (spark := SparkSession.getActiveSession()) is not None:
        bring(spark, path)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = counter(path)
        for batch in batches:
            yield batch.map(of, na_action="ignore").astype("Int64")

    return tokens.asNondeterministic()(text)  # or the optimizer may count twice
