"""All queries of the core, by name."""

from __future__ import annotations

from lexweave.plans import checked, corpus, retrieval, texts

QUERIES = {**corpus.QUERIES, **retrieval.QUERIES, **texts.QUERIES, **checked.QUERIES}
SQL = {**corpus.SQL, **retrieval.SQL, **texts.SQL, **checked.SQL}
