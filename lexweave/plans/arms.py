"""Retrieval arms: plans from a table of queries to contexts, by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import search
from lexweave.session import cut


@dataclass
class Index:
    """The tables that an arm reads.

    points: (id, register, vector, section_id), postings: (id, register, token, weight), fiche_sections: (id,
    section_ids), queries: (qid, vector), query_postings: (qid, token, weight); score: the rescoring model as a plan.
    """

    points: DataFrame
    queries: DataFrame
    postings: DataFrame | None = None
    query_postings: DataFrame | None = None
    fiche_sections: DataFrame | None = None
    score: Callable[[DataFrame], DataFrame] | None = None
    known: search.Shape | None = None

    def shape(self) -> search.Shape:
        """Sizes of points and queries, counted once."""
        self.known = self.known or search.shape_of(self.points, self.queries)
        return self.known


REGISTERS = ("fiche", "article")
WEIGHTS = {"fiche": search.FICHE_WEIGHTS, "article": search.ARTICLE_WEIGHTS}


def _dense(x: Index) -> DataFrame:
    """Both dense legs, from one similarity join; written once, since they are read several times."""
    return cut(search.dense_legs(x.points, x.queries, shape=x.shape()))


def _hybrid(x: Index) -> DataFrame:
    return cut(search.fuse(search.dense_legs(x.points, x.queries, shape=x.shape()), search.sparse_legs(x.postings, x.query_postings), WEIGHTS))


def _by_register(pool: DataFrame) -> list[DataFrame]:
    return [pool.where(F.col("register") == r) for r in REGISTERS]


def _expanded(x: Index) -> DataFrame:
    """The merged pool of hybrid legs and expansion; written once."""
    fiches, articles = _by_register(_hybrid(x))
    expansion = search.expand(fiches, x.fiche_sections, x.points.where("register = 'article'").select("id", "section_id", "vector"), x.queries, shape=x.shape())
    return cut(search.merge(fiches, articles, expansion))


def _rescored(x: Index) -> DataFrame:
    return cut(search.rescore(_expanded(x), x.score))


def rung1(x: Index) -> DataFrame:
    """Dense legs of both registers, merged, the best of all."""
    return search.rank(search.merge(*_by_register(_dense(x))))


def rung2(x: Index) -> DataFrame:
    """Hybrid legs."""
    return search.rank(search.merge(*_by_register(_hybrid(x))))


def rung3(x: Index) -> DataFrame:
    """Hybrid legs and the expansion by section, on their own scales."""
    return search.rank(_expanded(x))


def rung4(x: Index) -> DataFrame:
    """The expanded pool, rescored by the model."""
    return search.rank(search.rescore(_expanded(x), x.score))


def rung5(x: Index) -> DataFrame:
    """The rescored pool under the register quota; `rank` is the slot."""
    rows = search.quota(_rescored(x), x.queries)
    return rows.withColumnRenamed("slot", "rank").select(*search.CANDIDATES)


ARMS = {f.__name__: f for f in (rung1, rung2, rung3, rung4, rung5)}


def retrieve(x: Index, arm: str = "rung1") -> DataFrame:
    """Contexts of all queries by the named arm. Another table of points is another index, not another arm."""
    if arm not in ARMS:
        raise KeyError(f"unknown arm {arm!r}; there are {', '.join(ARMS)}")
    return ARMS[arm](x)


def with_lookup(x: Index, turns: DataFrame, keyed_points: DataFrame, arm: str = "rung1") -> DataFrame:
    """Contexts of turns (qid, path, lookup_key): those resolved to an article get its pieces, the rest the arm."""
    found = search.by_key(keyed_points, turns.where("path = 'resolved'").select("qid", "lookup_key"))
    rest = turns.where("path <> 'resolved'").select("qid")
    left = Index(x.points, x.queries.join(rest, "qid", "left_semi"), x.postings, None if x.query_postings is None else x.query_postings.join(rest, "qid", "left_semi"), x.fiche_sections, x.score)
    return found.unionByName(retrieve(left, arm))
