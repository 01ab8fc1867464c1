"""Registered queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import lookalike, mixing, packing, splitting, subjects
from lexweave.session import read


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.corpus_pieces(*(read(spark, d, t) for t in ("articles", "fiches", "fiche_chunks")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 1").select("item_kind", "item_key").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p1_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Words of every oversized chunk as its pieces have them: overlaps left out, nothing is lost or twice."""
    rows = splitting.pieces(splitting.chunk_items(read(spark, d, "fiche_chunks"), splitting.LIMIT), "text").where("n_pieces > 1")
    return rows.groupBy("item_key", "n_pieces", F.col("n_pieces").alias("_n")).agg(F.sum(F.col("n_words") - F.col("overlap_words")).alias("n_words"), F.max("n_words").alias("longest")).select("item_key", "n_words", (F.col("longest") <= splitting.LIMIT).alias("within"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.corpus_twins(read(spark, d, "articles"), read(spark, d, "fiche_chunks"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every text of an article or a fiche chunk in its consistent form."""
    return lookalike.corpus_forms(read(spark, d, "articles"), read(spark, d, "fiche_chunks"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every fiche chunk that looks like a different one: its class, and how many rows and originals the class has."""
    return lookalike.classes(read(spark, d, "fiche_chunks"), "chunk_id", "text").where("n_originals > 1").select(F.hex("form").alias("class_id"), F.col("key").alias("chunk_id"), "n_keys", "n_originals")


def p4_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one chunk per different original of a class; `p4_classes` is the membership."""
    members = lookalike.classes(read(spark, d, "fiche_chunks"), "chunk_id", "text")
    return lookalike.representatives(members).select("key_a", "key_b", "n_a", "n_b")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Containers of at most 2,048 tokens: which part of which document lies in which."""
    return packing.pack(packing.sized(read(spark, d, "documents")))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_pack(spark, d))


def p6_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document that is packed: whether all of its parts are, once each, and its containers keep to the capacity."""
    rows = p6_pack(spark, d)
    room = rows.groupBy("container_id").agg((F.sum("tokens") <= packing.CAPACITY).alias("fits"))
    return rows.join(room, "container_id").groupBy("doc_id").agg((F.count(F.lit(1)) == F.max("part_no")).alias("whole"), F.bool_and("fits").alias("fits"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(read(spark, d, "documents"), read(spark, d, "mix_targets"))


def p7_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources that the mix draws from, and whether no document is used more often than allowed."""
    rows = p7_mix(spark, d).groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("copy_no").alias("k"))
    caps = read(spark, d, "mix_targets").select(F.lower(F.btrim("source", F.lit(" \t\n\r\u00a0"))).alias("source"), "max_repeats")
    return rows.groupBy("source").agg(F.max("n").alias("most"), F.bool_and(F.col("n") == F.col("k")).alias("numbered")).join(caps, "source").select("source", (F.col("most") <= F.col("max_repeats")).alias("within"), "numbered")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_areas(*(read(spark, d, t) for t in ("documents", "subjects", "subject_labels")))


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject and their share of all documents."""
    n = read(spark, d, "documents").count()
    return p8_found(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.count(F.lit(1)) / F.lit(max(n, 1)), 6).alias("share"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_chunks, p4_found, p4_forms, p4_classes, p4_representatives, p6_pack, p6_fill, p6_documents, p7_mix, p7_shares, p7_sources, p8_found, p8_composition)}
_TRIM = "trim({0}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))"
SQL: dict[str, str] = {
    "p1_chunks": r"""SELECT chunk_id AS item_key, n AS n_words, true AS within FROM (SELECT chunk_id, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n FROM (SELECT DISTINCT chunk_id, text FROM fiche_chunks WHERE chunk_id IS NOT NULL)) WHERE n > 512""",
    "p6_documents": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE length(text) > 0",
    "p7_sources": f"""SELECT DISTINCT lower({_TRIM.replace('{0}', 'd.source')}) AS source, true AS within, true AS numbered FROM documents d JOIN mix_targets t ON lower({_TRIM.replace('{0}', 'd.source')}) = lower({_TRIM.replace('{0}', 't.source')}) AND t.target_share > 0 AND t.max_repeats > 0
  WHERE length(text) > 0""",
}
