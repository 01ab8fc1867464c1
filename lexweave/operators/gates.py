"""Gates: frames of violations (check, key, detail). An empty frame passes; `enforce` raises once with all of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave import session
from lexweave.functions.text import lookup_key
from lexweave.operators.chunking import BAND, FLOOR, SPECIAL
from lexweave.operators.snapshots import IN_FORCE

# Slack of the content checks, states, bounds and the tag.
STUB_BUDGET, LABEL_SLACK = 200, 100
STATES = ("reponse", "reponse_sans_article", "refus:recommandation_produit", "refus:conseil_action", "refus:hors_corpus")
OUT_OF_CORPUS, WITHOUT_ARTICLE, MULTI_TURN = "refus:hors_corpus", "reponse_sans_article", "multi_turn"


def violations(rows: DataFrame, check: str, key: Column | str, detail: Column | None = None) -> DataFrame:
    k = F.col(key) if isinstance(key, str) else key
    return rows.select(F.lit(check).alias("check"), k.cast("string").alias("key"), (F.lit(None).cast("string") if detail is None else detail.cast("string")).alias("detail"))


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


class GateError(ValueError):
    """A corpus or set that a gate refuses; `violations` is the frame of all of them."""

    def __init__(self, message: str, violations: DataFrame) -> None:
        super().__init__(message)
        self.violations = violations


def summary(found: DataFrame) -> DataFrame:
    """(check, n): the checks that failed and how often."""
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("n"))


def enforce(found: DataFrame, shown: int = 20) -> None:
    """Raises GateError once, naming every failed check with its number of violations and the first `shown` whole keys;
    the error carries the frame of all violations, which may be as large as the corpus, for whoever wants every one."""
    found = session.cut(found)
    counts = {r[0]: r[1] for r in summary(found).collect()}  # one row a check
    if not counts:
        return
    order = Window.partitionBy("check").orderBy("key")
    some = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= shown).orderBy("check", "key").collect()
    rows = [(c, n, [str(r["key"]) for r in some if r["check"] == c]) for c, n in sorted(counts.items())]
    raise GateError("; ".join(f"{c}: {n} ({', '.join(keys)}{', …' if n > len(keys) else ''})" for c, n, keys in rows), found)


def repeated(rows: DataFrame, check: str, *keys: str) -> DataFrame:
    """Keys that more than one row has; null keys don't repeat."""
    return violations(rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), check, F.concat_ws("#", *keys), F.col("n"))


def article_gate(articles: DataFrame) -> DataFrame:
    """One row per cid, all in force, keys unique, citations present; over (cid, etat, citation_id)."""
    keyed = articles.select(lookup_key(F.col("citation_id")).alias("lookup_key"))
    return union(
        repeated(articles, "one version per article", "cid"),
        violations(articles.where(~F.col("etat").eqNullSafe(IN_FORCE)), "in force", "cid", F.col("etat")),
        repeated(keyed, "lookup keys unique", "lookup_key"),
        violations(articles.where(F.coalesce("citation_id", F.lit("")) == ""), "citation present", "cid"),
    )


def sections_gate(fiche_sections: DataFrame, articles: DataFrame) -> DataFrame:
    """Guides of (fiche_id, section_id) none of whose sections has an article (section_id)."""
    known = articles.select("section_id").where("section_id IS NOT NULL").distinct()
    good = fiche_sections.join(known, "section_id", "left_semi").select("fiche_id").distinct()
    return violations(fiche_sections.select("fiche_id").distinct().join(good, "fiche_id", "left_anti"), "sections resolve", "fiche_id")


def chunk_gate(documents: DataFrame, chunks: DataFrame, key: str, size: Column, labels: Column | None = None, stub: Column | None = None) -> DataFrame:
    """Every document (key, text) has a chunk (key, text, tokens), none above the band or below the floor, nothing lost.

    size: tokens of a document's text; labels: tokens of the labels of a chunk, for guides; stub: whether a chunk is one.
    """
    stub = F.lit(False) if stub is None else stub
    checks = [
        violations(documents.select(key).join(chunks.select(key).distinct(), key, "left_anti"), "at least one chunk", key),
        violations(chunks.where(F.col("tokens") > BAND).select(key).distinct(), "no chunk over the band", key),
        violations(chunks.where((F.col("tokens") < FLOOR) & ~stub).select(key).distinct(), "chunks meet the floor", key),
    ]
    sums = chunks.groupBy(key).agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"), F.bool_or(stub).alias("stubbed"), F.sum(F.lit(0) if labels is None else labels).alias("labels"))
    both = documents.select(key, size.alias("source")).join(sums, key)
    low = F.col("source") - (F.lit(0) if labels is None else F.col("labels") + LABEL_SLACK)
    high = F.col("source") + (F.col("n") - 1) * SPECIAL + F.when(F.col("stubbed"), STUB_BUDGET).otherwise(0)
    return union(*checks, violations(both.where(~F.col("total").between(low, high)), "no content lost", key, F.concat_ws("/", "total", "source")))


def golden_gate(items: DataFrame, fiche_ids: DataFrame, cids: DataFrame, chunk_texts: DataFrame) -> DataFrame:
    """The ten checks of annotated items. fiche_ids: (fiche_id), cids: (cid), chunk_texts: (fiche_id, text).

    Null lists are empty ones. Repeated references and spans count once.
    """
    none = F.array().cast("array<string>")
    rows = items.select("id", "expected_state", *(F.coalesce(c, none).alias(c) for c in ("gold_fiches", "gold_spans", "gold_articles", "expected_points", "tags")), F.coalesce("history", F.array().cast("array<map<string,string>>")).alias("history"))
    s, size = F.col("expected_state"), lambda c: F.size(c)
    out, without = s == OUT_OF_CORPUS, s == WITHOUT_ARTICLE
    other = s.isNotNull() & ~out & ~without
    points = size("expected_points")
    fiche_refs = rows.select("id", F.explode("gold_fiches").alias("fiche_id")).distinct()
    article_refs = rows.select("id", F.explode("gold_articles").alias("cid")).distinct()
    spans = rows.select("id", F.explode("gold_spans").alias("span")).distinct()
    # a span is looked for in the pieces of the item's own guides; items are few against pieces, pieces aren't copied
    own = spans.join(fiche_refs, "id").join(chunk_texts, "fiche_id").where(F.contains(F.col("text"), F.col("span"))).select("id", "span").distinct()
    turns = F.exists("history", lambda t: (F.element_at(t, F.lit("role")) == "assistant") & F.coalesce(F.contains(F.element_at(t, F.lit("content")), F.lit("fondement_juridique")), F.lit(False)))
    tagged, multi = F.array_contains("tags", MULTI_TURN), size("history") > 0
    return union(
        repeated(rows, "ids unique", "id"),
        violations(rows.where(~F.coalesce(F.col("id").rlike(r"^gs-\d+$"), F.lit(False))), "id shape", "id"),
        violations(rows.where(~F.coalesce(s.isin(*STATES), F.lit(False))), "state known", "id", s),
        violations(fiche_refs.join(fiche_ids.distinct(), "fiche_id", "left_anti"), "gold fiches resolve", "id", F.col("fiche_id")),
        violations(article_refs.join(cids.distinct(), "cid", "left_anti"), "gold articles resolve", "id", F.col("cid")),
        violations(spans.join(own, ["id", "span"], "left_anti"), "spans verbatim", "id", F.col("span")),
        violations(rows.where(out & ((size("gold_fiches") > 0) | (size("gold_articles") > 0) | (size("gold_spans") > 0))), "out of corpus has no gold", "id"),
        violations(rows.where(without & (size("gold_articles") > 0)), "without article has no gold article", "id"),
        violations(rows.where((without | other) & (size("gold_fiches") == 0)), "gold fiche needed", "id"),
        violations(rows.where(other & (size("gold_articles") == 0)), "gold article needed", "id"),
        violations(rows.where(~F.when(out, points == 0).otherwise(points.between(1, 3))), "number of points", "id", points),
        violations(rows.where(turns), "history stripped", "id"),
        violations(rows.where(tagged != multi), "multi-turn tag", "id"),
    )


def calibration_gate(pairs: DataFrame, golden: DataFrame) -> DataFrame:
    """Checks of judge-calibration pairs (golden_id, archetype, question, expected_points, retrieved ARRAY, clean, faulted
    STRUCT<envelope>) against the golden items (id, question, expected_points)."""
    c, f = F.col("clean.envelope"), F.col("faulted.envelope")
    ids = lambda e: F.transform(e["fondement_juridique"], lambda x: x["article_id"])
    outside = lambda e: F.size(F.array_except(ids(e), F.col("retrieved"))) > 0
    kind = F.col("archetype")
    refusal = kind == "refusal_without_explanation"
    both = pairs.join(golden.select(F.col("id").alias("golden_id"), F.col("question").alias("_q"), F.col("expected_points").alias("_p"), F.lit(True).alias("_known")), "golden_id", "left")
    refuses = (c["type"] == "refus") & (f["type"] == "refus")
    return union(
        repeated(pairs, "one pair per item", "golden_id"),
        violations(both.where("_known IS NULL"), "item known", "golden_id"),
        violations(both.where(F.col("_known") & ~F.col("question").eqNullSafe(F.col("_q"))), "same question", "golden_id"),
        violations(both.where(F.col("_known") & ~F.col("expected_points").eqNullSafe(F.col("_p"))), "same points", "golden_id"),
        violations(pairs.where(c.eqNullSafe(f)), "twin differs", "golden_id"),
        violations(pairs.where((kind == "fabricated_citation") & ~outside(f)), "twin cites outside", "golden_id"),
        violations(pairs.where((kind == "fabricated_citation") & outside(c)), "clean cites inside", "golden_id"),
        violations(pairs.where((refusal | (kind == "dropped_expected_point")) & (F.size("expected_points") <= 0)), "points needed", "golden_id"),
        violations(pairs.where(refusal & ~refuses), "both refuse", "golden_id"),
        violations(pairs.where(refusal & refuses & ~c["motif"].eqNullSafe(f["motif"])), "same motif", "golden_id"),
        violations(pairs.where(refusal & refuses & (F.length(f["explanation"]) >= F.length(c["explanation"]))), "twin explains less", "golden_id"),
    )
