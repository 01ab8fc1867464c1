"""Deterministic operators around model calls: citations, display, states, prompts, and the condensing decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.functions.text import MAX_CONDENSED_CHARS, first_reference, sanitize_condensed, strip_breadcrumb_root
from lexweave.operators.search import MARKER, short_circuit

#: Envelope of an answer: a tagged union in one struct.
ENVELOPE = "struct<type:string, explanation:string, fondement_juridique:array<struct<article_id:string, gloss:string>>, aucun_fondement:string, motif:string>"
#: Fixed value: what an answer without any valid citation says in the place of one.
NO_BASIS = "Pas de fondement juridique direct dans le corpus."
#: Headings of the two parts of a prompt's context.
FICHE_HEADING, ARTICLE_HEADING = "### Fiches", "### Articles"
# The outcomes of the condensing decision.
NO_HISTORY, SHORT_CIRCUIT, UNCHANGED, REWRITTEN = "skipped_no_history", "skipped_short_circuit", "passthrough", "rewritten"
FALLBACK_SANITIZER, FALLBACK_ERROR = "fallback_sanitizer", "fallback_error"


def retrieved_citations(contexts: DataFrame) -> DataFrame:
    """(qid, retrieved): the citation ids of the articles among the contexts; the marker gives none."""
    return contexts.where((F.col("register") == "article") & F.col("citation_id").isNotNull()).groupBy("qid").agg(F.array_sort(F.collect_set("citation_id")).alias("retrieved"))  # a query's contexts


def cited(envelope: Column) -> Column:
    """The distinct article ids that an envelope cites, in order; empty for none."""
    return F.coalesce(F.array_distinct(F.transform(envelope["fondement_juridique"], lambda c: c["article_id"])), F.array().cast("array<string>"))


def fabricated(envelope: Column, retrieved: Column) -> Column:
    """Citations of an answer that weren't retrieved; the answer is valid if there is none."""
    return F.array_except(cited(envelope), F.coalesce(retrieved, F.array().cast("array<string>")))


def repair(envelope: Column, false_ids: Column) -> Column:
    """The envelope for display without fabricated citations; an answer that loses all gets NO_BASIS. Valid ones stay."""
    kept = F.filter(envelope["fondement_juridique"], lambda c: ~F.array_contains(false_ids, c["article_id"]))
    empty = (envelope["type"] == "reponse") & (F.size(kept) == 0)
    repaired = F.struct(
        envelope["type"].alias("type"), envelope["explanation"].alias("explanation"), kept.alias("fondement_juridique"),
        F.when(empty, F.lit(NO_BASIS)).otherwise(envelope["aucun_fondement"]).alias("aucun_fondement"), envelope["motif"].alias("motif"),
    )
    return F.when(F.size(false_ids) > 0, repaired.cast(ENVELOPE)).otherwise(envelope.cast(ENVELOPE))


def state(envelope: Column) -> Column:
    """The state of an answer: refus:<motif>, reponse_sans_article where it says why it has no basis, else reponse."""
    return F.when(envelope["type"] == "refus", F.concat(F.lit("refus:"), envelope["motif"])).when(envelope["aucun_fondement"].isNotNull(), "reponse_sans_article").otherwise("reponse")


def view_state(envelope: Column) -> Column:
    """How an answer is shown: as `state`, with all refusals but hors_corpus as refus_regule."""
    return F.when((envelope["type"] == "refus") & (envelope["motif"] == "hors_corpus"), "hors_corpus").when(envelope["type"] == "refus", "refus_regule").otherwise(state(envelope))


#: The classes of refusals.
MOTIFS = ("recommandation_produit", "conseil_action", "hors_corpus")


def parse(answer: Column) -> Column:
    """STRUCT<envelope, error> of what a generating model said: JSON of one of the two kinds of envelope, with an
    explanation, citations that each name an article, and for a refusal a known motif. Null gives neither."""
    e = F.from_json(answer, ENVELOPE, {"mode": "PERMISSIVE"})
    answered, refused = F.coalesce(e["type"], F.lit("reponse")) == "reponse", F.coalesce(e["type"] == "refus", F.lit(False))
    named = F.forall(F.coalesce(e["fondement_juridique"], F.array().cast("array<struct<article_id:string,gloss:string>>")), lambda c: c["article_id"].isNotNull() & c["gloss"].isNotNull())
    good = e["explanation"].isNotNull() & named & (answered | (refused & F.coalesce(e["motif"].isin(*MOTIFS), F.lit(False))))
    whole = F.struct(
        F.coalesce(e["type"], F.lit("reponse")).alias("type"), e["explanation"].alias("explanation"), F.coalesce(e["fondement_juridique"], F.array()).alias("fondement_juridique"),
        F.when(answered, e["aucun_fondement"]).alias("aucun_fondement"), F.when(refused, e["motif"]).alias("motif"),
    )
    ok = F.coalesce(good, F.lit(False))
    return F.struct(F.when(ok, whole.cast(ENVELOPE)).alias("envelope"), F.when(answer.isNotNull() & ~ok, F.lit("the answer is not an envelope")).alias("error"))


# How a judge is shown the fields beside the explanation.
CITED, REFUSED, UNFOUNDED = "Fondement juridique :", "Refus (motif : %s)", "Aucun fondement : %s"


def render_answer(envelope: Column) -> Column:
    """An answer as a judge reads it: what it explains, and what its other fields say, where a fault may be hidden."""
    citations = F.transform(envelope["fondement_juridique"], lambda c: F.concat(F.lit("- "), c["article_id"], F.lit(" : "), F.coalesce(c["gloss"], F.lit(""))))
    listed = F.when(F.size(citations) > 0, F.concat(F.lit(f"\n{CITED}\n"), F.array_join(citations, "\n")))
    end = F.when(envelope["type"] == "refus", F.format_string(f"\n{REFUSED}", envelope["motif"])).when(envelope["aucun_fondement"].isNotNull(), F.format_string(f"\n{UNFOUNDED}", envelope["aucun_fondement"]))
    return F.concat_ws("\n", envelope["explanation"], listed, end)


def citation_links(answers: DataFrame, contexts: DataFrame, url: str) -> DataFrame:
    """(qid, citation_id, link): every citation of an answer with the address of the version that was retrieved; `url` is
    a format with one %s. Of several pieces of an article the first by slot counts."""
    wanted = answers.select("qid", F.explode(cited(F.col("envelope"))).alias("citation_id")).distinct()
    found = contexts.where("register = 'article'").groupBy("qid", "citation_id").agg(F.min_by("version", "slot").alias("version"))
    return wanted.join(found, ["qid", "citation_id"]).select("qid", "citation_id", F.format_string(url, F.col("version")).alias("link"))


def human_label(raw: Column, default: Column) -> Column:
    """pass or fail of what an annotator typed: p, pass, f or fail in any case; blank is the default, else null."""
    x = F.lower(F.trim(raw))
    return F.when(x == "", default).when(x.isin("p", "pass"), "pass").when(x.isin("f", "fail"), "fail")


def citation_correctness(cited_documents: Column, gold: Column) -> Column:
    """Share of the gold articles that are cited, by document; null without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(cited_documents, g)) / F.size(g))


def cited_documents(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, documents): the documents behind the citations, through the retrieved contexts only."""
    rows = answers.select("qid", F.explode(cited(F.col("envelope"))).alias("citation_id")).distinct()
    found = rows.join(contexts.where("register = 'article'").select("qid", "citation_id", "document").distinct(), ["qid", "citation_id"])
    return found.groupBy("qid").agg(F.array_sort(F.collect_set("document")).alias("documents"))


def score_answers(items: DataFrame, answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, expected_state, actual_state, state_correct, citation_valid, fabricated_ids, citation_correctness), on the
    answers as given, not repaired."""
    rows = items.join(answers, "qid").join(retrieved_citations(contexts), "qid", "left").join(cited_documents(answers, contexts), "qid", "left")
    wrong = fabricated(F.col("envelope"), F.col("retrieved"))
    return rows.select(
        "qid", "expected_state", state(F.col("envelope")).alias("actual_state"), (state(F.col("envelope")) == F.col("expected_state")).alias("state_correct"),
        (F.size(wrong) == 0).alias("citation_valid"), wrong.alias("fabricated_ids"),
        citation_correctness(F.coalesce("documents", F.array().cast("array<string>")), F.col("gold_articles")).alias("citation_correctness"),
    )


def render_contexts(contexts: DataFrame, fiche_heading: str = FICHE_HEADING, article_heading: str = ARTICLE_HEADING) -> DataFrame:
    """(qid, context): the guides of every query under their heading, then its articles under theirs, each in slot order.

    contexts: (qid, slot, register, text, title, chapitre_titre, cas_label, citation_id, breadcrumb). A guide is labelled
    by its non-empty titles, an article by its citation and the breadcrumb below the root; the marker is a line.
    """
    guide = text.enriched([F.coalesce(c, F.lit("")) for c in ("title", "chapitre_titre", "cas_label")], " · ")
    article = text.enriched([F.coalesce("citation_id", F.lit("")), F.coalesce(strip_breadcrumb_root(F.col("breadcrumb")), F.lit(""))], " · ")
    label = F.when(F.col("register") == "fiche", guide).otherwise(article)
    body = F.coalesce("text", F.lit(""))
    block = F.when(F.col("register") == MARKER, F.lit(NO_BASIS)).when(label != "", F.concat(F.lit("— "), label, F.lit("\n"), body)).otherwise(body)
    entries = F.array_sort(F.collect_list(F.struct("slot", (F.col("register") == "fiche").alias("guide"), block.alias("b"))))  # a query's contexts
    part = lambda kind: F.transform(F.filter(F.col("e"), lambda x: x["guide"] == kind), lambda x: x["b"])
    section = lambda heading, kind: F.when(F.size(part(kind)) > 0, F.concat(F.lit(heading + "\n\n"), F.array_join(part(kind), "\n\n")))
    return contexts.groupBy("qid").agg(entries.alias("e")).select("qid", F.concat_ws("\n\n", section(fiche_heading, True), section(article_heading, False)).alias("context"))


def messages(system: str, history: Column, user: Column) -> Column:
    """System message, history and the user's turn as ARRAY<STRUCT<role, content>>."""
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    kind = "array<struct<role:string,content:string>>"
    return F.concat(one("system", F.lit(system)).cast(kind), F.coalesce(history.cast(kind), F.array().cast(kind)), one("user", user).cast(kind))


def condense(turns: DataFrame, known: DataFrame, rewritten: str = "rewritten", limit: int = MAX_CONDENSED_CHARS) -> DataFrame:
    """turns plus (query, condensed_query, condense_status).

    turns: (raw_turn, history ARRAY, rewritten: what the rewriting model said, null where it failed or wasn't asked). A
    turn without history, or that names a known article, is its own query; a rewriting that the sanitizer rejects is kept
    in condensed_query but not used.
    """
    rows = short_circuit(turns, known, "raw_turn", first_reference)
    clean = sanitize_condensed(F.col("raw_turn"), F.col(rewritten), limit)
    same = clean == F.regexp_replace(F.col("raw_turn"), r"(?U)^\s+|\s+$", "")
    status = (
        F.when(F.coalesce(F.size("history"), F.lit(0)) <= 0, NO_HISTORY)
        .when(F.col("path") == "resolved", SHORT_CIRCUIT)
        .when(F.col(rewritten).isNull(), FALLBACK_ERROR)
        .when(clean.isNull(), FALLBACK_SANITIZER)
        .when(same, UNCHANGED)
        .otherwise(REWRITTEN)
    )
    rows = rows.withColumn("condense_status", status)
    done = F.col("condense_status")
    return rows.withColumn("condensed_query", F.when(done.isin(REWRITTEN, UNCHANGED), clean).when(done == FALLBACK_SANITIZER, F.col(rewritten))).withColumn("query", F.when(done == REWRITTEN, clean).otherwise(F.col("raw_turn"))).drop("path", "lookup_key")


def check_family(judge: str, generator: str) -> None:
    """A judge must not be of the family (the part before the slash) of the model that it judges."""
    if judge.split("/")[0] == generator.split("/")[0]:
        raise ValueError("judge and generator are of one family")
