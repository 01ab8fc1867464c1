"""From documents to a live index: gate, chunk, embed, upsert, flip; and evaluation over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import session
from lexweave.functions import ids, models, text
from lexweave.operators import answers, chunking, gates, metrics, search
from lexweave.plans.arms import ARMS, Index, with_lookup
from lexweave.sources import index, readers

REGISTERS = ("fiches", "articles")
#: Stages of the chain, in order.
STAGES = ("condense", "retrieve", "generate")


def enrich_article(row_text: Column, breadcrumb: Column) -> Column:
    """The breadcrumb before the text, where there is one."""
    return text.enriched([F.coalesce(breadcrumb, F.lit("")), row_text])


def enrich_guide(row_text: Column, title: Column, chapter: Column, case: Column) -> Column:
    return text.enriched([F.coalesce(c, F.lit("")) for c in (title, chapter, case)] + [row_text])


def article_points(articles: DataFrame, load: Callable[[], models.Embed], width: int | None = None, enriched: bool = False, size: chunking.Counter = chunking.count_words, load_sparse: Callable[[], models.Embed] | None = None) -> DataFrame:
    """Points of articles (cid, id, citation_id, sectionParentId, sectionParentTitre, fullSectionsTitre, dateDebut, etat,
    texteHtml). With enriched=True the dense vector is that of the text with its breadcrumb, the sparse one is not.

    size: the tokenizer's counter that chunks are cut by. load_sparse: the model of the sparse side, where it isn't that
    of the dense one."""
    chunks = chunking.article_chunks(articles, size=size)
    meta = articles.select("cid", F.col("id").alias("version"), "citation_id", "sectionParentId", "fullSectionsTitre", "dateDebut", "etat")
    rows = chunks.join(meta, "cid")
    payload = F.struct(
        F.col("cid").alias("document"), "chunk_index", "text", "citation_id", text.lookup_key(F.col("citation_id")).alias("lookup_key"), F.col("sectionParentId").alias("section_id"),
        F.col("fullSectionsTitre").alias("breadcrumb"), "version", F.col("dateDebut").alias("date_debut"), "etat",
    )
    return _points(rows.withColumn("payload", payload), F.col("cid"), enrich_article(F.col("text"), F.col("fullSectionsTitre")) if enriched else None, load, width, load_sparse)


def guide_points(fiches: DataFrame, load: Callable[[], models.Embed], width: int | None = None, enriched: bool = False, size: chunking.Counter = chunking.count_words, load_sparse: Callable[[], models.Embed] | None = None) -> DataFrame:
    """Points of guides (fiche_id, xml); parameters as in `article_points`."""
    meta = readers.guide_headers(fiches).drop("doc_id")
    rows = chunking.guide_chunks(fiches, size=size).join(meta, "fiche_id")
    payload = F.struct(F.col("fiche_id").alias("document"), "chunk_index", "text", "title", "chapitre_titre", "cas_label", "section_ids", "sp_url", "date_modified", "fil_ariane", "type")
    return _points(rows.withColumn("payload", payload), F.col("fiche_id"), enrich_guide(F.col("text"), F.col("title"), F.col("chapitre_titre"), F.col("cas_label")) if enriched else None, load, width, load_sparse)


def _points(rows: DataFrame, key: Column, dense_text: Column | None, load: Callable[[], models.Embed], width: int | None, load_sparse: Callable[[], models.Embed] | None) -> DataFrame:
    rows = rows.withColumn("id", ids.point_id(key, F.col("chunk_index"))).withColumn("e", models.embed(F.col("text"), load_sparse or load, None if load_sparse else width))
    other = dense_text is not None or load_sparse is not None
    rows = rows.withColumn("d", models.embed(F.col("text") if dense_text is None else dense_text, load, width) if other else F.col("e"))
    return rows.select("id", "d.dense", "e.sparse_indices", "e.sparse_values", "payload")


def gate(articles: DataFrame, fiches: DataFrame, size: chunking.Counter = chunking.count_words) -> DataFrame:
    """All violations that keep a corpus from being indexed; `size` is the counter that its chunks are cut by."""
    full = lambda c: chunking.size_of(F.col(c), size)
    label = lambda c: F.when(F.col(c).isNotNull(), full(c)).otherwise(0)
    sections = readers.guide_headers(fiches).select("fiche_id", F.explode("section_ids").alias("section_id"))
    return gates.union(
        gates.article_gate(articles),
        gates.sections_gate(sections, articles.select(F.col("sectionParentId").alias("section_id"))),
        gates.chunk_gate(chunking.article_texts(articles), chunking.article_chunks(articles, size=size), "cid", full("text"), stub=F.col("is_stub")),
        gates.chunk_gate(chunking.guide_texts(fiches), chunking.guide_chunks(fiches, size=size), "fiche_id", full("text"), labels=label("chapitre_titre") + label("cas_label")),
    )


def run_ingest(spark: SparkSession, articles: DataFrame, fiches: DataFrame, load: Callable[[], models.Embed], folder: str, tag: str, width: int | None = None, enriched: bool = False, check: bool = True, live: bool = True, size: chunking.Counter = chunking.count_words, load_sparse: Callable[[], models.Embed] | None = None) -> dict[str, int]:
    """Builds a version of both registers and, if asked, makes it live; running it again changes nothing. The gate comes
    first: a corpus that fails it leaves the index untouched. Returns the number of points by register."""
    if check:
        gates.enforce(gate(articles, fiches, size))
    made = {"fiches": guide_points(fiches, load, width, enriched, size, load_sparse), "articles": article_points(articles, load, width, enriched, size, load_sparse)}
    names = {r: index.version_name(r, tag) for r in REGISTERS}
    for r, points in made.items():
        index.upsert(spark, folder, names[r], session.cut(points))
    if live:
        index.flip(spark, folder, names)
    return {r: index.version(spark, folder, n).count() for r, n in names.items()}


def open_index(spark: SparkSession, folder: str, queries: DataFrame, load: Callable[[], models.Embed], scorer: Callable[[], models.Score], load_sparse: Callable[[], models.Embed] | None = None) -> tuple[Index, DataFrame]:
    """(Index, points with payload) of the live tables for queries (qid, text). `load` is the model's side for queries,
    `load_sparse` that of the sparse model where it is another one."""
    parts = {r: index.live(spark, folder, r) for r in REGISTERS}
    key = lambda r: F.lit({"fiches": "fiche", "articles": "article"}[r])
    shared, titles = ("document", "chunk_index", "text"), ("title", "chapitre_titre", "cas_label")
    fiches = parts["fiches"].select("*", key("fiches").alias("register"), *(F.col(f"payload.{c}").alias(c) for c in shared), F.col("payload.section_ids").alias("section_ids"), F.lit(None).cast("string").alias("section_id"), F.lit(None).cast("string").alias("lookup_key"), F.lit(None).cast("string").alias("citation_id"), F.lit(None).cast("string").alias("breadcrumb"), *(F.col(f"payload.{c}").alias(c) for c in titles), F.lit(None).cast("string").alias("version"))
    articles = parts["articles"].select("*", key("articles").alias("register"), *(F.col(f"payload.{c}").alias(c) for c in shared), F.lit(None).cast("array<string>").alias("section_ids"), *(F.col(f"payload.{c}").alias(c) for c in ("section_id", "lookup_key", "citation_id", "breadcrumb")), *(F.lit(None).cast("string").alias(c) for c in titles), F.col("payload.version").alias("version"))
    points = fiches.drop("payload").unionByName(articles.drop("payload"))
    asked = session.cut(queries.select("qid", "text", models.embed(F.col("text"), load).alias("d"), models.embed(F.col("text"), load_sparse or load).alias("e")))
    spread = lambda rows, *keep: rows.select(*keep, F.explode(F.arrays_zip("sparse_indices", "sparse_values")).alias("p")).select(*keep, F.col("p.sparse_indices").alias("token"), F.col("p.sparse_values").cast("double").alias("weight"))

    def score(candidates: DataFrame) -> DataFrame:
        pairs = candidates.select("qid", "id").join(points.select("id", "text"), "id").join(asked.select("qid", F.col("text").alias("q")), "qid")
        return pairs.select("qid", "id", models.score(F.col("q"), F.col("text"), scorer).alias("new_score"))

    found = Index(
        points.select("id", "register", F.col("dense").alias("vector"), "section_id"),
        asked.select("qid", F.col("d.dense").alias("vector")),
        spread(points, "id", "register"),
        spread(asked.select("qid", "e.sparse_indices", "e.sparse_values"), "qid"),
        points.where("register = 'fiche'").select("id", "section_ids"),
        score,
    )
    return found, points


def run_experiment(spark: SparkSession, folder: str, items: DataFrame, load: Callable[[], models.Embed], scorer: Callable[[], models.Score], arm: str = "rung1", load_sparse: Callable[[], models.Embed] | None = None) -> DataFrame:
    """Scores of an arm over annotated items (qid, text, expected_state, gold_fiches, gold_articles, gold_spans), all in
    one plan over the table of questions."""
    x, points = open_index(spark, folder, items.select("qid", "text"), load, scorer, load_sparse)
    ranked = session.cut(ARMS[arm](x))
    facts = points.select("id", "document", "text")
    contexts = ranked.join(facts, "id", "left").withColumnRenamed("rank", "slot")
    pool = search.dense_legs(x.points, x.queries, shape=x.shape()).join(facts.select("id", "document"), "id")
    return metrics.score_items(items.drop("text"), contexts, pool, key="document")


def contexts_of(spark: SparkSession, folder: str, queries: DataFrame, load: Callable[[], models.Embed], scorer: Callable[[], models.Score], arm: str = "rung1", load_sparse: Callable[[], models.Embed] | None = None) -> DataFrame:
    """Contexts (qid, slot, id, score, register, provenance, document, text and labels) of queries (qid, query). One that
    names a known article is looked up, not searched."""
    known = index.live(spark, folder, "articles").select(F.col("payload.lookup_key").alias("lookup_key"))
    x, points = open_index(spark, folder, queries.select("qid", F.col("query").alias("text")), load, scorer, load_sparse)
    paths = search.short_circuit(queries.select("qid", "query"), known, "query", text.first_reference)
    ranked = with_lookup(x, paths, points.where("lookup_key IS NOT NULL").select("id", "lookup_key", "chunk_index"), arm)
    facts = points.select("id", "document", "title", "chapitre_titre", "cas_label", "text", "citation_id", "breadcrumb", "version")
    return ranked.join(facts, "id", "left").withColumnRenamed("rank", "slot")


def run_chain(spark: SparkSession, folder: str, turns: DataFrame, load: Callable[[], models.Embed], scorer: Callable[[], models.Score], rewrite: Callable[[], models.Ask], generate: Callable[[], models.Ask], arm: str = "rung1", system: str = "", load_sparse: Callable[[], models.Embed] | None = None) -> DataFrame:
    """Answers to turns (qid, raw_turn, history): trim, condense, retrieve by the condensed question, answer the raw one.

    (qid, query, condense_status, context, answer, envelope, retrieved, fabricated_ids, citation_valid, shown, state,
    view_state, error): `envelope` is the answer as given and checked, `shown` the one without citations that weren't
    retrieved. An answer that isn't an envelope, or a model that fails, leaves the envelope null and says so in `error`.
    """
    return chain(spark, folder, turns, load, scorer, rewrite, generate, arm, system, load_sparse)[0]


def chain(spark: SparkSession, folder: str, turns: DataFrame, load: Callable[[], models.Embed], scorer: Callable[[], models.Score], rewrite: Callable[[], models.Ask], generate: Callable[[], models.Ask], arm: str = "rung1", system: str = "", load_sparse: Callable[[], models.Embed] | None = None, on_stage: Callable[[str], None] = lambda stage: None) -> tuple[DataFrame, DataFrame]:
    """(answers, contexts) of `run_chain`; every model is asked once, both are read from the shared folder. `on_stage` is
    told the name of each of STAGES when it begins, for all turns at once."""
    on_stage(STAGES[0])
    known = index.live(spark, folder, "articles").select(F.col("payload.lookup_key").alias("lookup_key"))
    trimmed = turns.withColumn("history", text.trim_history(F.col("history")))
    asked = trimmed.withColumn("rewritten", F.when(F.coalesce(F.size("history"), F.lit(0)) > 0, models.ask(F.col("raw_turn"), rewrite)["answer"]))
    condensed = session.cut(answers.condense(asked, known).select("qid", "raw_turn", "history", "query", "condense_status"))
    on_stage(STAGES[1])
    contexts = session.cut(contexts_of(spark, folder, condensed.select("qid", "query"), load, scorer, arm, load_sparse))
    rows = condensed.join(answers.render_contexts(contexts), "qid", "left").join(answers.retrieved_citations(contexts), "qid", "left")
    prompt = F.concat_ws("\n\n", F.lit(system), F.coalesce("context", F.lit("")), "raw_turn")
    on_stage(STAGES[2])
    said = session.cut(rows.withColumn("a", models.ask(prompt, generate)))
    done = said.withColumn("p", answers.parse(F.col("a.answer"))).select(
        "qid", "raw_turn", "query", "condense_status", "context", F.col("a.answer").alias("answer"), F.col("p.envelope").alias("envelope"),
        F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"), F.coalesce("a.error", "p.error").alias("error"),
    )
    e = F.col("envelope")
    there = lambda c: F.when(e.isNotNull(), c)
    done = done.withColumn("fabricated_ids", there(answers.fabricated(e, F.col("retrieved"))))
    done = done.withColumn("citation_valid", F.size("fabricated_ids") == 0).withColumn("shown", there(answers.repair(e, F.col("fabricated_ids"))))
    return done.withColumn("state", there(answers.state(F.col("shown")))).withColumn("view_state", there(answers.view_state(F.col("shown")))), contexts


def trace(answered: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, stage, place, output): what every stage of `chain` gave for a turn, as JSON; of the contexts only ids, scores
    and where they come from, not texts."""
    found = F.transform(F.array_sort(F.collect_list(F.struct("slot", "id", "register", "score", "provenance"))), lambda c: c)  # a turn's contexts
    retrieved = contexts.groupBy("qid").agg(F.to_json(found).alias("output"))
    parts = (answered.select("qid", F.to_json(F.struct("condense_status", "query")).alias("output")), retrieved, answered.select("qid", F.to_json(F.struct("answer", "state", "citation_valid", "error")).alias("output")))
    rows = [df.select("qid", F.lit(name).alias("stage"), F.lit(i).alias("place"), "output") for i, (name, df) in enumerate(zip(STAGES, parts))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def run_ab(spark: SparkSession, folders: tuple[str, str], items: DataFrame, load: Callable[[], models.Embed], scorer: Callable[[], models.Score], change: str, arm: str = "rung1") -> tuple[DataFrame, DataFrame]:
    """(comparison, verdict) of one change between two indexes, by its registered primary metric. Nothing is flipped."""
    primary = metrics.primary_of(change)
    one, two = (session.cut(metrics.long_scores(run_experiment(spark, f, items, load, scorer, arm))) for f in folders)
    table = session.cut(metrics.compare(one, two))
    return table, metrics.verdict(table, primary)
