"""Registered queries of operators around the corpus: sources, index, gates, answers, annotation, texts; all with SQL."""

from __future__ import annotations

import json
import re
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import schemas, session
from lexweave.functions import ids, text
from lexweave.functions.keys import digest, norm_key
from lexweave.operators import annotation, answers, chunking, gates, metrics, search
from lexweave.operators.snapshots import held
from lexweave.plans import evaluate, ingest
from lexweave.plans.retrieval import SQL as _RETRIEVAL
from lexweave.plans.retrieval import item_metrics
from lexweave.plans.texts import _ITEMS, _KEY, _LAST, _answers, _articles, _golden, _reduced, _term_shortlist
from lexweave.plans.texts import SQL as _TEXTS
from lexweave.session import read
from lexweave.sources import index, readers
from lexweave.streaming import pipelines


def _none() -> Column:
    return F.array().cast("array<string>")


# --- sources and index -----------------------------------------------------------------------------------------------


def jsonl_articles(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot's articles in force as a delivery, written as JSON lines and read back under the schema."""
    rows = read(spark, d, "articles").where("snapshot_no = 6").withColumn("_ms", F.unix_millis(F.try_to_timestamp("dateDebut", F.lit("yyyy-MM-dd"))))
    path = session.scratch(spark, "articles")
    readers.write_jsonl(readers.article_delivery(rows, {f: f for f in schemas.ARTICLE_FIELDS if f != "dateFin"} | {"dateDebut": "_ms"}), path)
    return readers.jsonl(spark, path).select("cid", "etat", "dateDebut", "citation_id", F.length("texteHtml").cast("long").alias("n_chars"), F.col("dateFin").isNull().alias("no_end"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "fiche_chunks").where("fiche_id IS NOT NULL AND chunk_index IS NOT NULL AND text IS NOT NULL")
    rows = rows.groupBy("fiche_id", "chunk_index").agg(F.max("text").alias("text"), F.max("tokens").alias("tokens"))
    empty = F.array().cast("array<bigint>"), F.array().cast("array<float>")
    return rows.select(ids.point_id(F.col("fiche_id"), F.col("chunk_index")).alias("id"), F.array(F.col("tokens").cast("float")).alias("dense"), empty[0].alias("sparse_indices"), empty[1].alias("sparse_values"), F.col("text").alias("payload"))


def _built(spark: SparkSession, d: str) -> str:
    """An index with two registers; the pieces with a size are written again, with another payload."""
    folder, points = session.scratch(spark, "index"), session.cut(_points(spark, d))
    names = {"fiches": index.version_name("fiches", "index-1"), "pieces": index.version_name("pieces", "index-1")}
    for name in names.values():
        index.create(spark, folder, name, points)
        index.upsert(spark, folder, name, points)
    index.upsert(spark, folder, names["pieces"], points.where("dense[0] IS NOT NULL").withColumn("payload", F.concat(F.lit("again "), "payload")))
    index.flip(spark, folder, names)
    return folder


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The live points after a second write of some of them."""
    return index.live(spark, _built(spark, d), "pieces").select("id", digest("payload").alias("payload")).withColumn("payload", F.lower(F.hex("payload")))


def index_release(spark: SparkSession, d: str) -> DataFrame:
    """A release of both registers published, restored elsewhere, and found healthy there."""
    folder, out, other = _built(spark, d), session.scratch(spark, "release"), session.scratch(spark, "restored")
    lock = index.publish(spark, folder, out, "index-2", ["fiches", "pieces"], {"chunking": "band"})
    done = index.restore(spark, other, out)
    again = index.restore(spark, other, out)
    ok = index.health(spark, other, lock.tag, ["fiches", "pieces"])["ok"]
    rows = [(r, lock.registers[r]["rows"], done[r], again[r], index.tag_of(r, index.pointers(spark, other)[r]), ok) for r in sorted(done)]
    return spark.createDataFrame(rows, "register string, n_rows long, outcome string, second string, tag string, healthy boolean")


def dataset_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = readers.dataset_items(_items(spark, d), "eval-")
    return rows.select("id", "input", "expected.expected_state", F.array_join("expected.gold_fiches", ",").alias("fiches"), F.size("expected.expected_points").alias("n_points"), F.array_join("metadata.tags", ",").alias("tags"))


def dataset_inverse(spark: SparkSession, d: str) -> DataFrame:
    """All items through the dataset and back; absent lists come back empty."""
    rows = readers.items_of_dataset(readers.dataset_items(_items(spark, d), working_set=False))
    return rows.select("id", "question", "expected_state", F.size("history").alias("n_turns"), *(F.size(c).alias(f"n_{c}") for c in ("gold_fiches", "gold_spans", "gold_articles", "expected_points", "tags")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Golden items as delivered in the shape of the schema, each once."""
    history = F.transform("turns", lambda t: F.create_map(F.lit("role"), t["role"], F.lit("content"), t["content"]))
    return _golden(spark, d).withColumn("history", history).select("id", "question", "history", "expected_state", "gold_fiches", "gold_spans", "gold_articles", "expected_points", "tags")


def attribution(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.date_format("collected_at", "yyyy-MM-dd").alias("file_date"), F.col("n_chars").alias("document_count"))
    return readers.attribution(rows)


# --- texts -----------------------------------------------------------------------------------------------------------


def enriched_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = _reduced(spark, d, text=digest(ingest.enrich_article(F.coalesce("texte", F.lit("")), F.col("fullSectionsTitre"))))
    return rows.select("cid", F.lower(F.hex("text")).alias("text"))


def enriched_guides(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "fiche_chunks").where("text IS NOT NULL").select("chunk_id", "fiche_id", "chapitre_titre", "cas_label", "text").distinct()
    return rows.select("chunk_id", F.lower(F.hex(digest(ingest.enrich_guide(F.col("text"), F.col("fiche_id"), F.col("chapitre_titre"), F.col("cas_label"))))).alias("text"))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """The functions over texts, on the pieces cut earlier."""
    rows = read(spark, d, "fiche_chunks").where("text IS NOT NULL AND chunk_index IS NOT NULL").select("chunk_id", "chunk_index", "text", "chapitre_titre", "cas_label").distinct()
    two = F.array(F.coalesce("chapitre_titre", F.lit("-")), F.coalesce("cas_label", F.lit("-")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("chunk_index"))
    lines = F.concat(F.lit("- "), F.coalesce("chapitre_titre", F.lit("")), F.lit("\n\n • "), F.coalesce("cas_label", F.lit("")), F.lit(" \n-"))
    turn = answers.messages("s", F.lit(None), F.col("chunk_id"))
    return rows.select(
        "chunk_id", F.lower(F.hex(digest(F.col("text")))).alias("sha"), F.length(text.collapse(F.translate(F.col("text"), "  ", "  "))).cast("long").alias("n_collapsed"),
        text.fill_template("{{a}}/{{b}}", {"a": F.col("chapitre_titre"), "b": F.col("cas_label")}).alias("filled"), text.numbered(two).alias("listed"), F.array_join(text.clean_lines(lines), "|").alias("lines"),
        F.date_format(text.epoch_ms_date(F.col("chunk_index").cast("long") * 86_400_000), "yyyy-MM-dd").alias("epoch_day"), F.date_format(text.http_date(F.date_format(day, "'Mon,' dd MMM yyyy '00:00:00 GMT'")), "yyyy-MM-dd").alias("http_day"),
        F.round(text.sigmoid(F.col("chunk_index") / 10.0), 9).alias("logistic"), F.array_join(F.transform(turn, lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|").alias("messages"),
        F.array_join(annotation.pick(F.array(F.concat(F.lit("* "), F.col("chunk_id")), F.lit("no")), F.array(F.lit("F0"), F.col("chunk_id"))), ",").alias("picked"),
    )


def verbatim_parts(spark: SparkSession, d: str) -> DataFrame:
    """Which of a piece's titles and openings stand verbatim in its text."""
    rows = read(spark, d, "fiche_chunks").where("text IS NOT NULL").select("chunk_id", "text", "chapitre_titre", "cas_label").distinct()
    spans = F.array(F.substring("text", 1, 20), F.coalesce("chapitre_titre", F.lit("")), F.coalesce("cas_label", F.lit("")), F.upper(F.substring("text", 5, 9)))
    return rows.select("chunk_id", F.array_join(text.verbatim(spans, F.array("text")), "|").alias("spans"))


def band_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of all documents; those over the band as runs of words."""
    rows = read(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    cut = F.udf(lambda t: chunking.fit(t), "array<string>", useArrow=True)
    pieces = rows.select("doc_id", F.posexplode(cut("text")).alias("n", "piece"))
    return pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.max(F.regexp_count("piece", F.lit(r"\S+"))).alias("longest"), F.sum(F.regexp_count("piece", F.lit(r"\S+")).cast("long")).alias("n_words"))


def packed_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every guide packed again as units of a text, with the last one rebalanced."""
    rows = read(spark, d, "fiche_chunks").where("text IS NOT NULL AND fiche_id IS NOT NULL AND chunk_index IS NOT NULL").groupBy("fiche_id", "chunk_index").agg(F.max("text").alias("text"))
    words = lambda t: len(re.findall(r"[^ \t\n\r]+", t))
    pack = F.udf(lambda units: [words(t) for t in chunking.pack_units(units, size=words)], "array<int>", useArrow=True)
    units = rows.groupBy("fiche_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]).alias("u"))  # a guide's pieces
    return units.select("fiche_id", F.posexplode(pack("u")).alias("piece_no", "n_words"))


def reference_scan(spark: SparkSession, d: str) -> DataFrame:
    """All distinct references of every held article's text, by the plain pattern."""
    rows = _reduced(spark, d, r=text.all_references(F.col("texte")))
    return rows.select("cid", F.array_join(F.array_sort("r"), ",").alias("references"), F.size("r").alias("n_references"))


# --- gates -----------------------------------------------------------------------------------------------------------


def _sectioned(spark: SparkSession, d: str) -> DataFrame:
    """Documents as guides that name one section each."""
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("fiche_id"), norm_key("section_id").alias("section_id"))


def scope(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose section holds an article of the last snapshot."""
    heads = _sectioned(spark, d).select("fiche_id", F.array_compact(F.array("section_id")).alias("section_ids"))
    return readers.in_scope(heads, _articles(spark, d, "sectionParentId").select(norm_key("sectionParentId").alias("sectionParentId"))).select("fiche_id")


def sections_gate(spark: SparkSession, d: str) -> DataFrame:
    held = _articles(spark, d, "sectionParentId").select(norm_key("sectionParentId").alias("section_id"))
    return gates.sections_gate(_sectioned(spark, d).where("section_id IS NOT NULL"), held)


def _piece_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "fiche_chunks").select("fiche_id", "chunk_id", "text", "tokens", "chapitre_titre", "cas_label").distinct().where("fiche_id IS NOT NULL")
    words = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit("[^ \\t\\n\\r]+"))
    whole = read(spark, d, "fiches").select("fiche_id").unionByName(rows.select("fiche_id")).distinct()
    texts = rows.groupBy("fiche_id").agg(F.max("text").alias("text"))
    return gates.chunk_gate(whole.join(texts, "fiche_id", "left"), rows, "fiche_id", words(F.col("text")) * 4, labels=words(F.col("chapitre_titre")) + words(F.col("cas_label")), stub=F.col("tokens") < 5)


def piece_gate(spark: SparkSession, d: str) -> DataFrame:
    """Checks of the pieces cut earlier against four times the size of a guide's greatest text."""
    return _piece_gate(spark, d)


def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a gate refuses, by check."""
    return gates.summary(_piece_gate(spark, d))


# --- answers ---------------------------------------------------------------------------------------------------------


def _answered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, answers, contexts) made of golden items: the contexts are the known articles among those cited."""
    rows = _answers(spark, d).withColumnRenamed("id", "qid")
    known = _articles(spark, d, "id").select("cid", F.col("id").alias("version"))
    contexts = rows.select("qid", F.posexplode("retrieved").alias("slot", "cid")).join(known, "cid")
    contexts = contexts.select("qid", F.lit("article").alias("register"), "slot", F.col("cid").alias("citation_id"), F.concat(F.lit("D"), F.col("cid")).alias("document"), "version")
    gold = _golden(spark, d).select(F.col("id").alias("qid"), "expected_state", F.transform(F.coalesce("gold_articles", _none()), lambda k: F.concat(F.lit("D"), norm_key(k))).alias("gold_articles"))
    return gold.withColumn("gold_articles", F.array_compact("gold_articles")), rows.select("qid", "envelope"), contexts


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = answers.score_answers(*_answered(spark, d))
    return rows.select("qid", "expected_state", "actual_state", "state_correct", "citation_valid", F.array_join(F.array_sort("fabricated_ids"), ",").alias("fabricated"), F.round("citation_correctness", 9).alias("citation_correctness"))


def answer_links(spark: SparkSession, d: str) -> DataFrame:
    _, said, contexts = _answered(spark, d)
    return answers.citation_links(said, contexts, "https://law.example/%s")


def answer_views(spark: SparkSession, d: str) -> DataFrame:
    """How answers are shown, after a round through JSON."""
    rows = _answers(spark, d).select("id", answers.parse(F.to_json("envelope")).alias("p"))
    return rows.select("id", answers.view_state(F.col("p.envelope")).alias("view"), answers.render_answer(F.col("p.envelope")).alias("rendered"), F.coalesce("p.error", F.lit("")).alias("error"))


def key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every snapshot's version of the articles that golden items are about, by their number."""
    gold = _golden(spark, d).select(F.col("id").alias("qid"), F.explode("gold_articles").alias("k")).select("qid", norm_key("k").alias("cid"))
    keys = gold.join(_articles(spark, d, "citation_id"), "cid").select("qid", text.lookup_key(F.col("citation_id")).alias("lookup_key")).distinct()
    rows = held(read(spark, d, "articles"), {"citation_id": F.col("citation_id")})
    points = rows.select(F.concat_ws("#", "cid", "snapshot_no").alias("id"), text.lookup_key(F.col("citation_id")).alias("lookup_key"), F.col("snapshot_no").alias("chunk_index"))
    return search.by_key(points, keys).select("qid", F.col("rank").cast("int").alias("rank"), "id", "score", "register")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of judged twins made of events: scores by value, labels by type."""
    rows = read(spark, d, "events").where("value IS NOT NULL AND event_type IS NOT NULL")
    clean, faulted = F.round(F.pmod(F.col("value"), F.lit(10.0)) / 10, 3), F.round(F.pmod(F.col("value") * 7, F.lit(10.0)) / 10, 3)
    kind = F.when(F.col("user_id") % 2 == 0, evaluate.FAITHFULNESS).otherwise(evaluate.COVERAGE)
    return rows.select(kind.alias("metric"), clean.alias("clean_score"), F.when(F.col("event_type") == "click", "fail").otherwise("pass").alias("clean_label"), faulted.alias("faulted_score"), F.when(F.col("event_type") == "error", "pass").otherwise("fail").alias("faulted_label"))


def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration(_pairs(spark, d), 0.5)


def calibration_errors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.errors_by_metric(_pairs(spark, d), evaluate.JUDGED, 0.5)


def point_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the expected points if those that hold a digit or are short are asserted, verdicts in reverse order."""
    rows = _golden(spark, d).select("id", F.coalesce("expected_points", _none()).alias("points"))
    verdicts = F.reverse(F.transform("points", lambda p, i: F.struct((i + 1).alias("index"), (p.rlike("[0-9]") | (F.length(p) < 60)).alias("asserted"))))
    return rows.select("id", F.round(metrics.point_coverage(verdicts, F.col("points")), 9).alias("coverage"))


def calibration_checks(spark: SparkSession, d: str) -> DataFrame:
    """Checks of calibration pairs made of golden items, most of them faulty in one way or another."""
    golden = _golden(spark, d).select("id", "question", "expected_points")
    rows = _answers(spark, d).join(golden, "id")
    k = F.conv(F.substring(F.sha2("id", 256), 1, 2), 16, 10).cast("int") % 4
    kind = F.when(k == 0, "fabricated_citation").when(k == 1, "refusal_without_explanation").when(k == 2, "dropped_expected_point").otherwise("other")
    e = F.col("envelope")
    more = F.struct(e["type"].alias("type"), F.lit("").alias("explanation"), F.when(k < 2, F.array_append(e["fondement_juridique"], F.struct(F.lit("X0").alias("article_id"), F.lit("").alias("gloss")))).otherwise(e["fondement_juridique"]).alias("fondement_juridique"), e["aucun_fondement"].alias("aucun_fondement"), e["motif"].alias("motif"))
    faulted = F.when(k == 3, e.cast(answers.ENVELOPE)).otherwise(more.cast(answers.ENVELOPE))
    pairs = rows.select(
        F.col("id").alias("golden_id"), kind.alias("archetype"), F.when(k == 2, F.upper("question")).otherwise(F.col("question")).alias("question"), F.coalesce("expected_points", _none()).alias("expected_points"), "retrieved",
        F.struct(e.cast(answers.ENVELOPE).alias("envelope")).alias("clean"), F.struct(faulted.alias("envelope")).alias("faulted"),
    )
    known = golden.where(F.col("question").isNotNull() & (F.length("question") < 60)).withColumn("expected_points", F.coalesce("expected_points", _none()))
    return gates.calibration_gate(pairs, known).select("check", "key")


# --- evaluation, with models that are rules ----------------------------------------------------------------------------


def _rule_judge():  # type: ignore[no-untyped-def]
    """A judge that goes by the length of what it's asked; some of what it says can't be read."""

    def run(prompts):  # type: ignore[no-untyped-def]
        out = []
        for p in prompts:
            n = len(p)
            if n % 7 == 0:
                out.append("no JSON")
            elif p.startswith("Which share"):
                out.append(json.dumps({"score": n % 101 / 100}))
            else:
                points = p.split("Points:\n", 1)[1].split("\n\nAnswer:", 1)[0].split("\n\n")
                out.append(json.dumps({"verdicts": [{"index": i, "asserted": (n + i) % 2 == 0} for i in range(len(points), 0, -1)]}))
        return out

    return run


def _rule_picks():  # type: ignore[no-untyped-def]
    """Picks the articles whose id is even."""
    return lambda prompts: ["\n".join(f"- {x}" for x in re.findall(r"(?m)^(\S+) : ", p) if x[-1] in "02468") for p in prompts]


def _rule_reasons():  # type: ignore[no-untyped-def]
    return lambda prompts: ["\n".join(f"{x}: reason {len(x)}\n{x}: later\nX{x}: other" for x in re.findall(r"(?m)^(\S+) : ", p)) for p in prompts]


def _rule_question():  # type: ignore[no-untyped-def]
    """The guide's text as a question; one that ends in a nought fails."""

    def run(prompts):  # type: ignore[no-untyped-def]
        guide = prompts[0].split("\n\n", 1)[1]
        if guide.endswith("0"):
            raise ValueError("nought")
        return [f" - {guide} ?\n- more"]

    return run


def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Both judged metrics of the answers made of golden items, and what couldn't be read."""
    items = _golden(spark, d).select("id", "question", F.coalesce("expected_points", _none()).alias("expected_points"))
    rows = _answers(spark, d).join(items, "id").select("id", "question", "expected_points", F.array_join("retrieved", " ").alias("context"), F.col("envelope").cast(answers.ENVELOPE).alias("envelope"))
    out = evaluate.judged(rows.withColumn("context", F.lit("context")), _rule_judge)
    return out.select("id", F.round("faithfulness", 9).alias("faithfulness"), F.round("point_coverage", 9).alias("point_coverage"), F.coalesce("judge_error", F.lit("")).alias("judge_error"))


def second_reading(spark: SparkSession, d: str) -> DataFrame:
    """Golden articles against those a second reader picks from the sections' articles."""
    texts = _articles(spark, d, "sectionParentId", "texte").select("cid", norm_key("sectionParentId").alias("section_id"), "texte")
    items = _read_items(spark, d).withColumn("question", F.lit("q"))
    rows = evaluate.disagreement_pass(items, _guides(spark, d), texts, _rule_picks)
    return rows.select("id", *(F.array_join(c, ",").alias(c) for c in ("only_gold", "only_picks", "explained", "needs_review")))


def rejections(spark: SparkSession, d: str) -> DataFrame:
    """Why the shortlisted articles are rejected."""
    texts = _articles(spark, d, "texte")
    return evaluate.rejection_reasons(_read_items(spark, d).withColumn("question", F.lit("q")), _shortlist(spark, d), texts, _rule_reasons)


def drafts(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of items for all parent sections, which no golden item uses as guides."""
    texts = _guides(spark, d).select("fiche_id", F.col("fiche_id").alias("text"))
    articles = _articles(spark, d, "sectionParentId", "texte").select("cid", norm_key("sectionParentId").alias("section_id"), "texte")
    rows = evaluate.draft_items(texts, _guides(spark, d), articles, _items(spark, d), _rule_question, _rule_picks, 2**31 - 1, 1)
    return rows.select("id", "fiche_id", "question", "expected_state", F.array_join("gold_articles", ",").alias("gold_articles"), "error")


def draft_twins(spark: SparkSession, d: str) -> DataFrame:
    """Calibration pairs to be worked on, of all golden items."""
    done = _answers(spark, d).select(F.col("id").alias("qid"), "envelope", "retrieved", F.lit("c").alias("context"))
    rows = evaluate.draft_pairs(_items(spark, d), done, "other")
    return rows.select("golden_id", "archetype", F.array_join("retrieved", ",").alias("retrieved"), F.col("clean.envelope").eqNullSafe(F.col("faulted.envelope")).alias("alike"), F.size("clean.envelope.fondement_juridique").alias("n_cited"))


def floor_gate(spark: SparkSession, d: str) -> DataFrame:
    """Items with an article as the set for the floor, the others as held out: one kind is missing, some guides overlap."""
    items = _items(spark, d)
    return evaluate.floor_gate(items.where("expected_state = 'reponse'"), items.where("expected_state <> 'reponse'"))


def run_files(spark: SparkSession, d: str) -> DataFrame:
    """Two runs written, read and compared from their files by the registered metric, and the report read again."""
    folder = session.scratch(spark, "runs")
    rows = _items(spark, d).select(F.col("id").alias("item_id"), F.size(F.coalesce("expected_points", _none())).alias("n"), F.length("question").alias("q"))
    names = [f.split() for f in schemas.ITEM_SCORES.split(", ")]
    paths = []
    for run, value in (("a", F.col("q") % 5 / 4), ("b", F.col("q") % 7 / 6)):
        scores = rows.select(*(F.col("item_id") if n == "item_id" else F.when(F.col("n") > 0, value if n == "fiche_recall_at_4" else None).cast(k).alias(n) for n, k in names))
        paths.append(readers.write_run({"run_id": run, "arm": "rung1"}, scores, folder))
    evaluate.compare_files(spark, *paths, "rung4", f"{folder}/report.json")
    report = spark.read.schema("change string, comparison array<struct<metric:string,n_paired:long,improved:long,regressed:long,net:long>>, verdict array<struct<net:long,adopt:boolean>>").option("multiLine", "true").json(f"{folder}/report.json")
    return report.select("change", F.explode("comparison").alias("c"), F.col("verdict")[0].alias("v")).where("c.n_paired > 0").select("change", "c.*", "v.adopt")


def annotated_files(spark: SparkSession, d: str) -> DataFrame:
    """The golden set saved in two parts, the second of which replaces items of the first, and read again."""
    path = f"{session.scratch(spark, 'set')}/set.json"
    items = _items(spark, d)
    none = lambda df: gates.repeated(df, "ids unique", "id")
    evaluate.save_items(items.withColumn("question", F.lit("old")), path, none)
    evaluate.save_items(items.where("question NOT LIKE '%e%e%'"), path, none)
    back = readers.annotated_set(spark, path)
    return back.select("id", "question", "expected_state", F.coalesce(F.array_join("gold_articles", ","), F.lit("null")).alias("gold_articles"), F.coalesce(F.size("history"), F.lit(-1)).alias("n_turns"))


# --- annotation ------------------------------------------------------------------------------------------------------


def _guides(spark: SparkSession, d: str) -> DataFrame:
    """Parent sections as guides that name their child sections, in order of id."""
    rows = read(spark, d, "sections").select(norm_key("section_id").alias("s"), norm_key("parent_id").alias("p")).where("s IS NOT NULL AND p IS NOT NULL").distinct()
    return rows.groupBy(F.col("p").alias("fiche_id")).agg(F.array_sort(F.collect_set("s")).alias("section_ids"))  # sections are a fixed table


def _by_section(spark: SparkSession, d: str) -> DataFrame:
    return _articles(spark, d, "sectionParentId").select("cid", norm_key("sectionParentId").alias("section_id"))


def reading(spark: SparkSession, d: str) -> DataFrame:
    """The reading list of every parent section: its sections in order, their titles and articles."""
    titles = read(spark, d, "sections").select(norm_key("section_id").alias("section_id"), "titre")
    return annotation.reading_list(_guides(spark, d), titles.where("titre NOT LIKE '%1%'"), _by_section(spark, d)).withColumn("place", F.col("place").cast("int"))


def section_articles(spark: SparkSession, d: str) -> DataFrame:
    rows = annotation.articles_by_section(_by_section(spark, d))
    return rows.groupBy("section_id").agg(F.count("cid").alias("n_articles"), F.min("cid").alias("first"), F.max("cid").alias("last"))


def _read_items(spark: SparkSession, d: str) -> DataFrame:
    """Golden items whose guide is the parent of the least section of their gold articles."""
    gold = _golden(spark, d).select("id", F.explode("gold_articles").alias("c")).select("id", norm_key("c").alias("cid")).where("cid IS NOT NULL").distinct()
    own = gold.join(_by_section(spark, d), "cid").join(read(spark, d, "sections").select(norm_key("section_id").alias("section_id"), norm_key("parent_id").alias("p")).distinct(), "section_id")
    guide = own.where("p IS NOT NULL").groupBy("id").agg(F.min("p").alias("p"))
    listed = gold.groupBy("id").agg(F.array_sort(F.collect_set("cid")).alias("gold_articles"))  # an item's list
    return listed.join(guide, "id").select("id", F.array("p").alias("gold_fiches"), "gold_articles")


def _shortlist(spark: SparkSession, d: str) -> DataFrame:
    return annotation.section_shortlist(_read_items(spark, d), _guides(spark, d), _by_section(spark, d))


def sections_shortlist(spark: SparkSession, d: str) -> DataFrame:
    return _shortlist(spark, d)


def outside_guides(spark: SparkSession, d: str) -> DataFrame:
    """Gold articles that no section of the item's guide holds."""
    return annotation.outside_sections(_read_items(spark, d), _shortlist(spark, d))


def shortlists(spark: SparkSession, d: str) -> DataFrame:
    """Both shortlists of every item, with where an article comes from."""
    rows = annotation.shortlist_union(_shortlist(spark, d), _term_shortlist(spark, d).select("id", "cid"))
    return rows.select("id", "cid", F.array_join("provenance", "+").alias("provenance"))


def disagreements(spark: SparkSession, d: str) -> DataFrame:
    """Gold articles against the best by terms, as a second reader would pick them."""
    items = session.cut(_read_items(spark, d))
    gold = items.select("id", F.explode("gold_articles").alias("cid"))
    picks = _term_shortlist(spark, d).where("rank <= 2").select("id", "cid")
    rows = annotation.disagreements(gold, picks, annotation.in_sections(gold, items, _guides(spark, d), _by_section(spark, d)))
    return rows.select("id", *(F.array_join(c, ",").alias(c) for c in ("only_gold", "only_picks", "explained", "needs_review")))


def held_out_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Guides that items with an article share with the others."""
    items = _golden(spark, d)
    return annotation.overlap(items.where("expected_state = 'reponse'"), items.where("expected_state <> 'reponse'"))


def unused_guides(spark: SparkSession, d: str) -> DataFrame:
    """All guides that no golden item uses, as a draw that is larger than their number."""
    guides = read(spark, d, "fiches").select("fiche_id")
    return annotation.unused_guides(guides, _golden(spark, d), 2**31 - 1, 1)


def derived_tags(spark: SparkSession, d: str) -> DataFrame:
    """Items with the tag that follows from their history, and the id that would be given next."""
    rows = annotation.derived_tags(_items(spark, d))
    return rows.select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"), F.lit(annotation.next_id(rows)).alias("next_id"))


def score_cells(spark: SparkSession, d: str) -> DataFrame:
    """The scores of the first arm, one row per item and metric that is defined."""
    return metrics.long_scores(item_metrics(spark, d)).where("value IS NOT NULL")


def usage_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type."""
    rows = pipelines.windowed_counts(read(spark, d, "events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        jsonl_articles, index_upsert, index_release, dataset_projection, dataset_inverse, attribution, enriched_articles, enriched_guides, text_forms, verbatim_parts, band_pieces, packed_pieces, reference_scan, scope, sections_gate,
        piece_gate, gate_counts, answer_scores, answer_links, answer_views, key_lookup, calibration_summary, calibration_errors, point_coverage, calibration_checks, judged_answers, second_reading, rejections, drafts, draft_twins, floor_gate, run_files, annotated_files, reading, section_articles, sections_shortlist,
        outside_guides, shortlists, disagreements, held_out_overlap, unused_guides, derived_tags, score_cells, usage_windows,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------


def _n(c: str) -> str:
    return f"nullif(upper(trim({c}, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _held6(*columns: str) -> str:
    return f"""last AS (SELECT * FROM (SELECT {_n('cid')} AS cid, etat, {', '.join(columns)}, row_number() OVER (PARTITION BY {_n('cid')} ORDER BY delivered_at DESC) AS rn
  FROM articles WHERE snapshot_no = 6) WHERE rn = 1 AND etat = 'VIGUEUR' AND cid IS NOT NULL)"""


_WORD = r"\p{L}\p{M}\p{N}\p{Pc}\x{200C}\x{200D}"


def _references(c: str, strict: bool = False) -> str:
    """The scan with Unicode's letters, digits and blanks: what stands before and after a number is read with it. In the
    plain scan a number that runs on in letters loses its last segment, or is none; in the strict one it's none."""
    blank = r"[\s\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]?"
    found = rf"coalesce(regexp_extract_all({c}, '[{_WORD}]?[LRAD]\*?{blank}\.?{blank}\p{{Nd}}+(?:-\p{{Nd}}+)*[{_WORD}{'-' if strict else ''}]?'), [])"
    short = "NULL" if strict else "CASE WHEN contains(x, '-') THEN regexp_replace(x, '-[^-]*$', '') END"
    cut = rf"CASE WHEN regexp_matches(x, '^[{_WORD}][LRAD]') THEN NULL WHEN regexp_matches(x, '\p{{Nd}}$') THEN x ELSE {short} END"
    return f"list_transform(list_transform({found}, lambda x: {cut}), lambda x: translate(upper(x), ' .*', ''))"


#: White space as Python and the JVM's Unicode classes have it.
_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SIZE = f"len(regexp_extract_all({{0}}, '[^{_SPACE}]+'))"


def _unescaped(c: str) -> str:
    """Latin-1's named references and the numbers up to 255, read from the inside out; the ampersand comes last."""
    named = {f"&{n};": chr(p) for n, p in sorted(name2codepoint.items()) if p < 256 and n != "amp"} | {"&#39;": "'", "&#160;": chr(160)}
    for name, sign in (named | {"&amp;": "&"}).items():
        c = f"replace({c}, '{name}', chr({ord(sign)}))"
    return c


#: Blocks of the fragments in `last`: tables go, some start tags part blocks, any other tag is a blank.
_BLOCKS = rf"""raw AS (SELECT cid AS key, string_split(regexp_replace(regexp_replace(regexp_replace(texteHtml, '(?s)<table[^<>]*>.*?(</table>|$)', ' ', 'g'), '<(p|br|li|tr)(\s[^<>]*)?/?>', chr(1), 'g'), '</?[a-zA-Z][^<>]*>', ' ', 'g'), chr(1)) AS parts FROM last WHERE texteHtml IS NOT NULL),
parts AS (SELECT key, unnest(parts) AS part, generate_subscripts(parts, 1) AS j FROM raw),
b AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY j) - 1 AS block_no, block FROM (SELECT key, j, trim(regexp_replace({_unescaped('part')}, '[{_SPACE}]+', ' ', 'g')) AS block FROM parts) WHERE block <> '')"""
#: Units u (f, i, n words) packed within the band, and the last text of each f rebalanced: d (f, i, p, n).
_PACKED = """g AS (SELECT f, i, 1 AS p, n AS held, n FROM u WHERE i = 1 UNION ALL SELECT u.f, u.i, CASE WHEN g.held + u.n + 2 > 512 THEN g.p + 1 ELSE g.p END, CASE WHEN g.held + u.n + 2 > 512 THEN u.n ELSE g.held + u.n END, u.n FROM g JOIN u ON u.f = g.f AND u.i = g.i + 1),
m AS (SELECT f, max(p) AS last FROM g GROUP BY 1),
s AS (SELECT g.f, last, sum(n) FILTER (p = last) AS tail, sum(n) FILTER (p >= last - 1) AS pair, min(i) FILTER (p = last - 1) AS a, min(i) FILTER (p = last) AS b FROM g JOIN m USING (f) GROUP BY 1, 2),
sums AS (SELECT g.f, g.i, sum(g.n) OVER (PARTITION BY g.f ORDER BY g.i DESC) AS suffix FROM g),
c AS (SELECT s.f, s.last, CASE WHEN last = 1 OR tail + 2 >= 32 THEN b WHEN pair + 2 <= 512 THEN NULL ELSE least(b, greatest(a + 1, coalesce(max(w.i) FILTER (w.suffix + 2 >= 32), a + 1))) END AS cut, last > 1 AND tail + 2 < 32 AND pair + 2 <= 512 AS joined
  FROM s JOIN sums w ON w.f = s.f AND w.i <= s.b GROUP BY s.f, s.last, s.tail, s.pair, s.a, s.b),
d AS (SELECT g.f, g.i, CASE WHEN g.p < c.last - 1 THEN g.p WHEN c.joined THEN c.last - 1 WHEN g.i >= c.cut THEN c.last ELSE c.last - 1 END AS p, g.n FROM g JOIN c USING (f))"""
_POINT = f"""pts AS (SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS id, text, tokens
  FROM (SELECT sha1(unhex('{ids.NAMESPACE.hex}') || encode(fiche_id || '#' || chunk_index)) AS h, text, tokens FROM (SELECT fiche_id, chunk_index, max(text) AS text, max(tokens) AS tokens FROM fiche_chunks
    WHERE fiche_id IS NOT NULL AND chunk_index IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2)))"""
_WORDS = r"len(regexp_extract_all(coalesce({0}, ''), '[^ \t\n\r]+'))"
_PIECES = f"""c AS (SELECT DISTINCT fiche_id, chunk_id, text, tokens, chapitre_titre, cas_label FROM fiche_chunks WHERE fiche_id IS NOT NULL),
whole AS (SELECT fiche_id FROM fiches WHERE fiche_id IS NOT NULL UNION SELECT fiche_id FROM c),
s AS (SELECT fiche_id, sum(tokens) AS total, count(*) AS n, coalesce(bool_or(tokens < 5), false) AS stubbed, sum({_WORDS.replace('{0}', 'chapitre_titre')} + {_WORDS.replace('{0}', 'cas_label')}) AS labels, 4 * {_WORDS.replace('{0}', 'max(text)')} AS source FROM c GROUP BY 1),
v AS (SELECT 'at least one chunk' AS "check", fiche_id AS "key", NULL::VARCHAR AS detail FROM whole WHERE fiche_id NOT IN (SELECT fiche_id FROM c)
  UNION ALL SELECT DISTINCT 'no chunk over the band', fiche_id, NULL FROM c WHERE tokens > 512
  UNION ALL SELECT DISTINCT 'chunks meet the floor', fiche_id, NULL FROM c WHERE tokens < 32 AND NOT tokens < 5
  UNION ALL SELECT 'no content lost', fiche_id, concat_ws('/', total, source) FROM s WHERE NOT (total BETWEEN source - (labels + 100) AND source + (n - 1) * 2 + CASE WHEN stubbed THEN 200 ELSE 0 END))"""
_PAIRS = """p AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'faithfulness' ELSE 'point_coverage' END AS metric, round((value % 10.0) / 10, 3) AS cs, CASE WHEN event_type = 'click' THEN 'fail' ELSE 'pass' END AS cl,
  round(((value * 7) % 10.0) / 10, 3) AS fs, CASE WHEN event_type = 'error' THEN 'pass' ELSE 'fail' END AS fl FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL)"""
_ANSWERED = f"""c AS (SELECT id, expected_state AS s, list_filter(u, lambda k, i: k IS NOT NULL AND list_position(u, k) = i) AS cited FROM (SELECT id, expected_state, list_transform(coalesce(gold_articles, []), lambda k: {_n('k')}) AS u FROM golden)),
r AS (SELECT id, s, cited, list_filter(cited, lambda k: NOT list_contains(l, k)) AS wrong, list_filter(cited, lambda k: list_contains(l, k)) AS good FROM c, (SELECT list(cid) AS l FROM last))"""
_GUIDES = f"""kids AS (SELECT DISTINCT {_n('section_id')} AS s, {_n('parent_id')} AS p FROM sections WHERE {_n('section_id')} IS NOT NULL AND {_n('parent_id')} IS NOT NULL),
art AS (SELECT cid, {_n('sectionParentId')} AS s FROM last),
gold AS (SELECT DISTINCT id, {_n('k')} AS cid FROM (SELECT id, unnest(gold_articles) AS k FROM golden) WHERE {_n('k')} IS NOT NULL),
guide AS (SELECT gold.id, min(kids.p) AS p FROM gold JOIN art USING (cid) JOIN kids ON kids.s = art.s GROUP BY 1),
short AS (SELECT DISTINCT guide.id, art.cid FROM guide JOIN kids USING (p) JOIN art ON art.s = kids.s),
mine AS (SELECT gold.* FROM gold JOIN guide USING (id))"""
_LEXICAL = _TEXTS["lexical_shortlist"]
_SECTIONED = f"WITH {_held6('sectionParentId')}, {_ITEMS}, {_GUIDES}"
_BY_TERMS = f"lex AS ({_LEXICAL})"

SQL = {
    "jsonl_articles": "SELECT cid, etat, strftime(try_cast(dateDebut AS DATE), '%Y-%m-%d') AS dateDebut, citation_id, length(texteHtml) AS n_chars, true AS no_end FROM articles WHERE snapshot_no = 6 AND etat = 'VIGUEUR' AND texteHtml IS NOT NULL",
    "index_upsert": f"WITH {_POINT} SELECT id, substr(sha256(CASE WHEN tokens IS NOT NULL THEN 'again ' || text ELSE text END), 1, 32) AS payload FROM pts",
    "index_release": f"WITH {_POINT} SELECT r AS register, (SELECT count(*) FROM pts) AS n_rows, 'restored' AS outcome, 'live' AS second, 'index-2' AS tag, true AS healthy FROM (VALUES ('fiches'), ('pieces')) t(r)",
    "dataset_projection": f"""WITH {_ITEMS} SELECT 'eval-' || id AS id, question AS input, expected_state, array_to_string(gold_fiches, ',') AS fiches, coalesce(len(expected_points), -1)::INT AS n_points, array_to_string(tags, ',') AS tags
FROM golden WHERE coalesce(len(history), 0) = 0 AND (coalesce(len(gold_fiches), 0) > 0 OR coalesce(len(gold_articles), 0) > 0)""",
    "dataset_inverse": f"WITH {_ITEMS} SELECT id, question, expected_state, coalesce(len(history), 0)::INT AS n_turns, " + ", ".join(f"coalesce(len({c}), 0)::INT AS n_{c}" for c in ("gold_fiches", "gold_spans", "gold_articles", "expected_points", "tags")) + " FROM golden",
    "attribution": "SELECT strftime(min(collected_at), '%Y-%m-%d') AS snapshot_date, sum(n_chars)::BIGINT AS n_documents FROM documents",
    "enriched_articles": f"WITH {_held6('texte', 'fullSectionsTitre')} SELECT cid, substr(sha256(concat_ws(chr(10), nullif(fullSectionsTitre, ''), nullif(texte, ''))), 1, 32) AS text FROM last",
    "enriched_guides": "SELECT chunk_id, substr(sha256(concat_ws(chr(10), nullif(fiche_id, ''), nullif(chapitre_titre, ''), nullif(cas_label, ''), nullif(text, ''))), 1, 32) AS text FROM (SELECT DISTINCT chunk_id, fiche_id, chapitre_titre, cas_label, text FROM fiche_chunks WHERE text IS NOT NULL)",
    "text_forms": r"""SELECT chunk_id, substr(sha256(text), 1, 32) AS sha, length(trim(regexp_replace(text, '[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}\x{0B}]+', ' ', 'g'))) AS n_collapsed,
  coalesce(chapitre_titre, '') || '/' || coalesce(cas_label, '') AS filled, '1. ' || coalesce(chapitre_titre, '-') || chr(10) || chr(10) || '2. ' || coalesce(cas_label, '-') AS listed,
  array_to_string(list_filter(list_transform([coalesce(chapitre_titre, ''), coalesce(cas_label, '')], lambda x: trim(x, ' -•' || chr(9))), lambda x: x <> ''), '|') AS lines,
  strftime(DATE '1970-01-01' + chunk_index, '%Y-%m-%d') AS epoch_day, strftime(DATE '2024-01-01' + chunk_index, '%Y-%m-%d') AS http_day, round(1 / (1 + exp(-(chunk_index / 10.0::DOUBLE))), 9) AS logistic,
  'system:s|user:' || chunk_id AS messages, chunk_id AS picked
FROM (SELECT DISTINCT chunk_id, chunk_index, text, chapitre_titre, cas_label FROM fiche_chunks WHERE text IS NOT NULL AND chunk_index IS NOT NULL)""",
    "verbatim_parts": """SELECT chunk_id, array_to_string(list_filter(s, lambda x, i: x <> '' AND contains(text, x) AND list_position(s, x) = i), '|') AS spans
FROM (SELECT chunk_id, text, [substr(text, 1, 20), coalesce(chapitre_titre, ''), coalesce(cas_label, ''), upper(substr(text, 5, 9))] AS s FROM (SELECT DISTINCT chunk_id, text, chapitre_titre, cas_label FROM fiche_chunks WHERE text IS NOT NULL))""",
    "band_pieces": r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.?!])\s+([A-ZÀ-Ü0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, len(regexp_extract_all(s, '\S+')) AS n FROM s WHERE trim(s, chr(32) || chr(9) || chr(10) || chr(13)) <> '')
SELECT doc_id, sum(CASE WHEN n <= 510 THEN 1 ELSE ceil(n / 510.0) END)::BIGINT AS n_pieces, max(least(n, 510))::INT AS longest, sum(n)::BIGINT AS n_words FROM w GROUP BY 1""",
    "packed_pieces": rf"""WITH RECURSIVE u AS (SELECT fiche_id AS f, row_number() OVER (PARTITION BY fiche_id ORDER BY chunk_index) AS i, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n
  FROM (SELECT fiche_id, chunk_index, max(text) AS text FROM fiche_chunks WHERE text IS NOT NULL AND fiche_id IS NOT NULL AND chunk_index IS NOT NULL GROUP BY 1, 2)), {_PACKED}
SELECT f AS fiche_id, (p - 1)::INT AS piece_no, sum(n)::INT AS n_words FROM d GROUP BY 1, 2""",
    "html_blocks": f"WITH {_held6('texteHtml')}, {_BLOCKS} SELECT key, block_no::INT AS block_no, block FROM b",
    "article_chunks": rf"""WITH RECURSIVE {_held6('id', 'citation_id', 'sectionParentTitre', 'texteHtml')}, {_BLOCKS},
t AS (SELECT cid, id, citation_id, sectionParentTitre AS title, texteHtml, coalesce((SELECT string_agg(block, ' ' ORDER BY block_no) FROM b WHERE b.key = last.cid), '') AS text FROM last),
z AS (SELECT *, {_SIZE.replace('{0}', 'text')} + 2 AS n FROM t),
stubs AS (SELECT cid, concat_ws(' ', nullif(text, ''), coalesce(citation_id, '') || ' — ' || rtrim(coalesce(nullif(title, ''), citation_id, ''), '.') || '.' || CASE WHEN contains(coalesce(texteHtml, ''), '<table') THEN ' table non indexée.' ELSE '' END
  || ' Texte intégral : https://legi.example/codes/article_lc/' || coalesce(id, 'None')) AS text FROM z WHERE n < 32),
q AS (SELECT key, block_no, block, {_SIZE.replace('{0}', 'block')} + 2 AS n FROM b WHERE key IN (SELECT cid FROM z WHERE n > 512)),
sent AS (SELECT key, block_no, s, generate_subscripts(s, 1) AS j FROM (SELECT key, block_no, CASE WHEN n <= 512 THEN [block] ELSE string_split(regexp_replace(block, '([.?!]) ([A-ZÀ-Ü0-9])', '\1' || chr(2) || '\2', 'g'), chr(2)) END AS s FROM q)),
w AS (SELECT key, block_no, j, string_split(s[j], ' ') AS w FROM sent),
cut AS (SELECT key, block_no, j, k, array_to_string(w[510 * k + 1 : 510 * k + 510], ' ') AS unit FROM (SELECT *, unnest(range(0, (len(w) + 509) // 510)) AS k FROM (SELECT key, block_no, j, w FROM w))),
u AS (SELECT key AS f, row_number() OVER (PARTITION BY key ORDER BY block_no, j, k) AS i, unit, {_SIZE.replace('{0}', 'unit')} AS n FROM cut), {_PACKED},
long AS (SELECT d.f, d.p, string_agg(u.unit, ' ' ORDER BY d.i) AS text FROM d JOIN u USING (f, i) GROUP BY 1, 2)
SELECT cid, 0::INT AS chunk_index, text, ({_SIZE.replace('{0}', 'text')} + 2)::INT AS tokens, true AS is_stub FROM stubs UNION ALL SELECT cid, 0, text, n::INT, false FROM z WHERE n BETWEEN 32 AND 512
UNION ALL SELECT f, (p - 1)::INT, text, ({_SIZE.replace('{0}', 'text')} + 2)::INT, false FROM long""",
    "reference_scan": f"""WITH {_held6('texte')}, r AS (SELECT cid, list_distinct(list_filter({_references('texte')}, lambda x: x IS NOT NULL)) AS r FROM last)
SELECT cid, array_to_string(list_sort(r), ',') AS "references", len(r)::INT AS n_references FROM r""",
    "reference_sets": f"""WITH {_held6('texte')}, r AS (SELECT cid, unnest(list_distinct(list_filter({_references('texte', True)}, lambda x: x IS NOT NULL))) AS r FROM last)
SELECT r AS reference, count(*) AS n_articles FROM r GROUP BY 1""",
    "scope": f"WITH {_held6('sectionParentId')} SELECT doc_id::VARCHAR AS fiche_id FROM documents WHERE {_n('section_id')} IN (SELECT {_n('sectionParentId')} FROM last WHERE {_n('sectionParentId')} IS NOT NULL)",
    "sections_gate": f"""WITH {_held6('sectionParentId')}, g AS (SELECT DISTINCT doc_id::VARCHAR AS k, {_n('section_id')} AS s FROM documents WHERE {_n('section_id')} IS NOT NULL)
SELECT 'sections resolve' AS "check", k AS "key", NULL::VARCHAR AS detail FROM g GROUP BY k HAVING NOT bool_or(s IN (SELECT {_n('sectionParentId')} FROM last WHERE {_n('sectionParentId')} IS NOT NULL))""",
    "piece_gate": f"WITH {_PIECES} SELECT * FROM v",
    "gate_counts": f'WITH {_PIECES} SELECT "check", count(*) AS n FROM v GROUP BY 1',
    "answer_scores": f"""WITH {_LAST}, {_ITEMS}, {_ANSWERED} SELECT id AS qid, s AS expected_state, CASE WHEN s LIKE 'refus:%' OR s = 'reponse_sans_article' THEN s ELSE 'reponse' END AS actual_state,
  CASE WHEN s LIKE 'refus:%' OR s = 'reponse_sans_article' THEN s ELSE 'reponse' END = s AS state_correct, len(wrong) = 0 AS citation_valid, array_to_string(list_sort(wrong), ',') AS fabricated,
  CASE WHEN len(cited) > 0 THEN round(len(good)::DOUBLE / len(cited), 9) END AS citation_correctness FROM r""",
    "answer_links": f"""WITH {_held6('id')}, {_ITEMS}, {_ANSWERED.replace('(SELECT list(cid) AS l FROM last)', '(SELECT list(cid) AS l FROM last)')}
SELECT r.id AS qid, k AS citation_id, 'https://law.example/' || last.id AS link FROM (SELECT id, unnest(good) AS k FROM r) r JOIN last ON last.cid = k""",
    "answer_views": f"""WITH {_LAST}, {_ITEMS}, {_ANSWERED} SELECT id, CASE WHEN s = 'refus:hors_corpus' THEN 'hors_corpus' WHEN s LIKE 'refus:%' THEN 'refus_regule' WHEN s = 'reponse_sans_article' THEN s ELSE 'reponse' END AS view,
  concat_ws(chr(10), '…', CASE WHEN len(cited) > 0 THEN chr(10) || 'Fondement juridique :' || chr(10) || array_to_string(list_transform(cited, lambda k: '- ' || k || ' : '), chr(10)) END,
    CASE WHEN s LIKE 'refus:%' THEN chr(10) || 'Refus (motif : ' || substr(s, 7) || ')' WHEN s = 'reponse_sans_article' THEN chr(10) || 'Aucun fondement : …' END) AS rendered, '' AS error FROM r""",
    "key_lookup": f"""WITH {_LAST}, {_ITEMS}, keys AS (SELECT DISTINCT g.id AS qid, {_KEY.replace('{0}', 'citation_id')} AS k FROM (SELECT id, {_n('k')} AS cid FROM (SELECT id, unnest(gold_articles) AS k FROM golden)) g JOIN last USING (cid)),
h AS (SELECT * FROM (SELECT {_n('cid')} AS cid, snapshot_no, etat, citation_id, row_number() OVER (PARTITION BY snapshot_no, {_n('cid')} ORDER BY delivered_at DESC) AS rn FROM articles) WHERE rn = 1 AND etat = 'VIGUEUR' AND cid IS NOT NULL),
p AS (SELECT cid || '#' || snapshot_no AS pid, snapshot_no, {_KEY.replace('{0}', 'citation_id')} AS k FROM h)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY snapshot_no, pid)::INT AS rank, pid AS id, 1.0::DOUBLE AS score, 'article' AS register FROM keys JOIN p USING (k)""",
    "calibration_summary": f"""WITH {_PAIRS}, a AS (SELECT count(*) AS n_pairs, count(*) FILTER (fs < cs) AS n_detected, coalesce(sum((cs >= 0.5 AND cl = 'fail')::INT + (fs >= 0.5 AND fl = 'fail')::INT), 0)::BIGINT AS false_passes,
  coalesce(sum((cs < 0.5 AND cl = 'pass')::INT + (fs < 0.5 AND fl = 'pass')::INT), 0)::BIGINT AS false_fails FROM p)
SELECT *, ceil(n_pairs * 10 / 12.0)::BIGINT AS n_required, n_detected >= ceil(n_pairs * 10 / 12.0) AND false_passes = 0 AS passed FROM a""",
    "calibration_errors": f"""WITH {_PAIRS}, e AS (SELECT metric, cs AS s, cl AS l FROM p UNION ALL SELECT metric, fs, fl FROM p), g AS (SELECT m AS metric, d AS direction FROM (VALUES ('faithfulness'), ('point_coverage')) a(m), (VALUES ('false_pass'), ('false_fail')) b(d))
SELECT g.metric, g.direction, count(e.metric) AS n FROM g LEFT JOIN e ON e.metric = g.metric AND CASE g.direction WHEN 'false_pass' THEN s >= 0.5 AND l = 'fail' ELSE s < 0.5 AND l = 'pass' END GROUP BY 1, 2""",
    "point_coverage": f"WITH {_ITEMS}, p AS (SELECT id, coalesce(expected_points, []) AS p FROM golden) SELECT id, CASE WHEN len(p) > 0 THEN round(len(list_filter(p, lambda x: regexp_matches(x, '[0-9]') OR length(x) < 60))::DOUBLE / len(p), 9) END AS coverage FROM p",
    "calibration_checks": f"""WITH {_LAST}, {_ITEMS}, {_ANSWERED}, k AS (SELECT r.*, g.question AS q, coalesce(g.expected_points, []) AS pts, ('0x' || substr(sha256(r.id), 1, 2))::INT % 4 AS k, r.s LIKE 'refus:%' AS refuses FROM r JOIN golden g USING (id))
SELECT 'item known' AS "check", id AS "key" FROM k WHERE NOT coalesce(length(q) < 60, false)
UNION ALL SELECT 'same question', id FROM k WHERE length(q) < 60 AND k = 2 AND upper(q) <> q
UNION ALL SELECT 'twin differs', id FROM k WHERE k = 3
UNION ALL SELECT 'clean cites inside', id FROM k WHERE k = 0 AND len(wrong) > 0
UNION ALL SELECT 'points needed', id FROM k WHERE k IN (1, 2) AND len(pts) = 0
UNION ALL SELECT 'both refuse', id FROM k WHERE k = 1 AND NOT refuses""",
    "reading": f"""WITH {_held6('sectionParentId')}, {_ITEMS}, {_GUIDES}, t AS (SELECT {_n('section_id')} AS s, max(titre) AS titre FROM sections WHERE titre NOT LIKE '%1%' AND {_n('section_id')} IS NOT NULL GROUP BY 1),
n AS (SELECT p, s, row_number() OVER (PARTITION BY p ORDER BY s) - 1 AS place FROM kids)
SELECT p AS fiche_id, place::INT AS place, n.s AS section_id, coalesce(titre, n.s) AS title, cid FROM n LEFT JOIN t USING (s) LEFT JOIN (SELECT DISTINCT * FROM art) a ON a.s = n.s""",
    "section_articles": f"WITH {_held6('sectionParentId')} SELECT {_n('sectionParentId')} AS section_id, count(*) AS n_articles, min(cid) AS first, max(cid) AS last FROM last WHERE {_n('sectionParentId')} IS NOT NULL GROUP BY 1",
    "sections_shortlist": f"{_SECTIONED} SELECT * FROM short",
    "outside_guides": f"{_SECTIONED} SELECT id, cid FROM mine WHERE (id, cid) NOT IN (SELECT (id, cid) FROM short)",
    "shortlists": f"{_SECTIONED}, {_BY_TERMS} SELECT id, cid, array_to_string(list_sort(list(p)), '+') AS provenance FROM (SELECT id, cid, 'section' AS p FROM short UNION ALL SELECT id, cid, 'lexical' FROM lex) GROUP BY 1, 2",
    "disagreements": f"""{_SECTIONED}, {_BY_TERMS}, cells AS (SELECT id, cid, max(g) AS g, max(m) AS m, max(s) AS s FROM (SELECT id, cid, 1 AS g, 0 AS m, 0 AS s FROM mine UNION ALL SELECT id, cid, 0, 1, 0 FROM lex WHERE rank <= 2
  UNION ALL SELECT id, cid, 0, 0, 1 FROM short) GROUP BY 1, 2 HAVING max(g) + max(m) > 0),
o AS (SELECT id, coalesce(string_agg(cid, ',' ORDER BY cid) FILTER (g = 1 AND m = 0), '') AS only_gold, coalesce(string_agg(cid, ',' ORDER BY cid) FILTER (g = 0 AND m = 1), '') AS only_picks, coalesce(string_agg(cid, ',' ORDER BY cid) FILTER (g = 1 AND m = 0 AND s = 0), '') AS explained,
  coalesce(string_agg(cid, ',' ORDER BY cid) FILTER ((g = 1 AND m = 0 AND s = 1) OR (g = 0 AND m = 1)), '') AS needs_review FROM cells GROUP BY 1)
SELECT * FROM o WHERE only_gold <> '' OR only_picks <> ''""",
    "held_out_overlap": f"WITH {_ITEMS}, f AS (SELECT DISTINCT id, expected_state = 'reponse' AS r, unnest(gold_fiches) AS fiche_id FROM golden WHERE expected_state IS NOT NULL) SELECT id, fiche_id FROM f WHERE r AND fiche_id IN (SELECT fiche_id FROM f WHERE NOT r)",
    "unused_guides": f"WITH {_ITEMS} SELECT DISTINCT fiche_id FROM fiches WHERE fiche_id NOT IN (SELECT unnest(gold_fiches) FROM golden)",
    "derived_tags": f"""WITH {_ITEMS} SELECT id, array_to_string(list_sort(CASE WHEN coalesce(len(history), 0) > 0 THEN list_append(t, 'multi_turn') ELSE t END), ',') AS tags,
  'gs-' || lpad(((SELECT max(try_cast(regexp_extract(id, '^gs-([0-9]+)$', 1) AS INT)) FROM golden) + 1)::VARCHAR, 3, '0') AS next_id FROM (SELECT id, history, list_filter(coalesce(tags, []), lambda x: x <> 'multi_turn') AS t FROM golden)""",
    "score_cells": "WITH m AS (" + _RETRIEVAL["item_metrics"] + ") " + " UNION ALL ".join(f"SELECT qid, '{m}' AS metric, {m}::DOUBLE AS value FROM m WHERE {m} IS NOT NULL" for m in metrics.METRICS),
    "usage_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "judged_answers": f"""WITH {_LAST}, {_ITEMS}, {_ANSWERED}, a AS (SELECT r.id, g.question AS q, coalesce(g.expected_points, []) AS p, concat_ws(chr(10), '…', CASE WHEN len(cited) > 0 THEN chr(10) || 'Fondement juridique :' || chr(10) || array_to_string(list_transform(cited, lambda k: '- ' || k || ' : '), chr(10)) END,
    CASE WHEN s LIKE 'refus:%' THEN chr(10) || 'Refus (motif : ' || substr(s, 7) || ')' WHEN s = 'reponse_sans_article' THEN chr(10) || 'Aucun fondement : …' END) AS answer FROM r JOIN golden g USING (id)),
n AS (SELECT id, len(p) AS k, {len(evaluate.TEMPLATES["faithfulness"]) - len("{{context}}{{answer}}") + len("context")} + length(answer) AS f,
  CASE WHEN len(p) > 0 THEN {len(evaluate.TEMPLATES["point_coverage"]) - len("{{question}}{{points}}{{answer}}")} + length(q) + length(answer) + list_sum(list_transform(p, lambda x, i: length(i::VARCHAR) + 2 + length(x))) + 2 * (len(p) - 1) END AS c FROM a)
SELECT id, CASE WHEN f % 7 <> 0 THEN round((f % 101) / 100.0::DOUBLE, 9) END AS faithfulness, CASE WHEN c % 7 <> 0 THEN round(len(list_filter(range(1, k + 1), lambda i: (c + i) % 2 = 0))::DOUBLE / k, 9) END AS point_coverage,
  concat_ws('; ', CASE WHEN f % 7 = 0 THEN 'faithfulness: no score from 0 to 1' END, CASE WHEN c % 7 = 0 THEN 'point_coverage: the verdicts do not number the points' END) AS judge_error FROM n""",
    "second_reading": f"""{_SECTIONED}, cells AS (SELECT id, cid, max(g) AS g, max(m) AS m, max(s) AS s FROM (SELECT id, cid, 1 AS g, 0 AS m, 0 AS s FROM mine UNION ALL SELECT id, cid, 0, 1, 0 FROM short WHERE right(cid, 1) IN ('0', '2', '4', '6', '8')
  UNION ALL SELECT id, cid, 0, 0, 1 FROM short) GROUP BY 1, 2 HAVING max(g) + max(m) > 0),
o AS (SELECT id, coalesce(string_agg(cid, ',' ORDER BY cid) FILTER (g = 1 AND m = 0), '') AS only_gold, coalesce(string_agg(cid, ',' ORDER BY cid) FILTER (g = 0 AND m = 1), '') AS only_picks, coalesce(string_agg(cid, ',' ORDER BY cid) FILTER (g = 1 AND m = 0 AND s = 0), '') AS explained,
  coalesce(string_agg(cid, ',' ORDER BY cid) FILTER ((g = 1 AND m = 0 AND s = 1) OR (g = 0 AND m = 1)), '') AS needs_review FROM cells GROUP BY 1)
SELECT * FROM o WHERE only_gold <> '' OR only_picks <> ''""",
    "rejections": f"{_SECTIONED} SELECT id, cid, 'reason ' || length(cid) AS reason FROM short",
    "drafts": f"""{_SECTIONED}, g AS (SELECT p, row_number() OVER (ORDER BY p) AS n FROM (SELECT DISTINCT p FROM kids)), m AS (SELECT max(try_cast(regexp_extract(id, '^gs-([0-9]+)$', 1) AS INT)) AS m FROM golden),
a AS (SELECT p, string_agg(DISTINCT cid, ',' ORDER BY cid) AS picks FROM kids JOIN art USING (s) WHERE right(cid, 1) IN ('0', '2', '4', '6', '8') GROUP BY 1)
SELECT 'gs-' || CASE WHEN m + n < 100 THEN lpad((m + n)::VARCHAR, 3, '0') ELSE (m + n)::VARCHAR END AS id, p AS fiche_id, CASE WHEN right(p, 1) <> '0' THEN p || ' ?' END AS question, CASE WHEN right(p, 1) = '0' THEN NULL WHEN picks IS NOT NULL THEN 'reponse' ELSE 'reponse_sans_article' END AS expected_state,
  CASE WHEN right(p, 1) = '0' THEN '' ELSE coalesce(picks, '') END AS gold_articles, CASE WHEN right(p, 1) = '0' THEN 'ValueError: nought' END AS error FROM g CROSS JOIN m LEFT JOIN a USING (p)""",
    "draft_twins": f"WITH {_LAST}, {_ITEMS}, {_ANSWERED} SELECT id AS golden_id, 'other' AS archetype, array_to_string(list_sort(good), ',') AS retrieved, true AS alike, len(cited)::INT AS n_cited FROM r",
    "floor_gate": f"""WITH {_ITEMS}, f AS (SELECT DISTINCT id, expected_state = 'reponse' AS r, unnest(gold_fiches) AS fiche_id FROM golden WHERE expected_state IS NOT NULL)
SELECT 'guides not held out' AS "check", id AS "key", fiche_id AS detail FROM f WHERE r AND fiche_id IN (SELECT fiche_id FROM f WHERE NOT r) UNION ALL SELECT 'items without article', 'set', NULL""",
    "run_files": f"""WITH {_ITEMS}, s AS (SELECT length(question) % 5 / 4.0::DOUBLE AS a, length(question) % 7 / 6.0::DOUBLE AS b FROM golden WHERE len(expected_points) > 0), n AS (SELECT count(*) AS n, count(*) FILTER (b > a) AS i, count(*) FILTER (b < a) AS r FROM s)
SELECT 'rung4' AS change, 'fiche_recall_at_4' AS metric, n AS n_paired, i AS improved, r AS regressed, i - r AS net, i - r >= 4 AS adopt FROM n""",
    "annotated_files": f"""WITH {_ITEMS} SELECT id, CASE WHEN question NOT LIKE '%e%e%' THEN question ELSE 'old' END AS question, expected_state, coalesce(array_to_string(gold_articles, ','), 'null') AS gold_articles, coalesce(len(history), -1)::INT AS n_turns FROM golden""",
}
