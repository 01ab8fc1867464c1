"""Evaluation of answers, calibration of the judge, drafts of annotated items, and what is kept of it in files.

Models are seams (`functions/models.ask`): one call per row, errors stay with the row. What a model is asked is a template
with `{{name}}` places, a parameter of each plan; the templates here are plain ones.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave import schemas, session
from lexweave.functions import models, text
from lexweave.operators import annotation, answers, gates, metrics
from lexweave.plans import ingest
from lexweave.sources import readers
from lexweave.sources.files import write_text

FAITHFULNESS, COVERAGE = "faithfulness", "point_coverage"
JUDGED = (FAITHFULNESS, COVERAGE)
_FAITHFUL = "struct<score:double,reasoning:string>"
_COVERED = "struct<verdicts:array<struct<index:int,asserted:boolean>>,reasoning:string>"
TEMPLATES = {
    FAITHFULNESS: 'Which share of the claims of the answer does the context support? JSON: {"score": 0..1, "reasoning": ""}\n\nContext:\n{{context}}\n\nAnswer:\n{{answer}}',
    COVERAGE: 'Does the answer assert each numbered point? JSON: {"verdicts": [{"index": 1, "asserted": true}], "reasoning": ""}\n\nQuestion:\n{{question}}\n\nPoints:\n{{points}}\n\nAnswer:\n{{answer}}',
    "pick": "Which of these articles answer the question? Their ids, one a line, or none.\n\nQuestion:\n{{question}}\n\nArticles:\n{{articles}}",
    "draft": "A question that a reader of this guide may have, on one line.\n\n{{guide}}",
    "reject": "Why does each of these articles not answer the question? One line each: id: reason.\n\nQuestion:\n{{question}}\n\nArticles:\n{{articles}}",
}
#: Fixed value: characters of an article's text that a model which picks is shown.
SHOWN = 500
#: Articles of one prompt; a longer shortlist is asked about in several.
POOL = 40

Load = Callable[[], models.Ask]


# --- judging ---------------------------------------------------------------------------------------------------------


def judge_faithfulness(context: Column, answer: Column, load: Load, template: str = TEMPLATES[FAITHFULNESS]) -> Column:
    """STRUCT<answer, error> of the judge's JSON for `read_faithfulness`."""
    return models.ask(F.when(answer.isNotNull(), text.fill_template(template, {"context": context, "answer": answer})), load)


def read_faithfulness(said: Column) -> Column:
    """STRUCT<value, reasoning, error>: a score from 0 to 1, or what is wrong with it."""
    out = F.from_json(said["answer"], _FAITHFUL)
    good = F.coalesce(out["score"].between(0, 1), F.lit(False))
    error = F.coalesce(said["error"], F.when(said["answer"].isNotNull() & ~good, F.lit("no score from 0 to 1")))
    return F.struct(F.when(good, out["score"]).alias("value"), out["reasoning"].alias("reasoning"), error.alias("error"))


def judge_coverage(question: Column, answer: Column, points: Column, load: Load, template: str = TEMPLATES[COVERAGE]) -> Column:
    """STRUCT<answer, error> of the judge's JSON for `read_coverage`; without points nobody is asked."""
    prompt = text.fill_template(template, {"question": question, "points": text.numbered(points), "answer": answer})
    return models.ask(F.when(answer.isNotNull() & (F.coalesce(F.size(points), F.lit(0)) > 0), prompt), load)


def read_coverage(said: Column, points: Column) -> Column:
    """STRUCT<value, reasoning, error>: the share of points asserted, computed here from a verdict on each; verdicts that
    do not number the points from 1, each once, are an error."""
    out = F.from_json(said["answer"], _COVERED)
    numbers = F.array_sort(F.transform(out["verdicts"], lambda v: v["index"]))
    good = F.coalesce((numbers == F.sequence(F.lit(1), F.size(points))) & F.forall(out["verdicts"], lambda v: v["asserted"].isNotNull()), F.lit(False))
    value = F.when(good, F.size(F.filter(out["verdicts"], lambda v: v["asserted"])) / F.size(points))
    error = F.coalesce(said["error"], F.when(said["answer"].isNotNull() & ~good, F.lit("the verdicts do not number the points")))
    return F.struct(value.alias("value"), out["reasoning"].alias("reasoning"), error.alias("error"))


def judged(rows: DataFrame, load: Load) -> DataFrame:
    """rows (question, expected_points, context, envelope) plus faithfulness, point_coverage and judge_error: one call per
    metric, the errors of both joined by "; ", null where there is none. Rows without envelope aren't judged."""
    answer = F.when(F.col("envelope").isNotNull(), answers.render_answer(F.col("envelope")))
    said = rows.withColumn("_f", judge_faithfulness(F.col("context"), answer, load)).withColumn("_c", judge_coverage(F.col("question"), answer, F.col("expected_points"), load))
    said = session.cut(said)
    said = said.withColumn("_f", read_faithfulness(F.col("_f"))).withColumn("_c", read_coverage(F.col("_c"), F.col("expected_points")))
    named = [F.when(F.col(f"{c}.error").isNotNull(), F.concat(F.lit(f"{m}: "), F.col(f"{c}.error"))) for c, m in (("_f", FAITHFULNESS), ("_c", COVERAGE))]
    error = F.concat_ws("; ", *named)
    return said.select(*rows.columns, F.col("_f.value").alias(FAITHFULNESS), F.col("_c.value").alias(COVERAGE), F.when(error != "", error).alias("judge_error"))


def run_answers(spark: SparkSession, folder: str, items: DataFrame, load: Callable[[], models.Embed], scorer: Callable[[], models.Score], rewrite: Load, generate: Load, judge: Load | None = None, arm: str = "rung1", system: str = "") -> DataFrame:
    """The generation experiment over annotated items (id, question, history, expected_state, gold_articles,
    expected_points): `schemas.ANSWER_SCORES`, one row per item that was answered.

    Answers are scored as given, not repaired; without a judge the judged columns are null.
    """
    turns = items.select(F.col("id").alias("qid"), F.col("question").alias("raw_turn"), "history")
    done, contexts = ingest.chain(spark, folder, turns, load, scorer, rewrite, generate, arm, system)
    asked = items.select(F.col("id").alias("qid"), "question", "expected_state", "gold_articles", "expected_points")
    given = done.where("envelope IS NOT NULL").select("qid", "envelope", "context")
    scores = answers.score_answers(asked.select("qid", "expected_state", "gold_articles"), given.select("qid", "envelope"), contexts)
    if judge is None:
        marks = given.select("qid", F.lit(None).cast("double").alias(FAITHFULNESS), F.lit(None).cast("double").alias(COVERAGE), F.lit(None).cast("string").alias("judge_error"))
    else:
        marks = judged(given.join(asked, "qid").select("qid", "question", "expected_points", "context", "envelope"), judge).select("qid", *JUDGED, "judge_error")
    names = [f.split()[0] for f in schemas.ANSWER_SCORES.split(", ")]
    return scores.join(marks, "qid", "left").withColumnRenamed("qid", "item_id").select(*names)


# --- calibrating the judge -------------------------------------------------------------------------------------------


def score_pairs(pairs: DataFrame, judge: Load) -> DataFrame:
    """(golden_id, metric, clean_score, clean_label, faulted_score, faulted_label, error) of calibration pairs (golden_id,
    metric, question, expected_points, context, clean, faulted STRUCT<envelope, label>): both twins are judged."""
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}.envelope").alias("envelope"), F.col(f"{s}.label").alias("label")) for s in ("clean", "faulted"))))
    twins = judged(pairs.select("golden_id", "metric", "question", "expected_points", "context", sides.alias("t")).select("golden_id", "metric", "question", "expected_points", "context", "t.*"), judge)
    score = F.when(F.col("metric") == FAITHFULNESS, F.col(FAITHFULNESS)).when(F.col("metric") == COVERAGE, F.col(COVERAGE))
    of = lambda s, c: F.max(F.when(F.col("side") == s, c))  # noqa: E731  a row a side
    error = F.array_join(F.array_sort(F.collect_set("judge_error")), "; ")
    return twins.groupBy("golden_id", "metric").agg(*(of(s, c).alias(f"{s}_{n}") for s in ("clean", "faulted") for n, c in (("score", score), ("label", F.col("label")))), F.when(error != "", error).alias("error"))


def run_calibration(pairs: DataFrame, judge: Load, threshold: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs scored, summary, errors by metric) of a judge. A pair whose judge failed has no score; it isn't detected."""
    scored = session.cut(score_pairs(pairs, judge))
    return scored, metrics.calibration(scored, threshold), metrics.errors_by_metric(scored, JUDGED, threshold)


def draft_pairs(items: DataFrame, done: DataFrame, archetype: str) -> DataFrame:
    """Calibration pairs to be worked on, of items (id, question, expected_points) and answers (qid, envelope, retrieved,
    context): both twins are the answer, for the annotator to spoil one."""
    twin = lambda: F.struct("envelope", F.lit(None).cast("string").alias("label"))
    rows = items.select(F.col("id").alias("qid"), "question", "expected_points").join(done.select("qid", "envelope", "retrieved", "context"), "qid")
    return rows.select(F.col("qid").alias("golden_id"), F.lit(archetype).alias("archetype"), "question", "expected_points", F.array_sort("retrieved").alias("retrieved"), "context", twin().alias("clean"), twin().alias("faulted"))


# --- second opinions and drafts --------------------------------------------------------------------------------------


def _asked_in_parts(questions: DataFrame, pool: DataFrame, articles: DataFrame, load: Load, template: str) -> DataFrame:
    """(id, ids, answer, error): the model's answer on each part of an item's pool (id, cid), POOL articles in order of
    cid with SHOWN characters of their text. An item without pool isn't asked about."""
    shown = articles.select("cid", F.concat(F.col("cid"), F.lit(" : "), F.coalesce(F.substring("texte", 1, SHOWN), F.lit(""))).alias("line"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("cid")) - 1
    parts = pool.select("id", "cid").distinct().join(shown, "cid").withColumn("part", F.floor(place / POOL))
    parts = parts.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct("cid", "line"))).alias("a"))  # POOL entries
    rows = parts.join(questions.select("id", "question"), "id")
    prompt = text.fill_template(template, {"question": F.col("question"), "articles": F.array_join(F.transform("a", lambda x: x["line"]), "\n")})
    return session.cut(rows.select("id", F.transform("a", lambda x: x["cid"]).alias("ids"), models.ask(prompt, load).alias("s"))).select("id", "ids", "s.answer", "s.error")


def independent_picks(questions: DataFrame, pool: DataFrame, articles: DataFrame, load: Load, template: str = TEMPLATES["pick"]) -> DataFrame:
    """(id, cid): what a second reader picks from an item's pool for its question, only ids that it was shown."""
    said = _asked_in_parts(questions, pool, articles, load, template)
    return said.where("answer IS NOT NULL").select("id", F.explode(annotation.pick(text.clean_lines(F.col("answer")), F.col("ids"))).alias("cid")).distinct()


def disagreement_pass(items: DataFrame, guides: DataFrame, articles: DataFrame, load: Load) -> DataFrame:
    """`annotation.disagreements` of items with a second reader over the articles (cid, section_id, texte) of their
    guides' sections (fiche_id, section_ids). A report only; the items stay as they are."""
    shortlist = session.cut(annotation.section_shortlist(items, guides, articles))
    gold = items.select("id", F.explode("gold_articles").alias("cid")).distinct()
    return annotation.disagreements(gold, independent_picks(items, shortlist, articles, load), shortlist)


def rejection_reasons(questions: DataFrame, rejected: DataFrame, articles: DataFrame, load: Load, template: str = TEMPLATES["reject"]) -> DataFrame:
    """(id, cid, reason): why a model rejects each article of (id, cid): of the lines `id: reason` whose id it was shown,
    the first one counts."""
    said = _asked_in_parts(questions, rejected, articles, load, template).where("answer IS NOT NULL")
    lines = said.select("id", "ids", F.posexplode(text.clean_lines(F.col("answer"))).alias("place", "line"))
    cid, reason = F.btrim(F.substring_index("line", ":", 1)), F.btrim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    rows = lines.select("id", "place", "ids", cid.alias("cid"), reason.alias("reason")).where(F.array_contains("ids", F.col("cid")) & (F.col("reason") != ""))
    return rows.groupBy("id", "cid").agg(F.min_by("reason", "place").alias("reason"))


def draft_items(fiche_texts: DataFrame, guides: DataFrame, articles: DataFrame, golden: DataFrame, ask: Load, pick: Load, n: int, seed: int) -> DataFrame:
    """(id, fiche_id, question, expected_state, gold_fiches, gold_articles, error): drafts of annotated items for `n`
    guides that no item uses.

    A model puts a question to the guide's text (fiche_id, text), of whose lines the first counts; another picks articles
    from the guide's sections. Without a pick the item is to be answered without an article. A failure stays a row.
    """
    drawn = annotation.unused_guides(fiche_texts, golden, n, seed)
    first = int(annotation.next_id(golden).removeprefix("gs-"))
    drawn = drawn.withColumn("id", F.format_string(annotation.ID_FORM, (F.row_number().over(Window.orderBy("fiche_id")) + first - 1).cast("int")))  # n rows
    said = session.cut(drawn.join(fiche_texts, "fiche_id").withColumn("s", models.ask(text.fill_template(TEMPLATES["draft"], {"guide": F.col("text")}), ask)))
    rows = said.select("id", "fiche_id", F.get(text.clean_lines(F.col("s.answer")), F.lit(0)).alias("question"), F.col("s.error").alias("error"))
    asked = rows.where("question IS NOT NULL").withColumn("gold_fiches", F.array("fiche_id"))
    picks = independent_picks(asked, annotation.section_shortlist(asked, guides, articles), articles, pick)
    found = picks.groupBy("id").agg(F.array_sort(F.collect_set("cid")).alias("gold_articles"))  # an item's picks
    out = rows.join(found, "id", "left")
    state = F.when(F.col("gold_articles").isNotNull(), "reponse").otherwise(gates.WITHOUT_ARTICLE)
    error = F.coalesce("error", F.when(F.col("question").isNull(), "no question"))
    return out.select("id", "fiche_id", "question", F.when(error.isNull(), state).alias("expected_state"), F.array("fiche_id").alias("gold_fiches"), F.coalesce("gold_articles", F.array().cast("array<string>")).alias("gold_articles"), error.alias("error"))


# --- what is kept ----------------------------------------------------------------------------------------------------


def write_report(spark: SparkSession, parts: dict[str, DataFrame | Any], path: str) -> str:
    """A report as one JSON file: small frames (a row per metric, floor or item) as lists of objects, other values as
    they are."""
    plain = lambda v: [json.loads(r) for r in v.toJSON().collect()] if isinstance(v, DataFrame) else v
    return write_text(spark, str(path), json.dumps({k: plain(v) for k, v in parts.items()}, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def compare_files(spark: SparkSession, incumbent: str, challenger: str, change: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(comparison, verdict) of two run files by the registered primary metric of a change; written to `out` if given."""
    primary = metrics.primary_of(change)
    one, two = (metrics.long_scores(readers.run_items(spark, p), "item_id") for p in (incumbent, challenger))
    table = session.cut(metrics.compare(one, two, "item_id"))
    verdict = metrics.verdict(table, primary)
    if out:
        write_report(spark, {"change": change, "comparison": table, "verdict": verdict}, out)
    return table, verdict


def write_sweep(sweep: DataFrame, path: str) -> str:
    """A floor sweep with the floor that it chooses, as JSON."""
    sweep = session.cut(sweep)
    return write_report(sweep.sparkSession, {"sweep": sweep.orderBy("floor"), "best": metrics.best_floor(sweep)}, path)


def save_items(items: DataFrame, path: str, check: Callable[[DataFrame], DataFrame], key: str = "id", schema: str = schemas.GOLDEN) -> DataFrame:
    """Puts items into an annotated set: those of the same key are replaced, the whole set is checked (a gate gives its
    violations) and only then written. Returns the set."""
    there = readers.annotated_set(items.sparkSession, path, schema)
    whole = session.cut(there.join(items.select(key), key, "left_anti").unionByName(items.select(*there.columns)))
    gates.enforce(check(whole))
    readers.write_annotated_set(whole, path, key)
    return whole


def floor_gate(items: DataFrame, held_out: DataFrame, names: Sequence[str] = ("id", "expected_state", "gold_fiches")) -> DataFrame:
    """Checks of a set for choosing the floor: no guide that the held-out set uses, and both kinds of items present."""
    rows = items.select(*names)
    kinds = rows.agg(F.count_if(F.col("expected_state") == gates.WITHOUT_ARTICLE).alias("without"), F.count_if(F.col("expected_state") == "reponse").alias("with"))
    return gates.union(
        gates.violations(annotation.overlap(rows, held_out), "guides not held out", "id", F.col("fiche_id")),
        gates.violations(kinds.where("`without` = 0"), "items without article", F.lit("set")),
        gates.violations(kinds.where("`with` = 0"), "items with articles", F.lit("set")),
    )
