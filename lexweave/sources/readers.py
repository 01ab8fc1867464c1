"""Sources and sinks: JSON lines, XML files, annotated sets, runs and manifests."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.functions.text import collapse, epoch_ms_date
from lexweave.operators.snapshots import IN_FORCE
from lexweave.sources.files import read_text, write_text
from lexweave.sources.xmltree import parse

GUIDE_FILE = r"^F\d+\.xml$"


def jsonl(spark: SparkSession, path: str, schema: str = schemas.ARTICLE) -> DataFrame:
    """One object per line under a declared schema. A line that isn't JSON fails the read, a missing file at once."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def article_delivery(rows: DataFrame, names: dict[str, str], dates: Sequence[str] = ("dateDebut", "dateFin")) -> DataFrame:
    """A delivery as article rows: source columns renamed by `names` (output -> source), epoch milliseconds of `dates` as
    ISO dates, only rows in force that have a texteHtml, in order of cid. Outputs without a source are null."""
    dates = set(dates)

    def column(out: str) -> Any:
        if out not in names:
            return F.lit(None).cast("string").alias(out)
        c = F.col(names[out])
        return (F.date_format(epoch_ms_date(c), "yyyy-MM-dd") if out in dates else c.cast("string")).alias(out)

    return rows.select(*map(column, schemas.ARTICLE_FIELDS)).where((F.col("etat") == IN_FORCE) & F.col("texteHtml").isNotNull()).orderBy("cid")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def guide_files(spark: SparkSession, folder: str, pattern: str = GUIDE_FILE) -> DataFrame:
    """(fiche_id, xml, modified) of the XML files of a folder whose names match."""
    rows = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.where(name.rlike(pattern)).select(F.regexp_replace(name, r"\.xml$", "").alias("fiche_id"), F.col("content").alias("xml"), F.col("modificationTime").alias("modified"))


def zipped_guides(spark: SparkSession, path: str, pattern: str = GUIDE_FILE) -> DataFrame:
    """(fiche_id, xml, modified) of the XML files in zip archives whose names match; an archive is read by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import re
        import zipfile

        for batch in batches:
            for body, modified in zip(batch.column(0), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(body.as_py())) as archive:
                    for name in sorted(archive.namelist()):
                        last = name.rsplit("/", 1)[-1]
                        if re.match(pattern, last):
                            yield pa.RecordBatch.from_arrays([pa.array([last.removesuffix(".xml")]), pa.array([archive.read(name)], pa.binary()), pa.array([modified.as_py()], modified.type)], ["fiche_id", "xml", "modified"])

    rows = spark.read.format("binaryFile").load(path).select("content", "modificationTime")
    return rows.mapInArrow(read, "fiche_id string, xml binary, modified timestamp")


def guide_headers(fiches: DataFrame, strict: bool = False) -> DataFrame:
    """(fiche_id, doc_id, title, type, sp_url, date_modified, section_ids, fil_ariane) of the guides (fiche_id, xml).

    date_modified is what stands after "modified"; with strict=True another form of date raises. section_ids are the
    distinct ids of dc:source in order, empty without one. Guides that don't parse have no row.
    """
    names = ["fiche_id", "doc_id", "title", "type", "sp_url", "date", "source", "trail"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k, x in zip(batch.column(0), batch.column(1)):
                doc = parse(x.as_py(), keep=("Niveau",), within=("FilDAriane",))
                if doc is None:
                    continue
                h = doc.headers
                trail = [" ".join("".join(n.text).split()) for n in doc.nodes]
                for c, v in zip(out, (k.as_py(), doc.root.get("ID"), (h.get("title") or [""])[0].strip(), doc.root.get("type"), doc.root.get("spUrl"), (h.get("date") or [""])[0], " ".join(h.get("source", ())), " > ".join(filter(None, trail)))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names)

    rows = fiches.select("fiche_id", "xml").mapInArrow(read, ", ".join(f"{n} string" for n in names))
    day = F.regexp_extract(collapse(F.col("date")), r"^modified (\d{4}-\d{2}-\d{2})$", 1)
    wrong = F.raise_error(F.concat(F.lit("no modification date in "), F.col("fiche_id"))).cast("string") if strict else F.lit(None).cast("string")
    return rows.select("fiche_id", "doc_id", "title", "type", "sp_url", F.when(day != "", day).otherwise(wrong).alias("date_modified"), F.array_distinct(F.regexp_extract_all("source", F.lit(r"LEGISCTA\d+"), F.lit(0))).alias("section_ids"), F.col("trail").alias("fil_ariane"))


def in_scope(headers: DataFrame, articles: DataFrame) -> DataFrame:
    """Guides one of whose sections holds an article (sectionParentId)."""
    known = articles.select(F.col("sectionParentId").alias("s")).where("s IS NOT NULL").distinct()
    ids = headers.select("fiche_id", F.explode("section_ids").alias("s")).join(known, "s", "left_semi").select("fiche_id").distinct()
    return headers.join(ids, "fiche_id", "left_semi")


def annotated_set(spark: SparkSession, path: str, schema: str = schemas.GOLDEN) -> DataFrame:
    """Items of a YAML (where a YAML reader is installed) or JSON file; a missing or empty file has none."""
    body = read_text(spark, str(path)) or ""
    if not body.strip():
        return spark.createDataFrame([], schema)
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML reader") from e
        items = yaml.safe_load(body) or []
    else:
        items = json.loads(body)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    wrong = [f"item {i}: {'not an object' if not isinstance(x, dict) else 'unknown ' + ', '.join(sorted(set(x) - set(names)))}" for i, x in enumerate(items, 1) if not isinstance(x, dict) or set(x) - set(names)]
    if wrong:
        raise ValueError("; ".join(wrong))
    return spark.createDataFrame([tuple(x.get(n) for n in names) for x in items], schema)


def write_annotated_set(items: DataFrame, path: str, key: str = "id") -> None:
    """Items in order of their key, fields in the order of the schema, as YAML or JSON by the file's name. The set is
    annotated by hand, so it is small. YAML is written without a YAML library: block style, texts in double quotes."""
    rows = [json.loads(r[0]) for r in items.orderBy(key).select(F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"})).collect()]
    if str(path).endswith((".yaml", ".yml")):
        body = "".join(f"{line}\n" for r in rows for line in _yaml([r], 0)) or "[]\n"
    else:
        body = json.dumps(rows, ensure_ascii=False, indent=2) + "\n"
    write_text(items.sparkSession, str(path), body)


def _yaml(value: Any, depth: int) -> list[str]:
    """Lines of a value in block style; texts are written as JSON texts, which YAML reads alike."""
    pad = "  " * depth
    if isinstance(value, list) and value:
        out = []
        for v in value:
            lines = _yaml(v, depth + 1)
            out += [f"{pad}- {lines[0].lstrip()}", *lines[1:]]
        return out
    if isinstance(value, dict) and value:
        out = []
        for k, v in value.items():
            nested = isinstance(v, (list, dict)) and v
            out += [f"{pad}{k}:", *_yaml(v, depth + 1)] if nested else [f"{pad}{k}: {json.dumps(v, ensure_ascii=False)}"]
        return out
    return [f"{pad}{json.dumps(value, ensure_ascii=False)}"]


def run_items(spark: SparkSession, path: str | Iterable[str], legacy: dict[str, str] | None = None, run: str = schemas.RUN) -> DataFrame:
    """(run_id, item_id, metrics): one row per scored item of run files; `legacy` maps old field names to new ones,
    which fill in where the new field is null. run: the schema, `schemas.RUN` or `schemas.ANSWER_RUN`."""
    old = legacy or {}
    extra = "".join(f", {o}:double" for o in old)
    schema = run.replace(">>", f"{extra}>>") if old else run
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).select("header.run_id", F.explode("items").alias("i")).select("run_id", "i.*")
    for o, n in old.items():
        rows = rows.withColumn(n, F.coalesce(F.col(n), F.col(o))).drop(o)
    return rows


def write_run(header: dict[str, Any], items: DataFrame, folder: str) -> str:
    """A run as one JSON file named by its id, and its path; its items are those of an annotated set."""
    body = {"header": header, "items": [json.loads(r[0]) for r in items.orderBy("item_id").select(F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"})).collect()]}
    return write_text(items.sparkSession, f"{str(folder).rstrip('/')}/{header['run_id']}.json", json.dumps(body, ensure_ascii=False, indent=2) + "\n")


def attribution(manifest: DataFrame) -> DataFrame:
    """(snapshot_date, n_documents) of a manifest: the earliest file date and all documents."""
    return manifest.agg(F.min("file_date").alias("snapshot_date"), F.sum("document_count").alias("n_documents"))


def dataset_items(golden: DataFrame, prefix: str = "", working_set: bool = True) -> DataFrame:
    """(id, input, expected, metadata) for an evaluation dataset: single-turn items with gold, or all of them."""
    rows = golden
    if working_set:
        rows = rows.where((F.coalesce(F.size("history"), F.lit(0)) <= 0) & ((F.coalesce(F.size("gold_fiches"), F.lit(0)) > 0) | (F.coalesce(F.size("gold_articles"), F.lit(0)) > 0)))
    return rows.select(
        F.concat(F.lit(prefix), F.col("id")).alias("id"), F.col("question").alias("input"),
        F.struct("expected_state", "gold_fiches", "gold_articles", "gold_spans", "expected_points").alias("expected"), F.struct("tags", "history").alias("metadata"),
    )


def items_of_dataset(rows: DataFrame) -> DataFrame:
    """The annotated items of (id, input, expected, metadata): the inverse of `dataset_items`; absent lists are empty."""
    none = F.array().cast("array<string>")
    lists = [F.coalesce(f"expected.{c}", none).alias(c) for c in ("gold_fiches", "gold_spans", "gold_articles", "expected_points")]
    return rows.select("id", F.col("input").alias("question"), F.coalesce("metadata.history", F.array().cast("array<map<string,string>>")).alias("history"), "expected.expected_state", *lists, F.coalesce("metadata.tags", none).alias("tags"))
