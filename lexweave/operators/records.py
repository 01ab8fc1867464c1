"""Deeply nested records as flat related tables, by Dewey labels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.snapshots import latest
from lexweave.sources.xmltree import parse

#: The elements that become rows, and the parts of the document they are looked for in.
FICHE_NODES = ("Chapitre", "SousChapitre", "BlocCas", "Cas", "ListeSituations", "Situation")
FICHE_PARTS = ("Introduction", "Texte", "Conclusion", "ListeSituations")

NODE_SCHEMA = (
    "doc_key string, node_no int, parent_no int, label array<int>, parent_label array<int>, node_tag string, schema_path string, "
    "attributes map<string,string>, title string, content string"
)


def current(df: DataFrame, key: str = "fiche_id", at: str = "retrieved_at", xml: str = "xml") -> DataFrame:
    """The latest row of every document: (key, at, xml). Ties go to the greater bytes; a null key is left out."""
    return latest(df, [key], [at], [xml])


def nodes(df: DataFrame, key: str, xml: str, keep: Sequence[str] = FICHE_NODES, within: Sequence[str] = FICHE_PARTS, content: bool = True) -> DataFrame:
    """The kept elements of every document as rows: `NODE_SCHEMA`.

    label: the ordinals of the element and of the kept elements around it, each among its kept siblings; the parent's
    label is the label without its last ordinal, so the link needs no join. Labels sort in document order; node_no is
    the place in that order, from 1, and parent_no the place of the parent, 0 at the top. schema_path, the kept names
    from the top, names the table of the node. title and content are null with content=False, title also where an
    element has none. Documents that are null or don't parse yield no rows, nor do documents without kept elements.
    Each document is read by itself: no exchange.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_key", "node_no", "parent_no", "label", "parent_label", "node_tag", "schema_path", "attributes", "title", "content"]
        types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
        for batch in batches:
            out: list[list] = [[] for _ in names]

            def flush() -> pa.RecordBatch:
                ready = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                for c in out:
                    c.clear()
                return ready

            for k, x in zip(batch.column(0), batch.column(1)):
                doc = parse(x.as_py(), keep, within, content=content)
                if doc is None:
                    continue
                number = {(): 0}
                for n in doc.nodes:
                    number[n.label] = len(number)
                    parent = n.label[:-1]
                    title, text = (" ".join("".join(p).split()) for p in (n.title, n.text)) if content else ("", "")
                    for c, v in zip(out, (k.as_py(), number[n.label], number[parent], n.label, parent, n.tag, n.schema, list(n.attributes.items()), title or None, text if content else None)):
                        c.append(v)
                if len(out[0]) > 5000:
                    yield flush()
            if out[0]:
                yield flush()

    return df.select(F.col(key).cast("string").alias("doc_key"), F.col(xml).cast("binary").alias("xml")).mapInArrow(read, NODE_SCHEMA)


def fiche_nodes(fiches: DataFrame, content: bool = True) -> DataFrame:
    """`nodes` of the current fiches."""
    return nodes(current(fiches), "fiche_id", "xml", content=content)


def table(nodes_: DataFrame, schema_path: str, attributes: Iterable[str] = ()) -> DataFrame:
    """One of the flat tables: the rows of a schema path with their key, their parent's key and the named attributes."""
    return nodes_.where(F.col("schema_path") == schema_path).select(
        "doc_key", "label", "parent_label", "node_no", "parent_no", "title", "content", *(F.col("attributes")[a].alias(a) for a in attributes)
    )


def write_tables(nodes_: DataFrame, path: str) -> None:
    """All flat tables in one pass, one folder per schema path (table=Chapitre.SousChapitre and so on)."""
    nodes_.withColumn("table", F.translate("schema_path", "/", ".")).write.mode("overwrite").partitionBy("table").parquet(path)


def table_summary(nodes_: DataFrame) -> DataFrame:
    """The relational schema found: per table its parent table, rows, documents, titled rows and attributed rows."""
    parent = F.regexp_extract("schema_path", "^(.*)/[^/]*$", 1)
    return nodes_.groupBy("schema_path").agg(
        F.first(F.when(parent != "", parent)).alias("parent_path"),
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("doc_key").alias("n_docs"),
        F.count("title").alias("n_titled"),
        F.sum(F.when(F.size("attributes") > 0, 1).otherwise(0)).alias("n_attributed"),
    )
