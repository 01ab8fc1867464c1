"""Registered queries of problems 2, 3 and 5, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import orphans, records, snapshots
from lexweave.session import read

_HELD = """
held AS (
  SELECT snapshot_no, snapshot_date, cid, texteHtml, texte, etat, titre, section, raw_section FROM (
    SELECT snapshot_no, snapshot_date, upper(trim(cid, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS cid, texteHtml, texte, etat, sectionParentTitre AS titre, sectionParentId AS raw_section,
           nullif(upper(trim(sectionParentId, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '') AS section,
           row_number() OVER (PARTITION BY snapshot_no, upper(trim(cid, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) ORDER BY delivered_at DESC) AS rn
    FROM articles WHERE cid IS NOT NULL
  ) WHERE rn = 1 AND etat = 'VIGUEUR' AND cid <> ''
)"""


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = records.fiche_nodes(read(spark, d, "fiches"), content=False)
    return rows.select(F.col("doc_key").alias("fiche_id"), "node_no", "parent_no", "node_tag")


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All flat tables in long form, with titles, texts and labels."""
    rows = records.fiche_nodes(read(spark, d, "fiches"))
    return rows.select("doc_key", F.array_join("label", ".").alias("label"), F.array_join("parent_label", ".").alias("parent_label"), "node_no", "parent_no", "schema_path", "title", "content", F.to_json("attributes").alias("attributes"))


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    return records.table_summary(records.fiche_nodes(read(spark, d, "fiches")))


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return orphans.corpus_orphans(*(read(spark, d, t) for t in ("articles", "sections", "fiches", "golden_set")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    dangling, _ = _orphans(spark, d)
    return dangling.select("ref_table", F.date_format("at", "yyyy-MM").alias("ref_month"), "record_key", "missing_key").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """The report: dangling references of all tables per month, the keys that miss and the records that name them."""
    dangling, _ = _orphans(spark, d)
    months = dangling.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("ref_month"))
    return months.agg(F.count(F.lit(1)).alias("n_dangling"), F.countDistinct("missing_key").alias("n_missing"), F.countDistinct("record_key").alias("n_records"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """The periodic counts of the state: references that arrived, were resolved or reopened, and that wait."""
    return _orphans(spark, d)[1].withColumn("until", F.col("until").cast("string"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.article_changes(read(spark, d, "articles")).drop("changed_fields")


def p5_fields(spark: SparkSession, d: str) -> DataFrame:
    """Which fields changed, over four fields of the articles."""
    rows = snapshots.article_changes(read(spark, d, "articles"), ["texteHtml", "texte", "sectionParentTitre", "sectionParentId"])
    return rows.groupBy("old_snapshot", "change_kind", F.array_join("changed_fields", ",").alias("fields")).agg(F.count(F.lit(1)).alias("n_articles"))


def p5_reported(spark: SparkSession, d: str) -> DataFrame:
    """How the earlier pipeline's reports compare with the changes found, per pair of snapshots and kind."""
    found = snapshots.article_changes(read(spark, d, "articles")).select("old_snapshot", "change_kind", "cid", F.lit(1).alias("f"), F.lit(0).alias("r"))
    reports = read(spark, d, "refresh_diffs")
    one = None
    for kind in ("added", "removed", "changed"):
        part = reports.select("old_snapshot", F.lit(kind).alias("change_kind"), F.explode(kind).alias("c")).select("old_snapshot", "change_kind", snapshots.norm_key("c").alias("cid"), F.lit(0).alias("f"), F.lit(1).alias("r")).where("cid IS NOT NULL")
        one = part if one is None else one.unionByName(part)
    pairs = found.unionByName(one).groupBy("old_snapshot", "change_kind", "cid").agg(F.max("f").alias("f"), F.max("r").alias("r"))
    return pairs.groupBy("old_snapshot", "change_kind").agg(F.sum(F.col("f") * F.col("r")).alias("n_both"), F.sum(F.col("f") * (1 - F.col("r"))).alias("n_unreported"), F.sum((1 - F.col("f")) * F.col("r")).alias("n_wrong"))


QUERIES = {f.__name__: f for f in (p2_found, p2_nodes, p2_tables, p3_found, p3_report, p3_counts, p5_found, p5_fields, p5_reported)}

_CHANGES = """
WITH {held},
numbers AS (SELECT DISTINCT snapshot_no FROM articles),
pairs AS (SELECT a.snapshot_no AS old_snapshot, b.snapshot_no AS new_snapshot FROM numbers a JOIN numbers b ON b.snapshot_no = a.snapshot_no + 1),
changes AS (
  SELECT p.old_snapshot, p.new_snapshot, h.cid, 'added' AS change_kind, '' AS fields FROM pairs p JOIN held h ON h.snapshot_no = p.new_snapshot
    WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.snapshot_no = p.old_snapshot AND o.cid = h.cid)
  UNION ALL
  SELECT p.old_snapshot, p.new_snapshot, h.cid, 'removed', '' FROM pairs p JOIN held h ON h.snapshot_no = p.old_snapshot
    WHERE NOT EXISTS (SELECT 1 FROM held n WHERE n.snapshot_no = p.new_snapshot AND n.cid = h.cid)
  UNION ALL
  SELECT p.old_snapshot, p.new_snapshot, o.cid, 'changed',
    concat_ws(',', CASE WHEN o.raw_section IS DISTINCT FROM n.raw_section THEN 'sectionParentId' END, CASE WHEN o.titre IS DISTINCT FROM n.titre THEN 'sectionParentTitre' END,
      CASE WHEN o.texte IS DISTINCT FROM n.texte THEN 'texte' END, CASE WHEN o.texteHtml IS DISTINCT FROM n.texteHtml THEN 'texteHtml' END)
    FROM pairs p JOIN held o ON o.snapshot_no = p.old_snapshot JOIN held n ON n.snapshot_no = p.new_snapshot AND n.cid = o.cid
    WHERE {compared}
)"""

_TEXT = _CHANGES.format(held=_HELD, compared="o.texteHtml IS DISTINCT FROM n.texteHtml")
_FOUR = _CHANGES.format(held=_HELD, compared="(o.texteHtml, o.texte, o.titre, o.raw_section) IS DISTINCT FROM (n.texteHtml, n.texte, n.titre, n.raw_section)")

SQL = {
    "p5_fields": _FOUR + " SELECT old_snapshot, change_kind, fields, count(*) AS n_articles FROM changes GROUP BY 1, 2, 3",
    "p5_found": _TEXT + " SELECT old_snapshot, new_snapshot, cid, change_kind FROM changes",
    "p5_reported": _TEXT
    + """, reported AS (
  SELECT DISTINCT old_snapshot, change_kind, upper(trim(c, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS cid FROM (
    SELECT old_snapshot, 'added' AS change_kind, unnest(added) AS c FROM refresh_diffs
    UNION ALL SELECT old_snapshot, 'removed', unnest(removed) FROM refresh_diffs
    UNION ALL SELECT old_snapshot, 'changed', unnest(changed) FROM refresh_diffs) WHERE c IS NOT NULL)
SELECT coalesce(f.old_snapshot, r.old_snapshot) AS old_snapshot, coalesce(f.change_kind, r.change_kind) AS change_kind,
       count(*) FILTER (f.cid IS NOT NULL AND r.cid IS NOT NULL) AS n_both, count(*) FILTER (r.cid IS NULL) AS n_unreported, count(*) FILTER (f.cid IS NULL) AS n_wrong
FROM changes f FULL JOIN reported r ON f.old_snapshot = r.old_snapshot AND f.change_kind = r.change_kind AND f.cid = r.cid GROUP BY 1, 2""",
}
