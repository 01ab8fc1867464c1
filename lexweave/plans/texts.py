"""Registered queries over texts, gates and chunks, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import ids, text
from lexweave.functions.keys import digest, norm_key
from lexweave.operators import annotation, answers, chunking, gates, search, snapshots
from lexweave.operators.records import current
from lexweave.plans.corpus import _HELD
from lexweave.session import cut, read
from lexweave.sources.readers import guide_headers

LATEST = 6


def _golden(spark: SparkSession, d: str) -> DataFrame:
    """Items once each, by the latest annotation; histories as structs."""
    rows = read(spark, d, "golden_set")
    turns = F.transform("history", lambda t: F.struct(F.element_at(t, F.lit("role")).alias("role"), F.element_at(t, F.lit("content")).alias("content")))
    keep = ["question", "expected_state", "gold_fiches", "gold_spans", "gold_articles", "expected_points", "tags", "turns"]
    return snapshots.latest(rows.withColumn("turns", turns), ["id"], ["annotated_at"], keep)


def _articles(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Articles that the last snapshot holds."""
    return snapshots.held(read(spark, d, "articles").where(F.col("snapshot_no") == LATEST), {c: F.col(c) for c in columns})


def _reduced(spark: SparkSession, d: str, **payload: Column) -> DataFrame:
    """The same with what is made of the texts where they are read, so that no text is shuffled."""
    return snapshots.held(read(spark, d, "articles").where(F.col("snapshot_no") == LATEST), payload)


def lookup_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key of every held article's number, null for other designations."""
    return _articles(spark, d, "citation_id").select("cid", "citation_id", text.lookup_key(F.col("citation_id")).alias("lookup_key"))


def reference_sets(spark: SparkSession, d: str) -> DataFrame:
    """Articles that the texts of held articles refer to: how often each key is named."""
    rows = _reduced(spark, d, r=text.all_references(F.col("texte"), strict=True)).select("cid", F.explode("r").alias("reference"))
    return rows.groupBy("reference").agg(F.count(F.lit(1)).alias("n_articles"))


def short_circuit_path(spark: SparkSession, d: str) -> DataFrame:
    """Path of every golden question; half of the questions are asked about an article by number."""
    known = lookup_keys(spark, d)
    turns = _golden(spark, d).select("id", F.when(F.substring("id", -1, 1).cast("int") % 2 == 0, F.concat("question", F.lit(" (art. L. "), F.substring("id", -3, 3).cast("int").cast("string"), F.lit("-1)"))).otherwise(F.col("question")).alias("turn"))
    return search.short_circuit(turns, known, "turn", text.first_reference).select("id", "path", "lookup_key")


def trimmed_history(spark: SparkSession, d: str) -> DataFrame:
    """Histories within the fixed numbers of turns and characters."""
    rows = _golden(spark, d).select("id", F.posexplode(text.trim_history(F.col("turns"))).alias("n", "t"))
    return rows.select("id", F.col("n").cast("int").alias("turn_no"), F.col("t.role").alias("role"), F.col("t.content").alias("content"))


def condense_status(spark: SparkSession, d: str) -> DataFrame:
    """The condensing decision over golden items, with rewritings of all kinds made from the question."""
    k = F.substring("id", -1, 1).cast("int")
    said = F.when(k < 2, None).when(k < 4, F.concat(F.lit("  "), F.col("question"), F.lit(" "))).when(k == 4, F.concat("question", F.lit(" (art. L999-9)"))).when(k == 5, F.concat("question", F.lit("\nVoilà"))).otherwise(F.concat("question", F.lit(" en France")))
    turns = _golden(spark, d).select("id", F.col("question").alias("raw_turn"), F.col("turns").alias("history"), said.alias("rewritten"))
    return answers.condense(turns, lookup_keys(spark, d)).select("id", "query", "condense_status")


def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    rows = _articles(spark, d, "fullSectionsTitre")
    return rows.groupBy(text.strip_breadcrumb_root(F.col("fullSectionsTitre")).alias("breadcrumb")).agg(F.count(F.lit(1)).alias("n_articles"))


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "fiche_chunks").select("fiche_id", "chunk_index").where("fiche_id IS NOT NULL AND chunk_index IS NOT NULL").distinct()
    return rows.select("fiche_id", "chunk_index", ids.point_id(F.col("fiche_id"), F.col("chunk_index")).alias("point_id"))


def article_gate(spark: SparkSession, d: str) -> DataFrame:
    """Violations in the rows of the last snapshot as delivered."""
    rows = read(spark, d, "articles").where(F.col("snapshot_no") == LATEST).select(norm_key("cid").alias("cid"), "etat", "citation_id").distinct()
    return gates.article_gate(rows)


def golden_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "golden_set").drop("annotated_at")
    upper = F.transform("gold_articles", lambda k: F.coalesce(norm_key(k), F.lit("")))
    texts = read(spark, d, "fiche_chunks").select("fiche_id", "text").distinct()
    return gates.golden_gate(rows.withColumn("gold_articles", upper), read(spark, d, "fiches").select("fiche_id").distinct(), _articles(spark, d).select("cid"), texts)


def _term_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """`annotation.term_shortlist` of the golden items over the texts of held articles.

    Texts are reduced to their terms that some item asks for where they are read; which delivery counts is found from
    digests, so no text is shuffled.
    """
    items = _golden(spark, d)
    weights = items.select("id", F.explode(text.terms(F.col("question"))).alias("term"), F.lit(3).alias("w")).unionByName(
        items.select("id", F.explode(text.terms(F.array_join("expected_points", " "))).alias("term"), F.lit(1).alias("w"))
    ).groupBy("id", "term").agg(F.sum("w").alias("w"))
    weights = cut(weights)
    rows = read(spark, d, "articles").where(F.col("snapshot_no") == LATEST).select(F.monotonically_increasing_id().alias("row"), norm_key("cid").alias("cid"), "delivered_at", digest("texte").alias("version"), "texte")
    rows = rows.select("row", "cid", "delivered_at", "version", F.explode(text.terms(F.col("texte"))).alias("term"))  # numbered before it's exploded
    asked = rows.join(weights.select("term").distinct(), "term", "left_semi").groupBy("row", "cid", "delivered_at", "version", "term").agg(F.count(F.lit(1)).alias("n"))
    won = snapshots.held(read(spark, d, "articles").where(F.col("snapshot_no") == LATEST), {"version": digest("texte")}).select("cid", "delivered_at", "version")
    asked = asked.join(won, ["cid", "delivered_at", "version"], "left_semi")
    held = asked.groupBy("cid", "delivered_at", "version", "term").agg(F.max("n").alias("n")).select("cid", "term", "n")  # rows of one version have equal counts
    return annotation.term_shortlist(weights, cut(held))


def lexical_shortlist(spark: SparkSession, d: str) -> DataFrame:
    """The ten articles nearest to each golden question by terms: a term weighs thrice its occurrences in the question,
    plus its occurrences in the expected points, and counts per occurrence in the article."""
    return _term_shortlist(spark, d)


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of golden items: they cite the gold articles, of which those known to the last snapshot are retrieved."""
    gold = F.array_distinct(F.transform("gold_articles", lambda k: norm_key(k)))
    items = _golden(spark, d).select("id", "expected_state", F.filter(F.coalesce(gold, F.array().cast("array<string>")), lambda k: k.isNotNull()).alias("cited"))
    known = items.select("id", F.explode("cited").alias("cid")).join(_articles(spark, d).select("cid"), "cid", "left_semi").groupBy("id").agg(F.collect_set("cid").alias("retrieved"))
    refuses = F.col("expected_state").startswith("refus:")
    envelope = F.struct(
        F.when(refuses, "refus").otherwise("reponse").alias("type"), F.lit("…").alias("explanation"), F.transform("cited", lambda k: F.struct(k.alias("article_id"), F.lit("").alias("gloss"))).alias("fondement_juridique"),
        F.when(F.col("expected_state") == "reponse_sans_article", "…").alias("aucun_fondement"), F.when(refuses, F.substring("expected_state", 7, 99)).alias("motif"),
    )
    return items.join(known, "id", "left").select("id", "expected_state", envelope.alias("envelope"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"))


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    rows = _answers(spark, d)
    wrong = answers.fabricated(F.col("envelope"), F.col("retrieved"))
    fixed = answers.repair(F.col("envelope"), wrong)
    return rows.select(
        "id", answers.state(F.col("envelope")).alias("state"), (F.size(wrong) == 0).alias("citation_valid"), F.array_join(F.array_sort(wrong), ",").alias("fabricated"),
        F.array_join(F.array_sort(answers.cited(fixed)), ",").alias("shown"), F.coalesce(fixed["aucun_fondement"], F.lit("")).alias("note"),
    )


def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How the chunks cut earlier keep to the band: chunks per guide and words, over distinct rows."""
    rows = read(spark, d, "fiche_chunks").select("fiche_id", "chunk_id", "text").distinct().where("text IS NOT NULL")
    n = F.regexp_count("text", F.lit("[^ \\t\\n\\r]+"))
    return rows.withColumn("n", n).groupBy("fiche_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("n_words"), F.count_if(F.col("n") > gates.BAND).alias("n_over"), F.count_if(F.col("n") < gates.FLOOR).alias("n_under"))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.blocks(_articles(spark, d, "texteHtml"), "cid", "texteHtml")


def article_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.article_chunks(_articles(spark, d, "id", "citation_id", "sectionParentTitre", "texteHtml"))


def fiche_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.guide_chunks(current(read(spark, d, "fiches")))


def chunk_gate(spark: SparkSession, d: str) -> DataFrame:
    """Violations of the chunks of all held articles and current guides."""
    full = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")) + chunking.SPECIAL
    a = _articles(spark, d, "id", "citation_id", "sectionParentTitre", "texteHtml")
    f = current(read(spark, d, "fiches"))
    labels = F.when(F.col("chapitre_titre").isNotNull(), full(F.col("chapitre_titre"))).otherwise(0) + F.when(F.col("cas_label").isNotNull(), full(F.col("cas_label"))).otherwise(0)
    return gates.union(
        gates.chunk_gate(chunking.article_texts(a), chunking.article_chunks(a), "cid", full(F.col("text")), stub=F.col("is_stub")),
        gates.chunk_gate(chunking.guide_texts(f).where("text <> ''"), chunking.guide_chunks(f), "fiche_id", full(F.col("text")), labels=labels),
    )


def prompt_render(spark: SparkSession, d: str) -> DataFrame:
    """The contexts of every item, its guides' pieces in order and then the marker, as one prompt."""
    items = _golden(spark, d).select(F.col("id").alias("qid"), F.explode("gold_fiches").alias("fiche_id")).distinct()
    pieces = read(spark, d, "fiche_chunks").select("fiche_id", "chunk_index", "text", "chapitre_titre", "cas_label").where("text IS NOT NULL").distinct()
    rows = items.join(pieces, "fiche_id").withColumn("slot", F.row_number().over(Window.partitionBy("qid").orderBy("fiche_id", "chunk_index", "text", "chapitre_titre", "cas_label")))
    none = F.lit(None).cast("string")
    contexts = rows.select("qid", "slot", F.lit("fiche").alias("register"), none.alias("title"), "chapitre_titre", "cas_label", "text", none.alias("citation_id"), none.alias("breadcrumb"))
    marker = items.select("qid").distinct().select("qid", F.lit(1_000_000).alias("slot"), F.lit(search.MARKER).alias("register"), *(none.alias(c) for c in ("title", "chapitre_titre", "cas_label", "text", "citation_id", "breadcrumb")))
    return answers.render_contexts(contexts.unionByName(marker))


def annotation_progress(spark: SparkSession, d: str) -> DataFrame:
    """Golden items by state and tag, each item once."""
    return annotation.progress(_golden(spark, d))


def working_sets(spark: SparkSession, d: str) -> DataFrame:
    """Which evaluation sets every golden item of the working set belongs to."""
    items = _golden(spark, d).withColumnRenamed("turns", "history")
    one = lambda f, n: f(items).select("id", F.lit(n).alias("part"))
    return one(annotation.working_set, "all").unionByName(one(annotation.article_set, "articles")).unionByName(one(annotation.floor_set, "floor"))


def outside_sections(spark: SparkSession, d: str) -> DataFrame:
    """Gold articles that none of the sections of the item's guides holds."""
    items = _golden(spark, d).withColumn("gold_articles", F.array_compact(F.transform("gold_articles", lambda k: norm_key(k))))
    guides = guide_headers(current(read(spark, d, "fiches"))).select("fiche_id", "section_ids")
    shortlist = annotation.section_shortlist(items, guides, _articles(spark, d, "sectionParentId").select("cid", norm_key("sectionParentId").alias("section_id")))
    return annotation.outside_sections(items, shortlist)


def guide_headers_all(spark: SparkSession, d: str) -> DataFrame:
    """Headers of all current guides."""
    rows = guide_headers(current(read(spark, d, "fiches")))
    return rows.withColumn("section_ids", F.array_join("section_ids", ","))


QUERIES = {
    f.__name__: f
    for f in (
        lookup_keys, reference_sets, short_circuit_path, trimmed_history, condense_status, breadcrumbs, point_ids, article_gate, golden_gate, lexical_shortlist, citation_check,
        chunk_sizes, html_blocks, article_chunks, fiche_chunks, chunk_gate, prompt_render, annotation_progress, working_sets, outside_sections, guide_headers_all,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------

_KEY = r"CASE WHEN regexp_full_match(trim({0}), '[LRAD]\*?[\s\x{A0}]?\.?[\s\x{A0}]?\d+(-\d+)*') THEN translate(upper(trim({0})), ' .*', '') END"
_ITEMS = "golden AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY annotated_at DESC) AS rn FROM golden_set) WHERE rn = 1)"
_LAST = """last AS (SELECT * FROM (SELECT upper(trim(cid, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) AS cid, etat, citation_id, texte, fullSectionsTitre,
  row_number() OVER (PARTITION BY upper(trim(cid, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) ORDER BY delivered_at DESC) AS rn FROM articles WHERE snapshot_no = 6) WHERE rn = 1 AND etat = 'VIGUEUR')"""
_TURN = "CASE WHEN right(id, 1)::INT % 2 = 0 THEN question || ' (art. L. ' || right(id, 3)::INT || '-1)' ELSE question END"
_REF = r"regexp_extract({0}, '\b[LRAD]\*?\s?\.?\s?\d+(?:-\d+)*\b')"
_REF_BODY = r"\b[LRAD]\*?\s?\.?\s?\d+(?:-\d+)*\b"
_TERMS = "list_filter(regexp_extract_all(lower({0}), '[a-zà-ÿ0-9]+'), lambda t: length(t) >= 3)"

SQL = {
    "annotation_progress": f"""WITH {_ITEMS} SELECT 'all' AS kind, 'all' AS name, count(*) AS n FROM golden
UNION ALL SELECT 'state', expected_state, count(*) FROM golden GROUP BY expected_state
UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM golden) GROUP BY tag""",
    "working_sets": f"""WITH {_ITEMS}, w AS (SELECT * FROM golden WHERE coalesce(len(history), 0) = 0 AND (coalesce(len(gold_fiches), 0) > 0 OR coalesce(len(gold_articles), 0) > 0))
SELECT id, 'all' AS part FROM w UNION ALL SELECT id, 'articles' FROM w WHERE len(gold_articles) > 0 UNION ALL SELECT id, 'floor' FROM w WHERE expected_state = 'reponse_sans_article'""",
    "lookup_keys": f"WITH {_LAST} SELECT cid, citation_id, {_KEY.replace('{0}', 'citation_id')} AS lookup_key FROM last",
    "short_circuit_path": f"""WITH {_LAST}, {_ITEMS}, keys AS (SELECT DISTINCT {_KEY.replace('{0}', 'citation_id')} AS k FROM last),
turns AS (SELECT id, nullif(translate(upper({_REF.replace('{0}', _TURN)}), ' .*', ''), '') AS ref FROM golden)
SELECT id, CASE WHEN ref IS NULL THEN 'no_reference' WHEN k IS NULL THEN 'membership_failed' ELSE 'resolved' END AS path, k AS lookup_key FROM turns LEFT JOIN keys ON ref = k""",
    "condense_status": f"""WITH {_LAST}, {_ITEMS}, keys AS (SELECT DISTINCT {_KEY.replace('{0}', 'citation_id')} AS k FROM last),
t AS (SELECT id, question AS q, coalesce(len(history), 0) AS h, right(id, 1)::INT AS k FROM golden),
s AS (SELECT id, q, h, k, CASE WHEN k < 2 THEN NULL WHEN k < 4 THEN '  ' || q || ' ' WHEN k = 4 THEN q || ' (art. L999-9)' WHEN k = 5 THEN q || chr(10) || 'Voilà' ELSE q || ' en France' END AS said,
  nullif(translate(upper({_REF.replace('{0}', 'q')}), ' .*', ''), '') AS ref FROM t),
u AS (SELECT *, trim(said, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) AS x FROM s),
c AS (SELECT *, x IS NOT NULL AND length(x) BETWEEN 1 AND 300 AND NOT contains(x, chr(10)) AND len(list_filter(regexp_extract_all(x, '{_REF_BODY}'), lambda r: NOT list_contains(list_transform(regexp_extract_all(q, '{_REF_BODY}'), lambda y: translate(upper(y), ' .*', '')), translate(upper(r), ' .*', '')))) = 0 AS clean FROM u),
d AS (SELECT *, CASE WHEN h = 0 THEN 'skipped_no_history' WHEN ref IN (SELECT k FROM keys WHERE k IS NOT NULL) THEN 'skipped_short_circuit' WHEN said IS NULL THEN 'fallback_error' WHEN NOT clean THEN 'fallback_sanitizer'
  WHEN x = trim(q, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)) THEN 'passthrough' ELSE 'rewritten' END AS condense_status FROM c)
SELECT id, CASE WHEN condense_status = 'rewritten' THEN x ELSE q END AS query, condense_status FROM d""",
    "trimmed_history": f"""WITH {_ITEMS}, t AS (SELECT id, history[greatest(len(history) - 5, 1):] AS h FROM golden WHERE len(history) > 0)
SELECT id, (n - 1)::INT AS turn_no, h[n]['role'] AS role, left(h[n]['content'], 2000) AS content FROM (SELECT id, h, unnest(range(1, len(h) + 1)) AS n FROM t)""",
    "breadcrumbs": f"""WITH {_LAST} SELECT array_to_string(list_transform(string_split(fullSectionsTitre, '>')[2:], lambda p: trim(p)), ' > ') AS breadcrumb, count(*) AS n_articles FROM last GROUP BY 1""",
    "point_ids": f"""SELECT fiche_id, chunk_index, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 2))::INT & 63) | 128)) || substr(h, 19, 2) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT fiche_id, chunk_index, sha1(unhex('{ids.NAMESPACE.hex}') || encode(fiche_id || '#' || chunk_index)) AS h FROM (SELECT DISTINCT fiche_id, chunk_index FROM fiche_chunks WHERE fiche_id IS NOT NULL AND chunk_index IS NOT NULL))""",
    "article_gate": f"""WITH rows AS (SELECT DISTINCT nullif(upper(trim(cid, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), '') AS cid, etat, citation_id FROM articles WHERE snapshot_no = 6)
SELECT 'one version per article' AS "check", cid AS "key", count(*)::VARCHAR AS detail FROM rows WHERE cid IS NOT NULL GROUP BY cid HAVING count(*) > 1
UNION ALL SELECT 'in force', cid, etat FROM rows WHERE etat IS DISTINCT FROM 'VIGUEUR'
UNION ALL SELECT 'lookup keys unique', k, count(*)::VARCHAR FROM (SELECT {_KEY.replace('{0}', 'citation_id')} AS k FROM rows) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1
UNION ALL SELECT 'citation present', cid, NULL FROM rows WHERE coalesce(citation_id, '') = ''""",
    "lexical_shortlist": f"""WITH {_LAST}, {_ITEMS},
w AS (SELECT id, term, sum(w) AS w FROM (SELECT id, unnest({_TERMS.replace('{0}', 'question')}) AS term, 3 AS w FROM golden
  UNION ALL SELECT id, unnest({_TERMS.replace('{0}', "array_to_string(expected_points, ' ')")}), 1 FROM golden) GROUP BY 1, 2),
t AS (SELECT cid, term, count(*) AS n FROM (SELECT cid, unnest({_TERMS.replace('{0}', 'texte')}) AS term FROM last) GROUP BY 1, 2),
s AS (SELECT id, cid, sum(w * n)::BIGINT AS score FROM t JOIN w USING (term) GROUP BY 1, 2)
SELECT id, cid, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cid) AS rank FROM s) WHERE rank <= 10""",
    "chunk_sizes": r"""WITH c AS (SELECT DISTINCT fiche_id, chunk_id, text FROM fiche_chunks WHERE text IS NOT NULL), n AS (SELECT fiche_id, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS n FROM c)
SELECT fiche_id, count(*) AS n_chunks, sum(n)::BIGINT AS n_words, count(*) FILTER (n > 512) AS n_over, count(*) FILTER (n < 32) AS n_under FROM n GROUP BY 1""",
    "citation_check": f"""WITH {_LAST}, {_ITEMS},
c AS (SELECT id, expected_state, list_filter(list_distinct(list_transform(coalesce(gold_articles, []), lambda k: nullif(upper(trim(k, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), ''))), lambda k: k IS NOT NULL) AS cited FROM golden),
r AS (SELECT id, expected_state, cited, list_filter(cited, lambda k: NOT list_contains(l, k)) AS wrong FROM c, (SELECT list(cid) AS l FROM last))
SELECT id, CASE WHEN expected_state LIKE 'refus:%' OR expected_state = 'reponse_sans_article' THEN expected_state ELSE 'reponse' END AS state, len(wrong) = 0 AS citation_valid,
  array_to_string(list_sort(wrong), ',') AS fabricated, array_to_string(list_sort(list_filter(cited, lambda k: NOT list_contains(wrong, k))), ',') AS shown,
  CASE WHEN len(wrong) > 0 AND len(wrong) = len(cited) AND expected_state NOT LIKE 'refus:%' THEN '{answers.NO_BASIS.replace(chr(39), chr(39) * 2)}' WHEN expected_state = 'reponse_sans_article' THEN '…' ELSE '' END AS note FROM r""",
    "prompt_render": f"""WITH {_ITEMS}, f AS (SELECT DISTINCT id AS qid, unnest(gold_fiches) AS fiche_id FROM golden),
p AS (SELECT qid, concat_ws(' · ', nullif(chapitre_titre, ''), nullif(cas_label, '')) AS label, text,
  row_number() OVER (PARTITION BY qid ORDER BY fiche_id, chunk_index, text COLLATE "C", chapitre_titre COLLATE "C" NULLS FIRST, cas_label COLLATE "C" NULLS FIRST) AS slot
  FROM f JOIN (SELECT DISTINCT fiche_id, chunk_index, text, chapitre_titre, cas_label FROM fiche_chunks WHERE text IS NOT NULL) USING (fiche_id)),
g AS (SELECT qid, string_agg(CASE WHEN label <> '' THEN '— ' || label || chr(10) || text ELSE text END, chr(10) || chr(10) ORDER BY slot) AS body FROM p GROUP BY 1)
SELECT q.qid, concat_ws(chr(10) || chr(10), '{answers.FICHE_HEADING}' || chr(10) || chr(10) || body, '{answers.ARTICLE_HEADING}', '{answers.NO_BASIS}') AS context FROM (SELECT DISTINCT qid FROM f) q LEFT JOIN g USING (qid)""",
    "golden_gate": f"""WITH {_LAST}, g AS (SELECT id, expected_state AS s, coalesce(gold_fiches, []) AS f, coalesce(gold_spans, []) AS sp, [coalesce(nullif(upper(trim(k, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), ''), '') FOR k IN coalesce(gold_articles, [])] AS a,
  coalesce(expected_points, []) AS p, coalesce(tags, []) AS t, coalesce(len(history), 0) AS h, coalesce(len([x FOR x IN history IF x['role'] = 'assistant' AND contains(x['content'], 'fondement_juridique')]), 0) AS raw FROM golden_set),
fr AS (SELECT DISTINCT id, unnest(f) AS fiche_id FROM g), ar AS (SELECT DISTINCT id, unnest(a) AS cid FROM g), sr AS (SELECT DISTINCT id, unnest(sp) AS span FROM g)
SELECT 'ids unique' AS "check", id AS "key", count(*)::VARCHAR AS detail FROM g GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'id shape', id, NULL FROM g WHERE NOT regexp_full_match(id, 'gs-[0-9]+')
UNION ALL SELECT 'state known', id, s FROM g WHERE s IS NULL OR s NOT IN ('reponse', 'reponse_sans_article', 'refus:recommandation_produit', 'refus:conseil_action', 'refus:hors_corpus')
UNION ALL SELECT 'gold fiches resolve', id, fiche_id FROM fr WHERE fiche_id NOT IN (SELECT fiche_id FROM fiches)
UNION ALL SELECT 'gold articles resolve', id, cid FROM ar WHERE cid NOT IN (SELECT cid FROM last)
UNION ALL SELECT 'spans verbatim', id, span FROM sr WHERE NOT EXISTS (SELECT 1 FROM fr JOIN fiche_chunks c ON c.fiche_id = fr.fiche_id WHERE fr.id = sr.id AND contains(c.text, sr.span))
UNION ALL SELECT 'out of corpus has no gold', id, NULL FROM g WHERE s = 'refus:hors_corpus' AND len(f) + len(a) + len(sp) > 0
UNION ALL SELECT 'without article has no gold article', id, NULL FROM g WHERE s = 'reponse_sans_article' AND len(a) > 0
UNION ALL SELECT 'gold fiche needed', id, NULL FROM g WHERE s <> 'refus:hors_corpus' AND len(f) = 0
UNION ALL SELECT 'gold article needed', id, NULL FROM g WHERE s NOT IN ('refus:hors_corpus', 'reponse_sans_article') AND len(a) = 0
UNION ALL SELECT 'number of points', id, len(p)::VARCHAR FROM g WHERE CASE WHEN s = 'refus:hors_corpus' THEN len(p) > 0 ELSE len(p) NOT BETWEEN 1 AND 3 END
UNION ALL SELECT 'history stripped', id, NULL FROM g WHERE raw > 0
UNION ALL SELECT 'multi-turn tag', id, NULL FROM g WHERE list_contains(t, 'multi_turn') <> (h > 0)""",
}
