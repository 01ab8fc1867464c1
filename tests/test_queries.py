"""Every query of the core with SQL against DuckDB on the smallest data, where that is at hand."""

import os

import pytest

from lexweave.plans import registry

DATA = os.environ.get("LEXWEAVE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return c


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    try:
        return f"{float(v):.6f}"
    except (TypeError, ValueError):
        return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.SQL[name])
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_nodes_against_a_tree_parser(spark):
    """p2_found by another parser and recursion."""
    from xml.etree import ElementTree

    from lexweave.operators.records import FICHE_NODES, FICHE_PARTS

    newest = {}
    for r in spark.read.parquet(f"{DATA}/fiches.parquet").collect():
        if r.fiche_id not in newest or r.retrieved_at > newest[r.fiche_id].retrieved_at:
            newest[r.fiche_id] = r
    want = []
    for r in newest.values():
        try:
            root = ElementTree.fromstring(bytes(r.xml))
        except ElementTree.ParseError:
            continue
        n = 0

        def walk(e, parent, r=r):
            nonlocal n
            if e.tag in FICHE_NODES:
                n += 1
                want.append((r.fiche_id, n, parent, e.tag))
                parent = n
            for c in e:
                walk(c, parent)

        for part in root:
            if part.tag in FICHE_PARTS:
                walk(part, 0)
    assert sorted(tuple(r) for r in registry.QUERIES["p2_found"](spark, DATA).collect()) == sorted(want)


def test_references_against_plain_python(spark):
    """The fiches' part of p3_found, which SQL can't read."""
    import re
    from xml.etree import ElementTree

    lives = [(r.section_id.strip().upper(), r.valid_from, r.valid_to) for r in spark.read.parquet(f"{DATA}/sections.parquet").collect()]
    newest = {}
    for r in spark.read.parquet(f"{DATA}/fiches.parquet").collect():
        if r.fiche_id not in newest or r.retrieved_at > newest[r.fiche_id].retrieved_at:
            newest[r.fiche_id] = r
    want, dc = set(), "{http://purl.org/dc/elements/1.1/}"
    for r in newest.values():
        try:
            root = ElementTree.fromstring(bytes(r.xml))
        except ElementTree.ParseError:
            continue
        day = re.search(r"\d{4}-\d\d-\d\d", root.findtext(f"{dc}date") or "")
        for s in re.findall(r"LEGISCTA\d+", " ".join(e.text or "" for e in root.findall(f"{dc}source")).upper()):
            if day and not any(k == s and str(a) <= day[0] and (b is None or str(b) > day[0]) for k, a, b in lives):
                want.add(("fiches", day[0][:7], r.fiche_id, s))
    got = {tuple(r) for r in registry.QUERIES["p3_found"](spark, DATA).where("ref_table = 'fiches'").collect()}
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).columns


def test_lexical_shortlist_of_repeated_deliveries(spark, tmp_path):
    """Which text counts, and that no row is made per item and article, however common a term is."""
    from pyspark.sql import functions as F

    day = [F.to_timestamp(F.lit(f"2024-01-0{n}")) for n in (1, 2, 3)]
    article = lambda i, at, text, state="VIGUEUR": (f"A{i:02d}", at, state, text)
    told = [article(i, 1, "les délais " * (1 + i % 9)) for i in range(60)] + [article(3, 1, "les délais " * 4), article(5, 2, "les primes"), article(5, 0, "délais " * 99), article(7, 2, "délais", "ABROGE"), article(8, 2, None), (" a09 ", 2, "VIGUEUR", "Les Délais, les délais !")]
    rows = spark.createDataFrame(told, "cid string, at int, etat string, texte string").withColumn("delivered_at", F.when(F.col("at") == 0, day[0]).when(F.col("at") == 1, day[1]).otherwise(day[2]))
    rows.select("cid", "etat", "texte", "delivered_at", F.lit(6).alias("snapshot_no"), F.current_date().alias("snapshot_date")).write.parquet(f"{tmp_path}/articles.parquet")
    items = spark.range(30).select(F.format_string("gs-%03d", "id").alias("id"), F.lit("Les délais ?").alias("question"), F.array(F.lit("Les primes.")).alias("expected_points"), F.lit("reponse").alias("expected_state"), day[0].alias("annotated_at"))
    none = "array<string>"
    items.select("*", *(F.lit(None).cast(none).alias(c) for c in ("gold_fiches", "gold_spans", "gold_articles", "tags")), F.lit(None).cast("array<map<string,string>>").alias("history")).write.parquet(f"{tmp_path}/golden_set.parquet")
    n = {i: (4 + 3) * (1 + i % 9) for i in range(60)} | {5: 5, 7: 0, 8: 0, 9: 14}
    best = sorted((-s, f"A{i:02d}") for i, s in n.items() if s)[:10]
    got = registry.QUERIES["lexical_shortlist"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"gs-{i:03d}", c, -s, k) for i in range(30) for k, (s, c) in enumerate(best, 1))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
