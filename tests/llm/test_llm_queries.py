import os

import pytest

pytest.importorskip("lexweave.llm")
from lexweave.llm import queries  # noqa: E402

DATA = os.environ.get("LEXWEAVE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def test_articles_found_against_the_standard_parser(spark):
    """p1_found by the standard library's HTML parser over all articles of the last snapshot."""
    import re
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.out.append(" ")
            self.depth += tag == "table"

        def handle_endtag(self, tag):
            self.out.append(" ")
            self.depth -= tag == "table" and self.depth > 0

        def handle_data(self, data):
            self.out.append("" if self.depth else data)

    newest = {}
    for r in spark.read.parquet(f"{DATA}/articles.parquet").where("snapshot_no = 6").collect():
        k = r.cid.strip().upper()
        if k not in newest or r.delivered_at > newest[k].delivered_at:
            newest[k] = r
    want = set()
    for k, r in newest.items():
        if r.etat == "VIGUEUR" and r.texteHtml:
            reader = Reader()
            reader.feed(r.texteHtml)
            reader.close()
            if len(re.findall(r"[^ \t\n\r]+", "".join(reader.out))) > 512:
                want.add(k)
    assert {r.item_key for r in queries.QUERIES["p1_found"](spark, DATA).where("item_kind = 'article'").collect()} == want


def test_forms_of_both_tables(spark):
    """p4_forms has a form for every text delivered."""
    got = {(r.text_table, r.key) for r in queries.QUERIES["p4_forms"](spark, DATA).where("form IS NOT NULL").collect()}
    want = {("articles", f"{r.cid.strip().upper()}#{r.snapshot_no}") for r in spark.read.parquet(f"{DATA}/articles.parquet").where("texteHtml IS NOT NULL").collect()}
    assert got == want | {("fiche_chunks", r.chunk_id) for r in spark.read.parquet(f"{DATA}/fiche_chunks.parquet").where("text IS NOT NULL").collect()}
