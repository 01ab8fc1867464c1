import datetime as dt

from conftest import rows

from lexweave.operators import records
from lexweave.sources.xmltree import parse

T = dt.datetime(2024, 1, 1)
DOC = """<?xml version="1.0"?><P xmlns:d="http://purl.org/dc/elements/1.1/" ID="F1"><d:source>LEGISCTA1</d:source><Nav><Chapitre><Titre>no</Titre></Chapitre></Nav>
<Texte><!-- <Chapitre/> --><Chapitre a="1"><Titre>One</Titre>text <BlocCas><Cas><Titre>in</Titre></Cas><Cas/></BlocCas></Chapitre><Chapitre/></Texte>
<ListeSituations><Situation><Titre>S</Titre><Texte>t</Texte></Situation></ListeSituations></P>"""


def fiches(spark, *docs):
    return spark.createDataFrame([(k, x.encode() if isinstance(x, str) else x, T + dt.timedelta(hours=h), "clash") for k, x, h in docs], "fiche_id string, xml binary, retrieved_at timestamp, label string")


def test_nodes_and_links(spark):
    found = records.fiche_nodes(fiches(spark, ("F1", DOC, 0))).orderBy("node_no").collect()
    assert [(r.node_no, r.parent_no, r.node_tag) for r in found] == [(1, 0, "Chapitre"), (2, 1, "BlocCas"), (3, 2, "Cas"), (4, 2, "Cas"), (5, 0, "Chapitre"), (6, 0, "ListeSituations"), (7, 6, "Situation")]
    assert found[0].title == "One" and found[0].content == "text" and found[0].attributes == {"a": "1"}
    assert found[3].label == [1, 1, 2] and found[3].parent_label == [1, 1] and found[3].schema_path == "Chapitre/BlocCas/Cas"
    assert sorted(found, key=lambda r: r.label) == found  # labels sort in document order


def test_current_document_counts_even_if_broken(spark):
    t = fiches(spark, ("F1", DOC, 0), ("F1", "<P><Texte>", 1), ("F2", "<P>", 0), ("F2", DOC, 1), ("F2", DOC, 1), ("F3", None, 0), (None, DOC, 0))
    assert {r.doc_key for r in records.fiche_nodes(t).collect()} == {"F2"}


def test_encodings_and_depth(spark):
    deep = "<P><Texte>" + "<Cas>" * 3000 + "</Cas>" * 3000 + "</Texte></P>"
    utf16 = ('<?xml version="1.0" encoding="UTF-16"?>' + DOC.split("?>", 1)[1]).encode("utf-16")
    latin = ('<?xml version="1.0" encoding="ISO-8859-1"?><P><Texte><Chapitre><Titre>é</Titre></Chapitre></Texte></P>').encode("latin-1")
    t = fiches(spark, ("A", deep, 0), ("B", utf16, 0), ("C", latin, 0), ("D", b"\xef\xbb\xbf" + DOC.encode(), 0), ("E", "<a:P/>", 0))
    found = rows(records.fiche_nodes(t, content=True).groupBy("doc_key").count())
    assert found == [("A", 3000), ("B", 7), ("C", 1), ("D", 7)]


def test_tables(spark, tmp_path):
    nodes = records.fiche_nodes(fiches(spark, ("F1", DOC, 0)))
    assert rows(records.table(nodes, "Chapitre", ["a"]).select("node_no", "a")) == [(1, "1"), (5, None)]
    assert ("Chapitre/BlocCas/Cas", "Chapitre/BlocCas", 2, 1, 1, 0) in rows(records.table_summary(nodes))
    records.write_tables(nodes, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("table = 'Chapitre.BlocCas'").count() == 1
    assert records.fiche_nodes(fiches(spark)).count() == 0


def test_headers_only():
    doc = parse(DOC.encode(), content=False)
    assert doc.headers == {"source": ["LEGISCTA1"]} and doc.root == {"ID": "F1"} and parse(b"<x") is None and parse(None) is None
