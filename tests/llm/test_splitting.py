import datetime as dt
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("lexweave.llm")
from lexweave.llm import splitting as s  # noqa: E402

WORDS = lambda t: re.findall(r"[^ \t\n\r]+", t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=0, max_size=900), st.integers(4, 60), st.integers(0, 3))
def test_pieces_cover_everything(strengths, limit, overlap):
    seps = {0: " ", 1: ", ", 2: ". A", 3: "\n"}
    text = "".join(f"w{i}{seps[x]}" for i, x in enumerate(strengths))
    found = s.split_text(text, limit, overlap)
    words = WORDS(text)
    assert [w for p in found for w in WORDS(p[5])[p[2] :]] == words
    assert all(p[3] == len(WORDS(p[5])) <= limit for p in found)
    assert all(p[2] == (0 if i == 0 else min(overlap, p[0])) for i, p in enumerate(found))
    assert len(found) == 1 if 0 < len(words) <= limit else True


def test_cuts_at_the_strongest_place_near_the_middle():
    text = " ".join(f"w{i}" for i in range(40)) + "\n" + " ".join(f"x{i}" for i in range(60))
    found = s.split_text(text, 70, 4)
    assert [(p[0], p[1], p[4]) for p in found] == [(0, 40, "start"), (40, 100, "block")]
    assert found[1][5].startswith("w36") and found[1][3] == 64
    assert s.bisect(np.zeros(1000, np.int8), 480) == [0, 250, 500, 750]


def test_sentence_and_blocks_of_html():
    html = "<p>" + "mot " * 30 + "fin.</p><table><tr><td>" + "x " * 500 + "</td></tr></table>" + "mot " * 30 + "Fin&nbsp;!<br>" + "Un " * 30
    found = s.split_text(s.read_html(html), 40, 2)
    assert sum(p[1] - p[0] for p in found) == 31 + 31 + 30 and {p[4] for p in found} >= {"start", "block"}
    assert "x" not in found[0][5] and "Fin\u00a0!" in "".join(p[5] for p in found)


def test_no_fragment_is_estimated_too_low(spark):
    """The bound that keeps fragments from the exact count never has fewer words than it."""
    parts = ["<p>", "</p>", "<table>", "</table>", "a b ", "c", "<a title='x > y'>", "<a <b>", "< d", "&nbsp;", "&#32;", "&eacute;", "<!-- e -->", "<!-- <table> -->", '<a title="<table>">', "<TABLE class=x>", "<br/>", " f", '"', "<i"]
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(parts, rng.integers(1, 25))) for _ in range(1500)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_count(s._html_words_at_most(F.col("t")), F.lit("[^ \t\n\r]+")).alias("n"))
    for t, n in df.collect():
        assert n >= len(WORDS(s.read_html(t).replace("\x00", " "))), t


def test_self_closed_tables_hide_nothing(spark):
    from pyspark.sql import functions as F

    tags = ["<table />", '<table class="x"/>', "<TABLE a=b / >", "<table a='1' /\u00a0>", '<table a=">" />', "<table\n/>"]
    texts = [f"<p>a</p>{t} b c d<table><tr><td>no</td></tr></table> e" for t in tags]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_count(s._html_words_at_most(F.col("t")), F.lit("[^ \t\n\r]+")).alias("n"))
    for t, n in df.collect():
        assert n >= len(WORDS(s.read_html(t).replace("\x00", " "))) == 5, t
    plain = spark.createDataFrame([('<table class="x/"><tr><td>a b c</td></tr></table>',)], "t string")
    assert plain.select(F.regexp_count(s._html_words_at_most(F.col("t")), F.lit("[a-z]+"))).first()[0] == 0


def test_texte_of_a_guide():
    xml = "<P><Introduction><Texte>no</Texte></Introduction><Texte><Paragraphe>a<!-- no -->b <MiseEnEvidence>c</MiseEnEvidence></Paragraphe><![CDATA[<d>]]></Texte></P>".encode()
    assert WORDS(s.read_texte(xml).replace("\x00", " ")) == ["ab", "c", "<d>"]
    assert s.read_texte(b"<P>") is None


def test_bad_limits_and_edges():
    with pytest.raises(ValueError):
        s.split_text("a", 5, 5)
    assert s.split_text("", 5, 1) == [] and s.split_text(" \n", 5, 1) == []
    assert [p[3] for p in s.split_text("x" * 100_000, 5, 1)] == [1]
    assert len(s.split_text("a\x00b " * 20, 5, 1)[0][5]) > 0


def test_every_text_under_one_chunk_id_is_an_item(spark):
    """Two oversized texts and a greater short one: both are cut, with a limit or without."""
    rows = [("c", "a " * 600), ("c", "b " * 700), ("c", "z z"), ("c", "a " * 600)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    assert sorted(len(r.body) for r in s.chunk_items(df, 512).collect()) == [1200, 1400]
    cut = lambda limit: sorted((r.n_pieces, r.n_words) for r in s.pieces(s.chunk_items(df, limit), "text").where("n_pieces > 1").collect())
    assert cut(512) == cut(0) and len(cut(0)) == 4


def test_corpus(spark):
    t = dt.datetime(2024, 1, 1)
    long = "<p>" + "mot " * 513 + "</p>"
    articles = spark.createDataFrame(
        [(6, t, " a1 ", long, "VIGUEUR", "k"), (6, t, "A1", long, "VIGUEUR", "k"), (6, t, "A2", "<p>" + "m " * 512 + "</p>", "VIGUEUR", "k"), (6, t, "A3", long, "ABROGE", "k"), (5, t, "A4", long, "VIGUEUR", "k"),
         (6, t, "A5", "mot " * 300 + "<table>" + "x " * 999 + "</table>", "VIGUEUR", "k"), (6, t, "A6", None, "VIGUEUR", "k"), (6, t, "A7", "a&#32;b " * 257, "VIGUEUR", "k"), (6, t, "A8", "<i>a</i>" * 513, "VIGUEUR", "k"), (6, t, None, long, "VIGUEUR", "k")],
        "snapshot_no int, delivered_at timestamp, cid string, texteHtml string, etat string, body string",
    )
    fiches = spark.createDataFrame([("F1", bytearray(("<P><Texte>" + "<a>m</a>" * 600 + "</Texte></P>").encode()), t), ("F2", bytearray(b"<P>"), t), ("F3", None, t)], "fiche_id string, xml binary, retrieved_at timestamp")
    chunks = spark.createDataFrame([("c#0", "w\t" * 600, 3), ("c#0", "w\t" * 600, 3), ("c#1", "w w", 900), ("c#2", None, None), (None, "w " * 600, 1)], "chunk_id string, text string, tokens int")
    found = s.corpus_pieces(articles, fiches, chunks)
    assert sorted((r.item_kind, r.item_key) for r in found.where("piece_no = 1").collect()) == [("article", "A1"), ("article", "A7"), ("article", "A8"), ("chunk", "c#0"), ("fiche", "F1")]
    assert found.where("n_words > 512").count() == 0
    assert s.corpus_pieces(articles.limit(0), fiches.limit(0), chunks.limit(0)).count() == 0
