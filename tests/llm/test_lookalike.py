import datetime as dt
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("lexweave.llm")
from lexweave.llm import lookalike as k  # noqa: E402

SAME = [("l’été", "l'été"), ("ａｒｔ．　１", "art. 1"), ("a​b­﻿", "ab"), ("a  b\t", "a b"), ("fin ﬁn", "fin fin"), ("сохо", "coxo"), ("Ρos‑t", "Pos-t"), ("е́", "é"), ("𝐚", "a"), ("Ⅳ", "IV"), ("ß", "β")]
#: Letters of the public table, and what they look like.
PUBLIC = {"Ꭺ": "A", "ꓮ": "A", "ꓐ": "B", "Ӏ": "I", "Ϲ": "C", "ϲ": "c", "ı": "i", "ρ": "p", "ᴏ": "o", "ⲟ": "o", "−": "-", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϳ": "j", "օ": "o", "ս": "u", "ո": "n", "ɡ": "g", "ɑ": "a"}
OTHER = [("m²", "m2"), ("Art", "art"), ("e", "é"), ("a b", "ab"), ("a.", "a"), ("œ", "oe"), ("1", "l"), ("0", "O"), ("n°", "no"), ("½", "1/2"), ("a–b", "a-b"), ("«a»", '"a"'), ("З", "3"), ("Ь", "b"), ("×", "x"), ("١", "l"), ("ª", "a"), ("ʰ", "h"), ("ø", "o"), ("đ", "d"), ("ſ", "f"), ("…", "...")]


@pytest.fixture(scope="module")
def form(spark):
    table = k.prototypes(spark)
    return lambda text: k.skeleton(text, table)


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other_look(form, a, b):
    assert form(a) != form(b)


def test_public_table(spark, form):
    assert {c: form(c) for c in PUBLIC} == PUBLIC
    table = k.letters(spark)
    assert len(table) > 1000 and all(ord(p) not in table and p.isalpha() for p in k.prototypes(spark).values() if p and p in table.values())
    assert all(form(chr(c)) == chr(c) for c in range(0x21, 0x7F)) and not [c for c in range(0xA1, 0x100) if c in table]


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=40))
def test_skeleton_is_stable(form, text):
    once = form(text)
    assert form(once) == once and unicodedata.is_normalized("NFC", once)


def test_both_paths_agree(spark, form):
    texts = [a for p in SAME + OTHER for a in p] + ["", "  ", "déjà  vu\nici", "l’œuvre à 3 m² — «oui»", "x" * 200_000, "&eacute;"]
    df = k.with_form(spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string"), "t", "f")
    for t, f in df.collect():
        assert f == (None if t is None else form(t)), t


def test_twins_against_brute_force(spark, form, monkeypatch):
    data = [("c1", "l'été"), ("c2", "l’été"), ("c3", "l'été"), ("c4", "l'été"), ("c5", "L'été"), ("c6", None), (None, "l'été"), ("c2", "l’été"), ("c7", "été"), ("c8", "")]
    want = sorted({(a, b) for a, x in data for b, y in data if a and b and a < b and x is not None and y is not None and x != y and form(x) == form(y)})
    df = spark.createDataFrame([(a, b, "z") for a, b in data], "chunk_id string, text string, form string")
    members = k.classes(df, "chunk_id", "text")
    assert sorted(tuple(r) for r in k.twins(members).collect()) == want
    monkeypatch.setattr(k, "SHARE", 2)  # a class divided among tasks
    assert sorted(tuple(r) for r in k.twins(members).collect()) == want
    assert k.twins(k.classes(df.limit(0), "chunk_id", "text")).count() == 0
    mixed = members.where("n_originals > 1").collect()
    assert sorted(r.key for r in mixed) == ["c1", "c2", "c3", "c4"] and {(r.n_keys, r.n_originals) for r in mixed} == {(4, len({x for c, x in data if c in ("c1", "c2", "c3", "c4")}))}
    pairs = k.representatives(members).collect()
    assert {x for r in pairs for x in ((r.key_a, r.n_a), (r.key_b, r.n_b))} == {(min(c for c, y in data if c and y == x), len({c for c, y in data if c and y == x})) for c, x in data if c in ("c1", "c2", "c3", "c4")}


def test_a_class_gives_one_pair_per_other_original(spark):
    """A hundred copies in each of three spellings: two representative pairs."""
    df = spark.createDataFrame([(f"{i}{j}", t) for i, t in enumerate(["l'été", "l’été", "l'é té".replace(" ", "\u200b")]) for j in range(100)], "chunk_id string, text string")
    members = k.classes(df, "chunk_id", "text")
    assert members.count() == 300 and k.representatives(members).count() == 2 and k.twins(members).count() == 30_000


def test_articles(spark):
    t = dt.datetime(2024, 1, 1)
    texts = {"a": ("<p>l'été</p>", "<p>l’été</p>"), "tags": ("<p>x</p>", "<div class='y'>x</div>"), "ref": ("<p>é</p>", "<p>&eacute;</p>"), "word": ("<p>a</p>", "<p>b</p>"), "null": ("<p>a</p>", None), "blank": ("<p>a b</p>", "<p>a  b</p>"), "table": ("<table><td>a b</td></table>", "<table><td>a b</td></table>")}
    rows = [(n, dt.date(2024, n, 1), t, c, "VIGUEUR", x[n - 1]) for c, x in texts.items() for n in (1, 2)] + [(3, dt.date(2024, 3, 1), t, "a", "ABROGE", "<p>l'été</p>"), (4, dt.date(2024, 4, 1), t, "a", "VIGUEUR", "<p>l'été</p>")]
    df = spark.createDataFrame(rows, "snapshot_no int, snapshot_date date, delivered_at timestamp, cid string, etat string, texteHtml string")
    assert sorted(r.key_a for r in k.article_twins(df).collect()) == ["A#1", "BLANK#1", "REF#1", "TABLE#1"]


def test_forms_of_all_texts(spark):
    articles = [(1, "a ", "<p>l’été</p><p>x&eacute;</p>"), (1, "A", "<p>l’été</p><p>x&eacute;</p>"), (1, "a", "<p>late</p>"), (2, "a", "<table><td>ｂ</td></table>"), (2, "old", "<p>abrogé</p>"), (3, "a", None)]
    chunks = [("c", "l’été"), ("c", "l’été"), ("c", "a  b"), ("d", None)]
    df = k.corpus_forms(spark.createDataFrame(articles, "snapshot_no int, cid string, texteHtml string"), spark.createDataFrame(chunks, "chunk_id string, text string"))
    want = [("articles", "A#1", "l'été xé"), ("articles", "A#1", "late"), ("articles", "A#2", "b"), ("articles", "A#3", None), ("articles", "OLD#2", "abrogé"), ("fiche_chunks", "c", "a b"), ("fiche_chunks", "c", "l'été"), ("fiche_chunks", "d", None)]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == sorted(want, key=repr) and df.columns == ["text_table", "key", "form"]
