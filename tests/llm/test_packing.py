import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("lexweave.llm")
from lexweave.llm import packing as p  # noqa: E402


def lay(histogram, capacity):
    matches, opened = p.sweep(histogram, capacity)
    load, ranks = {}, {s: set() for s in histogram}
    for m in matches:
        for j in range(m.number):
            c = m.container + j // m.each
            load[c] = load.get(c, 0) + m.size
            assert m.first + j not in ranks[m.size]
            ranks[m.size].add(m.first + j)
    assert {s: len(r) for s, r in ranks.items()} == histogram and all(r == set(range(len(r))) for r in ranks.values())
    assert all(v <= capacity for v in load.values()) and set(load) == set(range(opened))
    return opened


def best_fit_decreasing(histogram, capacity):
    gaps = []
    for s in sorted(histogram, reverse=True):
        for _ in range(histogram[s]):
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - s)
            else:
                gaps.append(capacity - s)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_as_good_as_best_fit_one_by_one(histogram):
    assert lay(histogram, 40) == best_fit_decreasing(histogram, 40)


def test_sizes_are_checked():
    assert p.sweep({}, 10) == ([], 0)
    with pytest.raises(ValueError):
        p.sweep({11: 1}, 10)
    with pytest.raises(ValueError, match="capacity"):
        p.sweep({1: 1}, p.MOST + 1)


def test_all_sizes_at_the_greatest_capacity():
    matches, opened = p.sweep({s: 3 for s in range(1, p.MOST + 1)}, p.MOST)
    assert opened == -(-3 * sum(range(1, p.MOST + 1)) // p.MOST) and len(matches) < 4 * p.MOST


def test_counts_are_those_of_the_lists():
    from lexweave.llm import tokens

    try:
        of = tokens.counter(tokens.DEFAULT)
    except OSError:
        pytest.skip("no vocabulary here")
    assert [of(t) for t in ("", "un mot", "<|endoftext|>")][:2] == [0, 2] and of("<|endoftext|>") > 1


def test_pack_ranks_hot_sizes_in_parts(spark, monkeypatch):
    monkeypatch.setattr(p, "RUN", 50)
    rng = random.Random(3)
    items = [(i, 1, 7 if i % 3 else rng.randrange(1, 20)) for i in range(700)] + [(5, 1, 7)]
    got = p.pack(spark.createDataFrame(items, "doc_id long, part_no int, tokens int"), capacity=20)
    loads = {}
    for c, _, _, s in got.collect():
        loads[c] = loads.get(c, 0) + s
    assert got.count() == len(items) and max(loads.values()) <= 20
    hist = {}
    for _, _, s in items:
        hist[s] = hist.get(s, 0) + 1
    assert len(loads) == best_fit_decreasing(hist, 20)
    assert p.fill(got, capacity=20).first().n_items == len(items)


def test_documents(spark):
    from lexweave.llm import tokens

    try:
        of = tokens.counter(tokens.DEFAULT)
    except OSError:
        pytest.skip("no vocabulary here")
    texts = [(1, "un mot"), (2, None), (3, ""), (4, "un mot " * 4000), (5, "x")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, tokens int")
    items = p.sized(docs)
    assert items.where("doc_id = 4").agg({"tokens": "sum"}).first()[0] == of(texts[3][1])
    assert {r.doc_id for r in items.collect()} == {1, 4, 5} and items.where("tokens > 2048 OR (part_no < n_parts AND tokens < 2048)").count() == 0
    assert p.fill(p.pack(items)).first().fullest <= 2048
    assert p.pack(items.limit(0)).count() == 0 and p.fill(p.pack(items.limit(0))).first().n_containers == 0
