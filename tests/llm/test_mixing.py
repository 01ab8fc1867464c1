import numpy as np
import pytest

pytest.importorskip("lexweave.llm")
from lexweave.llm import mixing as m  # noqa: E402
from lexweave.llm import tokens  # noqa: E402


def test_thresholds_invert_the_poisson_distribution():
    rng = np.random.default_rng(1)
    u = rng.random(200_000)
    n = (u[:, None] > m._below(1.7, 30)[None, :]).sum(1)
    assert abs(n.mean() - 1.7) < 0.02 and abs(n.var() - 1.7) < 0.03
    assert (u[:, None] > m._below(50.0, 4)[None, :]).sum(1).max() == 4


def test_rates_meet_targets_and_caps():
    hist = {s: np.full(m.BINS, w) for s, w in (("a", 10.0), ("b", 1.0), ("c", 5.0), ("none", 0.0))}
    got = m.rates(hist, {"a": 0.5, "b": 0.3, "none": 0.1, "d": 0.1}, {"a": 2, "b": 3, "none": 2, "d": 2})
    assert set(got) == {"a", "b"}
    for s, cap in (("a", 2), ("b", 3)):
        assert m._drawn(hist[s], got[s][0], cap) == pytest.approx(got[s][1], rel=1e-6)
    assert got["a"][1] / got["b"][1] == pytest.approx(5 / 3)
    assert m.rates({}, {"a": 1.0}, {"a": 1}) == {}


def test_mix(spark):
    try:
        tokens.counter(tokens.DEFAULT)
    except OSError:
        pytest.skip("no vocabulary here")
    docs = [(i, "un mot de plus " * (1 + i % 5), [" Big", "big", "SMALL "][i % 3]) for i in range(3000)] + [(9001, None, "big"), (9002, "", "big"), (9003, "x", None), (9004, "x", "other"), (None, "x", "big"), (1, "un", "big")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, source string, tokens int")
    t = spark.createDataFrame([("big", 0.4, 2), ("small", 0.5, 3), ("absent", 0.1, 2), (None, 0.1, 2)], "source string, target_share double, max_repeats int")
    shares = {r.source: r for r in m.shares(d, t).collect()}
    assert shares["big"].actual_share == pytest.approx(4 / 9, abs=0.01) and shares["small"].actual_share == pytest.approx(5 / 9, abs=0.01)
    assert shares["absent"].n_tokens == 0 and shares["big"].most_copies <= 2 and shares["small"].most_copies <= 3
    mix = m.mix(d, t)
    rows = mix.collect()
    assert [r.place for r in rows] == sorted(r.place for r in rows) and {r.source for r in rows} == {"big", "small"}
    assert sum(r.tokens for r in rows) == shares["big"].n_tokens + shares["small"].n_tokens
    assert rows == m.mix(d.repartition(7), t).collect()
    assert m.mix(d.limit(0), t).count() == 0 and m.mix(d, t.limit(0)).count() == 0
