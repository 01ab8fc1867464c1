import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lexweave.llm")
from lexweave.llm import subjects as s  # noqa: E402

TERMS = {"auto": "moteur volant pneu phare frein".split(), "mer": "voile ancre marin port quille".split(), "loi": "juge greffe avocat appel tribunal".split()}
FILLER = "le contrat prévoit une somme que la partie verse dans les délais".split()


def sentence(rng, term=None):
    words = rng.choices(FILLER, k=8)
    if term:
        words.insert(rng.randrange(8), term)
    return " ".join(words).capitalize() + "."


def paragraph(rng, subject=None, passing=None, n=4):
    out = [sentence(rng, rng.choice(TERMS[subject]) if subject else None) for _ in range(n)]
    return " ".join(out + ([sentence(rng, rng.choice(TERMS[passing]))] if passing else []))


def corpus(n=400, seed=2):
    rng, docs, truth = random.Random(seed), [], []
    for i in range(n):
        chosen = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 2]))
        parts = [paragraph(rng, c, rng.choice([None, None, *(x for x in TERMS if x not in chosen)])) for c in chosen] + [paragraph(rng)]
        rng.shuffle(parts)
        text = "\n\n".join(parts)
        docs.append((i, text.upper() if i % 11 == 0 else text))
        truth += [(i, c) for c in chosen]
    return docs, truth


def encoded(*texts):
    return s.encode_texts(pa.array(texts, pa.string()))


def vocabulary(*words):
    return s.Vocabulary(np.sort(np.array([s.code(w) for w in words], np.int32)))


def test_encoding_reads_sentences_and_paragraphs():
    flat, lengths = encoded("L'Été, 3 fois. Oui !\n \nDEJA déjà", "", " \n\n ")
    assert flat[: lengths[0]].tolist() == [s.code("ete"), s.code("fois"), -1, s.code("oui"), -1, -2, s.code("deja"), s.code("deja"), -2]
    known = vocabulary("ete", "deja")
    cells, n = s.lay_out(flat, lengths, known)
    ete, deja = known.places(np.array([s.code("ete"), s.code("deja")], np.int32))
    assert cells.tolist() == [ete, -1, -2, deja, deja, -2] and n.tolist() == [6, 0, 0]
    w = s.words_of(cells, n)
    assert w.sent.tolist() == [0, 2, 2] and w.par_of.tolist() == [0, 0, 1] and w.doc_of.tolist() == [0, 0]


def test_numbers_travel_as_binary():
    cells, n = np.array([4, -2, 7, 8, -2], np.int32), np.array([2, 0, 3])
    column = s._binary(cells, n)
    assert column.to_pylist()[1] == b"" and [x.tolist() for x in s._numbers(column)] == [cells.tolist(), n.tolist()]
    assert [x.tolist() for x in s._numbers(column.slice(1, 2))] == [[7, 8, -2], [0, 3]]
    assert list(s._blocks(np.array([5, 5, 50, 1, 1]), 10)) == [(0, 2), (2, 3), (3, 5)]


def test_a_word_that_shares_a_slot_is_not_taken_for_another():
    known = s.Vocabulary(np.array([3, 7, 3 + s.SLOTS], np.int32))
    assert known.places(np.array([3, 7, 3 + s.SLOTS, 3 + 2 * s.SLOTS, 8], np.int32)).tolist() == [0, 1, 2, -1, -1]
    assert s.Vocabulary(np.empty(0, np.int32)).places(np.array([3], np.int32)).tolist() == [-1]


def test_paragraphs_without_frequent_words_have_no_language():
    known = vocabulary("moteur", "le", "the")
    cells, n = s.lay_out(*encoded("Le moteur.\n\nThe moteur.\n\nMoteur."), known)
    assert [s.LANGUAGES[i] for i in s.languages_of(s.words_of(cells, n), known)] == ["fr", "en", "other"]


def test_pairs_leave_frequent_words_out():
    at, numbers = s.pair_numbers(encoded("La clause bénéficiaire. Le contrôle de la technique")[0])
    assert at.tolist() == [1] and numbers.tolist() == [s.pair_numbers(encoded("clause beneficiaire")[0])[1][0]]


def test_unevenness():
    u = s.unevenness(np.array([[40.0, 0, 0], [20, 20, 20], [1, 1, 0]]))
    assert u[0] > 0.9 and u[1] < 0.1 and u[2] == 0


def test_sums_do_not_depend_on_batches():
    """Every term of a paragraph with a subject adds to its row, however even it is in the batch."""
    docs, truth = corpus(200)
    rng = random.Random(5)
    texts = ["\n\n".join(paragraph(rng, c).replace(".", " commun.") for c in sorted({c for d, c in truth if d == i})) for i, _ in docs]
    known = s.vocabulary_of(texts, [], 1)
    cells, lengths = s.lay_out(*encoded(*texts), known)
    names, n = sorted(TERMS), np.bincount(cells[cells >= 0], minlength=len(known))
    labels = [[names.index(c) for j, c in truth if j == i] for i, _ in docs]
    model = s.first_model(s.words_of(cells, lengths), labels, known, np.log(len(docs) * 9 / np.maximum(n, 1)).astype(np.float32), len(names), rank=8)
    whole = s.gather(s.words_of(cells, lengths), model)
    at = known.places(np.array([s.code("commun")], np.int32))[0]
    assert whole.counts[at].max() < 0.5 * whole.counts[at].sum() and np.abs(whole.terms[at]).sum() > 0
    ends = np.concatenate([[0], np.cumsum(lengths)])
    parts = [s.gather(s.words_of(cells[ends[i] : ends[i + 20]], lengths[i : i + 20]), model) for i in range(0, len(docs), 20)]
    assert np.allclose(sum(p.counts for p in parts), whole.counts)
    assert np.allclose(sum(p.terms for p in parts), whole.terms, atol=1e-2)


def test_sums_by_group():
    rng = np.random.default_rng(1)
    table = rng.normal(size=(50, 4)).astype(np.float32)
    group = np.sort(np.concatenate([rng.integers(0, 30, 200), np.full(300, 7)]))
    row = rng.integers(0, 50, len(group))
    want = np.zeros((31, 4))
    np.add.at(want, group, table[row])
    assert np.allclose(s._sums(table, row, group, 31), want, atol=1e-3)
    assert s._sums(table, row[:0], group[:0], 2).tolist() == np.zeros((2, 4)).tolist()


def test_tasks_are_added_up(spark):
    """Slices of more tasks than there are buckets."""
    total = np.arange(2 * s.SLICE + 2, dtype=float)[:, None] * np.ones(3)

    def run(batches):
        for batch in batches:
            for _ in range(batch.num_rows):
                yield from s._parts(total)

    parts = spark.range(0, 6, 1, 6).mapInArrow(run, s.CELLS)
    for buckets in (2, 1024):
        s.BUCKETS, kept = buckets, s.BUCKETS
        assert np.allclose(s.add_up(parts, len(total), 3), 6 * total)
        s.BUCKETS = kept


def test_term_sums_by_matrices():
    rng = np.random.default_rng(1)
    z = rng.normal(size=(2 * s.PARAGRAPHS + 5, 4)).astype(np.float32)
    par, term = np.sort(rng.integers(0, len(z), 50_000)), rng.integers(0, 2 * s.FREQUENT, 50_000)
    want = np.zeros((2 * s.FREQUENT, 4))
    np.add.at(want, term, z[par])
    assert np.allclose(s._term_sums(z, par, term, 2 * s.FREQUENT), want, atol=1e-3)
    assert s._term_sums(z[:0], par[:0], term[:0], 3).tolist() == np.zeros((3, 4)).tolist() and s._term_sums(z[:0], par[:0], term[:0], 0).shape == (0, 4)


def test_subjects_are_found(spark):
    docs, truth = corpus()
    labels = [(d, c.upper() + " ") for d, c in truth if d % 4 == 0] + [(0, "unknown"), (None, "auto"), (3, None)]
    notes = [(c, c, "Textes sur " + " ".join(t[:2])) for c, t in TERMS.items()]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs] + [(5000, None, "x"), (5001, "", "x"), (None, "moteur", "x")], "doc_id long, text string, subject string")
    sub = spark.createDataFrame(notes, "subject string, titre string, scope_note string")
    lab = spark.createDataFrame(labels + labels[:5], "doc_id long, subject string")
    found = {tuple(r) for r in s.subject_areas(d, sub, lab, rank=8).collect()}
    want = set(truth)
    assert len(found & want) / len(want) > 0.95 and len(found & want) / len(found) > 0.95
    assert s.subject_areas(d, sub.limit(0), lab).count() == 0
    assert s.subject_areas(d.limit(0), sub, lab.limit(0)).count() == 0
    assert s.subject_areas(d, sub, lab.limit(0), rank=8).count() >= 0
