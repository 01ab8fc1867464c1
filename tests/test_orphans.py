import datetime as dt
import random

from conftest import rows

from lexweave.operators import orphans as o

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def frames(spark, lives, refs):
    parents = spark.createDataFrame([("section", k, D(a), 1) for k, a, _ in lives] + [("section", k, D(b), -1) for k, _, b in lives if b is not None], "space string, key string, at date, delta int")
    return parents, spark.createDataFrame([("articles", "section", r, k, D(n)) for r, k, n in refs], "ref_table string, space string, record_key string, missing_key string, at date")


def test_incremental_equals_brute_force_for_any_bounds(spark):
    rng = random.Random(5)
    lives = [(f"k{rng.randrange(6)}", a := rng.randrange(40), rng.choice([None, a + rng.randrange(1, 20)])) for _ in range(12)]
    refs = [(f"r{rng.randrange(30)}", f"k{rng.randrange(8)}", rng.randrange(60)) for _ in range(80)] * 2
    want = sorted({("articles", r, k, D(n)) for r, k, n in refs if not any(key == k and a <= n and (b is None or n < b) for key, a, b in lives)}, key=repr)
    assert want
    for bounds in ([], [D(10)], [D(5), D(20), D(33), D(50)]):
        dangling, counts = o.run(*frames(spark, lives, refs), bounds)
        assert rows(dangling) == want
        last = {r.ref_table: r for r in counts.orderBy("until").collect() if r.until == dt.date(9999, 12, 31)}
        gone = {k for _, k, _ in refs if not any(key == k and b is None for key, a, b in lives)}
        assert last["articles"].pending == len({(r, k, n) for r, k, n in refs if k in gone})


def test_state_resolves_and_reopens(spark):
    lives, refs = [("a", 10, 20), ("a", 30, None)], [("r1", "a", 1), ("r2", "a", 15)]
    _, counts = o.run(*frames(spark, lives, refs), [D(5), D(12), D(25)])
    got = [(r.arrived, r.resolved, r.reopened, r.pending) for r in counts.where("ref_table = 'articles'").orderBy("until").collect()]
    assert got == [(1, 0, 0, 1), (0, 1, 0, 0), (1, 0, 1, 2), (0, 2, 0, 0)]


def test_batches_of_any_order_give_one_state(spark):
    """References, parents and deletions in random batches, late ones among them, against one batch."""
    rng = random.Random(8)
    lives = [(f"k{rng.randrange(5)}", a := rng.randrange(40), rng.choice([None, a + rng.randrange(1, 20)])) for _ in range(10)]
    refs = [(f"r{rng.randrange(20)}", f"k{rng.randrange(7)}", rng.randrange(60)) for _ in range(60)]
    parents, asked = frames(spark, lives, refs)
    want, _ = o.run(parents, asked, [])
    p, r = parents.collect(), asked.collect()
    rng.shuffle(p), rng.shuffle(r)
    state, sofar = None, {}
    for i in range(3):
        step = o.advance(state, spark.createDataFrame(r[i::3], asked.schema), spark.createDataFrame(p[i::3], parents.schema))
        for c in step.changes.collect():
            key = tuple(c)[:-1]
            sofar[key] = sofar.get(key, 0) + c.change
            assert sofar[key] in (0, 1)
        state = step.state
    assert sorted((k for k, n in sofar.items() if n), key=repr) == rows(want) == rows(state.waiting.select(want.columns))
    assert state.waiting.count() + state.settled.count() == asked.distinct().count()


def test_a_day_of_change_counts_before_its_references(spark):
    dangling, _ = o.run(*frames(spark, [("a", 3, 5)], [("r", "a", 2), ("r", "a", 3), ("r", "a", 4), ("r", "a", 5)]), [])
    assert [r.at for r in dangling.orderBy("at").collect()] == [D(2), D(5)]


def test_corpus(spark):
    t = dt.datetime(2024, 1, 1)
    xml = b'<P xmlns:d="http://purl.org/dc/elements/1.1/"><d:date> modified 2024-01-05\n</d:date><d:source>x/legiscta1 ; LEGISCTA2#a LEGISCTA1</d:source></P>'
    fiches = spark.createDataFrame([("F1", bytearray(xml), t), ("F2", bytearray(b"<P>"), t), ("F3", bytearray(b"<P/>"), t), ("F4", None, t)], "fiche_id string, xml binary, retrieved_at timestamp")
    sections = spark.createDataFrame([("LEGISCTA1", "t", None, D(0), D(4)), ("legiscta2 ", "t", None, D(0), None), ("LEGISCTA2", "t", None, D(0), None), (None, None, None, None, None)], "section_id string, titre string, parent_id string, valid_from date, valid_to date")
    articles = spark.createDataFrame([(k, D(10 * k), t, c, "VIGUEUR", s) for k, c, s in [(1, "a", "LEGISCTA2"), (1, "b", "LEGISCTA9"), (2, "b", None), (2, "a", "legiscta2")]], "snapshot_no int, snapshot_date date, delivered_at timestamp, cid string, etat string, sectionParentId string")
    golden = spark.createDataFrame([("g1", [" A", "b ", "b", "", None, "zz"], dt.datetime(2024, 1, 12)), ("g2", ["a"], dt.datetime(2024, 1, 3)), ("g3", None, t), ("g4", ["b"], dt.datetime(2024, 3, 1))], "id string, gold_articles array<string>, annotated_at timestamp")
    dangling, _ = o.corpus_orphans(articles, sections, fiches, golden)
    assert rows(dangling.select("ref_table", "record_key", "missing_key")) == [("articles", "B", "LEGISCTA9"), ("fiches", "F1", "LEGISCTA1"), ("golden_set", "g1", "ZZ"), ("golden_set", "g2", "A")]


def test_empty(spark):
    dangling, counts = o.run(*frames(spark, [], []), [])
    assert dangling.count() == 0 and counts.where("pending > 0").count() == 0
