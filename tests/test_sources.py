import datetime as dt
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexweave import schemas
from lexweave.operators import orphans
from lexweave.sources import files, index, readers
from lexweave.streaming import pipelines


def points(spark, *data):
    return spark.createDataFrame([(i, [float(v)] * 4, [1], [0.5], json.dumps({"text": t})) for i, v, t in data], schemas.POINT)


def test_jsonl_and_deliveries(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"cid": "1", "extra": 2}\n{"cid": "2", "etat": "VIGUEUR"}\n')
    assert rows(readers.jsonl(spark, str(tmp_path / "a.jsonl")).select("cid", "etat")) == [("1", None), ("2", "VIGUEUR")]
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "none.jsonl")).count()
    (tmp_path / "b.jsonl").write_text("nonsense\n")
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "b.jsonl")).collect()
    raw = spark.createDataFrame([("2", "VIGUEUR", "<p>", 0), ("1", "VIGUEUR", "<p>", 86_400_000), ("3", "ABROGE", "<p>", 0), ("4", "VIGUEUR", None, 0)], "k string, etat string, html string, debut long")
    got = readers.article_delivery(raw, {"cid": "k", "etat": "etat", "texteHtml": "html", "dateDebut": "debut"})
    assert [(r.cid, r.dateDebut, r.nota) for r in got.collect()] == [("1", "1970-01-02", None), ("2", "1970-01-01", None)] and tuple(got.columns) == schemas.ARTICLE_FIELDS


def test_guides(spark, tmp_path):
    xml = '<P xmlns:dc="http://purl.org/dc/elements/1.1/" ID="F1" type="t" spUrl="u"><dc:title> T </dc:title><dc:date>modified 2024-01-02</dc:date><dc:source>LEGISCTA2,LEGISCTA1,LEGISCTA2</dc:source><FilDAriane><Niveau>A</Niveau><Niveau>B</Niveau></FilDAriane></P>'
    for name, text in (("F1.xml", xml), ("F2.xml", "<P/>"), ("x.xml", xml), ("F3.xml", "<P>")):
        (tmp_path / name).write_text(text)
    got = {r.fiche_id: r for r in readers.guide_headers(readers.guide_files(spark, str(tmp_path))).collect()}
    assert set(got) == {"F1", "F2"} and tuple(got["F1"])[1:] == ("F1", "T", "t", "u", "2024-01-02", ["LEGISCTA2", "LEGISCTA1"], "A > B")
    assert got["F2"].section_ids == [] and got["F2"].date_modified is None
    with pytest.raises(Exception, match="no modification date"):
        readers.guide_headers(readers.guide_files(spark, str(tmp_path)), strict=True).collect()
    scoped = readers.in_scope(readers.guide_headers(readers.guide_files(spark, str(tmp_path))), spark.createDataFrame([("LEGISCTA1",), (None,)], "sectionParentId string"))
    assert [r.fiche_id for r in scoped.collect()] == ["F1"]


def test_zip_yaml_and_inverse_projection(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "guides.zip", "w") as z:
        z.writestr("x/F1.xml", "<P/>")
        z.writestr("readme.txt", "no")
    assert rows(readers.zipped_guides(spark, str(tmp_path / "guides.zip")).select("fiche_id", F.decode("xml", "utf-8"))) == [("F1", "<P/>")]
    items = spark.createDataFrame([("gs-1", 'a: "q"\n# é', [{"role": "user", "content": "c"}], "s", ["F"], [], [], ["p: 1"], None)], schemas.GOLDEN)
    readers.write_annotated_set(items, str(tmp_path / "g.yaml"))
    lines = (tmp_path / "g.yaml").read_text().splitlines()
    assert lines[:3] == ['- id: "gs-1"', '  question: "a: \\"q\\"\\n# é"', "  history:"] and '    - "p: 1"' in lines and "  tags: null" in lines
    back = readers.items_of_dataset(readers.dataset_items(items, working_set=False))
    assert rows(back.select(items.columns)) == rows(items.fillna({}).withColumn("tags", F.array().cast("array<string>")))
    (tmp_path / "bad.json").write_text('[{"id": "a", "x": 1}, {"id": "b"}, 3]')
    with pytest.raises(ValueError, match="item 1: unknown x; item 3: not an object"):
        readers.annotated_set(spark, str(tmp_path / "bad.json"))


def test_annotated_sets_and_runs(spark, tmp_path):
    assert readers.annotated_set(spark, str(tmp_path / "none.json")).count() == 0
    items = spark.createDataFrame([("gs-2", "é", None, "s", ["F"], None, None, None, None), ("gs-1", "q", [{"role": "user", "content": "c"}], "s", None, None, None, None, None)], schemas.GOLDEN)
    readers.write_annotated_set(items, str(tmp_path / "g.json"))
    assert rows(readers.annotated_set(spark, str(tmp_path / "g.json"))) == rows(items)
    assert rows(readers.dataset_items(items, "x-").select("id")) == [("x-gs-2",)] and readers.dataset_items(items, working_set=False).count() == 2
    scores = spark.createDataFrame([("gs-1", "no_reference", 0.5, None, None, None, None, None, True, None, None)], schemas.ITEM_SCORES)
    path = readers.write_run({"run_id": "r1", "arm": "rung1"}, scores, str(tmp_path))
    assert rows(readers.run_items(spark, str(path)).select("run_id", "item_id", "fiche_recall_at_4", "zero_articles", "floor_correct")) == [("r1", "gs-1", 0.5, True, None)]
    manifest = spark.createDataFrame([("a", "2024-02-01", 3), ("b", "2024-01-01", 4)], "producer string, file_date string, document_count long")
    assert tuple(readers.attribution(manifest).first()) == ("2024-01-01", 7)


def test_upsert_flip_publish_restore(spark, tmp_path):
    home, out = f"file://{tmp_path}/home", f"file://{tmp_path}/out"
    index.upsert(spark, home, "articles__index-1", points(spark, ("a", 1, "x"), ("b", 2, "y")))
    for _ in range(2):
        index.upsert(spark, home, "articles__index-1", points(spark, ("b", 3, "z"), ("c", 4, "w")))
    with pytest.raises(index.IndexFault):
        index.flip(spark, home, {"articles": "articles__none"})
    assert index.flip(spark, home, {"articles": "articles__index-1"}) and not index.flip(spark, home, {"articles": "articles__index-1"})
    assert rows(index.live(spark, home, "articles").select("id", "payload")) == [("a", '{"text": "x"}'), ("b", '{"text": "z"}'), ("c", '{"text": "w"}')]
    with pytest.raises(index.IndexFault, match="scored"):
        index.publish(spark, home, out, "index-2", ["articles"], {}, scored={"articles": "other"})
    lock = index.publish(spark, home, out, "index-2", ["articles"], {"chunking": {"band": 512}})
    with pytest.raises(index.IndexFault, match="chunking"):
        index.publish(spark, home, out, "index-3", ["articles"], {"chunking": {"band": 256}}, previous=lock)
    other = f"file://{tmp_path}/other"
    assert index.restore(spark, other, out) == {"articles": "restored"} and index.restore(spark, other, out) == {"articles": "live"}
    assert index.digest(index.live(spark, other, "articles")) == index.digest(index.live(spark, home, "articles"))
    assert index.health(spark, other, "index-2", ["articles"])["ok"] and not index.health(spark, other, "index-1", ["articles"])["ok"]
    points(spark, ("a", 9, "forged")).write.mode("overwrite").parquet(f"{out}/articles.parquet")
    with pytest.raises(index.IndexFault, match="lock"):
        index.restore(spark, f"file://{tmp_path}/third", out)
    assert not (tmp_path / "third").exists()
    for tag in ("index-0", "index-1"):
        index.upsert(spark, other, f"articles__{tag}", points(spark, ("a", 1, "x")))
    assert index.prune(spark, other, "articles") == ["articles__index-0"]


def test_upsert_keeps_one_row_per_id_and_survives_a_crash(spark, tmp_path, monkeypatch):
    home = f"file://{tmp_path}/home"
    twice = points(spark, ("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z"))
    for df in (twice, twice.orderBy("payload", ascending=False).repartition(3)):
        index.upsert(spark, home, "v", df)
        assert rows(index.version(spark, home, "v").select("id", "payload")) == [("a", '{"text": "y"}'), ("b", '{"text": "z"}')]
    assert rows(index.last_wins(twice.withColumn("n", F.col("dense")[0] * -1), ["n"]).select("id", "payload")) == [("a", '{"text": "x"}'), ("b", '{"text": "z"}')]

    def crash(self, name, text):
        raise OSError("crash")

    monkeypatch.setattr(files.Files, "write", crash)
    with pytest.raises(OSError):
        index.upsert(spark, home, "v", points(spark, ("c", 1, "new")))
    monkeypatch.undo()
    held = index.version(spark, home, "v")
    assert rows(held.select("id")) == [("a",), ("b",)]
    index.upsert(spark, home, "v", points(spark, ("c", 1, "new")))
    assert held.count() == 2 and index.version(spark, home, "v").count() == 3  # a reader keeps the state it opened


def test_create_lays_out_by_section(spark, tmp_path):
    home = f"file://{tmp_path}/home"
    some = points(spark, *((f"p{i}", i, f"s{i % 5}") for i in range(50)))
    for _ in range(2):
        index.create(spark, home, "v", some, "get_json_object(payload, '$.text')")
    assert index.version(spark, home, "v").count() == 0
    index.upsert(spark, home, "v", some)
    again = index.version(spark, home, "v")
    assert again.count() == 50 and all(r.n <= 2 for r in again.select(F.get_json_object("payload", "$.text").alias("t"), F.input_file_name().alias("f")).groupBy("t").agg(F.countDistinct("f").alias("n")).collect())


def test_digest_ignores_order(spark):
    a = points(spark, ("a", 1, "x"), ("b", 2, "y"))
    assert index.digest(a) == index.digest(a.orderBy("id", ascending=False).repartition(3)) != index.digest(a.limit(1))
    assert index.tag_of("articles", "articles__index-1") == "index-1" and index.tag_of("articles", "articles__test") is None


def test_streams(spark, tmp_path):
    src = tmp_path / "src"
    points(spark, ("a", 1, "x")).write.parquet(str(src))
    for extra in (("a", 2, "y"), ("b", 3, "z")):
        q = pipelines.upsert_points(spark.readStream.schema(schemas.POINT).parquet(str(src)), f"file://{tmp_path}/home", "p", str(tmp_path / "cp"))
        q.awaitTermination()
        points(spark, extra).write.mode("append").parquet(str(src))
    assert rows(index.version(spark, f"file://{tmp_path}/home", "p").select("id", "dense")) == [("a", [2.0] * 4)]
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), "v", 1.0), (dt.datetime(2024, 1, 1, 9), "v", 2.0), (dt.datetime(2024, 1, 2), "v", None)], "ts timestamp, event_type string, value double")
    assert [tuple(r)[1:] for r in pipelines.windowed_counts(events).orderBy("window_start").collect()] == [("v", 2, 3.0), ("v", 1, None)]


def test_orphan_stream_equals_the_batch(spark, tmp_path):
    """A parent of day 2 that arrives after its references, and one whose end arrives late."""
    day = lambda n: dt.date(2024, 1, n)
    refs = [("articles", "section", "r", k, day(n), None) for k in "ab" for n in (1, 3, 5)]
    batches = [refs + [(None, "section", None, "b", day(1), 1)], [(None, "section", None, "a", day(2), 1)], [(None, "section", None, "a", day(4), -1), (None, "section", None, "b", day(5), -1), refs[0]]]
    schema = "ref_table string, space string, record_key string, missing_key string, at date, delta int"
    src = tmp_path / "events"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(src))
        pipelines.orphan_stream(spark.readStream.schema(schema).parquet(str(src)), f"file://{tmp_path}/state", str(tmp_path / "cp")).awaitTermination()
    changes = [rows(spark.read.parquet(f"file://{tmp_path}/state/changes-{n}").select("missing_key", "at", "change")) for n in range(3)]
    assert changes == [[("a", day(n), 1) for n in (1, 3, 5)], [("a", day(3), -1), ("a", day(5), -1)], [("a", day(5), 1), ("b", day(5), 1)]]
    events = spark.createDataFrame([r for b in batches for r in b], schema)
    dangling, counts = orphans.run(events.where("delta IS NOT NULL").select("space", F.col("missing_key").alias("key"), "at", "delta"), events.where("ref_table IS NOT NULL"), [day(4)])
    state = orphans.load(spark, f"file://{tmp_path}/state/state-2")
    assert rows(dangling.select("missing_key", "at")) == rows(state.waiting.select("missing_key", "at")) == [("a", day(1)), ("a", day(5)), ("b", day(5))]
    assert rows(counts) == rows(orphans.counts(state, [day(4)]))


def test_orphan_stream_needs_the_state_before(spark, tmp_path):
    import shutil

    from pyspark.errors import StreamingQueryException

    schema = "ref_table string, space string, record_key string, missing_key string, at date, delta int"
    src = tmp_path / "events"
    for n in (1, 2):
        spark.createDataFrame([("articles", "section", "r", "a", dt.date(2024, 1, n), None)], schema).coalesce(1).write.mode("append").parquet(str(src))
        run = pipelines.orphan_stream(spark.readStream.schema(schema).parquet(str(src)), f"file://{tmp_path}/state", str(tmp_path / "cp"))
        if n == 1:
            run.awaitTermination()
            shutil.rmtree(tmp_path / "state" / "state-0")
        else:
            with pytest.raises(StreamingQueryException, match="missing"):
                run.awaitTermination()
