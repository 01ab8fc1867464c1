import pytest

from lexweave import session


@pytest.mark.parametrize("raw,want", [(None, False), (" TRUE ", True), ("on", True), ("0", False), ("", False), ("No", False)])
def test_flags(raw, want):
    assert session.flag("X", {} if raw is None else {"X": raw}) is want


def test_a_flag_is_one_of_the_words():
    with pytest.raises(ValueError, match="X must be"):
        session.flag("X", {"X": "maybe"})


def test_scratch_tables_are_dropped(spark, tmp_path):
    path = session.scratch(spark, "t")
    spark.range(3).write.parquet(path)
    kept, session._written[:] = list(session._written), [path]
    session.clean(spark)
    session._written[:] = [p for p in kept if p != path]
    assert not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://x:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
