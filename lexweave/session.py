"""Session helpers: the builder used by tests and bench, the shared folder, and durable cuts of lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build(cpus: int | str = "*", shuffle: int = 8, name: str = "lexweave") -> SparkSession:
    """A local session with the settings the plans are written for (UTC, adaptive execution, Arrow)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


# What a switch may be set to.
_ON, _OFF = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


def flag(name: str, values: Mapping[str, str] = os.environ, default: bool = False) -> bool:
    """A switch among named values, in any letter case; one that is set to something else is an error, not false."""
    if (raw := values.get(name)) is None:
        return default
    said = raw.strip().lower()
    if said not in _ON + _OFF:
        raise ValueError(f"{name} must be one of {', '.join(_ON + _OFF[:-1])}, not {raw!r}")
    return said in _ON


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    A session that runs on one machine (tests, a laptop) and names none gets a temporary folder of this machine; one
    with executors elsewhere, which couldn't read such a folder, is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found
    if (own := spark.sparkContext.getCheckpointDir()) is not None:
        return own
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lexweave-checkpoints-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder, so that a lost executor costs nothing before this point."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a written intermediate table. It stays as long as results may be read from it,
    that is, until `clean` or the end of this process."""
    path = f"{shared_dir(spark).rstrip('/')}/lexweave-{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean, spark)
    _written.append(path)
    return path


_written: list[str] = []


def clean(spark: SparkSession) -> None:
    """Drops the intermediate tables that this process has written; results that read from them can't be read any more."""
    while _written:
        path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session has ended; whoever owns the folder cleans it
            return


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per context, so that their Python workers find it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_lexweave_shipped", False):
        return
    home = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="lexweave-"), "lexweave.zip")  # read by the driver's file server only
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(home.rglob("*.py")):
            z.write(file, Path("lexweave") / file.relative_to(home))
    context.addPyFile(path)
    context._lexweave_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
