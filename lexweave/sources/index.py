"""Versioned tables of points behind pointers: write, verify, flip, dump, publish, restore, prune.

An index is a folder. Each version of a register is a subfolder `<register>__<tag>` with its states, of which
`state.json` names the latest complete one; `pointers.json` says which version is live for every register. It's replaced in one rename, so that readers see all registers move at once or none. Folders
are paths of any file system that the session's Hadoop client knows, local or shared.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave import session
from lexweave.sources.files import Files

POINTERS, LOCK = "pointers.json", "lock.json"
#: Number of the format of versions and dumps.
FORMAT = 2


class IndexFault(RuntimeError):
    """An index isn't what it's said to be; nothing was changed."""


def version_name(register: str, tag: str) -> str:
    return f"{register}__{tag}"


def tag_of(register: str, name: str) -> str | None:
    """The release tag of a version's name, null where it isn't a release of the register."""
    start = f"{register}__"
    tag = name[len(start) :]
    return tag if name.startswith(start) and tag.startswith("index-") else None


def digest(points: DataFrame) -> tuple[int, str]:
    """(rows, digest) of a table, whatever its order and files: counts and two wide sums of row hashes."""
    row = F.to_json(F.struct(*sorted(points.columns)), {"ignoreNullFields": "false"})
    h = F.sha2(row, 256)
    half = lambda a: F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)")
    n, x, y = points.agg(F.count(F.lit(1)), F.coalesce(F.sum(half(1)), F.lit(0)), F.coalesce(F.sum(half(16)), F.lit(0))).first()
    return n, hashlib.sha256(f"{n}|{x}|{y}".encode()).hexdigest()


def layout(points: DataFrame) -> str:
    """Digest of the columns, the width of the vectors and the format of a dump."""
    wide = points.select(F.size("dense").alias("n")).where("n >= 0").first() if "dense" in points.columns else None
    return hashlib.sha256(json.dumps([sorted(points.dtypes), wide[0] if wide else None, FORMAT]).encode()).hexdigest()


def last_wins(points: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One row per id: the one greatest in `order`, then by the JSON of its columns, so that it's always the same one."""
    rest = F.to_json(F.struct(*sorted(c for c in points.columns if c != "id")), {"ignoreNullFields": "false"})
    rows = points.select("id", F.struct(*order, rest.alias("_json"), F.struct(*(c for c in points.columns if c != "id")).alias("_row")).alias("_r")) if not _maps(points) else None
    if rows is None:
        ranked = points.withColumn("_json", rest).withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*(F.desc(c) for c in order), F.desc("_json"))))
        return ranked.where("_n = 1").drop("_n", "_json")
    best = rows.groupBy("id").agg(F.max("_r").alias("_r"))  # combines where the rows are read
    return best.select(*(F.col("id") if c == "id" else F.col(f"_r._row.`{c}`").alias(c) for c in points.columns))


def _maps(points: DataFrame) -> bool:
    return any("map<" in t for _, t in points.dtypes)


#: Rows of one file of a version, at most; with vectors of a thousand numbers some hundred megabytes.
ROWS_A_FILE = 100_000
STATE = "state.json"


def version(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a version: of its latest complete state."""
    files = Files(spark, f"{folder.rstrip('/')}/{name}")
    if not files.exists(STATE):
        raise IndexFault(f"no such version: {name}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}/{json.loads(files.read(STATE))['rows']}")


def complete(files: Files, name: str) -> bool:
    return files.exists(f"{name}/{STATE}")


def create(spark: SparkSession, folder: str, name: str, like: DataFrame, by: str | None = None) -> str:
    """An empty version with the columns of `like`; one that is there stays as it is. `by`: rows of one value of this
    expression (a section, say) are written together, so that a filter on it skips files."""
    files = Files(spark, folder)
    if not complete(files, name):
        _write(spark, folder, name, like.limit(0), by)
    return f"{folder.rstrip('/')}/{name}"


def _write(spark: SparkSession, folder: str, name: str, rows: DataFrame, by: str | None, batch: str | None = None) -> None:
    files, part = Files(spark, f"{folder.rstrip('/')}/{name}"), f"rows-{uuid.uuid4().hex}"
    old = json.loads(files.read(STATE)) if files.exists(STATE) else {}
    if by:
        rows = rows.repartitionByRange(F.expr(by), F.col("id")).sortWithinPartitions(F.expr(by), F.col("id"))  # a large section is several ranges
    rows.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{folder.rstrip('/')}/{name}/{part}")
    files.write(STATE, json.dumps({"rows": part, "by": by, "before": old.get("rows")}))
    if (older := old.get("before")) and older != part:
        files.drop(older)  # a reader may still hold the state before this one, but not the one before that


def upsert(spark: SparkSession, folder: str, name: str, points: DataFrame, order: Sequence[str] = ()) -> str:
    """Writes a new state of a version where the given ids replace those that are there; the same call twice gives the
    same rows. Of several rows with one id `last_wins`.

    A state is a folder of its own, and a small file names the one that counts; it is replaced in one step once the rows
    are complete. So a crash at any point leaves the old state readable, and so are readers that opened it.
    """
    files = Files(spark, folder)
    rows = last_wins(points, order)
    by = None
    if complete(files, name):
        by = json.loads(Files(spark, f"{folder.rstrip('/')}/{name}").read(STATE)).get("by")
        rows = session.cut(rows)
        rows = version(spark, folder, name).join(rows.select("id"), "id", "left_anti").unionByName(rows)
    _write(spark, folder, name, rows, by)
    return f"{folder.rstrip('/')}/{name}"


def pointers(spark: SparkSession, folder: str) -> dict[str, str]:
    files = Files(spark, folder)
    return json.loads(files.read(POINTERS)) if files.exists(POINTERS) else {}


def flip(spark: SparkSession, folder: str, targets: Mapping[str, str]) -> bool:
    """Points registers at versions, all in one rename; False where they already are. The versions must exist."""
    files, now = Files(spark, folder), pointers(spark, folder)
    if missing := [n for n in targets.values() if not complete(files, n)]:
        raise IndexFault(f"no such version: {', '.join(missing)}")
    if all(now.get(r) == n for r, n in targets.items()):
        return False
    files.write(POINTERS, json.dumps(now | dict(targets), sort_keys=True))
    return True


def live(spark: SparkSession, folder: str, register: str) -> DataFrame:
    """The live table of a register; its name is looked up once, here."""
    return version(spark, folder, pointers(spark, folder)[register])


def dump(points: DataFrame, path: str) -> None:
    """Points in order of id, payload as one JSON text."""
    payload = F.col("payload") if dict(points.dtypes).get("payload") == "string" else F.to_json("payload", {"ignoreNullFields": "false"})
    points.withColumn("payload", payload).orderBy("id").write.mode("overwrite").parquet(path)


@dataclass
class Lock:
    """What a release holds: per register rows, content digest and layout, and what it was made with."""

    tag: str
    registers: dict[str, dict[str, Any]]
    config: dict[str, Any] = field(default_factory=dict)

    def write(self, spark: SparkSession, folder: str) -> None:
        Files(spark, folder).write(LOCK, json.dumps(asdict(self), indent=2, sort_keys=True))

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> Lock:
        return cls(**json.loads(Files(spark, folder).read(LOCK)))


def publish(spark: SparkSession, folder: str, out: str, tag: str, registers: list[str], config: dict[str, Any], scored: Mapping[str, str] | None = None, previous: Lock | None = None) -> Lock:
    """Dumps the live tables and writes `lock.json` last. Refused if the tag is malformed, a scored version isn't the
    live one, or the chunking changed since `previous`."""
    if not tag.startswith("index-"):
        raise IndexFault("a release tag starts with index-")
    now = pointers(spark, folder)
    if wrong := [r for r in registers if r not in now or (scored or {}).get(r, now[r]) != now[r]]:
        raise IndexFault(f"not the version that was scored: {', '.join(wrong)}")
    if previous and previous.config.get("chunking") != config.get("chunking"):
        raise IndexFault("the chunking has changed since the last release")
    entries = {}
    for r in registers:
        points, path = live(spark, folder, r), f"{out}/{r}.parquet"
        dump(points, path)
        n, d = digest(spark.read.parquet(path))
        entries[r] = {"rows": n, "digest": d, "layout": layout(points), "version": now[r]}
    lock = Lock(tag, entries, config)
    lock.write(spark, out)
    return lock


def restore(spark: SparkSession, folder: str, out: str) -> dict[str, str]:
    """Brings the dumped release live: register -> "live", "restored" or "rebuilt".

    Contents are verified before anything is written and again before the pointers move, all in one flip; then each
    register keeps the live version and the newest other one. A live version of the release that's short is an error.
    """
    lock, files, done, targets = Lock.read(spark, out), Files(spark, folder), {}, {}
    now = pointers(spark, folder)
    for r, entry in lock.registers.items():
        name = version_name(r, lock.tag)
        if now.get(r) == name:
            if version(spark, folder, name).count() != entry["rows"]:
                raise IndexFault(f"{name} is live but incomplete")
            done[r] = "live"
            continue
        points = spark.read.parquet(f"{out}/{r}.parquet")
        if list(digest(points)) != [entry["rows"], entry["digest"]]:
            raise IndexFault(f"the dump of {r} isn't what the lock says")
        done[r] = "rebuilt" if files.exists(name) else "restored"
        files.drop(name)
        upsert(spark, folder, name, points)
        if version(spark, folder, name).count() != entry["rows"]:
            raise IndexFault(f"{name} is incomplete")
        targets[r] = name
    if targets:
        flip(spark, folder, targets)
    for r in lock.registers:
        prune(spark, folder, r)
    return done


def prune(spark: SparkSession, folder: str, register: str) -> list[str]:
    """Drops all released versions of a register but the live one and the newest other one."""
    files, now = Files(spark, folder), pointers(spark, folder).get(register)
    others = sorted((n for n in files.folders() if tag_of(register, n) and n != now), reverse=True)
    for n in others[1:]:
        files.drop(n)
    return others[1:]


def health(spark: SparkSession, folder: str, tag: str, registers: list[str], models_loaded: bool = True) -> dict[str, bool]:
    """Whether models are loaded, the index can be read and every register's pointer is at the release."""
    now = pointers(spark, folder)
    current = all(tag_of(r, now.get(r, "")) == tag for r in registers)
    return {"models": models_loaded, "index": bool(now), "release": current, "ok": models_loaded and bool(now) and current}
