"""Generations of tables: a store that only grows, with compare-and-append publication, snapshots and recovery.

A store is a folder that driver and executors share (any file system that Spark reaches)::

    objects/<name>-<digest>   a table, named after its content
    generations/<number>.json a generation: its tables, its predecessor's digest, its own digest
    intents/<run>.json        a generation that a writer is about to publish
    staging/<run>/<name>      tables that a writer has not named yet

A generation exists when its file does, and that file is created once: of two writers that read the same latest
generation one wins, the other gets ``PublicationConflict`` and leaves nothing behind. A writer that dies before its intent leaves
staging, after it an intent that ``recover`` finishes or clears. Readers open a snapshot of one generation, which later ones do
not change; its lineage down to the first generation and its tables are checked before anything is answered.

Creating a file only where none is must be atomic in the file system (it is in HDFS and on local disks).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = "generation.v1"


class PublicationConflict(RuntimeError):
    """Another generation has been published in the meantime."""


class SnapshotError(RuntimeError):
    """A generation whose lineage, coverage or content is not what its files say."""


class Snapshot(NamedTuple):
    sequence: int
    digest: str
    tables: dict[str, DataFrame]


def table_digest(df: DataFrame) -> tuple[str, int]:
    """(digest, rows) of a table's rows and columns, whatever their order: digests of rows are summed, so tasks sum their own first."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = lambda k: F.conv(F.substring("row", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("row")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(part(k)), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]).first()
    shape = sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)
    told = json.dumps([sums["n"], *[str(int(sums[f"s{k}"])) for k in range(4)], shape], separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(told.encode()).hexdigest(), sums["n"]


def _canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _bound(body: dict) -> dict:
    """The body with its own digest."""
    return body | {"digest": "sha256:" + hashlib.sha256(_canonical({k: v for k, v in body.items() if k != "digest"}).encode()).hexdigest()}


class Files:
    """Small files and folders of a store, through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; whether it was this call that made it."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as problem:
            if self.fs.exists(self._path(name)):
                return False
            raise problem
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def move(self, one: str, other: str) -> bool:
        self.fs.mkdirs(self._path(other).getParent())
        return not self.exists(other) and self.fs.rename(self._path(one), self._path(other))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _object(name: str, entry: dict) -> str:
    return f"objects/{name}-{entry['digest'].removeprefix('sha256:')}"


def _generation(files: Files, sequence: int) -> dict | None:
    text = files.read(f"generations/{sequence:010d}.json")
    if text is None:
        return None
    try:
        body = json.loads(text)
    except ValueError:
        raise SnapshotError(f"generation {sequence} is unreadable") from None
    if not isinstance(body, dict) or _bound(body) != body or body.get("sequence") != sequence or body.get("version") != VERSION:
        raise SnapshotError(f"generation {sequence} is not what its digest says")
    return body


def latest(spark: SparkSession, root: str) -> dict | None:
    """The latest generation, or None."""
    files = Files(spark, root)
    numbers = [int(n.removesuffix(".json")) for n in files.names("generations") if n.endswith(".json") and n.removesuffix(".json").isdigit()]
    return _generation(files, max(numbers)) if numbers else None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], expected: str | None = "latest", failpoint: Callable[[str], None] = lambda name: None) -> dict:
    """Append a generation of ``tables`` after the one whose digest is ``expected`` (None: the store is empty; "latest": the one found now).

    Gives the generation; the latest one, if its tables are the same. Tables are computed once: written, then named after what
    was written. ``failpoint`` is called after each step, for tests of interrupted writers.
    """
    files, run = Files(spark, root), uuid.uuid4().hex
    if any(r["result"] == "investigate" for r in recover(spark, root)):
        raise PublicationConflict("an earlier publication must be investigated")
    head = latest(spark, root)
    held = head["digest"] if head else None
    if expected != "latest" and expected != held:
        raise PublicationConflict("the latest generation is another one")
    entries = {}
    for name, df in sorted(tables.items()):
        place = f"staging/{run}/{name}"
        df.write.parquet(f"{root}/{place}")
        digest, rows = table_digest(spark.read.schema(df.schema).parquet(f"{root}/{place}"))
        entries[name] = {"digest": digest, "rows": rows, "schema": df.schema.jsonValue()}
    failpoint("staged")
    if head and head["tables"] == entries:
        files.remove(f"staging/{run}")
        return head
    body = _bound({"version": VERSION, "sequence": (head["sequence"] if head else 0) + 1, "predecessor": held, "tables": entries})
    files.create(f"intents/{run}.json", _canonical(body))
    failpoint("intended")
    result = _finish(files, run, body, failpoint)
    if result != "complete":
        raise PublicationConflict("the next generation has been published by another writer")
    return body


def _finish(files: Files, run: str, body: dict, failpoint: Callable[[str], None] = lambda name: None) -> str:
    """Name the tables, create the generation, clear what is left: complete, superseded or discarded."""
    marker, told = f"generations/{body['sequence']:010d}.json", _canonical(body)
    for name, entry in body["tables"].items():
        if not files.exists(_object(name, entry) + "/_SUCCESS"):
            if not files.exists(f"staging/{run}/{name}/_SUCCESS"):
                result = "complete" if files.read(marker) == told else "discarded"
                break
            if files.exists(_object(name, entry)):  # half of a table that another writer left
                files.remove(_object(name, entry))
            files.move(f"staging/{run}/{name}", _object(name, entry))
    else:
        failpoint("named")
        files.create(marker, told)
        failpoint("created")
        result = "complete" if files.read(marker) == told else "superseded"
    files.remove(f"staging/{run}")
    files.remove(f"intents/{run}.json")
    return result


def recover(spark: SparkSession, root: str, abandoned: bool = False) -> list[dict]:
    """(run, result) of what interrupted writers left: published intents are complete, whole ones are published now, those whose
    place is taken are superseded, those without their tables discarded; intents that no writer here made are left for investigation.
    With ``abandoned`` staging without an intent is removed too: only when no writer is at work."""
    files, out = Files(spark, root), []
    for name in files.names("intents"):
        run = name.removesuffix(".json")
        try:
            body = json.loads(files.read(f"intents/{name}") or "")
            known = isinstance(body, dict) and _bound(body) == body and body["version"] == VERSION and all(set(e) == {"digest", "rows", "schema"} for e in body["tables"].values())
        except (ValueError, KeyError, AttributeError, TypeError):
            known = False
        if not known:
            out.append({"run": run, "result": "investigate"})
            continue
        before = _generation(files, body["sequence"] - 1) if body["sequence"] > 1 else None
        if (before["digest"] if before else None) != body["predecessor"]:
            out.append({"run": run, "result": "investigate"})
            continue
        out.append({"run": run, "result": _finish(files, run, body)})
    for run in files.names("staging"):
        if not files.exists(f"intents/{run}.json") and abandoned:
            files.remove(f"staging/{run}")
            out.append({"run": run, "result": "discarded"})
    return out


def open_snapshot(spark: SparkSession, root: str, sequence: int | None = None, expected: list[str] | None = None, verify: bool = True) -> Snapshot:
    """The tables of one generation, sealed: lineage down to the first generation, the tables asked for, and (``verify``) their contents are checked."""
    files = Files(spark, root)
    head = latest(spark, root) if sequence is None else _generation(files, sequence)
    if head is None:
        raise SnapshotError("there is no such generation")
    later = head
    for number in range(head["sequence"] - 1, 0, -1):
        earlier = _generation(files, number)
        if earlier is None or earlier["digest"] != later["predecessor"]:
            raise SnapshotError(f"the lineage breaks at generation {number}")
        later = earlier
    if later["predecessor"] is not None:
        raise SnapshotError("the first generation has a predecessor")
    if expected is not None and set(expected) != set(head["tables"]):
        raise SnapshotError("the generation has other tables than were asked for")
    tables = {}
    for name, entry in head["tables"].items():
        if not files.exists(_object(name, entry) + "/_SUCCESS"):
            raise SnapshotError(f"table {name} is not whole")
        tables[name] = spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{root}/{_object(name, entry)}")
        if verify and table_digest(tables[name]) != (entry["digest"], entry["rows"]):
            raise SnapshotError(f"table {name} is not what its digest says")
    return Snapshot(head["sequence"], head["digest"], tables)


def not_advancing(previous: DataFrame, proposed: DataFrame, key: str, version: str) -> DataFrame:
    """(key, problem) of proposed definitions whose version goes back, or stays while their content changes."""
    content = lambda df: F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    side = lambda df, end: df.select(F.col(key), F.col(version).alias(f"version_{end}"), content(df).alias(f"content_{end}"))
    both = side(proposed, "now").join(side(previous, "then"), key)
    problem: Column = F.when(F.col("version_now") < F.col("version_then"), "version_goes_back").when((F.col("version_now") == F.col("version_then")) & (F.col("content_now") != F.col("content_then")), "version_stays")
    return both.select(key, problem.alias("problem")).filter("problem is not null")
