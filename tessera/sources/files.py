"""JSON, JSON-lines and CSV files of the labelling workflow as tables, and back."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from ..review import ledger_faults

LEDGER = "event_id string, event_type string, boundary_id string, review_id string, reviewer_id string, review_round int, label string, confidence string, reason string, created_at string, label_origin string, seq long"
#: Columns that a queue's hash leaves out, since reviewers fill them in.
MUTABLE = ("label", "confidence", "reason")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_json_array(spark: SparkSession, path: str, schema: str | StructType, field: str | None = None) -> DataFrame:
    """Rows of a file that holds one JSON array, or one object with the array in `field`."""
    if field is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    inner = schema if isinstance(schema, str) else schema.simpleString()[len("struct<") : -1]
    rows = spark.read.schema(f"`{field}` array<struct<{inner}>>").json(path, multiLine=True)
    return rows.select(F.explode(field).alias("__row")).select("__row.*")


def read_ledger(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """Events of a JSON-lines ledger; no file, or an empty one, has none. Order is the column seq, never the place in the file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; quoted fields may hold line ends and doubled quotes; a byte-order mark is no part of the first name."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, encoding="UTF-8")
    return rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """The named columns; arrays, structs and maps as JSON, nulls as empty strings; with no rows, the header alone."""
    shown = []
    for c in columns:
        nested = isinstance(rows.schema[c].dataType, (ArrayType, MapType, StructType))
        shown.append(F.coalesce(F.to_json(c) if nested else F.col(c).cast("string"), F.lit("")).alias(c))
    rows.select(*shown).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def write_json_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report(rows: DataFrame, most: int = 10_000) -> str:
    """Aggregated facts as one indented JSON text; refuses more rows than a report has."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has {most} rows at most")
    return json.dumps([r.asDict(recursive=True) for r in found], ensure_ascii=False, indent=2, default=str)


def queue_manifests(queues: DataFrame, mutable: tuple[str, ...] = MUTABLE) -> DataFrame:
    """Of each queue_id: ids in order of place, how many, and the SHA-256 of its rows without the mutable columns.

    Queues are batches of bounded size, so that one value holds a queue's ids.
    """
    fixed = sorted(c for c in queues.columns if c not in (*mutable, "queue_id", "place"))
    line = F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"})
    listed = F.array_sort(F.collect_list(F.struct("place", F.col("boundary_id").alias("id"), line.alias("line"))))
    grouped = queues.groupBy("queue_id").agg(listed.alias("l"))
    text = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["line"]), ", "), F.lit("]"))
    return grouped.select("queue_id", F.transform("l", lambda x: x["id"]).alias("boundary_ids"), F.size("l").alias("row_count"), F.sha2(text, 256).alias("content_sha256"))


class LedgerTable:
    """An append-only ledger below a folder: every append writes a new folder of its own, then a pointer by an atomic rename.

    A reader sees what the last pointer names, so an append is all or nothing, and one that is tried again adds nothing.
    Two writers can't both take the same version: the second rename fails, and its append has to start again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = LEDGER) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def _folders(self, version: int) -> list[str]:
        return [r["value"] for r in self.spark.read.text(f"{self.path}/versions/{version}").collect()]  # one short line an append

    def read(self) -> DataFrame:
        held = self.versions()
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in self._folders(held[-1])])

    def append(self, events: DataFrame, candidates: DataFrame | None = None) -> int:
        """Add the events whose review_id is new; fails if any repeats a reviewer, round and boundary. Returns the version.

        With candidates (boundary_id), old and new events together have to keep every rule of a ledger.
        """
        held = self.versions()
        folders = self._folders(held[-1]) if held else []
        old = self.read()
        new = events.join(old.select("review_id"), "review_id", "left_anti").select(*old.columns)
        key = ["boundary_id", "reviewer_id", "review_round", "event_type"]
        clash = new.select(*key).unionByName(new.select(*key).join(old.select(*key).distinct(), key, "left_semi")).groupBy(*key).count().where("count > 1")
        if clash.limit(1).collect():
            raise ValueError("an event repeats a reviewer, round and boundary")
        if candidates is not None:
            faults = ledger_faults(old.unionByName(new), candidates).limit(5).collect()
            if faults:
                raise ValueError("; ".join(f"{r['boundary_id']}, event {r['seq']}: {r['error']}" for r in faults))
        folder, version = f"events/{uuid.uuid4().hex}", (held[-1] + 1) if held else 1
        new.write.parquet(f"{self.path}/{folder}")
        pointer = f"{self.path}/pending-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(f,) for f in [*folders, folder]], "value string").coalesce(1).write.text(pointer)
        target = self._path(f"{self.path}/versions/{version}")
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(self._path(pointer), target):
            self._fs.delete(self._path(pointer), True)
            raise RuntimeError("another writer appended first")
        return version


def remaining(cases: DataFrame, done: DataFrame, run_id: str, key: str = "boundary_id") -> DataFrame:
    """Cases that a run has not scored yet; predictions of another run are refused when the result is read."""
    other = F.when(F.col("run_id") == run_id, F.col(key)).otherwise(F.raise_error(F.lit("predictions belong to another run")).cast(done.schema[key].dataType))
    return cases.join(done.select(other.alias(key)), key, "left_anti")


def add_missing(rows: DataFrame, manifest: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Columns that the rows lack, from the manifest's row of the same key, else the default; columns that exist keep their values."""
    lacking = [c for c in defaults if c not in rows.columns]
    if not lacking:
        return rows
    known = manifest.dropDuplicates([key]).select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in lacking if c in manifest.columns])
    joined = rows.join(known, F.col(key) == F.col("__key"), "left")
    found = {c: F.coalesce(F.col(f"__{c}"), F.lit(defaults[c])) if c in manifest.columns else F.lit(defaults[c]) for c in lacking}
    return joined.select(*rows.columns, *[v.alias(c) for c, v in found.items()])
