"""Snapshot tables: Parquet directories under a log of numbered manifests.

A commit writes its manifest beside the log and renames it into place, which fails if that number is taken: a reader
sees a version whole or not at all, and of two writers one has to try again. A manifest lists the directories of its
version, the files in them that a later change has replaced, and the ledgers of the source files that went in.
Appending adds a directory; a change of some keys rewrites only the files that hold them; earlier versions stay readable
until vacuum() drops them. Files go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators.clustering import z_value
from lakeweave.operators.joins import absent
from lakeweave.operators.ordering import latest

PART = "part"


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.partition_by = spark, path.rstrip("/"), tuple(partition_by)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/_log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table at {self.path}")
        stream = self._fs.open(self._path(f"{self.path}/_log/{found[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def rows_of(self) -> int:
        """The version that the present rows came with: compacting and marking don't change it."""
        return self.manifest()["rows_of"]

    def _listed(self, part: str) -> list[str]:
        """The data files of a directory, relative to the table."""
        out, found = [], self._fs.listFiles(self._path(f"{self.path}/{part}"), True)
        while found.hasNext():
            name = found.next().getPath().toString()
            if name.endswith(".parquet"):
                out.append(self._relative(name))
        return out

    def _relative(self, file: str) -> str:
        return f"data/{PART}=" + file.rsplit(f"/data/{PART}=", 1)[1]

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest(version)
        return self.read_parts(held["parts"], held.get("removed", {}))

    def read_parts(self, parts: list[str], removed: dict[str, list[str]] | None = None) -> DataFrame:
        """The rows of some directories, less the files that were replaced."""
        return self._scan(parts, removed or {}).drop(PART)

    def _scan(self, parts: list[str], removed: dict[str, list[str]]) -> DataFrame:
        paths = []
        for p in parts:
            gone = set(removed.get(p, ()))
            paths += [p] if not gone else [f for f in self._listed(p) if f not in gone]
        return self.spark.read.option("mergeSchema", True).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/{p}" for p in paths))

    def _commit(self, parts: list[str], action: str, removed: dict | None = None, **more) -> int:
        """The next version; what a manifest says beside its parts is carried over unless given."""
        found = self.versions()
        kept = {k: v for k, v in self.manifest(found[-1]).items() if k in ("ledgers", "consumed")} if found else {}
        number = (found or [0])[-1] + 1
        of_rows = self.manifest(found[-1])["rows_of"] if found and action in ("compact", "mark") else number
        body = kept | {"version": number, "rows_of": of_rows, "action": action, "parts": parts, "removed": removed or {}, "partition_by": list(self.partition_by)} | more
        folder = f"{self.path}/_log"
        draft = f"{folder}/.{uuid.uuid4().hex}"
        self._put(draft, json.dumps(body))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(folder).toUri(), self._conf)
        without_overwriting = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(self._path(draft), self._path(f"{folder}/{number:010d}.json"), without_overwriting)
        return number

    def _put(self, path: str, text: str) -> None:
        stream = self._fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _write(self, df: DataFrame) -> str:
        part = f"data/{PART}={uuid.uuid4().hex}"
        writer = df.write
        if self.partition_by:
            writer = df.repartition(*self.partition_by).write.partitionBy(*self.partition_by)
        writer.parquet(f"{self.path}/{part}")
        return part

    def replace(self, df: DataFrame, **more) -> int:
        return self._commit([self._write(df)], "replace", **more)

    def append(self, df: DataFrame, sources: list[str] | None = None, **more) -> int:
        """Add rows; the source files that they come from go into a ledger of this commit."""
        held = self.manifest() if self.exists() else {"parts": []}
        if sources:
            ledger = f"ledger/{uuid.uuid4().hex}.txt"
            self._put(f"{self.path}/{ledger}", "\n".join(sources))
            more["ledgers"] = [*held.get("ledgers", []), ledger]
        return self._commit([*held["parts"], self._write(df)], "append", held.get("removed"), **more)

    def sources(self) -> DataFrame:
        """The source files that went in, from the ledgers: (arquivo_origem)."""
        ledgers = self.manifest().get("ledgers", []) if self.exists() else []
        if not ledgers:
            return self.spark.createDataFrame([], "arquivo_origem string")
        return self.spark.read.text([f"{self.path}/{x}" for x in ledgers]).select(F.col("value").alias("arquivo_origem"))

    def mark(self, **more) -> int:
        """A version with the same rows that notes something, such as what has been consumed of another table."""
        held = self.manifest()
        return self._commit(held["parts"], "mark", held.get("removed"), **more)

    def rewrite(self, keys: DataFrame, rows: DataFrame, on: list[str], **more) -> int:
        """Put rows in the place of all that have the given keys. Only the files that hold such keys are written again."""
        held = self.manifest()
        removed = held.get("removed", {})
        keys = keys.select(*on).distinct()
        old = self._scan(held["parts"], removed).withColumn("_file", F.col("_metadata.file_path"))
        touched: dict[str, list[str]] = {}
        for r in old.join(keys, on, "left_semi").select(PART, "_file").distinct().collect():
            touched.setdefault(f"data/{PART}={r[PART]}", []).append(self._relative(unquote(r["_file"])))
        files = [f for own in touched.values() for f in own]
        if not files:
            return self._commit([*held["parts"], self._write(rows)], "append", removed, **more)
        beside = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/{f}" for f in files)).drop(PART)
        new = self._write(beside.join(keys, on, "left_anti").unionByName(rows, allowMissingColumns=True))
        removed = removed | {p: sorted({*removed.get(p, ()), *own}) for p, own in touched.items()}
        parts = [p for p in held["parts"] if p not in touched or set(self._listed(p)) - set(removed[p])]
        return self._commit([*parts, new], "rewrite", {p: f for p, f in removed.items() if p in parts}, **more)

    def upsert(self, source: DataFrame, keys: list[str], **more) -> int:
        """Rows of known keys are replaced, others added. Repeated source keys are an error; without a known key it is an append."""
        repeated = source.groupBy(*keys).count().where("count > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"repeated key in the source of an upsert: {repeated[0].asDict()}")
        return self.rewrite(source, source, keys, **more) if self.exists() else self.replace(source, **more)

    def insert_new(self, source: DataFrame, keys: list[str]) -> int:
        """Only rows whose key the table doesn't have, of repeated ones the first in the order of their values; no commit if there are none."""
        source = latest(source, keys, [])
        if self.exists():
            source = absent(source, self.read(), keys)
        if source.isEmpty():
            return (self.versions() or [0])[-1]
        return self.append(source)

    def compact(self, cluster_by: list[str], files: int) -> int:
        """The same rows in so many files, those with near values of some columns together: by range of one, on a Z-order curve of several."""
        df = self.read()
        if len(cluster_by) == 1:
            df = df.repartitionByRange(files, *cluster_by).sortWithinPartitions(*cluster_by)
        else:
            df = df.withColumn("_z", z_value(df, cluster_by)).repartitionByRange(files, "_z").sortWithinPartitions("_z").drop("_z")
        part = f"data/{PART}={uuid.uuid4().hex}"
        (df.write.partitionBy(*self.partition_by) if self.partition_by else df.write).parquet(f"{self.path}/{part}")
        return self._commit([part], "compact")

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the last versions and the directories that only dropped ones list."""
        found = self.versions()
        used = {p for v in found[-keep:] for p in self.manifest(v)["parts"]}
        for v in found[:-keep]:
            for p in self.manifest(v)["parts"]:
                if p not in used:
                    self._fs.delete(self._path(f"{self.path}/{p}"), True)
            self._fs.delete(self._path(f"{self.path}/_log/{v:010d}.json"), False)

    def register(self, name: str, database: str | None = None) -> str:
        """The present version as a table of the session's catalog: an external one where one directory holds it all, else a view."""
        if database:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        full = f"`{database}`.`{name}`" if database else f"`{name}`"
        held = self.manifest()
        if database and len(held["parts"]) == 1 and not held.get("removed") and not self.partition_by:
            self.spark.sql(f"DROP TABLE IF EXISTS {full}")
            self.spark.sql(f"CREATE TABLE {full} USING parquet LOCATION '{self.path}/{held['parts'][0]}'")
        else:
            self.read().createOrReplaceTempView(name)
        return full
