"""Landing files: listing, scans as text, audit columns and incremental ingestion into a raw table."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions.columns import layout_fingerprint, row_hash
from lakeweave.operators.joins import evolving_union
from lakeweave.sources.store import SnapshotTable

AT_ONCE = 32  # files whose first lines are read at a time
RESCUED = "_rescued_data"
AUDIT = ("arquivo_origem", "data_ingestao", "timestamp_ingestao", "batch_id", "hash_linha", "schema_version")


def canonical(path: str) -> str:
    """One spelling of a path: decoded, and with one slash after file:."""
    path = unquote(path)
    return "file:/" + path[5:].lstrip("/") if path.startswith("file:") else path


def canonical_column(c):
    return F.regexp_replace(F.expr(f"url_decode(replace({c}, '+', '%2B'))"), "^file:/+", "file:/")


def landed(spark: SparkSession, folder: str, extension: str) -> list[str]:
    """The files of a folder (not below it) with an extension, sorted; hidden ones and those that begin with _ are skipped, a missing folder has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.isFile()]
    return sorted(canonical(p.toString()) for p in found if p.getName().endswith(f".{extension.lstrip('.')}") and p.getName()[0] not in "._")


def pending(spark: SparkSession, files: list[str], raw: SnapshotTable) -> list[str]:
    """The files that the raw table's ledgers don't have."""
    if not files or not raw.exists():
        return files
    listed = spark.createDataFrame([(f,) for f in files], "arquivo_origem string")
    return sorted(r[0] for r in listed.join(raw.sources(), "arquivo_origem", "left_anti").collect())


def headers(spark: SparkSession, files: list[str], separator: str = ",") -> dict[str, tuple[str, ...]]:
    """The column names in the first line of each file; empty files have none. First lines only are read, many files at a time and without a Spark job."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    readers = spark._jvm.java.io

    def first(file: str) -> tuple[str, ...]:
        where = path(file)
        lines = readers.BufferedReader(readers.InputStreamReader(where.getFileSystem(conf).open(where), "UTF-8"))
        try:
            line = lines.readLine()
        finally:
            lines.close()
        return next(csv.reader([line.lstrip("\ufeff")], delimiter=separator), ()) if line else ()

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return {f: tuple(x.strip() for x in names) for f, names in zip(files, pool.map(first, files), strict=True)}


def scan(spark: SparkSession, files: list[str], kind: str, rescued: bool = False) -> DataFrame:
    """Files as text columns with their own path. CSV files are read in one scan per layout, JSON with every primitive as text.

    With rescued, lines that don't fit their file's layout are kept whole in a column of their own, RESCUED.
    """
    more = {"columnNameOfCorruptRecord": RESCUED} if rescued else {}
    extra = f", `{RESCUED}` string" if rescued else ""
    if kind == "json":
        columns = [c for c in spark.read.option("primitivesAsString", True).json(files).schema.fields if c.name != "_corrupt_record"]
        schema = T.StructType([*columns, *([T.StructField(RESCUED, T.StringType())] if rescued else [])])
        frames = [spark.read.options(primitivesAsString=True, **more).schema(schema).json(files)] if columns or rescued else []
    else:
        layouts: dict[tuple[str, ...], list[str]] = {}
        for f, names in headers(spark, files).items():
            layouts.setdefault(names, []).append(f)
        frames = [spark.read.options(header=True, mode="PERMISSIVE", enforceSchema=True, **more).schema(", ".join(f"`{c}` string" for c in names) + extra).csv(own) for names, own in sorted(layouts.items()) if names]
    if not frames:
        return spark.createDataFrame([], "arquivo_origem string, schema_version string")
    return evolving_union(*(f.select("*", canonical_column("_metadata.file_path").alias("arquivo_origem")).withColumn("schema_version", F.lit(layout_fingerprint([c for c in f.columns if c != RESCUED]))) for f in frames))


def audited(df: DataFrame, batch_id: str, reference: str) -> DataFrame:
    """With the audit columns; the hash covers business columns only."""
    business = [c for c in df.columns if c not in (*AUDIT, RESCUED)]
    kept = [RESCUED] if RESCUED in df.columns else []
    return df.select(*business, *kept, "arquivo_origem", F.lit(reference).cast("date").alias("data_ingestao"), F.current_timestamp().alias("timestamp_ingestao"), F.lit(batch_id).alias("batch_id"), row_hash(business).alias("hash_linha"), "schema_version")


def ingest(spark: SparkSession, folder: str, kind: str, raw: SnapshotTable, batch_id: str, reference: str, again: bool = False) -> int | None:
    """Append the files that aren't in the raw table yet (or all, if told to); the new version, or none without files."""
    files = landed(spark, folder, "csv" if kind == "csv" else "json")
    files = files if again else pending(spark, files, raw)
    return raw.append(audited(scan(spark, files, kind), batch_id, reference), files) if files else None
