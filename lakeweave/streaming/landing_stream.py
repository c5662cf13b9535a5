"""Structured Streaming ingestion: a landing folder into a raw table, as far as there are files, then it stops.

The stream is one of files, not of rows: its checkpoint remembers which it has seen, and each micro-batch reads its
own files as batch ingestion does, one scan per layout. So columns may come, go or move from file to file within a run,
and lines that don't fit their file's layout are kept in a column of their own.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lakeweave.sources.landing import audited, canonical, landed, pending, scan
from lakeweave.sources.store import SnapshotTable

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_stream(spark: SparkSession, folder: str, raw: SnapshotTable, checkpoint: str, batch_id: str, reference: str, kind: str = "csv", max_files: int = 1000) -> None:
    """Append the files that are new to the stream, as text with the audit columns of a batch and `_rescued_data`.

    Files that the raw table's ledgers have are left out, so a micro-batch that is run again after a failure, or a file
    that batch ingestion took, appends nothing twice. A missing folder has no files.
    """
    extension = "csv" if kind == "csv" else "json"
    if not landed(spark, folder, extension):
        return
    found = spark.readStream.schema(FILES).format("binaryFile").option("maxFilesPerTrigger", max_files).option("pathGlobFilter", f"*.{extension}").load(folder).select("path")

    def store(batch, _number):
        files = pending(spark, sorted(canonical(r["path"]) for r in batch.collect()), raw)  # at most max_files names
        if files:
            raw.append(audited(scan(spark, files, kind, rescued=True), batch_id, reference), files)

    found.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
