"""Tables of a run that cut lineage: written once to the folder that all machines share, read back, and dropped after use.

The folder is the session's spark.checkpoint.dir. Only a local session, whose machine is the whole cluster, falls back
to a temporary folder of its own. All tables of an application are below lakeweave/<application>; drop() removes those
that are done with, and what is left goes when the driver's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}  # application -> folder
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lakeweave-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """This application's own folder for scratch tables."""
    name = spark.sparkContext.applicationId
    if name not in _made:
        if not _made:
            atexit.register(_clear)
        _made[name] = f"{shared_dir(spark)}/lakeweave/{name}"
    return _made[name]


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """The same rows, written once as Parquet and read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[id(found)] = found, path
    return found


def drop(*tables: DataFrame | None) -> None:
    """Delete the files of tables of written() that nothing will read again."""
    for t in tables:
        if id(t) in _paths:
            delete(t.sparkSession, _paths.pop(id(t))[1])


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        folder = _made.get(spark.sparkContext.applicationId)
        if folder:
            delete(spark, folder)
