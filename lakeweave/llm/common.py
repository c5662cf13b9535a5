"""Small things that several operators share: shared folders, tables that cut lineage, readers."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.sources.scratch import application_dir, delete, drop, shared_dir, written

__all__ = ["application_dir", "bucketed", "carried", "drop", "dropped", "quoted", "release", "shared_dir", "shuffle_parts", "table", "with_texts", "written"]


def bucketed(df: DataFrame, key: str, name: str = "b") -> tuple[DataFrame, str]:
    """The rows as a table bucketed by key in the shared folder, so that joins on key don't move it again; and its name."""
    spark = df.sparkSession
    parts = shuffle_parts(spark)
    table = f"lakeweave_{name}_{uuid.uuid4().hex}"
    path = f"{application_dir(spark)}/{table}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(parts, key).saveAsTable(table)
    return spark.table(table), table


def dropped(spark: SparkSession, name: str) -> None:
    """Drop a table of bucketed() and its files."""
    location = spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete(spark, location)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now rather than when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """A column by its name, whatever dots or marks the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_texts(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, under names of its own, so that no other column can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def carried(docs: DataFrame, inputs: list[Column], function: Callable, combine: Callable[[pa.Table, pa.Table], pa.Table]) -> DataFrame:
    """The rows of docs with all their columns, as combine(rows, results) makes them of a function's results.

    The function gets batches of row numbers and inputs and gives a row for each, in order. So a filter or a change
    needs no join with the texts, and rows without an id or with a repeated one are judged as they stand.
    """
    n, schema = len(docs.columns), docs.schema

    def run(batches):
        for batch in batches:
            own = pa.Table.from_arrays(batch.columns[:n], names=schema.names)
            given = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), *batch.columns[n:]], names=[f"i{k}" for k in range(1 + batch.num_columns - n)])
            if len(batch):
                yield from combine(own, pa.Table.from_batches(list(function(iter([given]))))).to_batches()

    return docs.select(*(quoted(c).alias(f"_own{k}") for k, c in enumerate(docs.columns)), *(x.alias(f"_input{k}") for k, x in enumerate(inputs))).mapInArrow(run, schema)
