"""The corpus pipeline: stages in order, each written as Parquet and read again as the next one's documents.

Quality classifier (documents that it rejects go), n-gram Jaccard join (the one of smallest id of each group of linked
documents stays), benchmark decontamination (documents with a hit go), secret scans (secrets are masked in the text),
BPE encoding (the result: token ids, their number and digests of each document that is left).

All stages but the last return every column of documents, in no particular order of rows. Rows with a null id pass through each
stage by their own text; repeated rows count as they stand; no rows give none. Documents need doc_id and text; of lang,
source and n_chars, those that are there are the classifier's metadata, and n_chars follows a masked text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import bpe, co_training, decontaminate, ngram_join, secrets
from lakeweave.llm.common import application_dir, table

METADATA = ("lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject.

    A null or empty text is judged as an empty one, a null in the metadata as a value of its own; without labels of
    both classes all documents stay.
    """
    return co_training.keep_good(docs, table(spark, sf_dir, "labels"), [c for c in METADATA if c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links of five-word shingles join (Jaccard 0.75 or more) the one of smallest id.

    Texts without words link with nothing, not even with one another; rows with a null id stay; rows that repeat the
    smallest id stay as often as they come.
    """
    return ngram_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark, or any whole item of fewer words.

    Items without id, text or words are none; a null or empty text has no hit and stays.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each union of secret spans; n_chars, if there, is that of a changed text.

    A null text stays null and an empty one empty.
    """
    return secrets.redacted(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document doc_id, n_tokens, digests of the ids and of what they decode to, and the ids themselves; a null text has none."""
    return bpe.encode(docs, keep_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("encoding", encoding)]

ORACLE_SQL = None  # no SQL has the classifier and the tokenizer; tests/llm holds the pipeline against a plain version


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written whole: Spark's mark of a committed job is there."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over the whole table of documents. With a folder of the caller's, stages that an earlier run wrote there whole are read, not made again."""
    docs, folder = table(spark, sf_dir, "documents"), folder or f"{application_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        if not _finished(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
