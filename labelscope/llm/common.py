"""What the pipeline operators share: reading tables, cutting lineage, batch bounds."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from labelscope.llm import textkernel as tk


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader; ``columns`` limits what is read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small enough for Python workers whatever the text lengths.

    Spark reads these settings when a plan runs, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work`` over the batches of a task, after which its memory goes back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            tk.release()

    return run


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) a temporary one is made where it is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all machines share")
    return tempfile.mkdtemp(prefix="labelscope-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of one id column that may be broadcast (about 16 MB).
BROADCAST_ROWS = 500_000


def join_side(ids: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``ids``, one column of a written table, marked for broadcasting if it has at most ``limit`` rows.

    Beyond that it stays as it is and the join shuffles both sides.
    """
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def document_remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus``: the fold a document is in."""
    return F.crc32(F.col(column).cast("string")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, label, text): at most ``limit`` labelled documents of ``docs``, those of the smallest md5 of the id.

    Labels other than 0 and 1, null ids and labels of documents that are not there
    do not count. A doc_id with several labels has the largest, one with several
    texts the smallest.
    """
    known = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(cut(sample)), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def within_bytes(rows: DataFrame, limit: int) -> DataFrame:
    """The first of ``rows`` (doc_id, label, text; a bounded sample, ids distinct) by the md5 of the id whose texts have
    at most ``limit`` bytes together; a text of more than an eighth of it is passed over, a null one has none."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = cut(rows.withColumn("size", size).filter(F.col("size") <= limit // 8))
    order = Window.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = rows.select("doc_id", "size").withColumn("total", F.sum("size").over(order)).filter(F.col("total") <= limit)
    return rows.join(F.broadcast(fitting.select("doc_id")), "doc_id").select("doc_id", "label", "text")


def keep_scored(docs: DataFrame, score: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, np.ndarray]]], keep) -> DataFrame:
    """Rows of ``docs`` for whose score ``keep`` (a function of a column) holds, columns as they were.

    ``score`` gives each batch of rows with its scores. No join is needed, so ids may
    repeat or be missing: every row is judged by its own text. Columns of any name pass
    through; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    name = "_score"
    while name in docs.columns:
        name += "_"
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in score(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=names)

    return docs.mapInArrow(released(run), schema).filter(keep(F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])
