"""The corpus pipeline: stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import decontaminate, deobfuscate, mixing, near_dup, quality, toxicity
from labelscope.llm.common import cut, join_side, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, learned on this stage's input, rejects.

    Every row is judged by its own text, a null one as empty; repeated rows and null ids
    stay or go by it; columns of any name pass through; an empty table stays empty.
    Without labels of both classes all rows stay or all go (see ``quality.fit``).
    """
    return quality.keep_good(docs, quality.fit(docs, quality.training_labels(spark, sf_dir)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score as toxic; language model and lexicon come from this stage's input.

    Every row is judged by its own text, a null one as empty; repeated rows and null ids
    stay or go by it; columns of any name pass through; an empty table stays empty.
    Without labels of both classes all rows stay, or all go where all labels are toxic.
    """
    costs = deobfuscate.language_model(toxicity.corpus_trigrams(docs))
    return toxicity.keep_civil(docs, costs, toxicity.fit(docs, toxicity.training_labels(spark, sf_dir), costs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document (the smallest doc_id) of each group of near copies.

    Texts without words and rows without doc_id stay; equal doc_ids are one document.
    """
    found = near_dup.near_duplicates(docs.select("doc_id", "text"))
    gone = cut(found.filter("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(join_side(gone), "doc_id", "left_anti").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents, by the rule of ``decontaminate.is_contaminated``; others stay as they are.

    Rows without doc_id are one document: all go if one is contaminated.
    """
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    gone = cut(found.filter(decontaminate.is_contaminated()).select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(join_side(gone), docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with how many (repeats counted).

    Null and empty texts have no words and go; repeated rows count each on their own; rows
    without doc_id or source are mixed like others; other columns are not read.
    """
    return mixing.mix_documents(docs).filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The classifiers are trained models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder and read again.

    A stage's table goes when the next one's is whole.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        written = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(written)
        docs = spark.read.parquet(written)
        if before is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = written
    return docs
