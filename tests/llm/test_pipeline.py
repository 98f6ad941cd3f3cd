from __future__ import annotations

import corpus_pipeline
import pytest
from labelscope.llm import decontaminate, mixing, near_dup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "mixing"]


def test_each_stage_takes_effect(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if name != "mixing":
            assert out.columns == docs.columns == COLUMNS
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        kept.append(docs.count())
    assert kept[0] > 0 and kept == sorted(kept, reverse=True)
    before_mix = spark.read.parquet(str(tmp_path / "3"))
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert decontaminate.contamination(before_mix, bench).filter(decontaminate.is_contaminated()).isEmpty()
    assert near_dup.near_duplicates(before_mix).filter("doc_id <> component_id").isEmpty()
    assert docs.filter("taken <= 0 OR taken > 3 * size").isEmpty()
    total = mixing.mix_documents(before_mix)
    assert total.agg({"taken": "sum"}).first()[0] == docs.agg({"taken": "sum"}).first()[0]


def test_run_equals_the_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    want, got = docs.collect(), corpus_pipeline.run(spark, small).collect()
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, "a b c", "en", "a", 5)]])
def test_stages_on_odd_rows(spark, small, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n", corpus_pipeline.F.lit(1)).withColumn("score", corpus_pipeline.F.lit("s"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        got = out.count()
        assert got <= len(rows)
        if name in ("near_duplicates", "decontamination"):
            assert got == len(rows) and out.columns == docs.columns
