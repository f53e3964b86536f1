"""The pipeline's stages one after another, against what each may do to its input."""

from conftest import DATA

import corpus_pipeline as C
from ledgerloom.llm.jaccard import Spec
from tests.llm.helpers import empty_docs
from tests.llm.test_near_copies import brute


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, frames[-1], DATA).write.parquet(str(tmp_path / str(k)))
        frames.append(spark.read.parquet(str(tmp_path / str(k))))
    for before, after in zip(frames[:-2], frames[1:-1], strict=True):
        assert after.columns == docs.columns and after.join(before, "doc_id", "left_anti").count() == 0
    deduplicated, rows = frames[3], [(r["doc_id"], r["text"]) for r in frames[2].collect()]
    assert {r["doc_id"] for r in deduplicated.collect()} == {c for _, _, c in brute(rows, Spec())}
    private = frames[4].where("text rlike '[0-9]@|4[0-9]{15}'").join(frames[3].withColumnRenamed("text", "old"), "doc_id").where("text = old")
    assert private.count() == 0 or all("@" not in r["text"] for r in private.collect())
    assert {r["doc_id"] for r in frames[5].collect()} == {r["doc_id"] for r in frames[4].collect()}
    assert C.run(spark, DATA).count() == frames[5].count()


def test_empty(spark):
    docs = empty_docs(spark).select(C.COLUMNS)
    for _, stage in C.STAGES:
        assert stage(spark, docs, DATA).count() == 0
