"""The corpus pipeline: documents pass through STAGES, each written as Parquet and read again as the next one's docs.

Every stage but the last returns the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import langid, pii, quality
from ledgerloom.llm.common import fresh_path, table
from ledgerloom.llm.jaccard import Spec, jaccard_join, one_of_each
from ledgerloom.llm.packing import pack_documents
from ledgerloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble the trusted ones among docs; others go."""
    judged = quality.quality(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; texts that the calibrated model rejects go, and a null lang gets the prediction."""
    model = langid.train(langid.sample(docs))
    told = langid.predict(docs, model, COLUMNS).where(~F.col("rejected"))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 over five-word shingles."""
    return one_of_each(docs.select(COLUMNS), jaccard_join(docs, Spec(k=5, num=80, den=100)))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms for personal data; their lengths stay."""
    done = pii.pseudonyms(docs.select(COLUMNS), pii.session_key(spark))
    return done.select(*("text" if c == "text" else F.col(f"row.{c}").alias(c) for c in COLUMNS))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequence and offset."""
    return pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the trained models, the similarity join and the pseudonyms; tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
