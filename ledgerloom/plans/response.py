"""Results as JSON documents, with the typed records of each document by table and row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.ingest import Ingested


def response(done: Ingested, include_warnings: bool = True) -> DataFrame:
    """(doc_id, response): one JSON text a document. Rebalance plans and gains are included."""
    rows = [r.select("doc_id", "table_index", "row_idx", F.to_json(F.struct(*[c for c in r.columns if c not in ("doc_id", "table_index", "row_idx")])).alias("record")) for r in done.records.values()]
    every = reduce(DataFrame.unionByName, rows)
    data = every.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_index", "row_idx", "record"))), lambda x: F.parse_json(x["record"])).alias("data"))
    tables = done.tables.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("table_index", "table_type", "row_count", "record_count", "skipped_rows", "suspicious_rows", "parse_confidence", "parse_status", "skipped", "notes"))).alias("table_summaries"))
    own = done.results.join(data, "doc_id", "left").join(tables, "doc_id", "left")
    none = F.array().cast("array<string>")
    body = F.struct(
        "status", "input_type", "record_count",
        F.struct("doc_type", F.col("classification_confidence").alias("confidence"), "reason").alias("classification"),
        F.coalesce("data", F.array().cast("array<variant>")).alias("data"), "table_summaries", "errors",
        (F.coalesce("warnings", none) if include_warnings else none).alias("warnings"),
    )
    return own.select("doc_id", F.to_json(body).alias("response"))


def preview(done: Ingested, n: int = 3) -> dict[str, list]:
    """The first n records of each type, for a terminal."""
    return {kind: frame.orderBy("doc_id", "table_index", "row_idx").limit(n).collect() for kind, frame in done.records.items()}


def health() -> dict[str, str]:
    return {"status": "ok"}
