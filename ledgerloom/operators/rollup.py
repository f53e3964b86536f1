"""Roll-ups of parsed rows: table summaries, then one result a document. Plain grouped aggregates with partial sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocabulary as V

NOTES = 5


def parse_confidence(bad: Column) -> Column:
    return F.when(bad == 0, "high").when(bad <= 2, "medium").otherwise("low")


def table_status(records: Column, skipped: Column, suspicious: Column) -> Column:
    share = suspicious / F.greatest(records + skipped, F.lit(1))
    return F.when(records == 0, "failed").when((skipped > 0) | (share > V.TABLE_SUSPICIOUS), "partial_success").otherwise("success")


def summarise_tables(outcomes: DataFrame) -> DataFrame:
    """outcomes (doc_id, table_index, table_type, row_idx, outcome, suspicious, note) -> a row a table."""
    notes = F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("note").isNotNull(), F.struct("row_idx", "note")))), 1, NOTES), lambda x: x["note"])
    per = outcomes.groupBy("doc_id", "table_index", "table_type").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("outcome") == "record").alias("record_count"),
        F.count_if(F.col("outcome") == "skip").alias("skipped_rows"),
        F.count_if((F.col("outcome") == "record") & F.coalesce("suspicious", F.lit(False))).alias("suspicious_rows"),
        notes.alias("notes"),
    )
    return per.select(
        "*",
        parse_confidence(F.col("skipped_rows") + F.col("suspicious_rows")).alias("parse_confidence"),
        table_status(F.col("record_count"), F.col("skipped_rows"), F.col("suspicious_rows")).alias("parse_status"),
        (F.col("record_count") == 0).alias("skipped"),
    )


def table_warnings(summaries: DataFrame) -> DataFrame:
    """(doc_id, table_index, kind, warning): skipped rows, and tables that gave no record."""
    return summaries.select(
        "doc_id", "table_index",
        F.explode(F.array_compact(F.array(
            F.when(F.col("skipped_rows") > 0, F.struct(F.lit(1).alias("kind"), F.format_string("%d %s skipped during %s parsing (missing or invalid data).", "skipped_rows", F.when(F.col("skipped_rows") == 1, "row").otherwise("rows"), "table_type").alias("warning"))),
            F.when(F.col("record_count") == 0, F.struct(F.lit(2).alias("kind"), F.format_string("Table %d produced no records.", "table_index").alias("warning"))),
        ))).alias("w"),
    ).select("doc_id", "table_index", "w.*")


def document_status(records: Column, suspicious: Column, errors: Column, partial: Column) -> Column:
    return (
        F.when(records == 0, "failed")
        .when(suspicious / F.greatest(records, F.lit(1)) > V.DOCUMENT_SUSPICIOUS, "low_confidence_partial")
        .when((errors > 0) | (partial > 0), "partial_success")
        .otherwise("success")
    )


def summarise_documents(summaries: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A row a document: status, input_type, record_count. errors (doc_id) are stage errors of its tables."""
    types = F.collect_set("table_type")
    per = summaries.groupBy("doc_id").agg(
        F.when(F.size(types) > 1, "mixed").otherwise(F.element_at(types, 1)).alias("input_type"),
        F.sum("record_count").alias("record_count"),
        F.sum("skipped_rows").alias("skipped_rows"),
        F.sum("suspicious_rows").alias("suspicious_rows"),
        F.count_if(F.col("parse_status") == "partial_success").alias("partial_tables"),
        F.count("*").alias("table_count"),
    )
    if errors is None:
        per = per.withColumn("error_count", F.lit(0).cast("long"))
    else:
        per = per.join(errors.groupBy("doc_id").agg(F.count("*").alias("error_count")), "doc_id", "left").fillna(0, ["error_count"])
    return per.withColumn("status", document_status(F.col("record_count"), F.col("suspicious_rows"), F.col("error_count"), F.col("partial_tables")))


def ordered_warnings(warnings: DataFrame) -> DataFrame:
    """(doc_id, warnings): extraction first, then by table and kind."""
    own = F.array_sort(F.collect_list(F.struct("table_index", "kind", "warning")))
    return warnings.groupBy("doc_id").agg(F.transform(own, lambda w: w["warning"]).alias("warnings"))


def error_type(doc_type: Column) -> Column:
    """NonFinancial for non_financial."""
    return F.replace(F.initcap(F.replace(doc_type, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
