"""The whole ingestion: documents -> raw tables -> clean tables -> classes -> typed records -> summaries and results."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import messages as M
from ledgerloom.functions.text import category, round_half_even, suffix
from ledgerloom.operators import classify, cleaning, grid, mapping, records, repair, rollup
from ledgerloom.functions.cut import cut
from ledgerloom.sources import files

ROUTES = {"holding": "holding", "constituent_holding": "constituent", "transaction": "transaction", "rebalance_plan": "rebalance"}


@dataclass
class Ingested:
    """What an ingestion gives: lazy frames over the tables that were written while it was built; records by type, every row's outcome, and the summaries."""

    records: dict[str, DataFrame]
    outcomes: DataFrame
    classification: DataFrame
    tables: DataFrame
    results: DataFrame
    warnings: DataFrame
    errors: DataFrame
    built_ms: dict[str, float] = field(default_factory=dict)


IDS = cleaning.IDS


def routed_tables(classified: DataFrame, raw: DataFrame) -> DataFrame:
    """Financial tables with their maps and route; holding tables are repaired and matched again (own, stray: where
    their symbols are mapped and stand)."""
    money = classified.where("doc_type != 'non_financial'")
    first = classify.route(money.withColumn("hint", F.when(F.col("confidence") == "high", F.col("doc_type"))))
    nowhere = F.lit(None).cast("int")
    others = first.where(~F.col("route").isin("holding", "constituent_fallback", "none_holding")).withColumns({"own": nowhere, "stray": nowhere})
    holdings = first.where(F.col("route").isin("holding", "constituent_fallback", "none_holding"))
    ratios = repair.ticker_ratios(cleaning.exploded(raw, holdings.select(*IDS, "used")), IDS)
    fixed = cut(repair.symbol_places(holdings.join(ratios, IDS), F.try_element_at("maps.holding", F.lit("symbol"))).drop("maps", "route", "route_missing"))
    again = classify.route(mapping.with_maps(fixed))
    return others.unionByName(again)


def parse(routed: DataFrame, raw: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Records by type, and the outcomes of all rows (doc_id, table_index, table_type, row_idx, outcome, suspicious, note)."""
    heads = routed.select(*IDS, "headers", "used", "maps", "route", "own", "stray")
    rows = cleaning.exploded(raw, heads).withColumn("cells", F.get(repair.fill_symbols(F.array("cells")), 0))
    kind = F.when(F.col("route") == "constituent_fallback", "constituent_holding").otherwise(F.col("route"))
    found, outcomes = {}, []
    for name, vocabulary in ROUTES.items():
        own = rows.where(kind == name)
        cells = mapping.project(own, F.col(f"maps.{vocabulary}"), records.FIELDS[name]).select("doc_id", "table_index", "row_idx", *records.FIELDS[name])
        done = records.PARSERS[name](cells)
        issues = F.col("issue_texts") if name == "holding" else F.array().cast("array<string>")
        outcomes.append(
            done.select(
                "doc_id", "table_index", F.lit(name).alias("table_type"), "row_idx", "outcome", "reason", (F.size(issues) > 0).alias("suspicious"),
                records.sanity_note(F.col("row_idx"), F.col("record.symbol"), issues).alias("note"),
            )
        )
        found[name] = done.where("outcome = 'record'").select("doc_id", "table_index", "row_idx", "record.*")
    lacking = routed.where(F.col("route").startswith("none_")).select(
        "doc_id", "table_index", F.substring("route", 6, 100).alias("table_type"), F.lit(None).cast("long").alias("row_idx"), F.lit("none").alias("outcome"),
        F.lit(None).cast("string").alias("reason"), F.lit(False).alias("suspicious"), F.lit(None).cast("string").alias("note"),
    )
    every = lacking
    for o in outcomes:
        every = every.unionByName(o)
    return found, every


def route_warnings(routed: DataFrame) -> DataFrame:
    lacks = F.concat(F.lit("[MissingRequiredColumns] "), M.missing_required(F.substring("route", 6, 100), F.col("route_missing"), F.col("headers")))
    fallback = "Parsed as constituent holding (index/fund constituent view): shares column not found, using weight/price instead."
    own = F.when(F.col("route").startswith("none_"), lacks).when(F.col("route") == "constituent_fallback", fallback)
    return routed.select("doc_id", "table_index", F.lit(0).alias("kind"), own.alias("warning")).where("warning is not null")


def extract(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (with suffix, category, content) -> raw tables of the first pass that gave any, and extraction errors.

    What is decoded is written once. PDF tables of a registered table decoder (passes 1 and 2) get their header rows
    merged here; tables rebuilt from words are pass 3. No word is decoded where no file has a word decoder.
    """
    readable = documents.where(~F.col("category").isin("unsupported", "unknown"))
    decoded = cut(files.decode(readable))
    columns = ["doc_id", "pass_no", "table_index", "headers", "cells"]
    pdf = category(suffix("doc_id")) == "pdf"
    own = decoded.where("error is null")
    tables = own.where(~pdf).select(columns)
    errors = decoded.where("error is not null").select("doc_id", "error")
    if ".pdf" in files.DECODERS:
        two = cleaning.normalise_pdf(own.where(pdf).withColumn("cells", F.concat(F.array("headers"), "cells")))
        tables = tables.unionByName(two.select(columns))
    worded = readable.where(F.col("suffix").isin(list(files.WORD_DECODERS)))
    if worded.select("doc_id").limit(1).count():
        words = cut(files.decode_words(worded.join(tables.select("doc_id").distinct(), "doc_id", "left_anti")))
        rebuilt = grid.word_tables(words.where("error is null").drop("error"))
        tables = tables.unionByName(rebuilt.withColumn("pass_no", F.lit(3)).select(columns))
        errors = errors.unionByName(words.where("error is not null").select("doc_id", "error"))
    raw = cut(files.first_pass(tables).select("doc_id", "table_index", "headers", "cells"))
    return raw, errors.select("doc_id", F.lit("extraction").alias("stage"), F.substring_index("error", ":", 1).alias("error_type"), F.col("error").alias("message"))


def ingest_tables(documents: DataFrame, raw: DataFrame, early: DataFrame) -> Ingested:
    """From documents (doc_id), raw tables (doc_id, table_index, headers, cells) and early errors to results.

    A table may come in parts (see cleaning), with first_row, the number of a part's first row. Its rows are read where
    they are, once for its columns and once to be parsed (tables of holdings once more for tickers); what is written
    are heads and summaries, a row a table.
    """
    began = time.monotonic()
    every = cut(classify.classify_tables(mapping.with_maps(cut(cleaning.heads(raw)))))
    classes = classify.classify_documents(documents, every)
    routed = cut(routed_tables(every, raw))
    found, outcomes = parse(routed, raw)
    tables = cut(rollup.summarise_tables(outcomes))
    tables = tables.withColumn("row_count", F.when(F.col("table_type").isNotNull(), F.col("row_count")))
    per = rollup.summarise_documents(tables, early.select("doc_id"))
    refused = classes.where(~F.col("is_financial")).join(early.select("doc_id"), "doc_id", "left_anti")
    errors = early.unionByName(refused.select("doc_id", F.lit("classification").alias("stage"), rollup.error_type(F.col("doc_type")).alias("error_type"), F.col("reason").alias("message")))
    warnings = route_warnings(routed).unionByName(rollup.table_warnings(tables))
    results = (
        documents.select("doc_id")
        .join(classes.select("doc_id", "doc_type", F.col("confidence").alias("classification_confidence"), "reason"), "doc_id", "left")
        .join(per, "doc_id", "left")
        .join(rollup.ordered_warnings(warnings), "doc_id", "left")
        .join(errors.groupBy("doc_id").agg(F.collect_list(F.struct("stage", "error_type", "message")).alias("errors")), "doc_id", "left")
        .select(
            "doc_id", F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("input_type", F.lit("unknown")).alias("input_type"),
            F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("skipped_rows", F.lit(0)).alias("skipped_rows"),
            F.coalesce("suspicious_rows", F.lit(0)).alias("suspicious_rows"), F.coalesce("table_count", F.lit(0)).alias("table_count"),
            "doc_type", "classification_confidence", "reason", "warnings", "errors",
        )
    )
    return Ingested(found, outcomes, classes, tables, results, warnings, errors, {"build_ms": round((time.monotonic() - began) * 1000, 2)})


def ingest(spark: SparkSession, paths: str | list[str]) -> Ingested:
    """Ingest files: CSV, XLSX, DOCX, PDF text, and what decoders are registered for. Errors are rows; no file is lost."""
    documents = files.read_documents(spark, paths)
    missing = files.missing_paths(spark, paths)
    raw, failed = extract(documents)
    listed = documents.select("doc_id").unionByName(missing.select("doc_id"))
    return ingest_tables(listed, raw, files.routing_errors(documents).unionByName(failed).unionByName(files.missing_errors(missing)))


__all__ = ["Ingested", "ingest", "ingest_tables", "parse", "round_half_even", "routed_tables"]
