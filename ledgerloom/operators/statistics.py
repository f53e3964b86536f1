"""Statistics of runs over many documents: pass rates, mean latencies, fields that differ from their defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suites(runs: DataFrame) -> DataFrame:
    """runs (suite, passed, latency_ms, record_count) -> a row a suite; latencies of 0 are left out of their mean."""
    good = F.col("passed")
    return runs.groupBy("suite").agg(
        F.count("*").alias("runs"),
        F.count_if(good).alias("passed"),
        F.round(F.avg(good.cast("double")), 6).alias("pass_rate"),
        F.round(F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms"))), 6).alias("mean_latency_ms"),
        F.round(F.avg(F.when(good, F.col("record_count"))), 6).alias("mean_records"),
    )


def told_fields(fields: Column) -> Column:
    """Of a record as map(field, text) the fields that are neither empty nor zero."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & ~v.isin("", "0", "0.0"))
