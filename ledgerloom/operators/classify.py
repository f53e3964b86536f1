"""Classification of tables and documents from header maps, and the choice of a parser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocabulary as V
from ledgerloom.functions import messages as M

FINANCIAL = ["holding", "transaction", "mixed"]
RANKS = {"low": 0, "medium": 1, "high": 2}


def has(map_: Column, field: str) -> Column:
    return F.coalesce(F.map_contains_key(map_, F.lit(field)), F.lit(False))


def points(strict: Column, loose: Column, rules: list[tuple[str, int, bool]]) -> Column:
    total = F.lit(0)
    for field, n, is_strict in rules:
        total = total + F.when(has(strict if is_strict else loose, field), n).otherwise(0)
    return total


def missing(loose: Column, required: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, required)), lambda f: ~F.coalesce(F.map_contains_key(loose, f), F.lit(False)))


def matched(headers: Column, loose: Column, vocabulary: str) -> Column:
    """The headers that fields take, in field order."""
    names = F.array(*map(F.lit, V.VOCABULARIES[vocabulary]))
    return F.filter(F.transform(names, lambda f: F.try_element_at(loose, f)), lambda h: h.isNotNull())


def classify_tables(tables: DataFrame) -> DataFrame:
    """tables with headers and maps -> transaction_score, holding_score, doc_type, confidence, missing, matched_*."""
    m = lambda n: F.col(f"maps.{n}")
    scored = tables.withColumns(
        {
            "transaction_score": points(m("transaction_strict"), m("transaction"), V.TRANSACTION_POINTS),
            "holding_score": points(m("holding_strict"), m("holding"), V.HOLDING_POINTS),
            "missing_holding": missing(m("holding"), V.REQUIRED["holding"]),
            "missing_transaction": missing(m("transaction"), V.REQUIRED["transaction"]),
            "matched_holding": matched(F.col("headers"), m("holding"), "holding"),
            "matched_transaction": matched(F.col("headers"), m("transaction"), "transaction"),
        }
    )
    t, h = F.col("transaction_score"), F.col("holding_score")
    raw = F.when((t > h) & (t >= 2), "transaction").when((t > 0) | (h > 0), "holding").otherwise("non_financial")
    lacks = F.when(F.col("raw") == "transaction", F.col("missing_transaction")).when(F.col("raw") == "holding", F.col("missing_holding")).otherwise(F.array(*map(F.lit, sorted({*V.REQUIRED["holding"], *V.REQUIRED["transaction"]}))))
    best = F.greatest(t, h)
    gone = (F.col("raw") == "non_financial") | ((F.size("missing") > 0) & (best < 2))
    sure = F.when(gone, "high").when(F.size("missing") > 0, "low").when(best >= 4, "high").when(best >= 2, "medium").otherwise("low")
    out = scored.withColumn("raw", raw).withColumn("missing", lacks).withColumn("confidence", sure)
    return out.withColumn("doc_type", F.when(gone, "non_financial").otherwise(F.col("raw"))).drop("raw", "missing_holding", "missing_transaction")


def detect_input_type(maps: Column) -> Column:
    """holding or transaction from the two scores; equal ones are decided by how many fields match."""
    strict = lambda n: maps[f"{n}_strict"]
    t = points(strict("transaction"), maps["transaction"], V.TRANSACTION_POINTS)
    h = points(strict("holding"), maps["holding"], V.HOLDING_POINTS)
    wider = F.size(F.map_keys(maps["transaction"])) > F.size(F.map_keys(maps["holding"]))
    return F.when((t > h) & (t >= 2), "transaction").when(h > t, "holding").when(wider, "transaction").otherwise("holding")


def classify_documents(documents: DataFrame, classified: DataFrame) -> DataFrame:
    """doc_id -> doc_type, confidence (the weakest of its financial tables), reason, is_financial."""
    money = F.col("doc_type").isin("holding", "transaction")
    rank = F.create_map(*(F.lit(x) for p in RANKS.items() for x in p))
    first = lambda c, kind: F.min_by(F.when(F.col("doc_type") == kind, F.col(c)), F.when(F.col("doc_type") == kind, F.col("table_index")))
    per = classified.groupBy("doc_id").agg(
        F.count("*").alias("tables"),
        F.count_if(F.col("doc_type") == "holding").alias("holdings"),
        F.count_if(F.col("doc_type") == "transaction").alias("transactions"),
        F.min(F.when(money, rank[F.col("confidence")])).alias("weakest"),
        first("matched_holding", "holding").alias("holding_columns"),
        first("matched_transaction", "transaction").alias("transaction_columns"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("table_index", F.concat("matched_holding", "matched_transaction").alias("c")))), lambda x: x["c"])).alias("every_column"),
        F.array_distinct(F.flatten(F.collect_list("missing"))).alias("every_missing"),
    )
    joined = documents.select("doc_id").join(per, "doc_id", "left")
    h, t = F.coalesce("holdings", F.lit(0)), F.coalesce("transactions", F.lit(0))
    kind = F.when(F.col("tables").isNull(), "unsupported").when((h == 0) & (t == 0), "non_financial").when(t == 0, "holding").when(h == 0, "transaction").otherwise("mixed")
    sure = F.when(F.col("weakest").isNull(), "high").otherwise(F.element_at(F.array(*map(F.lit, RANKS)), (F.coalesce("weakest", F.lit(0)) + 1).cast("int")))
    noun = F.when(h + t == 1, "table").otherwise("tables")
    empty = (F.size("every_column") == 0) & (F.size("every_missing") == 0)
    reason = (
        F.when(F.col("doc_type") == "holding", M.said("Detected %d holdings %s. Matched columns: %s.", h, noun, M.listed(F.col("holding_columns"), 4)))
        .when(F.col("doc_type") == "transaction", M.said("Detected %d transaction %s. Matched columns: %s.", t, noun, M.listed(F.col("transaction_columns"), 4)))
        .when(F.col("doc_type") == "mixed", M.said("Detected mixed document: %d holdings table(s) and %d transaction table(s).", h, t))
        .when(F.col("doc_type") == "unsupported", "No tables could be extracted from the file.")
        .when(empty, M.no_financial_columns())
        .otherwise(M.not_financial(F.col("every_missing"), F.col("every_column")))
    )
    out = joined.withColumn("doc_type", kind).withColumn("confidence", sure).withColumn("reason", reason)
    return out.select("doc_id", "doc_type", "confidence", "reason", F.col("doc_type").isin(FINANCIAL).alias("is_financial"))


def route(tables: DataFrame) -> DataFrame:
    """tables with maps and hint (a type or null) -> route, route_missing: which parser takes the table.

    A rebalance plan is looked for first, whatever the hint; then transactions, constituents (by hint), holdings, and
    constituents once more where a holding table has no shares. route 'none' parses nothing and says what is missing.
    """
    m = lambda n: F.col(f"maps.{n}")
    hint = F.col("hint")
    kind = F.coalesce(F.when(hint.isin("holding", "transaction", "constituent_holding", "rebalance_plan"), hint), detect_input_type(F.col("maps")))
    r, c = m("rebalance"), m("constituent")
    rebalance = ((kind == "rebalance_plan") | has(r, "target_weight") | has(r, "drift")) & has(r, "symbol") & (has(r, "current_weight") | has(r, "target_weight"))
    lacks_t, lacks_h = missing(m("transaction"), V.REQUIRED["transaction"]), missing(m("holding"), V.REQUIRED["holding"])
    again = F.when((kind == "transaction") & (F.size(lacks_t) > 0) & (hint == "transaction"), detect_input_type(F.col("maps"))).otherwise(kind)
    constituent = has(c, "symbol") & (has(c, "weight") | has(c, "price"))
    way = (
        F.when(rebalance, "rebalance_plan")
        .when((again == "transaction") & (F.size(lacks_t) == 0), "transaction")
        .when(again == "transaction", "none_transaction")
        .when((again == "constituent_holding") & has(m("holding"), "symbol") & has(m("holding"), "shares"), "holding")
        .when((again == "constituent_holding") & constituent, "constituent_holding")
        .when(F.size(lacks_h) == 0, "holding")
        .when(~has(m("holding"), "shares") & constituent, "constituent_fallback")
        .otherwise("none_holding")
    )
    return tables.withColumn("route", way).withColumn("route_missing", F.when(F.col("route") == "none_transaction", lacks_t).when(F.col("route") == "none_holding", lacks_h))
