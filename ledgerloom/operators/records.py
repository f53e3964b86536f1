"""Typed records from mapped rows. Each parser takes rows with its fields as nullable text columns and adds

* outcome: 'blank' and 'aggregate' (silently dropped), 'skip' (counted), 'record';
* reason: why a row is skipped, else null;
* the typed columns, in a struct ``record``; for holdings also ``issues``, the codes of failed sanity checks, and
  ``issue_texts``, their sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocabulary as V
from ledgerloom.functions import text as X
from ledgerloom.functions.binding import let

FIELDS = {
    "holding": [f for f in V.HOLDING if f not in V.DISPLAY_ONLY],
    "constituent_holding": list(V.CONSTITUENT),
    "transaction": list(V.TRANSACTION),
    "rebalance_plan": list(V.REBALANCE),
}


def absent(field: str) -> Column:
    """No cell, or a blank one."""
    return X.strip(F.coalesce(F.col(field), F.lit(""))).isin("", "nan", "None")


def outcome(rows: DataFrame, rules: list[tuple[str, Column]], aggregates: bool) -> DataFrame:
    """The first rule that holds skips the row."""
    reason = F.lit(None).cast("string")
    for name, test in reversed(rules):
        reason = F.when(test, name).otherwise(reason)
    total = F.lower(X.strip(F.coalesce("symbol", F.lit("")))).isin(V.AGGREGATE_SYMBOLS) if aggregates else F.lit(False)
    what = F.when(absent("symbol"), "blank").when(total, "aggregate").when(reason.isNotNull(), "skip").otherwise("record")
    return rows.withColumn("outcome", what).withColumn("reason", F.when(F.col("outcome") == "skip", reason))


def average_cost(avg: Column, total: Column, shares: Column) -> Column:
    return F.when((avg == 0) & (total > 0) & (shares > 0), F.round(F.try_divide(total, shares), 6)).otherwise(avg)


def sanity_issues(symbol: Column, shares: Column, avg: Column, total: Column) -> Column:
    """Codes of the failed checks of a holding, in order."""
    expected = shares * avg
    off = F.abs(total - expected) / F.greatest(expected, F.lit(1.0)) > V.COST_TOLERANCE
    known = (total > 0) & (shares > 0)
    fund = (F.length(symbol) > 4) | symbol.endswith("X")
    return F.array_compact(
        F.array(
            F.when((shares < 0) | (shares > V.SHARES_MAX), "shares_range"),
            F.when(avg > V.AVG_COST_MAX, "avg_cost_high").when((avg > 0) & (avg < V.AVG_COST_MIN), "avg_cost_low"),
            F.when((avg > 0) & known & off, "cost_mismatch")
            .when((avg > 0) & ~known & fund & (avg > V.FUND_COST), "fund_cost_high")
            .when((avg > 0) & ~known & ~(fund & (avg > V.FUND_COST)) & (avg > V.FEW_SHARES_COST) & (shares < V.FEW_SHARES), "few_shares_high_cost"),
        )
    )


def sanity_note(row_idx: Column, symbol: Column, texts: Column) -> Column:
    return F.when(F.size(texts) > 0, F.format_string("[sanity] Row %d [%s]: %s", row_idx, symbol, F.array_join(texts, "; ")))


def sanity_texts(issues: Column, symbol: Column, shares: Column, avg: Column, total: Column) -> Column:
    """The sentences of failed checks, in the order of their codes; the wording is fixed."""
    expected = shares * avg
    share = F.abs(total - expected) / F.greatest(expected, F.lit(1.0))
    few = short_number(shares)
    texts = {
        "shares_range": F.format_string("shares=%s out of expected range [0, 1B)", few),
        "avg_cost_high": F.format_string(f"avg_cost=%.2f > ${V.AVG_COST_MAX:,} — unrealistic", avg),
        "avg_cost_low": F.format_string("avg_cost=%s < %s — possible OCR garbage", plain_number(avg), F.lit(str(V.AVG_COST_MIN))),
        "cost_mismatch": F.format_string("total_cost %.2f ≠ shares×avg_cost (%s×%.2f=%.2f, diff %s%%)", total, few, avg, expected, F.bround(share * 100, 0).cast("decimal(38,0)").cast("string")),
        "fund_cost_high": F.format_string("avg_cost=%.2f seems high for fund-like symbol '%s' — possible OCR misread", avg, symbol),
        "few_shares_high_cost": F.format_string("avg_cost=%.2f with only %s shares — cross-check manually", avg, few),
    }
    said = F.lit(None).cast("string")

    def sentence(code: Column) -> Column:
        out = said
        for name, text in texts.items():
            out = F.when(code == name, text).otherwise(out)
        return out

    return F.transform(issues, sentence)


def exponent_form(digits: Column, power: Column) -> Column:
    """Two digits of exponent at least, with its sign."""
    return F.concat(digits, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))


def tidy(s: Column) -> Column:
    return F.when(F.instr(s, ".") > 0, F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)


def short_number(x: Column) -> Column:
    """Four significant digits, without trailing zeros; an exponent for what is below 0.0001 or has over four digits."""
    exponent = F.substring_index(F.format_string("%.3e", x), "e", -1).cast("int")
    even = F.coalesce(*(F.when(exponent == p, F.bround(x, 3 - p)) for p in range(-4, 13)), x)  # ties go to the even digit
    scientific = F.format_string("%.3e", even)
    power = F.substring_index(scientific, "e", -1).cast("int")
    plain = F.coalesce(*(F.when(power == p, F.format_string(f"%.{3 - p}f", even)) for p in range(-4, 4)))
    return F.when(x == 0, "0").when((power < -4) | (power >= 4), exponent_form(tidy(F.substring_index(scientific, "e", 1)), power)).otherwise(tidy(plain))


def plain_number(x: Column) -> Column:
    """A small number as short as it reads back: decimal from 0.0001 on, else with an exponent."""
    text = x.cast("string")
    power = F.substring_index(text, "E", -1).cast("int")
    decimal = tidy(x.try_cast("decimal(38,20)").cast("string"))
    return F.when(~text.contains("E"), text).when(x >= 0.0001, decimal).otherwise(exponent_form(tidy(F.substring_index(text, "E", 1)), power))


def parse_holdings(rows: DataFrame) -> DataFrame:
    """Numbers are bound once: record, issues and notes read the bound values."""
    done = outcome(rows, [("missing_shares", (X.number("shares") == 0) & absent("shares"))], aggregates=True)
    numbers = F.struct(*(X.number(c).alias(c) for c in ("shares", "avg_cost_per_share", "total_cost")))
    avg = lambda n: average_cost(n["avg_cost_per_share"], n["total_cost"], n["shares"])
    bound = let(numbers, lambda n: F.struct(n["shares"].alias("shares"), avg(n).alias("avg"), n["total_cost"].alias("total")))
    kept = F.col("outcome") == "record"
    own = done.withColumn("bound", let(bound, lambda n: F.struct(n.alias("n"), X.symbol("symbol").alias("symbol"))))
    n = [F.col(c) for c in ("bound.symbol", "bound.n.shares", "bound.n.avg", "bound.n.total")]
    issues = sanity_issues(*n)
    record = F.struct(
        F.lit("broker_holding").alias("dto_type"), F.col("bound.symbol").alias("symbol"), X.text("name").alias("name"),
        F.col("bound.n.shares").alias("shares"), F.col("bound.n.avg").alias("avg_cost_per_share"), F.col("bound.n.total").alias("total_cost"),
        X.side("side").alias("side"), X.date_text("first_trading_date").alias("first_trading_date"), X.date_text("last_trading_date").alias("last_trading_date"),
        X.number("day_gain").alias("day_gain"), X.number("overall_gain").alias("overall_gain"), X.number("overall_gain_pct").alias("overall_gain_pct"),
    )
    none = F.array().cast("array<string>")
    return own.withColumns({"record": record, "issues": F.when(kept, issues).otherwise(none), "issue_texts": F.when(kept, sanity_texts(issues, *n)).otherwise(none)}).drop("bound")


def parse_constituents(rows: DataFrame) -> DataFrame:
    done = outcome(rows, [("missing_weight_and_price", absent("weight") & absent("price"))], aggregates=False)
    record = F.struct(
        F.lit("constituent_holding").alias("dto_type"), X.symbol("symbol").alias("symbol"), X.text("name").alias("name"),
        X.number("weight").alias("weight"), X.number("price").alias("price"), X.text("holding_type").alias("holding_type"), X.number("change").alias("change"),
    )
    return done.withColumn("record", record)


def parse_transactions(rows: DataFrame) -> DataFrame:
    move, shares, when = X.move("transaction_move"), X.number("shares"), X.date_text("executed_at")
    rules = [("unrecognised_move", ~move.isin(list(V.MOVES))), ("missing_executed_at", when.isNull()), ("missing_shares", (shares == 0) & absent("shares"))]
    record = F.struct(
        F.lit("transaction").alias("dto_type"), X.symbol("symbol").alias("symbol"), move.alias("transaction_move"), shares.alias("shares"),
        *(X.number(c).alias(c) for c in ("price_per_share", "total_amount", "commission", "fees", "net_amount")),
        when.alias("executed_at"), X.date_text("settled_at").alias("settled_at"), X.text("notes").alias("notes"),
    )
    return outcome(rows, rules, aggregates=False).withColumn("record", record)


def parse_rebalance(rows: DataFrame) -> DataFrame:
    current, target, drift = (X.number(c) for c in ("current_weight", "target_weight", "drift"))
    derived = F.when((drift == 0) & (current != 0) & (target != 0), F.round(target - current, 6)).otherwise(drift)
    record = F.struct(
        F.lit("rebalance_plan").alias("dto_type"), X.symbol("symbol").alias("symbol"), X.lower_text("name").alias("name"),
        current.alias("current_weight"), target.alias("target_weight"), derived.alias("drift"), X.lower_text("action").alias("action"),
        X.number("trade_amount").alias("trade_amount"), X.number("trade_shares").alias("trade_shares"),
    )
    return outcome(rows, [("missing_weights", absent("current_weight") & absent("target_weight"))], aggregates=True).withColumn("record", record)


PARSERS = {"holding": parse_holdings, "constituent_holding": parse_constituents, "transaction": parse_transactions, "rebalance_plan": parse_rebalance}
