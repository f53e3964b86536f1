"""Repair of misplaced columns: tickers or share counts that stand in another column than the mapped one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocabulary as V
from ledgerloom.functions.text import strip

TICKER = r"^[A-Z]{1,6}$"


def shares_of(cells: Column, width: Column, test) -> Column:
    """For each column the share of rows whose cell passes test."""
    n = F.greatest(F.size(cells), F.lit(1))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.size(F.filter(cells, lambda r: F.coalesce(test(strip(F.get(r, i))), F.lit(False)))) / n)


def stray(ratios: Column, own: Column, fine: float, least: float, skip: Column) -> Column:
    """Place of the best other column over ``least`` (of equal ones the first), null where the own one is fine."""
    others = F.filter(F.transform(ratios, lambda r, i: F.struct(r.alias("r"), (-i).alias("i"))), lambda x: (x["r"] > least) & ~F.array_contains(skip, -x["i"]))
    return F.when(F.coalesce(F.get(ratios, own) >= fine, F.lit(False)), None).otherwise(-F.array_max(others)["i"])


def place(headers: Column, header: Column) -> Column:
    """0-based place of a header, null without one."""
    return F.nullif(F.array_position(headers, header), F.lit(0)).cast("int") - 1


def filled(cells: Column, own: Column, other: Column, empty: list[str]) -> Column:
    """cells with blanks of column own taken from column other."""
    return F.transform(cells, lambda r: F.transform(r, lambda c, i: F.when((i == own) & strip(c).isin(empty), F.get(r, other)).otherwise(c)))


def symbol_places(tables: DataFrame, symbol_header: Column) -> DataFrame:
    """tables with ratios (of tickers in each column) -> own and stray, the places of symbols as mapped and as found
    elsewhere; a stray column is named Symbol where none is mapped."""
    found = tables.withColumn("own", place(F.col("headers"), symbol_header))
    found = found.withColumn("stray", stray(F.col("ratios"), F.col("own"), V.SYMBOL_FINE, V.SYMBOL_STRAY, F.array(F.coalesce("own", F.lit(-1)))))
    rename = F.col("stray").isNotNull() & F.col("own").isNull()
    headers = F.when(rename, F.transform("headers", lambda h, i: F.when(i == F.col("stray"), "Symbol").otherwise(h))).otherwise(F.col("headers"))
    return found.withColumn("headers", headers).drop("ratios")


def fill_symbols(cells: Column) -> Column:
    """cells (all rows) with blank symbols of column own taken from column stray."""
    fill = F.col("stray").isNotNull() & F.col("own").isNotNull()
    return F.when(fill, filled(cells, F.col("own"), F.col("stray"), ["", "nan", "None"])).otherwise(cells)


def repair_symbols(tables: DataFrame, symbol_header: Column) -> DataFrame:
    """Fill blank symbols from the column of tickers, or name that column Symbol where none is mapped; adds stray."""
    ratios = shares_of(F.col("cells"), F.size("headers"), lambda c: c.rlike(TICKER))
    found = symbol_places(tables.withColumn("ratios", ratios), symbol_header)
    return found.withColumn("cells", fill_symbols(F.col("cells"))).drop("own")


def ticker_ratios(rows: DataFrame, ids: list[str]) -> DataFrame:
    """ids -> ratios: for each column the share of a table's rows whose cell is a ticker; rows: ids, cells."""
    each = rows.select(*ids, F.posexplode("cells").alias("place", "cell"))
    ratio = F.count_if(F.coalesce(strip("cell").rlike(TICKER), F.lit(False))) / F.count("*")
    columns = each.groupBy(*ids, "place").agg(ratio.alias("ratio"))
    return columns.groupBy(*ids).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def repair_shares(tables: DataFrame, shares_header: Column, symbol_header: Column) -> DataFrame:
    """Fill blank or zero share counts from the most numeric other column. Off in ingest, where it never applies."""
    own, other = place(F.col("headers"), shares_header), place(F.col("headers"), symbol_header)
    size = lambda c: F.abs(F.replace(c, F.lit(","), F.lit("")).try_cast("double"))
    numeric = lambda c: (size(c) > V.SHARE_LEAST) & (size(c) < V.SHARE_MOST)
    found = tables.withColumn("own", own).withColumn("ratios", shares_of(F.col("cells"), F.size("headers"), numeric))
    skip = F.array(F.coalesce("own", F.lit(-1)), F.coalesce(other, F.lit(-1)))
    found = found.withColumn("stray", F.when(F.col("own").isNotNull(), stray(F.col("ratios"), F.col("own"), V.SHARES_FINE, V.SHARES_STRAY, skip)))
    cells = F.when(F.col("stray").isNotNull(), filled(F.col("cells"), F.col("own"), F.col("stray"), ["", "nan", "None", "0"])).otherwise(F.col("cells"))
    return found.withColumn("cells", cells).drop("own", "ratios")
