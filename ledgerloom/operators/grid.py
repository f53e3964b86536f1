"""Tables from positioned words: rows by vertical gaps, columns by header groups and centres, cells by nearest column.

All steps are windows over a page's words and folds over small arrays; a page is one window partition.
Tokens (of OCR): doc_id, page, seq, y, x, text. Words (of a PDF text layer): doc_id, page, seq, text, x0, x1, top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.operators.mapping import header_points_udf

PAGE = ["doc_id", "page"]


def sessions(rows: DataFrame, order: list, gap: Column, limit: Column, name: str, by: list[str]) -> DataFrame:
    """Number runs of rows whose gap to the row before is at most limit. gap uses the columns of lag."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(gap > limit, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def token_rows(tokens: DataFrame, height: Column | None = None) -> DataFrame:
    """Row numbers of OCR tokens: a new row where y is more than max(12, 1.8 % of the image's height) below the last."""
    order = ["y", "seq"]
    limit = F.greatest(F.lit(12), F.floor((F.lit(500) if height is None else height) * 0.018))
    last = F.lag("y").over(Window.partitionBy(*PAGE).orderBy(*order))
    return sessions(tokens, order, F.abs(F.col("y") - F.coalesce(last, F.col("y"))), limit, "row_no", PAGE)


def word_rows(words: DataFrame) -> DataFrame:
    """Row numbers of PDF words: the limit is 0.6 of the median distance of text lines, at least 4."""
    line = F.bround("top", 0)
    lines = words.select(*PAGE, line.alias("line")).distinct()
    before = F.lag("line").over(Window.partitionBy(*PAGE).orderBy("line"))
    gaps = lines.withColumn("gap", F.col("line") - before).where("gap > 0")
    own = F.sort_array(F.collect_list("gap"))
    limits = gaps.groupBy(*PAGE).agg(F.element_at(own, (F.floor(F.size(own) / 2) + 1).cast("int")).alias("median"))
    order = [line, F.col("x0"), F.col("seq")]
    last = F.lag("top").over(Window.partitionBy(*PAGE).orderBy(*order))
    joined = words.join(limits, PAGE, "left").withColumn("last_top", last)
    limit = F.greatest(F.lit(4.0), F.coalesce("median", F.lit(10.0)) * 0.6)
    return sessions(joined, order, F.abs(F.col("top") - F.coalesce("last_top", F.col("top"))), limit, "row_no", PAGE).drop("median", "last_top")


def header_rows(rows: DataFrame, first: int, reject_zero: bool) -> DataFrame:
    """(page, header_row, header_score): the best of the first rows (of equal ones the earliest)."""
    own = rows.where(F.col("row_no") < first)
    words = own.select("text").distinct().withColumn("points", header_points_udf("text"))
    scores = own.join(words, "text").groupBy(*PAGE, "row_no").agg(F.sum("points").alias("header_score"))
    best = scores.groupBy(*PAGE).agg(F.max_by("row_no", F.struct("header_score", -F.col("row_no"))).alias("header_row"), F.max("header_score").alias("header_score"))
    return best.where("header_score > 0") if reject_zero else best


def running_centres(sorted_xs: Column, gap: Column) -> Column:
    """Fold of ascending positions: within gap of the last centre a position moves it half-way, else it opens one."""

    def step(acc: Column, x: Column) -> Column:
        last, head = F.try_element_at(acc, F.lit(-1)), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) == 0) | (x - last > gap), F.concat(acc, F.array(x))).otherwise(F.concat(head, F.array((last + x) / 2)))

    return F.aggregate(F.transform(sorted_xs, lambda x: x.cast("double")), F.array().cast("array<double>"), step)


def split_centres(xs: Column, n: Column) -> Column:
    """Means of the n segments of ascending positions between the n - 1 widest gaps (of equal ones the later)."""
    gaps = F.transform(F.sequence(F.lit(0), F.size(xs) - 2), lambda i: F.struct((F.get(xs, i + 1) - F.get(xs, i)).alias("g"), i.alias("i")))
    cuts = F.sort_array(F.transform(F.slice(F.sort_array(gaps, asc=False), F.lit(1), n - 1), lambda x: x["i"] + 1))
    edges = F.concat(F.array(F.lit(0)), cuts, F.array(F.size(xs)))

    def mean(i: Column) -> Column:
        own = F.slice(xs, F.get(edges, i) + 1, F.get(edges, i + 1) - F.get(edges, i))
        return F.aggregate(own, F.lit(0.0), lambda a, v: a + v) / F.size(own)

    return F.when(n <= 1, F.array(F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), mean))


def boundaries(centres: Column) -> Column:
    """Midpoints between neighbouring centres."""
    return F.zip_with(F.slice(centres, F.lit(1), F.greatest(F.size(centres) - 1, F.lit(0))), F.slice(centres, F.lit(2), F.greatest(F.size(centres) - 1, F.lit(0))), lambda a, b: (a + b) / 2)


def column_between(x: Column, bounds: Column) -> Column:
    """Column of x among half-open intervals [bound, next bound)."""
    return F.size(F.filter(bounds, lambda b: b <= x))


def nearest_column(x: Column, centres: Column) -> Column:
    """Column with the nearest centre, of equal ones the first."""
    return F.array_min(F.transform(centres, lambda c, i: F.struct(F.abs(x - c).alias("d"), i.alias("i"))))["i"]


def header_groups(words: DataFrame, gap: float = 20.0) -> DataFrame:
    """Header words (one row of a page) -> groups of words less than gap apart: page, group, name, in x order."""
    order = ["x0", "seq"]
    last = F.lag("x1").over(Window.partitionBy(*PAGE).orderBy(*order))
    own = sessions(words.withColumn("last_x1", last), order, F.when(F.col("x0") - F.col("last_x1") >= gap, 1).otherwise(0), F.lit(0), "group", PAGE)
    name = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "seq", "text"))), lambda w: w["text"]), " ")
    return own.groupBy(*PAGE, "group").agg(F.trim(name).alias("name"))


def joined_cells(placed: DataFrame, order: list[str]) -> DataFrame:
    """placed (page, row_no, col_no, text, order) -> page, row_no, col_no, cell: texts of a cell joined in order."""
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda w: w["text"]), " ")
    return placed.groupBy(*PAGE, "row_no", "col_no").agg(F.trim(own).alias("cell"))


def assembled(cells: DataFrame, widths: DataFrame) -> DataFrame:
    """cells and widths (page, n_cols) -> page, row_no, cells array; blanks where no text fell."""
    by_row = cells.groupBy(*PAGE, "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "cell"))).alias("own"))
    full = by_row.join(widths, PAGE)
    return full.select(*PAGE, "row_no", F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda i: F.coalesce(F.try_element_at("own", i), F.lit(""))).alias("cells"))


def tables_of(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """grid (page, row_no, cells) and headers (page, headers, header_row) -> raw tables of the rows below the header."""
    below = grid.join(headers, PAGE).where(F.col("row_no") > F.col("header_row"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda r: r["cells"])
    return below.groupBy(*PAGE, "headers").agg(rows.alias("cells")).withColumn("table_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")))


def word_tables(words: DataFrame) -> DataFrame:
    """PDF words -> raw tables (doc_id, table_index, headers, cells)."""
    enough = words.withColumn("n", F.count("*").over(Window.partitionBy(*PAGE))).where("n >= 4").drop("n")
    rows = word_rows(enough)
    best = header_rows(rows, 3, reject_zero=False)
    on_header = rows.join(best.select(*PAGE, "header_row"), PAGE).where("row_no = header_row")
    groups = header_groups(on_header)
    named = groups.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("group", "name"))), lambda g: g["name"]).alias("names"))
    mids = F.sort_array(F.collect_set(F.bround((F.col("x0") + F.col("x1")) / 2, 0)))
    layout = rows.groupBy(*PAGE).agg(mids.alias("mids")).join(named, PAGE).where(F.size("names") >= 2)
    layout = layout.withColumn("centres", running_centres(F.col("mids"), F.lit(25.0))).where((F.size("centres") == F.size("names")) | (F.size("mids") >= F.size("names")))
    layout = layout.withColumn("centres", F.when(F.size("centres") == F.size("names"), F.col("centres")).otherwise(split_centres(F.col("mids"), F.size("names"))))
    placed = rows.join(layout.select(*PAGE, "centres"), PAGE).withColumn("col_no", nearest_column((F.col("x0") + F.col("x1")) / 2, F.col("centres")))
    grid = assembled(joined_cells(placed, ["x0", "seq"]), layout.select(*PAGE, F.size("centres").alias("n_cols")))
    return tables_of(grid, layout.select(*PAGE, F.col("names").alias("headers")).join(best.select(*PAGE, "header_row"), PAGE))


def token_tables(tokens: DataFrame, width: Column | None = None, height: Column | None = None) -> DataFrame:
    """OCR tokens -> raw tables (doc_id, table_index, headers, cells)."""
    rows = token_rows(tokens, height)
    several = rows.withColumn("last", F.max("row_no").over(Window.partitionBy(*PAGE))).where("last >= 1").drop("last")
    best = header_rows(several, 10, reject_zero=True)
    gap = F.greatest(F.lit(18.0), F.floor((F.lit(500) if width is None else width) * 0.02).cast("double"))
    xs = several.join(best.select(*PAGE, "header_row"), PAGE)
    layout = xs.groupBy(*PAGE, "header_row").agg(F.sort_array(F.collect_list(F.when(F.col("row_no") == F.col("header_row"), F.col("x")))).alias("own"), F.sort_array(F.collect_set(F.bround("x", 0))).alias("every"))
    layout = layout.withColumn("centres", running_centres(F.col("own"), gap))
    layout = layout.withColumn("centres", F.when(F.size("centres") >= 2, F.col("centres")).otherwise(running_centres(F.col("every"), gap))).where(F.size("centres") >= 2)
    placed = xs.drop("header_row").join(layout.select(*PAGE, "centres", "header_row"), PAGE).withColumn("col_no", column_between(F.col("x"), boundaries(F.col("centres"))))
    grid = assembled(joined_cells(placed, ["y", "seq"]), layout.select(*PAGE, F.size("centres").alias("n_cols")))
    heads = grid.join(layout.select(*PAGE, "header_row"), PAGE).where("row_no = header_row")
    return tables_of(grid, heads.select(*PAGE, F.transform("cells", lambda c: F.when(F.trim(c) == "", "col").otherwise(F.trim(c))).alias("headers"), "header_row"))
