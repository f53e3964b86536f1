"""Cleaning of raw tables: headers, cells, empty columns, rejection of what is no table; two-row headers of PDF tables.

A raw table is a row (doc_id, table_index, headers, cells) whose cells are an array of rows, each an array of texts. The
whole ingestion also takes a table in parts, rows with the same id, index and headers and some of its rows each:
``heads`` judges it by sums over its parts, so no task holds a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocabulary as V
from ledgerloom.functions.text import clean_cell, strip
from ledgerloom.functions.binding import let

SPACES = r"(?U)\s+"


def clean_header(h: Column, i: Column) -> Column:
    """Lower case, single spaces; blank and unnamed headers become col_i."""
    own = F.lower(strip(F.regexp_replace(F.coalesce(h, F.lit("")), SPACES, " ")))
    bare = (own == "") | own.startswith("unnamed:") | (own == "nan")
    return F.when(bare, F.concat(F.lit("col_"), i.cast("string"))).otherwise(own)


def deduplicated(headers: Column) -> Column:
    """The second of equal headers gets _1, the third _2; made names are not compared again."""

    def name(h: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(headers, F.lit(1), i), lambda x: x == h))
        return F.when(before == 0, h).otherwise(F.concat(h, F.lit("_"), before.cast("string")))

    return F.transform(headers, name)


def is_placeholder(h: Column) -> Column:
    return h.rlike(r"^col_\d+$")


def padded(row: Column, width: Column) -> Column:
    """A row of exactly width cells: blanks are added, cells beyond are left out."""
    blanks = F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))
    return F.slice(F.concat(row, blanks), F.lit(1), width)


def cleaned(headers: Column, cells: Column) -> Column:
    """struct(headers, cells, ok) of a raw table; every step is bound once."""

    def finish(h: Column, c: Column, used: Column) -> Column:
        return F.struct(
            F.transform(used, lambda i: F.get(h, i)).alias("headers"),
            F.transform(c, lambda r: F.transform(used, lambda i: F.get(r, i))).alias("cells"),
        )

    def judge(t: Column) -> Column:
        filled = F.size(F.filter(F.flatten(t["cells"]), lambda c: c != "")) / F.greatest(F.size(t["cells"]) * F.size(t["headers"]), F.lit(1))
        ok = (F.size(t["cells"]) > 0) & (F.size(t["headers"]) >= V.MIN_COLUMNS) & (filled >= V.SPARSE_SHARE) & (unnamed_share(t["headers"]) <= V.PLACEHOLDER_SHARE)
        return F.struct(t["headers"].alias("headers"), t["cells"].alias("cells"), ok.alias("ok"))

    def columns(h: Column) -> Column:
        own = F.transform(cells, lambda r: F.transform(padded(r, F.size(h)), clean_cell))
        places = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
        return let(own, lambda c: let(F.filter(places, lambda i: F.exists(c, lambda r: F.get(r, i) != "")), lambda used: finish(h, c, used)))

    return let(let(let(F.transform(headers, clean_header), deduplicated), columns), judge)


def normalise(raw: DataFrame) -> DataFrame:
    """Clean headers and cells, leave out empty columns, and keep what is a table: two columns, filled and named enough."""
    rest = [c for c in raw.columns if c not in ("headers", "cells")]
    # the id is not null; it keeps the filter from being pushed below, where the table would be cleaned twice
    own = raw.select(*rest, cleaned(F.col("headers"), F.col("cells")).alias("table"), F.monotonically_increasing_id().alias("seen"))
    return own.where(F.col("table.ok") & (F.col("seen") >= 0)).select(*rest, "table.headers", "table.cells")


IDS = ["doc_id", "table_index"]


def unnamed_share(headers: Column) -> Column:
    return F.size(F.filter(headers, is_placeholder)) / F.greatest(F.size(headers), F.lit(1))


def heads(raw: DataFrame) -> DataFrame:
    """What normalise() keeps, a row a table without its cells: doc_id, table_index, headers, used (the places of its
    columns in the raw rows). A raw table may come in parts."""
    rows = raw.select(*IDS, F.size("headers").alias("width"), F.explode("cells").alias("row"))
    each = rows.select(*IDS, F.posexplode(padded(F.col("row"), F.col("width"))).alias("place", "cell"))
    columns = each.groupBy(*IDS, "place").agg(F.count("*").alias("n"), F.count_if(clean_cell("cell") != "").alias("filled"))
    used = F.array_sort(F.collect_list(F.when(F.col("filled") > 0, F.col("place"))))
    counted = columns.groupBy(*IDS).agg(F.max("n").alias("n_rows"), F.sum("filled").alias("n_filled"), used.alias("used"))
    names = let(let(F.transform("headers", clean_header), deduplicated), lambda h: F.transform("used", lambda i: F.get(h, i)))
    own = raw.select(*IDS, "headers").distinct().join(counted, IDS).withColumn("headers", names)
    filled = F.col("n_filled") / F.greatest(F.col("n_rows") * F.size("headers"), F.lit(1))
    ok = (F.size("headers") >= V.MIN_COLUMNS) & (filled >= V.SPARSE_SHARE) & (unnamed_share(F.col("headers")) <= V.PLACEHOLDER_SHARE)
    return own.where(ok).select(*IDS, "headers", "used")


def squeezed(c: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(c, F.lit(""))), SPACES, " ")


def normalise_pdf(raw: DataFrame) -> DataFrame:
    """raw (cells: all rows, the first the header) -> the same after merging a header of two rows, then normalise.

    Two rows are one header where many names of the first are blank, the second is well filled, and the second is not
    numeric or holds a usual header word.
    """
    blank = lambda h: (h == "") | F.lower(h).startswith("col_") | (F.lower(h) == "nan")
    share = lambda a, test: F.size(F.filter(a, test)) / F.greatest(F.size(a), F.lit(1))
    rows = raw.where(F.size("cells") >= 2).withColumn("first", F.transform(F.get("cells", 0), lambda c, i: F.when(F.coalesce(c, F.lit("")) == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(squeezed(c))))
    rows = rows.withColumn("second", F.transform(F.get("cells", 1), lambda c: strip(F.coalesce(c, F.lit("")))))
    two = (
        (F.size("cells") >= 3)
        & (share(F.col("first"), blank) > 0.3)
        & (share(F.col("second"), lambda v: v != "") > 0.5)
        & ((share(F.col("second"), lambda v: v.rlike(r"^-?[\d,.]+$")) < 0.3) | F.exists("second", lambda v: F.lower(v).isin(V.HEADER_KEYWORDS)))
    )
    merged = F.zip_with(
        F.slice("first", F.lit(1), F.least(F.size("first"), F.size("second"))),
        F.slice("second", F.lit(1), F.least(F.size("first"), F.size("second"))),
        lambda h, r: F.when(blank(h) & (r != ""), r).when((h != "") & (r != "") & (F.lower(h) != F.lower(r)), strip(F.concat_ws(" ", h, r))).otherwise(F.when(h != "", h).otherwise(r)),
    )
    headed = rows.withColumn("two", two).withColumn("names", F.when(F.col("two"), merged).otherwise(F.col("first")))
    named = headed.withColumn("headers", deduplicated(F.transform("names", lambda h, i: F.when(h == "", F.concat(F.lit("col_"), i.cast("string"))).otherwise(h))))
    body = F.slice("cells", F.when(F.col("two"), 3).otherwise(2), F.size("cells"))
    return normalise(named.withColumn("cells", F.transform(body, lambda r: F.transform(r, squeezed))).drop("first", "second", "two", "names"))


#: Tables whose heads are broadcast to their rows; more are joined by shuffle.
BROADCAST_TABLES = 5_000


def exploded(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """One row a table row: the columns of tables (heads, written), then row_idx and cells, clean and of used columns.

    raw may have first_row, the number of a part's first row.
    """
    first = F.col("first_row") if "first_row" in raw.columns else F.lit(0)
    few = tables.limit(BROADCAST_TABLES + 1).count() <= BROADCAST_TABLES
    joined = raw.select(*IDS, first.alias("first_row"), "cells").join(F.broadcast(tables) if few else tables, IDS)
    rows = joined.select(*tables.columns, "first_row", F.posexplode("cells").alias("place", "row"))
    cells = F.transform("used", lambda i: clean_cell(F.get("row", i)))
    return rows.select(*tables.columns, (F.col("first_row") + F.col("place")).alias("row_idx"), cells.alias("cells"))
