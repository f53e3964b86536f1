"""Registered queries of file decoding, PDF words, header scores, image measures, rejected tables and hinted routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom import vocabulary as V
from ledgerloom.operators import classify, cleaning, grid, images, mapping
from ledgerloom.plans.queries import TOKENS, query, raw, source
from ledgerloom.sources import files

NATIONS = {"doc_id": "'r' || n_regionkey", "key": "n_nationkey", "name": "n_name"}
LISTED_ROWS = f"WITH r AS ({source('nation', NATIONS)}), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1)::INT AS row_idx FROM r)"


def file_rows(tables):
    own = tables.select("doc_id", F.array_join("headers", "|").alias("headers"), F.posexplode("cells").alias("row_idx", "cells"))
    return own.withColumn("cells", F.array_join("cells", "|"))


def nation_lines(spark, sf_dir, line: Column):
    """doc_id -> the texts of its nations' lines, in the order of their keys."""
    own = raw(spark, sf_dir, "nation", NATIONS)
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("key")))
    return own.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", line.alias("line")))), lambda x: x["line"]).alias("lines"))


@query(LISTED_ROWS + " SELECT doc_id, 'Key|Full Name|Note' AS headers, row_idx, key || '|' || name || ', \"x\"|' || CASE WHEN key % 2 = 0 THEN '' ELSE ' k' END AS cells FROM n")
def csv_files(spark, sf_dir):
    """CSV bytes with quoted commas and quotes, blank lines and words for missing values, decoded."""
    line = F.concat(F.col("key").cast("string"), F.lit(',"'), F.col("name"), F.lit(', ""x""",'), F.when(F.col("key") % 2 == 0, "N/A").otherwise(" k"), F.lit("\n"))
    content = F.concat(F.lit("Key,Full Name,Note\n"), F.array_join("lines", "\n")).cast("binary")
    documents = nation_lines(spark, sf_dir, line).select("doc_id", F.lit(".csv").alias("suffix"), content.alias("content"))
    return file_rows(files.decode(documents))


@query(LISTED_ROWS + " SELECT doc_id, 'Symbol|Shares|Avg Cost' AS headers, row_idx, 'N' || key || '|' || (key + 10) || '|' || (key + 0.5) AS cells FROM n")
def pdf_files(spark, sf_dir):
    """PDF bytes with a page of words a region, decoded to words and rebuilt as tables."""
    y = (F.lit(700) - 18 * F.col("place")).cast("string")
    cell = lambda x, text: F.concat(F.lit(f"BT /F1 9 Tf 1 0 0 1 {x} "), y, F.lit(" Tm ("), text.cast("string"), F.lit(") Tj ET\n"))
    line = F.concat(cell(50, F.concat(F.lit("N"), F.col("key"))), cell(200, F.col("key") + 10), cell(350, F.concat(F.col("key").cast("string"), F.lit(".5"))))
    head = "".join(f"BT /F1 9 Tf 1 0 0 1 {x} 700 Tm ({t}) Tj ET\n" for x, t in ((50, "Symbol"), (200, "Shares"), (350, "Avg Cost")))
    before = "%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [4 0 R] /MediaBox [0 0 612 792] >> endobj\n3 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj\n"
    before += "4 0 obj << /Type /Page /Parent 2 0 R /Contents 5 0 R /Resources << /Font << /F1 3 0 R >> >> >> endobj\n5 0 obj << >>\nstream\n"
    content = F.concat(F.lit(before + head), F.array_join("lines", ""), F.lit("endstream\nendobj\ntrailer << /Root 1 0 R >>\n%%EOF")).cast("binary")
    documents = nation_lines(spark, sf_dir, line).select("doc_id", F.lit(".pdf").alias("suffix"), content.alias("content"))
    return file_rows(grid.word_tables(files.decode_words(documents).where("error is null").drop("error")))


@query(
    f"""WITH t AS ({source('events', TOKENS)}), l AS (SELECT doc_id, list_sort(list(DISTINCT round_even(x, 0))) AS xs FROM t GROUP BY doc_id),
c AS (SELECT doc_id, list_reduce(list_transform(xs, lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[-1] > 25 THEN list_concat(a, b) ELSE list_concat(list_slice(a, 1, len(a) - 1), [(a[-1] + b[1]) / 2]) END) AS centres,
  CASE WHEN len(xs) > 1 THEN list_reverse_sort(list_transform(range(1, len(xs)), lambda i: {{'g': xs[i + 1] - xs[i], 'i': i}}))[1]['i'] END AS cut, xs FROM l)
SELECT doc_id, (unnest(range(1, len(centres) + 1)) - 1)::INT AS place, unnest(centres) AS centre, list_sum(list_slice(xs, 1, cut)) / cut AS half_1, list_sum(list_slice(xs, cut + 1, len(xs))) / (len(xs) - cut) AS half_2 FROM c"""
)
def column_centres(spark, sf_dir):
    own = raw(spark, sf_dir, "events", TOKENS).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.bround("x", 0))).alias("xs"))
    halves = F.when(F.size("xs") > 1, grid.split_centres(F.col("xs"), F.lit(2)))
    own = own.select("doc_id", grid.running_centres(F.col("xs"), F.lit(25.0)).alias("centres"), halves.alias("halves"))
    return own.select("doc_id", F.posexplode("centres").alias("place", "centre"), F.get("halves", 0).alias("half_1"), F.get("halves", 1).alias("half_2"))


SCORED = {"doc_id": "user_id", "page": "1", "row_no": "event_id % 12", "text": "CASE event_id % 7 WHEN 0 THEN 'Symbol' WHEN 1 THEN ' qty ' WHEN 2 THEN 'symbool' WHEN 3 THEN '' ELSE 'zzzz' END"}


@query(
    f"WITH r AS ({source('events', SCORED)}), s AS (SELECT doc_id, page, row_no, sum(CASE WHEN lower(trim(text)) IN ('symbol', 'qty') THEN 2 WHEN text = 'symbool' THEN 1 ELSE 0 END)::BIGINT AS header_score FROM r WHERE row_no < 10 GROUP BY ALL) "
    "SELECT doc_id, page, row_no AS header_row, header_score FROM s WHERE header_score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY header_score DESC, row_no) = 1"
)
def header_scores(spark, sf_dir):
    return grid.header_rows(raw(spark, sf_dir, "events", SCORED), 10, reject_zero=True)


MEASURED = {
    "p_partkey": "p_partkey", "grid_h": "p_size % 7", "grid_v": "p_partkey % 6", "blobs": "p_partkey % 9", "all_blobs": "p_size * 2", "columns": "p_partkey % 11", "rows": "p_size % 5",
    "full_columns": "p_partkey % 4", "spread": "cast((p_partkey % 10) AS double) / 10", "density": "CASE WHEN p_size % 3 = 0 THEN 0.05 ELSE 0.02 END", "width": "p_size * 40", "height": "p_partkey % 200",
}


@query(
    f"SELECT p_partkey, (grid_h >= 4 AND grid_v >= 4) OR (blobs::DOUBLE / greatest(all_blobs, 1) >= 0.08 AND blobs >= 4 AND columns >= 2 AND rows >= 2 AND NOT (columns > 8 AND spread > 0.70) AND full_columns >= 2) "
    f"OR (density > {V.DENSE} AND blobs >= 6 AND columns >= 2 AND rows >= 3) AS has_table, width > 0 AND height > 0 AND NOT (width < {V.MIN_IMAGE_WIDTH} AND height < {V.MIN_IMAGE_HEIGHT}) AS readable FROM ({source('part', MEASURED)})"
)
def table_structure(spark, sf_dir):
    own = raw(spark, sf_dir, "part", MEASURED)
    measures = {n: F.col(n) for n in ("blobs", "all_blobs", "columns", "rows", "full_columns", "spread")}
    return own.select("p_partkey", images.has_table(F.col("grid_h"), F.col("grid_v"), measures, F.col("density")).alias("has_table"), images.readable(F.col("width"), F.col("height")).alias("readable"))


@query("SELECT n_nationkey AS doc_id, CASE WHEN n_nationkey % 4 = 2 THEN 5 ELSE 2 END::INT AS n_columns, CASE WHEN n_nationkey % 4 = 2 THEN 1 + n_nationkey % 8 ELSE 1 END::INT AS n_rows FROM nation WHERE n_nationkey % 4 = 3 OR (n_nationkey % 4 = 2 AND 1 + n_nationkey % 8 <= 5)")
def rejected_tables(spark, sf_dir):
    """Tables of one column, without names, with one filled row among several, and sound ones."""
    texts = lambda *t: F.array(*map(F.lit, t))
    k = F.col("doc_id") % 4
    own = raw(spark, sf_dir, "nation", {"doc_id": "n_nationkey"})
    blanks = F.array_repeat(F.array_repeat(F.lit(""), 5), (F.col("doc_id") % 8).cast("int"))
    own = own.withColumn("headers", F.when(k == 0, texts("a")).when(k == 1, texts("", "Unnamed: 1", "nan", "x")).when(k == 2, texts(*"abcde")).otherwise(texts("a", "b")))
    own = own.withColumn("cells", F.when(k == 2, F.concat(F.array(texts(*"12345")), blanks)).otherwise(F.array(F.transform("headers", lambda h: F.lit("v")))))
    return cleaning.normalise(own).select("doc_id", F.size("headers").alias("n_columns"), F.size("cells").alias("n_rows"))


HINTED = {
    0: ("holding", ["symbol", "current weight", "target weight", "action"], "rebalance_plan"),
    1: ("constituent_holding", ["symbol", "weight"], "constituent_holding"),
    2: ("constituent_holding", ["symbol", "shares", "weight"], "holding"),
    3: ("holding", ["symbol", "weight"], "constituent_fallback"),
    4: ("transaction", ["symbol", "shares"], "holding"),
}


@query("SELECT n_nationkey AS doc_id, CASE n_nationkey % 5 " + " ".join(f"WHEN {k} THEN '{way}'" for k, (_, _, way) in HINTED.items()) + " END AS route FROM nation")
def hinted_routes(spark, sf_dir):
    """A rebalance plan whatever the hint, constituents by hint, by shares a holding after all, by fallback, and a hint withdrawn."""
    k, hint, names = F.col("doc_id") % 5, F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for n, (own_hint, headers, _) in HINTED.items():
        hint, names = F.when(k == n, own_hint).otherwise(hint), F.when(k == n, F.array(*map(F.lit, headers))).otherwise(names)
    tables = raw(spark, sf_dir, "nation", {"doc_id": "n_nationkey"}).withColumn("headers", names).withColumn("hint", hint)
    return classify.route(mapping.with_maps(tables)).select("doc_id", "route")
