"""Gates of image documents and the choice among OCR results, on decoded measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import vocabulary as V


def borderless(blobs: DataFrame) -> DataFrame:
    """blobs (doc_id, x, y, w, h, img_w, img_h) -> doc_id, blobs, columns, rows, spread, full_columns of plausible text blobs."""
    area = F.col("w") * F.col("h") / (F.col("img_w") * F.col("img_h"))
    fit = (area > 0.0001) & (area < 0.10) & (F.col("h") <= 0.15 * F.col("img_h")) & (F.col("w") <= 0.90 * F.col("img_w")) & (F.col("w") >= F.col("h"))
    all_ = blobs.groupBy("doc_id").agg(F.count("*").alias("all_blobs"))
    own = blobs.where(fit).select("doc_id", F.floor((F.col("x") + F.col("w") / 2) * 20 / F.col("img_w")).alias("c"), F.floor((F.col("y") + F.col("h") / 2) * 20 / F.col("img_h")).alias("r"))
    columns = own.groupBy("doc_id", "c").agg(F.count("*").alias("n"))
    wide = columns.groupBy("doc_id").agg(F.count("*").alias("columns"), F.count_if(F.col("n") >= 2).alias("full_columns"), ((F.max("c") - F.min("c")) / 20).alias("spread"))
    tall = own.groupBy("doc_id").agg(F.count("*").alias("blobs"), F.count_distinct("r").alias("rows"))
    return all_.join(tall, "doc_id", "left").join(wide, "doc_id", "left").fillna(0)


def has_table(grid_h: Column, grid_v: Column, measures: dict[str, Column], density: Column) -> Column:
    """A line grid, or blobs in columns and rows, or (in dense images) enough of them."""
    m = measures
    table = (m["blobs"] / F.greatest(m["all_blobs"], F.lit(1)) >= 0.08) & (m["blobs"] >= 4) & (m["columns"] >= 2) & (m["rows"] >= 2)
    table = table & ~((m["columns"] > 8) & (m["spread"] > 0.70)) & (m["full_columns"] >= 2)
    dense = (density > V.DENSE) & (m["blobs"] >= 6) & (m["columns"] >= 2) & (m["rows"] >= 3)
    return ((grid_h >= 4) & (grid_v >= 4)) | table | dense


def gate(width: Column, density: Column, table: Column, allow_ocr: Column) -> Column:
    """Cheap tests first: 'ocr', or why an image is rejected."""
    return (
        F.when(width < V.MIN_IMAGE_WIDTH, F.when(allow_ocr, "resolution_too_low").otherwise("no_table"))
        .when(density < V.MIN_DENSITY, "no_table")
        .when(~table, "no_table")
        .when(~allow_ocr, "ocr_disabled")
        .otherwise("ocr")
    )


def readable(width: Column, height: Column) -> Column:
    """Images of no size, or both narrow and flat, are not read."""
    return (width > 0) & (height > 0) & ~((width < V.MIN_IMAGE_WIDTH) & (height < V.MIN_IMAGE_HEIGHT))


def confident(tokens: DataFrame) -> DataFrame:
    return tokens.where((F.col("conf") >= V.MIN_TOKEN_CONFIDENCE) & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def best_strategy(counts: DataFrame) -> DataFrame:
    """counts (doc_id, page, strategy, n), strategy 0 the original -> doc_id, page, strategy.

    The original wins with ENOUGH_TOKENS tokens; else the strategy with most tokens, of equal ones the first.
    """
    n = F.when((F.col("strategy") == 0) & (F.col("n") >= V.ENOUGH_TOKENS), F.lit(1 << 30)).otherwise(F.col("n"))
    return counts.groupBy("doc_id", "page").agg(F.max_by("strategy", F.struct(n, -F.col("strategy"))).alias("strategy"))


def adapt_lines(lines: list) -> list[tuple[list, str, float]]:
    """(box, text, confidence) from the shapes in which OCR engines give lines: pairs, dictionaries, parallel lists."""
    found = []
    for line in lines or []:
        if isinstance(line, dict):
            own = line.get("transcription") or {}
            found.append((line.get("points") or line.get("bbox") or [], own.get("text"), own.get("score")))
        elif hasattr(line, "rec_texts"):
            found += zip(line.dt_polys or [], line.rec_texts or [], line.rec_scores or [], strict=False)
        elif isinstance(line, list | tuple) and len(line) == 2 and isinstance(line[1], list | tuple) and len(line[1]) == 2:
            found.append((line[0], *line[1]))
    kept = []
    for box, text, score in found:
        try:
            own, sure = str(text or "").strip(), float(score or 0)
        except (TypeError, ValueError):
            continue
        if own and sure >= V.MIN_TOKEN_CONFIDENCE:
            kept.append((box, own, sure))
    return kept
