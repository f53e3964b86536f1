"""Messages for users, as column expressions. The wording is fixed: clients show it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def said(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def listed(items: Column, most: int | None = None) -> Column:
    return F.array_join(items if most is None else F.slice(items, 1, most), ", ")


def file_not_found(path: Column) -> Column:
    return said("File not found: '%s'. Please check the file path and try again.", base_name(path))


def unsupported_file_type(suffix: Column) -> Column:
    return said("'%s' files are not supported. Accepted formats: PDF, Excel (.xlsx), CSV, Word (.docx), and images (.jpg, .png, .bmp, .tiff, .webp, .gif).", suffix)


def unknown_file_type(suffix: Column) -> Column:
    return said("Unrecognised file type '%s'. Please upload a PDF, Excel, CSV, Word, or image file.", suffix)


def no_tables_found(suffix: Column) -> Column:
    return (
        F.when(suffix == ".pdf", "The PDF appears to have no extractable tables. If it is a scanned document, try re-uploading with OCR enabled.")
        .when(suffix == ".docx", "No tables were found in the Word document. Make sure the data is in a Word table (Insert → Table), not plain text.")
        .otherwise("No tables could be extracted from the file. Please check that the file contains tabular data.")
    )


def missing_dependency(package: Column, command: Column) -> Column:
    return said("Required package '%s' is not installed. Run: %s", package, command)


def ocr_disabled() -> Column:
    return F.lit("This image file requires OCR to extract data, but OCR is currently disabled. Enable OCR mode and try again.")


def image_no_table(path: Column) -> Column:
    return said("'%s' does not appear to contain a table or spreadsheet. Only images of financial tables (e.g. broker screenshots) are supported. Photos, logos, and charts are not accepted.", base_name(path))


def resolution_too_low(width: Column, height: Column, path: Column) -> Column:
    return said("'%s' has very low resolution (%d×%dpx). OCR accuracy may be poor. For best results, use an image at least 800px wide. The pipeline will attempt extraction anyway.", base_name(path), width, height)


def ocr_no_results(path: Column) -> Column:
    return said("A table was detected in '%s', but OCR could not read any text. Try uploading a higher-resolution version of the image.", base_name(path))


def not_financial(missing: Column, available: Column) -> Column:
    """Missing columns sorted; six found ones at most, placeholders left out."""
    own = F.filter(available, lambda c: ~c.startswith("col_"))
    return said(
        "This does not appear to be a portfolio holdings or transaction file. Missing required columns: %s. Columns found: %s.",
        F.when(F.size(missing) > 0, listed(F.array_sort(missing))).otherwise("symbol, shares"),
        F.when(F.size(own) > 0, listed(own, 6)).otherwise("none recognised"),
    )


def no_financial_columns() -> Column:
    return F.lit("Tables were found in the file, but no financial columns were detected. Expected columns such as: Symbol, Shares, Avg Cost, Date, Commission.")


def missing_required(kind: Column, missing: Column, available: Column) -> Column:
    return said("Cannot parse as %s: required column(s) not found: %s. Columns available: %s.", kind, listed(missing), listed(available, 8))


def rows_skipped(count: Column, kind: Column) -> Column:
    return said("%d %s skipped during %s parsing (missing or invalid data).", count, F.when(count == 1, "row").otherwise("rows"), kind)


def unrecognised_move(raw: Column, row_idx: Column) -> Column:
    return said("Row %d: unrecognised transaction type '%s'. Expected: buy, sell, short sell, cover, or dividend.", row_idx, raw)


def missing_executed_at(row_idx: Column) -> Column:
    return said("Row %d: trade date is missing or could not be parsed — row skipped.", row_idx)


def missing_shares(row_idx: Column) -> Column:
    return said("Row %d: shares value is missing or empty — row skipped.", row_idx)
