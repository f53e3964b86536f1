"""Documents from files, and raw tables from documents.

``read_documents`` lists files of any kind with their bytes. ``decode`` turns their bytes into raw tables, a row a table
(doc_id, pass_no, table_index, headers, cells, error); decoders run where the file is read, and what fails is a row with
an error. CSV, XLSX and DOCX are read with the standard library and pandas. ``decode_words`` gives the positioned words
of PDF files, from which the grid operators rebuild tables. Decoders of tables and of words can be registered for other
kinds and for PDF; without any a file gives an error that says what is missing.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import messages as M
from ledgerloom.functions.text import category, suffix
from ledgerloom.sources.pdf import Word, pdf_words

RAW = "doc_id string, pass_no int, table_index int, headers array<string>, cells array<array<string>>, error string"
#: A decoder takes a file's bytes and gives passes of tables: [(pass number, headers, rows)].
Decoder = Callable[[bytes], list[tuple[int, list[str], list[list[str]]]]]
WORDS = "doc_id string, page int, seq int, text string, x0 double, x1 double, top double, error string"
#: A word decoder takes a file's bytes and gives its positioned words.
WordDecoder = Callable[[bytes], list[Word]]


def existing(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[str]]:
    """(paths that stand for a file or folder, paths that do not)."""
    there, gone = [], []
    for p in [paths] if isinstance(paths, str) else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        hits = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        (there if hits else gone).append(p)
    return there, gone


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id (the path), path, suffix, category, n_bytes, content; paths that do not exist are left to missing_paths.

    The engine does not read files of no bytes, so these are added from its own listing.
    """
    there, _ = existing(spark, paths)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = reader.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    listed = [re.sub(r"^file:/+", "file:/", unquote(f)) for f in found.inputFiles()] if there else []
    every = spark.createDataFrame([(f,) for f in listed], "path string")
    empty = every.join(found.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    both = found.select("path", "length", "content").unionByName(empty)
    own = both.select(F.col("path").alias("doc_id"), "path", suffix("path").alias("suffix"), F.col("length").alias("n_bytes"), "content")
    return own.withColumn("category", category("suffix"))


def missing_paths(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """doc_id (the path as given) of paths that do not exist."""
    return spark.createDataFrame([(p,) for p in existing(spark, paths)[1]], "doc_id string")


def missing_errors(missing: DataFrame) -> DataFrame:
    return missing.select("doc_id", F.lit("extraction").alias("stage"), F.lit("FileNotFoundError").alias("error_type"), M.file_not_found(F.col("doc_id")).alias("message"))


def decode_csv(content: bytes) -> list[tuple[int, list[str], list[list[str]]]]:
    """All text; the usual missing-value words become ''; blank lines are skipped."""
    frame = pd.read_csv(io.BytesIO(content), dtype=str).fillna("")
    return [(1, [str(c) for c in frame.columns], frame.astype(str).values.tolist())]


S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def cell_place(ref: str) -> int:
    """0-based column of a cell reference."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def spoken(item: ElementTree.Element | None) -> str:
    """The text of a string item: its own or its runs', without phonetic guides."""
    return "" if item is None else "".join(t.text or "" for part in item if part.tag != f"{S}rPh" for t in part.iter(f"{S}t"))


#: The built-in number formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def date_styles(styles: ElementTree.Element) -> set[str]:
    """Cell styles (by number) whose number format shows a date or time."""
    shown = lambda code: re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.', "", code.split(";")[0].lower())) is not None
    own = {int(f.get("numFmtId")) for f in styles.iter(f"{S}numFmt") if shown(f.get("formatCode", ""))}
    cells = styles.find(f"{S}cellXfs")
    return {str(i) for i, x in enumerate([] if cells is None else cells) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def serial_date(days: float, epoch: dt.datetime) -> str:
    """A day number with its time as text; under one day it is a time."""
    if days < 1 and epoch.year == 1899:
        return str((epoch + dt.timedelta(seconds=round(days * 86400))).time())
    day = days + 1 if epoch.year == 1899 and days < 60 else days  # the first sheets counted a 29 February 1900
    return str(epoch + dt.timedelta(seconds=round(day * 86400)))


def decode_xlsx(content: bytes) -> list[tuple[int, list[str], list[list[str]]]]:
    """Every sheet is a table of texts, its first row the header; dates by their number format, booleans as words."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = [spoken(item) for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{S}si")]
    dated = date_styles(ElementTree.fromstring(book.read("xl/styles.xml"))) if "xl/styles.xml" in names else set()
    first = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{S}workbookPr")
    epoch = dt.datetime(1904, 1, 1) if first is not None and first.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{S}sheet"):
        target = targets[sheet.get(f"{R}id")].lstrip("/")
        part = target if target in names else f"xl/{target}"
        rows = []
        for row in ElementTree.fromstring(book.read(part)).iter(f"{S}row"):
            cells: dict[int, str] = {}
            for c in row.iter(f"{S}c"):
                at = cell_place(c.get("r")) if c.get("r") else len(cells)
                value = c.find(f"{S}v")
                kind = c.get("t", "n")
                if kind == "inlineStr":
                    cells[at] = spoken(c.find(f"{S}is"))
                elif value is None or value.text is None:
                    continue
                elif kind == "s":
                    cells[at] = shared[int(value.text)]
                elif kind == "b":
                    cells[at] = "True" if value.text == "1" else "False"
                elif kind == "e":
                    cells[at] = ""
                elif kind == "n" and c.get("s") in dated:
                    cells[at] = serial_date(float(value.text), epoch)
                else:
                    cells[at] = value.text
            rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
        if rows:
            width = max(map(len, rows))
            full = [r + [""] * (width - len(r)) for r in rows]
            out.append((1, [h or f"Unnamed: {i}" for i, h in enumerate(full[0])], [["" if v in NA_WORDS else v for v in r] for r in full[1:]]))
    return out


#: Fixed value: words that spreadsheet readers take for a missing value.
NA_WORDS = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}


def decode_docx(content: bytes) -> list[tuple[int, list[str], list[list[str]]]]:
    """Every Word table of the body of two rows or more, its first row the header; a merged cell stands in all its places."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{W}body")
    out = []
    for table in body.findall(f"{W}tbl"):
        rows: list[list[str]] = []
        for row in table.findall(f"{W}tr"):
            cells: list[str] = []
            for cell in row.findall(f"{W}tc"):
                span, down = cell.find(f"{W}tcPr/{W}gridSpan"), cell.find(f"{W}tcPr/{W}vMerge")
                text = "\n".join("".join(t.text or "" for t in p.iter(f"{W}t")) for p in cell.findall(f"{W}p")).strip()
                if down is not None and down.get(f"{W}val") != "restart" and rows and len(cells) < len(rows[-1]):
                    text = rows[-1][len(cells)]
                cells += [text] * (int(span.get(f"{W}val")) if span is not None else 1)
            rows.append(cells)
        if len(rows) >= 2:
            out.append((1, rows[0], rows[1:]))
    if not out:
        raise ValueError("no usable table in the Word document")
    return out


DECODERS: dict[str, Decoder] = {".csv": decode_csv, ".xlsx": decode_xlsx, ".docx": decode_docx}
WORD_DECODERS: dict[str, WordDecoder] = {".pdf": pdf_words}


def register_decoder(suffix_: str, decoder: Decoder) -> None:
    """Add or replace the decoder of a suffix (with its dot); it is shipped to the executors."""
    DECODERS[suffix_] = decoder


def register_word_decoder(suffix_: str, decoder: WordDecoder) -> None:
    """The same for a decoder of words; tables of a table decoder come first."""
    WORD_DECODERS[suffix_] = decoder


def decode(documents: DataFrame) -> DataFrame:
    """RAW rows: a table a row, or one row with an error for a file that gives none.

    Files of which only words can be read have no rows here.
    """
    decoders = dict(DECODERS)
    worded = [s for s in WORD_DECODERS if s not in DECODERS]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, kind, content in zip(frame.doc_id, frame.suffix, frame.content, strict=True):
                try:
                    if kind not in decoders:
                        raise LookupError(f"no decoder for '{kind}' files is installed")
                    tables = decoders[kind](bytes(content))
                    rows += [(doc_id, n, i + 1, h, c, None) for i, (n, h, c) in enumerate(tables)]
                except (pd.errors.EmptyDataError, csv.Error) as e:
                    rows.append((doc_id, 0, 0, [], [], f"{type(e).__name__}: {e}"))
                except Exception as e:  # a damaged file is a row of the result
                    rows.append((doc_id, 0, 0, [], [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "pass_no", "table_index", "headers", "cells", "error"])

    return documents.where(~F.col("suffix").isin(worded)).select("doc_id", "suffix", "content").mapInPandas(run, RAW)


def decode_words(documents: DataFrame) -> DataFrame:
    """WORDS rows of the files that have a word decoder: a word a row, or one row with an error."""
    decoders = dict(WORD_DECODERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc_id, kind, content in zip(frame.doc_id, frame.suffix, frame.content, strict=True):
                try:
                    rows = [(doc_id, *w, None) for w in decoders[kind](bytes(content))]
                except Exception as e:  # a damaged file is a row of the result
                    rows = [(doc_id, 0, 0, "", 0.0, 0.0, 0.0, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in WORDS.split(", ")])

    return documents.where(F.col("suffix").isin(list(decoders))).select("doc_id", "suffix", "content").mapInPandas(run, WORDS)


def first_pass(raw: DataFrame) -> DataFrame:
    """Of each document the tables of its first pass that gave any."""
    first = F.min("pass_no").over(Window.partitionBy("doc_id"))
    return raw.withColumn("first", first).where("pass_no = first").drop("first")


def routing_errors(documents: DataFrame) -> DataFrame:
    """(doc_id, stage, error_type, message) of files whose kind cannot be read."""
    kind = F.col("category")
    return documents.where(kind.isin("unsupported", "unknown")).select(
        "doc_id", F.lit("extraction").alias("stage"), F.lit("ValueError").alias("error_type"),
        F.when(kind == "unsupported", M.unsupported_file_type(F.col("suffix"))).otherwise(M.unknown_file_type(F.col("suffix"))).alias("message"),
    )


def read_one_schema(spark: SparkSession, path: str) -> DataFrame:
    """The fast path for large CSV files of one header: rows (headers, cells, row_idx unknown) straight from the reader."""
    frame = spark.read.csv(path, header=True, inferSchema=False, multiLine=True)
    cells = F.array(*(F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in frame.columns))
    return frame.select(F.array(*map(F.lit, frame.columns)).alias("headers"), cells.alias("cells"))
