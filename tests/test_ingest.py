"""Files to results: fixtures of all readable kinds, errors as rows, and the stream equal to the batch."""

import json
import zipfile
import zlib

import pytest

from ledgerloom.operators import grid, records
from ledgerloom.operators.cleaning import heads, normalise, normalise_pdf
from ledgerloom.operators.mapping import with_maps
from ledgerloom.plans.ingest import ingest, ingest_tables
from ledgerloom.plans.response import response
from ledgerloom.sources import files
from ledgerloom.sources.pdf import pdf_words, to_unicode
from ledgerloom.streaming.files import ingest_stream

HOLDINGS = """Symbol,Name,Shares,Avg Cost,Total Cost,Side,First Trading Date,Last Trading Date
AAPL,Apple Inc,150,182.50,27375.00,long,2023-01-15,2024-03-01
GOOG,Alphabet,40,140.20,5608.00,long,2022-06-10,2024-02-28
TSLA,Tesla,0,220.00,0.00,flat,2021-11-05,2023-08-20
NVDA,Nvidia,80,495.30,39624.00,long,2023-05-22,2024-03-10
"""
TRADES = """Symbol,Type,Quantity,Price,Total Amount,Commission,Fees,Net Amount,Date,Settlement Date,Notes
AAPL,buy,50,178.90,8945.00,1.00,0.15,8946.15,2024-01-10,2024-01-12,
TSLA,sell,30,215.50,6465.00,1.00,0.20,6463.80,2024-01-15,2024-01-17,Partial exit
,buy,1,1,1,1,1,1,2024-01-01,,
NVDA,transfer,1,1,1,1,1,1,2024-01-01,,
NVDA,buy,,1,1,1,1,1,2024-01-01,,
"""
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} {R}><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="t" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>Symbol</t></si><si><t>Shares</t></si><si><t>Avg Cost</t></si><si><t>Total Cost</t></si></sst>")
        head = "".join(f'<c r="{c}1" t="s"><v>{i}</v></c>' for i, c in enumerate("ABCD"))
        z.writestr("xl/worksheets/s.xml", f'<worksheet {S}><sheetData><row r="1">{head}</row><row r="2"><c r="A2" t="inlineStr"><is><t>IBM</t></is></c><c r="B2"><v>10</v></c><c r="D2"><v>1500</v></c></row></sheetData></worksheet>')


def docx(path):
    rows = [["Symbol", "Name", "Shares", "Avg Cost", "Side"], ["KO", "Coca", "5", "60", "long"]]
    body = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:tbl>{body}</w:tbl></w:body></w:document>")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    (d / "holdings.csv").write_text(HOLDINGS)
    (d / "transactions.csv").write_text(TRADES)
    (d / "constituents.csv").write_text("Symbol,Name,Weight,Price,Change\nAAPL,Apple,7.1%,190,0.5\nMSFT,MS,,,\n")
    (d / "rebalance.csv").write_text("Symbol,Current Weight,Target Weight,Action,Trade Amount\nAAPL,10%,12.5%,BUY,\"$1,000\"\n")
    (d / "other.csv").write_text("a,b\n1,2\n")
    (d / "empty.csv").write_text("\n")
    (d / "legacy.doc").write_text("x")
    (d / "scan.pdf").write_bytes(b"%PDF")
    xlsx(d / "book.xlsx")
    docx(d / "table.docx")
    return d


@pytest.fixture(scope="module")
def done(spark, folder):
    return ingest(spark, str(folder))


def by_file(frame):
    return {r["doc_id"].rsplit("/", 1)[1]: r for r in frame.collect()}


def test_results(done):
    got = {k: (r["status"], r["input_type"], r["record_count"]) for k, r in by_file(done.results).items()}
    assert got == {
        "holdings.csv": ("success", "holding", 4), "transactions.csv": ("partial_success", "transaction", 2), "constituents.csv": ("partial_success", "constituent_holding", 1),
        "rebalance.csv": ("success", "rebalance_plan", 1), "other.csv": ("failed", "unknown", 0), "empty.csv": ("failed", "unknown", 0), "legacy.doc": ("failed", "unknown", 0),
        "scan.pdf": ("failed", "unknown", 0), "book.xlsx": ("success", "holding", 1), "table.docx": ("success", "holding", 1),
    }


def test_holdings(done):
    rows = {r["symbol"]: r for r in done.records["holding"].collect()}
    assert (rows["TSLA"]["shares"], rows["TSLA"]["side"], rows["TSLA"]["avg_cost_per_share"]) == (0.0, "flat", 220.0)
    assert (rows["AAPL"]["total_cost"], rows["AAPL"]["last_trading_date"], rows["AAPL"]["day_gain"]) == (27375.0, "2024-03-01", 0.0)
    assert rows["IBM"]["avg_cost_per_share"] == 150.0  # from total cost and shares


def test_transactions_and_skips(done):
    rows = {r["symbol"]: r for r in done.records["transaction"].collect()}
    assert rows["TSLA"]["notes"] == "Partial exit" and rows["AAPL"]["net_amount"] == 8946.15 and rows["AAPL"]["transaction_move"] == "buy"
    reasons = {r["reason"] for r in done.outcomes.where("outcome = 'skip'").collect()}
    assert reasons == {"unrecognised_move", "missing_shares", "missing_weight_and_price"}


def test_other_types_and_errors(done):
    assert done.records["rebalance_plan"].first()["drift"] == 2.5 and done.records["rebalance_plan"].first()["trade_amount"] == 1000.0
    assert done.records["constituent_holding"].first()["weight"] == 7.1
    errors = by_file(done.errors)
    assert errors["legacy.doc"]["message"].startswith("'.doc' files are not supported") and errors["other.csv"]["error_type"] == "NonFinancial"
    assert errors["empty.csv"]["stage"] == "extraction" and "Unsupported" in errors["scan.pdf"]["error_type"]


def test_json(done):
    got = {k: json.loads(r["response"]) for k, r in by_file(response(done)).items()}
    assert [x["symbol"] for x in got["holdings.csv"]["data"]] == ["AAPL", "GOOG", "TSLA", "NVDA"]
    assert got["rebalance.csv"]["data"][0]["dto_type"] == "rebalance_plan" and got["other.csv"]["data"] == []


def test_stream_equals_batch(spark, folder, done, tmp_path):
    seen = []
    query = ingest_stream(spark, str(folder), str(tmp_path / "checkpoint"), lambda d, n: seen.extend(d.results.collect()))
    query.awaitTermination()
    key = lambda r: (r["doc_id"].rsplit("/", 1)[1], r["status"], r["record_count"])
    assert sorted(map(key, seen)) == sorted(map(key, done.results.collect()))


def test_bad_tables_are_rejected(spark):
    raw = [
        (1, ["a"], [["1"], ["2"]]),  # one column
        (2, ["a", "b", "c", "d", "e", "f"], [["1", "", "", "", "", ""]] + [["", "", "", "", "", ""]] * 3 + [["", "2", "3", "4", "5", "6"]] + [[""] * 6] * 8),  # sparse
        (3, ["", "Unnamed: 1", "nan", "x"], [["1", "2", "3", "4"]]),  # no names
        (4, ["A", "a ", "\nA\n"], [["1", "n/a", "3"], ["-", "2", " 4 "]]),
    ]
    got = normalise(spark.createDataFrame(raw, "doc_id int, headers array<string>, cells array<array<string>>")).collect()
    assert [(r["doc_id"], r["headers"], r["cells"]) for r in got] == [(4, ["a", "a_1", "a_2"], [["1", "", "3"], ["", "2", "4"]])]


def test_ragged_pdf_rows(spark):
    raw = spark.createDataFrame([(1, [], [["Symbol", None, "Qty"], ["A", "x", "1"], ["B", "y"]])], "doc_id int, headers array<string>, cells array<array<string>>")
    assert normalise_pdf(raw).first()["cells"] == [["A", "x", "1"], ["B", "y", ""]]


def words_of(rows, xs):
    return [(1, 1, 100 * i + j, w, float(x), float(x + 8 * len(w)), 20.0 * i) for i, row in enumerate(rows) for j, (x, w) in enumerate(zip(xs, row, strict=True))]


def test_word_tables(spark):
    rows = [["Symbol", "Shares", "Price"], ["AAPL", "5", "10.5"], ["MSFT", "7", "11"], ["IBM", "9", "12"]]
    words = spark.createDataFrame(words_of(rows, (50, 200, 350)), "doc_id int, page int, seq int, text string, x0 double, x1 double, top double")
    got = grid.word_tables(words).first()
    assert got["headers"] == rows[0] and got["cells"] == rows[1:]


def test_token_tables(spark):
    rows = [["Report", "of", "today"], ["Symbol", "Shares", "Cost Basis"], ["AAPL", "5", "10.5"], ["MSFT", "7", "11"]]
    tokens = [(1, 1, 10 * i + j, 30.0 * i + j, float(x), w) for i, row in enumerate(rows) for j, (x, w) in enumerate(zip((50, 200, 350), row, strict=True))]
    got = grid.token_tables(spark.createDataFrame(tokens, "doc_id int, page int, seq int, y double, x double, text string")).first()
    assert got["headers"] == rows[1] and got["cells"] == rows[2:]


def test_files_of_no_bytes_and_missing_paths_are_rows(spark, tmp_path):
    (tmp_path / "some folder").mkdir()
    (tmp_path / "some folder" / "zero.csv").write_bytes(b"")
    (tmp_path / "some folder" / "holdings.csv").write_text(HOLDINGS)
    done = ingest(spark, [str(tmp_path / "some folder"), str(tmp_path / "gone.csv")])
    got = by_file(done.results)
    assert {k: r["status"] for k, r in got.items()} == {"zero.csv": "failed", "holdings.csv": "success", "gone.csv": "failed"}
    errors = {k: r["errors"][0] for k, r in got.items() if r["errors"]}
    assert errors["zero.csv"]["error_type"] == "EmptyDataError" and errors["zero.csv"]["stage"] == "extraction"
    assert errors["gone.csv"]["error_type"] == "FileNotFoundError" and "gone.csv" in errors["gone.csv"]["message"]
    alone = ingest(spark, str(tmp_path / "gone.csv")).results.collect()
    assert [r["status"] for r in alone] == ["failed"]


def test_xlsx_dates_booleans_and_phonetic_guides(tmp_path):
    path = tmp_path / "dates.xlsx"
    xlsx(path)
    styles = f'<styleSheet {S}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="21"/></cellXfs></styleSheet>'
    cells = '<c r="A1" t="inlineStr"><is><t>a</t><rPh sb="0" eb="1"><t>guide</t></rPh></is></c><c r="B1" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c>'
    row = '<c r="A2" s="1"><v>45301</v></c><c r="B2" s="2"><v>45301.5</v></c><c r="C2" s="3"><v>45301</v></c><c r="D2" s="4"><v>0.25</v></c><c r="E2" t="b"><v>1</v></c><c r="F2" t="e"><v>#REF!</v></c><c r="G2" s="1"><v>1</v></c>'
    with zipfile.ZipFile(tmp_path / "own.xlsx", "w") as z, zipfile.ZipFile(path) as old:
        for name in old.namelist():
            if not name.endswith("s.xml") or name.endswith("sharedStrings.xml"):
                z.writestr(name, old.read(name))
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/s.xml", f'<worksheet {S}><sheetData><row r="1">{cells}</row><row r="2">{row}</row></sheetData></worksheet>')
    ((_, headers, rows),) = files.decode_xlsx((tmp_path / "own.xlsx").read_bytes())
    assert headers[:2] == ["a", "xy"]
    assert rows == [["2024-01-10 00:00:00", "2024-01-10 12:00:00", "45301", "06:00:00", "True", "", "1900-01-01 00:00:00"]]


def test_docx_merged_cells_and_nested_tables(tmp_path):
    text = lambda x: f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    cell = lambda x, how="": f"<w:tc><w:tcPr>{how}</w:tcPr>{text(x)}</w:tc>"
    nested = f"<w:tc><w:tbl><w:tr>{cell('inner')}</w:tr><w:tr>{cell('inner 2')}</w:tr></w:tbl>{text('c')}</w:tc>"
    body = f"<w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}{cell('h')}</w:tr><w:tr>{cell('tall', '<w:vMerge w:val=\"restart\"/>')}{cell('b')}{nested}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('d')}{cell('e')}</w:tr>"
    path = tmp_path / "m.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body><w:tbl>{body}</w:tbl></w:body></w:document>")
    assert files.decode_docx(path.read_bytes()) == [(1, ["wide", "wide", "h"], [["tall", "b", "c"], ["tall", "d", "e"]])]


def test_null_headers_stay(spark):
    tables = spark.createDataFrame([(1, ["symbol", "shares"]), (2, None), (3, [])], "doc_id int, headers array<string>")
    got = {r["doc_id"]: r["maps"] for r in with_maps(tables).collect()}
    assert got.keys() == {1, 2, 3} and got[1]["holding"] and not got[2]["holding"] and not got[3]["holding"]


def test_sanity_sentences(spark):
    rows = [("AB", "-5", "10", ""), ("AB", "1e10", "", ""), ("AB", "10", "20000000", "200000000"), ("AB", "10", "0.00001", ""), ("AB", "12.5", "100", "2000"), ("LONGFUND", "500", "250", ""), ("AB", "7", "1500", ""), ("AB", "10", "100", "1000")]
    own = spark.createDataFrame([(i, *r, *[None] * 7) for i, r in enumerate(rows)], "i int, symbol string, shares string, avg_cost_per_share string, total_cost string, name string, side string, first_trading_date string, last_trading_date string, day_gain string, overall_gain string, overall_gain_pct string")
    got = {r["i"]: r["issue_texts"] for r in records.parse_holdings(own).collect()}
    assert got[0] == ["shares=-5 out of expected range [0, 1B)"] and got[1] == ["shares=1e+10 out of expected range [0, 1B)"]
    assert got[2][0].startswith("avg_cost=20000000.00 > $") and got[3][0].startswith("avg_cost=1e-05 < ")
    assert got[4] == ["total_cost 2000.00 ≠ shares×avg_cost (12.5×100.00=1250.00, diff 60%)"]
    assert got[5] == ["avg_cost=250.00 seems high for fund-like symbol 'LONGFUND' — possible OCR misread"]
    assert got[6] == ["avg_cost=1500.00 with only 7 shares — cross-check manually"] and got[7] == []


def test_short_numbers_like_a_plain_formatter(spark):
    values = [0.0, 1.0, 12.5, 1234.0, 12345.0, 99999.0, 0.00012345, 0.00001, 1e10, 5.25e-7, 999.96, 0.1]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    got = frame.select(records.short_number(frame.x).alias("s"), records.plain_number(frame.x).alias("p")).collect()
    assert [r["s"] for r in got] == [f"{v:.4g}" for v in values]
    assert [r["p"] for v, r in zip(values, got, strict=True) if 0 < v < 1] == [str(v) for v in values if 0 < v < 1]


def test_numbers_are_bound_once(spark):
    """The plan of holdings with their checks has a bounded number of patterns."""
    own = spark.createDataFrame([], "symbol string, shares string, avg_cost_per_share string, total_cost string, name string, side string, first_trading_date string, last_trading_date string, day_gain string, overall_gain string, overall_gain_pct string")
    plan = records.parse_holdings(own).select("record", "issues")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") <= 16 and plan.count("regexp_extract") == 0


HOLDING_ROWS = [["Symbol", "Name", "Shares", "Avg Cost", "Total Cost", "Side"], ["AAPL", "Apple", "150", "182.50", "27375.00", "long"], ["GOOG", "Alphabet", "40", "140.20", "5608.00", "long"], ["MSFT", "Microsoft", "60", "310.10", "18606.00", "long"], ["NVDA", "Nvidia", "80", "495.30", "39624.00", "short"], ["KO", "Coca (Cola)", "5", "60.00", "300.00", "long"]]
TRADE_ROWS = [["Symbol", "Type", "Shares", "Price", "Total", "Commission", "Net Amt", "Date"], ["AAPL", "buy", "50", "178.90", "8945.00", "1.00", "8946.00", "2024-01-10"], ["TSLA", "sell", "30", "215.50", "6465.00", "1.00", "6464.00", "2024-01-15"], ["KO", "dividend", "5", "0.46", "2.30", "0.00", "2.30", "2024-02-01"], ["IBM", "buy", "7", "180.00", "1260.00", "1.00", "1261.00", "2024-02-02"]]


def shown(rows, width=85):
    """A content stream that shows rows of texts, a text object a cell."""
    quoted = lambda t: t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    return "\n".join(f"BT /F1 9 Tf 1 0 0 1 {30 + j * width} {740 - i * 18} Tm ({quoted(t)}) Tj ET" for i, row in enumerate(rows) for j, t in enumerate(row)).encode()


def pdf_file(pages, packed=False):
    """A PDF file of content streams; packed: Flate streams, and all other objects in an object stream."""
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{10 + 2 * i} 0 R' for i in range(len(pages)))}] /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>".encode(), 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"}
    streams = {}
    for i, body in enumerate(pages):
        plain[10 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >>".encode()
        streams[11 + 2 * i] = (b"/Filter /FlateDecode", zlib.compress(body)) if packed else (b"", body)
    if packed:
        heads, bodies = b"", b""
        for n, body in plain.items():
            heads += f"{n} {len(bodies)} ".encode()
            bodies += body + b" "
        streams[90] = (f"/Type /ObjStm /N {len(plain)} /First {len(heads)} /Filter /FlateDecode".encode(), zlib.compress(heads + bodies))
        plain = {}
    out = b"%PDF-1.5\n" + b"".join(f"{n} 0 obj\n".encode() + b + b"\nendobj\n" for n, b in plain.items())
    out += b"".join(f"{n} 0 obj\n<< /Length {len(b)} ".encode() + f + b" >>\nstream\n" + b + b"\nendstream\nendobj\n" for n, (f, b) in streams.items())
    return out + (b"91 0 obj\n<< /Type /XRef /Root 1 0 R /Length 0 >>\nstream\n\nendstream\nendobj\n" if packed else b"trailer\n<< /Root 1 0 R >>\n") + b"%%EOF"


def test_pdf_words():
    words = pdf_words(pdf_file([b"q 1 0 0 1 10 0 cm BT /F1 10 Tf 20 700 Td [(Av) -100 (g) -2000 (C\\157st)] TJ 0 -20 Td (two words) Tj T* ET Q BT /F1 10 Tf 5 TL 10 100 Td <48 69> Tj (x) ' ET"]))
    assert [(w.page, w.text, round(w.x0)) for w in words] == [(1, "Avg", 30), (1, "Cost", 68), (1, "two", 30), (1, "words", 48), (1, "Hi", 10), (1, "x", 10)]
    assert [round(b.top - a.top) for a, b in zip(words, words[1:], strict=False)] == [0, 20, 0, 580, 5]
    assert pdf_words(pdf_file([shown(HOLDING_ROWS)])) == pdf_words(pdf_file([shown(HOLDING_ROWS)], packed=True))
    image = b"BI /W 2 /H 1 /BPC 8 /CS /G ID (\xff<< EIx EI BT /F1 10 Tf 10 10 Td (after) Tj ET"
    assert [w.text for w in pdf_words(pdf_file([image]))] == ["after"]
    with pytest.raises(ValueError):
        pdf_words(b"no file")
    with pytest.raises(ValueError):
        pdf_words(b"%PDF-1.4\ntrailer << /Encrypt 5 0 R >>")


def test_unicode_maps():
    body = b"2 beginbfchar <0003> <0041> <0004> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<0078> <0079>] endbfrange"
    assert to_unicode(body) == {3: "A", 4: "fi", 16: "a", 17: "b", 18: "c", 32: "x", 33: "y"}


def test_pdf_files(spark, tmp_path):
    (tmp_path / "holdings.pdf").write_bytes(pdf_file([shown(HOLDING_ROWS)]))
    (tmp_path / "trades.pdf").write_bytes(pdf_file([shown([TRADE_ROWS[0], *TRADE_ROWS[1:3]], 70), shown([TRADE_ROWS[0], *TRADE_ROWS[3:]], 70)], packed=True))
    (tmp_path / "picture.pdf").write_bytes(pdf_file([b"q 100 0 0 100 0 0 cm /Im1 Do Q"]))
    (tmp_path / "damaged.pdf").write_bytes(b"PK")
    done = ingest(spark, str(tmp_path))
    got = {k: (r["status"], r["input_type"], r["record_count"]) for k, r in by_file(done.results).items()}
    assert got == {"holdings.pdf": ("success", "holding", 5), "trades.pdf": ("success", "transaction", 4), "picture.pdf": ("failed", "unknown", 0), "damaged.pdf": ("failed", "unknown", 0)}
    rows = {r["symbol"]: r for r in done.records["holding"].collect()}
    assert (rows["NVDA"]["side"], rows["AAPL"]["total_cost"], rows["KO"]["name"]) == ("short", 27375.0, "Coca (Cola)")
    assert {r["symbol"]: r["executed_at"] for r in done.records["transaction"].collect()}["IBM"] == "2024-02-02"
    errors = by_file(done.errors)
    assert errors["damaged.pdf"]["message"] == "ValueError: not a PDF file" and errors["picture.pdf"]["error_type"] == "Unsupported"


def test_registered_pdf_tables_come_first_with_merged_headers(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(files.DECODERS, ".pdf", lambda content: [(1, ["", "", "Avg"], [["Symbol", "Shares", "Cost"], ["IBM", "5", "100"]])] if b"IBM" in content else [])
    (tmp_path / "ruled.pdf").write_bytes(pdf_file([shown([["Symbol", "Shares", "Avg Cost"], ["IBM", "6", "1"], ["KO", "7", "1"]])]))
    (tmp_path / "plain.pdf").write_bytes(pdf_file([shown(HOLDING_ROWS)]))
    done = ingest(spark, str(tmp_path))
    got = {(r["doc_id"].rsplit("/", 1)[1], r["symbol"]): (r["shares"], r["avg_cost_per_share"]) for r in done.records["holding"].collect()}
    assert got[("ruled.pdf", "IBM")] == (5.0, 100.0) and ("ruled.pdf", "KO") not in got and len(got) == 6


def test_tables_in_parts_equal_whole_tables(spark):
    """Rows of a table that come one by one, in any order, give what the whole table gives: blank columns, sparse and
    unnamed tables, short and long rows, tickers in another column."""
    holdings = [["", f"Company {i}", "7", "5.0", "", t, "over"] for i, t in enumerate(["AAPL", "GOOG", "TSLA", "NVDA", "MSFT"])]
    raw = [
        ("a", 1, ["Symbol", "Name", "Shares", "Avg Cost", "Blank", "Code"], holdings),
        ("a", 2, ["Symbol", "Type", "Quantity", "Date", "Symbol"], [["AAPL", "buy", "3", "2024-01-10"], ["X", "transfer", "1", "2024-01-01", "n/a"], ["", "buy"], []]),
        ("b", 1, ["", "", "Symbol", ""], [["1", "2", "3", "4"]]),
        ("b", 2, ["Symbol", "Shares"], [["", ""], ["N/A", "-"]]),
        ("c", 1, ["Symbol", "Weight", "Price"], [["AAPL", "5%", "3"], ["GOOG", "", ""], ["Total", "100", ""]]),
        ("c", 2, ["Symbol", "Shares", "x", "y", "z", "u", "v", "w", "q", "r", "s", "t"], [["AAPL", "", "1"], *[[""] * 12] * 40]),
        ("d", 1, ["Symbol", "Shares"], []),
        ("e", 1, [], [["1"]]),
    ]
    schema = "doc_id string, table_index int, headers array<string>, cells array<array<string>>"
    whole = spark.createDataFrame(raw, schema)
    rows = [(d, t, h, [r], i) for d, t, h, cells in raw for i, r in enumerate(cells)]
    parts = spark.createDataFrame(rows[::-1], schema + ", first_row long").repartition(5)
    documents = whole.select("doc_id").distinct()
    early = spark.createDataFrame([], "doc_id string, stage string, error_type string, message string")
    one, many = (ingest_tables(documents, r, early) for r in (whole, parts))
    plain = lambda frame: sorted(map(repr, frame.collect()))
    assert plain(one.results) == plain(many.results) and plain(one.outcomes) == plain(many.outcomes) and plain(one.warnings) == plain(many.warnings)
    for name, own in one.records.items():
        assert plain(own) == plain(many.records[name])
    assert [r["symbol"] for r in many.records["holding"].orderBy("row_idx").collect() if r["doc_id"] == "a"] == ["AAPL", "GOOG", "TSLA", "NVDA", "MSFT"]
    kept = {(r["doc_id"], r["table_index"]): r["headers"] for r in normalise(whole).collect()}
    assert kept == {(r["doc_id"], r["table_index"]): r["headers"] for r in heads(parts).collect()} and set(kept) == {("a", 1), ("a", 2), ("c", 1)}
