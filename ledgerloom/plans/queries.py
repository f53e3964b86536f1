"""The registered queries: every operator applied to raw text tables that are made, by the same SQL in both engines,
from the driver's tables, beside the SQL that says what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import vocabulary as V
from ledgerloom.functions import messages as M
from ledgerloom.functions import text as X
from ledgerloom.functions.cut import cut
from ledgerloom.operators import classify, cleaning, grid, images, mapping, records, repair, rollup, statistics
from ledgerloom.plans.ingest import ingest_tables
from ledgerloom.sources.files import first_pass

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def raw(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str], where: str | None = None) -> DataFrame:
    """A text table from one of the driver's tables; a table of few files is one row group, which one task would read, so its rows are spread."""
    frame = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    wide = spark.sparkContext.defaultParallelism
    if len(frame.inputFiles()) < wide:
        frame = frame.repartition(wide)
    return (frame.where(where) if where else frame).select(*(F.expr(e).alias(n) for n, e in columns.items()))


def source(table: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}"


def amount(x: str) -> str:
    return f"(cast({x} AS decimal(18,2)) || '')"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def number_sql(c: str) -> str:
    bare = f"trim(replace(replace(replace(trim(coalesce({c}, '')), '$', ''), ',', ''), '%', ''))"
    plain = f"CASE WHEN {bare} LIKE '(%)' THEN '-' || substr({bare}, 2, length({bare}) - 2) ELSE {bare} END"
    return f"coalesce(CASE WHEN lower(trim(coalesce({c}, ''))) IN ('', 'nan', 'n/a', '--', '-') THEN 0.0::DOUBLE ELSE try_cast({plain} AS DOUBLE) END, 0.0::DOUBLE)"


def text_sql(c: str) -> str:
    return f"CASE WHEN lower(trim(coalesce({c}, ''))) IN {in_list(V.NULL_TEXTS)} THEN '' ELSE trim(coalesce({c}, '')) END"


def absent_sql(c: str) -> str:
    return f"(trim(coalesce({c}, '')) IN ('', 'nan', 'None'))"


MOVE_CASE = " ".join(f"WHEN {{0}} IN {in_list(words)} THEN '{move}'" for move, words in V.MOVES.items())


def move_sql(c: str) -> str:
    own = f"lower({text_sql(c)})"
    return f"CASE {MOVE_CASE.replace('{0}', own)} ELSE {own} END"


# ------------------------------------------------------------------ scalar functions
NUMBERS = {
    "l_orderkey": "l_orderkey",
    "raw": "CASE l_linenumber % 8 WHEN 0 THEN '$' || " + amount("l_extendedprice") + " WHEN 1 THEN '(' || " + amount("l_quantity") + " || ')' WHEN 2 THEN " + amount("l_discount * 100")
    + " || '%' WHEN 3 THEN '--' WHEN 4 THEN ' 1,' || " + amount("l_quantity + 100") + " || ' ' WHEN 5 THEN 'N/A' WHEN 6 THEN 'abc' ELSE '$(' || " + amount("l_tax") + " || ')' END",
}


@query(f"WITH r AS ({source('lineitem', NUMBERS)}) SELECT l_orderkey, raw, {number_sql('raw')} AS value FROM r")
def to_number(spark, sf_dir):
    return raw(spark, sf_dir, "lineitem", NUMBERS).select("l_orderkey", "raw", X.number("raw").alias("value"))


TEXTS = {"p_partkey": "p_partkey", "raw": "CASE p_partkey % 6 WHEN 0 THEN '  ' || p_brand || ' ' WHEN 1 THEN 'N/A' WHEN 2 THEN ' none' WHEN 3 THEN '-' WHEN 4 THEN NULL ELSE lower(p_type) END"}


@query(
    f"WITH r AS ({source('part', TEXTS)}) SELECT p_partkey, {text_sql('raw')} AS own_text, upper({text_sql('raw')}) AS own_symbol, nullif({text_sql('raw')}, '') AS own_date, "
    f"lower({text_sql('raw')}) AS own_lower, CASE WHEN lower(trim(coalesce(raw, ''))) IN {in_list(V.NULL_CELLS)} THEN '' ELSE trim(coalesce(raw, '')) END AS own_cell FROM r"
)
def clean_texts(spark, sf_dir):
    return raw(spark, sf_dir, "part", TEXTS).select(
        "p_partkey", X.text("raw").alias("own_text"), X.symbol("raw").alias("own_symbol"), X.date_text("raw").alias("own_date"), X.lower_text("raw").alias("own_lower"), X.clean_cell("raw").alias("own_cell")
    )


MOVES = {
    "l_orderkey": "l_orderkey",
    "raw": "CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN 'Bought' WHEN 1 THEN ' SOLD' WHEN 2 THEN 'btc' WHEN 3 THEN 'Div' WHEN 4 THEN 'transfer' WHEN 5 THEN '' WHEN 6 THEN 'BUY 100 AAPL' WHEN 7 THEN 'short sale' ELSE 'n/a' END",
    "side_raw": "CASE l_linenumber % 4 WHEN 0 THEN 'Short ' WHEN 1 THEN 'FLAT' WHEN 2 THEN 'both' ELSE 'long' END",
}


@query(f"WITH r AS ({source('lineitem', MOVES)}) SELECT l_orderkey, raw, {move_sql('raw')} AS move, CASE WHEN lower(trim(side_raw)) IN ('long', 'short', 'flat') THEN lower(trim(side_raw)) ELSE 'long' END AS side FROM r")
def normalise_move(spark, sf_dir):
    return raw(spark, sf_dir, "lineitem", MOVES).select("l_orderkey", "raw", X.move("raw").alias("move"), X.side("side_raw").alias("side"))


FILE_NAMES = ["a.csv", "dir/B.XLSX", "c.pdf", "d.docx", "e.JPeG", "f.tif", "g.doc", "h", "x.y/i.png", "j.tar.gz", ".hidden", "k.webp"]
MIMES = ["text/csv", "application/pdf; charset=x", "application/octet-stream", "IMAGE/PNG", ""]
FILES = {"doc_id": "doc_id", "path": "CASE doc_id % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FILE_NAMES)) + " END", "mime": "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(MIMES)) + " END"}
SUFFIX_SQL = r"lower(regexp_extract(regexp_extract(path, '([^/\\]*)$', 1), '[^.](\.[^.]+)$', 1))"
CATEGORY_SQL = "CASE " + " ".join(f"WHEN suffix IN {in_list(s)} THEN '{k}'" for k, s in V.CATEGORIES.items()) + " ELSE 'unknown' END"
SUPPORTED = [s for k, own in V.CATEGORIES.items() if k != "unsupported" for s in own]
MIME_SQL = "CASE lower(trim(split_part(mime, ';', 1))) " + " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in V.MIME_SUFFIX.items()) + " END"


@query(
    f"WITH r AS ({source('documents', FILES)}), s AS (SELECT *, {SUFFIX_SQL} AS suffix, {MIME_SQL} AS mapped FROM r) SELECT doc_id, suffix, {CATEGORY_SQL} AS category, "
    f"CASE WHEN suffix IN {in_list(SUPPORTED)} THEN 200 WHEN suffix <> '' THEN 415 WHEN mapped IS NOT NULL THEN 200 ELSE 400 END AS status, "
    f"CASE WHEN suffix <> '' THEN suffix ELSE coalesce(mapped, '') END AS upload_suffix FROM s"
)
def file_types(spark, sf_dir):
    up = X.upload_type("path", "mime")
    return raw(spark, sf_dir, "documents", FILES).select("doc_id", X.suffix("path").alias("suffix"), X.category(X.suffix("path")).alias("category"), up["status"].alias("status"), up["suffix"].alias("upload_suffix"))


@query("SELECT doc_id, CASE WHEN n_chars % 7 = 0 THEN 400 WHEN n_chars * 50000 > 52428800 THEN 413 ELSE 200 END AS status FROM documents")
def upload_guards(spark, sf_dir):
    size = "CASE WHEN n_chars % 7 = 0 THEN 0 ELSE n_chars * 50000 END"
    return raw(spark, sf_dir, "documents", {"doc_id": "doc_id", "n": size}).select("doc_id", X.upload_guard("n").alias("status"))


@query(
    "SELECT n_nationkey, n_nationkey || CASE WHEN n_nationkey = 1 THEN ' row' ELSE ' rows' END || ' skipped during transaction parsing (missing or invalid data).' AS skipped, "
    "'Row ' || n_nationkey || ': unrecognised transaction type ''' || n_name || '''. Expected: buy, sell, short sell, cover, or dividend.' AS move, "
    "'''.' || lower(n_name) || ''' files are not supported. Accepted formats: PDF, Excel (.xlsx), CSV, Word (.docx), and images (.jpg, .png, .bmp, .tiff, .webp, .gif).' AS unsupported, "
    "'Cannot parse as holding: required column(s) not found: symbol, shares. Columns available: ' || n_name || ', x.' AS missing FROM nation"
)
def messages(spark, sf_dir):
    own = raw(spark, sf_dir, "nation", {"n_nationkey": "n_nationkey", "n_name": "n_name"})
    array = lambda *c: F.array(*c)
    return own.select(
        "n_nationkey", M.rows_skipped(F.col("n_nationkey"), F.lit("transaction")).alias("skipped"), M.unrecognised_move(F.col("n_name"), F.col("n_nationkey")).alias("move"),
        M.unsupported_file_type(F.concat(F.lit("."), F.lower("n_name"))).alias("unsupported"),
        M.missing_required(F.lit("holding"), array(F.lit("symbol"), F.lit("shares")), array(F.col("n_name"), F.lit("x"))).alias("missing"),
    )


# ------------------------------------------------------------------ records
TRADES = {
    "l_orderkey": "l_orderkey",
    "symbol": "CASE WHEN l_partkey % 17 = 0 THEN ' ' ELSE ' p' || l_partkey END",
    "transaction_move": "CASE l_suppkey % 6 WHEN 0 THEN 'Buy' WHEN 1 THEN 'sold' WHEN 2 THEN 'transfer' WHEN 3 THEN 'SS' WHEN 4 THEN 'reinvest' ELSE 'cover' END",
    "shares": "CASE WHEN l_partkey % 11 = 0 THEN '' WHEN l_partkey % 11 = 1 THEN '0' WHEN l_partkey % 11 = 2 THEN 'abc' ELSE " + amount("l_quantity") + " END",
    "price_per_share": "'$' || " + amount("l_extendedprice"),
    "total_amount": amount("l_extendedprice * l_quantity"),
    "commission": "CASE WHEN l_tax > 0.04 THEN '(' || " + amount("l_tax") + " || ')' END",
    "fees": "'--'",
    "net_amount": amount("l_discount"),
    "executed_at": "CASE WHEN l_suppkey % 7 = 0 THEN 'nan' ELSE cast(cast(l_shipdate AS date) AS {text}) END",
    "settled_at": "cast(NULL AS {text})",
    "notes": "CASE WHEN l_linenumber = 1 THEN 'none' ELSE l_returnflag || ' ' END",
}
SPARK_TRADES = {k: v.replace("{text}", "string") for k, v in TRADES.items()}
DUCK_TRADES = {k: v.replace("{text}", "varchar") for k, v in TRADES.items()}
TRADE_OUTCOME = (
    f"CASE WHEN {absent_sql('symbol')} THEN 'blank' WHEN reason IS NOT NULL THEN 'skip' ELSE 'record' END"
)
TRADE_REASON = (
    f"CASE WHEN {move_sql('transaction_move')} NOT IN ('buy', 'sell', 'short_sell', 'cover', 'dividend') THEN 'unrecognised_move' WHEN nullif({text_sql('executed_at')}, '') IS NULL THEN 'missing_executed_at' "
    f"WHEN {number_sql('shares')} = 0 AND {absent_sql('shares')} THEN 'missing_shares' END"
)
TRADE_RECORD = (
    f"upper({text_sql('symbol')}) AS symbol, {move_sql('transaction_move')} AS transaction_move, "
    + ", ".join(f"{number_sql(c)} AS {c}" for c in ("shares", "price_per_share", "total_amount", "commission", "fees", "net_amount"))
    + f", nullif({text_sql('executed_at')}, '') AS executed_at, nullif({text_sql('settled_at')}, '') AS settled_at, {text_sql('notes')} AS notes"
)


@query(f"WITH r AS ({source('lineitem', DUCK_TRADES)}), o AS (SELECT *, {TRADE_REASON} AS reason FROM r) SELECT l_orderkey, 'transaction' AS dto_type, {TRADE_RECORD} FROM o WHERE {TRADE_OUTCOME} = 'record'")
def parse_transactions(spark, sf_dir):
    return records.parse_transactions(raw(spark, sf_dir, "lineitem", SPARK_TRADES)).where("outcome = 'record'").select("l_orderkey", "record.*")


@query(f"WITH r AS ({source('lineitem', DUCK_TRADES)}), o AS (SELECT *, {TRADE_REASON} AS reason FROM r) SELECT {TRADE_OUTCOME} AS outcome, CASE WHEN {TRADE_OUTCOME} = 'skip' THEN reason END AS reason, count(*) AS n FROM o GROUP BY ALL")
def transaction_outcomes(spark, sf_dir):
    return records.parse_transactions(raw(spark, sf_dir, "lineitem", SPARK_TRADES)).groupBy("outcome", "reason").agg(F.count("*").alias("n"))


POSITIONS = {
    "l_orderkey": "l_orderkey",
    "symbol": "CASE l_partkey % 19 WHEN 0 THEN 'Total' WHEN 1 THEN NULL WHEN 2 THEN 'longsym' || l_partkey WHEN 3 THEN 'ABX' ELSE 'q' || l_suppkey END",
    "name": "'Part ' || l_partkey",
    "shares": "CASE l_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '-5' ELSE " + amount("l_quantity") + " END",
    "avg_cost_per_share": "CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN " + amount("l_extendedprice") + " ELSE '0.00001' END",
    "total_cost": "CASE WHEN l_suppkey % 5 = 0 THEN '' WHEN l_suppkey % 10 = 1 THEN " + amount("l_extendedprice * l_quantity * 2") + " ELSE " + amount("l_extendedprice * l_quantity") + " END",
    "side": "'SHORT'",
    "first_trading_date": "cast(NULL AS {text})",
    "last_trading_date": "'2024-01-01'",
    "day_gain": "'1%'",
    "overall_gain": "cast(NULL AS {text})",
    "overall_gain_pct": "'(2)'",
}
SPARK_POSITIONS = {k: v.replace("{text}", "string") for k, v in POSITIONS.items()}
DUCK_POSITIONS = {k: v.replace("{text}", "varchar") for k, v in POSITIONS.items()}
POSITION_SQL = f"""
WITH r AS ({source('lineitem', DUCK_POSITIONS)}),
n AS (SELECT *, {number_sql('shares')} AS s, {number_sql('avg_cost_per_share')} AS a0, {number_sql('total_cost')} AS t, upper({text_sql('symbol')}) AS sym FROM r
  WHERE NOT {absent_sql('symbol')} AND lower(trim(coalesce(symbol, ''))) NOT IN {in_list(V.AGGREGATE_SYMBOLS)} AND NOT ({number_sql('shares')} = 0 AND {absent_sql('shares')})),
h AS (SELECT *, CASE WHEN a0 = 0 AND t > 0 AND s > 0 THEN round(t / s, 6) ELSE a0 END AS a FROM n)"""


@query(
    POSITION_SQL + f" SELECT l_orderkey, 'broker_holding' AS dto_type, sym AS symbol, {text_sql('name')} AS name, s AS shares, round(a, 4) AS avg_cost_per_share, t AS total_cost, "
    "'short' AS side, nullif(first_trading_date, '') AS first_trading_date, last_trading_date, 1.0::DOUBLE AS day_gain, 0.0::DOUBLE AS overall_gain, -2.0::DOUBLE AS overall_gain_pct FROM h"
)
def parse_holdings(spark, sf_dir):
    done = records.parse_holdings(raw(spark, sf_dir, "lineitem", SPARK_POSITIONS)).where("outcome = 'record'").select("l_orderkey", "record.*")
    return done.withColumn("avg_cost_per_share", F.round("avg_cost_per_share", 4))


@query(
    POSITION_SQL + f""", i AS (SELECT sym, CASE WHEN s < 0 OR s > {V.SHARES_MAX} THEN 'shares_range' END AS i1,
  CASE WHEN a > {V.AVG_COST_MAX} THEN 'avg_cost_high' WHEN a > 0 AND a < {V.AVG_COST_MIN} THEN 'avg_cost_low' END AS i2,
  CASE WHEN a > 0 AND t > 0 AND s > 0 THEN CASE WHEN abs(t - s * a) / greatest(s * a, 1) > {V.COST_TOLERANCE} THEN 'cost_mismatch' END
    WHEN a > 0 AND (length(sym) > 4 OR sym LIKE '%X') AND a > {V.FUND_COST} THEN 'fund_cost_high'
    WHEN a > {V.FEW_SHARES_COST} AND s < {V.FEW_SHARES} THEN 'few_shares_high_cost' END AS i3 FROM h)
SELECT concat_ws('; ', i1, i2, i3) AS issues, count(*) AS n FROM i GROUP BY 1"""
)
def sanity_issues(spark, sf_dir):
    done = records.parse_holdings(raw(spark, sf_dir, "lineitem", SPARK_POSITIONS)).where("outcome = 'record'")
    return done.groupBy(F.array_join("issues", "; ").alias("issues")).agg(F.count("*").alias("n"))


WEIGHTS = {
    "p_partkey": "p_partkey",
    "symbol": "CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 9 = 1 THEN 'subtotal' ELSE 'w' || p_partkey END",
    "name": "' ' || p_name",
    "weight": "CASE WHEN p_size % 4 = 0 THEN '' ELSE p_size || '%' END",
    "price": "CASE WHEN p_size % 8 = 0 THEN NULL ELSE " + amount("p_retailprice") + " END",
    "holding_type": "p_type",
    "change": "'(' || p_size || ')'",
    "current_weight": "CASE WHEN p_size % 4 = 0 THEN '' ELSE p_size || '%' END",
    "target_weight": "CASE WHEN p_size % 8 = 0 THEN '' ELSE " + amount("p_size + 0.25") + " END",
    "drift": "CASE WHEN p_size % 3 = 0 THEN '1.5' ELSE '' END",
    "action": "CASE WHEN p_size % 2 = 0 THEN 'BUY' ELSE 'Sell ' END",
    "trade_amount": "'$' || " + amount("p_retailprice"),
    "trade_shares": "'n/a'",
}


@query(
    f"WITH r AS ({source('part', WEIGHTS)}) SELECT p_partkey, 'constituent_holding' AS dto_type, upper({text_sql('symbol')}) AS symbol, {text_sql('name')} AS name, {number_sql('weight')} AS weight, "
    f"{number_sql('price')} AS price, {text_sql('holding_type')} AS holding_type, {number_sql('change')} AS change FROM r WHERE NOT {absent_sql('symbol')} AND NOT ({absent_sql('weight')} AND {absent_sql('price')})"
)
def parse_constituents(spark, sf_dir):
    own = {k: WEIGHTS[k] for k in ("p_partkey", *records.FIELDS["constituent_holding"])}
    return records.parse_constituents(raw(spark, sf_dir, "part", own)).where("outcome = 'record'").select("p_partkey", "record.*")


@query(
    f"WITH r AS ({source('part', WEIGHTS)}), n AS (SELECT *, {number_sql('current_weight')} AS c, {number_sql('target_weight')} AS t, {number_sql('drift')} AS d FROM r) "
    f"SELECT p_partkey, 'rebalance_plan' AS dto_type, upper({text_sql('symbol')}) AS symbol, lower({text_sql('name')}) AS name, c AS current_weight, t AS target_weight, "
    f"CASE WHEN d = 0 AND c <> 0 AND t <> 0 THEN round(t - c, 6) ELSE d END AS drift, lower({text_sql('action')}) AS action, {number_sql('trade_amount')} AS trade_amount, 0.0::DOUBLE AS trade_shares "
    f"FROM n WHERE NOT {absent_sql('symbol')} AND lower(trim(symbol)) NOT IN {in_list(V.AGGREGATE_SYMBOLS)} AND NOT ({absent_sql('current_weight')} AND {absent_sql('target_weight')})"
)
def parse_rebalance(spark, sf_dir):
    own = {k: WEIGHTS[k] for k in ("p_partkey", *records.FIELDS["rebalance_plan"])}
    return records.parse_rebalance(raw(spark, sf_dir, "part", own)).where("outcome = 'record'").select("p_partkey", "record.*")


# ------------------------------------------------------------------ roll-ups
OUTCOMES = {
    "doc_id": "l_orderkey % 50", "table_index": "l_linenumber", "table_type": "CASE WHEN l_linenumber % 2 = 0 OR l_orderkey % 50 % 3 = 0 THEN 'holding' ELSE 'transaction' END", "row_idx": "l_partkey",
    "outcome": "CASE WHEN l_orderkey % 50 % 5 = 0 THEN 'blank' WHEN l_suppkey % 40 = 0 THEN 'skip' ELSE 'record' END",
    "suspicious": "l_partkey % (1 + l_orderkey % 50 % 9) = 1",
}
SUMMARY_SQL = f"""
WITH r AS ({source('lineitem', OUTCOMES)}),
t AS (SELECT doc_id, table_index, table_type, count(*) AS row_count, count(*) FILTER (outcome = 'record') AS record_count, count(*) FILTER (outcome = 'skip') AS skipped_rows,
  count(*) FILTER (outcome = 'record' AND suspicious) AS suspicious_rows FROM r GROUP BY ALL),
s AS (SELECT *, CASE skipped_rows + suspicious_rows WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' ELSE 'low' END AS parse_confidence,
  CASE WHEN record_count = 0 THEN 'failed' WHEN skipped_rows > 0 OR suspicious_rows / greatest(record_count + skipped_rows, 1) > {V.TABLE_SUSPICIOUS} THEN 'partial_success' ELSE 'success' END AS parse_status, record_count = 0 AS skipped FROM t)"""


def summaries(spark, sf_dir):
    return rollup.summarise_tables(raw(spark, sf_dir, "lineitem", OUTCOMES).withColumn("note", F.lit(None).cast("string")))


@query(SUMMARY_SQL + " SELECT * FROM s")
def table_summaries(spark, sf_dir):
    return summaries(spark, sf_dir).drop("notes")


@query(
    SUMMARY_SQL + f""", d AS (SELECT doc_id, CASE WHEN count(DISTINCT table_type) > 1 THEN 'mixed' ELSE min(table_type) END AS input_type, sum(record_count)::BIGINT AS record_count, sum(skipped_rows)::BIGINT AS skipped_rows,
  sum(suspicious_rows)::BIGINT AS suspicious_rows, count(*) FILTER (parse_status = 'partial_success') AS partial_tables, count(*) AS table_count, 0::BIGINT AS error_count FROM s GROUP BY doc_id)
SELECT *, CASE WHEN record_count = 0 THEN 'failed' WHEN suspicious_rows / greatest(record_count, 1) > {V.DOCUMENT_SUSPICIOUS} THEN 'low_confidence_partial' WHEN partial_tables > 0 THEN 'partial_success' ELSE 'success' END AS status FROM d"""
)
def document_status(spark, sf_dir):
    return rollup.summarise_documents(summaries(spark, sf_dir))


@query(
    SUMMARY_SQL + """, w AS (SELECT doc_id, table_index, 1 AS kind, skipped_rows || CASE WHEN skipped_rows = 1 THEN ' row' ELSE ' rows' END || ' skipped during ' || table_type || ' parsing (missing or invalid data).' AS warning FROM s WHERE skipped_rows > 0
  UNION ALL SELECT doc_id, table_index, 2, 'Table ' || table_index || ' produced no records.' FROM s WHERE record_count = 0)
SELECT doc_id, string_agg(warning, ' / ' ORDER BY table_index, kind) AS warnings FROM w GROUP BY doc_id"""
)
def document_warnings(spark, sf_dir):
    return rollup.ordered_warnings(rollup.table_warnings(summaries(spark, sf_dir))).select("doc_id", F.array_join("warnings", " / ").alias("warnings"))


# ------------------------------------------------------------------ mapping and classification
HEADERS = {
    0: ["symbol", "name", "shares", "avg cost", "total cost", "side", "first trading date", "last trading date"],
    1: ["symbol", "type", "quantity", "price", "total amount", "commission", "fees", "net amount", "date", "settlement date", "notes"],
    2: ["symbol", "shares"],
    3: ["alpha", "beta gamma", "delta 9"],
    4: ["ticker", "qty", "market value", "day gain"],
}


def header_tables(spark, sf_dir):
    pick = F.lit(None).cast("array<string>")
    for k, names in HEADERS.items():
        pick = F.when(F.col("n_nationkey") % 5 == k, F.array(*map(F.lit, names))).otherwise(pick)
    own = raw(spark, sf_dir, "nation", {"n_nationkey": "n_nationkey"})
    return own.select(F.col("n_nationkey").alias("doc_id"), F.lit(1).alias("table_index"), pick.alias("headers"))


@query()
def map_headers(spark, sf_dir):
    own = mapping.with_maps(header_tables(spark, sf_dir))
    return own.select("doc_id", F.explode("maps.holding").alias("field", "header"), F.size(mapping.ignored(F.col("headers"), F.col("maps.holding"))).alias("ignored"))


@query(
    "SELECT n_nationkey AS doc_id, t.* EXCLUDE (k) FROM nation JOIN (VALUES (0, 'holding', 'high', 2, 5), (1, 'transaction', 'high', 14, 2), (2, 'non_financial', 'high', 0, 0), (3, 'non_financial', 'high', 0, 0), (4, 'holding', 'medium', 0, 3)) "
    "AS t(k, doc_type, confidence, transaction_score, holding_score) ON n_nationkey % 5 = k"
)
def classify_tables(spark, sf_dir):
    own = classify.classify_tables(mapping.with_maps(header_tables(spark, sf_dir)))
    return own.select("doc_id", "doc_type", "confidence", "transaction_score", "holding_score")


@query(
    "SELECT n_nationkey AS doc_id, t.* EXCLUDE (k) FROM nation JOIN (VALUES (0, 'holding', 'holding'), (1, 'transaction', 'transaction'), (2, 'holding', 'holding'), (3, 'holding', 'none_holding'), (4, 'holding', 'holding')) "
    "AS t(k, detected, route) ON n_nationkey % 5 = k"
)
def route_tables(spark, sf_dir):
    own = classify.route(mapping.with_maps(header_tables(spark, sf_dir)).withColumn("hint", F.lit(None).cast("string")))
    return own.select("doc_id", classify.detect_input_type(F.col("maps")).alias("detected"), "route")


@query(
    "SELECT n_regionkey AS doc_id, CASE WHEN h = 0 AND t = 0 THEN 'non_financial' WHEN t = 0 THEN 'holding' WHEN h = 0 THEN 'transaction' ELSE 'mixed' END AS doc_type, coalesce(weakest, 'high') AS confidence, h + t > 0 AS is_financial "
    "FROM (SELECT n_regionkey, count(*) FILTER (n_nationkey % 5 IN (0, 4)) AS h, count(*) FILTER (n_nationkey % 5 = 1) AS t, CASE WHEN count(*) FILTER (n_nationkey % 5 = 4) > 0 THEN 'medium' WHEN count(*) FILTER (n_nationkey % 5 IN (0, 1)) > 0 THEN 'high' END AS weakest FROM nation GROUP BY 1)"
)
def classify_documents(spark, sf_dir):
    nations = raw(spark, sf_dir, "nation", {"key": "n_nationkey", "region": "n_regionkey"})
    tables = header_tables(spark, sf_dir).join(nations, F.col("doc_id") == F.col("key")).select(F.col("region").alias("doc_id"), F.col("key").alias("table_index"), "headers")
    done = classify.classify_documents(tables.select("doc_id").distinct(), classify.classify_tables(mapping.with_maps(tables)))
    return done.select("doc_id", "doc_type", "confidence", "is_financial")


# ------------------------------------------------------------------ cleaning and repair
CELLS = {"doc_id": "l_orderkey % 50", "row": "l_partkey", "a": "' ' || l_orderkey", "b": "CASE WHEN l_quantity > 25 THEN " + amount("l_quantity") + " ELSE 'N/A' END", "d": "CASE WHEN l_orderkey % 50 < 10 THEN '-' ELSE l_returnflag END"}


@query(
    f"WITH r AS ({source('lineitem', CELLS)}), d AS (SELECT doc_id, count(*) AS n_rows, count(*) FILTER (b <> 'N/A') AS nb, count(*) FILTER (d <> '-') AS nd FROM r GROUP BY doc_id) "
    "SELECT doc_id, 'order key' || CASE WHEN nb > 0 THEN ',qty' ELSE '' END || CASE WHEN nd > 0 THEN ',flag_1' ELSE '' END AS headers, n_rows, n_rows + nb + nd AS filled FROM d WHERE nb > 0 OR nd > 0"
)
def normalise_tables(spark, sf_dir):
    own = raw(spark, sf_dir, "lineitem", CELLS).groupBy("doc_id").agg(F.collect_list(F.array("a", "b", F.lit(""), F.lit("—"), "d")).alias("cells"))
    names = F.array(*map(F.lit, [" Order  Key", "QTY", "", "Flag", "flag"]))
    done = cleaning.normalise(own.withColumn("headers", names))
    return done.select("doc_id", F.array_join("headers", ",").alias("headers"), F.size("cells").cast("long").alias("n_rows"), F.size(F.filter(F.flatten("cells"), lambda c: c != "")).cast("long").alias("filled"))


@query("SELECT n_nationkey AS doc_id, 'symbol|qty|avg cost' AS headers, '1|2|3/4|5|6' AS cells FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, 'symbol|qty', 'A|1/B|2' FROM nation WHERE n_nationkey % 2 = 1")
def two_row_headers(spark, sf_dir):
    rows = lambda *r: F.array(*(F.array(*map(F.lit, x)) for x in r))
    own = raw(spark, sf_dir, "nation", {"doc_id": "n_nationkey"})
    own = own.withColumn("cells", F.when(F.col("doc_id") % 2 == 0, rows(["", "", "Avg"], ["Symbol", "Qty", "Cost"], ["1", "2", "3"], ["4", " 5", "6"])).otherwise(rows(["Symbol", "Qty"], ["A", "1"], ["B", "2"])))
    done = cleaning.normalise_pdf(own.withColumn("headers", F.array().cast("array<string>")))
    return done.select("doc_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "/").alias("cells"))


KINDS = {"doc_id": "user_id", "kind": "CASE WHEN event_id % 3 = 0 THEN 'x-' || event_id ELSE upper(substr(event_type, 1, 4)) END", "own": "CASE WHEN user_id % 4 = 0 THEN 'AAPL' WHEN event_id % 5 = 0 THEN 'Q' ELSE '' END"}


@query(
    f"WITH r AS ({source('events', KINDS)}), d AS (SELECT doc_id, avg((regexp_matches(kind, '^[A-Z]{{1,6}}$'))::INT) AS k, avg((regexp_matches(own, '^[A-Z]{{1,6}}$'))::INT) AS o, count(*) AS n, count(*) FILTER (own <> '') AS f FROM r GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN o < 0.5 AND k > 0.3 THEN 1 END AS stray, CASE WHEN o < 0.5 AND k > 0.3 THEN n ELSE f END AS filled FROM d"
)
def repair_symbols(spark, sf_dir):
    own = raw(spark, sf_dir, "events", KINDS).groupBy("doc_id").agg(F.collect_list(F.array("own", "kind")).alias("cells"))
    done = repair.repair_symbols(own.withColumn("headers", F.array(F.lit("symbol"), F.lit("kind"))), F.lit("symbol"))
    return done.select("doc_id", "stray", F.size(F.filter("cells", lambda r: F.get(r, 0) != "")).cast("long").alias("filled"))


COUNTS = {"doc_id": "user_id", "own": "CASE WHEN user_id % 3 = 0 THEN '12' WHEN event_id % 4 = 0 THEN '0' ELSE '' END", "other": "CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '1,' || (100 + event_id % 100) END"}


@query(
    f"WITH r AS ({source('events', COUNTS)}), d AS (SELECT doc_id, avg((own = '12')::INT) AS o, avg((other <> 'x')::INT) AS k, count(*) FILTER (own NOT IN ('', '0')) AS f, count(*) AS n FROM r GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN o < 0.3 AND k > 0.4 THEN 2 END AS stray, CASE WHEN o < 0.3 AND k > 0.4 THEN n ELSE f END AS filled FROM d"
)
def repair_shares(spark, sf_dir):
    own = raw(spark, sf_dir, "events", COUNTS).groupBy("doc_id").agg(F.collect_list(F.array(F.lit("AAPL"), "own", "other")).alias("cells"))
    done = repair.repair_shares(own.withColumn("headers", F.array(*map(F.lit, ["symbol", "shares", "total"]))), F.lit("shares"), F.lit("symbol"))
    return done.select("doc_id", "stray", F.size(F.filter("cells", lambda r: ~F.get(r, 1).isin("", "0"))).cast("long").alias("filled"))


RUNS = {"suite": "o_orderpriority", "passed": "o_orderstatus = 'F'", "latency_ms": "CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 97 END", "record_count": "o_custkey % 10"}


@query(
    f"SELECT suite, count(*) AS runs, count(*) FILTER (passed) AS passed, round(avg(passed::INT), 6) AS pass_rate, round(avg(latency_ms) FILTER (latency_ms > 0), 6) AS mean_latency_ms, "
    f"round(avg(record_count) FILTER (passed), 6) AS mean_records FROM ({source('orders', RUNS)}) GROUP BY suite"
)
def suite_statistics(spark, sf_dir):
    return statistics.suites(raw(spark, sf_dir, "orders", RUNS))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'name' ELSE 'name,region' END AS told FROM nation")
def told_fields(spark, sf_dir):
    fields = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("note"), F.lit(""))
    own = raw(spark, sf_dir, "nation", {"n_nationkey": "n_nationkey", "n_name": "n_name", "n_regionkey": "n_regionkey"})
    return own.select("n_nationkey", F.array_join(F.array_sort(F.map_keys(statistics.told_fields(fields))), ",").alias("told"))


# ------------------------------------------------------------------ grids, passes, images
BLOBS = {"doc_id": "user_id", "x": "cast((event_id * 37) % 900 AS double)", "y": "cast((event_id * 53) % 560 AS double)", "w": "cast(20 + event_id % 90 AS double)", "h": "cast(5 + event_id % 30 AS double)", "img_w": "1000.0", "img_h": "600.0"}


@query(
    f"WITH b AS ({source('events', BLOBS)}), f AS (SELECT *, floor((x + w / 2) * 20 / img_w) AS c, floor((y + h / 2) * 20 / img_h) AS r FROM b WHERE w * h / (img_w * img_h) > 0.0001 AND w * h / (img_w * img_h) < 0.10 AND h <= 0.15 * img_h AND w <= 0.90 * img_w AND w >= h), "
    "a AS (SELECT doc_id, count(*) AS all_blobs FROM b GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS blobs, count(DISTINCT r) AS rows FROM f GROUP BY doc_id), "
    "k AS (SELECT doc_id, c, count(*) AS n FROM f GROUP BY doc_id, c), w AS (SELECT doc_id, count(*) AS columns, count(*) FILTER (n >= 2) AS full_columns, (max(c) - min(c)) / 20 AS spread FROM k GROUP BY doc_id) "
    "SELECT doc_id, all_blobs, coalesce(blobs, 0) AS blobs, coalesce(rows, 0) AS rows, coalesce(columns, 0) AS columns, coalesce(full_columns, 0) AS full_columns, coalesce(spread, 0)::DOUBLE AS spread FROM a LEFT JOIN t USING (doc_id) LEFT JOIN w USING (doc_id)"
)
def blob_measures(spark, sf_dir):
    return images.borderless(raw(spark, sf_dir, "events", BLOBS))


READ = {"doc_id": "user_id", "seq": "event_id", "conf": "value / 1000", "text": "CASE WHEN event_id % 5 = 0 THEN ' ' ELSE event_type END"}


@query(f"SELECT doc_id, seq FROM ({source('events', READ)}) WHERE conf >= 0.05 AND trim(text) <> ''")
def confident_tokens(spark, sf_dir):
    return images.confident(raw(spark, sf_dir, "events", READ)).select("doc_id", "seq")


TOKENS = {"doc_id": "user_id", "page": "1", "seq": "event_id", "y": "value * 7", "x": "cast((event_id % 100) * 10 AS double)", "text": "event_type"}
ROWS_SQL = f"""
WITH t AS ({source('events', TOKENS)}), g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, seq) AS gap FROM t),
r AS (SELECT *, (sum(CASE WHEN gap > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY y, seq))::INT AS row_no FROM g)"""


@query(ROWS_SQL + " SELECT doc_id, seq, row_no FROM r")
def token_rows(spark, sf_dir):
    return grid.token_rows(raw(spark, sf_dir, "events", TOKENS)).select("doc_id", "seq", "row_no")


WORDS = {"doc_id": "user_id", "page": "1", "seq": "event_id", "x0": "value", "x1": "value + 15", "top": "cast((event_id % 40) * 9 + event_id % 3 AS double)", "text": "event_type"}


@query(
    f"""WITH t AS ({source('events', WORDS)}), l AS (SELECT DISTINCT doc_id, round_even(top, 0) AS line FROM t), g AS (SELECT doc_id, line - lag(line) OVER (PARTITION BY doc_id ORDER BY line) AS gap FROM l),
m AS (SELECT doc_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS median FROM g WHERE gap > 0 GROUP BY doc_id),
j AS (SELECT t.*, greatest(4, coalesce(median, 10) * 0.6) AS tol, top - lag(top) OVER (PARTITION BY t.doc_id ORDER BY round_even(top, 0), x0, seq) AS d FROM t LEFT JOIN m USING (doc_id))
SELECT doc_id, seq, (sum(CASE WHEN abs(d) > tol THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY round_even(top, 0), x0, seq))::INT AS row_no FROM j"""
)
def word_rows(spark, sf_dir):
    return grid.word_rows(raw(spark, sf_dir, "events", WORDS)).select("doc_id", "seq", "row_no")


@query(
    f"""WITH t AS ({source('events', WORDS)}), g AS (SELECT *, (sum(CASE WHEN x0 - p >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x0, seq))::INT AS grp FROM (SELECT *, lag(x1) OVER (PARTITION BY doc_id ORDER BY x0, seq) AS p FROM t))
SELECT doc_id, 1 AS page, grp AS "group", string_agg(text, ' ' ORDER BY x0, seq) AS name FROM g GROUP BY doc_id, grp"""
)
def header_groups(spark, sf_dir):
    return grid.header_groups(raw(spark, sf_dir, "events", WORDS))


@query(ROWS_SQL + ", c AS (SELECT *, (x >= 105)::INT + (x >= 400)::INT + (x >= 750)::INT AS col_no FROM r) SELECT doc_id, row_no, col_no, string_agg(text, ' ' ORDER BY y, seq) AS cell FROM c GROUP BY ALL")
def grid_cells(spark, sf_dir):
    own = grid.token_rows(raw(spark, sf_dir, "events", TOKENS))
    bounds = F.array(F.lit(105.0), F.lit(400.0), F.lit(750.0))
    return grid.joined_cells(own.withColumn("col_no", grid.column_between(F.col("x"), bounds)), ["y", "seq"]).drop("page")


@query(f"WITH t AS ({source('events', TOKENS)}) SELECT doc_id, seq, CASE WHEN abs(x - 100) <= abs(x - 300) AND abs(x - 100) <= abs(x - 900) THEN 0 WHEN abs(x - 300) <= abs(x - 900) THEN 1 ELSE 2 END AS col_no FROM t")
def nearest_column(spark, sf_dir):
    centres = F.array(F.lit(100.0), F.lit(300.0), F.lit(900.0))
    return raw(spark, sf_dir, "events", TOKENS).select("doc_id", "seq", grid.nearest_column(F.col("x"), centres).alias("col_no"))


PASSES = {"doc_id": "user_id", "pass_no": "1 + (user_id + event_id) % 3 + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END", "table_index": "event_id"}


@query(f"WITH r AS ({source('events', PASSES)}) SELECT doc_id, pass_no, table_index FROM r QUALIFY pass_no = min(pass_no) OVER (PARTITION BY doc_id)")
def first_pass_wins(spark, sf_dir):
    return first_pass(raw(spark, sf_dir, "events", PASSES))


STRATEGIES = {"doc_id": "user_id % 100", "page": "1", "strategy": "event_id % 4"}


@query(
    f"WITH c AS (SELECT doc_id, page, strategy, count(*) AS n FROM ({source('events', STRATEGIES)}) GROUP BY ALL) SELECT doc_id, page, strategy FROM c "
    "QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN strategy = 0 AND n >= 20 THEN 1000000000 ELSE n END DESC, strategy) = 1"
)
def best_strategy(spark, sf_dir):
    counts = raw(spark, sf_dir, "events", STRATEGIES).groupBy("doc_id", "page", "strategy").agg(F.count("*").alias("n"))
    return images.best_strategy(counts)


@query(
    "SELECT p_partkey, CASE WHEN p_size * 40 < 600 THEN CASE WHEN p_partkey % 2 = 0 THEN 'resolution_too_low' ELSE 'no_table' END WHEN p_retailprice % 10 < 1 THEN 'no_table' WHEN p_partkey % 3 = 0 THEN 'no_table' WHEN p_partkey % 2 <> 0 THEN 'ocr_disabled' ELSE 'ocr' END AS gate FROM part"
)
def image_gate(spark, sf_dir):
    own = raw(spark, sf_dir, "part", {"p_partkey": "p_partkey", "width": "p_size * 40", "density": "CASE WHEN p_retailprice % 10 < 1 THEN 0.005 ELSE 0.02 END"})
    return own.select("p_partkey", images.gate(F.col("width"), F.col("density"), F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 2 == 0).alias("gate"))


# ------------------------------------------------------------------ the whole plan
DOCUMENT_TRADES = {"doc_id": "l_orderkey % 50", **{k: v for k, v in TRADES.items() if k != "l_orderkey"}}


@query(
    f"WITH r AS ({source('lineitem', {k: v.replace('{text}', 'varchar') for k, v in DOCUMENT_TRADES.items()})}), o AS (SELECT *, {TRADE_REASON} AS reason FROM r), "
    f"d AS (SELECT doc_id, count(*) FILTER ({TRADE_OUTCOME} = 'record') AS record_count, count(*) FILTER ({TRADE_OUTCOME} = 'skip') AS skipped_rows FROM o GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN record_count = 0 THEN 'failed' WHEN skipped_rows > 0 THEN 'partial_success' ELSE 'success' END AS status, 'transaction' AS input_type, record_count, skipped_rows FROM d"
)
def ingest_documents(spark, sf_dir):
    """Raw tables of texts, a document a table that comes row by row, through cleaning, mapping, classification, parsing and roll-ups."""
    fields = records.FIELDS["transaction"]
    rows = raw(spark, sf_dir, "lineitem", {k: v.replace("{text}", "string") for k, v in DOCUMENT_TRADES.items()})
    cells = F.array(*(F.coalesce(F.col(f), F.lit("")) for f in fields))
    names = F.array(*(F.lit(V.TRANSACTION[f][0]) for f in fields))
    tables = rows.select("doc_id", F.lit(1).alias("table_index"), names.alias("headers"), F.array(cells).alias("cells"), F.monotonically_increasing_id().alias("first_row"))
    early = spark.createDataFrame([], "doc_id long, stage string, error_type string, message string")
    done = ingest_tables(cut(rows.select("doc_id").distinct()), tables, early)
    return done.results.select("doc_id", "status", "input_type", "record_count", "skipped_rows")
