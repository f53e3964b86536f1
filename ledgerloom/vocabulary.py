"""Field vocabularies of portfolio documents, and the limits that the rules use.

Fixed values: these words, their order and these numbers are part of the behaviour (a header is matched to the first
field, in this order, that it is most similar to), so they are data and stand here plainly.
"""

from __future__ import annotations

HOLDING: dict[str, list[str]] = {
    "symbol": ["symbol", "ticker", "stock", "security", "stock symbol", "ticker symbol", "instrument", "security id", "股票代码", "代码", "证券代码", "scrip", "exchange code: ticker", "exchange code"],
    "name": ["name", "company", "security name", "stock name", "description", "company name", "公司名称", "名称", "证券名称"],
    "shares": ["shares", "quantity", "qty", "units", "position", "shares held", "number of shares", "# shares", "no. of shares", "holding", "pos", "position size", "股数", "数量", "持股数", "holding qty"],
    "avg_cost_per_share": ["avg cost", "average cost", "avg price", "average price", "avg cost per share", "average cost per share", "unit cost", "均价", "平均成本", "成本价", "buy price", "purchase price"],
    "total_cost": ["total cost", "cost", "book value", "total value", "book cost", "total book value", "cost basis", "total cost basis", "总成本", "账面价值", "成本基础", "buy value", "purchase value"],
    "side": ["side", "position type", "long/short", "direction", "position side", "多空", "方向"],
    "first_trading_date": ["first trading date", "open date", "first purchase", "start date", "inception date", "首次交易日"],
    "last_trading_date": ["last trading date", "last purchase", "last trade date", "most recent trade", "最近交易日"],
    "last_price": ["last price", "current price", "market price", "latest price", "price", "last", "现价", "最新价"],
    "market_value": ["market value", "mkt value", "mkt val", "current value", "portfolio value", "市值"],
    "day_gain": ["day's gain", "day gain", "daily gain", "today's gain", "change today", "日收益"],
    "overall_gain": ["overall gain", "total gain", "total return", "gain/loss", "unrealized gain", "总收益", "浮动盈亏", "gain loss"],
    "overall_gain_pct": ["overall gain %", "gain %", "return %", "total return %", "% gain", "% return", "% change", "pct return", "overall gain percent", "unrealized gain %", "收益率", "gain/loss (%)", "gain loss %", "gain/loss(%)", "(%)"],
}

TRANSACTION: dict[str, list[str]] = {
    "symbol": ["symbol", "ticker", "stock", "security", "instrument", "stock symbol", "security id", "股票代码", "代码", "scrip", "exchange code: ticker", "exchange code"],
    "transaction_move": ["type", "action", "transaction type", "move", "buy/sell", "side", "transaction", "trade type", "order type", "activity", "activity type", "trans type", "description", "debit/credit", "交易类型", "操作类型"],
    "shares": ["shares", "quantity", "qty", "units", "volume", "number of shares", "# shares", "no. of shares", "amount", "share count", "股数", "数量"],
    "price_per_share": ["price", "price per share", "unit price", "execution price", "fill price", "trade price", "单价", "成交价"],
    "total_amount": ["total", "total amount", "gross amount", "gross", "value", "total value", "debit", "credit", "总金额", "总价"],
    "commission": ["commission", "comm", "brokerage", "broker fee", "佣金"],
    "fees": ["fees", "fee", "charges", "other fees", "regulatory fee", "手续费", "费用"],
    "net_amount": ["net amount", "net", "settlement amount", "net proceeds", "net debit", "net credit", "净额"],
    "executed_at": ["date", "execution date", "trade date", "executed at", "transaction date", "trade time", "settled date", "交易日期", "成交日期", "txn date", "txn_date", "trans date"],
    "settled_at": ["settlement date", "settle date", "settled at", "value date", "清算日期"],
    "notes": ["notes", "memo", "remarks", "comment", "备注", "说明"],
}

CONSTITUENT: dict[str, list[str]] = {
    "symbol": ["symbol", "ticker", "stock", "security", "instrument", "stock symbol", "security id", "股票代码", "代码", "scrip", "exchange code: ticker", "exchange code"],
    "name": ["name", "company", "security name", "stock name", "description", "公司名称", "名称"],
    "weight": ["weight", "% weight", "wt", "allocation", "% alloc", "portfolio weight", "index weight", "权重", "占比"],
    "price": ["price", "last price", "current price", "market price", "latest price", "last", "现价", "最新价"],
    "holding_type": ["holding type", "type", "asset type", "security type", "asset class", "类型"],
    "change": ["change", "% change", "chg", "day change", "daily change", "变动", "涨跌幅"],
}

REBALANCE: dict[str, list[str]] = {
    "symbol": ["symbol", "ticker", "stock", "security", "instrument", "stock symbol", "security id", "股票代码", "代码", "scrip", "exchange code: ticker", "exchange code"],
    "name": ["name", "description", "security name", "company", "公司名称", "名称"],
    "current_weight": ["current weight", "current %", "current allocation", "cur wt", "cur %", "current pct", "actual weight", "actual %", "actual allocation", "current", "existing %", "持仓权重", "当前占比"],
    "target_weight": ["target weight", "target %", "target allocation", "tgt wt", "tgt %", "target pct", "desired weight", "desired %", "goal %", "new %", "ideal %", "目标权重", "目标占比"],
    "drift": ["drift", "difference", "diff", "over/under", "deviation", "delta", "off by", "deviation %", "rebalance %", "偏差", "差值"],
    "action": ["action", "trade", "rebalance action", "buy/sell", "direction", "type", "to do", "recommended action", "操作", "建议"],
    "trade_amount": ["trade amount", "amount", "dollar amount", "trade value", "$ to trade", "trade $", "value", "notional", "金额", "交易金额"],
    "trade_shares": ["shares to trade", "shares", "qty", "quantity", "units", "share count", "# shares", "股数", "交易股数"],
}

MOVES: dict[str, list[str]] = {
    "buy": ["buy", "purchase", "purchased", "bought", "b", "buy order", "market buy", "limit buy", "买入", "买", "申购"],
    "sell": ["sell", "sold", "s", "sell order", "market sell", "limit sell", "卖出", "卖", "赎回"],
    "short_sell": ["short sell", "short sale", "short", "ss", "做空", "融券"],
    "cover": ["cover", "buy to cover", "btc", "cover short", "平仓", "回补"],
    "dividend": ["dividend", "div", "income", "distribution", "reinvest", "reinvestment", "股息", "分红"],
}

VOCABULARIES = {"holding": HOLDING, "transaction": TRANSACTION, "constituent": CONSTITUENT, "rebalance": REBALANCE}
REQUIRED = {"holding": ["symbol", "shares"], "transaction": ["symbol", "transaction_move", "shares", "executed_at"], "constituent": ["symbol"], "rebalance": ["symbol"]}
#: Holding fields that only help to recognise a table.
DISPLAY_ONLY = ["last_price", "market_value"]
#: Thresholds of header similarity for scores of kind and for everything else.
STRICT, LOOSE = 0.75, 0.6
HEADER_CUTOFF = 0.7

AGGREGATE_SYMBOLS = ["total", "grand total", "subtotal", "sub-total", "portfolio total", "account total", "合计", "总计"]
NULL_CELLS = ["", "nan", "none", "n/a", "na", "-", "—", "null"]
NULL_NUMBERS = ["", "nan", "n/a", "--", "-"]
NULL_TEXTS = ["nan", "none", "n/a"]
SIDES = ["long", "short", "flat"]
HEADER_KEYWORDS = ["date", "qty", "price", "amount", "total", "cost", "symbol", "type", "action", "shares", "value", "name", "ticker", "日期", "数量", "价格", "金额", "成本", "代码", "类型"]

#: What a field adds to a table's score: strict matches, then loose ones.
TRANSACTION_POINTS = [("commission", 3, True), ("net_amount", 3, True), ("settled_at", 3, True), ("transaction_move", 2, True), ("executed_at", 2, True), ("price_per_share", 1, False)]
HOLDING_POINTS = [("avg_cost_per_share", 2, True), ("total_cost", 2, True), ("last_price", 2, True), ("market_value", 2, True), ("first_trading_date", 1, True), ("day_gain", 1, True)]

SHARES_MAX, AVG_COST_MAX, AVG_COST_MIN, COST_TOLERANCE = 1_000_000_000, 1_000_000, 0.0001, 0.15
FUND_COST, FEW_SHARES_COST, FEW_SHARES = 200, 1000, 100
TABLE_SUSPICIOUS, DOCUMENT_SUSPICIOUS = 0.30, 0.50
SYMBOL_FINE, SYMBOL_STRAY = 0.5, 0.3
SHARES_FINE, SHARES_STRAY, SHARE_LEAST, SHARE_MOST = 0.3, 0.4, 0.001, 1_000_000
SPARSE_SHARE, PLACEHOLDER_SHARE, MIN_COLUMNS = 0.2, 0.6, 2

CATEGORIES = {
    "image": [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".webp", ".gif"],
    "pdf": [".pdf"],
    "spreadsheet": [".xlsx", ".csv"],
    "word": [".docx"],
    "unsupported": [".mp4", ".mp3", ".wav", ".avi", ".mov", ".mkv", ".zip", ".rar", ".7z", ".tar", ".gz", ".exe", ".dll", ".bin", ".dmg", ".apk", ".psd", ".ai", ".sketch", ".fig", ".doc", ".ppt", ".xls"],
}
MIME_SUFFIX = {
    "text/csv": ".csv",
    "application/csv": ".csv",
    "text/plain": ".csv",
    "application/vnd.ms-excel": ".xlsx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/pdf": ".pdf",
    "image/png": ".png",
    "image/jpeg": ".jpg",
    "image/bmp": ".bmp",
    "image/gif": ".gif",
    "image/tiff": ".tiff",
    "image/webp": ".webp",
}
MAX_FILE_MB = 50
MIN_IMAGE_WIDTH, MIN_IMAGE_HEIGHT, MIN_DENSITY, DENSE = 600, 100, 0.01, 0.03
MIN_TOKEN_CONFIDENCE, ENOUGH_TOKENS = 0.05, 20
