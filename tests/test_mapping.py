from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom import vocabulary as V
from ledgerloom.operators.images import adapt_lines
from ledgerloom.operators.mapping import header_points, map_columns, similarity


def test_exact_headers():
    got = map_columns(("Symbol", "Name", "Shares", "Avg Cost", "Total Cost", "Side"), "holding")
    assert got == {"symbol": "Symbol", "name": "Name", "shares": "Shares", "avg_cost_per_share": "Avg Cost", "total_cost": "Total Cost", "side": "Side"}


def test_fuzzy_header_and_chinese():
    assert map_columns(("Net Amt",), "transaction")["net_amount"] == "Net Amt"
    assert map_columns(("股票代码", "股数", "成本价"), "holding") == {"symbol": "股票代码", "shares": "股数", "avg_cost_per_share": "成本价"}


def test_first_header_wins_and_one_to_one():
    got = map_columns(("ticker", "symbol", "qty"), "holding")
    assert got["symbol"] == "ticker" and len(set(got.values())) == len(got)


def test_similarity_is_not_symmetric():
    assert similarity("tide", "diet") == 0.25 and similarity("diet", "tide") == 0.5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["symbol", "Ticker", "quantity", "description", "current price", "wt", "target pct", "holding type", "x", "avg costs", "notes"]), max_size=8, unique=True), st.sampled_from(list(V.VOCABULARIES)), st.sampled_from([0.6, 0.75]))
def test_like_a_double_loop(headers, vocabulary, threshold):
    fields, result, left = V.VOCABULARIES[vocabulary], {}, list(headers)
    for h in headers:
        for f, words in fields.items():
            if h.lower() in words and f not in result:
                result[f] = h
                left.remove(h)
                break
    for f, words in fields.items():
        if f in result:
            continue
        best, top = None, 0.0
        for h in left:
            for w in words:
                s = 1.0 if h.lower() == w else SequenceMatcher(None, h.lower(), w).ratio()
                if s > top:
                    best, top = h, s
        if best is not None and top >= threshold:
            result[f] = best
            left.remove(best)
    assert map_columns(tuple(headers), vocabulary, threshold) == result


def test_header_points_and_lines():
    assert [header_points(x) for x in ("Symbol", "simbol", "12.5", "")] == [2, 1, 0, 0]
    box = [[0, 0], [1, 0], [1, 1], [0, 1]]
    lines = [[box, (" A ", 0.9)], [box, ("low", 0.01)], {"transcription": {"text": "B", "score": 0.5}, "points": box}, 7, [box, ("", 1.0)]]
    assert [(t, c) for _, t, c in adapt_lines(lines)] == [("A", 0.9), ("B", 0.5)]
