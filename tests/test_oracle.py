"""Every registered query with SQL equals it; the others run."""

import pytest
from conftest import DATA, same_rows

from ledgerloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same_rows(QUERIES[name](spark, DATA), SQL[name])


def test_map_headers(spark):
    rows = {(r["doc_id"], r["field"]): r["header"] for r in QUERIES["map_headers"](spark, DATA).collect()}
    assert rows[0, "avg_cost_per_share"] == "avg cost" and rows[4, "symbol"] == "ticker"
    assert rows[1, "last_price"] == "price"


def test_column_centres_equal_a_loop(spark):
    from pyspark.sql import functions as F

    from ledgerloom.plans.queries import TOKENS, raw

    wanted = {}
    for r in raw(spark, DATA, "events", TOKENS).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.bround("x", 0))).alias("xs")).collect():
        centres = []
        for x in r["xs"]:
            if centres and x - centres[-1] <= 25:
                centres[-1] = (centres[-1] + x) / 2
            else:
                centres.append(x)
        xs = r["xs"]
        cut = max(range(1, len(xs)), key=lambda i: (xs[i] - xs[i - 1], i)) if len(xs) > 1 else None
        halves = [sum(xs[:cut]) / cut, sum(xs[cut:]) / len(xs[cut:])] if cut else None
        wanted[r["doc_id"]] = (centres, halves)
    found = {}
    for r in QUERIES["column_centres"](spark, DATA).orderBy("doc_id", "place").collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert found.keys() == wanted.keys()
    for doc_id, rows in found.items():
        centres, halves = wanted[doc_id]
        assert [r["centre"] for r in rows] == pytest.approx(centres)
        assert [rows[0]["half_1"], rows[0]["half_2"]] == (pytest.approx(halves) if halves else [None, None])


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
