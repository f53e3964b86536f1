import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(frame, sql: str, folder: str = DATA) -> None:
    """The frame's rows equal those of DuckDB's SQL over the same tables, in any order; doubles to 6 digits."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    columns = sorted(frame.columns)
    found = con.execute(f"SELECT * FROM ({sql})")
    names = [d[0] for d in found.description]
    assert sorted(names) == columns

    def plain(v):
        if isinstance(v, bool) or v is None or isinstance(v, str):
            return repr(v)
        return repr(round(float(v), 6)) if isinstance(v, int | float) else repr(v)

    wanted = sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in columns) for r in frame.select(columns).collect())
    assert got == wanted
