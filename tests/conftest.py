"""A small session for all tests, and comparison with SQL."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from scholia.session import session

    s = session("tests", **{"spark.master": "local[4]", "spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.local.dir": str(tmp_path_factory.mktemp("spark")), "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6) + 0.0
    return [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def rows_of(df) -> list:
    """A DataFrame's rows by column name, in an order of their own."""
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list]:
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
