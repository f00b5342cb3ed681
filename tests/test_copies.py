"""Queries against their SQL on tables that hold copies of their rows under other keys."""

import os

import duckdb
import pytest

from readspan.plans.registry import ORACLES, QUERIES
from tests.test_queries import DIR, TABLES, rows


def copied(path, n: int, **shifts: dict[str, int]) -> str:
    """A folder with ``n`` copies of each named table, the i-th with its columns shifted by i times the number given; others as they are."""
    con = duckdb.connect()
    for t in TABLES:
        target = f"{path}/{t}.parquet"
        if t not in shifts:
            os.symlink(f"{DIR}/{t}.parquet", target)
            continue
        moved = ", ".join(f"cast({c} + i * {by} as bigint) as {c}" for c, by in shifts[t].items())
        con.execute(f"copy (select * replace ({moved}) from '{DIR}/{t}.parquet', range({n}) r(i)) to '{target}' (format parquet)")
    return str(path)


def agree(spark, name: str, path: str) -> int:
    """Raises unless the query gives its SQL's rows; their number."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    df = QUERIES[name](spark, path)
    got, want = rows(df.columns, map(tuple, df.collect())), con.execute(ORACLES[name])
    assert got == rows([c[0] for c in want.description], want.fetchall())
    return len(got)


@pytest.mark.parametrize("name", ["healed_sittings", "rebuilt_sittings"])
def test_orders_of_a_customer_that_start_in_one_second(spark, tmp_path, name):
    assert agree(spark, name, copied(tmp_path, 3, orders={"o_orderkey": 160_000}))
