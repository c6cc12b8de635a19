"""Every catalog query against its DuckDB SQL on the smallest tables, and the entry point without the optional package."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lurescope.plans import catalog

DATA = Path("/root/testdata/sf0.001")
REPO = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def rows(frame: pd.DataFrame) -> list:
    cols = sorted(frame.columns)
    shown = lambda x: "NULL" if x is None or x is pd.NaT or x is pd.NA or x != x else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(shown, r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    assert len(got.columns)
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_without_the_optional_package():
    code = "import sys; sys.modules['lurescope.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'campaign_top_indicators' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, env=os.environ | {"PYTHONPATH": str(REPO)}, check=True, timeout=120)


def test_stream_replay_changes_nothing(spark):
    from datetime import datetime

    from lurescope.streaming.victims import merge_batch

    a = spark.createDataFrame([(1, datetime(2024, 1, 5), datetime(2024, 1, 9), 2)], "victim_id long, first_seen timestamp, last_seen timestamp, kits long")
    late = spark.createDataFrame([(1, datetime(2024, 1, 1), datetime(2024, 1, 9), 3)], a.schema)
    once = merge_batch(a, late)
    assert [tuple(r) for r in once.collect()] == [tuple(r) for r in merge_batch(once, late).collect()] == [(1, datetime(2024, 1, 1), datetime(2024, 1, 9), 3)]


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    from lurescope.streaming.victims import victim_state

    landed, state = f"file://{tmp_path}/orders.parquet", f"file://{tmp_path}/state"
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("id % 7 as o_custkey", "id as o_orderkey", "'1-URGENT' as o_orderpriority", "date_add(date'2024-01-01', cast(id as int)) as o_orderdate").coalesce(1)
    rows(50, 100).write.parquet(landed)
    assert victim_state(spark, landed, state).agg({"first_seen": "min"}).first()[0].isoformat() == "2024-02-20"
    rows(0, 50).write.mode("append").parquet(landed)
    got = victim_state(spark, landed, state)
    assert got.agg({"first_seen": "min"}).first()[0].isoformat() == "2024-01-01" and got.count() == 7
    assert victim_state(spark, landed, state).count() == 7
