"""The registered queries against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from aerolith.plans import catalog

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    return v.item() if hasattr(v, "item") else v


def rows(df):
    out = [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v or 0) for v in r))


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    assert rows(catalog.QUERIES[name](spark, str(DATA)).toPandas()) == rows(con.execute(catalog.ORACLE_SQL[name]).fetchdf())


def test_whole_tables_are_averaged(spark, tmp_path):
    """Every user's events and every month's orders count; days and quarters without any stay."""
    ts = pd.to_datetime(["2024-01-01 12:30", "2024-01-01 16:59", "2024-01-01 17:00", "2024-01-04 13:00"])
    events = pd.DataFrame({"event_id": range(4), "user_id": [1, 2, 3, 4], "event_type": ["click", "error", "view", "click"], "ts": ts.astype("datetime64[us]"), "value": [1.0, 3.0, 100.0, 7.0]})
    events.to_parquet(tmp_path / "events.parquet")
    days = [plain(v) for _, v in sorted((r["day"], r["value"]) for r in catalog.QUERIES["a3_well_mixed_all"](spark, str(tmp_path)).collect())]
    assert days == [2.0, None, None, 7.0]
    orders = pd.DataFrame({"o_orderdate": pd.to_datetime(["2024-03-01", "2024-04-01", "2024-12-01"]).astype("datetime64[us]"), "o_totalprice": [1.0, 5.0, 9.0]})
    orders.to_parquet(tmp_path / "orders.parquet")
    got = {(r["year"], r["season"]): (r["o_totalprice_mean"], r["o_totalprice_count"]) for r in catalog.QUERIES["a2_seasonal_all"](spark, str(tmp_path)).collect()}
    assert got == {(2024, "MAM"): (3.0, 2), (2024, "JJA"): (None, None), (2024, "SON"): (None, None), (2024, "DJF"): (9.0, 1)}


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(catalog.QUERIES) <= set(e.queries())
