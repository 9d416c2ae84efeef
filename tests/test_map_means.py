"""Cells that tie with the median of their map fall on the side on which the SQL puts them."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from fieldgrain.plans import load_queries
from tools.check import compare


@pytest.fixture(scope="module")
def events():
    # means of three cents each: many are equal, and their doubles differ by the order of the sums
    rng = np.random.default_rng(5)
    n = 15000
    cell = np.sort(np.tile(np.arange(n // 3), 3))[rng.permutation(n)]
    found = pd.DataFrame({
        "event_id": np.arange(n),
        "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(cell % 10, unit="D"),
        "user_id": cell // 10,
        "event_type": "view",
        "value": rng.integers(1, 40, n) / 10,
        "props": '{"k": 4}',
    })
    found["ts"] = found["ts"].astype("datetime64[us]")
    found.loc[cell == 77, "value"] = np.nan
    return found.astype({"value": "Float64"})


def test_regions_of_ties_are_those_of_the_sql(spark, tmp_path, events):
    query = load_queries()["pseudo_regions"]
    # one file in the order of the events, and files in another order
    (tmp_path / "mixed").mkdir()
    events.to_parquet(tmp_path / "events.parquet", index=False)
    moved = events.sample(frac=1.0, random_state=1)
    (tmp_path / "mixed" / "events.parquet").mkdir()
    for part in range(3):
        moved.iloc[part::3].to_parquet(tmp_path / "mixed" / "events.parquet" / f"part-{part}.parquet", index=False)
    with duckdb.connect() as con:
        con.execute(f"SET TimeZone='UTC'; SET threads=1; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = con.execute(query.sql).fetchdf()
    assert compare(query.build(spark, str(tmp_path)).toPandas(), want) == ""
    assert compare(query.build(spark, str(tmp_path / "mixed")).toPandas(), want) == ""
