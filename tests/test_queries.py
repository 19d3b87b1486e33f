import duckdb
import pytest

from tidemark import catalog
from tools.check import TABLES, norm

REG = catalog.load()
NAMES = ["region_quarter", "rollup_grouping_sets", "partner_snapshot", "outlier_limits", "trend_quarter_region", "breakdown_tier", "churn_noise",
         "revenue_concentration", "forecast_backtest", "decide_with_cap", "threshold_sweep", "correctness_features", "severity_tokens",
         "counterfactual_edits", "stream_uncapped", "churn_labels"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_twin(spark, sf, name):
    e = REG[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = e.fn(spark, sf)
    res = con.execute(e.sql)
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    key = sorted(cols)
    a = sorted(tuple(norm(r[c]) for c in key) for r in (x.asDict() for x in df.collect()))
    b = sorted(tuple(norm(r[cols.index(c)]) for c in key) for r in res.fetchall())
    assert a == b


def test_every_query_names_its_inventory_rows():
    assert all(e.rows for e in REG.values()) and len(REG) > 150
