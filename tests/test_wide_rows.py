"""The feature rows are wide: their projections must compile, and their quantiles must not move every row."""
import re

from tidemark.catalog import snapshots as s
from tidemark.operators import features as ft
from tidemark.session import cut_lineage


def test_features_compile_and_limits_move_no_rows(spark, sf):
    raw = ft.snapshots(cut_lineage(s.history(spark, sf)), s.SETTINGS.train_cutoffs, s.SETTINGS)
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = raw._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", text)]
        assert sizes and min(sizes) > 0
        kept = cut_lineage(raw)
        plan = ft.center_and_winsorize(kept, s.SETTINGS)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
    # rows meet the buckets they may be in by broadcast; sorted joins are left for the few picked values
    assert len(re.findall("SortMergeJoin", plan)) <= 2
