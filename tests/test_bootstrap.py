"""The resampled AUC draws its weights in chunks of rows; no row is copied for a replicate."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import stats


def test_replicates_equal_rows_copied_for_each(spark, monkeypatch):
    monkeypatch.setattr(stats, "CHUNK", 40)
    rng = np.random.default_rng(5)
    d = pd.DataFrame({"cutoff": rng.choice(["2000-Q1", "2001-Q4"], 300), "row_id": np.arange(300) * 2_000_000_011 - 7, "y": rng.integers(0, 2, 300),
                      "a": rng.normal(size=300).round(1), "b": np.where(rng.random(300) < 0.6, 0.0, rng.normal(size=300))})
    df = spark.createDataFrame(d)
    w = df.withColumn("replicate", stats.replicates(6)).select("*", stats.poisson1(42, F.col("replicate"), F.col("cutoff"), F.col("row_id")).alias("w")).toPandas()

    def auc(x, score):
        p, n = x[x.y == 1], x[x.y == 0]
        won = (p[score].to_numpy()[:, None] > n[score].to_numpy()) + 0.5 * (p[score].to_numpy()[:, None] == n[score].to_numpy())
        return (won * p.w.to_numpy()[:, None] * n.w.to_numpy()).sum() / (p.w.sum() * n.w.sum())

    want = {r: np.mean([auc(x, "a") - auc(x, "b") for _, x in g.groupby("cutoff")]) for r, g in w.groupby("replicate")}
    open_ = df.limit(5).withColumns({"row_id": F.col("row_id") + 10**15, "y": F.lit(None).cast("long")})  # without a label: neither side
    reps = stats._auc_replicates(df.unionByName(open_), ["cutoff"], "y", "a", "b", 6, 42)
    assert {r.replicate: r._m for r in reps.collect()} == pytest.approx(want, abs=1e-12)
    out = stats.auc_bootstrap(df, ["cutoff"], "y", "a", "b", boot=50).collect()
    assert len(out) == 1 and out[0].lo < out[0].hi
