import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators.ranking import equal_count_bin, exact_quantiles, global_rank, running_totals, top_share


def frame(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "g": rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05]),
                        "x": np.round(rng.normal(0, 50, n), 1), "w": rng.integers(1, 5, n)})
    pdf.loc[rng.random(n) < 0.33, "x"] = 7.0  # one value holds a third of all rows
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_running_totals_match_pandas_with_a_hot_value(spark):
    pdf, df = frame(spark)
    got = running_totals(df, [F.col("x"), F.col("id")], {"cw": F.col("w"), "rn": F.lit(1).cast("long")}, ["g"], buckets=7).toPandas()
    p = pdf.sort_values(["g", "x", "id"])
    p["cw"], p["rn"] = p.groupby("g")["w"].cumsum(), p.groupby("g").cumcount() + 1
    m = got.merge(p, on="id", suffixes=("", "_p"))
    assert len(m) == len(pdf) and (m["cw"] == m["cw_p"]).all() and (m["rn"] == m["rn_p"]).all()
    assert (got.groupby("g")["rn_total"].first() == pdf.groupby("g").size()).all()


def test_global_rank_without_groups_is_a_permutation(spark):
    pdf, df = frame(spark, 500)
    got = global_rank(df, [-F.col("x"), F.col("id")], "rn").toPandas().sort_values("rn")
    assert list(got["rn"]) == list(range(1, 501))
    assert list(got["id"]) == list(pdf.assign(k=-pdf["x"]).sort_values(["k", "id"])["id"])


def test_quantiles_are_exact(spark):
    pdf, df = frame(spark)
    df = df.withColumn("x", F.when(F.col("id") % 50 == 0, None).otherwise(F.col("x")))
    pdf.loc[pdf["id"] % 50 == 0, "x"] = np.nan
    got = exact_quantiles(df, ["g"], "x", {"q1": 0.01, "q50": 0.5, "q99": 0.99}).toPandas().set_index("g")
    for g, v in pdf.groupby("g")["x"]:
        for name, q in (("q1", 0.01), ("q50", 0.5), ("q99", 0.99)):
            assert np.isclose(got.loc[g, name], v.quantile(q)), (g, name)


def test_quantiles_of_tiny_and_single_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0), ("c", None)], "g string, x double")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "x", {"m": 0.5}).collect()}
    assert got == {"a": 1.0, "b": 3.0}


def test_deciles_follow_interpolated_edges(spark):
    for n in (7, 23, 131):
        pdf = pd.DataFrame({"id": range(n), "x": np.random.default_rng(n).random(n)})
        got = equal_count_bin(spark.createDataFrame(pdf), [], [F.col("x"), F.col("id")]).toPandas().sort_values("id")["bin"].to_numpy()
        assert (got == pd.qcut(pdf["x"].rank(method="first"), 10, labels=False).to_numpy()).all(), n


def test_top_share_counts_exactly(spark):
    df = spark.range(20).withColumn("s", F.lit(1.0))
    got = [r["id"] for r in top_share(df, [-F.col("s"), F.col("id")], 0.15).where("chosen").orderBy("id").collect()]
    assert got == [0, 1, 2]
