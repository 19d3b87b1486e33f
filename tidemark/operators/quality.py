"""Checks that end as rows of (rule, count): domains, keys, orphans, nulls."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..settings import ChannelSettings
from . import facts


def domain_frame(spark: SparkSession, column: str, values) -> DataFrame:
    """A dimension's allowed values with their rank; as long as the domain, so it may be broadcast."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"{column} string, rank int")


def unknown_values(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """Values outside their domain. The domains are short lists, so the test is a literal IN, checked in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in domains]))
    rows = df.select(pairs.alias("x")).select("x.*").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    ok = reduce(lambda a, b: a | b, [(F.col("dimension") == c) & F.col("value").isin(list(v)) for c, v in domains.items()])
    return rows.where(F.col("value").isNotNull() & ~ok)


def require_domains(df: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """The frame unchanged; the job fails on the first value outside its domain."""
    out = df
    for c, values in domains.items():
        if c in df.columns and values:
            out = out.withColumn(c, F.when(F.col(c).isNull() | F.col(c).isin(list(values)), F.col(c)).otherwise(
                F.raise_error(F.concat(F.lit(f"Unexpected value in {c}: "), F.col(c))).cast("string")))
    return out


def period_revenue(lines: DataFrame, by: str, start, end) -> DataFrame:
    return (lines.where(F.col("order_date").between(F.lit(start), F.lit(end)))
            .groupBy(by).agg(F.sum("revenue_usd").alias("revenue_usd")))


def _null_cells(df: DataFrame) -> DataFrame:
    return df.agg(reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns]).alias("value"))


def data_quality(sales: DataFrame, master: DataFrame, targets: DataFrame, settings: ChannelSettings) -> DataFrame:
    ids = sales.groupBy("partner_id").agg(F.min("order_date").alias("first_order"))
    dims = (sales.select("partner_id", "region", "tier").distinct()
            .join(master.select("partner_id", F.col("region").alias("mr"), F.col("tier").alias("mt")), "partner_id"))
    copies = sales.groupBy(*sales.columns).agg(F.count(F.lit(1)).alias("n"))
    known = ids.join(master.select("partner_id", "onboarded_date"), "partner_id")
    n = lambda df: df.agg(F.count(F.lit(1)).alias("value"))
    checks = {
        "sales lines": n(sales), "partners in master": n(master), "target rows": n(targets),
        "null cells in sales": _null_cells(sales), "null cells in master": _null_cells(master),
        "null cells in targets": _null_cells(targets),
        "duplicate sales lines": copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("value")),
        "lines with revenue or quantity <= 0": n(sales.where("revenue_usd <= 0 OR quantity <= 0")),
        "sales partners missing from master": n(ids.join(master, "partner_id", "left_anti")),
        "master partners without sales": n(master.join(ids, "partner_id", "left_anti")),
        "master partners without targets": n(master.join(targets.select("partner_id").distinct(), "partner_id", "left_anti")),
        "region differs from master": n(dims.where("region <> mr")), "tier differs from master": n(dims.where("tier <> mt")),
        "partners ordering before onboarding": n(known.where("first_order < onboarded_date")),
        "partners onboarded in the window": n(master.where(F.col("onboarded_date") >= F.lit(settings.start))),
        "outlier lines": n(facts.clean_lines(sales).where("is_outlier")),
    }
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("check_name"), "value") for k, df in checks.items()])
