"""Order-dependent operators that stay distributed.

A Spark window without a partition key, or with one hot key, runs in a single task, and `orderBy().limit(k)` brings k
rows to the driver. Ranks, running totals, quantiles and "the top 15 percent" are therefore built here from a two-level
prefix sum: rows are cut into ordered buckets, every bucket is totalled (map-side combined), the few totals are
accumulated, and each bucket only accumulates its own rows on top of its offset. The results are exact."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SAMPLE_PER_BUCKET = 32


def bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions: whoever sizes those for the data sizes the buckets."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column], within: list[str] | None = None,
                   buckets: int | None = None) -> DataFrame:
    """Add, for every name in `sums`, the inclusive running total `<name>` and the group total `<name>_total`.

    `order` must be ascending and unique inside a group (end it with an id), so that no tie, however large, has to sit
    in one bucket. `within` names the grouping columns; groups may be of any size. Bucket edges come from the rows with
    the smallest hash of their key: a bounded, repeatable sample, so a recomputed task cuts the rows the same way."""
    within = within or []
    n = buckets or bucket_count(df)
    key = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(within)],
                   *[c.alias(f"k{i}") for i, c in enumerate(order)])
    keyed = df.select("*", key.alias("_key"), *[c.alias(f"_v_{name}") for name, c in sums.items()])

    sample = (keyed.select("_key").orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE_PER_BUCKET * n)
              .agg(F.sort_array(F.collect_list("_key")).alias("s")))
    step = F.greatest(F.floor(F.size("s") / n), F.lit(1)).cast("int")
    edges = sample.select(F.filter("s", lambda _, i: (i % step) == (step - 1)).alias("_edges"))
    placed = (keyed.crossJoin(F.broadcast(edges))
              .withColumn("_bucket", F.aggregate(F.array(*[F.lit(1 << b) for b in reversed(range((2 * n).bit_length()))]), F.lit(0),
                                                 lambda at, step: at + F.when(F.get("_edges", at + step - 1) < F.col("_key"), step).otherwise(0)))
              .drop("_edges"))

    totals = placed.groupBy(*within, "_bucket").agg(*[F.sum(f"_v_{s}").alias(f"_b_{s}") for s in sums])
    whole = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"_o_{c}") for c in within], F.col("_bucket").alias("_o_bucket"),
        *[F.coalesce(F.sum(f"_b_{s}").over(before), F.lit(0)).alias(f"_off_{s}") for s in sums],
        *[F.sum(f"_b_{s}").over(whole).alias(f"{s}_total") for s in sums])
    cond = F.col("_bucket") == F.col("_o_bucket")
    for c in within:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    inner = (Window.partitionBy(*within, "_bucket").orderBy("_key")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (placed.join(offsets, cond)
            .select(*df.columns,
                    *[(F.col(f"_off_{s}") + F.sum(f"_v_{s}").over(inner)).alias(s) for s in sums],
                    *[f"{s}_total" for s in sums]))


def global_rank(df: DataFrame, order: list[Column], name: str = "rn", within: list[str] | None = None) -> DataFrame:
    """row_number over the whole frame (or inside groups of any size), with `<name>_total` rows."""
    return running_totals(df, order, {name: F.lit(1).cast("long")}, within)


def _level(x: Column, scale: float = 1e4, steps: int = 1024) -> Column:
    """A monotone, scale-free integer bucket: about 0.07 percent wide in relative terms."""
    return F.floor(F.signum(x) * F.log2(1 + F.abs(x) * scale) * steps).cast("long")


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    weight: str | None = None, few_groups: bool = False) -> DataFrame:
    """Linearly interpolated quantiles of `value` for each group, exact for groups of any size.

    First pass: a histogram on a monotone bucket, combined map-side. Second pass: only the rows in the buckets that
    hold the wanted ranks. With `few_groups`, for groups of a domain of known size, the wanted buckets (two a group and
    quantile at most) are broadcast and nothing but the rows in them is shuffled. Missing values are ignored."""
    rows = df.where(F.col(value).isNotNull()).select(
        *by, F.col(value).cast("double").alias("_x"),
        (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("_w"))
    rows = rows.withColumn("_lvl", _level(F.col("_x")))
    hist = rows.groupBy(*by, "_lvl").agg(F.sum("_w").alias("_n"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    run = whole.orderBy("_lvl").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.select(*by, "_lvl", "_n", (F.sum("_n").over(run) - F.col("_n")).alias("_before"),
                       F.sum("_n").over(whole).alias("_total"))
    ranks = F.array(*[F.struct(F.lit(name).alias("q"), (F.lit(p) * (F.col("_total") - 1)).alias("pos"))
                      for name, p in probs.items()])
    wanted = (hist.select("*", F.explode(ranks).alias("_r"))
              .select("*", F.explode(F.array_distinct(F.array(F.floor("_r.pos"), F.ceil("_r.pos")))).alias("_rank"))
              .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))))
    targets = wanted.select(*[F.col(c).alias(f"_t_{c}") for c in by], F.col("_lvl").alias("_t_lvl"),
                            "_before").distinct()
    targets = F.broadcast(targets) if few_groups else targets
    cond = F.col("_lvl") == F.col("_t_lvl")
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    near = (rows.join(targets, cond).groupBy(*by, "_lvl", "_x")
            .agg(F.sum("_w").alias("_n"), F.first("_before").alias("_before")))
    inner = Window.partitionBy(*by, "_lvl").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.select(*by, "_lvl", "_x", "_n",
                       (F.col("_before") + F.sum("_n").over(inner) - F.col("_n")).alias("_lo"))
    pick = (wanted.select(*[F.col(c).alias(f"_t_{c}") for c in by], F.col("_lvl").alias("_t_lvl"), "_rank",
                          F.col("_r.q").alias("_q"), F.col("_r.pos").alias("_pos")))
    hit = near.join(pick, cond).where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_lo") + F.col("_n")))
    out = hit.groupBy(*by).agg(*[x for name in probs for x in (
        F.max(F.when((F.col("_q") == name) & (F.col("_rank") == F.floor("_pos")), F.col("_x"))).alias(f"_a_{name}"),
        F.max(F.when((F.col("_q") == name) & (F.col("_rank") == F.ceil("_pos")), F.col("_x"))).alias(f"_b_{name}"),
        F.max(F.when(F.col("_q") == name, F.col("_pos"))).alias(f"_p_{name}"))])
    return out.select(*by, *[
        (F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}"))
         * (F.col(f"_p_{name}") - F.floor(f"_p_{name}"))).alias(name) for name in probs])


def equal_count_bin(df: DataFrame, within: list[str], order: list[Column], bins: int = 10,
                    name: str = "bin") -> DataFrame:
    """Equal-count bins 0..bins-1 from the first-come rank, with linearly interpolated edges (not ntile)."""
    r = global_rank(df, order, "_rn", within)
    pos = (F.col("_rn") - 1) * bins / F.nullif(F.col("_rn_total") - 1, F.lit(0))
    return (r.withColumn(name, F.coalesce(F.greatest(F.ceil(pos) - 1, F.lit(0)), F.lit(0)).cast("int"))
            .drop("_rn", "_rn_total"))


def top_share(df: DataFrame, order: list[Column], cap: float, name: str = "chosen") -> DataFrame:
    """Flag the first floor(cap * n + 1e-9) rows in `order`, n being the row count."""
    r = global_rank(df, order, "_rn")
    return (r.withColumn(name, F.col("_rn") <= F.floor(F.lit(cap) * F.col("_rn_total") + 1e-9))
            .drop("_rn", "_rn_total"))
