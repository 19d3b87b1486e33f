"""From a leave probability per partner to ranks, flags, segments and health scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import sym_to_change
from ..operators.ranking import global_rank


def segment(at_risk: Column, is_ramping: Column, yoy: Column, streak: Column) -> Column:
    """First rule that holds wins; a missing growth falls through to Stable."""
    return (F.when(at_risk == 1, "At risk").when(is_ramping == 1, "Ramping (new)")
            .when((yoy <= -0.25) & (streak >= 2), "Quietly declining").when(yoy >= 0.15, "Growing").otherwise("Stable"))


def flag_top(df: DataFrame, n: Column, p: str = "p_leave", name: str = "at_risk") -> DataFrame:
    """Rank by falling probability, ties by partner id, and flag the first n."""
    r = global_rank(df, [-F.col(p), F.col("partner_id")], "risk_rank")
    return r.withColumn(name, (F.col("risk_rank") <= n).cast("int"))


def assemble(snapshot: DataFrame, master: DataFrame, flag_share: float | None = None, flags: Column | None = None) -> DataFrame:
    """`snapshot` holds the features and p_leave. Flags the given share of partners, or `flags` of them."""
    n = F.floor(F.lit(flag_share) * F.col("risk_rank_total") + 1e-9) if flags is None else flags
    x = flag_top(snapshot, n).join(master.select("partner_id", "partner_name", "country"), "partner_id", "left")
    yoy = sym_to_change(F.col("yoy_2q"))
    extra = [c for c in ("p_leave_unseasonal",) if c in snapshot.columns]
    return x.select(
        "partner_id", "partner_name", "region", "tier", "partner_type", "country", "p_leave", *extra,
        F.bround((1 - F.col("p_leave")) * 100, 4).alias("health_score"), "risk_rank", "at_risk",
        segment(F.col("at_risk"), F.col("is_ramping"), yoy, F.col("yoy_decline_streak")).alias("segment"),
        F.bround(F.expm1("rev_q1_log"), 0).alias("revenue_last_q"), F.bround(F.expm1("rev_avg_4q_log"), 0).alias("revenue_avg_4q"),
        yoy.alias("yoy_h1_pct"), "days_since_last_order", F.bround("lines_per_month_6m", 2).alias("lines_per_month_6m"))


def rule_probability() -> Column:
    """A model-free stand-in: silence over buying frequency."""
    return (1 + F.coalesce(F.col("days_since_last_order"), F.lit(900.0))) / (1000 * (1 + F.coalesce(F.col("lines_per_month_6m"), F.lit(0.0))))


def rule_scores(snapshot: DataFrame, master: DataFrame, share: float = 0.1) -> DataFrame:
    return assemble(snapshot.withColumn("p_leave", rule_probability()), master, share)
