"""Insight and exploration tables. Every number a reader sees is computed here from the tables."""
from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.numeric import percent_text, ratio
from ..operators.facts import ChannelTables
from ..operators.ranking import equal_count_bin, exact_quantiles, running_totals
from ..settings import RECOVER_SHARE, TOKEN_SHARE

log = logging.getLogger("tidemark.insights")


def _share(cond: Column) -> Column:
    return F.avg(F.coalesce(cond, F.lit(False)).cast("int"))


def outlier_effect(t: ChannelTables) -> DataFrame:
    """Reported against cleaned quarterly revenue for every region that has an outlier line, with both growth rates."""
    hit = t.clean.where("is_outlier").select("region").distinct()
    q = (t.clean.join(F.broadcast(hit), "region", "left_semi").groupBy("region", "quarter")
         .agg(F.sum("revenue_usd").alias("reported"), F.sum(F.when(~F.col("is_outlier"), F.col("revenue_usd"))).alias("cleaned"),
              F.max(F.when(F.col("is_outlier"), F.col("revenue_usd"))).alias("outlier_revenue")))
    w = Window.partitionBy("region").orderBy("quarter")
    biggest = t.clean.agg(F.max(F.when(~F.col("is_outlier"), F.col("revenue_usd"))).alias("_next"))
    grow = lambda c: ratio(F.col(c), F.lag(c).over(w)) - 1
    return q.withColumns({"reported_qoq": grow("reported"), "cleaned_qoq": grow("cleaned")}).crossJoin(biggest).withColumn(
        "times_next_largest", ratio(F.col("outlier_revenue"), F.col("_next"))).drop("_next")


def growth_vs_shrinking(t: ChannelTables) -> DataFrame:
    """Like for like: total growth, the typical partner and the share shrinking, per region and ALL."""
    act = t.partner_summary.where("revenue_h1_prev > 0").select("region", "revenue_h1", "revenue_h1_prev", "growth_h1_yoy")
    both = act.unionByName(act.withColumn("region", F.lit("ALL")))
    med = exact_quantiles(both, ["region"], "growth_h1_yoy", {"median_partner_growth": 0.5})
    agg = both.groupBy("region").agg(
        (ratio(F.sum("revenue_h1"), F.sum("revenue_h1_prev")) - 1).alias("total_growth"),
        _share(F.col("growth_h1_yoy") < 0).alias("pct_declining"), F.count(F.lit(1)).alias("partners"))
    return agg.join(med, "region", "left")


def cohort_revenue(t: ChannelTables) -> DataFrame:
    c = t.master.select("partner_id", F.when(F.col("onboarded_date") < F.lit(t.settings.start), t.settings.cohort_old)
                        .otherwise(t.settings.cohort_new).alias("cohort"))
    return (t.partner_quarter.join(c, "partner_id").groupBy("region", "cohort", "quarter")
            .agg(F.sum("revenue_usd").alias("revenue")))


def new_partners(t: ChannelTables) -> DataFrame:
    """Existing partners' growth and the new cohort's revenue in the last quarter, per region."""
    s = t.settings
    lq, ly = s.score_cutoff, cal.qlabel(s.last_q - 4)
    pick = lambda c, q: F.sum(F.when((F.col("cohort") == c) & (F.col("quarter") == q), F.col("revenue")))
    return cohort_revenue(t).groupBy("region").agg(
        (ratio(F.coalesce(pick(s.cohort_old, lq), F.lit(0)), pick(s.cohort_old, ly)) - 1).alias("existing_yoy"),
        F.coalesce(pick(s.cohort_new, lq), F.lit(0)).alias("new_cohort_revenue"))


def concentration(t: ChannelTables, shares: list[float] | None = None) -> DataFrame:
    """Cumulative revenue share of the largest partners at the given shares of the partner count."""
    shares = shares or sorted({0.01, 0.05, *[i / 50 for i in range(1, 51)]})
    rev = t.partner_summary.select("partner_id", F.coalesce(F.col("revenue_total"), F.lit(0)).cast("decimal(28,4)").alias("r"))
    cum = running_totals(rev, [-F.col("r"), F.col("partner_id")], {"cum": F.col("r"), "rn": F.lit(1).cast("long")})
    at = F.explode(F.filter(F.array(*[F.struct(F.lit(p).alias("p"), F.greatest(F.floor(F.col("rn_total") * F.lit(p)), F.lit(1))
                                               .alias("k")) for p in shares]), lambda x: x["k"] == F.col("rn")))
    return cum.select("rn", "cum", "cum_total", at.alias("at")).select(
        F.col("at.p").alias("partner_share"), F.col("rn").alias("partners"), ratio(F.col("cum"), F.col("cum_total")).alias("revenue_share"))


def top_partners(t: ChannelTables, k: int = 10) -> DataFrame:
    return (t.partner_summary.select("partner_id", "partner_name", "region", "tier", "partner_type", "revenue_total", "growth_h1_yoy")
            .orderBy(F.col("revenue_total").desc_nulls_last(), "partner_id").limit(k))


def price_index(t: ChannelTables) -> DataFrame:
    """Unit price per family and quarter, first quarter = 100, with price and quantity change since it."""
    g = t.base.groupBy("product_family", "quarter").agg(F.sum("revenue_usd").alias("rev"), F.sum("quantity").alias("quantity"))
    w = Window.partitionBy("product_family").orderBy("quarter").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    price = ratio(F.col("rev"), F.col("quantity"))
    g = g.withColumn("unit_price", price)
    return g.select("product_family", "quarter", "unit_price", "quantity",
                    (F.col("unit_price") / F.first("unit_price").over(w) * 100).alias("price_index"),
                    (ratio(F.col("quantity"), F.first("quantity").over(w)) - 1).alias("quantity_change"))


def margin_mix(t: ChannelTables) -> DataFrame:
    """Weighted margin by family, by tier and by quarter in one pass."""
    dims = ["product_family", "tier", "quarter"]
    fine = t.base.groupBy(*dims).agg(F.sum("revenue_usd").alias("r"), F.sum("margin_usd").alias("m"))
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims]))
    return (fine.select(cells.alias("c"), "r", "m").groupBy("c.dim", "c.value")
            .agg((ratio(F.sum("m"), F.sum("r")) * 100).alias("margin_pct")))


def attainment(t: ChannelTables) -> DataFrame:
    pq = t.partner_quarter.where(F.col("target_usd").isNotNull())
    med = exact_quantiles(pq, ["quarter"], "attainment", {"median_attainment": 0.5})
    return pq.groupBy("quarter").agg(
        ratio(F.sum("revenue_usd"), F.sum("target_usd")).alias("revenue_vs_target"),
        _share(F.col("attainment") >= 1).alias("pct_partners_hit"),
        F.count(F.lit(1)).alias("partners_with_target")).join(med, "quarter", "left")


def attainment_histogram(t: ChannelTables) -> DataFrame:
    """Attainment of the last quarter in tenths, capped at 3; empty bins stay."""
    from .dashboard import histogram
    pq = t.partner_quarter.where(F.col("target_usd").isNotNull() & (F.col("quarter") == t.settings.score_cutoff))
    x = pq.select(F.floor(F.least(F.col("attainment"), F.lit(3.0)) * 10 + 1e-9).alias("tenth"))
    return histogram(x, "tenth", [float(i) for i in range(0, 31)])


def quarter_end_spike(t: ChannelTables) -> DataFrame:
    """How much the last month of a quarter brings against the other two: mean of monthly totals and of sums."""
    m = t.base.groupBy("month").agg(F.sum("revenue_usd").cast("double").alias("r"))
    last = cal.month_in_quarter(F.col("month")) == 3
    return m.agg((F.avg(F.when(last, F.col("r"))) / F.avg(F.when(~last, F.col("r")))).alias("spike_of_means"),
                 (F.sum(F.when(last, F.col("r"))) / (F.sum(F.when(~last, F.col("r"))) / 2)).alias("spike_of_sums"))


def third_vs_second_quarter(t: ChannelTables) -> DataFrame:
    y = F.substring("quarter", 1, 4)
    q = lambda n: F.sum(F.when(F.substring("quarter", 7, 1) == str(n), F.col("revenue_usd")))
    return (t.base.groupBy(y.alias("year"), "region").agg(ratio(q(3), q(2)).alias("q3_over_q2"), q(3).alias("_q3"))
            .where(F.col("_q3").isNotNull()).drop("_q3"))


def churn_signal_rows(t: ChannelTables) -> DataFrame:
    """Partner-quarters from the fifth quarter on: eligible, collapsed, recovered in the next quarter."""
    s = t.settings
    w = Window.partitionBy("partner_id").orderBy("quarter")
    prev = w.rowsBetween(-4, -1)
    rev = F.col("revenue_usd").cast("double")
    x = t.partner_quarter.select("partner_id", "tier", "quarter", rev.alias("rev"), F.avg(rev).over(prev).alias("base"),
                                 F.count(rev).over(prev).alias("n"), F.lead(rev).over(w).alias("next_rev"))
    x = x.where(F.col("quarter") >= cal.qlabel(s.first_q + 4))
    ok = F.coalesce((F.col("n") >= 2) & (F.col("base") > 0), F.lit(False))
    left = ok & (F.col("rev") < TOKEN_SHARE * F.col("base"))
    return x.withColumns({"eligible": ok, "leaver": left,
                          "recovered": left & F.coalesce(F.col("next_rev") >= RECOVER_SHARE * F.col("base"), F.lit(False))})


def churn_noise(t: ChannelTables) -> DataFrame:
    last = t.settings.score_cutoff
    known = F.col("quarter") != last
    g = churn_signal_rows(t).groupBy("quarter").agg(
        F.count_if("eligible").alias("eligible_partners"), F.count_if("leaver").alias("naive_leavers"),
        F.count_if("recovered").alias("_rec"), F.count_if(F.col("leaver") & (F.col("tier") == "Business")).alias("_biz"))
    return g.select("quarter", "eligible_partners", "naive_leavers", ratio(F.col("naive_leavers"), F.col("eligible_partners")).alias("rate"),
                    F.when(known, F.col("_rec")).alias("recovered"),
                    F.when(known, F.col("naive_leavers") - F.col("_rec")).otherwise(0).alias("stayed_low"),
                    F.when(known, 0).otherwise(F.col("naive_leavers")).alias("unknown"),
                    ratio(F.col("_biz"), F.col("naive_leavers")).alias("business_tier_share"),
                    F.when(known, ratio(F.col("_rec"), F.col("naive_leavers"))).alias("recovery_rate"))


def recovery_range(t: ChannelTables) -> DataFrame:
    """Lowest, highest and typical recovery rate over the quarters (at most one row per quarter here)."""
    r = F.col("recovery_rate")
    return churn_noise(t).where(r.isNotNull()).agg(F.min(r).alias("lowest"), F.max(r).alias("highest"), F.median(r).alias("typical"))


DECLINE_GROUPS = {
    "YoY down 2+ quarters": ("yoy_decline_streak", ">=", 2.0),
    "YoY down 3+ quarters": ("yoy_decline_streak", ">=", 3.0),
    "YoY down 4+ quarters": ("yoy_decline_streak", ">=", 4.0),
    "Revenue < 50% of peak": ("rev_drawdown", "<", 0.5),
    "last 2Q YoY <= -25%": ("yoy_2q", "<=", -1 / 7),
}


def _holds(rule) -> Column:
    column, op, x = rule
    c = F.col(column)
    return F.coalesce({">=": c >= x, "<": c < x, "<=": c <= x}[op], F.lit(False))


def observed_vs_expected(panel: DataFrame, groups: dict | None = None, label: str = "left_token") -> DataFrame:
    """Did a group leave more often than others of the same snapshot, tier and size decile? The panel is reduced to
    one count per cell first, so everything after it is as small as the cells."""
    groups = groups or DECLINE_GROUPS
    p = equal_count_bin(panel.select("partner_id", "cutoff", "tier", label, "rev_avg_4q_log", "yoy_decline_streak",
                                     "rev_drawdown", "yoy_2q"),
                        ["cutoff"], [F.col("rev_avg_4q_log"), F.col("partner_id")], 10, "size_decile")
    tags = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), _holds(r).alias("is_in")) for n, r in groups.items()]))
    cells = (p.select("cutoff", "tier", "size_decile", F.col(label).alias("y"), tags.alias("g"))
             .groupBy(F.col("g.name").alias("group"), "cutoff", "tier", "size_decile")
             .agg(F.count_if("g.is_in").alias("n_in"), F.coalesce(F.sum(F.when(F.col("g.is_in"), F.col("y"))), F.lit(0)).alias("y_in"),
                  F.count_if(~F.col("g.is_in")).alias("n_rest"),
                  F.coalesce(F.sum(F.when(~F.col("g.is_in"), F.col("y"))), F.lit(0)).alias("y_rest")))
    rest = cells.groupBy("group").agg(F.sum("y_rest").alias("_y"), F.sum("n_rest").alias("_n"))
    x = cells.join(rest, "group")
    expected = F.col("n_in") * F.coalesce(ratio(F.col("y_rest"), F.col("n_rest")), ratio(F.col("_y"), F.col("_n")))
    out = x.groupBy("group").agg(F.sum("n_in").alias("snapshots"), F.sum("y_in").alias("leavers"),
                                 F.sum(F.when(F.col("n_in") > 0, expected)).alias("expected"),
                                 F.sum("n_rest").alias("rest"), F.sum("y_rest").alias("rest_leavers"))
    return out.withColumn("ratio", ratio(F.col("leavers"), F.col("expected")))


def dimension_breakdowns(t: ChannelTables) -> DataFrame:
    """Revenue, share, margin, growth and attainment for every value of the four dimensions."""
    s = t.settings
    year = s.end.year
    halves = [[f"{y}-Q1", f"{y}-Q2"] for y in (year - 1, year)]
    dims = ["region", "tier", "product_family", "partner_type"]
    fine = t.base_typed.groupBy(*dims, "quarter", "partner_id").agg(F.sum("revenue_usd").alias("r"), F.sum("margin_usd").alias("m"))
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims]))
    h = lambda qs: F.sum(F.when(F.col("quarter").isin(qs), F.col("r")))
    out = fine.select(cells.alias("c"), "quarter", "partner_id", "r", "m").groupBy("c.dim", "c.value").agg(
        F.sum("r").alias("revenue_usd"), (ratio(F.sum("m"), F.sum("r")) * 100).alias("margin_pct"),
        (ratio(h(halves[1]), h(halves[0])) - 1).alias("growth_h1_yoy"), F.countDistinct("partner_id").alias("partners"))
    w = Window.partitionBy("dim")
    out = out.withColumn("share", ratio(F.col("revenue_usd"), F.sum("revenue_usd").over(w)))
    last4 = [cal.qlabel(s.last_q - i) for i in range(4)]
    recent = t.partner_quarter.where(F.col("quarter").isin(last4) & F.col("target_usd").isNotNull())
    pcells = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dims if d != "product_family"]))
    att = recent.select(pcells.alias("c"), "revenue_usd", "target_usd", "attainment").groupBy("c.dim", "c.value").agg(
        ratio(F.sum("revenue_usd"), F.sum("target_usd")).alias("attainment_last4q"),
        _share(F.col("attainment") >= 1).alias("pct_partner_q_hit"))
    return out.join(att, ["dim", "value"], "left")


def regional_trend(t: ChannelTables) -> DataFrame:
    """Quarterly revenue per region and ALL with the change on the same quarter a year earlier."""
    q = t.base.groupBy("region", "quarter").agg(F.sum("revenue_usd").alias("revenue"))
    q = q.unionByName(q.groupBy("quarter").agg(F.sum("revenue").alias("revenue")).withColumn("region", F.lit("ALL")))
    w = Window.partitionBy("region").orderBy("quarter")
    return q.withColumn("yoy", ratio(F.col("revenue"), F.lag("revenue", 4).over(w)) - 1)


def silence(t: ChannelTables) -> DataFrame:
    s = t.settings
    return t.partner_summary.agg(
        F.count_if((F.col("lines_last_q") == 0) & (F.col("onboarded_date") < F.lit(cal.qstart(s.score_cutoff)))).alias("dormant"),
        F.count_if("is_ramping").alias("ramping"), F.count_if(F.col("recency_vs_typical_gap") > 3).alias("silent_3x_gap"))


def last_order_months(t: ChannelTables) -> DataFrame:
    """Partners by the month of their last order, the newest month left out."""
    last = t.base.groupBy("partner_id").agg(F.date_format(F.max("order_date"), "yyyy-MM").alias("last_order_month"))
    m = last.groupBy("last_order_month").agg(F.count(F.lit(1)).alias("partners"))
    top = m.agg(F.max("last_order_month").alias("_top"))
    return m.crossJoin(top).where("last_order_month < _top").drop("_top")


BUILDERS = {
    "growth_vs_shrinking": growth_vs_shrinking, "new_partners": new_partners, "concentration": concentration,
    "margin_mix": margin_mix, "attainment": attainment, "seasonality": quarter_end_spike,
    "volume_not_price": price_index, "outlier": outlier_effect, "churn_noise": churn_noise,
}


def build_insights(t: ChannelTables, builders: dict | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The card tables and a status row per card; one failing card does not hide the others."""
    cards, status = {}, []
    for name, fn in (builders or BUILDERS).items():
        try:
            cards[name] = fn(t)
            status.append((name, "ok", ""))
        except Exception as exc:  # noqa: BLE001 - reported as a row
            log.warning("insight %s failed: %s", name, exc)
            status.append((name, "failed", f"{type(exc).__name__}: {exc}"))
    spark = t.master.sparkSession
    return cards, spark.createDataFrame(status, "card string, status string, detail string")


def takeaway(parts: list[tuple[str, Column]]) -> Column:
    """A sentence from numbers: literal text and formatted columns in turn."""
    return F.concat(*reduce(lambda acc, p: acc + [F.lit(p[0]), p[1]], parts, []))


def growth_sentence(df: DataFrame) -> DataFrame:
    return df.select("region", takeaway([
        ("", F.col("region")), (": like-for-like revenue ", percent_text(F.col("total_growth"), 0, True)),
        (" while ", percent_text(F.col("pct_declining"))), (" of ", F.col("partners").cast("string")),
        (" partners are shrinking", F.lit("."))]).alias("takeaway"))

