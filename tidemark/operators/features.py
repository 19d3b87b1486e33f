"""Point-in-time partner features and next-quarter labels.

All snapshots come out of one job. Lines are summed once per (partner, quarter), the at most ten quarter rows of a
partner become arrays, and a snapshot only reads those arrays at and before its own quarter. Adding a snapshot adds no
shuffle, and a partner with a third of all lines is one row per quarter before anything moves."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import calendar as cal
from ..functions import numeric as nm
from ..session import cut_lineage
from ..settings import (ChannelSettings, DOWN_QUARTER, RAMPING_MONTHS, RATIO_CAP, RECENCY_CAP, TOKEN_SHARE, WINSOR)
from .facts import tenure
from .ranking import exact_quantiles

CATEGORICAL = ["partner_type", "tier", "region"]
WINSORIZED = ["rev_cv_4q", "rev_cv_6m", "rev_slope_4q", "rev_slope_6m", "att_trend_4q", "margin_trend", "margin_vs_tier"]

GROUPS = {
    "revenue_trend": ["rev_q1_log", "rev_avg_2q_log", "rev_avg_4q_log", "rev_growth_qoq", "rev_growth_2q",
                      "rev_q1_vs_prev4q", "rev_cv_4q", "rev_cv_6m", "rev_slope_4q", "rev_slope_6m", "rev_drawdown"],
    "order_activity": ["order_days_6m", "lines_per_month_6m", "active_month_share_6m", "lines_last_month",
                       "lines_3m_vs_prev3m", "lines_q1_vs_prev4q", "days_since_last_order", "typical_gap_days",
                       "recency_vs_gap", "avg_line_value_6m_log", "line_value_3m_vs_prev3m", "never_ordered"],
    "target_attainment": ["att_q1", "att_avg_2q", "att_avg_4q", "att_trend_4q", "att_miss_streak", "att_misses_4q",
                          "target_yoy"],
    "profit_quality": ["margin_pct_4q", "margin_pct_2q", "margin_trend", "margin_vs_tier", "margin_usd_4q_log"],
    "product_diversity": ["n_products_q1", "n_products_2q", "n_products_change", "share_*_2q", "product_hhi_2q"],
    "year_on_year": ["yoy_q1", "yoy_2q", "lines_yoy_2q", "yoy_down_quarters_4q", "yoy_decline_streak",
                     "yoy_2q_vs_region"],
    "static": ["partner_type", "tier", "region", "tier_rank", "tenure_months", "is_ramping", "quarters_observed"],
}


def share_name(family: str) -> str:
    return f"share_{family.lower().replace(' ', '_')}_2q"


def feature_names(settings: ChannelSettings) -> list[str]:
    out = []
    for names in GROUPS.values():
        for n in names:
            out += [share_name(f) for f in settings.families] if n == "share_*_2q" else [n]
    return out


def numeric_features(settings: ChannelSettings) -> list[str]:
    return [n for n in feature_names(settings) if n not in CATEGORICAL]


def feature_group(settings: ChannelSettings) -> dict[str, str]:
    out = {}
    for g, names in GROUPS.items():
        for n in names:
            for f in ([share_name(x) for x in settings.families] if n == "share_*_2q" else [n]):
                out[f] = g
    return out


def partner_history(base: DataFrame, master: DataFrame, targets: DataFrame, settings: ChannelSettings) -> DataFrame:
    """One row per partner with dense month and quarter arrays over the window."""
    d = F.col("order_date")
    n_q = settings.last_q - settings.first_q + 1
    # lines before the onboarding month are outside the grid, but count for order days and product mix
    lines = base.join(master.select("partner_id", cal.month_start(F.col("onboarded_date")).alias("_from")), "partner_id")
    in_grid = F.col("month") >= F.col("_from")
    k = cal.month_in_quarter(d)
    measures = [agg for i in (1, 2, 3) for agg in (
        F.sum(F.when(in_grid & (k == i), F.col("revenue_usd"))).alias(f"r{i}"),
        F.sum(F.when(in_grid & (k == i), F.col("margin_usd"))).alias(f"g{i}"),
        F.count_if(in_grid & (k == i)).alias(f"l{i}"))]
    mix = [F.sum(F.when(F.col("product_family") == f, F.col("revenue_usd"))).alias(f"f{i}")
           for i, f in enumerate(settings.families)]
    per_q = (lines.groupBy("partner_id", (cal.quarter_index(d) - settings.first_q).alias("q"))
             .agg(*measures, *mix, F.collect_set("order_date").alias("days")))
    keep = [c for c in per_q.columns if c not in ("partner_id", "q")]
    hist = per_q.groupBy("partner_id").agg(
        F.map_from_entries(F.collect_list(F.struct("q", F.struct(*keep)))).alias("h"))
    goal = (targets.select("partner_id", (cal.index_of_label(F.col("quarter")) - settings.first_q).alias("q"),
                           F.col("target_usd").cast("double").alias("t"))
            .groupBy("partner_id").agg(F.map_from_entries(F.collect_list(F.struct("q", "t"))).alias("goal")))
    rows = master.join(hist, "partner_id", "left").join(goal, "partner_id", "left")

    first_month = F.lit(settings.start.year * 12 + settings.start.month - 1)
    from_month = F.greatest(cal.month_index(F.col("onboarded_date")) - first_month, F.lit(0))
    quarters = F.sequence(F.lit(0), F.lit(n_q - 1))
    cell = lambda q: F.col("h")[q]

    def month_array(prefix: str) -> Column:
        def one(q, i):
            v = F.coalesce(cell(q)[f"{prefix}{i + 1}"].cast("double"), F.lit(0.0))
            return F.when(q * 3 + i >= F.col("_m0"), v)
        return F.flatten(F.transform(quarters, lambda q: F.array(*[one(q, i) for i in range(3)])))

    def quarter_array(prefix: str) -> Column:
        def one(q):
            total = reduce(lambda a, b: a + b, [F.coalesce(cell(q)[f"{prefix}{i}"], F.lit(0)) for i in (1, 2, 3)])
            return F.when(q * 3 + 2 >= F.col("_m0"), total.cast("double"))
        return F.transform(quarters, one)

    return (rows.withColumn("_m0", from_month).select(
        "partner_id", "partner_name", "region", "tier", "partner_type", "country", "onboarded_date",
        month_array("r").alias("rev_m"), month_array("l").alias("lines_m"),
        quarter_array("r").alias("rev_q"), quarter_array("l").alias("lines_q"), quarter_array("g").alias("mgn_q"),
        F.transform(quarters, lambda q: F.when(q * 3 + 2 >= F.col("_m0"), F.col("goal")[q])).alias("tgt_q"),
        F.transform(quarters, lambda q: F.array(*[cell(q)[f"f{i}"].cast("double")
                                                  for i in range(len(settings.families))])).alias("fam_q"),
        F.sort_array(F.flatten(F.map_values(F.transform_values("h", lambda _, v: v["days"])))).alias("days")))


def cutoff_frame(spark: SparkSession, cutoffs: list[str]) -> DataFrame:
    return spark.createDataFrame([(c, cal.qend(c)) for c in cutoffs], "cutoff string, cutoff_end date")


def _median_of_sorted(a: Column) -> Column:
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2.0)


def snapshots(history: DataFrame, cutoffs: list[str], settings: ChannelSettings, token_share: float = TOKEN_SHARE,
              label: bool = True) -> DataFrame:
    """Raw features (before the group-median and winsorising steps) with labels, one row per (partner_id, cutoff)."""
    cuts = F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.lit(cal.qidx(c) - settings.first_q).alias("ci"),
                                        F.lit(cal.qend(c)).alias("end")) for c in cutoffs]))
    rows = history.withColumn("_c", cuts).select(
        "*", F.col("_c.cutoff").alias("cutoff"), F.col("_c.ci").alias("ci"), F.col("_c.end").alias("end"))
    rows = rows.where(F.col("onboarded_date") <= F.col("end"))

    ci = F.col("ci")
    q = lambda arr, k: F.get(F.col(arr), ci - k)                          # noqa: E731  quarter k before the cutoff
    m = lambda arr, k: F.get(F.col(arr), ci * 3 + 2 - k)                  # noqa: E731  month k before its last month
    lag_cols = {f"r{k}": q("rev_q", k) for k in range(10)}
    lag_cols |= {f"n{k}": q("lines_q", k) for k in range(6)}
    lag_cols |= {f"t{k}": q("tgt_q", k) for k in range(10)}
    lag_cols |= {f"g{k}": q("mgn_q", k) for k in range(4)}
    lag_cols |= {f"mr{k}": m("rev_m", k) for k in range(6)}
    lag_cols |= {f"ml{k}": m("lines_m", k) for k in range(6)}
    lag_cols |= {f"p{k}": q("fam_q", k) for k in range(4)}
    lag_cols |= {"r_next": q("rev_q", -1), "n_next": q("lines_q", -1), "r_next2": q("rev_q", -2),
                 "n_next2": q("lines_q", -2)}
    past = F.filter("days", lambda x: x <= F.col("end"))
    lag_cols |= {"past": F.coalesce(past, F.array().cast("array<date>"))}
    keep = ["partner_id", "cutoff", "ci", "end", "partner_name", "country", "onboarded_date", *CATEGORICAL]
    rows = rows.select(*keep, *[c.alias(n) for n, c in lag_cols.items()])

    m6 = F.add_months(F.trunc("end", "MM"), -5)
    year_days = F.filter("past", lambda x: x > F.date_sub("end", 365))
    # Means that many expressions below read are columns, since an inlined mean is worked out at every mention. They stand beside, and the
    # features hold, a higher-order function: such a projection is compiled as many small methods; one of this width compiled with its
    # stage is a single method, too long for the JVM to turn into machine code.
    rows = rows.withColumns({
        "_last": F.array_max("past"),
        "_year": year_days,
        "_mean_4q": nm.mean_skip_null([F.col(f"r{k}") for k in range(4)]),
        "_mean_6m": nm.mean_skip_null([F.col(f"mr{k}") for k in range(6)]),
    }).withColumn("_gaps", F.when(F.size("_year") > 1, F.sort_array(F.transform(
        F.sequence(F.lit(1), F.size("_year") - 1), lambda i: F.datediff(F.get(F.col("_year"), i), F.get(F.col("_year"), i - 1))))))

    c = F.col
    r, n, t, g = ([c(f"{x}{k}") for k in range(10)] if x in "rt" else [c(f"{x}{k}") for k in range(6 if x == "n" else 4)]
                  for x in ("r", "n", "t", "g"))
    mr, ml = [c(f"mr{k}") for k in range(6)], [c(f"ml{k}") for k in range(6)]
    att = [nm.ratio(r[k], t[k]) for k in range(10)]
    ma2 = [(r[k] + r[k + 1]) / 2 for k in range(9)]
    yoy = [nm.sym_growth(r[k], r[k + 4]) for k in range(6)]
    down = [F.coalesce(y < DOWN_QUARTER, F.lit(False)) for y in yoy]
    total = lambda cols: reduce(lambda a, b: a + b, cols)                  # noqa: E731
    zero_sum = lambda cols: total([F.coalesce(x, F.lit(0.0)) for x in cols])
    flags = lambda conds: total([F.coalesce(x, F.lit(False)).cast("int") for x in conds])
    value3 = nm.ratio_pos(zero_sum(mr[:3]), zero_sum(ml[:3]))
    value6 = nm.ratio_pos(zero_sum(mr[3:]), zero_sum(ml[3:]))
    margin = lambda ks: nm.ratio_pos(nm.sum_min1([g[k] for k in ks]), nm.sum_min1([r[k] for k in ks])) * 100
    fam = lambda k, i: F.get(c(f"p{k}"), F.lit(i))                         # noqa: E731
    n_fam = len(settings.families)
    sold = lambda a, b: total([(fam(a, i).isNotNull() | fam(b, i).isNotNull()).cast("int") for i in range(n_fam)])
    mix = [F.coalesce(fam(0, i), F.lit(0.0)) + F.coalesce(fam(1, i), F.lit(0.0)) for i in range(n_fam)]
    mix_total = total(mix)
    shares = [nm.ratio_pos(x, mix_total) for x in mix]
    ten = tenure(c("end"), c("onboarded_date"))
    days_since = F.datediff("end", "_last")
    gap = _median_of_sorted(c("_gaps"))

    f: dict[str, Column] = {
        "rev_q1_log": F.log1p(r[0]),
        "rev_avg_2q_log": F.log1p(nm.mean_skip_null(r[:2])),
        "rev_avg_4q_log": F.log1p(c("_mean_4q")),
        "rev_growth_qoq": nm.sym_growth(r[0], r[1]),
        "rev_growth_2q": nm.sym_growth(r[0] + r[1], r[2] + r[3]),
        "rev_q1_vs_prev4q": nm.capped_ratio(r[0], nm.mean_skip_null(r[1:5]), RATIO_CAP),
        "rev_cv_4q": nm.row_cv(r[:4], 2, c("_mean_4q")),
        "rev_cv_6m": nm.row_cv(mr, 3, c("_mean_6m")),
        "rev_slope_4q": nm.row_norm_slope(r[3::-1]),
        "rev_slope_6m": nm.row_norm_slope(mr[::-1]),
        "rev_drawdown": nm.ratio_pos(ma2[0], F.greatest(*ma2)),
        "order_days_6m": F.size(F.filter("past", lambda x: x >= m6)).cast("double"),
        "lines_per_month_6m": nm.mean_skip_null(ml),
        "active_month_share_6m": flags([x > 0 for x in ml]) / F.nullif(nm.count_present(ml), F.lit(0)),
        "lines_last_month": ml[0],
        "lines_3m_vs_prev3m": nm.sym_growth(nm.sum_min1(ml[:3]), nm.sum_min1(ml[3:])),
        "lines_q1_vs_prev4q": nm.capped_ratio(n[0], nm.mean_skip_null(n[1:5]), RATIO_CAP),
        "days_since_last_order": days_since.cast("double"),
        "typical_gap_days": gap,
        "recency_vs_gap": nm.clip_upper(days_since / F.when(gap.isNotNull(), F.greatest(gap, F.lit(1.0))), RECENCY_CAP),
        "avg_line_value_6m_log": F.log1p(nm.ratio_pos(zero_sum(mr), zero_sum(ml))),
        "line_value_3m_vs_prev3m": nm.sym_growth(value3, value6),
        "never_ordered": c("_last").isNull().cast("double"),
        "att_q1": nm.clip_upper(att[0], RATIO_CAP),
        "att_avg_2q": nm.capped_ratio(nm.sum_min1(r[:2]), nm.sum_min1(t[:2]), RATIO_CAP),
        "att_avg_4q": nm.capped_ratio(nm.sum_min1(r[:4]), nm.sum_min1(t[:4]), RATIO_CAP),
        "att_trend_4q": nm.row_slope([nm.clip_upper(a, RATIO_CAP) for a in att[3::-1]]),
        "att_miss_streak": nm.trailing_streak([a < 1 for a in att]).cast("double"),
        "att_misses_4q": flags([a < 1 for a in att[:4]]).cast("double"),
        "target_yoy": nm.sym_growth(t[0], t[4]),
        "margin_pct_4q": margin(range(4)),
        "margin_pct_2q": margin(range(2)),
        "margin_trend": margin(range(2)) - margin((2, 3)),
        "margin_usd_4q_log": F.log1p(F.greatest(zero_sum(g[:4]), F.lit(0.0))),
        "n_products_q1": F.when(r[0].isNotNull(), total([fam(0, i).isNotNull().cast("int") for i in range(n_fam)])).cast("double"),
        "n_products_2q": sold(0, 1).cast("double"),
        "n_products_change": (sold(0, 1) - sold(2, 3)).cast("double"),
        **{share_name(x): s for x, s in zip(settings.families, shares)},
        "product_hhi_2q": total([s * s for s in shares]),
        "yoy_q1": yoy[0],
        "yoy_2q": nm.sym_growth(r[0] + r[1], r[4] + r[5]),
        "lines_yoy_2q": nm.sym_growth(n[0] + n[1], n[4] + n[5]),
        "yoy_down_quarters_4q": flags(down[:4]).cast("double"),
        "yoy_decline_streak": nm.trailing_streak(down).cast("double"),
        "tier_rank": F.element_at(F.create_map(*[x for i, v in enumerate(settings.tiers) for x in
                                                 (F.lit(v), F.lit(float(len(settings.tiers) - 1 - i)))]), c("tier")),
        "tenure_months": ten,
        "is_ramping": (ten < RAMPING_MONTHS).cast("double"),
        "quarters_observed": nm.count_present(r).cast("double"),
    }
    out = ["partner_id", "cutoff", "partner_name", "country", *CATEGORICAL, *[x.alias(k) for k, x in f.items()]]
    if label:
        out += label_columns(settings, token_share)
    return rows.select(*out)


def label_columns(settings: ChannelSettings, token_share: float = TOKEN_SHARE) -> list[Column]:
    """Next-quarter churn labels from the lag columns; a missing quarter compares false."""
    c = F.col
    known = c("ci") + 1 <= settings.last_q - settings.first_q
    known2 = c("ci") + 2 <= settings.last_q - settings.first_q
    baseline = c("_mean_4q")
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    token = lambda rev, n: yes(n == 0) | yes(rev < token_share * baseline)
    return [baseline.alias("baseline_4q_revenue"), F.when(known, c("r_next")).alias("next_q_revenue"),
            F.when(known, yes(c("n_next") == 0).cast("int")).alias("left_zero"),
            F.when(known, token(c("r_next"), c("n_next")).cast("int")).alias("left_token"),
            F.when(known2, (token(c("r_next"), c("n_next")) & token(c("r_next2"), c("n_next2"))).cast("int"))
            .alias("left_persistent")]


def require_next_quarter(cutoffs: list[str], settings: ChannelSettings) -> None:
    for c in cutoffs:
        if cal.qidx(c) + 1 > settings.last_q:
            raise ValueError(f"No data after {c}: it cannot be labelled")


def center_and_winsorize(raw: DataFrame, settings: ChannelSettings) -> DataFrame:
    """Add the two features measured against a group median, then clip the heavy tails inside each snapshot."""
    kinds = F.explode(F.array(
        F.struct(F.concat(F.lit("tier:"), F.col("tier")).alias("grp"), F.col("margin_pct_4q").alias("v")),
        F.struct(F.concat(F.lit("region:"), F.col("region")).alias("grp"), F.col("yoy_2q").alias("v"))))
    med = exact_quantiles(raw.select("cutoff", kinds.alias("k")).select("cutoff", "k.grp", "k.v"),
                          ["cutoff", "grp"], "v", {"med": 0.5}, few_groups=True)
    # one row per snapshot: as long as the list of snapshots, so it may be broadcast
    meds = F.broadcast(med.groupBy("cutoff").agg(F.map_from_entries(F.collect_list(F.struct("grp", "med"))).alias("_med")))
    x = raw.join(meds, "cutoff", "left").withColumns({
        "margin_vs_tier": F.col("margin_pct_4q") - F.col("_med")[F.concat(F.lit("tier:"), F.col("tier"))],
        "yoy_2q_vs_region": F.col("yoy_2q") - F.col("_med")[F.concat(F.lit("region:"), F.col("region"))],
    }).drop("_med")
    return winsorize(x, WINSORIZED, ["cutoff"])


def winsorize(x: DataFrame, columns: list[str], by: list[str], q: tuple[float, float] = WINSOR) -> DataFrame:
    """Clip the columns at their q quantiles inside each `by` group; `by` is a short list such as the snapshots."""
    long = x.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("v")) for n in columns])).alias("k"))
    lim = exact_quantiles(long.select(*by, "k.f", "k.v"), [*by, "f"], "v", {"lo": q[0], "hi": q[1]}, few_groups=True)
    edge = lambda n: F.struct(*[F.max(F.when(F.col("f") == n, F.col(side))).alias(side) for side in ("lo", "hi")])
    wide = F.broadcast(lim.groupBy(*by).agg(F.array(*[edge(n) for n in columns]).alias("_lim")))
    y = x.join(wide, by, "left")
    clipped = F.zip_with(F.array(*[F.col(n) for n in columns]), "_lim", lambda v, e: nm.clip(v, e["lo"], e["hi"]))
    return y.select(*[F.get(clipped, F.lit(columns.index(n))).alias(n) if n in columns else F.col(n) for n in x.columns])


LABELS = ["baseline_4q_revenue", "next_q_revenue", "left_zero", "left_token", "left_persistent"]


def build_panel(history: DataFrame, cutoffs: list[str], settings: ChannelSettings, label: bool = True,
                cut: bool = True) -> DataFrame:
    """(partner_id, cutoff) x features, with labels where asked. The raw snapshot feeds four passes (medians, limits,
    result), so it is written to the shared folder first."""
    if label:
        require_next_quarter(cutoffs, settings)
    raw = snapshots(history, cutoffs, settings, label=label)
    if cut:
        raw = cut_lineage(raw)
    done = center_and_winsorize(raw, settings)
    return done.select("partner_id", "cutoff", *feature_names(settings), *(LABELS if label else []))
