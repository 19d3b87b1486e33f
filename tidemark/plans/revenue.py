"""Revenue forecasts for many series at once. Every (area, target quarter) is a row with its own history, so a
backtest is the same job as a forecast and adds no loop."""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import calendar as cal
from ..functions.numeric import ratio
from ..session import cut_lineage
from ..settings import COVERAGE, ChannelSettings

CORE = ["seasonal_ratio", "yoy_growth", "regression"]
NEW = ["arima", "sarimax", "target_attainment"]
METHODS = CORE + NEW
ENSEMBLES = {"core3": CORE, "all6": METHODS}
INFO_ONLY = {"all6 without arima (info only)": [m for m in METHODS if m != "arima"]}
SQL_METHODS = ["seasonal_ratio", "yoy_growth", "target_attainment"]


def t_quantile(p: float, df: int) -> float:
    """Student t quantile by bisection on the integrated density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def cdf(t: float) -> float:
        x = np.linspace(0.0, t, 20001)
        y = c * (1 + x * x / df) ** (-(df + 1) / 2)
        h = x[1] - x[0]
        return 0.5 + h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())

    lo, hi = 0.0, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def series(lines: DataFrame, pq: DataFrame, area: str = "region") -> tuple[DataFrame, DataFrame]:
    """(area, q, revenue, target) per quarter and (area, m, revenue) per month."""
    q = lines.groupBy(F.col(area).alias("area"), cal.quarter_index(F.col("order_date")).alias("q")).agg(F.sum("revenue_usd").cast("double").alias("revenue"))
    t = pq.groupBy(F.col(area).alias("area"), cal.index_of_label(F.col("quarter")).alias("q")).agg(F.sum("target_usd").cast("double").alias("target"))
    m = lines.groupBy(F.col(area).alias("area"), cal.month_index(F.col("order_date")).alias("m")).agg(F.sum("revenue_usd").cast("double").alias("revenue"))
    # two short tables (series x periods) that every forecast step reads again: written once
    return cut_lineage(q.join(t, ["area", "q"], "full")), cut_lineage(m)


def histories(quarterly: DataFrame, targets: list[str]) -> DataFrame:
    """(area, target, T, rev, tgt): one row per series and target quarter; maps hold only quarters before the target."""
    ts = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(cal.qidx(t)).alias("T")) for t in targets]))
    maps = quarterly.groupBy("area").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("revenue").isNotNull(), F.struct("q", "revenue")))).alias("rev"),
        F.map_from_entries(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("q", F.col("target").alias("t"))))).alias("tgt"))
    x = maps.select("area", "rev", "tgt", ts.alias("t")).select("area", "t.target", "t.T", "rev", "tgt")
    past = lambda c: F.map_filter(c, lambda k, _: k < F.col("T"))
    return x.withColumns({"rev": past("rev"), "tgt": past("tgt")})


def _at(c: str, k: int) -> Column:
    return F.try_element_at(F.col(c), F.col("T") - k)


def _mean(xs: list[Column]) -> Column:
    n = reduce(lambda a, b: a + b, [x.isNotNull().cast("int") for x in xs])
    return reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in xs]) / F.nullif(n, F.lit(0))


def seasonal_ratio() -> Column:
    """Last quarter times the mean past step into the target's quarter of the year (up to three years)."""
    return _at("rev", 1) * _mean([ratio(_at("rev", 4 * k), _at("rev", 4 * k + 1)) for k in (1, 2, 3)])


def yoy_growth() -> Column:
    """The same quarter a year ago times recent growth over two quarters, or one where two are not known."""
    two = ratio(_at("rev", 1) + _at("rev", 2), _at("rev", 5) + _at("rev", 6))
    return _at("rev", 4) * F.coalesce(two, ratio(_at("rev", 1), _at("rev", 5)))


def projected_target() -> Column:
    return ratio(_at("tgt", 4) * _at("tgt", 1), _at("tgt", 5))


def target_attainment() -> Column:
    return projected_target() * _mean([ratio(_at("rev", k), _at("tgt", k)) for k in (4, 8)])


# ---------------------------------------------------------------- monthly models (one small fit per series and target)

def _ols(y: np.ndarray, m: np.ndarray, future: np.ndarray) -> float:
    if len(y) < 12:
        return math.nan
    origin = m[0]

    def design(ms):
        month = ms % 12
        qoy, miq = month // 3 + 1, month % 3 + 1
        return np.column_stack([np.ones(len(ms)), ms - origin, qoy == 2, qoy == 3, qoy == 4, miq == 2, miq == 3]).astype(float)

    X = design(m)
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    var = ((y - X @ beta) ** 2).sum() / max(len(y) - X.shape[1], 1)
    return float(np.exp(design(future) @ beta + var / 2).sum())


def _airline(y: np.ndarray, steps: int = 3) -> float:
    """(1-B)(1-B^3) y = (1 + a B)(1 + b B^3) e by least conditional squares on a refined grid."""
    if len(y) < 15:
        return math.nan
    w = (y[1:] - y[:-1])
    w = w[3:] - w[:-3]

    def errors(a, b):
        e = np.zeros(len(w) + 4)
        for t in range(len(w)):
            e[t + 4] = w[t] - a * e[t + 3] - b * e[t + 1] - a * b * e[t]
        return e

    best, span, centre = None, 0.9, (0.0, 0.0)
    for _ in range(4):
        for a in np.linspace(max(centre[0] - span, -0.98), min(centre[0] + span, 0.98), 11):
            for b in np.linspace(max(centre[1] - span, -0.98), min(centre[1] + span, 0.98), 11):
                s = (errors(a, b) ** 2).sum()
                if best is None or s < best[0]:
                    best = (s, a, b)
        centre, span = best[1:], span / 4
    s, a, b = best
    e, path, var = list(errors(a, b)), list(y), s / len(w)
    out, psi = 0.0, [1.0]
    for h in range(steps):
        wh = sum(c * e[len(e) - 1 - lag + h] for lag, c in ((0, a), (2, b), (3, a * b)) if lag >= h and len(e) - 1 - lag + h < len(e))
        nxt = path[-1] + path[-3] - path[-4] + wh
        path.append(nxt)
    pw = [1.0, a, 0.0, b, a * b]  # weights of the error in w, then summed twice
    psi = np.zeros(steps)
    for h in range(steps):
        psi[h] = (pw[h] if h < len(pw) else 0.0) + (psi[h - 1] if h >= 1 else 0.0) + (psi[h - 3] if h >= 3 else 0.0) - (psi[h - 4] if h >= 4 else 0.0)
    for h in range(steps):
        out += math.exp(path[len(y) + h] + var * (psi[:h + 1] ** 2).sum() / 2)
    return out


def _regression_with_errors(y: np.ndarray, X: np.ndarray, Xf: np.ndarray) -> float:
    """log revenue on month dummies and log target with AR(1), differenced MA(1) or differenced AR(1) errors; the form
    with the smallest AIC wins."""
    n = len(y)
    if n < 15:
        return math.nan
    best = None

    def fit(kind):
        nonlocal best
        for r in np.linspace(-0.95, 0.95, 39):
            if kind == "ar":
                A, b = np.column_stack([np.ones(n), np.arange(n), X]), y
                t = lambda z: np.concatenate([z[:1] * math.sqrt(1 - r * r), z[1:] - r * z[:-1]])
            else:
                A, b = np.column_stack([np.ones(n - 1), np.diff(X, axis=0)]), np.diff(y)

                def t(z):
                    if kind == "dar":
                        return np.concatenate([z[:1] * math.sqrt(1 - r * r), z[1:] - r * z[:-1]])
                    out = np.array(z, dtype=float)
                    for i in range(1, len(out)):
                        out[i] = z[i] - r * out[i - 1]
                    return out
            At = np.apply_along_axis(t, 0, A)
            bt = t(b)
            beta = np.linalg.lstsq(At, bt, rcond=None)[0]
            e = bt - At @ beta
            s2 = (e ** 2).mean()
            if s2 <= 0:
                continue
            extra = math.log(1 - r * r) if kind in ("ar", "dar") else 0.0
            aic = len(bt) * (math.log(2 * math.pi * s2) + 1) - extra + 2 * (A.shape[1] + 2)
            if best is None or aic < best[0]:
                best = (aic, kind, r, beta, s2, e)

    for kind in ("ar", "dma", "dar"):
        fit(kind)
    _, kind, r, beta, s2, e = best
    out = 0.0
    if kind == "ar":
        last = y[-1] - np.concatenate([[1.0, n - 1], X[-1]]) @ beta
        for h in range(1, 4):
            mu = np.concatenate([[1.0, n - 1 + h], Xf[h - 1]]) @ beta + last * r ** h
            out += math.exp(mu + s2 * sum(r ** (2 * j) for j in range(h)) / 2)
        return out
    level, prev = y[-1], X[-1]
    dlast = (y[-1] - y[-2]) - np.concatenate([[1.0], X[-1] - X[-2]]) @ beta
    for h in range(1, 4):
        d = np.concatenate([[1.0], Xf[h - 1] - prev]) @ beta
        prev = Xf[h - 1]
        if kind == "dma":
            d += r * e[-1] if h == 1 else 0.0
            var = s2 * (1 + (h - 1) * (1 + r) ** 2)
        else:
            d += dlast * r ** h
            var = s2 * sum(sum(r ** i for i in range(h - j)) ** 2 for j in range(h))
        level += d
        out += math.exp(level + var / 2)
    return out


def fit_monthly(pdf: pd.DataFrame) -> pd.DataFrame:
    """One series and target: its months before the target, with the quarter's target value where known."""
    pdf = pdf.sort_values("m")
    m, rev = pdf["m"].to_numpy(), pdf["revenue"].to_numpy(dtype=float)
    T = int(pdf["T"].iloc[0])
    future = np.arange(T * 3, T * 3 + 3)
    rows = {"regression": math.nan, "arima": math.nan, "sarimax": math.nan}
    if len(rev) and (rev > 0).all():
        y = np.log(rev)
        rows["regression"] = _ols(y, m, future)
        rows["arima"] = _airline(y)
        goal, proj = pdf["target_value"].to_numpy(dtype=float), pdf["projected"].iloc[0]
        if proj is not None and not math.isnan(proj) and not np.isnan(goal).any():
            X = lambda ms, g: np.column_stack([ms % 3 == 1, ms % 3 == 2, np.log(g / 3)]).astype(float)
            rows["sarimax"] = _regression_with_errors(y, X(m, goal), X(future, np.repeat(proj, 3)))
    return pd.DataFrame({"area": pdf["area"].iloc[0], "target": pdf["target"].iloc[0], "method": list(rows), "forecast": list(rows.values())})


def monthly_models(hist: DataFrame, monthly: DataFrame) -> DataFrame:
    """(area, target, method, forecast). A group is one series up to one target: as long as its months."""
    x = hist.select("area", "target", "T", "tgt", projected_target().alias("projected")).join(monthly, "area").where(F.col("m") < F.col("T") * 3)
    x = x.select("area", "target", "T", "projected", "m", "revenue", F.try_element_at("tgt", F.floor(F.col("m") / 3).cast("int")).alias("target_value"))
    fc = x.groupBy("area", "target").applyInPandas(fit_monthly, "area string, target string, method string, forecast double")
    return fc.withColumn("forecast", F.when(~F.isnan("forecast"), F.col("forecast")))


# ---------------------------------------------------------------- all methods, ensembles, backtest

def forecast_all(quarterly: DataFrame, monthly: DataFrame | None, targets: list[str], n_areas: int, ensembles: dict | None = None,
                 total: str = "ALL") -> DataFrame:
    """(area, target, method, forecast) for methods, ensembles and ALL; ALL is missing where any area is."""
    ensembles = ensembles if ensembles is not None else {**ENSEMBLES, **INFO_ONLY}
    h = histories(quarterly, targets)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), e.alias("forecast")) for n, e in
                                (("seasonal_ratio", seasonal_ratio()), ("yoy_growth", yoy_growth()), ("target_attainment", target_attainment()))]))
    base = h.select("area", "target", cells.alias("c")).select("area", "target", "c.*")
    if monthly is not None:
        base = base.unionByName(monthly_models(h, monthly))
    parts = [base] + [base.where(F.col("method").isin(ms)).groupBy("area", "target").agg(F.avg("forecast").alias("forecast")).withColumn("method", F.lit(n))
                      for n, ms in ensembles.items()]
    out = reduce(DataFrame.unionByName, parts)
    every = out.groupBy("target", "method").agg(F.when(F.count("forecast") == n_areas, F.sum("forecast")).alias("forecast")).withColumn("area", F.lit(total))
    return out.unionByName(every)


def actuals(quarterly: DataFrame, total: str = "ALL") -> DataFrame:
    q = quarterly.where(F.col("revenue").isNotNull()).select("area", cal.label_of_index(F.col("q")).alias("target"), F.col("revenue").alias("actual"))
    return q.unionByName(q.groupBy("target").agg(F.sum("actual").alias("actual")).withColumn("area", F.lit(total)))


def backtest(forecasts: DataFrame, quarterly: DataFrame) -> DataFrame:
    x = forecasts.join(actuals(quarterly), ["area", "target"])
    return x.withColumnRenamed("target", "quarter").withColumns({
        "pct_error": ratio(F.col("forecast"), F.col("actual")) - 1,
        "log_error": F.when((F.col("forecast") > 0) & (F.col("actual") > 0), F.log(F.col("actual") / F.col("forecast")))})


def bias_and_scale(bt: DataFrame, by: list[str], n_areas: int, n_quarters: int) -> DataFrame:
    """Per `by` and area: the mean regional log error and the half-width of the interval. The error of a region is
    scaled by the larger of the pooled and its own spread; ALL by its own, at least half the pooled width."""
    t_reg = t_quantile(0.5 + COVERAGE / 2, n_areas * n_quarters - 1)
    t_all = t_quantile(0.5 + COVERAGE / 2, n_quarters - 1)
    reg = F.col("area") != "ALL"
    pool = bt.groupBy(*by).agg(F.avg(F.when(reg, F.col("log_error"))).alias("bias"), F.stddev_samp(F.when(reg, F.col("log_error"))).alias("_pool"))
    own = bt.groupBy(*by, "area").agg(F.stddev_samp("log_error").alias("_own"))
    x = own.join(pool, by)
    half = F.when(F.col("area") == "ALL", F.greatest(t_all * F.col("_own"), 0.5 * t_reg * F.col("_pool"))).otherwise(t_reg * F.greatest("_pool", "_own"))
    return x.select(*by, "area", "bias", half.alias("half_width"))


def leave_one_out(bt: DataFrame, n_areas: int) -> DataFrame:
    """Each quarter corrected with the bias and width of the others: errors before and after, and coverage."""
    bt = cut_lineage(bt)  # errors per series, method and quarter: small, and read several times below
    qs = bt.select(F.col("quarter").alias("held_out")).distinct()
    nq = bt.agg(F.countDistinct("quarter").alias("n")).first()["n"]  # the number of backtest quarters
    others = bt.join(F.broadcast(qs), F.col("quarter") != F.col("held_out"))
    scale = bias_and_scale(others, ["method", "held_out"], n_areas, nq - 1)
    x = bt.join(scale.withColumnRenamed("held_out", "quarter"), ["method", "quarter", "area"])
    corrected = F.when(F.col("area") != "ALL", F.col("forecast") * F.exp("bias"))
    x = x.withColumn("_c", corrected)
    x = x.withColumn("forecast_corrected", F.coalesce("_c", F.sum("_c").over(Window.partitionBy("method", "quarter"))))
    return x.select("method", "quarter", "area", "actual", "forecast_corrected", F.abs(ratio(F.col("forecast"), F.col("actual")) - 1).alias("ape_raw"),
                    F.abs(ratio(F.col("forecast_corrected"), F.col("actual")) - 1).alias("ape_bias_corrected"),
                    (F.abs(F.log(F.col("actual") / F.col("forecast_corrected"))) <= F.col("half_width")).alias("inside_80"))


def choose_ensemble(loo: DataFrame, small: str = "core3", large: str = "all6") -> DataFrame:
    """Mean corrected error per ensemble, and the rule: the large one only if it is no worse than the small one."""
    m = loo.where(F.col("method").isin(small, large)).groupBy("method", "area").agg(F.avg("ape_bias_corrected").alias("e")).groupBy("method").agg(F.avg("e").alias("mean_error"))
    g = lambda n: F.max(F.when(F.col("method") == n, F.col("mean_error")))
    rule = m.agg(F.when(g(large) <= g(small), large).otherwise(small).alias("chosen"))
    return m.crossJoin(F.broadcast(rule))


def mape(bt: DataFrame) -> DataFrame:
    return bt.groupBy("method", "area").agg(F.avg(F.abs("pct_error")).alias("mape"))


def version_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1.0) -> DataFrame:
    """Per method: shared rows, the largest absolute difference and whether it is within the tolerance."""
    x = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return x.groupBy("method").agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff")).withColumn(
        "passed", F.coalesce(F.col("max_abs_diff") <= tolerance, F.lit(False)))


# ---------------------------------------------------------------- excess churn

def loss_shares(df: DataFrame, p: str, e: str, by: list[str]) -> DataFrame:
    """Expected share of revenue lost: sum of p x E over sum of E."""
    v = F.coalesce(F.col(e), F.lit(0.0))
    return df.groupBy(*by).agg(ratio(F.sum(F.col(p) * v), F.sum(v)).alias("share"))


def churn_backtest(shares: DataFrame, loo: DataFrame) -> DataFrame:
    """Score the adjustment on the quarters after each snapshot; the normal share leaves the scored snapshot out."""
    w = Window.partitionBy("region")
    n = F.count(F.lit(1)).over(w)
    s = shares.withColumn("normal", (F.sum("share").over(w) - F.col("share")) / F.nullif(n - 1, F.lit(0)))
    s = s.select(F.col("region").alias("area"), cal.shift_quarter(F.col("cutoff"), 1).alias("quarter"), "share", "normal")
    x = loo.where("area <> 'ALL'").join(s, ["area", "quarter"]).withColumn("adjustment", -(F.col("share") - F.col("normal")) * F.col("forecast_corrected"))
    every = x.groupBy("quarter").agg(*[F.sum(c).alias(c) for c in ("adjustment", "forecast_corrected", "actual")]).withColumn("area", F.lit("ALL"))
    y = x.select("quarter", "area", "adjustment", "forecast_corrected", "actual").unionByName(every)
    return y.select("quarter", "area", "adjustment", F.abs(ratio(F.col("forecast_corrected"), F.col("actual")) - 1).alias("ape_without"),
                    F.abs(ratio(F.col("forecast_corrected") + F.col("adjustment"), F.col("actual")) - 1).alias("ape_with"))


def churn_rule(bt: DataFrame) -> DataFrame:
    """Apply the adjustment only if it does not raise the mean error."""
    return bt.agg(F.avg("ape_without").alias("error_without"), F.avg("ape_with").alias("error_with"),
                  F.coalesce(F.avg("ape_with") <= F.avg("ape_without") + 1e-12, F.lit(False)).alias("apply"))


def churn_live(scores: DataFrame, shares: DataFrame, base: DataFrame) -> DataFrame:
    """(region, share_now, share_normal, adjustment) for the target quarter."""
    now = loss_shares(scores, "p_leave_unseasonal", "revenue_avg_4q", ["region"]).withColumnRenamed("share", "share_now")
    normal = shares.groupBy("region").agg(F.avg("share").alias("share_normal"))
    money = scores.groupBy("region").agg(F.sum(F.when(F.col("at_risk") == 1, F.coalesce("revenue_avg_4q", F.lit(0.0))).otherwise(0.0)).alias("flagged_revenue_avg_4q"),
                                         F.sum(F.col("p_leave") * F.coalesce("revenue_avg_4q", F.lit(0.0))).alias("expected_loss_seasonal"))
    x = now.join(normal, "region").join(money, "region").join(base.withColumnRenamed("area", "region"), "region")
    return x.withColumn("adjustment", -(F.col("share_now") - F.col("share_normal")) * F.col("forecast"))


def final_forecast(forecasts: DataFrame, scale: DataFrame, chosen: str, target: str, adjustment: DataFrame | None = None) -> DataFrame:
    """Rounded forecast with bounds per area; ALL is the sum of the rounded areas."""
    f = forecasts.where((F.col("method") == chosen) & (F.col("target") == target) & (F.col("area") != "ALL"))
    s = scale.where(F.col("method") == chosen)
    x = f.join(s.select("area", "bias"), "area").withColumn("final", F.col("forecast") * F.exp("bias"))
    if adjustment is not None:
        x = x.join(adjustment.select(F.col("region").alias("area"), "adjustment"), "area", "left").withColumn("final", F.col("final") + F.coalesce("adjustment", F.lit(0.0)))
    x = x.select("area", "final")
    x = x.unionByName(x.agg(F.sum("final").alias("final"), F.sum(F.bround("final", 0)).alias("_r")).select(F.lit("ALL").alias("area"), "final"))
    y = x.join(s.select("area", "half_width"), "area")
    rounded = y.select("area", F.bround("final", 0).cast("long").alias("forecast_revenue_usd"), F.bround(F.col("final") * F.exp(-F.col("half_width")), 0).cast("long").alias("lo80_usd"),
                       F.bround(F.col("final") * F.exp("half_width"), 0).cast("long").alias("hi80_usd"))
    total = rounded.where("area <> 'ALL'").agg(F.sum("forecast_revenue_usd").alias("_sum"))
    return rounded.crossJoin(F.broadcast(total)).withColumn("forecast_revenue_usd", F.when(F.col("area") == "ALL", F.col("_sum")).otherwise(F.col("forecast_revenue_usd"))).drop("_sum")


def check_forecast(sub: DataFrame, areas: list[str]) -> DataFrame:
    """(rule, n violations): the interval holds the forecast, the areas are complete, ALL is the sum."""
    s = sub.agg(F.count_if((F.col("lo80_usd") > F.col("forecast_revenue_usd")) | (F.col("forecast_revenue_usd") > F.col("hi80_usd"))).alias("interval out of order"),
                (F.lit(len(areas) + 1) - F.countDistinct("area")).alias("areas missing"),
                (F.abs(F.sum(F.when(F.col("area") == "ALL", -F.col("forecast_revenue_usd")).otherwise(F.col("forecast_revenue_usd")))) >= 1).cast("long").alias("ALL is not the sum"))
    return s.select(F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n")) for c in s.columns])).alias("r")).select("r.*")


def interval_percent(scale: DataFrame, chosen: str) -> DataFrame:
    return scale.where(F.col("method") == chosen).select("area", (1 - F.exp(-F.col("half_width"))).alias("down"), (F.exp("half_width") - 1).alias("up"), (F.exp("bias") - 1).alias("bias_pct"))


def third_quarter_baselines(quarterly: DataFrame, settings: ChannelSettings) -> DataFrame:
    """Two naive anchors for the target quarter: the last step into it, and the last year times half-year growth."""
    T = settings.last_q + 1
    g = quarterly.groupBy("area").agg(*[F.max(F.when(F.col("q") == T - k, F.col("revenue"))).alias(f"r{k}") for k in (1, 2, 4, 5, 6, 8, 9)])
    c = F.col
    x = g.select("area", ratio(c("r8"), c("r9")).alias("step_two_years_ago"), ratio(c("r4"), c("r5")).alias("step_last_year"),
                 ratio(c("r1") + c("r2"), c("r5") + c("r6")).alias("half_year_growth"), (c("r1") * ratio(c("r4"), c("r5"))).alias("baseline_a"),
                 (c("r4") * ratio(c("r1") + c("r2"), c("r5") + c("r6"))).alias("baseline_b"))
    every = x.agg(F.sum("baseline_a").alias("baseline_a"), F.sum("baseline_b").alias("baseline_b")).withColumn("area", F.lit("ALL"))
    return x.unionByName(every, allowMissingColumns=True).withColumn("mean_baseline", (c("baseline_a") + c("baseline_b")) / 2)
