"""Forecast queries. The monthly models are rows only; everything else has a SQL twin on the SQL-expressible methods."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import revenue as rv
from ..sources.fixtures import SETTINGS
from .channel_core import stored as tables
from .prelude import cte, define
from .registry import query
from .snapshots import panel

N = len(SETTINGS.regions)
TARGETS = [*SETTINGS.backtest_quarters, SETTINGS.target_quarter]
ENS = {"core2": ["seasonal_ratio", "yoy_growth"], "all3": rv.SQL_METHODS}
T_REG, T_ALL = rv.t_quantile(0.9, N * 5 - 1), rv.t_quantile(0.9, 4)
T_REG4, T_ALL4 = rv.t_quantile(0.9, N * 4 - 1), rv.t_quantile(0.9, 3)

define("qs", "base pq", """
SELECT coalesce(a.area, b.area) AS area, coalesce(a.q, b.q) AS q, revenue, target FROM
 (SELECT region AS area, qi AS q, CAST(sum(revenue_usd) AS DOUBLE) AS revenue FROM base GROUP BY 1, 2) a
 FULL JOIN (SELECT region AS area, qi AS q, CAST(sum(target_usd) AS DOUBLE) AS target FROM pq GROUP BY 1, 2) b ON a.area = b.area AND a.q = b.q""")
_lag = lambda c, k: f"max(CASE WHEN q = tq - {k} THEN {c} END) AS {c[0]}{k}"
define("lg", "qs", "SELECT area, tq, CONCAT(tq // 4, '-Q', tq % 4 + 1) AS target, " + ", ".join(_lag("revenue", k) for k in range(1, 14)) + ", "
       + ", ".join(_lag("target", k) for k in (1, 4, 5, 8)) + " FROM qs CROSS JOIN (SELECT unnest(range(8001, 8007)) AS tq) GROUP BY 1, 2")
define("meth", "lg", """
SELECT area, target, 'seasonal_ratio' AS method, r1 * list_avg([r4 / r5, r8 / r9, r12 / r13]) AS forecast FROM lg
UNION ALL SELECT area, target, 'yoy_growth', r4 * coalesce((r1 + r2) / (r5 + r6), r1 / r5) FROM lg
UNION ALL SELECT area, target, 'target_attainment', t4 * t1 / t5 * list_avg([r4 / t4, r8 / t8]) FROM lg""")
define("ens", "meth", """
SELECT * FROM meth UNION ALL SELECT area, target, 'core2', avg(forecast) FROM meth WHERE method IN ('seasonal_ratio', 'yoy_growth') GROUP BY 1, 2
UNION ALL SELECT area, target, 'all3', avg(forecast) FROM meth GROUP BY 1, 2""")
define("fc", "ens", f"SELECT area, target, method, forecast FROM ens UNION ALL SELECT 'ALL', target, method, CASE WHEN count(forecast) = {N} THEN sum(forecast) END FROM ens GROUP BY 2, 3")
define("bt", "fc qs", """
SELECT f.area, f.target AS quarter, method, forecast, actual, forecast / actual - 1 AS pct_error, ln(actual / forecast) AS log_error
FROM fc f JOIN (SELECT area, CONCAT(q // 4, '-Q', q % 4 + 1) AS target, revenue AS actual FROM qs WHERE revenue IS NOT NULL
  UNION ALL SELECT 'ALL', CONCAT(q // 4, '-Q', q % 4 + 1), sum(revenue) FROM qs WHERE revenue IS NOT NULL GROUP BY 2) a ON f.area = a.area AND f.target = a.target""")
define("bs", "bt", f"""
SELECT o.method, o.area, bias, CASE WHEN o.area = 'ALL' THEN greatest({T_ALL} * own, 0.5 * {T_REG} * pool) ELSE {T_REG} * greatest(pool, own) END AS half_width
FROM (SELECT method, area, stddev_samp(log_error) AS own FROM bt GROUP BY 1, 2) o
JOIN (SELECT method, avg(log_error) AS bias, stddev_samp(log_error) AS pool FROM bt WHERE area <> 'ALL' GROUP BY 1) p ON o.method = p.method""")
define("loo", "bt", f"""
SELECT method, quarter, area, actual, fcorr AS forecast_corrected, abs(forecast / actual - 1) AS ape_raw, abs(fcorr / actual - 1) AS ape_bias_corrected, abs(ln(actual / fcorr)) <= half_width AS inside_80
FROM (SELECT *, CASE WHEN area = 'ALL' THEN sum(CASE WHEN area <> 'ALL' THEN forecast * exp(bias) END) OVER (PARTITION BY method, quarter) ELSE forecast * exp(bias) END AS fcorr FROM
 (SELECT b.*, p.bias, CASE WHEN b.area = 'ALL' THEN greatest({T_ALL4} * own, 0.5 * {T_REG4} * pool) ELSE {T_REG4} * greatest(pool, own) END AS half_width FROM bt b
  JOIN (SELECT h.quarter AS held, o.method, avg(o.log_error) AS bias, stddev_samp(o.log_error) AS pool FROM bt o JOIN (SELECT DISTINCT quarter FROM bt) h ON o.quarter <> h.quarter WHERE o.area <> 'ALL' GROUP BY 1, 2) p
    ON p.held = b.quarter AND p.method = b.method
  JOIN (SELECT h.quarter AS held, o.method, o.area, stddev_samp(o.log_error) AS own FROM bt o JOIN (SELECT DISTINCT quarter FROM bt) h ON o.quarter <> h.quarter GROUP BY 1, 2, 3) w
    ON w.held = b.quarter AND w.method = b.method AND w.area = b.area))""")


def inputs(spark, sf):
    t = tables(spark, sf)
    return rv.series(t.base, t.partner_quarter)


def sql_forecasts(spark, sf):
    q, _ = inputs(spark, sf)
    return q, rv.forecast_all(q, None, TARGETS, N, ENS)


@query("series_by_quarter", "AG-06", cte("qs") + "SELECT * FROM qs", dbl="revenue target", big="q")
def series_by_quarter(spark, sf):
    return inputs(spark, sf)[0]


@query("forecast_methods", "FC-01 FC-02 FC-06 FC-07", cte("fc") + "SELECT * FROM fc", dbl="forecast", digits=3)
def forecast_methods(spark, sf):
    return sql_forecasts(spark, sf)[1]


@query("forecast_backtest", "FC-08 SE-01", cte("bt") + "SELECT * FROM bt", dbl="forecast actual pct_error log_error", digits=4)
def forecast_backtest(spark, sf):
    q, f = sql_forecasts(spark, sf)
    return rv.backtest(f, q)


def _bt(spark, sf):
    q, f = sql_forecasts(spark, sf)
    return rv.backtest(f, q)


@query("forecast_bias_and_width", "FC-09", cte("bs") + "SELECT * FROM bs", dbl="bias half_width")
def forecast_bias_and_width(spark, sf):
    return rv.bias_and_scale(_bt(spark, sf), ["method"], N, 5)


@query("forecast_leave_one_out", "FC-10", cte("loo") + "SELECT * FROM loo", dbl="actual forecast_corrected ape_raw ape_bias_corrected", digits=4)
def forecast_leave_one_out(spark, sf):
    return rv.leave_one_out(_bt(spark, sf), N)


@query("ensemble_choice", "FC-11", cte("loo") + """,
m AS (SELECT method, avg(e) AS mean_error FROM (SELECT method, area, avg(ape_bias_corrected) AS e FROM loo WHERE method IN ('core2', 'all3') GROUP BY 1, 2) GROUP BY 1)
SELECT method, mean_error, CASE WHEN (SELECT mean_error FROM m WHERE method = 'all3') <= (SELECT mean_error FROM m WHERE method = 'core2') THEN 'all3' ELSE 'core2' END AS chosen FROM m""", dbl="mean_error")
def ensemble_choice(spark, sf):
    return rv.choose_ensemble(rv.leave_one_out(_bt(spark, sf), N), "core2", "all3")


@query("forecast_mape", "FC-14 DB-08", cte("bt") + "SELECT method, area, avg(abs(pct_error)) AS mape FROM bt GROUP BY 1, 2", dbl="mape")
def forecast_mape(spark, sf):
    return rv.mape(_bt(spark, sf))


@query("third_quarter_baselines", "FC-14", cte("lg") + """,
x AS (SELECT area, r8 / r9 AS step_two_years_ago, r4 / r5 AS step_last_year, (r1 + r2) / (r5 + r6) AS half_year_growth, r1 * r4 / r5 AS baseline_a, r4 * (r1 + r2) / (r5 + r6) AS baseline_b FROM lg WHERE tq = 8006)
SELECT *, (baseline_a + baseline_b) / 2 AS mean_baseline FROM x UNION ALL SELECT 'ALL', NULL, NULL, NULL, sum(baseline_a), sum(baseline_b), (sum(baseline_a) + sum(baseline_b)) / 2 FROM x""",
       dbl="step_two_years_ago step_last_year half_year_growth baseline_a baseline_b mean_baseline", digits=4)
def third_quarter_baselines(spark, sf):
    return rv.third_quarter_baselines(inputs(spark, sf)[0], SETTINGS)


@query("version_difference", "JN-15", cte("fc") + """
SELECT a.method, count(*) AS rows, max(abs(a.forecast - b.forecast)) AS max_abs_diff, max(abs(a.forecast - b.forecast)) <= 1 AS passed
FROM fc a JOIN fc b ON a.area = b.area AND a.target = b.target AND a.method = b.method GROUP BY 1""", dbl="max_abs_diff")
def version_difference(spark, sf):
    """Forecasts made together against forecasts made one target at a time: they must agree."""
    q, f = sql_forecasts(spark, sf)
    alone = None
    for t in TARGETS:
        g = rv.forecast_all(q, None, [t], N, ENS)
        alone = g if alone is None else alone.unionByName(g)
    return rv.version_difference(f, alone, ["area", "target", "method"], "forecast").withColumn("max_abs_diff", F.round("max_abs_diff", 3))


define("sh", "hist", """
SELECT cutoff, region, sum(p * coalesce(baseline_4q_revenue, 0)) / nullif(sum(coalesce(baseline_4q_revenue, 0)), 0) AS share
FROM (SELECT *, (1 + coalesce(days_since_last_order, 900)) / (1000 * (1 + coalesce(lines_per_month_6m, 0))) AS p FROM hist) GROUP BY 1, 2""")
define("cb", "sh loo", """
SELECT quarter, area, adjustment, abs(f / actual - 1) AS ape_without, abs((f + adjustment) / actual - 1) AS ape_with FROM (
 SELECT l.quarter, l.area, forecast_corrected AS f, actual, -(share - normal) * forecast_corrected AS adjustment FROM loo l
 JOIN (SELECT *, (sum(share) OVER (PARTITION BY region) - share) / (count(*) OVER (PARTITION BY region) - 1) AS normal, CAST(substr(cutoff, 1, 4) AS INT) * 4 + CAST(substr(cutoff, 7, 1) AS INT) AS nq FROM sh) s
   ON s.region = l.area AND l.quarter = CONCAT(nq // 4, '-Q', nq % 4 + 1) WHERE l.method = 'core2')
UNION ALL SELECT quarter, 'ALL', sum(adjustment), abs(sum(f) / sum(actual) - 1), abs((sum(f) + sum(adjustment)) / sum(actual) - 1) FROM (
 SELECT l.quarter, forecast_corrected AS f, actual, -(share - normal) * forecast_corrected AS adjustment FROM loo l
 JOIN (SELECT *, (sum(share) OVER (PARTITION BY region) - share) / (count(*) OVER (PARTITION BY region) - 1) AS normal, CAST(substr(cutoff, 1, 4) AS INT) * 4 + CAST(substr(cutoff, 7, 1) AS INT) AS nq FROM sh) s
   ON s.region = l.area AND l.quarter = CONCAT(nq // 4, '-Q', nq % 4 + 1) WHERE l.method = 'core2') GROUP BY 1""")


def shares(spark, sf):
    from ..plans.scoring import rule_probability
    return rv.loss_shares(panel(spark, sf).withColumn("p", rule_probability()), "p", "baseline_4q_revenue", ["cutoff", "region"])


@query("loss_shares", "AG-20", cte("sh") + "SELECT * FROM sh", dbl="share")
def loss_shares(spark, sf):
    return shares(spark, sf)


@query("churn_adjustment_backtest", "FC-13", cte("cb") + "SELECT * FROM cb", dbl="adjustment ape_without ape_with", digits=4)
def churn_adjustment_backtest(spark, sf):
    return rv.churn_backtest(shares(spark, sf), rv.leave_one_out(_bt(spark, sf), N).where("method = 'core2'"))


@query("churn_adjustment_rule", "FC-13", cte("cb") + """
SELECT avg(ape_without) AS error_without, avg(ape_with) AS error_with, avg(ape_with) <= avg(ape_without) + 1e-12 AS apply FROM cb""", dbl="error_without error_with")
def churn_adjustment_rule(spark, sf):
    return rv.churn_rule(rv.churn_backtest(shares(spark, sf), rv.leave_one_out(_bt(spark, sf), N).where("method = 'core2'")))


@query("forecast_monthly_models", "FC-03 FC-04 FC-05 UD-05")
def forecast_monthly_models(spark, sf):
    q, m = inputs(spark, sf)
    return rv.monthly_models(rv.histories(q, TARGETS), m)


@query("forecast_final", "FC-12 FC-07 DB-08")
def forecast_final(spark, sf):
    from ..session import cut_lineage
    q, m = inputs(spark, sf)
    f = cut_lineage(rv.forecast_all(q, m, TARGETS, N))
    bt = rv.backtest(f, q)
    chosen = rv.choose_ensemble(rv.leave_one_out(bt, N)).first()["chosen"]
    return rv.final_forecast(f, rv.bias_and_scale(bt, ["method"], N, 5), chosen, SETTINGS.target_quarter)


@query("forecast_checks", "SRC-10 DB-08")
def forecast_checks(spark, sf):
    q, f = sql_forecasts(spark, sf)
    sub = rv.final_forecast(f, rv.bias_and_scale(rv.backtest(f, q), ["method"], N, 5), "all3", SETTINGS.target_quarter)
    return rv.check_forecast(sub, list(SETTINGS.regions))
