"""Leave-risk queries: models (rows only) and the statistics around them (checked in SQL)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import stats
from ..plans import risk
from ..session import fingerprint
from ..sources.fixtures import SETTINGS
from . import feature_sql as fs
from .channel_core import stored as tables
from .prelude import cte
from .registry import query
from .snapshots import history, panel, score_snapshot

NUM = ft.numeric_features(SETTINGS)
FEATURES = NUM + ft.CATEGORICAL
CUTS = SETTINGS.eval_cutoffs
_RESULTS: dict = {}


def result(spark, sf) -> risk.RiskResult:
    """Trained once per session and directory, shared by the queries that only report on it."""
    key = (spark.sparkContext.applicationId, sf, fingerprint(spark, sf))
    if key not in _RESULTS:
        _RESULTS[key] = risk.compute(panel(spark, sf), score_snapshot(spark, sf), tables(spark, sf).master, SETTINGS)
    return _RESULTS[key]


@query("risk_backtest_metrics", "ML-01 ML-02 ML-03 ML-04")
def risk_backtest_metrics(spark, sf):
    return result(spark, sf).metrics


@query("risk_flag_sizes", "ML-05 SO-07")
def risk_flag_sizes(spark, sf):
    return result(spark, sf).flag_summary


@query("risk_scores", "ML-08 ML-09 JN-12 WN-11 PRJ-06 PRJ-19")
def risk_scores(spark, sf):
    return result(spark, sf).scores


@query("risk_submission_checks", "SRC-10 SRC-07")
def risk_submission_checks(spark, sf):
    return risk.check_submission(risk.submission(result(spark, sf).scores), tables(spark, sf).master)


@query("risk_variants", "ML-13 ML-15")
def risk_variants(spark, sf):
    return risk.compare_variants(panel(spark, sf), SETTINGS, CUTS)[0]


@query("risk_variant_bootstrap", "DE-20")
def risk_variant_bootstrap(spark, sf):
    x = result(spark, sf).oof.select("cutoff", F.col("partner_id").alias("row_id"), "y", F.round("raw", 12).alias("a"))
    heur = panel(spark, sf).select("cutoff", F.col("partner_id").alias("row_id"), (-F.coalesce("lines_per_month_6m", F.lit(0.0))).alias("b"))
    return stats.auc_bootstrap(x.join(heur, ["cutoff", "row_id"]), ["cutoff"], "y", "a", "b", boot=1000)


@query("permutation_importance", "ML-11")
def permutation_importance(spark, sf):
    r = result(spark, sf)
    test = panel(spark, sf).where(F.col("cutoff") == CUTS[-1])
    return risk.permutation_importance(r.model, test, FEATURES)


@query("label_rates", "AG-07", cte("lagged", "raw0") + " UNION ALL ".join(
    f"""SELECT cutoff, {s} AS token_share, count(*) AS partners, avg(CAST(coalesce(n_next = 0, false) AS INT)) AS left_zero, avg(CAST({fs.TOK(s)} AS INT)) AS left_token,
  avg(CASE WHEN c + 2 <= 8005 THEN CAST({fs.TOK(s)} AND {fs.TOK(s, 'r_next2', 'n_next2')} AS INT) END) AS left_persistent FROM lagged WHERE c < 8005 GROUP BY 1""" for s in (0.05, 0.1, 0.2)),
       dbl="token_share left_zero left_token left_persistent")
def label_rates(spark, sf):
    h = history(spark, sf)
    return risk.label_rates({s: ft.snapshots(h, SETTINGS.train_cutoffs, SETTINGS, token_share=s).select("cutoff", *ft.LABELS) for s in (0.05, 0.1, 0.2)})


@query("seasonal_factor", "AG-08", cte("hist") + """,
r AS (SELECT cutoff, avg(left_token) AS rate, CAST(substr(cutoff, 7, 1) AS INT) % 4 + 1 AS q FROM hist GROUP BY 1)
SELECT avg(rate) FILTER (q = 3) / avg(rate) AS factor FROM r""", dbl="factor")
def seasonal_factor(spark, sf):
    return risk.seasonal_factor(panel(spark, sf), 3)


@query("feature_missingness", "AG-09", cte("now") + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, avg(CAST({f} IS NULL AS INT)) AS missing FROM now" for f in NUM) + ") WHERE missing > 0", dbl="missing")
def feature_missingness(spark, sf):
    return risk.missingness(score_snapshot(spark, sf), NUM)


_AUC = """SELECT '{f}' AS feature, {h} AS is_hold, (sum(ar) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(CAST(sum(y) AS DOUBLE) * sum(1 - y), 0) AS auc
FROM (SELECT left_token AS y, rank() OVER (ORDER BY round({f}, 9)) + (count(*) OVER (PARTITION BY round({f}, 9)) - 1) / 2.0 AS ar FROM hist WHERE {f} IS NOT NULL AND (cutoff = '2001-Q1') = {h})"""


@query("univariate_auc", "ML-10 ML-06", cte("hist") + ", a AS (" + " UNION ALL ".join(_AUC.format(f=f, h=h) for f in NUM for h in ("true", "false")) + "), c AS ("
       + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(CAST({f} IS NOT NULL AS INT)) AS coverage FROM hist" for f in NUM) + """)
SELECT c.feature, coverage, max(auc) FILTER (NOT is_hold) AS auc_history, max(auc) FILTER (is_hold) AS auc_holdout, abs(max(auc) FILTER (is_hold) - 0.5) AS strength,
  CASE WHEN max(auc) FILTER (is_hold) > 0.5 THEN 'higher' ELSE 'lower' END AS risk_when FROM c LEFT JOIN a ON c.feature = a.feature GROUP BY 1, 2""",
       dbl="coverage auc_history auc_holdout strength")
def univariate_auc(spark, sf):
    # equal values may differ in the last bit between snapshots, so ties are made on nine digits
    x = panel(spark, sf).select("cutoff", risk.LABEL, *[F.round(c, 9).alias(c) for c in NUM])
    return risk.univariate_auc(x, NUM, SETTINGS.train_cutoffs[-1])


SP = ["rev_q1_log", "rev_avg_4q_log", "lines_per_month_6m", "days_since_last_order", "typical_gap_days", "att_avg_4q", "yoy_2q", "margin_pct_4q", "tenure_months", "order_days_6m"]
_pairs = [(a, b) for i, a in enumerate(SP) for b in SP[i + 1:]]


@query("spearman_pairs", "AG-16", cte("now") + " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, corr(x, y) AS spearman, count(*) AS n FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM (SELECT round({a}, 9) AS x, round({b}, 9) AS y FROM now WHERE {a} IS NOT NULL AND {b} IS NOT NULL))""" for a, b in _pairs), dbl="spearman")
def spearman_pairs(spark, sf):
    return stats.spearman_pairs(score_snapshot(spark, sf).select("partner_id", *[F.round(c, 9).alias(c) for c in SP]), "partner_id", SP)


@query("decline_counts", "ML-12", cte("now") + """
SELECT k AS at_least, count(*) FILTER (yoy_decline_streak >= k) AS partners, count(*) FILTER (yoy_decline_streak >= k AND coalesce(rev_q1_log, 0) = 0) AS zero_revenue_now
FROM now CROSS JOIN (SELECT unnest([2, 3, 4, 5]) AS k) GROUP BY 1""", big="at_least")
def decline_counts(spark, sf):
    return risk.decline_counts(score_snapshot(spark, sf))


@query("decline_profile", "ML-12", cte("now") + "SELECT tier, region, count(*) AS partners FROM now WHERE yoy_decline_streak >= 4 GROUP BY 1, 2")
def decline_profile(spark, sf):
    return risk.decline_profile(score_snapshot(spark, sf))


@query("decline_trajectory", "ML-12", cte("now", "pq") + """,
m AS (SELECT CASE WHEN yoy_decline_streak >= 2 THEN 'declining' ELSE 'others' END AS cohort, pq.quarter, median(CAST(revenue_usd AS DOUBLE)) AS median_revenue
  FROM pq JOIN now USING (partner_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY quarter) AS k FROM m)
SELECT cohort, quarter, median_revenue, median_revenue / nullif(avg(median_revenue) FILTER (k <= 4) OVER (PARTITION BY cohort), 0) * 100 AS indexed FROM k""", dbl="median_revenue indexed")
def decline_trajectory(spark, sf):
    return risk.decline_trajectory(score_snapshot(spark, sf), tables(spark, sf).partner_quarter, streak=2)


@query("odds_and_logit", "PRJ-06", cte("now") + """
SELECT partner_id, p * 1.2 / (1 - p + p * 1.2) AS scaled, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) AS logit
FROM (SELECT partner_id, (1 + coalesce(days_since_last_order, 900)) / (1000 * (1 + coalesce(lines_per_month_6m, 0))) AS p FROM now)""", dbl="scaled logit")
def odds_and_logit(spark, sf):
    from ..functions.numeric import logit, scale_odds
    from ..plans.scoring import rule_probability
    p = rule_probability()
    return score_snapshot(spark, sf).select("partner_id", scale_odds(p, 1.2).alias("scaled"), logit(p).alias("logit"))


_pct = lambda e: f"CAST(CAST(round_even(({e}) * 100, 0) AS BIGINT) AS VARCHAR) || '%'"
_spct = lambda e: f"CASE WHEN round_even(({e}) * 100, 0) >= 0 THEN '+' ELSE '' END || {_pct(e)}"
_n0 = lambda e: f"CAST(CAST(round_even({e}, 0) AS BIGINT) AS VARCHAR)"
_n1 = lambda e: f"printf('%.1f', round_even({e}, 1))"
_money = lambda v: (f"CASE WHEN abs({v}) < 1e3 THEN '$' || format('{{:,}}', CAST(round_even({v}, 0) AS BIGINT)) WHEN abs({v}) < 1e6 THEN '$' || format('{{:,}}', CAST(round_even({v} / 1e3, 0) AS BIGINT)) || 'K' "  # noqa: E731
                    f"ELSE '$' || printf('%.1f', round_even({v} / 1e6, 1)) || 'M' END")
_chg = lambda s: f"(CASE WHEN {s} < 1 THEN (1 + {s}) / (1 - {s}) - 1 END)"
_part1 = f"'revenue in 2001-Q2 was ' || {_pct('rev_q1_vs_prev4q')} || ' of its previous 4-quarter average'"
_part2 = f"'order lines ' || {_spct(_chg('lines_3m_vs_prev3m'))} || ' in the last 3 months vs the 3 before'"
SENTENCE = {
    "recency": f"""CASE WHEN never_ordered = 1 THEN 'Has not placed an order since onboarding ' || {_n0('tenure_months')} || ' months ago'
      WHEN typical_gap_days IS NOT NULL AND days_since_last_order > typical_gap_days THEN 'No order for ' || {_n0('days_since_last_order')} || ' days - usually orders every ' || {_n0('typical_gap_days')} || ' days'
      WHEN days_since_last_order > 60 THEN 'No order for ' || {_n0('days_since_last_order')} || ' days'
      ELSE 'Quiet at quarter end: ' || {_n0('lines_last_month')} || ' order line' || CASE WHEN lines_last_month = 1 THEN '' ELSE 's' END || ' in the final month of 2001-Q2' END""",
    "frequency": f"""CASE WHEN active_month_share_6m * 6 = 0 THEN coalesce('No orders in the last 6 months (last order ' || {_n0('days_since_last_order')} || ' days ago)', 'No orders in the last 6 months')
      ELSE 'Orders infrequently: active in ' || {_n0('active_month_share_6m * 6')} || ' of the last 6 months, ' || {_n1('lines_per_month_6m')} || ' order lines a month (typical ' || tier || ' partner: ' || {_n1('m_lines')} || ')' END""",
    "volatility": f"'Very irregular buying: monthly revenue varies ' || {_n1('rev_cv_6m')} || 'x its average (typical ' || tier || ' partner: ' || {_n1('m_cv')} || 'x)'",
    "size": f"""CASE WHEN exp(rev_q1_log) - 1 = 0 THEN 'No revenue in 2001-Q2 (averaged ' || {_money('(exp(rev_avg_4q_log) - 1)')} || ' a quarter over the last year; typical ' || tier || ' partner: ' || {_money('(exp(m_rev) - 1)')} || ')'
      ELSE 'Small account: ' || {_money('(exp(rev_q1_log) - 1)')} || ' revenue in 2001-Q2 vs ' || {_money('(exp(m_rev) - 1)')} || ' for a typical ' || tier || ' partner' END""",
    "momentum": f"""CASE WHEN rev_q1_vs_prev4q IS NULL AND {_chg('lines_3m_vs_prev3m')} IS NULL THEN 'Recent revenue trend is weakening' ELSE 'Slowing down: ' || concat_ws('; ', {_part1}, CASE WHEN {_chg('lines_3m_vs_prev3m')} IS NOT NULL THEN {_part2} END) END""",
    "yoy": f"""CASE WHEN {_chg('yoy_2q')} IS NOT NULL THEN 'Revenue ' || {_spct(_chg('yoy_2q'))} || ' year on year (H1 2001 vs H1 2000)' ELSE 'Revenue down year on year' END
      || CASE WHEN yoy_decline_streak >= 2 THEN ', down ' || {_n0('yoy_decline_streak')} || ' quarters in a row' ELSE '' END""",
    "attainment": f"""CASE WHEN att_miss_streak >= 1 THEN 'Below target ' || {_n0('att_miss_streak')} || ' quarter' || CASE WHEN att_miss_streak = 1 THEN '' ELSE 's' END || ' in a row; ' ELSE 'Target attainment slipping: ' END
      || coalesce({_pct('att_avg_2q')}, '-') || ' of target over the last 2 quarters'""",
    "breadth": f"""'Narrow product mix: ' || {_n0('n_products_2q')} || ' product famil' || CASE WHEN n_products_2q = 1 THEN 'y' ELSE 'ies' END || ' in the last 2 quarters' || CASE WHEN n_products_change < 0 THEN ' (down from ' || {_n0('n_products_2q - n_products_change')} || ')' ELSE '' END""",
    "margin": f"'Margin ' || {_n1('margin_pct_4q')} || '% vs ' || {_n1('m_margin')} || '% for its tier'",
}


@query("driver_sentences", "PRJ-19 PRJ-07", cte("now") + """,
p AS (SELECT *, median(lines_per_month_6m) OVER (PARTITION BY tier) AS m_lines, median(rev_cv_6m) OVER (PARTITION BY tier) AS m_cv, median(rev_q1_log) OVER (PARTITION BY tier) AS m_rev,
  median(margin_pct_4q) OVER (PARTITION BY tier) AS m_margin FROM now)
""" + " UNION ALL ".join(f"SELECT partner_id, '{k}' AS driver, {e} AS sentence FROM p" for k, e in SENTENCE.items()))
def driver_sentences(spark, sf):
    return risk.all_sentences(score_snapshot(spark, sf), SETTINGS)


@query("flag_overlap", "SE-03", cte("now") + """,
s AS (SELECT partner_id, row_number() OVER (ORDER BY (1 + coalesce(days_since_last_order, 900)) / (1000 * (1 + coalesce(lines_per_month_6m, 0))) DESC, partner_id) AS a,
  row_number() OVER (ORDER BY coalesce(days_since_last_order, 900) DESC, partner_id) AS b, count(*) OVER () AS n FROM now)
SELECT count(*) FILTER (a <= floor(0.1 * n + 1e-9)) AS flagged_a, count(*) FILTER (b <= floor(0.1 * n + 1e-9)) AS flagged_b, count(*) FILTER (a <= floor(0.1 * n + 1e-9) AND b <= floor(0.1 * n + 1e-9)) AS flagged_both FROM s""")
def flag_overlap(spark, sf):
    from ..operators.ranking import top_share
    from ..plans.scoring import rule_probability
    x = score_snapshot(spark, sf).select("partner_id", rule_probability().alias("p"), F.coalesce("days_since_last_order", F.lit(900.0)).alias("d"))
    a = top_share(x, [-F.col("p"), F.col("partner_id")], 0.1).where("chosen").select("partner_id")
    b = top_share(x, [-F.col("d"), F.col("partner_id")], 0.1).where("chosen").select("partner_id")
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    return n(a, "flagged_a").crossJoin(n(b, "flagged_b")).crossJoin(n(a.intersect(b), "flagged_both"))
