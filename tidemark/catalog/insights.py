"""Insight and exploration queries over the whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import insights as ins
from ..operators import stats
from .channel_core import stored as tables
from .prelude import cte, define
from .registry import query
from .snapshots import panel



@query("outlier_effect", "IN-01", cte("lines") + """,
q AS (SELECT region, quarter, sum(revenue_usd) AS reported, sum(revenue_usd) FILTER (NOT is_outlier) AS cleaned, max(revenue_usd) FILTER (is_outlier) AS outlier_revenue
      FROM lines WHERE region IN (SELECT region FROM lines WHERE is_outlier) GROUP BY 1, 2)
SELECT *, CAST(reported AS DOUBLE) / CAST(lag(reported) OVER w AS DOUBLE) - 1 AS reported_qoq, CAST(cleaned AS DOUBLE) / CAST(lag(cleaned) OVER w AS DOUBLE) - 1 AS cleaned_qoq,
  CAST(outlier_revenue AS DOUBLE) / CAST((SELECT max(revenue_usd) FROM lines WHERE NOT is_outlier) AS DOUBLE) AS times_next_largest
FROM q WINDOW w AS (PARTITION BY region ORDER BY quarter)""", dbl="reported cleaned outlier_revenue reported_qoq cleaned_qoq times_next_largest")
def outlier_effect(spark, sf):
    return ins.outlier_effect(tables(spark, sf))


@query("growth_vs_shrinking", "IN-02", cte("ps") + """,
a AS (SELECT region, revenue_h1, revenue_h1_prev, growth_h1_yoy FROM ps WHERE revenue_h1_prev > 0), b AS (SELECT * FROM a UNION ALL SELECT 'ALL', * EXCLUDE (region) FROM a)
SELECT region, CAST(sum(revenue_h1) AS DOUBLE) / CAST(sum(revenue_h1_prev) AS DOUBLE) - 1 AS total_growth, avg(CAST(coalesce(growth_h1_yoy < 0, false) AS INT)) AS pct_declining,
  count(*) AS partners, median(growth_h1_yoy) AS median_partner_growth FROM b GROUP BY 1""", dbl="total_growth pct_declining median_partner_growth")
def growth_vs_shrinking(spark, sf):
    return ins.growth_vs_shrinking(tables(spark, sf))


define("cohort", "pq master", """
SELECT pq.region, CASE WHEN onboarded_date < DATE '1995-01-01' THEN 'Onboarded pre-1995' ELSE 'Onboarded 1995+' END AS cohort, quarter, sum(revenue_usd) AS revenue
FROM pq JOIN master USING (partner_id) GROUP BY 1, 2, 3""")


@query("cohort_revenue", "IN-03", cte("cohort") + "SELECT * FROM cohort", dbl="revenue")
def cohort_revenue(spark, sf):
    return ins.cohort_revenue(tables(spark, sf))


@query("new_partner_growth", "IN-03", cte("cohort") + """
SELECT region, CAST(coalesce(sum(revenue) FILTER (cohort = 'Onboarded pre-1995' AND quarter = '2001-Q2'), 0) AS DOUBLE)
  / nullif(CAST(sum(revenue) FILTER (cohort = 'Onboarded pre-1995' AND quarter = '2000-Q2') AS DOUBLE), 0) - 1 AS existing_yoy,
  coalesce(sum(revenue) FILTER (cohort = 'Onboarded 1995+' AND quarter = '2001-Q2'), 0) AS new_cohort_revenue FROM cohort GROUP BY 1""", dbl="existing_yoy new_cohort_revenue")
def new_partner_growth(spark, sf):
    return ins.new_partners(tables(spark, sf))


@query("revenue_concentration", "IN-04 WN-10", cte("ps") + """,
r AS (SELECT coalesce(revenue_total, 0) AS r, row_number() OVER (ORDER BY coalesce(revenue_total, 0) DESC, partner_id) AS rn, count(*) OVER () AS n,
      sum(coalesce(revenue_total, 0)) OVER (ORDER BY coalesce(revenue_total, 0) DESC, partner_id ROWS UNBOUNDED PRECEDING) AS cum, sum(coalesce(revenue_total, 0)) OVER () AS tot FROM ps),
s AS (SELECT i / CAST(50 AS DOUBLE) AS p FROM (SELECT unnest(range(1, 51)) AS i) UNION SELECT CAST(0.01 AS DOUBLE) UNION SELECT CAST(0.05 AS DOUBLE))
SELECT p AS partner_share, rn AS partners, CAST(cum AS DOUBLE) / CAST(tot AS DOUBLE) AS revenue_share FROM r JOIN s ON rn = greatest(floor(n * p), 1)""", dbl="partner_share revenue_share")
def revenue_concentration(spark, sf):
    return ins.concentration(tables(spark, sf))


@query("top_ten_partners", "SO-06 IN-04", cte("ps") + """
SELECT partner_id, partner_name, region, tier, partner_type, revenue_total, growth_h1_yoy FROM ps ORDER BY revenue_total DESC NULLS LAST, partner_id LIMIT 10""", dbl="revenue_total growth_h1_yoy")
def top_ten_partners(spark, sf):
    return ins.top_partners(tables(spark, sf))


@query("price_vs_volume", "IN-05", cte("base") + """,
g AS (SELECT product_family, quarter, CAST(sum(revenue_usd) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) AS unit_price, CAST(sum(quantity) AS BIGINT) AS quantity FROM base GROUP BY 1, 2)
SELECT *, unit_price / first_value(unit_price) OVER w * 100 AS price_index, CAST(quantity AS DOUBLE) / first_value(quantity) OVER w - 1 AS quantity_change
FROM g WINDOW w AS (PARTITION BY product_family ORDER BY quarter)""", dbl="unit_price price_index quantity_change")
def price_vs_volume(spark, sf):
    return ins.price_index(tables(spark, sf))


@query("margin_mix", "IN-06", cte("base") + " UNION ALL ".join(
    f"SELECT '{d}' AS dim, {d} AS value, CAST(sum(margin_usd) AS DOUBLE) / CAST(sum(revenue_usd) AS DOUBLE) * 100 AS margin_pct FROM base GROUP BY {d}"
    for d in ("product_family", "tier", "quarter")), dbl="margin_pct")
def margin_mix(spark, sf):
    return ins.margin_mix(tables(spark, sf))


@query("attainment_by_quarter", "IN-07", cte("pq") + """
SELECT quarter, CAST(sum(revenue_usd) AS DOUBLE) / CAST(sum(target_usd) AS DOUBLE) AS revenue_vs_target, avg(CAST(attainment >= 1 AS INT)) AS pct_partners_hit,
  count(*) AS partners_with_target, median(attainment) AS median_attainment FROM pq WHERE target_usd IS NOT NULL GROUP BY 1""", dbl="revenue_vs_target pct_partners_hit median_attainment")
def attainment_by_quarter(spark, sf):
    return ins.attainment(tables(spark, sf))


@query("attainment_histogram", "AG-10 IN-07", cte("pq") + """,
t AS (SELECT floor(least(attainment, 3.0) * 10 + 1e-9) AS tenth FROM pq WHERE target_usd IS NOT NULL AND quarter = '2001-Q2')
SELECT CAST(i AS DOUBLE) AS "from", CAST(i + 1 AS DOUBLE) AS "to", (SELECT count(*) FROM t WHERE tenth >= i AND (tenth < i + 1 OR (i = 29 AND tenth = 30))) AS partners
FROM (SELECT unnest(range(0, 30)) AS i)""", dbl="from to")
def attainment_histogram(spark, sf):
    return ins.attainment_histogram(tables(spark, sf))


@query("quarter_end_spike", "IN-08", cte("base") + """,
m AS (SELECT month, CAST(sum(revenue_usd) AS DOUBLE) AS r, (month(month) - 1) % 3 = 2 AS last FROM base GROUP BY 1)
SELECT avg(r) FILTER (last) / avg(r) FILTER (NOT last) AS spike_of_means, sum(r) FILTER (last) / (sum(r) FILTER (NOT last) / 2) AS spike_of_sums FROM m""",
       dbl="spike_of_means spike_of_sums")
def quarter_end_spike(spark, sf):
    return ins.quarter_end_spike(tables(spark, sf))


@query("third_vs_second_quarter", "IN-08 FC-14", cte("base") + """
SELECT substr(quarter, 1, 4) AS year, region, CAST(sum(revenue_usd) FILTER (substr(quarter, 7, 1) = '3') AS DOUBLE)
  / CAST(sum(revenue_usd) FILTER (substr(quarter, 7, 1) = '2') AS DOUBLE) AS q3_over_q2 FROM base GROUP BY 1, 2
HAVING count(*) FILTER (substr(quarter, 7, 1) = '3') > 0""", dbl="q3_over_q2")
def third_vs_second_quarter(spark, sf):
    return ins.third_vs_second_quarter(tables(spark, sf))


define("cs", "pq", """
SELECT *, coalesce(n >= 2 AND b > 0, false) AS eligible, coalesce(n >= 2 AND b > 0 AND rev < 0.1 * b, false) AS leaver,
  coalesce(n >= 2 AND b > 0 AND rev < 0.1 * b AND next_rev >= 0.3 * b, false) AS recovered
FROM (SELECT partner_id, tier, quarter, CAST(revenue_usd AS DOUBLE) AS rev, avg(CAST(revenue_usd AS DOUBLE)) OVER p AS b, count(*) OVER p AS n,
        lead(CAST(revenue_usd AS DOUBLE)) OVER (PARTITION BY partner_id ORDER BY qi) AS next_rev
      FROM pq WINDOW p AS (PARTITION BY partner_id ORDER BY qi ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))
WHERE quarter >= '1996-Q1'""")
define("cn", "cs", """
SELECT quarter, count(*) FILTER (eligible) AS eligible_partners, count(*) FILTER (leaver) AS naive_leavers,
  CAST(count(*) FILTER (leaver) AS DOUBLE) / nullif(count(*) FILTER (eligible), 0) AS rate,
  CASE WHEN quarter <> '2001-Q2' THEN count(*) FILTER (recovered) END AS recovered,
  CASE WHEN quarter <> '2001-Q2' THEN count(*) FILTER (leaver) - count(*) FILTER (recovered) ELSE 0 END AS stayed_low,
  CASE WHEN quarter <> '2001-Q2' THEN 0 ELSE count(*) FILTER (leaver) END AS unknown,
  CAST(count(*) FILTER (leaver AND tier = 'Business') AS DOUBLE) / nullif(count(*) FILTER (leaver), 0) AS business_tier_share,
  CASE WHEN quarter <> '2001-Q2' THEN CAST(count(*) FILTER (recovered) AS DOUBLE) / nullif(count(*) FILTER (leaver), 0) END AS recovery_rate
FROM cs GROUP BY 1""")


@query("churn_noise", "IN-09 WN-12", cte("cn") + "SELECT * FROM cn", dbl="rate business_tier_share recovery_rate")
def churn_noise(spark, sf):
    return ins.churn_noise(tables(spark, sf))


@query("recovery_range", "IN-09", cte("cn") + "SELECT min(recovery_rate) AS lowest, max(recovery_rate) AS highest, median(recovery_rate) AS typical FROM cn", dbl="lowest highest typical")
def recovery_range(spark, sf):
    return ins.recovery_range(tables(spark, sf))


RULES = {"YoY down 2+ quarters": "yoy_decline_streak >= 2", "YoY down 3+ quarters": "yoy_decline_streak >= 3", "YoY down 4+ quarters": "yoy_decline_streak >= 4",
         "Revenue < 50% of peak": "rev_drawdown < 0.5", "last 2Q YoY <= -25%": "yoy_2q <= -1 / CAST(7 AS DOUBLE)"}
define("dec", "hist", """
SELECT *, greatest(ceil((row_number() OVER w - 1) * 10 / CAST(count(*) OVER (PARTITION BY cutoff) - 1 AS DOUBLE)) - 1, 0) AS size_decile
FROM hist WINDOW w AS (PARTITION BY cutoff ORDER BY rev_avg_4q_log, partner_id)""")
define("grp", "dec", " UNION ALL ".join(f"SELECT '{n}' AS grp, coalesce({r}, false) AS is_in, cutoff, tier, size_decile, left_token AS y FROM dec" for n, r in RULES.items()))
define("ove", "grp", """
SELECT g.grp AS "group", count(*) AS snapshots, sum(y) AS leavers, sum(coalesce(rref, rglob)) AS expected, any_value(nrest) AS rest, any_value(yrest) AS rest_leavers,
  sum(y) / nullif(sum(coalesce(rref, rglob)), 0) AS ratio
FROM grp g JOIN (SELECT grp, avg(y) AS rglob, count(*) AS nrest, sum(y) AS yrest FROM grp WHERE NOT is_in GROUP BY 1) a ON g.grp = a.grp
LEFT JOIN (SELECT grp, cutoff, tier, size_decile, avg(y) AS rref FROM grp WHERE NOT is_in GROUP BY 1, 2, 3, 4) r
  ON g.grp = r.grp AND g.cutoff = r.cutoff AND g.tier = r.tier AND g.size_decile = r.size_decile WHERE is_in GROUP BY 1""")


@query("declining_not_leaving", "IN-10 JN-08 WN-08", cte("ove") + "SELECT * FROM ove", dbl="expected ratio", big="leavers rest_leavers")
def declining_not_leaving(spark, sf):
    return ins.observed_vs_expected(panel(spark, sf)).where("snapshots > 0")


@query("size_deciles", "WN-08", cte("dec") + "SELECT partner_id, cutoff, size_decile FROM dec", big="size_decile")
def size_deciles(spark, sf):
    from ..operators.ranking import equal_count_bin
    return equal_count_bin(panel(spark, sf).select("partner_id", "cutoff", "rev_avg_4q_log"), ["cutoff"],
                           [F.col("rev_avg_4q_log"), F.col("partner_id")], 10, "size_decile").select("partner_id", "cutoff", "size_decile")


@query("decliner_fisher", "ML-14", cte("ove") + """,
t AS (SELECT "group", snapshots AS n, CAST(leavers AS BIGINT) AS a, rest AS m, CAST(rest_leavers AS BIGINT) AS c FROM ove),
s AS (SELECT "group", n, a, m, c, k, lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(m + 1) - lgamma(a + c - k + 1) - lgamma(m - (a + c - k) + 1)
        - (lgamma(n + m + 1) - lgamma(a + c + 1) - lgamma(n + m - a - c + 1)) AS lp
      FROM t, LATERAL (SELECT unnest(range(greatest(0, a + c - m), least(n, a + c) + 1)) AS k))
SELECT "group", sum(exp(lp)) FILTER (lp <= l0 + 1e-7) AS fisher_p FROM s JOIN (SELECT "group", lp AS l0 FROM s WHERE k = a) o USING ("group") GROUP BY 1""", dbl="fisher_p")
def decliner_fisher(spark, sf):
    x = ins.observed_vs_expected(panel(spark, sf)).where("snapshots > 0")
    return x.select("group", F.least(stats.fisher_two_sided("leavers", "snapshots", "rest_leavers", "rest"), F.lit(1.0)).alias("fisher_p"))


def _dimsql(d):
    att = ("NULL, NULL" if d == "product_family" else
           f"""(SELECT CAST(sum(revenue_usd) AS DOUBLE) / CAST(sum(target_usd) AS DOUBLE) FROM pq WHERE pq.{d} = b.{d} AND quarter >= '2000-Q3' AND target_usd IS NOT NULL),
  (SELECT avg(CAST(attainment >= 1 AS INT)) FROM pq WHERE pq.{d} = b.{d} AND quarter >= '2000-Q3' AND target_usd IS NOT NULL)""")
    return f"""SELECT '{d}' AS dim, b.{d} AS value, CAST(sum(revenue_usd) AS DOUBLE) AS revenue_usd, CAST(sum(margin_usd) AS DOUBLE) / CAST(sum(revenue_usd) AS DOUBLE) * 100 AS margin_pct,
  CAST(sum(revenue_usd) FILTER (quarter IN ('2001-Q1','2001-Q2')) AS DOUBLE) / CAST(sum(revenue_usd) FILTER (quarter IN ('2000-Q1','2000-Q2')) AS DOUBLE) - 1 AS growth_h1_yoy,
  count(DISTINCT partner_id) AS partners, CAST(sum(revenue_usd) AS DOUBLE) / CAST((SELECT sum(revenue_usd) FROM base) AS DOUBLE) AS share, {att} FROM base b GROUP BY b.{d}"""


@query("dimension_breakdowns", "IN-11 WN-14", cte("base", "pq") + "SELECT * FROM (" + " UNION ALL ".join(_dimsql(d) for d in ("region", "tier", "product_family", "partner_type"))
       + ") AS t(dim, value, revenue_usd, margin_pct, growth_h1_yoy, partners, share, attainment_last4q, pct_partner_q_hit)",
       dbl="revenue_usd margin_pct growth_h1_yoy share attainment_last4q pct_partner_q_hit")
def dimension_breakdowns(spark, sf):
    return ins.dimension_breakdowns(tables(spark, sf))


@query("regional_trend", "IN-12 WN-09", cte("base") + """,
q AS (SELECT region, quarter, sum(revenue_usd) AS revenue FROM base GROUP BY 1, 2 UNION ALL SELECT 'ALL', quarter, sum(revenue_usd) FROM base GROUP BY 2)
SELECT *, CAST(revenue AS DOUBLE) / CAST(lag(revenue, 4) OVER (PARTITION BY region ORDER BY quarter) AS DOUBLE) - 1 AS yoy FROM q""", dbl="revenue yoy")
def regional_trend(spark, sf):
    return ins.regional_trend(tables(spark, sf))


@query("silent_partners", "IN-13", cte("ps") + """
SELECT count(*) FILTER (lines_last_q = 0 AND onboarded_date < DATE '2001-04-01') AS dormant, count(*) FILTER (is_ramping) AS ramping,
  count(*) FILTER (recency_vs_typical_gap > 3) AS silent_3x_gap FROM ps""")
def silent_partners(spark, sf):
    return ins.silence(tables(spark, sf))


@query("last_order_months", "IN-13", cte("base") + """,
m AS (SELECT strftime(max(order_date), '%Y-%m') AS last_order_month FROM base GROUP BY partner_id)
SELECT last_order_month, count(*) AS partners FROM m WHERE last_order_month < (SELECT max(last_order_month) FROM m) GROUP BY 1""")
def last_order_months(spark, sf):
    return ins.last_order_months(tables(spark, sf))


@query("growth_sentences", "IN-02 PRJ-07", cte("ps") + """,
a AS (SELECT region, revenue_h1, revenue_h1_prev, growth_h1_yoy FROM ps WHERE revenue_h1_prev > 0), b AS (SELECT * FROM a UNION ALL SELECT 'ALL', * EXCLUDE (region) FROM a),
c AS (SELECT region, CAST(sum(revenue_h1) AS DOUBLE) / CAST(sum(revenue_h1_prev) AS DOUBLE) - 1 AS g, avg(CAST(coalesce(growth_h1_yoy < 0, false) AS INT)) AS d, count(*) AS n FROM b GROUP BY 1)
SELECT region, region || ': like-for-like revenue ' || CASE WHEN round_even(g * 100, 0) >= 0 THEN '+' ELSE '' END || CAST(CAST(round_even(g * 100, 0) AS BIGINT) AS VARCHAR) || '% while '
  || CAST(CAST(round_even(d * 100, 0) AS BIGINT) AS VARCHAR) || '% of ' || n || ' partners are shrinking.' AS takeaway FROM c""")
def growth_sentences(spark, sf):
    return ins.growth_sentence(ins.growth_vs_shrinking(tables(spark, sf)))


@query("money_texts", "PRJ-07", cte("pq") + """
SELECT partner_id, quarter, CASE WHEN abs(v) < 1e3 THEN '$' || format('{:,}', CAST(round_even(v, 0) AS BIGINT))
  WHEN abs(v) < 1e6 THEN '$' || format('{:,}', CAST(round_even(v / 1e3, 0) AS BIGINT)) || 'K' ELSE '$' || printf('%.1f', round_even(v / 1e6, 1)) || 'M' END AS money
FROM (SELECT partner_id, quarter, CAST(revenue_usd AS DOUBLE) AS v FROM pq)""")
def money_texts(spark, sf):
    from ..functions.numeric import money_text
    return tables(spark, sf).partner_quarter.select("partner_id", "quarter", money_text(F.col("revenue_usd").cast("double")).alias("money"))


