"""Sources, calendar, lines, grid, snapshot and data-quality queries."""
from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.numeric import ratio
from ..operators import facts, quality
from ..session import is_stored
from ..sources.fixtures import SETTINGS, Channel, Desk
from .prelude import cte
from .registry import query


def tables(spark, sf):
    """Everything computed from the given files."""
    return facts.ChannelTables.of(Channel(spark, sf))


def stored(spark, sf):
    """For queries that read prepared tables: lines and partner facts are prepared once per session."""
    return facts.ChannelTables.stored(Channel(spark, sf))


def stored_or_plain(spark, sf):
    """For queries that read the lines once: the prepared ones where the session has them, else the given files, since writing
    and moving all lines costs more than one such query."""
    return stored(spark, sf) if is_stored(spark, sf, "lines") else tables(spark, sf)


@query("sales_lines_clean", "SRC-01 PRJ-02", cte("lines") + """
SELECT order_date, partner_id, product_family, quantity, revenue_usd, margin_pct, month, quarter,
       year(order_date) AS year, margin_usd, CAST(revenue_usd AS DOUBLE) / quantity AS unit_price, is_outlier
FROM lines""", dbl="revenue_usd margin_pct margin_usd unit_price", big="year", digits=9)
def sales_lines_clean(spark, sf):
    return tables(spark, sf).clean.select(
        "order_date", "partner_id", "product_family", "quantity", "revenue_usd", "margin_pct", "month", "quarter",
        "year", "margin_usd", "unit_price", "is_outlier")


@query("ticket_scan", "SRC-02", cte("tickets") + """
SELECT ticket_id, channel, product, category, priority, assigned_team, sentiment, length(body) AS body_chars
FROM tickets""", big="body_chars")
def ticket_scan(spark, sf):
    return Desk(spark, sf).tickets.select("ticket_id", "channel", "product", "category", "priority",
                                          "assigned_team", "sentiment", F.length("body").alias("body_chars"))


@query("dimension_domain_check", "SRC-04", cte("sales") + """
SELECT 'tier' AS dimension, tier AS value, count(*) AS n FROM sales
WHERE tier NOT IN ('Platinum', 'Gold', 'Silver') GROUP BY tier
UNION ALL SELECT 'product_family', product_family, count(*) FROM sales
WHERE product_family NOT IN ('ECONOMY', 'LARGE', 'MEDIUM', 'SMALL', 'STANDARD') GROUP BY product_family""")
def dimension_domain_check(spark, sf):
    """Values outside a (here deliberately short) domain, with their line counts."""
    domains = {"tier": ["Platinum", "Gold", "Silver"],
               "product_family": ["ECONOMY", "LARGE", "MEDIUM", "SMALL", "STANDARD"]}
    return quality.unknown_values(Channel(spark, sf).sales, domains)


@query("dimension_order", "SRC-04", cte("sales") + """
SELECT tier, CASE tier WHEN 'Platinum' THEN 0 WHEN 'Gold' THEN 1 WHEN 'Silver' THEN 2 ELSE 3 END AS rank,
       sum(revenue_usd) AS revenue FROM sales GROUP BY 1, 2""", dbl="revenue", big="rank")
def dimension_order(spark, sf):
    dom = quality.domain_frame(spark, "tier", SETTINGS.tiers)
    s = Channel(spark, sf).sales.groupBy("tier").agg(F.sum("revenue_usd").alias("revenue"))
    return s.join(F.broadcast(dom), "tier").select("tier", "rank", "revenue").orderBy("rank")


@query("calendar_shifts", "PRJ-01", cte("sales") + """,
d AS (SELECT DISTINCT order_date FROM sales),
s AS (SELECT order_date, year(order_date) * 4 + quarter(order_date) - 1 AS q, n
      FROM d CROSS JOIN (SELECT unnest(range(-5, 5)) AS n))
SELECT order_date, n, CONCAT(q // 4, '-Q', q % 4 + 1) AS quarter, CONCAT((q + n) // 4, '-Q', (q + n) % 4 + 1) AS shifted,
       CAST(date_trunc('month', order_date) AS DATE) AS month, CAST(date_trunc('quarter', order_date) AS DATE) AS starts,
       CAST(date_trunc('quarter', order_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS ends,
       (month(order_date) - 1) % 3 + 1 AS month_in_quarter FROM s""", big="n month_in_quarter")
def calendar_shifts(spark, sf):
    d = Channel(spark, sf).sales.select("order_date").distinct()
    q = cal.quarter_label(F.col("order_date"))
    n = F.explode(F.sequence(F.lit(-5), F.lit(4))).alias("n")
    return (d.select("order_date", q.alias("quarter"), cal.month_start(F.col("order_date")).alias("month"),
                     cal.month_in_quarter(F.col("order_date")).alias("month_in_quarter"), n)
            .withColumns({"shifted": cal.shift_quarter(F.col("quarter"), F.col("n")),
                          "starts": cal.quarter_start(F.col("quarter")), "ends": cal.quarter_end(F.col("quarter"))}))


@query("targets_dated", "PRJ-03", cte("targets") + """
SELECT partner_id, quarter, target_usd,
       make_date(CAST(substr(quarter, 1, 4) AS INT), CAST(substr(quarter, 7, 1) AS INT) * 3 - 2, 1) AS quarter_start,
       CAST(make_date(CAST(substr(quarter, 1, 4) AS INT), CAST(substr(quarter, 7, 1) AS INT) * 3 - 2, 1)
            + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS quarter_end FROM targets""", dbl="target_usd")
def targets_dated(spark, sf):
    return facts.clean_targets(Channel(spark, sf).targets)


@query("lines_with_partner", "PRJ-04 JN-01", cte("base") + """
SELECT partner_id, order_date, revenue_usd, partner_type, country,
       CASE WHEN onboarded_date < DATE '1995-01-01' THEN 'Onboarded pre-1995' ELSE 'Onboarded 1995+' END AS cohort,
       round((order_date - onboarded_date) / 30.44, 1) AS tenure_months FROM base""", dbl="revenue_usd tenure_months")
def lines_with_partner(spark, sf):
    t = tables(spark, sf)
    return facts.attach_partner(t.base, t.master, SETTINGS).select(
        "partner_id", "order_date", "revenue_usd", "partner_type", "country", "cohort", "tenure_months")


@query("line_key_repeats", "JN-01", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""", big="l_linenumber")
def line_key_repeats(spark, sf):
    """The uniqueness check of a many-to-one join, on a key that is not unique."""
    return facts.repeated_keys(Channel(spark, sf).table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("region_quarter", "AG-01", cte("base") + """
SELECT region, quarter, sum(revenue_usd) AS revenue_usd, sum(margin_usd) AS margin_usd, sum(quantity) AS quantity,
       count(*) AS order_lines, count(DISTINCT partner_id) AS partners,
       CAST(sum(margin_usd) AS DOUBLE) / CAST(sum(revenue_usd) AS DOUBLE) * 100 AS margin_pct
FROM base GROUP BY 1, 2""", dbl="revenue_usd margin_usd margin_pct", big="quantity")
def region_quarter(spark, sf):
    return facts.aggregate(tables(spark, sf).base, ["region", "quarter"])


@query("rollup_grouping_sets", "AG-04", cte("base") + """
SELECT CASE grouping_id(region, tier, product_family, quarter, month)
            WHEN 14 THEN 'region_month' WHEN 13 THEN 'region_quarter' WHEN 21 THEN 'tier_quarter'
            WHEN 25 THEN 'product_quarter' ELSE 'region_tier_product_quarter' END AS rollup,
       region, tier, product_family, quarter, month, sum(revenue_usd) AS revenue_usd, sum(margin_usd) AS margin_usd,
       sum(quantity) AS quantity, count(*) AS order_lines, count(DISTINCT partner_id) AS partners,
       CAST(sum(margin_usd) AS DOUBLE) / CAST(sum(revenue_usd) AS DOUBLE) * 100 AS margin_pct
FROM base GROUP BY GROUPING SETS ((region, month), (region, quarter), (tier, quarter), (product_family, quarter),
                                  (region, tier, product_family, quarter))""",
       dbl="revenue_usd margin_usd margin_pct", big="quantity")
def rollup_grouping_sets(spark, sf):
    return facts.rollups(tables(spark, sf).base)


@query("partner_month_grid", "JN-02 JN-03 AG-02", cte("pm") + """
SELECT partner_id, region, tier, partner_type, month, quarter, revenue_usd, margin_usd, quantity, order_lines,
       n_products, active FROM pm""", dbl="revenue_usd margin_usd", big="quantity order_lines n_products")
def partner_month_grid(spark, sf):
    return tables(spark, sf).partner_month


@query("partner_quarter_facts", "JN-04 AG-03", cte("pq") + "SELECT * EXCLUDE (qi) FROM pq",
       dbl="revenue_usd margin_usd target_usd margin_pct attainment", big="quantity order_lines active_months n_products")
def partner_quarter_facts(spark, sf):
    return tables(spark, sf).partner_quarter


@query("partner_snapshot", "AG-05 WN-01", cte("ps") + "SELECT * FROM ps",
       dbl="typical_gap_days revenue_total revenue_h1_prev revenue_h1 revenue_last_q revenue_prev4q_avg "
           "lines_prev4q_avg growth_h1_yoy last_q_vs_prev4q tenure_months recency_vs_typical_gap",
       big="order_days lines_last_q days_since_last_order")
def partner_snapshot(spark, sf):
    return tables(spark, sf).partner_summary


@query("order_day_gaps", "WN-01 SE-02", cte("base") + """
SELECT partner_id, order_date, order_date - lag(order_date) OVER (PARTITION BY partner_id ORDER BY order_date) AS gap_days
FROM (SELECT DISTINCT partner_id, order_date FROM base)""", big="gap_days")
def order_day_gaps(spark, sf):
    return facts.order_gaps(tables(spark, sf).base)


@query("outlier_lines", "AG-18 FLT-03", cte("lines") + """
SELECT l.partner_id, l.order_date, l.region, l.product_family, l.quantity, l.revenue_usd, outlier_above
FROM lines l JOIN lim USING (product_family) WHERE is_outlier""", dbl="revenue_usd outlier_above")
def outlier_lines(spark, sf):
    ch = Channel(spark, sf)
    return (tables(spark, sf).clean.where("is_outlier").join(facts.outlier_limits(ch.line_values), "product_family")
            .select("partner_id", "order_date", "region", "product_family", "quantity", "revenue_usd", "outlier_above"))


@query("outlier_limits", "AG-18", cte("lim") + "SELECT * FROM lim", dbl="outlier_above")
def outlier_limits(spark, sf):
    return facts.outlier_limits(Channel(spark, sf).line_values)


DQ_SQL = cte("lines", "targets") + """,
first_order AS (SELECT partner_id, min(order_date) AS d FROM sales GROUP BY 1),
dims AS (SELECT DISTINCT s.partner_id, s.region, s.tier, m.region AS mr, m.tier AS mt
         FROM sales s JOIN master m USING (partner_id))
SELECT 'sales lines' AS check_name, count(*) AS value FROM sales
UNION ALL SELECT 'partners in master', count(*) FROM master
UNION ALL SELECT 'target rows', count(*) FROM targets
UNION ALL SELECT 'null cells in sales', CAST(sum(CAST(order_date IS NULL AS INT) + CAST(partner_id IS NULL AS INT)
   + CAST(partner_name IS NULL AS INT) + CAST(region IS NULL AS INT) + CAST(tier IS NULL AS INT)
   + CAST(product_family IS NULL AS INT) + CAST(quantity IS NULL AS INT) + CAST(revenue_usd IS NULL AS INT)
   + CAST(margin_pct IS NULL AS INT)) AS BIGINT) FROM sales
UNION ALL SELECT 'null cells in master', count(*) FILTER (partner_id IS NULL) + count(*) FILTER (partner_name IS NULL)
   + count(*) FILTER (region IS NULL) + count(*) FILTER (tier IS NULL) + count(*) FILTER (partner_type IS NULL)
   + count(*) FILTER (country IS NULL) + count(*) FILTER (onboarded_date IS NULL) FROM master
UNION ALL SELECT 'null cells in targets', count(*) FILTER (partner_id IS NULL) + count(*) FILTER (quarter IS NULL)
   + count(*) FILTER (target_usd IS NULL) FROM targets
UNION ALL SELECT 'duplicate sales lines', (SELECT count(*) FROM sales) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales))
UNION ALL SELECT 'lines with revenue or quantity <= 0', count(*) FROM sales WHERE revenue_usd <= 0 OR quantity <= 0
UNION ALL SELECT 'sales partners missing from master', count(DISTINCT partner_id) FROM sales
   WHERE partner_id NOT IN (SELECT partner_id FROM master)
UNION ALL SELECT 'master partners without sales', count(*) FROM master WHERE partner_id NOT IN (SELECT partner_id FROM sales)
UNION ALL SELECT 'master partners without targets', count(*) FROM master WHERE partner_id NOT IN (SELECT partner_id FROM targets)
UNION ALL SELECT 'region differs from master', count(*) FROM dims WHERE region <> mr
UNION ALL SELECT 'tier differs from master', count(*) FROM dims WHERE tier <> mt
UNION ALL SELECT 'partners ordering before onboarding', count(*) FROM first_order JOIN master USING (partner_id) WHERE d < onboarded_date
UNION ALL SELECT 'partners onboarded in the window', count(*) FROM master WHERE onboarded_date >= DATE '1995-01-01'
UNION ALL SELECT 'outlier lines', count(*) FROM lines WHERE is_outlier"""


@query("data_quality_checks", "AG-17 JN-07 SE-02", DQ_SQL)
def data_quality_checks(spark, sf):
    ch = Channel(spark, sf)
    return quality.data_quality(ch.sales, ch.master, ch.targets, SETTINGS)


@query("period_revenue", "FLT-06", cte("base") + """
SELECT tier, sum(revenue_usd) AS revenue_usd FROM base
WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-30' GROUP BY 1""", dbl="revenue_usd")
def period_revenue(spark, sf):
    return quality.period_revenue(tables(spark, sf).base, "tier", date(2000, 1, 1), date(2000, 6, 30))


@query("margin_ratio_edges", "PRJ-02", cte("base") + """
SELECT product_family, quarter, CAST(sum(revenue_usd) AS DOUBLE) / nullif(sum(quantity), 0) AS unit_price
FROM base GROUP BY 1, 2""", dbl="unit_price")
def margin_ratio_edges(spark, sf):
    g = tables(spark, sf).base.groupBy("product_family", "quarter").agg(
        F.sum("revenue_usd").alias("r"), F.sum("quantity").alias("q"))
    return g.select("product_family", "quarter", ratio(F.col("r"), F.col("q")).alias("unit_price"))
