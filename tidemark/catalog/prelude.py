"""Shared common table expressions of the SQL twins. `cte("a", "b")` returns a WITH clause holding a, b and what they
need, in order."""
from __future__ import annotations

CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, needs: str, sql: str) -> None:
    CTES[name] = (tuple(needs.split()), sql)


def cte(*names: str) -> str:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in CTES[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in seen) + "\n"


define("master", "", """
SELECT c_custkey AS partner_id, c_name AS partner_name, r_name AS region,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Platinum' WHEN 'BUILDING' THEN 'Gold'
            WHEN 'FURNITURE' THEN 'Silver' ELSE 'Business' END AS tier,
       CASE c_custkey % 3 WHEN 0 THEN 'Distributor' WHEN 1 THEN 'Reseller' ELSE 'Service Provider' END AS partner_type,
       n_name AS country, DATE '1993-01-01' + CAST((c_custkey * 37) % 2920 AS INT) AS onboarded_date
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

define("sales", "master", """
SELECT CAST(o_orderdate AS DATE) AS order_date, m.partner_id, m.partner_name, m.region, m.tier,
       p_type AS product_family, CAST(l_quantity AS BIGINT) AS quantity,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue_usd,
       CAST(5 + l_partkey % 16 AS DECIMAL(5,2)) AS margin_pct
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN master m ON o_custkey = m.partner_id
     JOIN part ON l_partkey = p_partkey
WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '2001-07-01'
UNION ALL
SELECT DATE '2001-03-27', partner_id, partner_name, region, tier, 'PROMO', CAST(12800 AS BIGINT),
       CAST(37800000 AS DECIMAL(18,4)), CAST(10 AS DECIMAL(5,2))
FROM master WHERE partner_id = 18""")

define("targets", "master", """
SELECT partner_id, CONCAT(1995 + CAST(floor(q / 4) AS INT), '-Q', 1 + q % 4) AS quarter,
       CAST(40000 + 1000 * (partner_id % 60) + 2000 * q AS DECIMAL(18,4)) AS target_usd
FROM master CROSS JOIN (SELECT unnest(range(0, 26)) AS q) AS qs WHERE partner_id % 10 <> 0""")

define("lim", "sales", """
SELECT product_family, 20 * quantile_cont(CAST(revenue_usd AS DOUBLE), 0.99) AS outlier_above FROM sales GROUP BY 1""")

define("lines", "sales lim", """
SELECT s.*, CAST(date_trunc('month', order_date) AS DATE) AS month,
       CONCAT(year(order_date), '-Q', quarter(order_date)) AS quarter,
       year(order_date) * 4 + quarter(order_date) - 1 AS qi,
       CAST(revenue_usd * margin_pct * 0.01 AS DECIMAL(24,6)) AS margin_usd,
       CAST(revenue_usd AS DOUBLE) > outlier_above AS is_outlier
FROM sales s JOIN lim USING (product_family)""")

define("base", "lines master", """
SELECT l.*, m.partner_type, m.onboarded_date, m.country
FROM lines l JOIN master m USING (partner_id) WHERE NOT is_outlier""")

define("months", "", """
SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-06-01', INTERVAL 1 MONTH)) AS DATE) AS month""")

define("pm", "master months base", """
SELECT g.partner_id, g.region, g.tier, g.partner_type, g.month,
       CONCAT(year(g.month), '-Q', quarter(g.month)) AS quarter,
       year(g.month) * 4 + quarter(g.month) - 1 AS qi,
       coalesce(f.revenue_usd, 0) AS revenue_usd, coalesce(f.margin_usd, 0) AS margin_usd,
       coalesce(f.quantity, 0) AS quantity, coalesce(f.order_lines, 0) AS order_lines,
       coalesce(f.n_products, 0) AS n_products, coalesce(f.order_lines, 0) > 0 AS active
FROM (SELECT partner_id, region, tier, partner_type, month FROM master CROSS JOIN months
      WHERE month >= date_trunc('month', onboarded_date)) g
LEFT JOIN (SELECT partner_id, month, sum(revenue_usd) AS revenue_usd, sum(margin_usd) AS margin_usd,
                  sum(quantity) AS quantity, count(*) AS order_lines, count(DISTINCT product_family) AS n_products
           FROM base GROUP BY 1, 2) f ON g.partner_id = f.partner_id AND g.month = f.month""")

define("pq", "pm base targets", """
SELECT p.*, coalesce(b.n_products, 0) AS n_products, t.target_usd,
       CASE WHEN revenue_usd > 0 THEN CAST(margin_usd AS DOUBLE) / CAST(revenue_usd AS DOUBLE) * 100 END AS margin_pct,
       CAST(revenue_usd AS DOUBLE) / CAST(target_usd AS DOUBLE) AS attainment
FROM (SELECT partner_id, region, tier, partner_type, quarter, qi, sum(revenue_usd) AS revenue_usd,
             sum(margin_usd) AS margin_usd, sum(quantity) AS quantity, sum(order_lines) AS order_lines,
             count(*) FILTER (active) AS active_months
      FROM pm GROUP BY ALL) p
LEFT JOIN (SELECT partner_id, quarter, count(DISTINCT product_family) AS n_products FROM base GROUP BY 1, 2) b
       ON p.partner_id = b.partner_id AND p.quarter = b.quarter
LEFT JOIN targets t ON p.partner_id = t.partner_id AND p.quarter = t.quarter""")

define("ps", "master base pq", """
SELECT m.*, r.first_order, r.last_order, r.order_days, r.typical_gap_days, q.* EXCLUDE (partner_id),
       CASE WHEN revenue_h1_prev > 0 THEN CAST(revenue_h1 AS DOUBLE) / CAST(revenue_h1_prev AS DOUBLE) - 1 END AS growth_h1_yoy,
       CASE WHEN revenue_prev4q_avg > 0 THEN CAST(revenue_last_q AS DOUBLE) / revenue_prev4q_avg END AS last_q_vs_prev4q,
       DATE '2001-06-30' - last_order AS days_since_last_order,
       round((DATE '2001-06-30' - onboarded_date) / 30.44, 1) AS tenure_months,
       CASE WHEN onboarded_date < DATE '1995-01-01' THEN 'Onboarded pre-1995' ELSE 'Onboarded 1995+' END AS cohort,
       (DATE '2001-06-30' - last_order) / nullif(typical_gap_days, 0) AS recency_vs_typical_gap,
       round((DATE '2001-06-30' - onboarded_date) / 30.44, 1) < 12 AS is_ramping
FROM master m
LEFT JOIN (SELECT partner_id, min(order_date) AS first_order, max(order_date) AS last_order, count(*) AS order_days,
                  median(gap) AS typical_gap_days
           FROM (SELECT partner_id, order_date,
                        order_date - lag(order_date) OVER (PARTITION BY partner_id ORDER BY order_date) AS gap
                 FROM (SELECT DISTINCT partner_id, order_date FROM base)) GROUP BY 1) r ON m.partner_id = r.partner_id
LEFT JOIN (SELECT partner_id, sum(revenue_usd) AS revenue_total,
                  sum(revenue_usd) FILTER (quarter IN ('2000-Q1', '2000-Q2')) AS revenue_h1_prev,
                  sum(revenue_usd) FILTER (quarter IN ('2001-Q1', '2001-Q2')) AS revenue_h1,
                  sum(revenue_usd) FILTER (quarter = '2001-Q2') AS revenue_last_q,
                  avg(CAST(revenue_usd AS DOUBLE)) FILTER (quarter IN ('2000-Q2','2000-Q3','2000-Q4','2001-Q1')) AS revenue_prev4q_avg,
                  sum(order_lines) FILTER (quarter = '2001-Q2') AS lines_last_q,
                  avg(order_lines) FILTER (quarter IN ('2000-Q2','2000-Q3','2000-Q4','2001-Q1')) AS lines_prev4q_avg
           FROM pq GROUP BY 1) q ON m.partner_id = q.partner_id""")

define("tickets", "", """
SELECT d.doc_id AS ticket_id, CASE d.doc_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'portal' ELSE 'chat' END AS channel,
       substring(d.text, 1, 40) AS subject, d.text AS body, d.source AS product, d.lang AS category,
       CASE WHEN toxic = 1 AND quality = 0 THEN 'P1' WHEN toxic = 1 THEN 'P2' WHEN quality = 0 THEN 'P3' ELSE 'P4' END AS priority,
       CASE WHEN d.source IN ('src3', 'src7') THEN 'team_x' ELSE CONCAT('team_', d.lang) END AS assigned_team,
       CASE WHEN toxic = 1 THEN 'Angry' WHEN quality = 0 THEN 'Frustrated' WHEN d.doc_id % 5 = 0 THEN 'Positive' ELSE 'Neutral' END AS sentiment
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")


def _scored(extra: int, boost: int) -> str:
    from ..sources.fixtures import CLASS_STEPS, CLASSES
    rows = ", ".join(f"('{t}', '{c}', {CLASS_STEPS[c] + extra})" for t, cs in CLASSES.items() for c in cs)
    return f"""
SELECT ticket_id, target, class, truth, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY ticket_id, target) AS p
FROM (SELECT ticket_id, target, class, truth, 1 + (ticket_id * m) % 97 + CASE WHEN truth = class THEN {boost} ELSE 0 END AS w
      FROM (SELECT t.ticket_id, c.target, c.class, c.m,
                   CASE c.target WHEN 'priority' THEN t.priority WHEN 'category' THEN t.category ELSE t.assigned_team END AS truth
            FROM tickets t CROSS JOIN (VALUES {rows}) AS c(target, class, m)) AS x) AS y"""


define("proba", "tickets", _scored(0, 60))
define("proba2", "tickets", _scored(6, 40))


def _inbox() -> str:
    from ..sources.fixtures import PHRASES, SEVERITY_WORDS
    ph = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PHRASES) + "]"
    sv = "[" + ", ".join(f"'{w}'" for w in SEVERITY_WORDS) + "]"
    return f"""
SELECT doc_id AS ticket_id, CASE doc_id % 3 WHEN 0 THEN 'email' WHEN 1 THEN 'portal' ELSE 'chat' END AS channel,
       substring(text, 1, 40) AS subject,
       CASE WHEN doc_id % 3 = 1 THEN '[Customer-selected severity: ' || ({sv})[1 + doc_id % {len(SEVERITY_WORDS)}] || '] ' ELSE '' END
       || text || ' ' || ({ph})[1 + doc_id % {len(PHRASES)}] AS body, source AS product
FROM documents"""


define("inbox", "", _inbox())
