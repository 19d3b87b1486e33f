"""Dashboard queries over the whole tables."""
from __future__ import annotations


from pyspark.sql import functions as F

from ..fixed_values import SIGNAL_LABELS
from ..plans import dashboard as db
from ..plans import scoring
from ..plans.selection import Selection
from ..settings import HEALTH_EDGES
from .channel_core import stored as tables, stored_or_plain
from .prelude import cte, define
from .registry import query
from .snapshots import score_snapshot

YOY = "CASE WHEN yoy_2q < 1 THEN (1 + yoy_2q) / nullif(1 - yoy_2q, 0) - 1 END"
define("scored", "now", f"""
SELECT *, (1 + coalesce(days_since_last_order, 900)) / (1000 * (1 + coalesce(lines_per_month_6m, 0))) AS p_leave, {YOY} AS yoy_h1_pct
FROM now""")
define("scores", "scored", """
SELECT partner_id, partner_name, region, tier, partner_type, country, p_leave, round(100 * (1 - p_leave), 4) AS health_score,
  risk_rank, at_risk, CASE WHEN at_risk = 1 THEN 'At risk' WHEN is_ramping = 1 THEN 'Ramping (new)'
    WHEN yoy_h1_pct <= -0.25 AND yoy_decline_streak >= 2 THEN 'Quietly declining' WHEN yoy_h1_pct >= 0.15 THEN 'Growing'
    ELSE 'Stable' END AS segment,
  round(exp(rev_q1_log) - 1, 0) AS revenue_last_q, round(exp(rev_avg_4q_log) - 1, 0) AS revenue_avg_4q, yoy_h1_pct,
  days_since_last_order, round(lines_per_month_6m, 2) AS lines_per_month_6m, yoy_decline_streak, rev_drawdown
FROM (SELECT *, CAST(risk_rank <= floor(0.1 * n + 1e-9) AS BIGINT) AS at_risk
      FROM (SELECT *, row_number() OVER (ORDER BY p_leave DESC, partner_id) AS risk_rank, count(*) OVER () AS n FROM scored))""")
SCORE_DBL = "p_leave health_score revenue_last_q revenue_avg_4q yoy_h1_pct days_since_last_order lines_per_month_6m"


def scores(spark, sf):
    return scoring.rule_scores(score_snapshot(spark, sf), tables(spark, sf).master)


@query("risk_ranking", "WN-07 SO-02 PRJ-08 JN-05 PRJ-05", cte("scores") + "SELECT * EXCLUDE (yoy_decline_streak, rev_drawdown) FROM scores", dbl=SCORE_DBL)
def risk_ranking(spark, sf):
    return scores(spark, sf)


@query("dashboard_meta", "DB-01 FLT-07", cte("lines") + """
SELECT min(order_date) AS data_from, max(order_date) AS data_to, count(*) AS order_lines,
  count(*) FILTER (is_outlier) AS outlier_lines_excluded, string_agg(DISTINCT quarter, ',' ORDER BY quarter) AS quarters,
  (SELECT count(*) FROM master) AS partners, 'AFRICA,AMERICA,ASIA,EUROPE,MIDDLE EAST' AS regions,
  'Platinum,Gold,Silver,Business' AS tiers, 'ECONOMY,LARGE,MEDIUM,PROMO,SMALL,STANDARD' AS products,
  'Distributor,Reseller,Service Provider' AS partner_types, 'At risk,Quietly declining,Ramping (new),Stable,Growing' AS segments
FROM lines""")
def dashboard_meta(spark, sf):
    return db.meta(tables(spark, sf))


@query("effective_last_quarter", "FLT-07", cte("base") + "SELECT least(max(quarter), '2000-Q4') AS quarter FROM base")
def effective_last_quarter(spark, sf):
    return db.last_quarter(tables(spark, sf), Selection(last="2000-Q4"))


def _kpi_sql(where, lq, ly, rng, att=True, prod=False):
    w = f"WHERE {where}" if where else ""
    pw = f"AND {where}" if where and not prod else ""
    attq = (f"(SELECT CAST(sum(revenue_usd) AS DOUBLE) / nullif(CAST(sum(target_usd) AS DOUBLE), 0) FROM pq WHERE quarter = '{lq}' AND target_usd IS NOT NULL {pw})"
            if att else "CAST(NULL AS DOUBLE)")
    sc = ("scores WHERE partner_id IN (SELECT partner_id FROM base " + f"{w} AND {rng})") if prod else f"scores {w}"
    return cte("base", "pq", "scores") + f"""
SELECT '{lq}' AS quarter, revenue, revenue_last_year, revenue / nullif(revenue_last_year, 0) - 1 AS yoy, margin / nullif(revenue, 0) * 100 AS margin_pct,
  active_partners, revenue_in_range, {attq} AS attainment, flagged, partners, declining
FROM (SELECT CAST(coalesce(sum(revenue_usd) FILTER (quarter = '{lq}'), 0) AS DOUBLE) AS revenue,
        CAST(coalesce(sum(revenue_usd) FILTER (quarter = '{ly}'), 0) AS DOUBLE) AS revenue_last_year,
        CAST(sum(margin_usd) FILTER (quarter = '{lq}') AS DOUBLE) AS margin,
        count(DISTINCT partner_id) FILTER (quarter = '{lq}') AS active_partners,
        CAST(coalesce(sum(revenue_usd) FILTER ({rng}), 0) AS DOUBLE) AS revenue_in_range FROM base {w}) a
CROSS JOIN (SELECT coalesce(sum(at_risk), 0) AS flagged, count(*) AS partners, count(*) FILTER (segment = 'Quietly declining') AS declining FROM {sc}) s"""


KPI_DBL = "revenue revenue_last_year yoy margin_pct revenue_in_range attainment"


@query("kpis_region_filter", "DB-02 FLT-01 JN-16", _kpi_sql("region IN ('ASIA', 'EUROPE')", "2001-Q1", "2000-Q1", "quarter BETWEEN '2000-Q2' AND '2001-Q1'"),
       dbl=KPI_DBL, big="flagged")
def kpis_region_filter(spark, sf):
    return db.kpis(tables(spark, sf), Selection.of({"region": "ASIA, EUROPE", "from": "2000-Q2", "to": "2001-Q1"}), scores(spark, sf))


@query("kpis_product_filter", "DB-02 JN-06", _kpi_sql("product_family IN ('PROMO')", "2001-Q2", "2000-Q2", "true", att=False, prod=True),
       dbl=KPI_DBL, big="flagged")
def kpis_product_filter(spark, sf):
    return db.kpis(tables(spark, sf), Selection(product_family=("PROMO",)), scores(spark, sf))


def _trend_sql(period, by, keys):
    cols = ", ".join(f"""coalesce(sum(revenue_usd) FILTER ({by} = '{k}'), 0) AS "{k}" """ for k in keys)
    return cte("base") + f"""SELECT {period} AS period, {cols}, sum(revenue_usd) AS total,
  CAST(sum(margin_usd) AS DOUBLE) / CAST(sum(revenue_usd) AS DOUBLE) * 100 AS margin_pct FROM base GROUP BY 1"""


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_sql = _trend_sql("quarter", "region", REGIONS)
_fix = ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in [*REGIONS, "total", "margin_pct"])


@query("trend_quarter_region", "DB-03 AG-06", f"SELECT * REPLACE ({_fix}) FROM ({_sql})")
def trend_quarter_region(spark, sf):
    return db.trend(tables(spark, sf), Selection())


@query("trend_month_tier", "DB-03", _trend_sql("strftime(month, '%Y-%m')", "tier", ["Platinum", "Gold", "Silver", "Business"]),
       dbl="Platinum Gold Silver Business total margin_pct")
def trend_month_tier(spark, sf):
    return db.trend(tables(spark, sf), Selection(), "month", "tier")


def _breakdown_sql(dim, att):
    extra = f""", (SELECT CAST(sum(revenue_usd) AS DOUBLE) / CAST(sum(target_usd) AS DOUBLE) FROM pq WHERE pq.{dim} = a.key
      AND quarter IN ('2000-Q3','2000-Q4','2001-Q1','2001-Q2') AND target_usd IS NOT NULL) AS attainment,
  (SELECT avg(CAST(coalesce(attainment >= 1, false) AS INT)) FROM pq WHERE pq.{dim} = a.key
      AND quarter IN ('2000-Q3','2000-Q4','2001-Q1','2001-Q2') AND target_usd IS NOT NULL) AS pct_partner_quarters_hit""" if att else ""
    return cte("base", "pq") + f"""
SELECT '{dim}' AS dim, a.key, revenue, revenue / sum(revenue) OVER () AS share, margin / revenue * 100 AS margin_pct, partners, order_lines,
  h_now / nullif(h_old, 0) - 1 AS growth_yoy {extra}
FROM (SELECT {dim} AS key, CAST(sum(revenue_usd) FILTER (quarter >= '2000-Q1') AS DOUBLE) AS revenue,
   CAST(sum(margin_usd) FILTER (quarter >= '2000-Q1') AS DOUBLE) AS margin,
   count(DISTINCT partner_id) FILTER (quarter >= '2000-Q1') AS partners, count(*) FILTER (quarter >= '2000-Q1') AS order_lines,
   CAST(sum(revenue_usd) FILTER (quarter IN ('2001-Q1','2001-Q2')) AS DOUBLE) AS h_now,
   CAST(sum(revenue_usd) FILTER (quarter IN ('2000-Q1','2000-Q2')) AS DOUBLE) AS h_old FROM base GROUP BY 1) a"""


BD = "revenue share margin_pct growth_yoy"
for _dim in db.DIMS:
    def _make(dim):
        @query(f"breakdown_{dim}", "DB-04 WN-14" + (" FLT-01" if dim == "region" else ""), _breakdown_sql(dim, dim != "product_family"),
               dbl=BD + (" attainment pct_partner_quarters_hit" if dim != "product_family" else ""))
        def breakdown(spark, sf):
            return db.breakdown(tables(spark, sf), Selection(first="2000-Q1"), dim).withColumn("dim", F.lit(dim))
    _make(_dim)

define("prows", "scores base", """
SELECT s.*, coalesce(r, 0) AS revenue_range, m / nullif(r, 0) * 100 AS margin_pct FROM scores s
LEFT JOIN (SELECT partner_id, CAST(sum(revenue_usd) AS DOUBLE) AS r, CAST(sum(margin_usd) AS DOUBLE) AS m
           FROM base WHERE quarter >= '2000-Q3' GROUP BY 1) b ON s.partner_id = b.partner_id""")
PR = SCORE_DBL + " revenue_range margin_pct"


@query("partner_rows_all", "DB-05 JN-05", cte("prows") + "SELECT * EXCLUDE (yoy_decline_streak, rev_drawdown) FROM prows", dbl=PR)
def partner_rows_all(spark, sf):
    return db.partner_rows(tables(spark, sf), scores(spark, sf), Selection(first="2000-Q3"))


@query("partner_list_page", "DB-05 SO-01 FLT-04", cte("prows") + """
SELECT * EXCLUDE (yoy_decline_streak, rev_drawdown), count(*) OVER () AS total FROM prows WHERE contains(lower(partner_name), '0001') OR contains(CAST(partner_id AS VARCHAR), '0001')
ORDER BY revenue_range DESC NULLS LAST, partner_id LIMIT 25 OFFSET 25""", dbl=PR)
def partner_list_page(spark, sf):
    return db.partners(tables(spark, sf), scores(spark, sf), Selection(first="2000-Q3"), search=" 0001 ", page=2)


@query("partner_list_segment", "DB-05 JN-06 SO-01", cte("prows") + """
SELECT * EXCLUDE (yoy_decline_streak, rev_drawdown), count(*) OVER () AS total FROM prows
WHERE segment = 'Stable' AND partner_id IN (SELECT partner_id FROM base WHERE quarter >= '2000-Q3')
ORDER BY yoy_h1_pct ASC NULLS LAST, partner_id LIMIT 500""", dbl=PR)
def partner_list_segment(spark, sf):
    t = tables(spark, sf)
    every = Selection(first="2000-Q3", product_family=tuple(t.settings.families))
    return db.partners(t, scores(spark, sf), every, segment="Stable", sort="yoy_h1_pct", desc=False, page_size=500)


@query("partner_signals", "DB-06 WN-06", cte("now") + """, long AS (""" + " UNION ALL ".join(
    f"SELECT partner_id, tier, '{k}' AS key, '{v}' AS label, CAST({k} AS DOUBLE) AS value FROM now" for k, v in SIGNAL_LABELS.items())
    + ") SELECT *, median(value) OVER (PARTITION BY tier, key) AS tier_median FROM long", dbl="value tier_median")
def partner_signals(spark, sf):
    return db.partner_signals(score_snapshot(spark, sf))


@query("partner_product_mix", "DB-06 AG-21", cte("base") + """
SELECT partner_id, product_family AS product, revenue, CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER (PARTITION BY partner_id) AS DOUBLE) AS share
FROM (SELECT partner_id, product_family, sum(revenue_usd) AS revenue FROM base WHERE quarter >= '2000-Q3' GROUP BY 1, 2)""", dbl="revenue share")
def partner_product_mix(spark, sf):
    return db.product_mix(stored_or_plain(spark, sf))


@query("partner_detail", "DB-06", cte("master", "scores", "pq") + """
SELECT m.partner_id, m.partner_name, m.region, m.tier, (SELECT risk_rank FROM scores s WHERE s.partner_id = m.partner_id) AS risk_rank,
  (SELECT string_agg(quarter || '=' || CAST(order_lines AS BIGINT), ',' ORDER BY quarter) FROM pq WHERE pq.partner_id = m.partner_id) AS quarterly
FROM master m WHERE partner_id = 18""")
def partner_detail(spark, sf):
    d = db.partner_detail(tables(spark, sf), scores(spark, sf), score_snapshot(spark, sf), 18)
    return d.select("partner_id", "partner_name", "region", "tier", "score.risk_rank",
                    F.array_join(F.transform("quarterly", lambda q: F.concat(q["quarter"], F.lit("="), q["order_lines"].cast("string"))), ",").alias("quarterly"))


_edges = list(zip(HEALTH_EDGES[:-1], HEALTH_EDGES[1:]))


@query("health_histogram", "AG-10 DB-07", cte("scores") + " UNION ALL ".join(
    f"""SELECT {a} AS "from", {b} AS "to", count(*) FILTER (health_score >= {a} AND health_score {'<=' if b == 100 else '<'} {b}) AS partners FROM scores"""
    for a, b in _edges), dbl="from to")
def health_histogram(spark, sf):
    return db.health_histogram(scores(spark, sf))


@query("segment_table", "DB-07", cte("scores") + """
SELECT segment, count(*) AS partners, sum(revenue_last_q) AS revenue_q, avg(health_score) AS avg_health FROM scores GROUP BY 1""", dbl="revenue_q avg_health")
def segment_table(spark, sf):
    return db.segment_table(scores(spark, sf))


@query("risk_headline", "DB-07", cte("scores") + """
SELECT count(*) AS partners, count(*) FILTER (at_risk = 1) AS flagged, sum(p_leave) AS expected_leavers,
  sum(revenue_avg_4q) FILTER (at_risk = 1) AS flagged_revenue_avg_4q,
  sum(revenue_avg_4q) FILTER (at_risk = 1) / sum(revenue_avg_4q) AS flagged_share_of_revenue FROM scores""",
       dbl="expected_leavers flagged_revenue_avg_4q flagged_share_of_revenue")
def risk_headline(spark, sf):
    return db.risk_headline(scores(spark, sf))


@query("declining_partners", "SO-06", cte("scores") + "SELECT * FROM scores WHERE yoy_decline_streak >= 4", dbl=SCORE_DBL + " yoy_decline_streak rev_drawdown")
def declining_partners(spark, sf):
    return db.declining(scores(spark, sf), score_snapshot(spark, sf))


@query("partner_json_rows", "SRC-11", cte("ps") + """
SELECT '{"partner_id":' || partner_id || ',"last_order":' || coalesce('"' || last_order || '"', 'null') || ',"tier":"' || tier || '","lines_last_q":'
  || coalesce(CAST(CAST(lines_last_q AS BIGINT) AS VARCHAR), 'null') || '}' AS document FROM ps""")
def partner_json_rows(spark, sf):
    return db.to_json_rows(tables(spark, sf).partner_summary.select("partner_id", "last_order", "tier", "lines_last_q"))


@query("active_partner_semi_join", "JN-06", cte("base", "master") + """
SELECT partner_id, region, tier FROM master WHERE partner_id IN (SELECT partner_id FROM base WHERE product_family = 'PROMO')""")
def active_partner_semi_join(spark, sf):
    t = tables(spark, sf)
    return t.master.join(t.base.where("product_family = 'PROMO'").select("partner_id"), "partner_id", "left_semi").select("partner_id", "region", "tier")


@query("rollup_pivots", "AG-06", cte("base", "pq") + """
SELECT quarter, 'revenue' AS measure, """ + ", ".join(f"""sum(revenue_usd) FILTER (region = '{r}') AS {r.split()[0].lower()}""" for r in REGIONS)
       + " FROM base GROUP BY 1 UNION ALL SELECT quarter, 'target', " + ", ".join(f"""sum(target_usd) FILTER (region = '{r}')""" for r in REGIONS)
       + " FROM pq GROUP BY 1", dbl="africa america asia europe middle")
def rollup_pivots(spark, sf):
    t = tables(spark, sf)
    names = [F.col(f"`{r}`").alias(r.split()[0].lower()) for r in REGIONS]
    rev = t.base.groupBy("quarter").pivot("region", REGIONS).agg(F.sum("revenue_usd")).select("quarter", F.lit("revenue").alias("measure"), *names)
    tgt = t.partner_quarter.groupBy("quarter").pivot("region", REGIONS).agg(F.sum("target_usd")).select("quarter", F.lit("target").alias("measure"), *names)
    return rev.unionByName(tgt)


