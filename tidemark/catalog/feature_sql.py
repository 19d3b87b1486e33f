"""SQL twin of the feature panel: plain conditional aggregation over the partner-quarter and partner-month tables."""
from __future__ import annotations

from .prelude import define

D = "CAST({} AS DOUBLE)"
FAMILIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def lag(src, col, ks, name):
    return ", ".join(f"max(CASE WHEN c - {src}.qi = {k} THEN CAST({col} AS DOUBLE) END) AS {name}{k}" for k in ks)


define("cut", "", "SELECT *, CONCAT(c // 4, '-Q', c % 4 + 1) AS cutoff, "
       "CAST(make_date(c // 4, (c % 4) * 3 + 1, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS cend "
       "FROM (SELECT unnest(range(7983, 8006)) AS c)")
define("pop", "master cut", "SELECT m.*, cutoff, c, cend FROM master m CROSS JOIN cut WHERE onboarded_date <= cend")
define("qlag", "pop pq", f"""
SELECT p.partner_id, p.c, {lag('q', 'revenue_usd', range(10), 'r')}, {lag('q', 'order_lines', range(6), 'n')},
  {lag('q', 'target_usd', range(10), 't')}, {lag('q', 'margin_usd', range(4), 'g')}, {lag('q', 'n_products', range(1), 'np')},
  max(CASE WHEN c - q.qi = -1 THEN CAST(revenue_usd AS DOUBLE) END) AS r_next, max(CASE WHEN c - q.qi = -1 THEN order_lines END) AS n_next,
  max(CASE WHEN c - q.qi = -2 THEN CAST(revenue_usd AS DOUBLE) END) AS r_next2, max(CASE WHEN c - q.qi = -2 THEN order_lines END) AS n_next2
FROM pop p LEFT JOIN pq q ON p.partner_id = q.partner_id GROUP BY 1, 2""")


def mlag(col, name):
    return ", ".join(
        f"max(CASE WHEN datediff('month', month, date_trunc('month', cend)) = {k} THEN CAST({col} AS DOUBLE) END) AS {name}{k}"
        for k in range(6))


define("mlag", "pop pm", f"""
SELECT p.partner_id, p.c, {mlag('revenue_usd', 'mr')}, {mlag('order_lines', 'ml')}
FROM pop p LEFT JOIN pm ON p.partner_id = pm.partner_id GROUP BY 1, 2""")
define("dayfeat", "pop base", """
SELECT partner_id, c, max(order_date) AS last_order, count(*) FILTER (order_date >= date_trunc('month', cend) - INTERVAL 5 MONTH) AS d6
FROM (SELECT DISTINCT p.partner_id, c, cend, order_date FROM pop p JOIN base b ON p.partner_id = b.partner_id AND order_date <= cend)
GROUP BY 1, 2""")
define("gapfeat", "pop base", """
SELECT partner_id, c, median(gap) AS gap FROM (
  SELECT partner_id, c, order_date - lag(order_date) OVER (PARTITION BY partner_id, c ORDER BY order_date) AS gap
  FROM (SELECT DISTINCT p.partner_id, c, order_date FROM pop p JOIN base b ON p.partner_id = b.partner_id
        AND order_date <= cend AND order_date > cend - INTERVAL 365 DAY)) GROUP BY 1, 2""")
define("prodfeat", "pop base", "SELECT p.partner_id, c, "
       "count(DISTINCT product_family) FILTER (c - qi IN (0, 1)) AS np2, count(DISTINCT product_family) FILTER (c - qi IN (2, 3)) AS npp, "
       "coalesce(CAST(sum(revenue_usd) FILTER (c - qi IN (0, 1)) AS DOUBLE), 0) AS ftot, "
       + ", ".join(f"coalesce(CAST(sum(revenue_usd) FILTER (c - qi IN (0, 1) AND product_family = '{f}') AS DOUBLE), 0) AS f_{f.lower()}" for f in FAMILIES)
       + " FROM pop p JOIN base b ON p.partner_id = b.partner_id AND order_date <= cend GROUP BY 1, 2")


def sym(a, b):
    return f"CASE WHEN {a} + {b} > 0 THEN ({a} - ({b})) / ({a} + {b}) END"


def avg_(cols):
    return f"(SELECT avg(v) FROM (VALUES {', '.join(f'({c})' for c in cols)}) AS x(v))"


def lavg(cols):
    return f"list_avg([{', '.join(cols)}])"


def lsum(cols):
    return f"list_sum([{', '.join(cols)}])"


def cap(e, c=5):
    return f"CASE WHEN ({e}) IS NOT NULL THEN least({e}, {c}.0) END"


def pos(a, b):
    return f"({a}) / CASE WHEN {b} > 0 THEN {b} END"


def cv(cols, k):
    L = f"[{', '.join(cols)}]"
    return f"CASE WHEN list_count({L}) >= {k} AND list_avg({L}) > 0 THEN list_stddev_pop({L}) / list_avg({L}) END"


def slope(cols):
    n = len(cols)
    xs = [i - (n - 1) / 2 for i in range(n)]
    return "(" + " + ".join(f"({c}) * ({x})" for c, x in zip(cols, xs)) + f") / {sum(x * x for x in xs)}"


def nslope(cols):
    m = "((" + " + ".join(cols) + f") / {len(cols)}.0)"
    return f"({slope(cols)}) / CASE WHEN {m} > 0 THEN {m} END"


def streak(conds):
    return "CASE " + " ".join(f"WHEN NOT coalesce({c}, false) THEN {i}" for i, c in enumerate(conds)) + f" ELSE {len(conds)} END"


def cnt(conds):
    return " + ".join(f"CAST(coalesce({c}, false) AS INT)" for c in conds)


R = [f"r{k}" for k in range(10)]
N = [f"n{k}" for k in range(6)]
T = [f"t{k}" for k in range(10)]
G = [f"g{k}" for k in range(4)]
MR = [f"mr{k}" for k in range(6)]
ML = [f"ml{k}" for k in range(6)]
ATT = [f"(r{k} / t{k})" for k in range(10)]
MA2 = [f"((r{k} + r{k + 1}) / 2)" for k in range(9)]
YOY = [sym(f"r{k}", f"r{k + 4}") for k in range(6)]
DOWN = [f"({y}) < -0.10" for y in YOY]
Z = lambda cols: "(" + " + ".join(f"coalesce({c}, 0)" for c in cols) + ")"
MARGIN = lambda ks: f"({pos(lsum([f'g{k}' for k in ks]), lsum([f'r{k}' for k in ks]))} * 100)"
V3 = f"({Z(MR[:3])} / CASE WHEN {Z(ML[:3])} > 0 THEN {Z(ML[:3])} END)"
V6 = f"({Z(MR[3:])} / CASE WHEN {Z(ML[3:])} > 0 THEN {Z(ML[3:])} END)"
TEN = "round((cend - onboarded_date) / 30.44, 1)"
SH = {f: f"(f_{f.lower()} / CASE WHEN ftot > 0 THEN ftot END)" for f in FAMILIES}

FEATURE_EXPR = {
    "rev_q1_log": "ln(1 + r0)", "rev_avg_2q_log": f"ln(1 + {lavg(R[:2])})", "rev_avg_4q_log": f"ln(1 + {lavg(R[:4])})",
    "rev_growth_qoq": sym("r0", "r1"), "rev_growth_2q": sym("(r0 + r1)", "(r2 + r3)"),
    "rev_q1_vs_prev4q": cap(pos("r0", lavg(R[1:5]))), "rev_cv_4q": cv(R[:4], 2), "rev_cv_6m": cv(MR, 3),
    "rev_slope_4q": nslope(R[3::-1]), "rev_slope_6m": nslope(MR[::-1]),
    "rev_drawdown": pos(MA2[0], f"greatest({', '.join(MA2)})"),
    "order_days_6m": "coalesce(d6, 0)", "lines_per_month_6m": lavg(ML),
    "active_month_share_6m": f"({cnt([x + ' > 0' for x in ML])}) / nullif(list_count([{', '.join(ML)}]), 0)",
    "lines_last_month": "ml0", "lines_3m_vs_prev3m": sym(lsum(ML[:3]), lsum(ML[3:])),
    "lines_q1_vs_prev4q": cap(pos("n0", lavg(N[1:5]))), "days_since_last_order": "cend - last_order",
    "typical_gap_days": "gap", "recency_vs_gap": "CASE WHEN gap IS NOT NULL THEN least((cend - last_order) / greatest(gap, 1), 20.0) END",
    "avg_line_value_6m_log": f"ln(1 + {Z(MR)} / CASE WHEN {Z(ML)} > 0 THEN {Z(ML)} END)",
    "line_value_3m_vs_prev3m": sym(V3, V6), "never_ordered": "CAST(last_order IS NULL AS INT)",
    "att_q1": cap(ATT[0]), "att_avg_2q": cap(pos(lsum(R[:2]), lsum(T[:2]))), "att_avg_4q": cap(pos(lsum(R[:4]), lsum(T[:4]))),
    "att_trend_4q": slope([cap(a) for a in ATT[3::-1]]), "att_miss_streak": streak([a + " < 1" for a in ATT]),
    "att_misses_4q": cnt([a + " < 1" for a in ATT[:4]]), "target_yoy": sym("t0", "t4"),
    "margin_pct_4q": MARGIN(range(4)), "margin_pct_2q": MARGIN(range(2)),
    "margin_trend": f"{MARGIN(range(2))} - {MARGIN((2, 3))}",
    "margin_usd_4q_log": f"ln(1 + greatest({Z(G)}, 0))",
    "n_products_q1": "np0", "n_products_2q": "coalesce(np2, 0)", "n_products_change": "coalesce(np2, 0) - coalesce(npp, 0)",
    **{f"share_{f.lower()}_2q": SH[f] for f in FAMILIES},
    "product_hhi_2q": " + ".join(f"{s} * {s}" for s in SH.values()),
    "yoy_q1": YOY[0], "yoy_2q": sym("(r0 + r1)", "(r4 + r5)"), "lines_yoy_2q": sym("(n0 + n1)", "(n4 + n5)"),
    "yoy_down_quarters_4q": cnt(DOWN[:4]), "yoy_decline_streak": streak(DOWN),
    "tier_rank": "CASE tier WHEN 'Platinum' THEN 3 WHEN 'Gold' THEN 2 WHEN 'Silver' THEN 1 ELSE 0 END",
    "tenure_months": TEN, "is_ramping": f"CAST({TEN} < 12 AS INT)", "quarters_observed": f"list_count([{', '.join(R)}])",
}
BASE4 = lavg(R[:4])
TOK = lambda share, r="r_next", n="n_next": f"(coalesce({n} = 0, false) OR coalesce({r} < {share} * {BASE4}, false))"
LABEL_EXPR = {
    "baseline_4q_revenue": BASE4, "next_q_revenue": "CASE WHEN c + 1 <= 8005 THEN r_next END",
    "left_zero": "CASE WHEN c + 1 <= 8005 THEN CAST(coalesce(n_next = 0, false) AS BIGINT) END",
    "left_token": f"CASE WHEN c + 1 <= 8005 THEN CAST({TOK(0.1)} AS BIGINT) END",
    "left_persistent": f"CASE WHEN c + 2 <= 8005 THEN CAST({TOK(0.1)} AND {TOK(0.1, 'r_next2', 'n_next2')} AS BIGINT) END",
}
NUM = list(FEATURE_EXPR)
define("lagged", "qlag mlag dayfeat gapfeat prodfeat", """
SELECT p.*, q.* EXCLUDE (partner_id, c), ml.* EXCLUDE (partner_id, c), d.* EXCLUDE (partner_id, c),
       g.gap, f.* EXCLUDE (partner_id, c)
FROM pop p JOIN qlag q ON p.partner_id = q.partner_id AND p.c = q.c JOIN mlag ml ON p.partner_id = ml.partner_id AND p.c = ml.c
LEFT JOIN dayfeat d ON p.partner_id = d.partner_id AND p.c = d.c LEFT JOIN gapfeat g ON p.partner_id = g.partner_id AND p.c = g.c
LEFT JOIN prodfeat f ON p.partner_id = f.partner_id AND p.c = f.c""")
define("raw0", "lagged", "SELECT partner_id, cutoff, c, partner_name, country, partner_type, tier, region, "
       + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in FEATURE_EXPR.items()) + ", "
       + ", ".join(f"{e} AS {n}" for n, e in LABEL_EXPR.items()) + " FROM lagged")
define("raw1", "raw0", """
SELECT *, margin_pct_4q - median(margin_pct_4q) OVER (PARTITION BY cutoff, tier) AS margin_vs_tier,
       yoy_2q - median(yoy_2q) OVER (PARTITION BY cutoff, region) AS yoy_2q_vs_region FROM raw0""")
WINS = ["rev_cv_4q", "rev_cv_6m", "rev_slope_4q", "rev_slope_6m", "att_trend_4q", "margin_trend", "margin_vs_tier"]
define("panel", "raw1", "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {w} IS NOT NULL THEN least(greatest({w}, quantile_cont({w}, 0.01) OVER (PARTITION BY cutoff)), "
    f"quantile_cont({w}, 0.99) OVER (PARTITION BY cutoff)) END AS {w}" for w in WINS) + ") FROM raw1")
ALL_NUM = NUM + ["margin_vs_tier", "yoy_2q_vs_region"]
define("hist", "panel", "SELECT * FROM panel WHERE cutoff < '2001-Q2'")
define("now", "panel", "SELECT * FROM panel WHERE cutoff = '2001-Q2'")
