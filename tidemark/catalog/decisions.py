"""Decision, evaluation and calibration queries on arithmetic probabilities."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import decisions as dc
from ..operators import intake, stats
from ..sources.fixtures import CLASSES, KNOWN_PRODUCTS, Desk
from ..session import cut_lineage
from .prelude import cte, define
from .registry import query

W = "CASE {} WHEN 'P1' THEN 8.0 WHEN 'P2' THEN 2.0 ELSE 1.0 END"
A = "CASE {} WHEN 'P1' THEN 1.0 WHEN 'P2' THEN 0.5 ELSE 0.3 END"
TEMP = 1.5
TEAMS = CLASSES["assigned_team"]

define("cal", "proba", f"""
SELECT ticket_id, target, class, truth, e / sum(e) OVER (PARTITION BY ticket_id, target) AS p
FROM (SELECT *, exp(ln(greatest(p, 1e-12)) / {TEMP}) AS e FROM proba)""")
define("top", "proba", """
SELECT ticket_id, target, class AS predicted, p AS conf, truth FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id, target ORDER BY p DESC, class) AS rn FROM proba) WHERE rn = 1""")
define("caltop", "cal", """
SELECT ticket_id, target, class AS predicted, p AS conf, truth FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id, target ORDER BY p DESC, class) AS rn FROM cal) WHERE rn = 1""")


def ec(src: str, pok: str = "max(p) FILTER (target = 'assigned_team')", join: str = "") -> str:
    return f"""SELECT ticket_id, p_ok, (1 - p_ok) * w AS e_route, e_abstain, (1 - p_ok) * w - e_abstain AS savings FROM
 (SELECT ticket_id, {pok} AS p_ok, sum(p * CAST({W.format('class')} AS DOUBLE)) FILTER (target = 'priority') AS w,
    sum(p * CAST({A.format('class')} AS DOUBLE)) FILTER (target = 'priority') AS e_abstain FROM {src} {join} GROUP BY ticket_id)"""


define("pcorr", "caltop proba2", """
SELECT c.ticket_id, (c.conf + q.p) / 2 AS pc FROM caltop c JOIN proba2 q ON c.ticket_id = q.ticket_id AND q.target = 'assigned_team' AND q.class = c.predicted
WHERE c.target = 'assigned_team'""")
define("ecraw", "proba", ec("proba"))
define("eccal", "cal", ec("cal"))
define("eccorr", "cal pcorr", ec("cal", "any_value(pc)", "JOIN pcorr USING (ticket_id)"))
define("decin", "ecraw tickets", """
SELECT e.*, t.product, t.priority, product NOT IN (""" + ", ".join(f"'{p}'" for p in KNOWN_PRODUCTS) + """) OR length(trim(body)) < 20 AS guarded
FROM ecraw e JOIN tickets t USING (ticket_id)""")


def calibrated(desk):
    return stats.temperature(desk.proba, ["ticket_id", "target"], F.lit(TEMP))


def p_correct(desk):
    f = dc.correctness_features(calibrated(desk), desk.tickets, desk.proba_second)
    return f.select("ticket_id", ((F.col("p_ok") + F.col("e1_p_pred")) / 2).alias("p_ok"))


def scored(desk):
    guarded = intake.guards(desk.tickets, KNOWN_PRODUCTS).select("ticket_id", "guard_flags", "guarded")
    return dc.expected_costs(desk.proba).join(guarded, "ticket_id")


def policies(desk):
    raw = cut_lineage(desk.proba)
    cal = cut_lineage(stats.temperature(raw, ["ticket_id", "target"], F.lit(TEMP)))
    f = dc.correctness_features(cal, desk.tickets, desk.proba_second)
    pc = f.select("ticket_id", ((F.col("p_ok") + F.col("e1_p_pred")) / 2).alias("p_ok"))
    return dc.policy_frame(raw, cal, pc, desk.tickets)


@query("probability_frame_checks", "SRC-08", cte("proba") + """
SELECT 'invalid probability' AS rule, count(*) FILTER (isnan(p) OR p < 0 OR p > 1e308) AS n FROM proba
UNION ALL SELECT 'row does not sum to 1', count(*) FROM (SELECT 1 FROM proba GROUP BY ticket_id, target HAVING abs(sum(p) - 1) > 1e-6)
UNION ALL SELECT 'wrong class set', count(*) FROM (SELECT 1 FROM proba GROUP BY ticket_id, target
   HAVING count(DISTINCT class) <> CASE target WHEN 'assigned_team' THEN 5 ELSE 4 END OR count(*) <> count(DISTINCT class))
UNION ALL SELECT 'id set differs', (SELECT count(*) FROM (SELECT ticket_id FROM tickets EXCEPT SELECT ticket_id FROM proba)) + (SELECT count(*) FROM (SELECT ticket_id FROM proba EXCEPT SELECT ticket_id FROM tickets))""")
def probability_frame_checks(spark, sf):
    d = Desk(spark, sf)
    return dc_checks(d.proba, d.tickets)


def dc_checks(proba, tickets):
    from ..plans.triage import check_probabilities
    return check_probabilities(proba, tickets, CLASSES)


@query("cost_table_exposure", "SRC-05", cte("tickets") + f"""
SELECT priority AS true_priority, count(*) AS tickets, 0.0 AS correct, any_value({W.format('priority')}) AS misroute, any_value({A.format('priority')}) AS abstain,
  sum({W.format('priority')}) AS exposure FROM tickets GROUP BY 1""", dbl="correct misroute abstain exposure")
def cost_table_exposure(spark, sf):
    n = Desk(spark, sf).tickets.groupBy(F.col("priority").alias("true_priority")).agg(F.count(F.lit(1)).alias("tickets"))
    return n.join(F.broadcast(dc.cost_table(spark)), "true_priority").withColumn("exposure", F.col("tickets") * F.col("misroute"))


@query("expected_costs", "DE-01", cte("ecraw") + "SELECT * FROM ecraw", dbl="p_ok e_route e_abstain savings")
def expected_costs(spark, sf):
    return dc.expected_costs(Desk(spark, sf).proba)


@query("escalation_flags", "PRJ-16", cte("tickets") + "SELECT ticket_id, sentiment = 'Angry' OR (sentiment = 'Frustrated' AND priority IN ('P1', 'P2')) AS escalation FROM tickets")
def escalation_flags(spark, sf):
    return Desk(spark, sf).tickets.select("ticket_id", dc.escalation(F.col("priority"), F.col("sentiment")).alias("escalation"))


define("plabel", "proba", """
SELECT ticket_id, max(p) FILTER (class = 'P1') AS p1, CASE WHEN max(p) FILTER (class = 'P1') >= 0.225 THEN 'P1' ELSE
  (SELECT class FROM proba q WHERE q.ticket_id = o.ticket_id AND target = 'priority' AND class <> 'P1' ORDER BY p DESC, class LIMIT 1) END AS priority
FROM proba o WHERE target = 'priority' GROUP BY ticket_id""")


@query("priority_threshold_label", "PRJ-17", cte("plabel") + "SELECT * FROM plabel", dbl="p1")
def priority_threshold_label(spark, sf):
    return dc.priority_label(Desk(spark, sf).proba)


@query("temperature_softmax", "PRJ-20", cte("cal") + "SELECT * FROM cal", dbl="p")
def temperature_softmax(spark, sf):
    return calibrated(Desk(spark, sf))


@query("decide_no_cap", "SO-04", cte("decin") + "SELECT ticket_id, savings, guarded, CAST(guarded OR savings > 0 AS BIGINT) AS abstain FROM decin", dbl="savings")
def decide_no_cap(spark, sf):
    return dc.decide(scored(Desk(spark, sf))).select("ticket_id", "savings", "guarded", "abstain")


CAP_SQL = cte("decin") + """,
r AS (SELECT *, row_number() OVER (ORDER BY guarded DESC, savings DESC, ticket_id) AS rn, row_number() OVER (ORDER BY guarded DESC, e_route DESC, ticket_id) AS rg,
  floor({cap} * count(*) OVER () + 1e-9) AS slots FROM decin), d AS (SELECT *, guarded OR (savings > 0 AND rn <= slots) AS ab FROM r)
SELECT ticket_id, savings, guarded, CAST({expr} AS BIGINT) AS abstain FROM d"""


@query("decide_with_cap", "SO-04 SO-03", CAP_SQL.format(cap=0.15, expr="ab"), dbl="savings")
def decide_with_cap(spark, sf):
    return dc.decide(scored(Desk(spark, sf)), fv.MAX_ABSTAIN_RATE).select("ticket_id", "savings", "guarded", "abstain")


@query("decide_hard_cap", "SO-05", CAP_SQL.format(cap=0.05, expr="CASE WHEN sum(CAST(ab AS INT)) OVER () > slots THEN ab AND guarded AND rg <= slots ELSE ab END"), dbl="savings")
def decide_hard_cap(spark, sf):
    return dc.decide_hard_cap(scored(Desk(spark, sf)), 0.05).select("ticket_id", "savings", "guarded", "abstain")


define("truthrow", "top tickets", """
SELECT t.ticket_id, t.priority, x.predicted, x.predicted = t.assigned_team AS correct, x.conf, t.assigned_team FROM tickets t JOIN top x ON t.ticket_id = x.ticket_id AND x.target = 'assigned_team'""")


@query("realised_costs", "DE-02", cte("truthrow", "decin") + f"""
SELECT t.ticket_id, t.priority, correct, d.savings > 0 AS abstain, CASE WHEN d.savings > 0 THEN {A.format('t.priority')} WHEN correct THEN 0.0 ELSE {W.format('t.priority')} END AS cost
FROM truthrow t JOIN decin d USING (ticket_id)""", dbl="cost")
def realised_costs(spark, sf):
    return _routed(Desk(spark, sf)).withColumn("cost", dc.realized_cost(F.col("abstain"), F.col("correct"), F.col("priority")))


def _routed(d):
    top = stats.top_class(d.proba.where("target = 'assigned_team'"), ["ticket_id"])
    x = d.tickets.select("ticket_id", "priority", "assigned_team").join(top.select("ticket_id", "predicted"), "ticket_id")
    s = dc.expected_costs(d.proba).select("ticket_id", (F.col("savings") > 0).alias("abstain"))
    return x.join(s, "ticket_id").select("ticket_id", "priority", (F.col("predicted") == F.col("assigned_team")).alias("correct"), "abstain")


@query("abstention_efficiency", "DE-03", cte("truthrow", "decin") + f""",
r AS (SELECT t.priority, correct, d.savings > 0 AS ab FROM truthrow t JOIN decin d USING (ticket_id)), b AS (SELECT * FROM r UNION ALL SELECT 'ALL', correct, ab FROM r),
g AS (SELECT priority AS p0, correct, ab, {W.format('priority')} AS w, {A.format('priority')} AS a FROM r)
SELECT priority, count(*) FILTER (ab) AS abstains, count(*) FILTER (ab AND NOT correct) AS caught,
  CAST(count(*) FILTER (ab AND NOT correct) AS DOUBLE) / nullif(count(*) FILTER (ab), 0) AS hit_rate,
  (SELECT coalesce(sum(w) FILTER (ab AND NOT correct), 0) - coalesce(sum(a) FILTER (ab), 0) FROM g WHERE b.priority = 'ALL' OR g.p0 = b.priority) AS net_gain
FROM b GROUP BY priority""", dbl="hit_rate net_gain")
def abstention_efficiency(spark, sf):
    return dc.abstention_efficiency(_routed(Desk(spark, sf)))


def _policy_cte() -> str:
    return cte("caltop", "tickets", "ecraw", "eccal", "eccorr", "pcorr") + f""",
x AS (SELECT t.ticket_id, t.priority, c.predicted = t.assigned_team AS correct, c.conf, r.savings AS sc, l.savings AS sd, f.savings AS sf, p.pc
      FROM tickets t JOIN caltop c ON t.ticket_id = c.ticket_id AND c.target = 'assigned_team' JOIN ecraw r ON t.ticket_id = r.ticket_id JOIN eccal l ON t.ticket_id = l.ticket_id
      JOIN eccorr f ON t.ticket_id = f.ticket_id JOIN pcorr p ON t.ticket_id = p.ticket_id),
s AS (SELECT 'a_no_abstain' AS policy, ticket_id, priority, correct, CAST(NULL AS DOUBLE) AS score FROM x
  UNION ALL SELECT 'b_naive_low_conf', ticket_id, priority, correct, -conf FROM x UNION ALL SELECT 'c_expcost_raw', ticket_id, priority, correct, sc FROM x
  UNION ALL SELECT 'd_expcost_cal', ticket_id, priority, correct, sd FROM x UNION ALL SELECT 'e_oracle_floor', ticket_id, priority, correct, CASE WHEN NOT correct THEN CAST({W.format('priority')} AS DOUBLE) END FROM x
  UNION ALL SELECT 'f_expcost_pcorrect', ticket_id, priority, correct, sf FROM x UNION ALL SELECT 'g_naive_low_pcorrect', ticket_id, priority, correct, -pc FROM x),
rk AS (SELECT * REPLACE (round(score, 12) AS score), row_number() OVER (PARTITION BY policy ORDER BY round(score, 12) DESC NULLS LAST, ticket_id) AS rn, count(*) OVER (PARTITION BY policy) AS n FROM s),
pf AS (SELECT *, rn <= floor(0.15 * n + 1e-9) AND score IS NOT NULL AND (policy NOT IN ('c_expcost_raw', 'd_expcost_cal', 'f_expcost_pcorrect') OR score > 0) AS ab FROM rk),
pt AS (SELECT *, CASE WHEN ab THEN {A.format('priority')} WHEN correct THEN 0.0 ELSE {W.format('priority')} END AS cost,
  CASE WHEN correct THEN 0.0 ELSE {W.format('priority')} END AS routed, {A.format('priority')} AS acost FROM pf)
"""


@query("routing_policies", "DE-04", _policy_cte() + "SELECT policy, avg(cost) AS mean_cost, avg(CAST(ab AS INT)) AS abstain_rate, count(*) FILTER (ab) AS n_abstain, "
       + ", ".join(f"count(*) FILTER (ab AND priority = '{p}') AS abst_{p}" for p in fv.PRIORITIES) + ", "
       + ", ".join(f"count(*) FILTER (NOT ab AND NOT correct AND priority = '{p}') AS misr_{p}" for p in fv.PRIORITIES) + " FROM pt GROUP BY 1", dbl="mean_cost abstain_rate")
def routing_policies(spark, sf):
    return dc.policy_table(policies(Desk(spark, sf)))


@query("cost_curve", "DE-05", _policy_cte() + """,
rates AS (SELECT round(i * 0.005, 3) AS abstain_rate FROM (SELECT unnest(range(0, 31)) AS i))
SELECT policy, CAST(abstain_rate AS DOUBLE) AS abstain_rate, any_value(floor(CAST(abstain_rate AS DOUBLE) * n + 1e-9)) AS n_abstain,
  avg(CASE WHEN rn <= floor(CAST(abstain_rate AS DOUBLE) * n + 1e-9) THEN acost ELSE routed END) AS mean_cost
FROM pt CROSS JOIN rates WHERE policy IN ('b_naive_low_conf', 'c_expcost_raw', 'd_expcost_cal') GROUP BY 1, 2""", dbl="abstain_rate mean_cost", big="n_abstain")
def cost_curve(spark, sf):
    return dc.cost_curve(policies(Desk(spark, sf)))


@query("policy_bootstrap", "DE-06")
def policy_bootstrap(spark, sf):
    f = policies(Desk(spark, sf)).select("ticket_id", "policy", "cost")
    base = f.where("policy = 'b_naive_low_conf'").select("ticket_id", F.col("cost").alias("_base"))
    d = f.where(F.col("policy").isin("d_expcost_cal", "f_expcost_pcorrect", "g_naive_low_pcorrect")).join(base, "ticket_id")
    return stats.mean_difference_bootstrap(d.withColumn("d", F.round(F.col("cost") - F.col("_base"), 9)), ["policy"], "d")


define("conf", "top", "SELECT target, truth AS actual, predicted, count(*) AS n FROM top GROUP BY 1, 2, 3")
define("rep", "conf", """
SELECT target, class, support, predicted, tp, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0 END AS recall, 2.0 * tp / (support + predicted) AS f1
FROM (SELECT target, class, coalesce(sum(n) FILTER (side = 't'), 0) AS support, coalesce(sum(n) FILTER (side = 'p'), 0) AS predicted, coalesce(sum(n) FILTER (side = 't' AND hit), 0) AS tp
      FROM (SELECT target, actual AS class, 't' AS side, actual = predicted AS hit, n FROM conf UNION ALL SELECT target, predicted, 'p', actual = predicted, n FROM conf) GROUP BY 1, 2)""")


@query("confusion_cells", "DE-07 AG-12", cte("conf") + "SELECT * FROM conf")
def confusion_cells(spark, sf):
    return stats.confusion(stats.top_class(Desk(spark, sf).proba, ["ticket_id", "target"]), ["target"], "truth", "predicted")


def cells(d):
    return stats.confusion(stats.top_class(d.proba, ["ticket_id", "target"]), ["target"], "truth", "predicted")


@query("class_report", "DE-07", cte("rep") + "SELECT * FROM rep", dbl="precision recall f1", big="support predicted tp")
def class_report(spark, sf):
    return stats.class_report(cells(Desk(spark, sf)), ["target"])


@query("macro_f1", "DE-07", cte("rep") + "SELECT target, avg(f1) AS macro_f1, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) AS accuracy FROM rep GROUP BY 1", dbl="macro_f1 accuracy")
def macro_f1(spark, sf):
    return stats.macro_f1(cells(Desk(spark, sf)), ["target"])


@query("probability_losses", "DE-08", cte("proba") + """
SELECT target, sum(-ln(greatest(p, 1e-12))) FILTER (class = truth) / count(*) FILTER (class = truth) AS log_loss,
  sum((p - CAST(class = truth AS INT)) ** 2) / count(*) FILTER (class = truth) AS brier FROM proba GROUP BY 1""", dbl="log_loss brier")
def probability_losses(spark, sf):
    return stats.proba_losses(Desk(spark, sf).proba, ["target"])


define("relb", "top", "SELECT target, least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS mean_conf, avg(CAST(predicted = truth AS INT)) AS accuracy FROM top GROUP BY 1, 2")


@query("reliability_table", "DE-08", cte("relb") + "SELECT * FROM relb", dbl="mean_conf accuracy", big="bin")
def reliability_table(spark, sf):
    return stats.reliability(stats.top_class(Desk(spark, sf).proba, ["ticket_id", "target"]), ["target"])


@query("calibration_error", "DE-08", cte("relb") + "SELECT target, sum(abs(accuracy - mean_conf) * n) / sum(n) AS ece FROM relb GROUP BY 1", dbl="ece")
def calibration_error(spark, sf):
    return stats.ece(stats.top_class(Desk(spark, sf).proba, ["ticket_id", "target"]), ["target"])


def _team_conf(d):
    top = stats.top_class(d.proba, ["ticket_id", "target"])
    team = top.where("target = 'assigned_team'").select("ticket_id", "conf", "predicted", "truth")
    prio = top.where("target = 'priority'").select("ticket_id", F.col("predicted").alias("pred_priority"), F.col("truth").alias("true_priority"))
    return team.join(prio, "ticket_id")


@query("conditional_reliability", "DE-09", cte("top") + """,
j AS (SELECT a.conf, a.predicted = a.truth AS ok, b.predicted AS pred_priority, b.truth AS true_priority FROM top a JOIN top b ON a.ticket_id = b.ticket_id AND a.target = 'assigned_team' AND b.target = 'priority')
SELECT 'true' AS side, true_priority AS priority, count(*) AS n, avg(CAST(ok AS INT)) AS team_acc, avg(conf) AS mean_conf, avg(CAST(ok AS INT)) - avg(conf) AS acc_minus_conf FROM j GROUP BY 2
UNION ALL SELECT 'predicted', pred_priority, count(*), avg(CAST(ok AS INT)), avg(conf), avg(CAST(ok AS INT)) - avg(conf) FROM j GROUP BY 2""", dbl="team_acc mean_conf acc_minus_conf")
def conditional_reliability(spark, sf):
    x = _team_conf(Desk(spark, sf))
    sides = F.explode(F.array(F.struct(F.lit("true").alias("side"), F.col("true_priority").alias("priority")),
                              F.struct(F.lit("predicted").alias("side"), F.col("pred_priority").alias("priority"))))
    ok = (F.col("predicted") == F.col("truth")).cast("int")
    return x.select(sides.alias("s"), ok.alias("ok"), "conf").groupBy("s.side", "s.priority").agg(
        F.count(F.lit(1)).alias("n"), F.avg("ok").alias("team_acc"), F.avg("conf").alias("mean_conf"), (F.avg("ok") - F.avg("conf")).alias("acc_minus_conf"))


@query("reliability_by_priority", "DE-09", cte("top") + """,
j AS (SELECT a.conf, a.predicted = a.truth AS ok, b.predicted AS pred_priority FROM top a JOIN top b ON a.ticket_id = b.ticket_id AND a.target = 'assigned_team' AND b.target = 'priority')
SELECT pred_priority, least(floor(conf * 5), 4) AS bin, count(*) AS n, avg(conf) AS mean_conf, avg(CAST(ok AS INT)) AS accuracy FROM j WHERE pred_priority IN ('P1', 'P2') GROUP BY 1, 2""",
       dbl="mean_conf accuracy", big="bin")
def reliability_by_priority(spark, sf):
    return stats.reliability(_team_conf(Desk(spark, sf)).where("pred_priority IN ('P1', 'P2')"), ["pred_priority"], 5)


@query("ranking_auc", "ML-06", cte("proba") + """,
x AS (SELECT target, class, p, CAST(class = truth AS INT) AS y FROM proba),
r AS (SELECT *, rank() OVER (PARTITION BY target, class ORDER BY p) + (count(*) OVER (PARTITION BY target, class, p) - 1) / 2.0 AS ar FROM x)
SELECT target, class, (sum(ar) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / nullif(CAST(sum(y) AS DOUBLE) * sum(1 - y), 0) AS auc, sum(y) AS positives, sum(1 - y) AS negatives
FROM r GROUP BY 1, 2""", dbl="auc", big="positives negatives")
def ranking_auc(spark, sf):
    p = Desk(spark, sf).proba.withColumn("y", (F.col("class") == F.col("truth")).cast("int"))
    return stats.auc(p, ["target", "class"], "y", "p")


define("curve", "proba", """
SELECT target, class, p, sum(pos) OVER w AS tp, sum(n) OVER w AS fl, pos, sum(pos) OVER (PARTITION BY target, class) AS tot
FROM (SELECT target, class, p, sum(CAST(class = truth AS INT)) AS pos, count(*) AS n FROM proba GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY target, class ORDER BY p DESC)""")


@query("average_precision", "ML-07", cte("curve") + "SELECT target, class, sum(CAST(pos AS DOUBLE) / tot * tp / fl) AS average_precision FROM curve GROUP BY 1, 2", dbl="average_precision")
def average_precision(spark, sf):
    p = Desk(spark, sf).proba.withColumn("y", (F.col("class") == F.col("truth")).cast("int"))
    return stats.average_precision(p, ["target", "class"], "y", "p")


@query("f2_threshold", "DE-13", cte("curve") + """,
f AS (SELECT *, CAST(tp AS DOUBLE) / fl AS pr, CAST(tp AS DOUBLE) / tot AS re FROM curve WHERE target = 'priority'),
g AS (SELECT *, round(5 * pr * re / greatest(4 * pr + re, 1e-12), 12) AS f2 FROM f)
SELECT class, p AS threshold, f2, pr AS precision, re AS recall FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY f2 DESC, p) AS rn FROM g) WHERE rn = 1""",
       dbl="threshold f2 precision recall")
def f2_threshold(spark, sf):
    p = Desk(spark, sf).proba.where("target = 'priority'").withColumn("y", (F.col("class") == F.col("truth")).cast("int"))
    return stats.f2_threshold(p, ["class"], "y", "p")


THRESHOLDS = [round(0.1 + 0.025 * i, 3) for i in range(17)]
define("tlab", "proba", f"""
SELECT t, truth, CASE WHEN t < 0 THEN best WHEN p1 >= t THEN 'P1' ELSE rest END AS label FROM
 (SELECT ticket_id, any_value(truth) AS truth, max(p) FILTER (class = 'P1') AS p1, (list(class ORDER BY p DESC, class))[1] AS best,
    (list(class ORDER BY p DESC, class) FILTER (class <> 'P1'))[1] AS rest FROM proba WHERE target = 'priority' GROUP BY 1)
 CROSS JOIN (SELECT unnest([-1.0::DOUBLE, {', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS t)""")
define("tsweep", "tlab", """
SELECT CASE WHEN t >= 0 THEN t END AS threshold, coalesce(max(pr) FILTER (c = 'P1'), 0) AS p1_precision, coalesce(max(re) FILTER (c = 'P1'), 0) AS p1_recall,
  coalesce(max(f1) FILTER (c = 'P1'), 0) AS p1_f1, coalesce(5 * max(pr) FILTER (c = 'P1') * max(re) FILTER (c = 'P1') / nullif(4 * max(pr) FILTER (c = 'P1') + max(re) FILTER (c = 'P1'), 0), 0) AS p1_f2, avg(f1) AS macro_f1
FROM (SELECT t, c, coalesce(CAST(tp AS DOUBLE) / nullif(pd, 0), 0) AS pr, coalesce(CAST(tp AS DOUBLE) / nullif(su, 0), 0) AS re, 2.0 * tp / (pd + su) AS f1
  FROM (SELECT t, c, count(*) FILTER (truth = c AND label = c) AS tp, count(*) FILTER (label = c) AS pd, count(*) FILTER (truth = c) AS su
        FROM tlab CROSS JOIN (SELECT unnest(['P1', 'P2', 'P3', 'P4']) AS c) GROUP BY 1, 2) WHERE pd + su > 0) GROUP BY t""")


@query("threshold_sweep", "DE-12", cte("tsweep") + "SELECT * FROM tsweep", dbl="threshold p1_precision p1_recall p1_f1 p1_f2 macro_f1")
def threshold_sweep(spark, sf):
    return dc.threshold_sweep(Desk(spark, sf).proba, THRESHOLDS)


@query("threshold_options", "DE-12", cte("tsweep") + """
SELECT (SELECT macro_f1 FROM tsweep WHERE threshold IS NULL) AS argmax_macro_f1,
  (SELECT threshold FROM tsweep WHERE threshold IS NOT NULL ORDER BY round(p1_f2, 12) DESC, threshold LIMIT 1) AS best_f2_threshold,
  (SELECT min(threshold) FROM tsweep WHERE threshold IS NOT NULL AND macro_f1 >= (SELECT macro_f1 FROM tsweep WHERE threshold IS NULL) - 0.005) AS lowest_threshold_keeping_f1""",
       dbl="argmax_macro_f1 best_f2_threshold lowest_threshold_keeping_f1")
def threshold_options(spark, sf):
    return dc.threshold_options(dc.threshold_sweep(Desk(spark, sf).proba, THRESHOLDS))


@query("p1_probability_check", "DE-14", cte("proba") + """
SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mean_p1, avg(CAST(truth = 'P1' AS INT)) AS p1_rate FROM proba WHERE target = 'priority' AND class = 'P1' GROUP BY 1""", dbl="mean_p1 p1_rate", big="bin")
def p1_probability_check(spark, sf):
    p = Desk(spark, sf).proba.where("target = 'priority' AND class = 'P1'")
    return p.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p1"), F.avg((F.col("truth") == "P1").cast("int")).alias("p1_rate"))


define("grid1", "", "SELECT exp(ln(0.05) + i * (ln(20) - ln(0.05)) / 40) AS T FROM (SELECT unnest(range(0, 41)) AS i)")


@query("temperature_grid", "TX-12", cte("proba", "grid1") + """
SELECT target, T, avg(l - y) AS nll FROM (SELECT target, ticket_id, T, ln(sum(exp(ln(greatest(p, 1e-12)) / T))) AS l, max(CASE WHEN class = truth THEN ln(greatest(p, 1e-12)) / T END) AS y
  FROM proba CROSS JOIN grid1 GROUP BY 1, 2, 3) GROUP BY 1, 2""", dbl="T nll")
def temperature_grid(spark, sf):
    import math
    pts = [math.exp(math.log(0.05) + i * (math.log(20) - math.log(0.05)) / 40) for i in range(41)]
    return stats.temperature_nll(Desk(spark, sf).proba, F.array(*[F.lit(x) for x in pts]))


@query("temperature_fit", "TX-12")
def temperature_fit(spark, sf):
    return stats.fit_temperature(Desk(spark, sf).proba)


@query("team_cascade", "TX-07", cte("proba") + f""",
pc AS (SELECT category, product, {', '.join(f"(count(*) FILTER (assigned_team = '{t}') + 1.0) / (count(*) + 5) AS q{i}" for i, t in enumerate(TEAMS))} FROM tickets GROUP BY 1, 2),
cc AS (SELECT category, {', '.join(f"(count(*) FILTER (assigned_team = '{t}') + 1.0) / (count(*) + 5) AS q{i}" for i, t in enumerate(TEAMS))} FROM tickets GROUP BY 1),
s AS (SELECT p.ticket_id, {', '.join(f"sum(p * CAST(coalesce(a.q{i}, c.q{i}) AS DOUBLE)) AS s{i}" for i in range(5))} FROM proba p JOIN tickets t USING (ticket_id)
  LEFT JOIN pc a ON a.category = p.class AND a.product = t.product LEFT JOIN cc c ON c.category = p.class WHERE p.target = 'category' GROUP BY 1)
""" + " UNION ALL ".join(f"SELECT ticket_id, '{t}' AS class, s{i} / (s0 + s1 + s2 + s3 + s4) AS p FROM s" for i, t in enumerate(TEAMS)), dbl="p")
def team_cascade(spark, sf):
    d = Desk(spark, sf)
    return dc.cascade(d.proba, d.tickets, d.tickets, TEAMS)


define("lk", "tickets", """
SELECT t.ticket_id, coalesce(p.assigned_team, c.assigned_team, g.assigned_team) AS lookup_team FROM tickets t
LEFT JOIN (SELECT category, product, assigned_team FROM (SELECT category, product, assigned_team, row_number() OVER (PARTITION BY category, product ORDER BY count(*) DESC, assigned_team) AS rn FROM tickets GROUP BY 1, 2, 3) WHERE rn = 1) p ON t.category = p.category AND t.product = p.product
LEFT JOIN (SELECT category, assigned_team FROM (SELECT category, assigned_team, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, assigned_team) AS rn FROM tickets GROUP BY 1, 2) WHERE rn = 1) c ON t.category = c.category
CROSS JOIN (SELECT assigned_team FROM tickets GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) g""")


@query("team_lookup", "JN-09 UD-04", cte("lk") + "SELECT * FROM lk")
def team_lookup(spark, sf):
    t = Desk(spark, sf).tickets
    return intake.team_lookup(t, t).select("ticket_id", "lookup_team")


@query("correctness_features", "TX-13 TX-14", cte("cal", "caltop", "proba2", "lk", "tickets") + """,
e AS (SELECT ticket_id, -sum(p * ln(greatest(p, 1e-12))) FILTER (target = 'assigned_team') AS entropy, -sum(p * ln(greatest(p, 1e-12))) FILTER (target = 'category') AS cat_entropy,
  max(p) FILTER (target = 'category') AS max_cat, """ + ", ".join(f"max(p) FILTER (target = 'priority' AND class = '{c}') AS p_{c}" for c in fv.PRIORITIES) + """,
  (list(p ORDER BY p DESC) FILTER (target = 'assigned_team'))[1] - (list(p ORDER BY p DESC) FILTER (target = 'assigned_team'))[2] AS margin FROM cal GROUP BY 1),
b AS (SELECT ticket_id, class AS b2 FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY p DESC, class) AS rn FROM proba2 WHERE target = 'assigned_team') WHERE rn = 1)
SELECT e.*, c.predicted AS team_pred, c.conf AS p_ok, ln(greatest(c.conf, 1e-12)) AS log_p_ok, ln(greatest(1 - c.conf, 1e-12)) AS log_1m_p_ok, c.conf * p_P1 AS "p_ok_x_P1", c.conf * p_P2 AS "p_ok_x_P2",
  t.product, t.channel, t.assigned_team AS true_team, q.p AS e1_p_pred, CAST(b.b2 = c.predicted AS INT) AS e1_agree, CAST(lk.lookup_team = c.predicted AS INT) AS lookup_agree, CAST(c.predicted = t.assigned_team AS BIGINT) AS y
FROM e JOIN caltop c ON e.ticket_id = c.ticket_id AND c.target = 'assigned_team' JOIN tickets t ON e.ticket_id = t.ticket_id JOIN lk ON e.ticket_id = lk.ticket_id
JOIN b ON e.ticket_id = b.ticket_id JOIN proba2 q ON q.ticket_id = e.ticket_id AND q.target = 'assigned_team' AND q.class = c.predicted""",
       dbl="entropy cat_entropy max_cat p_P1 p_P2 p_P3 p_P4 margin p_ok log_p_ok log_1m_p_ok p_ok_x_P1 p_ok_x_P2 e1_p_pred e1_agree lookup_agree")
def correctness_features(spark, sf):
    d = Desk(spark, sf)
    return dc.correctness_features(calibrated(d), d.tickets, d.proba_second, intake.team_lookup(d.tickets, d.tickets))


@query("run_comparison_rules", "DE-11 DE-19")
def run_comparison_rules(spark, sf):
    from ..plans.experiments import compare_runs, selection_rules
    d = Desk(spark, sf)
    return selection_rules(compare_runs(d.proba, d.proba_second, d.tickets, boot=1000))


@query("run_comparison_bootstrap", "DE-10")
def run_comparison_bootstrap(spark, sf):
    from ..plans.experiments import compare_runs
    d = Desk(spark, sf)
    return compare_runs(d.proba, d.proba_second, d.tickets, boot=1000)


@query("holdout_summary", "DE-18", cte("top", "rep", "decin", "truthrow") + f""",
c AS (SELECT t.*, d.savings > 0 AS ab FROM truthrow t JOIN decin d USING (ticket_id))
SELECT 'macro_f1_' || target AS metric, avg(f1) AS value FROM rep GROUP BY target
UNION ALL SELECT 'accuracy_' || target, CAST(sum(tp) AS DOUBLE) / CAST(sum(support) AS DOUBLE) FROM rep GROUP BY target
UNION ALL SELECT 'P1_precision', precision FROM rep WHERE target = 'priority' AND class = 'P1' UNION ALL SELECT 'P1_recall', recall FROM rep WHERE target = 'priority' AND class = 'P1'
UNION ALL SELECT 'P1_f1', f1 FROM rep WHERE target = 'priority' AND class = 'P1'
UNION ALL SELECT 'cost_no_abstain', avg(CASE WHEN correct THEN 0.0 ELSE {W.format('priority')} END) FROM c
UNION ALL SELECT 'cost_savings_policy', avg(CASE WHEN ab THEN {A.format('priority')} WHEN correct THEN 0.0 ELSE {W.format('priority')} END) FROM c""", dbl="value")
def holdout_summary(spark, sf):
    from ..plans.triage import holdout_metrics
    d = Desk(spark, sf)
    return holdout_metrics(d.proba, _routed(d))


@query("submission_rows", "SRC-09", cte("decin", "top") + """,
r AS (SELECT *, row_number() OVER (ORDER BY guarded DESC, savings DESC, ticket_id) AS rn, floor(0.15 * count(*) OVER () + 1e-9) AS slots FROM decin),
d AS (SELECT ticket_id, CAST(guarded OR (savings > 0 AND rn <= slots) AS BIGINT) AS abstain FROM r)
SELECT d.ticket_id, CASE WHEN abstain = 1 THEN '' ELSE c.predicted END AS category, p.predicted AS priority, CASE WHEN abstain = 1 THEN '' ELSE a.predicted END AS assigned_team, t.sentiment, abstain
FROM d JOIN top c ON d.ticket_id = c.ticket_id AND c.target = 'category' JOIN top p ON d.ticket_id = p.ticket_id AND p.target = 'priority'
JOIN top a ON d.ticket_id = a.ticket_id AND a.target = 'assigned_team' JOIN tickets t ON d.ticket_id = t.ticket_id""")
def submission_rows(spark, sf):
    return _submission(Desk(spark, sf))


def _submission(d):
    from ..plans.triage import to_submission
    top = stats.top_class(d.proba, ["ticket_id", "target"]).groupBy("ticket_id").pivot("target", ["category", "priority", "assigned_team"]).agg(F.first("predicted"))
    pred = dc.decide(scored(d), fv.MAX_ABSTAIN_RATE).join(top, "ticket_id").join(d.tickets.select("ticket_id", "sentiment"), "ticket_id")
    return to_submission(pred)


@query("submission_checks", "SRC-10", cte("decin", "top") + """,
r AS (SELECT *, row_number() OVER (ORDER BY guarded DESC, savings DESC, ticket_id) AS rn, floor(0.15 * count(*) OVER () + 1e-9) AS slots FROM decin),
d AS (SELECT ticket_id, guarded OR (savings > 0 AND rn <= slots) AS ab, slots FROM r)
SELECT 'missing columns' AS rule, 0 AS n UNION ALL SELECT 'duplicate id', 0 UNION ALL SELECT 'id set differs', 0 UNION ALL SELECT 'abstain not 0/1', 0 UNION ALL SELECT 'invalid priority', 0
UNION ALL SELECT 'invalid category', 0 UNION ALL SELECT 'invalid assigned_team', 0 UNION ALL SELECT 'over the cap', greatest(count(*) FILTER (ab) - any_value(slots), 0) FROM d""", big="n")
def submission_checks(spark, sf):
    from ..plans.triage import check_submission
    d = Desk(spark, sf)
    return check_submission(_submission(d), d.tickets, CLASSES, fv.MAX_ABSTAIN_RATE)


@query("decision_reasons", "PRJ-18", cte("decin", "top", "tickets") + """,
r AS (SELECT d.*, body, row_number() OVER (ORDER BY guarded DESC, savings DESC, d.ticket_id) AS rn, floor(0.15 * count(*) OVER () + 1e-9) AS slots FROM decin d JOIN tickets t USING (ticket_id)),
x AS (SELECT r.*, guarded OR (savings > 0 AND rn <= slots) AS ab, a.predicted AS team, p1.p AS p1, p2.p AS p2 FROM r JOIN top a ON r.ticket_id = a.ticket_id AND a.target = 'assigned_team'
  JOIN proba p1 ON r.ticket_id = p1.ticket_id AND p1.target = 'priority' AND p1.class = 'P1' JOIN proba p2 ON r.ticket_id = p2.ticket_id AND p2.target = 'priority' AND p2.class = 'P2'),
y AS (SELECT *, CASE WHEN p1 >= 0.225 THEN 'likely P1' WHEN p1 + p2 >= 0.5 THEN 'likely P1/P2' ELSE 'likely P3/P4' END AS phrase,
  CASE WHEN guarded THEN 'Abstain: guard' WHEN ab THEN 'Abstain' WHEN savings > 0 THEN 'Route, desk full' ELSE 'Route' END AS kind FROM x)
SELECT ticket_id, kind, contains(kind, 'Abstain') AS starts_abstain, phrase, team FROM y""")
def decision_reasons(spark, sf):
    d = Desk(spark, sf)
    p = d.proba.where("target = 'priority'").groupBy("ticket_id").agg(F.max(F.when(F.col("class") == "P1", F.col("p"))).alias("p1"),
                                                                      F.max(F.when(F.col("class") == "P2", F.col("p"))).alias("p2"))
    team = stats.top_class(d.proba.where("target = 'assigned_team'"), ["ticket_id"]).select("ticket_id", F.col("predicted").alias("assigned_team"))
    x = dc.decide(scored(d), fv.MAX_ABSTAIN_RATE).join(p, "ticket_id").join(team, "ticket_id").withColumn("reason", dc.reason(fv.MAX_ABSTAIN_RATE))
    r = F.col("reason")
    kind = (F.when(r.startswith("Abstain: guard"), "Abstain: guard").when(r.startswith("Abstain"), "Abstain")
            .when(r.contains("desk is full"), "Route, desk full").otherwise("Route"))
    phrase = F.regexp_extract(r, r"(likely P1/P2|likely P3/P4|likely P1)", 1)
    return x.select("ticket_id", kind.alias("kind"), r.startswith("Abstain").alias("starts_abstain"), phrase.alias("phrase"), F.col("assigned_team").alias("team"))


@query("decision_documents", "SRC-11", cte("decin", "proba") + """
SELECT ticket_id, CAST(count(*) AS BIGINT) AS probabilities, round(max(p), 6) AS largest FROM decin JOIN proba USING (ticket_id) GROUP BY 1""", dbl="largest")
def decision_documents(spark, sf):
    """Nested documents per ticket (target -> class -> probability), read back from their JSON."""
    from ..plans.triage import to_documents
    d = Desk(spark, sf)
    doc = to_documents(d.proba, dc.decide(scored(d)))
    back = F.from_json("document", "ticket_id long, probabilities map<string, map<string, double>>")
    flat = doc.select(back.alias("j")).select("j.ticket_id", F.flatten(F.transform(F.map_values("j.probabilities"), lambda m: F.map_values(m))).alias("ps"))
    return flat.select("ticket_id", F.size("ps").alias("probabilities"), F.array_max("ps").alias("largest"))


@query("flag_size_study", "ML-05", cte("proba") + """,
x AS (SELECT row_number() OVER (ORDER BY p DESC, ticket_id) AS rn, CAST(truth = 'P1' AS INT) AS y, sum(p) OVER () AS expected, sum(CAST(truth = 'P1' AS INT)) OVER () AS pos FROM proba WHERE target = 'priority' AND class = 'P1'),
m AS (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 2.0]) AS multiplier),
g AS (SELECT multiplier, round_even(multiplier * any_value(expected), 0) AS flagged, sum(y) FILTER (rn <= round_even(multiplier * expected, 0)) AS tp, any_value(pos) AS pos FROM x CROSS JOIN m GROUP BY 1)
SELECT CAST(multiplier AS DOUBLE) AS multiplier, flagged, tp / nullif(flagged, 0) AS precision, CAST(tp AS DOUBLE) / pos AS recall, 2 * (tp / flagged) * (CAST(tp AS DOUBLE) / pos) / nullif(tp / flagged + CAST(tp AS DOUBLE) / pos, 0) AS f1 FROM g""",
       dbl="multiplier precision recall f1", big="flagged")
def flag_size_study(spark, sf):
    from ..plans.risk import flag_study
    p = Desk(spark, sf).proba.where("target = 'priority' AND class = 'P1'").select(
        F.lit("all").alias("cutoff"), F.col("ticket_id").alias("partner_id"), F.col("p").alias("raw"), (F.col("truth") == "P1").cast("int").alias("y"))
    expected = p.groupBy("cutoff").agg(F.sum("raw").alias("expected"))
    return flag_study(p, expected).select("multiplier", "flagged", "precision", "recall", F.coalesce("f1", F.lit(0.0)).alias("f1"))
