"""Route or hand off: expected costs, capacity, policies and their evaluation. Frames are keyed by ticket_id; ranks
over all tickets use the distributed ranking, ties go to the smaller id."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed_values as fv
from ..functions.numeric import ratio, xlogx
from ..session import cut_lineage
from .ranking import global_rank, running_totals
from . import stats

MISROUTE = {p: c for p, o, c in fv.COSTS if o == "misroute"}
ABSTAIN = {p: c for p, o, c in fv.COSTS if o == "abstain"}


def cost_table(spark: SparkSession, costs=fv.COSTS) -> DataFrame:
    """One row per priority with its misroute and hand-off cost, pivoted from the long cost list."""
    long = spark.createDataFrame(costs, "true_priority string, outcome string, cost double")
    return long.groupBy("true_priority").pivot("outcome", ["correct", "misroute", "abstain"]).agg(F.first("cost"))


def read_costs(spark: SparkSession, path: str) -> DataFrame:
    long = spark.read.schema("true_priority string, outcome string, cost double").option("header", True).csv(path)
    return long.groupBy("true_priority").pivot("outcome", ["correct", "misroute", "abstain"]).agg(F.first("cost"))


def by_priority(col: Column, values: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])[col]


def cap_count(cap: float | Column, n: Column) -> Column:
    c = cap if isinstance(cap, Column) else F.lit(float(cap))
    return F.floor(c * n + 1e-9)


def escalation(priority: Column, sentiment: Column) -> Column:
    return (sentiment == "Angry") | ((sentiment == "Frustrated") & priority.isin("P1", "P2"))


def expected_costs(proba: DataFrame, p_ok: DataFrame | None = None) -> DataFrame:
    """Expected routing and hand-off cost and the saving, one row per ticket, from long probabilities.
    `p_ok(ticket_id, p_ok)` replaces the team confidence as the chance that the team is right."""
    prio, team = F.col("target") == "priority", F.col("target") == "assigned_team"
    x = proba.groupBy("ticket_id").agg(
        F.sum(F.when(prio, F.col("p") * by_priority(F.col("class"), MISROUTE))).alias("_w"),
        F.sum(F.when(prio, F.col("p") * by_priority(F.col("class"), ABSTAIN))).alias("e_abstain"),
        F.max(F.when(team, F.col("p"))).alias("p_ok"))
    if p_ok is not None:
        x = x.drop("p_ok").join(p_ok, "ticket_id", "left")
    return x.select("ticket_id", "p_ok", ((1 - F.col("p_ok")) * F.col("_w")).alias("e_route"), "e_abstain").withColumn(
        "savings", F.col("e_route") - F.col("e_abstain"))


def priority_label(proba: DataFrame, threshold: float = fv.P1_THRESHOLD) -> DataFrame:
    """P1 when P(P1) reaches the threshold, else the best of the others (first name on ties)."""
    x = proba.where("target = 'priority'").groupBy("ticket_id").agg(
        F.max(F.when(F.col("class") == "P1", F.col("p"))).alias("p1"),
        F.min(F.when(F.col("class") != "P1", F.struct(-F.col("p"), F.col("class")))).alias("_b"))
    return x.select("ticket_id", "p1", F.when(F.col("p1") >= threshold, "P1").otherwise(F.col("_b.class")).alias("priority"))


# ---------------------------------------------------------------- deciding

def decide(scored: DataFrame, cap: float | None = None, use_guards: bool = True) -> DataFrame:
    """Hand off where it saves money. With a cap, guarded tickets take slots first and the largest positive savings
    take what is left of floor(cap * n); without, every positive saving does."""
    g = F.col("guarded") if use_guards else F.lit(False)
    pos = F.col("savings") > 0
    if cap is None:
        return scored.withColumn("abstain", (g | pos).cast("int"))
    r = running_totals(scored.withColumn("_g", g), [F.when(F.col("_g"), 0).otherwise(1), -F.col("savings"), F.col("ticket_id")],
                       {"_rn": F.lit(1).cast("long"), "_ng": F.col("_g").cast("long")})
    slots = cap_count(cap, F.col("_rn_total"))
    return r.withColumn("abstain", (F.col("_g") | (pos & (F.col("_rn") <= slots))).cast("int")).drop(
        "_g", "_rn", "_ng", "_rn_total", "_ng_total")


def decide_hard_cap(scored: DataFrame, cap: float) -> DataFrame:
    """As decide, but when guarded tickets alone exceed the slots only those with the highest expected route cost stay."""
    d = decide(scored, cap)
    r = running_totals(d, [F.when(F.col("guarded"), 0).otherwise(1), -F.col("e_route"), F.col("ticket_id")],
                       {"_rn": F.lit(1).cast("long"), "_na": F.col("abstain").cast("long")})
    slots = cap_count(cap, F.col("_rn_total"))
    over = F.col("_na_total") > slots
    keep = F.col("guarded") & (F.col("_rn") <= slots)
    return r.withColumn("abstain", F.when(over, (F.col("abstain") == 1) & keep).otherwise(F.col("abstain") == 1).cast("int")).drop(
        "_rn", "_na", "_rn_total", "_na_total")


def reason(cap: float | None) -> Column:
    """A plain sentence per decision, from p1, p2, p_correct, costs, guards and the chosen team."""
    p1, p2 = F.col("p1"), F.col("p2")
    phrase = (F.when(p1 >= fv.P1_THRESHOLD, F.format_string("likely P1 (P(P1)=%.2f)", p1))
              .when(p1 + p2 >= 0.5, "likely P1/P2").otherwise("likely P3/P4"))
    ctx = F.concat(phrase, F.format_string(", team confidence %.2f", F.col("p_ok")))
    costs = F.concat(F.format_string("expected misroute cost %.2f ", F.col("e_route")), F.when(F.col("savings") > 0, ">").otherwise("<="),
                     F.format_string(" hand-off cost %.2f", F.col("e_abstain")))
    texts = F.create_map(*[x for k, v in fv.GUARD_TEXT.items() for x in (F.lit(k), F.lit(f"{k} ({v})"))])
    names = F.array_join(F.transform("guard_flags", lambda g: F.coalesce(texts[g], g)), "; ")
    team = F.col("assigned_team")
    full = F.lit(f", but the hand-off desk is full ({cap:.0%} cap) and other tickets save more" if cap is not None else "")
    return (F.when(F.col("guarded"), F.concat(F.lit("Abstain: guard "), names, F.lit(". Model would have routed to "), team, F.lit(" ("), ctx, F.lit(")")))
            .when(F.col("abstain") == 1, F.concat(F.lit("Abstain: "), ctx, F.lit("; "), costs))
            .when(F.col("savings") > 0, F.concat(F.lit("Route to "), team, F.lit(": "), ctx, F.lit("; "), costs, full))
            .otherwise(F.concat(F.lit("Route to "), team, F.lit(": "), ctx, F.lit("; "), costs)))


# ---------------------------------------------------------------- evaluating

def realized_cost(abstain: Column, correct: Column, priority: Column) -> Column:
    return F.when(abstain, by_priority(priority, ABSTAIN)).when(correct, 0.0).otherwise(by_priority(priority, MISROUTE))


def abstention_efficiency(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per true priority and ALL: hand-offs, errors caught, hit rate, net gain. Columns: priority, abstain, correct."""
    by = by or []
    a, caught = F.col("abstain"), F.col("abstain") & ~F.col("correct")
    cells = df.groupBy(*by, "priority").agg(F.count_if(a).alias("abstains"), F.count_if(caught).alias("caught"))
    gain = F.col("caught") * by_priority(F.col("priority"), MISROUTE) - F.col("abstains") * by_priority(F.col("priority"), ABSTAIN)
    cells = cells.withColumn("net_gain", gain)
    every = cells.groupBy(*by).agg(F.sum("abstains").alias("abstains"), F.sum("caught").alias("caught"), F.sum("net_gain").alias("net_gain"))
    out = cells.unionByName(every.withColumn("priority", F.lit("ALL")))
    return out.withColumn("hit_rate", ratio(F.col("caught"), F.col("abstains")))


FORCED = ["b_naive_low_conf", "e_oracle_floor", "g_naive_low_pcorrect"]
SAVING = ["c_expcost_raw", "d_expcost_cal", "f_expcost_pcorrect"]
POLICIES = ["a_no_abstain", *FORCED, *SAVING]


def policy_frame(raw: DataFrame, calibrated: DataFrame, p_correct: DataFrame, truth: DataFrame, cap: float = fv.MAX_ABSTAIN_RATE) -> DataFrame:
    """(policy, ticket_id, priority, correct, abstain, cost) for all seven policies. `truth` holds ticket_id and the
    true priority and assigned_team."""
    top = stats.top_class(calibrated.where("target = 'assigned_team'"), ["ticket_id"]).select("ticket_id", "predicted", "conf")
    sav = lambda d, n: d.select("ticket_id", F.col("savings").alias(n))
    x = (truth.select("ticket_id", "priority", "assigned_team").join(top, "ticket_id")
         .join(sav(expected_costs(raw), "_c"), "ticket_id").join(sav(expected_costs(calibrated), "_d"), "ticket_id")
         .join(p_correct.select("ticket_id", F.col("p_ok").alias("_pc")), "ticket_id")
         .join(sav(expected_costs(calibrated, p_correct), "_f"), "ticket_id"))
    correct = F.col("predicted") == F.col("assigned_team")
    scores = {"a_no_abstain": F.lit(None).cast("double"), "b_naive_low_conf": -F.col("conf"), "c_expcost_raw": F.col("_c"), "d_expcost_cal": F.col("_d"),
              "e_oracle_floor": F.when(~correct, by_priority(F.col("priority"), MISROUTE)), "f_expcost_pcorrect": F.col("_f"),
              "g_naive_low_pcorrect": -F.col("_pc")}
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), F.round(v, 12).alias("score")) for k, v in scores.items()]))
    long = x.select("ticket_id", "priority", correct.alias("correct"), cells.alias("s")).select("ticket_id", "priority", "correct", "s.*")
    # ranking reads its input three times: the joined scores are written once
    r = global_rank(cut_lineage(long), [-F.coalesce("score", F.lit(-1e18)), F.col("ticket_id")], "_rn", ["policy"])
    inside = (F.col("_rn") <= cap_count(cap, F.col("_rn_total"))) & F.col("score").isNotNull()
    mask = F.when(F.col("policy").isin(SAVING), inside & (F.col("score") > 0)).otherwise(inside)
    return r.withColumn("abstain", mask).withColumn("cost", realized_cost(mask, F.col("correct"), F.col("priority"))).select(
        "policy", "ticket_id", "priority", "correct", "score", "abstain", "cost")


def policy_table(frame: DataFrame) -> DataFrame:
    a = F.col("abstain")
    wrong = ~a & ~F.col("correct")
    counts = [F.count_if(a & (F.col("priority") == p)).alias(f"abst_{p}") for p in fv.PRIORITIES]
    counts += [F.count_if(wrong & (F.col("priority") == p)).alias(f"misr_{p}") for p in fv.PRIORITIES]
    return frame.groupBy("policy").agg(F.avg("cost").alias("mean_cost"), F.avg(a.cast("int")).alias("abstain_rate"),
                                       F.count_if(a).alias("n_abstain"), *counts)


def cost_curve(frame: DataFrame, cap: float = fv.MAX_ABSTAIN_RATE, step: float = 0.005) -> DataFrame:
    """Mean cost when the top k of each score is handed off, for every rate up to the cap: one running total of what
    each hand-off changes, read at the ranks of the rates."""
    x = frame.where(F.col("policy").isin("b_naive_low_conf", "c_expcost_raw", "d_expcost_cal"))
    routed = realized_cost(F.lit(False), F.col("correct"), F.col("priority"))
    delta = by_priority(F.col("priority"), ABSTAIN) - routed
    r = running_totals(cut_lineage(x), [-F.col("score"), F.col("ticket_id")],
                       {"_rn": F.lit(1).cast("long"), "_d": delta.cast("decimal(18,4)"), "_r": routed.cast("decimal(18,4)")}, ["policy"])
    rates = [round(i * step, 3) for i in range(int(cap / step + 1e-6) + 1)]
    at = F.filter(F.array(*[F.struct(F.lit(v).alias("rate"), cap_count(v, F.col("_rn_total")).alias("k")) for v in rates]),
                  lambda s: (s["k"] == F.col("_rn")) | ((s["k"] == 0) & (F.col("_rn") == 1)))
    hit = r.select("policy", "_d", "_r_total", "_rn_total", F.explode(at).alias("s"))
    change = F.when(F.col("s.k") == 0, F.lit(0)).otherwise(F.col("_d"))
    return hit.select("policy", F.col("s.rate").alias("abstain_rate"), F.col("s.k").alias("n_abstain"),
                      ratio(F.col("_r_total") + change, F.col("_rn_total")).alias("mean_cost"))


def threshold_sweep(proba: DataFrame, thresholds: list[float]) -> DataFrame:
    """P1 precision, recall, F1, F2 and macro-F1 for every threshold, and for the plain argmax (threshold missing).
    Each ticket becomes one cell (truth, label) per threshold, counted before anything else."""
    x = proba.where("target = 'priority'").groupBy("ticket_id").agg(
        F.max("truth").alias("truth"), F.max(F.when(F.col("class") == "P1", F.col("p"))).alias("p1"),
        F.min(F.struct(-F.col("p"), F.col("class"))).alias("_all"),
        F.min(F.when(F.col("class") != "P1", F.struct(-F.col("p"), F.col("class")))).alias("_rest"))
    ts = F.explode(F.array(F.lit(None).cast("double"), *[F.lit(float(t)) for t in thresholds]))
    lab = x.select("truth", "p1", F.col("_all.class").alias("best"), F.col("_rest.class").alias("rest"), ts.alias("t")).select(
        "truth", "t", F.when(F.col("t").isNull(), F.col("best")).when(F.col("p1") >= F.col("t"), "P1").otherwise(F.col("rest")).alias("label"))
    cells = lab.withColumn("tkey", F.coalesce("t", F.lit(-1.0))).groupBy("tkey", F.col("truth").alias("actual"), F.col("label").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    rep = stats.class_report(cells, ["tkey"])
    one = F.col("class") == "P1"
    pick = lambda c: F.coalesce(F.max(F.when(one, F.col(c))), F.lit(0.0))
    g = rep.groupBy("tkey").agg(pick("precision").alias("p1_precision"), pick("recall").alias("p1_recall"), pick("f1").alias("p1_f1"),
                                F.avg("f1").alias("macro_f1"))
    f2 = 5 * F.col("p1_precision") * F.col("p1_recall") / F.nullif(4 * F.col("p1_precision") + F.col("p1_recall"), F.lit(0.0))
    return g.select(F.when(F.col("tkey") >= 0, F.col("tkey")).alias("threshold"), "p1_precision", "p1_recall", "p1_f1",
                    F.coalesce(f2, F.lit(0.0)).alias("p1_f2"), "macro_f1")


def threshold_options(sweep: DataFrame, slack: float = 0.005) -> DataFrame:
    """Three choices: plain argmax, the best F2 (lowest threshold on ties), the lowest threshold that keeps macro-F1
    within the slack of argmax. The sweep has one row per threshold."""
    base = sweep.where("threshold IS NULL").select(F.col("macro_f1").alias("_base"))
    cand = sweep.where("threshold IS NOT NULL").crossJoin(F.broadcast(base))
    out = cand.agg(F.min(F.struct(-F.round("p1_f2", 12), "threshold")).alias("b"),
                   F.min(F.when(F.col("macro_f1") >= F.col("_base") - slack, F.col("threshold"))).alias("lowest_threshold_keeping_f1"),
                   F.max("_base").alias("argmax_macro_f1"))
    return out.select("argmax_macro_f1", F.col("b.threshold").alias("best_f2_threshold"), "lowest_threshold_keeping_f1")


def correctness_features(calibrated: DataFrame, tickets: DataFrame, second: DataFrame | None = None, lookup: DataFrame | None = None) -> DataFrame:
    """Features of "is the top team right": confidence, margin, entropy, priority probabilities, category confidence,
    and where given the agreement with a second model and with the lookup team."""
    t = lambda name: F.col("target") == name
    p = F.col("p")
    x = calibrated.groupBy("ticket_id").agg(
        F.sort_array(F.collect_list(F.when(t("assigned_team"), p)), asc=False).alias("_s"),
        (-F.sum(F.when(t("assigned_team"), xlogx(p)))).alias("entropy"),
        *[F.max(F.when(t("priority") & (F.col("class") == c), p)).alias(f"p_{c}") for c in fv.PRIORITIES],
        F.max(F.when(t("category"), p)).alias("max_cat"),
        (-F.sum(F.when(t("category"), xlogx(p)))).alias("cat_entropy"),
        F.min(F.when(t("assigned_team"), F.struct(-p, F.col("class")))).alias("_b"))
    ok = F.get("_s", F.lit(0))
    unit = lambda v: F.log(F.least(F.greatest(v, F.lit(1e-12)), F.lit(1.0)))
    x = x.select("ticket_id", F.col("_b.class").alias("team_pred"), ok.alias("p_ok"), unit(ok).alias("log_p_ok"), unit(1 - ok).alias("log_1m_p_ok"),
                 (ok - F.get("_s", F.lit(1))).alias("margin"), "entropy", *[f"p_{c}" for c in fv.PRIORITIES], "max_cat",
                 (ok * F.col("p_P1")).alias("p_ok_x_P1"), (ok * F.col("p_P2")).alias("p_ok_x_P2"), "cat_entropy")
    x = x.join(tickets.select("ticket_id", "product", "channel", F.col("assigned_team").alias("true_team")), "ticket_id")
    if second is not None:
        b = stats.top_class(second.where("target = 'assigned_team'"), ["ticket_id"]).select("ticket_id", F.col("predicted").alias("_b2"))
        pr = second.where("target = 'assigned_team'").select("ticket_id", F.col("class").alias("team_pred"), F.col("p").alias("e1_p_pred"))
        x = (x.join(b, "ticket_id").join(pr, ["ticket_id", "team_pred"], "left")
             .withColumn("e1_agree", (F.col("_b2") == F.col("team_pred")).cast("double")).drop("_b2"))
    if lookup is not None:
        x = x.join(lookup.select("ticket_id", "lookup_team"), "ticket_id", "left").withColumn(
            "lookup_agree", (F.col("lookup_team") == F.col("team_pred")).cast("double")).drop("lookup_team")
    return x.withColumn("y", (F.col("team_pred") == F.col("true_team")).cast("int"))


def cascade(category_proba: DataFrame, tickets: DataFrame, train: DataFrame, teams: list[str]) -> DataFrame:
    """P(team) = sum over categories of P(category) * P(team | category, product), counts smoothed by one, the
    category alone where the pair was never seen. (ticket_id, class, p)."""
    k = len(teams)
    def table(by: list[str], name: str) -> DataFrame:
        n = train.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("assigned_team") == t).alias(f"_t{i}") for i, t in enumerate(teams)])
        return n.select(*by, F.array(*[(F.col(f"_t{i}") + 1) / (F.col("_n") + k) for i in range(k)]).alias(name))

    pair = table(["category", "product"], "_pq").withColumnRenamed("category", "class")
    cat = table(["category"], "_cq").withColumnRenamed("category", "class")
    x = category_proba.where("target = 'category'").select("ticket_id", "class", "p").join(tickets.select("ticket_id", "product"), "ticket_id")
    x = x.join(pair, ["class", "product"], "left").join(cat, "class", "left").withColumn("_q", F.coalesce("_pq", "_cq"))
    s = x.groupBy("ticket_id").agg(*[F.sum(F.col("p") * F.get("_q", F.lit(i))).alias(f"_s{i}") for i in range(k)])
    total = reduce(lambda a, b: a + b, [F.col(f"_s{i}") for i in range(k)])
    return s.select("ticket_id", F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in teams]).alias("class"),
                                                        F.array(*[F.col(f"_s{i}") / total for i in range(k)]).alias("p"))).alias("z")).select("ticket_id", "z.class", "z.p")


