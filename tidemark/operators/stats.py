"""Evaluation statistics. Rows are first reduced to counts per distinct value or cell, then accumulated with the
distributed running totals, so nothing here depends on how many rows share a group, a class or a score."""
from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numeric import ratio
from ..session import cut_lineage
from .ranking import exact_quantiles, running_totals

EPS = 1e-12


# ---------------------------------------------------------------- ranking quality

def auc(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """ROC-AUC per group; ties count half, missing x is left out, one class gives a missing value."""
    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(
        F.sum(F.col(y).cast("long")).alias("_pos"), F.sum((1 - F.col(y)).cast("long")).alias("_neg"))
    run = running_totals(cells, [F.col("_x")], {"_cn": F.col("_neg")}, by)
    return run.groupBy(*by).agg(
        F.sum(F.col("_pos").cast("double") * (F.col("_cn") - F.col("_neg") / 2.0)).alias("_u"),
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives")).select(
        *by, ratio(F.col("_u"), F.col("positives").cast("double") * F.col("negatives")).alias("auc"), "positives", "negatives")


def score_curve(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """One row per distinct score, best first: rows and positives at or above it, precision and recall."""
    cells = df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(F.col(y).cast("long")).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    run = running_totals(cells, [-F.col("threshold")], {"_tp": F.col("_pos"), "_cn": F.col("_n")}, by)
    return run.select(*by, "threshold", "_pos", F.col("_tp").alias("tp"), F.col("_cn").alias("flagged"),
                      F.col("_tp_total").alias("positives"), ratio(F.col("_tp"), F.col("_cn")).alias("precision"),
                      ratio(F.col("_tp"), F.col("_tp_total")).alias("recall"))


def average_precision(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    c = score_curve(df, by, y, score)
    return c.groupBy(*by).agg(F.sum(ratio(F.col("_pos"), F.col("positives")) * F.col("precision")).alias("average_precision"))


def f2_threshold(df: DataFrame, by: list[str], y: str, score: str) -> DataFrame:
    """The score cut with the best F2 (recall counts four times); the lowest such cut on ties."""
    c = score_curve(df, by, y, score)
    f2 = 5 * F.col("precision") * F.col("recall") / F.greatest(4 * F.col("precision") + F.col("recall"), F.lit(EPS))
    best = c.withColumn("f2", F.round(f2, 12)).groupBy(*by).agg(
        F.max(F.struct("f2", -F.col("threshold"), "precision", "recall")).alias("b"))
    return best.select(*by, (-F.col("b.col2")).alias("threshold"), F.col("b.f2").alias("f2"),
                       F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"))


# ---------------------------------------------------------------- classification

def confusion(df: DataFrame, by: list[str], y: str, yhat: str) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_report(cells: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Precision, recall and F1 for every class seen as truth or prediction."""
    side = F.explode(F.array(F.struct(F.col("actual").alias("class"), F.lit(True).alias("is_true")),
                             F.struct(F.col("predicted").alias("class"), F.lit(False).alias("is_true"))))
    x = cells.select(*by, side.alias("s"), (F.col("actual") == F.col("predicted")).alias("hit"), F.col(n).alias("_n"))
    g = x.groupBy(*by, F.col("s.class").alias("class")).agg(
        F.coalesce(F.sum(F.when(F.col("s.is_true"), F.col("_n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("s.is_true"), F.col("_n"))), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when(F.col("hit") & F.col("s.is_true"), F.col("_n"))), F.lit(0)).alias("tp"))
    return g.where("support + predicted > 0").withColumns({
        "precision": F.coalesce(ratio(F.col("tp"), F.col("predicted")), F.lit(0.0)),
        "recall": F.coalesce(ratio(F.col("tp"), F.col("support")), F.lit(0.0)),
        "f1": 2 * F.col("tp") / (F.col("support") + F.col("predicted"))})


def macro_f1(cells: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Macro-F1 over the classes present, and accuracy."""
    r = class_report(cells, by, n)
    return r.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"))


def flag_metrics(tp: Column, flagged: Column, positives: Column) -> dict[str, Column]:
    prec = F.coalesce(ratio(tp, flagged), F.lit(0.0))
    rec = F.coalesce(ratio(tp, positives), F.lit(0.0))
    return {"precision": prec, "recall": rec, "f1": F.coalesce(ratio(2 * prec * rec, prec + rec), F.lit(0.0))}


# ---------------------------------------------------------------- probabilities (long form: id, target, class, truth, p)

def top_class(long: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: the most probable class (first class name on ties), its probability and the margin."""
    w = Window.partitionBy(*keys).orderBy(F.desc("p"), "class")
    r = long.select(*keys, "class", "p", "truth", F.row_number().over(w).alias("_rn"), F.lead("p").over(w).alias("_second"))
    return r.where("_rn = 1").select(*keys, F.col("class").alias("predicted"), F.col("p").alias("conf"),
                                     (F.col("p") - F.col("_second")).alias("margin"), "truth")


def proba_losses(long: DataFrame, by: list[str]) -> DataFrame:
    """Log-loss and Brier score from long probabilities; no per-row regrouping is needed for either."""
    hit = F.col("class") == F.col("truth")
    return long.groupBy(*by).agg(
        (F.sum(F.when(hit, -F.log(F.least(F.greatest("p", F.lit(EPS)), F.lit(1.0))))) / F.count_if(hit)).alias("log_loss"),
        (F.sum((F.col("p") - hit.cast("int")) * (F.col("p") - hit.cast("int"))) / F.count_if(hit)).alias("brier"))


def reliability(top: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1))
    return top.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"),
        F.avg((F.col("predicted") == F.col("truth")).cast("int")).alias("accuracy"))


def ece(top: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    r = reliability(top, by, bins)
    return r.groupBy(*by).agg((F.sum(F.abs(F.col("accuracy") - F.col("mean_conf")) * F.col("n")) / F.sum("n")).alias("ece"))


def temperature(long: DataFrame, keys: list[str], t: Column) -> DataFrame:
    """softmax(log p / T) per row, that is p^(1/T) rescaled."""
    w = Window.partitionBy(*keys)
    z = F.log(F.least(F.greatest("p", F.lit(EPS)), F.lit(1.0))) / t
    e = long.withColumn("_z", z).withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(w)))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_z", "_e")


def temperature_nll(long: DataFrame, grid: Column) -> DataFrame:
    """Mean negative log-likelihood per (target, T) for every temperature in the array `grid`.

    Each row's classes are folded once into an array of log-probabilities (as long as the class list), and every
    temperature is evaluated on it in place, so the grid multiplies arithmetic and not rows in a shuffle."""
    logp = F.log(F.least(F.greatest("p", F.lit(EPS)), F.lit(1.0)))
    rows = long.groupBy("ticket_id", "target").agg(F.collect_list(logp).alias("_l"),
                                                   F.max(F.when(F.col("class") == F.col("truth"), logp)).alias("_y"))
    rows = rows.where(F.col("_y").isNotNull()).select("target", "_l", "_y", F.explode(grid).alias("T"))
    top = F.array_max("_l") / F.col("T")
    lse = top + F.log(F.aggregate("_l", F.lit(0.0), lambda a, v: a + F.exp(v / F.col("T") - top)))
    return rows.groupBy("target", "T").agg(F.avg(lse - F.col("_y") / F.col("T")).alias("nll"))


def fit_temperature(long: DataFrame, lo: float = 0.05, hi: float = 20.0, points: int = 41, rounds: int = 3) -> DataFrame:
    """Best temperature per target on a log grid, refined around the best point; everything stays on the executors."""
    def grid_between(a: Column, b: Column) -> Column:
        step = (F.log(b) - F.log(a)) / (points - 1)
        return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.exp(F.log(a) + i * step))

    width = (math.log(hi) - math.log(lo)) / (points - 1)
    best = None
    for _ in range(rounds):
        if best is None:
            nll = temperature_nll(long, grid_between(F.lit(lo), F.lit(hi)))
        else:
            # one row per target: bounded by the number of targets
            src = long.join(F.broadcast(best.select("target", F.col("T").alias("_t"))), "target")
            logp = F.log(F.least(F.greatest("p", F.lit(EPS)), F.lit(1.0)))
            rows = src.groupBy("ticket_id", "target", "_t").agg(
                F.collect_list(logp).alias("_l"), F.max(F.when(F.col("class") == F.col("truth"), logp)).alias("_y"))
            g = grid_between(F.col("_t") * math.exp(-width), F.col("_t") * math.exp(width))
            rows = rows.where(F.col("_y").isNotNull()).select("target", "_l", "_y", F.explode(g).alias("T"))
            top = F.array_max("_l") / F.col("T")
            lse = top + F.log(F.aggregate("_l", F.lit(0.0), lambda a, v: a + F.exp(v / F.col("T") - top)))
            nll = rows.groupBy("target", "T").agg(F.avg(lse - F.col("_y") / F.col("T")).alias("nll"))
            width = 2 * width / (points - 1)
        best = nll.groupBy("target").agg(F.min(F.struct("nll", "T")).alias("b")).select("target", F.col("b.T").alias("T"), F.col("b.nll").alias("nll"))
    return best


# ---------------------------------------------------------------- tests and resampling

def _log_fact(n: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma)(n + 1.0)


def _fisher(a: int, n: int, c: int, m: int) -> float:
    """Two-sided exact p. Only the part of the support near its mode carries weight, so far tails are not visited."""
    k = a + c
    lo, hi = max(0, k - m), min(n, k)
    mean = k * n / (n + m) if n + m else 0.0
    sd = math.sqrt(max(mean * (1 - n / (n + m)) * (n + m - k) / max(n + m - 1, 1), 1.0)) if n + m else 1.0
    reach = abs(a - mean) + 40 * sd + 10
    ks = np.arange(max(lo, math.floor(mean - reach)), min(hi, math.ceil(mean + reach)) + 1)
    lp = (math.lgamma(n + 1) - _log_fact(ks) - _log_fact(n - ks) + math.lgamma(m + 1) - _log_fact(k - ks) - _log_fact(m - k + ks)
          - (math.lgamma(n + m + 1) - math.lgamma(k + 1) - math.lgamma(n + m - k + 1)))
    return float(np.exp(lp[lp <= lp[ks == a][0] + 1e-7]).sum())


def fisher_two_sided(a: str, n: str, c: str, m: str) -> Column:
    """Fisher's exact test of a of n against c of m, for a frame with one row per comparison."""
    @F.pandas_udf("double")
    def run(a_: pd.Series, n_: pd.Series, c_: pd.Series, m_: pd.Series) -> pd.Series:
        return pd.Series([_fisher(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a_, n_, c_, m_)])
    return run(F.col(a).cast("long"), F.col(n).cast("long"), F.col(c).cast("long"), F.col(m).cast("long"))


POISSON_CDF = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(13)]


def poisson1(seed: int, *key: Column) -> Column:
    """A Poisson(1) weight that depends only on the seed and the key: the same whenever a task is run again."""
    u = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) / F.lit(float(1 << 52))
    out = F.lit(0)
    for c in POISSON_CDF:
        out = out + (u > c).cast("int")
    return out


def replicates(n: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(n)))


def cell_weights(cells: DataFrame, keys: list[str], n: str, boot: int, seed: int) -> DataFrame:
    """Resampled counts for counted cells. A cell of n rows with Poisson(1) weights weighs Poisson(n) in total, so
    the cells are resampled and not the rows: the work does not grow with the data."""
    @F.pandas_udf("long")
    def draw(lam: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([int(np.random.default_rng(x & 0x7FFFFFFFFFFFFFFF).poisson(v)) for v, x in zip(lam, s)])
    return cells.withColumn("replicate", replicates(boot)).withColumn(
        "_w", draw(F.col(n).cast("double"), F.xxhash64(F.lit(seed), F.col("replicate"), *[F.col(k) for k in keys])))


def interval(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """95 percent bounds and the share of replicates at or above zero. The replicates are written once: the bounds
    take two passes over them."""
    df = cut_lineage(df)
    q = exact_quantiles(df, by, value, {"lo": 0.025, "hi": 0.975})
    share = df.groupBy(*by).agg(F.avg((F.col(value) >= 0).cast("int")).alias("share_ge_0"))
    return q.join(share, by) if by else q.crossJoin(share)


def mean_difference_bootstrap(df: DataFrame, by: list[str], diff: str, boot: int = 1000, seed: int = 42) -> DataFrame:
    """Paired bootstrap of a mean difference: rows with the same difference are one cell."""
    cells = df.groupBy(*by, F.col(diff).alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    point = cells.groupBy(*by).agg((F.sum(F.col("_d") * F.col("_n")) / F.sum("_n")).alias("diff"))
    r = cell_weights(cells, [*by, "_d"], "_n", boot, seed).groupBy(*by, "replicate").agg(
        ratio(F.sum(F.col("_d") * F.col("_w")), F.sum("_w")).alias("_m"))
    b = interval(r, by, "_m")
    return point.join(b, by) if by else point.crossJoin(b)


def macro_f1_bootstrap(pairs: DataFrame, by: list[str], boot: int = 1000, seed: int = 42) -> DataFrame:
    """Paired bootstrap of macro-F1 of run a minus run b from rows (truth, a, b): only joint confusion cells are
    resampled, with weights shared by both runs."""
    cells = pairs.groupBy(*by, "truth", "a", "b").agg(F.count(F.lit(1)).alias("_n"))

    def diff(c: DataFrame, keys: list[str], w: str) -> DataFrame:
        fa = macro_f1(c.select(*keys, F.col("truth").alias("actual"), F.col("a").alias("predicted"), F.col(w).alias("n")), keys)
        fb = macro_f1(c.select(*keys, F.col("truth").alias("actual"), F.col("b").alias("predicted"), F.col(w).alias("n")), keys)
        j = fa.select(*keys, F.col("macro_f1").alias("_a")).join(fb.select(*keys, F.col("macro_f1").alias("_b")), keys)
        return j.select(*keys, (F.col("_a") - F.col("_b")).alias("diff"))
    r = diff(cell_weights(cells, [*by, "truth", "a", "b"], "_n", boot, seed), [*by, "replicate"], "_w")
    return diff(cells, by, "_n").join(interval(r, by, "diff"), by)


def auc_bootstrap(df: DataFrame, within: list[str], y: str, a: str, b: str, boot: int = 200, seed: int = 42) -> DataFrame:
    """Paired bootstrap of the mean over `within` of AUC(a) - AUC(b): one replicate weight per row and snapshot,
    shared by both scores."""
    def weighted(frame: DataFrame, keys: list[str], w: Column) -> DataFrame:
        s = F.explode(F.array(F.struct(F.lit("a").alias("run"), F.col(a).alias("x")), F.struct(F.lit("b").alias("run"), F.col(b).alias("x"))))
        long = frame.select(*keys, F.col(y).alias("_y"), w.alias("_w"), s.alias("s")).where("_w > 0")
        cells = long.groupBy(*keys, F.col("s.run").alias("run"), F.col("s.x").alias("x")).agg(
            F.sum(F.col("_w") * F.col("_y")).alias("_pos"), F.sum(F.col("_w") * (1 - F.col("_y"))).alias("_neg"))
        cells = cut_lineage(cells)
        run = running_totals(cells, [F.col("x")], {"_cn": F.col("_neg")}, [*keys, "run"])
        g = run.groupBy(*keys, "run").agg(F.sum(F.col("_pos") * (F.col("_cn") - F.col("_neg") / 2.0)).alias("_u"),
                                          F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
        g = g.withColumn("auc", ratio(F.col("_u"), F.col("_p") * F.col("_q")))
        return g.groupBy(*keys).agg((F.max(F.when(F.col("run") == "a", F.col("auc"))) - F.max(F.when(F.col("run") == "b", F.col("auc")))).alias("diff"))

    point = weighted(df, within, F.lit(1)).agg(F.avg("diff").alias("diff"))
    return point.crossJoin(interval(_auc_replicates(df, within, y, a, b, boot, seed), [], "_m"))


#: Rows of one score that are resampled in one array, at most twice as many.
CHUNK = 20_000


def _last_hash(rows: np.ndarray, before: np.ndarray) -> np.ndarray:
    """xxhash64(..., row) as Spark gives it, from the hashes of what stands before: rows x replicates. Unsigned numbers wrap around as they should."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = (before + p5 + np.uint64(8))[None, :] ^ (turn(rows * p2, 31) * p1)[:, None]
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _draws(h: np.ndarray) -> np.ndarray:
    """The numbers of `poisson1` for its hashes."""
    u, out = (h & np.uint64((1 << 52) - 1)) / float(1 << 52), np.zeros(h.shape)
    for c in POISSON_CDF:
        more = u > c
        if not more.any():
            break
        out += more
    return out


def _auc_replicates(df: DataFrame, within: list[str], y: str, a: str, b: str, boot: int, seed: int) -> DataFrame:
    """(replicate, _m): mean over `within` of AUC(a) - AUC(b) with the weights of `poisson1(seed, replicate, *within, row_id)`.

    Rows are not copied for the replicates. They are cut by score into chunks, ties whole; a chunk returns three numbers a replicate: the pairs won inside it, its positives
    and its negatives. A score with more rows than a chunk is spread over several, whose pairs are all ties."""
    s = F.explode(F.array(F.struct(F.lit("a").alias("run"), F.col(a).alias("x")), F.struct(F.lit("b").alias("run"), F.col(b).alias("x"))))
    # ids that are not whole numbers are hashed to one
    number = F.col("row_id").cast("long") if df.schema["row_id"].dataType.typeName() in ("long", "integer") else F.xxhash64("row_id")
    long = cut_lineage(df.select(*within, number.alias("_id"), F.col(y).cast("long").alias("_y"), s.alias("s")).where("_y IS NOT NULL").select(*within, "_id", "_y", "s.run", "s.x"))
    keys = [*within, "run"]
    cells = cut_lineage(long.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_n")))
    cells = running_totals(cells, [F.col("x")], {"_at": F.col("_n")}, keys)
    cells = cells.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "x"]], "_n", (F.col("_at") - F.col("_n")).alias("_at"), (F.col("_n") > CHUNK).alias("_ties"))
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, "x"]])
    part = F.when(F.col("_ties"), F.pmod(F.xxhash64("_id"), F.ceil(F.col("_n") / CHUNK))).otherwise(F.lit(0)).cast("long")
    chunk = [*keys, "_chunk", "_ties", "_part"]
    rows = cut_lineage(long.join(cells, same).select(*keys, F.floor(F.col("_at") / CHUNK).alias("_chunk"), "_ties", part.alias("_part"), "_at", "_id", "_y"))
    # one more row a chunk brings the hashes of seed, replicate and group
    hashes = F.transform(F.sequence(F.lit(1), F.lit(boot)), lambda r: F.xxhash64(F.lit(seed), r, *[F.col(c) for c in within]))
    heads = rows.select(*chunk).distinct().withColumns({"_at": F.lit(0).cast("long"), "_id": F.lit(0).cast("long"), "_y": F.lit(0).cast("long"), "_h": hashes})

    def drawn(frame: pd.DataFrame) -> pd.DataFrame:
        head = frame["_h"].notna()
        first = frame[head].iloc[0]
        before = np.array(first["_h"], dtype=np.int64).view(np.uint64)
        held = frame[~head].sort_values("_at")
        at, ids, label = held["_at"].to_numpy(np.int64), held["_id"].to_numpy(np.int64).view(np.uint64), held["_y"].to_numpy(float)[:, None]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        step, out = max(500_000 // len(at), 1), []
        for i in range(0, len(before), step):
            w = _draws(_last_hash(ids, before[i:i + step]))
            pos, neg = (np.add.reduceat(x, starts, axis=0) if len(starts) < len(at) else x for x in (w * label, w * (1 - label)))
            out.append(((pos * (np.cumsum(neg, axis=0) - neg / 2)).sum(axis=0), pos.sum(axis=0), neg.sum(axis=0)))
        u, p, q = (np.concatenate(x) for x in zip(*out))
        return pd.DataFrame([{**{c: first[c] for c in chunk}, "_u": u, "_p": p, "_q": q}])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    parts = rows.withColumn("_h", F.lit(None).cast("array<bigint>")).unionByName(heads)
    parts = parts.groupBy(*chunk).applyInPandas(drawn, ", ".join(f"`{c}` {kinds[c]}" for c in chunk) + ", _u array<double>, _p array<double>, _q array<double>")
    cell = parts.select(*chunk, F.posexplode(F.arrays_zip("_u", "_p", "_q")).alias("replicate", "_x"))
    cell = cell.groupBy(*keys, "replicate", "_chunk", "_ties").agg(*[F.sum(f"_x.{c}").alias(c) for c in ("_u", "_p", "_q")])
    # the scores of one value lie behind the smaller ones of their chunk's number
    below = Window.partitionBy(*keys, "replicate").orderBy("_chunk", "_ties").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.when(F.col("_ties"), F.col("_p") * F.col("_q") / 2).otherwise(F.col("_u"))
    cell = cell.select(*keys, "replicate", "_p", "_q", (inside + F.col("_p") * F.coalesce(F.sum("_q").over(below), F.lit(0.0))).alias("_u"))
    g = cell.groupBy(*keys, "replicate").agg(*[F.sum(c).alias(c) for c in ("_u", "_p", "_q")]).withColumn("auc", ratio(F.col("_u"), F.col("_p") * F.col("_q")))
    side = lambda r: F.max(F.when(F.col("run") == r, F.col("auc")))
    g = g.groupBy(*within, "replicate").agg((side("a") - side("b")).alias("diff"))
    return g.groupBy((F.col("replicate") + 1).alias("replicate")).agg(F.avg("diff").alias("_m"))


# ---------------------------------------------------------------- rank correlation

def spearman_pairs(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Spearman correlation of every column pair over the rows where both are present, with average ranks."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1:]]
    cells = F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                      for x, y in pairs])
    long = df.select(F.explode(cells).alias("c")).select("c.*").where("x IS NOT NULL AND y IS NOT NULL")
    joint = long.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    def ranked(col: str) -> DataFrame:
        v = joint.groupBy("a", "b", col).agg(F.sum("n").alias("_n"))
        r = running_totals(v, [F.col(col)], {"_c": F.col("_n")}, ["a", "b"])
        return r.select("a", "b", col, (F.col("_c") - (F.col("_n") - 1) / 2.0).alias(f"r{col}"))

    j = joint.join(ranked("x"), ["a", "b", "x"]).join(ranked("y"), ["a", "b", "y"])
    n, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    sxy, sxx, syy = (F.sum(F.col("n") * F.col(p) * F.col(q)) for p, q in (("rx", "ry"), ("rx", "rx"), ("ry", "ry")))
    cov = n * sxy - sx * sy
    return j.groupBy("a", "b").agg(
        (cov / F.nullif(F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), F.lit(0.0))).alias("spearman"), n.alias("n"))


def ap_bootstrap(df: DataFrame, y: str, a: str, b: str, boot: int = 200, seed: int = 42) -> DataFrame:
    """Paired bootstrap of average precision of a minus b, weights shared by both scores."""
    def weighted(frame: DataFrame, keys: list[str], w: Column) -> DataFrame:
        s = F.explode(F.array(F.struct(F.lit("a").alias("run"), F.col(a).alias("x")), F.struct(F.lit("b").alias("run"), F.col(b).alias("x"))))
        cells = (frame.select(*keys, F.col(y).alias("_y"), w.alias("_w"), s.alias("s")).where("_w > 0")
                 .groupBy(*keys, F.col("s.run").alias("run"), F.col("s.x").alias("x"))
                 .agg(F.sum(F.col("_w") * F.col("_y")).alias("_pos"), F.sum("_w").alias("_n")))
        cells = cut_lineage(cells)
        run = running_totals(cells, [-F.col("x")], {"_tp": F.col("_pos"), "_cn": F.col("_n")}, [*keys, "run"])
        g = run.groupBy(*keys, "run").agg(F.sum(ratio(F.col("_pos"), F.col("_tp_total")) * ratio(F.col("_tp"), F.col("_cn"))).alias("ap"))
        side = lambda r: F.max(F.when(F.col("run") == r, F.col("ap")))
        return g.groupBy(*keys).agg((side("a") - side("b")).alias("diff"))

    point = weighted(df, [], F.lit(1)).select("diff")
    reps = df.withColumn("replicate", replicates(boot))
    r = weighted(reps, ["replicate"], poisson1(seed, F.col("replicate"), F.col("row_id"))).where(F.col("diff").isNotNull())
    return point.crossJoin(interval(r.withColumnRenamed("diff", "_m"), [], "_m"))
