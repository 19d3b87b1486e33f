"""Ticket triage end to end: text models per label, calibration, correctness, costs, guards and the decision."""
from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from ..operators import decisions as dc
from ..operators import intake, matching, stats, terms
from ..operators.ranking import global_rank
from ..session import cut_lineage


# ---------------------------------------------------------------- frames in and out

def check_probabilities(proba: DataFrame, ids: DataFrame, classes: dict[str, list[str]]) -> DataFrame:
    """(rule, n) over long probabilities: valid numbers, rows that sum to 1, complete class sets, the expected ids."""
    sizes = F.create_map(*[x for t, cs in classes.items() for x in (F.lit(t), F.lit(len(cs)))])
    bad = F.isnan("p") | (F.col("p") < 0) | (F.col("p") == float("inf")) | F.col("p").isNull()
    rows = proba.groupBy("ticket_id", "target").agg(F.count_if(bad).alias("bad"), F.sum("p").alias("s"),
                                                    F.countDistinct("class").alias("k"), F.count(F.lit(1)).alias("m"))
    n = rows.agg(F.sum("bad").alias("invalid probability"), F.count_if(F.abs(F.col("s") - 1) > 1e-6).alias("row does not sum to 1"),
                 F.count_if((F.col("k") != sizes[F.col("target")]) | (F.col("m") != F.col("k"))).alias("wrong class set"))
    rules = F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n")) for c in n.columns]))
    a, b = proba.select("ticket_id").distinct(), ids.select("ticket_id").distinct()
    diff = a.join(b, "ticket_id", "left_anti").unionByName(b.join(a, "ticket_id", "left_anti")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(rules.alias("r")).select("r.*").unionByName(diff.select(F.lit("id set differs").alias("rule"), "n"))


def to_submission(pred: DataFrame) -> DataFrame:
    out = F.col("abstain") == 1
    return pred.select("ticket_id", F.when(out, "").otherwise(F.col("category")).alias("category"), "priority",
                       F.when(out, "").otherwise(F.col("assigned_team")).alias("assigned_team"), "sentiment",
                       F.col("abstain").cast("int").alias("abstain"))


def check_submission(sub: DataFrame, ids: DataFrame, domains: dict[str, list[str]], cap: float | None) -> DataFrame:
    """(rule, n violations); all zero for a valid submission."""
    missing = len([c for c in fv.SUBMISSION_COLUMNS if c not in sub.columns])
    routed = F.col("abstain") == 0
    ok = lambda c: F.col(c).isin(domains[c]) if c in domains else F.col(c) != ""
    free = lambda c: ~F.when(routed, ok(c)).otherwise(ok(c) | (F.coalesce(F.col(c), F.lit("")) == ""))
    n = sub.agg(F.count_if(~F.col("abstain").isin(0, 1)).alias("abstain not 0/1"), F.count_if(~ok("priority")).alias("invalid priority"),
                F.count_if(free("category")).alias("invalid category"), F.count_if(free("assigned_team")).alias("invalid assigned_team"),
                F.greatest(F.sum("abstain") - (dc.cap_count(cap, F.count(F.lit(1))) if cap is not None else F.count(F.lit(1))), F.lit(0)).alias("over the cap"))
    rules = F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(f"`{c}`").cast("long").alias("n")) for c in n.columns]))
    one = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    twice = sub.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    diff = sub.join(ids, "ticket_id", "left_anti").select("ticket_id").unionByName(ids.join(sub, "ticket_id", "left_anti").select("ticket_id"))
    gone = sub.agg(F.lit(missing).cast("long").alias("n")).select(F.lit("missing columns").alias("rule"), "n")
    return reduce(DataFrame.unionByName, [n.select(rules.alias("r")).select("r.*"), gone, one("duplicate id", twice), one("id set differs", diff)])


def to_documents(proba: DataFrame, decided: DataFrame) -> DataFrame:
    """One JSON document per ticket with probabilities nested target -> class."""
    per = proba.groupBy("ticket_id", "target").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", F.round("p", 6).alias("p"))))).alias("m"))
    nested = per.groupBy("ticket_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("target", F.to_json("m").alias("j"))))).alias("pj"))
    nested = nested.select("ticket_id", F.transform_values("pj", lambda _, j: F.from_json(j, "map<string,double>")).alias("probabilities"))
    money = [F.round(c, 6).alias(c) for c in ("p_ok", "e_route", "e_abstain", "savings") if c in decided.columns]
    rest = [c for c in ("category", "priority", "assigned_team", "sentiment", "escalation", "guard_flags", "abstain", "decision", "reason") if c in decided.columns]
    x = decided.select("ticket_id", *rest, *money).join(nested, "ticket_id")
    return x.select("ticket_id", F.to_json(F.struct("ticket_id", *rest, "probabilities", *[c for c in ("p_ok", "e_route", "e_abstain", "savings") if c in decided.columns])).alias("document"))


def holdout_metrics(proba: DataFrame, routed: DataFrame) -> DataFrame:
    """(metric, value) of one final evaluation: labels, P1, and routing cost with and without hand-offs."""
    cells = stats.confusion(stats.top_class(proba, ["ticket_id", "target"]), ["target"], "truth", "predicted")
    rep = stats.class_report(cells, ["target"])
    m = stats.macro_f1(cells, ["target"])
    pairs = F.explode(F.array(F.struct(F.concat(F.lit("macro_f1_"), "target").alias("metric"), F.col("macro_f1").alias("value")),
                              F.struct(F.concat(F.lit("accuracy_"), "target").alias("metric"), F.col("accuracy").alias("value"))))
    p1 = rep.where("target = 'priority' AND class = 'P1'")
    p1s = F.explode(F.array(*[F.struct(F.lit(f"P1_{c}").alias("metric"), F.col(c).alias("value")) for c in ("precision", "recall", "f1")]))
    cost = lambda a: F.avg(dc.realized_cost(a, F.col("correct"), F.col("priority")))
    c = routed.agg(cost(F.lit(False)).alias("none"), cost(F.col("abstain")).alias("policy"))
    cs = F.explode(F.array(F.struct(F.lit("cost_no_abstain").alias("metric"), F.col("none").alias("value")),
                           F.struct(F.lit("cost_savings_policy").alias("metric"), F.col("policy").alias("value"))))
    sel = lambda d, e: d.select(e.alias("x")).select("x.*")
    return sel(m, pairs).unionByName(sel(p1, p1s)).unionByName(sel(c, cs))


# ---------------------------------------------------------------- vectors

@F.udf(VectorUDT())
def _sparse(size, idx, w):
    return SparseVector(size, idx, w)


#: A vocabulary of at most so many terms, as counted, is broadcast; a larger one is joined by shuffle.
BROADCAST_TERMS = 500_000


@dataclass
class TermSpace:
    """A fitted vocabulary: (kind, term, idx, idf), of all terms or, by kind, of the `most` frequent."""
    kinds: tuple[str, ...] = ("word",)
    most: dict = field(default_factory=dict)
    min_df: dict = field(default_factory=lambda: {"word": 2, "char": 3})
    vocab: DataFrame | None = None
    size: int = 0

    def _counts(self, docs: DataFrame, kind: str, text: Column) -> DataFrame:
        return terms.word_counts(docs, "ticket_id", text) if kind == "word" else terms.char_counts(docs, "ticket_id", text)

    def fit(self, docs: DataFrame, text: Column | None = None) -> "TermSpace":
        text = tx.ticket_text() if text is None else text
        parts = []
        n = docs.agg(F.count(F.lit(1)).alias("_n"))
        for kind in self.kinds:
            limits = self.min_df[kind], self.most.get(kind)
            v = terms.vocabulary(self._counts(docs, kind, text), *limits) if kind == "word" else terms.char_vocabulary(docs, "ticket_id", text, *limits)
            parts.append(v.crossJoin(F.broadcast(n)).select(F.lit(kind).alias("kind"), "term", (F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1).alias("idf")))
        v = global_rank(reduce(DataFrame.unionByName, parts), [F.col("kind"), F.col("term")], "_rn")
        self.vocab = cut_lineage(v.select("kind", "term", "idf", (F.col("_rn") - 1).cast("int").alias("idx")))
        self.size = max(self.vocab.count(), 1)
        return self

    def restrict(self, kept: DataFrame) -> "TermSpace":
        """Only the terms in `kept(kind, term)`, renumbered."""
        v = global_rank(self.vocab.join(kept, ["kind", "term"], "left_semi").drop("idx"), [F.col("kind"), F.col("term")], "_rn")
        out = TermSpace(self.kinds, self.most, self.min_df)
        out.vocab = cut_lineage(v.select("kind", "term", "idf", (F.col("_rn") - 1).cast("int").alias("idx")))
        out.size = max(out.vocab.count(), 1)
        return out

    def weights(self, docs: DataFrame, text: Column | None = None) -> DataFrame:
        """(ticket_id, kind, term, idx, weight), unit length per kind."""
        text = tx.ticket_text() if text is None else text
        parts = []
        for kind in self.kinds:
            v = self.vocab.where(F.col("kind") == kind).select("term", "idx", "idf")
            v = F.broadcast(v) if self.size <= BROADCAST_TERMS else v
            raw = self._counts(docs, kind, text).join(v, "term").select("ticket_id", F.lit(kind).alias("kind"), "term", "idx", ((1 + F.log("tf")) * F.col("idf")).alias("_w"))
            parts.append(raw)
        x = reduce(DataFrame.unionByName, parts)
        norm = x.groupBy("ticket_id", "kind").agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
        return x.join(norm, ["ticket_id", "kind"]).select("ticket_id", "kind", "term", "idx", (F.col("_w") / F.col("_n")).alias("weight"))

    def vectors(self, docs: DataFrame, text: Column | None = None, keep: list[str] = ()) -> DataFrame:
        """(ticket_id, features, kept columns): one sparse vector per document, empty where no term is known."""
        v = self.weights(docs, text).groupBy("ticket_id").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("v"))
        x = docs.select("ticket_id", *keep).join(v, "ticket_id", "left")
        idx = F.coalesce(F.col("v.idx"), F.array().cast("array<int>"))
        w = F.coalesce(F.col("v.weight"), F.array().cast("array<double>"))
        return x.select("ticket_id", *keep, _sparse(F.lit(self.size), idx, w).alias("features"))


# ---------------------------------------------------------------- classifiers (long probabilities out)

def long_proba(scored: DataFrame, classes: list[str], target: str, column: str = "probability") -> DataFrame:
    arr = vector_to_array(F.col(column)) if scored.schema[column].dataType.typeName() != "array" else F.col(column)
    z = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("class"), arr.alias("p")))
    keep = ["truth"] if "truth" in scored.columns else []
    return scored.select("ticket_id", F.lit(target).alias("target"), *keep, z.alias("z")).select("ticket_id", "target", *keep, "z.class", "z.p")


def label_index(column: str, classes: list[str]) -> Column:
    return F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])[F.col(column)]


class TextLogistic:
    """Multinomial logistic regression with inverse regularisation C; `weights` maps a class to its row weight, or is
    "balanced"."""

    def __init__(self, C: float = 1.0, weights: dict | str | None = None, max_iter: int = 100):
        self.C, self.weights, self.max_iter = C, weights, max_iter

    def fit(self, train: DataFrame, label: str, classes: list[str]) -> "TextLogistic":
        self.classes = classes
        n = train.count()
        x = train.withColumn("_y", label_index(label, classes))
        if self.weights == "balanced":
            c = train.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
            x = x.join(F.broadcast(c), label).withColumn("_w", F.lit(float(n)) / (len(classes) * F.col("_c")))
        elif self.weights:
            table = F.create_map(*[v for k, w in self.weights.items() for v in (F.lit(k), F.lit(float(w)))])
            x = x.withColumn("_w", F.coalesce(table[F.col(label)], F.lit(1.0)))
        else:
            x = x.withColumn("_w", F.lit(1.0))
        lr = LogisticRegression(featuresCol="features", labelCol="_y", weightCol="_w", family="multinomial", maxIter=self.max_iter,
                                regParam=1.0 / (self.C * max(n, 1)), standardization=False)
        self.model = lr.fit(x)
        return self

    def proba(self, rows: DataFrame, target: str) -> DataFrame:
        # classes missing from the training part keep probability 0
        k = self.model.numClasses
        scored = self.model.transform(rows)
        if k < len(self.classes):
            scored = scored.withColumn("probability", F.concat(vector_to_array("probability"), F.array(*[F.lit(0.0)] * (len(self.classes) - k))))
        return long_proba(scored, self.classes, target)

    def top_features(self, vocab: DataFrame, k: int = 25) -> DataFrame:
        """(class, term, weight): the k heaviest terms per class."""
        m = self.model.coefficientMatrix
        spark = vocab.sparkSession
        rows = []
        dense = m.toArray()
        for i in range(dense.shape[0]):
            best = dense[i].argsort()[::-1][:k]
            rows += [(self.classes[i], int(j), float(dense[i, j])) for j in best]
        top = spark.createDataFrame(rows, "class string, idx int, weight double")
        return vocab.select("idx", "term").join(F.broadcast(top), "idx").select("class", "term", "weight")


# ---------------------------------------------------------------- the trained desk

class CorrectnessModel:
    """Chance that the top team is right, from calibrated probabilities."""

    NUMERIC = ["log_p_ok", "log_1m_p_ok", "margin", "entropy", "p_P1", "p_P2", "p_P3", "p_P4", "max_cat", "p_ok_x_P1", "p_ok_x_P2"]

    def __init__(self, extra: list[str] = ()):
        self.numeric = [*self.NUMERIC, *extra]

    def fit(self, feats: DataFrame) -> "CorrectnessModel":
        n = max(feats.count(), 1)
        self.model = Pipeline(stages=[
            VectorAssembler(inputCols=self.numeric, outputCol="_num", handleInvalid="keep"),
            StandardScaler(inputCol="_num", outputCol="_std", withMean=True, withStd=True),
            StringIndexer(inputCols=["product", "channel"], outputCols=["_pi", "_ci"], handleInvalid="keep"),
            OneHotEncoder(inputCols=["_pi", "_ci"], outputCols=["_ph", "_ch"], dropLast=True, handleInvalid="keep"),
            VectorAssembler(inputCols=["_std", "_ph", "_ch"], outputCol="features"),
            LogisticRegression(labelCol="y", maxIter=100, regParam=1.0 / n, standardization=False)]).fit(feats)
        return self

    def p_ok(self, feats: DataFrame) -> DataFrame:
        return self.model.transform(feats).select("ticket_id", F.element_at(vector_to_array("probability"), 2).alias("p_ok"))


class Triage:
    """Everything needed to score and decide tickets. Train once, then `score` and `decide` any batch or stream."""

    def __init__(self, known_products: list[str], classes: dict[str, list[str]], C: float = 1.0, max_iter: int = 100,
                 kinds: tuple[str, ...] = ("word",), most: dict | None = None):
        self.known_products, self.classes, self.C, self.max_iter = known_products, classes, C, max_iter
        self.space = TermSpace(kinds, **({"most": most} if most else {}))
        self.temperatures: dict[str, float] = {}

    def train(self, tickets: DataFrame, folds: int = 5, parallel: int = 4, novelty: bool = False) -> "Triage":
        """Vectors, one classifier per label, out-of-fold probabilities for the temperatures and the correctness model."""
        data = cut_lineage(intake.split_and_fold(tickets, folds=folds))
        train = data.where("split = 'train'")
        self.space.fit(train)
        self.corpus = train.select("ticket_id", *fv.REQUIRED_COLUMNS)
        vec = cut_lineage(self.space.vectors(train, keep=["fold", *self.classes]))
        jobs = [(t, f) for t in self.classes for f in [None, *range(folds)]]

        def run(job):
            t, f = job
            part = vec if f is None else vec.where(F.col("fold") != f)
            return job, TextLogistic(self.C, max_iter=self.max_iter).fit(part, t, self.classes[t])

        with ThreadPoolExecutor(parallel) as pool:
            fitted = dict(pool.map(run, jobs))
        self.models = {t: fitted[(t, None)] for t in self.classes}
        oof = [fitted[(t, f)].proba(vec.where(F.col("fold") == f).withColumn("truth", F.col(t)), t) for t in self.classes for f in range(folds)]
        self.oof = cut_lineage(reduce(DataFrame.unionByName, oof))
        for r in stats.fit_temperature(self.oof).collect():  # one row per target
            self.temperatures[r["target"]] = r["T"]
        cal = self.calibrate(self.oof)
        self.correctness = CorrectnessModel().fit(dc.correctness_features(cal, train))
        self.novelty_cut = None
        if novelty:
            val = data.where("split = 'val'")
            self.novelty_cut = self._threshold(self._novelty(val))
        return self

    def _novelty(self, docs: DataFrame) -> DataFrame:
        w = lambda d: self.space.weights(d).where("kind = 'word'")
        return matching.novelty(w(docs), w(self.corpus), docs, "ticket_id")

    @staticmethod
    def _threshold(nov: DataFrame) -> float:
        return intake.novelty_threshold(nov).first()["threshold"]

    def calibrate(self, proba: DataFrame) -> DataFrame:
        t = F.create_map(*[x for k, v in self.temperatures.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("target")]
        return stats.temperature(proba, ["ticket_id", "target"], t)

    def probabilities(self, tickets: DataFrame) -> DataFrame:
        """Calibrated long probabilities; a pure map over the tickets apart from the term join."""
        vec = self.space.vectors(tickets)
        return self.calibrate(reduce(DataFrame.unionByName, [m.proba(vec, t) for t, m in self.models.items()]))

    def score(self, tickets: DataFrame) -> DataFrame:
        x = intake.prepare(tickets, self.known_products)
        # several steps read the probabilities: written once to the shared folder
        p = cut_lineage(self.probabilities(x).withColumn("truth", F.lit(None).cast("string")))
        feats = dc.correctness_features(p, x.withColumn("assigned_team", F.lit(None).cast("string")))
        costs = dc.expected_costs(p, self.correctness.p_ok(feats))
        top = stats.top_class(p, ["ticket_id", "target"]).groupBy("ticket_id").pivot("target", ["category", "assigned_team", "sentiment"]).agg(F.first("predicted"))
        prio = dc.priority_label(p)
        p2 = p.where("target = 'priority' AND class = 'P2'").select("ticket_id", F.col("p").alias("p2"))
        out = x.join(top, "ticket_id").join(prio, "ticket_id").join(p2, "ticket_id").join(costs, "ticket_id")
        out = out.withColumn("escalation", dc.escalation(F.col("priority"), F.col("sentiment")))
        if self.novelty_cut is not None:
            out = out.join(self._novelty(x), "ticket_id", "left")
            return intake.guards(out, self.known_products, threshold=F.lit(self.novelty_cut))
        return intake.guards(out, self.known_products)

    def decide(self, tickets: DataFrame, cap: float | None = None) -> DataFrame:
        d = dc.decide(tickets if "savings" in tickets.columns else self.score(tickets), cap)
        return d.withColumn("decision", F.when(F.col("abstain") == 1, "abstain").otherwise("route")).withColumn("reason", dc.reason(cap))
