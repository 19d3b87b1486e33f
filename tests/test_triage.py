import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions as dc
from tidemark.operators import intake, stats
from tidemark.sources.fixtures import CLASSES, Desk


def scored(spark, savings, guarded=(), route=None):
    rows = [(i, float(s), i in guarded, float((route or {}).get(i, s))) for i, s in enumerate(savings)]
    return spark.createDataFrame(rows, "ticket_id long, savings double, guarded boolean, e_route double")


def handed(df):
    return sorted(r["ticket_id"] for r in df.where("abstain = 1").collect())


def test_cap_takes_guards_first_then_the_largest_savings(spark):
    s = scored(spark, [5, 4, 3, 2, 1] + [-1] * 15, guarded={10})
    assert handed(dc.decide(s, 0.15)) == [0, 1, 10]
    assert handed(dc.decide(s)) == [0, 1, 2, 3, 4, 10]
    assert handed(dc.decide(s, 0.15, use_guards=False)) == [0, 1, 2]


def test_ties_at_the_cap_go_to_the_smaller_id(spark):
    assert handed(dc.decide(scored(spark, [1.0] * 20), 0.15)) == [0, 1, 2]


def test_guards_may_exceed_the_cap_unless_it_is_hard(spark):
    s = scored(spark, [-1] * 20, guarded={1, 2, 3, 4}, route={1: 0.1, 2: 0.9, 3: 0.5, 4: 0.7})
    assert handed(dc.decide(s, 0.10)) == [1, 2, 3, 4]
    assert handed(dc.decide_hard_cap(s, 0.10)) == [2, 4]


def test_intake_rules(spark):
    rows = [("1", "EMAIL ", "s", "hi", "src1"), ("1", "fax", None, None, " SRC2 "), (" ", "chat", "", "long enough body text", "other")]
    df = spark.createDataFrame(rows, "ticket_id string, channel string, subject string, body string, product string")
    got = {r["rule"]: r["n"] for r in intake.check_batch(df).collect()}
    assert got == {"no rows": 0, "blank ticket_id": 1, "duplicate ticket_id": 1, "invalid channel": 1}
    assert intake.check_batch(df.drop("body")).first()["rule"] == "missing columns"
    with pytest.raises(ValueError, match="body"):
        intake.prepare(df.drop("body"), ["src1"])
    g = intake.guards(intake.prepare(df, ["src1", "src2"]), ["src1", "src2"]).collect()
    assert [r["product"] for r in g] == ["src1", "src2", "other"]
    assert [r["guard_flags"] for r in g] == [["short_body"], ["short_body"], ["unknown_product"]]


def test_csv_intake(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes('﻿ticket_id, channel ,subject,body,product\nX-1,email,a,"two\nlines",src1\n'.encode())
    df = intake.read_batch(spark, str(p))
    assert df.columns == ["ticket_id", "channel", "subject", "body", "product"] and df.first()["body"] == "two\nlines"


def test_auc_and_average_precision_by_brute_force(spark):
    rng = np.random.default_rng(4)
    y, x = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    df = spark.createDataFrame([(1, int(a), float(b)) for a, b in zip(y, x)], "g int, y int, x double")
    pos, neg = x[y == 1], x[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert np.isclose(stats.auc(df, ["g"], "y", "x").first()["auc"], want)
    ap, seen = 0.0, 0
    for v in sorted(set(x), reverse=True):
        k = y[x >= v].sum()
        ap += (k - seen) / y.sum() * k / (x >= v).sum()
        seen = k
    assert np.isclose(stats.average_precision(df, ["g"], "y", "x").first()["average_precision"], ap)


def test_bootstrap_interval_covers_the_point(spark):
    df = spark.createDataFrame([(1, float(d)) for d in ([-1.0] * 30 + [0.0] * 60 + [0.5] * 10)], "g int, d double")
    r = stats.mean_difference_bootstrap(df, ["g"], "d", boot=200).first()
    assert np.isclose(r["diff"], -0.25) and r["lo"] < -0.25 < r["hi"] < 0 and r["share_ge_0"] == 0


def test_fisher():
    assert np.isclose(stats._fisher(8, 10, 1, 6), 0.0350, atol=1e-3)


def test_temperature_recovers_sharpness(spark, sf):
    p = Desk(spark, sf).proba
    t = {r["target"]: r["T"] for r in stats.fit_temperature(stats.temperature(p, ["ticket_id", "target"], F.lit(3.0)), rounds=2).collect()}
    u = {r["target"]: r["T"] for r in stats.fit_temperature(p, rounds=2).collect()}
    assert all(np.isclose(t[k] * 3.0, u[k], rtol=0.15) for k in t)


def test_split_is_disjoint_and_stratified(spark, sf):
    x = intake.split_and_fold(Desk(spark, sf).tickets, rare=3)
    assert all(r["n"] == 0 for r in intake.split_checks(x, Desk(spark, sf).tickets).collect())
    assert {r["split"] for r in x.select("split").distinct().collect()} == {"train", "val", "test"}


def test_probability_checks_find_a_bad_row(spark, sf):
    from tidemark.plans.triage import check_probabilities
    d = Desk(spark, sf)
    first = d.tickets.agg(F.min("ticket_id")).first()[0]
    bad = d.proba.withColumn("p", F.when((F.col("ticket_id") == first) & (F.col("class") == "P1"), 5.0).otherwise(F.col("p")))
    assert {r["rule"]: r["n"] for r in check_probabilities(bad, d.tickets, CLASSES).collect()}["row does not sum to 1"] == 1


def test_default_ids_hang_on_the_content_alone(spark, monkeypatch):
    monkeypatch.setattr(intake, "COPIES", 7)
    rows = [("email", f"s{i % 9}", None if i % 5 == 0 else f"b{i % 13}", "p") for i in range(200)] + [("chat", "same", "same", None)] * 60
    df = spark.createDataFrame(rows, "channel string, subject string, body string, product string")
    a, b = (sorted(tuple(r) for r in intake.numbered(x).fillna("-").collect()) for x in (df.repartition(3), df.repartition(5, "body")))
    assert a == b and len(a) == 260
    assert sorted(r[-1] for r in a) == [f"T-{i:06d}" for i in range(1, 261)]
    assert intake.prepare(df.drop("ticket_id"), ["p"]).select("ticket_id").distinct().count() == 260
    assert intake.numbered(df.limit(0)).count() == 0
