from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import numeric as nm
from tidemark.operators import facts, features as ft
from tidemark.plans import dashboard as db
from tidemark.plans import insights as ins
from tidemark.plans import revenue as rv
from tidemark.plans.selection import Selection
from tidemark.sources import tables_io
from tidemark.sources.fixtures import SETTINGS, Channel


@pytest.fixture(scope="module")
def t(spark, sf):
    return facts.ChannelTables.stored(Channel(spark, sf))


def features_of(base, master, targets, cutoff):
    h = ft.partner_history(base, master, targets, SETTINGS)
    return ft.build_panel(h, [cutoff], SETTINGS, label=False).toPandas().sort_values("partner_id").reset_index(drop=True)


def test_no_future_leakage(t):
    cutoff = "2000-Q3"
    end = cal.qend(cutoff)
    full = features_of(t.base, t.master, t.targets, cutoff)
    past = features_of(t.base.where(F.col("order_date") <= F.lit(end)), t.master, t.targets.where(F.col("quarter") <= cutoff), cutoff)
    assert full.equals(past)
    assert list(full.columns) == ["partner_id", "cutoff", *ft.feature_names(SETTINGS)]
    num = full[ft.numeric_features(SETTINGS)].astype(float)
    assert not np.isinf(num.to_numpy()).any()
    for c in ("rev_growth_qoq", "yoy_q1", "yoy_2q", "lines_yoy_2q"):
        assert num[c].dropna().between(-1, 1).all()
    shares = [c for c in num if c.startswith("share_")] + ["product_hhi_2q", "active_month_share_6m"]
    assert all(num[c].dropna().between(0, 1).all() for c in shares)


def test_labels_need_the_next_quarter():
    with pytest.raises(ValueError):
        ft.require_next_quarter([SETTINGS.score_cutoff], SETTINGS)


def test_label_order(t):
    y = ft.snapshots(ft.partner_history(t.base, t.master, t.targets, SETTINGS), ["2000-Q2"], SETTINGS).select(*ft.LABELS).toPandas()
    assert (y["left_zero"] <= y["left_token"]).all() and (y["left_persistent"].dropna() <= y["left_token"][y["left_persistent"].notna()]).all()


def test_region_parts_sum_to_total(t):
    tr = db.trend(t, Selection()).toPandas()
    assert np.allclose(tr[list(SETTINGS.regions)].astype(float).sum(axis=1), tr["total"].astype(float))
    assert db.trend(t, Selection(region=("NOWHERE",))).count() == 0
    with pytest.raises(ValueError):
        db.breakdown(t, Selection(), "colour")


def test_selection_of_a_request(t):
    s = Selection.of({"region": " ASIA, EUROPE,", "tier": "", "to": "2000-Q4"})
    assert s.values("region") == ("ASIA", "EUROPE") and not s.narrows("tier") and (s.first, s.last) == (None, "2000-Q4")
    got = s.rows(t.base_typed, dated=True).agg(F.collect_set("region"), F.max("quarter")).first()
    assert set(got[0]) <= {"ASIA", "EUROPE"} and got[1] <= "2000-Q4"
    assert Selection(product_family=("NOWHERE",)).rows(t.master).count() == t.master.count()
    with pytest.raises(ValueError):
        Selection(colour=("red",))


def test_grid_drops_orders_before_onboarding(t):
    early = t.base.join(t.master.select("partner_id", "onboarded_date"), "partner_id").where(F.col("month") < cal.month_start(F.col("onboarded_date")))
    grid = t.partner_month.agg(F.sum("order_lines")).first()[0]
    assert grid + early.count() == t.base.count()


def test_numeric_rules(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 0.0), (None, 2.0)], "a double, b double")
    got = df.select(nm.sym_growth(F.col("b"), F.col("a")).alias("g"), nm.clip_upper(F.col("a"), 0.5).alias("c"), nm.ratio(F.col("b"), F.col("a")).alias("r"),
                    nm.money_text(F.col("b") * 1e6).alias("m"), nm.sym_to_change(F.lit(1 / 3)).alias("s")).collect()
    assert [r["g"] for r in got] == [0.5, None, None] and [r["c"] for r in got] == [0.5, 0.0, None] and [r["r"] for r in got] == [3.0, None, None]
    assert got[0]["m"] == "$3.0M" and abs(got[0]["s"] - 1.0) < 1e-12


def test_unknown_dimension_value_fails_loudly(spark):
    from tidemark.operators.quality import require_domains
    df = spark.createDataFrame([("Gold",), ("Tin",)], "tier string")
    with pytest.raises(Exception, match="Unexpected value in tier"):
        require_domains(df, {"tier": ["Gold"]}).collect()


def test_forecast_uses_only_the_past(spark):
    rows = [("x", 8000 + i, 100.0 + 10 * i, 90.0 + 10 * i) for i in range(12)]
    months = [("x", 8000 * 3 + i, 30.0 + i + (10 if i % 3 == 2 else 0)) for i in range(36)]
    q = spark.createDataFrame(rows, "area string, q int, revenue double, target double")
    m = spark.createDataFrame(months, "area string, m int, revenue double")
    T = cal.qlabel(8010)
    past_q, past_m = q.where("q < 8010"), m.where("m < 24030")
    key = lambda d: {(r["area"], r["method"]): r["forecast"] for r in d.collect()}
    full, past = key(rv.forecast_all(q, m, [T], 1)), key(rv.forecast_all(past_q, past_m, [T], 1))
    assert full == past and all(v is not None for v in full.values())
    tampered = q.withColumn("target", F.when(F.col("q") == 8010, F.col("target") * 10).otherwise(F.col("target")))
    assert key(rv.forecast_all(tampered, m, [T], 1)) == full
    truth = sum(v for _, mm, v in months if 24030 <= mm < 24033)
    assert abs(full[("x", "regression")] / truth - 1) < 0.15 and abs(full[("x", "arima")] / truth - 1) < 0.15 and abs(full[("x", "sarimax")] / truth - 1) < 0.15


def test_t_quantiles():
    assert abs(rv.t_quantile(0.9, 14) - 1.3450) < 1e-3 and abs(rv.t_quantile(0.9, 4) - 1.5332) < 1e-3


def test_adjustment_is_zero_at_the_normal_share(spark):
    shares = spark.createDataFrame([(c, r, 0.004) for c in ("2000-Q1", "2000-Q2") for r in ("A", "B")], "cutoff string, region string, share double")
    loo = spark.createDataFrame([("2000-Q2", r, 100.0, 101.0) for r in ("A", "B", "ALL")], "quarter string, area string, forecast_corrected double, actual double")
    got = rv.churn_backtest(shares, loo).collect()
    assert got and all(abs(r["adjustment"]) < 1e-12 for r in got)


def test_insights_survive_a_failing_card(t):
    def broken(_):
        raise RuntimeError("no")
    cards, status = ins.build_insights(t, {"margin_mix": ins.margin_mix, "broken": broken})
    assert set(cards) == {"margin_mix"} and {r["card"]: r["status"] for r in status.collect()} == {"margin_mix": "ok", "broken": "failed"}


def test_publish_keeps_the_old_version_on_failure(spark, tmp_path):
    ok = lambda v: (lambda: spark.createDataFrame([(v,)], "v int"))
    def fail():
        raise RuntimeError("no")
    assert tables_io.publish(spark, str(tmp_path), {"a": (ok(1), True)}, "1").first()["published"]
    rows = tables_io.publish(spark, str(tmp_path), {"a": (ok(2), True), "b": (fail, True)}, "2").collect()
    assert not rows[0]["published"] and tables_io.read_published(spark, str(tmp_path), "a").first()["v"] == 1


def test_save_and_read_back(spark, tmp_path, t):
    tables_io.save_tables({"targets": t.targets.limit(50)}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/targets").count() == 50
    assert date(2000, 3, 31) == cal.qend("2000-Q1")
