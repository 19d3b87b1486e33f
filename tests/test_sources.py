"""Text files with stated schemas, results in both formats, and stored tables that follow their input."""
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import decisions
from tidemark.operators.ranking import global_rank, running_totals
from tidemark.settings import ChannelSettings
from tidemark.sources import tables_io

SETTINGS = ChannelSettings(regions=("AMS", "APJ"), tiers=("Gold", "Silver"), families=("A", "B"), partner_types=("Reseller",))


def put(folder, name, *lines):
    (folder / name).write_text("\n".join(lines) + "\n")


def channel(folder, region="AMS"):
    put(folder, "partner_sales.csv", "order_date,partner_id,partner_name,region,tier,product_family,quantity,revenue_usd,margin_pct",
        f"2024-02-03,P1,One,{region},Gold,A,3,120.5,11.25", "2024-05-06,P2,Two,APJ,Silver,B,1,9.99,")
    put(folder, "partner_master.csv", "partner_id,partner_name,partner_type,tier,region,country,onboarded_date", "P1,One,Reseller,Gold,AMS,US,2020-01-02", "P2,Two,Reseller,Silver,APJ,JP,")
    put(folder, "targets.csv", "partner_id,quarter,target_usd", "P1,2024-Q1,1000")


def test_channel_files(spark, tmp_path):
    channel(tmp_path)
    sales, master, targets = tables_io.read_channel(spark, str(tmp_path), SETTINGS)
    rows = {r.partner_id: r for r in sales.collect()}
    assert rows["P1"].order_date == date(2024, 2, 3) and rows["P1"].quantity == 3 and float(rows["P1"].revenue_usd) == 120.5
    assert rows["P2"].margin_pct is None
    assert {r.partner_id: r.onboarded_date for r in master.collect()} == {"P1": date(2020, 1, 2), "P2": None}
    assert [(r.partner_id, r.quarter, float(r.target_usd)) for r in targets.collect()] == [("P1", "2024-Q1", 1000.0)]


def test_channel_values_outside_their_domain_stop_the_read(spark, tmp_path):
    channel(tmp_path, region="MARS")
    with pytest.raises(Exception, match="MARS|region"):
        tables_io.read_channel(spark, str(tmp_path), SETTINGS)[0].collect()


def test_ticket_files_with_quotes_and_line_ends(spark, tmp_path):
    put(tmp_path, "t.csv", "ticket_id,channel,subject,body,product,category,priority,assigned_team,sentiment", '1,email,"a ""quoted"" subject","two\nlines, one field",box,en,P1,team_en,Angry', "2,chat,,,box,,,,")
    rows = {r.ticket_id: r for r in tables_io.read_tickets(spark, str(tmp_path / "t.csv")).collect()}
    assert rows["1"].subject == 'a "quoted" subject' and rows["1"].body == "two\nlines, one field" and rows["1"].sentiment == "Angry"
    assert rows["2"].body is None


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_results_in_every_format(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    for _ in range(2):  # written again, not added
        tables_io.write_result(df, str(tmp_path / "out"), fmt)
    back = spark.read.schema(df.schema).option("header", True).format(fmt).load(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, "b")]


def test_stored_table_follows_its_input(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(3).write.parquet(f"{folder}/x")

    def stored():
        return session.stored_table(spark, folder, "x", lambda: spark.read.parquet(f"{folder}/x"))

    assert stored().count() == 3 and stored().inputFiles() == stored().inputFiles()
    spark.range(5).write.mode("overwrite").parquet(f"{folder}/x")
    assert stored().count() == 5


def test_other_sessions_must_name_the_shared_folder(spark):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)


def test_buckets_hold_ties_and_edges(spark):
    for n, buckets in ((0, 4), (1, 4), (7, 16), (500, 3), (500, 40)):
        df = spark.range(n).select("id", (F.col("id") % 5).alias("v"))
        got = {r.id: r.rn for r in running_totals(df, [F.col("v"), F.col("id")], {"rn": F.lit(1).cast("long")}, buckets=buckets).collect()}
        want = {i: k + 1 for k, (_, i) in enumerate(sorted((i % 5, i) for i in range(n)))}
        assert got == want
    assert global_rank(spark.range(0), [F.col("id")]).count() == 0


def test_cost_files(spark, tmp_path):
    put(tmp_path, "costs.csv", "true_priority,outcome,cost", "P1,misroute,2.5", "P1,abstain,0.5", "P1,correct,0", "P4,misroute,0.25")
    rows = {r.true_priority: r for r in decisions.read_costs(spark, str(tmp_path / "costs.csv")).collect()}
    assert (rows["P1"].correct, rows["P1"].misroute, rows["P1"].abstain) == (0.0, 2.5, 0.5)
    assert rows["P4"].misroute == 0.25 and rows["P4"].abstain is None
