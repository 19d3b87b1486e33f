"""The grid and the targets are unfolded by many tasks, however few read the partners."""
from pyspark.sql import functions as F

from tidemark.operators import facts
from tidemark.sources.fixtures import Channel


def test_partners_are_spread_before_they_unfold(spark, sf):
    t = facts.ChannelTables.of(Channel(spark, sf))
    master = t.master.coalesce(1)
    grid = facts.partner_month(t.base, master, t.settings)
    assert grid.select(F.spark_partition_id()).distinct().count() > 1
    assert t.targets.select(F.spark_partition_id()).distinct().count() > 1
    lines = t.base.groupBy("partner_id", "month").agg(F.sum("quantity").alias("q"))
    inside = lines.join(master, "partner_id").where(F.col("month") >= F.trunc("onboarded_date", "MM"))
    assert grid.agg(F.sum("quantity")).first()[0] == inside.agg(F.sum("q")).first()[0]
    assert grid.groupBy("partner_id", "month").count().where("count > 1").isEmpty()
