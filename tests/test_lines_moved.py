"""How often lines move on their way to the prepared tables."""
from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts
from tidemark.sources.fixtures import SETTINGS, Channel


@pytest.fixture
def shuffled_joins(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def moves(df, column: str) -> int:
    """Exchanges below which `column` is read."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(re.match(r"[\s:+*|-]*(\(\d+\))?\s*", line).group(0))
    at = next(i for i, line in enumerate(plan) if "Scan parquet" in line and column in line)
    found, level = 0, depth(plan[at])
    for line in reversed(plan[:at]):
        if depth(line) < level:
            level = depth(line)
            found += "Exchange hashpartitioning" in line or "Exchange REPARTITION" in line
    return found


def test_lines_move_for_orders_and_products_only(spark, sf, shuffled_joins):
    assert moves(Channel(spark, sf).sales, "l_quantity") == 2


def test_lines_are_written_where_they_lie(spark, sf, monkeypatch):
    built = {}
    monkeypatch.setattr(facts, "stored_table", lambda session, folder, name, build, partition_by=(): built.setdefault(name, build()))
    plan = facts.ChannelTables.stored(Channel(spark, sf)).clean._jdf.queryExecution().optimizedPlan().toString()
    assert list(built) == ["lines"] and "Repartition" not in plan


def test_a_set_counts_like_a_distinct_count(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (2, "c"), (3, None)], "k int, v string")
    out = rows.groupBy("k").agg(facts.distinct("v").alias("n"), F.countDistinct("v").alias("m"))
    assert out.schema["n"].dataType == out.schema["m"].dataType
    assert sorted(map(tuple, out.collect())) == [(1, 2, 2), (2, 1, 1), (3, 0, 0)]


def test_partner_facts_move_once_for_their_families(spark, sf):
    t = facts.ChannelTables.of(Channel(spark, sf))
    plan = facts.partner_month(t.clean, t.master, SETTINGS)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(partner_id#\d+L, month#\d+, product_family", plan)
