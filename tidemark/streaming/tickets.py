"""Ticket decisions on a stream. Scoring is stateless, so a stream gives the same columns as a batch; the capacity cap
applies per micro-batch, because a share of an endless stream has no fixed size."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as fv
from ..operators import decisions as dc
from ..operators import intake

TICKET_SCHEMA = "ticket_id string, channel string, subject string, body string, product string"


def read_tickets(spark: SparkSession, path: str, files_per_batch: int | None = 100, fmt: str = "parquet", schema: str = TICKET_SCHEMA) -> DataFrame:
    """A stream of ticket files. Without `files_per_batch` a trigger takes all files that have come."""
    rows = spark.readStream.schema(schema).format(fmt)
    return (rows.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else rows).load(path)


def decide_stream(scored: DataFrame) -> DataFrame:
    """Hand off where it saves money or a guard fires; row by row, so it may run on a stream or a batch."""
    out = F.col("guarded") | (F.col("savings") > 0)
    return scored.withColumn("abstain", out.cast("int")).withColumn("decision", F.when(out, "abstain").otherwise("route"))


def wide_costs(priorities: dict[str, str], p_ok: str) -> dict:
    """Expected costs from probability columns of one row, without a grouping: fit for a stream. `priorities` maps a
    priority to its column."""
    w = sum((F.col(c) * F.lit(dc.MISROUTE[p]) for p, c in priorities.items()), F.lit(0.0))
    a = sum((F.col(c) * F.lit(dc.ABSTAIN[p]) for p, c in priorities.items()), F.lit(0.0))
    return {"e_route": (1 - F.col(p_ok)) * w, "e_abstain": a, "savings": (1 - F.col(p_ok)) * w - a}


def guard_stream(tickets: DataFrame, known_products: list[str]) -> DataFrame:
    return intake.guards(intake.prepare(tickets, known_products), known_products)


def start_uncapped(scored: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    w = decide_stream(scored).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def start_capped(tickets: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, cap: float = fv.MAX_ABSTAIN_RATE,
                 hard: bool = False, once: bool = False) -> StreamingQuery:
    """Decide every micro-batch under floor(cap * n). The batch id is part of the path, so a repeated batch overwrites
    its own rows."""
    def one(batch: DataFrame, batch_id: int) -> None:
        x = score(batch)
        d = dc.decide_hard_cap(x, cap) if hard else dc.decide(x, cap)
        d.withColumn("decision", F.when(F.col("abstain") == 1, "abstain").otherwise("route")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    w = tickets.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
