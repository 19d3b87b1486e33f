"""Reading business tables with stated schemas, and writing results."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import quality
from ..settings import ChannelSettings

SALES = ("order_date date, partner_id string, partner_name string, region string, tier string, product_family string, quantity long, "
         "revenue_usd decimal(18,4), margin_pct decimal(7,4)")
MASTER = "partner_id string, partner_name string, partner_type string, tier string, region string, country string, onboarded_date date"
TARGETS = "partner_id string, quarter string, target_usd decimal(18,4)"


def read_channel(spark: SparkSession, folder: str, settings: ChannelSettings, fmt: str = "csv") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sales, master, targets) with dimension values checked against their domains while the rows are read."""
    def read(name: str, schema: str) -> DataFrame:
        r = spark.read.schema(schema)
        return (r.option("header", True).csv(f"{folder}/{name}.csv") if fmt == "csv" else r.format(fmt).load(f"{folder}/{name}"))
    sales, master = read("partner_sales", SALES), read("partner_master", MASTER)
    return quality.require_domains(sales, settings.domains), quality.require_domains(master, settings.domains), read("targets", TARGETS)


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    schema = ("ticket_id string, channel string, subject string, body string, product string, category string, priority string, "
              "assigned_team string, sentiment string")
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as parquet; tables with a quarter are partitioned by it, so that a quarter filter prunes files."""
    for name, df in tables.items():
        w = df.repartition(F.col("quarter")) if "quarter" in df.columns and name != "sales" else df
        out = w.write.mode("overwrite")
        (out.partitionBy("quarter") if "quarter" in df.columns else out).parquet(f"{folder}/{name}")


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def publish(spark: SparkSession, folder: str, sections: dict, version: str) -> DataFrame:
    """All-or-nothing refresh: every section is written under a new version, and only when all mandatory ones are there
    is the pointer moved. A failed optional section is reported and leaves the others.

    `sections` maps a name to (build, mandatory). Returns one status row per section."""
    status, failed = [], False
    for name, (build, mandatory) in sections.items():
        try:
            build().write.mode("overwrite").parquet(f"{folder}/version={version}/{name}")
            status.append((name, "ok", ""))
        except Exception as exc:  # noqa: BLE001 - reported as a row
            status.append((name, "failed", f"{type(exc).__name__}: {str(exc)[:200]}"))
            failed = failed or mandatory
    rows = spark.createDataFrame(status, "section string, status string, detail string").withColumn("published", F.lit(not failed))
    if not failed:
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder}/current")
    return rows


def read_published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{folder}/current").first()["version"]
    return spark.read.parquet(f"{folder}/version={version}/{name}")
