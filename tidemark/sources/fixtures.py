"""Channel and ticket tables derived from the test star schema. Every frame is lazy; nothing is collected."""
from __future__ import annotations

from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..settings import ChannelSettings

SETTINGS = ChannelSettings(
    start=date(1995, 1, 1), end=date(2001, 6, 30),
    regions=("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
    tiers=("Platinum", "Gold", "Silver", "Business"),
    families=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"),
    partner_types=("Distributor", "Reseller", "Service Provider"))

KNOWN_PRODUCTS = [f"src{i}" for i in range(17)]
CHANNELS = ["email", "portal", "chat"]
PRIORITIES = ["P1", "P2", "P3", "P4"]
CLASSES = {"priority": ["P1", "P2", "P3", "P4"], "category": ["de", "en", "es", "fr"],
           "assigned_team": ["team_de", "team_en", "team_es", "team_fr", "team_x"]}
CLASS_STEPS = {"P1": 31, "P2": 37, "P3": 41, "P4": 43, "en": 47, "fr": 53, "de": 59, "es": 61,
               "team_en": 67, "team_fr": 71, "team_de": 73, "team_es": 79, "team_x": 83}

# Phrases put behind the document text, so that the phrase rules have something to find.
PHRASES = ["Only one user is affected.", "All customers on the platform see this.", "This box runs our production ERP.",
           "It is in our test environment.", "There is a manual workaround but it is slow.",
           "Marking this urgent.", "low priority, just curious", "about 40 users are affected, r u there? pls call",
           "", "", "", "several vms on it are affectd today", "go-live is tomorow morning"]
SEVERITY_WORDS = ["Low", "Critical", "hgih", "medum", "critcal", "banana", "High", "lwo", "Medium"]


# Schemas are stated, not inferred: a read then costs no extra job and a changed file fails loudly.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


class Channel:
    """The three business tables of the channel workload, over one directory of parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str, settings: ChannelSettings = SETTINGS):
        self.spark, self.dir, self.settings = spark, sf_dir, settings

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.dir, name)

    @cached_property
    def master(self) -> DataFrame:
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        places = n.join(r, n.n_regionkey == r.r_regionkey)
        k = F.col("c_custkey")
        tier = F.create_map(*[F.lit(x) for x in ("AUTOMOBILE", "Platinum", "BUILDING", "Gold", "FURNITURE", "Silver")])
        kinds = F.array(*[F.lit(x) for x in self.settings.partner_types])
        return c.join(places, c.c_nationkey == places.n_nationkey).select(
            k.alias("partner_id"), F.col("c_name").alias("partner_name"), F.col("r_name").alias("region"),
            F.coalesce(tier[F.col("c_mktsegment")], F.lit("Business")).alias("tier"),
            kinds[(k % 3).cast("int")].alias("partner_type"), F.col("n_name").alias("country"),
            F.date_add(F.lit(date(1993, 1, 1)), ((k * 37) % 2920).cast("int")).alias("onboarded_date"))

    def _orders(self) -> DataFrame:
        """Orders of the window."""
        s = self.settings
        return self.table("orders").where(
            (F.col("o_orderdate") >= F.lit(s.start).cast("timestamp_ntz"))
            & (F.col("o_orderdate") < F.lit(s.end + timedelta(days=1)).cast("timestamp_ntz")))

    def _priced(self, orders: DataFrame, attributes: list[str] = ()) -> DataFrame:
        """Lines of the orders with their family and revenue, and attributes that the orders carry."""
        lines = (self.table("lineitem")
                 .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
                 .join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")))
        price = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
        return lines.select(
            F.col("o_orderdate").cast("date").alias("order_date"), F.col("o_custkey").alias("partner_id"), *attributes,
            F.col("p_type").alias("product_family"), F.col("l_quantity").cast("long").alias("quantity"),
            price.cast("decimal(18,4)").alias("revenue_usd"),
            (5 + F.col("l_partkey") % 16).cast("decimal(5,2)").alias("margin_pct"))

    @cached_property
    def line_values(self) -> DataFrame:
        """(product_family, revenue_usd) of every sales line, for the outlier limits: no partner join needed."""
        corrupt = self.table("customer").where("c_custkey = 18").select(
            F.lit("PROMO").alias("product_family"), F.lit(37800000).cast("decimal(18,4)").alias("revenue_usd"))
        return self._priced(self._orders()).select("product_family", "revenue_usd").unionByName(corrupt)

    @cached_property
    def sales(self) -> DataFrame:
        # partners go to the orders, which are fewer than the lines, so that the lines move once
        who = ["partner_name", "region", "tier"]
        orders = self._orders().join(self.master.select("partner_id", *who), F.col("o_custkey") == F.col("partner_id")).drop("partner_id")
        real = self._priced(orders, who).select(
            "order_date", "partner_id", "partner_name", "region", "tier", "product_family", "quantity",
            "revenue_usd", "margin_pct")
        corrupt = self.master.where("partner_id = 18").select(
            F.lit(date(2001, 3, 27)).alias("order_date"), "partner_id", "partner_name", "region", "tier",
            F.lit("PROMO").alias("product_family"), F.lit(12800).cast("long").alias("quantity"),
            F.lit(37800000).cast("decimal(18,4)").alias("revenue_usd"),
            F.lit(10).cast("decimal(5,2)").alias("margin_pct"))
        return real.unionByName(corrupt)

    @cached_property
    def targets(self) -> DataFrame:
        s = self.settings
        q = F.explode(F.sequence(F.lit(0), F.lit(s.last_q - s.first_q))).alias("q")
        from ..functions.calendar import label_of_index
        from ..operators.facts import spread
        return (spread(self.master.where("partner_id % 10 <> 0").select("partner_id")).select("partner_id", q)
                .select("partner_id", label_of_index(F.lit(s.first_q) + F.col("q")).alias("quarter"),
                        (F.lit(40000) + 1000 * (F.col("partner_id") % 60) + 2000 * F.col("q"))
                        .cast("decimal(18,4)").alias("target_usd")))


class Desk:
    """Tickets over the documents: labelled ones with truth, all of them as the raw inbox."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.dir, name)

    @cached_property
    def inbox(self) -> DataFrame:
        """Every document as an unlabelled ticket; portal tickets carry a severity tag, some a known phrase."""
        d = F.col("doc_id")
        phrase = F.array(*[F.lit(p) for p in PHRASES])[(d % len(PHRASES)).cast("int")]
        sev = F.array(*[F.lit(w) for w in SEVERITY_WORDS])[(d % len(SEVERITY_WORDS)).cast("int")]
        tag = F.when(d % 3 == 1, F.concat(F.lit("[Customer-selected severity: "), sev, F.lit("] "))).otherwise("")
        channel = F.array(*[F.lit(c) for c in CHANNELS])[(d % 3).cast("int")]
        return self.table("documents").select(
            d.alias("ticket_id"), channel.alias("channel"), F.substring("text", 1, 40).alias("subject"),
            F.concat(tag, F.col("text"), F.lit(" "), phrase).alias("body"), F.col("source").alias("product"))

    @cached_property
    def tickets(self) -> DataFrame:
        d = F.col("doc_id")
        toxic, good = F.col("toxic") == 1, F.col("quality") == 0
        channel = F.array(*[F.lit(c) for c in CHANNELS])[(d % 3).cast("int")]
        return self.table("documents").join(self.table("labels"), "doc_id").select(
            d.alias("ticket_id"), channel.alias("channel"), F.substring("text", 1, 40).alias("subject"),
            F.col("text").alias("body"), F.col("source").alias("product"), F.col("lang").alias("category"),
            F.when(toxic & good, "P1").when(toxic, "P2").when(good, "P3").otherwise("P4").alias("priority"),
            F.when(F.col("source").isin("src3", "src7"), "team_x")
            .otherwise(F.concat(F.lit("team_"), F.col("lang"))).alias("assigned_team"),
            F.when(toxic, "Angry").when(good, "Frustrated").when(d % 5 == 0, "Positive")
            .otherwise("Neutral").alias("sentiment"))

    def scored(self, steps: dict[str, int] = CLASS_STEPS, boost: int = 60) -> DataFrame:
        """Arithmetic stand-in for model output, long form (ticket_id, target, class, p, truth)."""
        from pyspark.sql import Window
        grid = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(c).alias("class"), F.lit(steps[c]).alias("m"))
                         for t, cs in CLASSES.items() for c in cs])
        x = self.tickets.select("ticket_id", "priority", "category", "assigned_team", F.explode(grid).alias("g"))
        truth = (F.when(F.col("g.target") == "priority", F.col("priority"))
                 .when(F.col("g.target") == "category", F.col("category")).otherwise(F.col("assigned_team")))
        w = 1 + (F.col("ticket_id") * F.col("g.m")) % 97 + F.when(truth == F.col("g.class"), boost).otherwise(0)
        per = Window.partitionBy("ticket_id", "target")
        return (x.select("ticket_id", F.col("g.target").alias("target"), F.col("g.class").alias("class"),
                         truth.alias("truth"), w.alias("w"))
                .select("ticket_id", "target", "class", "truth",
                        (F.col("w").cast("double") / F.sum("w").over(per)).alias("p")))

    @cached_property
    def proba(self) -> DataFrame:
        return self.scored()

    @cached_property
    def proba_second(self) -> DataFrame:
        """A second, weaker model over the same tickets."""
        return self.scored({c: m + 6 for c, m in CLASS_STEPS.items()}, boost=40)
