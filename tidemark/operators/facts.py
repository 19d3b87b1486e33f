"""Cleaned lines, the regular partner grid and the tables built on it."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import calendar as cal
from ..functions.numeric import ratio, ratio_pos
from ..session import stored_table
from ..settings import ChannelSettings, DAYS_PER_MONTH, OUTLIER_MULTIPLE, OUTLIER_QUANTILE, RAMPING_MONTHS
from .ranking import exact_quantiles


def enrich_lines(sales: DataFrame) -> DataFrame:
    return sales.withColumns({
        "month": cal.month_start(F.col("order_date")),
        "quarter": cal.quarter_label(F.col("order_date")),
        "year": F.year("order_date"),
        "margin_usd": (F.col("revenue_usd") * F.col("margin_pct") / 100).cast("decimal(22,6)"),
        "unit_price": ratio(F.col("revenue_usd"), F.col("quantity")),
    })


def outlier_limits(sales: DataFrame, multiple: float = OUTLIER_MULTIPLE) -> DataFrame:
    """product_family -> the revenue above which a line counts as an outlier."""
    q = exact_quantiles(sales, ["product_family"], "revenue_usd", {"p99": OUTLIER_QUANTILE}, few_groups=True)
    return q.select("product_family", (F.col("p99") * multiple).alias("outlier_above"))


def flag_outliers(lines: DataFrame, sales: DataFrame | None = None, multiple: float = OUTLIER_MULTIPLE) -> DataFrame:
    limits = outlier_limits(lines if sales is None else sales, multiple)
    limits = F.broadcast(limits)  # a row for each product family: a stated domain, checked at intake
    return (lines.join(limits, "product_family", "left")
            .withColumn("is_outlier", F.coalesce(F.col("revenue_usd").cast("double") > F.col("outlier_above"),
                                                 F.lit(False)))
            .drop("outlier_above"))


def clean_lines(sales: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """Every line, with calendar and margin columns and the outlier flag. `values` may name a cheaper source of the
    same (product_family, revenue_usd) pairs."""
    return flag_outliers(enrich_lines(sales), sales if values is None else values)


def base_lines(sales: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """The lines every aggregate is built on: outliers left out."""
    return clean_lines(sales, values).where(~F.col("is_outlier"))


def attach_partner(lines: DataFrame, master: DataFrame, settings: ChannelSettings) -> DataFrame:
    """Many-to-one: partner type, country, onboarding date, cohort and tenure at the order."""
    attrs = master.select("partner_id", "partner_type", "country", "onboarded_date")
    return lines.join(attrs, "partner_id", "left").withColumns({
        "cohort": cohort(F.col("onboarded_date"), settings),
        "tenure_months": tenure(F.col("order_date"), F.col("onboarded_date")),
    })


def cohort(onboarded: Column, settings: ChannelSettings) -> Column:
    return F.when(onboarded < F.lit(settings.start), settings.cohort_old).otherwise(settings.cohort_new)


def tenure(at: Column, onboarded: Column) -> Column:
    return F.bround(F.datediff(at, onboarded) / DAYS_PER_MONTH, 1)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break a many-to-one join; empty when the right side is unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def clean_targets(targets: DataFrame) -> DataFrame:
    q = F.col("quarter")
    return targets.withColumns({"quarter_start": cal.quarter_start(q), "quarter_end": cal.quarter_end(q)})


def rollup_measures() -> list[Column]:
    return [F.sum("revenue_usd").alias("revenue_usd"), F.sum("margin_usd").alias("margin_usd"),
            F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("order_lines"),
            F.countDistinct("partner_id").alias("partners")]


def aggregate(lines: DataFrame, by: list[str]) -> DataFrame:
    out = lines.groupBy(*by).agg(*rollup_measures())
    return out.withColumn("margin_pct", ratio(F.col("margin_usd"), F.col("revenue_usd")) * 100)


ROLLUP_SETS = {
    "region_month": ["region", "month"], "region_quarter": ["region", "quarter"],
    "tier_quarter": ["tier", "quarter"], "product_quarter": ["product_family", "quarter"],
    "region_tier_product_quarter": ["region", "tier", "product_family", "quarter"],
}


def rollups(lines: DataFrame) -> DataFrame:
    """All rollup tables in one grouping-sets pass, told apart by the column `rollup`.

    Lines are first summed per partner and dimension combination, so that the pass expands the small result and
    not the lines, and a partner with a third of all lines is already one row per month and family."""
    dims = ["region", "tier", "product_family", "quarter", "month"]
    fine = lines.groupBy("partner_id", *dims).agg(
        F.sum("revenue_usd").alias("revenue_usd"), F.sum("margin_usd").alias("margin_usd"),
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("order_lines"))
    sets = [[F.col(c) for c in cols] for cols in ROLLUP_SETS.values()]
    out = fine.groupingSets(sets, *[F.col(c) for c in dims]).agg(
        F.grouping_id(*[F.col(c) for c in dims]).alias("_gid"),
        F.sum("revenue_usd").alias("revenue_usd"), F.sum("margin_usd").alias("margin_usd"),
        F.sum("quantity").alias("quantity"), F.sum("order_lines").alias("order_lines"),
        F.countDistinct("partner_id").alias("partners"))
    name = None
    for table, cols in ROLLUP_SETS.items():
        gid = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in cols)
        cond = F.col("_gid") == gid
        name = F.when(cond, table) if name is None else name.when(cond, table)
    return (out.withColumn("rollup", name).drop("_gid")
            .withColumn("margin_pct", ratio(F.col("margin_usd"), F.col("revenue_usd")) * 100))


def rollup_table(rollup: DataFrame, name: str) -> DataFrame:
    return rollup.where(F.col("rollup") == name).select(
        *ROLLUP_SETS[name], "revenue_usd", "margin_usd", "quantity", "order_lines", "partners", "margin_pct")


# ---------------------------------------------------------------- the grid

def distinct(column: str) -> Column:
    """How many values a group of few has: as a set it moves once, while a distinct count moves rows by value and then by group."""
    return F.size(F.collect_set(column)).cast("long")


def spread(partners: DataFrame) -> DataFrame:
    """Partners over all shuffle partitions. They come from a small file, and so from few tasks, which would otherwise unfold
    every month of every partner."""
    return partners.repartition(int(partners.sparkSession.conf.get("spark.sql.shuffle.partitions")), "partner_id")


def partner_month(lines: DataFrame, master: DataFrame, settings: ChannelSettings) -> DataFrame:
    """Partner x month from the onboarding month (or the window start) to the window end. A partner's months with lines are
    joined to it as one map, and unfolded after that: the grid itself never moves."""
    facts = lines.where(F.col("month").isNotNull()).groupBy("partner_id", "month").agg(
        F.sum("revenue_usd").alias("revenue_usd"), F.sum("margin_usd").alias("margin_usd"),
        F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("order_lines"),
        distinct("product_family").alias("n_products"))
    measures = ["revenue_usd", "margin_usd", "quantity", "order_lines", "n_products"]
    held = facts.groupBy("partner_id").agg(F.map_from_entries(F.collect_list(F.struct("month", F.struct(*measures)))).alias("_held"))
    first = F.greatest(F.lit(settings.start), cal.month_start(F.col("onboarded_date")))
    last = F.trunc(F.lit(settings.end), "MM")
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    cells = F.transform(months, lambda m: F.struct(m.alias("month"), F.col("_held")[m].alias("f")))
    grid = (spread(master.select("partner_id", "region", "tier", "partner_type", "onboarded_date")).join(held, "partner_id", "left")
            .select("partner_id", "region", "tier", "partner_type", F.explode(cells).alias("_c")))
    return grid.select("partner_id", F.col("_c.month").alias("month"), "region", "tier", "partner_type",
                       *[F.coalesce(F.col(f"_c.f.{c}"), F.lit(0)).alias(c) for c in measures]).withColumns({
        "quarter": cal.quarter_label(F.col("month")), "active": F.col("order_lines") > 0})


def partner_quarter(lines: DataFrame, pm: DataFrame, targets: DataFrame) -> DataFrame:
    pq = pm.groupBy("partner_id", "region", "tier", "partner_type", "quarter").agg(
        F.sum("revenue_usd").alias("revenue_usd"), F.sum("margin_usd").alias("margin_usd"),
        F.sum("quantity").alias("quantity"), F.sum("order_lines").alias("order_lines"),
        F.count_if("active").alias("active_months"))
    breadth = lines.groupBy("partner_id", "quarter").agg(distinct("product_family").alias("n_products"))
    out = (pq.join(breadth, ["partner_id", "quarter"], "left")
           .join(targets.select("partner_id", "quarter", "target_usd"), ["partner_id", "quarter"], "left"))
    return out.withColumns({
        "n_products": F.coalesce("n_products", F.lit(0)),
        "margin_pct": ratio_pos(F.col("margin_usd"), F.col("revenue_usd")) * 100,
        "attainment": ratio(F.col("revenue_usd"), F.col("target_usd")),
    })


def order_gaps(lines: DataFrame) -> DataFrame:
    """Distinct order days with the days since the partner's previous one."""
    w = Window.partitionBy("partner_id").orderBy("order_date")
    return (lines.select("partner_id", "order_date").distinct()
            .withColumn("gap_days", F.datediff("order_date", F.lag("order_date").over(w))))


def order_rhythm(lines: DataFrame) -> DataFrame:
    """First and last order, number of order days and the usual gap. A partner has at most one row per day of the
    window here, so the exact median is bounded."""
    return order_gaps(lines).groupBy("partner_id").agg(
        F.min("order_date").alias("first_order"), F.max("order_date").alias("last_order"),
        F.count(F.lit(1)).alias("order_days"), F.median("gap_days").alias("typical_gap_days"))


def half_revenue(pq: DataFrame, year: int, half: int) -> Column:
    qs = [f"{year}-Q{q}" for q in ((1, 2) if half == 1 else (3, 4))]
    return F.sum(F.when(F.col("quarter").isin(qs), F.col("revenue_usd")))


def partner_summary(lines: DataFrame, pq: DataFrame, master: DataFrame, settings: ChannelSettings) -> DataFrame:
    """One row per partner as of the window end."""
    last = cal.qlabel(settings.last_q)
    prev4 = [cal.qlabel(settings.last_q - i) for i in range(1, 5)]
    year = settings.end.year
    money = pq.groupBy("partner_id").agg(
        F.sum("revenue_usd").alias("revenue_total"),
        half_revenue(pq, year - 1, 1).alias("revenue_h1_prev"), half_revenue(pq, year, 1).alias("revenue_h1"),
        F.sum(F.when(F.col("quarter") == last, F.col("revenue_usd"))).alias("revenue_last_q"),
        F.avg(F.when(F.col("quarter").isin(prev4), F.col("revenue_usd").cast("double"))).alias("revenue_prev4q_avg"),
        F.sum(F.when(F.col("quarter") == last, F.col("order_lines"))).alias("lines_last_q"),
        F.avg(F.when(F.col("quarter").isin(prev4), F.col("order_lines"))).alias("lines_prev4q_avg"))
    as_of = F.lit(settings.end)
    out = master.join(order_rhythm(lines), "partner_id", "left").join(money, "partner_id", "left")
    return out.withColumns({
        "growth_h1_yoy": ratio_pos(F.col("revenue_h1"), F.col("revenue_h1_prev")) - 1,
        "last_q_vs_prev4q": ratio_pos(F.col("revenue_last_q"), F.col("revenue_prev4q_avg")),
        "days_since_last_order": F.datediff(as_of, "last_order"),
        "tenure_months": tenure(as_of, F.col("onboarded_date")),
        "cohort": cohort(F.col("onboarded_date"), settings),
    }).withColumns({
        "recency_vs_typical_gap": ratio(F.col("days_since_last_order"), F.col("typical_gap_days")),
        "is_ramping": F.col("tenure_months") < RAMPING_MONTHS,
    })


class ChannelTables:
    """Lazily built tables of one workload: nothing runs until a result is asked for."""

    def __init__(self, sales: DataFrame, master: DataFrame, targets: DataFrame, settings: ChannelSettings,
                 values: DataFrame | None = None, exclude_outliers: bool = True):
        self.settings, self.sales, self.master, self.targets = settings, sales, master, targets
        self._values, self._exclude = values, exclude_outliers

    @classmethod
    def of(cls, channel) -> "ChannelTables":
        return cls(channel.sales, channel.master, channel.targets, channel.settings, channel.line_values)

    @classmethod
    def stored(cls, channel) -> "ChannelTables":
        """The same tables with the cleaned lines and the partner-quarter facts written once per session, as a nightly
        job would: lines by quarter, so that a quarter filter reads only its files."""
        t = StoredTables(channel.sales, channel.master, channel.targets, channel.settings, channel.line_values)
        t.spark, t.where = channel.spark, str(channel.dir)
        return t

    @cached_property
    def clean(self) -> DataFrame:
        return clean_lines(self.sales, self._values)

    @cached_property
    def lines(self) -> DataFrame:
        return attach_partner(self.clean, self.master, self.settings)

    @cached_property
    def base(self) -> DataFrame:
        return self.clean.where(~F.col("is_outlier")) if self._exclude else self.clean

    @cached_property
    def base_typed(self) -> DataFrame:
        """Base lines with the partner type, which is not on the line itself."""
        return self.base.join(self.master.select("partner_id", "partner_type"), "partner_id", "left")

    @cached_property
    def partner_month(self) -> DataFrame:
        return partner_month(self.base, self.master, self.settings)

    @cached_property
    def partner_quarter(self) -> DataFrame:
        return partner_quarter(self.base, self.partner_month, self.targets)

    @cached_property
    def partner_summary(self) -> DataFrame:
        return partner_summary(self.base, self.partner_quarter, self.master, self.settings)

    def rollup(self, name: str) -> DataFrame:
        return aggregate(self.base, ROLLUP_SETS[name])

    def all_tables(self) -> dict[str, DataFrame]:
        allr = rollups(self.base)
        return {"sales": self.lines, "master": self.master, "targets": clean_targets(self.targets),
                "partner_month": self.partner_month, "partner_quarter": self.partner_quarter,
                "partner_summary": self.partner_summary, **{n: rollup_table(allr, n) for n in ROLLUP_SETS}}


class StoredTables(ChannelTables):
    """Each table is written when a query first asks for it; one that needs the lines alone builds no grid."""

    spark: SparkSession
    where: str

    @cached_property
    def clean(self) -> DataFrame:
        # every task writes its own file of a quarter: the lines do not move for it, and neither a quarter nor a partner is one task
        return stored_table(self.spark, self.where, "lines", lambda: clean_lines(self.sales, self._values), ["quarter"])

    @cached_property
    def partner_month(self) -> DataFrame:
        return stored_table(self.spark, self.where, "partner_month", lambda: partner_month(self.base, self.master, self.settings))

    @cached_property
    def partner_quarter(self) -> DataFrame:
        return stored_table(self.spark, self.where, "partner_quarter", lambda: partner_quarter(self.base, self.partner_month, self.targets))
