"""Ticket intake: checks that end as rows, canonical values, guards, splits and lookups."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import fixed_values as fv
from ..functions import text as tx
from .ranking import exact_quantiles, global_rank, running_totals

#: Equal rows that one task numbers.
COPIES = 10_000


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """A ticket file as text: every column a string, quoted line breaks kept, header names trimmed, BOM dropped."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
           .option("nullValue", "\u0000").option("emptyValue", "").csv(path))
    return raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])


def missing_columns(df: DataFrame, required: list[str] = fv.BATCH_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def check_batch(df: DataFrame, examples: int = 10) -> DataFrame:
    """(rule, n, examples) for every intake rule; n is 0 where the rule holds. At most `examples` ids are kept per
    rule, smallest first."""
    gone = missing_columns(df)
    if gone:
        spark = df.sparkSession
        return spark.createDataFrame([("missing columns", len(gone), ", ".join(gone))], "rule string, n long, examples string")
    ident = F.trim(F.coalesce(F.col("ticket_id").cast("string"), F.lit("")))
    chan = F.lower(F.trim(F.coalesce("channel", F.lit(""))))
    rows = df.select(ident.alias("id"), chan.alias("channel"))
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    empty = n.select(F.lit("no rows").alias("rule"), (F.col("_n") == 0).cast("long").alias("n"), F.lit("").alias("examples"))
    per_id = rows.where("id <> ''").groupBy("id").agg(F.count(F.lit(1)).alias("c"))
    bad_channel = rows.where(~F.col("channel").isin(fv.CHANNELS))

    def rule(name: str, hits: DataFrame, sample: Column) -> DataFrame:
        # the examples come from a bounded top-k beside the exact count
        total = hits.agg(F.count(F.lit(1)).alias("n"))
        some = hits.select(sample.alias("x")).orderBy("x").limit(examples).agg(
            F.array_join(F.sort_array(F.collect_list("x")), ", ").alias("examples"))
        return total.crossJoin(some).select(F.lit(name).alias("rule"), "n", "examples")

    parts = [empty, rule("blank ticket_id", rows.where("id = ''"), F.lit("")),
             rule("duplicate ticket_id", per_id.where("c > 1"), F.col("id")),
             rule("invalid channel", bad_channel, F.concat("id", F.lit("="), "channel"))]
    return reduce(DataFrame.unionByName, parts)


def numbered(df: DataFrame) -> DataFrame:
    """Adds a ticket_id to every row: rows in the order of their content's digest, equal rows with consecutive numbers. The ids hang on nothing but the
    content, so partitioning and repeated tasks give the same. Equal rows are one row with a count until the end."""
    content = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    equal = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_d", F.sha2(content, 256))
    upto = running_totals(equal, [F.col("_d")], {"_upto": F.col("_n")}, [])
    # a row with very many copies goes to several tasks
    part = upto.withColumn("_part", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / COPIES)))).repartition("_d", "_part")
    first = F.col("_upto") - F.col("_n") + 1 + F.col("_part") * COPIES
    each = part.withColumn("_i", F.explode(F.sequence(first, F.least("_upto", first + (COPIES - 1)))))
    return each.select(*df.columns, F.format_string("T-%06d", F.col("_i")).alias("ticket_id"))


def prepare(df: DataFrame, known_products: list[str]) -> DataFrame:
    """Missing text to '', channel folded, known products respelled as listed, ids as text."""
    gone = missing_columns(df, fv.REQUIRED_COLUMNS)
    if gone:
        raise ValueError(f"missing required column(s): {', '.join(gone)}")
    spelling = F.create_map(*[x for p in known_products for x in (F.lit(" ".join(p.split()).lower()), F.lit(p))])
    prod = F.coalesce("product", F.lit(""))
    out = df
    if "ticket_id" not in df.columns:
        out = numbered(out)
    return out.withColumns({
        "ticket_id": F.col("ticket_id").cast("string"),
        "subject": F.coalesce("subject", F.lit("")), "body": F.coalesce("body", F.lit("")),
        "product": F.coalesce(F.try_element_at(spelling, tx.squeeze(prod)), F.trim(prod)),
        "channel": F.lower(F.trim(F.coalesce("channel", F.lit("")))),
    })


def guards(df: DataFrame, known_products: list[str], min_chars: int = fv.MIN_BODY_CHARS, threshold: Column | None = None) -> DataFrame:
    """Add guard_flags (names that fired, in order) and guarded. Novelty takes part when its column and threshold exist."""
    fired = {"unknown_product": ~F.trim(F.coalesce("product", F.lit(""))).isin(known_products),
             "short_body": F.length(tx.body_content(F.col("body"))) < min_chars}
    if threshold is not None and "novelty" in df.columns:
        fired["novel_topic"] = F.coalesce(F.col("novelty") >= threshold, F.lit(False))
    names = F.filter(F.array(*[F.when(c, n) for n, c in fired.items()]), lambda x: x.isNotNull())
    return df.withColumn("guard_flags", names).withColumn("guarded", F.size("guard_flags") > 0)


def novelty_threshold(scored: DataFrame) -> DataFrame:
    return exact_quantiles(scored, [], "novelty", {"threshold": fv.NOVELTY_QUANTILE})


# ---------------------------------------------------------------- splits and folds

def strata(df: DataFrame, rare: int = 10) -> DataFrame:
    """category|priority; strata below `rare` rows join the largest stratum of their category (first name on ties)."""
    key = F.concat("category", F.lit("|"), "priority")
    sizes = df.groupBy("category", "priority").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("category").orderBy(F.desc("n"), key)
    # one row per class pair: as short as the label domains
    table = F.broadcast(sizes.select("category", "priority", F.when(F.col("n") < rare, F.first(key).over(w)).otherwise(key).alias("stratum")))
    return df.join(table, ["category", "priority"], "left")


def split_and_fold(df: DataFrame, key: str = "ticket_id", seed: int = 42, folds: int = 5, rare: int = 10) -> DataFrame:
    """70/15/15 split inside each stratum and k folds inside the training part, by a seeded hash rank. The rank is
    distributed, so one stratum may hold any share of the rows."""
    s = strata(df, rare)
    r = global_rank(s, [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "_rn", ["stratum"])
    pos = (F.col("_rn") - 0.5) / F.col("_rn_total")
    return r.withColumn("split", F.when(pos < 0.70, "train").when(pos < 0.85, "val").otherwise("test")).withColumn(
        "fold", F.when(F.col("split") == "train", F.pmod(F.col("_rn"), F.lit(folds)).cast("int"))).drop("_rn", "_rn_total")


def split_checks(split: DataFrame, source: DataFrame, key: str = "ticket_id") -> DataFrame:
    """(rule, n): ids in several splits, ids lost, ids invented."""
    twice = split.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    n = lambda name, d: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    return (n("id in several splits", twice).unionByName(n("id lost", source.select(key).exceptAll(split.select(key))))
            .unionByName(n("id invented", split.select(key).exceptAll(source.select(key)))))


def representativeness(df: DataFrame, split: str, columns: list[str]) -> DataFrame:
    """Class shares in the whole against each split, with the deviation in points; a missing class shows as zero."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))
    n = df.select(F.col(split).alias("split"), cells.alias("c")).groupBy("split", "c.column", "c.value").agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("column", "value").agg(F.sum("n").alias("n_all"))
    sizes = df.groupBy(F.col(split).alias("split")).agg(F.count(F.lit(1)).alias("n_split"))
    total = sizes.agg(F.sum("n_split").alias("total"))
    grid = whole.crossJoin(F.broadcast(sizes)).crossJoin(F.broadcast(total)).join(n, ["split", "column", "value"], "left")
    return grid.select("split", "column", "value", (F.col("n_all") / F.col("total")).alias("share_all"),
                       (F.coalesce("n", F.lit(0)) / F.col("n_split")).alias("share_split")).withColumn(
        "deviation_pp", (F.col("share_split") - F.col("share_all")) * 100)


def duplicate_groups(df: DataFrame, columns: list[str], split: str) -> DataFrame:
    """Groups of exact copies and how many span several splits; one row."""
    g = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"), F.min(split).alias("a"), F.max(split).alias("b")).where("n > 1")
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_involved"), F.count(F.lit(1)).alias("groups"),
                 F.count_if(F.col("a") != F.col("b")).alias("groups_spanning_splits"))


def sample_per_class(df: DataFrame, label: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each class by a seeded hash; the rank is distributed."""
    r = global_rank(df, [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], "_rn", [label])
    return r.where(F.col("_rn") <= n).drop("_rn", "_rn_total")


# ---------------------------------------------------------------- lookups

def mode_by(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Most common value per group, alphabetical on ties."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return c.groupBy(*by).agg(F.min(F.struct(-F.col("_n"), F.col(value))).alias("_b")).select(*by, F.col("_b")[value].alias(name))


def team_lookup(train: DataFrame, rows: DataFrame, category: str = "category") -> DataFrame:
    """The usual team for (category, product), else for the category, else overall."""
    pair = mode_by(train, ["category", "product"], "assigned_team", "_pair").withColumnRenamed("category", "_c")
    cat = mode_by(train, ["category"], "assigned_team", "_cat").withColumnRenamed("category", "_c")
    every = mode_by(train, [], "assigned_team", "_all")
    x = rows.withColumn("_c", F.col(category))
    return (x.join(pair, ["_c", "product"], "left").join(cat, "_c", "left").crossJoin(F.broadcast(every))
            .withColumn("lookup_team", F.coalesce("_pair", "_cat", "_all")).drop("_c", "_pair", "_cat", "_all"))


# ---------------------------------------------------------------- template sentences

def template_sentences(df: DataFrame, min_tickets: int, products: list[str] = (), body: str = "body", key: str = "ticket_id") -> DataFrame:
    """Normalised sentences that occur in at least `min_tickets` tickets."""
    s = df.select(key, F.explode(F.array_distinct(tx.sentences(F.col(body), products))).alias("sentence"))
    return s.groupBy("sentence").agg(F.count(F.lit(1)).alias("tickets")).where(F.col("tickets") >= min_tickets)


def template_class_shares(df: DataFrame, templates: DataFrame, label: str, classes: list[str], top: int = 30,
                          body: str = "body", key: str = "ticket_id") -> DataFrame:
    """Label shares of the most common template sentences."""
    best = F.broadcast(templates.orderBy(F.desc("tickets"), "sentence").limit(top))
    s = df.select(key, label, F.explode(F.array_distinct(tx.sentences(F.col(body)))).alias("sentence"))
    return s.join(best, "sentence").groupBy("sentence", "tickets").agg(
        *[F.avg((F.col(label) == c).cast("int")).alias(c) for c in classes])
