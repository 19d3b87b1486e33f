"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is one stream: its documents in the order of a digest of id and text, cut into blocks of equally many
words. A golden-ratio sequence visits the unit interval; the source whose share of the total a point falls into gets the
slot, and the k-th slot of a source takes the k-th block of its stream, wrapping around up to `cap` times; words
of a block without a slot are not taken. Because
the points fill the interval evenly, every stretch of the mix holds the sources in their proportions.

Defined results: null and blank texts have size 0 and no words are taken from them; null is a source of its own, last in
order; rows that agree in id, source and text are told apart by their place in the stream only, so their results are the
same multiset in any run; an empty table gives an empty result. Nothing depends on task order, so reruns agree."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import written

from .common import table, word_count

#: The golden ratio's fraction in 40 bits, odd: multiplied by the slot number it gives the points of the sequence.
STEP = 679_582_956_591
BITS = 40


@dataclass
class Mix:
    """sources: source, source_size, weight, target, take. schedule: slot, source key, rank (the block it takes).
    documents: doc_id, source, size, source_size, target, taken, first_slot (null if none takes from it), repeats."""
    sources: DataFrame
    schedule: DataFrame
    documents: DataFrame


def point(slot: Column) -> Column:
    """The slot's point in 0..1: the fraction of slot times the golden ratio, in integers that cannot overflow."""
    half = 1 << (BITS // 2)
    high, low = F.floor(slot / half).cast("long"), slot % half
    return ((high * STEP % half) * half + low * STEP) % (1 << BITS) / F.lit(float(1 << BITS))


def before(df: DataFrame, keys: list[str], by: str, value: str, name: str) -> DataFrame:
    """Sum of `value` over the earlier `by` inside `keys`; few rows a key by construction."""
    w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """One row a source: the weights repeat in source order, and the target is weight times the level at which the capped
    targets add up to the wanted total."""
    total = sizes.groupBy("source", "_s").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    rows = total.withColumn("_place", place).withColumn("weight", weight)
    most = F.lit(float(cap)) * F.col("source_size")
    whole = Window.partitionBy(F.lit(1))
    fill = whole.orderBy(F.col("_ratio"), F.col("_place")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_most", most).withColumn("_ratio", most / F.col("weight"))
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_most").over(fill), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))
    rows = rows.withColumn("_level", left / rest)
    rows = rows.withColumn("_level", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_place", "_level"))).over(whole)["_level"])
    target = F.when(F.col("_level").isNull(), F.col("_most")).otherwise(F.least(F.col("_most"), F.col("_level") * F.col("weight")))
    rows = rows.withColumn("target", target).withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
    order = whole.orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    all_take = F.greatest(F.sum("take").over(whole), F.lit(1))
    low = F.coalesce(F.sum("take").over(order), F.lit(0))
    return rows.select("source", "_s", "_place", "source_size", "weight", "target", "take",
                       (low / all_take).alias("_low"), ((low + F.col("take")) / all_take).alias("_high"))


def text_key() -> Column:
    """Digest of id and text: the order inside a source's stream."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))


def source_key() -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def blocks_from(start: Column, ranks: Column) -> Column:
    """The block numbers with the place where the document begins."""
    return F.transform(ranks, lambda r: F.struct(start.alias("start"), r.alias("rank")))


def slots(sources: DataFrame, block: int, chunk: int = 16_384) -> DataFrame:
    """Which source every slot of the mix takes from, and the how-manieth slot of that source it is.

    A source gets exactly the slots that its words fill: what the sequence gives beyond is left out, and the few that it
    gives too little are added at the end."""
    spark = sources.sparkSession
    sources = sources.withColumn("need", F.ceil(F.col("take") / block).cast("long"))
    n, count = sources.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    cells = max(1024, 4 * count)
    ranges = sources.where("take > 0").select("_s", "_low", "_high", F.explode(F.sequence(
        F.floor(F.col("_low") * cells).cast("long"), F.floor(F.col("_high") * cells).cast("long"))).alias("_cell"))
    points = spark.range(n).select(F.col("id").alias("slot"), point(F.col("id")).alias("_u")).withColumn(
        "_cell", F.floor(F.col("_u") * cells).cast("long"))
    drawn = points.join(ranges, "_cell").where("_u >= _low AND _u < _high").select(
        "slot", "_s", F.floor(F.col("slot") / chunk).cast("long").alias("_chunk"))
    counted = drawn.groupBy("_s", "_chunk").agg(F.count("*").alias("_n"))
    offsets = before(counted, ["_s"], "_chunk", "_n", "_before").select("_s", "_chunk", "_before")
    inner = Window.partitionBy("_s", "_chunk").orderBy("slot")
    ranked = drawn.join(offsets, ["_s", "_chunk"]).select(
        "slot", "_s", (F.col("_before") + F.row_number().over(inner) - 1).cast("long").alias("rank"))
    need = sources.select("_s", "_place", "take", "need")
    got = counted.groupBy("_s").agg(F.sum("_n").alias("_got"))
    short = need.join(got, "_s", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).where("_got < need")
    extra = short.select(
        (F.lit(n) + F.col("_place")).cast("long").alias("slot"), "_s",
        F.explode(F.sequence(F.col("_got"), F.col("need") - 1)).alias("rank"))
    return ranked.unionByName(extra).join(need, "_s").where("rank < need").select("slot", "_s", "rank", "take")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, cap: int = 3, block: int = 256) -> Mix:
    """Mix `docs` (doc_id, source, text) to `share` times all their words.

    weights: of the sources in order, repeating. cap: how often a source's words may be taken at most. block: words of a
    slot. `repeats` of the result is the number of times a document is in the mix, to the nearest whole."""
    sized = written(docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
        text_key().alias("_key"), source_key().alias("_s"))
        .groupBy("doc_id", "source", "_s", "size", "_key").agg(F.count("*").alias("copies")), "mix-sizes")
    sources = written(source_targets(sized, weights, share, cap), "mix-sources")

    rows = sized.withColumns({"_a": F.substring("_key", 1, 2), "_b": F.substring("_key", 3, 2), "_n": F.col("size") * F.col("copies")})
    by_b = rows.groupBy("_s", "_a", "_b").agg(F.sum("_n").alias("_n"))
    by_a = rows.groupBy("_s", "_a").agg(F.sum("_n").alias("_n"))
    offsets = before(by_b, ["_s", "_a"], "_b", "_n", "_off_b").drop("_n").join(
        before(by_a, ["_s"], "_a", "_n", "_off_a").drop("_n"), ["_s", "_a"])
    inner = Window.partitionBy("_s", "_a", "_b").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["_s", "_a", "_b"]).withColumn(
        "_at", F.col("_off_a") + F.col("_off_b") + F.coalesce(F.sum("_n").over(inner), F.lit(0)))
    placed = placed.select("doc_id", "source", "_s", "size", "_key", "_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("_copy"))
    placed = placed.withColumn("_at", F.col("_at") + F.col("_copy") * F.col("size"))

    plan = written(slots(sources, block), "mix-slots")
    known = sources.select("_s", "source_size", "target", "take")
    size, take = F.col("size"), F.col("take")
    rounds = []
    for e in range(cap):
        start = F.col("_at") + e * F.col("source_size")
        blocks = F.sequence(F.floor(start / block).cast("long"), F.floor((F.least(start + size, take) - 1) / block).cast("long"))
        rounds.append(F.when((size > 0) & (start < take), blocks_from(start, blocks))
                      .otherwise(F.array().cast("array<struct<start:bigint,rank:bigint>>")))
    pieces = placed.join(known, "_s").select(
        "doc_id", "source", "_s", "size", "_key", "_copy", "source_size", "target", F.explode_outer(F.flatten(F.array(*rounds))).alias("_p"))
    pieces = pieces.withColumns({"start": F.col("_p.start"), "rank": F.col("_p.rank")}).drop("_p")
    lower, upper = F.greatest(F.col("start"), F.col("rank") * block), F.least(F.col("start") + size, (F.col("rank") + 1) * block, take)
    # A piece without a slot is not in the mix; the rows of untaken documents stay for their zeros.
    met = pieces.join(plan, ["_s", "rank"], "left").withColumn("_words", F.when(F.col("slot").isNotNull(), upper - lower))
    taken = met.groupBy("doc_id", "source", "_s", "size", "_key", "_copy", "source_size", "target").agg(
        F.coalesce(F.sum("_words"), F.lit(0)).cast("long").alias("taken"), F.min(F.when(F.col("_words") > 0, F.col("slot"))).alias("first_slot"))
    return Mix(sources, plan, taken.withColumn("repeats", F.when(size > 0, F.floor(F.col("taken") / size + 0.5)).otherwise(0).cast("long")))


def repeated(docs: DataFrame, mixture: Mix) -> DataFrame:
    """`docs` as the mix has them: every document as often as it is taken, to the nearest whole; all columns as they were."""
    times = written(mixture.documents.groupBy("_s", "_key").agg(F.sum("repeats").alias("__times")).where("__times > 0").select(
        F.col("_s").alias("__s"), F.col("_key").alias("__key"), "__times"), "mix-repeats")
    keyed = docs.withColumns({"__s": source_key(), "__key": text_key()}).dropDuplicates(["__s", "__key"])
    return keyed.join(times, ["__s", "__key"]).withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).drop("__s", "__key", "__times", "__n")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes from it."""
    out = mix(table(spark, sf_dir, "documents")).documents
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: The same by arithmetic: a source's stream is taken from its start, `take` words long, wrapping around.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w FROM src),
filled AS (
  SELECT *, 3.0 * source_size / w AS ratio,
         (sum(source_size) OVER () - coalesce(sum(3.0 * source_size) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT arg_min(level, ratio) AS level FROM filled WHERE ratio > level),
target AS (SELECT source, source_size, least(3.0 * source_size, coalesce((SELECT level FROM lvl) * w, 3.0 * source_size))::DOUBLE AS target FROM weighed),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS take,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(greatest(0, least(size, take - pos)) + greatest(0, least(size, take - pos - source_size))
            + greatest(0, least(size, take - pos - 2 * source_size)) AS BIGINT) AS taken
FROM placed"""
