"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

Items are partitioned by their number of five-word shingles into classes (u/2, u]. For each class that occurs, documents
are cut into windows of 2u shingles, u apart, so an item of the class that occurs in a document lies whole in a window of
comparable size and its containment turns into a Jaccard similarity with a floor of about 0.19 at containment 0.8,
whatever the document's length. Minima are taken once over stretches of the smallest class; those of neighbours make the windows of all
classes. Items and windows get `hashes` minima each, every minimum a band of its own: at 32 the
chance to miss is 0.1 % at the floor and below 0.01 % for a whole copy. Candidates are verified exactly: distinct shingles
of the item that the whole document holds, as strings, over the item's distinct shingles.

Text is lower-cased (A-Z) and words are runs of non-white-space. Defined results: null or blank texts and texts under five
words have no shingle and match nothing, as items and as documents (short_contained finds such items); repeated items each match; rows that agree in id and
text are one document; empty tables give an empty result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import written

from .common import lower_ascii, small, table, word_list

WIDTH = 5
#: Classes from here on share their minima over stretches; windows of smaller ones take theirs from the shingles.
STRETCH = 16


def masks(hashes: int) -> list[int]:
    """XOR masks that differ in their leading bits: the smallest hash after each is an independent uniform choice."""
    return [((k * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)) - (1 << 63) for k in range(1, hashes + 1)]


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def shingles(df: DataFrame, keep: list[Column], text: Column, as_text: bool, width: int = WIDTH) -> DataFrame:
    """A row for each place: `keep`, place, and the shingle there as hash or text."""
    rows = df.select(*keep, word_list(lower_ascii(text)).alias("_w")).where(F.size("_w") >= width)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.size("_w") - width)).alias("place"))
    at = [F.get("_w", F.col("place") + i) for i in range(width)]
    return rows.withColumn("shingle", F.concat_ws(" ", *at) if as_text else F.xxhash64(*at)).drop("_w")


def window_minima(at: DataFrame, classes: list[int], sign: list[Column], hashes: int) -> DataFrame:
    """row_key, u, w and m0, m1, ... of every window: the shingles at places from w u to below (w + 2) u. at: row_key, place, h.

    A class u is a power of two, so its windows consist of whole stretches of any smaller class."""
    def windows(place: Column, sizes: list[int]) -> list[Column]:
        return [F.struct(F.lit(u).alias("u"), (F.floor(place / u) - back).cast("int").alias("w")) for u in sizes for back in (0, 1)]

    small_classes, large = [u for u in classes if u < STRETCH], [u for u in classes if u >= STRETCH]
    kinds = windows(F.col("place"), small_classes)
    if large:
        kinds.append(F.struct(F.lit(-large[0]).alias("u"), F.floor(F.col("place") / large[0]).cast("int").alias("w")))
    if len(kinds) == 1:
        spread = at.select("row_key", "h", kinds[0].alias("_x"))
    else:
        spread = at.select("row_key", "h", F.explode(F.array(*kinds) if kinds else F.array().cast("array<struct<u:int,w:int>>")).alias("_x"))
    first = spread.groupBy("row_key", F.col("_x.u").alias("u"), F.col("_x.w").alias("w")).agg(*sign)
    if not large:
        return first
    own = F.array(F.struct("u", "w"))
    names = [f"m{i}" for i in range(hashes)]
    stretch = F.when(F.col("u") < 0, F.array(*windows(F.col("w") * large[0], large))).otherwise(own)
    return (first.select("row_key", *names, F.explode(stretch).alias("_x")).groupBy("row_key", F.col("_x.u").alias("u"), F.col("_x.w").alias("w"))
            .agg(*[F.min(m).alias(m) for m in names]))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, hashes: int = 32) -> DataFrame:
    """Pairs (row_key, doc_id, item_id) with n_shared, n_shingles and containment of at least `threshold`.

    docs: doc_id, text. items: item_id, text. Both may have other columns. row_key is xxhash64(doc_id, text)."""
    spark = docs.sparkSession
    items = items.select("item_id", F.col("text").alias("item_text")).distinct().withColumn("_item", F.xxhash64("item_id", "item_text"))
    item_sh = written(shingles(items, [F.col("_item"), F.col("item_id")], F.col("item_text"), True)
                      .select("_item", "item_id", "shingle").distinct().withColumn("h", F.xxhash64(*[F.split("shingle", " ")[i] for i in range(WIDTH)])), "items")
    sizes = item_sh.groupBy("_item").agg(F.count("*").alias("n_shingles"))
    step = F.pow(2.0, F.ceil(F.log2("n_shingles"))).cast("int")
    sized = written(item_sh.join(sizes.withColumn("_u", step), "_item"), "items-sized")
    classes = [r[0] for r in sized.select("_u").distinct().orderBy("_u").collect()]  # one number for each power of two
    xors = masks(hashes)
    sign = [F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(xors)]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"m{i}").alias("m")) for i in range(hashes)])).alias("_b")
    item_bands = written(sized.groupBy("_item", "_u").agg(*sign).select("_item", F.col("_u").alias("_iu"), each)
                         .select("_item", "_iu", F.col("_b.i").alias("_i"), F.col("_b.m").alias("_m")), "item-bands")

    # Each row stays in one task from here to its windows' minima: the text is moved once, the minima never.
    moved = docs.select("doc_id", "text").withColumn("row_key", row_key()).repartition("row_key")
    at = shingles(moved, [F.col("row_key")], F.col("text"), False).withColumnRenamed("shingle", "h")
    minima = window_minima(at, classes, sign, hashes)
    bands = minima.select("row_key", "u", each).select("row_key", "u", F.col("_b.i").alias("i"), F.col("_b.m").alias("m"))
    band = small(item_bands)
    cand = bands.join(band, (F.col("i") == F.col("_i")) & (F.col("m") == F.col("_m")) & (F.col("u") == F.col("_iu"))).select("row_key", "_item").distinct()
    cand = written(cand, "item-candidates")

    hit = docs.select("doc_id", "text").withColumn("row_key", row_key()).join(cand.select("row_key").distinct(), "row_key", "left_semi").dropDuplicates(["row_key"])
    held = shingles(hit, [F.col("row_key"), F.col("doc_id")], F.col("text"), True).drop("place")
    wanted = small(sized.select("_item", "item_id", "shingle", "n_shingles"))
    shared = held.join(wanted, "shingle").groupBy("row_key", "doc_id", "_item", "item_id", "n_shingles").agg(F.countDistinct("shingle").alias("n_shared"))
    return (shared.join(cand, ["row_key", "_item"], "left_semi").withColumn("containment", F.col("n_shared") / F.col("n_shingles"))
            .where(F.col("n_shared") >= F.lit(threshold) * F.col("n_shingles") - 1e-9)
            .select("row_key", "doc_id", "item_id", "n_shared", F.col("n_shingles"), "containment"))


def short_contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs (row_key, doc_id, item_id) for items of one to four words: the documents that hold all of an item's words in a row.

    The item is its own only shingle. It is looked up by hash at every place of a document and then compared as text; for widths that
    no item has, no document is read. Beside contained(), which leaves these items out: whether so short a passage is a leak is the
    caller's choice. Rows that agree in id and text are one document; null and blank texts match nothing."""
    words = items.select("item_id", word_list(lower_ascii(F.col("text"))).alias("_w")).where((F.size("_w") > 0) & (F.size("_w") < WIDTH))
    words = written(words.select("item_id", F.size("_w").alias("width"), F.array_join("_w", " ").alias("item_shingle")).distinct(), "items-short")
    keyed = docs.select("doc_id", "text", row_key().alias("row_key"))
    found = keyed.where(F.lit(False)).select("row_key", "doc_id", F.lit(None).cast(words.schema["item_id"].dataType).alias("item_id"))
    for width in sorted(r[0] for r in words.select("width").distinct().collect()):  # at most four numbers
        each = [F.get(F.split("item_shingle", " "), F.lit(i)) for i in range(width)]
        asked = small(written(words.where(F.col("width") == width).select("item_id", "item_shingle", F.xxhash64(*each).alias("_h")), "items-asked"))
        places = shingles(keyed, [F.col("row_key"), F.col("doc_id")], F.col("text"), True, width)
        places = places.withColumn("_p", F.xxhash64(*[F.get(F.split("shingle", " "), F.lit(i)) for i in range(width)]))
        hit = places.join(asked, (F.col("_p") == F.col("_h")) & (F.col("shingle") == F.col("item_shingle")))
        found = found.unionByName(hit.select("row_key", "doc_id", "item_id"))
    return found.distinct()


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """`docs` without the documents that contain an item; all columns as they were."""
    bad = written(contained(docs, items, threshold).select(F.col("row_key").alias("__row_key")).distinct(), "contaminated")
    return docs.withColumn("__row_key", row_key()).join(bad, "__row_key", "left_anti").drop("__row_key")


def query(spark, sf_dir: str) -> DataFrame:
    """Document and benchmark item, for every item of which a document holds 80 % of the shingles or more."""
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", F.round("containment", 6).alias("containment"))


#: All pairs that share a shingle, without any search for candidates.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, text, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, text, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, text, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, text, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, text, count(*) AS n_shingles FROM bs GROUP BY 1, 2),
c AS (SELECT ds.doc_id, ds.text AS dt, bs.item_id, bs.text, count(*) AS n_shared FROM ds JOIN bs USING (s) GROUP BY 1, 2, 3, 4)
SELECT doc_id, c.item_id, n_shared, n_shingles, round(n_shared / n_shingles, 6) AS containment
FROM c JOIN n ON c.item_id IS NOT DISTINCT FROM n.item_id AND c.text = n.text WHERE n_shared >= 0.8 * n_shingles - 1e-9"""
