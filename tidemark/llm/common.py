"""What the operators share: words, sources and the sizes under which a table may be broadcast."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: A table of at most so many rows may be broadcast; callers count it first and shuffle beyond.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words, as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_list(text: Column) -> Column:
    """The words in order; an empty list for null and for text without words."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if a count proves it small; unchanged, so shuffled, otherwise. Pass a written table."""
    return F.broadcast(df) if df.count() <= rows else df
