"""Texts with very many matches: places are those of a plain scan, at the borders of runs too."""
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import secrets


@pytest.mark.parametrize("hits", [1, secrets.RUN - 1, secrets.RUN, secrets.RUN + 1, 3 * secrets.RUN, 20_000])
def test_places_of_many_matches(spark, hits):
    text = "\U0001F600 " + " é ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(hits)) + " end"
    row = spark.createDataFrame([(text,)], "text string").select(secrets.found(F.col("text"), secrets.HEX, 2).alias("s")).first()
    assert [(s.start, s.end, s.hit) for s in row.s] == [(*m.span(), m.group()) for m in re.finditer(secrets.HEX, text)]


def test_no_match(spark):
    rows = spark.createDataFrame([("",), ("plain",)], "text string").select(secrets.found(F.col("text"), secrets.HEX, 2).alias("s")).collect()
    assert [r.s for r in rows] == [[], []]
