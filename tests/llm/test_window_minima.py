"""Minima of windows by way of stretches are those of the windows' own shingles."""
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as dc


@pytest.mark.parametrize("classes", [[16, 32, 64], [1, 4, 32, 256], [2, 8], [64], []])
def test_window_minima(spark, classes):
    rng = random.Random(4)
    hashes = {(r, p): rng.getrandbits(64) - (1 << 63) for r, n in ((1, 1), (2, 31), (3, 700)) for p in range(n)}
    at = spark.createDataFrame([(r, p, h) for (r, p), h in hashes.items()], "row_key long, place int, h long")
    xors = dc.masks(4)
    sign = [F.min(F.col("h").bitwiseXOR(F.lit(m))).alias(f"m{i}") for i, m in enumerate(xors)]
    got = {(r.row_key, r.u, r.w): [r[f"m{i}"] for i in range(4)] for r in dc.window_minima(at, classes, sign, 4).collect()}
    want = {}
    for (r, p), h in hashes.items():
        for u in classes:
            for w in (p // u, p // u - 1):
                old = want.get((r, u, w), [1 << 63] * 4)
                want[r, u, w] = [min(a, h ^ m) for a, m in zip(old, xors)]
    assert got == want
