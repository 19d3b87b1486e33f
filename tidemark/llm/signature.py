"""Parity signatures of token sets, and the narrowing of sets that met by them.

Each token of a set flips one bit of its signature. Tokens that two sets share cancel out, so signatures differ in at most as many bits
as the sets differ in tokens: a distance too large for the threshold rules a pair out for certain. A signature has at least four bits
a token, up to a maximum; the longer of two is folded to the length of the shorter, which keeps the bound."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import written

from .arrow import mixed

#: 64-bit words of the shortest and the longest signature.
LEAST, MOST = 8, 512
#: Sets of a block; a task holds two blocks.
BLOCK = 4096


def widths(counts: np.ndarray) -> np.ndarray:
    """Words of the signatures of sets of so many tokens: powers of two, four bits a token or more."""
    need = np.ceil(np.log2(np.maximum(counts, 1) * 4 / 64)).astype(np.int64)
    return 1 << np.clip(need, int(np.log2(LEAST)), int(np.log2(MOST)))


def signatures(tokens: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """The signature of every set."""
    counts = np.diff(begins)
    width = widths(counts)
    start = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(counts)), counts)
    hashed = mixed(tokens ^ np.uint64(0x3C6EF372FE94F82B))
    bit = (hashed % (width[owner] * 64).astype(np.uint64)).astype(np.int64)
    words = np.zeros(int(width.sum()), np.uint64)
    # The bit's place is the hash modulo the length, so halves folded together are the signature of half the length.
    np.bitwise_xor.at(words, start[owner] + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return [words[a:a + w].tobytes() for a, w in zip(start, width)]


def near(rows: pa.Table, percent: int) -> pa.Table:
    """Pairs of a task's one block, or of its two, that signatures do not rule out; as many as connect what such pairs connect."""
    ids, side, n = rows.column("node").to_numpy(), rows.column("side").to_numpy(), rows.column("n").to_numpy()
    raw = rows.column("signature").to_pylist()
    width = widths(n)
    two = side.any() and not side.all()
    label, out = np.arange(len(ids)), []
    levels = {}
    for w in np.unique(width):
        at = np.flatnonzero((width == w) & (side == 0)) if two else np.flatnonzero(width == w)
        at = at[np.argsort(n[at], kind="stable")]
        levels[int(w)] = at, n[at], np.frombuffer(b"".join(raw[i] for i in at), "<u8").reshape(len(at), w)
    for p in np.flatnonzero(side == 1) if two else range(len(ids)):
        mine = np.frombuffer(raw[p], "<u8")
        low, high = -(-int(n[p]) * percent // 100), int(n[p]) * 100 // percent
        for w, (at, size, words) in levels.items():
            # Both directions are needed where the blocks are two; in one block a pair is met from its larger set.
            a, b = np.searchsorted(size, low, "left"), np.searchsorted(size, high if two else int(n[p]), "right")
            mask = label[at[a:b]] != label[p]
            if not mask.any():
                continue
            other, theirs = at[a:b][mask], words[a:b][mask]
            m = min(w, len(mine))
            one = np.bitwise_xor.reduce(mine.reshape(-1, m), axis=0)
            if w > m:
                theirs = np.bitwise_xor.reduce(theirs.reshape(len(other), -1, m), axis=1)
            distance = np.bitwise_count(theirs ^ one).sum(axis=1, dtype=np.int64)
            for q in other[(100 + percent) * distance <= (100 - percent) * (n[other] + n[p])]:
                if label[q] != label[p]:
                    out.append((int(ids[p]), int(ids[q])))
                    label[label == label[q]] = label[p]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def narrowed(met: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """a, b: pairs of sets that connect all those of `met` which may be similar at `percent`.

    met: a, b; every two sets that met have a common a, or one is the other's a. sets: node, n, signature, one row a node or
    more. A group is an `a` with its `b`; a group of any size is cut into blocks, and a task compares one block or two."""
    rows = met.select(F.col("a").alias("head"), F.col("b").alias("node")).union(met.select("a", "a")).distinct()
    parts = rows.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    placed = rows.join(parts, "head").withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int"))
    # A block goes to a task of its own with every block of its group: as side 0 with later ones, as side 1 with earlier ones.
    both = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
        F.xxhash64("head", F.least("part", other), F.greatest("part", other)).alias("task"), (F.col("part") > other).cast("int").alias("side")))
    sent = written(placed.select("node", F.explode(both).alias("_t")).select("node", "_t.task", "_t.side"), "sets-sent")
    one = sets.join(sent.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tasks are small and many: they follow each other in a partition, and one at a time is compared."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            task = rows.column("task").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
            yield from joined(rows.slice(a, b - a) for a, b in zip(cut, cut[1:]))
            held = rows.slice(cut[-1])
        if held is not None:
            yield from joined([held])

    def joined(tasks) -> Iterator[pa.RecordBatch]:
        found = [near(t, percent) for t in tasks]
        if found:
            yield from pa.concat_tables(found).combine_chunks().to_batches()

    tasks = sent.join(one, "node").select("task", "side", "node", "n", "signature").repartition("task").sortWithinPartitions("task")
    return written(tasks.mapInArrow(compared, "a long, b long").distinct(), "candidates")
