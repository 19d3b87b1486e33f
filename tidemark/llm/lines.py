"""Fuzzy line dedup by MinHash.

Lines are compared by the sets of their character shingles. Distinct lines get `BANDS` bands of `ROWS` minima; at a similarity of 0.8 one band
at least agrees in 99.8 % of cases, for short lines too. Lines that agree in a band form candidate clusters, every cluster is verified by exact Jaccard, all
pairs of a block at once, and a distributed union-find gives the components. Of each component the first line stays: smallest doc_id (null
last), then row, then line number.

Equal lines are one node by their 64-bit digest from the start, so a line in a third of all documents costs a count and no pairs. Lines
end at line feeds; blank lines are kept and never compared. Lines shorter than a shingle are their own only shingle.
Defined results: null and empty texts have no lines; rows that agree in id and text are one document; copies of a line inside a
document go as well; an empty table gives an empty result."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.session import written

from .arrow import mixed, slices
from .common import table
from .jaccard import meet
from .trie import linked

SHINGLE = 8
BANDS, ROWS = 16, 5
MULTIPLIERS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).tolist()
#: Shingles of lines of like length whose minima are taken at once.
AT_ONCE = 1 << 16
#: Tokens of a matrix product.
TOKENS = 4096


def lines_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lines, the line of every place, where each text's begin, and the digests of the distinct lines (signed)."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    coded = pc.dictionary_encode(lists.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    names = coded.dictionary.to_pylist()
    digest = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), dtype=np.uint64, count=len(names)).view(np.int64)
    return names, coded.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py(), digest


def char_grams(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` characters from each place on; characters beyond the end count as 0."""
    padded = np.concatenate((codes, np.zeros(width, np.uint64)))
    total, term = np.zeros(len(codes), np.uint64), np.empty(len(codes), np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(width):
        np.multiply(padded[j:j + len(codes)], np.uint64(factor), out=term)
        total += term
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return mixed(total)


def shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character shingles of all lines in a row, and where each line's begin. Lines must not be empty."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    total = char_grams(codes, width)
    ends = np.cumsum(sizes)
    short = np.flatnonzero(sizes < width)
    total[(ends - sizes)[short]] = [xxhash.xxh64_intdigest(lines[i], 11) for i in short] if len(short) else []
    counts = np.maximum(sizes - width + 1, 1)
    stops = np.cumsum(counts)
    whole = np.ones(len(codes), bool)  # places where a shingle begins
    for j in range(1, width):
        at = ends - j
        whole[at[at >= ends - sizes + counts]] = False
    return total[whole], np.concatenate(([0], stops))


def bands(lines: list[str], width: int) -> np.ndarray:
    """(bands, lines) keys: digests of ROWS minima each. Every minimum has a multiply-add of its own, so that choices are independent.

    Lines are taken by length, some of like length at once, as many as a processor's cache holds; shorter ones repeat their last shingle."""
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    order = np.argsort(sizes, kind="stable")
    need = np.maximum(sizes[order] - width + 1, 1)
    least = np.empty((BANDS * ROWS, len(lines)), np.uint32)
    lo = 0
    while lo < len(order):
        hi = lo + int(np.searchsorted(need[lo:lo + AT_ONCE] * np.arange(1, min(AT_ONCE, len(order) - lo) + 1), AT_ONCE, "right"))
        hi = max(lo + 1, min(hi, lo + int(np.searchsorted(need[lo:], need[lo] + need[lo] // 4, "right"))))
        least[:, order[lo:hi]] = like_minima([lines[i] for i in order[lo:hi]], width)
        lo = hi
    out = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = mixed(out * np.uint64(31) + least[r::ROWS])
    return out


def like_minima(lines: list[str], width: int) -> np.ndarray:
    """(bands * rows, lines) minima of lines of like length."""
    hashes, begins = shingles(lines, width)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    most = int(np.diff(begins).max())
    across = len(lines) >= most  # the longer side lies in memory in a row
    place = begins[:-1, None] + np.minimum(np.arange(most), (np.diff(begins) - 1)[:, None])
    grid = low[place.T if across else place]
    spare, out = np.empty_like(grid), np.empty((BANDS * ROWS, len(lines)), np.uint32)
    for row, m in zip(out, MULTIPLIERS):
        np.multiply(grid, np.uint32(m >> 32 | 1), out=spare)
        np.add(spare, np.uint32(m & 0xFFFFFFFF), out=spare)
        np.minimum.reduce(spare, axis=0 if across else 1, out=row)
    return out


def overlaps(token: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, n) sizes of the intersections of n sets; token (small numbers) and owner of every member. Tokens of one set alone have no
    part in any; in large blocks those of few sets are counted pair by pair, all others by a matrix product over some tokens at once."""
    out = np.zeros((n, n), np.float32)
    held = np.bincount(token)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    few = 8 if n > 64 else 1
    for d in range(2, few + 1):
        own = owner[held[token] == d].reshape(-1, d)
        for i in range(d if len(own) else 0):
            for j in range(i):
                cell, count = np.unique(own[:, i] * n + own[:, j], return_counts=True)
                out.reshape(-1)[cell] += count
    out += out.T
    often = held[token] > few
    token, owner = token[often], owner[often]
    token = np.cumsum(np.concatenate(([False], token[1:] != token[:-1]))) if len(token) else token
    for first in range(0, int(token[-1]) + 1 if len(token) else 0, TOKENS):
        a, b = np.searchsorted(token, (first, first + TOKENS))
        grid = np.zeros((n, int(token[b - 1]) - first + 1), np.float32)
        grid[owner[a:b], token[a:b] - first] = 1
        out += grid @ grid.T
    return out


def line_links(rows: pa.Table, percent: int, width: int) -> pa.Table:
    """Links between similar lines of a task's one block or of its two, as many as connect what such pairs and the labels connect."""
    ids, side, label = rows.column("node").to_numpy(), rows.column("side").to_numpy(), rows.column("label").to_numpy()
    n = len(ids)
    if n < 2:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    hashes, begins = shingles([x.decode() for x in rows.column("tokens").to_pylist()], width)
    known, token = np.unique(hashes, return_inverse=True)
    key = np.unique(np.repeat(np.arange(n), np.diff(begins)) * len(known) + token)
    owner, token = key // len(known), key % len(known)
    size = np.bincount(owner, minlength=n)
    common = overlaps(token, owner, n)
    near = 100 * common.astype(np.int64) >= percent * (size[:, None] + size - common.astype(np.int64))
    if side.any() and not side.all():
        near &= side[:, None] != side
    near |= label[:, None] == label
    left, out = np.ones(n, bool), []
    for first in range(n):
        if not left[first]:
            continue
        group = np.zeros(n, bool)
        edge = np.array([first])
        group[first] = True
        while len(edge):
            edge = np.flatnonzero(near[edge].any(axis=0) & ~group)
            group[edge] = True
        left &= ~group
        for other in np.flatnonzero(group & (label != label[first])):
            out.append((int(ids[first]), int(ids[other])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def components_of(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Line occurrences (doc_id, row_key, line_no, node) without blank lines, and node, label of every linked distinct line."""
    rows = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text").where("text <> ''")
    buckets = max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                names, at, begins, digest = lines_of(part.column(2))
                full = np.fromiter((x.strip() != "" for x in names), dtype=bool, count=len(names))[at]
                doc = np.repeat(np.arange(part.num_rows), np.diff(begins))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc[full])), part.column(1).take(pa.array(doc[full])), pa.array((np.arange(len(at)) - begins[doc])[full]), pa.array(digest[at][full])],
                    names=["doc_id", "row_key", "line_no", "node"])

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                names, _, _, digest = lines_of(part.column(0))
                keep = np.array([i for i, x in enumerate(names) if x.strip()], dtype=np.int64)
                if not len(keep):
                    continue
                key = bands([names[i] for i in keep], width).reshape(-1)
                node = np.tile(digest[keep], BANDS)
                bucket = (key % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                key, node, bucket = key[order], node[order], bucket[order]
                have = np.unique(bucket)
                cut = np.searchsorted(bucket, [*have, buckets])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(have, pa.int32()), pa.array([key[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([node[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                    names=["bucket", "token", "node"])

    seen = written(rows.mapInArrow(occurring, "doc_id long, row_key long, line_no long, node long").distinct(), "lines")
    candidates = written(rows.select("text").mapInArrow(signed, "bucket int, token binary, node binary").groupBy("bucket").applyInArrow(meet, "a long, b long").distinct(), "line-candidates")
    wanted = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
    where = seen.join(wanted, "node").groupBy("node").agg(F.min("row_key").alias("row_key")).groupBy("row_key").agg(F.collect_list("node").alias("wanted"))
    texts = rows.join(where, "row_key").dropDuplicates(["row_key"]).select("text", "wanted")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                names, _, _, digest = lines_of(part.column(0))
                asked = np.unique(part.column(1).flatten().to_numpy())
                mine = np.flatnonzero(np.isin(digest, asked))
                if len(mine):
                    hashes, begins = shingles([names[i] for i in mine], width)
                    yield pa.RecordBatch.from_arrays([pa.array(digest[mine]), pa.array([len(np.unique(hashes[a:b])) for a, b in zip(begins, begins[1:])], pa.int64()),
                                                      pa.array([names[i].encode() for i in mine], pa.binary())], names=["node", "n", "tokens"])

    # A line is asked of one text only, and its text travels, a tenth of its set; tasks that compare make the set of it.
    full = written(texts.mapInArrow(sets, "node long, n long, tokens binary"), "line-sets")
    return seen, linked(candidates, full, percent, compare=lambda rows, percent: line_links(rows, percent, width))


def dedup(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_lines (non-blank), n_removed and removed (their numbers from 0, ascending) of every row of `docs` (doc_id, text)."""
    seen, label = components_of(docs, percent, width)
    last = F.lit((1 << 63) - 1)
    placed = seen.join(label, "node", "left").select("doc_id", "row_key", "line_no", F.coalesce("label", "node").alias("component"))
    order = F.struct(F.coalesce("doc_id", last).alias("d"), F.col("row_key").alias("r"), F.col("line_no").alias("l"))
    first = placed.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("uses"))
    gone = placed.join(first.where("uses > 1"), "component").where(order != F.col("first"))
    removed = gone.groupBy("row_key").agg(F.array_sort(F.collect_list("line_no")).alias("removed"))
    blank = F.lit(0).cast("long")
    line = F.split(F.col("text"), "\n", -1)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce(F.size(F.filter(line, lambda x: x.rlike(r"\S"))).cast("long"), blank).alias("n_lines"), F.col("text").isNull().alias("bare"))
    rows = rows.withColumn("n_lines", F.when(F.col("bare"), blank).otherwise(F.col("n_lines")))
    return rows.join(removed, "row_key", "left").select("doc_id", "row_key", "n_lines", F.greatest(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                                                         F.coalesce("removed", F.array().cast("array<long>")).alias("removed"))


def query(spark, sf_dir: str) -> DataFrame:
    """Of every document, how many lines it has and the numbers of those that repeat an earlier line."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"))
