"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits: bit j is 1 if it is set in over half of the XXH64 (UTF-8, seed 42) of the text's word 3-shingles, repeats
included; fewer words are one shingle, and a text without words has fingerprint zero. Fingerprints link at 3 or fewer differing bits.

The 64 bits are a ring of four segments. If all of them together differ in at most 3 bits, then from some segment on every chain
of 1, 2, 3 and 4 consecutive segments differs in at most 0, 1, 2 and 3 bits (its proportional share, 3/4 a segment). So two fingerprints
meet under the key of a chain of two segments: the first equal, the second equal or one bit apart. The one whose bit is 0 brings the
key of the other, so a pair meets once. Keys that very many fingerprints hold go on to chains of three segments, of at most 2 differing bits; such a group
has at most 2^16 fingerprints of its own, however large the table. What meets is held against the chain of three, then against the
whole. A group gives a spanning forest of its links, not its pairs.

Equal fingerprints are one throughout. Defined results: null texts are texts without words; repeated rows and ids are linked like any others; the smallest
id ignores null ids, and a component without any id has null; an empty table gives an empty result. Other columns are ignored."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.session import written

from .arrow import mixed, slices
from .common import SPACES, table
from .components import components
from .skew import looked_up

#: Differing bits at which fingerprints link, segments of the ring and bits of a segment.
BITS, SEGMENTS, WIDTH = 3, 4, 16
#: Seed of a shingle's hash and words of a shingle.
SEED, WORDS = 42, 3
#: Fingerprints under one key of two segments beyond which it is lengthened to three.
CROWD = 20_000
#: At most so many keys are lengthened; the limit above rises with the table to keep this.
CROWDS = 200_000
#: Groups of at most so many rows are compared by shifting, larger ones by search from one to the next.
SMALL = 24

_PLAIN = bytes(32 if chr(c) in SPACES else c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle of all texts in a row, and where each text's begin (and the last end)."""
    raw = [x or b"" for x in pc.cast(texts, pa.binary()).to_pylist()]
    begins = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw]))).astype(np.int64)
    flat = np.frombuffer(b" ".join([*raw, b""]).translate(_PLAIN), np.uint8)
    full = flat != 32
    before = np.concatenate(([False], full[:-1]))
    keep = full | before
    place = np.cumsum(keep) - 1
    first = np.flatnonzero(full & ~before)
    last = np.flatnonzero(before & ~full)
    doc = np.searchsorted(begins, first, "right") - 1
    start, end, even = place[first], place[last], flat[keep].tobytes()  # words one blank apart
    words = np.bincount(doc, minlength=len(raw)) if len(doc) else np.zeros(len(raw), np.int64)
    word = np.concatenate(([0], np.cumsum(words)))
    counts = np.where(words > 0, np.maximum(words - WORDS + 1, 1), 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(out[-1]) + np.repeat(word[:-1] - out[:-1], counts)
    to = np.minimum(at + WORDS, np.repeat(word[1:], counts)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(even[a:b], SEED) for a, b in zip(start[at].tolist(), end[to].tolist())), np.uint64, len(at)), out


def fingerprints(texts: pa.Array) -> np.ndarray:
    h, begins = shingles(texts)
    counts = np.diff(begins)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # Stretches of at most 255 shingles of one text: eight bits are counted at once, each in a byte of its own.
    pieces = -(-counts[some] // 255)
    ends = np.cumsum(pieces)
    piece = np.repeat(begins[some] - 255 * (ends - pieces), pieces) + 255 * np.arange(ends[-1])
    ones = np.zeros((len(piece), 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((h >> _U(k)) & _U(0x0101010101010101), piece)
        ones[:, k::8] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.add.reduceat(ones, ends - pieces, axis=0)
    bits = 2 * ones > counts[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def turned(f: np.ndarray, segment: int) -> np.ndarray:
    """The ring turned so that `segment` has the lowest bits."""
    s = segment * WIDTH
    return f if s == 0 else (f >> _U(s)) | (f << _U(64 - s))


def _variants(value: np.ndarray, low: int, flips: int, above: bool) -> tuple[np.ndarray, np.ndarray]:
    """`value` with up to `flips` bits of the segment at bit `low` changed, and whose it is; only larger results if `above`."""
    ones = [_U(1 << (low + i)) for i in range(WIDTH)]
    masks = [_U(0), *ones] + ([a | b for i, a in enumerate(ones) for b in ones[:i]] if flips > 1 else [])
    owner, out = [], []
    for m in masks:
        new = value ^ m
        good = np.flatnonzero(new >= value) if above else np.arange(len(value))
        owner.append(good)
        out.append(new[good])
    return np.concatenate(out), np.concatenate(owner)


def chain_keys(f: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which fingerprints meet, and the fingerprint of each. crowded: ascending keys of two segments to be lengthened."""
    keys, owners = [], []
    two, three = _U((1 << 2 * WIDTH) - 1), _U((1 << 3 * WIDTH) - 1)
    for i in range(SEGMENTS):
        ring = turned(f, i)
        name = _U(i << 2 * WIDTH)
        for own in (True, False):
            if own:
                value, owner = ring, np.arange(len(f))
            else:
                value, owner = _variants(ring & two, WIDTH, 1, True)
                changed = value != (ring & two)[owner]
                value, owner = value[changed], owner[changed]
                value = value | (ring[owner] & ~two)
            short = name | (value & two)
            hot = np.searchsorted(crowded, short, "left") < np.searchsorted(crowded, short, "right") if len(crowded) else np.zeros(len(short), bool)
            keys.append(short[~hot])
            owners.append(owner[~hot])
            if hot.any():
                # An unchanged one brings only larger third segments, of two bits at most; a changed one all that are one bit apart.
                longer, at = _variants(value[hot] & three, 2 * WIDTH, 2 if own else 1, own)
                keys.append(_U(1 << 63) | _U(i << 3 * WIDTH) | longer)
                owners.append(owner[hot][at])
    return np.concatenate(keys), f[np.concatenate(owners)]


def viable(differ: np.ndarray) -> np.ndarray:
    """Whether the chains from the lowest segment on stay within their budgets, the shortest first."""
    good = (differ & _U((1 << WIDTH) - 1)) == 0
    for length in range(2, SEGMENTS + 1):
        at = np.flatnonzero(good)
        good[at] = np.bitwise_count(differ[at] & _U((1 << length * WIDTH) - 1)) <= BITS * length // SEGMENTS
    return good


def forest(ring: np.ndarray) -> list[tuple[int, int]]:
    """Links that span what is linked among `ring`, as places: search from one to all that are not yet reached."""
    left, out = np.arange(len(ring)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = viable(ring[left] ^ ring[one])
            out += [(one, x) for x in left[near].tolist()]
            queue += left[near].tolist()
            left = left[~near]
    return out


def meet(rows: pa.Table) -> pa.Table:
    """Links between fingerprints that share a key, in one bucket of keys."""
    key = np.frombuffer(b"".join(rows.column("token").to_pylist()), "<u8")
    f = np.frombuffer(b"".join(rows.column("print").to_pylist()), "<u8")
    order = np.lexsort((f, key))
    key, f = key[order], f[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((start, [len(key)])))
    long = key >> _U(63) == 1
    segment = np.where(long, (key & ~_U(1 << 63)) >> _U(3 * WIDTH), key >> _U(2 * WIDTH)).astype(np.int64)
    ring = np.select([segment == i for i in range(SEGMENTS)], [turned(f, i) for i in range(SEGMENTS)]) if len(f) else f
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    several = np.repeat((size > 1) & (size <= SMALL), size)
    k, r, g = key[several], ring[several], f[several]
    for shift in range(1, SMALL):
        at = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(at):
            break
        at = at[viable(r[at] ^ r[at + shift])]
        left.append(g[at])
        right.append(g[at + shift])
    for group in np.flatnonzero(size > SMALL):
        a = start[group]
        part = np.arange(a, a + size[group])
        part = part[np.concatenate(([True], f[part[1:]] != f[part[:-1]]))]
        links = forest(ring[part])
        if links:
            x, y = np.array(links).T
            left.append(f[part[x]])
            right.append(f[part[y]])
    a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b], axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """a, b: links that connect whatever is connected among the distinct `print` (long) of a written table."""
    n = prints.count()
    buckets = max(2 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 20_000)
    limit = max(crowd, SEGMENTS * n // CROWDS)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            token = [_U(i << 2 * WIDTH) | (turned(f, i) & _U((1 << 2 * WIDTH) - 1)) for i in range(SEGMENTS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64))], names=["token"])

    crowded = np.zeros(0, np.uint64)
    if n > limit:  # at most CROWDS keys can hold more
        held = prints.select("print").mapInArrow(own, "token long").groupBy("token").count().where(F.col("count") > limit)
        crowded = np.sort(np.array([r.token for r in held.select("token").collect()], dtype=np.int64).view(np.uint64))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys and fingerprints, packed into a row for each bucket of keys."""
        for batch in batches:
            key, f = chain_keys(batch.column(0).to_numpy().view(np.uint64), crowded)
            bucket = (mixed(key) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            key, f, bucket = key[order], f[order], bucket[order]
            names, cut = np.unique(bucket, return_index=True)
            cut = [*cut.tolist(), len(bucket)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([key[x:y].astype("<u8").tobytes() for x, y in zip(cut, cut[1:])], pa.binary()),
                 pa.array([f[x:y].astype("<u8").tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], names=["bucket", "token", "print"])

    return prints.select("print").mapInArrow(keyed, "bucket int, token binary, print binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def near(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, print (the fingerprint as signed long), component (its smallest fingerprint, signed) and component_id of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(part.column(1)).view(np.int64))], names=["doc_id", "print"])

    rows = written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, print long"), "fingerprints")
    prints = written(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "prints")
    label = components(links(prints, crowd)).withColumnRenamed("node", "print")
    classed = written(prints.join(label, "print", "left").select("print", "least", "copies", F.coalesce("label", "print").alias("component")), "print-classes")
    least = written(classed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")), "components")
    named = written(looked_up(classed.select("print", "copies", "component"), least, "component", "prints"), "print-components")
    return looked_up(rows, named, "print", "copies")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id of its component."""
    return near(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
