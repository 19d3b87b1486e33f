"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A text is cut into windows of one word each (lower case, without the marks around it). Each window, between two copies of a fixed
carrier line that both dictionaries know, is compressed with either dictionary; the difference in bytes says whose
vocabulary it is. The carrier keeps short windows from being stored uncompressed. A document's three largest differences, and the same
less the bytes of the word itself, and its number of windows go into a logistic score, fitted on documents that the dictionaries have not seen.

Training takes a bounded sample of labelled documents (`Limits`); scoring takes every window of every text. The toxic dictionary
is trained on words that occur in markedly more different contexts (word before, word, word after) in toxic than in ordinary documents:
contexts, unlike counts, do not grow when a document is copied.

Defined results: null and blank texts have no window and get the score of a text without any toxic window; several labels of one
id count as toxic if one is; null labels and ids are not learnt from; without labels of both kinds every score is the share of
toxic labels (0 without labels); repeated rows get one result each; an empty table gives an empty result."""
from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import table

MARKS = ".,!&%$#*|;:?\"()"
CARRIER = b" :: these words were said by somebody to somebody else :: "
#: The second figure of a word is not taken below this.
LOWEST = -12
#: Scores of words remembered per Python worker.
REMEMBERED = 400_000


@dataclass(frozen=True)
class Limits:
    """The training sample: documents of either kind, and characters of all of them together."""
    toxic: int = 1_500
    ordinary: int = 4_500
    chars: int = 24_000_000


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    constant: float | None = None


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-case words, the word of every place, and where every text begins."""
    flat = pc.utf8_lower(pc.fill_null(texts, ""))
    for c in "\t\n\x0b\x0c\r":
        flat = pc.replace_substring(flat, c, " ")
    lists = pc.split_pattern(flat, " ")
    coded = pc.dictionary_encode(lists.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    offsets = lists.offsets.to_numpy()
    return [w.strip(MARKS) for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


class Distance:
    """Of each word, the bytes that it takes more with the ordinary than with the toxic dictionary, and that less twice the bytes
    that it takes with the toxic one beyond the bare carrier: high only for words that the toxic dictionary has whole."""

    def __init__(self, model: Model):
        params = zstandard.ZstdCompressionParameters.from_level(9, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=4,
                                                                strategy=zstandard.STRATEGY_LAZY2, window_log=17, hash_log=12, chain_log=12)
        self.sides = []
        for content in (model.ordinary, model.toxic):
            d = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.sides.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        self.bare = len(self.sides[1].compress(CARRIER + b"  " + CARRIER))
        self.known: dict[str, tuple[int, int]] = {"": (0, 0)}

    def __call__(self, words: list[str]) -> np.ndarray:
        known, (ordinary, toxic) = self.known, self.sides
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                window = CARRIER + b" " + w.encode() + b" " + CARRIER
                with_toxic = len(toxic.compress(window))
                diff = len(ordinary.compress(window)) - with_toxic
                known[w] = (diff, max(LOWEST, diff - 2 * (with_toxic - self.bare)))
        return np.array([known[w] for w in words], dtype=np.int32).reshape(-1, 2)


def features(texts: pa.Array, distance: Distance) -> np.ndarray:
    """Per text: the three largest of either figure over its distinct words, and the logarithm of their number."""
    words, at, begins = words_of(texts)
    both = distance(words)
    real = np.fromiter((w != "" for w in words), dtype=bool, count=len(words))
    out = np.zeros((len(texts), 7))
    out[:, 3:6] = LOWEST
    for i in range(len(texts)):
        own = np.unique(at[begins[i]:begins[i + 1]])
        own = own[real[own]]
        for k in (0, 1):
            top = np.sort(both[own, k])[::-1][:3]
            out[i, 3 * k:3 * k + len(top)] = top
        out[i, 6] = np.log1p(len(own))
    return out


def probability(texts: pa.Array, model: Model, distance: Distance | None) -> np.ndarray:
    if distance is None:
        return np.full(len(texts), model.constant)
    x = np.column_stack([features(texts, distance), np.ones(len(texts))])
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxic_words(docs: list[tuple[list[str], int]]) -> list[str]:
    """Words that are markedly more toxic documents' own, once for each of their uses there. A word's use in a document counts as far
    as both the word before and the word after it are new: copies, also altered ones, bring few new neighbours."""
    def spread(label: int, only: set[str] | None) -> dict[str, int]:
        near: dict[str, tuple[set, set]] = {}
        for words, kind in docs:
            if kind == label:
                fresh: dict[str, tuple[str, str]] = {}
                for left, w, right in zip(["", *words], words, [*words[1:], ""]):
                    if only is None or w in only:
                        fresh.setdefault(w, (left, right))
                for w, (left, right) in fresh.items():
                    before, after = near.setdefault(w, (set(), set()))
                    before.add(left)
                    after.add(right)
        return {w: min(len(b), len(a)) for w, (b, a) in near.items()}

    ratio = max(1.0, sum(1 - label for _, label in docs) / max(1, sum(label for _, label in docs)))
    least = max(3, 0.015 * sum(label for _, label in docs))
    many = {w: n for w, n in spread(1, None).items() if w and n >= least}
    plain = spread(0, set(many))
    return [w for w, n in sorted(many.items()) if n * ratio >= 8 * (plain.get(w, 0) + 1) for _ in range(n)]


def dictionary(samples: list[str], size: int) -> bytes:
    """What the trainer makes of the samples, and after it the distinct samples themselves, most frequent last, `size` bytes
    of either at most: the trainer drops samples when there are few."""
    counts = Counter(s.encode() for s in samples)
    own = b"".join(s for s, _ in sorted(counts.items(), key=lambda x: (x[1], x[0])))[-size:]
    try:
        return zstandard.train_dictionary(size, [s.encode() for s in samples]).as_bytes() + own
    except zstandard.ZstdError:
        return own


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), toxic_size: int = 4096, ordinary_size: int = 16384) -> Model:
    """Fit on the labelled documents with crc32(doc_id) mod 4 other than 2. docs: doc_id, text. labels: doc_id, toxic."""
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(
        learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    shares = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(shares) != {0, 1}:
        return Model(b"", b"", (0.0,) * 8, 1.0 if shares.get(1) else 0.0)
    sized = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n")).join(marked, "doc_id")
    chosen: list[int] = []
    for label, most in ((1, limits.toxic), (0, limits.ordinary)):
        left = limits.chars * most // (limits.toxic + limits.ordinary)
        for r in sized.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id", "n").limit(most).collect():  # at most `most` pairs of numbers
            if r["n"] <= left:
                left -= r["n"]
                chosen.append(r["doc_id"])
    picked = spark.createDataFrame([(x,) for x in dict.fromkeys(chosen)], "doc_id long")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").join(marked, "doc_id").select(
        F.coalesce("text", F.lit("")).alias("text"), "label", (F.xxhash64("doc_id", F.lit(7)) % 2 == 0).alias("first")).distinct()
    sample = sorted(tuple(r) for r in rows.collect())
    texts = [(text, label) for text, label, first in sample if first]
    rest = [(text, label) for text, label, first in sample if not first] or texts
    if not rest:
        return Model(b"", b"", (0.0,) * 8, shares[1] / (shares[0] + shares[1]))
    words, at, begins = words_of(pa.array([t for t, _ in texts], pa.string()))
    cut = [([w for w in (words[j] for j in at[begins[i]:begins[i + 1]]) if w], y) for i, (_, y) in enumerate(texts)]
    rng = random.Random(7)
    toxic = [f" {w} " for w in toxic_words(cut)]
    rng.shuffle(toxic)
    plain = [f" {' '.join(ws[i:i + 4])} " for ws, y in cut if not y for i in range(0, len(ws), 40)]
    rng.shuffle(plain)
    model = Model(dictionary(toxic[:20_000], toxic_size), dictionary(plain[:40_000], ordinary_size), ())
    x = features(pa.array([t for t, _ in rest], pa.string()), Distance(model))
    y = np.array([label for _, label in rest], dtype=float)
    w = fit_logistic(x, y)
    ones = min(max(y.mean(), 1e-6), 1 - 1e-6)
    w[-1] += np.log(shares[1] / shares[0]) - np.log(ones / (1 - ones))  # from the sample's share of toxic rows to that of all labels
    return Model(model.toxic, model.ordinary, tuple(float(v) for v in w))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, row_key (of id and text), score and predicted of every row; one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model) if model.constant is None else None
        for batch in batches:
            p = probability(batch.column(2), model, distance)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                                             names=["doc_id", "row_key", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text").mapInArrow(
        run, "doc_id long, row_key long, score double, predicted int")


def clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """`docs` without the rows whose text scores `threshold` or more; all columns as they were; one pass, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(model) if model.constant is None else None
        for batch in batches:
            yield batch.filter(pa.array(probability(batch.column("text"), model, distance) < threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from the labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "score", "predicted")
