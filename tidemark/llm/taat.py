"""Ranked lexical search, term at a time with a limited number of accumulators.

Items are queries; documents are dealt into shards. First one pass writes, for each document, its length and the query terms in it with their
counts, and N, L and the document frequencies are counted over all of them. Then every shard turns its documents into posting lists and takes each item's terms
rarest first. A document gets an accumulator when a term first finds it. Once the greatest scores that the remaining terms can still add fall below the k-th
best partial score (or below the k-th best of earlier shards of the task), no document without an accumulator can come among the k best:
from there on no accumulators are made, and those there are get the rest of their terms, so their scores are exact. Equal scores may
still win by their doc_id, so the bound must be strictly below. The k best of all shards are merged exactly.

Terms are the maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased. N: documents with a term; L: all their terms; n: a
document's terms; df: documents with a term; tf: its occurrences. w = floor(1000 ln((2N + 2) / (2 df + 1))); m = 75 + 25 n N div L;
score = sum over the item's terms, repeats included, of w (1000000000 tf div (1000 tf + 12 m)), in 64-bit integers.

Items are read in blocks of about `item_bytes`, which bounds what the driver and every task hold; each block passes over the documents anew. Defined results: null
texts have no terms; an item without known terms finds nothing; each row of documents is a document, so a repeated row is
ranked again; rows of items with equal id and text are one item; null ids come after all others; empty tables give an empty result.
Other columns are ignored."""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import written

from .arrow import coded_words, slices
from .common import table

#: Bytes of item text worked on in one pass over the documents.
ITEM_BYTES = 16_000_000
#: Shards' results are merged in so many groups before the last merge.
MERGES = 64

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
HIT = "item_key long, item_id long, doc_id long, score long"


def spaced(texts: pa.Array) -> pa.Array:
    """Texts of terms with blanks between; A-Z become a-z."""
    flat = pc.fill_null(texts.cast(pa.string()), "")
    data = flat.buffers()[2]
    at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset:flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
    raw = data.to_pybytes()[at[0]:at[-1]].translate(_TERM) if data is not None else b""
    return pa.StringArray.from_buffers(len(flat), pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(raw))


def hits(texts: pa.Array, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of every text; and document, term and count of every query term in it, by document."""
    words, at, begins = coded_words(spaced(texts))
    number = np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))
    term = number[at] if len(at) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))
    key, count = np.unique((doc * len(vocabulary) + term)[term >= 0], return_counts=True)
    return np.diff(begins), key // max(len(vocabulary), 1), key % max(len(vocabulary), 1), count


class Shard:
    """Posting lists of a stretch of documents: for each term its documents and their scores for one occurrence in an item."""

    def __init__(self, length: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, docs: int, terms: int):
        m = 75 + (25 * length * docs) // terms
        gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.argsort(term, kind="stable")
        self.doc, self.gain, self.size = doc[order], gain[order], len(length)
        names, first = np.unique(term[order], return_index=True)
        ends = [*first[1:].tolist(), len(order)]
        self.most = dict(zip(names.tolist(), np.maximum.reduceat(self.gain, first).tolist())) if len(order) else {}
        self.list = {t: (a, b) for t, a, b in zip(names.tolist(), first.tolist(), ends)}

    def best(self, item: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best, and their exact scores. item: terms and their repeats, rarest first; floor: a score that k
        documents have already."""
        item = [(t, times) for t, times in item if self.most.get(t)]
        rest = np.cumsum([0, *(self.most[t] * times for t, times in reversed(item))])[::-1].tolist()
        score, made, making, least = np.zeros(self.size, np.int64), np.zeros(self.size, bool), True, floor
        for (t, times), bound in zip(item, rest):
            if making and bound >= least and bound < int(score.max(initial=0)):
                partial = score[made]
                if len(partial) >= k:
                    least = max(floor, int(np.partition(partial, -k)[-k]))
            making = making and bound >= least
            a, b = self.list[t]
            doc, gain = self.doc[a:b], self.gain[a:b]
            if making:
                made[doc] = True
            else:
                known = made[doc]
                doc, gain = doc[known], gain[known]
            score[doc] += times * gain
        found = np.flatnonzero(made & (score > 0) & (score >= floor))
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        return found, score[found]


def _block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """item_key, item_id, doc_id and score of the k best documents of every task, for items that fit one pass."""
    asked = [Counter(w for w in text.as_py().split(" ") if w) for text in spaced(pa.array([r.text for r in items], pa.string()))]
    names = sorted({w for c in asked for w in c})
    vocabulary = {w: i for i, w in enumerate(names)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                n, doc, term, tf = hits(part.column(1), vocabulary)
                at = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], names=["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    held = written(docs.mapInArrow(read, "doc_id long, n long, terms array<int>, tf array<long>"), "term-counts")
    total = held.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    known = {r.term: r.df for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row a query term
    weight = np.array([math.floor(1000 * math.log((2 * total.docs + 2) / (2 * known[i] + 1))) if i in known else 0 for i in range(len(names))], dtype=np.int64)
    plans = [(r.item_key, r.item_id, sorted(((vocabulary[w], times) for w, times in c.items() if vocabulary[w] in known), key=lambda x: (known[x[0]], x[0])))
             for r, c in zip(items, asked)]
    plans = [p for p in plans if p[2]]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [np.zeros(0, np.int64)] * len(plans)  # null as the largest long, beside a mark
        void = [np.zeros(0, bool)] * len(plans)
        scores = [np.zeros(0, np.int64)] * len(plans)
        for batch in batches:
            size = pc.list_value_length(batch.column(2)).to_numpy()
            shard = Shard(batch.column(1).to_numpy(), np.repeat(np.arange(len(size)), size), batch.column(2).flatten().to_numpy().astype(np.int64),
                          batch.column(3).flatten().to_numpy(), weight, total.docs, total.terms)
            none = pc.is_null(batch.column(0)).to_numpy(zero_copy_only=False)
            name = pc.fill_null(batch.column(0), 0).to_numpy()
            for i, (_, _, item) in enumerate(plans):
                doc, score = shard.best(item, k, int(scores[i][-1]) if len(scores[i]) == k else 0)
                if len(doc):
                    d, v, s = np.concatenate((ids[i], name[doc])), np.concatenate((void[i], none[doc])), np.concatenate((scores[i], score))
                    order = np.lexsort((d, v, -s))[:k]
                    ids[i], void[i], scores[i] = d[order], v[order], s[order]
        for i, (key, item_id, _) in enumerate(plans):
            if len(ids[i]):
                n = len(ids[i])
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([item_id] * n, pa.int64()), pa.array(ids[i], mask=void[i]), pa.array(scores[i])],
                                                 names=["item_key", "item_id", "doc_id", "score"])

    return held.mapInArrow(ranked, HIT)


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_key (of id and text), item_id, rank, doc_id and score of the k best documents of every item.

    docs: doc_id, text; items: item_id, text; and any other columns."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
                    .withColumn("item_key", F.xxhash64("item_id", "text")), "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first().s
    blocks, found = max(1, -(-size // item_bytes)), None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_key", F.lit(7)), F.lit(blocks)) == block).collect()
        if part:
            hit = _block(docs, part, k)
            found = hit if found is None else found.unionByName(hit)
    if found is None:
        found = docs.sparkSession.createDataFrame([], HIT)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    found = found.withColumn("_merge", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES)).cast("int"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_key", "_merge").orderBy(*order))).where(F.col("rank") <= k).drop("rank")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_key").orderBy(*order))).where(F.col("rank") <= k)
    return found.select("item_key", "item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
n AS (SELECT doc_id, len(t)::BIGINT AS n FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM f GROUP BY 1), g),
s AS (SELECT q.item_id, f.doc_id, sum(q.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * n.n * g.docs) // g.terms))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term) JOIN n ON n.doc_id = f.doc_id CROSS JOIN g GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20"""
