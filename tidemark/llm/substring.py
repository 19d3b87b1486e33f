"""Substring dedup by de Bruijn compaction.

Edges are windows of k words, nodes the k - 1 words that neighbours share. Windows that follow one another and share a minimizer
(the smallest hash of the 5-word grams inside) travel as one packed row to the bucket of that minimizer, where equal edges of all
documents meet. A repeated edge points to its first source: the smallest document that has it. Edges in a row whose sources are in a row
too form a nonbranching path; pieces of a path found in different buckets are joined into one by their coordinates. Every path is
verified: its words in the document and at the source must have the same digest.

A word is removed if a window that covers it also starts in a document with a smaller id. Within a batch, equal stretches are
resolved at once and only those of the smallest document go on, so a passage in a third of all documents reaches its bucket
once a batch and not once a document.

Defined results: null and blank texts have no words; documents with a null id are kept whole and are nobody's source; documents
of the same id do not remove from each other; texts under k words are kept; an empty table gives an empty result."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import written

from .arrow import coded_words, gram_hashes, mixed, slices, word_hashes
from .common import table

GRAM = 5
PACKED = "bucket int, doc binary, tag binary, start binary, n binary, edges binary, near binary"
PATH = "doc_id long, tag long, start long, n long, src_doc long, src_tag long, src_start long"
#: A repeated piece found inside a batch.
NEAR = np.dtype([("doc", "<i8"), ("tag", "<u4"), ("start", "<u4"), ("n", "<u4"), ("src_doc", "<i8"), ("src_tag", "<u4"), ("src_start", "<u4")])


def tag() -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))


def stretches(texts: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """Stretches of windows with one minimizer: text number, first word, number of windows, minimizer, digest of the
    stretch; and the edge hash of each of their windows, all in a row."""
    words, at, begins = coded_words(texts)
    h = word_hashes(words)[at] if len(at) else np.zeros(0, np.uint64)
    edge, gram = gram_hashes(h, k), gram_hashes(h, GRAM)
    none = np.zeros(0, np.int64)
    if not len(edge):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), edge
    least = gram[:len(edge)].copy()
    for j in range(1, k - GRAM + 1):
        np.minimum(least, gram[j:len(edge) + j], out=least)
    doc = np.repeat(np.arange(len(texts)), np.diff(begins))[:len(edge)]
    place = np.arange(len(edge))
    keep = np.flatnonzero(place + k <= begins[doc + 1])
    if not len(keep):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), edge[:0]
    least, doc, place, edge = least[keep], doc[keep], place[keep], edge[keep]
    cut = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))))
    n = np.diff(np.concatenate((cut, [len(edge)])))
    whole = edge[cut] * np.uint64(3) + edge[cut + n - 1] * np.uint64(5) + n.astype(np.uint64) + np.add.reduceat(edge, cut) * np.uint64(7)
    return doc[cut], place[cut] - begins[doc[cut]], n, least[cut], mixed(whole), edge


def pack(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 2):
            ids, tags = part.column(0).to_numpy(), part.column(1).to_numpy().astype(np.uint32)
            doc, start, n, least, digest, edge = stretches(part.column(2), k)
            if not len(doc):
                continue
            ends = np.cumsum(n)
            raw = np.ascontiguousarray(edge, "<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            order = np.lexsort((start, tags[doc], ids[doc], digest))
            first = np.concatenate(([True], digest[order][1:] != digest[order][:-1]))
            head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            later = ids[doc[order]] > ids[doc[head]]
            near = np.zeros(int(later.sum()), NEAR)
            own, source = order[later], head[later]
            near["doc"], near["tag"], near["start"], near["n"] = ids[doc[own]], tags[doc[own]], start[own], n[own]
            near["src_doc"], near["src_tag"], near["src_start"] = ids[doc[source]], tags[doc[source]], start[source]
            near_bucket = (least[own] % np.uint64(buckets)).astype(np.int32)
            o = np.argsort(near_bucket, kind="stable")
            near, near_bucket = near[o], near_bucket[o]
            own = np.sort(order[~later])
            bucket = (least[own] % np.uint64(buckets)).astype(np.int32)
            o = np.argsort(bucket, kind="stable")
            own, bucket = own[o], bucket[o]
            names = np.union1d(bucket, near_bucket)
            cut, near_cut = np.searchsorted(bucket, [*names, buckets]), np.searchsorted(near_bucket, [*names, buckets])
            out: list[list] = [[] for _ in range(7)]
            for i, name in enumerate(names.tolist()):
                mine = own[cut[i]:cut[i + 1]]
                lengths = n[mine]
                rows = np.arange(int(lengths.sum())) + np.repeat(ends[mine] - lengths - (np.cumsum(lengths) - lengths), lengths)
                for c, v in zip(out, (name, ids[doc[mine]].astype("<i8").tobytes(), tags[doc[mine]].astype("<u4").tobytes(), start[mine].astype("<u4").tobytes(),
                                      lengths.astype("<u4").tobytes(), raw[rows].tobytes(), near[near_cut[i]:near_cut[i + 1]].tobytes())):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]],
                                             names=["bucket", "doc", "tag", "start", "n", "edges", "near"])


def resolve(rows: pa.Table) -> pa.Table:
    """All rows of a bucket: every edge that also starts in a smaller document, in pieces whose sources are in a row."""
    def column(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype=kind)

    doc, tags, start, n = column("doc", "<i8"), column("tag", "<u4"), column("start", "<u4").astype(np.int64), column("n", "<u4").astype(np.int64)
    raw, near = column("edges", "u1").reshape(-1, 6), column("near", NEAR)
    edge = np.zeros((len(raw), 8), np.uint8)
    edge[:, :6] = raw
    edge = edge.view("<u8").reshape(-1)
    order = np.argsort(edge, kind="stable")
    same = edge[order][1:] == edge[order][:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(edge) else np.zeros(0, bool)
    some = np.sort(order[shared])
    stretch = np.repeat(np.arange(len(n)), n)[some]
    place = start[stretch] + some - (np.cumsum(n) - n)[stretch]
    o = np.lexsort((place, tags[stretch], doc[stretch], edge[some]))
    e = edge[some][o]
    first = np.concatenate(([True], e[1:] != e[:-1])) if len(e) else np.zeros(0, bool)
    head = o[np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))] if len(o) else o
    back = np.empty(len(o), np.int64)
    back[o] = head
    hit = np.flatnonzero(doc[stretch] > doc[stretch[back]]) if len(o) else o
    src = back[hit]
    s, p, sp, ss = stretch[hit], place[hit], place[src], stretch[src]
    cols = {"doc_id": doc[s], "tag": tags[s].astype(np.int64), "start": p, "src_doc": doc[ss], "src_tag": tags[ss].astype(np.int64), "src_start": sp}
    if len(hit):
        new = np.concatenate(([True], (some[hit][1:] != some[hit][:-1] + 1) | (s[1:] != s[:-1]) | (sp[1:] != sp[:-1] + 1)
                              | (doc[ss][1:] != doc[ss][:-1]) | (tags[ss][1:] != tags[ss][:-1])))
        at = np.flatnonzero(new)
        cols = {c: v[at] for c, v in cols.items()} | {"n": np.diff(np.concatenate((at, [len(hit)])))}
    else:
        cols["n"] = np.zeros(0, np.int64)
    both = {"doc_id": near["doc"], "tag": near["tag"], "start": near["start"], "n": near["n"], "src_doc": near["src_doc"], "src_tag": near["src_tag"], "src_start": near["src_start"]}
    return pa.table({c: np.concatenate((cols[c].astype(np.int64), both[c].astype(np.int64))) for c in both})


def paths(docs: DataFrame, k: int = 13, buckets: int | None = None) -> DataFrame:
    """Compacted paths: `n` windows from word `start` of (doc_id, tag) that equal those from `src_start` of a smaller document."""
    spark = docs.sparkSession
    count = buckets or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    packed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), tag().alias("tag"), "text").mapInArrow(
        lambda batches: pack(batches, k, count), PACKED)
    return compacted(written(packed.groupBy("bucket").applyInArrow(resolve, PATH), "path-pieces"))


def compacted(pieces: DataFrame) -> DataFrame:
    """Pieces joined into paths. Repeated rows, and rows resolved partly in their batch and partly in a bucket, give pieces of one
    line (document, source and distance) twice or overlapping; a path is what they cover, not their sum."""
    line = ["doc_id", "tag", "src_doc", "src_tag", "line"]
    w = Window.partitionBy(*line).orderBy("start")
    ends = pieces.withColumns({"line": F.col("start") - F.col("src_start"), "end": F.col("start") + F.col("n")})
    reached = ends.withColumn("reached", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    linked = reached.withColumn("path", F.max(F.when(F.col("reached").isNull() | (F.col("reached") < F.col("start")), F.col("start"))).over(w))
    return linked.groupBy(*line, "path").agg(F.max("end").alias("end")).select(
        "doc_id", "tag", F.col("path").alias("start"), (F.col("end") - F.col("path")).alias("n"), "src_doc", "src_tag", (F.col("path") - F.col("line")).alias("src_start"))


def _words(text: str | None) -> list[str]:
    return [w for w in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]


def dedup(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row of `docs` (doc_id, text)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(paths(docs, k).withColumn("len", F.col("n") + k - 1), "paths")
    text = docs.select(F.col("doc_id").cast("long"), tag().alias("tag"), "text").repartition(n, "doc_id", "tag")  # both joins read this one exchange
    own = found.select("doc_id", "tag", F.col("start"), "len")
    source = found.select(F.col("src_doc").alias("doc_id"), F.col("src_tag").alias("tag"), F.col("src_start").alias("start"), "len")
    wanted = own.union(source).distinct().repartition(n, "doc_id", "tag").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "len")).alias("wanted"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, x, spans in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                words = _words(x)
                rows = [(d, t, s["start"], s["len"], hashlib.blake2b(" ".join(words[s["start"]:s["start"] + s["len"]]).encode(), digest_size=16).digest()) for s in spans]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                 names=["doc_id", "tag", "start", "len", "digest"])

    digest = text.join(wanted, ["doc_id", "tag"]).select("doc_id", "tag", "text", "wanted").mapInArrow(
        digests, "doc_id long, tag long, start long, len long, digest binary").distinct()
    at_source = digest.select(F.col("doc_id").alias("src_doc"), F.col("tag").alias("src_tag"), F.col("start").alias("src_start"), "len", F.col("digest").alias("src_digest"))
    verified = found.join(digest, ["doc_id", "tag", "start", "len"]).join(at_source, ["src_doc", "src_tag", "src_start", "len"]).where("digest = src_digest")
    spans = verified.select("doc_id", "tag", "start", "len").distinct().repartition(n, "doc_id", "tag").groupBy("doc_id", "tag").agg(
        F.collect_list(F.struct("start", "len")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, x, spans in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                words = _words(x)
                total = len(words)
                if spans:
                    gone = np.zeros(total + 1, np.int32)
                    np.add.at(gone, [s["start"] for s in spans], 1)
                    np.add.at(gone, [s["start"] + s["len"] for s in spans], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone)) if not g]
                kept = " ".join(words)
                out.append((d, total, total - len(words), hashlib.sha256(kept.encode()).hexdigest(), kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                                                 names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return text.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's words, how many of them go, and a digest of the rest."""
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
lo AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
hit AS (SELECT r, i FROM win JOIN lo USING (s) WHERE doc_id > lo),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM hit),
word AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
