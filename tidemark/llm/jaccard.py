"""N-gram Jaccard join by prefix trees.

A document is the set of its word n-grams, as 64-bit tokens in one global order. Clusters of sets that may be similar are joined in
prefix trees (trie.py), which share the overlap with common beginnings and leave subtrees whose remaining lengths cannot reach the
threshold; the result is exact.

The clusters come from a pigeonhole: two sets of a and b tokens with similarity t or more differ in at most k = (a + b)(1 - t) / (1 + t) tokens.
If tokens are dealt into more than k parts by hash, one part at least is equal in both. Sets are therefore classed by size, so that similar
ones fall into the same class or neighbours, each class fixes a number of parts for pairs of its sets with the next, and sets
meet when the digest of a part agrees (of two parts for small sets). Passages that many documents share hardly make them meet: whole
parts, some tokens from all over a document, must agree.

Sets that met are then narrowed by parity signatures (signature.py), a few hundred bytes in place of the whole set: two sets differ in at least as
many tokens as their signatures differ in bits, so a pair whose signatures are too far apart cannot be similar, and what is left
makes clusters hardly larger than the components. No similar pair is lost.

Equal sets are one class throughout, named by a 64-bit digest; copies are never paired. Defined results: texts without words, null
texts included, have the empty set and are linked with nothing; texts under n words have their whole sequence as the one n-gram; repeated
rows and ids are linked like any others; the smallest id ignores null ids, and a component without any id has null; an empty table gives an
empty result."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.session import written

from .arrow import coded_words, gram_hashes, mixed, slices, word_hashes
from .common import table, word_count
from .signature import narrowed, signatures
from .trie import linked

#: A part with fewer tokens says little: a passage of two documents alone can fill it.
FULL = 3
#: With at most so many parts, sets meet at two equal parts, not one.
FEW = 14


def token_sets(texts: pa.Array, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of all texts, ascending inside a text, and where each text's begin."""
    words, at, begins = coded_words(texts, lower)
    h = word_hashes(words)[at] if len(at) else np.zeros(0, np.uint64)
    grams, sizes = gram_hashes(h, n), np.diff(begins)
    counts = np.maximum(sizes - n + 1, 0)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    doc = np.concatenate((np.repeat(np.arange(len(texts)), counts), short))
    ends = np.cumsum(counts)
    place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begins[:-1] - (ends - counts), counts)
    alone = [xxhash.xxh64_intdigest(" ".join(words[x] for x in at[begins[i]:begins[i + 1]]), 99) for i in short]
    key = np.concatenate((grams[place], np.array(alone, dtype=np.uint64)))
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.zeros(0, bool)
    return key[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def digests(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, as signed."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ np.uint64(0x5851F42D4C957F2D)))))
    return mixed(total[begins[1:]] - total[begins[:-1]] + np.diff(begins).astype(np.uint64)).view(np.int64)


def size_classes(most: int, percent: int) -> np.ndarray:
    """Smallest sizes of the classes, up to one beyond `most`: sets at `percent` or more are in one class or in neighbours."""
    least = [1]
    while least[-1] <= most:
        least.append(least[-1] * 100 // percent + 1)
    return np.array([*least, least[-1] * 100 // percent + 1, (least[-1] * 100 // percent + 1) * 100 // percent + 1], dtype=np.int64)


def part_keys(tokens: np.ndarray, begins: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys under which sets meet, and the set of each, for pairs with the class above and for pairs with the class below.

    Large sets have so many parts to spare that two similar ones share an equal part of FULL tokens or more, as long as one of them
    has no more smaller parts than are spare; sets with more give all their parts with tokens, and one key more if even
    empty parts exceed what is spare. Small sets have two parts to spare and give all pairs of parts with tokens; those with more than
    one empty part give all pairs."""
    counts = np.diff(begins)
    least = size_classes(int(counts.max()) if len(counts) else 1, percent)
    own = np.searchsorted(least, counts, "right") - 1
    larger = np.minimum(least[2:] - 1, (least[1:-1] - 1) * 100 // percent)
    differ = (100 - percent) * (least[1:-1] - 1 + larger) // (100 + percent)
    few = differ + 3 <= FEW
    spare = np.where(few, 2, 2 + differ // 5)
    parts = differ + 1 + spare
    doc = np.repeat(np.arange(len(counts)), counts)
    keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    hashed, value = mixed(tokens ^ np.uint64(0x2545F4914F6CDD1D)), mixed(tokens + np.uint64(0x9E3779B97F4A7C15))

    def give(key: np.ndarray, owner: np.ndarray) -> None:
        keys.append(mixed(key))
        owners.append(owner)

    for family in (own, own - 1):
        real = (family >= 0) & (counts > 0)
        number = np.where(real, parts[np.maximum(family, 0)], 0)
        ends = np.cumsum(number)
        mine = real[doc]
        at = (ends - number)[doc[mine]] + (hashed[mine] % number[doc[mine]].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
        np.add.at(total, at, value[mine])
        held = np.bincount(at, minlength=len(total))
        owner = np.repeat(np.arange(len(counts)), number)
        place = np.arange(len(total)) - (ends - number)[owner]
        salt = family[owner].astype(np.uint64) * np.uint64(1 << 32) + place.astype(np.uint64)
        part = mixed(total + mixed(salt))
        empty = np.bincount(owner[held == 0], minlength=len(counts))
        thin = np.bincount(owner[held < FULL], minlength=len(counts))
        many = real & ~few[np.maximum(family, 0)]
        allowed = spare[np.maximum(family, 0)]
        chosen = many[owner] & ((held >= FULL) | ((held > 0) & (thin > allowed)[owner]))
        give(part[chosen], owner[chosen])
        bare = np.flatnonzero(many & (empty > allowed))
        give(family[bare].astype(np.uint64) + np.uint64(1 << 63), bare)
        for size in np.unique(number[real & ~many]):
            group = np.flatnonzero(real & ~many & (number == size))
            rows = (ends - number)[group][:, None] + np.arange(size)
            filled = (held[rows] > 0) | (empty[group] > 1)[:, None]
            for i in range(size):
                for j in range(i):
                    both = filled[:, i] & filled[:, j]
                    give(part[rows[both, i]] * np.uint64(3) + part[rows[both, j]] * np.uint64(5), group[both])
    return np.concatenate(keys), np.concatenate(owners)


def meet(rows: pa.Table) -> pa.Table:
    """Of every key that several sets have: its smallest set paired with each of the others."""
    token = np.frombuffer(b"".join(rows.column("token").to_pylist()), "<u8")
    node = np.frombuffer(b"".join(rows.column("node").to_pylist()), "<i8")
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    first = np.concatenate(([True], token[1:] != token[:-1])) if len(token) else np.zeros(0, bool)
    head = node[np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))] if len(token) else node
    other = head != node
    pairs = np.unique(np.stack((head[other], node[other]), axis=1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def join(docs: DataFrame, n: int = 4, percent: int = 85, lower: bool = True) -> DataFrame:
    """doc_id, row_key (of id and text), component (its digest, null for the empty set), n_shingles and component_id of every row.

    Sets link when 100 * intersection >= percent * union. docs: doc_id, text, and any other columns."""
    buckets = max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"), "text")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                tokens, begins = token_sets(part.column(2), n, lower)
                counts = np.diff(begins)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digests(tokens, begins), mask=counts == 0), pa.array(counts), pa.array(signatures(tokens, begins), pa.binary())],
                                                 names=["doc_id", "row_key", "node", "n_shingles", "signature"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys and sets, packed into a row for each bucket of keys; equal sets once."""
        for batch in batches:
            for part in slices(batch, 0):
                tokens, begins = token_sets(part.column(0), n, lower)
                node = digests(tokens, begins)
                key, owner = part_keys(tokens, begins, percent)
                _, one = np.unique(node, return_index=True)
                first = np.zeros(len(node), bool)
                first[one] = True
                key, owner = key[first[owner]], node[owner[first[owner]]]
                bucket = (key % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                key, owner, bucket = key[order], owner[order], bucket[order]
                names = np.unique(bucket)
                cut = np.searchsorted(bucket, [*names, buckets])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int32()), pa.array([key[a:b].astype("<u8").tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([owner[a:b].astype("<i8").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["bucket", "token", "node"])

    members = written(rows.mapInArrow(sized, "doc_id long, row_key long, node long, n_shingles long, signature binary"), "set-members")
    met = written(rows.select("text").mapInArrow(keyed, "bucket int, token binary, node binary").groupBy("bucket").applyInArrow(meet, "a long, b long").distinct(), "sets-met")
    candidates = narrowed(met, members.select("node", F.col("n_shingles").alias("n"), "signature"), percent)

    wanted = candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct()
    chosen = members.join(wanted, "node").groupBy("node").agg(F.min("row_key").alias("row_key")).select("row_key").distinct()
    texts = rows.join(chosen, "row_key", "left_semi").dropDuplicates(["row_key"]).select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                tokens, begins = token_sets(part.column(0), n, lower)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests(tokens, begins)), pa.array(np.diff(begins)), pa.array([tokens[a:b].astype("<u8").tobytes() for a, b in zip(begins, begins[1:])], pa.binary())],
                    names=["node", "n", "tokens"])

    full = written(texts.mapInArrow(sets, "node long, n long, tokens binary"), "sets")
    label = linked(candidates, full, percent)
    placed = members.drop("signature").join(label, "node", "left").withColumn("class", F.coalesce("label", "node"))
    least = placed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "class", "left").select(
        "doc_id", "row_key", F.col("class").alias("component"), "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """`docs` with one document of each component, that of the smallest id (null last); texts without words all stay."""
    rows = join(docs, n, percent).where("component IS NOT NULL")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("row_key").alias("r"))
    kept = written(rows.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.r").alias("__row_key")).distinct(), "kept")
    worded = word_count(F.col("text")) > 0
    one = docs.where(worded).withColumn("__row_key", F.xxhash64("doc_id", "text")).join(kept, "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return one.drop("__row_key").unionByName(docs.where(~worded))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's number of 4-word shingles and the smallest id of its component at 85 %."""
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS seen FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
