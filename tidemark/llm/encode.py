"""Token-id files: ids in blocks, each block transposed into bit or byte planes, every plane compressed by zstandard.

A dataset is a folder of Parquet files, one row a block, written in the order of the documents: part and seq (place of the
block), first (ids of the part before it), n_ids, planes (compressed, lowest first), and the block's index: for every document piece in
it, doc_no (place in the part), doc_id, length, and whether the document begins and ends there. High planes of small ids are
all zero and cost nothing. Spark's writer commits whole tasks, so a lost executor leaves no half block.

Documents are ordered by doc_id (null first), then by a digest of the text, and get one closing id each. Null texts are empty
ones: just the closing id. Repeated rows are encoded once each. Texts of any length run over as many blocks as they need.
An empty table gives an empty dataset.

The tokenizer never joins what white space parts, so a text is encoded by its distinct pieces between blanks and line ends;
pieces already met come from a bounded memory."""
from __future__ import annotations

import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.session import shared_dir

from .common import table

BLOCK = 1 << 16
FILE = "part int, seq int, first long, n_ids int, planes array<binary>, doc_no array<long>, doc_id array<long>, length array<int>, begins array<boolean>, ends array<boolean>"
PIECE = "part int, doc_no long, doc_id long, at long, n int, crc long, ids binary"
#: Words remembered per Python worker.
REMEMBERED = 400_000
#: Characters of text encoded at once.
AT_ONCE = 2_000_000
#: New words that go to the tokenizer as one text.
LEARNT = 10_000
#: Between new words; a control character that the tokenizer keeps as a token of its own.
MARK = "\x01"
#: A letter or digit, the ASCII marks after it, and the blank or end after these.
CLOSING = r"([a-z0-9])([.,!&%$#*|;:?]+)( |$)"

_loaded: dict = {}


class Encoder:
    """Texts to ids by a tokenizer file, through a memory of words.

    Texts are lower-cased in ASCII and closing ASCII marks are set apart from the word before them, as the tokenizer itself does.
    New words go to the tokenizer as one text, with a mark between any two that no word contains."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, np.uint16)
        self.starts = np.zeros(1 << 16, np.int64)  # of every known word, and the end of the last; room beyond

    def learn(self, words: list[str]) -> None:
        for i in range(0, len(words), LEARNT):
            part = words[i:i + LEARNT]
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            cuts = np.flatnonzero(ids == self.mark[0])
            if len(self.mark) != 1 or len(cuts) != len(part) - 1:  # a word holds the mark
                each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in part]
                ids, sizes = np.array([x for e in each for x in e], dtype=np.int64), np.array([len(e) for e in each])
            else:
                sizes = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
                ids = np.delete(ids, cuts)
            first = len(self.known)
            end = int(self.starts[first])
            while first + len(part) >= len(self.starts):
                self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
            while end + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            if len(ids) and ids.max() > 0xFFFF and self.ids.dtype == np.uint16:
                self.ids = self.ids.astype(np.uint32)
            self.ids[end:end + len(ids)] = ids
            self.known.update(zip(part, range(first, first + len(part))))
            self.starts[first + 1:first + len(part) + 1] = end + np.cumsum(sizes)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        flat = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        flat = pc.replace_substring_regex(flat, CLOSING, r"\1 \2\3")
        lists = pc.split_pattern(flat, " ")
        words = pc.dictionary_encode(lists.flatten())
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        names = words.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        known = self.known
        self.learn([w for w in names if w not in known])
        at = np.fromiter(map(known.__getitem__, names), dtype=np.int64, count=len(names))
        which = at[words.indices.to_numpy(zero_copy_only=False)]
        starts = self.starts[which]
        each = self.starts[which + 1] - starts
        ends = np.cumsum(each)
        ids = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - each), each)]
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        total = np.concatenate(([0], ends))
        return ids, total[bounds[1:]] - total[bounds[:-1]]


def planes_of(ids: np.ndarray, bits: bool, compressor) -> list[bytes]:
    """The ids' planes, lowest first, compressed."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4).T
    if bits:
        rows = [np.packbits((rows[b // 8] >> (b % 8)) & 1) for b in range(32)]
    return [compressor.compress(np.ascontiguousarray(r).tobytes()) for r in rows]


def ids_of(planes: list[bytes], n: int, decompressor) -> np.ndarray:
    rows = [np.frombuffer(decompressor.decompress(p), dtype=np.uint8) for p in planes]
    if len(rows) == 4:
        return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").reshape(-1) if n else np.zeros(0, "<u4")
    out = np.zeros(n, dtype="<u4")
    for b, row in enumerate(rows):
        out |= np.unpackbits(row, count=n).astype("<u4") << b
    return out


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def encode(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block: int = BLOCK, bits: bool = False) -> None:
    """Write `docs` (doc_id, text) as token ids to the folder `path`. tokenizer: a tokenizer file that executors can read."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(
        n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = _schema(FILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Encoder(tokenizer)
        encoder, compressor = _loaded[tokenizer], zstandard.ZstdCompressor(level=3)
        part = TaskContext.get().partitionId()
        waiting: list[np.ndarray] = []
        index: deque[list] = deque()  # doc_no, doc_id, length, begins, ends
        state = {"held": 0, "seq": 0, "first": 0, "no": 0}

        def block_of(size: int) -> pa.RecordBatch:
            ids = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
            mine, rest = ids[:size], ids[size:]
            waiting[:] = [rest] if len(rest) else []
            entries, left = [], size
            while index and left > 0:
                x = index[0]
                if x[2] <= left:
                    entries.append(index.popleft())
                    left -= x[2]
                else:
                    entries.append([x[0], x[1], left, x[3], False])
                    index[0] = [x[0], x[1], x[2] - left, False, x[4]]
                    left = 0
            row = [part, state["seq"], state["first"], len(mine), planes_of(mine, bits, compressor), *[[e[i] for e in entries] for i in range(5)]]
            state["seq"] += 1
            state["first"] += len(mine)
            state["held"] -= len(mine)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
            group = np.cumsum(lengths) // AT_ONCE
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                ids, counts = encoder(texts.slice(a, b - a))
                counts = counts.astype(np.int64)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                waiting.append(ids.astype("<u4"))
                state["held"] += len(ids)
                for name, c in zip(names[a:b], counts.tolist()):
                    index.append([state["no"], name, c + 1, True, True])
                    state["no"] += 1
                while state["held"] >= block:
                    yield block_of(block)
        if state["held"]:
            yield block_of(state["held"])

    sorted_docs.mapInArrow(run, FILE).write.option("compression", "uncompressed").parquet(path)


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc_of_both(a: int, b: int, length: int) -> int:
    """crc32 of two byte strings in a row from the crc32 of each: `a` moved on by `length` zero bytes, plus `b`."""
    shift = [0xEDB88320, *[1 << i for i in range(31)]]  # one zero bit; the polynomial is a fixed value
    for _ in range(3):
        shift = [_times(shift, x) for x in shift]
    while length:
        if length & 1:
            a = _times(shift, a)
        shift = [_times(shift, x) for x in shift]
        length >>= 1
    return a ^ b


def pieces(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The document pieces of all blocks, decoded: part, doc_no, doc_id, at (ids of the part before it), n, crc of its ids."""
    schema = _schema(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, out = ids_of(row["planes"], row["n_ids"], decompressor), 0, []
                for no, name, n in zip(row["doc_no"], row["doc_id"], row["length"]):
                    raw = ids[at:at + n].tobytes()
                    out.append((row["part"], no, name, row["first"] + at, n, zlib.crc32(raw), raw if with_ids else None))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return spark.read.schema(FILE).parquet(path).select("part", "first", "n_ids", "planes", "doc_no", "doc_id", "length").mapInArrow(run, PIECE)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files."""
    index = spark.read.schema(FILE).parquet(path)
    sizes = index.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    offsets = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        out = []
        for p in parts:
            crc = int(p[0]["crc"])
            for x in p[1:]:
                crc = crc_of_both(crc, int(x["crc"]), 4 * int(x["n"]))
            out.append(crc)
        return pd.Series(out, dtype="int64")

    docs = pieces(spark, path).groupBy("part", "doc_no", "doc_id").agg(
        F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("_p"))
    return docs.withColumn("ids_crc32", joined("_p")).join(offsets, "part").select(
        "doc_id", (F.col("_before") + F.col("at")).alias("start"), F.col("n_tokens").cast("long"), "ids_crc32")


def digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode `docs` to a new folder below the shared one and read the files back."""
    import public_tokenizers
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tidemark/ids-{uuid.uuid4().hex}"
    encode(docs, path, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path)


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and check sum in the encoded files."""
    return digest(table(spark, sf_dir, "documents"))
