"""Token alignment between two tokenizers, by exact-text deduplication.

Rows are shuffled by their full text; each distinct text is encoded and aligned once and carries its number of copies, which weighs
its pair counts; the measures then go back to the doc_ids under the text's SHA-256. A text is read as blank + text: A encodes that by a byte-level BPE file, B encodes the
text by a piece model that adds the blank itself. Bytes of a token are the byte-level entry decoded, or the piece in UTF-8 with U+2581 as blank and <0xHH> as
that byte. Offsets where a token of both ends cut the tokens into groups; tokens that end together are linked.

Neither tokenizer joins across a blank that follows a non-blank, so inside a text the stretches between such blanks are encoded and aligned on their
own, through a bounded memory of stretches; the two files are checked for what this rests on, and others are encoded whole. Texts in which a stretch
does not give its own bytes are judged as a whole.

Pair counts are summed map-side before they are shuffled; pairs that many texts hold are looked up by a broadcast of bounded size, the rest by a shuffle.
Defined results: null and empty texts, and texts whose bytes are not given back by both, have no tokens, zeros and '' for the digest; repeated rows
and null ids get a row each; an empty table gives an empty result. Other columns are ignored."""
from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import written

from .arrow import slices
from .common import table
from .skew import looked_up

#: Stretches remembered per Python worker.
REMEMBERED = 400_000
#: Bits of an id and of a count in a packed pair; larger counts take several entries.
ID_BITS, COUNT_BITS = 20, 23
#: Pairs that more than one in so many (text, pair) rows hold are broadcast.
SHARE = 100_000
ALIGNED = "text_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, packed array<long>"

_SPLIT = re.compile(r"(?<=\S)(?= +[^ ])").split
#: Whether some blank follows white space or nothing, or ends the text.
_UNEVEN = re.compile(r"^ |\s | $").search
_loaded: dict = {}


def _byte_values() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes for the characters from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Two tokenizers and a memory of aligned stretches."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        values = _byte_values()
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(values[c] for c in t) if (t := self.a.id_to_token(i)) is not None and all(c in values for c in t) else (t or "").encode() for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = [len(x) for x in self.bytes_a], [len(x) for x in self.bytes_b]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS:
            raise ValueError(f"ids of over {ID_BITS} bits")
        said = json.loads(self.a.to_str())
        before = said["pre_tokenizer"] or {}
        plain = not said["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        apart = not any("▁" in p.lstrip("▁") for p in pieces) and self.b.encode(" a\né") + self.b.encode("b") == self.b.encode(" a\né b")
        self.parted = bool(plain and apart)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str] = []
        self.counts = array("q")  # tokens of A and of B, groups, 1 if the bytes are not given back
        self.pairs = array("q")  # linked pairs of all stretches in a row, A's id above B's

    def _aligned(self, a: list[int], b: list[int]) -> tuple[int, int, int, int, str, list[int]]:
        """Counts, groups as text and linked pairs of a text whose bytes both give back."""
        size_a, size_b = self.size_a, self.size_b
        groups, pairs, end_a, end_b, j, from_a, from_b = [], [], 0, 0, 0, 0, 0
        for i, x in enumerate(a):
            end_a += size_a[x]
            while end_b < end_a:
                y = b[j]
                end_b += size_b[y]
                j += 1
            if end_b == end_a:
                pairs.append(x << ID_BITS | y)
                groups.append(f"{x}|{y}" if i == from_a and j == from_b + 1 else f"{','.join(map(str, a[from_a:i + 1]))}|{','.join(map(str, b[from_b:j]))}")
                from_a, from_b = i + 1, j
        return len(a), len(b), len(groups), 0, ";".join(groups), pairs

    def _gives(self, raw: bytes, ids: list[int], tokens: list[bytes]) -> bool:
        return b"".join([tokens[x] for x in ids]) == raw

    def _ids(self, raw: list[bytes], texts: list[str]) -> list[list[int]]:
        """A's ids of every text, from one encoding of stretches in a row where that gives them back apart."""
        if self.parted and not any(t[-1].isspace() for t in texts):
            ids = self.a.encode("".join(texts), add_special_tokens=False).ids
            ends = np.cumsum([len(self.bytes_a[i]) for i in ids])
            wanted = np.cumsum([len(r) for r in raw])
            cut = np.searchsorted(ends, wanted) + 1
            if cut[-1] == len(ids) and (ends[cut - 1] == wanted).all():
                return [ids[x:y] for x, y in zip([0, *cut.tolist()], cut.tolist())]
        return [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]

    def _encoded(self, texts: list[str]) -> list[tuple]:
        """Texts without their blank."""
        whole = [" " + t for t in texts]
        raw = [t.encode() for t in whole]
        a, b = self._ids(raw, whole), self.b.encode(texts, num_threads=1)
        joined, size_a, size_b = b"".join(raw), self.size_a, self.size_b
        # All texts at once: the same bytes in all, and the same number in each.
        if (self._gives(joined, list(chain.from_iterable(a)), self.bytes_a) and self._gives(joined, list(chain.from_iterable(b)), self.bytes_b)
                and all(len(r) == sum([size_a[i] for i in x]) == sum([size_b[i] for i in y]) for r, x, y in zip(raw, a, b))):
            return [self._aligned(x, y) for x, y in zip(a, b)]
        return [self._aligned(x, y) if self._gives(r, x, self.bytes_a) and self._gives(r, y, self.bytes_b) else (0, 0, 0, 1, "", []) for r, x, y in zip(raw, a, b)]

    def _stretches(self, text: str) -> list[str]:
        """Stretches without their first blank."""
        if not self.parted:
            return [text]
        return [u[1:] for u in _SPLIT(" " + text)] if _UNEVEN(text) else text.split(" ")

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """Tokens of A and B, groups, digest and linked pairs of every text."""
        if len(self.number) > REMEMBERED:
            self.forget()
        cut = [self._stretches(t) for t in texts]
        new = list({u for units in cut for u in units if u not in self.number})
        # Stretches that end in white space are apart from those that stand in a row.
        new.sort(key=lambda u: u[-1:].isspace())
        for i in range(0, len(new), 512):
            for u, (*counts, said, pairs) in zip(new[i:i + 512], self._encoded(new[i:i + 512])):
                self.number[u] = len(self.said)
                self.said.append(said)
                self.counts.extend(counts)
                self.pairs.extend(pairs)
        counts, pairs = np.array(self.counts, np.int64).reshape(-1, 4), np.array(self.pairs, np.int64)
        first = np.cumsum(counts[:, 2]) - counts[:, 2]
        number, said = self.number.__getitem__, self.said.__getitem__
        for text, units in zip(texts, cut):
            names = list(map(number, units))
            at = np.array(names)
            n_a, n_b, groups, bad = counts[at].sum(axis=0).tolist()
            if bad and len(units) > 1:
                n_a, n_b, groups, bad, joined, linked = self._encoded([text])[0]
                linked = np.array(linked, np.int64)
            else:
                joined, sizes = ";".join(map(said, names)), counts[at, 2]
                linked = pairs[np.arange(groups) + np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes)]
            yield (0, 0, 0, "", linked[:0]) if bad else (n_a, n_b, groups, hashlib.sha256(joined.encode()).hexdigest(), linked)


def packed(pairs: np.ndarray) -> np.ndarray:
    """Distinct pairs with their counts, a long each; a count beyond its bits takes several."""
    pair, count = np.unique(pairs, return_counts=True)
    most = (1 << COUNT_BITS) - 1
    times = -(-count // most)
    if len(times) and times.max() > 1:
        ends = np.cumsum(times)
        part = np.full(ends[-1], most)
        part[ends - 1] = count - (times - 1) * most
        pair, count = np.repeat(pair, times), part
    return (pair << COUNT_BITS) | count


def align(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Measures of every row of docs (doc_id, text), and pair, links and best (whether no A id has more links to its B id) of every id pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _loaded:
            _loaded[path_a, path_b] = Pair(path_a, path_b)
        pair = _loaded[path_a, path_b]
        for batch in batches:
            for part in slices(batch, 0):
                got = list(pair.align(part.column(0).to_pylist()))
                n_a, n_b, groups, digest, links = map(list, zip(*got))
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(1), pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.int64()),
                     pa.array([len(x) for x in links], pa.int64()), pa.array(digest, pa.string()), pa.array([packed(x) for x in links], pa.list_(pa.int64()))],
                    names=["text_key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "packed"])

    key = F.unhex(F.sha2(F.col("text"), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).select("text", "copies", key.alias("text_key"))
    texts = written(distinct.mapInArrow(run, ALIGNED), "aligned-texts")

    entry, mask = F.explode("packed").alias("entry"), (1 << COUNT_BITS) - 1
    pair, times = F.shiftrightunsigned("entry", COUNT_BITS), F.col("entry").bitwiseAND(F.lit(mask).cast("long"))
    counted = texts.select("copies", entry).select("copies", pair.alias("pair"), times.alias("times")).groupBy("pair").agg(
        F.sum(F.col("copies") * F.col("times")).alias("links"), F.count("*").alias("held"))
    counted = written(counted, "pair-counts")
    id_b = F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1).cast("long"))
    top = counted.groupBy(id_b.alias("b")).agg(F.max("links").alias("most"))  # a row a B id: bounded by the vocabulary
    pairs = written(counted.withColumn("b", id_b).join(F.broadcast(top), "b").select("pair", "links", "held", (F.col("links") == F.col("most")).alias("best")), "pairs")

    each = texts.select("text_key", entry).select("text_key", pair.alias("pair"), times.alias("times"))
    sums = looked_up(each, pairs, "pair", "held", SHARE, "inner").groupBy("text_key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("links")).alias("count_sum"))
    measures = written(texts.drop("packed").join(sums, "text_key", "left"), "text-measures")
    named = written(rows.select("doc_id", F.when(F.col("text") != "", key).alias("text_key")), "text-keys")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = looked_up(named, measures, "text_key", "copies").select(
        "doc_id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return out, pairs.select(F.shiftrightunsigned("pair", ID_BITS).alias("id_a"), id_b.alias("id_b"), "links", "best")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens, groups, links and their corpus-wide counts."""
    import public_tokenizers
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
