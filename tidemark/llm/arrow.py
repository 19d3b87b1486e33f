"""Words of many texts at once, for operators that work on Arrow batches."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Characters of text worked on at once.
AT_ONCE = 4_000_000


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about AT_ONCE characters of its column `text`, whole texts each."""
    group = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the word of every place in all texts, and where each text begins (and the last ends).

    Words are runs of anything but ASCII white space; `lower` turns A-Z into a-z."""
    flat = pc.fill_null(texts, "")
    if lower:
        flat = pc.ascii_lower(flat)
    for c in "\t\n\x0b\x0c\r":
        flat = pc.replace_substring(flat, c, " ")
    lists = pc.split_pattern(flat, " ")
    coded = pc.dictionary_encode(lists.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    at = coded.indices.to_numpy(zero_copy_only=False)
    begins = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    words = coded.dictionary.to_pylist()
    full = np.fromiter((w != "" for w in words), dtype=bool, count=len(words))[at] if len(at) else np.zeros(0, bool)
    return words, at[full], np.concatenate(([0], np.cumsum(full)))[begins]


def word_hashes(words: list[str], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves about half of the output's."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the places are those of all texts in a row."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for j in range(n):
        out += h[j:len(h) - n + 1 + j] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return mixed(out)
