"""SimHash links, term-at-a-time search and token alignment against plain versions, and on odd tables."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import align, simhash, taat
from tidemark.llm.skew import looked_up


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def plain_components(names):
    """names: print by id; the smallest id reachable over links of 3 bits or fewer."""
    prints = sorted(set(names.values()))
    up = {p: p for p in prints}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p
    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                up[find(p)] = find(q)
    least = {}
    for d, p in sorted(names.items()):
        least.setdefault(find(p), d)
    return {d: least[find(p)] for d, p in names.items()}


def test_simhash_equals_a_plain_version(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    names = {r.doc_id: plain_print(r.text) for r in rows}
    near = plain_components(names)
    got = simhash.query(spark, sf).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{p:016x}", near[d]) for d, p in names.items()}


def test_prints_of_long_and_odd_texts():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") + rng.choice("xyzÄß") for _ in range(n)) for n in (1, 2, 3, 4, 254, 256, 257, 258, 259, 700, 3000)]
    texts += ["", None, "  A\tB\n\nC  D ", "x" * 5000, "   "]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [plain_print(t) for t in texts]


def crowded_prints(n, seed=5):
    """Random fingerprints, chains of them three bits apart, and a crowd around one."""
    rng = random.Random(seed)
    flip = lambda p, k: p ^ sum(1 << b for b in rng.sample(range(64), k))
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n // 10):
        p = rng.choice(out)
        for _ in range(4):
            p = flip(p, rng.randint(1, 4))
            out.append(p)
    centre = rng.getrandbits(64)
    return sorted({*out, *(flip(centre, rng.randint(1, 6)) for _ in range(n)), 0, 1, 7, 15, (1 << 64) - 1})


@pytest.mark.parametrize("crowd", [simhash.CROWD, 5])
def test_links_connect_what_is_connected(spark, crowd, monkeypatch):
    from tidemark.llm.components import components
    from tidemark.session import written
    if crowd == 5:
        monkeypatch.setattr(simhash, "CROWDS", 10 ** 9)  # let short keys be lengthened in a small table
    prints = crowded_prints(600)
    table = written(spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "print long"), "test-prints")
    links = simhash.links(table, crowd)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    want = plain_components(dict(enumerate(prints)))
    label = {r.node % (1 << 64): r.label % (1 << 64) for r in components(links).collect()}
    got = {i: label.get(p, p) for i, p in enumerate(prints)}
    first = {}
    assert all(first.setdefault(got[i], want[i]) == want[i] for i in got)
    assert len(set(got.values())) == len(set(want.values()))


def test_every_linked_pair_meets():
    """Each pair of up to 3 differing bits has a chain that stays within its budgets, and shares a key under short and long keys."""
    rng = random.Random(6)
    for _ in range(300):
        p = rng.getrandbits(64)
        q = p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        f = np.array([p, q], np.uint64)
        short = np.unique(np.concatenate([np.uint64(i << 32) | (simhash.turned(f, i) & np.uint64(0xFFFFFFFF)) for i in range(4)]))
        for crowded in (short[:0], short, short[::2]):
            keys, owner = simhash.chain_keys(f, crowded)
            by = defaultdict(set)
            for k, o in zip(keys.tolist(), owner.tolist()):
                by[k].add(o)
            shared = [k for k, o in by.items() if len(o) == 2]
            turn = [(k & ~(1 << 63)) >> 48 if k >> 63 else k >> 32 for k in shared]
            assert any(simhash.viable(simhash.turned(f[:1] ^ f[1:], i))[0] for i in turn)


def test_simhash_on_odd_tables(spark, odd, nothing):
    got = simhash.near(odd)
    assert got.columns == ["doc_id", "print", "component", "component_id"]
    rows = got.collect()
    assert len(rows) == odd.count()
    zero = [r for r in rows if r.print == 0]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in zero) == [(False, 0), (False, 1), (False, 8), (True, 0)]
    assert {r.component_id for r in zero} == {0}
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 7)} >= {2}
    assert simhash.near(nothing).count() == 0
    alone = simhash.near(odd.where("doc_id IS NULL AND text IS NULL")).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


def test_lookups_of_uneven_keys(spark):
    from tidemark.session import written
    rows = written(spark.createDataFrame([(i, None if i % 50 == 0 else 7 if i % 3 else i) for i in range(3000)], "id long, k long"), "rows")
    lookup = written(rows.where("k IS NOT NULL").groupBy("k").count().selectExpr("k", "k * 2 AS v", "count AS uses").where("k <> 9"), "lookup")
    want = sorted((i, k, None if k is None or k == 9 else 2 * k) for i, k in ((r.id, r.k) for r in rows.collect()))
    key = lambda r: (r[0], r[1] or -1)
    assert sorted((tuple(r) for r in looked_up(rows, lookup, "k", "uses", 100).collect()), key=key) == sorted(want, key=key)


# Term-at-a-time search.

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_search(docs, items, k):
    """docs: (doc_id, text) rows."""
    terms = lambda t: re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, Counter(t), len(t)) for d, t in held if t]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        ranked = []
        for d, c, n in held:
            m, score = 75 + (25 * n * n_docs) // total, 0
            for w in terms(text):
                if c[w]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 12 * m))
            if score > 0:
                ranked.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if v else d, -s) for i, (s, v, d) in enumerate(sorted(ranked)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("item_bytes,batch", [(taat.ITEM_BYTES, 10_000), (120, 16)])
def test_search_equals_a_plain_version(spark, item_bytes, batch):
    """Many equal scores, hot terms, several shards a task and several blocks of items."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocab[:1 + int(60 * rng.random() ** 3)]) for _ in range(rng.choice([1, 2, 3, 5, 30])))) for i in range(400)]
    docs += [(400 + i, docs[i % 7][1]) for i in range(60)] + [(None, "w1 w2"), (500, None), (501, ""), (502, "... -- !"), (5, docs[5][1])]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 4, 9])))) for i in range(25)] + [(90, None), (91, ""), (92, "unknown"), (93, "W1 W1 w2-w3!")]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = taat.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 10, item_bytes).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == plain_search(docs, items, 10)


def test_accumulators_stop_and_stay_exact():
    rng = np.random.default_rng(9)
    n, vocab = 500, 40
    tf = (rng.random((n, vocab)) < np.linspace(0.01, 0.9, vocab)).astype(np.int64) * rng.integers(1, 6, (n, vocab))
    doc, term = np.nonzero(tf)
    length, weight = tf.sum(axis=1) + 1, np.linspace(4000, 5, vocab).astype(np.int64)
    shard = taat.Shard(length, doc, term, tf[doc, term], weight, n, int(length.sum()))
    m = 75 + 25 * length * n // int(length.sum())
    whole = (weight * ((10 ** 9 * tf) // (1000 * tf + 12 * m[:, None]))).sum(axis=1)
    found, score = shard.best([(t, 1) for t in range(vocab)], 10, 0)
    assert set(np.argsort(-whole, kind="stable")[:10]) <= set(found.tolist())
    assert (score == whole[found]).all()
    high = int(np.sort(whole)[-10])
    assert set(shard.best([(t, 1) for t in range(vocab)], 10, high)[0].tolist()) == set(np.flatnonzero(whole >= high).tolist())


def test_search_on_odd_tables(spark, odd, nothing):
    items = spark.createDataFrame([(1, "quick Fox"), (None, "geese"), (1, "quick Fox"), (2, None)], "item_id long, text string").selectExpr("*", "'x' AS rank", "'y' AS term")
    rows = taat.search(odd, items, 3).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = plain_search(docs, [(1, "quick Fox"), (None, "geese")], 3)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str) == want
    assert taat.search(nothing, items).count() == 0
    assert taat.search(odd, items.where("item_id = 7")).count() == 0


# Alignment.

def plain_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in own} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in own)}
    said, linked, count = [], [], Counter()
    for _, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p := b.id_to_piece(i)) else p.replace("▁", " ").encode() for i in ids_b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            said.append(None)
            linked.append([])
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        cuts, groups, pairs, i, j = sorted(set(ends_a) & set(ends_b)), [], [], 0, 0
        for y in cuts:
            x, z = i, j
            while ends_a[i] < y:
                i += 1
            while ends_b[j] < y:
                j += 1
            pairs.append((ids_a[i], ids_b[j]))
            i, j = i + 1, j + 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[z:j])))
        groups = ";".join(groups)
        count.update(pairs)
        said.append((len(ids_a), len(ids_b), len(cuts), groups))
        linked.append(pairs)
    top = Counter()
    for (_, y), c in count.items():
        top[y] = max(top[y], c)
    return [(d, 0, 0, 0, 0, 0, 0, "") if s is None else
            (d, s[0], s[1], s[2], len(p), sum(count[x] == top[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(s[3].encode()).hexdigest())
            for (d, _), s, p in zip(rows, said, linked)]


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned(spark, docs):
    import public_tokenizers as P
    return align.align(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


@pytest.mark.parametrize("share", [align.SHARE, 50])
def test_alignment_equals_a_plain_version(spark, sf, share, monkeypatch):
    monkeypatch.setattr(align, "SHARE", share)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text if r.text is None else r.text[:3000]) for r in docs.collect()]
    rng = random.Random(2)
    letters = [" ", "  ", "\n", "\t", "a", "b", "'s", "1", "é", "▁", "　", "<s>", "<|endoftext|>", ".", "😀", "\xa0", "\x00", "ﬁ", "é", "<0x0A>"]
    rows += [(10_000 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 14)))) for i in range(400)] + [(10_000, "again"), (None, "again"), (20_000, None), (20_001, "")]
    got = aligned(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))[0].collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got if r.doc_id is not None) == sorted(x for x in plain_alignment(rows) if x[0] is not None)
    assert [r.groups_sha256 for r in got if r.doc_id is None] == [x[-1] for x in plain_alignment(rows) if x[0] is None]


def test_a_forgetful_memory_changes_nothing(monkeypatch):
    import public_tokenizers as P
    paths = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    texts = [" ".join(f"w{i * j % 91}" for j in range(50)) for i in range(40)]
    pair, small, whole = align.Pair(*paths), align.Pair(*paths), align.Pair(*paths)
    assert pair.parted
    whole.parted = False
    monkeypatch.setattr(align, "REMEMBERED", 20)
    out = [[(*r[:4], r[4].tolist()) for t in texts for r in p.align([t])] for p in (pair, small, whole)]
    assert out[0] == out[1] == out[2]


def test_large_counts_take_several_entries(monkeypatch):
    monkeypatch.setattr(align, "COUNT_BITS", 2)
    out = align.packed(np.array([5] * 10 + [9] * 3 + [2]))
    assert Counter({k: int(sum(out[out >> 2 == k] & 3)) for k in (2, 5, 9)}) == {2: 1, 5: 10, 9: 3}


def test_alignment_on_odd_tables(spark, odd, nothing):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got, pairs = aligned(spark, odd)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=key) == sorted(plain_alignment(rows), key=key)
    assert pairs.where("best").selectExpr("id_b").distinct().count() == pairs.select("id_b").distinct().count()
    assert aligned(spark, nothing)[0].count() == 0


@pytest.mark.parametrize("batch", [10, 10_000])
def test_bm25_over_slices_without_queries_or_words(spark, batch, monkeypatch):
    """A partition of several batches or slices, some without a query row, some blank."""
    from pyspark.sql import functions as F
    from tidemark.llm import search
    rows = [(i, "" if i < 12 else f"word{i % 5} common term{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        few = search.top_k(docs, F.col("doc_id") == 25).collect()
        none = search.top_k(docs, F.col("doc_id") == 3).count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert few and none == 0
