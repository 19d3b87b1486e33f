"""Nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables, for every operator and stage."""
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, encode, jaccard, licences, lines, mixing, search, secrets, substring, toxicity, trie

ITEMS = [(1, "quick brown fox jumps over the lazy dog while seven"), (None, "grey geese fly south across a cold blue lake"), (2, None), (3, ""), (4, "one two"), (1, "quick brown fox jumps over the lazy dog while seven")]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(11)] + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix(odd, nothing):
    rows = mixing.mix(odd, block=16).documents.collect()
    assert len(rows) == odd.count()
    assert sorted(r.size for r in rows) == sorted(len(words(r.text)) for r in odd.collect())
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    taken = {}
    for r in rows:
        taken.setdefault((r.source, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 0.5 for (_, target), t in taken.items())
    assert sum(target for _, target in taken) == pytest.approx(sum(r.size for r in rows))
    assert mixing.mix(nothing).documents.count() == 0


def test_mix_visits_sources_evenly(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "abc"[i % 3]) for i in range(600)], "doc_id long, text string, source string")
    plan = [r["_s"] for r in mixing.mix(docs, block=10).schedule.orderBy("slot").collect()]
    half = plan[:len(plan) // 2]
    for s in set(plan):
        assert abs(half.count(s) - plan.count(s) / 2) <= 6


def test_toxicity(odd, nothing, labels):
    for docs, marks in ((odd, labels), (odd, labels.where("toxic = 1")), (odd, labels.where("doc_id < 0")), (nothing, labels)):
        model = toxicity.train(docs, marks)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        kept = toxicity.clean(docs, model)
        assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in rows)


def test_encode(odd, nothing):
    rows = sorted(encode.digest(odd).collect(), key=lambda r: r.start)
    assert len(rows) == odd.count() and [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda x: -1 if x is None else x)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert encode.digest(nothing).count() == 0


def test_lines(odd, nothing):
    rows = lines.dedup(odd).collect()
    assert len(rows) == odd.count() and all(r.n_removed == len(r.removed) <= r.n_lines for r in rows)
    assert sorted(r.n_lines for r in rows) == sorted(sum(x.strip() != "" for x in (r.text or "").split("\n")) for r in odd.collect())
    assert lines.dedup(nothing).count() == 0


def test_licences(odd, nothing):
    assert licences.scan(odd).where("licences = '' AND n_sentences = 0").count() == odd.count()
    assert licences.scan(nothing).count() == 0


def test_decontaminate(odd, nothing, items):
    found = {(r.doc_id, r.item_id) for r in decontaminate.contained(odd, items).collect()}
    assert found == {(d, i) for d in (None, 2, 3, 7) for i in (1, None)}
    left = decontaminate.clean(odd, items)
    assert left.columns == odd.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in left.collect()) == [-1, 0, 1, 4, 5, 6, 8, 9, 10]
    assert decontaminate.contained(nothing, items).count() == 0 == decontaminate.contained(odd, items.where("item_id = 99")).count()


def test_substring(odd, nothing):
    rows = substring.dedup(odd).collect()
    want = []
    data = [(r.doc_id, words(r.text)) for r in odd.collect()]
    first = {}
    for d, w in data:
        for i in range(len(w) - 12):
            if d is not None:
                first[tuple(w[i:i + 13])] = min(d, first.get(tuple(w[i:i + 13]), d))
    for d, w in data:
        gone = {p for i in range(len(w) - 12) if d is not None and first[tuple(w[i:i + 13])] < d for p in range(i, i + 13)}
        want.append((d if d is not None else -1, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_text) for r in rows) == sorted(want)
    assert substring.dedup(nothing).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_substring_of_repeated_rows(spark, parts):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "a b " + passage + " c d"), *[(2, "x y z " + passage + " u v w q " + " ".join(f"t{i}" for i in range(90)))] * 2, (3, passage), *[(4, passage)] * 3]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 64, 0), *[(2, 157, 60)] * 2, (3, 60, 60), *[(4, 60, 60)] * 3]


def test_overlapping_pieces_are_one_path(spark):
    pieces = [(9, 0, 0, 8, 1, 0, 5), (9, 0, 0, 4, 1, 0, 5), (9, 0, 0, 8, 1, 0, 5), (9, 0, 8, 3, 1, 0, 13), (9, 0, 20, 2, 1, 0, 25), (9, 0, 21, 1, 1, 0, 26), (9, 0, 4, 4, 2, 0, 0)]
    got = substring.compacted(spark.createDataFrame(pieces, substring.PATH)).collect()
    assert sorted((r.doc_id, r.start, r.n, r.src_doc, r.src_start) for r in got) == [(9, 0, 11, 1, 5), (9, 4, 4, 2, 0), (9, 20, 2, 1, 25)]


def test_search(odd, nothing):
    rows = search.top_k(odd, F.col("doc_id") % 2 == 0, k=4, shard_chars=100).collect()
    best = {r.query_id: r.doc_id for r in rows if r["rank"] == 1}
    assert best[4] == 4 and best[6] == 6 and best[10] == 6 and 0 not in best and 8 not in best
    assert max(r["rank"] for r in rows) <= 4
    whole = search.top_k(odd, F.col("doc_id") % 2 == 0, k=4).collect()
    assert sorted(map(tuple, ((r.query_id, r["rank"], r.score) for r in rows))) == sorted(map(tuple, ((r.query_id, r["rank"], r.score) for r in whole)))
    assert search.top_k(nothing, F.col("doc_id") % 2 == 0).count() == 0


def test_secrets(odd, nothing):
    assert secrets.scan(odd, F.col("source"), F.col("source")).count() == odd.count()
    assert secrets.scan(nothing, F.col("source"), F.col("source")).count() == 0


def test_jaccard(odd, nothing):
    rows = jaccard.join(odd).collect()
    assert len(rows) == odd.count()
    data = [(r.doc_id, words((r.text or "").lower())) for r in odd.collect()]
    sets = [(d, {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}) for d, w in data]
    assert sorted(r.n_shingles for r in rows) == sorted(len(s) for _, s in sets)
    groups = {r.doc_id: r.component_id for r in rows if r.n_shingles > 1}
    assert groups[2] == groups[3] == 2 and groups[4] == 4
    assert {r.component_id for r in rows if r.doc_id in (6, 10)} == {6}
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and words(r.text)) == [2, 4, 5, 6, 7, 9]
    assert kept.where("text IS NULL OR trim(text) = ''").count() == odd.where("text IS NULL OR trim(text) = ''").count()
    assert jaccard.join(nothing).count() == 0


@pytest.mark.parametrize("percent,block", [(50, 1024), (85, 1024), (95, 8), (60, 4), (85, 8)])
def test_jaccard_equals_all_pairs(spark, percent, block, monkeypatch):
    monkeypatch.setattr(trie.linked, "__defaults__", (trie.as_tokens, block))
    import numpy as np
    rng = np.random.default_rng(percent)
    rows, base = [], []
    for i in range(160):
        n = int(rng.integers(1, 60))
        if i % 2 or not base:
            base = [f"t{x}" for x in rng.integers(0, 10_000, n)]
        w = [x if rng.random() > 0.03 else f"u{rng.integers(10_000)}" for x in base]
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()}
    sets = [{" ".join(w[j:j + 4]) for j in range(max(1, len(w) - 3))} for w in (t.split() for _, t in rows)]
    above = list(range(len(rows)))

    def root(k):
        while above[k] != k:
            k = above[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = root(a), root(b)
                above[max(p, q)] = min(p, q)
    assert got == {i: root(i) for i in range(len(rows))}


def test_large_clusters_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie.linked, "__defaults__", (trie.as_tokens, 64))
    import numpy as np
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(700):
        w = list(base)
        for p in rng.integers(0, 200, 2):
            w[p] = f"x{i}_{p}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages(spark, odd, nothing, items, labels, tmp_path, stage):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, f = stage
    for docs in (odd, nothing):
        out = f(spark, docs, str(tmp_path))
        assert name == "token_ids" or out.columns == docs.columns
        assert out.count() <= 3 * docs.count()


def test_the_stage_links_at_80_percent_of_five_words(spark, sf):
    base = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    texts = [base, [{30: "x", 60: "y"}.get(i, w) for i, w in enumerate(base)], other, [*other, *(f"z{i}" for i in range(20))], [*other[:60], *(f"u{i}" for i in range(40))]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()) == [0, 2, 4]
    assert jaccard.keep_one(docs).count() == 5


def test_pipeline_runs_and_repeats(spark, sf):
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) for _ in range(2))
    assert one == two and len(one) > 100


def test_equal_sets_in_a_trie():
    import numpy as np
    sets = [np.array(x, dtype=np.uint64) for x in ([1, 2, 3], [1, 2, 3], [1, 2, 3], [1, 2, 3, 4], [7], [7])]
    tree = trie.Trie(sets)
    assert sorted(tree.similar(sets[0], 75, np.ones(6, bool)).tolist()) == [0, 1, 2, 3]
    assert sorted(tree.similar(sets[4], 80, np.ones(6, bool)).tolist()) == [4, 5]
    assert sorted(trie.Trie(sets[:2]).similar(sets[0], 80, np.ones(2, bool)).tolist()) == [0, 1]
