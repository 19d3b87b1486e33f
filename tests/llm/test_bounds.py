"""What grows with the input and what does not: remembered words, labels of settled nodes, blocks of lines."""
import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import components, encode, lines


def test_remembered_words_are_bounded():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = encode.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    words = [f"x{i:x}" for i in range(700_000)]
    for i in range(0, len(words), 50_000):
        encoder(pa.array([" ".join(words[i:i + 50_000])]))
    assert len(encoder.known) <= 500_000
    text = "some words, x7 again."
    ids, counts = encoder(pa.array([text, ""]))
    assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids and counts.tolist() == [len(ids), 0]


@pytest.mark.parametrize("last", [0, 300])
def test_settled_nodes_are_not_carried_along(spark, monkeypatch, last):
    rng = np.random.default_rng(1)
    nodes = rng.permutation(1 << 20)[:1500].tolist()
    links = [*zip(nodes[:1200], nodes[1:1200]), *zip(nodes[1200:], nodes[1210:]), (nodes[0], nodes[0])]
    label = {x: x for e in links for x in e}
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = {n: low if m == high else m for n, m in label.items()}
    rows, written = [], components.written

    def counted(df, name):
        out = written(df, name)
        rows.append((name, out.count()))
        return out

    monkeypatch.setattr(components, "written", counted)
    monkeypatch.setattr(components, "LAST", last, raising=False)
    assert {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()} == label
    assert sum(n for name, n in rows if name == "labels") == len(label)


def test_lines_of_two_blocks_and_their_labels():
    text = "a line of some forty characters in all, "
    all_lines = [text + "one", text + "onE", text + "oNE", "another line that has nothing in common", "another line that has nothing in commox", "x", "y"]
    ids = pa.array(range(10, 17))
    table = lambda side, label: pa.table({"node": ids, "side": side, "label": label, "tokens": [x.encode() for x in all_lines]})
    pairs = lambda t: sorted(zip(t["a"].to_pylist(), t["b"].to_pylist()))
    assert pairs(lines.line_links(table([0] * 7, list(range(7))), 80, 8)) == [(10, 11), (10, 12), (13, 14)]
    assert pairs(lines.line_links(table([0, 0, 0, 0, 1, 0, 1], list(range(7))), 80, 8)) == [(13, 14)]
    assert pairs(lines.line_links(table([0] * 7, [1, 1, 1, 2, 2, 3, 4]), 80, 8)) == []


def test_overlaps_of_many_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, int(rng.integers(1, 200)))) for _ in range(90)]
    token, owner = np.concatenate(sets), np.repeat(np.arange(90), [len(s) for s in sets])
    common = lines.overlaps(token, owner, 90)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(90) for j in range(i))


def test_minima_do_not_depend_on_the_lines_beside():
    rng = np.random.default_rng(3)
    some = ["".join(rng.choice(list("abcdef é😀"), n)) for n in [*rng.integers(1, 60, 200), 5000, 70_000]]
    together = lines.bands(some, 8)
    assert all((lines.bands([x], 8)[:, 0] == together[:, i]).all() for i, x in enumerate(some))
