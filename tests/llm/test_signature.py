"""Narrowing by parity signatures: never a similar pair lost, dissimilar ones ruled out, blocks and hot groups alike."""
import numpy as np
import pytest

from tidemark.llm.signature import narrowed, signatures, widths


@pytest.fixture(scope="module")
def family():
    """Sets of 1 to 9,500 tokens, each with versions that differ a little or much; sizes on both sides of every change of length."""
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 2, 5, 40, 128, 130, 300, 1000, 5000, 9000, 9500):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for share in (0, .03, .08, .1, .3):
            other = base.copy()
            other[:int(size * share)] = rng.integers(0, 1 << 63, int(size * share), dtype=np.uint64)
            sets.append(np.unique(other))
            sets.append(np.unique(np.concatenate((other, rng.integers(0, 1 << 63, size // 12, dtype=np.uint64)))))
    return sets


def joined(pairs, n):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [y if z == x else z for z in label]
    return label


def similar(sets, percent):
    return [(i, j) for i in range(len(sets)) for j in range(i)
            if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))]


def packed(sets):
    return signatures(np.concatenate(sets), np.cumsum([0] + [len(s) for s in sets]))


def test_distance_is_at_most_the_difference(family):
    raw = packed(family)
    assert [len(r) // 8 for r in raw] == widths(np.array([len(s) for s in family])).tolist()
    for i in range(0, len(family), 7):
        for j in range(len(family)):
            a, b = np.frombuffer(raw[i], "<u8"), np.frombuffer(raw[j], "<u8")
            m = min(len(a), len(b))
            a, b = (np.bitwise_xor.reduce(x.reshape(-1, m), axis=0) for x in (a, b))
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(family[i], family[j]))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("block", [4096, 7])
def test_no_similar_pair_is_lost(spark, family, percent, block):
    """One group of all sets, in one block or many: what is left connects exactly what similar pairs connect, or a little more."""
    n = len(family)
    sets = spark.createDataFrame([(i, len(s), bytes(r)) for i, (s, r) in enumerate(zip(family, packed(family)))] * 2, "node long, n long, signature binary")
    met = spark.createDataFrame([(0, i) for i in range(1, n)], "a long, b long")
    got = joined([(r.a, r.b) for r in narrowed(met, sets, percent, block).collect()], n)
    pairs = similar(family, percent)
    assert pairs and all(got[i] == got[j] for i, j in pairs)
    assert len(set(got)) > 0.8 * len(set(joined(pairs, n)))


def test_sets_of_other_groups_do_not_meet(spark, family):
    some = [family[0], family[0], family[0]]
    sets = spark.createDataFrame([(i, len(s), bytes(r)) for i, (s, r) in enumerate(zip(some, packed(some)))], "node long, n long, signature binary")
    met = spark.createDataFrame([(0, 1)], "a long, b long")
    assert [tuple(r) for r in narrowed(met, sets, 85).collect()] in ([(1, 0)], [(0, 1)])
    assert narrowed(met.where("a < 0"), sets, 85).count() == 0
