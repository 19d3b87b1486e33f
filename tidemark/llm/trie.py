"""Set-similarity join in a prefix tree, and its distribution over clusters of candidates."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import written

from .components import components

#: Sets of a block; a task holds two blocks.
BLOCK = 1024


class Trie:
    """A path-compressed prefix tree of ascending token arrays, in flat arrays by node."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())  # big-endian bytes sort like the numbers
        runs, begin, length, depth, low, high, leaf, children = [], [], [], [], [], [], [], []
        size = 0
        stack = [(0, len(order), 0, -1)]
        while stack:
            lo, hi, at, above = stack.pop()
            one, last = sets[order[lo]], sets[order[hi - 1]]
            m = min(len(one), len(last))
            differ = np.flatnonzero(one[at:m] != last[at:m]) if hi - lo > 1 else ()
            end = (at + int(differ[0]) if len(differ) else m) if above >= 0 or hi - lo == 1 else (int(differ[0]) if len(differ) else m)
            node = len(begin)
            if above >= 0:
                children[above].append(node)
            sizes = [len(sets[order[i]]) for i in range(lo, hi)]
            runs.append(one[at:end])
            begin.append(size)
            length.append(end - at)
            size += end - at
            depth.append(end)
            low.append(min(sizes))
            high.append(max(sizes))
            leaf.append(-1)
            children.append([])
            i = lo
            if len(one) == end:
                leaf[-1] = order[lo]
                i += 1
            while i < hi and len(sets[order[i]]) == end:  # an equal set: a leaf of its own without tokens
                stack.append((i, i + 1, end, node))
                i += 1
            while i < hi:
                j, t = i + 1, sets[order[i]][end]
                while j < hi and sets[order[j]][end] == t:
                    j += 1
                stack.append((i, j, end, node))
                i = j
        self.tokens = np.concatenate(runs) if runs else np.zeros(0, np.uint64)
        self.begin, self.length, self.depth = np.array(begin), np.array(length), np.array(depth)
        self.low, self.high, self.leaf = np.array(low), np.array(high), np.array(leaf)
        self.first = np.cumsum([0] + [len(c) for c in children])
        self.child = np.array([x for c in children for x in c], dtype=np.int64)
        self.sizes = np.array([len(s) for s in sets])
        self.last = np.arange(len(begin))  # nodes are in preorder: a subtree is the nodes from its own to `last`
        for node in range(len(begin) - 1, -1, -1):
            if children[node]:
                self.last[node] = max(self.last[c] for c in children[node])
        self.known, self.tokens = np.unique(self.tokens, return_inverse=True)
        self.end_token = np.array([r[-1] if len(r) else 0 for r in runs], dtype=np.uint64)
        self.held = np.zeros(len(self.known) + 1, bool)

    def similar(self, probe: np.ndarray, percent: int, wanted: np.ndarray) -> np.ndarray:
        """Of the `wanted` sets, those with 100 * intersection >= percent * union. Level by level, all nodes of a level at once; a
        subtree is left when it has no wanted set, or when even all its remaining tokens, or all of the probe's, could not make
        up the overlap that its smallest set needs."""
        n, found = len(probe), []
        at = np.minimum(np.searchsorted(self.known, probe), len(self.known) - 1)
        at = at[self.known[at] == probe] if len(self.known) else at[:0]
        self.held[at] = True
        asked = np.concatenate(([0], np.cumsum((self.leaf >= 0) & wanted[np.maximum(self.leaf, 0)])))
        asked = asked[self.last + 1] - asked[:-1] > 0
        nodes, overlap = np.flatnonzero(asked[:1]), np.zeros(1, np.int64)
        while len(nodes):
            overlap = overlap[:len(nodes)]
            lengths = self.length[nodes]
            ends = np.cumsum(lengths)
            run = self.tokens[np.arange(int(ends[-1])) + np.repeat(self.begin[nodes] - (ends - lengths), lengths)]
            held = np.concatenate(([0], np.cumsum(self.held[run])))
            overlap = overlap + held[ends] - held[ends - lengths]
            passed = np.where(lengths > 0, np.searchsorted(probe, self.end_token[nodes], "right"), 0)
            leaf = self.leaf[nodes]
            whole = leaf >= 0
            if whole.any():
                o = overlap[whole]
                found.append(leaf[whole][100 * o >= percent * (n + self.sizes[leaf[whole]] - o)])
            most = overlap + np.minimum(self.high[nodes] - self.depth[nodes], n - passed)
            go = (100 + percent) * most >= percent * (n + self.low[nodes])
            nodes, overlap = nodes[go], overlap[go]
            counts = self.first[nodes + 1] - self.first[nodes]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            overlap = np.repeat(overlap, counts)
            nodes = self.child[np.arange(total) + np.repeat(self.first[nodes] - (ends - counts), counts)] if total else nodes[:0]
            keep = asked[nodes]
            nodes, overlap = nodes[keep], overlap[keep]
        self.held[at] = False
        found = np.concatenate(found) if found else np.zeros(0, np.int64)
        return found[wanted[found]]


def as_tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def block_links(rows: pa.Table, percent: int, decode: Callable[[bytes], np.ndarray] = as_tokens) -> pa.Table:
    """Links inside a task's one block or between its two, as many as connect what is connected. Sets that a label or earlier links
    connect already are not compared."""
    ids, side, label = rows.column("node").to_numpy(), rows.column("side").to_numpy(), rows.column("label").to_numpy()
    sets = [decode(x) for x in rows.column("tokens").to_pylist()]
    _, label = np.unique(label, return_inverse=True)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    tree, probes = (left, right) if len(left) and len(right) else (np.arange(len(ids)),) * 2
    trie, out = Trie([sets[i] for i in tree]), []
    for p in probes:
        for q in trie.similar(sets[p], percent, label[tree] != label[p]):
            if label[tree[q]] != label[p]:
                out.append((int(ids[p]), int(ids[tree[q]])))
                label[label == label[tree[q]]] = label[p]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def by_task(compare: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`compare` for every task of a partition that is sorted by its column `task`; one task at a time is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), batch.num_rows]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if held and current != task[a]:
                    out.append(compare(pa.Table.from_batches(held).combine_chunks()))
                    held = []
                current = task[a]
                held.append(batch.slice(a, b - a))
            yield from (r for t in out for r in t.to_batches())
        if held:
            yield from compare(pa.Table.from_batches(held).combine_chunks()).to_batches()
    return run


def linked(candidates: DataFrame, sets: DataFrame, percent: int, decode: Callable[[bytes], np.ndarray] = as_tokens, block: int = BLOCK, *,
           compare: Callable[[pa.Table, int], pa.Table] | None = None) -> DataFrame:
    """node, label: components of all links of at least `percent` between sets that candidates connect.

    candidates: a, b; pairs that stand for groups: every two nodes that candidates connect, over however many steps, are
    compared. sets: node, n, tokens of at least those nodes; `decode` makes of tokens the set's ascending 64-bit numbers, by
    default its own bytes; `compare` finds the links of a task's blocks, by default in prefix trees. A cluster of any size is cut
    into blocks by size class and digest; a task compares one block or two; blocks of sizes too far apart are not compared.

    Clusters of several blocks take two more steps. First every block meets the first of its size class, and that the next class's: in
    a group of copies this connects nearly all. Then all sets outside the cluster's largest component meet all sets, so sets that are
    connected anyway, however many, are not compared in pairs."""
    cluster = written(components(candidates).join(sets.select("node", "n"), "node").withColumnRenamed("label", "cluster"), "clusters")
    members = cluster.groupBy("cluster").agg(F.count("*").alias("members"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    sized = cluster.join(members, "cluster").withColumn("class", F.when(F.col("members") <= block, F.lit(0)).otherwise(size))

    def cut(rows: DataFrame, keys: list[str]) -> DataFrame:
        parts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
        return rows.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))

    def compared(sent: DataFrame) -> DataFrame:
        full = sent.join(sets.select("node", "tokens"), "node").select("task", "side", "node", "label", "tokens")
        run = by_task(lambda rows: compare(rows, percent) if compare else block_links(rows, percent, decode))
        n = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return written(full.repartition(n, "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long"), "set-links")

    def between(placed: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
        """Two blocks a task; pairs has the keys of one block with suffix 1 and of the other with 2."""
        task = F.xxhash64("cluster", *[f"{k}{i}" for k in keys for i in (1, 2)])
        here = pairs.select(task.alias("task"), F.lit(0).alias("side"), "cluster", *[F.col(f"{k}1").alias(k) for k in keys])
        other = F.lit(False)
        for k in keys:
            other = other | (F.col(f"{k}1") != F.col(f"{k}2"))
        there = pairs.where(other).select(task.alias("task"), F.lit(1).alias("side"), "cluster", *[F.col(f"{k}2").alias(k) for k in keys])
        return compared(here.union(there).join(placed, ["cluster", *keys]).select("task", "side", "node", "label"))

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        return rows.drop("label").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))

    placed = written(cut(sized, ["cluster", "class"]), "blocks")
    links = compared(placed.select(F.xxhash64("cluster", "class", "part").alias("task"), F.lit(0).alias("side"), "node", F.col("node").alias("label")))
    large = placed.where(F.col("members") > block)
    if large.head(1):
        large = written(labelled(large, links), "large")
        blocks = large.select("cluster", "class", "part").distinct()
        star = blocks.where("part > 0").select("cluster", F.col("class").alias("class1"), F.lit(0).alias("part1"), F.col("class").alias("class2"), F.col("part").alias("part2"))
        step = blocks.where("part = 0").select("cluster", F.col("class").alias("class1"), F.lit(0).alias("part1"), (F.col("class") - 1).alias("class2"), F.lit(0).alias("part2"))
        links = written(links.union(between(large, star.union(step), ["class", "part"])), "links-so-far")
        again = labelled(large.select("cluster", "node", "class"), links)
        counts = again.groupBy("cluster", "label").agg(F.count("*").alias("c"))
        main = counts.groupBy("cluster").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
        again = written(cut(again.join(main, "cluster").withColumn("other", (F.col("label") != F.col("main")).cast("int")), ["cluster", "class", "other"]), "large-again")
        blocks = again.select("cluster", "class", "other", "part").distinct()
        one = blocks.select("cluster", F.col("class").alias("class1"), F.col("other").alias("other1"), F.col("part").alias("part1"), F.explode(F.array(F.col("class"), F.col("class") - 1)).alias("class2"))
        two = blocks.select("cluster", F.col("class").alias("class2"), F.col("other").alias("other2"), F.col("part").alias("part2"))
        pairs = one.join(two, ["cluster", "class2"]).where("other1 + other2 > 0 AND (class1 > class2 OR other1 > other2 OR (other1 = other2 AND part1 >= part2))")
        links = links.union(between(again, pairs, ["class", "other", "part"]))
    return components(links)
