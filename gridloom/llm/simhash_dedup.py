"""SimHash near-duplicates: fingerprints, and a self-join of them by a traversal of binary tries.

Fingerprints: A-Z go to lower case, words are split at ASCII white space, and shingles are three words, repeats
included, joined by spaces (fewer words: all of them; none: fingerprint zero, which links like any other). A bit is
set if it is set in over half of the shingles' XXH64 (seed 42).

Links: fingerprints with at most RADIUS differing bits, found by a self-join of the binary trie over all distinct
fingerprints. Pairs of nodes are taken down together from the pair (root, root), differing bits are added up, and a
pair goes no further if its sum is over the radius.
1. The top of the trie is a directory made from counts by prefix: nodes with more fingerprints than a task should hold
   are split, one bit at a time and to any depth, so it is as deep as the data are dense.
2. The pairs of its leaves that are left when node pairs are taken down to them are the tasks. A fingerprint goes to the
   pairs of its leaf.
3. A task takes its pair further down, in chunks of bounded size, to pairs of single fingerprints. It also drops a pair
   whose fingerprints are all in one component. This is done with a radius of 0, 1, ... up to RADIUS, so that dense
   groups join up early and their pairs are dropped. Tasks return a forest, not all pairs.

Components: documents with the same fingerprint are one node; forests are joined by components(). A row gets the
smallest doc_id of its component; rows with the same doc_id keep their own fingerprints. Null ids don't count for the
smallest id, and a component of null ids only has a null one. Null text is empty. Empty input gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import documents, materialize, skew_safe_left_join
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Most fingerprints in a leaf of the directory (a task holds two leaves), pairs of nodes that are taken down at a time, bits counted at a time.
LEAF = 4_000_000
CHUNK = 1 << 14
STEP = 12


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    n = max(len(words) - k + 1, 1)
    if n == 1:
        return xxhash.xxh64_intdigest(data, SEED)
    space = [-1, *np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist(), len(data)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[a + 1 : b], SEED) for a, b in zip(space, space[k:])], ">u8")  # noqa: B905
    return _majority(h)


def _majority(h: np.ndarray) -> int:
    ones, raw = np.zeros(64, np.int64), h.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    """As signed longs."""
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


class Forest:
    """Union-find over numbers 0 .. n-1, with whole arrays of links at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            open_ = x != y
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            hi, lo = np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_])
            np.minimum.at(root, hi, lo)
            while not np.array_equal(up := root[root], root):
                root[:] = up


class Trie:
    """Pairs of nodes of the binary trie over sorted distinct fingerprints; a node is a range of them.

    visited and leaf_pairs count the pairs of nodes and of single fingerprints that were met.
    """

    def __init__(self, prints: np.ndarray):
        self.prints, self.forest = prints, Forest(len(prints))
        # All have the bits above these in common.
        self.bits = int(prints[0] ^ prints[-1]).bit_length() if len(prints) else 0
        self.visited = self.leaf_pairs = 0
        self._note()

    def _note(self) -> None:
        root = self.forest.root
        self.change = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])

    def join(self, a: tuple[int, int], b: tuple[int, int], radius: int) -> None:
        """Link what is within the radius between two nodes (or in one, if they are the same)."""
        for r in range(1, radius + 1):
            stack = [(self.bits - 1, np.array([[*a, *b, 0]], np.int64).T)]
            while stack:
                bit, pairs = stack.pop()
                below = self._leaves(pairs, r)
                if bit < 0 or not below.shape[1]:
                    continue
                below = self._down(below, bit, r)
                stack += [(bit - 1, below[:, at : at + CHUNK]) for at in range(0, below.shape[1], CHUNK)]

    def _leaves(self, pairs: np.ndarray, radius: int) -> np.ndarray:
        """Settle the pairs of single fingerprints, whose path is all of their bits; returns the others that are not in one component."""
        self.visited += pairs.shape[1]
        a0, a1, b0, b1, _ = pairs
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            self.leaf_pairs += len(i)
            near = np.bitwise_count(self.prints[i] ^ self.prints[j]) <= radius
            near &= self.forest.root[i] != self.forest.root[j]
            if near.any():
                self.forest.link(i[near], j[near])
                self._note()
            pairs = pairs[:, ~single]
        a0, a1, b0, b1, _ = pairs
        root, change = self.forest.root, self.change
        one = (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (root[a0] == root[b0])
        return pairs[:, ~one]

    def _down(self, pairs: np.ndarray, bit: int, radius: int) -> np.ndarray:
        a0, a1, b0, b1, err = pairs
        am, bm, own = self._split(a0, a1, bit), self._split(b0, b1, bit), a0 == b0
        down = np.concatenate([[a0, am, b0, bm, err], [am, a1, bm, b1, err], [a0, am, bm, b1, err + 1], [am, a1, b0, bm, err + 1]], axis=1)
        ok = (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= radius)
        ok &= (down[0] != down[2]) | (down[1] - down[0] > 1)
        ok[3 * len(own) :] &= ~own
        return down[:, ok]

    def _split(self, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
        """The first of lo .. hi-1 that has the bit set; the bits above are equal there."""
        first = (self.prints[lo] >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)
        return np.clip(np.searchsorted(self.prints, first), lo, hi)


def _counts(prints: DataFrame, prefixes: list[int], depth: int, upto: int) -> dict[int, int]:
    """Distinct fingerprints by their first `upto` bits, of those whose first `depth` bits are one of the prefixes."""
    bits = lambda n: F.shiftrightunsigned("p", 64 - n) if n else F.lit(0).cast("bigint")
    if depth:
        wanted = prints.sparkSession.createDataFrame([(_signed(x),) for x in prefixes], "w bigint")
        prints = prints.join(F.broadcast(wanted), bits(depth) == F.col("w"), "left_semi")
    return {r["x"] % (1 << 64): r["count"] for r in prints.groupBy(bits(upto).alias("x")).count().collect()}


def directory(prints: DataFrame, leaf: int) -> list[tuple[int, int]]:
    """(depth, prefix) of the leaves of the top of the trie, in order: those with at most `leaf` fingerprints, all of them together whole."""
    done, depth, heavy = [], 0, [0]
    while heavy:
        upto = min(depth + STEP, 64)
        counts = _counts(prints, heavy, depth, upto)
        sums = [Counter() for _ in range(depth, upto)] + [Counter(counts)]
        for d in range(upto - 1, depth - 1, -1):
            for x, n in sums[d + 1 - depth].items():
                sums[d - depth][x >> 1] += n
        for d in range(depth, upto):
            done += [(d, x) for x in heavy if sums[d - depth][x] <= leaf]
            heavy = [y for x in heavy if sums[d - depth][x] > leaf for y in (2 * x, 2 * x + 1)]
        depth = upto
        if depth == 64:
            done += [(64, x) for x in heavy]
            break
    return sorted(done, key=lambda n: n[1] << (64 - n[0]))


def leaf_pairs(leaves: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """The pairs of leaves (by number, the first not after the second) that may hold fingerprints within the radius."""
    starts = [x << (64 - d) for d, x in leaves]
    find = lambda lo, hi, d, x: (bisect_left(starts, x << (64 - d), lo, hi), bisect_left(starts, (x + 1) << (64 - d), lo, hi))
    found, open_ = [], [(0, len(leaves), 0, 0, 0, len(leaves), 0, 0, 0)]
    while open_:
        a0, a1, da, xa, b0, b1, db, xb, err = open_.pop()
        if a1 - a0 == 1 and b1 - b0 == 1:
            (da, xa), (db, xb) = leaves[a0], leaves[b0]
            same = min(da, db)
            if (xa >> (da - same) ^ xb >> (db - same)).bit_count() <= radius:
                found.append((a0, b0))
            continue
        # A node that is a leaf already stays as it is, at the depth of the other's children.
        halves = lambda lo, hi, d, x: [(*find(lo, hi, d + 1, y), d + 1, y) for y in (2 * x, 2 * x + 1)] if hi - lo > 1 else [(lo, hi, d, x)]
        for i, a in enumerate(halves(a0, a1, da, xa)):
            for j, b in enumerate(halves(b0, b1, db, xb)):
                if (a0, a1) == (b0, b1) and j < i or a[0] == a[1] or b[0] == b[1]:
                    continue
                same = min(a[2], b[2])
                if (more := (a[3] >> (a[2] - same) ^ b[3] >> (b[2] - same)).bit_count()) <= radius:
                    open_.append((*a, *b, more))
    return sorted(found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def leaf_size(n: int) -> int:
    """Fingerprints of a leaf of the directory. Below LEAF there are about as many leaves, and so copies of a fingerprint, at any size."""
    return max(1, min(n // 24, LEAF))


def links(prints: DataFrame, radius: int = RADIUS, leaf: int | None = None) -> DataFrame:
    """prints: distinct longs `p`. Edges a, b that connect all within the radius."""
    leaves = directory(prints, leaf or leaf_size(prints.count()))
    pairs = np.array(leaf_pairs(leaves, radius), np.int64)
    # For each leaf, its pairs; a pair of two leaves is in the list of both.
    of = np.concatenate([np.stack([pairs[:, 0], np.arange(len(pairs))]), np.stack([pairs[:, 1], np.arange(len(pairs))])[:, pairs[:, 0] != pairs[:, 1]]], axis=1)
    of = of[:, np.argsort(of[0], kind="stable")]
    starts = np.array([x << (64 - d) for d, x in leaves], np.uint64)
    held = prints.sparkSession.sparkContext.broadcast((starts, of[1], np.searchsorted(of[0], np.arange(len(leaves) + 1)), pairs))

    def deal(batches):
        starts, pair, first, _ = held.value
        for batch in batches:
            p = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(p), 4096):
                part = p[at : at + 4096]
                own = np.searchsorted(starts, part, "right") - 1
                n = first[own + 1] - first[own]
                take = np.arange(n.sum()) + np.repeat(first[own] - (np.cumsum(n) - n), n)
                yield pa.RecordBatch.from_arrays([pa.array(pair[take]), pa.array(np.repeat(part, n).view(np.int64))], names=["pair", "p"])

    dealt = prints.select("p").mapInArrow(deal, "pair bigint, p bigint")
    # The work of a pair is not in proportion to its bytes, so tasks are not put together by size.
    tasks = max(1, min(len(pairs), max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(pairs) // 64)))
    dealt = dealt.repartition(tasks, "pair").sortWithinPartitions("pair")

    def join(batches):
        starts, _, _, pairs = held.value
        for pair, p in _whole(batches):
            a, b = pairs[pair]
            yield from _edges(np.sort(p.view(np.uint64)), starts, a, b, radius)

    return dealt.mapInArrow(join, "a bigint, b bigint").distinct()


def _whole(batches):
    """(pair, its fingerprints) of rows that are sorted by pair."""
    last, held = None, []
    for batch in batches:
        pair, p = (batch.column(i).to_numpy() for i in range(2))
        cuts = np.flatnonzero(np.diff(pair)) + 1
        for q, part in zip(pair[np.append(0, cuts)].tolist() if len(pair) else [], np.split(p, cuts), strict=False):
            if q != last and held:
                yield last, np.concatenate(held)
                held = []
            last = q
            held.append(part)
    if held:
        yield last, np.concatenate(held)


def _edges(p: np.ndarray, starts: np.ndarray, a: int, b: int, radius: int):
    trie = Trie(p)
    if a == b:
        trie.join((0, len(p)), (0, len(p)), radius)
    else:
        cut = int(np.searchsorted(p, starts[b]))
        if not 0 < cut < len(p):
            return
        trie.join((0, cut), (cut, len(p)), radius)
    root = trie.forest.root
    linked = np.flatnonzero(root != np.arange(len(p)))
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(p[linked].view(np.int64)), pa.array(p[root[linked]].view(np.int64))], names=["a", "b"])


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that can be reached)."""
    own = docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("p"))
    own = materialize(own, "fingerprints")
    total = own.count()
    nodes = materialize(own.groupBy("p").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "prints")
    roots = components(links(nodes.select("p"), radius))
    rooted = nodes.join(roots, nodes["p"] == roots["node"], "left").select("p", "least", "rows", F.coalesce("root", "p").alias("root"))
    rooted = materialize(rooted, "rooted")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    by_print = skew_safe_left_join(rooted.select("p", "rows", "root"), of_root, ["root"], "size", total)
    by_print = materialize(by_print.select("p", "rows", "component_id"), "by-print")
    found = skew_safe_left_join(own, by_print, ["p"], "rows", total)
    return found.select("doc_id", F.lpad(F.lower(F.hex("p")), 16, "0").alias("fingerprint"), "component_id")


def query(spark, sf_dir):
    return simhash_dedup(documents(spark, sf_dir))
