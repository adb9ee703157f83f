"""Benchmark decontamination: which documents hold a benchmark item.

A window of a document as long as an item, in words, matches it if the weighted similarity of their five-word shingles
(sum of the smaller over sum of the larger counts) is 0.8 or more. Items of under five words have one shingle, all of
their words. A text shorter than the item is one window, all of its words; its shingles are as long as the item's.

1. Windows: a window that matches an item of its size has most of the item's shingles. So windows of a size are made
   only where enough shingles stand together that any item of this size has. This loses none.
2. The SimHash of each window is looked up in a multi-index over the SimHashes of all items of its size. Their 64 bits
   are cut into BLOCKS blocks. If at most RADIUS bits differ, then in one block at least no more than its share differs
   (5, 4, 4 and 4 bits of 16), so the buckets that near finds hold all items within the radius. The index finds the items;
   nothing else does.
3. The exact similarity of the window and each item found decides.

Windows with a similarity of 0.8 differ in about 10 bits on average; RADIUS is chosen to hold practically all of them
(tests measure the recall).

Items are a stated query set. They are cut into blocks of at most `block_bytes` of text. Each block is broadcast in a
job of its own against all documents, so what a worker holds is bounded whatever the size of the benchmark.

Null texts and items have no words and match nothing. Null ids stay null. Repeated rows and items have results of
their own. Of several windows the most similar one is reported, then the first. Empty input gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize
from .words import RunHashes, words_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 4
BLOCK_BYTES = 16 << 20
_CHUNK = 1 << 20
_LEAK = "array<struct<item_id:bigint,similarity:double,first_word:bigint,n_words:bigint>>"


def shingles(words: list[bytes], k: int) -> Counter:
    return Counter(b" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity."""
    both = sum((a & b).values())
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 0.0


def simhash(counts: Counter) -> int:
    """The bits set in over half the weight of the shingles' hashes."""
    if not counts:
        return 0
    h = np.array([xxhash.xxh64_intdigest(s) for s in counts], ">u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    over = 2 * (bits * np.array(list(counts.values()))[:, None]).sum(0) > sum(counts.values())
    return int.from_bytes(np.packbits(over).tobytes(), "big")


class MultiIndex:
    """Fingerprints in buckets by each of their blocks of bits. probes and candidates count lookups and what they found before the exact distance."""

    def __init__(self, prints: list[int], radius: int, blocks: int = BLOCKS):
        self.prints, self.radius = np.array(prints, np.uint64), radius
        self.probes = self.candidates = 0
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.blocks = []
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            # With one more error than this in each block, there would be radius + 1 in all.
            share = (radius + 1 - blocks + blocks - 1 - i) // blocks
            codes, bucket = np.unique(self.prints >> np.uint64(lo) & np.uint64((1 << (hi - lo)) - 1), return_inverse=True)
            self.blocks.append((np.uint64(lo), np.uint64((1 << (hi - lo)) - 1), share, codes, np.argsort(bucket, kind="stable"), np.searchsorted(np.sort(bucket), np.arange(len(codes) + 1))))

    def within(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) by number, for all within the radius."""
        found, step = [np.zeros((2, 0), np.int64)], max(1, _CHUNK // max(1, len(self.prints)))
        for at in range(0, len(queries), step):
            part, near = queries[at : at + step], []
            for lo, mask, share, codes, items, first in self.blocks:
                q, c = np.nonzero(np.bitwise_count((part[:, None] >> lo & mask) ^ codes[None, :]) <= share) if share >= 0 else (np.zeros(0, np.int64),) * 2
                n = first[c + 1] - first[c]
                near.append(np.stack([np.repeat(q, n), items[np.arange(n.sum()) + np.repeat(first[c] - (np.cumsum(n) - n), n)]]))
            q, i = np.unique(np.concatenate(near, axis=1), axis=1)
            self.probes += len(part)
            self.candidates += len(q)
            ok = np.bitwise_count(part[q] ^ self.prints[i]) <= self.radius
            found.append(np.stack([q[ok] + at, i[ok]]))
        return tuple(np.concatenate(found, axis=1))


def window_prints(words: list[bytes], starts: np.ndarray, size: int, k: int) -> np.ndarray:
    """The SimHashes of windows of `size` words."""
    lo, hi, m = int(starts[0]), int(starts[-1]) + size, size - k + 1
    h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + k])) for i in range(lo, hi - k + 1)], ">u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    over = 2 * (sums[starts - lo + m] - sums[starts - lo]) > m
    return np.packbits(over, axis=1).view(">u8").ravel().astype(np.uint64)


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS):
        self.least = least
        words = [(i, words_of(t)) for i, t in items]
        self.ids = [i for i, w in words if w]
        self.words = [w for _, w in words if w]
        self.counts = [shingles(w, min(k, len(w))) for w in self.words]
        #: Items of each size, and their index.
        self.sizes = sorted({len(w) for w in self.words})
        self.of_size = [[j for j, w in enumerate(self.words) if len(w) == size] for size in self.sizes]
        self.index = [MultiIndex([simhash(self.counts[j]) for j in js], radius) for js in self.of_size]
        #: By shingle length: the sorted hashes, a first sieve over their top bits, and the sizes of items that have each hash.
        self.by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({min(k, size) for size in self.sizes}):
            pairs = [np.zeros((2, 0), np.uint64)]
            for z, js in enumerate(self.of_size):
                if min(k, self.sizes[z]) == n:
                    h = np.unique(np.concatenate([RunHashes([self.words[j]]).of(n) for j in js]))
                    pairs.append(np.stack([h, np.full(len(h), z, np.uint64)]))
            both = np.concatenate(pairs, axis=1)
            both = both[:, np.lexsort(both[::-1])]
            keys, first = np.unique(both[0], return_index=True)
            sieve = np.zeros(1 << 20, bool)
            sieve[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by[n] = keys, sieve, both[1].astype(np.int64), np.append(first, both.shape[1])

    def find(self, texts: list[list[bytes]]) -> dict[int, list[tuple[int | None, float, int, int]]]:
        """By number of a text: (item_id, similarity, first word, words) of its matches."""
        runs, out = RunHashes(texts), defaultdict(list)
        for n, (keys, sieve, sizes, first) in self.by.items():
            h = runs.of(n)
            at = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
            key = np.searchsorted(keys, h[at])
            ok = keys[np.minimum(key, len(keys) - 1)] == h[at]
            at, key = at[ok], key[ok]
            many = first[key + 1] - first[key]
            size = sizes[np.arange(many.sum()) + np.repeat(first[key] - (np.cumsum(many) - many), many)]
            text = np.searchsorted(runs.first, at, "right") - 1
            place, text = np.repeat(at - runs.first[text], many), np.repeat(text, many)
            order = np.lexsort((place, size, text))
            place, size, text = place[order], size[order], text[order]
            cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(size) != 0)) + 1
            for lo, hi in zip(np.append(0, cuts).tolist(), np.append(cuts, len(text)).tolist(), strict=True):
                if lo < hi:
                    t = int(text[lo])
                    out[t] += self._matches(texts[t], int(size[lo]), n, place[lo:hi])
        return {t: sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[2])) for t, found in out.items() if found}

    def _matches(self, words: list[bytes], z: int, k: int, places: np.ndarray) -> list[tuple[int | None, float, int, int]]:
        """Matches of items of one size; places: of the shingles that such items have."""
        size = min(self.sizes[z], len(words))
        goal, m = self.sizes[z] - k + 1, size - k + 1
        need = int(np.ceil((m + goal) * self.least / (1 + self.least) - 1e-9))  # of m shingles here and goal there
        if len(places) < need:
            return []
        # Windows that start at s hold the shingles at s .. s + m - 1; enough of them must be such places.
        last = len(words) - size
        a, b = places[: len(places) - need + 1], places[need - 1 :]
        close = b - a < m
        lo, hi = np.maximum(b[close] - m + 1, 0), np.minimum(a[close], last) + 1
        edge = np.zeros(last + 2, np.int64)
        np.add.at(edge, lo, 1)
        np.add.at(edge, np.maximum(hi, lo), -1)
        starts = np.flatnonzero(np.cumsum(edge) > 0)
        if not len(starts):
            return []
        best: dict[int, tuple[float, int]] = {}
        have = (-1, None)
        for w, i in zip(*(x.tolist() for x in self.index[z].within(window_prints(words, starts, size, k))), strict=True):
            s, j = int(starts[w]), self.of_size[z][i]
            if have[0] != s:
                have = s, shingles(words[s : s + size], k)
            if (x := similarity(have[1], self.counts[j])) >= self.least and (j not in best or x > best[j][0]):
                best[j] = x, s
        return [(self.ids[j], x, s, size) for j, (x, s) in best.items()]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """Broadcasts of blocks of items, one after the other."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        yield b + 1 == blocks, benchmark.sparkSession.sparkContext.broadcast([(r["item"], r["text"]) for r in part.collect()])


def _finder(held):
    ready: list[Items] = []

    @F.pandas_udf(_LEAK)
    def leaks(texts: pd.Series) -> pd.Series:
        if not ready:
            ready.append(Items(held.value))
        out: list[list] = [[] for _ in range(len(texts))]
        part, first, size = [], 0, 0
        for i, text in enumerate(texts):
            part.append(words_of(text))
            size += len(text or "")
            if size >= _CHUNK or i + 1 == len(texts):
                for t, found in ready[0].find(part).items():
                    out[first + t] = [dict(zip(("item_id", "similarity", "first_word", "n_words"), x, strict=True)) for x in found]
                part, first, size = [], i + 1, 0
        return pd.Series(out)

    return leaks


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each item in a row of docs: doc_id, item_id, similarity, first_word, n_words."""
    found = None
    for last, held in _blocks(benchmark, item_id, item_text, block_bytes):
        rows = docs.select(F.col(id_col).alias("doc_id"), _finder(held)(F.col(text_col)).alias("leaks"))
        rows = rows.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
        if not last or found is not None:  # a block of several is done before the next one goes out
            rows = materialize(rows, "leaks")
            held.destroy()
        found = rows if found is None else found.union(rows)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no item."""
    for last, held in _blocks(benchmark, item_id, item_text, block_bytes):
        docs = docs.withColumn("__leaks", _finder(held)(F.col(text_col))).where(F.size("__leaks") == 0).drop("__leaks")
        if not last:
            docs = materialize(docs, "without-leaks")
            held.destroy()
    return docs


def query(spark, sf_dir):
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
