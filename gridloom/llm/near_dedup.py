"""Near-duplicates by exact similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are those of simhash_dedup: A-Z go to lower case, split at ASCII white space. A shingle is SHINGLE words joined by
spaces (fewer words: all of them; none: one empty shingle), held as its XXH64, so equality is that of 64-bit hashes.

Candidates come from two searches, and all are verified on whole sets:
1. The SimHash trie of simhash_dedup, over the fingerprints of the sets: near copies, a few bits apart, also in dense groups.
2. An exact join for what is further apart: at 0.8 about 10 of 64 bits differ, beyond what a trie can search. In an order
   of shingles that all sets share, two sets that are similar enough have a shingle in common among the first
   n - ceil(SIMILARITY * n) + 1 of each (prefix filter), the smaller has at least SIMILARITY times the shingles of the
   larger (length filter), and from the first common shingle on, both have as many left as they need in common (positional
   filter; it holds for the first one, and that is among those where the pair is met). Shingles are in the order of their hashes, but those that over HOT sets have in their prefixes
   go last; any order gives the same result, this one keeps groups small.

Candidates are sieved by parities: each set has a bit for each of 2**m >= n buckets of hashes, set if it has an odd number
of shingles there. Two sets differ in at least as many shingles as bits, so this loses none. The rest is verified on whole sets.

Equal sets are one node. In each group of sets with a shingle in common, first sets next to each other by size are
compared, then each with a few of the group: a number of pairs in proportion to the group, which joins up what is
dense. What is not connected then is compared whole, in the task of the group, and only pairs that parities leave go out.

A row gets the smallest id of its component. Null text is empty. Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_ROWS, discard, materialize, skew_safe_left_join, small
from .components import components
from .simhash_dedup import RADIUS, SEED, _majority, links

SHINGLE = 5
SIMILARITY = 0.8
HOT = 32
#: Pairs that a task makes at a time; texts and sets that it holds at a time.
_PAIRS = 1 << 18
#: Sets of a group that each set of it is compared with, before the groups that are left are searched whole.
PIVOTS = 16
#: Buckets for each shingle in the parities of sets that are searched whole: what these leave is hardly more than what is similar.
_FINE = 8
#: Most rows of a table that is broadcast here, where many joins follow each other.
_SMALL = 100_000
_SLICE = 256


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    words = (text or "").encode().lower().split()
    data = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(data, SEED)], np.uint64)
    space = [-1, *np.flatnonzero(np.frombuffer(data, np.uint8) == 32).tolist(), len(data)]
    return np.unique(np.array([digest(data[a + 1 : b], SEED) for a, b in zip(space, space[k:])], np.uint64))  # noqa: B905


def need(n, similarity: float):
    """The fewest shingles that a similar set has in common with one of n."""
    return np.ceil(similarity * n - 1e-9).astype(np.int64)


def parities(s: np.ndarray, fine: int = 1) -> bytes:
    """A bit for each bucket of hashes: whether it has an odd number of them. There are at least `fine` times as many buckets as hashes."""
    size = max(8, 1 << (fine * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fewest_different(x: bytes, y: bytes) -> int:
    """How many shingles at least are in one of two sets with these parities."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(c.reshape(-1, size), axis=0) for c in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def prefix_size(n: int, similarity: float) -> int:
    return n - int(need(n, similarity)) + 1


def _sets(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """docs: id, text. id, p (hash of the set), n, f (its SimHash), odd (its parities), low (bytes of the prefix of its sorted hashes)."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                found = [shingle_set(t.as_py(), k) for t in part.column(1)]
                p = np.array([_name(s) for s in found], np.int64)
                f = np.array([_majority(s.astype(">u8")) for s in found], np.uint64).view(np.int64)
                low = [s[: prefix_size(len(s), similarity)].tobytes() for s in found]
                columns = [pa.array(p), pa.array([len(s) for s in found], pa.int64()), pa.array(f), pa.array([parities(s) for s in found], pa.binary()), pa.array(low, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "p", "n", "f", "odd", "low"])

    return docs.mapInArrow(run, StructType([docs.schema["id"], *StructType.fromDDL("p bigint, n bigint, f bigint, odd binary, low binary")]))


def _name(s: np.ndarray) -> int:
    p = xxhash.xxh64_intdigest(s.tobytes(), SEED)
    return p - (1 << 64) if p >> 63 else p


def _rows(found, seen: set):
    """h, n (and the place of h, as n << 32 | place), p of the prefixes (p, n, hashes) of sets that haven't been seen."""
    h, n, p = [], [], []
    for name, size, prefix in found:
        if name not in seen:
            seen.add(name)
            h.append(prefix)
            n.append((size << 32) + np.arange(len(prefix)))
            p.append(np.full(len(prefix), name))
    if h:
        h, n, p = (np.concatenate(c) for c in (h, n, p))
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(p)], names=["h", "n", "p"])


def _prefixes(sets: DataFrame) -> DataFrame:
    """h, n, p: the prefix of each set in the order of hashes. Copies in a batch go out once."""

    def run(batches):
        for batch in batches:
            seen: set = set()
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                yield from _rows(((p, n, np.frombuffer(low, np.uint64)) for p, n, low in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)), seen)

    return sets.select("p", "n", "low").mapInArrow(run, "h bigint, n bigint, p bigint")


def _prefixes_again(docs: DataFrame, similarity: float, k: int, late: np.ndarray) -> DataFrame:
    """h, n, p: the prefix of each set in the order of hashes, but with the late ones at the end."""
    held = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches):
        last = held.value

        def reordered(s):
            at_end = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
            return np.concatenate([s[~at_end], s[at_end]])[: prefix_size(len(s), similarity)]

        for batch in batches:
            seen: set = set()
            for at in range(0, len(batch), _SLICE):
                found = [shingle_set(t.as_py(), k) for t in batch.column(0).slice(at, _SLICE)]
                yield from _rows(((_name(s), len(s), reordered(s)) for s in found), seen)

    return docs.select("text").mapInArrow(run, "h bigint, n bigint, p bigint")


def _grouped(rows: DataFrame, work, kinds: str, at_once: int = 1 << 18) -> DataFrame:
    """work() on whole groups of rows with the same h, the first column, about at_once rows at a time; rows are sorted by their columns."""
    names = rows.columns

    def run(batches):
        held: list = []
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))])
            # A batch is done at a time, but for its last group, which may go on.
            if sum(len(x[0]) for x in held) >= at_once:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                end = int(np.searchsorted(cols[0], cols[0][-1]))
                held = [[x[end:] for x in cols]]
                if end:
                    yield from work(*(x[:end] for x in cols))
        if held:
            yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.repartition("h").sortWithinPartitions(*names[:3]).mapInArrow(run, kinds)


def _shared(h, n, p):
    """The rows of groups of two sets or more, once each, and c: how many sets are in the group."""
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (p[1:] != p[:-1])])
    h, n, p = h[new], n[new], p[new]
    _, group, sizes = np.unique(h, return_inverse=True, return_counts=True)
    c = sizes[group]
    if (c > 1).any():
        yield pa.RecordBatch.from_arrays([pa.array(x[c > 1]) for x in (h, n, p, c)], names=["h", "n", "p", "c"])


def _room(k, n, similarity: float):
    """The largest size of a set that may be similar to one of n shingles, of which k are left; they need (n + m) * similarity / (1 + similarity) in common."""
    return np.floor(k * (1 + similarity) / similarity - n + 1e-9).astype(np.int64)


def _emit(a, b):
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    if both.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])


def _some_pairs(similarity: float, seed: int | None):
    """Sets of different roots r in a group that may be similar by their sizes and by where they have the shingle.

    seed None: those next to each other by size. Else: each with PIVOTS of its group, chosen by the seed; so all pairs of a
    group of up to PIVOTS + 1 sets, and a number in proportion to its size of any other.
    """

    def work(h, packed, p, r):
        n = packed >> 32
        most = np.minimum(_room(n - (packed & 0xFFFFFFFF), n, similarity), (n / similarity + 1e-9).astype(np.int64))
        _, group, sizes = np.unique(h, return_inverse=True, return_counts=True)
        if seed is None:
            take = np.zeros((len(h), 1), np.int64) + np.minimum(np.arange(len(h)) + 1, len(h) - 1)[:, None]
        else:
            chance = (p.view(np.uint64) ^ np.uint64(seed + 1)) * np.uint64(0x9E3779B97F4A7C15)
            order = np.lexsort((chance ^ chance >> np.uint64(29), group))
            first = np.cumsum(sizes) - sizes
            own = np.minimum(np.arange(PIVOTS + 1)[None, :], sizes[:, None] - 1) + first[:, None]
            take = order[own][group]
        for at in range(0, len(h), _PAIRS // (PIVOTS + 1)):
            j = take[at : at + _PAIRS // (PIVOTS + 1)]
            i = np.repeat(np.arange(at, at + len(j)), j.shape[1])
            j = j.ravel()
            ok = (group[i] == group[j]) & (r[i] != r[j])
            i, j = i[ok], j[ok]
            i, j = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
            ok = (n[j] <= most[i]) & (n[i] <= most[j])
            yield from _emit(p[i[ok]], p[j[ok]])

    return work


def _all_pairs(similarity: float):
    """The same for all sets of a group, sieved by their parities in the task, so that only what may be similar goes out."""

    def work(h, packed, p, r, odd):
        n = packed >> 32
        most = np.minimum(_room(n - (packed & 0xFFFFFFFF), n, similarity), (n / similarity + 1e-9).astype(np.int64))
        _, group = np.unique(h, return_inverse=True)
        width = np.array([len(x) for x in odd])
        # Rows of each width as a table, and folded to half of it: sets that may be similar differ by a factor of two at most.
        tables = {w: np.frombuffer(b"".join(odd[width == w]), np.uint8).reshape(-1, w) for w in np.unique(width).tolist()}
        at = np.zeros(len(h), np.int64)
        for w in tables:
            at[width == w] = np.arange(len(tables[w]))
        place = group * (1 << 32)
        end = np.searchsorted(place + n, place + most, "right")
        size = np.maximum(end - np.arange(len(h)) - 1, 0)
        upto, done = np.cumsum(size), 0
        while done < len(h):
            step = max(1, (1 << 24) // int(width[done:].max()))
            stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + min(step, _PAIRS), "right")))
            own = size[done:stop]
            i = np.repeat(np.arange(done, stop), own)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
            far = (r[i] != r[j]) & (n[i] <= most[j])
            i, j = i[far], j[far]
            for w, table in tables.items():
                for wide in (w, 2 * w):
                    of = (width[i] == w) & (width[j] == wide)
                    if of.any():
                        a, b = i[of], j[of]
                        y = tables[wide][at[b]]
                        y = y if wide == w else y[:, :w] ^ y[:, w:]
                        differ = np.bitwise_count(table[at[a]] ^ y).sum(1)
                        may = differ <= (n[a] + n[b]) * (1 - similarity) / (1 + similarity) + 1e-9
                        yield from _emit(p[a[may]], p[b[may]])
            done = stop

    return work


def _beside(pairs: DataFrame, of_set: DataFrame) -> DataFrame:
    """a, b, the column of a's set, that of b's. of_set: p and one column, once for each set."""
    name = of_set.columns[1]
    return pairs.join(of_set.toDF("a", f"{name}_a"), "a").join(of_set.toDF("b", f"{name}_b"), "b").select("a", "b", f"{name}_a", f"{name}_b")


def _where(pairs: DataFrame, holds) -> DataFrame:
    def run(batches):
        for batch in batches:
            ok = [holds(*(v.as_py() for v in row)) for row in zip(*batch.columns[2:], strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _of_texts(docs: DataFrame, ids: DataFrame, made, k: int) -> DataFrame:
    """p and hs, what is made of each set of ids (p, id), from the texts again."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), _SLICE):
                part = batch.slice(at, _SLICE)
                found = [(p, made(s)) for p, t in zip(part.column(0).to_pylist(), part.column(1), strict=True) if _name(s := shingle_set(t.as_py(), k)) == p]  # not another text with this id
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())], names=["p", "hs"])

    ids = materialize(ids, "set-ids")
    return docs.join(small(ids, _SMALL), "id").select("p", "text").mapInArrow(run, "p bigint, hs binary").dropDuplicates(["p"])


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, similarity: float, k: int) -> DataFrame:
    """The pairs whose sets are similar. Whole sets are made again, from the texts of those that parities leave."""

    def may_be(x, y):
        return fewest_different(x["odd"], y["odd"]) <= (x["n"] + y["n"]) * (1 - similarity) / (1 + similarity) + 1e-9

    def is_similar(x, y):
        s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = len(np.intersect1d(s, t, assume_unique=True))
        return common >= similarity * (len(s) + len(t) - common) - 1e-9

    def of_pairs(pairs: DataFrame) -> DataFrame:
        """p and an id of each set in the pairs."""
        nodes = materialize(pairs.select(F.col("a").alias("p")).union(pairs.select("b")).distinct(), "pair-nodes")
        return materialize(sets.join(small(nodes, _SMALL), "p", "left_semi").groupBy("p").agg(F.min("id").alias("id")), "pair-ids")

    pairs = materialize(pairs.distinct(), "pairs")
    ids = of_pairs(pairs)
    parity = sets.select("p", "id", F.struct("n", "odd").alias("odd")).join(ids, ["p", "id"], "left_semi").dropDuplicates(["p"]).select("p", "odd")
    pairs = materialize(_where(_beside(pairs, parity), may_be), "sieved-pairs")
    ids = of_pairs(pairs)
    held = materialize(_of_texts(docs, ids, lambda s: s.tobytes(), k), "pair-sets")
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(_SLICE))  # a batch holds two whole sets a row
    try:
        return materialize(_where(_beside(pairs, held), is_similar), "similar-pairs")
    finally:
        conf.set(name, before)


def trie_pairs(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a, b of sets whose SimHashes the trie connects, each with the first set of a fingerprint."""
    own = materialize(sets.select("p", "f").distinct(), "set-prints")
    first = materialize(own.groupBy("f").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("c")), "print-firsts")
    same = skew_safe_left_join(own, first, ["f"], "c", own.count()).where("p <> first").select(F.least("p", "first").alias("a"), F.greatest("p", "first").alias("b"))
    of = lambda c: first.select(F.col("f").alias(c), F.col("first").alias(f"{c}_first"))
    near = links(first.select(F.col("f").alias("p")), radius).join(of("a"), "a").join(of("b"), "b")
    return same.union(near.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b")))


def similar_pairs(docs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, hot: int = HOT, k: int = SHINGLE) -> DataFrame:
    """Pairs a, b of similar sets that connect all that similar pairs connect. docs: id, text; sets: those of _sets."""
    kinds = "h bigint, n bigint, p bigint, c bigint"
    shared = materialize(_grouped(_prefixes(sets), _shared, kinds), "shared")
    over = shared.where(F.col("c") > hot).groupBy("h").agg(F.max("c").alias("c")).orderBy(F.desc("c"), "h").limit(BROADCAST_ROWS)
    late = np.sort(over.select("h").toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64))
    if len(late):
        old, shared = shared, materialize(_grouped(_prefixes_again(docs, similarity, k, late), _shared, kinds), "shared")
        discard(old)
    kinds = "a bigint, b bigint"
    beside = _grouped(shared.select("h", "n", "p", F.col("p").alias("r")), _some_pairs(similarity, None), kinds)
    near = _verified(trie_pairs(sets).union(beside), docs, sets, similarity, k)

    def rooted(rows: DataFrame) -> DataFrame:
        roots = materialize(components(near), "roots").toDF("p", "r")
        return rows.join(small(roots, _SMALL), "p", "left").select("h", "n", "p", F.coalesce("r", "p").alias("r"))

    # All pairs of small groups; in large ones this joins up what is dense.
    near = near.union(_verified(_grouped(rooted(shared), _some_pairs(similarity, 0), kinds), docs, sets, similarity, k))
    large = shared.where(F.col("c") > PIVOTS + 1)
    if large.isEmpty():
        return near
    rest = rooted(large)
    open_ = materialize(rest.groupBy("h").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("h"), "open-groups")
    rest = rest.join(small(open_, _SMALL), "h", "left_semi")
    names = materialize(rest.select("p").distinct(), "open-sets")
    ids = sets.join(small(names, _SMALL), "p", "left_semi").groupBy("p").agg(F.min("id").alias("id"))
    odd = materialize(_of_texts(docs, ids, lambda s: parities(s, _FINE), k), "open-parities").withColumnRenamed("hs", "odd")
    rest = rest.join(odd, "p").select("h", "n", "p", "r", "odd")
    return near.union(_verified(_grouped(rest, _all_pairs(similarity), kinds, 1 << 13), docs, sets, similarity, k))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, component_id (smallest doc_id that can be reached by pairs that are similar)."""
    # In a struct, null ids are equal to each other, so their rows are found again too.
    docs = docs.select(F.struct(F.col(id_col).alias("doc_id")).alias("id"), F.col(text_col).alias("text"))
    sets = materialize(_sets(docs, similarity, shingle), "sets")
    own = sets.select("id.doc_id", "p")
    total = own.count()
    nodes = materialize(own.groupBy("p").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "set-nodes")
    roots = components(similar_pairs(docs, sets, similarity, hot, shingle))
    rooted = nodes.join(roots, nodes["p"] == roots["node"], "left").select("p", "least", "rows", F.coalesce("root", "p").alias("root"))
    rooted = materialize(rooted, "rooted-sets")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size"))
    by_set = skew_safe_left_join(rooted.select("p", "rows", "root"), of_root, ["root"], "size", total)
    by_set = materialize(by_set.select("p", "rows", "component_id"), "by-set")
    return skew_safe_left_join(own, by_set, ["p"], "rows", total).select("doc_id", "component_id")
