"""Removal of repeated byte strings, found on a Burrows-Wheeler transform.

Each byte goes that is covered by a string of LENGTH bytes which also starts earlier: in a row with a smaller doc_id,
in an earlier row with that id, or earlier in the same text. Texts are UTF-8 bytes; matches never cross documents, and
strings are judged on the input, not on what is left.

Equal strings are brought together by their content. A window of LENGTH bytes has a key, the smallest hash of its
GRAM-byte pieces; equal windows have equal keys. Successive windows with one key make a segment.
1. Equal windows have their smallest piece at the same place, so a key with one such piece in the corpus holds no
   repeats. These pieces are counted by key, after a pre-aggregation in each task.
2. Segments with shared keys go to the task of their key; equal segments of a task are sent once, for their earliest
   owner, so a passage in a third of all documents stays small. Segments of hot keys are split by longer pieces around
   the smallest one, so a common piece in many contexts is dealt out over many tasks.
3. A task sorts the suffixes of its segments as far as needed, makes the Burrows-Wheeler transform, and expands
   intervals breadth-first by backward extension. That gives common prefix lengths by increasing value, up to LENGTH - 1;
   where none was found, neighbours share LENGTH bytes. Of each class of equal windows, the earliest is not a repeat.
4. Each document joins its segments with what was found, and the repeats are cut out.

Null text is empty. A null doc_id comes before any other. Of rows with the same doc_id, the one whose text has the
smaller hash comes first (texts of one doc_id are told apart by a 64-bit hash). Rows that are equal in both are rows of
their own: the first has the result, the others are repeats of it. Texts under LENGTH bytes stay as they are. Nothing
depends on how a scan is dealt out. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, documents, materialize, small

LENGTH = 100
GRAM = 32
_BLOCK = 1 << 20
#: Bytes of segments that a task sorts at a time, whole keys at once.
SORT_BYTES = 1 << 18
_NULL = -(1 << 63)
_ROW = ["doc", "row"]


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hashes of the pieces of gram bytes (a power of two), by doubling."""
    h, n, p = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while n < gram:
        h = h[: len(h) - n] * np.uint64(p) + h[n:]
        n, p = 2 * n, p * p % (1 << 64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, n = h, 1
    while 2 * n <= width:
        m, n = np.minimum(m[:-n], m[n:]), 2 * n
    return np.minimum(m[: len(m) - (width - n)], m[width - n :]) if n < width else m


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows) of the segments of a text; a block of windows at a time."""
    keys, starts, counts = [], [], []
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw) - length + 1, _BLOCK):
        m = sliding_min(gram_hashes(raw[at : at + _BLOCK + length - 1], gram), length - gram + 1)
        new = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        keys.append(m[new])
        starts.append(new + at)
        counts.append(np.diff(np.append(new, len(m))))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)


def key_places(data: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The key once for each piece that has it and is the smallest of a window; so windows that repeat within one segment count twice."""
    found, raw, width = [np.zeros(0, np.uint64)], np.frombuffer(data, np.uint8), length - gram + 1
    for at in range(0, len(raw) - length + 1, _BLOCK):
        h = gram_hashes(raw[at : at + _BLOCK + length - 1], gram)
        rim = np.full(width - 1, np.uint64(2**64 - 1))
        # The largest of the minima over a piece, as the smallest of their complements.
        found.append(h[h == ~sliding_min(np.concatenate([rim, ~sliding_min(h, width), rim]), width)])
    return np.concatenate(found)


def split_segment(data: bytes, key: int, start: int, windows: int, length: int = LENGTH, gram: int = GRAM, levels: int = 2) -> list[tuple[int, int, int]]:
    """A segment in parts with narrower keys: (key, first window, windows).

    A window reaches far to the left or far to the right of its smallest piece (the first one, of equals), by half of
    what is free at least. The piece with the bytes there is the next, longer piece, and so on. Equal windows have equal
    pieces at equal places, so they stay together; segments that only share the smallest piece part.
    """
    raw = np.frombuffer(data, np.uint8)[start : start + windows + length - 1]
    places = np.flatnonzero(gram_hashes(raw, gram).view(np.int64) == key)
    at = np.arange(windows)
    lo = places[np.searchsorted(places, at)]
    hi, free = lo + gram, length - gram
    for _ in range(levels):
        half = free // 2
        left = lo - at >= half
        lo, hi, free = np.where(left, lo - half, lo), np.where(left, hi, hi + half), free - half
    new = np.flatnonzero(np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
    counts = np.diff(np.append(new, windows))
    found = []
    for i, n in zip(new.tolist(), counts.tolist(), strict=True):
        piece = xxhash.xxh64_intdigest(raw[lo[i] : hi[i]].tobytes(), key & 0xFFFF)
        found.append((piece - (1 << 64) if piece >> 63 else piece, start + i, n))
    return found


#: Symbols in a packed word.
PACK = 7


def packed_words(s: np.ndarray) -> np.ndarray:
    """The PACK symbols (under 512) from each place on, as one number; zeros follow the end."""
    padded = np.concatenate([s.astype(np.int64), np.zeros(PACK, np.int64)])
    key = np.zeros(len(s), np.int64)
    for i in range(PACK):
        key = key << 9 | padded[i : i + len(s)]
    return key


def suffix_order(key: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes sorted by their first `depth` symbols at least, from their packed words.

    Prefix doubling; after the first round only suffixes that are equal so far are sorted again.
    """
    n, width = len(key), PACK
    order = np.argsort(key)
    new = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    while width < depth:
        tied = np.flatnonzero(~new | ~np.concatenate([new[1:], [True]]))
        if not len(tied):
            break
        at = order[tied]
        after = at + width
        two = rank[at] << 32 | np.where(after < n, rank[np.minimum(after, n - 1)], 0)
        again = np.argsort(two)
        order[tied], two = at[again], two[again]
        new[tied] = np.concatenate([[True], np.diff(two) != 0])
        rank[order[tied]] = np.maximum.accumulate(np.where(new[tied], tied, 0)) + 1
        width *= 2
    return order


def boundaries(bwt: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """For each place in the suffix order, whether it has under `length` symbols in common with the one before.

    Intervals of strings are extended backwards, shortest strings first: a right boundary that is met for the first
    time has as common prefix length the length reached before. A string has the separator 0 at its end only. key: the
    packed words in suffix order, which show the strings of PACK symbols to start with, and all shorter common prefixes.
    """
    n = len(bwt)
    by_symbol = np.argsort(bwt, kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    known = np.concatenate([[True], np.diff(key) != 0, [True]])
    lo = np.flatnonzero(known[:n])
    hi = np.append(lo[1:], n)
    whole = np.ones(len(lo), bool)
    for i in range(1, PACK):
        whole &= (key[lo] >> 9 * i & 511) != 0
    lo, hi = lo[whole], hi[whole]
    for _ in range(PACK, length):
        if not len(lo):
            break
        one = hi - lo == 1
        at = lo[one]
        at = at[bwt[at] != 0]
        first, count = [step[at]], [np.ones(len(at), np.int64)]
        lo, size = lo[~one], (hi - lo)[~one]
        if len(lo):
            which = np.repeat(np.arange(len(lo)), size)
            place = np.arange(len(which)) + np.repeat(lo - (np.cumsum(size) - size), size)
            c = bwt[place]
            which, place, c = which[c != 0], place[c != 0], c[c != 0]
            _, at, n_of = np.unique(which << 9 | c, return_index=True, return_counts=True)
            first.append(step[place[at]])
            count.append(n_of)
        lo, count = np.concatenate(first), np.concatenate(count)
        hi = lo + count
        new = ~known[hi]
        lo, hi = lo[new], hi[new]
        known[hi] = True
    return known[:n]


def first_windows(texts: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text, the starts of its windows whose bytes don't occur at an earlier place. owners: order of each text's first window."""
    sizes = np.array([len(t) for t in texts]) + 1
    begins = np.cumsum(sizes) - sizes
    s = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    s[begins + sizes - 1] = 0
    key = packed_words(s)
    order = suffix_order(key, length + 1)
    new = boundaries(s[order - 1], key[order], length)
    of = np.repeat(np.arange(len(texts)), sizes)[order]
    inside = order - begins[of]
    valid = inside + length < sizes[of]
    group = np.cumsum(new)[valid]
    when = owners[of[valid]] + inside[valid]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    earliest = np.minimum.reduceat(when, heads) if len(heads) else when
    is_first = when == np.repeat(earliest, np.diff(np.append(heads, len(when))))
    at, starts = of[valid][is_first], inside[valid][is_first]
    rank = np.lexsort((starts, at))
    return np.split(starts[rank], np.searchsorted(at[rank], np.arange(1, len(texts))))


def _settle(keys, docs, rows, starts, texts, length) -> Iterator[pa.RecordBatch]:
    """Segments of whole keys: the first windows of each owner, as runs."""
    own: dict[bytes, tuple] = {}
    for d, r, s, t in zip(docs, rows, starts, texts, strict=True):
        if t not in own or (d, r, s) < own[t]:
            own[t] = (d, r, s)
    parts = list(own)
    ranks = {p: i for i, p in enumerate(sorted({o[:2] for o in own.values()}))}
    order = np.array([(ranks[o[:2]] << 40) + o[2] for o in own.values()], np.int64)
    out_docs, out_rows, out_starts, out_counts = [], [], [], []
    for t, found in zip(parts, first_windows(parts, order, length), strict=True):
        if len(found):
            cut = np.flatnonzero(np.concatenate([[True], np.diff(found) != 1]))
            out_docs.append(own[t][0])
            out_rows.append(own[t][1])
            out_starts.append((found[cut] + own[t][2]).astype(np.int64))
            out_counts.append(np.diff(np.append(cut, len(found))).astype(np.int64))
    if out_rows:
        runs = [pa.array(c, pa.list_(pa.int64())) for c in (out_starts, out_counts)]
        yield pa.RecordBatch.from_arrays([pa.array(out_docs, pa.int64()), pa.array(out_rows, pa.int64()), *runs], names=[*_ROW, "starts", "counts"])


def cut_out(data: bytes, segs: list[int], starts: list[int], counts: list[int], length: int = LENGTH) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them, and what is left. segs: numbers of the segments with shared keys; starts, counts: runs of windows that stay."""
    if not segs:
        return 0, 0, data
    _, first, windows = segments(data, length)
    edge = np.zeros(len(data) + 1, np.int64)
    for a, n, sign in ((first[segs], windows[segs], 1), (np.array(starts, np.int64), np.array(counts, np.int64), -1)):
        np.add.at(edge, a, sign)
        np.add.at(edge, a + n, -sign)
    repeat = np.cumsum(edge)[:-1] > 0
    cover = np.concatenate([[0], np.cumsum(repeat)])
    at = np.arange(len(data))
    gone = cover[at + 1] > cover[np.maximum(at - length + 1, 0)]
    runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]])))
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot_rows: int = 1000) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    Keys with over hot_rows pieces, and over a share of 1 / HOT_SHARE of all that are shared, are split by longer pieces.
    """
    rows = _identified(docs, id_col, text_col)

    def keys(batches):
        for batch in batches:
            found = [key_places(t.encode(), length) for t in batch.column(0).to_pylist()]
            k, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counts = rows.select("text").mapInArrow(keys, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    counts = materialize(counts.where("n > 1"), "suffix-shared")
    bar = max(hot_rows, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE)
    hot = docs.sparkSession.sparkContext.broadcast({r["key"] for r in counts.where(F.col("n") > bar).select("key").collect()})  # at most HOT_SHARE keys
    shared = counts.select("key")

    def places(batches):
        for batch in batches:
            found = [segments(t.encode(), length)[0] for t in batch.column(2).to_pylist()]
            size = np.array([len(f) for f in found], np.int64)
            k = np.concatenate(found) if found else np.zeros(0, np.uint64)
            at = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
            of = [pa.array(np.repeat(batch.column(i).to_numpy(), size)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *of, pa.array(at.astype(np.int32))], names=["key", *_ROW, "seg"])

    # Equal rows are one row here.
    marks = rows.select(*_ROW, "text").mapInArrow(places, "key bigint, doc bigint, row bigint, seg int").join(shared, "key", "left_semi")
    marks = materialize(marks.groupBy(*_ROW).agg(F.sort_array(F.collect_set("seg")).alias("segs")), "suffix-marks")

    def cut(batches):
        for batch in batches:
            once: dict[tuple, tuple] = {}
            for doc, row, text, segs in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                data, segs = text.encode(), segs.values.to_numpy()
                k, first, n = (x[segs] for x in segments(data, length))
                for whole in zip(k.view(np.int64).tolist(), first.tolist(), n.tolist(), strict=True):
                    for key, s, w in split_segment(data, *whole, length) if whole[0] in hot.value else [whole]:
                        at = (key, data[s : s + w + length - 1])
                        if at not in once or (doc, row, s) < once[at]:
                            once[at] = (doc, row, s)
            if once:
                cols = [[k for k, _ in once], *zip(*once.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([t for _, t in once], pa.binary())], names=["key", "doc", "row", "start", "bytes"])

    sent = rows.join(marks, _ROW).select(*_ROW, "text", "segs").mapInArrow(cut, "key bigint, doc bigint, row bigint, start bigint, bytes binary")
    sent = sent.repartition("key").sortWithinPartitions("key")

    def expand(batches):
        held, size = [[] for _ in range(5)], 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(5)]
            for i, k in enumerate(cols[0]):
                if size >= SORT_BYTES and k != held[0][-1]:
                    yield from _settle(*held, length)
                    held, size = [[] for _ in range(5)], 0
                for h, c in zip(held, cols, strict=True):
                    h.append(c[i])
                size += len(cols[4][i])
        if held[0]:
            yield from _settle(*held, length)

    kept = sent.mapInArrow(expand, "doc bigint, row bigint, starts array<bigint>, counts array<bigint>")
    kept = materialize(kept.groupBy(*_ROW).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("counts")).alias("counts")), "suffix-kept")

    def finish(batches):
        for batch in batches:
            out = []
            for doc, n, text, *runs in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                data = text.encode()
                out.append((doc, n, len(data), *cut_out(data, *[r or [] for r in runs], length)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=["doc_id", "copies", "n_bytes", "n_removed", "n_spans", "kept"])

    def finished(rows: DataFrame) -> DataFrame:
        joined = rows.join(marks.join(kept, _ROW, "left"), _ROW, "left").select("doc_id", "copies", "text", "segs", "starts", "counts")
        return joined.mapInArrow(finish, "doc_id bigint, copies bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")

    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    copies = materialize(rows.groupBy(*_ROW).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "suffix-copies")
    if copies.isEmpty():
        return finished(rows.withColumn("copies", F.lit(1).cast("bigint"))).select(*result)
    several = small(copies)
    single = finished(rows.join(several, _ROW, "left_anti").withColumn("copies", F.lit(1).cast("bigint")))
    # Of equal rows, all but the first are repeats from end to end.
    first = finished(rows.select("doc_id", *_ROW, "text").join(several, _ROW).dropDuplicates([*_ROW]))
    first = first.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    again = (F.col("at") > 1) & (F.col("n_bytes") >= length)
    first = first.withColumns({"n_removed": F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed")), "n_spans": F.when(again, F.lit(1)).otherwise(F.col("n_spans")), "kept": F.when(again, F.lit(b"")).otherwise(F.col("kept"))})
    return single.select(*result).union(first.select(*result))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and what tells rows apart: doc (null ids come first) and row, a hash of the text."""
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    return rows.withColumns({"doc": F.coalesce("doc_id", F.lit(_NULL)), "row": F.xxhash64("text", F.col("doc_id").isNull())})


def query(spark, sf_dir):
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
