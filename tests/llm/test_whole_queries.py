"""Queries over whole test tables against plain versions, and the held-out quality of what is learnt."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from gridloom.llm import packing, secret_scan, simhash_dedup, suffix_dedup, token_counts, tokenizer, toxicity

from .test_operators import plain_spans, slow_print

DATA = "/root/testdata"


def texts(sf):
    return duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{DATA}/{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def test_toxicity_of_held_out_rows(spark):
    rows = toxicity.query(spark, f"{DATA}/sf0.1")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").select("doc_id", "toxic")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n[1, 0]) and n[0, 0] >= 0.99 * (n[0, 0] + n[0, 1])


def test_simhash_components(spark):
    rows = texts("sf0.01")
    prints = np.array([slow_print(t) for _, t in rows], np.uint64)
    forest = simhash_dedup.Forest(len(rows))
    forest.link(*np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3))
    want = {d: (f"{int(p):016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, forest.root, strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.query(spark, f"{DATA}/sf0.01").collect()}
    assert got == want


def test_repeated_bytes(spark):
    seen, want = set(), {}
    for d, t in texts("sf0.001"):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = hash(b[s : s + 100])
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        runs = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        want[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.query(spark, f"{DATA}/sf0.001").collect()}
    assert got == want and sum(x[1] for x in want.values()) > 0


def test_secrets_of_the_base_patterns(spark):
    got = {r["doc_id"]: r for r in secret_scan.query(spark, f"{DATA}/sf0.001").collect()}
    for d, t in texts("sf0.001"):
        spans = plain_spans(t)
        say = [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert [got[d][c] for c in ("n_assign", "n_access", "n_hex")] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(say).encode()).hexdigest() and set(say) <= set(got[d]["spans"].split(","))


@pytest.fixture(scope="module")
def encoded():
    slow = Tokenizer.from_file(tokenizer.default_path())
    return [(d, t, slow.encode(t, add_special_tokens=False)) for d, t in texts("sf0.001")]


def test_packed_pieces(spark, encoded):
    pieces, by = packing.query(spark, f"{DATA}/sf0.001").collect(), defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append(r)
    for d, _, e in encoded:
        ids, at = np.array([*e.ids, 1], "<u4"), 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sizes = Counter()
    for r in pieces:
        sizes[r["sequence_id"]] += r["length"]
    assert all(n == 2048 or n & (n - 1) == 0 for n in sizes.values()) and max(sizes.values()) <= 2048


def test_tokens_of_sections(spark, encoded):
    got = defaultdict(dict)
    for r in token_counts.query(spark, f"{DATA}/sf0.001").collect():
        got[r["doc_id"]][r["section"]] = r
    for d, t, e in encoded:
        starts = [r["start"] for _, r in sorted(got[d].items())]
        want = Counter(int(np.searchsorted(starts, a, "right")) - 1 for a, _ in e.offsets)
        assert {k: r["n_tokens"] for k, r in got[d].items()} == {k: want[k] for k in got[d]}
        assert starts == [0] + [i + 1 for i, c in enumerate(t) if c == "\n" and i + 1 < len(t)]
