"""The near-duplicate stage of the pipeline against all pairs of documents."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from gridloom.llm import near_dedup

from .conftest import frame, prose


def slow_components(rows, k=5, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if root[i] != root[j] and both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    found = defaultdict(list)
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            found[r].append(d)
    return [(d, min(found[r], default=None)) for (d, _), r in zip(rows, root, strict=True)]


@pytest.fixture(scope="module")
def near(awkward):
    """Copies with 1 to 12 words of 80 replaced, so similarities from about 0.4 to 0.97; a cluster; boilerplate before other texts."""
    r, rows = random.Random(3), list(awkward)
    for i, t in enumerate(prose(30, 60)):
        w = (t + " ").split() * 4
        w = [x + str(k) for k, x in enumerate(w)][:80]
        rows.append((1000 + 10 * i, " ".join(w)))
        for at in r.sample(range(len(w)), min(r.randint(1, 12), len(w))):
            w[at] = "changed"
        rows.append((1001 + 10 * i, " ".join(w)))
    long = " ".join(prose(31, 8))
    rows += [(3000 + i, f"{long} end {i}") for i in range(40)]
    rows += [(4000 + i, " ".join(prose(32, 3)) + " " + t) for i, t in enumerate(prose(33, 40))]
    return rows


@pytest.mark.parametrize(("hot", "pivots"), [(3, 8), (1000, 8), (1000, 1)])
def test_all_similar_pairs_are_linked(spark, near, hot, pivots, monkeypatch):
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    found = near_dedup.near_dedup(frame(spark, near), hot=hot).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=str) == sorted(slow_components(near), key=str)


def test_the_trie_finds_near_copies(spark, near):
    """What the SimHash trie gives the stage: near copies are among its pairs, before the exact join."""
    rows = [(5000 + i, " ".join(prose(34, 12)) + f" end {i}") for i in range(30)]
    sets = near_dedup._sets(frame(spark, rows).selectExpr("struct(doc_id) AS id", "text"))
    pairs = near_dedup.trie_pairs(sets).collect()
    found = {x for r in pairs for x in r}
    assert len(found) >= 20 and {r["p"] for r in sets.select("p").collect()} >= found


def test_stage_keeps_one_of_each_component(spark, near, tmp_path):
    rows = [(i, t) for i, (_, t) in enumerate(near)]
    want = sorted(d for d, least in slow_components(rows) if d == least)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect()) == want


def test_empty(spark):
    assert near_dedup.near_dedup(frame(spark, [(1, "a")]).limit(0)).count() == 0
