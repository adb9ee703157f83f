"""Each stage of the pipeline on awkward rows, and the whole of it against plain versions of its decisions."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline as pipeline
from gridloom.llm import tokenizer, toxicity

from .conftest import prose
from .test_near_dedup import slow_components
from .test_short_leaks import all_windows

COLUMNS = pipeline.COLUMNS
STAGE = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def rows(awkward):
    """awkward rows, toxic ones, near copies and benchmark items; ids from 3000 on are labelled."""
    found = [(d, t) for d, t in awkward if len(t or "") < 6000]
    r, bad = prose(41, 400), ["gronk", "blivet", "smurtch"]
    found += [(3000 + i, f"{t} {bad[i % 3]} {t}" if i % 4 == 0 else t) for i, t in enumerate(r)]
    found += [(4000 + i, f"{t} and some more") for i, t in enumerate(r[1:60:4])]
    found += [(4100 + i, f"{a} {t} {b}") for i, (a, t, b) in enumerate(zip(r[101:121:4], prose(42, 5), r[201:221:4], strict=True))]
    return found


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(d, t, "en", None, len(t) if t else None, "x", "y", None) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id string, __row bigint")
    docs.repartition(5).write.parquet(f"{at}/documents.parquet")
    labels = [(3000 + i, 0, int(i % 4 == 0)) for i in range(400)] + [(None, 1, 1), (3001, 1, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate([*prose(42, 5), None, ""])), "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def ids(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def docs_of(spark, sf, rows=None):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if rows is None:
        return docs
    return spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def low(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_toxicity_stage(spark, sf, rows):
    kept = ids(STAGE["toxicity"](spark, docs_of(spark, sf), sf))
    scores = toxicity.toxicity(docs_of(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0")
    assert [d for d, _ in kept] == sorted((r["doc_id"] for r in scores.collect()), key=lambda d: str((d, ""))) or len(kept) == scores.count()
    there = {d for d, _ in kept}
    toxic = {3000 + i for i in range(0, 400, 4)}
    clean = {d for d, t in rows if d is not None and 3000 <= d < 3400} - toxic
    assert len(toxic & there) <= 2 and len(clean - there) <= 3


def test_exact_stage(spark, sf, rows):
    best = {}
    for d, t in rows:
        k = low(t)
        best[k] = max(best.get(k, -1), -1 if d is None else d)
    kept = ids(STAGE["exact_dedup"](spark, docs_of(spark, sf), sf))
    assert len(kept) == len(best) and {low(t): -1 if d is None else d for d, t in kept} == best


def test_near_stage(spark, sf, rows):
    # One of each component: that with the smallest id, a null one before all others.
    kept = ids(STAGE["simhash_near_dedup"](spark, docs_of(spark, sf), sf))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {least for _, least in slow_components([(i, t) for i, (_, t) in enumerate(order)])}
    assert sorted((d for d, _ in kept), key=str) == sorted((order[i][0] for i in first), key=str)


def test_decontamination_stage(spark, sf, rows):
    bench = list(enumerate([*prose(42, 5), None, ""]))
    leaks = {d for d, *_ in all_windows(rows, bench)}
    kept = ids(STAGE["benchmark_decontamination"](spark, docs_of(spark, sf), sf))
    assert kept == sorted(((d, t) for d, t in rows if d not in leaks), key=str) and leaks == {4100 + i for i in range(5)}


def test_packing_stage(spark, sf, rows):
    bpe = tokenizer.load(tokenizer.default_path())
    got = defaultdict(list)
    for r in STAGE["packing"](spark, docs_of(spark, sf), sf).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    single = {d: t for d, t in rows if sum(x == d for x, _ in rows) == 1}
    for d, t in single.items():
        want, at = np.array([*bpe.encode(t or ""), 1], "<u4"), 0
        for start, n, crc in sorted(got[d]):
            assert start == at and crc == zlib.crc32(want[at : at + n].tobytes())
            at += n
        assert at == len(want)


@pytest.mark.parametrize("rows_", [[], [(None, None)], [(1, "a"), (1, "a"), (1, None)]])
def test_small_inputs(spark, sf, rows_):
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs_of(spark, sf, rows_), sf)
        assert out.count() <= max(1, len(rows_)) and (name == "packing" or out.columns == COLUMNS)


def test_the_whole(spark, sf, rows):
    docs = docs_of(spark, sf)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            kept = ids(docs)
            docs = docs_of(spark, sf, kept)
    want = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in docs.collect() if r["doc_id"] is not None)
    got = pipeline.run(spark, sf)
    total = lambda pieces: {d: sum(n for x, _, n, _ in pieces if x == d) for d in {p[0] for p in pieces}}
    found = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect() if r["doc_id"] is not None)
    assert total(found) == total(want) and len(total(found)) > 200
