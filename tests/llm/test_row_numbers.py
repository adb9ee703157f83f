"""Rows keep their numbers when a scan is dealt out differently from job to job; hot keys may be split without any effect."""

import pytest

from gridloom.llm import suffix_dedup

from .conftest import frame, prose


@pytest.fixture(scope="module")
def repeats(awkward):
    p, common = prose(70, 60), " ".join(prose(71, 2))[:150]
    rows = [*awkward, *[(800 + i, f"{t[: 60 + i]} {common} {p[i - 1]}") for i, t in enumerate(p)], (900, "a" * 400), (901, "b" + "a" * 300), (902, "ab" * 200)]
    return rows


def plain(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())


def test_scan_dealt_out_anew_in_each_job(spark, repeats, tmp_path, monkeypatch):
    rows = [(i, t) for i, (_, t) in enumerate(repeats)]
    frame(spark, rows).repartition(7, "doc_id").write.parquet(str(tmp_path / "documents.parquet"))
    want = plain(suffix_dedup.suffix_dedup(frame(spark, rows).coalesce(1)))
    assert any(0 < r[2] < r[1] for r in want)
    jobs = iter(range(100))
    kept = suffix_dedup.materialize

    def turn(*args):
        spark.conf.set("spark.sql.files.maxPartitionBytes", ["1k", "128m", "20k"][next(jobs) % 3])
        return kept(*args)

    monkeypatch.setattr(suffix_dedup, "materialize", turn)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = suffix_dedup.suffix_dedup(spark.read.parquet(str(tmp_path / "documents.parquet")))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        assert plain(got) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_hot_keys(spark, repeats):
    df = frame(spark, repeats).coalesce(1)
    assert plain(suffix_dedup.suffix_dedup(df, hot_rows=1)) == plain(suffix_dedup.suffix_dedup(df))


def test_parts_of_a_segment_are_its_windows():
    data = (" ".join(prose(72, 10)) + "a" * 300 + "xyz" * 100).encode()
    keys, starts, counts = suffix_dedup.segments(data)
    for k, s, n in zip(keys.view("int64").tolist(), starts.tolist(), counts.tolist(), strict=True):
        parts = suffix_dedup.split_segment(data, k, s, n)
        assert [i for _, a, m in parts for i in range(a, a + m)] == list(range(s, s + n))
    both = data[500:800]
    again = b"0" * 77 + both
    key_of = lambda text: {text[a + i : a + i + 100]: part for k, s, n in zip(*(x.tolist() for x in suffix_dedup.segments(text)), strict=True) for part, a, m in suffix_dedup.split_segment(text, k - (1 << 64) if k >> 63 else k, s, n) for i in range(m)}
    x, y = key_of(data), key_of(again)
    assert all(x[w] == y[w] for w in x.keys() & y.keys()) and len(x.keys() & y.keys()) >= 201
