"""Series: resampling, merging and weights against known constants."""

import math

import pytest

from gridloom.functions import splines
from gridloom.operators import merge
from gridloom.operators.resample import resample
from gridloom.plans.lattice import Axis
from gridloom.plans.merging import merge_series
from gridloom.sources.text import Record, read_records

NAN_GAP = [(0.0, 0.0), (1.0, None), (2.0, 2.0), (3.0, 3.0), (4.0, 4.0)]


def series(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in ("x", *(names or ("z",)))))


def constant(spark, v, lo, hi):
    return series(spark, [(float(x), float(v)) for x in range(lo, hi + 1)])


def values(df, key="ix", field="z"):
    return {r[key]: r[field] for r in df.collect()}


@pytest.mark.parametrize(("bridge", "row", "expected"), [(False, 1, None), (False, 2, None), (True, 2, 1.0), (1.5, 2, None), (2.0, 2, 1.0)])
def test_gaps(spark, bridge, row, expected):
    df = series(spark, NAN_GAP).selectExpr("0 AS g", "x", "z")
    got = values(resample(df, ["g"], "x", ["z"], Axis.sized("x", 0, 4, 0.5), "l", bridge))
    assert got.get(row) == (pytest.approx(expected) if expected is not None else None)
    assert got[0] == 0 and got[5] == pytest.approx(2.5)


def test_linear_of_irregular(spark):
    df = series(spark, [(0.0, 0.0), (0.5, 1.0), (2.0, 4.0), (4.0, 8.0)]).selectExpr("0 AS g", "x", "z")
    assert values(resample(df, ["g"], "x", ["z"], Axis.sized("x", 0, 4, 1)))[1] == pytest.approx(2, abs=1e-10)


def test_kernels_agree_with_expressions(spark):
    df = series(spark, NAN_GAP).selectExpr("0 AS g", "x", "z")
    axis = Axis.sized("x", 0, 4, 0.25)
    xs, vs = zip(*NAN_GAP, strict=True)
    import numpy as np

    x, v = np.array(xs), np.array([math.nan if y is None else y for y in vs])
    for mode in "lne":
        for bridge in (False, True, 1.5):
            got = values(resample(df, ["g"], "x", ["z"], axis, mode, bridge))
            want = splines.sample(x, v, np.array(axis.values()), mode, bridge)
            assert {i: pytest.approx(w) for i, w in enumerate(want) if math.isfinite(w)} == got


def test_no_extrapolation_and_single_samples(spark):
    df = series(spark, [(1.0, 5.0), (2.0, None), (3.0, 7.0)]).selectExpr("0 AS g", "x", "z")
    assert values(resample(df, ["g"], "x", ["z"], Axis.sized("x", 0, 4, 0.5))) == {2: 5.0, 6: 7.0}


def test_blend_constants(spark):
    sources = {"a": series(spark, [(float(x), 10.0, 100.0) for x in range(5)], "u", "v"), "b": series(spark, [(float(x), 0.0, 0.0) for x in range(5)], "u", "v")}
    got = merge_series(spark, read_records("a b 0/4 cosine 0.25/0.25  # one\n"), sources, Axis.sized("x", 0, 4, 1), ["u", "v"], weight="append")
    rows = {r["ix"]: r for r in got.collect()}
    assert rows[0]["u"] == pytest.approx(3.45491502813, abs=1e-10) and rows[0]["weight"] == pytest.approx(0.345491502813, abs=1e-10)
    assert (rows[2]["u"], rows[2]["v"], rows[2]["weight"]) == (10, 100, 1)


def test_secondary_stays_in_the_domain(spark):
    sources = {"a": constant(spark, 10, 0, 4), "b": constant(spark, 0, -1, 5)}
    axis = Axis.sized("x", -1, 5, 1)
    for mode in ("blend", "aggregate"):
        got = values(merge_series(spark, [Record("a", "b", "0/4")], sources, axis, ["z"], mode=mode))
        assert got[0] is None and got[6] is None
        got = values(merge_series(spark, [Record("a", "b", "0/4"), Record("b")], sources, axis, ["z"], mode=mode))
        assert got[0] == 0 and got[6] == 0


def test_clobber(spark):
    sources = {"a": constant(spark, 10, 0, 6), "b": constant(spark, 20, 4, 10)}
    axis, records = Axis.sized("x", 0, 10, 1), [Record("a"), Record("b")]
    for how, v in (("first", 10), ("last", 20), ("lowest", 10), ("highest", 20)):
        assert values(merge_series(spark, records, sources, axis, ["z"], mode="clobber", how=how))[5] == v


def test_signed_clobber_by_dialect(spark):
    rows = spark.createDataFrame([(0, 0, 5.0), (1, 0, -3.0), (2, 0, 7.0), (0, 1, 4.0), (1, 1, -9.0)], "rec int, ix int, p_z double")
    assert values(merge.clobber(rows, ["ix"], ["z"], "highest", "-")) == {0: 5.0, 1: 4.0}
    assert values(merge.clobber(rows, ["ix"], ["z"], "highest", "-", "grid")) == {0: -3.0, 1: -9.0}
    assert values(merge.clobber(rows, ["ix"], ["z"], "last", "+")) == {0: 7.0, 1: 4.0}


def test_aggregates(spark):
    sources = {"a": constant(spark, 10, 0, 10), "b": constant(spark, 20, 0, 10), "c": constant(spark, 40, 0, 10), "back": constant(spark, 0, 0, 10), "other": constant(spark, 1, 0, 10)}
    axis = Axis.sized("x", 0, 10, 1)
    box = "boxcar 0"
    two = read_records(f"a back 0/6 {box}\nb back 4/10 {box}")
    got = {r["ix"]: r for r in merge_series(spark, two, sources, axis, ["z"], mode="aggregate", weight="append").collect()}
    assert got[5]["z"] == pytest.approx(15) and got[5]["weight"] == 1 and got[2]["z"] == 10 and got[8]["z"] == 20
    three = read_records(f"a back 0/6 {box}\nb back 4/10 {box}\nc back 5/10 {box}")
    assert values(merge_series(spark, three, sources, axis, ["z"], mode="aggregate"))[5] == pytest.approx(23.3333333333, abs=1e-9)
    hierarchy = read_records(f"a back 0/6 {box}\nb back 4/10 {box}\nback other 0/10 {box}\nother")
    assert values(merge_series(spark, hierarchy, sources, axis, ["z"], mode="aggregate"))[5] == pytest.approx(15)
    with pytest.raises(ValueError, match="different secondaries"):
        merge_series(spark, read_records(f"a back 0/6 {box}\nb other 4/10 {box}"), sources, axis, ["z"], mode="aggregate")


def test_pair_fill(spark):
    sources = {"a": series(spark, [(float(x), None if x == 2 else 10.0) for x in range(5)]), "b": constant(spark, 2, 0, 4)}
    axis, records = Axis.sized("x", 0, 4, 1), read_records("a b - boxcar")
    assert values(merge_series(spark, records, sources, axis, ["z"]))[2] is None
    assert values(merge_series(spark, records, sources, axis, ["z"], pair_fill=True))[2] == 2
    assert values(merge_series(spark, records, sources, axis, ["z"], bridge=True))[2] == 10
