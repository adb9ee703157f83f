"""Whole runs, gaps by node, the NetCDF source, and kernels on curved data against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import noise, splines
from gridloom.operators import columns, heterogeneity, holes, resample, supports
from gridloom.plans import programs
from gridloom.plans.gridframe import GridFrame
from gridloom.plans.lattice import Axis, Lattice
from gridloom.sources import netcdf, text


def grid(spark, lattice, f, name="v"):
    arrays = {name: np.array([f(*p) for p in np.ndindex(*[a.n for a in lattice.axes])], float).reshape([a.n for a in lattice.axes])}
    return GridFrame(netcdf.from_arrays(spark, lattice, arrays), lattice, (name,))


X, Y = Axis("x", 0.0, 1.0, 5), Axis("y", 0.0, 1.0, 4)


# Gaps


def test_a_node_without_a_row_is_a_gap(spark):
    rows = [(z, 0, 0, float(z), None if z == 1 else 10.0 * z) for z in range(3)]
    dense = spark.createDataFrame(rows, "iz int, iy int, ix int, z double, v double")
    to = Axis("z", 0.0, 0.5, 5)
    for df in (dense, dense.where("v IS NOT NULL")):
        got = lambda **k: sorted((r["iz"], r["v"]) for r in resample.vertical(df, "z", ["v"], to, **k).collect())  # noqa: B023, E731
        assert got() == got(mode="a") == [(0, 0.0), (4, 20.0)]
        assert got(bridge=True) == [(0, 0.0), (1, 5.0), (2, 10.0), (3, 15.0), (4, 20.0)]
        assert sorted((r["iz"], r["run"]) for r in resample.run_numbers(df, ["iy", "ix"], "z", "v", index="iz").collect()) == [(0, 0), (2, 1)]


def test_water_in_sparse_columns(spark):
    # z from 3 to 0 of index is 10, 0, -10, -20; water is a missing value, so the sea floor is at -20.
    rows = [(iz, 0, 0, 10.0 * iz - 20, v) for iz, v in enumerate((5.0, None, None, None))] + [(iz, 0, 1, 10.0 * iz - 20, v) for iz, v in enumerate((5.0, 4.0, 3.0, 2.0))]
    dense = spark.createDataFrame(rows, "iz int, iy int, ix int, z double, v double")
    for df in (dense, dense.where("v IS NOT NULL")):
        got = {r["ix"]: r for r in columns.infer_surface(df, ["v"], {"v": None}).collect()}
        assert (got[0]["model_class"], got[0]["water_surface"], got[0]["conflict"]) == (columns.WET, -20.0, False)
        assert (got[1]["model_class"], got[1]["land_surface"]) == (columns.LAND, 10.0)


def test_conflicts(spark):
    rows = [(iz, 0, 0, 10.0 * iz - 20, v, w) for iz, (v, w) in enumerate(((None, 1.0), (9.0, 1.0), (9.0, 1.0), (None, 2.0)))]
    df = spark.createDataFrame(rows, "iz int, iy int, ix int, z double, v double, w double")
    r = columns.infer_surface(df, ["v", "w"], {"v": 9.0}).first()
    # The water ends in a node without a value, and the highest values differ.
    assert r["conflict"] and r["water_surface"] is None and r["land_conflict"] and r["land_surface"] == 10.0


# Sources


def test_tables_increase(spark, tmp_path):
    for name, lines, ok in (("a", "1 2\n2 3\n4 1", True), ("b", "3 1\n2 1\n5 1", False), ("c", "1 1\n1 2", False), ("d", "1 1\nnan 2\n3 3", False)):
        (tmp_path / name).write_text(lines)
        if ok:
            assert text.read_table(spark, str(tmp_path / name)).count() == 3
        else:
            with pytest.raises(ValueError):
                text.read_table(spark, str(tmp_path / name))


def test_records_in_three_dimensions():
    a, b = text.read_records("a b ring 1/5 cosine/boxcar .1\nc - - - boxcar", 3)
    assert a.levels == (1.0, 5.0) and a.tapers[0] == a.tapers[2] != a.tapers[1] and b.levels is None
    with pytest.raises(ValueError):
        text.read_records("a b c d e f", 2)


@pytest.mark.parametrize("lattice", [Lattice((Axis("z", 2.0, -1.0, 3), Y, X)), Lattice((Y, X))])
def test_netcdf_source(spark, tmp_path, lattice):
    own = grid(spark, lattice, lambda *p: np.nan if sum(p) % 4 == 3 else sum(x * 10**k for k, x in enumerate(p)))
    path = str(tmp_path / "a.nc")
    if lattice.axes[0].name == "z":
        lattice = Lattice((Axis("z", 0.0, 1.0, 3), Y, X))
        own = GridFrame(own.df, lattice, ("v",), {"v": "m"})
    netcdf.write_grid(own, path)
    got = netcdf.read_grid(spark, f"{path}?v", nodes=1)
    assert got.df.rdd.getNumPartitions() == lattice.axes[0].n and got.lattice == lattice and got.units == own.units
    plain = lambda g: sorted((tuple(r) for r in g.df.collect()), key=str)
    assert plain(got) == plain(own)
    assert sorted(r["v"] for r in netcdf.read_grid(spark, f"{path}?v+v2").df.where("v IS NOT NULL").collect()) == sorted(2 * r["v"] for r in own.df.where("v IS NOT NULL").collect())
    # Over the file that is left, nothing but the header is read for the lattice.
    assert netcdf.layout(netcdf.read_classic(path)).lattice == lattice


# Runs


def test_merge_of_tiles_that_need_resampling(spark):
    target = Lattice((Axis("y", 0.0, 0.5, 7), Axis("x", 0.0, 0.5, 9)))
    a, far = grid(spark, Lattice((Y, X)), lambda i, j: 2 * i + 3 * j), grid(spark, Lattice((Axis("y", 90.0, 1.0, 4), X)), lambda i, j: 1)
    got = programs.merge_grids(spark, ["far", "a"], {"a": a, "far": far}, target, steps=programs.Steps(horizontal="l"))
    assert all(r["v"] == pytest.approx(r["iy"] + 1.5 * r["ix"]) for r in got.df.collect()) and got.df.count() == 63
    with pytest.raises(ValueError):
        programs.merge_grids(spark, ["far"], {"far": far}, target)


def test_merge_fills_holes_first(spark):
    a = grid(spark, Lattice((Axis("y", 0.0, 1.0, 6), X)), lambda i, j: np.nan if (i, j) in ((2, 2), (3, 2)) else 2 * i + 3 * j)
    got = programs.merge_grids(spark, ["a"], {"a": a}, a.lattice, steps=programs.Steps(holes="m"))
    assert all(r["v"] == pytest.approx(2 * r["iy"] + 3 * r["ix"]) for r in got.df.collect())
    bent = GridFrame(a.df, Lattice((a.lattice.axis("y"), Axis.of("x", [0, 1, 2, 3, 5]))), ("v",))
    with pytest.raises(ValueError):
        programs.merge_grids(spark, ["a"], {"a": bent}, a.lattice, steps=programs.Steps(holes="m"))


def test_polygon_of_a_tile(spark):
    wide = Lattice((Axis("y", 0.0, 1.0, 9), Axis("x", 0.0, 1.0, 11)))
    one, two = grid(spark, wide, lambda i, j: 1), grid(spark, wide, lambda i, j: 2)
    ring = [(3.0, 3.0), (7.0, 3.0), (7.0, 6.0), (3.0, 6.0)]
    record = text.Record("one", "two", "ring", (supports.Taper("boxcar", 0.0, 0.0),) * 2)
    got = {(r["iy"], r["ix"]): r for r in programs.merge_grids(spark, [record], {"one": one, "two": two}, wide, polygons={"ring": ring}, weight="append").df.collect()}
    # In a plane a polygon reaches one node further.
    assert all((got[i, j]["v"] == 1) == (2 <= i <= 7 and 2 <= j <= 8) for i, j in got)


def test_near_surface_units_and_evidence(spark):
    lattice = Lattice((Axis("z", 0.0, 100.0, 6), Y, X))
    si = grid(spark, lattice, lambda k, i, j: 800 + 100 * k, "vs")
    km = grid(spark, lattice, lambda k, i, j: 0.8 + 0.1 * k, "vs")
    flat = Lattice((Y, X))
    a, n = programs.near_surface(si, grid(spark, flat, lambda i, j: 300 if i else -1), evidence="vs30")
    b, _ = programs.near_surface(km, grid(spark, flat, lambda i, j: 0.3 if i else -1), evidence="vs30", velocity=1000.0)
    both = a.df.join(b.df.withColumnRenamed("vs", "km"), a.lattice.keys)
    assert both.count() == lattice.size and both.where("abs(vs - 1000 * km) > 1e-6").count() == 0
    assert {r["reason"]: r["columns"] for r in n.collect()} == {"wet": 5, "layer": 15}
    assert a.df.where("iy = 1 AND iz = 0 AND abs(vs - 300) > 150").count() == 0 and a.df.where("iy = 0 AND vs <> 800 + 100 * iz").count() == 0


def test_perturbation(spark):
    lattice = Lattice((Axis("z", 0.0, 1.0, 4), Y, X))
    model = grid(spark, lattice, lambda *p: 100.0)
    got, bad = programs.perturb(model, {"v": heterogeneity.Statistics(0.05, (2.0,))}, 3, ranges={"x": (1.0, 3.0)}, tapers={"x": supports.Taper()})
    v = {(r["iz"], r["iy"], r["ix"]): r["v"] for r in got.df.collect()}
    assert len(v) == lattice.size and bad.first()["v"] == 0
    assert all(v[k] == 100 for k in v if k[2] in (0, 4)) and any(v[k] != 100 for k in v)
    with pytest.raises(ValueError):
        supports.perturbation_support(lattice, {"x": (-2.0, 3.0)})


def test_fields_are_aggregated_together_as_alone(spark):
    from gridloom.operators import merge

    rng = np.random.default_rng(7)
    num = lambda: None if rng.random() < 0.3 else float(rng.integers(1, 9))
    rows = [(rec, ix, num(), num(), num(), num(), float(rng.random()) if rng.random() < 0.8 else None, rec % 3 != 2, f"p{rec}", "s" if rec % 3 != 2 else None) for rec in range(6) for ix in range(30) if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "rec int, ix int, p_a double, s_a double, p_b double, s_b double, w double, pair boolean, prim string, sec string")
    for dialect in ("series", "cube"):
        both = {r["ix"]: r for r in merge.aggregate(df, ["ix"], ["a", "b"], True, dialect).collect()}
        for f in "ab":
            alone = {r["ix"]: r[f] for r in merge.aggregate(df, ["ix"], [f], True, dialect).collect()}
            assert alone and all(both[k][f] == v for k, v in alone.items())


# Kernels on curved data


def curved(n, m):
    i, j = np.mgrid[:n, :m]
    return np.sin(i / 3) * np.cos(j / 4) + i * j / 50


def test_fills_differ_and_are_near_on_a_curved_plane():
    z = curved(20, 22)
    gone = z.copy()
    gone[8:12, 9:13] = np.nan
    worst = {m: np.abs(holes.fill_plane(gone, 1.0, 1.0, m) - z).max() for m in ("n", "l", "s", "m")}
    assert worst["s"] < 0.02 and worst["m"] < 0.02 and 0.02 < worst["l"] < worst["n"]
    s, m, t = (holes.fill_plane(gone, 1.0, 1.0, *a) for a in (("s",), ("m",), ("s", 0.9)))
    assert np.abs(s - m).max() > 1e-6 and np.abs(s - t).max() > 1e-4 and np.abs(t - z).max() < 0.1


def test_labels_against_a_flood():
    rng = np.random.default_rng(3)
    z = np.where(rng.random((30, 40)) < 0.35, np.nan, 1.0)
    label = holes.label_holes(z)
    seen, groups = set(), []
    for start in zip(*np.nonzero(np.isnan(z)), strict=True):
        if start in seen:
            continue
        todo, group = [start], set()
        while todo:
            i, j = todo.pop()
            if (i, j) in group or not (0 <= i < 30 and 0 <= j < 40) or np.isfinite(z[i, j]):
                continue
            group.add((i, j))
            todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        seen |= group
        groups.append(group)
    inside = [g for g in groups if all(0 < i < 29 and 0 < j < 39 for i, j in g)]
    assert len(inside) > 5 and sorted(map(sorted, inside)) == sorted(sorted(zip(*(x.tolist() for x in np.nonzero(label == k)), strict=True)) for k in set(label[label > 0].tolist()))
    # The nearest value, against all of the plane.
    got = holes.fill_plane(z * np.arange(1200).reshape(30, 40), 1.0, 1.0, "n")
    gi, gj = np.nonzero(np.isfinite(z))
    for i, j in [p for g in inside for p in g]:
        d2 = (gi - i) ** 2 + (gj - j) ** 2
        assert got[i, j] in (gi * 40 + gj)[d2 == d2.min()]


def test_bessel_k0():
    # Published values.
    for x, want in ((0.1, 2.4270690247), (1.0, 0.4210244382), (2.0, 0.1138938728)):
        assert holes._bessel_k0(np.array([x]))[0] == pytest.approx(want, rel=1e-8)


def test_natural_spline_and_akima_against_plain_versions():
    x, v, to = np.array([0.0, 1.0, 2.5, 3.0, 4.5, 6.0, 7.0]), np.array([0.0, 2.0, 1.0, 3.0, 2.5, 2.0, 4.0]), np.linspace(0, 7, 57)
    n = len(x)
    # Second derivatives by the whole system.
    a, r = np.zeros((n, n)), np.zeros(n)
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, n - 1):
        h, g = x[i] - x[i - 1], x[i + 1] - x[i]
        a[i, i - 1 : i + 2] = h / 6, (h + g) / 3, g / 6
        r[i] = (v[i + 1] - v[i]) / g - (v[i] - v[i - 1]) / h
    second = np.linalg.solve(a, r)
    want = []
    for t in to:
        i = min(max(int(np.searchsorted(x, t, "right")) - 1, 0), n - 2)
        h, p, q = x[i + 1] - x[i], x[i + 1] - t, t - x[i]
        want.append((second[i] * p**3 + second[i + 1] * q**3) / (6 * h) + (v[i] / h - second[i] * h / 6) * p + (v[i + 1] / h - second[i + 1] * h / 6) * q)
    assert np.allclose(splines.sample(x, v, to, "c"), want, atol=1e-9)
    # Akima's slopes from the definition, with two slopes more at each end.
    m = list(np.diff(v) / np.diff(x))
    m = [3 * m[0] - 2 * m[1], 2 * m[0] - m[1], *m, 2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]
    slopes = []
    for i in range(n):
        w1, w2 = abs(m[i + 3] - m[i + 2]), abs(m[i + 1] - m[i])
        slopes.append((w1 * m[i + 1] + w2 * m[i + 2]) / (w1 + w2) if w1 + w2 else (m[i + 1] + m[i + 2]) / 2)
    want = []
    for t in to:
        i = min(max(int(np.searchsorted(x, t, "right")) - 1, 0), n - 2)
        h = x[i + 1] - x[i]
        u = (t - x[i]) / h
        want.append(v[i] * (1 + 2 * u) * (1 - u) ** 2 + h * slopes[i] * u * (1 - u) ** 2 + v[i + 1] * u * u * (3 - 2 * u) - h * slopes[i + 1] * u * u * (1 - u))
    assert np.allclose(splines.sample(x, v, to, "a"), want, atol=1e-9)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 30])
def test_smoothing_against_the_whole_system(n):
    rng = np.random.default_rng(n)
    x, v, p = np.cumsum(rng.random(n) + 0.1), rng.random(n), 0.7
    values, second = splines.smoothing(x, v, p)
    h = np.diff(x)
    q, r = np.zeros((n, max(n - 2, 0))), np.zeros((max(n - 2, 0),) * 2)
    for i in range(n - 2):
        q[i : i + 3, i] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        r[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            r[i, i - 1] = r[i - 1, i] = h[i] / 6
    inner = np.linalg.solve(r + p * q.T @ q, q.T @ v)
    assert np.allclose(second[1:-1], inner) and np.allclose(values, v - p * q @ inner)


@pytest.mark.parametrize("seed", [0, 1, 12345, (1 << 64) - 1])
def test_random_numbers_one_by_one(seed):
    x, want = seed or noise.GOLDEN, []
    for _ in range(1000):
        x ^= x >> 12
        x = (x ^ x << 25) & noise.MASK
        x ^= x >> 27
        want.append(x * noise.MULTIPLIER & noise.MASK)
    for n in (1, 2, 3, 17, 1000):
        assert noise.raw(seed, n).tolist() == want[:n]


def test_bicubic_is_near_a_smooth_field():
    z, y, x = curved(20, 22), np.arange(20.0), np.arange(22.0)
    to_y, to_x = np.linspace(3, 15, 25), np.linspace(3, 17, 31)
    want = np.sin(to_y[:, None] / 3) * np.cos(to_x / 4) + to_y[:, None] * to_x / 50
    cubic, line = splines.bicubic(y, x, z, to_y, to_x), splines.separable(y, x, z, to_y, to_x, "l")
    assert np.abs(cubic - want).max() < 2e-3 < np.abs(line - want).max()
    assert np.abs(splines.separable(y, x, z, to_y, to_x, "c") - want).max() < 2e-3


@pytest.mark.parametrize("model", ["v", "g", "e"])
def test_spectrum_against_a_plain_transform(model):
    """Anisotropic; lengths are along x, y, z, arrays z, y, x."""
    shape, incs, lengths, hurst = [3, 4, 5], [2.0, 1.0, 0.5], (4.0, 2.0, 7.0), 0.3
    got = heterogeneity.realise(shape, incs, [0, 0, 0], heterogeneity.Statistics(0.1, lengths, hurst, model), 5)
    white = noise.gaussians(5, 60).astype(np.float32).astype(float).reshape(shape)
    out = np.zeros(shape, complex)
    waves = [[2 * math.pi * (k if k <= (n - 1) // 2 else k - n) / (n * d) for k in range(n)] for n, d in zip(shape, incs, strict=True)]
    at = list(np.ndindex(*shape))
    for k in at[1:]:
        q2 = sum((a * waves[d][k[d]]) ** 2 for d, a in enumerate(lengths[::-1]))
        gain = {"v": (1 + q2) ** (-0.5 * (hurst + 1.5)), "g": math.exp(-q2 / 8), "e": (1 + q2) ** -1.0}[model]
        phase = np.array([sum(k[d] * p[d] / shape[d] for d in range(3)) for p in at]).reshape(shape)
        c = (white * np.exp(-2j * np.pi * phase)).sum() * gain
        out += c * np.exp(2j * np.pi * phase) / 60
    want = out.real - out.real.mean()
    assert np.allclose(got, want * 0.1 / want.std(ddof=1), atol=1e-6)


def test_envelopes_are_monotone():
    x, y = Axis("x", 0.0, 1.0, 21), Axis("y", 0.0, 1.0, 21)
    bent = [(2.0, 2.0), (18.0, 2.0), (18.0, 18.0), (12.0, 18.0), (12.0, 6.0), (10.0, 14.0), (8.0, 6.0), (2.0, 15.0)]
    assert not supports.is_monotone(bent)
    for shape in (supports.envelope(bent, x, y), supports.piecewise_envelope(bent)):
        assert supports.is_monotone(shape)
    assert set(supports.piecewise_envelope(bent)) < set(bent)
    with pytest.raises(ValueError):
        supports.polygon_support(bent, x, y)
    assert supports.polygon_support(bent, x, y, convert="piecewise").box == {"y": (2, 18), "x": (2, 18)}


def test_refused_arguments(spark):
    df = spark.createDataFrame([(0, 0, 1.0)], "iy int, ix int, v double")
    for method, arg in (("n", -1.0), ("a", -2.0), ("l", 1.0), ("s", 1.5), ("m", -0.1)):
        with pytest.raises(ValueError):
            holes.fill_holes(df, ["v"], 3, 3, method=method, arg=arg)
    with pytest.raises(ValueError):
        heterogeneity.by_axis((1.0, 2.0), 3)


def test_nodes_of_a_box(spark):
    lattice = Lattice((Y, X))
    assert sorted((r["iy"], r["ix"], r["x"]) for r in lattice.nodes(spark, {"x": (2, 3), "y": (1, 1)}).collect()) == [(1, 2, 2.0), (1, 3, 3.0)]
    assert lattice.nodes(spark, {"x": (3, 2)}).count() == 0
    assert lattice.nodes(spark).where(F.col("x") >= 0).count() == 20
