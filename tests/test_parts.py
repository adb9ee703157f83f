"""Windows, grids, columns, random numbers, sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import geotech, noise, splines, transforms, windows
from gridloom.operators import columns, heterogeneity, holes, resample, supports
from gridloom.operators import geotech as layer
from gridloom.plans.lattice import Axis, Lattice
from gridloom.sources import netcdf, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_cosine_constants(spark):
    at = lambda i, n, r: one(spark, windows.weight(F.lit(i), n, r, r))
    assert at(0, 5, 0.25) == pytest.approx(0.345491502813, abs=1e-12) and at(1, 5, 0.25) == 1
    assert at(0, 3, 0.25) == pytest.approx(0.75) and at(0, 101, 0.2) == pytest.approx(0.001510978, abs=1e-9) and at(50, 101, 0.2) == 1


def test_windows_are_weights(spark):
    df = spark.range(60).select("id", *[windows.weight(F.col("id"), 60, 0.4, 0.2, n).alias(n) for n in windows.NAMES])
    pdf = df.toPandas()
    for n in windows.NAMES:
        assert pdf[n].between(0, 1).all(), n
    assert len(windows.NAMES) == 53 and windows.canonical("tukey") == "cosine" and windows.canonical("linear") == "trapezoid"


def test_lattice():
    with pytest.warns(UserWarning):
        assert Axis.sized("x", 0, 1, 0.3).n == 4
    with pytest.raises(ValueError):
        Axis.sized("x", 0, 0.1, 1)
    assert Axis.of("x", [0, 1, 2]).regular and not Axis.of("x", [0, 1, 3]).regular
    assert Axis.sized("x", 0, 4, 1, "m").scaled(-0.001).unit is None


def test_transforms():
    s = transforms.parse_source("m.nc?vp,vs+x1/1000+v1e+3,2+Vm/s,m/s+n-9")
    assert s.fields == ("vp", "vs") and s.transform.axis_scale == {"x": 0.001} and s.transform.value_scale == (1000, 2) and s.transform.sentinel == -9
    for bad in ("+x0", "+x1+x2", "+q1", "+v"):
        with pytest.raises(ValueError):
            transforms.parse_modifiers(bad)
    with pytest.raises(ValueError):
        s.transform.scale_of(0, 3)


def test_unpack(spark):
    df = spark.createDataFrame([(1.0,), (-9.0,), (float("nan"),), (float("inf"),), (None,)], "p double")
    assert [r[0] for r in df.select(transforms.unpack(F.col("p"), 2.0, 1.0, (-9.0,), 10.0)).collect()] == [30.0, None, None, None, None]


def test_splines():
    x = np.arange(6.0)
    line = 2 * x + 1
    for mode in "lacs":
        assert splines.sample(x, line, np.array([2.5, 0.1]), mode, smooth=0.5) == pytest.approx([6, 1.2])
    z = np.add.outer(3 * x, 2 * x) + 100
    assert splines.bicubic(x, x, z, np.array([0.5]), np.array([2.25]))[0, 0] == pytest.approx(106)


def test_bilinear_and_nearest(spark):
    lattice = Lattice((Axis("y", 0, 1, 3), Axis("x", 0, 1, 3)))
    df = lattice.nodes(spark).select("iy", "ix", (F.col("y") * 3 + F.col("x")).alias("v"))
    to = Lattice((Axis("y", 0.5, 1, 2), Axis("x", 0.25, 0.5, 4)))
    got = {(r["iy"], r["ix"]): r["v"] for r in resample.horizontal(df, lattice, to, ["v"], "l").collect()}
    assert got == {(i, j): pytest.approx(3 * (0.5 + i) + 0.25 + 0.5 * j) for i in range(2) for j in range(4)}
    got = resample.horizontal(df, lattice, to, ["v"], "n").where("iy = 0 AND ix = 0").first()
    assert got["v"] == 3


@pytest.mark.parametrize("method", holes.METHODS)
def test_holes(method):
    z = np.full((9, 9), 10.0)
    z[3:6, 3:6] = np.nan
    z[0, 3] = np.nan
    got = holes.fill_plane(z, 1, 1, method)
    assert got[4, 4] == pytest.approx(10, abs=0.05) and np.isnan(got[0, 3])
    assert np.isnan(holes.fill_plane(z, 1, 1, method, most=2)[4, 4])


def test_hole_frames(spark):
    lattice = Lattice((Axis("y", 0, 1, 5), Axis("x", 0, 1, 5)))
    df = lattice.nodes(spark).where("NOT (iy = 2 AND ix = 2)").select(F.lit(0).alias("iz"), "iy", "ix", (F.col("x") + F.col("y")).alias("v"))
    assert holes.fill_holes(df, ["v"], 5, 5, layer=["iz"]).where("iy = 2 AND ix = 2").first()["v"] == pytest.approx(4)
    assert [tuple(r) for r in holes.hole_labels(df, "v", 5, 5, ["iz"]).collect()] == [(0, 2, 2, 1)]


def test_plane_weights(spark):
    x = y = Axis("x", 0, 1, 3)
    y = Axis("y", 0, 1, 3)
    taper = {"x": supports.Taper("cosine", 0.25, 0.25), "y": supports.Taper("cosine", 0.25, 0.25)}
    support = supports.plane_support(x, y, (0, 2, 0, 2), taper, grown=True)
    corner = Lattice((Axis("y", -1, 1, 5), Axis("x", -1, 1, 5)))
    got = corner.nodes(spark).select((F.col("iy") - 1).alias("iy"), (F.col("ix") - 1).alias("ix")).select("iy", "ix", support.weight().alias("w"))
    assert got.where("iy = -1 AND ix = -1").first()["w"] == pytest.approx(0.119364378516, abs=1e-10)


def test_polygons(spark):
    x, y = Axis("x", 0, 1, 11), Axis("y", 0, 1, 11)
    rows, cols = supports.polygon_spans([(0, 0), (10, 0), (0, 10)], x, y)
    assert rows[0] == (0, 10) and rows[4] == (0, 6) and cols[3] == (0, 7)
    dented = [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10)]
    assert not supports.is_monotone(dented)
    with pytest.raises(ValueError):
        supports.polygon_support(dented, x, y)
    s = supports.polygon_support(dented, x, y, convert="envelope")
    assert Lattice((y, x)).nodes(spark).where(s.weight() > 0).count() == 121


def test_ely_constants(spark):
    at = lambda q, top, anchor: one(spark, geotech.ely_profile(F.lit(q), F.lit(top), F.lit(anchor)))
    assert [at(q, 400.0, 1000.0) for q in (0.0, 0.5, 1.0)] == pytest.approx([200, 865.1948, 1000], abs=1e-2)
    assert one(spark, geotech.brocher_vp(F.lit(1000.0))) == pytest.approx(2458.2, abs=0.1)
    assert one(spark, geotech.nafe_drake(F.lit(2464.68))) == pytest.approx(2082.08, abs=0.1)
    assert one(spark, geotech.brocher_vs(F.lit(2000.0))) == pytest.approx(608.6, abs=0.1)
    assert one(spark, geotech.brocher_vp(F.lit(5000.0))) is None


def test_geotech_layer(spark):
    cube = spark.createDataFrame([(k, 0, i, 175.0 * k, 1000.0) for k in range(3) for i in range(2)], "iz int, iy int, ix int, z double, vs double")
    dry = spark.createDataFrame([(0, 0, 400.0, True), (0, 1, 400.0, False)], "iy int, ix int, vs30 double, land boolean")
    got = {(r["iz"], r["ix"]): r["vs"] for r in layer.geotech_layer(cube, dry).collect()}
    assert [got[k, 0] for k in range(3)] == pytest.approx([200, 865.1948, 1000], abs=1e-2)
    assert [got[k, 1] for k in range(3)] == [1000.0] * 3
    more = layer.geotech_layer(cube, dry, vp="vp", rho="rho", create=("vp", "rho")).where("ix = 0").orderBy("iz").collect()
    assert [r["vp"] for r in more] == pytest.approx([832.005, 2464.68, 2458.2], abs=0.1)
    assert [r["rho"] for r in more][:2] == pytest.approx([1091.95, 2082.08], abs=0.1)


def surface_cube(spark):
    """Value = depth below the old surface, which is at 2; z from -4 to 2."""
    return spark.createDataFrame([(0, 0, float(z), float(10 + z - 2)) for z in range(-4, 3)], "iy int, ix int, z double, v double")


@pytest.mark.parametrize(("method", "expected"), [("pull", {4: 10, 3: 9, 0: 6}), ("extend", {4: 10, 3: 10, 1: 10, 0: 10, -1: 9}), ("linear", {4: 8, 2: 9, 0: 10})])
def test_column_methods(spark, method, expected):
    old = columns.infer_surface(surface_cube(spark), ["v"]).select("iy", "ix", F.col("land_surface").alias("old"), F.lit(columns.LAND).alias("cls"), F.lit(4.0).alias("requested"))
    moved = columns.finish_surfaces(old, "replace")
    axis = Axis("z", -4.0, 1.0, 10)
    got = {int(r["z"]): r["v"] for r in columns.transform_columns(surface_cube(spark), moved, {"v": columns.Fill(air=-1.0, top=8.0)}, axis, "replace", method).collect()}
    assert got[5] == -1 and {z: got[z] for z in expected} == {z: pytest.approx(v) for z, v in expected.items()}


def test_missing_request_is_an_error(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 1, None)], "iy int, ix int, old double, cls int, requested double")
    with pytest.raises(Exception, match="no requested surface"):
        columns.finish_surfaces(df, "add").collect()


def test_random_numbers():
    assert noise.raw(42, 4).tolist() == [6255019084209693600, 14430073426741505498, 14575455857230217846, 17414512882241728735]
    assert noise.gaussians(42, 4) == pytest.approx([0.296033015087, -1.440615086681, 0.644377979445, -0.236378439564], abs=1e-11)
    assert noise.field_seed(42, "vp", True) == 4189447965118319750 and noise.field_seed(42, "vs", True) == 4189444666583435193


@pytest.mark.parametrize("model", "vgew")
@pytest.mark.parametrize("dims", [1, 2, 3])
def test_random_fields(model, dims):
    stats = heterogeneity.Statistics(0.05, (4.0,), 0.2, model)
    a = heterogeneity.realise([8] * dims, [1.0] * dims, [4] * dims, stats, 7)
    assert a.mean() == pytest.approx(0, abs=1e-12) and a.std(ddof=1) == pytest.approx(0.05)
    assert np.array_equal(a, heterogeneity.realise([8] * dims, [1.0] * dims, [4] * dims, stats, 7))


def test_random_field_frame(spark):
    lattice = Lattice((Axis("y", 0, 1, 6), Axis("x", 0, 1, 8)))
    stats = heterogeneity.resolve(["vp", "vs"], {"sigma": 0.1, "lengths": (3.0,)}, {"vs": {"sigma": 0.2}})
    got = heterogeneity.heterogeneity(spark, lattice, stats, 5, support=supports.box_support(lattice, {})).toPandas()
    assert len(got) == 48 and got["taper"].between(0, 1).all() and np.allclose(got["vs_heterogeneity"], 2 * got["vp_heterogeneity"])
    with pytest.raises(ValueError):
        heterogeneity.resolve(["vp"], {"sigma": 0.1, "lengths": (1.0,)}, {"rho": {}})


def test_text_tables(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("# head\n0 1 2\n1 nan -9 # end\n2 3 4\n")
    assert [tuple(r) for r in text.read_table(spark, str(p), sentinel=-9).orderBy("x").collect()] == [(0, 1, 2), (1, None, None), (2, 3, 4)]
    text.write_table(text.read_table(spark, str(p)), "x", str(tmp_path / "o.txt"))
    assert (tmp_path / "o.txt").read_text().splitlines()[1] == "1 NaN -9"
    p.write_text("0 1\n0 2\n")
    with pytest.raises(ValueError):
        text.read_table(spark, str(p))
    assert text.is_merge_file(["# c", "a.nc b.nc"]) and not text.is_merge_file(["0 1"])
    with pytest.raises(ValueError):
        text.check_output("a.nc", ["./a.nc?z"])


def test_netcdf_round_trip(spark, tmp_path):
    cdl = """netcdf a { dimensions: z = 2 ; y = 2 ; x = 2 ;
    variables: double z(z) ; z:axis = "Z" ; double y(y) ; y:axis = "Y" ; double x(x) ; x:axis = "X" ; x:units = "m" ;
    float v(y, x, z) ; v:_FillValue = -9999.f ; v:units = "m/s" ; v:scale_factor = 2.f ;
    data: z = 0, 1 ; y = 1, 0 ; x = 0, 5 ; v = 1, 2, 3, 4, 5, 6, _, 8 ; }"""
    path = str(tmp_path / "a.nc")
    netcdf.write_classic(netcdf.parse_cdl(cdl), path)
    frame = netcdf.read_grid(spark, f"{path}?v+x2+v10")
    got = {(r["iz"], r["iy"], r["ix"]): r["v"] for r in frame.df.collect()}
    assert got[0, 1, 0] == 20 and got[1, 1, 1] == 80 and got[0, 0, 1] is None and frame.lattice.axis("x").hi == 10
    netcdf.write_grid(frame, str(tmp_path / "b.nc"))
    again = netcdf.read_grid(spark, f"{tmp_path / 'b.nc'}?v")
    assert sorted(map(tuple, again.df.collect()), key=str) == sorted(map(tuple, frame.df.collect()), key=str)


def test_geometry(spark):
    from gridloom.operators import geometry

    a, b, c = Axis("x", 0, 0.5, 11), Axis("x", 2, 0.5, 11), Axis("x", 0.1, 0.5, 11)
    assert geometry.co_registered(a, b) and not geometry.co_registered(a, c) and not geometry.co_registered(a, Axis("x", 0, 0.6, 5))
    whole = geometry.union_lattice([Lattice((a,)), Lattice((b,))])
    assert (whole.axes[0].lo, whole.axes[0].hi) == (0, 7)
    moved = geometry.on_lattice(Lattice((b,)).nodes(spark).select("ix"), Lattice((b,)), Lattice((a,)))
    assert sorted(r["ix"] for r in moved.collect()) == list(range(4, 11))
    with pytest.raises(ValueError):
        geometry.union_lattice([Lattice((a,)), Lattice((Axis("x", 0, 1, 5),))])
    tiles = {"west": Lattice((Axis("x", -180, 1, 11),)), "east": Lattice((Axis("x", 100, 1, 11),))}
    region = Lattice((Axis("x", 175, 1, 11),))
    assert geometry.overlapping(tiles, region) == [] and geometry.overlapping(tiles, region, {"x": 360.0}) == ["west"]
    assert one(spark, geometry.wrapped(F.lit(2), -5, 360)) == 357
    df = spark.createDataFrame([(2.0, 3.0)], "vp double, rho double")
    si = geometry.to_si(df, ["vp"], ["rho"], 1000, 1000)
    assert tuple(si.first()) == (2000, 3000) and tuple(geometry.from_si(si, ["vp"], ["rho"], 1000, 1000).first()) == (2, 3)
