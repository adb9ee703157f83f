"""Resampling of series, columns and planes.

Samples along an axis form runs: consecutive nodes with values. Where samples have a node index, it tells which are
consecutive, so a node without a row is a gap like one whose value is null; without an index, every sample is a row.
Targets get values within a run only, never before its first or after its last sample. A gap may be bridged, up to a distance. Linear, nearest and step-up are expressions
over neighbouring samples, exploded onto the target indices they cover, so there is no join of samples with targets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import splines
from ..plans.lattice import EPS, Axis, Lattice

MODES = ("l", "n", "e", "a", "c", "s")


def _places(group: list[str], x: str, index: str | None) -> Column:
    """The numbers of samples along the axis: their node index, or else their rank."""
    return F.col(index) if index else F.row_number().over(Window.partitionBy(*group).orderBy(x))


def pieces(df: DataFrame, group: list[str], x: str, v: str, bridge: bool | float = False, index: str | None = None) -> DataFrame:
    """group, x0, v0, x1, v1 of successive samples in one run, and x1 = x0 for the last sample of a run.

    bridge: False, True or the largest distance between samples around a gap. index: the column of the node index.
    """
    given = df.select(*group, F.col(x).cast("double").alias("x0"), F.col(v).cast("double").alias("v0"), _places(group, x, index).alias("at"))
    given = given.where(F.col("v0").isNotNull() & ~F.isnan("v0") & (F.abs("v0") != float("inf")))
    # By coordinate: an axis may run against its index.
    order = Window.partitionBy(*group).orderBy("x0")
    step = given.withColumns({"x1": F.lead("x0").over(order), "v1": F.lead("v0").over(order), "next": F.lead("at").over(order)})
    joined = F.abs(F.col("next") - F.col("at")) == 1
    if bridge is True:
        joined = F.col("next").isNotNull()
    elif bridge:
        joined = joined | (F.col("x1") - F.col("x0") <= float(bridge))
    joined = F.coalesce(joined, F.lit(False))
    before = F.coalesce(F.lag(joined).over(order), F.lit(False))
    step = step.withColumns({"joined": joined, "alone": ~joined & ~before})
    return step.select(*group, "x0", "v0", F.when(F.col("joined"), F.col("x1")).otherwise(F.col("x0")).alias("x1"), F.when(F.col("joined"), F.col("v1")).otherwise(F.col("v0")).alias("v1"), "alone")


def run_numbers(df: DataFrame, group: list[str], x: str, v: str, bridge: bool | float = False, index: str | None = None) -> DataFrame:
    """df's samples with values, and the number of the run each is in, from 0."""
    order = Window.partitionBy(*group).orderBy(x)
    at = df.withColumn("__at", _places(group, x, index)).where(F.col(v).isNotNull() & ~F.isnan(v))
    gap = F.abs(F.col("__at") - F.lag("__at").over(order)) > 1
    far = F.lit(bridge is False) if isinstance(bridge, bool) else F.col(x) - F.lag(x).over(order) > float(bridge)
    new = at.withColumn("__new", F.coalesce((gap & far).cast("int"), F.lit(0)))
    return new.withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__at", "__new")


def _between(mode: str, x: Column) -> Column:
    x0, x1, v0, v1 = map(F.col, ("x0", "x1", "v0", "v1"))
    if mode == "l":
        return F.when(x1 > x0, v0 + (v1 - v0) * (x - x0) / (x1 - x0)).otherwise(v0)
    if mode == "n":
        return F.when(x - x0 <= x1 - x, v0).otherwise(v1)
    return v0  # step-up


def resample(df: DataFrame, group: list[str], x: str, fields: list[str], target: Axis, mode: str = "l", bridge: bool | float = False, smooth: float = 0.0, index: str | None = None) -> DataFrame:
    """group, the target's index, and fields at its nodes; nodes without a value have no row, or null where another field has one."""
    if mode not in MODES:
        raise ValueError(f"unknown interpolation: {mode}")
    if mode in "acs" or not target.regular:
        return _by_kernel(df, group, x, fields, target, mode, bridge, smooth, index)
    key, parts = target.key, []
    for k, f in enumerate(fields):
        p = pieces(df, group, x, f, bridge, index)
        first = F.greatest(F.ceil((F.col("x0") - target.lo) / target.inc - 1e-6), F.lit(0)).cast("int")
        last = F.least(F.floor((F.col("x1") - target.lo) / target.inc + 1e-6), F.lit(target.n - 1)).cast("int")
        p = p.withColumns({"first": first, "last": last}).where("first <= last")
        p = p.withColumn(key, F.explode(F.sequence("first", "last")))
        at = target.coordinate(F.col(key))
        near = 32 * EPS * F.greatest(F.lit(1.0), F.abs(at))
        # [x0, x1), so a shared sample is met once; the last sample of a run is a piece of its own.
        p = p.where(F.when(F.col("x1") > F.col("x0"), (at >= F.col("x0")) & (at < F.col("x1"))).when(F.col("alone"), F.abs(at - F.col("x0")) <= near).otherwise(at == F.col("x0")))
        parts.append(p.select(*group, key, F.lit(k).alias("k"), _between(mode, at).alias("v")))
    if len(parts) == 1:
        return parts[0].select(*group, key, F.col("v").alias(fields[0]))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy(*group, key).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f) for k, f in enumerate(fields)])


def _by_kernel(df, group, x, fields, target, mode, bridge, smooth, index) -> DataFrame:
    """One group of samples at a time in numpy: splines, and irregular targets."""
    to, key, names = np.array(target.values()), target.key, list(fields)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(x)
        if index:
            pdf = _with_gaps(pdf, index, x, names)
        out = {g: pdf[g].iloc[0] for g in group} | {key: np.arange(len(to), dtype=np.int32)}
        for f in names:
            out[f] = splines.sample(pdf[x].to_numpy(float), pdf[f].to_numpy(float, na_value=np.nan), to, mode, bridge, smooth)
        got = pd.DataFrame(out)
        return got[got[names].notna().any(axis=1)][[*group, key, *names]].astype({f: object for f in names}).where(lambda d: d.notna(), None)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group).schema] + [f"`{key}` int"] + [f"`{f}` double" for f in names]
    if not group:
        return df.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(lambda p: one(p), ", ".join(kinds))
    return df.groupBy(*group).applyInPandas(one, ", ".join(kinds))


def _with_gaps(pdf: pd.DataFrame, index: str, x: str, names: list[str]) -> pd.DataFrame:
    """A row without values in each gap of the index, halfway; the kernels know gaps by such rows."""
    at, z = pdf[index].to_numpy(), pdf[x].to_numpy(float)
    gap = np.flatnonzero(np.abs(np.diff(at)) > 1)
    if not len(gap):
        return pdf
    more = pdf.iloc[gap].copy()
    more[x] = (z[gap] + z[gap + 1]) / 2
    more[names] = np.nan
    return pd.concat([pdf, more]).sort_values(x)


def vertical(df: DataFrame, z: str, fields: list[str], target: Axis, mode: str = "l", bridge: bool | float = False, smooth: float = 0.0) -> DataFrame:
    """Every column of a cube once onto all new layers. df: iz, iy, ix, z, fields; without iz, a column's gaps are its rows without values."""
    return resample(df, ["iy", "ix"], z, fields, target, mode, bridge, smooth, "iz" if "iz" in df.columns else None)


def horizontal(df: DataFrame, source: Lattice, target: Lattice, fields: list[str], mode: str = "b", layer: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Planes onto another lattice (nearest n, bilinear l, bicubic c or b). df: layer, iy, ix, fields.

    n and l are expressions over the nodes around; a missing node counts out, and a target needs `threshold` of the
    weight to have values. c and b, and irregular axes, are done a plane at a time.
    """
    layer = layer or []
    sy, sx, ty, tx = source.axis("y"), source.axis("x"), target.axis("y"), target.axis("x")
    if mode in "nl" and sy.regular and sx.regular:
        return _around(df, sy, sx, target, fields, mode, layer, threshold)
    names, to_y, to_x = list(fields), np.array(ty.values()), np.array(tx.values())
    from_y, from_x = np.array(sy.values()), np.array(sx.values())
    regular = sy.regular and sx.regular

    def plane(pdf: pd.DataFrame) -> pd.DataFrame:
        iy, ix = np.meshgrid(np.arange(len(to_y), dtype=np.int32), np.arange(len(to_x), dtype=np.int32), indexing="ij")
        out = {c: pdf[c].iloc[0] for c in layer} | {"iy": iy.ravel(), "ix": ix.ravel()}
        for f in names:
            z = np.full((len(from_y), len(from_x)), np.nan)
            z[pdf["iy"], pdf["ix"]] = pdf[f].to_numpy(float, na_value=np.nan)
            got = splines.bicubic(from_y, from_x, z, to_y, to_x, threshold) if regular else splines.separable(from_y, from_x, z, to_y, to_x, "c" if mode in "cb" else mode)
            out[f] = got.ravel()
        got = pd.DataFrame(out)
        return got[got[names].notna().any(axis=1)].astype({f: object for f in names}).where(lambda d: d.notna(), None)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*layer).schema] if layer else []
    kinds += ["iy int", "ix int"] + [f"`{f}` double" for f in names]
    by = layer or ["__all"]
    df = df if layer else df.withColumn("__all", F.lit(1))
    return df.groupBy(*by).applyInPandas(plane, ", ".join(kinds))


def _around(df, sy, sx, target, fields, mode, layer, threshold) -> DataFrame:
    ty, tx = target.axis("y"), target.axis("x")
    nodes = target.nodes(df.sparkSession)
    eps = 1e-9
    for a, t in ((sy, ty), (sx, tx)):
        nodes = nodes.where(F.col(t.name).between(a.lo - eps * abs(a.inc), a.hi + eps * abs(a.inc)))
    place = lambda a: (F.col(a.name) - a.lo) / a.inc
    if mode == "n":
        near = nodes.withColumns({"sy": F.floor(place(sy) + 0.5).cast("int"), "sx": F.floor(place(sx) + 0.5).cast("int"), "w": F.lit(1.0)})
    else:
        corner = lambda a: F.least(F.greatest(F.floor(place(a) + eps), F.lit(0)), F.lit(a.n - 2)).cast("int")
        near = nodes.withColumns({"y0": corner(sy), "x0": corner(sx)})
        near = near.withColumns({"fy": place(sy) - F.col("y0"), "fx": place(sx) - F.col("x0")})
        near = near.withColumn("c", F.explode(F.array(*[F.struct((F.col("y0") + dy).alias("sy"), (F.col("x0") + dx).alias("sx"), ((F.col("fy") if dy else 1 - F.col("fy")) * (F.col("fx") if dx else 1 - F.col("fx"))).alias("w")) for dy in (0, 1) for dx in (0, 1)])))
        near = near.select("iy", "ix", "c.*").where("w > 1e-12")
    values = df.select(*layer, F.col("iy").alias("sy"), F.col("ix").alias("sx"), *fields)
    joined = near.join(values, ["sy", "sx"])
    sums = []
    for f in fields:
        w = F.sum(F.when(F.col(f).isNotNull(), F.col("w")))
        sums.append(F.when(w >= threshold - eps, F.sum(F.col("w") * F.col(f)) / w).alias(f))
    return joined.groupBy(*layer, "iy", "ix").agg(*sums).where(F.coalesce(*[F.col(f) for f in fields]).isNotNull())


def nearest_level(z_values: DataFrame, wanted: float, index: str = "iz", z: str = "z") -> DataFrame:
    """The index of the level closest to a coordinate, the first of several."""
    gap = F.abs(F.col(z) - F.lit(float(wanted)))
    return z_values.agg(F.min_by(index, F.struct(gap, F.col(index))).alias(index))
