"""A near-surface layer of seismic velocities and density under dry columns. z is in metres, downwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geotech import brocher_vp, brocher_vs, ely_profile, nafe_drake
from ..plans.lattice import EPS
from .resample import pieces

COLUMN = ["iy", "ix"]
DEPTH = 350.0


def column_evidence(cube: DataFrame, field: str, water: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """iy, ix, land: by the shallowest value of a property. Above 0 land, below 0 wet, at 0 wet if it is the water's value."""
    top = F.min_by(F.struct("z", F.col(field).alias("v")), F.when(F.col(field).isNotNull(), F.col("z")))
    got = cube.groupBy(*COLUMN).agg(top.alias("t"))
    at_zero = F.abs(F.col("t.v") - F.lit(float(water))) > tolerance if water is not None else F.lit(True)
    land = F.when(F.col("t.z") < 0, True).when(F.col("t.z") > 0, False).when(F.col("t.z") == 0, at_zero)
    return got.select(*COLUMN, land.alias("land"))


def vs30_evidence(vs30: Column) -> Column:
    return F.coalesce(vs30 > 0, F.lit(False))


def value_at(cube: DataFrame, field: str, depths: DataFrame, at: str, name: str) -> DataFrame:
    """depths and the linear value of a field at column `at` of it, null outside its samples."""
    seg = pieces(cube, COLUMN, "z", field, index="iz" if "iz" in cube.columns else None).select(*[F.col(c).alias(f"__{c}") for c in COLUMN], "x0", "v0", "x1", "v1")
    on = [F.col(c) == F.col(f"__{c}") for c in COLUMN]
    near = 32 * EPS * F.greatest(F.lit(1.0), F.abs(at))
    on.append((F.col(at) >= F.col("x0") - near) & (F.col(at) <= F.col("x1") + near))
    value = F.when(F.col("x1") > F.col("x0"), F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col(at) - F.col("x0")) / (F.col("x1") - F.col("x0"))).otherwise(F.col("v0"))
    keep = [c for c in depths.columns if c not in COLUMN]
    return depths.join(seg, on, "left").groupBy(*COLUMN).agg(*[F.first(c).alias(c) for c in keep], F.min(value).alias(name))


def prepare_columns(cube: DataFrame, surfaces: DataFrame, vp: str | None, vs: str | None, depth: float = DEPTH) -> DataFrame:
    """surfaces: iy, ix, vs30, land, and thickness if it varies. One row a column: what the layer needs, and why it is left out.

    skip: wet, unclassified, vs30, thickness, surface, anchor or range; null where the layer goes in.
    """
    authority = vs or vp
    top = cube.groupBy(*COLUMN).agg(F.min(F.when(F.col(authority).isNotNull(), F.col("z"))).alias("surface"))
    if "thickness" not in surfaces.columns:
        surfaces = surfaces.withColumn("thickness", F.lit(float(depth)))
    thickness = F.when(F.col("thickness") > 0, F.col("thickness")).when(F.col("thickness").isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit("a thickness must be positive")).cast("double"))
    got = surfaces.withColumn("thickness", thickness).join(top, COLUMN, "left").withColumn("base", F.col("surface") + F.col("thickness"))
    none = F.lit(None).cast("double")
    got = value_at(cube, vs, got, "base", "vs_anchor") if vs else got.withColumn("vs_anchor", none)
    got = value_at(cube, vp, got, "base", "vp_anchor") if vp else got.withColumn("vp_anchor", none)
    got = got.withColumns({"vs_anchor": F.coalesce("vs_anchor", brocher_vs(F.col("vp_anchor"))), "vp_anchor": F.coalesce("vp_anchor", brocher_vp(F.col("vs_anchor")))})
    got = got.withColumn("vp30", brocher_vp(F.col("vs30")))
    skip = (
        F.when(F.col("land").isNull(), "unclassified").when(~F.col("land"), "wet").when(F.col("vs30").isNull() | (F.col("vs30") <= 0), "vs30").when(F.col("thickness").isNull(), "thickness").when(F.col("surface").isNull(), "surface")
        .when((F.col("vs_anchor") if vs else F.col("vp_anchor")).isNull(), "anchor").when(F.col("vp30").isNull() & F.lit(vp is not None), "range")
    )
    return got.withColumn("skip", skip)


def geotech_layer(cube: DataFrame, surfaces: DataFrame, vp: str | None = None, vs: str | None = "vs", rho: str | None = None, depth: float = DEPTH, create: tuple[str, ...] = ()) -> DataFrame:
    """cube with the layer in columns that take it. cube: iz, iy, ix, z, fields.

    create: fields that the model lacks; they are made from the others in all dry columns first.
    """
    if not vp and not vs:
        raise ValueError("vp or vs is needed")
    have_vp, have_vs = (n if n and n not in create else None for n in (vp, vs))
    columns = prepare_columns(cube, surfaces, have_vp, have_vs, depth)
    joined = cube.join(columns.select(*COLUMN, "surface", "thickness", "vs30", "vp30", "vs_anchor", "vp_anchor", "skip", "land"), COLUMN, "left")
    dry = F.coalesce(F.col("land"), F.lit(False))
    if vs in create:
        joined = joined.withColumn(vs, F.when(dry, brocher_vs(F.col(have_vp))))
    if vp in create:
        joined = joined.withColumn(vp, F.when(dry, brocher_vp(F.col(have_vs))))
    if rho in create:
        joined = joined.withColumn(rho, F.when(dry, nafe_drake(F.col(vp) if vp else brocher_vp(F.col(vs)))))
    q = (F.col("z") - F.col("surface")) / F.col("thickness")
    inside = F.coalesce(F.col("skip").isNull() & (q >= 0) & (q <= 1), F.lit(False))
    q = F.greatest(q, F.lit(0.0))
    changes, new_vp = {}, None
    if vs:
        changes[vs] = F.when(inside, ely_profile(q, F.col("vs30"), F.col("vs_anchor"))).otherwise(F.col(vs))
    new_vp = ely_profile(q, F.col("vp30"), F.col("vp_anchor"))
    if vp:
        changes[vp] = F.when(inside, new_vp).otherwise(F.col(vp))
    if rho:
        changes[rho] = F.when(inside, nafe_drake(new_vp)).otherwise(F.col(rho))
    fields = [c for c in cube.columns if c not in changes]
    return joined.withColumns(changes).select(*fields, *changes)
