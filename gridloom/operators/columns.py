"""Surfaces of vertical columns: classification, inference, and the shift of a model to a new surface.

Cubes are long frames iz, iy, ix, z, <fields> with z upwards; surfaces are frames iy, ix, <value> joined on (iy, ix).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lattice import EPS, Axis
from .resample import pieces

COLUMN = ["iy", "ix"]
LAND, WET = 1, 2


def prior_from_mask(mask: Column) -> Column:
    """1 for land, 2 for wet, null where the mask has no value."""
    return F.when(mask >= 0.5, LAND).when(mask < 0.5, WET)


def prior_from_level(level: Column) -> Column:
    """Levels 0, 2, 4 are wet; 1, 3 land; others unresolved."""
    return F.when(F.round(level).isin(0.0, 2.0, 4.0), WET).when(F.round(level).isin(1.0, 3.0), LAND)


def is_water(v: Column, water: float | None, tolerance: float | None = None) -> Column:
    """The signature of water in a field: missing if water is None, else a value within the tolerance."""
    if water is None:
        return v.isNull()
    within = max(1e-6, 1e-4 * abs(water)) if tolerance is None else tolerance
    return F.coalesce(F.abs(v - F.lit(float(water))) <= within, F.lit(False))


def dense(cube: DataFrame, fields: list[str]) -> DataFrame:
    """cube with a row for each level of each of its columns: a node without a row becomes one without values."""
    if "iz" not in cube.columns:
        return cube
    # The levels are those of the axis, so they are as few as its nodes.
    levels = [F.struct(F.lit(r["iz"]).alias("iz"), F.lit(r["z"]).alias("z")) for r in cube.select("iz", "z").distinct().orderBy("iz").collect()]
    if not levels:
        return cube
    every = cube.select(*COLUMN).distinct().withColumn("level", F.explode(F.array(*levels))).select(*COLUMN, "level.*")
    return every.join(cube.drop("z"), [*COLUMN, "iz"], "left")


def infer_surface(cube: DataFrame, fields: list[str], water: dict[str, float | None] | None = None, tolerance: dict[str, float] | None = None) -> DataFrame:
    """iy, ix, land_surface, water_surface, model_class, land_conflict, conflict.

    Land: the highest z with a value, over all fields; land_conflict: fields have different ones. Water, by fields with a
    signature: the first node at or below 0 has it; going down, the first node that hasn't it and has a value. conflict:
    fields have different ones, or the signature ends in a node without a value, or not at all. A node without a row
    counts as one without values, if the cube has its node index iz.
    """
    water, tolerance = water or {}, tolerance or {}
    most = lambda cols: F.greatest(*cols) if len(cols) > 1 else cols[0]
    least = lambda cols: F.least(*cols) if len(cols) > 1 else cols[0]
    none = F.lit(None).cast("double")
    below = dense(cube, fields) if water else cube
    down = Window.partitionBy(*COLUMN).orderBy(F.desc("z"))
    aggs = [F.max(F.when(F.col(f).isNotNull(), F.col("z"))).alias(f"__land_{f}") for f in fields]
    for f in water:
        wet = is_water(F.col(f), water[f], tolerance.get(f))
        # The run of water starts at the first node at or below 0 and is over for good where the signature ends.
        broken = F.sum(F.when((F.col("z") <= 0) & ~wet, 1).otherwise(0)).over(down.rowsBetween(Window.unboundedPreceding, 0))
        below = below.withColumn(f"__broken_{f}", broken)
        begun = F.coalesce(F.max(F.when((F.col("z") <= 0) & (F.col(f"__broken_{f}") == 0), 1)) == 1, F.lit(False))
        end = F.max_by(F.struct("z", F.col(f).isNotNull().alias("has")), F.when((F.col("z") <= 0) & (F.col(f"__broken_{f}") == 1) & ~wet, F.col("z")))
        aggs += [F.when(begun & end["has"], end["z"]).alias(f"__water_{f}"), (begun & ~F.coalesce(end["has"], F.lit(False))).alias(f"__open_{f}")]
    out = below.groupBy(*COLUMN).agg(*aggs)
    lands, marks = [F.col(f"__land_{f}") for f in fields], [F.col(f"__water_{f}") for f in water]
    land, deepest, highest = most(lands), least(marks) if marks else none, most(marks) if marks else none
    conflict = F.coalesce(deepest < highest, F.lit(False))
    for f in water:
        conflict = conflict | F.col(f"__open_{f}")
    model = F.when(highest.isNotNull(), WET).when(land.isNotNull(), LAND)
    return out.select(*COLUMN, land.alias("land_surface"), highest.alias("water_surface"), model.alias("model_class"), F.coalesce(least(lands) < land, F.lit(False)).alias("land_conflict"), conflict.alias("conflict"))


def resolve_class(authority: Column | None, model: Column, prior: Column, prefer_model: bool = False) -> Column:
    order = ([authority] if authority is not None else []) + ([model, prior] if prefer_model else [prior, model])
    return F.coalesce(*order)


def old_surface(cls: Column) -> Column:
    return F.when((cls == WET) & F.col("water_surface").isNotNull(), F.col("water_surface")).otherwise(F.col("land_surface"))


def finish_surfaces(columns: DataFrame, operation: str, scope: str | None = None) -> DataFrame:
    """columns: iy, ix, old, cls, requested. Adds new and modify. operation: add, remove or replace; scope: None, land or wet.

    Remove goes to 0. A missing request in a column to be modified is an error. Wet columns stay at or below 0.
    """
    in_scope = {None: F.lit(True), "land": F.col("cls") == LAND, "wet": F.col("cls") == WET}[scope]
    modify = F.coalesce(in_scope & F.col("old").isNotNull() & F.col("cls").isNotNull(), F.lit(False))
    wanted = F.lit(0.0) if operation == "remove" else F.when(F.col("requested").isNotNull(), F.col("requested")).otherwise(F.raise_error(F.lit("a column to be modified has no requested surface")).cast("double"))
    new = F.when((F.col("cls") == WET) & (wanted > 0), 0.0).otherwise(wanted)
    return columns.withColumn("modify", modify).withColumn("new", F.when(modify, new))


@dataclass(frozen=True)
class Fill:
    """What a field holds above its surface, in water, and at a linear column's top."""

    air: float | None = None
    water: float | None = None
    top: float | None = None


def output_range(columns: DataFrame, bounds: DataFrame, inc: float) -> DataFrame:
    """lo, hi of an axis that holds all shifted columns, outwards to whole increments. bounds: iy, ix, base, surface."""
    joined = columns.join(bounds, COLUMN)
    shift = F.when(F.col("modify"), F.col("new") - F.col("old")).otherwise(0.0)
    lo, hi = F.min(F.col("base") + shift), F.max(F.col("surface") + shift)
    return joined.agg((F.floor(lo / inc) * inc).alias("lo"), (F.ceil(hi / inc) * inc).alias("hi"))


def source_depth(operation: str, method: str) -> Column:
    """Where in the old model the value of a node comes from (null: not from the model). Columns z, old, new, cls, modify."""
    z, old, new = F.col("z"), F.col("old"), F.col("new")
    above = z > old + 1024 * EPS * F.greatest(F.lit(1.0), F.abs(old))
    stay = F.when(~above, z)
    pulled = F.when(z <= new, z - new + old)
    wet = F.when((z <= 0) & (z <= new), z - new + old)
    extended = F.when(z <= 0, z + old).when(z <= new, old)
    land = pulled if operation == "remove" or method == "pull" else F.when(new <= 0, pulled).otherwise(extended)
    return F.when(~F.col("modify"), stay).when(F.col("cls") == WET, wet).otherwise(land)


def transform_columns(cube: DataFrame, columns: DataFrame, fields: dict[str, Fill], target: Axis, operation: str = "replace", method: str = "pull", bridge: bool | float = False) -> DataFrame:
    """The model on the target axis with its new surface: iz, iy, ix, z, fields.

    cube: iy, ix, z, fields. columns: iy, ix, old, new, cls, modify. method: pull moves the column as it is; extend
    stretches land above 0 with the value at its old surface; linear goes from there to the field's top value.
    """
    nodes = columns.where("old IS NOT NULL AND cls IS NOT NULL").withColumn("iz", F.explode(F.sequence(F.lit(0), F.lit(target.n - 1))))
    nodes = nodes.withColumn("z", target.coordinate(F.col("iz"))).withColumn("from", source_depth(operation, method))
    near = lambda c: 32 * EPS * F.greatest(F.lit(1.0), F.abs(c))
    # Nodes and the starts of segments in one order along each column: the segment of a node is the last one before it.
    every = nodes.select(*COLUMN, F.col("from").alias("at"), F.lit(-1).alias("k"), F.struct("iz", "z", "from", "old", "new", "cls", "modify").alias("node"), F.lit(None).cast("struct<x0:double,v0:double,x1:double,v1:double>").alias("seg"))
    kind = every.schema["node"].dataType
    for k, f in enumerate(fields):
        seg = pieces(cube, COLUMN, "z", f, bridge, "iz" if "iz" in cube.columns else None)
        every = every.union(seg.select(*COLUMN, F.col("x0") - near("x0"), F.lit(k), F.lit(None).cast(kind), F.struct("x0", "v0", "x1", "v1")))
    order = Window.partitionBy(*COLUMN).orderBy("at", F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    for k, f in enumerate(fields):
        every = every.withColumn(f"__s{k}", F.last(F.when(F.col("k") == k, F.col("seg")), ignorenulls=True).over(order))
    out = every.where("k = -1").select(*COLUMN, "node.*", *[f"__s{k}" for k in range(len(fields))])
    for k, f in enumerate(fields):
        x0, v0, x1, v1 = (F.col(f"__s{k}.{c}") for c in ("x0", "v0", "x1", "v1"))
        value = F.when(x1 > x0, v0 + (v1 - v0) * (F.col("from") - x0) / (x1 - x0)).otherwise(v0)
        out = out.withColumn(f"__{f}", F.when(F.col("from") <= x1 + near("from"), value))
    cols = []
    for f, fill in fields.items():
        v, z, new = F.col(f"__{f}"), F.col("z"), F.col("new")
        air, water = F.lit(fill.air).cast("double"), F.lit(fill.water).cast("double")
        wet = F.when(z > 0, air).when((z > new) & F.lit(operation != "remove"), water).otherwise(v)
        land = F.when(z > new, air).otherwise(v)
        if method == "linear" and operation != "remove":
            if fill.top is None:
                raise ValueError(f"a linear column needs a top value of {f}")
            sloped = F.when((z > 0) & (z <= new) & (new > 0) & (v > fill.top), v + (F.lit(float(fill.top)) - v) * z / new).otherwise(v)
            land = F.when(z > new, air).otherwise(sloped)
        cols.append(F.when(~F.col("modify"), v).when(F.col("cls") == WET, wet).otherwise(land).alias(f))
    return out.select("iz", *COLUMN, "z", *cols)
