"""Whole runs: merges of planes and cubes, topography, near-surface layers, and perturbation of models.

A run takes GridFrames, brings them onto one lattice (hole fill, then vertical and horizontal resampling in the order of
the run), applies its operator and returns a GridFrame, beside which topography and layers return a frame of
diagnostics. Nothing is computed before a result is read, but for axes that are worked out from the data.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import columns, geotech, heterogeneity, holes, resample
from ..operators.geometry import co_registered, from_si, on_lattice, to_si
from ..operators.supports import Support, box_support, perturbation_support, plane_support, polygon_support
from ..sources.text import Record, interval
from .gridframe import GridFrame
from .lattice import Axis, Lattice
from .merging import Placed, merge_rows, relation

PLANE = ("y", "x")


@dataclass(frozen=True)
class Steps:
    """How sources are brought onto a lattice. holes: a method of holes.fill_holes, with its argument and largest span."""

    holes: str | None = None
    hole_argument: float | None = None
    hole_span: int | None = None
    horizontal: str = "b"
    threshold: float = 0.5
    vertical: str = "l"
    bridge: bool | float = False
    smooth: float = 0.0


def _plane(lattice: Lattice) -> Lattice:
    return Lattice(tuple(lattice.axis(n) for n in PLANE))


def with_coordinates(grid: GridFrame, *names: str) -> DataFrame:
    """The frame and the coordinates of its nodes."""
    return grid.df.withColumns({n: grid.lattice.axis(n).coordinate() for n in names or [a.name for a in grid.lattice.axes]})


def filled(grid: GridFrame, steps: Steps) -> GridFrame:
    """Holes of each layer filled. Their axes have to be regular."""
    if not steps.holes:
        return grid
    y, x = (grid.lattice.axis(n) for n in PLANE)
    if not (x.regular and y.regular):
        raise ValueError("holes are filled on regular axes only")
    layer = [k for k in grid.keys if k not in ("iy", "ix")]
    df = holes.fill_holes(grid.df, list(grid.fields), y.n, x.n, abs(y.inc), abs(x.inc), layer, steps.holes, steps.hole_argument, steps.hole_span)
    return grid.with_df(df)


def onto_plane(grid: GridFrame, target: Lattice, steps: Steps) -> GridFrame:
    """Planes onto another plane: by shifting indices where nodes fall on nodes, else by interpolation."""
    source, target = _plane(grid.lattice), _plane(target)
    layer = [k for k in grid.keys if k not in ("iy", "ix")]
    if all(co_registered(a, b) for a, b in zip(target.axes, source.axes, strict=True)):
        df = on_lattice(grid.df.select(*grid.keys, *grid.fields), source, target)
    else:
        df = resample.horizontal(grid.df, source, target, list(grid.fields), steps.horizontal, layer, steps.threshold)
    axes = tuple(a for a in grid.lattice.axes if a.name not in PLANE) + target.axes
    return replace(grid, df=df, lattice=Lattice(axes))


def onto_levels(grid: GridFrame, target: Axis, steps: Steps) -> GridFrame:
    """Columns onto another vertical axis."""
    own = grid.lattice.axis("z")
    if own.same(target):
        return grid
    df = resample.vertical(with_coordinates(grid, "z"), "z", list(grid.fields), target, steps.vertical, steps.bridge, steps.smooth)
    return replace(grid, df=df.select("iz", "iy", "ix", *grid.fields), lattice=Lattice((target, *_plane(grid.lattice).axes)))


def onto(grid: GridFrame, target: Lattice, steps: Steps, vertical_first: bool = True) -> GridFrame:
    """Hole fill, then both resamplings."""
    grid = filled(grid, steps)
    if len(target.axes) == 2:
        return onto_plane(grid, target, steps)
    turns = [lambda g: onto_levels(g, target.axis("z"), steps), lambda g: onto_plane(g, target, steps)]
    for turn in turns if vertical_first else turns[::-1]:
        grid = turn(grid)
    return grid


def sample_surface(grid: GridFrame, lattice: Lattice, name: str, steps: Steps | None = None) -> DataFrame:
    """iy, ix and the first field of a plane at the columns of a lattice."""
    df = onto_plane(replace(grid, fields=grid.fields[:1]), lattice, steps or Steps()).df
    return df.select("iy", "ix", F.col(grid.fields[0]).alias(name))


# Merges ---------------------------------------------------------------------------------------------------------


def _support(record: Record, lattice: Lattice, domain: Lattice, polygons: dict, convert: str | None) -> Support:
    tapers = dict(zip("xyz", record.tapers * 3 if len(record.tapers) == 1 else record.tapers, strict=False))
    flat, x, y = len(lattice.axes) == 2, lattice.axis("x"), lattice.axis("y")
    if record.support in polygons:
        found = polygon_support(polygons[record.support], x, y, tapers, convert)
        if flat:  # a polygon in a plane reaches one node further on each side
            found = replace(found, box={n: (lo - 1, hi + 1) for n, (lo, hi) in found.box.items()}, rows=_wider(found.rows), cols=_wider(found.cols))
    else:
        ends = [e for n in "xy" for e in (domain.axis(n).lo, domain.axis(n).hi)]
        if record.support:
            parts = record.support.split("/")
            ends = [*interval("/".join(parts[:2])), *interval("/".join(parts[2:]))]
        found = plane_support(x, y, tuple(ends), tapers)
    if flat:
        return found
    levels = record.levels or (domain.axis("z").lo, domain.axis("z").hi)
    return replace(found, box=found.box | {"z": box_support(lattice, {"z": levels}).box["z"]})


def _wider(spans: dict[int, tuple[int, int]]) -> dict[int, tuple[int, int]]:
    wide = {k: (a - 1, b + 1) for k, (a, b) in spans.items()}
    return {min(spans) - 1: wide[min(spans)], max(spans) + 1: wide[max(spans)]} | wide


def merge_grids(
    spark: SparkSession, records: list[Record] | list[str], sources: dict[str, GridFrame], lattice: Lattice, names: list[str] | None = None, mode: str = "blend", steps: Steps | None = None,
    polygons: dict[str, list[tuple[float, float]]] | None = None, convert: str | None = None, **options,
) -> GridFrame:
    """Planes or cubes by name, each on a lattice of its own, merged on one lattice.

    records: of a merge file, or just names in order, whose first values count (mode clobber). Sources match by the
    position of their fields. A source is prepared once, however often it is named; one that doesn't meet the lattice is
    left out. options: those of merge_rows. Cubes are resampled vertically first.
    """
    steps, polygons = steps or Steps(), polygons or {}
    if records and isinstance(records[0], str):
        records, mode = [Record(r) for r in records], "clobber"
    first = sources[records[0].primary]
    names = list(names or first.fields)
    dialect = "grid" if len(lattice.axes) == 2 else "cube"
    ready: dict[str, tuple[DataFrame, dict, bool]] = {}

    def place(name: str):
        if name not in ready:
            grid = sources[name]
            if len(grid.fields) != len(names):
                raise ValueError(f"{name} has {len(grid.fields)} fields, not {len(names)}")
            box = lattice.covered(grid.lattice)
            meets = all(lo <= hi for lo, hi in box.values())
            ready[name] = onto(grid.renamed(names), lattice, steps).df if meets else None, box, meets
        return ready[name]

    placed = []
    for r in records:
        df, box, meets = place(r.primary)
        if not meets:
            continue
        if r.secondary is None:
            placed.append(Placed(df, r.primary, F.lit(True), box=box))
            continue
        weight = _support(r, lattice, sources[r.primary].lattice, polygons, convert).weight()
        other, _, also = place(r.secondary)
        empty = other if also else df.limit(0)
        placed.append(Placed(df, r.primary, F.lit(True), empty, r.secondary, weight, box))
    if not placed:
        raise ValueError("no source meets the lattice")
    got = merge_rows(relation(spark, lattice, placed, names), lattice, names, mode, dialect=dialect, **options)
    grids = [sources[r.primary] for r in records] + [sources[r.secondary] for r in records if r.secondary]
    units = {n: u for k, n in enumerate(names) if len(every := {g.units.get(g.fields[k]) for g in grids}) == 1 and (u := every.pop())}
    fields = tuple(c for c in got.columns if c in names or c == "weight")
    return GridFrame(got.select(*lattice.keys, *fields), lattice, fields, units)


# Columns --------------------------------------------------------------------------------------------------------

#: Codes of the classes in diagnostics; 0 is unresolved.
CLASSES = {"land": columns.LAND, "wet": columns.WET}


def topography(
    model: GridFrame, surface: GridFrame | None = None, operation: str = "replace", method: str = "pull", old: GridFrame | None = None, mask: GridFrame | None = None, classify: str = "prior",
    water: dict[str, float | None] | None = None, tolerance: dict[str, float] | None = None, fills: dict[str, columns.Fill] | None = None, scope: str | None = None,
    plane: Lattice | None = None, levels: Axis | float | None = None, steps: Steps | None = None,
) -> tuple[GridFrame, DataFrame]:
    """A model (z upwards) moved to a new surface, and the diagnostics iy, ix, old, new, modify, class, conflict.

    classify: prior (the mask, then the model), model (the model, then the mask), land or wet (all columns). old: the
    surface that the model has, else it is inferred. levels: the axis to write, or its increment, from which the axis that
    holds all columns is worked out. Classes are 0 where a column is unresolved; such columns stay out of the model.
    """
    steps, fills = steps or Steps(), fills or {}
    if plane:
        model = onto_plane(filled(model, steps), plane, steps)
    elif steps.holes:
        model = filled(model, steps)
    cube, lattice, fields = with_coordinates(model, "z"), model.lattice, list(model.fields)
    found = columns.infer_surface(cube, fields, water, tolerance)
    none = F.lit(None).cast("double")
    for name, grid in (("mask", mask), ("given", old), ("requested", surface)):
        found = found.join(sample_surface(grid, lattice, name, replace(steps, horizontal="n") if name == "mask" else steps), columns.COLUMN, "left") if grid else found.withColumn(name, none)
    if classify in CLASSES:
        cls = F.lit(CLASSES[classify])
    else:
        cls = columns.resolve_class(None, F.col("model_class"), columns.prior_from_mask(F.col("mask")), classify == "model")
    found = found.withColumn("cls", cls)
    found = found.withColumn("old", F.coalesce("given", columns.old_surface(F.col("cls"))) if old else columns.old_surface(F.col("cls")))
    done = columns.finish_surfaces(found, operation, scope)
    if not isinstance(levels, Axis):
        ends = cube.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull()).groupBy(*columns.COLUMN).agg(F.min("z").alias("base"), F.max("z").alias("surface"))
        inc = levels or abs(lattice.axis("z").inc)
        r = columns.output_range(done, ends, inc).first()
        levels = Axis.sized("z", r["lo"], r["hi"], inc, lattice.axis("z").unit)
    got = columns.transform_columns(cube, done, {f: fills.get(f, columns.Fill()) for f in fields}, levels, operation, method, steps.bridge)
    out = Lattice((levels, *_plane(lattice).axes))
    report = done.select(*columns.COLUMN, "old", F.coalesce("new", "old").alias("new"), "modify", F.coalesce("cls", F.lit(0)).alias("class"), (F.col("land_conflict") | F.col("conflict")).alias("conflict"))
    return replace(model, df=got.select(*out.keys, *fields), lattice=out), report


def near_surface(
    model: GridFrame, vs30: GridFrame, vp: str | None = None, vs: str | None = "vs", rho: str | None = None, create: tuple[str, ...] = (), mask: GridFrame | None = None, thickness: GridFrame | float = geotech.DEPTH,
    evidence: str | None = None, water: float | None = None, velocity: float = 1.0, density: float = 1.0, plane: Lattice | None = None, levels: Axis | None = None, steps: Steps | None = None,
) -> tuple[GridFrame, DataFrame]:
    """A model (z downwards, in metres) with a near-surface layer, and how many columns took it or were left out: reason, columns.

    A column is land by the mask; without one, by evidence: "vs30" (where it is positive) or the name of a field (its
    shallowest value), else all are. velocity, density: what the model's and Vs30's units are in m/s and kg/m3. Columns are
    resampled horizontally first. reason: layer, or why not.
    """
    steps = steps or Steps()
    lattice = Lattice((levels or model.lattice.axis("z"), *_plane(plane or model.lattice).axes))
    model = onto(model, lattice, steps, vertical_first=False)
    names = [n for n in (vp, vs) if n]
    have = [n for n in names if n not in create]
    df = to_si(with_coordinates(model, "z"), have, [rho] if rho and rho not in create else [], velocity, density)
    surfaces = sample_surface(vs30, lattice, "vs30", steps).withColumn("vs30", F.col("vs30") * F.lit(float(velocity)))
    surfaces = df.select(*columns.COLUMN).distinct().join(surfaces, columns.COLUMN, "left")
    if mask:
        marks = sample_surface(mask, lattice, "mask", replace(steps, horizontal="n"))
        surfaces = surfaces.join(marks, columns.COLUMN, "left").withColumn("land", columns.prior_from_mask(F.col("mask")) == columns.LAND).drop("mask")
    elif evidence == "vs30":
        surfaces = surfaces.withColumn("land", geotech.vs30_evidence(F.col("vs30")))
    elif evidence:
        surfaces = surfaces.join(geotech.column_evidence(df, evidence, water), columns.COLUMN, "left")
    else:
        surfaces = surfaces.withColumn("land", F.lit(True))
    depth = geotech.DEPTH
    if isinstance(thickness, GridFrame):
        surfaces = surfaces.join(sample_surface(thickness, lattice, "thickness", steps), columns.COLUMN, "left")
    else:
        depth = float(thickness)
    got = geotech.geotech_layer(df, surfaces, vp, vs, rho, depth, create)
    counts = geotech.prepare_columns(df, surfaces, vp if vp in have else None, vs if vs in have else None, depth)
    counts = counts.groupBy(F.coalesce("skip", F.lit("layer")).alias("reason")).agg(F.count(F.lit(1)).alias("columns"))
    fields = tuple(dict.fromkeys([*model.fields, *names, *([rho] if rho else [])]))
    got = from_si(got, names, [rho] if rho else [], velocity, density)
    return replace(model, df=got.select(*lattice.keys, *fields), fields=fields), counts


# Perturbation ---------------------------------------------------------------------------------------------------


def perturb(
    model: GridFrame, stats: dict[str, heterogeneity.Statistics], seed: int = 1, independent: bool = False, factor: float = 1.0, lattice: Lattice | None = None, ranges: dict[str, tuple[float, float]] | None = None,
    polygon: list[tuple[float, float]] | None = None, tapers: dict | None = None, convert: str | None = None, steps: Steps | None = None,
) -> tuple[GridFrame, DataFrame]:
    """A model with random fields of the named statistics put on, and how many values of each are not positive.

    The model is brought onto the lattice first, horizontally and then vertically. Fields without statistics stay.
    """
    steps = steps or Steps()
    lattice, names = lattice or model.lattice, [f for f in model.fields if f in stats]
    if extra := set(stats) - set(names):
        raise ValueError(f"statistics for fields that the model lacks: {sorted(extra)}")
    if len(lattice.axes) == 1:
        x = lattice.axis("x")
        if not model.lattice.axis("x").same(x):
            one = with_coordinates(model, "x").withColumn("one", F.lit(0))
            df = resample.resample(one, ["one"], "x", list(model.fields), x, steps.vertical, steps.bridge, steps.smooth, "ix").drop("one")
            model = replace(model, df=df, lattice=lattice)
    else:
        model = onto(model, lattice, steps, vertical_first=False)
    support = perturbation_support(lattice, ranges, polygon, tapers, convert) if ranges or polygon or tapers else None
    field = heterogeneity.heterogeneity(model.df.sparkSession, lattice, {n: stats[n] for n in names}, seed, independent, factor, support)
    got = heterogeneity.apply_heterogeneity(model.df, field, lattice.keys, names).select(*lattice.keys, *model.fields)
    return replace(model, df=got), heterogeneity.count_nonpositive(got, names)
