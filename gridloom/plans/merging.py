"""From records and sampled sources to the relation that the merge operators take, and whole merges of series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge, resample
from ..operators.supports import interval_weight
from ..plans.lattice import EPS, Axis, Lattice
from ..sources.text import Record, interval


@dataclass(frozen=True)
class Placed:
    """A record whose sources are on the lattice: frames of node indices and fields, by position of the record."""

    primary: DataFrame
    prim: str
    domain: Column  # over node coordinates
    secondary: DataFrame | None = None
    sec: str | None = None
    weight: Column | None = None  # over node indices and coordinates; null outside the support
    box: dict[str, tuple[int, int]] | None = None  # first and last index by axis, around the domain


def relation(spark: SparkSession, lattice: Lattice, records: list[Placed], fields: list[str]) -> DataFrame:
    """A row for each record and node in its domain: rec, keys, p_<f>, s_<f>, w, pair, prim, sec.

    The nodes of a record are made from its box, so a tile costs what it covers, not the lattice.
    """
    keys, out = lattice.keys, None
    for rec, r in enumerate(records):
        nodes = lattice.nodes(spark, r.box).where(r.domain)
        rows = nodes.join(r.primary.select(*keys, *[F.col(f).alias(f"p_{f}") for f in fields]), keys, "left")
        if r.secondary is not None:
            rows = rows.join(r.secondary.select(*keys, *[F.col(f).alias(f"s_{f}") for f in fields]), keys, "left")
        else:
            rows = rows.withColumns({f"s_{f}": F.lit(None).cast("double") for f in fields})
        w = r.weight if r.weight is not None and r.secondary is not None else F.lit(None).cast("double")
        rows = rows.select(
            F.lit(rec).alias("rec"), *keys, *[f"p_{f}" for f in fields], *[f"s_{f}" for f in fields], w.cast("double").alias("w"),
            F.lit(r.secondary is not None).alias("pair"), F.lit(r.prim).alias("prim"), F.lit(r.sec).cast("string").alias("sec"),
        )
        out = rows if out is None else out.union(rows)
    return out


def merge_rows(rows: DataFrame, lattice: Lattice, fields: list[str], mode: str = "blend", how: str = "first", sign: str | None = None, pair_fill: bool = False, dialect: str = "series", weight: str = "none") -> DataFrame:
    """All nodes of the lattice with the merged fields. weight: none, append or only."""
    keys, spark = lattice.keys, rows.sparkSession
    if mode == "clobber":
        got = merge.clobber(rows, keys, fields, how, sign, dialect)
        weights, got = got.select(*keys, "weight"), got.drop("weight")
    elif mode == "aggregate":
        merge.validate_overlaps(rows, keys)
        got, weights = merge.aggregate(rows, keys, fields, pair_fill, dialect), merge.report_weight(rows, keys, True, dialect)
    elif mode == "blend":
        got, weights = merge.blend(rows, keys, fields, pair_fill), merge.report_weight(rows, keys, False, dialect)
    else:
        raise ValueError(f"unknown mode: {mode}")
    nodes = lattice.nodes(spark)
    if weight != "only":
        nodes = nodes.join(got, keys, "left")
    if weight != "none":
        nodes = nodes.join(weights, keys, "left")
        if dialect != "grid":
            nodes = nodes.fillna(0.0, ["weight"])
    return nodes


def merge_series(spark: SparkSession, records: list[Record], sources: dict[str, DataFrame], axis: Axis, fields: list[str], interpolation: str = "l", bridge: bool | float = False, smooth: float = 0.0, **options) -> DataFrame:
    """Series by name (x and fields, matched by position) onto an axis, merged. A source is sampled once, however often it is named."""
    lattice, sampled, ends = Lattice((axis,)), {}, {}

    def place(name: str):
        if name not in sampled:
            df = sources[name]
            if len(df.columns) - 1 != len(fields):
                raise ValueError(f"{name} has {len(df.columns) - 1} fields, not {len(fields)}")
            df = df.toDF("x", *fields)
            r = df.agg(F.min("x"), F.max("x")).first()
            ends[name] = (r[0], r[1])
            one = df.withColumn("one", F.lit(0))
            sampled[name] = resample.resample(one, ["one"], "x", fields, axis, interpolation, bridge, smooth).drop("one")
        return sampled[name], ends[name]

    placed = []
    for r in records:
        primary, (lo, hi) = place(r.primary)
        near = 32 * EPS * max(1.0, abs(lo), abs(hi))
        domain = F.col(axis.name).between(lo - near, hi + near)
        if r.secondary is None:
            placed.append(Placed(primary, r.primary, domain))
            continue
        west, east = interval(r.support) if r.support else (lo, hi)
        weight = interval_weight(F.col(axis.name), west, east, axis.inc, r.tapers[0], (lo, hi))
        placed.append(Placed(primary, r.primary, domain, place(r.secondary)[0], r.secondary, weight))
    return merge_rows(relation(spark, lattice, placed, fields), lattice, fields, **options)
