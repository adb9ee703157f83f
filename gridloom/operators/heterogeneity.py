"""Correlated random fields on lattices, and their application to models.

White noise on a padded lattice is filtered in the wave-number domain, cropped, brought to zero mean and the wanted
deviation, and tapered. One realisation is one task: its memory is the padded lattice, as the transform needs it whole.
Several fields, seeds or members are rows of a small table and run side by side.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import noise
from ..plans.lattice import Lattice

MODELS = {"v": "von Karman", "g": "Gaussian", "e": "exponential", "w": "white"}


@dataclass(frozen=True)
class Statistics:
    """lengths: one for all axes, or those along x, y and z (as many as the lattice has), in this order."""

    sigma: float
    lengths: tuple[float, ...] = ()
    hurst: float = 0.15
    model: str = "v"

    def __post_init__(self):
        if self.model not in MODELS:
            raise ValueError(f"unknown model: {self.model}")
        if self.model != "w" and not self.lengths:
            raise ValueError("correlation lengths are needed, but for white noise")
        if not 0 < self.hurst < 1 or self.sigma < 0 or any(a <= 0 for a in self.lengths):
            raise ValueError("the Hurst exponent must be in (0, 1), sigma 0 or more, lengths positive")


def resolve(fields: list[str], default: dict, overrides: dict[str, dict]) -> dict[str, Statistics]:
    """Statistics of each field: the default ones, but for its overrides."""
    if extra := set(overrides) - set(fields):
        raise ValueError(f"statistics for fields that aren't selected: {sorted(extra)}")
    return {f: Statistics(**(default | overrides.get(f, {}))) for f in fields}


def amplitude(q2: np.ndarray, model: str, hurst: float, dims: int) -> np.ndarray:
    """Spectral amplitude of the squared wave number, scaled by the correlation lengths."""
    if model == "v":
        return (1 + q2) ** (-0.5 * (hurst + dims / 2))
    if model == "g":
        return np.exp(-q2 / 8)
    if model == "e":
        return (1 + q2) ** (-(dims + 1) / 4)
    return np.ones_like(q2)


def by_axis(lengths: tuple[float, ...], dims: int) -> tuple[float, ...]:
    """Lengths given from x on, in the order of a lattice's axes, the slowest first."""
    if len(lengths) not in (0, 1, dims):
        raise ValueError(f"one or {dims} correlation lengths are needed")
    return lengths[::-1] if len(lengths) == dims else (lengths or (0.0,)) * dims


def padding(lattice: Lattice, longest: tuple[float, ...], factor: float = 1.0) -> list[int]:
    return [math.ceil(factor * a / abs(axis.inc)) if a else 0 for a, axis in zip(longest, lattice.axes, strict=True)]


def realise(shape: list[int], incs: list[float], pads: list[int], stats: Statistics, seed: int) -> np.ndarray:
    """A field on the lattice (slowest axis first), in float32 as noise goes in and comes out of the transform."""
    full = [n + 2 * p for n, p in zip(shape, pads, strict=True)]
    white = noise.gaussians(seed, math.prod(full)).astype(np.float32).reshape(full)
    lengths = by_axis(stats.lengths, len(shape))
    q2 = np.zeros(full)
    for d, (n, inc, a) in enumerate(zip(full, incs, lengths, strict=True)):
        k = 2 * np.pi * np.fft.fftfreq(n, inc)
        q2 += ((a * k) ** 2).reshape([-1 if i == d else 1 for i in range(len(full))])
    gain = amplitude(q2, stats.model, stats.hurst, len(shape))
    gain.flat[0] = 0.0
    out = np.fft.ifftn(np.fft.fftn(white) * gain).real
    out = out[tuple(slice(p, p + n) for p, n in zip(pads, shape, strict=True))]
    out = out - out.mean()
    spread = out.std(ddof=1)
    return out * (stats.sigma / spread) if spread > 0 else out


def heterogeneity(spark: SparkSession, lattice: Lattice, stats: dict[str, Statistics], seed: int = 1, independent: bool = False, factor: float = 1.0, support=None) -> DataFrame:
    """Node indices, <field>_heterogeneity and, with a support, taper. Values are tapered after their deviation was set."""
    dims = len(lattice.axes)
    per = {f: by_axis(s.lengths, dims) for f, s in stats.items()}
    pads = padding(lattice, tuple(max(a) for a in zip(*per.values(), strict=True)), factor)
    shape, incs = [a.n for a in lattice.axes], [abs(a.inc) for a in lattice.axes]
    keys = lattice.keys
    jobs = [(f, str(noise.field_seed(seed, f, independent))) for f in stats]

    def run(batches):
        for pdf in batches:
            for f, s in zip(pdf["field"], pdf["seed"], strict=True):
                v = realise(shape, incs, pads, stats[f], int(s))
                at = np.indices(shape, np.int32).reshape(dims, -1)
                for lo in range(0, v.size, 1 << 18):
                    part = slice(lo, lo + (1 << 18))
                    yield pd.DataFrame({k: at[d][part] for d, k in enumerate(keys)} | {"field": f, "v": v.ravel()[part].astype(float)})

    long = spark.createDataFrame(jobs, "field string, seed string").repartition(len(jobs), "field").mapInPandas(run, ", ".join(f"{k} int" for k in keys) + ", field string, v double")
    out = long.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == f, F.col("v"))).alias(f"{f}_heterogeneity") for f in stats])
    if support is None:
        return out
    out = out.withColumn("taper", F.coalesce(support.weight(), F.lit(0.0)))
    return out.withColumns({f"{f}_heterogeneity": F.col(f"{f}_heterogeneity") * F.col("taper") for f in stats})


def apply_heterogeneity(model: DataFrame, field: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """m (1 + e) where the model has a value; nodes without a random value stay as they are."""
    both = model.join(field.select(*keys, *[F.col(f"{n}_heterogeneity").alias(f"__{n}") for n in names]), keys, "left")
    return both.withColumns({n: F.col(n) * (1 + F.coalesce(f"__{n}", F.lit(0.0))) for n in names}).drop(*[f"__{n}" for n in names])


def count_nonpositive(df: DataFrame, names: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(n) <= 0).alias(n) for n in names])
