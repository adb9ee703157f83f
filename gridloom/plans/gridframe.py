"""A DataFrame on a lattice: index columns, field columns (null: missing), and metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lattice import Lattice


@dataclass(frozen=True)
class GridFrame:
    df: DataFrame
    lattice: Lattice
    fields: tuple[str, ...]
    units: dict[str, str] = field(default_factory=dict)
    attributes: dict[str, str] = field(default_factory=dict)

    @property
    def keys(self) -> list[str]:
        return self.lattice.keys

    def with_df(self, df: DataFrame, **changes) -> GridFrame:
        return replace(self, df=df, **changes)

    def renamed(self, names: list[str]) -> GridFrame:
        """Fields by position, as sources of a merge are matched."""
        if len(names) != len(self.fields) or len(set(names)) != len(names):
            raise ValueError("as many different names as fields are needed")
        df = self.df.select(*self.keys, *[F.col(a).alias(b) for a, b in zip(self.fields, names, strict=True)])
        units = {b: self.units[a] for a, b in zip(self.fields, names, strict=True) if a in self.units}
        return replace(self, df=df, fields=tuple(names), units=units)

    def to_columns(self) -> DataFrame:
        """One row for each (iy, ix), fields as arrays along z."""
        packed = [F.transform(F.array_sort(F.collect_list(F.struct("iz", F.col(f).alias("v")))), lambda s: s["v"]).alias(f) for f in self.fields]
        return self.df.groupBy("iy", "ix").agg(*packed)

    def full(self) -> DataFrame:
        """All nodes of the lattice; those without a row have null fields."""
        nodes = self.lattice.nodes(self.df.sparkSession)
        return nodes.join(self.df.select(*self.keys, *self.fields), self.keys, "left")
