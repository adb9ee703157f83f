"""Text tables, merge files and polygons."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.transforms import number
from ..operators.supports import Taper
from ..functions import windows


def read_table(spark: SparkSession, path: str, names: list[str] | None = None, sentinel: float | None = None) -> DataFrame:
    """A table of numbers: x, and fields z or z1, z2, ... (or names); missing values are null.

    Comments start with #. Each row is split by Spark; all must have as many columns, and x must be finite and increase.
    """
    rows = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
    parts = rows.select(F.split("line", r"[\s,]+").alias("p"))
    counts = parts.agg(F.min(F.size("p")), F.max(F.size("p")), F.count(F.lit(1))).first()
    if counts[2] < 2 or counts[0] != counts[1] or counts[0] < 2:
        raise ValueError("a table needs two rows at least, and two columns or more that are the same in all rows")
    n = counts[0] - 1
    names = names or (["z"] if n == 1 else [f"z{i + 1}" for i in range(n)])
    if len(names) != n:
        raise ValueError(f"{len(names)} names for {n} fields")

    def value(i):
        v = F.when(~F.lower(F.col("p")[i]).isin("nan", "inf", "-inf", "+inf"), F.col("p")[i]).cast("double")
        return F.when(v != F.lit(float(sentinel)), v) if sentinel is not None else v

    df = parts.select(value(0).alias("x"), *[value(i + 1).alias(f) for i, f in enumerate(names)])
    _check_increasing(df)
    return df


def _check_increasing(df: DataFrame) -> None:
    """Within each partition of the scan by its own rows; then the partitions' ends, which are as few as the partitions."""
    placed = df.select("x", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    before = F.lag("x").over(Window.partitionBy("part").orderBy("at"))
    placed = placed.withColumn("bad", F.col("x").isNull() | F.coalesce(before >= F.col("x"), F.lit(False)))
    ends = placed.groupBy("part").agg(F.min_by("x", "at").alias("first"), F.max_by("x", "at").alias("last"), F.max("bad").alias("bad")).orderBy("part").collect()
    if any(e["bad"] for e in ends) or any(a["last"] >= b["first"] for a, b in zip(ends, ends[1:], strict=False)):
        raise ValueError("coordinates must be finite and increase from row to row")


def write_table(df: DataFrame, order: str, path: str, digits: int = 12, sep: str = " ") -> None:
    """Rows in order, %.<digits>g; missing is NaN. Rows come to the driver one partition at a time."""
    with open(path, "w") as out:
        for row in df.orderBy(order).toLocalIterator():
            out.write(sep.join("NaN" if v is None else f"{v + 0.0:.{digits}g}" for v in row) + "\n")


@dataclass(frozen=True)
class Record:
    """A line of a merge file. In three dimensions the support is one of x and y, and levels are the ends along z."""

    primary: str
    secondary: str | None = None
    support: str | None = None
    tapers: tuple[Taper, ...] = (Taper(),)
    levels: tuple[float, float] | None = None


def read_records(lines: Iterable[str] | str, dims: int = 1) -> list[Record]:
    """primary [secondary] [support] [levels, if dims is 3] [window] [ratios]; - leaves a field out, # starts a comment. In order."""
    if isinstance(lines, str):
        lines = lines.splitlines()
    records = []
    for line in lines:
        parts = line.partition("#")[0].split()
        if not parts:
            continue
        most = 6 if dims == 3 else 5
        if len(parts) > most:
            raise ValueError(f"too many fields: {line}")
        primary, secondary, support, *levels, names, ratios = (p if p != "-" else None for p in parts + ["-"] * (most - len(parts)))
        if primary is None:
            raise ValueError("a record needs a primary source")
        shapes = [windows.canonical(n) for n in (names or "cosine").split("/")]
        if len(shapes) == 2 and dims == 3:
            shapes = [*shapes, shapes[0]]  # x, y and, as x, z
        if len(shapes) not in (1, dims):
            raise ValueError(f"1 or {dims} windows are needed: {names}")
        shapes = shapes * dims if len(shapes) == 1 else shapes
        records.append(Record(primary, secondary, support, tuple(Taper(w, lo, hi) for w, (lo, hi) in zip(shapes, windows.ratios(ratios, dims), strict=True)), interval(levels[0]) if levels and levels[0] else None))
    if not records:
        raise ValueError("no records")
    return records


def is_merge_file(first_lines: Iterable[str]) -> bool:
    """Whether a text is a merge file rather than a table: its first item is no number."""
    for line in first_lines:
        parts = line.partition("#")[0].split()
        if parts:
            try:
                float(parts[0])
                return False
            except ValueError:
                return parts[0].lower() != "nan"
    return False


def interval(text: str) -> tuple[float, float]:
    lo, _, hi = text.partition("/")
    lo, hi = number(lo), number(hi)
    if not lo < hi:
        raise ValueError(f"an interval goes upwards: {text}")
    return lo, hi


def read_polygon(lines: Iterable[str] | str) -> list[tuple[float, float]]:
    """x y a line; one closed or open ring of three points at least."""
    if isinstance(lines, str):
        lines = lines.splitlines()
    points = []
    for line in lines:
        parts = line.partition("#")[0].replace(",", " ").split()
        if parts and not parts[0].startswith(">"):
            points.append((float(parts[0]), float(parts[1])))
    if len(set(points)) < 3:
        raise ValueError("a polygon needs three points")
    return points


def write_polygon(points: list[tuple[float, float]], path: str) -> str:
    """Beside the original, as <stem>_monotone<ext>."""
    stem, ext = os.path.splitext(path)
    out = f"{stem}_monotone{ext}"
    with open(out, "w") as f:
        f.writelines(f"{x:.17g}\t{y:.17g}\n" for x, y in points)
    return out


def resolve(source: str, cache: str | None = None) -> str:
    """@name is looked up in the cache folder; a selector after ? stays."""
    if not source.startswith("@"):
        return source
    name, mark, selector = source[1:].partition("?")
    folder = cache or os.environ.get("GRIDLOOM_CACHE", os.path.expanduser("~/.gridloom/cache"))
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        raise FileNotFoundError(f"{name} is not in {folder}")
    return path + mark + selector


def check_output(output: str, inputs: Iterable[str]) -> None:
    """An output must not be one of the inputs."""
    if any(os.path.abspath(output) == os.path.abspath(i.partition("?")[0]) for i in inputs):
        raise ValueError("the output is also an input")
