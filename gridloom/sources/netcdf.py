"""NetCDF classic (CDF-1, CDF-2) files and CDL text, and cubes made of their variables.

The format is read and written from its public description. Files hold a header and plain arrays. They are mapped into
memory, so the driver reads headers and axes only. Rows come by a Spark data source whose partitions are ranges along the
slowest axis; a task reads its own range. The sink writes a layer at a time. Paths have to be visible to all executors.
"""

from __future__ import annotations

import math
import mmap
import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.transforms import Transform, parse_source
from ..plans.lattice import Axis, Lattice
from .text import check_output

# Fixed values of the format: type number to numpy type.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
CDL_TYPES = {"byte": ">i1", "char": "S1", "short": ">i2", "int": ">i4", "long": ">i4", "float": ">f4", "real": ">f4", "double": ">f8"}
_NAMES = {"x": ("x", "lon", "longitude", "easting"), "y": ("y", "lat", "latitude", "northing"), "z": ("z", "depth", "elevation", "altitude", "level")}
_STANDARD = {"x": ("longitude", "projection_x"), "y": ("latitude", "projection_y"), "z": ("depth", "altitude", "height", "elevation")}


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    attrs: dict
    dtype: str
    data: np.ndarray


@dataclass
class Dataset:
    dims: dict[str, int] = field(default_factory=dict)
    variables: dict[str, Variable] = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)


def read_classic(path: str) -> Dataset:
    """Header and variables; their arrays are views of the mapped file, read when they are used."""
    with open(path, "rb") as f:
        raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    if raw[:3] != b"CDF" or raw[3] not in (1, 2):
        raise ValueError(f"{path} is not a classic NetCDF file")
    wide, at = raw[3] == 2, 4

    def integer() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">i", raw, at - 4)[0]

    def text() -> str:
        nonlocal at
        n = integer()
        at += -(-n // 4) * 4
        return raw[at - -(-n // 4) * 4 :][:n].decode()

    def attributes() -> dict:
        nonlocal at
        integer()
        out = {}
        for _ in range(integer()):
            name, kind, n = text(), integer(), integer()
            size = n * np.dtype(TYPES[kind]).itemsize
            value = raw[at : at + size].decode() if kind == 2 else np.frombuffer(raw, TYPES[kind], n, at)
            out[name] = value if kind == 2 else value[0].item() if n == 1 else value.tolist()
            at += -(-size // 4) * 4
        return out

    records = integer()
    integer()
    dims = []
    for _ in range(integer()):
        name = text()
        dims.append((name, integer()))
    attrs, heads = attributes(), []
    integer()
    for _ in range(integer()):
        name, ids = text(), []
        ids = [integer() for _ in range(integer())]
        own, kind, size = attributes(), integer(), integer()
        begin = struct.unpack_from(">q" if wide else ">i", raw, at)[0]
        at += 8 if wide else 4
        heads.append((name, ids, own, kind, size, begin))
    step = sum(h[4] for h in heads if h[1] and dims[h[1][0]][1] == 0)
    found = Dataset({n: s or records for n, s in dims}, {}, attrs)
    for name, ids, own, kind, size, begin in heads:
        shape, dtype = [dims[i][1] for i in ids], np.dtype(TYPES[kind])
        if ids and shape[0] == 0:
            n = int(np.prod(shape[1:], dtype=int))
            data = np.array([np.frombuffer(raw, dtype, n, begin + r * step) for r in range(records)]).reshape([records, *shape[1:]])
        else:
            data = np.frombuffer(raw, dtype, int(np.prod(shape, dtype=int)), begin).reshape(shape)
        found.variables[name] = Variable(name, tuple(dims[i][0] for i in ids), own, TYPES[kind], data)
    return found


def _header(data: Dataset) -> tuple[bytes, list[int]]:
    """The header of a file, and where each variable begins."""
    numbers = {v: k for k, v in TYPES.items()}

    def text(s: str) -> bytes:
        b = s.encode()
        return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)

    def attributes(a: dict) -> bytes:
        if not a:
            return struct.pack(">ii", 0, 0)
        out = struct.pack(">ii", 12, len(a))
        for k, v in a.items():
            if isinstance(v, str):
                kind, body, n = 2, v.encode(), len(v.encode())
            else:
                v = np.atleast_1d(v)
                kind = 4 if v.dtype.kind in "iu" else 6
                body, n = v.astype(TYPES[kind]).tobytes(), len(v)
            out += text(k) + struct.pack(">ii", kind, n) + body + b"\0" * (-len(body) % 4)
        return out

    names = list(data.dims)
    head = b"CDF\x02" + struct.pack(">i", 0)
    head += struct.pack(">ii", 10, len(names)) + b"".join(text(n) + struct.pack(">i", data.dims[n]) for n in names) if names else struct.pack(">ii", 0, 0)
    head += attributes(data.attrs)
    head += struct.pack(">ii", 11, len(data.variables)) if data.variables else struct.pack(">ii", 0, 0)
    sizes = [-(-math.prod(v.data.shape) * np.dtype(v.dtype).itemsize // 4) * 4 for v in data.variables.values()]
    # The size of a variable does not fit its place in the header if it is 4 GB or more; readers work it out from the shape.
    parts = [text(v.name) + struct.pack(">i", len(v.dims)) + b"".join(struct.pack(">i", names.index(d)) for d in v.dims) + attributes(v.attrs) + struct.pack(">iI", numbers[v.dtype], min(n, (1 << 32) - 1)) for v, n in zip(data.variables.values(), sizes, strict=True)]
    begins = [len(head) + sum(len(p) + 8 for p in parts)]
    for n in sizes:
        begins.append(begins[-1] + n)
    return head + b"".join(p + struct.pack(">q", at) for p, at in zip(parts, begins, strict=False)), begins


def write_classic(data: Dataset, path: str) -> None:
    head, begins = _header(data)
    with open(path, "wb") as f:
        f.write(head)
        for v, at in zip(data.variables.values(), begins, strict=False):
            f.seek(at)
            f.write(v.data.astype(v.dtype).tobytes())
        f.truncate(begins[-1])


def parse_cdl(text: str) -> Dataset:
    """The parts of CDL that fixtures use: dimensions, typed variables, attributes, data; _ is the fill value."""
    text = re.sub(r"//[^\n]*", "", text)
    out = Dataset()
    blocks = re.split(r"\b(dimensions|variables|data)\s*:", text)
    part = {blocks[i]: blocks[i + 1] for i in range(1, len(blocks) - 1, 2)}
    for name, size in re.findall(r"(\w+)\s*=\s*(\d+)", part.get("dimensions", "")):
        out.dims[name] = int(size)
    for s in re.findall(r'(?:[^;"]|"[^"]*")+;', part.get("variables", "")):
        s = s.strip()[:-1].strip()
        if m := re.match(r"(\w*):(\w+)\s*=\s*(.*)$", s, re.DOTALL):
            owner = out.variables[m[1]].attrs if m[1] else out.attrs
            owner[m[2]] = _cdl_value(m[3].strip())
        elif m := re.match(r"(\w+)\s+(\w+)\s*(?:\(([^)]*)\))?$", s):
            dims = tuple(d.strip() for d in (m[3] or "").split(",") if d.strip())
            out.variables[m[2]] = Variable(m[2], dims, {}, CDL_TYPES[m[1]], np.zeros(0))
    for m in re.finditer(r"(\w+)\s*=\s*([^;]*);", part.get("data", "")):
        v = out.variables[m[1]]
        fill = v.attrs.get("_FillValue", 9.969209968386869e36)
        values = [fill if x.strip() == "_" else float(x.strip().rstrip("fFsSbBdDlL") if not x.strip().lower().startswith(("nan", "inf", "-inf")) else x.strip().rstrip("fF") if not x.strip().lower().endswith("inf") else x.strip()) for x in m[2].split(",")]
        v.data = np.array(values, np.dtype(v.dtype)).reshape([out.dims[d] for d in v.dims])
    return out


def _cdl_value(text: str):
    if text.startswith('"'):
        return "".join(re.findall(r'"((?:[^"\\]|\\.)*)"', text))
    values = [float(x.strip().rstrip("fFsSbBdDlL")) for x in text.split(",")]
    return values[0] if len(values) == 1 else values


def axis_of(v: Variable) -> str | None:
    """x, y or z: by the axis attribute, then the standard name, then the variable's name."""
    if str(v.attrs.get("axis", "")).lower() in ("x", "y", "z"):
        return v.attrs["axis"].lower()
    standard = str(v.attrs.get("standard_name", "")).lower()
    for k, words in _STANDARD.items():
        if any(w in standard for w in words):
            return k
    return next((k for k, names in _NAMES.items() if v.name.lower() in names), None)


def unpacked(v: Variable, scale: float = 1.0, sentinel: float | None = None, data: np.ndarray | None = None) -> np.ndarray:
    """Doubles, NaN where the packed value is a missing one; of a part of the variable's data if it is given."""
    data = v.data if data is None else data
    gone = [v.attrs[k] for k in ("_FillValue", "missing_value") if k in v.attrs] + ([sentinel] if sentinel is not None else [])
    out = data.astype(float)
    packed = data.astype(np.dtype(v.dtype).newbyteorder("="))
    for g in gone:
        out[packed == np.array(g, packed.dtype)] = np.nan
    out = (out * float(v.attrs.get("scale_factor", 1.0)) + float(v.attrs.get("add_offset", 0.0))) * scale
    out[~np.isfinite(out)] = np.nan
    return out


@dataclass
class Layout:
    """How fields lie in a file: their lattice (slowest axis first), and the order and direction of their dimensions."""

    fields: tuple[str, ...]
    lattice: Lattice
    order: list[str]
    flips: list[bool]
    units: dict[str, str]

    def values(self, data: Dataset, transform: Transform, field: str, part: slice = slice(None)) -> np.ndarray:
        """A field in the lattice's order; part: of the slowest axis. Only that part of the file is read."""
        v = data.variables[field]
        a = np.transpose(v.data, [v.dims.index(d) for d in self.order])
        a = a[tuple(slice(None, None, -1) if flip else slice(None) for flip in self.flips)][part]
        return unpacked(v, transform.scale_of(self.fields.index(field), len(self.fields)), transform.sentinel, a)


def layout(data: Dataset, fields: tuple[str, ...] = (), transform: Transform | None = None) -> Layout:
    """Of the fields, by default the first one with axes."""
    transform = transform or Transform({}, {})
    axes = {n: k for n, v in data.variables.items() if v.dims == (n,) and (k := axis_of(v))}
    if not fields:
        first = next((n for n, v in data.variables.items() if v.dims and n not in axes and all(d in axes for d in v.dims)), None)
        if first is None:
            raise ValueError("there is no field on known axes")
        fields = (first,)
    dims = data.variables[fields[0]].dims
    if any(set(data.variables[f].dims) != set(dims) for f in fields):
        raise ValueError("fields of one source share their dimensions")
    order = sorted(dims, key=lambda d: "zyx".index(axes[d]))
    lattice, flips = [], []
    for d in order:
        v, name = data.variables[d], axes[d]
        coords = unpacked(v, transform.axis_scale.get(name, 1.0))
        flips.append(bool(name != "z" and len(coords) > 1 and coords[0] > coords[-1]))
        unit = transform.axis_unit.get(name) or (v.attrs.get("units") if transform.axis_scale.get(name, 1.0) == 1 else None)
        lattice.append(Axis.of(name, coords[::-1] if flips[-1] else coords, unit))
    units = {f: unit for i, f in enumerate(fields) if (unit := transform.unit_of(i, len(fields), data.variables[f].attrs.get("units")))}
    return Layout(tuple(fields), Lattice(tuple(lattice)), order, flips, units)


def open_fields(data: Dataset, fields: tuple[str, ...] = (), transform: Transform | None = None) -> tuple[Lattice, dict[str, np.ndarray], dict[str, str]]:
    """Lattice, whole arrays in its order, and units of the fields."""
    transform = transform or Transform({}, {})
    found = layout(data, fields, transform)
    return found.lattice, {f: found.values(data, transform, f) for f in found.fields}, found.units


class NetcdfSource(DataSource):
    """Rows of node indices and fields of path?fields+modifiers (option "path"); a partition has about "nodes" nodes."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_classic"

    def _opened(self):
        source = parse_source(self.options["path"])
        data = read_classic(source.path)
        return data, layout(data, source.fields, source.transform), source.transform

    def schema(self) -> str:
        found = self._opened()[1]
        return ", ".join([f"{k} int" for k in found.lattice.keys] + [f"`{f}` double" for f in found.fields])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: NetcdfSource):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        lattice = self.source._opened()[1].lattice
        n = lattice.axes[0].n
        step = max(1, int(self.source.options.get("nodes", 1 << 20)) * n // lattice.size)
        return [InputPartition((lo, min(lo + step, n))) for lo in range(0, n, step)]

    def read(self, partition: InputPartition):
        data, found, transform = self.source._opened()
        lo, hi = partition.value
        # A layer at a time, in pieces along its first axis if it is large.
        for layer in range(lo, hi):
            values = [found.values(data, transform, f, slice(layer, layer + 1)) for f in found.fields]
            at = np.indices(values[0].shape, np.int32).reshape(values[0].ndim, -1)
            at[0] += layer
            flat = [v.ravel() for v in values]
            for first in range(0, at.shape[1], 1 << 16):
                part = slice(first, first + (1 << 16))
                columns = [pa.array(a[part]) for a in at] + [pa.array(v[part], mask=np.isnan(v[part])) for v in flat]
                yield pa.RecordBatch.from_arrays(columns, names=[*found.lattice.keys, *found.fields])


def read_grid(spark: SparkSession, source: str, nodes: int = 1 << 20):
    """A GridFrame from path?fields+modifiers, with about `nodes` nodes in a partition."""
    from ..plans.gridframe import GridFrame

    s = parse_source(source)
    found = layout(read_classic(s.path), s.fields, s.transform)
    spark.dataSource.register(NetcdfSource)
    df = spark.read.format("netcdf_classic").option("path", source).option("nodes", str(nodes)).load()
    return GridFrame(df, found.lattice, found.fields, found.units)


def from_arrays(spark: SparkSession, lattice: Lattice, arrays: dict[str, np.ndarray]) -> DataFrame:
    """Rows of node indices and fields, NaN as null."""
    at = np.indices([a.n for a in lattice.axes], np.int32).reshape(len(lattice.axes), -1)
    pdf = pd.DataFrame({k: at[d] for d, k in enumerate(lattice.keys)})
    for f, a in arrays.items():
        pdf[f] = pd.array(a.ravel(), "Float64")
        pdf.loc[~np.isfinite(a.ravel()), f] = pd.NA
    rows = pdf.astype(object).where(pdf.notna(), None)
    kinds = ", ".join([f"{k} int" for k in lattice.keys] + [f"`{f}` double" for f in arrays])
    return spark.createDataFrame(rows.values.tolist(), kinds)


def write_grid(frame, path: str, float32: bool = True, extra: dict[str, Variable] | None = None, inputs: tuple[str, ...] = ()) -> None:
    """A GridFrame as a classic file: axes as doubles, fields as floats with NaN for null. The path must not be one of the inputs.

    Rows come sorted by the slowest axis, partition by partition; one layer of each field is held at a time.
    """
    check_output(path, inputs)
    lattice, dtype = frame.lattice, ">f4" if float32 else ">f8"
    shape, keys = [a.n for a in lattice.axes], lattice.keys
    data = Dataset({a.name: a.n for a in lattice.axes}, {}, {"Conventions": "CF-1.8", **frame.attributes})
    for a in lattice.axes:
        attrs = {"axis": a.name.upper()} | ({"units": a.unit} if a.unit else {})
        data.variables[a.name] = Variable(a.name, (a.name,), attrs, ">f8", np.array(a.values()))
    # Variables of the source that stay as they are, where all their dimensions are still there.
    more = {n: v for n, v in (extra or {}).items() if n not in data.variables and n not in frame.fields and all(data.dims.get(d) == s for d, s in zip(v.dims, v.data.shape, strict=True))}
    data.variables |= more
    for f in frame.fields:
        attrs = {"units": frame.units[f]} if f in frame.units else {}
        data.variables[f] = Variable(f, tuple(a.name for a in lattice.axes), attrs, dtype, np.broadcast_to(np.float32(0), shape))
    head, begins = _header(data)
    begin = dict(zip(data.variables, begins, strict=False))
    size = math.prod(shape[1:]) * np.dtype(dtype).itemsize
    with open(path, "wb") as out:
        out.write(head)
        for name, v in data.variables.items():
            if name not in frame.fields:
                out.seek(begin[name])
                out.write(v.data.astype(v.dtype).tobytes())
        out.truncate(begins[-1])

        def put(layer: int, arrays: list[np.ndarray]) -> None:
            for f, a in zip(frame.fields, arrays, strict=True):
                out.seek(begin[f] + layer * size)
                out.write(a.astype(dtype).tobytes())

        empty = lambda: [np.full(shape[1:], np.nan) for _ in frame.fields]
        at, arrays = 0, empty()
        for row in frame.df.select(*keys, *frame.fields).repartitionByRange(keys[0]).sortWithinPartitions(keys[0]).toLocalIterator():
            while at < row[0]:
                put(at, arrays)
                at, arrays = at + 1, empty()
            for a, v in zip(arrays, row[len(keys) :], strict=True):
                a[tuple(row[1 : len(keys)])] = np.nan if v is None else v
        for layer in range(at, shape[0]):
            put(layer, arrays if layer == at else empty())
