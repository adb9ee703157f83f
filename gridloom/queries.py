"""Queries over the test tables, one or more for each operator, and the same in SQL where SQL can say it.

Lattices are made of the tables: hourly means of events by type are series on 720 hours; lineitem is a cube, with
discounts, taxes and quantities as axes and mean prices as values; part prices stand for velocities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geotech, transforms, windows
from .operators import columns, heterogeneity, holes, merge, resample, supports
from .operators import geotech as layer
from .plans import programs
from .plans.gridframe import GridFrame
from .plans.lattice import Axis, Lattice
from .plans.merging import Placed, relation
from .sources.text import Record

HOURS = Axis("x", 0.0, 1.0, 720)
_T0 = 1704067200  # 2024-01-01 UTC
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, n: int = 6):
    """Rounded, without a negative zero."""
    return F.round(c, n) + F.lit(0.0)


# Series ---------------------------------------------------------------------------------------------------------


def hourly(spark, sf_dir) -> DataFrame:
    """kind, ix, x, v: mean value of an hour in whole hundredths; a mean over 15 counts as missing."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    ix = F.floor(micros / 3.6e9).cast("int")
    mean = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), ix.alias("ix")).agg((F.floor(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count(F.lit(1))) / 100.0).alias("m"))
    return mean.select("kind", "ix", F.col("ix").cast("double").alias("x"), F.when(F.col("m") <= 15, F.col("m")).alias("v"))


_HOURLY = f"""hourly AS (SELECT kind, ix, CAST(ix AS DOUBLE) AS x, CASE WHEN m <= 15 THEN m END AS v FROM (
  SELECT event_type AS kind, CAST(floor((epoch_us(ts) / 1e6 - {_T0}) / 3600) AS INTEGER) AS ix, floor(sum(CAST(round(value * 100) AS BIGINT)) / count(*)) / 100.0 AS m FROM events GROUP BY 1, 2))"""


@_query(f"WITH {_HOURLY} SELECT * FROM hourly")
def series_scan_hourly(spark, sf_dir):
    return hourly(spark, sf_dir)


@_query(f"WITH {_HOURLY} SELECT kind, ix, -2.0 * x + 0.0 AS x, round(v / 4.0, 6) + 0.0 AS v FROM hourly")
def output_scale_negative_axis(spark, sf_dir):
    s = transforms.parse_modifiers("+x-2+v1/4")
    df = hourly(spark, sf_dir)
    return df.select("kind", "ix", (F.col("x") * s.axis_scale["x"] + F.lit(0.0)).alias("x"), _r(F.col("v") * s.scale_of(0, 1)).alias("v"))


@_query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <> 25 THEN (l_quantity * 0.5 + 3.0) * 2.0 END, 6) + 0.0 AS v FROM lineitem")
def sentinel_to_null(spark, sf_dir):
    v = transforms.unpack(F.col("l_quantity"), 0.5, 3.0, (25.0,), 2.0)
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(v).alias("v"))


_FINE = Axis("t", 0.25, 0.75, 950)


def _pieces_sql(joined: str) -> str:
    return f"""{_HOURLY},
o AS (SELECT kind, x, v, row_number() OVER (PARTITION BY kind ORDER BY x) AS pos FROM hourly),
f AS (SELECT kind, x AS x0, v AS v0, pos, lead(x) OVER w AS nx, lead(v) OVER w AS nv, lead(pos) OVER w AS na FROM o WHERE v IS NOT NULL WINDOW w AS (PARTITION BY kind ORDER BY pos)),
p AS (SELECT kind, x0, v0, CASE WHEN j THEN nx ELSE x0 END AS x1, CASE WHEN j THEN nv ELSE v0 END AS v1 FROM (SELECT *, coalesce({joined}, false) AS j FROM f)),
t AS (SELECT CAST(i AS INTEGER) AS it, 0.25 + i * 0.75 AS t FROM range(950) r(i)),
h AS (SELECT * FROM p JOIN t ON CASE WHEN x1 > x0 THEN t >= x0 AND t < x1 ELSE t = x0 END)"""


_JOINED = {"contiguous": "na = pos + 1", "bridged": "na IS NOT NULL", "limited": "na = pos + 1 OR nx - x0 <= 3"}
_VALUE = {
    "l": "CASE WHEN x1 > x0 THEN v0 + (v1 - v0) * (t - x0) / (x1 - x0) ELSE v0 END",
    "n": "CASE WHEN t - x0 <= x1 - t THEN v0 ELSE v1 END",
    "e": "v0",
}


def _resampled(spark, sf_dir, mode, bridge):
    got = resample.resample(hourly(spark, sf_dir), ["kind"], "x", ["v"], _FINE, mode, bridge)
    return got.select("kind", "it", _r(F.col("v"), 9).alias("v"))


for _name, _mode, _bridge, _join in (
    ("resample_linear", "l", False, "contiguous"), ("resample_nearest", "n", False, "contiguous"), ("resample_step", "e", False, "contiguous"),
    ("gap_bridge", "l", True, "bridged"), ("gap_bridge_limited", "l", 3.0, "limited"),
):
    _query(f"WITH {_pieces_sql(_JOINED[_join])} SELECT kind, it, round({_VALUE[_mode]}, 9) + 0.0 AS v FROM h", _name)(lambda s, d, m=_mode, b=_bridge: _resampled(s, d, m, b))
for _name, _mode, _smooth in (("resample_akima", "a", 0.0), ("resample_cubic", "c", 0.0), ("resample_smooth", "s", 0.5)):
    _query(name=_name)(lambda s, d, m=_mode, p=_smooth: resample.resample(hourly(s, d), ["kind"], "x", ["v"], _FINE, m, True, p))


@_query(f"""WITH {_HOURLY}, o AS (SELECT kind, x, v, row_number() OVER (PARTITION BY kind ORDER BY x) AS pos FROM hourly),
f AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 1 THEN 1 ELSE 0 END AS n FROM o WHERE v IS NOT NULL WINDOW w AS (PARTITION BY kind ORDER BY pos))
SELECT kind, x, CAST(sum(n) OVER (PARTITION BY kind ORDER BY x) AS BIGINT) AS run FROM f""")
def run_segments(spark, sf_dir):
    return resample.run_numbers(hourly(spark, sf_dir), ["kind"], "x", "v").select("kind", "x", "run")


# Merging of series ----------------------------------------------------------------------------------------------

# (primary, first hour, last hour, secondary, support)
_RECORDS = (("click", 50, 500, "view", (80, 400)), ("purchase", 300, 650, "view", (350, 600)), ("signup", 600, 719, None, None), ("view", 0, 719, None, None))


def _rows(spark, sf_dir, window: str = "cosine", shift: float = 0.0) -> DataFrame:
    df = hourly(spark, sf_dir).withColumn("v", _r(F.col("v") - shift))
    source = lambda k: df.where(F.col("kind") == k).select("ix", "v")
    placed = []
    for prim, lo, hi, sec, sup in _RECORDS:
        taper = supports.Taper(window, 0.2, 0.1)
        w = supports.interval_weight(F.col("x"), *sup, 1.0, taper, (lo, hi)) if sup else None
        placed.append(Placed(source(prim), prim, F.col("x").between(lo, hi), source(sec) if sec else None, sec, w))
    return relation(spark, Lattice((HOURS,)), placed, ["v"])


def _rows_sql(taper: bool = True, shift: float = 0.0) -> str:
    parts = []
    for rec, (prim, lo, hi, sec, sup) in enumerate(_RECORDS):
        w = "CAST(NULL AS DOUBLE)"
        if sup:
            n, i = sup[1] - sup[0] + 1, f"(n.ix - {sup[0]})"
            side = lambda at, r: f"CASE WHEN ({at} + 0.5) / ({r} * {n}) < 1 THEN (1 - cos(pi() * ({at} + 0.5) / ({r} * {n}))) / 2 ELSE 1.0 END"  # noqa: B023, E731
            value = f"({side(i, 0.2)}) * ({side(f'({n - 1} - {i})', 0.1)})" if taper else "1.0"
            w = f"CASE WHEN n.ix BETWEEN {sup[0]} AND {sup[1]} THEN {value} END"
        s = "s.v" if sec else "CAST(NULL AS DOUBLE)"
        join = f"LEFT JOIN hv s ON s.kind = '{sec}' AND s.ix = n.ix" if sec else ""
        parts.append(f"SELECT {rec} AS rec, n.ix, p.v AS p, {s} AS s, {w} AS w, {'true' if sec else 'false'} AS pair, '{prim}' AS prim, {repr(sec) if sec else 'CAST(NULL AS VARCHAR)'} AS sec FROM n LEFT JOIN hv p ON p.kind = '{prim}' AND p.ix = n.ix {join} WHERE n.ix BETWEEN {lo} AND {hi}")
    return f"{_HOURLY}, hv AS (SELECT kind, ix, round(v - {shift}, 6) AS v FROM hourly), n AS (SELECT CAST(i AS INTEGER) AS ix FROM range(720) r(i)), rows_ AS ({' UNION ALL '.join(parts)})"


_CLOBBER = {"first": "arg_min(p, rec)", "last": "arg_max(p, rec)", "lowest": "min(p)", "highest": "max(p)"}
for _how, _agg in _CLOBBER.items():
    _query(f"WITH {_rows_sql()} SELECT ix, {_agg} FILTER (p IS NOT NULL) AS v, 1.0 AS weight FROM rows_ GROUP BY ix", f"clobber_{_how}")(lambda s, d, h=_how: merge.clobber(_rows(s, d), ["ix"], ["v"], h))
    for _sign, _test in (("+", ">="), ("-", "<=")):
        _word = "positive" if _sign == "+" else "negative"
        _sql = f"WITH {_rows_sql(shift=8.0)}, f AS (SELECT *, min(rec) FILTER (p IS NOT NULL) OVER (PARTITION BY ix) AS fr FROM rows_) "
        _query(_sql + f"SELECT ix, {_agg} FILTER (p IS NOT NULL AND (rec = fr OR p {_test} 0)) AS v, 1.0 AS weight FROM f GROUP BY ix", f"clobber_{_how}_{_word}")(lambda s, d, h=_how, g=_sign: merge.clobber(_rows(s, d, shift=8.0), ["ix"], ["v"], h, g))
        _query(_sql + f"SELECT ix, coalesce({_agg} FILTER (rec > fr AND p {_test} 0), arg_min(p, rec) FILTER (rec = fr)) AS v, 1.0 AS weight FROM f GROUP BY ix", f"clobber_grid_{_how}_{_word}")(lambda s, d, h=_how, g=_sign: merge.clobber(_rows(s, d, shift=8.0), ["ix"], ["v"], h, g, "grid"))


def _blend_sql(pair_fill: bool, taper: bool = True) -> str:
    return f"""WITH {_rows_sql(taper)}, c AS (SELECT *, row_number() OVER (PARTITION BY ix ORDER BY rec) AS k FROM rows_ WHERE pair OR p IS NOT NULL)
SELECT a.ix, round(CASE WHEN NOT pair THEN p WHEN p IS NULL THEN {'s' if pair_fill else 'NULL'} WHEN s IS NULL THEN p ELSE coalesce(w, 0) * p + (1 - coalesce(w, 0)) * s END, 6) + 0.0 AS v
FROM (SELECT DISTINCT ix FROM rows_) a LEFT JOIN c ON a.ix = c.ix AND k = 1"""


for _name, _fill, _window in (("blend_pair_cosine", False, "cosine"), ("blend_pair_fill", True, "cosine"), ("blend_boxcar", False, "boxcar")):
    _query(_blend_sql(_fill, _window == "cosine"), _name)(lambda s, d, p=_fill, w=_window: merge.blend(_rows(s, d, w), ["ix"], ["v"], p).withColumn("v", _r(F.col("v"))))


def _aggregate_sql(pair_fill: bool, dialect: str) -> str:
    owner = "pair OR p IS NOT NULL" if dialect == "cube" else "true"
    fill = "w > 0 AND p IS NULL AND s IS NOT NULL" if pair_fill else "false"
    return f"""WITH {_rows_sql()}, o AS (SELECT *, min(rec) FILTER ({owner}) OVER (PARTITION BY ix) AS orec FROM rows_),
q AS (SELECT o.*, r.pair AS opair, r.sec AS osec, coalesce(r.pair AND o.pair AND o.sec = r.sec AND o.prim <> r.sec, false) AS sh FROM o JOIN rows_ r ON o.ix = r.ix AND o.orec = r.rec WHERE o.rec >= o.orec),
a AS (SELECT ix, bool_or(opair) AS paired, coalesce(sum(w) FILTER (sh AND w > 0), 0) AS g, coalesce(sum(w) FILTER (sh AND w > 0 AND p IS NOT NULL), 0) AS gv,
  coalesce(sum(w * p) FILTER (sh AND w > 0), 0) AS vv, coalesce(sum(w) FILTER (sh AND {fill}), 0) AS gs, coalesce(sum(w * s) FILTER (sh AND {fill}), 0) AS vs,
  arg_min(s, rec) FILTER (sh AND s IS NOT NULL) AS bg, arg_min(p, rec) FILTER (p IS NOT NULL AND (sh OR NOT opair)) AS fp FROM q GROUP BY ix),
b AS (SELECT *, CASE WHEN bg IS NOT NULL THEN greatest(0, 1 - g) ELSE 0 END AS bw FROM a)
SELECT ix, round(CASE WHEN paired AND gv + gs + bw > 0 AND (fp IS NOT NULL OR {str(pair_fill).lower()}) THEN (vv + vs + bw * coalesce(bg, 0)) / (gv + gs + bw) ELSE fp END, 6) + 0.0 AS v FROM b"""


for _name, _fill, _dialect in (("aggregate_series", False, "series"), ("aggregate_pair_fill", True, "series"), ("aggregate_cube", False, "cube")):
    _query(_aggregate_sql(_fill, _dialect), _name)(lambda s, d, p=_fill, x=_dialect: merge.aggregate(_rows(s, d), ["ix"], ["v"], p, x).withColumn("v", _r(F.col("v"))))


def _weight_sql(aggregated: bool, none: str) -> str:
    more = f"CASE WHEN opair AND ow > 0 THEN least(1.0, ow + coalesce(sum(r.w) FILTER (r.rec > orec AND r.pair AND r.sec = osec AND r.w > 0), 0)) ELSE ow END" if aggregated else "ow"  # noqa: F541
    return f"""WITH {_rows_sql()}, d AS (SELECT ix, rec AS orec, CASE WHEN pair THEN w ELSE 0 END AS ow, sec AS osec, pair AS opair, row_number() OVER (PARTITION BY ix ORDER BY rec) AS k FROM rows_ WHERE NOT pair OR w IS NOT NULL)
SELECT ix, round(coalesce(weight, {none}), 6) AS weight FROM (SELECT r.ix, {more} AS weight FROM rows_ r LEFT JOIN d ON r.ix = d.ix AND k = 1 GROUP BY r.ix, orec, ow, osec, opair)"""


for _name, _agg, _dialect, _none in (("merge_weight", False, "series", "0.0"), ("merge_weight_aggregate", True, "series", "0.0"), ("merge_weight_grid", False, "grid", "NULL")):
    _query(_weight_sql(_agg, _none), _name)(lambda s, d, a=_agg, x=_dialect: merge.report_weight(_rows(s, d), ["ix"], a, x).withColumn("weight", F.round("weight", 6)))


@_query(f"""WITH {_rows_sql()}, r AS (SELECT ix, rec, prim, CASE WHEN rec = 1 THEN 'error' ELSE sec END AS sec FROM rows_ WHERE pair AND w > 0)
SELECT DISTINCT a.rec AS earlier, b.rec AS later FROM r a JOIN r b ON a.ix = b.ix AND b.rec > a.rec AND a.sec <> b.sec AND b.prim <> a.sec""")
def overlap_validation(spark, sf_dir):
    rows = _rows(spark, sf_dir).withColumn("sec", F.when(F.col("rec") == 1, "error").otherwise(F.col("sec")))
    return merge.overlap_conflicts(rows, ["ix"])


# Windows --------------------------------------------------------------------------------------------------------

_WINDOW_SQL = {
    "boxcar": "1.0", "cosine": "(1 - cos(pi() * t)) / 2", "trapezoid": "t", "hamming": "0.54 - 0.46 * cos(pi() * t)", "smoothstep": "t * t * (3 - 2 * t)", "smootherstep": "t * t * t * (t * (6 * t - 15) + 10)",
    "welch": "1 - (1 - t) * (1 - t)", "sine": "sin(pi() * t / 2)", "quadratic": "t * t", "cubic": "t * t * t", "blackman": "0.42 - 0.5 * cos(pi() * t) + 0.08 * cos(2 * pi() * t)", "exponential": "(exp(3 * t) - 1) / (exp(3) - 1)",
    "gaussian": "exp(-0.5 * pow((1 - t) / 0.4, 2))", "root": "sqrt(t)", "circular": "sqrt(greatest(0, 1 - (1 - t) * (1 - t)))", "poisson": "exp(-3 * (1 - t))", "cauchy": "1 / (1 + pow(3 * (1 - t), 2))",
}


def _windows(spark, names):
    df, parts = spark.range(40).withColumn("i", F.col("id").cast("int")).drop("id"), None
    for n in names:
        p = df.select(F.lit(n).alias("name"), "i", F.round(windows.weight(F.col("i"), 40, 0.3, 0.2, n), 6).alias("w"))
        parts = p if parts is None else parts.union(p)
    return parts


def _window_sql() -> str:
    parts = []
    for n, s in _WINDOW_SQL.items():
        side = lambda at, r, s=s, n=n: "1.0" if n == "boxcar" else f"(SELECT CASE WHEN t < 1 THEN {s} ELSE 1.0 END FROM (SELECT ({at} + 0.5) / ({r} * 40) AS t))"
        parts.append(f"SELECT '{n}' AS name, CAST(i AS INTEGER) AS i, round({side('i', 0.3)} * {side('(39 - i)', 0.2)}, 6) AS w FROM range(40) r(i)")
    return " UNION ALL ".join(parts)


_query(_window_sql(), "window_shapes")(lambda s, d: _windows(s, list(_WINDOW_SQL)))
_query(name="window_shapes_other")(lambda s, d: _windows(s, [n for n in windows.NAMES if n not in _WINDOW_SQL]))


# Planes and cubes -----------------------------------------------------------------------------------------------

GX, GY, GZ = Axis("x", 0.0, 1.0, 11), Axis("y", 0.0, 1.0, 9), Axis("z", 0.0, 10.0, 10)


def cube(spark, sf_dir) -> DataFrame:
    """iz, iy, ix, z, v: mean price by quantity, tax and discount; v is missing at nodes where 7 divides 3 iz + 5 iy + ix."""
    df = _table(spark, sf_dir, "lineitem").select(
        F.floor((F.col("l_quantity") - 1) / 5).cast("int").alias("iz"), F.round(F.col("l_tax") * 100).cast("int").alias("iy"), F.round(F.col("l_discount") * 100).cast("int").alias("ix"), "l_extendedprice"
    )
    df = df.groupBy("iz", "iy", "ix").agg((F.floor(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count(F.lit(1)) / 1000) / 100.0).alias("v"))
    return df.withColumns({"v": F.when(F.expr("(3 * iz + 5 * iy + ix) % 7 <> 0"), F.col("v")), "z": F.col("iz") * 10.0})


_CUBE = """cube AS (SELECT iz, iy, ix, iz * 10.0 AS z, CASE WHEN (3 * iz + 5 * iy + ix) % 7 <> 0 THEN v END AS v FROM (SELECT iz, iy, ix, floor(sum(CAST(round(p * 100) AS BIGINT)) / count(*) / 1000) / 100.0 AS v FROM (
  SELECT CAST(floor((l_quantity - 1) / 5) AS INTEGER) AS iz, CAST(round(l_tax * 100) AS INTEGER) AS iy, CAST(round(l_discount * 100) AS INTEGER) AS ix, l_extendedprice AS p FROM lineitem) GROUP BY iz, iy, ix))"""


@_query(f"WITH {_CUBE} SELECT iz, iy, ix, CAST(z AS DOUBLE) AS z, v FROM cube")
def grid_scan(spark, sf_dir):
    return cube(spark, sf_dir)


@_query(f"WITH {_CUBE} SELECT iy, ix, v FROM cube WHERE iz = 3")
def slice_index(spark, sf_dir):
    return cube(spark, sf_dir).where("iz = 3").select("iy", "ix", "v")


@_query(f"WITH {_CUBE} SELECT iy, ix, v FROM cube WHERE iz = (SELECT arg_min(iz, (abs(z - 35), iz)) FROM (SELECT DISTINCT iz, z FROM cube))")
def slice_nearest_level(spark, sf_dir):
    df = cube(spark, sf_dir)
    level = resample.nearest_level(df.select("iz", "z").distinct(), 35.0)
    return df.join(F.broadcast(level), "iz", "left_semi").select("iy", "ix", "v")


_HALF = Lattice((Axis("y", 0.25, 0.5, 16), Axis("x", 0.25, 0.5, 20)))


def _around_sql(weight: str, dy: str, dx: str, least: float) -> str:
    return f"""WITH {_CUBE}, n AS (SELECT CAST(i // 20 AS INTEGER) AS iy, CAST(i % 20 AS INTEGER) AS ix, 0.25 + (i // 20) * 0.5 AS y, 0.25 + (i % 20) * 0.5 AS x FROM range(320) r(i)),
c AS (SELECT iy, ix, {dy} AS sy, {dx} AS sx, {weight} AS w FROM n, range(2) a(p), range(2) b(q))
SELECT cube.iz, c.iy, c.ix, round(sum(w * v) / sum(w), 6) + 0.0 AS v FROM c JOIN cube ON cube.iy = sy AND cube.ix = sx WHERE w > 1e-12 AND v IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(w) >= {least} - 1e-9"""


@_query(_around_sql("(CASE WHEN p = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN q = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END)", "floor(y) + p", "floor(x) + q", 0.5))
def grid_bilinear(spark, sf_dir):
    got = resample.horizontal(cube(spark, sf_dir), Lattice((GY, GX)), _HALF, ["v"], "l", ["iz"])
    return got.select("iz", "iy", "ix", _r(F.col("v")).alias("v"))


@_query(_around_sql("CASE WHEN p = 0 AND q = 0 THEN 1.0 ELSE 0.0 END", "floor(y + 0.5)", "floor(x + 0.5)", 0.5))
def grid_nearest(spark, sf_dir):
    got = resample.horizontal(cube(spark, sf_dir), Lattice((GY, GX)), _HALF, ["v"], "n", ["iz"])
    return got.select("iz", "iy", "ix", _r(F.col("v")).alias("v"))


@_query()
def grid_bicubic(spark, sf_dir):
    return resample.horizontal(cube(spark, sf_dir), Lattice((GY, GX)), _HALF, ["v"], "b", ["iz"])


@_query(f"""WITH {_CUBE}, f AS (SELECT iy, ix, z AS x0, v AS v0, lead(z) OVER w AS x1, lead(v) OVER w AS v1, row_number() OVER w AS pos FROM cube WHERE v IS NOT NULL WINDOW w AS (PARTITION BY iy, ix ORDER BY z)),
t AS (SELECT CAST(i AS INTEGER) AS iz, 1.0 + i * 4.0 AS t FROM range(23) r(i))
SELECT iy, ix, iz, round(CASE WHEN x1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - x0) / (x1 - x0) END, 6) + 0.0 AS v FROM f JOIN t ON CASE WHEN x1 IS NULL THEN t = x0 ELSE t >= x0 AND t < x1 END""")
def cube_vertical_linear(spark, sf_dir):
    got = resample.vertical(cube(spark, sf_dir), "z", ["v"], Axis("z", 1.0, 4.0, 23), "l", True)
    return got.select("iy", "ix", "iz", _r(F.col("v")).alias("v"))


_VERTICAL_GAPS = """f AS (SELECT iy, ix, z AS x0, v AS v0, CASE WHEN lead(iz) OVER w = iz + 1 THEN lead(z) OVER w END AS x1, lead(v) OVER w AS v1,
  coalesce(lag(iz) OVER w = iz - 1, false) AS joined FROM {} WHERE v IS NOT NULL WINDOW w AS (PARTITION BY iy, ix ORDER BY z)),
t AS (SELECT CAST(i AS INTEGER) AS iz, 1.0 + i * 4.0 AS t FROM range(23) r(i))
SELECT iy, ix, iz, round(CASE WHEN x1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (t - x0) / (x1 - x0) END, 6) + 0.0 AS v FROM f JOIN t ON CASE WHEN x1 IS NULL THEN t = x0 ELSE t >= x0 AND t < x1 END"""


@_query(f"WITH {_CUBE}, {_VERTICAL_GAPS.format('cube')}")
def cube_vertical_gaps(spark, sf_dir):
    """Gaps are by node: those of the cube, whose missing nodes have rows."""
    got = resample.vertical(cube(spark, sf_dir), "z", ["v"], Axis("z", 1.0, 4.0, 23), "l")
    return got.select("iy", "ix", "iz", _r(F.col("v")).alias("v"))


@_query(f"{_around_sql('CASE WHEN p = 0 AND q = 0 THEN 1.0 ELSE 0.0 END', 'floor(y + 0.5)', 'floor(x + 0.5)', 0.5).replace('SELECT cube.iz', ', plane AS (SELECT cube.iz', 1)}), {_VERTICAL_GAPS.format('(SELECT *, iz * 10.0 AS z FROM plane)')}")
def cube_horizontal_then_vertical(spark, sf_dir):
    """The same after a horizontal step, which leaves no rows where it has no values."""
    flat = resample.horizontal(cube(spark, sf_dir), Lattice((GY, GX)), _HALF, ["v"], "n", ["iz"])
    flat = flat.select("iz", "iy", "ix", _r(F.col("v")).alias("v"), (F.col("iz") * 10.0).alias("z"))
    got = resample.vertical(flat, "z", ["v"], Axis("z", 1.0, 4.0, 23), "l")
    return got.select("iy", "ix", "iz", _r(F.col("v")).alias("v"))


def _cube_rows(spark, sf_dir):
    """Two records over the cube: all of it by a polygon-free box, paired with a plane of means, and the plane alone."""
    df = cube(spark, sf_dir)
    lattice = Lattice((GZ, GY, GX))
    back = df.groupBy("iz").agg((F.floor(F.sum(F.round(F.col("v") * 100).cast("long")) / F.count("v")) / 100.0).alias("v"))
    back = lattice.nodes(spark).select(*lattice.keys).join(F.broadcast(back), "iz")
    taper = {a: supports.Taper("cosine", 0.25, 0.25) for a in "xyz"}
    box = supports.box_support(lattice, {"x": (2.0, 9.0), "y": (1.0, 7.0), "z": (10.0, 80.0)}, taper)
    placed = [Placed(df.select(*lattice.keys, "v"), "cube", F.lit(True), back, "mean", box.weight()), Placed(back, "mean", F.lit(True))]
    return relation(spark, lattice, placed, ["v"])


def _cube_rows_sql() -> str:
    side = lambda i, n: f"(CASE WHEN ({i} + 0.5) / (0.25 * {n}) < 1 THEN (1 - cos(pi() * ({i} + 0.5) / (0.25 * {n}))) / 2 ELSE 1.0 END)"
    w = " * ".join(side(f"({a} - {lo})", hi - lo + 1) + " * " + side(f"({hi} - {a})", hi - lo + 1) for a, lo, hi in (("n.ix", 2, 9), ("n.iy", 1, 7), ("n.iz", 1, 8)))
    return f"""{_CUBE}, n AS (SELECT CAST(i // 99 AS INTEGER) AS iz, CAST((i // 11) % 9 AS INTEGER) AS iy, CAST(i % 11 AS INTEGER) AS ix FROM range(990) r(i)),
m AS (SELECT iz, floor(sum(CAST(round(v * 100) AS BIGINT)) / count(v)) / 100.0 AS s FROM cube GROUP BY iz),
j AS (SELECT n.iz, n.iy, n.ix, c.v AS p, m.s, CASE WHEN n.ix BETWEEN 2 AND 9 AND n.iy BETWEEN 1 AND 7 AND n.iz BETWEEN 1 AND 8 THEN {w} END AS w FROM n LEFT JOIN cube c USING (iz, iy, ix) JOIN m ON m.iz = n.iz)"""


@_query(f"WITH {_cube_rows_sql()} SELECT iz, iy, ix, round(CASE WHEN p IS NULL THEN s ELSE coalesce(w, 0) * p + (1 - coalesce(w, 0)) * s END, 6) + 0.0 AS v FROM j")
def cube_blend(spark, sf_dir):
    return merge.blend(_cube_rows(spark, sf_dir), ["iz", "iy", "ix"], ["v"], True).withColumn("v", _r(F.col("v")))


@_query(f"WITH {_cube_rows_sql()} SELECT iz, iy, ix, round(coalesce(w, 0), 6) AS weight FROM j")
def cube_weight(spark, sf_dir):
    return merge.report_weight(_cube_rows(spark, sf_dir), ["iz", "iy", "ix"], False, "cube").withColumn("weight", F.round("weight", 6))


# Ten planes of the cube as tiles, each on a lattice of its own that is shifted against the one before.
_WIDE = Lattice((Axis("y", 0.0, 1.0, 18), Axis("x", 0.0, 1.0, 29)))


def _tiles(spark, sf_dir) -> dict[str, GridFrame]:
    df = cube(spark, sf_dir)
    return {f"tile{k}": GridFrame(df.where(F.col("iz") == k).select("iy", "ix", "v"), Lattice((Axis("y", float(k), 1.0, 9), Axis("x", 2.0 * k, 1.0, 11))), ("v",)) for k in range(10)}


_NODES = "n AS (SELECT CAST(i // 29 AS INTEGER) AS iy, CAST(i % 29 AS INTEGER) AS ix FROM range(522) r(i)), tiles AS (SELECT iz AS k, iy + iz AS iy, ix + 2 * iz AS ix, iy AS ty, ix AS tx, v FROM cube)"


@_query(f"WITH {_CUBE}, {_NODES}, g AS (SELECT iy, ix, arg_min(v, k) AS v FROM tiles WHERE v IS NOT NULL GROUP BY iy, ix) SELECT iy, ix, v FROM n LEFT JOIN g USING (iy, ix)")
def merge_planes_clobber(spark, sf_dir):
    return programs.merge_grids(spark, [f"tile{k}" for k in range(10)], _tiles(spark, sf_dir), _WIDE).df


_SIDES = " * ".join(f"(CASE WHEN ({i} + 0.5) / (0.25 * {n}) < 1 THEN (1 - cos(pi() * ({i} + 0.5) / (0.25 * {n}))) / 2 ELSE 1.0 END)" for a, n in (("tx", 11), ("ty", 9)) for i in (a, f"({n - 1} - {a})"))


@_query(f"""WITH {_CUBE}, {_NODES}, r AS (SELECT k, n.iy, n.ix, t.v AS p, 10.0 + n.ix AS s, n.ix - 2 * k AS tx, n.iy - k AS ty FROM n JOIN (SELECT CAST(i AS INTEGER) AS k FROM range(10) q(i)) q ON n.ix BETWEEN 2 * k AND 2 * k + 10 AND n.iy BETWEEN k AND k + 8 LEFT JOIN tiles t USING (k, iy, ix)),
o AS (SELECT *, {_SIDES} AS w, row_number() OVER (PARTITION BY iy, ix ORDER BY k) AS pos FROM r)
SELECT n.iy, n.ix, round(CASE WHEN p IS NOT NULL THEN w * p + (1 - w) * s END, 6) + 0.0 AS v, round(coalesce(w, 0), 6) + 0.0 AS weight FROM n LEFT JOIN (SELECT * FROM o WHERE pos = 1) x USING (iy, ix)""")
def merge_planes_blend(spark, sf_dir):
    """Every tile is paired with a background over all nodes."""
    back = GridFrame(_WIDE.nodes(spark).select("iy", "ix", (10.0 + F.col("x")).alias("v")), _WIDE, ("v",))
    records = [Record(f"tile{k}", "back", None, (supports.Taper("cosine", 0.25, 0.25),) * 2) for k in range(10)]
    got = programs.merge_grids(spark, records, _tiles(spark, sf_dir) | {"back": back}, _WIDE, weight="append").df
    return got.select("iy", "ix", _r(F.col("v")).alias("v"), _r(F.coalesce("weight", F.lit(0.0))).alias("weight"))


@_query(f"""WITH {_CUBE}, h AS (SELECT a.iz, a.iy, a.ix, (a.v + b.v) / 2 AS v FROM cube a JOIN cube b ON b.iz = a.iz + 1 AND b.iy = a.iy AND b.ix = a.ix),
n AS (SELECT CAST(i // 99 AS INTEGER) AS iz, CAST((i // 11) % 9 AS INTEGER) AS iy, CAST(i % 11 AS INTEGER) AS ix FROM range(891) r(i))
SELECT n.iz, n.iy, n.ix, round(coalesce(a.v, -b.v), 6) + 0.0 AS v FROM n LEFT JOIN h a USING (iz, iy, ix) LEFT JOIN h b ON b.iz = n.iz AND b.iy = n.iy - 1 AND b.ix = n.ix""")
def merge_cubes_run(spark, sf_dir):
    """The cube, and behind it itself, negated and one row further; layers are made halfway between theirs."""
    own = GridFrame(cube(spark, sf_dir).select("iz", "iy", "ix", "v"), Lattice((GZ, GY, GX)), ("v",))
    other = GridFrame(own.df.withColumn("v", -F.col("v")), Lattice((GZ, Axis("y", 1.0, 1.0, 9), GX)), ("v",))
    got = programs.merge_grids(spark, ["own", "other"], {"own": own, "other": other}, Lattice((Axis("z", 5.0, 10.0, 9), GY, GX)))
    return got.df.withColumn("v", _r(F.col("v")))


def _holey(spark, sf_dir):
    return cube(spark, sf_dir).withColumn("v", F.when(F.expr("NOT (iy BETWEEN 3 AND 4 AND ix BETWEEN 5 AND 6)"), F.col("v")))


@_query()
def hole_label(spark, sf_dir):
    return holes.hole_labels(_holey(spark, sf_dir), "v", GY.n, GX.n, ["iz"])


for _name, _method in (("hole_fill_nearest", "n"), ("hole_fill_linear", "l"), ("hole_fill_average", "a"), ("hole_fill_spline", "s"), ("hole_fill_curvature", "m")):
    _query(name=_name)(lambda s, d, m=_method: holes.fill_holes(_holey(s, d), ["v"], GY.n, GX.n, layer=["iz"], method=m))


_POLYGON = [(1.0, 1.0), (9.0, 2.0), (7.0, 7.0), (3.0, 6.0)]


@_query("""WITH v(k, x, y) AS (VALUES (0, 1.0, 1.0), (1, 9.0, 2.0), (2, 7.0, 7.0), (3, 3.0, 6.0)), e AS (SELECT a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v a JOIN v b ON b.k = (a.k + 1) % 4),
r AS (SELECT CAST(i AS INTEGER) AS iy FROM range(1, 8) t(i))
SELECT iy, CAST(ceil(min(x0 + (x1 - x0) * (iy - y0) / (y1 - y0)) - 1e-9) AS INTEGER) AS first_ix, CAST(floor(max(x0 + (x1 - x0) * (iy - y0) / (y1 - y0)) + 1e-9) AS INTEGER) AS last_ix
FROM r JOIN e ON iy BETWEEN least(y0, y1) AND greatest(y0, y1) GROUP BY iy""")
def polygon_row_spans(spark, sf_dir):
    rows, _ = supports.polygon_spans(_POLYGON, GX, GY)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in rows.items()], "iy int, first_ix int, last_ix int")


@_query()
def polygon_weight(spark, sf_dir):
    support = supports.polygon_support(_POLYGON, GX, GY)
    return Lattice((GY, GX)).nodes(spark).select("iy", "ix", support.weight().alias("weight")).where("weight IS NOT NULL")


# Columns --------------------------------------------------------------------------------------------------------

_VS, _VP = "p_retailprice * 3.0 - 1500", "p_retailprice * 4.0 - 2000"


def _brocher(name, expr, f, sql):
    _query(sql, name)(lambda s, d: _table(s, d, "part").select("p_partkey", _r(f(F.expr(expr))).alias("v")))


_brocher("brocher_vp", _VS, geotech.brocher_vp, f"SELECT p_partkey, round(CASE WHEN s > 0 AND s <= 4.5 THEN 1000 * (0.9409 + s * (2.0947 + s * (-0.8206 + s * (0.2683 - 0.0251 * s)))) END, 6) + 0.0 AS v FROM (SELECT p_partkey, ({_VS}) / 1000 AS s FROM part)")
_brocher("brocher_vs", _VP, geotech.brocher_vs, f"SELECT p_partkey, round(CASE WHEN s >= 1.5 AND s <= 8.5 THEN 1000 * (0.7858 + s * (-1.2344 + s * (0.7949 + s * (-0.1238 + 0.0064 * s)))) END, 6) + 0.0 AS v FROM (SELECT p_partkey, ({_VP}) / 1000 AS s FROM part)")
_brocher("nafe_drake", _VP, geotech.nafe_drake, f"SELECT p_partkey, round(greatest(1000.0, 1000 * (s * (1.6612 + s * (-0.4721 + s * (0.0671 + s * (-0.0043 + 0.000106 * s)))))), 6) + 0.0 AS v FROM (SELECT p_partkey, ({_VP}) / 1000 AS s FROM part)")


@_query("SELECT p_partkey, round((q + 2.0 / 3.0 * (q - q * q)) * 1000 + (0.5 - q / 2 + 1.5 * (q * q + 2 * sqrt(q) - 3 * q)) * 400, 6) + 0.0 AS v FROM (SELECT p_partkey, p_size / 50.0 AS q FROM part)")
def ely_profile(spark, sf_dir):
    q = F.col("p_size") / 50.0
    return _table(spark, sf_dir, "part").select("p_partkey", _r(geotech.ely_profile(q, F.lit(400.0), F.lit(1000.0))).alias("v"))


def _velocity_cube(spark, sf_dir):
    """iz, iy, ix, z (metres, down), vs: the price cube as a shear-wave model."""
    return cube(spark, sf_dir).select("iz", "iy", "ix", (F.col("z") * 10).alias("z"), (F.col("v") * 20 + 500).alias("vs"))


def _surfaces(spark):
    return Lattice((GY, GX)).nodes(spark).select("iy", "ix", (300.0 + 10 * F.col("ix")).alias("vs30"), (F.col("iy") > 1).alias("land"))


def _poly(v: str, a: tuple[float, ...]) -> str:
    out = str(a[-1])
    for c in a[-2::-1]:
        out = f"({c} + ({v}) * {out})"
    return out


# Published velocity and density relations.
def _vp_sql(vs: str) -> str:
    return f"(CASE WHEN {vs} > 0 AND {vs} <= 4500 THEN 1000 * {_poly(f'{vs} / 1000', (0.9409, 2.0947, -0.8206, 0.2683, -0.0251))} END)"


def _rho_sql(vp: str) -> str:
    return f"(CASE WHEN {vp} IS NOT NULL THEN greatest(1000.0, 1000 * ({vp} / 1000) * {_poly(f'{vp} / 1000', (1.6612, -0.4721, 0.0671, -0.0043, 0.000106))}) END)"


def _ely_sql(top: str, anchor: str) -> str:
    return f"((q + 2.0 / 3.0 * (q - q * q)) * {anchor} + (0.5 - q / 2 + 1.5 * (q * q + 2 * sqrt(q) - 3 * q)) * {top})"


_LAYER = f"""{_CUBE}, m AS (SELECT iz, iy, ix, z * 10 AS z, v * 20 + 500 AS vs FROM cube),
f AS (SELECT iy, ix, z AS x0, vs AS v0, CASE WHEN lead(iz) OVER w = iz + 1 THEN lead(z) OVER w END AS x1, lead(vs) OVER w AS v1 FROM m WHERE vs IS NOT NULL WINDOW w AS (PARTITION BY iy, ix ORDER BY z)),
u AS (SELECT iy, ix, min(z) AS surface, min(z) + 350 AS base FROM m WHERE vs IS NOT NULL GROUP BY iy, ix),
c AS (SELECT u.iy, u.ix, surface, 300.0 + 10 * u.ix AS vs30, u.iy > 1 AS land, min(CASE WHEN x1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (base - x0) / (x1 - x0) END) AS anchor
  FROM u LEFT JOIN f ON f.iy = u.iy AND f.ix = u.ix AND base >= x0 AND base <= coalesce(x1, x0) GROUP BY ALL),
l AS (SELECT m.*, c.land, c.vs30, c.anchor, c.land AND c.anchor IS NOT NULL AND z >= surface AND z <= surface + 350 AS inside, greatest((z - surface) / 350.0, 0.0) AS q FROM m LEFT JOIN c USING (iy, ix))"""


@_query(f"WITH {_LAYER} SELECT iz, iy, ix, CAST(z AS DOUBLE) AS z, round(CASE WHEN inside THEN {_ely_sql('vs30', 'anchor')} ELSE vs END, 6) + 0.0 AS vs FROM l")
def geotech_layer(spark, sf_dir):
    return layer.geotech_layer(_velocity_cube(spark, sf_dir), _surfaces(spark), vs="vs", depth=350.0).withColumn("vs", _r(F.col("vs")))


@_query(f"""WITH {_LAYER}, n AS (SELECT *, {_ely_sql(_vp_sql('vs30'), _vp_sql('anchor'))} AS new_vp, CASE WHEN land THEN {_vp_sql('vs')} END AS own_vp FROM l)
SELECT iz, iy, ix, CAST(z AS DOUBLE) AS z, round(CASE WHEN inside THEN {_ely_sql('vs30', 'anchor')} ELSE vs END, 6) + 0.0 AS vs, round(CASE WHEN inside THEN new_vp ELSE own_vp END, 6) + 0.0 AS vp,
  round(CASE WHEN inside THEN {_rho_sql('new_vp')} ELSE {_rho_sql('own_vp')} END, 6) + 0.0 AS rho FROM n""")
def geotech_created_fields(spark, sf_dir):
    got = layer.geotech_layer(_velocity_cube(spark, sf_dir), _surfaces(spark), vp="vp", vs="vs", rho="rho", create=("vp", "rho"))
    return got.withColumns({f: _r(F.col(f)) for f in ("vs", "vp", "rho")})


@_query(f"WITH {_LAYER} SELECT CASE WHEN NOT land THEN 'wet' WHEN anchor IS NULL THEN 'anchor' ELSE 'layer' END AS reason, count(*) AS columns FROM c GROUP BY 1")
def near_surface_counts(spark, sf_dir):
    """The whole run: planes of Vs30 and of the mask are sampled at the columns, and the columns are counted by reason."""
    model = GridFrame(_velocity_cube(spark, sf_dir).select("iz", "iy", "ix", "vs"), Lattice((Axis("z", 0.0, 100.0, 10), GY, GX)), ("vs",))
    plane = Lattice((GY, GX))
    nodes = plane.nodes(spark)
    vs30 = GridFrame(nodes.select("iy", "ix", (300.0 + 10 * F.col("ix")).alias("vs30")), plane, ("vs30",))
    mask = GridFrame(nodes.select("iy", "ix", F.when(F.col("iy") > 1, 1.0).otherwise(0.0).alias("mask")), plane, ("mask",))
    return programs.near_surface(model, vs30, vs="vs", mask=mask)[1]


@_query(f"WITH {_CUBE}, t AS (SELECT iy, ix, min(z) - 5 AS z FROM cube WHERE v IS NOT NULL GROUP BY iy, ix) SELECT iy, ix, CASE WHEN z < 0 THEN true WHEN z > 0 THEN false ELSE true END AS land FROM t")
def column_evidence(spark, sf_dir):
    return layer.column_evidence(cube(spark, sf_dir).withColumn("z", F.col("z") - 5), "v")


def _relief(spark, sf_dir):
    """The cube with z upwards from -50 to 40, and no values above the ground."""
    return cube(spark, sf_dir).withColumn("z", F.col("z") - 50.0).withColumn("v", F.when(F.expr("z <= 30 - 10 * (ix % 4)"), F.col("v")))


_RELIEF = f"""{_CUBE}, nodes AS (SELECT iz, iy, ix, z - 50.0 AS z, CASE WHEN z - 50.0 <= 30 - 10 * (ix % 4) THEN v END AS v FROM cube),
relief AS (SELECT * FROM nodes WHERE v IS NOT NULL)"""


@_query(f"WITH {_RELIEF} SELECT iy, ix, CAST(max(z) AS DOUBLE) AS land_surface FROM relief GROUP BY iy, ix")
def infer_surface(spark, sf_dir):
    return columns.infer_surface(_relief(spark, sf_dir), ["v"]).select("iy", "ix", "land_surface")


@_query(f"""WITH {_RELIEF}, b AS (SELECT iy, ix, z, v, sum(CASE WHEN z <= 0 AND NOT coalesce(abs(v - 50) <= 5, false) THEN 1 ELSE 0 END) OVER (PARTITION BY iy, ix ORDER BY z DESC) AS n FROM nodes),
e AS (SELECT iy, ix, max(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS begun, max(CASE WHEN n = 1 AND NOT coalesce(abs(v - 50) <= 5, false) THEN z END) AS z FROM b WHERE z <= 0 GROUP BY iy, ix)
SELECT iy, ix, CAST(CASE WHEN begun = 1 AND nodes.v IS NOT NULL THEN e.z END AS DOUBLE) AS water_surface, begun = 1 AND nodes.v IS NULL AS conflict FROM e LEFT JOIN nodes USING (iy, ix, z)""")
def infer_water_surface(spark, sf_dir):
    return columns.infer_surface(_relief(spark, sf_dir), ["v"], {"v": 50.0}, {"v": 5.0}).select("iy", "ix", "water_surface", "conflict")


@_query("SELECT c_custkey, CASE WHEN c_acctbal / 5000 >= 0.5 THEN 1 WHEN c_acctbal / 5000 < 0.5 THEN 2 END AS cls FROM customer")
def classify_prior(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", columns.prior_from_mask(F.col("c_acctbal") / 5000).alias("cls"))


def _shifted(spark, sf_dir, scope=None, operation="replace"):
    found = columns.infer_surface(_relief(spark, sf_dir), ["v"])
    found = found.select("iy", "ix", F.col("land_surface").alias("old"), F.when(F.col("iy") < 7, columns.LAND).otherwise(columns.WET).alias("cls"), (F.col("iy") * 6.0 - 10).alias("requested"))
    return columns.finish_surfaces(found, operation, scope)


@_query(f"""WITH {_RELIEF}, s AS (SELECT iy, ix, max(z) AS old, CASE WHEN iy < 7 THEN 1 ELSE 2 END AS cls, iy * 6.0 - 10 AS req FROM relief GROUP BY iy, ix)
SELECT iy, ix, cls = 1 AS modify, CAST(CASE WHEN cls = 1 THEN req END AS DOUBLE) AS new FROM s""")
def new_surface_scope(spark, sf_dir):
    return _shifted(spark, sf_dir, "land").select("iy", "ix", "modify", "new")


def _shift_sql(source: str, value: str, requested: str = "iy * 6.0 - 10") -> str:
    return f"""WITH {_RELIEF}, s AS (SELECT iy, ix, CAST(max(z) AS DOUBLE) AS old, CASE WHEN iy < 7 THEN 1 ELSE 2 END AS cls, {requested} AS req FROM relief GROUP BY iy, ix),
c AS (SELECT *, CASE WHEN cls = 2 AND req > 0 THEN 0.0 ELSE req END AS new FROM s),
t AS (SELECT c.*, CAST(i AS INTEGER) AS iz, -60.0 + i * 6.0 AS z FROM c, range(20) r(i)),
u AS (SELECT *, {source} AS src FROM t),
f AS (SELECT iy, ix, z AS x0, v AS v0, lead(z) OVER w AS x1, lead(v) OVER w AS v1 FROM relief WINDOW w AS (PARTITION BY iy, ix ORDER BY z)),
g AS (SELECT u.iy, u.ix, iz, min(CASE WHEN x1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (src - x0) / (x1 - x0) END) AS v FROM u JOIN f ON u.iy = f.iy AND u.ix = f.ix AND src >= x0 AND src <= coalesce(x1, x0) GROUP BY ALL)
SELECT iz, u.iy, u.ix, round({value}, 6) + 0.0 AS v FROM u LEFT JOIN g USING (iy, ix, iz)"""


_WET = "WHEN cls = 2 THEN CASE WHEN z <= 0 AND z <= new THEN z - new + old END"
_PULL = "CASE WHEN z <= new THEN z - new + old END"
_TOP = "CASE WHEN cls = 2 AND z > 0 THEN -1.0 WHEN cls = 2 AND z > new THEN -2.0 WHEN z > new THEN -1.0 {} ELSE v END"
_STRETCH = f"CASE {_WET} WHEN new <= 0 THEN {_PULL} WHEN z <= 0 THEN z + old WHEN z <= new THEN old END"
for _name, _source, _more in (
    ("column_pull", f"CASE {_WET} ELSE {_PULL} END", ""), ("column_extend", _STRETCH, ""),
    ("column_linear", _STRETCH, "WHEN cls = 1 AND z > 0 AND z <= new AND v > 20 THEN v + (20 - v) * z / new"),
):
    def _moved(s, d, m=_name.removeprefix("column_")):
        got = columns.transform_columns(_relief(s, d), _shifted(s, d), {"v": columns.Fill(-1.0, -2.0, 20.0)}, Axis("z", -60.0, 6.0, 20), "replace", m, True)
        return got.select("iz", "iy", "ix", _r(F.col("v")).alias("v"))

    _query(_shift_sql(_source, _TOP.format(_more)), _name)(_moved)


@_query(_shift_sql(_PULL, "CASE WHEN z > new THEN NULL ELSE v END", "0.0"))
def remove_surface(spark, sf_dir):
    got = columns.transform_columns(_relief(spark, sf_dir), _shifted(spark, sf_dir, None, "remove"), {"v": columns.Fill()}, Axis("z", -60.0, 6.0, 20), "remove", "pull", True)
    return got.select("iz", "iy", "ix", _r(F.col("v")).alias("v"))


def _topography(spark, sf_dir):
    """The whole run: the new surface and the mask are planes."""
    plane = Lattice((GY, GX))
    model = GridFrame(_relief(spark, sf_dir).select("iz", "iy", "ix", "v"), Lattice((Axis("z", -50.0, 10.0, 10), GY, GX)), ("v",))
    nodes = plane.nodes(spark)
    surface = GridFrame(nodes.select("iy", "ix", (F.col("iy") * 6.0 - 10).alias("s")), plane, ("s",))
    mask = GridFrame(nodes.select("iy", "ix", F.when(F.col("iy") < 7, 1.0).otherwise(0.0).alias("m")), plane, ("m",))
    return programs.topography(model, surface, mask=mask, fills={"v": columns.Fill(-1.0, -2.0)}, levels=Axis("z", -60.0, 6.0, 20), steps=programs.Steps(bridge=True))


@_query(SQL["column_pull"])
def topography_run(spark, sf_dir):
    return _topography(spark, sf_dir)[0].df.select("iz", "iy", "ix", _r(F.col("v")).alias("v"))


@_query(f"""WITH {_RELIEF}, s AS (SELECT iy, ix, CAST(max(z) AS DOUBLE) AS old, CASE WHEN iy < 7 THEN 1 ELSE 2 END AS class, iy * 6.0 - 10 AS req FROM relief GROUP BY iy, ix)
SELECT iy, ix, old, CAST(CASE WHEN class = 2 AND req > 0 THEN 0.0 ELSE req END AS DOUBLE) AS new, true AS modify, class, false AS conflict FROM s""")
def topography_report(spark, sf_dir):
    return _topography(spark, sf_dir)[1]


@_query(f"""WITH {_RELIEF}, s AS (SELECT iy, ix, max(z) AS old, min(z) AS base, CASE WHEN iy < 7 THEN 1 ELSE 2 END AS cls, iy * 6.0 - 10 AS req FROM relief GROUP BY iy, ix),
c AS (SELECT *, CASE WHEN cls = 2 AND req > 0 THEN 0.0 ELSE req END AS new FROM s)
SELECT CAST(floor(min(base + new - old) / 10.0) * 10 AS DOUBLE) AS lo, CAST(ceil(max(new) / 10.0) * 10 AS DOUBLE) AS hi FROM c""")
def auto_axis(spark, sf_dir):
    ends = _relief(spark, sf_dir).where("v IS NOT NULL").groupBy("iy", "ix").agg(F.min("z").alias("base"), F.max("z").alias("surface"))
    return columns.output_range(_shifted(spark, sf_dir), ends, 10.0)


# Random fields --------------------------------------------------------------------------------------------------

_LINE = Lattice((Axis("x", 0.0, 1.0, 101),))
_HOURS = Lattice((Axis("x", 0.0, 1.0, 720),))
_PLANE = Lattice((Axis("y", 0.0, 1.0, 24), Axis("x", 0.0, 1.0, 30)))


def _stats(model: str, dims: int):
    return {"v": heterogeneity.Statistics(0.05, () if model == "w" else (8.0,) * dims, 0.3, model)}


def _spread(df):
    return df.agg(F.count(F.lit(1)).alias("n"), _r(F.avg("v_heterogeneity"), 9).alias("mean"), F.round(F.stddev_samp("v_heterogeneity"), 9).alias("deviation"))


for _model, _word in (("w", "white"), ("v", "vonkarman"), ("g", "gaussian"), ("e", "exponential")):
    _query("SELECT CAST(101 AS BIGINT) AS n, 0.0 AS mean, 0.05 AS deviation", f"hetero_{_word}_stats")(lambda s, d, m=_model: _spread(heterogeneity.heterogeneity(s, _LINE, _stats(m, 1), 42)))
_query(name="hetero_plane")(lambda s, d: heterogeneity.heterogeneity(s, _PLANE, _stats("v", 2), 7))


@_query("SELECT CAST(i AS INTEGER) AS ix, round((CASE WHEN (i + 0.5) / 20.2 < 1 THEN (1 - cos(pi() * (i + 0.5) / 20.2)) / 2 ELSE 1.0 END) * (CASE WHEN (100.5 - i) / 20.2 < 1 THEN (1 - cos(pi() * (100.5 - i) / 20.2)) / 2 ELSE 1.0 END), 9) AS taper FROM range(101) r(i)")
def hetero_taper(spark, sf_dir):
    got = heterogeneity.heterogeneity(spark, _LINE, _stats("w", 1), 3, support=supports.box_support(_LINE, {}))
    return got.select("ix", F.round("taper", 9).alias("taper"))


@_query()
def perturb_run(spark, sf_dir):
    """The whole run on the cube: a random field of its price, anisotropic and tapered."""
    model = GridFrame(cube(spark, sf_dir).select("iz", "iy", "ix", "v"), Lattice((GZ, GY, GX)), ("v",))
    return programs.perturb(model, {"v": heterogeneity.Statistics(0.05, (3.0, 2.0, 20.0))}, 11, tapers={a: supports.Taper() for a in "xyz"})[0].df


@_query()
def hetero_apply(spark, sf_dir):
    model = hourly(spark, sf_dir).select("kind", "ix", "v")
    return heterogeneity.apply_heterogeneity(model, heterogeneity.heterogeneity(spark, _HOURS, _stats("e", 1), 5), ["ix"], ["v"])
