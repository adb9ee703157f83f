"""Merging of overlapping sources, node by node.

All operators take one relation: a row for each record and node that the record's primary domain covers, with
  rec        the record's place in the order, which is part of the meaning
  <keys>     node indices
  p_<f>      the primary's value of field f (null: missing)
  s_<f>      the paired secondary's value
  w          the record's weight at the node, null outside its support
  pair       whether the record has a secondary
  prim, sec  names of the sources (sec null if unpaired)
First-come rules are aggregates by record number, so nothing is sorted and partial aggregation applies; a node's rows
meet once. Dialects: "series" and "cube" differ from "grid" where said.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOW = ("first", "lowest", "last", "highest")


def _first(value, rec):
    """The value at the smallest rec that isn't null."""
    return F.min_by(value, rec)


def clobber(rows: DataFrame, keys: list[str], fields: list[str], how: str = "first", sign: str | None = None, dialect: str = "series") -> DataFrame:
    """keys, fields, weight (1 where a record covers). sign: "+" or "-" lets only such values replace the first one.

    In the grid dialect with a sign, the first value only stands in until the first later value with that sign, from
    which the rule then goes on.
    """
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    by_node = Window.partitionBy(*keys)
    out = []
    for f in fields:
        v, first = F.col(f"p_{f}"), F.col(f"__first_{f}")
        rows = rows.withColumn(f"__first_{f}", F.min(F.when(v.isNotNull(), F.col("rec"))).over(by_node)) if sign else rows
        if not sign:
            out.append(_pick(v, F.when(v.isNotNull(), F.col("rec")), how).alias(f))
            continue
        allowed = v >= 0 if sign == "+" else v <= 0
        later = F.when(v.isNotNull() & (F.col("rec") > first) & allowed, F.col("rec"))
        both = F.when(v.isNotNull() & ((F.col("rec") == first) | later.isNotNull()), F.col("rec"))
        if dialect == "grid":
            alone = F.min_by(v, F.when(F.col("rec") == first, F.col("rec")))
            out.append(F.coalesce(_pick(F.when(later.isNotNull(), v), later, how), alone).alias(f))
        else:
            out.append(_pick(F.when(both.isNotNull(), v), both, how).alias(f))
    return rows.groupBy(*keys).agg(*out, F.lit(1.0).alias("weight"))


def _pick(v, rec, how):
    return {"first": lambda: F.min_by(v, rec), "last": lambda: F.max_by(v, rec), "lowest": lambda: F.min(v), "highest": lambda: F.max(v)}[how]()


def _blended(p, s, w, pair, pair_fill: bool):
    """The value of the record that owns a node."""
    missing = s if pair_fill else F.lit(None).cast("double")
    return F.when(~pair, p).when(p.isNull(), missing).when(s.isNull(), p).otherwise(w * p + (1 - w) * s)


def blend(rows: DataFrame, keys: list[str], fields: list[str], pair_fill: bool = False) -> DataFrame:
    """The first record that claims a node gives the value: a paired one wherever it covers, an unpaired one where it has a value.

    Outside its support a paired record has weight 0, so the secondary shows.
    """
    out = []
    for f in fields:
        p, s = F.col(f"p_{f}"), F.col(f"s_{f}")
        claims = F.when(F.col("pair") | p.isNotNull(), F.col("rec"))
        value = _blended(p, s, F.coalesce("w", F.lit(0.0)), F.col("pair"), pair_fill)
        out.append(F.min_by(value, claims).alias(f))
    return rows.groupBy(*keys).agg(*out)


def aggregate(rows: DataFrame, keys: list[str], fields: list[str], pair_fill: bool = False, dialect: str = "series") -> DataFrame:
    """Blending in which overlapping primaries with the owner's secondary share the weight.

    The owner is the first record that covers; in the cube dialect an unpaired record without a value is passed over.
    """
    by_node = Window.partitionBy(*keys)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    w, sums, values = zero(F.col("w")), {}, {}
    # One window by node finds the owners for all fields, and one aggregate of the same rows adds them all up.
    owners = {}
    for k, f in enumerate(fields):
        can_own = F.col("pair") | F.col(f"p_{f}").isNotNull() if dialect == "cube" else F.lit(True)
        owners[f"__own{k}"] = F.min(F.when(can_own, F.struct("rec", "pair", "sec"))).over(by_node)
    rows = rows.withColumns(owners)
    for k, f in enumerate(fields):
        p, s, own = F.col(f"p_{f}"), F.col(f"s_{f}"), F.col(f"__own{k}")
        after = F.coalesce(F.col("rec") >= own["rec"], F.lit(False))
        shares = after & F.coalesce(own["pair"] & F.col("pair") & (F.col("sec") == own["sec"]) & (F.col("prim") != own["sec"]), F.lit(False))
        sums |= {
            f"g{k}": F.sum(F.when(shares & (w > 0), w)),
            f"gv{k}": F.sum(F.when(shares & (w > 0) & p.isNotNull(), w)),
            f"v{k}": F.sum(F.when(shares & (w > 0) & p.isNotNull(), w * p)),
            f"gs{k}": F.sum(F.when(shares & (w > 0) & p.isNull() & s.isNotNull(), w)) if pair_fill else F.max(F.lit(0.0)),
            f"vs{k}": F.sum(F.when(shares & (w > 0) & p.isNull() & s.isNotNull(), w * s)) if pair_fill else F.max(F.lit(0.0)),
            f"bg{k}": F.min_by(s, F.when(shares & s.isNotNull(), F.col("rec"))),
            f"first{k}": F.min_by(p, F.when(after & p.isNotNull() & (shares | ~own["pair"]), F.col("rec"))),
            f"paired{k}": F.max(F.when(after, own["pair"])),
        }
        g, gv, v, gs, vs, bg, first, paired = (F.col(f"{n}{k}") for n in ("g", "gv", "v", "gs", "vs", "bg", "first", "paired"))
        bw = F.when(bg.isNotNull(), F.greatest(F.lit(0.0), 1 - zero(g))).otherwise(0.0)
        below = zero(gv) + zero(gs) + bw
        mixed = (zero(v) + zero(vs) + bw * zero(bg)) / F.when(below > 0, below)
        values[f] = F.when(paired & (below > 0) & (first.isNotNull() | F.lit(pair_fill)), mixed).otherwise(first)
    got = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in sums.items()])
    got = got.where(F.coalesce(*[F.col(f"paired{k}") for k in range(len(fields))]).isNotNull())  # some record owns the node
    return got.select(*keys, *[c.alias(f) for f, c in values.items()])


def report_weight(rows: DataFrame, keys: list[str], aggregated: bool = False, dialect: str = "series") -> DataFrame:
    """keys, weight: of the first record that covers the node: 0 if it is unpaired, else the first support there.

    With aggregation, a positive weight is joined by later ones with the same secondary, up to 1. Nodes that no record
    has a weight for are 0, in the grid dialect null.
    """
    inside = F.col("w").isNotNull()
    decides = F.when(~F.col("pair") | inside, F.struct("rec", F.when(F.col("pair"), F.col("w")).otherwise(0.0).alias("w"), "sec", "pair"))
    got = rows.withColumn("__own", F.min(decides).over(Window.partitionBy(*keys)))
    own = F.max("__own.w")
    if aggregated:
        later = (F.col("rec") > F.col("__own.rec")) & F.col("pair") & (F.col("sec") == F.col("__own.sec")) & (F.col("w") > 0)
        own = F.when((own > 0) & F.max("__own.pair"), F.least(F.lit(1.0), own + F.coalesce(F.sum(F.when(later, F.col("w"))), F.lit(0.0)))).otherwise(own)
    none = F.lit(None).cast("double") if dialect == "grid" else F.lit(0.0)
    return got.groupBy(*keys).agg(F.coalesce(own, none).alias("weight"))


def overlap_conflicts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of records whose weights are both positive at a node though their secondaries differ; none may exist when aggregating.

    A later record whose primary is the earlier one's secondary is exempt. A node's records are summed up first, so
    what is compared are the distinct record sets, not nodes.
    """
    heavy = rows.where(F.col("pair") & (F.col("w") > 0))
    sets = heavy.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("rec", "prim", "sec"))).alias("recs")).select("recs").distinct()
    pairs = sets.select(F.explode(F.flatten(F.transform("recs", lambda a: F.transform(F.filter("recs", lambda b: (b["rec"] > a["rec"]) & (b["sec"] != a["sec"]) & (b["prim"] != a["sec"])), lambda b: F.struct(a["rec"].alias("earlier"), b["rec"].alias("later")))))).alias("x"))
    return pairs.select("x.*").distinct()


def validate_overlaps(rows: DataFrame, keys: list[str]) -> None:
    found = overlap_conflicts(rows, keys).limit(1).collect()
    if found:
        raise ValueError(f"records {found[0]['earlier']} and {found[0]['later']} overlap with different secondaries")
