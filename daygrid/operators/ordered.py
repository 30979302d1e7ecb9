"""Exact order statistics of groups of any size.

One group (a date, a category) may hold a third of the table, so it is never
sorted by a single task here.  Equal values are first merged by a partial
aggregation; each group is then cut into value ranges at approximate
quantiles, ranges are sorted in parallel, and the counts of the lower ranges
are added as an offset.  The cut points only decide who sorts what: the
resulting positions are exact whatever the sketch returns.

Ranks and quantiles of rows (`placed`) need no merging and no join on values:
rows are dealt by ranges of (group, value), each range is ranked by itself, and
a table with a row per group and range brings the counts below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import SETTINGS
from daygrid.sources.store import saved


def cumulative_counts(df: DataFrame, by: list[str], value: str, ranges: int = SETTINGS.value_ranges) -> DataFrame:
    """Distinct (by, value) with `ties`, `upto` (rows <= value) and group size `n`."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("ties"))
    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    edges = counts.groupBy(*by).agg(
        F.percentile_approx(value, cuts, 1000).alias("edges"), F.sum("ties").alias("n")
    )
    ranged = counts.join(edges, by).withColumn("range_id", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")
    inside = Window.partitionBy(*by, "range_id").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy(*by).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*by, "range_id").agg(F.sum("ties").alias("size"))
        .select(*by, "range_id", F.coalesce(F.sum("size").over(below), F.lit(0)).alias("offset"))
    )
    return (
        ranged.withColumn("inside", F.sum("ties").over(inside))
        .join(offsets, [*by, "range_id"])
        .select(*by, value, "ties", (F.col("inside") + F.col("offset")).alias("upto"), "n")
    )


def quantile_columns(value: str, qs: dict[str, float]) -> list[Column]:
    """Aggregates over `cumulative_counts` rows: linear-interpolated exact quantiles."""
    out = []
    for name, q in qs.items():
        position = (F.max("n") - 1) * F.lit(q)
        # the position is the same for every row of a group, so it can be taken per row
        row_pos = (F.col("n") - 1) * F.lit(q)
        low = F.min(F.when(F.col("upto") > F.floor(row_pos), F.col(value)))
        high = F.min(F.when(F.col("upto") > F.ceil(row_pos), F.col(value)))
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return out


def placed(df: DataFrame, by: list[str], value: str, keep: list[str] | None = None) -> DataFrame:
    """Every row with `_below` (rows of its group under its value), `_ties` (with its value) and `_size` (with any).

    A range holds about `Settings.range_rows` rows and is one task, so more rows make more ranges, not larger sorts.
    The value's rows may fill several ranges (a hash of the row is part of the range key), so a date or a tie that
    holds most rows spreads over tasks.  Only the first and last value of a range can go on in others; their
    places come from the table of ranges, all others' from the range itself.  Null values, and rows of
    a null group, have nulls.  With `keep`, only these columns are returned; the others still tell rows of a tie apart.
    """
    keep = df.columns if keep is None else keep
    salt = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name, kind in df.dtypes if not kind.startswith("map")]), F.lit(1 << 15)).cast("short")
    n = max(1, -(-df.count() // SETTINGS.range_rows))
    ranged = df.select(*[F.col(f"`{c}`") for c in keep], salt.alias("_salt")).repartitionByRange(n, *by, value, "_salt").drop("_salt").withColumn("_range", F.spark_partition_id())
    key, v = ["_range", *by], F.col(value)
    order = Window.partitionBy(*key).orderBy(v.asc_nulls_last())
    counted = ranged.repartitionById(n, F.col("_range")).withColumns({"_first": F.rank().over(order), "_upto": F.count(v).over(order)})
    rows = saved(counted.withColumn("_here", F.when(v.isNotNull(), F.col("_upto") - F.col("_first") + 1)).drop("_first"), "ranges")
    ranges = rows.where(v.isNotNull()).groupBy(*key).agg(
        F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.min_by("_here", v).alias("lo_ties"), F.max_by("_here", v).alias("hi_ties"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({"offset": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "_size": F.sum("n").over(group)})
    end = lambda x, ties, start: F.struct(F.col(x).alias("v"), F.col(ties).alias("ties"), start.alias("start"))
    first, last = end("lo", "lo_ties", F.col("offset")), end("hi", "hi_ties", F.col("offset") + F.col("n") - F.col("hi_ties"))
    ends = ranges.select(*key, "offset", "_size", "lo", F.explode(F.when(F.col("lo") == F.col("hi"), F.array(first)).otherwise(F.array(first, last))).alias("e"))
    same = Window.partitionBy(*by, "e.v")
    ends = ends.withColumns({"start": F.min("e.start").over(same), "ties": F.sum("e.ties").over(same), "is_lo": F.col("e.v") == F.col("lo")})
    pick = lambda c, lo: F.max(F.when(F.col("is_lo") == F.lit(lo), F.col(c)))
    # written, so that its size is known before it is joined: small tables travel, the rows stay
    borders = saved(ends.groupBy(*key).agg(
        F.max("offset").alias("_offset"), F.max("_size").alias("_size"), F.max("lo").alias("_lo"), pick("start", True).alias("_lo_start"), pick("ties", True).alias("_lo_ties"),
        pick("e.v", False).alias("_hi"), pick("start", False).alias("_hi_start"), pick("ties", False).alias("_hi_ties")), "borders")
    at = lambda lo, hi, inside: F.when(v == F.col("_lo"), F.col(lo)).when(v == F.col("_hi"), F.col(hi)).when(v.isNotNull(), inside)
    return rows.join(borders, key, "left").select(
        *[F.col(f"`{c}`") for c in keep], at("_lo_start", "_hi_start", F.col("_offset") + F.col("_upto") - F.col("_here")).alias("_below"),
        at("_lo_ties", "_hi_ties", F.when(F.col("_size").isNotNull(), F.col("_here"))).alias("_ties"), F.when(v.isNotNull(), F.col("_size")).alias("_size"))


def _quantiles_of(rows: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """A row per group, written, so that joins know how small it is."""
    counted = rows.where(F.col("_size").isNotNull()).select(*by, value, (F.col("_below") + F.col("_ties")).alias("upto"), F.col("_size").alias("n"))
    return saved(counted.groupBy(*by).agg(*quantile_columns(value, qs)), "quantiles")


def group_quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    return _quantiles_of(placed(df, by, value, [*by, value]), by, value, qs)


def average_ranks(df: DataFrame, by: list[str], value: str, rank: str = "avg_rank", size: str = "n_names") -> DataFrame:
    """Average rank (1-based, ties share) of `value` within `by`, null for null."""
    return (
        placed(df, by, value)
        .withColumns({rank: F.col("_below") + (F.col("_ties") + 1) / 2.0, size: F.col("_size")})
        .drop("_below", "_ties", "_size")
    )


def winsorised_ranks(df: DataFrame, by: list[str], value: str, lower: float, upper: float, rank: str = "avg_rank", size: str = "n_names") -> DataFrame:
    """Average ranks of `value` clipped to two quantiles of its group, from one ranking of the unclipped values.

    Clipping only makes ties of the rows up to the lower cut and of those from the upper one; their numbers
    are a second aggregate over the same written rows.
    """
    rows, v = placed(df, by, value), F.col(value)
    cut = rows.join(_quantiles_of(rows, by, value, {"_q0": lower, "_q1": upper}), by, "left")
    ends = saved(cut.groupBy(*by).agg(F.count_if(v <= F.col("_q0")).alias("_low"), F.count_if(v >= F.col("_q1")).alias("_high"), F.max("_q0").alias("_q0"), F.max("_q1").alias("_q1")), "ends")
    n = F.col("_size")
    clipped = (
        F.when(F.col("_q0") == F.col("_q1"), (n + 1) / 2.0).when(v <= F.col("_q0"), (F.col("_low") + 1) / 2.0)
        .when(v >= F.col("_q1"), n - (F.col("_high") - 1) / 2.0).otherwise(F.col("_below") + (F.col("_ties") + 1) / 2.0)
    )
    return rows.join(ends, by, "left").withColumns({rank: F.when(v.isNotNull(), clipped), size: n}).drop("_below", "_ties", "_size", "_low", "_high", "_q0", "_q1")
