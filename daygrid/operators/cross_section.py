"""Cross-sectional and statistical primitives (X operators).

`max_names` is the checked upper bound of rows per group.  Within
`Settings.window_names_limit` a group is one window partition; beyond it, or
when no bound is known, the exact split of `ordered` is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import SETTINGS, VALUE_BUCKETS
from daygrid.functions.rolling import DATE, ENTITY, chg, clip, corr_of, ratio, roll, roll_corr
from daygrid.operators import ordered
from daygrid.sources.store import by_names


def fits_window(max_names: int | None) -> bool:
    return max_names is not None and max_names <= SETTINGS.window_names_limit


def count_names(entities: DataFrame, key: str = ENTITY) -> int:
    """Size of the entity list: the bound of every cross-section of a dense panel."""
    return entities.select(F.count_distinct(key)).first()[0]


def rank_z_column(value: str, by: list[str], min_names: int = SETTINGS.min_names_rank) -> Column:
    """Rank z-score as window expressions sharing one sort."""
    x = F.col(value)
    order = Window.partitionBy(*by).orderBy(x.asc_nulls_last())
    n = F.count(x).over(Window.partitionBy(*by))
    avg_rank = (F.rank().over(order) + F.count(x).over(order)) / 2.0
    return F.when(x.isNotNull() & (n >= min_names), F.try_divide(avg_rank - (n + 1) / 2.0, F.sqrt((n * n - 1) / 12.0)))


def winsorise(df: DataFrame, value: str, by: list[str], out: str, max_names: int | None = None,
              lower: float | None = SETTINGS.winsor_lower, upper: float | None = SETTINGS.winsor_upper) -> DataFrame:
    """Clip to linear-interpolated quantiles of the group; one side may be left open."""
    qs = {name: q for name, q in (("_lo", lower), ("_hi", upper)) if q is not None}
    if fits_window(max_names):
        w = Window.partitionBy(*by)
        cut = by_names(df, max_names, by).withColumns({name: F.percentile(value, F.lit(q)).over(w) for name, q in qs.items()})
    else:
        cut = df.join(ordered.group_quantiles(df, by, value, qs), by, "left")
    lo = F.col("_lo") if lower is not None else None
    hi = F.col("_hi") if upper is not None else None
    return cut.withColumn(out, clip(value, lo, hi)).drop(*qs)


def rank_z(df: DataFrame, value: str, by: list[str], out: str, max_names: int | None = None, winsor: bool = False) -> DataFrame:
    """Rank z-score per group.

    Winsorising moves ranks only where at least two names lie beyond a cut,
    which needs more than 100 names, so smaller bounded groups skip it.
    """
    if not fits_window(max_names):
        n = F.col("n_names")
        z = F.when(n >= SETTINGS.min_names_rank, F.try_divide(F.col("avg_rank") - (n + 1) / 2.0, F.sqrt((n * n - 1) / 12.0)))
        ranked = (ordered.winsorised_ranks(df, by, value, SETTINGS.winsor_lower, SETTINGS.winsor_upper) if winsor
                  else ordered.average_ranks(df, by, value))
        return ranked.withColumn(out, z).drop("avg_rank", "n_names")
    src = value
    if winsor and max_names > 100:
        df, src = winsorise(df, value, by, "_w", max_names), "_w"
    return df.withColumn(out, rank_z_column(src, by)).drop("_w")


def rank_ic(df: DataFrame, signal: str, ret: str, by: list[str], max_names: int | None = None) -> DataFrame:
    """Spearman of signal and return per group over complete pairs; null under five pairs."""
    pairs = df.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    if fits_window(max_names):
        w = Window.partitionBy(*by)
        for x, r in ((signal, "_rs"), (ret, "_rr")):
            order = w.orderBy(x)
            pairs = pairs.withColumn(r, (F.rank().over(order) + F.count(x).over(order)) / 2.0)
    else:
        pairs = ordered.average_ranks(pairs, by, signal, "_rs", "_ns")
        pairs = ordered.average_ranks(pairs, by, ret, "_rr", "_nr")
    return pairs.groupBy(*by).agg(
        F.when(F.count("*") >= SETTINGS.min_names_ic, corr_of("_rs", "_rr")).alias("ic"),
        F.count("*").alias("n_pairs"),
    )


def rolling_ic(ic: DataFrame, window: int = 13) -> DataFrame:
    """Rolling mean of a one-row-per-date IC table."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    return ic.withColumn("rolling_ic", roll(F.avg, "ic", window, max(3, window // 2), w))


def ic_summary(ic: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population deviation, information ratio, share positive and count.

    A coefficient within floating-point noise of zero is not positive.
    """
    x = F.col("ic")
    base = ic.where(x.isNotNull()).groupBy(*by).agg(
        F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.avg((x > 1e-12).cast("double")).alias("p"), F.count(x).alias("n")
    )
    return base.select(
        *by, F.round("m", 4).alias("mean_ic"), F.round("s", 4).alias("ic_std"),
        F.round(F.when(F.col("s") > 0, F.col("m") / F.col("s")), 4).alias("ic_ir"),
        F.round("p", 4).alias("pct_positive"), F.col("n").alias("n_periods"),
    )


def complete_rank_vectors(df: DataFrame, signals: list[str], keys: list[str]) -> DataFrame:
    """One column of whole-table average ranks per signal, over rows where all are present.

    All signals are ranked in one pass: unpivoted, split by value range, pivoted back.
    """
    long = df.dropna(subset=signals).unpivot(keys, signals, "signal", "_v")
    ranked = ordered.average_ranks(long, ["signal"], "_v", "_r", "_n")
    return ranked.groupBy(*keys).pivot("signal", signals).agg(F.max("_r"))


def pairwise_spearman(df: DataFrame, signals: list[str], keys: list[str]) -> DataFrame:
    """Long (left, right, corr) table: every pair is one aggregate over the same scan."""
    ranked = complete_rank_vectors(df, signals, keys)
    pairs = [(a, b) for i, a in enumerate(signals) for b in signals[i + 1:]]
    row = ranked.agg(*[corr_of(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    entries = F.array(*[
        F.struct(F.lit(a).alias("left_signal"), F.lit(b).alias("right_signal"), F.col(f"c{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ])
    return row.select(F.inline(entries))


def high_correlations(pairs: DataFrame, limit: float = SETTINGS.max_pairwise_corr, top: int | None = None) -> DataFrame:
    """Pairs beyond the limit, all or the `top` strongest."""
    rows = pairs.where(F.abs("corr") > limit)
    return rows if top is None else rows.orderBy(F.abs("corr").desc(), "left_signal", "right_signal").limit(top)


def min_observations(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    nonzero = F.count_if(F.col(value) != 0)
    return df.groupBy(*by).agg(nonzero.alias("n_nonzero"), (nonzero >= SETTINGS.min_nonzero_obs).alias("enough"))


def growth_ratio(df: DataFrame, value: str, out: str) -> DataFrame:
    """Two-week over four-week change of the weekly mean."""
    smooth = df.withColumn("_s", roll(F.avg, value, 7, 3))
    return smooth.withColumns({"_g2": chg("_s", 14), "_g4": chg("_s", 28)}).withColumn(out, ratio("_g2", "_g4")).drop("_s", "_g2", "_g4")


def rolling_corr_observed(df: DataFrame, x: str, y: str, window: int, min_obs: int, out: str, keys: tuple[str, ...] = (ENTITY,)) -> DataFrame:
    """Rolling correlation over observed pairs, not days; null until `min_obs` pairs.

    The pair rows are ordered apart from the gap rows inside the same entity
    partition, so no second copy of the panel is joined back.
    """
    paired = F.col(x).isNotNull() & F.col(y).isNotNull()
    w = Window.partitionBy(*keys, "_pair").orderBy(DATE)
    total = F.count("*").over(Window.partitionBy(*keys, "_pair"))
    return (
        df.withColumn("_pair", paired)
        .withColumn(out, F.when(F.col("_pair") & (total >= min_obs), roll_corr(x, y, window, min_obs, w)))
        .drop("_pair")
    )


def versus_group_median(df: DataFrame, value: str, by: list[str], out: str, max_names: int | None = None) -> DataFrame:
    """Percent difference from the median of the peer group."""
    if fits_window(max_names):
        base = df.withColumn("_m", F.median(value).over(Window.partitionBy(*by)))
    else:
        base = df.join(ordered.group_quantiles(df, by, value, {"_m": 0.5}), by, "left")
    return base.withColumn(out, (ratio(value, "_m") - 1.0) * 100.0).drop("_m")


def value_bucket(value: Column | str) -> Column:
    x = F.col(value) if isinstance(value, str) else value
    out = None
    for label, low, high in VALUE_BUCKETS:
        hit = (x >= low) if high is None else (x >= low) & (x < high)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("Unknown")


def peer_normalise(df: DataFrame, value: str, by: list[str], out: str, max_names: int | None = None) -> DataFrame:
    """(x - median) / IQR; the sample deviation, then 1, where the IQR is empty."""
    qs = {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75}
    if fits_window(max_names):
        w = Window.partitionBy(*by)
        base = df.withColumns({k: F.percentile(value, F.lit(q)).over(w) for k, q in qs.items()} | {"_sd": F.stddev_samp(value).over(w)})
    else:
        base = df.join(ordered.group_quantiles(df, by, value, qs), by, "left").join(
            df.groupBy(*by).agg(F.stddev_samp(value).alias("_sd")), by, "left")
    iqr = F.col("_q3") - F.col("_q1")
    scale = F.when(iqr > 0, iqr).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0)
    return base.withColumn(out, (F.col(value) - F.col("_q2")) / scale).drop("_q1", "_q2", "_q3", "_sd")


def share(mask: Column, eligible: Column | None = None) -> Column:
    """Aggregate: percent of eligible rows where the mask holds, null without eligible rows."""
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    return F.avg(F.when(ok, F.coalesce(mask, F.lit(False)).cast("double"))) * 100.0


def over_benchmark(price: str, bench: str) -> Column:
    return (chg(price, 1) - chg(bench, 1)) * 100.0


