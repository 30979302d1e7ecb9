"""Panel construction and alignment (P operators).

The panel is one long table: a row per entity and day, a column per metric.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import SETTINGS, Periods
from daygrid.functions.rolling import DATE, ENTITY, by_entity, ffill, lag, ratio
from daygrid.sources.store import by_names


def last_of_day(value: Column, *order: Column) -> Column:
    """Aggregate: value of the last row of the day in the given order."""
    return F.max_by(value, F.struct(*order))


def to_number(x: Column | str) -> Column:
    """Numeric coercion: text that is no number, and NaN, become null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.nanvl(x.try_cast("double"), F.lit(None).cast("double"))


def calendar(sources: list[DataFrame], start=None, end=None) -> DataFrame:
    """Dense day range over all sources, one row per day, clipped to the window."""
    bounds = sources[0].select(DATE)
    for s in sources[1:]:
        bounds = bounds.unionByName(s.select(DATE))
    lo, hi = F.min(DATE), F.max(DATE)
    if start is not None:
        lo = F.least(lo, F.lit(start))
    if end is not None:
        hi = F.least(hi, F.lit(end))
    return bounds.agg(lo.alias("lo"), hi.alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias(DATE))


def densify(daily: DataFrame, entities: DataFrame, bounds: DataFrame, metrics: list[str], names: int | None = None) -> DataFrame:
    """A row for every entity and day of the calendar; gaps are null.

    `bounds` is one row (lo, hi).  Each entity gets a seed row on the first
    day, and every row is stretched to the day before its successor, so the
    grid grows inside the entity partitions: one shuffle on entity, no product
    of entities and days, and later entity windows reuse the partitioning.
    `names`, the number of entities if known, decides how many tasks share them.
    """
    ends = bounds.select(F.struct("lo", "hi").alias("b")).scalar()
    lo, hi = ends["lo"], ends["hi"]
    # seeds carry no metric; the day they share with a real row is dropped again
    seeded = (
        daily.select(ENTITY, DATE, *metrics, F.lit(False).alias("_seed"))
        .unionByName(entities.select(ENTITY, lo.alias(DATE), F.lit(True).alias("_seed")), allowMissingColumns=True)
        .where((F.col(DATE) >= lo) & (F.col(DATE) <= hi))
    )
    order = Window.partitionBy(ENTITY).orderBy(DATE, F.col("_seed").desc())
    stretched = by_names(seeded, names, [ENTITY]).withColumn("_next", F.coalesce(F.lead(DATE).over(order), F.date_add(hi, 1))).where(
        F.col("_next") > F.col(DATE)
    )
    return stretched.select(
        ENTITY, F.col(DATE).alias("_obs"), *metrics, F.explode(F.sequence(DATE, F.date_sub("_next", 1))).alias(DATE)
    ).select(ENTITY, DATE, *[F.when(F.col(DATE) == F.col("_obs"), F.col(m)).alias(m) for m in metrics])


def align(daily: DataFrame, entities: DataFrame, bounds: DataFrame, metrics: list[str], max_fill: int = SETTINGS.max_fill_days) -> DataFrame:
    """Dense grid with gaps carried forward at most `max_fill` days."""
    dense = densify(daily, entities, bounds, metrics)
    return dense.select(ENTITY, DATE, *[ffill(m, max_fill).alias(m) for m in metrics])


def date_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min(DATE).alias("lo"), F.max(DATE).alias("hi"))


def combine_first(left: DataFrame, right: DataFrame, metrics: list[str], keys: tuple[str, ...] = (ENTITY, DATE)) -> DataFrame:
    """Cell-wise precedence: left where not null, else right; union of keys."""
    l = left.select(*keys, *[F.col(m).alias(f"_l_{m}") for m in metrics])
    r = right.select(*keys, *[F.col(m).alias(f"_r_{m}") for m in metrics])
    return l.join(r, list(keys), "full").select(*keys, *[F.coalesce(f"_l_{m}", f"_r_{m}").alias(m) for m in metrics])


def union_first(frames: list[DataFrame], metrics: list[str], keys: tuple[str, ...] = (ENTITY, DATE)) -> DataFrame:
    """Cell-wise precedence of any number of sources in one shuffle."""
    ranked = [f.select(*keys, *metrics).withColumn("_p", F.lit(i)) for i, f in enumerate(frames)]
    out = ranked[0]
    for f in ranked[1:]:
        out = out.unionByName(f)
    return out.groupBy(*keys).agg(*[F.min_by(m, F.when(F.col(m).isNotNull(), F.col("_p"))).alias(m) for m in metrics])


def static_panel(panel: DataFrame, snapshot: DataFrame, values: list[str]) -> DataFrame:
    """Repeat one snapshot value per entity over the grid."""
    return panel.join(snapshot.select(ENTITY, *values), ENTITY, "left")


def latest_values(df: DataFrame, metrics: list[str], key: str = ENTITY) -> DataFrame:
    """Latest non-null value of every metric per entity."""
    return df.groupBy(key).agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col(DATE))).alias(m) for m in metrics])


def lag_information(panel: DataFrame, metrics: list[str], prefix: str = "lag1_") -> DataFrame:
    return panel.withColumns({f"{prefix}{m}": lag(m, 1) for m in metrics})


def mcap_proxy(panel: DataFrame, snapshot: DataFrame) -> DataFrame:
    """History first, else price scaled by current cap over current price, with its source.

    `snapshot` has entity, current_price, current_mcap.
    """
    joined = panel.join(snapshot.select(ENTITY, "current_price", "current_mcap"), ENTITY, "left")
    proxy = F.col("price") * ratio("current_mcap", "current_price")
    source = F.when(F.col("mcap").isNotNull(), "history").when(proxy.isNotNull(), "proxy")
    return joined.withColumns({"mcap_source": source, "mcap": F.coalesce("mcap", proxy)}).drop("current_price", "current_mcap")


def fan_out(series: DataFrame, mapping: DataFrame, source_key: str) -> DataFrame:
    """One source series feeds every entity mapped to it; unmapped ids keep their own name."""
    return (
        series.join(mapping.select(F.col("source_id").alias(source_key), F.col(ENTITY).alias("_to")), source_key, "left")
        .withColumn(ENTITY, F.coalesce("_to", source_key)).drop("_to")
    )


def to_long(panel: DataFrame, columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return panel.unpivot([ENTITY, DATE], columns, name, value)


def to_wide(long: DataFrame, columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return long.groupBy(ENTITY, DATE).pivot(name, columns).agg(F.max(value))


def columns_with_prefix(dataset: DataFrame, prefix: str) -> DataFrame:
    """Key and the columns of one group of the stored dataset, prefix removed."""
    found = [c for c in dataset.columns if c.startswith(prefix)]
    return dataset.select(ENTITY, DATE, *[F.col(c).alias(c[len(prefix):]) for c in found])


def period_label(date: Column | str, p: Periods) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return (
        F.when(d.between(F.lit(p.train_start), F.lit(p.train_end)), "Train")
        .when(d.between(F.lit(p.validation_start), F.lit(p.validation_end)), "Validation")
        .when(d >= F.lit(p.test_start), "Test").otherwise("OutOfSampleGap")
    )


def trailing_days(df: DataFrame, days: int = SETTINGS.display_days) -> DataFrame:
    """Rows of the last `days` calendar days of the data itself."""
    last = df.agg(F.max(DATE)).scalar()
    return df.where(F.col(DATE) >= F.date_sub(last, days - 1))


def series_flags(df: DataFrame, value: str, window: int = 30) -> DataFrame:
    """Per entity over its last 30 observations: distinct values, absolute change, flat or not."""
    obs = df.where(F.col(value).isNotNull())
    recent = (
        obs.withColumn("_rn", F.row_number().over(Window.partitionBy(ENTITY).orderBy(F.col(DATE).desc())))
        .where(F.col("_rn") <= window)
        .withColumn("_c", F.abs(F.try_divide(F.col(value), F.lag(value).over(by_entity())) - 1.0))
    )
    n, distinct, moved = F.count("*"), F.count_distinct(value), F.coalesce(F.sum("_c"), F.lit(0.0))
    return recent.groupBy(ENTITY).agg(
        n.alias("n_obs"), distinct.alias("n_distinct"), moved.alias("abs_change"),
        ((n >= 7) & ((distinct <= 2) | (moved < 1e-8))).alias("is_flat"),
    )


def choose_venue(spot: DataFrame, futures: DataFrame) -> DataFrame:
    """Spot price and volume, the futures series where spot is missing, flat or without volume.

    Whole series are taken, never single days, as the choice is per entity.
    """
    flat = series_flags(spot, "price").select(ENTITY, F.col("is_flat").alias("_flat"))
    recent = (
        spot.where(F.col("volume").isNotNull())
        .withColumn("_rn", F.row_number().over(Window.partitionBy(ENTITY).orderBy(F.col(DATE).desc())))
        .where(F.col("_rn") <= 30).groupBy(ENTITY).agg(F.sum("volume").alias("_v30"))
    )
    fut = futures.select(ENTITY).distinct().withColumn("_fut", F.lit(True))
    choice = (
        spot.select(ENTITY).distinct().withColumn("_spot", F.lit(True))
        .join(fut, ENTITY, "full").join(flat, ENTITY, "left").join(recent, ENTITY, "left")
    )
    has_fut = F.coalesce("_fut", F.lit(False))
    use_fut_price = has_fut & (F.col("_spot").isNull() | F.coalesce("_flat", F.lit(False)))
    use_fut_vol = has_fut & (F.col("_spot").isNull() | (F.coalesce("_v30", F.lit(0.0)) <= 0))
    choice = choice.select(ENTITY, use_fut_price.alias("_fp"), use_fut_vol.alias("_fv"))
    both = spot.select(ENTITY, DATE, "price", "volume", F.lit("spot").alias("_venue")).unionByName(
        futures.select(ENTITY, DATE, "price", "volume", F.lit("futures").alias("_venue")))
    tagged = both.join(choice, ENTITY)
    is_fut = F.col("_venue") == "futures"
    return tagged.groupBy(ENTITY, DATE).agg(
        F.max(F.when(is_fut == F.col("_fp"), F.col("price"))).alias("price"),
        F.max(F.when(is_fut == F.col("_fv"), F.col("volume"))).alias("volume"),
        F.max(F.when(F.col("_fp"), "futures").otherwise("spot")).alias("price_venue"),
    ).where(F.col("price").isNotNull() | F.col("volume").isNotNull())


def sum_children(canonical: DataFrame, children: DataFrame, value: str) -> DataFrame:
    """The canonical series of an entity if it has any data, else the sum of its children per day."""
    has = canonical.where(F.col(value).isNotNull()).select(ENTITY).distinct()
    summed = children.groupBy(ENTITY, DATE).agg(F.sum(value).alias(value)).join(has, ENTITY, "left_anti")
    return canonical.join(has, ENTITY, "left_semi").select(ENTITY, DATE, value).unionByName(summed.select(ENTITY, DATE, value))


def fill_missing_entities(primary: DataFrame, fallback: DataFrame, value: str) -> DataFrame:
    """Fallback series only for entities the primary source lacks altogether."""
    covered = primary.where(F.col(value).isNotNull()).select(ENTITY).distinct()
    return primary.select(ENTITY, DATE, value).unionByName(fallback.join(covered, ENTITY, "left_anti").select(ENTITY, DATE, value))


def annualised_funding(rates: DataFrame, key: str, time: str, rate: str, last: int = 21) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(time).desc(), F.col(rate).desc())
    recent = rates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last)
    return recent.groupBy(key).agg((F.avg(rate) * (3 * 365 * 100)).alias("funding_annualised"), F.count("*").alias("n_rates"))


def upsert_first(fresh: DataFrame, cached: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Fresh rows before cached ones, the first row per key."""
    both = fresh.withColumn("_p", F.lit(0)).unionByName(cached.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_p", *order)
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_p")


def fallback_sources(master: DataFrame, size: Column) -> DataFrame:
    """Entities lacking a spot venue (or chains), best first, one row per source id."""
    rows = master.where(F.col("source_id").isNotNull() & (F.col("spot_symbol").isNull() | (F.col("asset_type") == "chain")))
    priority = F.col("spot_symbol").isNull().cast("int") * 2 + F.col("futures_symbol").isNotNull().cast("int")
    rows = rows.withColumns({"priority": priority, "size": size})
    w = Window.partitionBy("source_id").orderBy(F.desc("priority"), F.desc_nulls_last("size"), ENTITY)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def metric_by_type(series: DataFrame, master: DataFrame, metric_map: DataFrame) -> DataFrame:
    """Vendor metrics whose ids differ by asset type; ids of one metric merge by precedence.

    metric_map: asset_type, vendor_metric, metric, precedence.
    """
    typed = series.join(master.select("source_id", ENTITY, "asset_type"), "source_id").join(
        metric_map, ["asset_type", "vendor_metric"])
    return typed.groupBy(ENTITY, "metric", DATE).agg(
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("precedence"))).alias("value"))
