"""Labels, folds and information coefficients (W operators)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import SETTINGS, Periods
from daygrid.functions.rolling import DATE, ENTITY, by_entity, corr_of, ratio
from daygrid.operators import cross_section as X
from daygrid.operators import ordered
from daygrid.sources.store import beside


def label_returns(panel: DataFrame, price: str = "price", prefix: str = "ret_", keep_legs: bool = False,
                  horizons: tuple[int, ...] = SETTINGS.horizons, keys: tuple[str, ...] = (ENTITY,)) -> DataFrame:
    """Enter one day after the signal, leave h days later: p[t+h+1] / p[t+1] - 1."""
    w = by_entity(*keys)
    entry = F.lead(price, 1).over(w)
    out = {}
    for h in horizons:
        leave = F.lead(price, h + 1).over(w)
        out[f"{prefix}{h}"] = ratio(leave, entry) - 1.0
        if keep_legs:
            out |= {f"entry_{h}": entry, f"exit_{h}": leave}
    return panel.withColumns(out)


def benchmark_returns(series: DataFrame, value: str = "btc") -> DataFrame:
    """Forward returns of a one-row-per-day series."""
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    return series.select(DATE, *[
        (ratio(F.lead(value, h + 1).over(w), F.lead(value, 1).over(w)) - 1.0).alias(f"btc_ret_{h}") for h in SETTINGS.horizons])


def period_bounds(period: str, horizon: int, last: Column, p: Periods) -> tuple[Column, Column]:
    """Purged bounds: period ends are pulled back h+1 days, and all by the last labelled date."""
    latest = F.date_sub(last, horizon + 1)
    purge = dt.timedelta(days=horizon + 1)
    if period == "Train":
        return F.lit(p.train_start), F.least(F.lit(p.train_end - purge), latest)
    if period == "Validation":
        return F.lit(p.validation_start), F.least(F.lit(p.validation_end - purge), latest)
    if period == "Test":
        return F.lit(p.test_start), latest
    raise ValueError(f"unknown period {period}")


def period_dates(days: DataFrame, period: str, horizon: int, p: Periods) -> DataFrame:
    lo, hi = period_bounds(period, horizon, days.agg(F.max(DATE)).scalar(), p)
    return days.where((F.col(DATE) >= lo) & (F.col(DATE) <= hi))


def every_kth(days: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Every k-th date, from the first; `days` has one row per date (and key)."""
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy(DATE)
    return days.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") - 1) % k == 0).drop("_rn")


def search_dates(days: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Every k-th date from the first, or all dates where there are k or fewer."""
    w = Window.partitionBy(*(by or (F.lit(0),)))
    ranked = days.withColumns({"_rn": F.row_number().over(w.orderBy(DATE)), "_n": F.count("*").over(w)})
    return ranked.where((F.col("_n") <= k) | ((F.col("_rn") - 1) % k == 0)).drop("_rn", "_n")


def rebalance_dates(days: DataFrame, period: str, horizon: int, p: Periods) -> DataFrame:
    return every_kth(period_dates(days, period, horizon, p), horizon)


def _add_months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(y, m + 1, min(d.day, last))


def walk_forward_folds(days: DataFrame, p: Periods, horizon: int = SETTINGS.primary_horizon,
                       train_months: int = 6, validation_months: int = 3) -> DataFrame:
    """Expanding train, rolling validation, purged by h+1 days; one row per fold.

    Fold bounds come from the configured periods alone, so the candidate folds
    are literals; day counts come from the data.
    """
    rows, start, i = [], _add_months(p.train_start, train_months), 1
    while start <= p.validation_end:
        end = min(_add_months(start, validation_months) - dt.timedelta(days=1), p.validation_end)
        rows.append((i, p.train_start, start - dt.timedelta(days=horizon + 1), start, end))
        start, i = _add_months(start, validation_months), i + 1
    spark = days.sparkSession
    folds = spark.createDataFrame(rows, "seq int, train_start date, train_end date, validation_start date, validation_end date")
    last = days.agg(F.date_sub(F.max(DATE), horizon + 1)).scalar()
    folds = folds.withColumn("validation_end", F.least("validation_end", last))
    in_train = (F.col(DATE) >= F.col("train_start")) & (F.col(DATE) <= F.col("train_end"))
    in_val = (F.col(DATE) >= F.col("validation_start")) & (F.col(DATE) <= F.col("validation_end"))
    counted = beside(days.select(DATE), folds).where(in_train | in_val).groupBy(*folds.columns).agg(
        F.count_if(in_train).alias("train_days"), F.count_if(in_val).alias("validation_days"))
    counted = counted.where((F.col("train_days") > 0) & (F.col("validation_days") > 0))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("seq"))
    return counted.select(
        F.concat(F.lit("fold_"), number).alias("fold"), "train_start", "train_end", "validation_start", "validation_end",
        F.lit(horizon + 1).alias("purge_days"), "train_days", "validation_days")


def ic_over_dates(signals: DataFrame, returns: DataFrame, dates: DataFrame | None, ret: str, by: list[str], max_names: int | None) -> DataFrame:
    """IC per key and date; `signals` is long with column `z`."""
    rows = signals.join(returns.select(ENTITY, DATE, ret), [ENTITY, DATE])
    if dates is not None:
        rows = rows.join(F.broadcast(dates.select(DATE)), DATE, "left_semi")
    return X.rank_ic(rows, "z", ret, [*by, DATE], max_names).where(F.col("ic").isNotNull())


def signal_ics(frame: DataFrame, signals: dict[str, tuple[str, str]], dates: dict[int, DataFrame], max_names: int | None) -> DataFrame:
    """Long IC table (family, signal, horizon, date, ic) from one wide frame.

    `frame` holds a z column per signal and the labels `ret_<h>` beside them;
    `signals` maps the z column to (family, signal).  Rows are cut to the dates
    of any horizon before signals and horizons are unpivoted.
    """
    plan = None
    for h, d in dates.items():
        one = d.select(DATE).withColumn("horizon", F.lit(h))
        plan = one if plan is None else plan.unionByName(one)
    near = frame.join(F.broadcast(plan.groupBy(DATE).agg(F.collect_set("horizon").alias("_hs"))), DATE)
    by_horizon = near.select(ENTITY, DATE, *signals, F.inline(F.filter(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.when(F.array_contains("_hs", h), F.col(f"ret_{h}")).alias("ret")) for h in dates]),
        lambda x: x["ret"].isNotNull())))
    long = by_horizon.select(ENTITY, DATE, "horizon", "ret", F.inline(F.array(*[
        F.struct(F.lit(f).alias("family"), F.lit(s).alias("signal"), F.col(c).alias("z")) for c, (f, s) in signals.items()])))
    return X.rank_ic(long, "z", "ret", ["family", "signal", "horizon", DATE], max_names).where(F.col("ic").isNotNull())


def ic_table(ics: DataFrame, registry: DataFrame, horizons: tuple[int, ...] = SETTINGS.horizons, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean IC per horizon and pooled, sign and first selection, one row per registered signal."""
    per = []
    for h in horizons:
        here = F.when(F.col("horizon") == h, F.col("ic"))
        per += [F.avg(here).alias(f"mean_ic_{h}d"), F.count(here).alias(f"n_ic_{h}d")]
    agg = ics.groupBy(*by, "family", "signal").agg(*per, F.avg("ic").alias("mean_ic_avg"))
    full = registry.join(agg, [*by, "family", "signal"], "left").fillna(0, [f"n_ic_{h}d" for h in horizons])
    mean = F.col("mean_ic_avg")
    return full.withColumns({
        "sign": F.when(mean < 0, -1).otherwise(1), "selected": mean.isNotNull()})


def pair_correlations(frame: DataFrame, signals: dict[str, tuple[str, str]], seq: dict[str, int], dates: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Absolute Spearman of the signals of a family, two by two, over pairwise complete cells.

    A signal's sign does not change the absolute value.  Rows are cells,
    columns the few registered signals; a cell is expanded to the pairs of
    signals (never of rows), and each pair is ranked by value ranges.
    `dates` holds the dates to use (per fold, when `by` names one).
    """
    near = frame.join(F.broadcast(dates.select(*by, DATE)), DATE)
    names = list(signals.items())
    pairs = [F.struct(F.lit(f).alias("family"), F.lit(s).alias("left_signal"), F.lit(t).alias("right_signal"), F.lit(seq[s]).alias("left_seq"), F.lit(seq[t]).alias("right_seq"),
                      F.col(c).alias("lz"), F.col(d).alias("rz"))
             for c, (f, s) in names for d, (g, t) in names if f == g and seq[s] < seq[t]]
    long = near.select(*by, F.inline(F.filter(F.array(*pairs), lambda p: p["lz"].isNotNull() & p["rz"].isNotNull())))
    keys = [*by, "family", "left_signal", "right_signal", "left_seq", "right_seq"]
    ranked = ordered.average_ranks(ordered.average_ranks(long, keys, "lz", "lr", "ln"), keys, "rz", "rr", "rn")
    return ranked.groupBy(*keys).agg(F.abs(corr_of("lr", "rr")).alias("corr"))


def dedupe_signals(table: DataFrame, correlations: DataFrame, limit: float = SETTINGS.dedupe_corr, by: tuple[str, ...] = ()) -> DataFrame:
    """Greedy pass in registry order: of a pair at or above the limit the weaker IC is dropped.

    Each drop depends on the earlier ones, so the pass runs over one array per
    family (and fold); a family has at most as many rows as registered signals.
    """
    keys = [*by, "family"]
    ic = F.map_from_entries(F.collect_list(F.struct("signal", F.abs("mean_ic_avg"))))
    ics = table.where("selected").groupBy(*keys).agg(ic.alias("ics"))
    close = correlations.where(F.col("corr") >= limit).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("left_seq", "right_seq", "left_signal", "right_signal"))).alias("pairs"))
    empty = F.array().cast("array<struct<loser:string,winner:string>>")

    def step(dropped: Column, pair: Column, ics_col: Column) -> Column:
        gone = F.exists(dropped, lambda d: (d["loser"] == pair["left_signal"]) | (d["loser"] == pair["right_signal"]))
        left_wins = F.element_at(ics_col, pair["left_signal"]) >= F.element_at(ics_col, pair["right_signal"])
        verdict = F.struct(F.when(left_wins, pair["right_signal"]).otherwise(pair["left_signal"]).alias("loser"),
                           F.when(left_wins, pair["left_signal"]).otherwise(pair["right_signal"]).alias("winner"))
        return F.when(gone, dropped).otherwise(F.concat(dropped, F.array(verdict)))

    losers = close.join(ics, keys).select(
        *keys, F.inline(F.aggregate("pairs", empty, lambda acc, p: step(acc, p, F.col("ics")))))
    marked = table.join(F.broadcast(losers.withColumnRenamed("loser", "signal")), [*keys, "signal"], "left")
    reason = F.concat(F.lit(f"train corr >= {limit:.2f} with "), F.col("winner"))
    return marked.withColumns({
        "selected": F.col("selected") & F.col("winner").isNull(), "dedupe_reason": F.coalesce(reason, F.lit(""))}).drop("winner")


def top_bottom_spread(df: DataFrame, score: str, ret: str, n: int = SETTINGS.basket_size, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over dates of top-n minus bottom-n mean return; `df` holds eligible rows only."""
    keys = [*by, DATE]
    rows = df.where(F.col(score).isNotNull())
    up = Window.partitionBy(*keys).orderBy(F.desc(score), ENTITY)
    down = Window.partitionBy(*keys).orderBy(score, ENTITY)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= 2 * n)
    # each side keeps n rows per date, so the window group limit applies before the exchange
    top = rows.withColumn("_r", F.row_number().over(up)).where(F.col("_r") <= n).withColumn("_top", F.lit(True))
    bottom = rows.withColumn("_r", F.row_number().over(down)).where(F.col("_r") <= n).withColumn("_top", F.lit(False))
    picked = top.unionByName(bottom).join(counts.select(*keys), keys, "left_semi")
    hi, lo = F.when(F.col("_top"), F.col(ret)), F.when(~F.col("_top"), F.col(ret))
    per = picked.groupBy(*keys).agg(F.avg(hi).alias("_hi"), F.avg(lo).alias("_lo"), F.count(hi).alias("_nh"), F.count(lo).alias("_nl"))
    good = per.where((F.col("_nh") >= n) & (F.col("_nl") >= n))
    return good.groupBy(*by).agg(F.avg(F.col("_hi") - F.col("_lo")).alias("spread"), F.count("*").alias("n_dates"))


def coverage_audit(df: DataFrame, metrics: list[str]) -> DataFrame:
    """First and last date and count of non-null values per metric and entity."""
    aggs = []
    for m in metrics:
        day = F.when(F.col(m).isNotNull(), F.col(DATE))
        aggs.append(F.struct(F.lit(m).alias("metric"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count(m).alias("n_obs")).alias(f"_{m}"))
    return df.groupBy(ENTITY).agg(*aggs).select(ENTITY, F.inline(F.array(*[f"_{m}" for m in metrics])))


def leakage_checks(dataset: DataFrame, p: Periods, tol: float = 1e-12) -> DataFrame:
    """One row per check: recomputed labels, lag-1 metrics and purged period ends."""
    w = by_entity()
    re = label_returns(dataset, prefix="_re_")
    re = re.withColumn("_lag", F.lag("revenue", 1).over(w))
    off = lambda a, b: F.count_if((F.abs(F.col(a) - F.col(b)) > tol) | (F.col(a).isNull() != F.col(b).isNull()))
    checks = [F.struct(F.lit(f"label_{h}d").alias("check"), off(f"ret_{h}", f"_re_{h}").alias("n_bad")) for h in SETTINGS.horizons]
    checks.append(F.struct(F.lit("lag1_revenue").alias("check"), off("lag1_revenue", "_lag").alias("n_bad")))
    last = F.max(DATE)
    for h in SETTINGS.horizons:
        labelled = F.max(F.when(F.col(f"ret_{h}").isNotNull(), F.col(DATE)))
        checks.append(F.struct(F.lit(f"label_end_{h}d").alias("check"), (labelled > F.date_sub(last, h + 1)).cast("bigint").alias("n_bad")))
    return re.agg(F.array(*checks).alias("c")).select(F.inline("c")).withColumn("passed", F.col("n_bad") == 0)
