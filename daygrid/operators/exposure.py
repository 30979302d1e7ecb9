"""Exposure overlay and benchmark regime (G operators).

Series have one row per day, so an unpartitioned window over them is bounded
by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import SETTINGS
from daygrid.functions.rolling import DATE, chg, clip, ffill, first_value, ratio, roll, running


def series() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy(DATE)


def trend_ratio(price: str = "btc") -> Column:
    n = SETTINGS.sma_days
    return clip(ratio(price, roll(F.avg, price, n, n // 2, series())), 0.5, 1.5)


def trend_binary(price: str = "btc") -> Column:
    """1.0 at or above the mean, else 0.5; no mean counts as below."""
    n = SETTINGS.sma_days
    return F.when(F.col(price) >= roll(F.avg, price, n, n // 2, series()), 1.0).otherwise(0.5)


def vol_scalar(returns: str = "ret") -> Column:
    n = SETTINGS.vol_days
    vol = roll(F.stddev_samp, returns, n, n // 2, series()) * F.sqrt(F.lit(365.0))
    return clip(F.try_divide(F.lit(SETTINGS.vol_target), vol), SETTINGS.min_exposure, SETTINGS.max_leverage)


def drawdown_scalar(nav: str = "nav") -> Column:
    """1 above the start level, falling linearly to the floor exposure."""
    s = SETTINGS
    dd = ratio(nav, running(F.max, nav, series())) - 1.0
    through = clip((dd - s.dd_start) / (s.dd_floor - s.dd_start), 0.0, 1.0)
    return F.when(dd > s.dd_start, 1.0).otherwise(1.0 - through * (1.0 - s.min_exposure))


def with_proxies(df: DataFrame, price: str = "btc") -> DataFrame:
    """Benchmark returns and rebased benchmark stand in for absent portfolio series."""
    have = set(df.columns)
    null = F.lit(None).cast("double")
    ret = F.col("portfolio_return") if "portfolio_return" in have else null
    nav = F.col("portfolio_nav") if "portfolio_nav" in have else null
    base = df.withColumns({"_r": chg(price, 1, series()), "_n": ratio(price, first_value(price, series()))})
    # a portfolio series, where given at all, is used for every date
    given = lambda c: F.max(c.isNotNull()).over(Window.partitionBy(F.lit(0)))
    return base.withColumns({
        "ret": F.when(given(ret), ret).otherwise(F.col("_r")), "nav": F.when(given(nav), nav).otherwise(F.col("_n"))}).drop("_r", "_n")


def diagnostics(benchmark: DataFrame, price: str = "btc", binary: bool = False) -> DataFrame:
    """Trend, volatility and drawdown scalars and their clipped product where all exist."""
    rows = with_proxies(benchmark.where(F.col(price).isNotNull()), price)
    parts = rows.select(DATE, F.col(price).alias("btc_price"), (trend_binary(price) if binary else trend_ratio(price)).alias("btc_trend"),
                        vol_scalar().alias("vol_scalar"), drawdown_scalar().alias("dd_scalar"))
    product = F.col("btc_trend") * F.col("vol_scalar") * F.col("dd_scalar")
    return parts.withColumn("exposure", clip(product, SETTINGS.min_exposure, SETTINGS.max_leverage))


def apply_exposure(scores: DataFrame, exposure: DataFrame, score: str, out: str = "adjusted") -> DataFrame:
    """Exposure taken on the composite's own dates, then carried forward, times the score.

    An exposure dated between two composite dates is not seen, as in a reindex before the fill.
    """
    days = scores.select(DATE).distinct().join(F.broadcast(exposure.select(DATE, "exposure")), DATE, "left")
    carried = days.select(DATE, ffill("exposure", None, series()).alias("exposure"))
    return scores.join(F.broadcast(carried), DATE, "left").withColumn(out, F.col(score) * F.col("exposure"))


def summary(diag: DataFrame) -> DataFrame:
    x = F.col("exposure")
    rows = diag.where(x.isNotNull())
    latest = lambda c: F.max_by(c, DATE)
    return rows.agg(
        F.count("*").alias("n_dates"), F.avg(x).alias("mean_exposure"), F.median(x).alias("median_exposure"), F.min(x).alias("min_exposure"),
        F.max(x).alias("max_exposure"), F.avg((x < 1).cast("double")).alias("pct_below_1"), F.avg((x > 1).cast("double")).alias("pct_above_1"),
        latest("exposure").alias("current_exposure"), latest("btc_trend").alias("current_btc_trend"),
        latest("vol_scalar").alias("current_vol_scalar"), latest("dd_scalar").alias("current_dd_scalar"))


def week_end_sunday(day: Column) -> Column:
    """Last Sunday at or before the day: the end of the latest completed week."""
    return F.date_add(F.trunc(F.date_add(day, 1), "week"), -1)


def weekly_regime(benchmark: DataFrame, days: DataFrame, price: str = "btc") -> DataFrame:
    """Bullish when the week's close is above its 20-week mean; days see completed weeks only."""
    obs = benchmark.where(F.col(price).isNotNull())
    ends = F.date_add(F.trunc(DATE, "week"), 6)
    weekly = obs.groupBy(ends.alias("week_end")).agg(F.max_by(price, DATE).alias("btc_weekly_close"))
    w = Window.partitionBy(F.lit(0)).orderBy("week_end")
    weekly = weekly.withColumn("btc_20w_ma", roll(F.avg, "btc_weekly_close", 20, 20, w))
    regime = F.when(F.col("btc_20w_ma").isNotNull(), F.when(F.col("btc_weekly_close") > F.col("btc_20w_ma"), "Bullish").otherwise("Bearish"))
    weekly = weekly.withColumn("regime", regime)
    # weeks follow each other without gaps on the filled benchmark, so the as-of join is an equi-join
    daily = days.select(DATE).withColumn("week_end", week_end_sunday(F.col(DATE))).join(F.broadcast(weekly), "week_end", "left")
    close = daily.join(F.broadcast(obs.select(DATE, F.col(price).alias("_c"))), DATE, "left")
    return close.select(DATE, ffill("_c", None, series()).alias("btc_close"), "btc_weekly_close", "btc_20w_ma", "regime")
