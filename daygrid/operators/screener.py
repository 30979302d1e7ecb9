"""Screener tables and analytics (S operators and the project time series)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import SETTINGS
from daygrid.functions.rolling import DATE, ENTITY, chg, corr_of, ffill, first_value, pct_chg, ratio, roll
from daygrid.operators import cross_section as X
from daygrid.operators import ordered

LEVELS = ("price", "volume", "mcap", "fdv", "revenue", "fees", "deposits", "tvl", "open_interest", "addresses", "burn", "issuance")
# Summary metrics and their labels; stable-like tickers and categories.
CHANGE_METRICS = {"revenue_mom_pct": "Revenue", "fees_mom_pct": "Fees", "deposits_mom_pct": "Deposits", "oi_mom_pct": "Open interest"}
STABLE_TICKERS = ("BUSD", "CRVUSD", "DAI", "FDUSD", "FRAX", "GHO", "LUSD", "MIM", "PYUSD", "RLUSD", "SUSD", "TUSD", "USDC", "USDC.E", "USDD", "USDE", "USDG", "USDL", "USDP", "USDS", "USDT", "USDT0", "USDY")
STABLE_CATEGORIES = ("algo-stables", "dual-token stablecoin", "stablecoin", "stablecoins")


def coalesce_columns(columns: list[str]) -> Column:
    return F.coalesce(*columns)


def project_timeseries(panel: DataFrame, master: DataFrame, days: int = SETTINGS.history_days, max_names: int | None = None, last: Column | None = None) -> DataFrame:
    """About forty metrics per asset and day over the last `days` days.

    The window is cut first and gaps are carried once more inside it, so every
    trailing frame sees these days only.  Three window layers on one entity
    partitioning; the peer median adds one exchange on date and category.
    """
    last = panel.agg(F.max(DATE)).scalar() if last is None else last
    cut = panel.where(F.col(DATE) >= F.date_sub(last, days - 1))
    have = set(panel.columns)
    null = F.lit(None).cast("double")
    base = cut.select(ENTITY, DATE, *[(ffill(m, SETTINGS.max_fill_days) if m in have else null).alias(m) for m in LEVELS], *(["btc"] if "btc" in have else []))
    if "btc" not in have:
        base = base.withColumn("btc", null)
    smooth = base.withColumns({
        "revenue_7d_avg": roll(F.avg, "revenue", 7, 3), "revenue_30d": roll(F.sum, "revenue", 30, 7), "fees_7d_avg": roll(F.avg, "fees", 7, 3),
        "fees_30d": roll(F.sum, "fees", 30, 7), "daily_active_users": roll(F.avg, "addresses", 7, 3), "_rp": chg("price", 1), "_rr": chg("revenue", 1), "_rb": chg("btc", 1)})
    year = 365 / 30
    out = smooth.withColumns({"annualised_revenue_30d": F.col("revenue_30d") * year, "annualised_fees_30d": F.col("fees_30d") * year})
    wow = {f"{n}_{w}_pct": pct_chg(c, k) for n, c in (("revenue", "revenue_7d_avg"), ("fees", "fees_7d_avg"), ("deposits", "deposits"), ("tvl", "tvl"), ("oi", "open_interest")) for w, k in (("wow", 7), ("mom", 30))}
    g = {f"_g{k}_{m}": chg(f"{m}_7d_avg", k) for m in ("revenue", "fees") for k in (14, 28)}
    out = out.withColumns({
        "price_7d_pct": pct_chg("price", 7), **wow, **g, "fdv_annualised_revenue": ratio("fdv", "annualised_revenue_30d"), "fdv_annualised_fees": ratio("fdv", "annualised_fees_30d"),
        "payback_period_fees": ratio("fdv", "annualised_fees_30d"), "revenue_per_active_address": ratio("revenue_7d_avg", "daily_active_users"), "buyback_versus_issuance": ratio("burn", "issuance"),
        "spot_volume_oi_ratio": ratio("volume", "open_interest"), "daily_pct_over_btc": (F.col("_rp") - F.col("_rb")) * 100.0})
    out = out.withColumns({f"{m}_2w_4w_ratio": ratio(f"_g14_{m}", f"_g28_{m}") for m in ("revenue", "fees")})
    out = X.rolling_corr_observed(out, "_rp", "_rb", 30, 15, "price_btc_corr")
    out = X.rolling_corr_observed(out, "_rr", "_rb", 91, 45, "revenue_btc_corr")
    labelled = out.join(master, ENTITY).withColumns({"fdv_bucket": X.value_bucket("fdv"), "mcap_bucket": X.value_bucket("mcap")})
    labelled = X.versus_group_median(labelled, "fdv_annualised_revenue", [DATE, "category"], "implied_growth_rate", max_names)
    return labelled.drop("btc", "_rp", "_rr", "_rb", *g)


def market_snapshot(master: DataFrame, sources: dict[str, DataFrame], order: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """Left joins of the sources, then each metric by precedence; `order` maps metric to (source, column)."""
    out = master.select(ENTITY)
    for name, s in sources.items():
        out = out.join(s.select(ENTITY, *[F.col(c).alias(f"{name}_{c}") for c in s.columns if c != ENTITY]), ENTITY, "left")
    return out.select(ENTITY, *[F.coalesce(*[F.col(f"{s}_{c}") for s, c in cols]).alias(m) for m, cols in order.items()])


def quality_flags(panel: DataFrame, last: Column, stale_days: int = SETTINGS.stale_days) -> DataFrame:
    """Latest metric date, staleness, and whether fees repeat revenue (over the last 120 rows, as named 90d)."""
    near = F.col(DATE) >= F.date_sub(last, 119)
    both = near & F.col("revenue").isNotNull() & F.col("fees").isNotNull()
    r, f = F.when(both, F.col("revenue")), F.when(both, F.col("fees"))
    day = lambda c: F.max(F.when(F.col(c).isNotNull(), F.col(DATE)))
    agg = panel.groupBy(ENTITY).agg(F.greatest(day("revenue"), day("fees"), day("tvl")).alias("latest_metric_date"), F.count(r).alias("_n"), corr_of(r, f).alias("_c"),
                                    (F.count("revenue") + F.count("fees") == 0).alias("missing_fees_revenue"), (F.count("tvl") == 0).alias("missing_tvl"))
    corr = F.when(F.col("_n") >= 30, F.col("_c"))
    return agg.select(ENTITY, "latest_metric_date", F.coalesce(F.datediff(last, "latest_metric_date") > stale_days, F.lit(True)).alias("stale_metric"), "missing_fees_revenue", "missing_tvl",
                      corr.alias("revenue_fees_corr_90d"), F.coalesce(F.abs(corr) >= SETTINGS.redundant_corr, F.lit(False)).alias("revenue_fees_redundant"))


def mask_redundant_fees(panel: DataFrame, quality: DataFrame) -> DataFrame:
    q = quality.select(ENTITY, F.col("revenue_fees_redundant").alias("_red"))
    return panel.join(q, ENTITY, "left").withColumn("fees", F.when(~F.coalesce("_red", F.lit(False)), F.col("fees"))).drop("_red")


def snapshot(ts: DataFrame, static: DataFrame, quality: DataFrame, order: list[str]) -> DataFrame:
    """Last row per ticker with static and quality columns."""
    w = Window.partitionBy("ticker").orderBy(F.desc(DATE))
    rows = ts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    return rows.join(static, ENTITY, "left").join(quality, ENTITY, "left").orderBy(*[F.desc_nulls_last(c) for c in order])


STATS = {"Average": None, "Median": 0.5, "75th percentile": 0.75, "99th percentile": 0.99}


def group_stats(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, median, 75th and 99th percentile and count per group, as (Statistic, Value) rows.

    Percentiles come from counts of distinct values split by range, so one
    group may hold any share of the rows.
    """
    qs = {f"q{i}": q for i, q in enumerate(STATS.values()) if q is not None}
    quant = ordered.group_quantiles(long, by, value, qs)
    mean = long.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("q0"), F.count(value).alias("Eligible"))
    both = mean.join(quant, by)
    rows = F.array(*[F.struct(F.lit(s).alias("Statistic"), F.col(f"q{i}").alias("Value")) for i, s in enumerate(STATS)])
    return both.select(*by, "Eligible", F.inline(rows))


def grouped_long(ts: DataFrame, metrics: list[str], groups: tuple[str, ...] = ("category", "fdv_bucket", "mcap_bucket")) -> DataFrame:
    """Every metric value once per grouping: the aggregate and each group column."""
    g = F.array(F.struct(F.lit("aggregate").alias("group_type"), F.lit("Aggregate").alias("Group")), *[F.struct(F.lit(c).alias("group_type"), F.col(c).cast("string").alias("Group")) for c in groups])
    m = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics])
    return ts.select(DATE, g.alias("_g"), F.inline(m)).where(F.col("value").isNotNull()).select(DATE, "metric", "value", F.inline("_g")).where(F.col("Group").isNotNull())


def summary_timeseries(ts: DataFrame, metrics: list[str], days: int = SETTINGS.display_days) -> DataFrame:
    """Change view (mean) and dispersion view (four statistics) over all groupings of the last days."""
    last = ts.agg(F.max(DATE)).scalar()
    long = grouped_long(ts.where(F.col(DATE) >= F.date_sub(last, days - 1)), metrics)
    stats = group_stats(long, [DATE, "metric", "group_type", "Group"])
    views = F.when(F.col("Statistic") == "Average", F.array(F.lit("change"), F.lit("dispersion"))).otherwise(F.array(F.lit("dispersion")))
    return stats.withColumn("view", F.explode(views))


def universe_aggregate(ts: DataFrame, tickers: DataFrame, metrics: list[str]) -> DataFrame:
    rows = ts.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    m = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics])
    return rows.select(DATE, F.inline(m)).where(F.col("value").isNotNull()).groupBy(DATE, "metric").agg(F.sum("value").alias("value"))


def is_stable_like(ticker: str = "ticker", category: str = "category") -> Column:
    return F.upper(F.coalesce(ticker, F.lit(""))).isin(*STABLE_TICKERS) | F.lower(F.trim(F.coalesce(category, F.lit("")))).isin(*STABLE_CATEGORIES)


def top_price_changes(ts: DataFrame, n: int = 100, rows_back: int = 30) -> DataFrame:
    """30-row price change at the latest date per ticker, the n largest by cap.

    A change from a price of zero is no number: its row takes a place among the n largest, and is left out afterwards.
    """
    w = Window.partitionBy("ticker").orderBy(DATE)
    base = F.lag("price", rows_back).over(w)
    moved = ts.where(~is_stable_like() & F.col("price").isNotNull()).withColumns({"price_30d_pct": (ratio("price", base) - 1.0) * 100.0, "_endless": (base == 0) & (F.col("price") != 0)})
    ok = moved.where((F.col("price_30d_pct").isNotNull() | F.col("_endless")) & F.col("mcap").isNotNull())
    latest = ok.groupBy("ticker").agg(F.max_by(F.struct(DATE, "price_30d_pct", "mcap"), DATE).alias("_r")).select("ticker", "_r.*")
    return latest.orderBy(F.desc("mcap"), "ticker").limit(n).where(F.col("price_30d_pct").isNotNull())


def histogram(df: DataFrame, value: str, bins: int = 24) -> DataFrame:
    """Equal-width bin counts between the minimum and the maximum."""
    lo = df.agg(F.min(value)).scalar()
    hi = df.agg(F.max(value)).scalar()
    x = F.col(value)
    b = F.when(x >= hi, bins).otherwise(F.least(F.floor(F.try_divide((x - lo) * bins, hi - lo)) + 1, F.lit(bins)))
    return df.where(x.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))


def rebase(df: DataFrame, value: str, by: list[str], out: str, scale: str = "percent") -> DataFrame:
    """Against the first non-null value of the group; groups starting near zero drop out."""
    w = Window.partitionBy(*by).orderBy(DATE)
    first = first_value(value, w)
    rows = df.withColumn("_f", first).where(F.abs("_f") > 1e-12)
    r = F.col(value) / F.col("_f")
    return rows.withColumn(out, r * 100.0 if scale == "index" else (r - 1.0) * 100.0).drop("_f")


def peer_growth(ts: DataFrame, tickers: list[str], metric: str) -> DataFrame:
    """Levels indexed to 100 from the first date all peers have."""
    base = ts.where(F.upper("ticker").isin(*[t.upper() for t in tickers]) & F.col(metric).isNotNull()).select(DATE, "ticker", F.col(metric).alias("raw_value"))
    start = base.groupBy("ticker").agg(F.min(DATE).alias("_s")).agg(F.max("_s")).scalar()
    return rebase(base.where(F.col(DATE) >= start), "raw_value", ["ticker"], "Indexed", "index")


def change_series(ts: DataFrame, metric: str, group: str | None) -> DataFrame:
    g = F.lit("Aggregate") if group is None else F.col(group).cast("string")
    return ts.where(F.col(metric).isNotNull()).groupBy(DATE, g.alias("Group")).agg(F.avg(metric).alias("Value"), F.count(metric).alias("Eligible"))


def raw_sums(ts: DataFrame, metric: str, group: str | None, winsor: bool, max_names: int | None) -> DataFrame:
    rows = ts.where(F.col(metric).isNotNull())
    if winsor:
        rows = X.winsorise(rows, metric, [DATE], metric, max_names)
    g = F.lit("Aggregate") if group is None else F.col(group).cast("string")
    return rows.groupBy(DATE, g.alias("Group")).agg(F.sum(metric).alias("Value"), F.count(metric).alias("Eligible"))


def quartiles(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    q = ordered.group_quantiles(df, by, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    ends = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n"))
    return q.join(ends, by)


def category_position(df: DataFrame, metrics: list[str], max_names: int | None) -> DataFrame:
    m = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in metrics])
    long = df.select("ticker", "category", F.inline(m)).where(F.col("value").isNotNull())
    return X.peer_normalise(long, "value", ["category", "metric"], "position", max_names)


def matching_rows(table: DataFrame, keys: dict, columns: list[str]) -> DataFrame:
    cond = reduce(lambda a, kv: a & (F.col(kv[0]) == kv[1]), keys.items(), F.lit(True))
    return table.where(cond).select(*columns)


def filter_projects(df: DataFrame, categories: list[str], fdv_buckets: list[str], mcap_buckets: list[str], min_revenue: float = 0.0, min_fees: float = 0.0, complete: bool = False) -> DataFrame:
    ok = F.col("category").isin(*categories) & F.col("fdv_bucket").isin(*fdv_buckets) & F.col("mcap_bucket").isin(*mcap_buckets)
    if min_revenue > 0:
        ok = ok & (F.col("annualised_revenue_30d") >= min_revenue)
    if min_fees > 0:
        ok = ok & (F.col("annualised_fees_30d") >= min_fees)
    if complete:
        ok = ok & F.col("revenue_7d_avg").isNotNull() & F.col("fees_7d_avg").isNotNull() & F.col("fdv").isNotNull()
    return df.where(ok)


def score_range(df: DataFrame, score: str, low: float, high: float, buckets: list[str]) -> DataFrame:
    return df.where(F.col(score).between(low, high) & F.col("fdv_bucket").isin(*buckets))


def coverage_report(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Share and count per source or metric."""
    row = df.agg(F.count("*").alias("_t"), *[F.count_if(c).alias(f"_{n}") for n, c in flags.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"_{n}").alias("count"), F.try_divide(F.col(f"_{n}") * 100.0, F.col("_t")).alias("share")) for n in flags])))


def gap_report(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.select("ticker", *[F.when(F.col(m).isNotNull(), "OK").otherwise("Missing").alias(m) for m in metrics])


def freshness(df: DataFrame, today: Column) -> DataFrame:
    return df.agg(F.max(DATE).alias("latest"), F.datediff(today, F.max(DATE)).alias("age_days"))


def return_correlations(ts: DataFrame, selected: str, benchmarks: list[str], rows_back: int = 30) -> DataFrame:
    """Correlation of 30-row returns of one asset with each benchmark, in the given order.

    Dates are the union of all days in the table.  Only the few named tickers
    are kept, then each date is one row of their returns.
    """
    names = list(dict.fromkeys(b.upper() for b in benchmarks))
    wanted = list(dict.fromkeys([selected.upper(), *names]))
    priced = ts.withColumn("ticker", F.upper("ticker")).where(F.col("price").isNotNull())
    days = priced.select(DATE).distinct()
    per = priced.where(F.col("ticker").isin(*wanted)).groupBy(DATE).agg(*[F.max(F.when(F.col("ticker") == t, F.col("price"))).alias(f"p_{t}") for t in wanted])
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    # absent tickers keep an all-null column; a missing cell takes the last price, as the change pads
    rets = days.join(per, DATE, "left").select(DATE, *[ffill(f"p_{t}", None, w).alias(f"p_{t}") for t in wanted]).select(DATE, *[(ratio(f"p_{t}", F.lag(f"p_{t}", rows_back).over(w)) - 1.0).alias(f"r_{t}") for t in wanted])
    s = f"r_{selected.upper()}"
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(DATE)))
    aggs = [latest(s).alias("_s")]
    for b in names:
        c = f"r_{b}"
        both = F.count_if(F.col(s).isNotNull() & F.col(c).isNotNull())
        corr = F.when(both > 0, 1.0) if b == selected.upper() else F.when(both >= 2, corr_of(s, c))
        aggs.append(F.struct(F.lit(names.index(b)).alias("pos"), F.lit(b).alias("benchmark"), corr.alias("corr"), both.alias("observations"), latest(c).alias("benchmark_return"),
                             F.when(F.lit(b == selected.upper()), "Selected asset.").when(F.count(c) == 0, "Benchmark has no price history.").when(both < 2, "Insufficient aligned observations.").otherwise("").alias("note")).alias(f"_b{names.index(b)}"))
    row = rets.agg(*aggs)
    return row.select(F.col("_s").alias("selected_return"), F.inline(F.array(*[f"_b{i}" for i in range(len(names))])))


def basket_index(ts: DataFrame, members: DataFrame, by: list[str], days: int = SETTINGS.display_days) -> DataFrame:
    """Weighted index of baskets (by, ticker) over the last days, rebased to 100.

    Weight: FDV, else cap, at the first priced day, else of the last row, else one; renormalised over the members present.
    """
    last = ts.agg(F.max(DATE)).scalar()
    rows = members.join(ts.select(DATE, "ticker", "price", "fdv", "mcap"), "ticker").where((F.col(DATE) >= F.date_sub(last, days - 1)))
    keys = [*by, "ticker"]
    w = Window.partitionBy(*keys).orderBy(DATE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    priced = rows.where(F.col("price").isNotNull())
    start = F.coalesce(F.first("fdv").over(w), F.first("mcap").over(w))
    end = F.coalesce(F.last("fdv").over(w), F.last("mcap").over(w))
    own = F.when(start > 0, start).otherwise(end)
    idx = priced.withColumns({"_w": F.when(own > 0, own).otherwise(1.0), "_i": F.col("price") / F.first("price").over(w) * 100.0, "_n": F.count("*").over(w)}).where(F.col("_n") >= 2)
    per = idx.groupBy(*by, DATE).agg(F.try_divide(F.sum(F.col("_w") * F.col("_i")), F.sum("_w")).alias("_x"))
    return rebase(per, "_x", by, "Index", "index").drop("_x")


def factor_baskets(ts: DataFrame, snap: DataFrame, scores: dict[str, str], n: int = 5) -> DataFrame:
    """Top and bottom n by each lagged score, as weighted indices."""
    members = None
    for label, c in scores.items():
        rows = snap.where(F.col(c).isNotNull())
        for name, order in (("Top factor basket", [F.desc(c), F.col("ticker")]), ("Bottom factor basket", [F.asc(c), F.desc("ticker")])):
            one = rows.orderBy(*order).limit(n).select(F.lit(label).alias("Factor"), F.lit(name).alias("Basket"), "ticker")
            members = one if members is None else members.unionByName(one)
    return basket_index(ts, members, ["Factor", "Basket"])
