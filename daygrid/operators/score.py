"""Composite scores, ranking and universes (C operators)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import FAMILIES, FAMILY_WEIGHTS, SETTINGS
from daygrid.functions.rolling import DATE, ENTITY, by_entity, ffill, lag, roll
from daygrid.functions.text import normalise_text
from daygrid.operators import cross_section as X
from daygrid.operators import ordered

# Sums of z-scores arrive in any order; ten decimals make equal scores equal again.
SCORE_DECIMALS = 10


def settle(x: Column) -> Column:
    return F.round(x, SCORE_DECIMALS)


def family_scores(z: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of the available z per entity, date and family (long)."""
    return z.groupBy(*by, ENTITY, DATE, "family").agg(settle(F.avg("z")).alias("score"))


def widen(scores: DataFrame, families: tuple[str, ...] = FAMILIES, by: tuple[str, ...] = ()) -> DataFrame:
    return scores.groupBy(*by, ENTITY, DATE).pivot("family", list(families)).agg(F.max("score"))


def composite_fixed(wide: DataFrame, weights: dict[str, float] | None = None, min_families: int = 2, out: str = "composite") -> DataFrame:
    """Weights normalised over families that have any score; a missing family adds zero."""
    weights = FAMILY_WEIGHTS if weights is None else weights
    families = [f for f in wide.columns if f in FAMILIES]
    used = [f for f in families if weights.get(f, 0) > 0]
    present = wide.agg(*[F.max(F.col(f).isNotNull().cast("int")).alias(f) for f in families])
    total = present.select(sum((F.col(f) * weights[f] for f in used), F.lit(0.0))).scalar()
    num = sum((F.coalesce(F.col(f), F.lit(0.0)) * weights[f] for f in used), F.lit(0.0))
    covered = sum((F.col(f).isNotNull().cast("int") for f in families), F.lit(0))
    return wide.withColumn(out, F.when(covered >= min_families, settle(F.try_divide(num, total))))


def renormalised(weights: dict[str, Column | float], min_token_families: int = 1) -> Column:
    """sum(w x score) / sum(w of the families present), families without weight ignored."""
    terms = [(F.col(f), w if isinstance(w, Column) else F.lit(float(w))) for f, w in weights.items()
             if isinstance(w, Column) or w > 0]
    zero = F.lit(0.0)
    num = sum((F.coalesce(s, zero) * w for s, w in terms), zero)
    den = sum((F.when(s.isNotNull(), w).otherwise(zero) for s, w in terms), zero)
    covered = sum(((s.isNotNull() & (w > 0)).cast("int") for s, w in terms), F.lit(0))
    return F.when(covered >= min_token_families, settle(F.try_divide(num, den)))


def regime_composite(wide: DataFrame, bullish: dict[str, float], bearish: dict[str, float], regime: DataFrame, out: str = "composite") -> DataFrame:
    """Bearish weights on Bearish days, bullish weights otherwise; regime carried over the composite's dates."""
    days = wide.select(DATE).distinct().join(F.broadcast(regime.select(DATE, "regime")), DATE, "left")
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    carried = days.select(DATE, ffill("regime", None, w).alias("regime"))
    joined = wide.join(F.broadcast(carried), DATE, "left")
    return joined.withColumn(out, F.when(F.col("regime") == "Bearish", renormalised(bearish)).otherwise(renormalised(bullish)))


def days_earlier(x: Column | str, k: int, keys: tuple[str, ...] = (ENTITY,)) -> Column:
    """Value exactly k days before; the same as k rows on a dense grid, but needs no grid."""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(DATE)).rangeBetween(-k, -k)
    return F.max(F.col(x) if isinstance(x, str) else x).over(w)


def factor_improvement(wide: DataFrame, max_names: int | None, by: tuple[str, ...] = (), rows: int = SETTINGS.improvement_rows) -> DataFrame:
    """28-row change of the equal composite of three families, winsorised and rank-z scored."""
    base = wide.withColumn("_b", renormalised({f: 1.0 for f in FAMILIES[:3]}))
    moved = base.withColumn("_d", settle(F.col("_b") - days_earlier("_b", rows, (*by, ENTITY))))
    scored = X.rank_z(moved.drop("factor_improvement"), "_d", [*by, DATE], "factor_improvement", max_names, winsor=True)
    return scored.drop("_b", "_d")


def apply_decisions(z: DataFrame, decisions: DataFrame, max_names: int | None, by: tuple[str, ...] = ()) -> DataFrame:
    """Signed mean of the selected signals, rank-z without winsorising, plus factor improvement (wide).

    `decisions` has one row per registered signal (and fold), so it is broadcast.
    """
    keep = decisions.where("selected").select(*by, "family", "signal", "sign")
    signed = z.join(F.broadcast(keep), ["family", "signal"])
    avg = signed.groupBy(*by, ENTITY, DATE, "family").agg(settle(F.avg(F.col("z") * F.col("sign"))).alias("_avg"))
    scored = X.rank_z(avg, "_avg", [*by, DATE, "family"], "score", max_names)
    return factor_improvement(widen(scored.where(F.col("score").isNotNull()), FAMILIES[:3], by), max_names, by)


def change_and_lag(df: DataFrame, score: str, others: list[str], change: int = 28, rows: int = SETTINGS.factor_lag_rows) -> DataFrame:
    return df.withColumns({f"{score}_4w_change": F.col(score) - lag(score, change)} | {f"{c}_lag_{rows}d": lag(c, rows) for c in [score, *others]})


def rank_and_select(df: DataFrame, score: str, n: int = SETTINGS.max_positions, max_names: int | None = None, eligible: DataFrame | None = None) -> DataFrame:
    """Rank within date by score descending (ties by entity) and flag the first n."""
    rows = df.where(F.col(score).isNotNull())
    if eligible is not None:
        rows = rows.join(eligible.select(ENTITY).distinct(), ENTITY, "left_semi")
    if X.fits_window(max_names):
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(DATE).orderBy(F.desc(score), ENTITY)))
    else:
        upto = ordered.cumulative_counts(rows, [DATE], score).select(DATE, score, (F.col("n") - F.col("upto")).alias("_above"))
        tie = F.row_number().over(Window.partitionBy(DATE, score).orderBy(ENTITY))
        ranked = rows.join(upto, [DATE, score]).withColumn("rank", (F.col("_above") + tie).cast("int")).drop("_above")
    return ranked.withColumn("selected", F.col("rank") <= n)


def universe_screen(panel: DataFrame, as_of: DataFrame, categories: DataFrame) -> DataFrame:
    """Names eligible at each as-of date from history up to it: one entity pass for all dates.

    Last cap, mean of the last seven observed volumes, age since first cap or
    volume, days of cap history, and excluded category words.
    """
    # Excluded category words.
    words = "stablecoin|wrapped|pegged|tokenised-treasury|basket|infrastructure-aggregate"
    seen = F.col("volume").isNotNull()
    obs = Window.partitionBy(ENTITY, "_seen").orderBy(DATE).rowsBetween(-6, 0)
    up_to = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    flagged = panel.select(ENTITY, DATE, "mcap", "volume", "price").withColumn("_seen", seen)
    flagged = flagged.withColumn("_v7", F.when(F.col("_seen"), F.avg("volume").over(obs)))
    hist = flagged.select(
        ENTITY, DATE, ffill("mcap").alias("last_mcap"), ffill("_v7").alias("volume_7"),
        F.count("mcap").over(up_to).alias("history_days"),
        F.datediff(F.col(DATE), F.min(F.when(F.col("price").isNotNull(), F.col(DATE))).over(up_to)).alias("age_days"))
    at = hist.join(F.broadcast(as_of.select(DATE)), DATE, "left_semi").join(categories, ENTITY, "left")
    excluded = F.coalesce(F.lower("category").rlike(words), F.lit(False))
    s = SETTINGS
    return at.where(
        (F.col("last_mcap") >= s.min_mcap) & (F.col("volume_7") >= s.min_volume) & (F.col("age_days") >= s.min_listing_days)
        & (F.col("history_days") >= s.min_history_weeks * 7) & ~excluded)


def rebalance_calendar(spark, start: dt.date, end: dt.date, freq: str = "M") -> DataFrame:
    """Month ends, Fridays, or every n days (`'10D'`)."""
    lo, hi = F.lit(start), F.lit(end)
    one = spark.range(1)
    if freq == "M":
        return one.select(F.explode(F.sequence(F.trunc(lo, "month"), hi, F.expr("interval 1 month"))).alias("_m")).select(
            F.last_day("_m").alias(DATE)).where((F.col(DATE) >= lo) & (F.col(DATE) <= hi))
    if freq == "W":
        return one.select(F.explode(F.sequence(F.next_day(F.date_sub(lo, 1), "Fri"), hi, F.expr("interval 7 day"))).alias(DATE)).where(F.col(DATE) <= hi)
    return one.select(F.explode(F.sequence(lo, hi, F.expr(f"interval {int(freq[:-1] or 1)} day"))).alias(DATE))


# Assets that are no investable token.
STABLE_TICKERS = ("USDT", "USDC", "DAI", "FDUSD", "TUSD", "USDE", "USDS", "BUSD", "FRAX", "GHO", "PYUSD", "USDD", "USD1")
COMMODITY_TICKERS = ("PAXG", "XAUT", "KDAU", "KAG")
EXCLUDED_WORDS = ("(?i)stable|wrapped|pegged|tokeni[sz]ed|treasury|t[- ]?bill|basket|commodity|gold|silver|synthetic usd|institutional digital liquidity")


def is_excluded(ticker: str, text_columns: list[str]) -> Column:
    t = F.upper(F.coalesce(F.col(ticker), F.lit("")))
    return t.isin(*STABLE_TICKERS, *COMMODITY_TICKERS) | F.concat_ws(" ", *text_columns).rlike(EXCLUDED_WORDS)


def eligibility(panel: DataFrame, master: DataFrame) -> DataFrame:
    """Daily eligibility flags; `master` has entity, excluded, futures_symbol."""
    s = SETTINGS
    flags = panel.join(master.select(ENTITY, "excluded", "futures_symbol"), ENTITY, "left").withColumns({
        "volume_7d": roll(F.avg, "volume", 7, 5),
        "_first": F.min(F.when(F.col("price").isNotNull(), F.col(DATE))).over(Window.partitionBy(ENTITY))})
    age = F.coalesce(F.greatest(F.datediff(F.col(DATE), F.col("_first")), F.lit(0)), F.lit(0))
    no = F.lit(False)
    base = ((F.col("mcap") >= s.min_mcap) & (F.col("volume_7d") >= s.base_volume) & (age >= s.min_price_history_days)
            & F.col("price").isNotNull() & ~F.coalesce("excluded", F.lit(True)))
    return flags.withColumns({
        "price_history_days": age, "eligible_base": F.coalesce(base, no),
        "eligible_sensitivity": F.coalesce(base & (F.col("volume_7d") >= s.sensitivity_volume), no),
        "shortable": F.col("futures_symbol").isNotNull() & F.col("price").isNotNull()}).drop("_first", "excluded", "futures_symbol")


# Tokens kept whatever their rank.
MAJORS = ("BTC", "ETH", "SOL", "BNB", "XRP", "DOGE", "ADA", "AVAX", "LINK")


def research_universe(master: DataFrame, markets: DataFrame, max_assets: int = 140, majors: tuple[str, ...] = MAJORS) -> DataFrame:
    """Research assets: filter, market snapshot, best row per token, limit that keeps majors.

    master: entity, token, source_id, spot_symbol, futures_symbol, excluded; markets: source_id, mcap, volume.
    """
    zero = F.lit(0.0)
    rows = master.where(F.col("token").isNotNull() & F.col("source_id").isNotNull() & ~F.col("excluded")).join(markets, "source_id", "left")
    rows = rows.withColumns({
        "is_major": F.col("token").isin(*majors), "has_futures": F.col("futures_symbol").isNotNull(),
        "has_venue": F.col("spot_symbol").isNotNull() | F.col("futures_symbol").isNotNull(),
        "_m": F.coalesce("mcap", zero), "_v": F.coalesce("volume", zero)})
    first = Window.partitionBy("token").orderBy(F.desc("has_futures"), F.desc("has_venue"), F.desc("_m"), F.desc("_v"), ENTITY)
    best = rows.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)
    # the final order puts majors, then futures names, first, so the limit of the
    # combined lists is the limit of one sort
    full = [F.desc("is_major"), F.desc("has_futures"), F.desc("has_venue"), F.desc("_m"), F.desc("_v"), F.col("token")]
    futures_first = best.where("is_major or has_futures").orderBy(*full).limit(max_assets + len(majors))
    top = best.orderBy(*full).limit(max_assets)
    pool = futures_first.unionByName(top).dropDuplicates([ENTITY])
    order = [F.desc("is_major"), F.desc("has_futures"), F.desc("_m"), F.desc("_v"), F.col("token")]
    return pool.orderBy(*order).limit(max_assets).select(ENTITY, "token", "source_id", "mcap", "volume", "is_major", "has_futures")


DEFI_PROTOCOLS = ("dex", "dexs", "lending", "liquidstaking", "yield", "yieldrestaking", "derivatives", "perps")
EXCLUDED_CATEGORIES = ("stablecoin", "wrapped", "pegged", "tokenisedtreasury", "basket", "infrastructureaggregate")
CANDIDATE_STABLES = ("usdt", "usdc", "dai", "fdusd", "tusd", "usde", "usds", "busd", "frax", "gho")


def dedupe_tickers(rows: DataFrame) -> DataFrame:
    """One row per ticker: protocols with metrics, chains, other protocols, the rest; then size.

    rows: entity, ticker, category, asset_type, mcap, tvl, volume.
    """
    zero = F.lit(0.0)
    chain = F.col("asset_type") == "chain"
    defi = ~chain & normalise_text("category").isin(*DEFI_PROTOCOLS)
    live = defi & ((F.coalesce("tvl", zero) > 0) | (F.coalesce("volume", zero) > 0))
    priority = F.when(live, 0).when(chain, 1).when(defi, 2).otherwise(3)
    w = Window.partitionBy("ticker").orderBy(priority, F.coalesce("mcap", zero).desc(), F.coalesce("tvl", zero).desc(), F.coalesce("volume", zero).desc(), ENTITY)
    return rows.withColumns({"priority": priority, "_rn": F.row_number().over(w)}).where(F.col("_rn") == 1).drop("_rn")


def screener_candidates(rows: DataFrame, max_candidates: int = SETTINGS.max_candidates, chain_quota: int = SETTINGS.chain_quota,
                        min_mcap: float = SETTINGS.min_candidate_mcap, min_tvl: float = SETTINGS.min_candidate_tvl,
                        min_volume: float = SETTINGS.min_candidate_volume) -> DataFrame:
    """Liquid by cap, TVL or volume, or a chain; not stable, wrapped or excluded; chains first up to a quota."""
    zero = F.lit(0.0)
    chain = F.col("asset_type") == "chain"
    m, t, v = (F.coalesce(c, zero) for c in ("mcap", "tvl", "volume"))
    liquid = (m >= min_mcap) | (t >= min_tvl) | (v >= min_volume) | chain
    bad = (normalise_text("ticker").isin(*CANDIDATE_STABLES) | normalise_text("name").rlike("wrapped|pegged")
           | normalise_text("category").isin(*EXCLUDED_CATEGORIES))
    ok = rows.where(F.col("ticker").isNotNull() & liquid & ~bad).withColumns({"is_chain": chain, "_m": m, "_t": t, "_v": v})
    # the rank table counts equal caps once per distinct value, never one sorted task
    upto = ordered.cumulative_counts(ok.withColumn("_all", F.lit(1)), ["_all"], "_m").select("_m", (F.col("n") - F.col("upto") + 1).alias("mcap_rank"))
    ranked = ok.join(upto, "_m")
    one = Window.partitionBy("asset_type", "ticker", "source_id").orderBy(F.desc("_m"), F.desc("_t"), F.desc("_v"), ENTITY)
    unique = ranked.withColumn("_rn", F.row_number().over(one)).where(F.col("_rn") == 1).drop("_rn")
    single = dedupe_tickers(unique)
    order = [F.desc("_m"), F.desc("_t"), F.desc("_v"), F.col("ticker")]
    n = single.count()
    if 0 < max_candidates < n:
        chains = single.where("is_chain").orderBy(*order).limit(chain_quota)
        # the quota's own size (at most `chain_quota`) decides the room left for the others
        room = max_candidates - chains.count()
        single = chains.unionByName(single.where("not is_chain").orderBy(*order).limit(max(room, 0)))
    return single.drop("_m", "_t", "_v")


def directory_candidates(rows: DataFrame, known_chains: DataFrame, max_candidates: int = SETTINGS.max_candidates, min_mcap: float = SETTINGS.min_candidate_mcap) -> DataFrame:
    """The same idea on the vendor directory: token class, no previews, liquid, ranked or a known chain."""
    base = rows.where((F.lower(F.coalesce("asset_class", F.lit("token"))) == "token") & ~F.coalesce("is_preview", F.lit(False)) & F.col("ticker").isNotNull())
    base = base.join(known_chains.select(ENTITY, F.lit(True).alias("_k")).distinct(), ENTITY, "left").withColumn("known_chain", F.coalesce("_k", F.lit(False))).drop("_k")
    bad = (normalise_text("ticker").isin(*CANDIDATE_STABLES[:6]) | normalise_text("name").contains("wrapped") | normalise_text("category").isin(*EXCLUDED_CATEGORIES))
    ok = base.where(((F.coalesce("mcap", F.lit(0.0)) >= min_mcap) | (F.col("mcap_rank") <= max_candidates) | F.col("known_chain")) & ~bad)
    w = Window.partitionBy("ticker").orderBy(F.desc("known_chain"), F.coalesce("mcap", F.lit(0.0)).desc(), ENTITY)
    one = ok.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    chains = one.where("known_chain")
    room = max(max_candidates - chains.count(), 0)
    others = one.where("not known_chain").orderBy(F.coalesce("mcap", F.lit(0.0)).desc(), "ticker").limit(room)
    return chains.unionByName(others)


def lagged_snapshot(scores: DataFrame, columns: list[str], key: str = "ticker", days: int = SETTINGS.factor_lag_rows) -> DataFrame:
    """Last score row per key at or before the latest date minus `days`."""
    cut = scores.agg(F.date_sub(F.max(DATE), days)).scalar()
    old = scores.where((F.col(DATE) <= cut) & F.col(key).isNotNull())
    row = F.max_by(F.struct(F.col(DATE).alias("factor_lag_date"), *[F.col(c).alias(f"{c}_lag") for c in columns]), DATE)
    return old.groupBy(key).agg(row.alias("_r")).select(key, "_r.*")


def top_table(df: DataFrame, score: str, n: int = 5, ascending: bool = False, tie: str = "ticker") -> DataFrame:
    rows = df.where(F.col(score).isNotNull())
    return rows.orderBy(F.asc(score) if ascending else F.desc(score), tie).limit(n)
