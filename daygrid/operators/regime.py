"""Weekly market-regime features, indicator rules and classifier (I operators).

Every rule reads a weekly feature table, so all weeks are scored in one pass.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.functions.rolling import DATE, ENTITY, chg, ffill, lag, ratio, roll, running

WEEK = "week"
VOTES = ("risk_on", "choppy", "risk_off", "local_top", "local_bottom")

# Families in order with their weights (sum 100).
FAMILY_WEIGHTS = {"BTC trend / momentum": 20, "Market breadth": 15, "ETF + DAT flows": 30, "Stablecoin liquidity": 10,
                  "Leverage / volatility": 10, "Macro / AI": 10, "Valuation / sentiment": 5}


def weekly_series() -> Window:
    """One row per week: bounded by the calendar."""
    return Window.partitionBy(F.lit(0)).orderBy(WEEK)


def daily_series() -> Window:
    return Window.partitionBy(F.lit(0)).orderBy(DATE)


# ---- features ----

def weekly_last(df: DataFrame, values: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Monday-start weeks with the last non-null value."""
    aggs = [F.max_by(v, F.when(F.col(v).isNotNull(), F.col(DATE))).alias(v) for v in values]
    return df.groupBy(*keys, F.trunc(DATE, "week").alias(WEEK)).agg(*aggs)


def trend_features(weekly: DataFrame, close: str = "close") -> DataFrame:
    """20-week mean and slope, and returns over 1, 4, 8 and 12 weeks in percent."""
    w = weekly_series()
    rows = weekly.where(F.col(close).isNotNull()).withColumns({"sma": roll(F.avg, close, 20, 10, w), "n_weeks": F.row_number().over(w)})
    back = lambda k: chg(close, k, w) * 100.0
    return rows.withColumns({
        "slope": F.when(F.col("n_weeks") >= 2, F.col("sma") - lag("sma", 1, w)).otherwise(0.0), "ret_1w": back(1),
        "ret_4w": F.when(F.col("n_weeks") >= 5, back(4)).otherwise(0.0), "ret_8w": back(8),
        "ret_12w": F.when(F.col("n_weeks") >= 13, back(12)).otherwise(0.0)})


def breadth_features(token_weekly: DataFrame) -> DataFrame:
    """Share above the 20-week mean, median 8-week return, counts near 20-week highs and lows.

    token_weekly: entity, week, close, one row per entity and week.  The median
    runs over counts of distinct returns, so a week is never gathered whole.
    """
    from daygrid.operators import ordered

    w = Window.partitionBy(ENTITY).orderBy(WEEK)
    rows = token_weekly.withColumns({
        "_sma": roll(F.avg, "close", 20, 10, w), "_hi": roll(F.max, "close", 20, 20, w), "_lo": roll(F.min, "close", 20, 20, w),
        "_r8": chg("close", 8, w) * 100.0})
    valid = F.col("close").isNotNull() & F.col("_sma").isNotNull()
    per = rows.groupBy(WEEK).agg(
        F.try_divide(F.count_if(valid & (F.col("close") > F.col("_sma"))) * 100.0, F.count_if(valid)).alias("pct_above"),
        F.count_if(F.col("close") >= F.col("_hi") * 0.99).alias("highs"), F.count_if(F.col("close") <= F.col("_lo") * 1.01).alias("lows"))
    med = ordered.group_quantiles(rows.select(WEEK, "_r8"), [WEEK], "_r8", {"median_8w": 0.5})
    order = weekly_series()
    out = per.join(med, WEEK, "left").withColumns({"token_weeks": F.row_number().over(order), "lows_prev": F.lag("lows").over(order)})
    return out


def supply_growth(daily: DataFrame, value: str = "supply") -> DataFrame:
    """30- and 90-row growth in percent; with less history the first value is the base."""
    w = daily_series()
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    base = lambda k: F.coalesce(F.lag(value, k).over(w), first)
    rows = daily.where(F.col(value).isNotNull())
    g = lambda k: (ratio(value, base(k)) - 1.0) * 100.0
    return rows.select(DATE, F.row_number().over(w).alias("supply_rows"), g(30).alias("g30"), g(90).alias("g90"))


def vol_features(daily: DataFrame, price: str = "btc") -> DataFrame:
    """Annualised volatility of the last 56 returns against the 56 before, and the price change over them."""
    w = daily_series()
    rows = daily.where(F.col(price).isNotNull()).withColumns({"_r": chg(price, 1, w), "_n": F.row_number().over(w)})
    year = F.sqrt(F.lit(365.0)) * 100.0
    rows = rows.withColumn("vol_now", F.stddev_samp("_r").over(w.rowsBetween(-55, 0)) * year)
    before = F.stddev_samp("_r").over(w.rowsBetween(-111, -56)) * year
    return rows.select(
        DATE, F.col("_n").alias("vol_rows"), "vol_now", (F.col("vol_now") - F.when(F.col("_n") >= 113, before).otherwise(F.col("vol_now"))).alias("vol_chg"),
        (chg(price, 56, w) * 100.0).alias("price_chg_8w"))


def flow_sums(daily: DataFrame, flow: str) -> DataFrame:
    """Sums of the last 5 and the last 20 rows."""
    w = daily_series()
    return daily.select(DATE, F.sum(flow).over(w.rowsBetween(-4, 0)).alias("f5"), F.sum(flow).over(w.rowsBetween(-19, 0)).alias("f20"))


def portfolio_drawdown(daily: DataFrame, nav: str) -> DataFrame:
    return daily.select(DATE, ((ratio(nav, running(F.max, nav, daily_series())) - 1.0) * 100.0).alias("dd"))


def with_precedence(live: Column, override: Column) -> Column:
    """Live value, else the last manual row (row order carried forward over the weeks)."""
    return F.coalesce(live, ffill(override, None, weekly_series()))


def oi_percent(contracts: Column, price: Column, supply: float = 19_800_000.0) -> Column:
    """Open interest as percent of market cap; the price cancels unless it is missing."""
    return F.try_divide(contracts * price, price * supply) * 100.0


# ---- rules ----

@dataclass(frozen=True)
class Branch:
    when: Column
    score: int
    fit: str
    votes: dict[str, Column | float] = field(default_factory=dict)


def _branches(*rows) -> list[Branch]:
    return [Branch(cond, score, fit, dict(zip(VOTES, votes))) for cond, score, fit, *votes in rows]


def extra(cond: Column, points: float) -> Column:
    """Vote points only when a condition holds."""
    return F.when(cond, float(points)).otherwise(0.0)


def evaluate(family: str, name: str, present: Column, branches: list[Branch], fallback: int) -> Column:
    """Struct (family, indicator, score, regime_fit, votes); missing input gives the fallback score and choppy 100."""
    chain = lambda pick, default: reduce(lambda acc, b: acc.when(b.when, pick(b)), branches[1:], F.when(branches[0].when, pick(branches[0]))).otherwise(default)
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    ok = F.coalesce(present, F.lit(False))
    votes = [F.when(ok, chain(lambda b, v=v: lit(b.votes.get(v, 0.0)), F.lit(None).cast("double"))).otherwise(F.lit(100.0 if v == "choppy" else 0.0)).alias(v) for v in VOTES]
    return F.struct(
        F.lit(family).alias("family"), F.lit(name).alias("indicator"),
        F.when(ok, chain(lambda b: F.lit(b.score), F.lit(None).cast("int"))).otherwise(fallback).alias("score"),
        F.when(ok, chain(lambda b: F.lit(b.fit), F.lit(None).cast("string"))).otherwise("Choppy").alias("regime_fit"), F.struct(*votes).alias("votes"))



def rules() -> dict[str, Column]:
    """Indicator structs over the weekly feature columns.

    Fixed values: bands, scores and votes (risk on, choppy, risk off, local top, local bottom).
    """
    c = F.col
    yes = F.lit(True)
    up = "Risk-on support"
    down = "Risk-off drag"
    trend, breadth, etf, stable, lev, macro, val = FAMILY_WEIGHTS
    close, sma, slope = c("close"), c("sma"), c("slope")
    out = {
        "btc_vs_sma": evaluate(trend, "BTC vs 20-week SMA", close.isNotNull(), _branches(
            ((close > sma) & (slope > 0), 2, up, 80, 20), ((close > sma) & (slope <= 0), 1, "Choppy", 30, 60, 10),
            ((close <= sma) & (slope < 0), 0, down, 0, 30, 70), (yes, 1, "Choppy", 20, 60, 20)), 1),
        "sma_slope": evaluate(trend, "20-week SMA slope", close.isNotNull(), _branches(
            (slope > 0, 2, up, 70, 30), ((slope < 0) & (close < sma), 0, down, 0, 20, 70, 0, 10), (yes, 1, "Choppy", 20, 60, 20)), 1),
        "ret_4w": evaluate(trend, "BTC 4-week return", close.isNotNull(), _branches(
            (c("ret_4w") > 0, 2, up, 70, 20, 0, extra(c("ret_4w") > 20, 10)), (yes, 0, down, 0, 30, 60, 0, extra(c("ret_4w") < -15, 10))), 1),
        "ret_12w": evaluate(trend, "BTC 12-week return", close.isNotNull(), _branches(
            (c("ret_12w") > 3, 2, up, 70, 20, 0, extra(c("ret_12w") > 30, 10)), (c("ret_12w") >= -3, 1, "Choppy", 15, 70, 15),
            (yes, 0, down, 0, 25, 65, 0, extra(c("ret_12w") < -20, 10))), 1),
        "pct_above": evaluate(breadth, "% tokens above 20w SMA", c("pct_above").isNotNull(), _branches(
            (c("pct_above") > 60, 2, up, 75, 20, 0, extra(c("pct_above") > 85, 5)), (c("pct_above") >= 40, 1, "Choppy", 20, 65, 15),
            (yes, 0, down, 0, 25, 60, 0, extra(c("pct_above") < 20, 15))), 0),
        "median_vs_btc": evaluate(breadth, "Median token vs BTC, 8w", c("diff_8w").isNotNull(), _branches(
            (c("diff_8w") > 0, 2, up, 70, 25, 0, extra(c("diff_8w") > 15, 5)), (c("diff_8w") >= -5, 1, "Choppy", 15, 60, 25),
            (yes, 0, down, 0, 25, 60, 0, extra(c("diff_8w") < -15, 15))), 0),
        "highs_lows": evaluate(breadth, "New highs vs new lows", c("token_weeks") >= 20, _branches(
            (c("highs") > c("lows"), 2, up, 70, 20, 0, extra(c("highs") > c("lows") * 3, 10)),
            ((c("lows") > c("highs")) & (c("token_weeks") >= 21) & (c("lows_prev") > c("lows")), 1, "Bottom watch", 0, 40, 20, 0, 40),
            (yes, 1, "Choppy", 0, 50, 30, 0, 20)), 0),
        "stablecoin": evaluate(stable, "Stablecoin supply growth", c("supply_rows") >= 31, _branches(
            ((c("g30") > 0) & (c("g90") > 0), 2, up, 75, 25), ((c("g30") > 0) | (c("g90") > 0), 1, "Choppy", 25, 60, 15), (yes, 0, down, 0, 25, 65, 0, 10)), 0),
        "realised_vol": evaluate(lev, "8-week realised volatility", c("vol_rows") >= 57, _branches(
            ((c("vol_chg") < 0) & (c("price_chg_8w") >= 0), 2, "Local bottom support", 40, 30, 0, 0, 30),
            ((c("vol_chg") > 0) & (c("price_chg_8w") < 0), 0, down, 0, 25, 60, 15), (yes, 1, "Choppy", 20, 60, 20)), 1),
        "funding": evaluate(lev, "Funding rates", c("funding").isNotNull(), _branches(
            ((c("funding") > 0) & (c("funding") < 15), 2, up, 60, 30, 0, extra(c("funding") > 12, 10)), (c("funding") >= 15, 1, "Local top watch", 20, 30, 0, 50),
            (c("funding") < 0, 0, down, 0, 30, 50, 0, 20), (yes, 1, "Choppy", 30, 70)), 1),
        "oi_to_mcap": evaluate(lev, "Open interest / market cap", c("oi_pct").isNotNull(), _branches(
            (c("oi_pct").between(3, 5), 2, "Choppy to risk-on", 40, 50, 0, extra(c("oi_pct") > 4.5, 10)), (c("oi_pct") > 5, 1, "Local top watch", 0, 30, 20, 50),
            (yes, 1, "Choppy", 20, 60, 20)), 1),
        "basis": evaluate(lev, "CME / perp basis", c("basis").isNotNull(), _branches(
            (c("basis").between(5, 12), 2, "Choppy to risk-on", 40, 50, 0, extra(c("basis") > 10, 10)), (c("basis") > 15, 0, "Local top watch", 0, 20, 20, 60),
            (c("basis") < 5, 0, down, 0, 30, 50, 0, 20), (yes, 1, "Choppy", 30, 50, 0, 20)), 1),
        "dxy": evaluate(macro, "DXY trend", c("dxy").isNotNull(), _branches(
            (F.coalesce("dxy_chg", F.lit(0.0)) <= 0, 2, up, 60, 35, 0, 0, 5), (F.coalesce("dxy_chg", F.lit(0.0)) <= 1.5, 1, "Choppy", 15, 60, 25), (yes, 0, down, 0, 30, 60, 10)), 1),
        "real_yields": evaluate(macro, "Real yields", c("yield_bps").isNotNull(), _branches(
            (c("yield_bps") <= 0, 2, up, 55, 40, 0, 0, 5), (c("yield_bps") <= 10, 1, "Choppy", 15, 60, 25), (yes, 0, down, 0, 30, 55, 15)), 1),
        "ai_bias": evaluate(macro, "AI macro bias", c("ai_ret").isNotNull(), _branches(
            (c("ai_ret") > 0, 2, "Risk-on tilt", 60, 35, 0, extra(c("ai_ret") > 20, 5)), (c("ai_ret") >= -5, 1, "Choppy", 20, 60, 20), (yes, 0, down, 0, 35, 50, 0, 15)), 1),
        "mvrv": evaluate(val, "MVRV / NUPL", c("mvrv_z").isNotNull(), _branches(
            (c("mvrv_z") > 3.5, 0, "Local top", 0, 20, 10, 70), (c("mvrv_z") < 0.5, 2, "Local bottom", 10, 20, 0, 0, 70), (yes, 1, "Choppy", 15, 70, 15)), 1),
        # an unknown rank counts as 200; above 50 the votes are neutral
        "retail": evaluate(val, "Retail froth", yes, _branches(
            (F.coalesce("coin_rank", F.lit(200)) <= 10, 0, "Local top", 0, 20, 10, 70), (F.coalesce("coin_rank", F.lit(200)) <= 50, 1, "Top watch", 20, 40, 0, 40),
            (yes, 2, "No top signal", 20, 60, 20)), 1),
        "drawdown": evaluate(val, "Portfolio drawdown", yes, _branches(
            (F.coalesce("dd", F.lit(0.0)) > -15, 2, "Normal sizing", 30, 60, 10), (F.coalesce("dd", F.lit(0.0)) > -20, 1, "Defensive", 0, 30, 50, 0, 20),
            (yes, 0, "Capital preservation", 0, 0, 80, 0, 20)), 1),
        "btc_etf": evaluate(etf, "BTC ETF flows", c("btc_f5").isNotNull(), _branches(
            ((c("btc_f5") > 0) & (c("btc_f20") > 0), 2, up, 70, 25, 0, extra(c("btc_f5") > 2, 5)), ((c("btc_f5") < 0) & (c("btc_f20") < 0), 0, down, 0, 25, 65, 0, 10),
            (yes, 1, "Choppy", 25, 55, 20)), 2),
        "eth_etf": evaluate(etf, "ETH ETF flows", c("eth_f5").isNotNull(), _branches(
            ((c("eth_f5") > 0) & (c("eth_f20") > 0), 2, up, 60, 35, 0, 5), ((c("eth_f5") > 0) | (c("eth_f20") > 0), 1, "Choppy", 25, 60, 15), (yes, 0, down, 0, 30, 55, 0, 15)), 1),
        "etf_response": evaluate(etf, "ETF price response", c("ret_1w").isNotNull() & c("btc_f5").isNotNull(), _branches(
            ((c("btc_f5") > 0) & (c("ret_1w") > 3), 2, up, 75, 20, 0, 5), (c("btc_f5") > 0, 1, "Choppy / top watch", 25, 40, 0, 35),
            (c("ret_1w") < -3, 0, down, 0, 25, 60, 0, 15), (yes, 1, "Choppy", 20, 60, 20)), 1),
        "issuance": evaluate(etf, "DAT issuance capacity", c("issuance_bn").isNotNull(), _branches(
            ((c("issuance_bn") > 1) & ~F.coalesce("tightening", F.lit(False)), 2, up, 65, 30, 0, 5), (c("issuance_bn") > 0, 1, "Choppy", 30, 55, 15), (yes, 0, down, 0, 30, 55, 0, 15)), 1),
        "purchases": evaluate(etf, "DAT treasury purchases", c("purchases_bn").isNotNull(), _branches(
            (c("purchases_bn") > 0.5, 2, up, 70, 25, 0, 5), (c("purchases_bn") > 0, 1, "Choppy", 30, 55, 15), (yes, 0, down, 0, 25, 60, 0, 15)), 1),
        "credit": evaluate(etf, "STRC / DAT credit stress", c("credit_bps").isNotNull(), _branches(
            (c("credit_bps") <= 25, 2, up, 60, 35, 0, 5), (c("credit_bps") <= 100, 1, "Choppy / bottom watch", 0, 50, 30, 0, 20), (yes, 0, down, 0, 20, 65, 0, 15)), 1),
        "equity": evaluate(macro, "SPY / QQQ trend", c("eq_rows") >= 20, _branches(
            ((c("eq1") > 0) & (c("eq2") > 0) & (c("eq1_slope") > 0) & (c("eq2_slope") > 0), 2, up, 70, 30), ((c("eq1") > 0) & (c("eq2") > 0), 1, "Choppy", 40, 50, 10),
            ((c("eq1") < 0) & (c("eq2") < 0), 0, down, 0, 30, 60, 0, 10), (yes, 1, "Choppy", 20, 60, 20)), 1),
    }
    # company, display name, level above which issuing pays
    for who, name, top in (("mstr", "MSTR mNAV", 1.20), ("bmnr", "BMNR mNAV", 1.15), ("purr", "PURR multiple to adjusted NAV", 1.15)):
        m = c(f"mnav_{who}")
        out[f"mnav_{who}"] = evaluate(etf, name, m.isNotNull(), _branches(
            (m > top, 2, up, 65, 25, 0, extra(m > 2.0, 10)), (m > 1.0, 1, "Choppy", 25, 55, 20), (yes, 0, down, 0, 25, 60, 0, 15)), 0)
    return out


#: Rules whose code is generated together.
RULES_AT_ONCE = 3


def indicator_rows(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Long (week, family, indicator, score, regime_fit, votes.*), one row per indicator and week.

    A few rules at a time: each branch reads the columns of its own rules, and its generated code stays small.
    """
    table = rules()
    chosen = [table[n] for n in (names or table)]
    branches = [features.select(WEEK, "dd", F.inline(F.array(*chosen[i : i + RULES_AT_ONCE]))) for i in range(0, len(chosen), RULES_AT_ONCE)]
    return reduce(DataFrame.unionByName, branches).select(WEEK, "dd", "family", "indicator", "score", "regime_fit", "votes.*")


def family_scores(rows: DataFrame) -> DataFrame:
    """Family score and mean votes per week, empty families as choppy 100, with a read text.

    Means are rounded half to even, at one decimal.
    """
    r1 = lambda x: F.bround(x, 1)
    agg = rows.groupBy(WEEK, "family").agg(
        F.count_if(F.col("score") == 2).alias("indicators_met"), F.count("*").alias("indicators_total"),
        r1(F.sum("score") * 100.0 / (2 * F.count("*"))).alias("family_score"), F.sum("score").alias("_s"), *[F.avg(v).alias(v) for v in VOTES])
    every = rows.select(WEEK).distinct().select(WEEK, F.posexplode(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(w).alias("weight")) for f, w in FAMILY_WEIGHTS.items()])).alias("pos", "_f"))
    full = every.select(WEEK, "_f.family", "_f.weight").join(agg, [WEEK, "family"], "left")
    score = F.col("_s") * 100.0 / (2 * F.col("indicators_total"))
    strength = F.when(score >= 75, "strongly supportive").when(score >= 50, "moderately supportive").when(score >= 25, "mixed").otherwise("weak")
    on, ch, off = (F.col(v) for v in VOTES[:3])
    lean = F.when((on >= ch) & (on >= off), "risk-on").when(ch >= off, "choppy").otherwise("risk-off")
    read = F.concat("family", F.lit(" is "), strength, F.lit(" ("), F.col("indicators_met"), F.lit("/"), F.col("indicators_total"), F.lit(" met); primary lean is "), lean, F.lit("."))
    empty = F.col("indicators_total").isNull()
    return full.select(
        WEEK, "family", "weight", F.coalesce("indicators_met", F.lit(0)).alias("indicators_met"), F.coalesce("indicators_total", F.lit(0)).alias("indicators_total"),
        F.coalesce("family_score", F.lit(0.0)).alias("family_score"), *[F.when(empty, 100.0 if v == "choppy" else 0.0).otherwise(r1(F.col(v))).alias(v) for v in VOTES],
        F.when(empty, "No indicator data available for this family.").otherwise(read).alias("read"))


def classify(rows: DataFrame, on_at: float = 65.0, off_at: float = 65.0, lead: float = 10.0, overlay_at: float = 40.0, dd_at: float = -15.0) -> DataFrame:
    """Weekly regime: drawdown override, thresholds with leads, then local top and bottom, which may overwrite the override.

    The drawdown is compared at one decimal, as shown.
    """
    fams = family_scores(rows)
    total = float(sum(FAMILY_WEIGHTS.values()))
    per = fams.groupBy(WEEK).agg(*[F.sum(F.col(v) * F.col("weight") / total).alias(v) for v in VOTES])
    dd = rows.where(F.col("indicator") == "Portfolio drawdown").groupBy(WEEK).agg(F.max(F.bround(F.coalesce("dd", F.lit(0.0)), 1)).alias("_dd"))
    per = per.join(dd, WEEK, "left").withColumns({v: F.round(v, 9) for v in VOTES})
    on, ch, off, top, bottom = (F.col(v) for v in VOTES)
    base = F.when(F.coalesce(F.col("_dd") <= dd_at, F.lit(False)), "Risk-off").when(off >= off_at, "Risk-off").when(
        (on >= on_at) & (on - ch >= lead) & (on - off >= lead), "Risk-on").otherwise("Choppy")
    regime = F.when((top >= overlay_at) & (on >= 50), "Local top").when((bottom >= overlay_at) & (off >= 40), "Local bottom").otherwise(base)
    return per.select(WEEK, regime.alias("regime"), *[F.bround(v, 1).alias(f"{v}_score") for v in VOTES])


def weekly_history(classified: DataFrame, weekly: DataFrame, min_weeks: int = 21, start=None) -> DataFrame:
    """Classified weeks with enough history and the date the next one begins."""
    w = weekly_series()
    rows = weekly.select(WEEK, F.col("close").alias("btc_close"), "n_weeks").join(classified, WEEK).where(F.col("n_weeks") >= min_weeks)
    if start is not None:
        rows = rows.where(F.col(WEEK) >= F.lit(start))
    return rows.drop("n_weeks").withColumn("end_date", F.coalesce(F.lead(WEEK).over(w), F.date_add(WEEK, 7)))
