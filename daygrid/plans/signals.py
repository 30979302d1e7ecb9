"""Signal definitions (F, M, L and R operators) over the dense panel.

Three layers of columns: smoothed inputs, changes of those, statistics of the
changes.  Each layer is one `select` of windows with the same partitioning, so
all signals of all families share a single exchange on entity; columns nobody
asks for are pruned by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.functions.rolling import DATE, ENTITY, EPS, by_entity, chg, lag, ratio, roll, roll_corr, running
from daygrid.operators import cross_section as X

YEAR = 365.0

# Registry order decides the greedy dedupe: (family, signal, inputs).
SIGNALS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("fundamentals", "revenue", ("revenue",)),
    ("fundamentals", "revenue_growth", ("revenue",)),
    ("fundamentals", "revenue_growth_4w", ("revenue",)),
    ("fundamentals", "revenue_stability", ("revenue",)),
    ("fundamentals", "revenue_btc_corr", ("revenue", "btc")),
    ("fundamentals", "inverted_active_rev", ("revenue", "tips", "priority", "other_fees")),
    ("fundamentals", "gross_profit", ("gross_profit",)),
    ("fundamentals", "protocol_margin", ("revenue", "issuance")),
    ("fundamentals", "trading_fees", ("fees",)),
    ("fundamentals", "mc_fees_reversion", ("mcap", "fees")),
    ("fundamentals", "fdv_revenue", ("fdv", "revenue")),
    ("fundamentals", "payback_period", ("mcap", "revenue")),
    ("fundamentals", "implied_growth", ("mcap", "revenue")),
    ("fundamentals", "dau_growth", ("addresses",)),
    ("fundamentals", "dau_growth_4w", ("addresses",)),
    ("fundamentals", "growth_composite", ("revenue", "addresses")),
    ("fundamentals", "rev_per_address", ("revenue", "addresses")),
    ("fundamentals", "buyback_vs_issuance", ("burn", "issuance")),
    ("fundamentals", "staked_ratio", ("staked", "supply")),
    ("momentum", "vol_adj_momentum", ("price",)),
    ("momentum", "relative_strength", ("price", "btc")),
    ("momentum", "drawdown_from_ath", ("price",)),
    ("momentum", "momentum_breadth", ("price",)),
    ("momentum", "short_term_reversal", ("price",)),
    ("momentum", "realised_vol", ("price",)),
    ("momentum", "size", ("mcap",)),
    ("flows", "stablecoin_growth", ("stablecoin_supply",)),
    ("flows", "dex_volume_growth", ("dex_volume",)),
    ("flows", "bridge_net_flow", ("bridge_flow",)),
    ("flows", "oi_change", ("open_interest",)),
)

INPUTS = sorted({i for _, _, ins in SIGNALS for i in ins})

# Metrics of the research-only change and ratio signals.
CHANGE_METRICS = ("revenue", "fees", "tvl", "dex_volume", "open_interest", "stablecoin_supply", "addresses")
RATIO_METRICS = ("revenue", "fees", "tvl")


def names_of(family: str | None = None) -> list[str]:
    return [s for f, s, _ in SIGNALS if family in (None, f)]


def _annualised(m: str) -> Column:
    return F.col(f"{m}_full") * YEAR + EPS


def _smoothed() -> dict[str, Column]:
    out = {f"{m}_avg": roll(F.avg, m, 7, 3) for m in ("revenue", "fees", "gross_profit", "addresses", "stablecoin_supply", "dex_volume")}
    out |= {f"{m}_full": roll(F.avg, m, 7) for m in ("revenue", "fees")}
    out["ret_1"] = chg("price", 1)
    out["ret_w"] = chg("price", 7)
    out["ret_3w"] = chg("price", 21)
    return out


def _second() -> dict[str, Column]:
    return {
        "g_week": chg("revenue_avg", 7),
        "cap_fees": F.col("mcap") / _annualised("fees"),
        "cap_rev": F.col("mcap") / _annualised("revenue"),
    }


def _final() -> dict[str, Column]:
    passive = F.coalesce("tips", F.lit(0.0)) + F.coalesce("priority", F.lit(0.0)) + F.coalesce("other_fees", F.lit(0.0))
    peak = running(F.max, "price")
    breadth_rows = by_entity().rowsBetween(-90, 0)
    rising = F.coalesce((F.col("ret_w") > 0).cast("double"), F.lit(0.0))
    spread = lambda x, n, m: roll(F.stddev_samp, x, n, m)
    return {
        "revenue": F.col("revenue_avg"),
        "revenue_growth": chg("revenue_avg", 14),
        "revenue_growth_4w": chg("revenue_avg", 28),
        "revenue_stability": 1.0 / (spread("g_week", 91, 30) + EPS),
        "inverted_active_rev": -(passive / (F.col("revenue_raw") + EPS)),
        "gross_profit": F.col("gross_profit_avg"),
        "protocol_margin": F.col("revenue_raw") - F.col("issuance"),
        "trading_fees": F.col("fees_avg"),
        "mc_fees_reversion": -((F.col("cap_fees") - roll(F.avg, "cap_fees", 182, 60)) / (spread("cap_fees", 182, 60) + EPS)),
        "fdv_revenue": -(F.col("fdv") / _annualised("revenue")),
        "payback_period": -F.col("cap_rev"),
        "dau_growth": chg("addresses_avg", 14),
        "dau_growth_4w": chg("addresses_avg", 28),
        "rev_per_address": F.col("revenue_avg") / (F.col("addresses_avg") + EPS),
        "buyback_vs_issuance": F.col("burn") / (F.col("issuance") + EPS),
        "staked_ratio": F.col("staked") / (F.col("supply") + EPS),
        "vol_adj_momentum": F.col("ret_3w") / (spread("ret_1", 21, 10) * F.sqrt(F.lit(YEAR)) + EPS),
        "drawdown_from_ath": (F.col("price") - peak) / (peak + EPS),
        "momentum_breadth": F.when(F.count("*").over(breadth_rows) >= 39, F.avg(rising).over(breadth_rows)),
        "short_term_reversal": -F.col("ret_w"),
        "realised_vol": -(spread("ret_1", 28, 14) * F.sqrt(F.lit(YEAR))),
        "size": -F.col("mcap"),
        "stablecoin_growth": chg("stablecoin_supply_avg", 14),
        "dex_volume_growth": chg("dex_volume_avg", 14),
        "bridge_net_flow": roll(F.avg, "bridge_flow", 14, 5),
        "oi_change": chg("open_interest", 7),
    }


def signal_frame(panel: DataFrame, names: list[str], max_names: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Panel to (entity, date, one column per requested signal, kept columns).

    A metric the panel lacks counts as all null.  Only `growth_composite` and
    `implied_growth` need the cross-section and add an exchange on date.
    Columns in `keep` (labels, flags) ride along as `_k_<name>`, so they need no
    second panel and no join back.
    """
    null = F.lit(None).cast("double")
    have = set(panel.columns)
    base = panel.select(ENTITY, DATE, *[(F.col(m) if m in have else null).alias(m) for m in INPUTS], *[F.col(k).alias(f"_k_{k}") for k in keep])
    final = _final()
    extra = set()
    if "implied_growth" in names:
        extra.add("cap_rev")
    if "growth_composite" in names:
        extra |= {"revenue_growth", "dau_growth"}
    want = [n for n in names if n in final] + [c for c in extra if c in final and c not in names]
    layered = base.withColumns(_smoothed()).withColumns(_second()).withColumnRenamed("revenue", "revenue_raw")
    if "revenue_btc_corr" in names:
        both = F.col("revenue_raw").isNotNull() & F.col("btc").isNotNull()
        pairs = Window.partitionBy(ENTITY, "_pair").orderBy(DATE)
        layered = layered.withColumn("_pair", both).withColumn(
            "revenue_btc_corr", -F.when(F.col("_pair"), roll_corr("revenue_raw", "btc", 91, 91, pairs)))
    if "relative_strength" in names:
        layered = layered.withColumn("relative_strength", F.col("ret_3w") - chg("btc", 21))
    carried = [c for c in ("revenue_btc_corr", "relative_strength") if c in names] + (["cap_rev"] if "cap_rev" in extra else [])
    out = layered.select(ENTITY, DATE, *[final[n].alias(n) for n in want], *carried, *[f"_k_{k}" for k in keep])
    if "implied_growth" in names:
        if X.fits_window(max_names):
            out = out.withColumn("_m", F.median("cap_rev").over(Window.partitionBy(DATE)))
        else:
            from daygrid.operators import ordered

            out = out.join(ordered.group_quantiles(out, [DATE], "cap_rev", {"_m": 0.5}), DATE, "left")
        out = out.withColumn("implied_growth", -ratio("cap_rev", "_m"))
    if "growth_composite" in names:
        out = X.rank_z(out, "revenue_growth", [DATE], "_zr", max_names, winsor=True)
        out = X.rank_z(out, "dau_growth", [DATE], "_zu", max_names, winsor=True)
        out = out.withColumn("growth_composite", F.col("_zr") + F.col("_zu"))
    return out.select(ENTITY, DATE, *names, *[f"_k_{k}" for k in keep])


def research_signals(panel: DataFrame) -> DataFrame:
    """Inferred from published names: lag-1 changes over 28 and 56 days, and metric to market cap."""
    lagged = panel.select(ENTITY, DATE, "mcap", *[lag(m, 1).alias(m) for m in CHANGE_METRICS])
    return lagged.select(
        ENTITY, DATE,
        *[chg(m, k).alias(f"{m}_chg_{k // 7}w") for m in CHANGE_METRICS for k in (28, 56)],
        *[ratio(m, "mcap").alias(f"{m}_to_mcap") for m in RATIO_METRICS])


def long_signals(wide: DataFrame, names: list[str]) -> DataFrame:
    """(entity, date, family, signal, raw) with nulls dropped."""
    family = {s: f for f, s, _ in SIGNALS}
    rows = F.array(*[F.struct(F.lit(family[n]).alias("family"), F.lit(n).alias("signal"), F.col(n).alias("raw")) for n in names])
    return wide.select(ENTITY, DATE, F.inline(rows)).where(F.col("raw").isNotNull())


def z_signals(long: DataFrame, max_names: int | None = None) -> DataFrame:
    """Winsorised rank z of every signal and date: one exchange on (date, signal)."""
    return X.rank_z(long, "raw", [DATE, "family", "signal"], "z", max_names, winsor=True).where(F.col("z").isNotNull())


def registry(spark) -> DataFrame:
    return spark.createDataFrame([(i, f, s) for i, (f, s, _) in enumerate(SIGNALS)], "seq int, family string, signal string")


def stable_signals(ic: DataFrame, periods: tuple[str, ...] = ("Train", "Validation", "Test")) -> DataFrame:
    """Signals with a positive mean IC in every period, weakest period first in the order."""
    wide = ic.groupBy("signal").pivot("period", list(periods)).agg(F.avg("mean_ic"))
    weakest = F.least(*[F.col(p) for p in periods])
    positive = F.lit(True)
    for p in periods:
        positive = positive & (F.col(p) > 0)
    return wide.where(positive).withColumn("weakest", weakest)


