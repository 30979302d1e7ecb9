"""Weight search, rolling folds and model choice over one prepared frame.

`frame` is a saved table: one row per entity and day with `z_<signal>`
columns, `ret_<h>` labels, eligibility flags and the regime.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daygrid.config import FAMILIES, PRESET_WEIGHTS, SETTINGS, Periods
from daygrid.functions.rolling import DATE, ENTITY
from daygrid.operators import portfolio as B
from daygrid.operators import research as W
from daygrid.operators import score as C
from daygrid.sources.store import beside, saved

FLAGS = ("eligible_base", "eligible_sensitivity")
VARIANTS = ("always_l_s", "sticky_l_s")
LEARNED_VARIANTS = (*VARIANTS, "long_only", "short_only", "regime_switch")


def search(rows: DataFrame, spark, train: DataFrame, rebalance: DataFrame, max_names: int | None) -> DataFrame:
    """Full weight search: IC for the whole grid, spread and backtest for the shortlist, objective.

    rows: entity, date, families, ret, eligible, shortable, btc_return, on every date of either list.
    """
    grid = B.weight_grid(spark)
    labels = rows.select(ENTITY, DATE, "ret")
    table = saved(B.grid_ic(rows.select(ENTITY, DATE, *FAMILIES), labels, grid, train, max_names, "ret"), "grid-ic")
    short = saved(B.shortlist(table), "shortlist")
    scored = B.spread_weights(rows, short).withColumnRenamed("composite", "score")
    near = scored.join(F.broadcast(train.select(DATE)), DATE, "left_semi").where("eligible")
    spread = W.top_bottom_spread(saved(near.select("wid", ENTITY, DATE, "score", "ret"), "spread"), "score", "ret", by=("wid",)).select("wid", "spread")
    trade = scored.join(F.broadcast(rebalance.select(DATE)), DATE, "left_semi")
    cands = saved(B.candidates(trade, ["wid"], max_names=max_names), "candidates")
    pos = saved(B.flat_positions(cands, ["wid"], F.lit("always_l_s")), "positions")
    btc = rows.groupBy(DATE).agg(F.max("btc_return").alias("btc_return"))
    perf = B.performance(B.backtest(pos, ["wid"]).join(btc, DATE, "left"), ["wid"], SETTINGS.primary_horizon)
    perf = perf.select("wid", "total_return", "max_drawdown", "sharpe", F.col("avg_turnover").alias("turnover"))
    return B.objective(table.join(spread, "wid", "left").join(perf, "wid", "left"))


def best_weights(table: DataFrame) -> dict[str, float]:
    """The winning row of a search (one row to the driver)."""
    r = table.orderBy(F.desc("objective"), "wid").limit(1).collect()[0]
    return {f: r[f"weight_{f}"] for f in FAMILIES}


def weight_table(spark, learned: DataFrame | dict, by: tuple[str, ...] = ()) -> DataFrame:
    """(fold,) model and weights: the presets and the learned row."""
    cols = [f"weight_{f}" for f in FAMILIES]
    presets = B.preset_weights(spark)
    if isinstance(learned, dict):
        one = spark.createDataFrame([("learned_global", *[float(learned[f]) for f in FAMILIES])], presets.schema)
        return presets.unionByName(one)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), *[F.lit(float(w[f])).alias(f"weight_{f}") for f in FAMILIES]) for m, w in PRESET_WEIGHTS.items()],
                   F.struct(F.lit("learned_global").alias("model"), *cols))
    return learned.select(*by, F.inline(rows))


def runs(scores: DataFrame, weights: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Composite of every model (per fold): a handful of weight rows beside each score row."""
    entries = weights.groupBy(*by).agg(F.collect_list(F.struct("model", *[f"weight_{f}" for f in FAMILIES])).alias("_ws")) if by else None
    wide = scores.join(F.broadcast(entries), list(by)) if by else scores.withColumn("_ws", weights.agg(F.collect_list(F.struct("model", *[f"weight_{f}" for f in FAMILIES]))).scalar())
    each = wide.withColumn("_w", F.explode("_ws")).drop("_ws")
    return each.withColumns({"model": F.col("_w.model"), "score": C.renormalised({f: F.col(f"_w.weight_{f}") for f in FAMILIES})}).drop("_w")


def evaluate(rows: DataFrame, keys: list[str], horizon, max_names: int | None) -> DataFrame:
    """Backtests of all runs and variants and their metrics; `keys` include model and any fold or period.

    rows: keys, entity, date, score, ret, both eligibility flags, shortable, regime, btc_return.
    """
    u = F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("ok")) for f in FLAGS]))
    each = rows.withColumn("_u", u).withColumns({"eligible_universe": F.col("_u.name"), "eligible": F.col("_u.ok")})
    keys = [*keys, "eligible_universe"]
    cands = saved(B.candidates(each, keys, max_names=max_names), "candidates")
    kinds = F.when(F.col("model") == "learned_global", F.array(*[F.lit(v) for v in LEARNED_VARIANTS])).when(
        F.col("model") == "learned_regime_specific", F.array(F.lit("regime_aware_l_s"))).otherwise(F.array(*[F.lit(v) for v in VARIANTS]))
    tagged = cands.withColumn("variant", F.explode(kinds))
    full = [*keys, "variant"]
    flat = B.flat_positions(tagged.where("variant <> 'sticky_l_s'"), full, F.col("variant"))
    sticky = B.sticky_positions(tagged.where("variant = 'sticky_l_s'"), full)
    pos = saved(flat.unionByName(sticky), "positions")
    btc = rows.groupBy(DATE, *(["horizon"] if "horizon" in keys else [])).agg(F.max("btc_return").alias("btc_return"))
    on = [DATE, "horizon"] if "horizon" in keys else [DATE]
    return B.performance(B.backtest(pos, full).join(btc, on, "left"), full, horizon)


def rolling_diagnostics(frame: DataFrame, signals: dict[str, tuple[str, str]], registry: DataFrame, days: DataFrame, p: Periods, max_names: int | None) -> DataFrame:
    """Signs, dedupe and weights relearned on each purged fold, then validated forward; the fold is a column."""
    spark = frame.sparkSession
    h0 = SETTINGS.primary_horizon
    folds = saved(W.walk_forward_folds(days, p), "folds")
    bound = lambda h: (F.col(DATE) >= F.col("train_start")) & (F.col(DATE) <= F.date_sub("validation_start", h + 1))
    # every IC once, up to the last fold's train end; folds only choose dates
    top = folds.agg(F.max("validation_start")).scalar()
    span = days.where((F.col(DATE) >= F.lit(p.train_start)) & (F.col(DATE) < top))
    ics = saved(W.signal_ics(frame, signals, {h: span for h in SETTINGS.horizons}, max_names), "ics")
    by_fold = beside(ics, folds).where((F.col(DATE) >= F.col("train_start")) & (F.datediff("validation_start", DATE) >= F.col("horizon") + 1))
    reg = beside(registry, folds.select("fold"))
    table = saved(W.ic_table(by_fold, reg, by=("fold",)), "ic-table")
    train = saved(beside(days, folds).where(bound(h0)).select("fold", DATE), "train-dates")
    seq = {r["signal"]: r["seq"] for r in registry.collect()}
    pairs = W.pair_correlations(frame, signals, seq, train, ("fold",))
    decisions = saved(W.dedupe_signals(table, pairs, by=("fold",)), "decisions")
    long = frame.select(ENTITY, DATE, F.inline(F.array(*[F.struct(F.lit(f).alias("family"), F.lit(s).alias("signal"), F.col(c).alias("z")) for c, (f, s) in signals.items()]))).where(F.col("z").isNotNull())
    scores = saved(C.apply_decisions(long, decisions, max_names, ("fold",)), "fold-scores")
    labels = frame.select(ENTITY, DATE, F.col(f"ret_{h0}").alias("ret"), *FLAGS, "shortable", "regime", F.col(f"btc_ret_{h0}").alias("btc_return"))
    search_dates = W.search_dates(train, SETTINGS.search_every, ("fold",))
    grid = B.grid_ic(scores, labels, B.weight_grid(spark), search_dates, max_names, "ret", ("fold",))
    weights = saved(weight_table(spark, B.best_by_ic(grid, ("fold",)), ("fold",)), "fold-weights")
    val = beside(days, folds).where(F.col(DATE).between(F.col("validation_start"), F.col("validation_end"))).select("fold", DATE)
    chosen = W.every_kth(val, h0, ("fold",))
    near = scores.join(F.broadcast(chosen), ["fold", DATE]).join(labels, [ENTITY, DATE])
    out = evaluate(runs(near, weights, ("fold",)), ["fold", "model"], h0, max_names)
    return out.withColumn("horizon", F.lit(h0)).join(F.broadcast(folds.drop("train_days", "validation_days")), "fold")


def walk_forward(frame: DataFrame, scores: DataFrame, signals: dict[str, tuple[str, str]], registry: DataFrame, days: DataFrame, p: Periods, max_names: int | None) -> dict[str, DataFrame]:
    """Train search, validation of five models, fold gates, choice, then one test evaluation of the chosen model.

    scores: entity, date, the four families (signs learned on Train).
    """
    spark = frame.sparkSession
    h0 = SETTINGS.primary_horizon
    wide = frame.select(ENTITY, DATE, *[f"ret_{h}" for h in SETTINGS.horizons], *[f"btc_ret_{h}" for h in SETTINGS.horizons], *FLAGS, "shortable", "regime")
    rows = saved(scores.select(ENTITY, DATE, *FAMILIES).join(wide, [ENTITY, DATE]), "study")
    primary = rows.withColumns({"ret": F.col(f"ret_{h0}"), "btc_return": F.col(f"btc_ret_{h0}"), "eligible": F.col("eligible_base")})
    train = W.period_dates(days, "Train", h0, p)
    regimes = rows.where("regime IS NOT NULL").select(DATE, "regime").distinct()
    learned = {}
    for name, keep in (("learned_global", None), ("learned_bullish", "Bullish"), ("learned_bearish", "Bearish")):
        d = train if keep is None else train.join(F.broadcast(regimes.where(F.col("regime") == keep)), DATE, "left_semi")
        learned[name] = best_weights(search(primary, spark, W.search_dates(d, SETTINGS.search_every), W.every_kth(d, h0), max_names))
    plan = None
    for period in ("Validation", "Test"):
        for h in SETTINGS.horizons:
            d = W.rebalance_dates(days, period, h, p).select(DATE, F.lit(h).alias("horizon"), F.lit(period).alias("period"))
            plan = d if plan is None else plan.unionByName(d)
    pick = lambda prefix: F.coalesce(*[F.when(F.col("horizon") == h, F.col(f"{prefix}_{h}")) for h in SETTINGS.horizons])
    near = saved(rows.join(F.broadcast(plan), DATE).withColumns({"ret": pick("ret"), "btc_return": pick("btc_ret")}), "near")
    four = runs(near, weight_table(spark, learned["learned_global"]))
    own = near.withColumns({"model": F.lit("learned_regime_specific"), "score": F.when(F.col("regime") == "Bearish", C.renormalised(learned["learned_bearish"])).otherwise(C.renormalised(learned["learned_bullish"]))})
    both = four.unionByName(own)
    keys = ["model", "horizon", "period"]
    validation = evaluate(both.where("period = 'Validation'"), keys, F.col("horizon"), max_names)
    rolling = saved(rolling_diagnostics(frame, signals, registry, days, p, max_names), "rolling")
    gated = saved(B.selection_gates(validation.join(B.fold_statistics(rolling), ["model", "variant", "eligible_universe"], "left")), "validation")
    chosen = saved(B.choose_candidate(gated), "chosen")
    appendix = saved(evaluate(both.where("period = 'Test'"), keys, F.col("horizon"), max_names), "appendix")
    test = appendix.join(F.broadcast(chosen.select("model", "variant", "eligible_universe")), ["model", "variant", "eligible_universe"], "left_semi")
    return {"validation": gated, "rolling": rolling, "chosen": chosen, "test": test, "appendix": appendix}
