"""Portfolio construction, backtest, weight search and selection (B operators).

A run is one (model, variant, horizon, period, universe, ...) combination; the
run keys are columns, so every run of a study is computed in one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.config import FAMILIES, PRESET_WEIGHTS, SETTINGS
from daygrid.functions.rolling import DATE, ENTITY, corr_of
from daygrid.operators import cross_section as X
from daygrid.operators.score import SCORE_DECIMALS, renormalised, settle
from daygrid.sources.store import beside

LONG_SHORT = ("always_l_s", "sticky_l_s", "regime_aware_l_s")
DIRECTIONAL = ("long_only", "short_only", "regime_switch")
# Tokens never sold short.
NEVER_SHORT = ("HYPE",)


def block_shorts(rows: DataFrame, master: DataFrame, tokens: tuple[str, ...] = NEVER_SHORT) -> DataFrame:
    """Named tokens are not shortable; master: entity, token."""
    blocked = master.where(F.upper("token").isin(*[t.upper() for t in tokens])).select(ENTITY, F.lit(True).alias("_blocked"))
    return rows.join(blocked, ENTITY, "left").withColumn("shortable", F.col("shortable") & F.col("_blocked").isNull()).drop("_blocked")


def candidates(rows: DataFrame, keys: list[str], n: int = SETTINGS.basket_size, buffer: int = SETTINGS.short_rank_buffer,
               require_label: bool = True, max_names: int | None = None) -> DataFrame:
    """Top n and bottom max(buffer, 2n) shortable names of every run and date, as two ranked sides.

    rows: keys, entity, date, score, ret, eligible, shortable.  Bounded dates
    are ranked both ways in one pass.  Without a bound the sides are ranked
    apart, so each task first cuts its own rows to the limit and no date is
    ever gathered whole; save `rows` before, as both sides read it.
    """
    ok = rows.where(F.col("eligible") & F.col("score").isNotNull())
    if require_label:
        ok = ok.where(F.col("ret").isNotNull())
    part, most = [*keys, DATE], max(buffer, 2 * n)
    extra = ["regime"] if "regime" in rows.columns else []
    cols = [*part, ENTITY, "score", "ret", *extra]
    top = Window.partitionBy(*part).orderBy(F.desc("score"), ENTITY)
    low = Window.partitionBy(*part).orderBy("score", ENTITY)
    if X.fits_window(max_names):
        short_first = Window.partitionBy(*part).orderBy(F.desc("shortable"), "score", ENTITY)
        ranked = ok.select(*cols, "shortable").withColumns({"_t": F.row_number().over(top), "_b": F.row_number().over(short_first)})
        sides = F.filter(F.array(
            F.struct(F.col("_t").alias("pos"), F.lit(1).alias("side")),
            F.struct(F.when(F.col("shortable"), F.col("_b")).alias("pos"), F.lit(-1).alias("side"))),
            lambda s: s["pos"] <= F.when(s["side"] == 1, n).otherwise(most))
        return ranked.select(*cols, F.inline(sides))
    longs = ok.select(*cols).withColumn("pos", F.row_number().over(top)).where(F.col("pos") <= n).withColumn("side", F.lit(1))
    shorts = ok.where("shortable").select(*cols).withColumn("pos", F.row_number().over(low)).where(F.col("pos") <= most).withColumn("side", F.lit(-1))
    return longs.unionByName(shorts)


def flat_positions(cands: DataFrame, keys: list[str], variant: Column, n: int = SETTINGS.basket_size) -> DataFrame:
    """Weights of the variants without memory; `variant` is a column of the candidate rows.

    always_l_s takes the bottom n first and drops names also held long after,
    so an overlap leaves too few shorts and the date is not traded.
    """
    part = Window.partitionBy(*keys, DATE)
    regime = F.col("regime") if "regime" in cands.columns else F.lit(None).cast("string")
    kind = F.when(variant == "regime_switch", F.when(regime == "Bullish", "long_only").otherwise("short_only")).when(
        variant.isin(*LONG_SHORT), "l_s").otherwise(variant)
    rows = cands.where(F.col("pos") <= n).withColumns({
        "_kind": kind, "_both": F.count("*").over(Window.partitionBy(*keys, DATE, ENTITY)) > 1})
    both_sides = F.col("_kind") == "l_s"
    keep = F.when(both_sides, (F.col("side") == 1) | ~F.col("_both")).otherwise(
        ((F.col("_kind") == "long_only") & (F.col("side") == 1)) | ((F.col("_kind") == "short_only") & (F.col("side") == -1)))
    rows = rows.where(keep).withColumns({
        "_nl": F.count_if(F.col("side") == 1).over(part), "_ns": F.count_if(F.col("side") == -1).over(part)})
    full = F.when(both_sides, (F.col("_nl") >= n) & (F.col("_ns") >= n)).otherwise((F.col("_nl") + F.col("_ns")) >= n)
    weight = F.col("side") * F.when(both_sides, 0.5 / n).otherwise(1.0 / n)
    return rows.where(full).withColumn("weight", weight).drop("_kind", "_both", "_nl", "_ns", "side", "pos", "score")


def sticky_positions(cands: DataFrame, keys: list[str], n: int = SETTINGS.basket_size, buffer: int = SETTINGS.short_rank_buffer) -> DataFrame:
    """Sticky shorts: shorts still inside the buffer stay, then the weakest names fill up.

    Each date depends on the last traded one, so a run is walked in order.

    A group holds at most n + max(buffer, 2n) ranked rows per rebalance date,
    whatever the number of names; the candidates were cut before the shuffle.
    Names beyond 2n are never needed: at most n of them can be held long.
    """
    part = Window.partitionBy(*keys, DATE)
    types = dict(cands.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in (*keys, DATE, ENTITY)) + ", weight double"
    wide_enough = cands.withColumn("_n", F.count_if(F.col("side") == 1).over(part)).where(F.col("_n") >= n).drop("_n")

    # local functions travel with the plan, so workers need not have this package
    def book_of(rows: pd.DataFrame) -> Iterator[tuple]:
        held: list = []
        for day, book in rows.sort_values([DATE, "side", "pos"], ascending=[True, False, True]).groupby(DATE, sort=True):
            longs = book.loc[book.side == 1, ENTITY].tolist()
            taken = set(longs)
            pool = [e for e in book.loc[book.side == -1, ENTITY] if e not in taken]
            near = set(book.loc[(book.side == -1) & (book.pos <= max(buffer, n)), ENTITY])
            shorts = [e for e in held if e in near and e not in taken][:n]
            shorts += [e for e in pool if e not in shorts][: n - len(shorts)]
            if len(longs) < n or len(shorts) < n:
                continue
            held = shorts
            yield from ((day, e, 0.5 / n) for e in longs)
            yield from ((day, e, -0.5 / n) for e in shorts)

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(book_of(pdf), columns=[DATE, ENTITY, "weight"])
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, DATE, ENTITY, "weight"]]

    picked = wide_enough.select(*keys, DATE, ENTITY, "side", "pos").groupBy(*keys).applyInPandas(walk, schema)
    labels = cands.groupBy(*keys, DATE, ENTITY).agg(F.first("ret").alias("ret"), *([F.first("regime").alias("regime")] if "regime" in cands.columns else []))
    return picked.join(labels, [*keys, DATE, ENTITY], "left")


def backtest(positions: DataFrame, keys: list[str], cost_bps: float = SETTINGS.tx_cost_bps) -> DataFrame:
    """Per traded date: gross and net return, turnover against the last traded date, cost.

    Skipped dates leave the previous weights in place: the following traded
    date is found over traded dates only, and each weight is carried to it with
    a minus sign, so turnover is one grouped sum and no outer join.
    """
    part = Window.partitionBy(*keys).orderBy(DATE)
    dates = positions.select(*keys, DATE).distinct().withColumn("_next", F.lead(DATE).over(part))
    moved = positions.join(dates, [*keys, DATE]).where(F.col("_next").isNotNull())
    old = moved.select(*keys, F.col("_next").alias(DATE), ENTITY, (-F.col("weight")).alias("weight"))
    traded = positions.select(*keys, DATE, ENTITY, "weight").unionByName(old).groupBy(*keys, DATE, ENTITY).agg(F.sum("weight").alias("_d"))
    turnover = traded.groupBy(*keys, DATE).agg(F.sum(F.abs("_d")).alias("turnover"))
    extra = [F.first("regime").alias("regime")] if "regime" in positions.columns else []
    gross = positions.groupBy(*keys, DATE).agg(F.sum(F.col("weight") * F.col("ret")).alias("gross_return"), F.count("*").alias("n_positions"), *extra)
    out = gross.join(turnover, [*keys, DATE])
    cost = F.col("turnover") * (cost_bps / 10_000.0)
    return out.withColumns({"cost": cost, "net_return": F.col("gross_return") - cost})


def constituents(positions: DataFrame, returns: DataFrame, keys: list[str]) -> DataFrame:
    """Each position with its side and its contribution net of its share of the cost."""
    gross = positions.groupBy(*keys, DATE).agg(F.sum(F.abs("weight")).alias("_g"))
    rows = positions.join(gross, [*keys, DATE]).join(returns.select(*keys, DATE, "turnover", "cost"), [*keys, DATE])
    share = F.when(F.col("_g") > 0, F.col("cost") * F.abs("weight") / F.col("_g")).otherwise(0.0)
    return rows.withColumns({
        "side": F.when(F.col("weight") > 0, "Long").otherwise("Short"), "cost_allocated": share,
        "return_contribution": F.col("weight") * F.col("ret") - share}).drop("_g", "cost")


def nav(returns: DataFrame, keys: list[str], value: str = "net_return", out: str = "nav") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn(out, F.product(1.0 + F.coalesce(F.col(value), F.lit(0.0))).over(w))


def drawdowns(returns: DataFrame, keys: list[str], nav_col: str = "nav", out: str = "drawdown") -> DataFrame:
    """NAV against its running maximum; NAV has no initial 1, so a first-period loss does not count."""
    w = Window.partitionBy(*keys).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn(out, F.try_divide(F.col(nav_col), F.max(nav_col).over(w)) - 1.0)


METRICS = ("total_return", "annualized_return", "annualized_vol", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "avg_turnover", "total_cost",
           "btc_total_return", "excess_return", "beta", "alpha", "information_ratio", "correlation", "up_capture", "down_capture", "drawdown_vs_btc")


def performance(returns: DataFrame, keys: list[str], horizon: Column | int) -> DataFrame:
    """Nineteen metrics per run; rows need net_return, turnover, cost and optionally btc_return.

    beta is the sample covariance over the population variance, as published.
    """
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    rows = returns if "btc_return" in returns.columns else returns.withColumn("btc_return", F.lit(None).cast("double"))
    paired = rows.withColumn("_b", F.col("btc_return"))
    walked = drawdowns(nav(paired, keys), keys)
    # the benchmark is compounded over dates where it exists
    has = F.col("_b").isNotNull()
    bw = Window.partitionBy(*keys, has).orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    walked = walked.withColumn("_bn", F.when(has, F.product(1.0 + F.coalesce(F.col("_b"), F.lit(0.0))).over(bw)))
    walked = walked.withColumn("_bd", F.when(has, F.try_divide(F.col("_bn"), F.max("_bn").over(bw)) - 1.0))
    r, b = F.col("net_return"), F.col("_b")
    pr = F.when(has, r)
    agg = walked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max(h).alias("h"), F.datediff(F.max(DATE), F.min(DATE)).alias("span"),
        (F.max_by("nav", DATE) - 1.0).alias("total_return"), F.avg(r).alias("m"), F.stddev_samp(r).alias("s"),
        F.stddev_samp(F.when(r < 0, r)).alias("ds"), F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("hit_rate"), F.avg("turnover").alias("avg_turnover"), F.sum("cost").alias("total_cost"),
        F.count(b).alias("nb"), (F.max_by("_bn", F.when(has, F.col(DATE))) - 1.0).alias("btc_total_return"),
        F.avg(pr - b).alias("xm"), F.stddev_samp(pr - b).alias("xs"), F.covar_pop(pr, b).alias("cov"), F.var_pop(b).alias("vb"),
        corr_of(pr, b).alias("correlation"), F.min("_bd").alias("btc_dd"),
        F.avg(F.when(b > 0, r)).alias("up_r"), F.avg(F.when(b > 0, b)).alias("up_b"),
        F.avg(F.when(b < 0, r)).alias("dn_r"), F.avg(F.when(b < 0, b)).alias("dn_b"))
    per_year = 365.0 / F.col("h")
    years = F.greatest(F.col("span") + F.col("h"), F.col("h")) / 365.0
    grow = lambda t: F.when(t > -1, F.pow(1.0 + t, 1.0 / years) - 1.0)
    root = F.sqrt(per_year)
    out = agg.withColumns({
        "annualized_return": grow(F.col("total_return")), "annualized_vol": F.col("s") * root,
        "sharpe": F.when(F.col("s") > 0, F.col("m") / F.col("s") * root), "sortino": F.when(F.col("ds") > 0, F.col("m") / F.col("ds") * root),
        "excess_return": F.col("total_return") - F.col("btc_total_return"),
        "beta": F.when(F.col("vb") > 0, F.try_divide(F.col("cov") * F.col("nb"), (F.col("nb") - 1) * F.col("vb"))),
        "information_ratio": F.when(F.col("xs") > 0, F.col("xm") / F.col("xs") * root),
        "up_capture": F.try_divide("up_r", "up_b"), "down_capture": F.try_divide("dn_r", "dn_b"),
        "drawdown_vs_btc": F.col("max_drawdown") - F.col("btc_dd")})
    out = out.withColumns({
        "calmar": F.when(F.col("max_drawdown") < 0, F.col("annualized_return") / F.abs("max_drawdown")),
        "alpha": F.col("annualized_return") - F.col("beta") * grow(F.col("btc_total_return"))})
    return out.select(*keys, F.col("n").alias("n_rebalances"), *METRICS)


def beta_decomposition(metrics: DataFrame) -> DataFrame:
    attributed = F.col("beta") * F.col("btc_total_return")
    return metrics.withColumns({"beta_attributed_return": attributed, "dispersion_alpha": F.col("total_return") - attributed})


# ---- weights ----

def weight_grid(spark, families: tuple[str, ...] = FAMILIES, step: float = SETTINGS.weight_step, cap: float = SETTINGS.max_family_weight) -> DataFrame:
    """All weightings in steps that sum to one under the cap, in lexicographic order (1,291 rows by default)."""
    total, most = round(1 / step), round(cap / step)
    steps = F.sequence(F.lit(0), F.lit(most))
    g = spark.range(1).select()
    for f in families[:-1]:
        g = g.withColumn(f, F.explode(steps))
    g = g.withColumn(families[-1], F.lit(total) - sum(F.col(f) for f in families[:-1]))
    g = g.where(F.col(families[-1]).between(0, most)).where(sum((F.col(f) > 0).cast("int") for f in families) >= 2)
    order = Window.partitionBy(F.lit(0)).orderBy(*families)
    return g.select((F.row_number().over(order) - 1).alias("wid"), *[(F.col(f) * step).alias(f"weight_{f}") for f in families])


def preset_weights(spark) -> DataFrame:
    rows = [(m, *[w[f] for f in FAMILIES]) for m, w in PRESET_WEIGHTS.items()]
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"weight_{f} double" for f in FAMILIES))


def shrink_weights(base: DataFrame, target: DataFrame, shares: tuple[float, ...] = (0.5, 0.75), families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(1 - s) x base + s x target for every base and target scheme; both tables hold a few schemes."""
    b = base.select(F.col("model").alias("base"), *[F.col(f"weight_{f}").alias(f"b_{f}") for f in families])
    t = target.select(F.col("model").alias("target"), *[F.col(f"weight_{f}").alias(f"t_{f}") for f in families])
    both = beside(b, t).where("base <> target").withColumn("s", F.explode(F.array(*[F.lit(s) for s in shares])))
    mixed = [((1 - F.col("s")) * F.col(f"b_{f}") + F.col("s") * F.col(f"t_{f}")).alias(f"weight_{f}") for f in families]
    return both.select("base", "target", F.col("s").alias("shrink"), *mixed)


def spread_weights(scores: DataFrame, grid: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Composite of every weighting for every score row.

    The grid is a fixed few hundred to a few thousand rows whatever the data, so
    it travels as one array value and is exploded beside the scores.
    """
    entries = grid.agg(F.collect_list(F.struct("wid", *[F.col(f"weight_{f}") for f in families]))).scalar()
    wide = scores.withColumn("_w", F.explode(entries))
    ws = {f: F.col(f"_w.weight_{f}") for f in families}
    return wide.withColumns({"wid": F.col("_w.wid"), "composite": renormalised(ws)}).drop("_w", *families)


def _ics_of_date(keys: list[str], wids: list[int], weights: list[list[float]], families: list[str], ret: str, least: int, decimals: int):
    """Rank ICs of all weightings over one date's names, as a local function: it travels with the plan.

    The names with a composite depend only on which weights are above zero, so returns are ranked once for each such
    set of families and shared by its weightings, which are ranked a block of columns at a time.
    """

    def ranks(x):
        import numpy as np

        order = np.argsort(x, axis=0, kind="stable")
        s = np.take_along_axis(x, order, axis=0)
        at = np.arange(len(x))[:, None]
        new = np.vstack([np.ones((1, x.shape[1]), bool), s[1:] != s[:-1]])
        first = np.maximum.accumulate(np.where(new, at, 0), axis=0)
        ends = np.vstack([new[1:], np.ones((1, x.shape[1]), bool)])
        last = np.minimum.accumulate(np.where(ends, at, len(x))[::-1], axis=0)[::-1]
        out = np.empty(x.shape)
        np.put_along_axis(out, order, (first + last) / 2.0, axis=0)
        return out

    def compute(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        score, value = rows[families].to_numpy(float), rows[ret].to_numpy(float)
        ws, ic = np.array(weights), np.full(len(wids), np.nan)
        for used in {tuple(w > 0) for w in ws}:
            of = np.flatnonzero(((ws > 0) == used).all(axis=1))
            own = (~np.isnan(score[:, list(used)])).any(axis=1)
            if own.sum() < least:
                continue
            f, r = score[own], ranks(value[own, None])
            r = r - r.mean()
            for i in range(0, len(of), step := max(1, min(256, 1_000_000 // len(f)))):
                some = of[i : i + step]
                num, den = np.zeros((len(f), len(some))), np.zeros((len(f), len(some)))
                for k in range(len(families)):
                    num = num + np.nan_to_num(f[:, k, None]) * ws[some, k]
                    den = den + np.where(np.isnan(f[:, k, None]), 0.0, ws[some, k])
                c = ranks(np.round(num / den, decimals))
                c = c - c.mean(axis=0)
                spread = np.sqrt((c * c).sum(axis=0) * (r * r).sum())
                ic[some] = np.where(spread > 0, (c * r).sum(axis=0) / np.where(spread > 0, spread, 1.0), np.nan)
        out = pd.DataFrame({"wid": wids, "ic": pd.array(ic, dtype="Float64")})
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out[[*keys, "wid", "ic"]]

    return compute


def grid_ic(scores: DataFrame, labels: DataFrame, grid: DataFrame, dates: DataFrame, max_names: int | None, ret: str = "ret_14",
            by: tuple[str, ...] = (), families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Mean rank IC of every weighting over the search dates; rows are cut to those dates first.

    Scores move once, to their date: the weightings (a fixed number of rows, whatever the data) are applied inside the
    date's task, so no row is multiplied before it is ranked, and only one IC per date and weighting leaves.
    """
    keep = [*by, DATE]
    near = scores.join(F.broadcast(dates.select(*keep)), keep, "left_semi")
    near = near.join(labels.select(ENTITY, DATE, ret), [ENTITY, DATE]).where(F.col(ret).isNotNull()).select(*keep, *families, ret)
    table = grid.orderBy("wid").collect()
    ics = _ics_of_date(keep, [r["wid"] for r in table], [[r[f"weight_{f}"] for f in families] for r in table], list(families), ret, SETTINGS.min_names_ic, SCORE_DECIMALS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in near.select(*keep).schema) + ", wid int, ic double"
    means = near.groupBy(*keep).applyInPandas(ics, schema).groupBy(*by, "wid").agg(settle(F.avg("ic")).alias("mean_ic"))
    if by:
        return means.join(F.broadcast(grid), "wid")
    return grid.join(means, "wid", "left")


def best_by_ic(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Highest mean IC, the earlier grid row on a tie."""
    w = Window.partitionBy(*(by or (F.lit(0),))).orderBy(F.desc_nulls_last("mean_ic"), "wid")
    return table.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


# Weights of the search objective.
OBJECTIVE = {"mean_ic": 0.35, "spread": 0.20, "total_return": 0.25, "sharpe": 0.15, "max_drawdown": 0.10, "turnover": -0.05}


def shortlist(table: DataFrame, n: int = SETTINGS.shortlist) -> DataFrame:
    return table.orderBy(F.desc_nulls_last("mean_ic"), "wid").limit(n)


def objective(table: DataFrame) -> DataFrame:
    """Weighted sum of z-scores over the grid (population deviation), nulls set to the smallest z.

    A column that is constant or nearly empty enters with its raw values; for
    turnover the smallest z is a bonus, as published.  The grid is a fixed size.
    """
    whole = Window.partitionBy(F.lit(0))
    total = F.lit(0.0)
    for c, weight in OBJECTIVE.items():
        x = F.col(c)
        sd = F.stddev_pop(x).over(whole)
        z = F.try_divide(x - F.avg(x).over(whole), sd)
        flat = F.coalesce(x, F.median(x).over(whole), F.lit(-5.0 if weight > 0 else 5.0))
        smallest = F.try_divide(F.min(x).over(whole) - F.avg(x).over(whole), sd)
        total = total + weight * F.when((F.count(x).over(whole) < 2) | (sd == 0), flat).otherwise(F.coalesce(z, smallest, F.lit(0.0)))
    return table.withColumn("objective", settle(total))


# ---- selection ----

def fold_statistics(rolling: DataFrame, horizon: int = SETTINGS.primary_horizon) -> DataFrame:
    t = F.col("total_return")
    return rolling.where(F.col("horizon") == horizon).groupBy("model", "variant", "eligible_universe").agg(
        F.count(t).alias("rolling_folds"), F.count_if(t > 0).alias("rolling_positive_folds"), F.avg(t).alias("rolling_avg_total_return"),
        F.min(t).alias("rolling_min_total_return"), F.avg("sharpe").alias("rolling_avg_sharpe"))


def selection_gates(validation: DataFrame, horizon: int = SETTINGS.primary_horizon) -> DataFrame:
    """Score and gates of the primary validation rows; other rows get no score and no pass."""
    primary = (F.col("horizon") == horizon) & (F.col("period") == "Validation")
    or_ = lambda c, d: F.coalesce(F.col(c), F.lit(float(d)))
    score = or_("sharpe", -5) + F.greatest(F.least(or_("calmar", -5), F.lit(5.0)), F.lit(-5.0)) * 0.25 + or_("total_return", -1) * 2.0 - or_("avg_turnover", 2) * 0.05
    yes = lambda c: F.coalesce(primary & c, F.lit(False))
    ls = F.col("variant").isin(*LONG_SHORT)
    ok = ls & (F.col("total_return") > 0) & (F.col("sharpe") > 0) & (F.col("n_rebalances") >= 3) & (F.col("max_drawdown") >= -0.50)
    roll = (F.col("rolling_folds") >= 3) & (F.col("rolling_positive_folds") >= 3) & (F.col("rolling_avg_total_return") > 0)
    return validation.withColumns({
        "selection_score": F.when(primary, score), "is_l_s_candidate": yes(ls), "is_directional_candidate": yes(F.col("variant").isin(*DIRECTIONAL)),
        "passes_validation_gate": yes(ok), "passes_rolling_gate": yes(roll), "passes_strict_gate": yes(ok & roll)})


# Reasons reported with a choice.
REASON_BASELINE = "Strict gates passed, but the alternate did not clearly beat learned-global always L/S; the simpler baseline was selected."
REASON_BEST = "Best strict-gated L/S validation candidate, larger-volume universe preferred."
REASON_REPORT = "No L/S candidate cleared the validation and rolling gates; best L/S row for reporting only."
REASON_ANY = "No L/S candidate available; best validation row for reporting only."


def choose_candidate(gated: DataFrame, horizon: int = SETTINGS.primary_horizon) -> DataFrame:
    """One row: the chosen model with status and reason.  The table holds one row per model and variant."""
    primary = gated.where((F.col("horizon") == horizon) & (F.col("period") == "Validation"))
    base_row = (F.col("model") == "learned_global") & (F.col("variant") == "always_l_s")
    # tier 0 strict in the larger-volume universe, 1 strict, 2 and 3 the same for reporting, 4 anything
    sens = F.col("eligible_universe") == "eligible_sensitivity"
    tier = F.when(F.col("passes_strict_gate"), F.when(sens, 0).otherwise(1)).when(
        F.col("is_l_s_candidate"), F.when(sens, 2).otherwise(3)).otherwise(4)
    whole = Window.partitionBy(F.lit(0)).orderBy("_tier", F.desc_nulls_last("selection_score"), "model", "variant")
    first = primary.withColumn("_tier", tier).withColumn("_rn", F.row_number().over(whole)).where(F.col("_rn") == 1).drop("_rn")
    base = primary.where(base_row).select("eligible_universe", *[F.col(c).alias(f"b_{c}") for c in ("model", "variant", "total_return", "sharpe", "max_drawdown", "passes_strict_gate", "selection_score")])
    both = first.join(base, "eligible_universe", "left")
    beats = ((F.col("total_return") > F.col("b_total_return") + 0.01) & (F.col("sharpe") > F.col("b_sharpe") + 0.05)
             & (F.col("max_drawdown") >= F.col("b_max_drawdown") - 0.03))
    strict = F.col("_tier") <= 1
    back = strict & F.coalesce(F.col("b_passes_strict_gate"), F.lit(False)) & ~base_row & ~F.coalesce(beats, F.lit(False))
    pick = lambda c: F.when(back, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c)
    reason = F.when(back, REASON_BASELINE).when(strict, REASON_BEST).when(F.col("_tier") <= 3, REASON_REPORT).otherwise(REASON_ANY)
    return both.select(pick("model"), pick("variant"), "eligible_universe", pick("total_return"), pick("sharpe"), pick("max_drawdown"), pick("selection_score"),
                       F.when(strict, "STRICT_PASS").otherwise("NO_STRICT_PASS").alias("status"), reason.alias("reason"))


def month_end_dates(days: DataFrame) -> DataFrame:
    return days.groupBy(F.trunc(DATE, "month").alias("_m")).agg(F.max(DATE).alias(DATE)).select(DATE)


def monthly_baskets(positions: DataFrame, returns: DataFrame, keys: list[str], horizon: int) -> DataFrame:
    """One row per rebalance: long and short lists, overlap with the previous row, NAV, benchmark and excess.

    Lists hold the n names of one basket, so they are small.
    """
    listed = lambda side: F.array_sort(F.collect_list(F.when(F.signum("weight") == side, F.col(ENTITY))))
    lists = positions.groupBy(*keys, DATE).agg(listed(1).alias("longs"), listed(-1).alias("shorts"))
    w = Window.partitionBy(*keys).orderBy(DATE)
    over = lambda c: F.when(F.lag(c).over(w).isNotNull(), F.size(F.array_intersect(c, F.lag(c).over(w))))
    rows = nav(returns, keys).join(lists, [*keys, DATE])
    return rows.select(
        *keys, F.date_format(DATE, "yyyy-MM").alias("month"), F.col(DATE).alias("signal_date"), F.date_add(DATE, 1).alias("entry_date"),
        F.date_add(DATE, horizon + 1).alias("exit_date"), F.array_join("longs", ", ").alias("long_tokens"), F.array_join("shorts", ", ").alias("short_tokens"),
        over("longs").alias("long_overlap_prev"), over("shorts").alias("short_overlap_prev"), "gross_return", "cost", "net_return", "nav", "btc_return",
        (F.col("net_return") - F.col("btc_return")).alias("excess_return"), "turnover")


