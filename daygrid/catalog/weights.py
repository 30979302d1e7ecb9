"""Weight grid, search, folds and selection (B12 to B22)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daygrid.catalog.base import query, r6
from daygrid.catalog.cross_section import ic_sql, names
from daygrid.catalog.panel import DEMO_PERIODS as P
from daygrid.catalog.research import RETS, STUDY_SQL, TEST14, Z_COLUMNS, days, every_sql, flat_study, period_sql, positions_sql, registry, test_dates, RET_SQL
from daygrid.catalog.score import decided_frame, renorm_sql, z_wide
from daygrid.config import FAMILIES, PRESET_WEIGHTS, Periods
from daygrid.functions.rolling import DATE, ENTITY
from daygrid.operators import exposure as G
from daygrid.operators import portfolio as B
from daygrid.operators import research as W
from daygrid.operators import score as C
from daygrid.plans import walkforward as K
from daygrid.sources import tables as T
from daygrid.sources.store import saved

GRID_SQL = """, gr AS (SELECT row_number() OVER (ORDER BY a, b, c, d) - 1 AS wid, a * 0.05::DOUBLE AS wa, b * 0.05::DOUBLE AS wb, c * 0.05::DOUBLE AS wc, d * 0.05::DOUBLE AS wd
  FROM (SELECT a, b, c, 20 - a - b - c AS d FROM range(13) t(a), range(13) u(b), range(13) v(c)) WHERE d BETWEEN 0 AND 12 AND (a > 0)::INT + (b > 0)::INT + (c > 0)::INT + (d > 0)::INT >= 2)"""
_NUM = "coalesce(fundamentals, 0) * wa + coalesce(momentum, 0) * wb + coalesce(flows, 0) * wc + coalesce(factor_improvement, 0) * wd"
_DEN = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE {w} END" for f, w in zip(FAMILIES, ("wa", "wb", "wc", "wd")))
WCOMP = f"round(({_NUM}) / nullif({_DEN}, 0), 10)"


def frame_of(spark, sf, families=True):
    """Families (or z columns only), labels, flags, regime and benchmark returns in one saved table."""
    daily, limits = T.brand_daily(spark, sf), T.bounds(spark, sf)
    bench = saved(T.market_close(daily, limits), "benchmark")
    m = T.brand_master(spark, sf)
    m = m.withColumn("excluded", C.is_excluded("ticker", ["ticker", "name", "category"]))
    p = W.label_returns(T.with_benchmark(T.brand_panel(spark, sf), bench)).withColumns({f"ret_{h}": F.col(f"ret_{h}") * 0.02 for h in (7, 14, 30)})
    flags = C.eligibility(p.withColumns({"mcap": F.col("mcap") * 4000, "volume": F.col("volume") * 400}), m).withColumns({"mcap": F.col("mcap") / 4000, "volume": F.col("volume") / 400})
    named = B.block_shorts(flags, m.select(ENTITY, F.col("ticker").alias("token")), ("T4",))
    side = G.weekly_regime(bench, bench).select(DATE, "regime").join(W.benchmark_returns(bench), DATE)
    rows = named.join(F.broadcast(side), DATE, "left")
    keep = (*RETS, "btc_ret_7", "btc_ret_14", "btc_ret_30", "eligible_base", "eligible_sensitivity", "shortable", "regime")
    make = decided_frame if families else z_wide
    return saved(make(rows, names(spark, sf), keep), "frame")


@query("B12_weight_grid_scores", STUDY_SQL + GRID_SQL + f" SELECT wid, count(*) AS n, round(avg({WCOMP}), 6) + 0.0::DOUBLE AS mean_score, round(max(wa + wb + wc + wd), 6) AS total_weight FROM wide4, gr WHERE date IN ({TEST14}) GROUP BY 1")
def _(spark, sf):
    rows = frame_of(spark, sf).join(F.broadcast(test_dates(spark, sf)), DATE, "left_semi").select(ENTITY, DATE, *FAMILIES)
    grid = B.weight_grid(spark)
    s = B.spread_weights(rows, grid).groupBy("wid").agg(F.count("*").alias("n"), F.avg("composite").alias("m"))
    w = grid.select("wid", sum(F.col(f"weight_{f}") for f in FAMILIES).alias("t"))
    return s.join(w, "wid").select("wid", "n", r6("m").alias("mean_score"), r6("t").alias("total_weight"))


TRAIN = period_sql("Train", 14)
SEARCH = f"SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM ({TRAIN})) WHERE n <= 30 OR (rn - 1) % 30 = 0"
REBAL = every_sql(TRAIN, 14)
_GIC = STUDY_SQL + GRID_SQL + f""", st AS (SELECT w.*, ret, eligible, shortable FROM wide4 w JOIN study USING (entity, date)), gs AS (SELECT wid, date, ret, {WCOMP} AS s FROM st, gr WHERE ret IS NOT NULL AND date IN ({SEARCH})),
  gi AS (SELECT gr.*, mean_ic FROM gr LEFT JOIN (SELECT wid, round(avg(ic), 10) AS mean_ic FROM ({ic_sql('gs', 's', 'ret', 'wid, date')}) GROUP BY 1) USING (wid))"""


def primary(frame):
    return frame.withColumns({"ret": F.col("ret_14"), "btc_return": F.col("btc_ret_14"), "eligible": F.col("eligible_base")})


@query("B14_weight_search_ic_only", _GIC + " SELECT wid, round(wa, 4) AS weight_fundamentals, round(wb, 4) AS weight_momentum, round(wc, 4) AS weight_flows, round(wd, 4) AS weight_factor_improvement, mean_ic FROM gi")
def _(spark, sf):
    f = primary(frame_of(spark, sf))
    dates = W.search_dates(W.period_dates(days(spark, sf), "Train", 14, P), 30)
    out = B.grid_ic(f.select(ENTITY, DATE, *FAMILIES), f.select(ENTITY, DATE, "ret"), B.weight_grid(spark), dates, names(spark, sf), "ret")
    return out.select("wid", *[r6(f"weight_{x}", 4).alias(f"weight_{x}") for x in FAMILIES], "mean_ic")


_Z = lambda c, w: f"""{w} * CASE WHEN count({c}) OVER () < 2 OR stddev_pop({c}) OVER () = 0 THEN coalesce({c}, median({c}) OVER (), {-5 if w > 0 else 5}) ELSE coalesce(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), (min({c}) OVER () - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 0) END"""


@query("B13_weight_search", _GIC + f""", sl AS (SELECT * FROM gi ORDER BY mean_ic DESC NULLS LAST, wid LIMIT 60), sc AS (SELECT wid, entity, date, ret, eligible, shortable, {WCOMP} AS score FROM st, sl WHERE date IN ({SEARCH}) OR date IN ({REBAL})),
  tb AS (SELECT *, row_number() OVER (PARTITION BY wid, date ORDER BY score DESC, entity) AS t, row_number() OVER (PARTITION BY wid, date ORDER BY score, entity) AS b, count(*) OVER (PARTITION BY wid, date) AS n FROM sc WHERE eligible AND score IS NOT NULL AND date IN ({SEARCH})),
  sp2 AS (SELECT wid, avg(s) AS spread FROM (SELECT wid, date, avg(ret) FILTER (t <= 5) - avg(ret) FILTER (b <= 5) AS s FROM tb WHERE n >= 10 GROUP BY 1, 2 HAVING count(ret) FILTER (t <= 5) >= 5 AND count(ret) FILTER (b <= 5) >= 5) GROUP BY 1),
  el AS (SELECT * FROM sc WHERE eligible AND score IS NOT NULL AND ret IS NOT NULL AND date IN ({REBAL})), lg AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY wid, date ORDER BY score DESC, entity) <= 5),
  sh AS (SELECT * FROM el WHERE shortable QUALIFY row_number() OVER (PARTITION BY wid, date ORDER BY score, entity) <= 5), sx AS (SELECT * FROM sh WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.wid = sh.wid AND lg.date = sh.date AND lg.entity = sh.entity)),
  po AS (SELECT wid, date, entity, ret, w * 0.1::DOUBLE AS weight FROM (SELECT *, 1 AS w FROM lg UNION ALL SELECT *, -1 FROM sx) QUALIFY count(*) FILTER (w = 1) OVER (PARTITION BY wid, date) = 5 AND count(*) FILTER (w = -1) OVER (PARTITION BY wid, date) = 5),
  nx AS (SELECT wid, date, lead(date) OVER (PARTITION BY wid ORDER BY date) AS nd FROM (SELECT DISTINCT wid, date FROM po)),
  tu AS (SELECT wid, date, sum(abs(d)) AS turnover FROM (SELECT wid, date, entity, sum(weight) AS d FROM (SELECT wid, date, entity, weight FROM po UNION ALL SELECT wid, nd, entity, -weight FROM po JOIN nx USING (wid, date) WHERE nd IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2),
  rt AS (SELECT wid, date, turnover, g - turnover * 0.005::DOUBLE AS r FROM (SELECT wid, date, sum(weight * ret) AS g FROM po GROUP BY 1, 2) JOIN tu USING (wid, date)),
  nv AS (SELECT *, product(1 + r) OVER (PARTITION BY wid ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM rt), dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY wid ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS x FROM nv),
  pf AS (SELECT wid, arg_max(nav, date) - 1 AS total_return, min(x) AS max_drawdown, avg(r) / stddev_samp(r) * sqrt(365.0::DOUBLE / 14) AS sharpe, avg(turnover) AS turnover FROM dd GROUP BY 1),
  al AS (SELECT gi.*, spread, total_return, max_drawdown, sharpe, turnover FROM gi LEFT JOIN sp2 USING (wid) LEFT JOIN pf USING (wid))
  SELECT wid, round(mean_ic, 6) + 0.0::DOUBLE AS mean_ic, round(spread, 6) + 0.0::DOUBLE AS spread, round(total_return, 6) + 0.0::DOUBLE AS total_return, round(sharpe, 5) + 0.0::DOUBLE AS sharpe, round(max_drawdown, 6) + 0.0::DOUBLE AS max_drawdown, round(turnover, 6) AS turnover,
    round({' + '.join(_Z(c, w) for c, w in B.OBJECTIVE.items())}, 5) + 0.0::DOUBLE AS objective FROM al""")
def _(spark, sf):
    f = primary(frame_of(spark, sf))
    train = W.period_dates(days(spark, sf), "Train", 14, P)
    out = K.search(f, spark, W.search_dates(train, 30), W.every_kth(train, 14), names(spark, sf))
    return out.select("wid", *[r6(c, 5 if c in ("sharpe", "objective") else 6).alias(c) for c in ("mean_ic", "spread", "total_return", "sharpe", "max_drawdown", "turnover", "objective")])


@query("B13_search_dates", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INT) AS m FROM orders)
  SELECT m, date FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY date) AS rn, count(*) OVER (PARTITION BY m) AS n FROM d) WHERE n <= 30 OR (rn - 1) % 30 = 0""")
def _(spark, sf):
    day = F.to_date("o_orderdate")
    return W.search_dates(T.table(spark, sf, "orders").select((F.year(day) * 12 + F.month(day)).alias("m"), day.alias(DATE)).distinct(), 30, ("m",))


@query("B15_preset_composites", STUDY_SQL + " " + " UNION ALL ".join(f"SELECT entity, date, '{m}' AS model, {renorm_sql(w)} AS score FROM wide4 WHERE date IN ({TEST14})" for m, w in PRESET_WEIGHTS.items()))
def _(spark, sf):
    rows = frame_of(spark, sf).join(F.broadcast(test_dates(spark, sf)), DATE, "left_semi").select(ENTITY, DATE, *FAMILIES)
    return K.runs(rows, B.preset_weights(spark)).select(ENTITY, DATE, "model", "score")


def _shrink_sql():
    out = []
    for b, wb in PRESET_WEIGHTS.items():
        for t, wt in PRESET_WEIGHTS.items():
            if b != t:
                for s in (0.5, 0.75):
                    out.append(f"SELECT '{b}>{t}@{s}' AS model, count(*) AS n, round(avg({renorm_sql({f: (1 - s) * wb[f] + s * wt[f] for f in FAMILIES})}), 6) + 0.0::DOUBLE AS mean_score FROM wide4 WHERE date IN ({TEST14})")
    return " UNION ALL ".join(out)


@query("B16_shrunk_weights", STUDY_SQL + " " + _shrink_sql())
def _(spark, sf):
    rows = frame_of(spark, sf).join(F.broadcast(test_dates(spark, sf)), DATE, "left_semi").select(ENTITY, DATE, *FAMILIES)
    p = B.preset_weights(spark)
    w = B.shrink_weights(p, p)
    w = w.select(F.concat("base", F.lit(">"), "target", F.lit("@"), F.col("shrink").cast("string")).alias("model"), *[f"weight_{f}" for f in FAMILIES])
    return K.runs(rows, w).groupBy("model").agg(F.count("*").alias("n"), r6(F.avg("score")).alias("mean_score"))


# one year of six-month-trained folds
FOLD_PERIODS = Periods(dt.date(1996, 1, 1), dt.date(1996, 12, 31), dt.date(1997, 1, 1), dt.date(1997, 6, 30), dt.date(1997, 7, 1))


def rolling(spark, sf):
    return K.rolling_diagnostics(frame_of(spark, sf, families=False), Z_COLUMNS, registry(spark), days(spark, sf), FOLD_PERIODS, names(spark, sf))


@query("B17_rolling_folds")
def _(spark, sf):
    r = rolling(spark, sf)
    return r.select("fold", "model", "variant", "eligible_universe", "train_end", "validation_start", "validation_end", "n_rebalances", *[r6(m).alias(m) for m in ("total_return", "sharpe", "max_drawdown", "avg_turnover")])


# Fold and validation tables derived from orders: one row per group of orders acts as one run.
_ROLL = """WITH rl AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'learned_global' WHEN 1 THEN 'equal_family' ELSE 'heuristic' END AS model, CASE o_custkey % 4 WHEN 0 THEN 'always_l_s' WHEN 1 THEN 'sticky_l_s' WHEN 2 THEN 'long_only' ELSE 'regime_switch' END AS variant,
    CASE o_custkey % 2 WHEN 0 THEN 'eligible_base' ELSE 'eligible_sensitivity' END AS eligible_universe, year(o_orderdate) AS fold, CASE WHEN month(o_orderdate) <= 6 THEN 14 ELSE 30 END AS horizon, avg((o_totalprice % 1000 - 470) / 1000) AS total_return, avg((o_totalprice % 100 - 45) / 10) AS sharpe,
    -avg(o_totalprice % 500) / 1000 AS max_drawdown, avg(o_totalprice % 300) / 100 AS calmar, avg(o_totalprice % 2) AS avg_turnover, count(*) AS n_rebalances FROM orders GROUP BY 1, 2, 3, 4, 5)"""


def order_runs(spark, sf):
    o, t = T.table(spark, sf, "orders"), F.col("o_totalprice")
    m3, m4, m2 = F.col("o_orderkey") % 3, F.col("o_custkey") % 4, F.col("o_custkey") % 2
    return o.groupBy(F.when(m3 == 0, "learned_global").when(m3 == 1, "equal_family").otherwise("heuristic").alias("model"), F.when(m4 == 0, "always_l_s").when(m4 == 1, "sticky_l_s").when(m4 == 2, "long_only").otherwise("regime_switch").alias("variant"),
                     F.when(m2 == 0, "eligible_base").otherwise("eligible_sensitivity").alias("eligible_universe"), F.year("o_orderdate").alias("fold"), F.when(F.month("o_orderdate") <= 6, 14).otherwise(30).alias("horizon")).agg(
        F.avg((t % 1000 - 470) / 1000).alias("total_return"), F.avg((t % 100 - 45) / 10).alias("sharpe"), (-F.avg(t % 500) / 1000).alias("max_drawdown"), (F.avg(t % 300) / 100).alias("calmar"), F.avg(t % 2).alias("avg_turnover"), F.count("*").alias("n_rebalances"))


_STATS = _ROLL + """, fs AS (SELECT model, variant, eligible_universe, count(total_return) AS rolling_folds, count(*) FILTER (total_return > 0) AS rolling_positive_folds, avg(total_return) AS rolling_avg_total_return, min(total_return) AS rolling_min_total_return, avg(sharpe) AS rolling_avg_sharpe
  FROM rl WHERE horizon = 14 GROUP BY 1, 2, 3)"""


@query("B18_fold_statistics", _STATS + " SELECT model, variant, eligible_universe, rolling_folds, rolling_positive_folds, round(rolling_avg_total_return, 6) + 0.0::DOUBLE AS rolling_avg_total_return, round(rolling_min_total_return, 6) + 0.0::DOUBLE AS rolling_min_total_return, round(rolling_avg_sharpe, 6) + 0.0::DOUBLE AS rolling_avg_sharpe FROM fs")
def _(spark, sf):
    s = B.fold_statistics(order_runs(spark, sf))
    return s.select("model", "variant", "eligible_universe", "rolling_folds", "rolling_positive_folds", *[r6(c).alias(c) for c in ("rolling_avg_total_return", "rolling_min_total_return", "rolling_avg_sharpe")])


_GATES = _STATS + """, v AS (SELECT model, variant, eligible_universe, horizon, 'Validation' AS period, total_return + 0.02 AS total_return, sharpe, max_drawdown, calmar, avg_turnover, n_rebalances, fs.* EXCLUDE (model, variant, eligible_universe) FROM rl LEFT JOIN fs USING (model, variant, eligible_universe) WHERE fold = (SELECT max(fold) FROM rl)),
  g AS (SELECT *, horizon = 14 AS pr, variant IN ('always_l_s', 'sticky_l_s') AS ls, coalesce(total_return > 0 AND sharpe > 0 AND n_rebalances >= 3 AND max_drawdown >= -0.5, FALSE) AS ok, coalesce(rolling_folds >= 3 AND rolling_positive_folds >= 3 AND rolling_avg_total_return > 0, FALSE) AS rok FROM v),
  gt AS (SELECT *, CASE WHEN pr THEN coalesce(sharpe, -5) + greatest(least(coalesce(calmar, -5), 5), -5) * 0.25::DOUBLE + coalesce(total_return, -1) * 2 - coalesce(avg_turnover, 2) * 0.05::DOUBLE END AS selection_score, pr AND ls AS is_l_s_candidate, pr AND NOT ls AS is_directional_candidate, pr AND ls AND ok AS passes_validation_gate, pr AND rok AS passes_rolling_gate, pr AND ls AND ok AND rok AS passes_strict_gate FROM g)"""


def gated(spark, sf):
    r = order_runs(spark, sf)
    v = r.where(F.col("fold") == r.agg(F.max("fold")).scalar()).withColumns({"period": F.lit("Validation"), "total_return": F.col("total_return") + 0.02})
    return B.selection_gates(v.join(B.fold_statistics(r), ["model", "variant", "eligible_universe"], "left"))


_FLAGS = ("is_l_s_candidate", "is_directional_candidate", "passes_validation_gate", "passes_rolling_gate", "passes_strict_gate")


@query("B19_selection_gates", _GATES + f" SELECT model, variant, eligible_universe, horizon, round(selection_score, 6) + 0.0::DOUBLE AS selection_score, {', '.join(_FLAGS)} FROM gt")
def _(spark, sf):
    return gated(spark, sf).select("model", "variant", "eligible_universe", "horizon", r6("selection_score").alias("selection_score"), *_FLAGS)


@query("B20_strict_choice", _GATES + f""", t AS (SELECT *, CASE WHEN passes_strict_gate THEN CASE WHEN eligible_universe = 'eligible_sensitivity' THEN 0 ELSE 1 END WHEN is_l_s_candidate THEN CASE WHEN eligible_universe = 'eligible_sensitivity' THEN 2 ELSE 3 END ELSE 4 END AS tier FROM gt WHERE pr),
  f AS (SELECT * FROM t ORDER BY tier, selection_score DESC NULLS LAST, model, variant LIMIT 1), j AS (SELECT f.*, b.total_return AS bt, b.sharpe AS bs, b.max_drawdown AS bd, b.passes_strict_gate AS bp FROM f LEFT JOIN t b ON b.model = 'learned_global' AND b.variant = 'always_l_s' AND b.eligible_universe = f.eligible_universe),
  k AS (SELECT *, tier <= 1 AND coalesce(bp, FALSE) AND NOT (model = 'learned_global' AND variant = 'always_l_s') AND NOT coalesce(total_return > bt + 0.01 AND sharpe > bs + 0.05 AND max_drawdown >= bd - 0.03, FALSE) AS back FROM j)
  SELECT CASE WHEN back THEN 'learned_global' ELSE model END AS model, CASE WHEN back THEN 'always_l_s' ELSE variant END AS variant, eligible_universe, round(CASE WHEN back THEN bt ELSE total_return END, 6) + 0.0::DOUBLE AS total_return, CASE WHEN tier <= 1 THEN 'STRICT_PASS' ELSE 'NO_STRICT_PASS' END AS status,
    CASE WHEN back THEN '{B.REASON_BASELINE}' WHEN tier <= 1 THEN '{B.REASON_BEST}' WHEN tier <= 3 THEN '{B.REASON_REPORT}' ELSE '{B.REASON_ANY}' END AS reason FROM k""")
def _(spark, sf):
    out = B.choose_candidate(saved(gated(spark, sf), "gated"))
    return out.select("model", "variant", "eligible_universe", r6("total_return").alias("total_return"), "status", "reason")


MONTHLY = f"SELECT max(date) AS date FROM ({period_sql('Test', 14)}) GROUP BY date_trunc('month', date)"


@query("B21_monthly_baskets", STUDY_SQL + positions_sql("always_l_s", MONTHLY) + RET_SQL + """, ls AS (SELECT date, list_sort(list(entity) FILTER (weight > 0)) AS lo, list_sort(list(entity) FILTER (weight < 0)) AS sh FROM pos GROUP BY 1)
  SELECT strftime(date, '%Y-%m') AS month, date AS signal_date, date + 1 AS entry_date, date + 15 AS exit_date, array_to_string(lo, ', ') AS long_tokens, array_to_string(sh, ', ') AS short_tokens, CASE WHEN lag(lo) OVER w IS NOT NULL THEN CAST(len(list_intersect(lo, lag(lo) OVER w)) AS INT) END AS long_overlap_prev, CASE WHEN lag(sh) OVER w IS NOT NULL THEN CAST(len(list_intersect(sh, lag(sh) OVER w)) AS INT) END AS short_overlap_prev,
    round(net_return, 6) + 0.0::DOUBLE AS net_return, round(product(1 + net_return) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS nav, round(net_return - btc_ret_14, 6) + 0.0::DOUBLE AS excess_return, round(turnover, 6) AS turnover FROM ls JOIN rets USING (date) LEFT JOIN bret USING (date) WINDOW w AS (ORDER BY date)""")
def _(spark, sf):
    ends = B.month_end_dates(W.period_dates(days(spark, sf), "Test", 14, P))
    pos = saved(flat_study(spark, sf, ("always_l_s",), ends), "positions")
    bench = T.market_close(T.brand_daily(spark, sf), T.bounds(spark, sf))
    br = W.benchmark_returns(bench).select(DATE, F.col("btc_ret_14").alias("btc_return"))
    keys = ["model", "variant"]
    out = B.monthly_baskets(pos, B.backtest(pos, keys).join(F.broadcast(br), DATE, "left"), keys, 14)
    return out.select("month", "signal_date", "entry_date", "exit_date", "long_tokens", "short_tokens", "long_overlap_prev", "short_overlap_prev", *[r6(c).alias(c) for c in ("net_return", "nav", "excess_return", "turnover")])


@query("B22_walk_forward_evaluation")
def _(spark, sf):
    f = frame_of(spark, sf)
    z = frame_of(spark, sf, families=False)
    p = Periods(dt.date(1996, 1, 1), dt.date(1996, 12, 31), dt.date(1997, 1, 1), dt.date(1997, 6, 30), dt.date(1997, 7, 1))
    out = K.walk_forward(z, f, Z_COLUMNS, registry(spark), days(spark, sf), p, names(spark, sf))
    return out["test"].select("model", "variant", "eligible_universe", "horizon", "n_rebalances", *[r6(m).alias(m) for m in B.METRICS])


