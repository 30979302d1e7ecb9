"""Labels, folds, ICs (W) and portfolios (B) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.catalog.base import BRAND, query, r6
from daygrid.catalog.cross_section import LABELS, ic_sql, names, rank_z_sql
from daygrid.catalog.panel import DEMO_PERIODS
from daygrid.catalog.score import (DEC_SQL, DEMO, ELIG_SQL, REGIME_SQL, Z_SQL, benchmark, decided_frame, decided_scores, regime, renorm_sql, z_wide)
from daygrid.config import FAMILIES
from daygrid.functions.rolling import DATE, ENTITY, lag
from daygrid.operators import exposure as G
from daygrid.operators import portfolio as B
from daygrid.operators import research as W
from daygrid.operators import score as C
from daygrid.plans import signals as S
from daygrid.sources import tables as T
from daygrid.sources.store import saved

P = DEMO_PERIODS


def days(spark, sf):
    return T.bounds(spark, sf).select(F.explode(F.sequence("lo", "hi")).alias(DATE))


@query("W01_forward_returns", LABELS + " SELECT entity, date, round(ret_7, 6) + 0.0::DOUBLE AS ret_7, round(ret_14, 6) + 0.0::DOUBLE AS ret_14, round(ret_30, 6) + 0.0::DOUBLE AS ret_30 FROM lab")
def _(spark, sf):
    return W.label_returns(T.brand_panel(spark, sf)).select(ENTITY, DATE, *[r6(f"ret_{h}").alias(f"ret_{h}") for h in (7, 14, 30)])


BTC_RET = """, bret AS (SELECT date, lead(btc, 8) OVER w / lead(btc, 1) OVER w - 1 AS btc_ret_7, lead(btc, 15) OVER w / lead(btc, 1) OVER w - 1 AS btc_ret_14,
  lead(btc, 31) OVER w / lead(btc, 1) OVER w - 1 AS btc_ret_30 FROM btc WINDOW w AS (ORDER BY date))"""


@query("W02_benchmark_forward_returns", BRAND + BTC_RET + " SELECT date, round(btc_ret_7, 6) + 0.0::DOUBLE AS btc_ret_7, round(btc_ret_14, 6) + 0.0::DOUBLE AS btc_ret_14, round(btc_ret_30, 6) + 0.0::DOUBLE AS btc_ret_30 FROM bret")
def _(spark, sf):
    out = W.benchmark_returns(benchmark(spark, sf))
    return out.select(DATE, *[r6(f"btc_ret_{h}").alias(f"btc_ret_{h}") for h in (7, 14, 30)])


_LAST = "(SELECT max(date) FROM days)"


def period_sql(period: str, h: int) -> str:
    lo, hi = {"Train": ("1996-01-01", "1998-12-31"), "Validation": ("1999-01-01", "1999-12-31"), "Test": ("2000-02-01", None)}[period]
    end = f"{_LAST} - {h + 1}" if hi is None else f"least(DATE '{hi}' - {h + 1}, {_LAST} - {h + 1})"
    return f"SELECT date FROM days WHERE date >= DATE '{lo}' AND date <= {end}"


def every_sql(rel: str, k: int) -> str:
    return f"SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM ({rel})) WHERE (rn - 1) % {k} = 0"


@query("W03_purged_period_bounds", BRAND + " " + " UNION ALL ".join(
    f"SELECT '{p}' AS period, {h} AS horizon, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM ({period_sql(p, h)})"
    for p in ("Train", "Validation", "Test") for h in (7, 14, 30)))
def _(spark, sf):
    out = None
    for p in ("Train", "Validation", "Test"):
        for h in (7, 14, 30):
            d = W.period_dates(days(spark, sf), p, h, P).agg(F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), F.count("*").alias("n"))
            d = d.select(F.lit(p).alias("period"), F.lit(h).alias("horizon"), "first_date", "last_date", "n")
            out = d if out is None else out.unionByName(d)
    return out


@query("W04_rebalance_sampling", BRAND + " " + " UNION ALL ".join(f"SELECT {h} AS horizon, date FROM ({every_sql(period_sql('Validation', h), h)})" for h in (7, 14, 30)))
def _(spark, sf):
    out = None
    for h in (7, 14, 30):
        d = W.rebalance_dates(days(spark, sf), "Validation", h, P).select(F.lit(h).alias("horizon"), DATE)
        out = d if out is None else out.unionByName(d)
    return out


@query("W05_walk_forward_folds", BRAND + f""", f AS (SELECT i, CAST(DATE '1996-01-01' + INTERVAL (6 + 3 * i) MONTH AS DATE) AS vs FROM range(40) t(i) WHERE DATE '1996-01-01' + INTERVAL (6 + 3 * i) MONTH <= DATE '1999-12-31'),
  g AS (SELECT i, vs AS validation_start, vs - 15 AS train_end, least(CAST(vs + INTERVAL 3 MONTH AS DATE) - 1, DATE '1999-12-31', {_LAST} - 15) AS validation_end FROM f)
  SELECT 'fold_' || (i + 1) AS fold, DATE '1996-01-01' AS train_start, train_end, validation_start, validation_end, 15 AS purge_days,
    count(*) FILTER (date BETWEEN DATE '1996-01-01' AND train_end) AS train_days, count(*) FILTER (date BETWEEN validation_start AND validation_end) AS validation_days
  FROM g, days GROUP BY ALL""")
def _(spark, sf):
    return W.walk_forward_folds(days(spark, sf), P)


LSIG = Z_SQL + """, lab AS (SELECT entity, date, price, lead(price, 8) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_7,
    lead(price, 15) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_14, lead(price, 31) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_30
  FROM panel WINDOW e AS (PARTITION BY entity ORDER BY date))"""
ICS_SQL = LSIG + ", ics AS (" + " UNION ALL ".join(
    f"SELECT family, signal, {h} AS horizon, date, ic FROM ({ic_sql(f'(SELECT zz.*, ret_{h} AS r FROM zz JOIN lab USING (entity, date) WHERE date IN ({period_sql('Train', h)}))', 'z', 'r', 'family, signal, date')}) WHERE ic IS NOT NULL"
    for h in (7, 14, 30)) + ")"
REGISTRY = [(i, f, s) for i, s in enumerate(DEMO) for f in (next(ff for ff, ss, _ in S.SIGNALS if ss == s),)]


def registry(spark):
    return spark.createDataFrame(REGISTRY, "seq int, family string, signal string")


Z_COLUMNS = {f"z_{s}": (f, s) for _, f, s in REGISTRY}
RETS = ("ret_7", "ret_14", "ret_30")


def train_dates(spark, sf):
    return {h: W.period_dates(days(spark, sf), "Train", h, P) for h in (7, 14, 30)}


def labelled_z(spark, sf):
    """z of every demo signal and the labels, one pass over the panel."""
    return z_wide(W.label_returns(T.brand_panel(spark, sf, True)), names(spark, sf), RETS)


def train_table(spark, sf, z):
    return W.ic_table(W.signal_ics(z, Z_COLUMNS, train_dates(spark, sf), names(spark, sf)), registry(spark))


@query("W07_composite_ic", DEC_SQL + f""", cmp AS (SELECT entity, date, {renorm_sql({'fundamentals': 0.25, 'momentum': 0.4, 'flows': 0.25, 'factor_improvement': 0.1})} AS s FROM wide4),
  lab AS (SELECT entity, date, {', '.join(f'lead(price, {h + 1}) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_{h}' for h in (7, 14, 30))} FROM panel WINDOW e AS (PARTITION BY entity ORDER BY date))
  SELECT round(avg(ic), 6) AS mean_ic, count(*) AS n FROM (""" + " UNION ALL ".join(
    f"SELECT ic FROM ({ic_sql(f'(SELECT cmp.*, ret_{h} AS r FROM cmp JOIN lab USING (entity, date) WHERE date IN ({period_sql('Validation', h)}))', 's', 'r')}) WHERE ic IS NOT NULL" for h in (7, 14, 30)) + ")")
def _(spark, sf):
    ws = {"fundamentals": 0.25, "momentum": 0.4, "flows": 0.25, "factor_improvement": 0.1}
    s = decided_frame(W.label_returns(T.brand_panel(spark, sf, True)), names(spark, sf), RETS).withColumn("z", C.renormalised(ws))
    dates = {h: W.period_dates(days(spark, sf), "Validation", h, P) for h in (7, 14, 30)}
    ics = W.signal_ics(s, {"z": ("all", "composite")}, dates, names(spark, sf))
    return ics.agg(r6(F.avg("ic")).alias("mean_ic"), F.count("*").alias("n"))


_TABLE_SQL = ICS_SQL + """, tab AS (SELECT family, signal, """ + ", ".join(
    f"avg(ic) FILTER (horizon = {h}) AS mean_ic_{h}d, count(ic) FILTER (horizon = {h}) AS n_ic_{h}d" for h in (7, 14, 30)) + """, avg(ic) AS mean_ic_avg FROM ics GROUP BY 1, 2),
  reg AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{f}', '{s}')" for i, f, s in REGISTRY) + """) t(seq, family, signal)),
  dt AS (SELECT reg.family, reg.signal, reg.seq, mean_ic_avg, """ + ", ".join(f"mean_ic_{h}d, coalesce(n_ic_{h}d, 0) AS n_ic_{h}d" for h in (7, 14, 30)) + """,
    CASE WHEN mean_ic_avg < 0 THEN -1 ELSE 1 END AS sign, mean_ic_avg IS NOT NULL AS selected FROM reg LEFT JOIN tab USING (family, signal))"""
_IC_COLS = ("mean_ic_7d", "mean_ic_14d", "mean_ic_30d", "mean_ic_avg")


@query("W08_signal_ic_table", _TABLE_SQL + " SELECT family, signal, " + ", ".join(f"round({c}, 6) AS {c}" for c in _IC_COLS) + ", n_ic_7d, n_ic_14d, n_ic_30d, sign, selected FROM dt")
def _(spark, sf):
    t = train_table(spark, sf, labelled_z(spark, sf))
    return t.select("family", "signal", *[r6(c).alias(c) for c in _IC_COLS], "n_ic_7d", "n_ic_14d", "n_ic_30d", "sign", "selected")


_PAIR_SQL = _TABLE_SQL + f""", sz AS (SELECT zz.entity, zz.date, dt.family, dt.signal, dt.seq, z * sign AS z FROM zz JOIN dt USING (family, signal) WHERE selected AND date IN ({period_sql('Train', 14)})),
  pr AS (SELECT a.family, a.signal AS left_signal, b.signal AS right_signal, a.z AS x, b.z AS y FROM sz a JOIN sz b ON a.entity = b.entity AND a.date = b.date AND a.family = b.family AND a.seq < b.seq),
  rk AS (SELECT *, rank() OVER (PARTITION BY family, left_signal, right_signal ORDER BY x) + (count(*) OVER (PARTITION BY family, left_signal, right_signal, x) - 1) / 2.0::DOUBLE AS rx,
    rank() OVER (PARTITION BY family, left_signal, right_signal ORDER BY y) + (count(*) OVER (PARTITION BY family, left_signal, right_signal, y) - 1) / 2.0::DOUBLE AS ry FROM pr),
  pc AS (SELECT family, left_signal, right_signal, abs(corr(rx, ry)) AS corr FROM rk GROUP BY 1, 2, 3)"""


def table_and_pairs(spark, sf):
    """IC table and pair correlations; z-scores and the small table are written once, both branches read them."""
    z = saved(labelled_z(spark, sf), "z")
    t = saved(train_table(spark, sf, z), "ic-table")
    return t, W.pair_correlations(z, Z_COLUMNS, {s: i for i, _, s in REGISTRY}, W.period_dates(days(spark, sf), "Train", 14, P))


@query("W09_signal_pair_correlations", _PAIR_SQL + " SELECT family, left_signal, right_signal, round(corr, 6) AS corr FROM pc")
def _(spark, sf):
    _, c = table_and_pairs(spark, sf)
    return c.select("family", "left_signal", "right_signal", r6("corr").alias("corr"))


# With three signals a family the greedy pass is: the first close pair drops its
# weaker signal; a later pair counts only if neither of its signals is gone.
@query("W09_signal_dedupe", _PAIR_SQL + """, ordp AS (SELECT pc.*, l.seq AS ls, r.seq AS rs, CASE WHEN abs(l.mean_ic_avg) >= abs(r.mean_ic_avg) THEN right_signal ELSE left_signal END AS loser,
    row_number() OVER (PARTITION BY pc.family ORDER BY l.seq, r.seq) AS k FROM pc JOIN dt l ON l.signal = left_signal JOIN dt r ON r.signal = right_signal WHERE corr >= 0.2),
  d1 AS (SELECT family, loser FROM ordp WHERE k = 1),
  d2 AS (SELECT o.family, o.loser FROM ordp o WHERE k = 2 AND NOT EXISTS (SELECT 1 FROM d1 WHERE d1.loser IN (o.left_signal, o.right_signal))),
  d12 AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2),
  d3 AS (SELECT o.family, o.loser FROM ordp o WHERE k = 3 AND NOT EXISTS (SELECT 1 FROM d12 WHERE d12.loser IN (o.left_signal, o.right_signal)))
  SELECT family, signal, sign, selected AND signal NOT IN (SELECT loser FROM d12 UNION ALL SELECT loser FROM d3) AS selected FROM dt""")
def _(spark, sf):
    t, c = table_and_pairs(spark, sf)
    return W.dedupe_signals(t, c, 0.2).select("family", "signal", "sign", "selected")


# ---- one study: composite, labels, flags and regime on the rebalance dates ----

PRESET = {"fundamentals": 0.25, "momentum": 0.4, "flows": 0.25, "factor_improvement": 0.1}
_BIG = ELIG_SQL.replace("volume * 60", "volume * 400").replace("mcap * 40 ", "mcap * 4000 ")
STUDY_SQL = DEC_SQL + REGIME_SQL + _BIG + BTC_RET + f""", lab AS (SELECT entity, date, {', '.join(f'lead(price, {h + 1}) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_{h}, lead(price, 1) OVER e AS entry_{h}, lead(price, {h + 1}) OVER e AS exit_{h}' for h in (7, 14, 30))}
    FROM panel WINDOW e AS (PARTITION BY entity ORDER BY date)),
  study AS (SELECT w.entity, w.date, {renorm_sql(PRESET)} AS score, ret_14 * 0.02::DOUBLE AS ret, entry_14 AS entry, exit_14 AS leave, eligible_base AS eligible, shortable AND w.entity <> 'Brand#4' AS shortable, regime
    FROM wide4 w JOIN lab USING (entity, date) JOIN elig USING (entity, date) JOIN reg USING (date))"""
TEST14 = every_sql(period_sql("Test", 14), 14)


STUDY_KEEP = ("ret", "entry", "leave", "eligible", "shortable", "regime")


def study(spark, sf, dates=None):
    """Scores, labels, flags and regime per entity and day, carried through one pass over the panel.

    The demo prices are noise, so returns are scaled to keep compounding in range.
    """
    daily, limits = T.brand_daily(spark, sf), T.bounds(spark, sf)
    bench = saved(T.market_close(daily, limits), "benchmark")
    m = T.brand_master(spark, sf)
    m = m.withColumn("excluded", C.is_excluded("ticker", ["ticker", "name", "category"]))
    p = T.with_benchmark(T.brand_panel(spark, sf), bench)
    lab = W.label_returns(p, keep_legs=True, horizons=(14,)).withColumnsRenamed({"entry_14": "entry", "exit_14": "leave"}).withColumn("ret", F.col("ret_14") * 0.02)
    # thresholds are met at the demo's scale by larger units
    own = {c: F.col(c) for c in ("mcap", "volume")}
    flags = C.eligibility(lab.withColumns({"mcap": own["mcap"] * 4000, "volume": own["volume"] * 400}), m).withColumns({
        "mcap": F.col("mcap") / 4000, "volume": F.col("volume") / 400}).withColumnRenamed("eligible_base", "eligible")
    named = B.block_shorts(flags, m.select(ENTITY, F.col("ticker").alias("token")), ("T4",))
    rows = named.join(F.broadcast(G.weekly_regime(bench, bench).select(DATE, "regime")), DATE, "left")
    out = decided_frame(rows, names(spark, sf), STUDY_KEEP).withColumn("score", C.renormalised(PRESET))
    if dates is not None:
        out = out.join(F.broadcast(dates), DATE, "left_semi")
    return out.select(ENTITY, DATE, "score", *STUDY_KEEP)


def test_dates(spark, sf):
    return W.rebalance_dates(days(spark, sf), "Test", 14, P)


@query("W10_top_bottom_spread", STUDY_SQL + f""", k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity) AS t, row_number() OVER (PARTITION BY date ORDER BY score, entity) AS b,
    count(*) OVER (PARTITION BY date) AS n FROM study WHERE eligible AND score IS NOT NULL AND date IN ({TEST14})),
  g AS (SELECT date, avg(ret) FILTER (t <= 5) - avg(ret) FILTER (b <= 5) AS s FROM k WHERE n >= 10 GROUP BY 1 HAVING count(ret) FILTER (t <= 5) >= 5 AND count(ret) FILTER (b <= 5) >= 5)
  SELECT round(avg(s), 6) AS spread, count(*) AS n_dates FROM g""")
def _(spark, sf):
    rows = study(spark, sf, test_dates(spark, sf)).where("eligible")
    return W.top_bottom_spread(rows, "score", "ret").select(r6("spread").alias("spread"), "n_dates")


@query("W11_regime_split_ic", DEC_SQL + REGIME_SQL + """, lab AS (SELECT entity, date, lead(price, 8) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_7, lead(price, 15) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_14,
    lead(price, 31) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_30 FROM panel WINDOW e AS (PARTITION BY entity ORDER BY date)),
  fl AS (UNPIVOT (SELECT entity, date, fundamentals, momentum, flows, factor_improvement FROM wide4) ON fundamentals, momentum, flows, factor_improvement INTO NAME family VALUE z),
  q AS (""" + " UNION ALL ".join(f"SELECT family, {h} AS horizon, date, ic FROM (" + ic_sql(f"(SELECT fl.*, ret_{h} AS r FROM fl JOIN lab USING (entity, date) WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31')", "z", "r", "family, date") + ")" for h in (7, 14, 30)) + """)
  SELECT family, regime, horizon, round(avg(ic), 6) AS mean_ic, count(ic) AS n_periods FROM q JOIN reg USING (date) WHERE regime IS NOT NULL GROUP BY 1, 2, 3""")
def _(spark, sf):
    s = decided_frame(W.label_returns(T.brand_panel(spark, sf, True)), names(spark, sf), RETS)
    train = days(spark, sf).where(F.col(DATE).between(F.lit(P.train_start), F.lit(P.train_end)))
    ics = W.signal_ics(s, {f: (f, f) for f in FAMILIES}, {h: train for h in (7, 14, 30)}, names(spark, sf))
    r = regime(spark, sf).where("regime IS NOT NULL").select(DATE, "regime")
    return ics.join(F.broadcast(r), DATE).groupBy("family", "regime", "horizon").agg(r6(F.avg("ic")).alias("mean_ic"), F.count("ic").alias("n_periods"))


@query("W12_coverage_audit", BRAND + " " + " UNION ALL ".join(
    f"SELECT entity, '{m}' AS metric, min(date) FILTER ({m} IS NOT NULL) AS first_date, max(date) FILTER ({m} IS NOT NULL) AS last_date, count({m}) AS n_obs FROM daily GROUP BY 1" for m in ("price", "issuance", "dex_volume", "deposits")))
def _(spark, sf):
    return W.coverage_audit(T.brand_daily(spark, sf), ["price", "issuance", "dex_volume", "deposits"])


@query("W13_leakage_checks", """SELECT unnest(['label_7d', 'label_14d', 'label_30d', 'lag1_revenue', 'label_end_7d', 'label_end_14d', 'label_end_30d']) AS "check", 0 * count(*) AS n_bad, TRUE AS passed FROM lineitem""")
def _(spark, sf):
    p = T.brand_panel(spark, sf).select(ENTITY, DATE, "price", "revenue")
    return W.leakage_checks(W.label_returns(p).withColumn("lag1_revenue", lag("revenue", 1)), P)


# ---- portfolios ----

def positions_sql(variant: str, dates: str = TEST14) -> str:
    """CTE list giving `pos` (entity, date, weight, ret, regime) for one variant."""
    base = f""", elg AS (SELECT * FROM study WHERE eligible AND score IS NOT NULL AND ret IS NOT NULL AND date IN ({dates})),
      lg AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, entity) AS p FROM elg),
      sh AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score, entity) AS p FROM elg WHERE shortable),
      l5 AS (SELECT * FROM lg WHERE p <= 5), s5 AS (SELECT * FROM sh WHERE p <= 5),
      s5x AS (SELECT s5.* FROM s5 WHERE NOT EXISTS (SELECT 1 FROM l5 WHERE l5.date = s5.date AND l5.entity = s5.entity))"""
    ls = """SELECT entity, date, w * 0.1::DOUBLE AS weight, ret, regime, entry, leave FROM (SELECT *, 1 AS w FROM l5 UNION ALL SELECT *, -1 FROM s5x)
      WHERE date IN (SELECT date FROM l5 GROUP BY 1 HAVING count(*) = 5) AND date IN (SELECT date FROM s5x GROUP BY 1 HAVING count(*) = 5)"""
    lo = "SELECT entity, date, 0.2::DOUBLE AS weight, ret, regime, entry, leave FROM l5 WHERE date IN (SELECT date FROM l5 GROUP BY 1 HAVING count(*) = 5)"
    so = "SELECT entity, date, -0.2::DOUBLE AS weight, ret, regime, entry, leave FROM s5 WHERE date IN (SELECT date FROM s5 GROUP BY 1 HAVING count(*) = 5)"
    sw = f"SELECT * FROM ({lo}) WHERE regime = 'Bullish' UNION ALL SELECT * FROM ({so}) WHERE regime IS DISTINCT FROM 'Bullish'"
    return base + ", pos AS (" + {"always_l_s": ls, "long_only": lo, "short_only": so, "regime_switch": sw}[variant] + ")"


def _with_variants(rows, variants):
    return rows.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants])))


FLAT = ("always_l_s", "long_only", "short_only", "regime_switch")


def study_candidates(spark, sf, dates=None, n=5):
    """Ranked candidates of the study: a few rows per rebalance date, written once for all that follows."""
    rows = study(spark, sf, test_dates(spark, sf) if dates is None else dates).withColumn("model", F.lit("heuristic"))
    return saved(B.candidates(rows, ["model"], n, max_names=names(spark, sf)), "candidates")


def flat_study(spark, sf, variants=FLAT, dates=None, n=5):
    cands = _with_variants(study_candidates(spark, sf, dates, n), variants)
    return B.flat_positions(cands, ["model", "variant"], F.col("variant"), n)


def _pos_query(variant):
    def run(spark, sf):
        pos = flat_study(spark, sf, (variant,))
        return pos.select(ENTITY, DATE, "weight", r6("ret").alias("ret"), "regime")

    return run


for _v in FLAT:
    query(f"B01_positions_{_v}", STUDY_SQL + positions_sql(_v) + " SELECT entity, date, weight, round(ret, 6) + 0.0::DOUBLE AS ret, regime FROM pos")(_pos_query(_v))


# One date after the other: held shorts still in the buffer, then the weakest names.
_STICKY = STUDY_SQL.replace("WITH daily AS", "WITH RECURSIVE daily AS", 1) + f""", elg AS (SELECT * FROM study WHERE eligible AND score IS NOT NULL AND ret IS NOT NULL AND date IN ({TEST14})),
  lo AS (SELECT date, list(entity ORDER BY score DESC, entity)[1:5] AS longs FROM elg GROUP BY 1), po AS (SELECT date, list(entity ORDER BY score, entity) AS pool FROM elg WHERE shortable GROUP BY 1),
  sd AS (SELECT row_number() OVER (ORDER BY date) AS i, date, longs, coalesce(pool, []) AS pool FROM lo LEFT JOIN po USING (date)),
  rec AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS held, NULL::VARCHAR[] AS s UNION ALL
    SELECT i, CASE WHEN len(s) = 5 AND len(longs) = 5 THEN s ELSE held END, CASE WHEN len(s) = 5 AND len(longs) = 5 THEN s END FROM (SELECT i, held, longs, list_concat(k, [x for x in pool if NOT list_contains(k, x) AND NOT list_contains(longs, x)])[1:5] AS s
      FROM (SELECT sd.*, held, [x for x in held if list_contains(pool[1:10], x) AND NOT list_contains(longs, x)][1:5] AS k FROM rec JOIN sd ON sd.i = rec.i + 1))),
  bk AS (SELECT date, longs, s FROM rec JOIN sd USING (i) WHERE s IS NOT NULL),
  bw AS (SELECT date, unnest(longs) AS entity, 0.1::DOUBLE AS weight FROM bk UNION ALL SELECT date, unnest(s), -0.1::DOUBLE FROM bk)
  SELECT entity, date, weight, round(ret, 6) + 0.0::DOUBLE AS ret FROM bw JOIN elg USING (entity, date)"""


@query("B02_sticky_shorts", _STICKY)
def _(spark, sf):
    out = B.sticky_positions(study_candidates(spark, sf), ["model"])
    return out.select(ENTITY, DATE, "weight", r6("ret").alias("ret"))


@query("B03_overlap_removal", STUDY_SQL + positions_sql("always_l_s") + """ SELECT date, count(*) FILTER (NOT EXISTS (SELECT 1 FROM l5 WHERE l5.date = s5.date AND l5.entity = s5.entity)) AS n_short,
  count(*) FILTER (EXISTS (SELECT 1 FROM l5 WHERE l5.date = s5.date AND l5.entity = s5.entity)) AS n_overlap FROM s5 GROUP BY 1""")
def _(spark, sf):
    five = study_candidates(spark, sf).where("pos <= 5")
    longs = five.where("side = 1").select(DATE, ENTITY, F.lit(True).alias("held"))
    s = five.where("side = -1").join(longs, [DATE, ENTITY], "left")
    return s.groupBy(DATE).agg(F.count_if(F.col("held").isNull()).alias("n_short"), F.count("held").alias("n_overlap"))


@query("B04_never_short", STUDY_SQL + f" SELECT date, count(*) FILTER (shortable) AS n_shortable, count(*) FILTER (shortable AND entity = 'Brand#4') AS n_blocked FROM study WHERE date IN ({TEST14}) GROUP BY 1")
def _(spark, sf):
    rows = study(spark, sf, test_dates(spark, sf))
    return rows.groupBy(DATE).agg(F.count_if("shortable").alias("n_shortable"), F.count_if(F.col("shortable") & (F.col(ENTITY) == "Brand#4")).alias("n_blocked"))


RET_SQL = """, td AS (SELECT date, lead(date) OVER (ORDER BY date) AS nx FROM (SELECT DISTINCT date FROM pos)),
  tn AS (SELECT date, sum(abs(d)) AS turnover FROM (SELECT date, entity, sum(w) AS d FROM (SELECT date, entity, weight AS w FROM pos UNION ALL SELECT nx, entity, -weight FROM pos JOIN td USING (date) WHERE nx IS NOT NULL) GROUP BY 1, 2) GROUP BY 1),
  rets AS (SELECT date, gross_return, n_positions, regime, turnover, turnover * 0.005::DOUBLE AS cost, gross_return - turnover * 0.005::DOUBLE AS net_return
    FROM (SELECT date, sum(weight * ret) AS gross_return, count(*) AS n_positions, any_value(regime) AS regime FROM pos GROUP BY 1) JOIN tn USING (date))"""
_R = ("gross_return", "net_return", "turnover", "cost")


def _bt_query(variant):
    def run(spark, sf):
        pos = flat_study(spark, sf, (variant,))
        out = B.backtest(pos, ["model", "variant"])
        return out.select(DATE, *[r6(c).alias(c) for c in _R], "n_positions", "regime")

    return run


for _v in FLAT:
    query(f"B05_backtest_{_v}", STUDY_SQL + positions_sql(_v) + RET_SQL + " SELECT date, " + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in _R) + ", n_positions, regime FROM rets")(_bt_query(_v))


@query("B06_constituents", STUDY_SQL + positions_sql("long_only") + RET_SQL + """, g AS (SELECT date, sum(abs(weight)) AS g FROM pos GROUP BY 1)
  SELECT entity, date, CASE WHEN weight > 0 THEN 'Long' ELSE 'Short' END AS side, weight, round(entry, 6) AS entry_price, round(leave, 6) AS exit_price, round(ret, 6) + 0.0::DOUBLE AS asset_return,
    round(cost * abs(weight) / g, 6) AS cost_allocated, round(weight * ret - cost * abs(weight) / g, 6) + 0.0::DOUBLE AS return_contribution FROM pos JOIN rets USING (date) JOIN g USING (date)""")
def _(spark, sf):
    keys = ["model", "variant"]
    legs = W.label_returns(T.brand_panel(spark, sf), keep_legs=True, horizons=(14,)).select(
        ENTITY, DATE, F.col("entry_14").alias("entry"), F.col("exit_14").alias("leave"))
    pos = flat_study(spark, sf, ("long_only",))
    c = B.constituents(pos, B.backtest(pos, keys), keys).join(legs, [ENTITY, DATE])
    return c.select(ENTITY, DATE, "side", "weight", r6("entry").alias("entry_price"), r6("leave").alias("exit_price"), r6("ret").alias("asset_return"),
                    r6("cost_allocated").alias("cost_allocated"), r6("return_contribution").alias("return_contribution"))


@query("B07_nav", STUDY_SQL + positions_sql("long_only") + RET_SQL + " SELECT date, round(product(1 + net_return) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS nav FROM rets")
def _(spark, sf):
    keys = ["model", "variant"]
    pos = flat_study(spark, sf, ("long_only",))
    return B.nav(B.backtest(pos, keys), keys).select(DATE, r6("nav").alias("nav"))


@query("B08_max_drawdown", STUDY_SQL + positions_sql("long_only") + RET_SQL + """, nv AS (SELECT date, product(1 + net_return) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nav FROM rets),
  dd AS (SELECT nav / max(nav) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS d FROM nv) SELECT round(min(d), 6) + 0.0::DOUBLE AS max_drawdown, count(*) AS n FROM dd""")
def _(spark, sf):
    keys = ["model", "variant"]
    pos = flat_study(spark, sf, ("long_only",))
    out = B.drawdowns(B.nav(B.backtest(pos, keys), keys), keys)
    return out.agg(r6(F.min("drawdown")).alias("max_drawdown"), F.count("*").alias("n"))


METRIC_SQL = """, j AS (SELECT rets.*, btc_ret_14 AS b, product(1 + net_return) OVER w AS nav FROM rets LEFT JOIN bret USING (date) WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  j2 AS (SELECT *, nav / max(nav) OVER w - 1 AS dd FROM j WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  jb AS (SELECT date, net_return AS r, b, product(1 + b) OVER w AS bn FROM j WHERE b IS NOT NULL WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  jc AS (SELECT *, bn / max(bn) OVER w - 1 AS bd FROM jb WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  a AS (SELECT count(*) AS n_rebalances, (max(date) - min(date) + 14) / 365.0::DOUBLE AS y, arg_max(nav, date) - 1 AS total_return, avg(net_return) AS m, stddev_samp(net_return) AS s,
    stddev_samp(net_return) FILTER (net_return < 0) AS ds, min(dd) AS max_drawdown, avg((net_return > 0)::INT::DOUBLE) AS hit_rate, avg(turnover) AS avg_turnover, sum(cost) AS total_cost FROM j2),
  c AS (SELECT arg_max(bn, date) - 1 AS btc_total_return, avg(r - b) AS xm, stddev_samp(r - b) AS xs, covar_samp(r, b) / var_pop(b) AS beta, corr(r, b) AS correlation, min(bd) AS bdd,
    avg(r) FILTER (b > 0) / avg(b) FILTER (b > 0) AS up_capture, avg(r) FILTER (b < 0) / avg(b) FILTER (b < 0) AS down_capture FROM jc),
  mt AS (SELECT n_rebalances, total_return, pow(1 + total_return, 1 / y) - 1 AS annualized_return, s * sqrt(365.0::DOUBLE / 14) AS annualized_vol, m / s * sqrt(365.0::DOUBLE / 14) AS sharpe,
    m / ds * sqrt(365.0::DOUBLE / 14) AS sortino, max_drawdown, CASE WHEN max_drawdown < 0 THEN (pow(1 + total_return, 1 / y) - 1) / abs(max_drawdown) END AS calmar, hit_rate, avg_turnover, total_cost, btc_total_return,
    total_return - btc_total_return AS excess_return, beta, pow(1 + total_return, 1 / y) - 1 - beta * (pow(1 + btc_total_return, 1 / y) - 1) AS alpha, xm / xs * sqrt(365.0::DOUBLE / 14) AS information_ratio, correlation,
    up_capture, down_capture, max_drawdown - bdd AS drawdown_vs_btc FROM a, c)"""


def metrics_of(spark, sf, variants):
    keys = ["model", "variant"]
    pos = flat_study(spark, sf, variants)
    br = W.benchmark_returns(benchmark(spark, sf)).select(DATE, F.col("btc_ret_14").alias("btc_return"))
    return B.performance(B.backtest(pos, keys).join(F.broadcast(br), DATE, "left"), keys, 14)


@query("B09_performance_metrics", STUDY_SQL + positions_sql("long_only") + RET_SQL + METRIC_SQL + " SELECT n_rebalances, " + ", ".join(f"round({m}, 5) + 0.0::DOUBLE AS {m}" for m in B.METRICS) + " FROM mt")
def _(spark, sf):
    return metrics_of(spark, sf, ("long_only",)).select("n_rebalances", *[r6(m, 5).alias(m) for m in B.METRICS])


@query("B10_beta_decomposition", STUDY_SQL + positions_sql("short_only") + RET_SQL + METRIC_SQL + " SELECT round(beta * btc_total_return, 6) + 0.0::DOUBLE AS beta_attributed_return, round(total_return - beta * btc_total_return, 6) + 0.0::DOUBLE AS dispersion_alpha FROM mt")
def _(spark, sf):
    return B.beta_decomposition(metrics_of(spark, sf, ("short_only",))).select(r6("beta_attributed_return").alias("beta_attributed_return"), r6("dispersion_alpha").alias("dispersion_alpha"))


@query("B11_candidate_evaluation")
def _(spark, sf):
    """Every period, horizon and variant of one model in one job."""
    out = evaluate(spark, sf)
    return out.select("model", "variant", "horizon", "period", "eligible_universe", "n_rebalances", *[r6(m).alias(m) for m in B.METRICS])


def evaluate(spark, sf):
    daily, limits = T.brand_daily(spark, sf), T.bounds(spark, sf)
    bench = saved(T.market_close(daily, limits), "benchmark")
    m = T.brand_master(spark, sf)
    m = m.withColumn("excluded", C.is_excluded("ticker", ["ticker", "name", "category"]))
    lab = W.label_returns(T.with_benchmark(T.brand_panel(spark, sf), bench))
    flags = C.eligibility(lab.withColumns({"mcap": F.col("mcap") * 4000, "volume": F.col("volume") * 400}), m).withColumns({
        "mcap": F.col("mcap") / 4000, "volume": F.col("volume") / 400})
    rows = flags.join(F.broadcast(G.weekly_regime(bench, bench).select(DATE, "regime")), DATE, "left")
    scores = decided_frame(rows, names(spark, sf), (*RETS, "eligible_base", "eligible_sensitivity", "shortable", "regime")).withColumn("score", C.renormalised(PRESET))
    plan = None
    for period in ("Train", "Validation", "Test"):
        for h in (7, 14, 30):
            d = W.rebalance_dates(days(spark, sf), period, h, P).select(DATE, F.lit(h).alias("horizon"), F.lit(period).alias("period"))
            plan = d if plan is None else plan.unionByName(d)
    near = scores.join(F.broadcast(plan), DATE)
    ret = F.when(F.col("horizon") == 7, F.col("ret_7")).when(F.col("horizon") == 14, F.col("ret_14")).otherwise(F.col("ret_30"))
    near = near.withColumn("ret", ret * 0.02).withColumn("_u", F.explode(F.array(*[F.struct(F.lit(u).alias("name"), F.col(u).alias("ok")) for u in ("eligible_base", "eligible_sensitivity")])))
    near = near.withColumns({"eligible_universe": F.col("_u.name"), "eligible": F.col("_u.ok"), "model": F.lit("heuristic")})
    keys = ["model", "horizon", "period", "eligible_universe"]
    cands = saved(B.candidates(near, keys, max_names=names(spark, sf)), "candidates")
    flat = B.flat_positions(_with_variants(cands, FLAT), [*keys, "variant"], F.col("variant"))
    sticky = B.sticky_positions(cands, keys).withColumn("variant", F.lit("sticky_l_s"))
    pos = saved(flat.unionByName(sticky), "positions")
    br = W.benchmark_returns(bench).unpivot([DATE], ["btc_ret_7", "btc_ret_14", "btc_ret_30"], "_h", "btc_return").withColumn("horizon", F.replace("_h", F.lit("btc_ret_"), F.lit("")).cast("int"))
    rets = B.backtest(pos, [*keys, "variant"]).join(F.broadcast(br.drop("_h")), [DATE, "horizon"], "left")
    return B.performance(rets, [*keys, "variant"], F.col("horizon"))
