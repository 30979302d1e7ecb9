"""Composites, universes (C) and the exposure overlay (G) over the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daygrid.catalog.base import BRAND, MASTER, query, r6
from daygrid.catalog.cross_section import names, rank_z_sql
from daygrid.catalog.signals import SIGNAL_BASE, EXPR
from daygrid.functions.rolling import DATE, ENTITY
from daygrid.operators import cross_section as X
from daygrid.operators import exposure as G
from daygrid.operators import score as C
from daygrid.plans import scoring as R
from daygrid.plans import signals as S
from daygrid.sources import tables as T
from daygrid.sources.store import saved

DEMO = ("revenue_growth", "rev_per_address", "dau_growth", "vol_adj_momentum", "short_term_reversal", "realised_vol", "dex_volume_growth", "oi_change")
_FAM = {s: f for f, s, _ in S.SIGNALS}

Z_SQL = SIGNAL_BASE + ", dsig AS (SELECT entity, date, " + ", ".join(f"{EXPR[s][2]} AS {s}" for s in DEMO) + " FROM s2), lsig AS (" + " UNION ALL ".join(
    f"SELECT entity, date, '{_FAM[s]}' AS family, '{s}' AS signal, {i} AS seq, {s} AS raw FROM dsig WHERE {s} IS NOT NULL" for i, s in enumerate(DEMO)
) + f"""), zall AS (SELECT entity, date, family, signal, seq, {rank_z_sql('raw', 'date, signal')} AS z FROM lsig), zz AS (SELECT * FROM zall WHERE z IS NOT NULL)"""
FAM_SQL = Z_SQL + """, fam AS (SELECT entity, date, family, round(avg(z), 10) AS score FROM zz GROUP BY 1, 2, 3)"""
WIDE_SQL = FAM_SQL + """, wide AS (SELECT entity, date, max(score) FILTER (family = 'fundamentals') AS fundamentals, max(score) FILTER (family = 'momentum') AS momentum,
    max(score) FILTER (family = 'flows') AS flows FROM fam GROUP BY 1, 2)"""


def renorm_sql(ws: dict[str, float]) -> str:
    used = {f: w for f, w in ws.items() if w > 0}
    num = " + ".join(f"coalesce({f}, 0) * {w!r}::DOUBLE" for f, w in used.items())
    den = " + ".join(f"CASE WHEN {f} IS NULL THEN 0 ELSE {w!r}::DOUBLE END" for f, w in used.items())
    return f"round(({num}) / nullif({den}, 0), 10)"


EQUAL3 = {"fundamentals": 1.0, "momentum": 1.0, "flows": 1.0}
COMP_SQL = WIDE_SQL + f", comp AS (SELECT *, {renorm_sql({'fundamentals': 0.55, 'momentum': 0.175, 'flows': 0.125})} AS composite FROM wide)"
REGIME_SQL = """, wk AS (SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS week_end, arg_max(btc, date) AS c FROM btc WHERE btc IS NOT NULL GROUP BY 1),
  wm AS (SELECT week_end, c, CASE WHEN count(c) OVER w >= 20 THEN avg(c) OVER w END AS ma FROM wk WINDOW w AS (ORDER BY week_end ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  reg AS (SELECT d.date, c AS btc_weekly_close, ma AS btc_20w_ma, CASE WHEN ma IS NOT NULL THEN CASE WHEN c > ma THEN 'Bullish' ELSE 'Bearish' END END AS regime
    FROM days d ASOF LEFT JOIN wm ON d.date >= wm.week_end)"""


def z_long(spark, sf):
    n = names(spark, sf)
    p = T.brand_panel(spark, sf, True)
    return S.z_signals(S.long_signals(S.signal_frame(p, list(DEMO), n), list(DEMO)), n)


def z_wide(panel, n, keep=()):
    """z_<signal> beside the kept columns, all from one pass over the panel."""
    frame = R.z_frame(S.signal_frame(panel, list(DEMO), n, tuple(keep)), list(DEMO), n)
    return frame.withColumnsRenamed({f"_k_{k}": k for k in keep})


def plain_families():
    out = {}
    for s in DEMO:
        out.setdefault(_FAM[s], []).append((s, 1))
    return out


def wide_scores(spark, sf):
    n = names(spark, sf)
    frame = R.family_means(z_wide(T.brand_panel(spark, sf, True), n), plain_families())
    have = F.coalesce("fundamentals", "momentum", "flows").isNotNull()
    return frame.select(ENTITY, DATE, "fundamentals", "momentum", "flows").where(have)


WEIGHTS = {"fundamentals": 0.55, "momentum": 0.175, "flows": 0.125}


def composite(spark, sf):
    return wide_scores(spark, sf).withColumn("composite", C.renormalised(WEIGHTS))


def benchmark(spark, sf):
    return T.market_close(T.brand_daily(spark, sf), T.bounds(spark, sf))


def regime(spark, sf):
    b = benchmark(spark, sf)
    return G.weekly_regime(b, b)


@query("C01_family_score", FAM_SQL + " SELECT entity, date, family, score FROM fam")
def _(spark, sf):
    return C.family_scores(z_long(spark, sf))


@query("C02_composite_fixed", WIDE_SQL + """, av AS (SELECT CASE WHEN count(fundamentals) > 0 THEN 0.55::DOUBLE ELSE 0 END + CASE WHEN count(momentum) > 0 THEN 0.175::DOUBLE ELSE 0 END
    + CASE WHEN count(flows) > 0 THEN 0.125::DOUBLE ELSE 0 END AS t FROM wide)
  SELECT entity, date, CASE WHEN (fundamentals IS NOT NULL)::INT + (momentum IS NOT NULL)::INT + (flows IS NOT NULL)::INT >= 2 THEN
    round((coalesce(fundamentals, 0) * 0.55::DOUBLE + coalesce(momentum, 0) * 0.175::DOUBLE + coalesce(flows, 0) * 0.125::DOUBLE) / t, 10) END AS composite FROM wide, av""")
def _(spark, sf):
    return C.composite_fixed(wide_scores(spark, sf)).select(ENTITY, DATE, "composite")


@query("C03_composite_renormalised", COMP_SQL + " SELECT entity, date, composite FROM comp")
def _(spark, sf):
    return composite(spark, sf).select(ENTITY, DATE, "composite")


_BULL, _BEAR = {"fundamentals": 0.2, "momentum": 0.6, "flows": 0.2}, {"fundamentals": 0.6, "momentum": 0.0, "flows": 0.4}


@query("C04_regime_composite", WIDE_SQL + REGIME_SQL + f""", rd AS (SELECT date, last_value(regime IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS regime
    FROM (SELECT DISTINCT date FROM wide) LEFT JOIN reg USING (date))
  SELECT entity, date, CASE WHEN regime = 'Bearish' THEN {renorm_sql(_BEAR)} ELSE {renorm_sql(_BULL)} END AS composite FROM wide JOIN rd USING (date)""")
def _(spark, sf):
    out = C.regime_composite(wide_scores(spark, sf), _BULL, _BEAR, regime(spark, sf))
    return out.select(ENTITY, DATE, "composite")


IMPROVE_SQL = f""", imb AS (SELECT entity, date, {renorm_sql(EQUAL3)} AS b FROM wide),
  imd AS (SELECT x.entity, x.date, round(x.b - y.b, 10) AS d FROM imb x LEFT JOIN imb y ON x.entity = y.entity AND x.date = y.date + 28)"""


@query("C05_factor_improvement", WIDE_SQL + IMPROVE_SQL + f" SELECT entity, date, round({rank_z_sql('d', 'date')}, 6) AS factor_improvement FROM imd")
def _(spark, sf):
    return C.factor_improvement(wide_scores(spark, sf), names(spark, sf)).select(ENTITY, DATE, r6("factor_improvement").alias("factor_improvement"))


DECISIONS = [("fundamentals", "revenue_growth", 1, True), ("fundamentals", "rev_per_address", -1, True), ("fundamentals", "dau_growth", 1, False),
             ("momentum", "vol_adj_momentum", -1, True), ("momentum", "short_term_reversal", 1, True), ("momentum", "realised_vol", 1, False),
             ("flows", "dex_volume_growth", 1, True), ("flows", "oi_change", -1, True)]
DEC_SQL = Z_SQL + ", dec AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {g})" for _, s, g, on in DECISIONS if on) + """) t(signal, sign)),
  favg AS (SELECT entity, date, family, round(avg(z * sign), 10) AS a FROM zz JOIN dec USING (signal) GROUP BY 1, 2, 3),
  fz AS (SELECT entity, date, family, """ + rank_z_sql("a", "date, family") + """ AS score FROM favg),
  wide AS (SELECT entity, date, max(score) FILTER (family = 'fundamentals') AS fundamentals, max(score) FILTER (family = 'momentum') AS momentum,
    max(score) FILTER (family = 'flows') AS flows FROM fz WHERE score IS NOT NULL GROUP BY 1, 2)""" + IMPROVE_SQL + f""",
  wide4 AS (SELECT wide.*, {rank_z_sql('d', 'imd.date')} AS factor_improvement FROM wide JOIN imd ON wide.entity = imd.entity AND wide.date = imd.date)""".replace("rank() OVER (PARTITION BY imd.date", "rank() OVER (PARTITION BY imd.date")


def decided_frame(panel, n, keep=()):
    rows = R.decided(z_wide(panel, n, keep), [(f, s, g) for f, s, g, on in DECISIONS if on], n)
    return rows.where(F.coalesce("fundamentals", "momentum", "flows").isNotNull())


def decided_scores(spark, sf):
    return decided_frame(T.brand_panel(spark, sf, True), names(spark, sf))


@query("C06_apply_decisions_long", DEC_SQL + " SELECT entity, date, round(fundamentals, 6) AS fundamentals, round(momentum, 6) AS momentum, round(flows, 6) AS flows, round(factor_improvement, 6) AS factor_improvement FROM wide4")
def _(spark, sf):
    dec = spark.createDataFrame(DECISIONS, "family string, signal string, sign int, selected boolean")
    out = C.apply_decisions(z_long(spark, sf), dec, names(spark, sf))
    return out.select(ENTITY, DATE, *[r6(f).alias(f) for f in ("fundamentals", "momentum", "flows", "factor_improvement")])


@query("C06_decided_family_scores", DEC_SQL + " SELECT entity, date, round(fundamentals, 6) AS fundamentals, round(momentum, 6) AS momentum, round(flows, 6) AS flows, round(factor_improvement, 6) AS factor_improvement FROM wide4")
def _(spark, sf):
    return decided_scores(spark, sf).select(ENTITY, DATE, *[r6(f).alias(f) for f in ("fundamentals", "momentum", "flows", "factor_improvement")])


@query("C07_score_change_and_lag", BRAND + f""", z AS (SELECT entity, date, {rank_z_sql('revenue', 'date')} AS a, {rank_z_sql('addresses', 'date')} AS b FROM panel)
  SELECT entity, date, round(a - lag(a, 28) OVER w, 6) AS a_4w_change, round(lag(a, 30) OVER w, 6) AS a_lag_30d, round(lag(b, 30) OVER w, 6) AS b_lag_30d FROM z
  WINDOW w AS (PARTITION BY entity ORDER BY date)""")
def _(spark, sf):
    n = names(spark, sf)
    p = T.brand_panel(spark, sf).select(ENTITY, DATE, "revenue", "addresses")
    z = X.rank_z(X.rank_z(p, "revenue", [DATE], "a", n), "addresses", [DATE], "b", n)
    return C.change_and_lag(z, "a", ["b"]).select(ENTITY, DATE, *[r6(c).alias(c) for c in ("a_4w_change", "a_lag_30d", "b_lag_30d")])


_RANKED = COMP_SQL + """ SELECT entity, date, composite, row_number() OVER (PARTITION BY date ORDER BY composite DESC, entity) AS rank,
  row_number() OVER (PARTITION BY date ORDER BY composite DESC, entity) <= 8 AS selected FROM comp WHERE composite IS NOT NULL AND entity <> 'Brand#3'"""


def _select(spark, sf, bound):
    ok = T.brands(spark, sf).where(F.col(ENTITY) != "Brand#3")
    rows = composite(spark, sf) if bound is not None else saved(composite(spark, sf), "composite")
    out = C.rank_and_select(rows, "composite", max_names=bound, eligible=ok)
    return out.select(ENTITY, DATE, "composite", "rank", "selected")


@query("C08_rank_and_select", _RANKED)
def _(spark, sf):
    return _select(spark, sf, names(spark, sf))


@query("C08_rank_and_select_split_groups", _RANKED)
def _(spark, sf):
    return _select(spark, sf, None)


# money of the demo panel scaled so that the thresholds bite
_SCALED = ", sp AS (SELECT entity, date, price, volume * 60 AS volume, mcap * 40 AS mcap FROM panel)"


def scaled(spark, sf):
    return T.brand_panel(spark, sf).select(ENTITY, DATE, "price", (F.col("volume") * 60).alias("volume"), (F.col("mcap") * 40).alias("mcap"))


@query("C09_universe_screen", BRAND + _SCALED + f""", a AS (SELECT DISTINCT last_day(date) AS d FROM days WHERE last_day(date) IN (SELECT date FROM days)),
  v AS (SELECT entity, date, avg(volume) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS v7 FROM sp WHERE volume IS NOT NULL),
  h AS (SELECT a.d AS date, sp.entity, arg_max(mcap, sp.date) FILTER (mcap IS NOT NULL) AS last_mcap, count(mcap) AS history_days,
    a.d - min(sp.date) FILTER (price IS NOT NULL) AS age_days, arg_max(v7, sp.date) FILTER (v7 IS NOT NULL) AS volume_7
    FROM a JOIN sp ON sp.date <= a.d LEFT JOIN v ON v.entity = sp.entity AND v.date = sp.date GROUP BY 1, 2)
  SELECT entity, date, round(last_mcap, 1) AS last_mcap, round(volume_7, 3) AS volume_7, history_days, age_days FROM h JOIN ({MASTER}) USING (entity)
  WHERE last_mcap >= 1e8 AND volume_7 >= 1e7 AND age_days >= 30 AND history_days >= 91 AND NOT regexp_matches(lower(category), 'stablecoin|wrapped|pegged')""")
def _(spark, sf):
    p = scaled(spark, sf)
    ends = T.bounds(spark, sf).select(F.explode(F.sequence("lo", "hi")).alias(DATE)).where(F.col(DATE) == F.last_day(DATE))
    out = C.universe_screen(p, ends, T.brand_master(spark, sf).select(ENTITY, "category"))
    return out.select(ENTITY, DATE, r6("last_mcap", 1).alias("last_mcap"), r6("volume_7", 3).alias("volume_7"), "history_days", F.col("age_days").cast("bigint").alias("age_days"))


@query("C10_rebalance_dates", """WITH d AS (SELECT CAST(unnest(generate_series(DATE '1997-01-10', DATE '1998-06-30', INTERVAL 1 DAY)) AS DATE) AS date),
  x AS (SELECT 'M' AS freq, date FROM d WHERE date = last_day(date) UNION ALL SELECT 'W', date FROM d WHERE isodow(date) = 5
    UNION ALL SELECT '10D', date FROM d WHERE (date - DATE '1997-01-10') % 10 = 0)
  SELECT freq, date, count(l_orderkey) AS n_lines FROM x LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) = date GROUP BY 1, 2""")
def _(spark, sf):
    lo, hi = dt.date(1997, 1, 10), dt.date(1998, 6, 30)
    cal = None
    for f in ("M", "W", "10D"):
        one = C.rebalance_calendar(spark, lo, hi, f).withColumn("freq", F.lit(f))
        cal = one if cal is None else cal.unionByName(one)
    n = T.lines(spark, sf).groupBy(DATE).agg(F.count("*").alias("n"))
    return cal.join(n, DATE, "left").select("freq", DATE, F.coalesce("n", F.lit(0)).alias("n_lines"))


ELIG_SQL = _SCALED + f""", mst AS (SELECT *, category = 'Stablecoins' AS excluded FROM ({MASTER})),
  e0 AS (SELECT sp.*, excluded, futures_symbol, CASE WHEN count(volume) OVER w >= 5 THEN avg(volume) OVER w END AS volume_7d,
      min(date) FILTER (price IS NOT NULL) OVER (PARTITION BY sp.entity) AS f FROM sp JOIN mst USING (entity)
      WINDOW w AS (PARTITION BY sp.entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
  e1 AS (SELECT *, greatest(date - f, 0) AS price_history_days, coalesce(mcap >= 1e8 AND volume_7d >= 1e6 AND date - f >= 90 AND price IS NOT NULL AND NOT excluded, FALSE) AS eligible_base FROM e0),
  elig AS (SELECT *, coalesce(eligible_base AND volume_7d >= 1e7, FALSE) AS eligible_sensitivity, futures_symbol IS NOT NULL AND price IS NOT NULL AS shortable FROM e1)"""


def eligible(spark, sf):
    m = T.brand_master(spark, sf)
    m = m.withColumn("excluded", C.is_excluded("ticker", ["ticker", "name", "category"]))
    return C.eligibility(scaled(spark, sf), m)


@query("C11_eligibility_panels", BRAND + ELIG_SQL + " SELECT entity, date, round(volume_7d, 3) AS volume_7d, price_history_days, eligible_base, eligible_sensitivity, shortable FROM elig")
def _(spark, sf):
    e = eligible(spark, sf)
    return e.select(ENTITY, DATE, r6("volume_7d", 3).alias("volume_7d"), F.col("price_history_days").cast("bigint").alias("price_history_days"), "eligible_base", "eligible_sensitivity", "shortable")


@query("C12_excluded_asset", """SELECT p_partkey, upper(coalesce(split_part(p_name, ' ', 1), '')) IN ('USDT', 'PAXG') OR regexp_matches(p_name || ' ' || p_type,
  '(?i)stable|wrapped|pegged|tokeni[sz]ed|treasury|t[- ]?bill|basket|commodity|gold|silver|synthetic usd|institutional digital liquidity') AS excluded FROM part""")
def _(spark, sf):
    p = T.table(spark, sf, "part").withColumn("tick", F.split("p_name", " ")[0])
    return p.select("p_partkey", C.is_excluded("tick", ["p_name", "p_type"]).alias("excluded"))


_ASSETS_SQL = """SELECT c_custkey AS entity, 'T' || (c_custkey % 400) AS token, CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey * 1000 + c_custkey % 7 END AS source_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'S' END AS spot_symbol, CASE WHEN c_custkey % 4 = 0 THEN 'F' END AS futures_symbol, c_mktsegment = 'BUILDING' AS excluded FROM customer"""
_MKT_SQL = "SELECT c_nationkey * 1000 + c_custkey % 7 AS source_id, max(c_acctbal) AS mcap, sum(round(c_acctbal)) AS volume FROM customer GROUP BY 1"


def _assets(spark, sf):
    c, k = T.table(spark, sf, "customer"), F.col("c_custkey")
    src = F.col("c_nationkey") * 1000 + k % 7
    assets = c.select(k.alias(ENTITY), F.concat(F.lit("T"), (k % 400).cast("string")).alias("token"), F.when(k % 13 != 0, src).alias("source_id"),
                      F.when(k % 3 == 0, "S").alias("spot_symbol"), F.when(k % 4 == 0, "F").alias("futures_symbol"), (F.col("c_mktsegment") == "BUILDING").alias("excluded"))
    markets = c.groupBy(src.alias("source_id")).agg(F.max("c_acctbal").alias("mcap"), F.sum(F.round("c_acctbal")).alias("volume"))
    return assets, markets


@query("C13_research_universe", f"""WITH b AS (SELECT a.*, mcap, volume, token IN ('T1', 'T2', 'T5') AS is_major, futures_symbol IS NOT NULL AS has_futures,
    spot_symbol IS NOT NULL OR futures_symbol IS NOT NULL AS has_venue, coalesce(mcap, 0) AS m, coalesce(volume, 0) AS v
    FROM ({_ASSETS_SQL}) a LEFT JOIN ({_MKT_SQL}) k USING (source_id) WHERE source_id IS NOT NULL AND NOT excluded),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY has_futures DESC, has_venue DESC, m DESC, v DESC, entity) AS rn FROM b) WHERE rn = 1),
  o AS (SELECT *, row_number() OVER (ORDER BY is_major DESC, has_futures DESC, has_venue DESC, m DESC, v DESC, token) AS pos FROM u),
  f AS (SELECT *, row_number() OVER (ORDER BY pos) AS fp FROM o WHERE has_futures),
  pool AS (SELECT entity FROM o WHERE is_major OR pos <= 140 UNION SELECT entity FROM f WHERE fp <= 140)
  SELECT entity, token, source_id, mcap, volume, is_major, has_futures FROM (SELECT *, row_number() OVER (ORDER BY is_major DESC, has_futures DESC, m DESC, v DESC, token) AS r
    FROM u WHERE entity IN (SELECT entity FROM pool)) WHERE r <= 140""")
def _(spark, sf):
    assets, markets = _assets(spark, sf)
    return C.research_universe(assets, markets, 140, ("T1", "T2", "T5"))


_CAND = """WITH r AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 50 = 0 THEN 'USDC' ELSE 'T' || (c_custkey % 600) END AS ticker, c_name AS name,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Dexs' WHEN 'MACHINERY' THEN 'Wrapped' WHEN 'AUTOMOBILE' THEN 'Lending' ELSE c_mktsegment END AS category,
    CASE WHEN c_custkey % 9 = 0 THEN 'chain' ELSE 'project' END AS asset_type, c_nationkey AS source_id,
    CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS mcap, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 2 END AS tvl, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal / 2 END AS volume FROM customer)"""


def _candidates(spark, sf):
    c, k, a = T.table(spark, sf, "customer"), F.col("c_custkey"), F.col("c_acctbal")
    seg = F.col("c_mktsegment")
    cat = F.when(seg == "BUILDING", "Dexs").when(seg == "MACHINERY", "Wrapped").when(seg == "AUTOMOBILE", "Lending").otherwise(seg)
    return c.select(k.alias(ENTITY), F.when(k % 50 == 0, "USDC").otherwise(F.concat(F.lit("T"), (k % 600).cast("string"))).alias("ticker"), F.col("c_name").alias("name"),
                    cat.alias("category"), F.when(k % 9 == 0, "chain").otherwise("project").alias("asset_type"), F.col("c_nationkey").alias("source_id"),
                    F.when(k % 6 != 0, a).alias("mcap"), F.when(k % 4 == 0, a * 2).alias("tvl"), F.when(k % 5 == 0, a / 2).alias("volume"))


_PRIO = """CASE WHEN asset_type <> 'chain' AND d AND (coalesce(tvl, 0) > 0 OR coalesce(volume, 0) > 0) THEN 0 WHEN asset_type = 'chain' THEN 1 WHEN d THEN 2 ELSE 3 END"""


@query("C14_screener_candidates", _CAND + f""", o AS (SELECT *, coalesce(mcap, 0) AS m, coalesce(tvl, 0) AS t, coalesce(volume, 0) AS v, lower(category) IN ('dexs', 'lending') AS d FROM r
    WHERE (coalesce(mcap, 0) >= 5000 OR coalesce(tvl, 0) >= 9000 OR coalesce(volume, 0) >= 4000 OR asset_type = 'chain') AND ticker <> 'USDC' AND category <> 'Wrapped'),
  k AS (SELECT *, rank() OVER (ORDER BY m DESC) AS mcap_rank FROM o),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_type, ticker, source_id ORDER BY m DESC, t DESC, v DESC, entity) AS rn FROM k) WHERE rn = 1),
  s AS (SELECT * FROM (SELECT *, {_PRIO} AS priority, row_number() OVER (PARTITION BY ticker ORDER BY {_PRIO}, m DESC, t DESC, v DESC, entity) AS r2 FROM u) WHERE r2 = 1),
  q AS (SELECT *, row_number() OVER (PARTITION BY asset_type = 'chain' ORDER BY m DESC, t DESC, v DESC, ticker) AS pos, count(*) OVER () AS total,
    count(*) FILTER (asset_type = 'chain') OVER () AS nc FROM s)
  SELECT entity, ticker, asset_type, mcap_rank, priority FROM q WHERE total <= 100 OR (asset_type = 'chain' AND pos <= 20) OR (asset_type <> 'chain' AND pos <= 100 - least(nc, 20))""")
def _(spark, sf):
    out = C.screener_candidates(_candidates(spark, sf), 100, 20, 5000, 9000, 4000)
    return out.select(ENTITY, "ticker", "asset_type", "mcap_rank", "priority")


@query("C15_directory_candidates", _CAND + """, x AS (SELECT *, rank() OVER (ORDER BY mcap DESC NULLS LAST) AS mr, entity % 11 = 0 AS kc FROM r WHERE entity % 7 <> 0 AND entity % 8 <> 0),
  o AS (SELECT * FROM x WHERE (coalesce(mcap, 0) >= 6000 OR (mcap IS NOT NULL AND mr <= 80) OR kc) AND ticker <> 'USDC' AND category <> 'Wrapped'),
  u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY kc DESC, coalesce(mcap, 0) DESC, entity) AS rn FROM o) WHERE rn = 1),
  q AS (SELECT *, row_number() OVER (PARTITION BY kc ORDER BY coalesce(mcap, 0) DESC, ticker) AS pos, count(*) FILTER (kc) OVER () AS nk FROM u)
  SELECT entity, ticker, kc AS known_chain, mcap FROM q WHERE kc OR pos <= greatest(80 - nk, 0)""")
def _(spark, sf):
    from daygrid.operators import ordered

    c = _candidates(spark, sf).withColumns({
        "asset_class": F.when(F.col(ENTITY) % 7 == 0, "Equity").otherwise("Token"), "is_preview": F.when(F.col(ENTITY) % 8 == 0, True), "_all": F.lit(1)})
    kept = c.where("entity % 7 <> 0 AND entity % 8 <> 0")
    pos = ordered.cumulative_counts(kept, ["_all"], "mcap").select("mcap", (F.col("n") - F.col("upto") + 1).alias("mcap_rank"))
    known = T.table(spark, sf, "customer").where("c_custkey % 11 = 0").select(F.col("c_custkey").alias(ENTITY))
    out = C.directory_candidates(c.join(pos, "mcap", "left"), known, 80, 6000)
    return out.select(ENTITY, "ticker", "known_chain", "mcap")


@query("C16_ticker_dedupe", _CAND + f""", x AS (SELECT *, lower(category) IN ('dexs', 'lending') AS d FROM r)
  SELECT entity, ticker, priority FROM (SELECT *, {_PRIO} AS priority, row_number() OVER (PARTITION BY ticker ORDER BY {_PRIO}, coalesce(mcap, 0) DESC, coalesce(tvl, 0) DESC,
    coalesce(volume, 0) DESC, entity) AS rn FROM x) WHERE rn = 1""")
def _(spark, sf):
    return C.dedupe_tickers(_candidates(spark, sf)).select(ENTITY, "ticker", "priority")


@query("C17_factor_lag_snapshot", COMP_SQL + """, k AS (SELECT entity AS ticker, date, composite, momentum FROM comp),
  c AS (SELECT ticker, max(date) AS d FROM k WHERE date <= (SELECT max(date) FROM k) - 30 GROUP BY 1)
  SELECT ticker, date AS factor_lag_date, composite AS composite_lag, momentum AS momentum_lag FROM k JOIN c USING (ticker) WHERE date = d""")
def _(spark, sf):
    k = composite(spark, sf).withColumn("ticker", F.col(ENTITY))
    out = C.lagged_snapshot(k, ["composite", "momentum"])
    return out.select("ticker", "factor_lag_date", "composite_lag", "momentum_lag")


@query("C18_factor_table", COMP_SQL + """, k AS (SELECT * FROM comp WHERE date = (SELECT max(date) FROM comp) AND composite IS NOT NULL)
  (SELECT 'top' AS side, entity, composite FROM k ORDER BY k.composite DESC, entity LIMIT 5)
  UNION ALL (SELECT 'bottom', entity, composite FROM k ORDER BY k.composite, entity LIMIT 5)""")
def _(spark, sf):
    k = composite(spark, sf)
    k = k.where(F.col(DATE) == k.agg(F.max(DATE)).scalar())
    top, low = C.top_table(k, "composite", tie=ENTITY), C.top_table(k, "composite", ascending=True, tie=ENTITY)
    both = top.withColumn("side", F.lit("top")).unionByName(low.withColumn("side", F.lit("bottom")))
    return both.select("side", ENTITY, "composite")


# ---- exposure ----

_W = "OVER (ORDER BY date ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
_W140, _W56 = _W.format(n=139), _W.format(n=55)
EXPO_SQL = f""", x0 AS (SELECT date, btc, btc / lag(btc) OVER (ORDER BY date) - 1 AS ret, btc / first_value(btc) OVER (ORDER BY date) AS nav FROM btc WHERE btc IS NOT NULL),
  x1 AS (SELECT *, CASE WHEN count(btc) {_W140} >= 70 THEN avg(btc) {_W140} END AS sma, CASE WHEN count(ret) {_W56} >= 28 THEN stddev_samp(ret) {_W56} * sqrt(365) END AS vol,
    nav / max(nav) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM x0),
  x2 AS (SELECT date, btc, sma, CASE WHEN sma IS NOT NULL THEN least(greatest(btc / sma, 0.5), 1.5) END AS btc_trend, CASE WHEN btc >= sma THEN 1.0::DOUBLE ELSE 0.5 END AS btc_binary,
    CASE WHEN vol > 0 THEN least(greatest(0.15 / vol, 0.25), 1.5) END AS vol_scalar,
    CASE WHEN dd > -0.1::DOUBLE THEN 1.0::DOUBLE ELSE 1 - least(greatest((dd - -0.1::DOUBLE) / (-0.2::DOUBLE - -0.1::DOUBLE), 0), 1) * 0.75::DOUBLE END AS dd_scalar FROM x1),
  expo AS (SELECT *, CASE WHEN btc_trend IS NOT NULL AND vol_scalar IS NOT NULL THEN least(greatest(btc_trend * vol_scalar * dd_scalar, 0.25), 1.5) END AS exposure FROM x2)"""


@query("G01_trend_ratio", BRAND + EXPO_SQL + " SELECT date, round(btc_trend, 6) AS btc_trend FROM expo")
def _(spark, sf):
    return benchmark(spark, sf).select(DATE, r6(G.trend_ratio()).alias("btc_trend"))


@query("G02_binary_trend", BRAND + EXPO_SQL + " SELECT date, btc_binary FROM expo")
def _(spark, sf):
    return benchmark(spark, sf).select(DATE, G.trend_binary().alias("btc_binary"))


@query("G03_vol_target", BRAND + EXPO_SQL + " SELECT date, round(vol_scalar, 6) AS vol_scalar FROM expo")
def _(spark, sf):
    return G.with_proxies(benchmark(spark, sf)).select(DATE, r6(G.vol_scalar()).alias("vol_scalar"))


@query("G04_drawdown_scalar", BRAND + EXPO_SQL + " SELECT date, round(dd_scalar, 6) AS dd_scalar FROM expo")
def _(spark, sf):
    return G.with_proxies(benchmark(spark, sf)).select(DATE, r6(G.drawdown_scalar()).alias("dd_scalar"))


@query("G05_combined_exposure", BRAND + EXPO_SQL + " SELECT date, round(exposure, 6) AS exposure FROM expo WHERE exposure IS NOT NULL")
def _(spark, sf):
    return G.diagnostics(benchmark(spark, sf)).where("exposure IS NOT NULL").select(DATE, r6("exposure").alias("exposure"))


@query("G06_apply_to_composite", COMP_SQL + EXPO_SQL + """, wkc AS (SELECT entity, date, composite FROM comp WHERE isodow(date) = 3),
  dd AS (SELECT date, last_value(exposure IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM (SELECT DISTINCT date FROM wkc) LEFT JOIN expo USING (date))
  SELECT entity, date, round(composite * e, 6) AS adjusted FROM wkc JOIN dd USING (date)""")
def _(spark, sf):
    weekly = composite(spark, sf).where(F.weekday(DATE) == 2)
    out = G.apply_exposure(weekly, G.diagnostics(benchmark(spark, sf)), "composite")
    return out.select(ENTITY, DATE, r6("adjusted").alias("adjusted"))


@query("G07_proxy_defaults", BRAND + EXPO_SQL + " SELECT date, round(ret, 6) + 0.0::DOUBLE AS ret, round(nav, 6) AS nav FROM x0")
def _(spark, sf):
    return G.with_proxies(benchmark(spark, sf)).select(DATE, r6("ret").alias("ret"), r6("nav").alias("nav"))


@query("G08_exposure_diagnostics", BRAND + EXPO_SQL + " SELECT date, btc AS btc_price, round(btc_trend, 6) AS btc_trend, round(vol_scalar, 6) AS vol_scalar, round(dd_scalar, 6) AS dd_scalar, round(exposure, 6) AS exposure FROM expo")
def _(spark, sf):
    d = G.diagnostics(benchmark(spark, sf))
    return d.select(DATE, "btc_price", *[r6(c).alias(c) for c in ("btc_trend", "vol_scalar", "dd_scalar", "exposure")])


@query("G08_exposure_summary", BRAND + EXPO_SQL + """ SELECT count(*) AS n_dates, round(avg(exposure), 6) AS mean_exposure, round(median(exposure), 6) AS median_exposure, round(min(exposure), 6) AS min_exposure,
  round(max(exposure), 6) AS max_exposure, round(avg((exposure < 1)::INT::DOUBLE), 6) AS pct_below_1, round(avg((exposure > 1)::INT::DOUBLE), 6) AS pct_above_1, round(arg_max(exposure, date), 6) AS current_exposure,
  round(arg_max(btc_trend, date), 6) AS current_btc_trend, round(arg_max(vol_scalar, date), 6) AS current_vol_scalar, round(arg_max(dd_scalar, date), 6) AS current_dd_scalar FROM expo WHERE exposure IS NOT NULL""")
def _(spark, sf):
    s = G.summary(G.diagnostics(benchmark(spark, sf)))
    return s.select("n_dates", *[r6(c).alias(c) for c in s.columns if c != "n_dates"])


@query("G09_weekly_regime", BRAND + REGIME_SQL + " SELECT date, btc AS btc_close, btc_weekly_close, round(btc_20w_ma, 6) AS btc_20w_ma, regime FROM reg JOIN btc USING (date)")
def _(spark, sf):
    r = regime(spark, sf)
    return r.select(DATE, "btc_close", "btc_weekly_close", r6("btc_20w_ma").alias("btc_20w_ma"), "regime")
