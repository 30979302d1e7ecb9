"""Screener tables (S, P15, B23, B24) over the brand panel."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daygrid.catalog.base import BRAND, MASTER, query, r6
from daygrid.catalog.cross_section import BUCKET_SQL, names
from daygrid.catalog.score import WIDE_SQL, plain_families, z_wide
from daygrid.catalog.signals import _chg, _roll
from daygrid.functions.rolling import DATE, ENTITY
from daygrid.operators import panel as P
from daygrid.operators import score as C
from daygrid.operators import screener as S
from daygrid.plans import scoring as R
from daygrid.sources import tables as T
from daygrid.sources.store import saved

_SP = BRAND + ", sp AS (SELECT * REPLACE (mcap * 40 AS mcap, fdv * 40 AS fdv) FROM panel JOIN btc USING (date)), lastd AS (SELECT max(date) AS d FROM panel)"


def ts_sql(prefix: str) -> str:
    fill = ", ".join(f"last_value({m} IGNORE NULLS) OVER f AS {m}" for m in S.LEVELS)
    wow = ", ".join(f"({_chg(c, k)}) * 100 AS {n}_{w}_pct" for n, c in (("revenue", "revenue_7d_avg"), ("fees", "fees_7d_avg"), ("deposits", "deposits"), ("tvl", "tvl"), ("oi", "open_interest")) for w, k in (("wow", 7), ("mom", 30)))
    return prefix + f""", t0 AS (SELECT entity, date, {fill}, btc FROM sp WHERE date >= (SELECT d FROM lastd) - 119 WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
  t1 AS (SELECT *, {_roll('avg', 'revenue', 7, 3)} AS revenue_7d_avg, {_roll('sum', 'revenue', 30, 7)} AS revenue_30d, {_roll('avg', 'fees', 7, 3)} AS fees_7d_avg, {_roll('sum', 'fees', 30, 7)} AS fees_30d, {_roll('avg', 'addresses', 7, 3)} AS daily_active_users,
    {_chg('price', 1)} AS rp, {_chg('revenue', 1)} AS rr, {_chg('btc', 1)} AS rb FROM t0),
  t2 AS (SELECT *, revenue_30d * (365::DOUBLE / 30) AS annualised_revenue_30d, fees_30d * (365::DOUBLE / 30) AS annualised_fees_30d FROM t1),
  t3 AS (SELECT *, ({_chg('price', 7)}) * 100 AS price_7d_pct, {wow}, {_chg('revenue_7d_avg', 14)} AS g14, {_chg('revenue_7d_avg', 28)} AS g28, {_chg('fees_7d_avg', 14)} AS h14, {_chg('fees_7d_avg', 28)} AS h28, fdv / nullif(annualised_revenue_30d, 0) AS fdv_annualised_revenue,
    fdv / nullif(annualised_fees_30d, 0) AS fdv_annualised_fees, fdv / nullif(annualised_fees_30d, 0) AS payback_period_fees, revenue_7d_avg / nullif(daily_active_users, 0) AS revenue_per_active_address, burn / nullif(issuance, 0) AS buyback_versus_issuance,
    volume / nullif(open_interest, 0) AS spot_volume_oi_ratio, (rp - rb) * 100 AS daily_pct_over_btc, {BUCKET_SQL.format(x='fdv')} AS fdv_bucket, {BUCKET_SQL.format(x='mcap')} AS mcap_bucket FROM t2),
  ca AS (SELECT entity, date, corr(rp, rb) OVER w AS c, count(*) OVER w AS n, count(*) OVER (PARTITION BY entity) AS t FROM t3 WHERE rp IS NOT NULL AND rb IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  cb AS (SELECT entity, date, corr(rr, rb) OVER w AS c, count(*) OVER w AS n, count(*) OVER (PARTITION BY entity) AS t FROM t3 WHERE rr IS NOT NULL AND rb IS NOT NULL WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 90 PRECEDING AND CURRENT ROW)),
  mst AS ({MASTER}),
  t4 AS (SELECT t3.*, ticker, name, category, g14 / nullif(g28, 0) AS revenue_2w_4w_ratio, h14 / nullif(h28, 0) AS fees_2w_4w_ratio, CASE WHEN ca.n >= 15 AND ca.t >= 15 THEN ca.c END AS price_btc_corr, CASE WHEN cb.n >= 45 AND cb.t >= 45 THEN cb.c END AS revenue_btc_corr
    FROM t3 JOIN mst USING (entity) LEFT JOIN ca USING (entity, date) LEFT JOIN cb USING (entity, date)),
  md AS (SELECT date, category, median(fdv_annualised_revenue) AS m FROM t4 GROUP BY 1, 2),
  ts AS (SELECT t4.*, (fdv_annualised_revenue / nullif(m, 0) - 1) * 100 AS implied_growth_rate FROM t4 JOIN md USING (date, category))"""


TS = ts_sql(_SP)


def base_panel(spark, sf):
    return T.brand_panel(spark, sf, True).withColumns({"mcap": F.col("mcap") * 40, "fdv": F.col("fdv") * 40})


def project_ts(spark, sf):
    m = T.brand_master(spark, sf).select(ENTITY, "ticker", "name", "category")
    return S.project_timeseries(base_panel(spark, sf), m, max_names=names(spark, sf), last=T.bounds(spark, sf).select("hi").scalar())


_DERIVED = ("price_7d_pct", "revenue_7d_avg", "revenue_30d", "annualised_revenue_30d", "fees_7d_avg", "annualised_fees_30d", "daily_active_users", *(f"{n}_{w}_pct" for n in ("revenue", "fees", "deposits", "tvl", "oi") for w in ("wow", "mom")),
            "revenue_2w_4w_ratio", "fees_2w_4w_ratio", "fdv_annualised_revenue", "fdv_annualised_fees", "payback_period_fees", "revenue_per_active_address", "buyback_versus_issuance", "spot_volume_oi_ratio", "daily_pct_over_btc",
            "price_btc_corr", "revenue_btc_corr", "implied_growth_rate")


@query("P15_project_timeseries", TS + " SELECT entity, date, ticker, category, fdv_bucket, mcap_bucket, " + ", ".join(f"round({c}, 4) + 0.0::DOUBLE AS {c}" for c in _DERIVED) + " FROM ts")
def _(spark, sf):
    return project_ts(spark, sf).select(ENTITY, DATE, "ticker", "category", "fdv_bucket", "mcap_bucket", *[r6(c, 4).alias(c) for c in _DERIVED])


@query("S01_market_snapshot", BRAND + f""", a AS (SELECT entity, arg_max(price, date) AS price, arg_max(volume, date) AS volume FROM daily WHERE substr(entity, 7)::INT % 3 <> 0 GROUP BY 1), b AS (SELECT entity, list_price AS price, n_parts * 100.0::DOUBLE AS mcap FROM ({MASTER}) WHERE n % 2 = 0),
  c AS (SELECT entity, arg_max(price, date) AS price, arg_max(mcap, date) AS mcap FROM panel WHERE mcap IS NOT NULL GROUP BY 1)
  SELECT entity, coalesce(b.price, a.price, c.price) AS price, coalesce(b.mcap, c.mcap) AS mcap, a.volume FROM ({MASTER}) LEFT JOIN a USING (entity) LEFT JOIN b USING (entity) LEFT JOIN c USING (entity)""")
def _(spark, sf):
    m = T.brand_master(spark, sf)
    n3 = F.substr(ENTITY, F.lit(7)).cast("int") % 3 != 0
    a = P.latest_values(T.brand_daily(spark, sf).where(n3), ["price", "volume"])
    b = m.where("n % 2 = 0").select(ENTITY, F.col("list_price").alias("price"), (F.col("n_parts") * 100.0).alias("mcap"))
    c = T.brand_panel(spark, sf).where("mcap IS NOT NULL").groupBy(ENTITY).agg(F.max_by("price", DATE).alias("price"), F.max_by("mcap", DATE).alias("mcap"))
    order = {"price": [("cg", "price"), ("venue", "price"), ("bw", "price")], "mcap": [("cg", "mcap"), ("bw", "mcap")], "volume": [("venue", "volume")]}
    return S.market_snapshot(m, {"cg": b, "venue": a, "bw": c}, order)


@query("S02_panel_assembly", BRAND + f""" SELECT entity, date, coalesce(CASE WHEN n % 3 <> 0 THEN issuance END, dex_volume, list_price) AS price, coalesce(deposits, n_parts * 1.0::DOUBLE) AS tvl FROM panel JOIN ({MASTER}) USING (entity)""")
def _(spark, sf):
    p = T.brand_panel(spark, sf).select(ENTITY, DATE, "issuance", "dex_volume", "deposits")
    m = T.brand_master(spark, sf).select(ENTITY, "n", "list_price", F.col("n_parts").cast("double").alias("n_parts"))
    j = P.static_panel(p, m, ["n", "list_price", "n_parts"])
    return j.select(ENTITY, DATE, P_first(F.when(F.col("n") % 3 != 0, F.col("issuance")), F.col("dex_volume"), F.col("list_price")).alias("price"), P_first(F.col("deposits"), F.col("n_parts")).alias("tvl"))


def P_first(*cols):
    return F.coalesce(*cols)


_Q = _SP + """, qa AS (SELECT entity, greatest(max(date) FILTER (revenue IS NOT NULL), max(date) FILTER (fees IS NOT NULL), max(date) FILTER (tvl2 IS NOT NULL)) AS latest_metric_date, count(*) FILTER (rr IS NOT NULL) AS n,
    corr(rr, ff) AS c, stddev_pop(rr) * stddev_pop(ff) AS v, count(revenue) + count(fees) = 0 AS missing_fees_revenue, count(tvl2) = 0 AS missing_tvl FROM (SELECT *, CASE WHEN entity = 'Brand#5' THEN NULL ELSE dex_volume END AS tvl2,
      CASE WHEN date >= (SELECT d FROM lastd) - 119 AND revenue IS NOT NULL AND fees IS NOT NULL THEN revenue END AS rr, CASE WHEN date >= (SELECT d FROM lastd) - 119 AND revenue IS NOT NULL AND fees IS NOT NULL THEN fees END AS ff
      FROM (SELECT entity, date, dex_volume, revenue, CASE WHEN entity = 'Brand#8' THEN revenue * 3 ELSE fees END AS fees FROM sp)) GROUP BY 1),
  qf AS (SELECT entity, latest_metric_date, coalesce((SELECT d FROM lastd) + 10 - latest_metric_date > 14, TRUE) AS stale_metric, missing_fees_revenue, missing_tvl, CASE WHEN n >= 30 AND v > 0 THEN c END AS revenue_fees_corr_90d,
    coalesce(CASE WHEN n >= 30 AND v > 0 THEN abs(c) >= 0.98 END, FALSE) AS revenue_fees_redundant FROM qa)"""


def quality(spark, sf):
    p = T.brand_panel(spark, sf).select(ENTITY, DATE, "revenue", F.when(F.col(ENTITY) == "Brand#8", F.col("revenue") * 3).otherwise(F.col("fees")).alias("fees"),
                                        F.when(F.col(ENTITY) != "Brand#5", F.col("dex_volume")).alias("tvl"))
    last = T.bounds(spark, sf).select("hi").scalar()
    # ages are measured ten days after the data ends; the correlation window is the data's own
    q = S.quality_flags(p, last)
    return q.withColumn("stale_metric", F.coalesce(F.datediff(F.date_add(last, 10), "latest_metric_date") > 14, F.lit(True)))


@query("S03_quality_flags", _Q + " SELECT * REPLACE (round(revenue_fees_corr_90d, 6) AS revenue_fees_corr_90d) FROM qf")
def _(spark, sf):
    return quality(spark, sf).withColumn("revenue_fees_corr_90d", r6("revenue_fees_corr_90d"))


@query("S04_redundant_fee_mask", _Q.replace("sp AS (", "sp AS MATERIALIZED (").replace("qf AS (", "qf AS MATERIALIZED (") + " SELECT entity, date, CASE WHEN NOT revenue_fees_redundant THEN fees END AS fees FROM sp JOIN qf USING (entity)")
def _(spark, sf):
    return S.mask_redundant_fees(T.brand_panel(spark, sf).select(ENTITY, DATE, "fees"), quality(spark, sf))


_FS = WIDE_SQL + """, fsc AS (SELECT *, round((coalesce(fundamentals, 0) * 0.55::DOUBLE + coalesce(momentum, 0) * 0.175::DOUBLE + coalesce(flows, 0) * 0.125::DOUBLE) / (0.55::DOUBLE + 0.175::DOUBLE + 0.125::DOUBLE), 10) AS factor_score FROM wide)"""
_SCORES = ("factor_score", "fundamentals", "momentum", "flows")


def factor_scores(spark, sf):
    n = names(spark, sf)
    frame = R.family_means(z_wide(T.brand_panel(spark, sf, True), n), plain_families())
    rows = frame.where(F.coalesce("fundamentals", "momentum", "flows").isNotNull()).select(ENTITY, DATE, "fundamentals", "momentum", "flows")
    return C.composite_fixed(saved(rows, "family-scores"), min_families=1, out="factor_score")


@query("S05_factor_panels", _FS + " SELECT entity, date, " + ", ".join(_SCORES) + " FROM fsc")
def _(spark, sf):
    return factor_scores(spark, sf).select(ENTITY, DATE, *_SCORES)


@query("S06_snapshot", TS + _Q.replace(_SP, "") + """ SELECT entity, date, ticker, round(revenue_7d_avg, 4) AS revenue_7d_avg, fdv_bucket, n_parts, stale_metric, revenue_fees_redundant FROM ts JOIN (SELECT entity, n_parts FROM mst) USING (entity) JOIN qf USING (entity) WHERE date = (SELECT d FROM lastd)""")
def _(spark, sf):
    m = T.brand_master(spark, sf).select(ENTITY, "n_parts")
    snap = S.snapshot(project_ts(spark, sf), m, quality(spark, sf), ["mcap"])
    return snap.select(ENTITY, DATE, "ticker", r6("revenue_7d_avg", 4).alias("revenue_7d_avg"), "fdv_bucket", "n_parts", "stale_metric", "revenue_fees_redundant")


_LONG = """, gl AS (SELECT date, metric, value, g.t AS group_type, g.v AS "Group" FROM (SELECT date, mm.m AS metric, mm.v AS value, [{'t': 'aggregate', 'v': 'Aggregate'}, {'t': 'category', 'v': category}, {'t': 'fdv_bucket', 'v': fdv_bucket}, {'t': 'mcap_bucket', 'v': mcap_bucket}] AS gs FROM (SELECT date, category, fdv_bucket, mcap_bucket, unnest([{'m': 'revenue_mom_pct', 'v': revenue_mom_pct}, {'m': 'fees_mom_pct', 'v': fees_mom_pct}, {'m': 'deposits_mom_pct', 'v': deposits_mom_pct}, {'m': 'oi_mom_pct', 'v': oi_mom_pct}]) AS mm FROM ts WHERE date >= (SELECT d FROM lastd) - 29)), unnest(gs) u(g) WHERE value IS NOT NULL),
  gst AS (SELECT date, metric, group_type, "Group", count(*) AS "Eligible", avg(value) AS a, median(value) AS b, quantile_cont(value, 0.75::DOUBLE) AS c, quantile_cont(value, 0.99::DOUBLE) AS d FROM gl GROUP BY 1, 2, 3, 4),
  sm AS (SELECT date, metric, group_type, "Group", "Eligible", s.s AS "Statistic", s.v AS "Value", s.w AS view FROM gst, unnest([{'s': 'Average', 'v': a, 'w': 'change'}, {'s': 'Average', 'v': a, 'w': 'dispersion'}, {'s': 'Median', 'v': b, 'w': 'dispersion'},
    {'s': '75th percentile', 'v': c, 'w': 'dispersion'}, {'s': '99th percentile', 'v': d, 'w': 'dispersion'}]) u(s))"""


def summary(spark, sf):
    return S.summary_timeseries(saved(project_ts(spark, sf), "project-ts"), list(S.CHANGE_METRICS))


@query("S07_summary_timeseries", TS + _LONG + """ SELECT date, metric, group_type, "Group", "Eligible", "Statistic", round("Value", 4) + 0.0::DOUBLE AS "Value", view FROM sm""")
def _(spark, sf):
    return summary(spark, sf).withColumn("Value", r6("Value", 4))


@query("S08_factor_score_table", _FS + f""" SELECT 'T' || substr(entity, 7) AS ticker, date, factor_score, momentum, date - 30 AS factor_lag_date FROM fsc""")
def _(spark, sf):
    m = T.brand_master(spark, sf).select(ENTITY, "ticker")
    return factor_scores(spark, sf).join(m, ENTITY).select("ticker", DATE, "factor_score", "momentum", F.date_sub(DATE, 30).alias("factor_lag_date"))


@query("S09_universe_aggregate", TS + " SELECT date, metric, sum(value) AS value FROM (SELECT date, 'revenue' AS metric, revenue AS value FROM ts WHERE category <> 'DEX' UNION ALL SELECT date, 'fees', fees FROM ts WHERE category <> 'DEX' UNION ALL SELECT date, 'deposits', deposits FROM ts WHERE category <> 'DEX') WHERE value IS NOT NULL GROUP BY 1, 2")
def _(spark, sf):
    ok = T.brand_master(spark, sf).where("category <> 'DEX'")
    return S.universe_aggregate(project_ts(spark, sf), ok, ["revenue", "fees", "deposits"])


# All stable-like tickers and categories, and some that are not.
_STABLE_TICKERS = ("BUSD", "CRVUSD", "DAI", "FDUSD", "FRAX", "GHO", "LUSD", "MIM", "PYUSD", "RLUSD", "SUSD", "TUSD", "USDC", "USDC.E", "USDD", "USDE", "USDG", "USDL", "USDP", "USDS", "USDT", "USDT0", "USDY")
_STABLE_CATEGORIES = ("algo-stables", "dual-token stablecoin", "stablecoin", "stablecoins")
_SOME_TICKERS, _SOME_CATEGORIES = (*_STABLE_TICKERS, "USD1", "BTC", "usdc", "T1", "ETH", "SOL"), (*(c.title() for c in _STABLE_CATEGORIES), "DEX", "Lending", " stablecoins ")


def _sql_list(values):
    return ", ".join(f"'{v}'" for v in values)


@query("S10_stable_like", f"""WITH x AS (SELECT p_partkey, t[p_partkey % {len(_SOME_TICKERS) + 4} + 1] AS ticker, c[p_partkey % 41 % {len(_SOME_CATEGORIES) + 9} + 1] AS category FROM part, (SELECT [{_sql_list(_SOME_TICKERS)}] AS t, [{_sql_list(_SOME_CATEGORIES)}] AS c))
  SELECT p_partkey, ticker, category, coalesce(upper(ticker), '') IN ({_sql_list(_STABLE_TICKERS)}) OR coalesce(lower(trim(category)), '') IN ({_sql_list(_STABLE_CATEGORIES)}) AS stable FROM x""")
def _(spark, sf):
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))
    k = F.col("p_partkey")
    rows = T.table(spark, sf, "part").select("p_partkey", pick(_SOME_TICKERS, k % (len(_SOME_TICKERS) + 4)).alias("ticker"), pick(_SOME_CATEGORIES, k % 41 % (len(_SOME_CATEGORIES) + 9)).alias("category"))
    return rows.withColumn("stable", S.is_stable_like())


_TOP = TS + """, tp AS (SELECT *, (price / nullif(b, 0) - 1) * 100 AS p30 FROM (SELECT *, lag(price, 30) OVER (PARTITION BY entity ORDER BY date) AS b FROM ts WHERE lower(category) <> 'stablecoins' AND price IS NOT NULL)),
  tl AS (SELECT * FROM tp WHERE (p30 IS NOT NULL OR (b = 0 AND price <> 0)) AND mcap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date DESC) = 1), t100 AS (SELECT * FROM (SELECT * FROM tl ORDER BY mcap DESC, ticker LIMIT 100) WHERE p30 IS NOT NULL)"""


@query("S11_top_price_distribution", _TOP + " SELECT ticker, date, round(p30, 6) AS price_30d_pct, mcap FROM t100")
def _(spark, sf):
    return S.top_price_changes(project_ts(spark, sf)).withColumn("price_30d_pct", r6("price_30d_pct"))


@query("S12_histogram", """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), x AS (SELECT l_extendedprice AS v, CASE WHEN l_extendedprice >= hi THEN 24 ELSE least(CAST(floor((l_extendedprice - lo) * 24 / (hi - lo)) AS INT) + 1, 24) END AS bin FROM lineitem, b)
  SELECT bin, count(*) AS n, min(v) AS low, max(v) AS high FROM x GROUP BY 1""")
def _(spark, sf):
    return S.histogram(T.table(spark, sf, "lineitem"), "l_extendedprice")


@query("S13_peer_kpi_growth", TS + """, b AS (SELECT date, ticker, revenue_7d_avg AS v FROM ts WHERE ticker IN ('T1', 'T2', 'T3') AND revenue_7d_avg IS NOT NULL), st AS (SELECT max(s) AS s FROM (SELECT min(date) AS s FROM b GROUP BY ticker)),
  f AS (SELECT *, first_value(v) OVER (PARTITION BY ticker ORDER BY date) AS f FROM b WHERE date >= (SELECT s FROM st)) SELECT date, ticker, round(v / f * 100, 6) AS indexed FROM f WHERE abs(f) > 1e-12""")
def _(spark, sf):
    return S.peer_growth(saved(project_ts(spark, sf), "project-ts"), ["t1", "T2", "T3"], "revenue_7d_avg").select(DATE, "ticker", r6("Indexed").alias("indexed"))


@query("S14_change_series", TS + """ SELECT date, category AS "Group", round(avg(fees_mom_pct), 4) + 0.0::DOUBLE AS "Value", count(fees_mom_pct) AS "Eligible" FROM ts WHERE fees_mom_pct IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return S.change_series(project_ts(spark, sf), "fees_mom_pct", "category").withColumn("Value", r6("Value", 4))


_WIN = TS + """, wq AS (SELECT date, quantile_cont(revenue, 0.01::DOUBLE) AS lo, quantile_cont(revenue, 0.99::DOUBLE) AS hi FROM ts GROUP BY 1), wv AS (SELECT ts.*, least(greatest(revenue, lo), hi) AS wr FROM ts JOIN wq USING (date) WHERE revenue IS NOT NULL),
  rs AS (SELECT date, category AS g, sum(wr) AS v, count(*) AS n FROM wv GROUP BY 1, 2)"""


@query("S15_raw_sums", _WIN + """ SELECT date, g AS "Group", round(v, 3) AS "Value", n AS "Eligible" FROM rs""")
def _(spark, sf):
    return S.raw_sums(project_ts(spark, sf), "revenue", "category", True, names(spark, sf)).withColumn("Value", r6("Value", 3))


@query("S16_rebased_index", _WIN + """, rf AS (SELECT *, first_value(v) OVER (PARTITION BY g ORDER BY date) AS f FROM rs) SELECT date, g AS "Group", round((v / f - 1) * 100, 5) + 0.0::DOUBLE AS "Index", n AS "Eligible" FROM rf WHERE abs(f) > 1e-12""")
def _(spark, sf):
    sums = S.raw_sums(project_ts(spark, sf), "revenue", "category", True, names(spark, sf))
    return S.rebase(sums, "Value", ["Group"], "Index").select(DATE, "Group", r6("Index", 5).alias("Index"), "Eligible")


@query("S17_stat_series", TS + """, q AS (SELECT date, fdv_bucket AS g, count(*) AS n, avg(fees) AS a, median(fees) AS b, quantile_cont(fees, 0.75::DOUBLE) AS c, quantile_cont(fees, 0.99::DOUBLE) AS d FROM ts WHERE fees IS NOT NULL GROUP BY 1, 2),
  l AS (SELECT date, g, n, s.s, s.v FROM q, unnest([{'s': 'Average', 'v': a}, {'s': 'Median', 'v': b}, {'s': '75th percentile', 'v': c}, {'s': '99th percentile', 'v': d}]) u(s)), f AS (SELECT *, first_value(v) OVER (PARTITION BY g, s ORDER BY date) AS f FROM l)
  SELECT date, g AS "Group", n AS "Eligible", s AS "Statistic", round((v / f - 1) * 100, 5) + 0.0::DOUBLE AS "Index" FROM f WHERE abs(f) > 1e-12""")
def _(spark, sf):
    ts = saved(project_ts(spark, sf).select(DATE, F.col("fdv_bucket").alias("Group"), F.col("fees").alias("value")), "fees")
    stats = S.group_stats(ts, [DATE, "Group"])
    return S.rebase(stats, "Value", ["Group", "Statistic"], "Index").select(DATE, "Group", "Eligible", "Statistic", r6("Index", 5).alias("Index"))


@query("S18_box_quartiles", """SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25::DOUBLE) AS q1, quantile_cont(l_extendedprice, 0.5::DOUBLE) AS q2, quantile_cont(l_extendedprice, 0.75::DOUBLE) AS q3, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark, sf):
    q = S.quartiles(T.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])
    return q.select("l_returnflag", "l_linestatus", "q1", "q2", "q3", "low", "high", "n")


@query("S19_category_position", TS + """, l AS (SELECT ticker, category, 'revenue_7d_avg' AS metric, revenue_7d_avg AS value FROM ts WHERE date = (SELECT d FROM lastd) UNION ALL SELECT ticker, category, 'fdv', fdv FROM ts WHERE date = (SELECT d FROM lastd)),
  q AS (SELECT category, metric, quantile_cont(value, 0.25::DOUBLE) AS a, median(value) AS m, quantile_cont(value, 0.75::DOUBLE) AS b, stddev_samp(value) AS s FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
  SELECT ticker, category, metric, round((value - m) / CASE WHEN b - a > 0 THEN b - a WHEN s > 0 THEN s ELSE 1 END, 6) + 0.0::DOUBLE AS position FROM l JOIN q USING (category, metric) WHERE value IS NOT NULL""")
def _(spark, sf):
    last = T.bounds(spark, sf).select("hi").scalar()
    snap = project_ts(spark, sf).where(F.col(DATE) == last)
    return S.category_position(snap, ["revenue_7d_avg", "fdv"], names(spark, sf)).select("ticker", "category", "metric", r6("position").alias("position"))


@query("S20_selection_rows", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def _(spark, sf):
    return S.matching_rows(T.table(spark, sf, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, ["o_orderkey", "o_totalprice"])


@query("S21_table_reader", TS + _LONG + """ SELECT date, "Group", "Statistic", round("Value", 4) + 0.0::DOUBLE AS "Value" FROM sm WHERE metric = 'oi_mom_pct' AND view = 'change'""")
def _(spark, sf):
    out = S.matching_rows(saved(summary(spark, sf), "summary"), {"metric": "oi_mom_pct", "view": "change"}, [DATE, "Group", "Statistic", "Value"])
    return out.orderBy(DATE, "Group").withColumn("Value", r6("Value", 4))


@query("S22_project_filter", TS + """ SELECT ticker, date FROM ts WHERE category IN ('DEX', 'Perps') AND fdv_bucket IN ('Mid', 'Large', 'Mega') AND mcap_bucket IN ('Mid', 'Large', 'Mega') AND annualised_revenue_30d >= 1000000 AND revenue_7d_avg IS NOT NULL AND fees_7d_avg IS NOT NULL AND fdv IS NOT NULL""")
def _(spark, sf):
    big = ["Mid", "Large", "Mega"]
    return S.filter_projects(project_ts(spark, sf), ["DEX", "Perps"], big, big, 1_000_000.0, 0.0, True).select("ticker", DATE)


@query("S23_score_range", TS + """ SELECT ticker, date, round(price_btc_corr, 5) + 0.0::DOUBLE AS price_btc_corr FROM ts WHERE price_btc_corr BETWEEN 0.1 AND 0.5 AND fdv_bucket IN ('Large', 'Mega')""")
def _(spark, sf):
    return S.score_range(project_ts(spark, sf), "price_btc_corr", 0.1, 0.5, ["Large", "Mega"]).select("ticker", DATE, r6("price_btc_corr", 5).alias("price_btc_corr"))


@query("S24_coverage_report", BRAND + " " + " UNION ALL ".join(f"SELECT '{m}' AS metric, count({m}) AS count, round(count({m}) * 100.0::DOUBLE / count(*), 6) AS share FROM sparse" for m in ("revenue", "issuance", "dex_volume")))
def _(spark, sf):
    d = P.densify(T.brand_daily(spark, sf), T.brands(spark, sf), T.bounds(spark, sf), ["revenue", "issuance", "dex_volume"])
    return S.coverage_report(d, {m: F.col(m).isNotNull() for m in ("revenue", "issuance", "dex_volume")}).withColumn("share", r6("share"))


@query("S25_gap_report", TS + """ SELECT ticker, CASE WHEN issuance IS NULL THEN 'Missing' ELSE 'OK' END AS issuance, CASE WHEN open_interest IS NULL THEN 'Missing' ELSE 'OK' END AS open_interest FROM ts WHERE date = (SELECT d FROM lastd)""")
def _(spark, sf):
    last = T.bounds(spark, sf).select("hi").scalar()
    return S.gap_report(project_ts(spark, sf).where(F.col(DATE) == last), ["issuance", "open_interest"])


@query("S26_data_freshness", "SELECT max(CAST(l_shipdate AS DATE)) AS latest, CAST(DATE '2002-01-01' - max(CAST(l_shipdate AS DATE)) AS INT) AS age_days FROM lineitem")
def _(spark, sf):
    return S.freshness(T.lines(spark, sf), F.lit(dt.date(2002, 1, 1)))


_RC = BRAND + ", px AS (SELECT date, " + ", ".join(f"max(price) FILTER (entity = 'Brand#{n}') AS p{n}" for n in (1, 2, 3)) + " FROM panel WHERE price IS NOT NULL GROUP BY 1), pf AS (SELECT date, " + ", ".join(f"last_value(p{n} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p{n}" for n in (1, 2, 3)) + \
    " FROM px), pr AS (SELECT date, " + ", ".join(f"p{n} / lag(p{n}, 30) OVER (ORDER BY date) - 1 AS r{n}" for n in (1, 2, 3)) + " FROM pf)"


@query("S27_return_correlations", _RC + f""" SELECT pos, benchmark, round(corr, 6) AS corr, observations, round(benchmark_return, 6) AS benchmark_return, (SELECT round(arg_max(r1, date), 6) FROM pr WHERE r1 IS NOT NULL) AS selected_return, note FROM (
  SELECT 0 AS pos, 'T2' AS benchmark, corr(r1, r2) AS corr, count(*) FILTER (r1 IS NOT NULL AND r2 IS NOT NULL) AS observations, arg_max(r2, date) FILTER (r2 IS NOT NULL) AS benchmark_return, '' AS note FROM pr
  UNION ALL SELECT 1, 'T1', 1.0, count(r1), arg_max(r1, date) FILTER (r1 IS NOT NULL), 'Selected asset.' FROM pr UNION ALL SELECT 2, 'MISSING', NULL, 0, NULL, 'Benchmark has no price history.'
  UNION ALL SELECT 3, 'T3', corr(r1, r3), count(*) FILTER (r1 IS NOT NULL AND r3 IS NOT NULL), arg_max(r3, date) FILTER (r3 IS NOT NULL), '' FROM pr)""")
def _(spark, sf):
    p = saved(T.brand_panel(spark, sf).select(DATE, F.concat(F.lit("T"), F.substr(ENTITY, F.lit(7))).alias("ticker"), "price"), "prices")
    out = S.return_correlations(p, "t1", ["T2", "t1", "T2", "MISSING", "T3"])
    return out.select("pos", "benchmark", r6("corr").alias("corr"), "observations", r6("benchmark_return").alias("benchmark_return"), r6("selected_return").alias("selected_return"), "note")


_BI = """, bp AS (SELECT k.*, ts.date, price, fdv, mcap FROM mem k JOIN ts USING (ticker) WHERE ts.date >= (SELECT d FROM lastd) - 29 AND price IS NOT NULL),
  bq AS (SELECT *, first_value(fdv) OVER w AS f0, last_value(fdv) OVER w AS f1, price / first_value(price) OVER w * 100 AS i, count(*) OVER w AS n FROM bp WINDOW w AS (PARTITION BY factor, basket, ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  bx AS (SELECT factor, basket, date, sum(w * i) / sum(w) AS x FROM (SELECT *, CASE WHEN f0 > 0 THEN f0 WHEN f1 > 0 THEN f1 ELSE 1 END AS w FROM bq WHERE n >= 2) GROUP BY 1, 2, 3),
  bi AS (SELECT *, first_value(x) OVER (PARTITION BY factor, basket ORDER BY date) AS f FROM bx)"""


@query("B23_basket_index", TS + ", mem AS (SELECT 'x' AS factor, 'mix' AS basket, ticker FROM mst WHERE n IN (1, 2, 3, 4))" + _BI + """ SELECT date, basket AS "Basket", round(x / f * 100, 6) AS "Index" FROM bi""")
def _(spark, sf):
    m = T.brand_master(spark, sf).where("n IN (1, 2, 3, 4)").select(F.lit("mix").alias("Basket"), "ticker")
    return S.basket_index(saved(project_ts(spark, sf).select(DATE, "ticker", "price", "fdv", "mcap"), "project-ts"), m, ["Basket"]).select(DATE, "Basket", r6("Index").alias("Index"))


@query("B24_factor_baskets", TS + """, sn AS (SELECT ticker, lag(revenue_7d_avg, 30) OVER (PARTITION BY ticker ORDER BY date) AS a, lag(price_7d_pct, 30) OVER (PARTITION BY ticker ORDER BY date) AS b, date FROM ts), s1 AS (SELECT * FROM sn WHERE date = (SELECT d FROM lastd)),
  mem AS (SELECT * FROM (SELECT 'Total' AS factor, 'Top factor basket' AS basket, ticker FROM s1 WHERE a IS NOT NULL ORDER BY a DESC, ticker LIMIT 5) UNION ALL SELECT * FROM (SELECT 'Total', 'Bottom factor basket', ticker FROM s1 WHERE a IS NOT NULL ORDER BY a, ticker DESC LIMIT 5)
    UNION ALL SELECT * FROM (SELECT 'Momentum', 'Top factor basket', ticker FROM s1 WHERE b IS NOT NULL ORDER BY b DESC, ticker LIMIT 5) UNION ALL SELECT * FROM (SELECT 'Momentum', 'Bottom factor basket', ticker FROM s1 WHERE b IS NOT NULL ORDER BY b, ticker DESC LIMIT 5))"""
       + _BI + """ SELECT factor AS "Factor", basket AS "Basket", date, round(x / f * 100, 6) AS "Index" FROM bi""")
def _(spark, sf):
    from pyspark.sql import Window

    ts = saved(project_ts(spark, sf).select(DATE, "ticker", "price", "fdv", "mcap", "revenue_7d_avg", "price_7d_pct"), "project-ts")
    w = Window.partitionBy("ticker").orderBy(DATE)
    snap = ts.withColumns({"a": F.lag("revenue_7d_avg", 30).over(w), "b": F.lag("price_7d_pct", 30).over(w)}).where(F.col(DATE) == ts.agg(F.max(DATE)).scalar())
    return S.factor_baskets(ts, saved(snap, "snapshot"), {"Total": "a", "Momentum": "b"}).select("Factor", "Basket", DATE, r6("Index").alias("Index"))


