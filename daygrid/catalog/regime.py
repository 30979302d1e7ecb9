"""Weekly regime indicators and classifier (I) over the brand panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daygrid.catalog.base import BRAND, query, r6
from daygrid.functions.rolling import DATE, ENTITY, chg, lag, roll
from daygrid.operators import regime as I
from daygrid.sources import tables as T
from daygrid.sources.store import saved

WEEK = I.WEEK


def _w():
    return Window.partitionBy(F.lit(0)).orderBy(WEEK)


def sources(spark, sf):
    """The panel once, the market per day once."""
    panel = saved(T.brand_panel(spark, sf, True).select(ENTITY, DATE, "price", "stablecoin_supply", "bridge_flow", "dex_volume", "deposits", "btc"), "panel")
    pick = lambda n: F.max(F.when(F.col(ENTITY) == f"Brand#{n}", F.col("price"))).alias(f"p{n}")
    day = panel.groupBy(DATE).agg(
        F.max("btc").alias("btc"), F.sum("stablecoin_supply").alias("supply"), (F.sum("bridge_flow") / 1e6).alias("flow"),
        (F.sum(F.coalesce("dex_volume", F.lit(0.0)) - F.coalesce("deposits", F.lit(0.0))) / 1e6).alias("eth_flow"), *[pick(n) for n in (1, 2, 3, 4, 5, 6, 7)])
    return panel, saved(day, "market-day")


def features(spark, sf):
    """Weekly features; manual inputs are stood in for by scaled market series."""
    panel, day = sources(spark, sf)
    # a week's last day: every daily feature is read there
    f = lambda name, out: I.flow_sums(day, name).withColumnsRenamed({"f5": f"{out}_f5", "f20": f"{out}_f20"})
    d = Window.partitionBy(F.lit(0)).orderBy(DATE)
    daily = (day.select(DATE, "btc", *[f"p{n}" for n in range(1, 8)], ((F.col("p2") - lag("p2", 19, d)) / 100.0).alias("yield_bps"))
             .join(I.supply_growth(day), DATE).join(I.vol_features(day), DATE).join(f("flow", "btc"), DATE).join(f("eth_flow", "eth"), DATE)
             .join(I.portfolio_drawdown(day.withColumn("nav", 3000 + F.col("btc")), "nav"), DATE))
    last = daily.withColumn(WEEK, F.trunc(DATE, "week")).withColumn("_rn", F.row_number().over(Window.partitionBy(WEEK).orderBy(F.desc(DATE)))).where("_rn = 1").drop("_rn")
    weekly = I.trend_features(last.withColumn("close", F.col("btc")))
    tokens = I.weekly_last(panel.withColumnRenamed("price", "close"), ["close"], (ENTITY,))
    wk = weekly.join(I.breadth_features(tokens), WEEK)
    pct = lambda c: (F.col(c) / roll(F.avg, c, 20, 20, _w()) - 1.0) * 100.0
    wk = wk.withColumns({"m1": roll(F.avg, "p3", 20, 20, _w()), "m2": roll(F.avg, "p4", 20, 20, _w()), "eq1": pct("p3"), "eq2": pct("p4"), "eq_rows": F.row_number().over(_w())})
    baskets = [chg(f"p{n}", 8, _w()) * 100.0 for n in range(1, 8)]
    n = sum((b.isNotNull().cast("int") for b in baskets), F.lit(0))
    return wk.withColumns({
        "diff_8w": F.col("median_8w") - F.col("ret_8w"), "eq1_slope": F.col("m1") - lag("m1", 1, _w()), "eq2_slope": F.col("m2") - lag("m2", 1, _w()),
        "funding": F.col("ret_4w"), "oi_pct": I.oi_percent(792_000 + F.col("ret_1w") * 4000, F.col("close")), "basis": 10 + F.col("ret_12w") / 20, "dxy": F.col("p1"),
        "dxy_chg": chg("p1", 4, _w()) * 5.0, "ai_ret": F.try_divide(sum((F.coalesce(b, F.lit(0.0)) for b in baskets), F.lit(0.0)), n) / 5.0,
        "mvrv_z": 2 + F.col("ret_12w") / 50, "coin_rank": (F.col("n_weeks") * 7 % 120 + 1).cast("int"), "issuance_bn": F.col("btc_f20") / 50, "tightening": F.col("slope") < 0,
        "purchases_bn": F.col("btc_f5") / 20, "credit_bps": F.col("ret_4w") * 3, "mnav_mstr": F.col("p5") / F.col("close"), "mnav_bmnr": F.col("p6") / F.col("close"), "mnav_purr": F.col("p7") / F.col("close")})


_D = "OVER (ORDER BY date ROWS BETWEEN {a} PRECEDING AND {b})"
_K20 = "OVER (ORDER BY week ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
_T20 = "OVER (PARTITION BY entity ORDER BY week ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


def _full(agg, x, w, n, m):
    return f"CASE WHEN count({x}) {w} >= {m} THEN {agg}({x}) {w} END"


FEATURES = BRAND + """, md AS (SELECT date, max(btc) AS btc, sum(stablecoin_supply) AS supply, sum(bridge_flow) / 1e6 AS flow, sum(coalesce(dex_volume, 0) - coalesce(deposits, 0)) / 1e6 AS eth_flow, """ + ", ".join(
    f"max(price) FILTER (entity = 'Brand#{n}') AS p{n}" for n in range(1, 8)) + f""" FROM panel JOIN btc USING (date) GROUP BY 1),
  ma AS (SELECT *, btc / lag(btc) OVER (ORDER BY date) - 1 AS r, row_number() OVER (ORDER BY date) AS rn FROM md WHERE btc IS NOT NULL),
  mb AS (SELECT *, stddev_samp(r) {_D.format(a=55, b='CURRENT ROW')} * (sqrt(365) * 100) AS vol_now, stddev_samp(r) {_D.format(a=111, b='56 PRECEDING')} * (sqrt(365) * 100) AS vol_before,
    (btc / lag(btc, 56) OVER (ORDER BY date) - 1) * 100 AS price_chg_8w, (supply / nullif(coalesce(lag(supply, 30) OVER (ORDER BY date), first_value(supply) OVER (ORDER BY date)), 0) - 1) * 100 AS g30,
    (supply / nullif(coalesce(lag(supply, 90) OVER (ORDER BY date), first_value(supply) OVER (ORDER BY date)), 0) - 1) * 100 AS g90, (p2 - lag(p2, 19) OVER (ORDER BY date)) / 100 AS yield_bps,
    sum(flow) {_D.format(a=4, b='CURRENT ROW')} AS btc_f5, sum(flow) {_D.format(a=19, b='CURRENT ROW')} AS btc_f20, sum(eth_flow) {_D.format(a=4, b='CURRENT ROW')} AS eth_f5, sum(eth_flow) {_D.format(a=19, b='CURRENT ROW')} AS eth_f20,
    ((3000 + btc) / max(3000 + btc) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) * 100 AS dd FROM ma),
  ml AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week FROM mb QUALIFY row_number() OVER (PARTITION BY date_trunc('week', date) ORDER BY date DESC) = 1),
  w1 AS (SELECT *, btc AS close, row_number() OVER (ORDER BY week) AS n_weeks, {_full('avg', 'btc', _K20, 20, 10)} AS sma, {_full('avg', 'p3', _K20, 20, 20)} AS m1, {_full('avg', 'p4', _K20, 20, 20)} AS m2 FROM ml),
  tw AS (SELECT entity, CAST(date_trunc('week', date) AS DATE) AS week, arg_max(price, date) FILTER (price IS NOT NULL) AS c FROM panel GROUP BY 1, 2),
  tx AS (SELECT *, {_full('avg', 'c', _T20, 20, 10)} AS s, {_full('max', 'c', _T20, 20, 20)} AS hi, {_full('min', 'c', _T20, 20, 20)} AS lo, (c / nullif(lag(c, 8) OVER (PARTITION BY entity ORDER BY week), 0) - 1) * 100 AS r8 FROM tw),
  br AS (SELECT week, count(*) FILTER (c > s) * 100.0::DOUBLE / nullif(count(*) FILTER (c IS NOT NULL AND s IS NOT NULL), 0) AS pct_above, count(*) FILTER (c >= hi * 0.99::DOUBLE) AS highs, count(*) FILTER (c <= lo * 1.01::DOUBLE) AS lows, median(r8) AS median_8w FROM tx GROUP BY 1),
  br2 AS (SELECT *, row_number() OVER (ORDER BY week) AS token_weeks, lag(lows) OVER (ORDER BY week) AS lows_prev FROM br),
  w2 AS (SELECT w1.*, br2.* EXCLUDE (week), CASE WHEN n_weeks >= 2 THEN sma - lag(sma) OVER k ELSE 0 END AS slope, (close / lag(close) OVER k - 1) * 100 AS ret_1w, (close / lag(close, 8) OVER k - 1) * 100 AS ret_8w,
    CASE WHEN n_weeks >= 5 THEN (close / lag(close, 4) OVER k - 1) * 100 ELSE 0 END AS ret_4w, CASE WHEN n_weeks >= 13 THEN (close / lag(close, 12) OVER k - 1) * 100 ELSE 0 END AS ret_12w,
    (p3 / m1 - 1) * 100 AS eq1, (p4 / m2 - 1) * 100 AS eq2, m1 - lag(m1) OVER k AS eq1_slope, m2 - lag(m2) OVER k AS eq2_slope, (p1 / lag(p1, 4) OVER k - 1) * 5 AS dxy_chg,
    """ + ", ".join(f"(p{n} / lag(p{n}, 8) OVER k - 1) * 100 AS b{n}" for n in range(1, 8)) + """ FROM w1 JOIN br2 USING (week) WINDOW k AS (ORDER BY week)),
  wf AS (SELECT *, rn AS supply_rows, rn AS vol_rows, n_weeks AS eq_rows, vol_now - CASE WHEN rn >= 113 THEN vol_before ELSE vol_now END AS vol_chg, median_8w - ret_8w AS diff_8w, ret_4w AS funding, ((792000 + ret_1w * 4000) * close) / (close * 19800000) * 100 AS oi_pct, 10 + ret_12w / 20 AS basis, p1 AS dxy,
    (""" + " + ".join(f"coalesce(b{n}, 0)" for n in range(1, 8)) + ") / nullif(" + " + ".join(f"(b{n} IS NOT NULL)::INT" for n in range(1, 8)) + """, 0) / 5 AS ai_ret, 2 + ret_12w / 50 AS mvrv_z, n_weeks * 7 % 120 + 1 AS coin_rank,
    btc_f20 / 50 AS issuance_bn, slope < 0 AS tightening, btc_f5 / 20 AS purchases_bn, ret_4w * 3 AS credit_bps, p5 / close AS mnav_mstr, p6 / close AS mnav_bmnr, p7 / close AS mnav_purr FROM w2)"""

_T, _B, _E, _S, _L, _M, _V = I.FAMILY_WEIGHTS
# name: (id, family, present, fallback, [(condition, score, on, choppy, off, top, bottom)])
SQL_RULES = {
    "btc_vs_sma": ("I02", _T, "close IS NOT NULL", 1, [("close > sma AND slope > 0", 2, 80, 20, 0, 0, 0), ("close > sma AND slope <= 0", 1, 30, 60, 10, 0, 0), ("close <= sma AND slope < 0", 0, 0, 30, 70, 0, 0), ("TRUE", 1, 20, 60, 20, 0, 0)]),
    "sma_slope": ("I03", _T, "close IS NOT NULL", 1, [("slope > 0", 2, 70, 30, 0, 0, 0), ("slope < 0 AND close < sma", 0, 0, 20, 70, 0, 10), ("TRUE", 1, 20, 60, 20, 0, 0)]),
    "ret_4w": ("I04", _T, "close IS NOT NULL", 1, [("ret_4w > 20", 2, 70, 20, 0, 10, 0), ("ret_4w > 0", 2, 70, 20, 0, 0, 0), ("ret_4w < -15", 0, 0, 30, 60, 0, 10), ("TRUE", 0, 0, 30, 60, 0, 0)]),
    "ret_12w": ("I05", _T, "close IS NOT NULL", 1, [("ret_12w > 30", 2, 70, 20, 0, 10, 0), ("ret_12w > 3", 2, 70, 20, 0, 0, 0), ("ret_12w >= -3", 1, 15, 70, 15, 0, 0), ("ret_12w < -20", 0, 0, 25, 65, 0, 10), ("TRUE", 0, 0, 25, 65, 0, 0)]),
    "pct_above": ("I06", _B, "pct_above IS NOT NULL", 0, [("pct_above > 85", 2, 75, 20, 0, 5, 0), ("pct_above > 60", 2, 75, 20, 0, 0, 0), ("pct_above >= 40", 1, 20, 65, 15, 0, 0), ("pct_above < 20", 0, 0, 25, 60, 0, 15), ("TRUE", 0, 0, 25, 60, 0, 0)]),
    "median_vs_btc": ("I07", _B, "diff_8w IS NOT NULL", 0, [("diff_8w > 15", 2, 70, 25, 0, 5, 0), ("diff_8w > 0", 2, 70, 25, 0, 0, 0), ("diff_8w >= -5", 1, 15, 60, 25, 0, 0), ("diff_8w < -15", 0, 0, 25, 60, 0, 15), ("TRUE", 0, 0, 25, 60, 0, 0)]),
    "highs_lows": ("I08", _B, "token_weeks >= 20", 0, [("highs > lows * 3", 2, 70, 20, 0, 10, 0), ("highs > lows", 2, 70, 20, 0, 0, 0), ("lows > highs AND token_weeks >= 21 AND lows_prev > lows", 1, 0, 40, 20, 0, 40), ("TRUE", 1, 0, 50, 30, 0, 20)]),
    "stablecoin": ("I09", _S, "supply_rows >= 31", 0, [("g30 > 0 AND g90 > 0", 2, 75, 25, 0, 0, 0), ("g30 > 0 OR g90 > 0", 1, 25, 60, 15, 0, 0), ("TRUE", 0, 0, 25, 65, 0, 10)]),
    "realised_vol": ("I10", _L, "vol_rows >= 57", 1, [("vol_chg < 0 AND price_chg_8w >= 0", 2, 40, 30, 0, 0, 30), ("vol_chg > 0 AND price_chg_8w < 0", 0, 0, 25, 60, 15, 0), ("TRUE", 1, 20, 60, 20, 0, 0)]),
    "funding": ("I11", _L, "funding IS NOT NULL", 1, [("funding > 12 AND funding < 15", 2, 60, 30, 0, 10, 0), ("funding > 0 AND funding < 15", 2, 60, 30, 0, 0, 0), ("funding >= 15", 1, 20, 30, 0, 50, 0), ("funding < 0", 0, 0, 30, 50, 0, 20), ("TRUE", 1, 30, 70, 0, 0, 0)]),
    "oi_to_mcap": ("I12", _L, "oi_pct IS NOT NULL", 1, [("oi_pct > 4.5 AND oi_pct <= 5", 2, 40, 50, 0, 10, 0), ("oi_pct BETWEEN 3 AND 5", 2, 40, 50, 0, 0, 0), ("oi_pct > 5", 1, 0, 30, 20, 50, 0), ("TRUE", 1, 20, 60, 20, 0, 0)]),
    "basis": ("I13", _L, "basis IS NOT NULL", 1, [("basis > 10 AND basis <= 12", 2, 40, 50, 0, 10, 0), ("basis BETWEEN 5 AND 12", 2, 40, 50, 0, 0, 0), ("basis > 15", 0, 0, 20, 20, 60, 0), ("basis < 5", 0, 0, 30, 50, 0, 20), ("TRUE", 1, 30, 50, 0, 20, 0)]),
    "equity": ("I14", _M, "eq_rows >= 20", 1, [("eq1 > 0 AND eq2 > 0 AND eq1_slope > 0 AND eq2_slope > 0", 2, 70, 30, 0, 0, 0), ("eq1 > 0 AND eq2 > 0", 1, 40, 50, 10, 0, 0), ("eq1 < 0 AND eq2 < 0", 0, 0, 30, 60, 0, 10), ("TRUE", 1, 20, 60, 20, 0, 0)]),
    "dxy": ("I15", _M, "dxy IS NOT NULL", 1, [("coalesce(dxy_chg, 0) <= 0", 2, 60, 35, 0, 0, 5), ("dxy_chg <= 1.5", 1, 15, 60, 25, 0, 0), ("TRUE", 0, 0, 30, 60, 10, 0)]),
    "real_yields": ("I16", _M, "yield_bps IS NOT NULL", 1, [("yield_bps <= 0", 2, 55, 40, 0, 0, 5), ("yield_bps <= 10", 1, 15, 60, 25, 0, 0), ("TRUE", 0, 0, 30, 55, 15, 0)]),
    "ai_bias": ("I17", _M, "ai_ret IS NOT NULL", 1, [("ai_ret > 20", 2, 60, 35, 0, 5, 0), ("ai_ret > 0", 2, 60, 35, 0, 0, 0), ("ai_ret >= -5", 1, 20, 60, 20, 0, 0), ("TRUE", 0, 0, 35, 50, 0, 15)]),
    "mvrv": ("I18", _V, "mvrv_z IS NOT NULL", 1, [("mvrv_z > 3.5", 0, 0, 20, 10, 70, 0), ("mvrv_z < 0.5", 2, 10, 20, 0, 0, 70), ("TRUE", 1, 15, 70, 15, 0, 0)]),
    "retail": ("I19", _V, "TRUE", 1, [("coin_rank <= 10", 0, 0, 20, 10, 70, 0), ("coin_rank <= 50", 1, 20, 40, 0, 40, 0), ("TRUE", 2, 20, 60, 20, 0, 0)]),
    "drawdown": ("I20", _V, "TRUE", 1, [("dd > -15", 2, 30, 60, 10, 0, 0), ("dd > -20", 1, 0, 30, 50, 0, 20), ("TRUE", 0, 0, 0, 80, 0, 20)]),
    "btc_etf": ("I21", _E, "btc_f5 IS NOT NULL", 2, [("btc_f5 > 2 AND btc_f20 > 0", 2, 70, 25, 0, 5, 0), ("btc_f5 > 0 AND btc_f20 > 0", 2, 70, 25, 0, 0, 0), ("btc_f5 < 0 AND btc_f20 < 0", 0, 0, 25, 65, 0, 10), ("TRUE", 1, 25, 55, 20, 0, 0)]),
    "eth_etf": ("I21", _E, "eth_f5 IS NOT NULL", 1, [("eth_f5 > 0 AND eth_f20 > 0", 2, 60, 35, 0, 5, 0), ("eth_f5 > 0 OR eth_f20 > 0", 1, 25, 60, 15, 0, 0), ("TRUE", 0, 0, 30, 55, 0, 15)]),
    "etf_response": ("I22", _E, "ret_1w IS NOT NULL AND btc_f5 IS NOT NULL", 1, [("btc_f5 > 0 AND ret_1w > 3", 2, 75, 20, 0, 5, 0), ("btc_f5 > 0", 1, 25, 40, 0, 35, 0), ("ret_1w < -3", 0, 0, 25, 60, 0, 15), ("TRUE", 1, 20, 60, 20, 0, 0)]),
    "issuance": ("I24", _E, "issuance_bn IS NOT NULL", 1, [("issuance_bn > 1 AND NOT coalesce(tightening, FALSE)", 2, 65, 30, 0, 5, 0), ("issuance_bn > 0", 1, 30, 55, 15, 0, 0), ("TRUE", 0, 0, 30, 55, 0, 15)]),
    "purchases": ("I24", _E, "purchases_bn IS NOT NULL", 1, [("purchases_bn > 0.5", 2, 70, 25, 0, 5, 0), ("purchases_bn > 0", 1, 30, 55, 15, 0, 0), ("TRUE", 0, 0, 25, 60, 0, 15)]),
    "credit": ("I24", _E, "credit_bps IS NOT NULL", 1, [("credit_bps <= 25", 2, 60, 35, 0, 5, 0), ("credit_bps <= 100", 1, 0, 50, 30, 0, 20), ("TRUE", 0, 0, 20, 65, 0, 15)]),
}
for _firm, _top in (("mstr", 1.2), ("bmnr", 1.15), ("purr", 1.15)):
    SQL_RULES[f"mnav_{_firm}"] = ("I23", _E, f"mnav_{_firm} IS NOT NULL", 0, [(f"mnav_{_firm} > 2", 2, 65, 25, 0, 10, 0), (f"mnav_{_firm} > {_top}", 2, 65, 25, 0, 0, 0), (f"mnav_{_firm} > 1", 1, 25, 55, 20, 0, 0), ("TRUE", 0, 0, 25, 60, 0, 15)])


def rule_sql(name: str) -> str:
    _, fam, present, fallback, rows = SQL_RULES[name]
    case = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rows) + " END"
    votes = ", ".join(f"CAST(CASE WHEN {present} THEN {case(i)} ELSE {100 if v == 'choppy' else 0} END AS DOUBLE) AS {v}" for i, v in enumerate(I.VOTES, 2))
    return f"SELECT week, dd, '{fam}' AS family, '{name}' AS key, CAST(CASE WHEN {present} THEN {case(1)} ELSE {fallback} END AS INT) AS score, {votes} FROM wf"


def _one(name):
    def run(spark, sf):
        return I.indicator_rows(features(spark, sf), [name]).select(WEEK, "score", *I.VOTES)

    return run


for _name, (_id, *_rest) in SQL_RULES.items():
    query(f"{_id}_{_name}", FEATURES + f" SELECT week, score, {', '.join(I.VOTES)} FROM ({rule_sql(_name)})")(_one(_name))


@query("I01_weekly_resample", BRAND + " SELECT CAST(date_trunc('week', date) AS DATE) AS week, arg_max(btc, date) AS close FROM btc WHERE btc IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return I.weekly_last(T.market_close(T.brand_daily(spark, sf), T.bounds(spark, sf)), ["btc"]).select(WEEK, F.col("btc").alias("close"))


@query("I25_leverage_precedence", FEATURES + """ SELECT week, round(coalesce(CASE WHEN n_weeks % 3 = 0 THEN ret_1w END, last_value(CASE WHEN n_weeks % 5 = 0 THEN ret_4w END IGNORE NULLS) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) + 0.0::DOUBLE AS funding,
  round(oi_pct, 6) AS oi_pct FROM wf""")
def _(spark, sf):
    f = features(spark, sf)
    live, manual = F.when(F.col("n_weeks") % 3 == 0, F.col("ret_1w")), F.when(F.col("n_weeks") % 5 == 0, F.col("ret_4w"))
    return f.select(WEEK, r6(I.with_precedence(live, manual)).alias("funding"), r6("oi_pct").alias("oi_pct"))


@query("I26_four_week_changes", FEATURES + " SELECT week, round(dxy_chg, 6) + 0.0::DOUBLE AS dxy_chg, round(yield_bps, 6) + 0.0::DOUBLE AS yield_bps FROM wf")
def _(spark, sf):
    return features(spark, sf).select(WEEK, r6("dxy_chg").alias("dxy_chg"), r6("yield_bps").alias("yield_bps"))


@query("I27_fallback_rows", FEATURES + " SELECT week, key, score, choppy FROM (" + " UNION ALL ".join(f"SELECT week, key, score, choppy FROM ({rule_sql(n)})" for n in ("pct_above", "median_vs_btc", "highs_lows", "stablecoin", "realised_vol", "real_yields", "equity", "ai_bias")) + ") WHERE choppy = 100")
def _(spark, sf):
    keys = ["pct_above", "median_vs_btc", "highs_lows", "stablecoin", "realised_vol", "real_yields", "equity", "ai_bias"]
    label = F.create_map(*[x for k, n in zip(keys, ("% tokens above 20w SMA", "Median token vs BTC, 8w", "New highs vs new lows", "Stablecoin supply growth", "8-week realised volatility", "Real yields", "SPY / QQQ trend", "AI macro bias")) for x in (F.lit(n), F.lit(k))])
    return I.indicator_rows(saved(features(spark, sf), "features"), keys).where("choppy = 100").select(WEEK, label[F.col("indicator")].alias("key"), "score", "choppy")


def indicators(spark, sf):
    """Every indicator of every week, written once: families, override and weeks all read it."""
    return saved(I.indicator_rows(saved(features(spark, sf), "features")), "indicators")


ALL_ROWS = ", ir AS (" + " UNION ALL ".join(rule_sql(n) for n in SQL_RULES) + ")"
FAM_SQL = FEATURES + ALL_ROWS + """, fa AS (SELECT week, family, count(*) FILTER (score = 2) AS indicators_met, count(*) AS indicators_total, round_even(sum(score) * 100.0::DOUBLE / (2 * count(*)), 1) AS family_score,
  sum(score) * 100.0::DOUBLE / (2 * count(*)) AS fs, """ + ", ".join(f"avg({v}) AS a_{v}, round_even(avg({v}), 1) AS {v}" for v in I.VOTES) + " FROM ir GROUP BY 1, 2)"
_WT = "CASE family " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in I.FAMILY_WEIGHTS.items()) + " END"


@query("I30_family_scores", FAM_SQL + f""" SELECT week, family, {_WT} AS weight, indicators_met, indicators_total, family_score, {', '.join(I.VOTES)},
  family || ' is ' || CASE WHEN fs >= 75 THEN 'strongly supportive' WHEN fs >= 50 THEN 'moderately supportive' WHEN fs >= 25 THEN 'mixed' ELSE 'weak' END || ' (' || indicators_met || '/' || indicators_total || ' met); primary lean is ' ||
  CASE WHEN a_risk_on >= a_choppy AND a_risk_on >= a_risk_off THEN 'risk-on' WHEN a_choppy >= a_risk_off THEN 'choppy' ELSE 'risk-off' END || '.' AS read FROM fa""")
def _(spark, sf):
    return I.family_scores(indicators(spark, sf))


_CLS = FAM_SQL + ", pw AS (SELECT week, " + ", ".join(f"round(sum({v} * {_WT} / 100.0::DOUBLE), 9) AS {v}" for v in I.VOTES) + """ FROM fa GROUP BY 1),
  cl AS (SELECT week, CASE WHEN local_top >= 40 AND risk_on >= 50 THEN 'Local top' WHEN local_bottom >= 40 AND risk_off >= 40 THEN 'Local bottom' WHEN round_even(dd, 1) <= -15 OR risk_off >= 65 THEN 'Risk-off'
    WHEN risk_on >= 65 AND risk_on - choppy >= 10 AND risk_on - risk_off >= 10 THEN 'Risk-on' ELSE 'Choppy' END AS regime, """ + ", ".join(f"round_even({v}, 1) AS {v}_score" for v in I.VOTES) + " FROM pw JOIN (SELECT week, dd FROM wf) USING (week))"
_SC = ", ".join(f"{v}_score" for v in I.VOTES)


@query("I28_classifier", _CLS + f" SELECT week, regime, {_SC} FROM cl")
def _(spark, sf):
    return I.classify(indicators(spark, sf))


@query("I29_weekly_history", _CLS + f" SELECT week, close AS btc_close, regime, {_SC}, coalesce(lead(week) OVER (ORDER BY week), week + 7) AS end_date FROM cl JOIN (SELECT week, close, n_weeks FROM wf) USING (week) WHERE n_weeks >= 21")
def _(spark, sf):
    f = saved(features(spark, sf), "features")
    return I.weekly_history(I.classify(saved(I.indicator_rows(f), "indicators")), f)
