"""One query per signal (F, M, L, R) over the brand panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.catalog.base import BRAND, query, r6
from daygrid.catalog.cross_section import ic_sql, names, rank_z_sql
from daygrid.catalog.panel import DEMO_PERIODS
from daygrid.functions.rolling import DATE, ENTITY
from daygrid.operators import cross_section as X
from daygrid.operators import panel as P
from daygrid.operators import research as W
from daygrid.plans import signals as S
from daygrid.sources import tables as T


def _roll(agg: str, x: str, n: int, m: int) -> str:
    w = f"OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} >= {m} THEN {agg}({x}) {w} END"


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY entity ORDER BY date)"


def _chg(x: str, k: int) -> str:
    return f"{x} / nullif({_lag(x, k)}, 0) - 1"


_S1 = ", s1 AS (SELECT panel.*, btc, " + ", ".join(
    f"{_roll('avg', m, 7, 3)} AS {m}_s" for m in ("revenue", "fees", "gross_profit", "addresses", "stablecoin_supply", "dex_volume")
) + f", {_roll('avg', 'revenue', 7, 7)} AS rev_f, {_roll('avg', 'fees', 7, 7)} AS fees_f, {_chg('price', 1)} AS r1, {_chg('price', 7)} AS r7, {_chg('price', 21)} AS r21, {_chg('btc', 21)} AS b21 FROM panel JOIN btc USING (date))"
_S2 = f", s2 AS (SELECT *, {_chg('revenue_s', 7)} AS gw, mcap / (fees_f * 365 + 1e-8) AS cf, mcap / (rev_f * 365 + 1e-8) AS cr, {_chg('revenue_s', 14)} AS g14, {_chg('addresses_s', 14)} AS u14 FROM s1)"
SIGNAL_BASE = BRAND + _S1 + _S2

_PEAK = "max(price) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_B91 = "OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 90 PRECEDING AND CURRENT ROW)"

# signal -> (query id, decimals compared, oracle expression over s2)
EXPR = {
    "revenue": ("F01", 4, "revenue_s"),
    "revenue_growth": ("F02", 6, "g14"),
    "revenue_growth_4w": ("F03", 6, _chg("revenue_s", 28)),
    "revenue_stability": ("F04", 6, f"1 / ({_roll('stddev_samp', 'gw', 91, 30)} + 1e-8)"),
    "inverted_active_rev": ("F06", 6, "-((coalesce(tips, 0) + coalesce(priority, 0) + coalesce(other_fees, 0)) / (revenue + 1e-8))"),
    "gross_profit": ("F07", 4, "gross_profit_s"),
    "protocol_margin": ("F08", 4, "revenue - issuance"),
    "trading_fees": ("F09", 4, "fees_s"),
    "mc_fees_reversion": ("F10", 5, f"-((cf - {_roll('avg', 'cf', 182, 60)}) / ({_roll('stddev_samp', 'cf', 182, 60)} + 1e-8))"),
    "fdv_revenue": ("F11", 6, "-(fdv / (rev_f * 365 + 1e-8))"),
    "payback_period": ("F12", 6, "-cr"),
    "dau_growth": ("F14", 6, "u14"),
    "dau_growth_4w": ("F15", 6, _chg("addresses_s", 28)),
    "rev_per_address": ("F17", 4, "revenue_s / (addresses_s + 1e-8)"),
    "buyback_vs_issuance": ("F18", 6, "burn / (issuance + 1e-8)"),
    "staked_ratio": ("F19", 6, "staked / (supply + 1e-8)"),
    "vol_adj_momentum": ("M01", 6, f"r21 / ({_roll('stddev_samp', 'r1', 21, 10)} * sqrt(365) + 1e-8)"),
    "relative_strength": ("M02", 6, "r21 - b21"),
    "drawdown_from_ath": ("M03", 6, f"(price - {_PEAK}) / ({_PEAK} + 1e-8)"),
    "momentum_breadth": ("M04", 6, f"CASE WHEN count(*) {_B91} >= 39 THEN avg(CASE WHEN r7 > 0 THEN 1.0::DOUBLE ELSE 0 END) {_B91} END"),
    "short_term_reversal": ("M05", 6, "-r7"),
    "realised_vol": ("M06", 6, f"-({_roll('stddev_samp', 'r1', 28, 14)} * sqrt(365))"),
    "size": ("M07", None, "-mcap"),
    "stablecoin_growth": ("L01", 6, _chg("stablecoin_supply_s", 14)),
    "dex_volume_growth": ("L02", 6, _chg("dex_volume_s", 14)),
    "bridge_net_flow": ("L03", 4, _roll("avg", "bridge_flow", 14, 5)),
    "oi_change": ("L04", 6, _chg("open_interest", 7)),
}


def _one(signal: str, k: int):
    def run(spark, sf):
        out = S.signal_frame(T.brand_panel(spark, sf, True), [signal], names(spark, sf))
        return out.select(ENTITY, DATE, (F.col(signal) if k is None else r6(signal, k)).alias("value"))

    return run


for _signal, (_id, _k, _expr) in EXPR.items():
    _v = _expr if _k is None else f"round({_expr}, {_k}) + 0.0::DOUBLE"
    query(f"{_id}_{_signal}", SIGNAL_BASE + f" SELECT entity, date, {_v} AS value FROM s2")(_one(_signal, _k))

_CORR91 = """, pr AS (SELECT entity, date, corr(revenue, btc) OVER w AS c, count(*) OVER w AS n FROM panel JOIN btc USING (date) WHERE revenue IS NOT NULL AND btc IS NOT NULL
  WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 90 PRECEDING AND CURRENT ROW))"""
query("F05_revenue_btc_corr", BRAND + _CORR91 + """ SELECT entity, date, round(CASE WHEN n >= 91 THEN -c END, 5) + 0.0::DOUBLE AS value FROM panel LEFT JOIN pr USING (entity, date)""")(
    _one("revenue_btc_corr", 5))
query("F13_implied_growth", SIGNAL_BASE + """, md AS (SELECT date, median(cr) AS m FROM s2 GROUP BY 1)
  SELECT entity, date, round(-(cr / nullif(m, 0)), 6) + 0.0::DOUBLE AS value FROM s2 JOIN md USING (date)""")(_one("implied_growth", 6))
query("F16_growth_composite", SIGNAL_BASE + f"""
  SELECT entity, date, round({rank_z_sql('g14', 'date')} + {rank_z_sql('u14', 'date')}, 6) + 0.0::DOUBLE AS value FROM s2""")(_one("growth_composite", 6))

ALL_SQL = SIGNAL_BASE + _CORR91 + ", md AS (SELECT date, median(cr) AS m FROM s2 GROUP BY 1), allsig AS (SELECT entity, date, " + ", ".join(
    f"{e} AS {s}" for s, (_, _, e) in EXPR.items() if s not in ("revenue", "gross_profit")
) + f""", revenue_s AS revenue, gross_profit_s AS gross_profit, CASE WHEN n >= 91 THEN -c END AS revenue_btc_corr, -(cr / nullif(m, 0)) AS implied_growth,
  {rank_z_sql('g14', 'date')} + {rank_z_sql('u14', 'date')} AS growth_composite
  FROM s2 JOIN md USING (date) LEFT JOIN pr USING (entity, date))"""


def _family(family: str):
    ids = S.names_of(family)

    def run(spark, sf):
        wide = S.signal_frame(T.brand_panel(spark, sf, True), ids, names(spark, sf))
        return S.long_signals(wide, ids).groupBy("signal").agg(
            F.count("*").alias("n"), F.min(DATE).alias("first_date"), F.max(DATE).alias("last_date"), r6(F.avg(F.signum("raw")), 4).alias("mean_sign"))

    sql = ALL_SQL + ", l AS (" + " UNION ALL ".join(f"SELECT '{s}' AS signal, date, {s} AS raw FROM allsig WHERE {s} IS NOT NULL" for s in ids) + """)
      SELECT signal, count(*) AS n, min(date) AS first_date, max(date) AS last_date, round(avg(sign(raw)::DOUBLE), 4) + 0.0::DOUBLE AS mean_sign FROM l GROUP BY 1"""
    return sql, run


for _name, _fam in (("F20_all_fundamentals", "fundamentals"), ("M08_all_momentum", "momentum"), ("L05_all_flows", "flows")):
    _sql, _run = _family(_fam)
    query(_name, _sql)(_run)


_LAGGED = ", lg AS (SELECT entity, date, mcap, " + ", ".join(f"{_lag(m, 1)} AS {m}" for m in S.CHANGE_METRICS) + " FROM panel)"


@query("R01_metric_changes", BRAND + _LAGGED + " SELECT entity, date, " + ", ".join(
    f"round({_chg(m, k)}, 9) + 0.0::DOUBLE AS {m}_chg_{k // 7}w" for m in S.CHANGE_METRICS for k in (28, 56)) + " FROM lg")
def _(spark, sf):
    cols = [f"{m}_chg_{k}w" for m in S.CHANGE_METRICS for k in (4, 8)]
    return S.research_signals(T.brand_panel(spark, sf)).select(ENTITY, DATE, *[r6(c, 9).alias(c) for c in cols])


@query("R02_metric_to_market_cap", BRAND + _LAGGED + " SELECT entity, date, " + ", ".join(f"round({m} / nullif(mcap, 0), 6) AS {m}_to_mcap" for m in S.RATIO_METRICS) + " FROM lg")
def _(spark, sf):
    cols = [f"{m}_to_mcap" for m in S.RATIO_METRICS]
    return S.research_signals(T.brand_panel(spark, sf)).select(ENTITY, DATE, *[r6(c).alias(c) for c in cols])


_PERIOD_SQL = """CASE WHEN date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' THEN 'Train' WHEN date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 'Validation'
  WHEN date >= DATE '2000-02-01' THEN 'Test' ELSE 'OutOfSampleGap' END"""


@query("R03_stable_signals", BRAND + _LAGGED + ", sg AS (SELECT entity, date, " + ", ".join(
    f"{_chg(m, 28)} AS {m}_chg_4w" for m in S.CHANGE_METRICS) + """ FROM lg), lab AS (SELECT entity, date, lead(price, 15) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret FROM panel
    WINDOW e AS (PARTITION BY entity ORDER BY date)),
  l AS (SELECT date, signal, z, ret FROM (UNPIVOT sg ON COLUMNS(* EXCLUDE (entity, date)) INTO NAME signal VALUE z) JOIN lab USING (entity, date)),
  i AS (""" + ic_sql("l", "z", "ret", "date, signal").replace("PARTITION BY date, signal ORDER BY", "PARTITION BY date, signal ORDER BY") + f"""),
  m AS (SELECT signal, {_PERIOD_SQL} AS period, avg(ic) AS ic FROM i WHERE ic IS NOT NULL GROUP BY 1, 2),
  w AS (SELECT signal, max(ic) FILTER (period = 'Train') AS a, max(ic) FILTER (period = 'Validation') AS b, max(ic) FILTER (period = 'Test') AS c FROM m GROUP BY 1)
  SELECT signal, round(a, 6) AS "Train", round(b, 6) AS "Validation", round(c, 6) AS "Test", round(least(a, b, c), 6) AS weakest FROM w WHERE a > 0 AND b > 0 AND c > 0""")
def _(spark, sf):
    p = T.brand_panel(spark, sf)
    cols = [f"{m}_chg_4w" for m in S.CHANGE_METRICS]
    long = S.research_signals(p).unpivot([ENTITY, DATE], cols, "signal", "z")
    lab = W.label_returns(p).select(ENTITY, DATE, "ret_14")
    ic = W.ic_over_dates(long, lab, None, "ret_14", ["signal"], names(spark, sf))
    table = ic.groupBy("signal", P.period_label(DATE, DEMO_PERIODS).alias("period")).agg(F.avg("ic").alias("mean_ic"))
    out = S.stable_signals(table)
    return out.select("signal", *[r6(c).alias(c) for c in ("Train", "Validation", "Test", "weakest")])


@query("W06_revenue_growth_ic", SIGNAL_BASE + """, lab AS (SELECT entity, date, g14, lead(price, 15) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret FROM s2
    WINDOW e AS (PARTITION BY entity ORDER BY date)),
  zz AS (SELECT date, ret, """ + rank_z_sql("g14", "date") + """ AS z FROM lab)
  SELECT date, round(ic, 6) AS ic, n_pairs FROM (""" + ic_sql("zz", "z", "ret") + ") WHERE ic IS NOT NULL")
def _(spark, sf):
    n = names(spark, sf)
    lab = W.label_returns(T.brand_panel(spark, sf), horizons=(14,))
    z = X.rank_z(S.signal_frame(lab, ["revenue_growth"], n, ("ret_14",)), "revenue_growth", [DATE], "z", n, winsor=True)
    ic = X.rank_ic(z, "z", "_k_ret_14", [DATE], n).where("ic IS NOT NULL")
    return ic.select(DATE, r6("ic").alias("ic"), "n_pairs")
