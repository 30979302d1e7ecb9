"""Cross-sectional primitives (X) over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.catalog.base import BRAND, MASTER, SUPPLIER, query, r6
from daygrid.functions.rolling import DATE, ENTITY, by_entity, chg, pct_chg, ratio
from daygrid.operators import cross_section as X
from daygrid.operators import research as W
from daygrid.sources import tables as T
from daygrid.sources.store import saved


def names(spark, sf) -> int:
    return X.count_names(T.brands(spark, sf))


def supplier_names(spark, sf) -> int:
    return X.count_names(T.suppliers(spark, sf))


# Oracle text: average rank and rank z-score of column x within a partition.
def rank_z_sql(x: str, by: str, where: str = "TRUE") -> str:
    n = f"count({x}) OVER (PARTITION BY {by})"
    return f"""CASE WHEN {x} IS NOT NULL AND {n} >= 3 THEN
      (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::DOUBLE
       - ({n} + 1) / 2.0::DOUBLE) / sqrt(({n} * {n} - 1) / 12.0::DOUBLE) END"""


_WINSOR = SUPPLIER + """, q AS (SELECT date, quantile_cont(revenue, 0.01::DOUBLE) AS lo, quantile_cont(revenue, 0.99::DOUBLE) AS hi FROM panel GROUP BY 1)"""


@query("X01_winsorise", _WINSOR + """ SELECT entity, date, round(CASE WHEN revenue IS NOT NULL THEN least(greatest(revenue, lo), hi) END, 3) AS revenue
  FROM panel JOIN q USING (date)""")
def _(spark, sf):
    p = T.supplier_panel(spark, sf).select(ENTITY, DATE, "revenue")
    return X.winsorise(p, "revenue", [DATE], "w", supplier_names(spark, sf)).select(ENTITY, DATE, r6("w", 3).alias("revenue"))


@query("X01_winsorise_split_groups", _WINSOR + """ SELECT entity, date, round(CASE WHEN revenue IS NOT NULL THEN least(greatest(revenue, lo), hi) END, 3) AS revenue
  FROM panel JOIN q USING (date)""")
def _(spark, sf):
    p = saved(T.supplier_panel(spark, sf).select(ENTITY, DATE, "revenue"), "panel")
    return X.winsorise(p, "revenue", [DATE], "w").select(ENTITY, DATE, r6("w", 3).alias("revenue"))


@query("X02_rank_z", BRAND + f" SELECT entity, date, round({rank_z_sql('issuance', 'date')}, 6) AS z FROM panel")
def _(spark, sf):
    p = T.brand_panel(spark, sf).select(ENTITY, DATE, "issuance")
    return X.rank_z(p, "issuance", [DATE], "z", names(spark, sf)).select(ENTITY, DATE, r6("z").alias("z"))


@query("X02_rank_z_split_groups", BRAND + f" SELECT entity, date, round({rank_z_sql('issuance', 'date')}, 6) AS z FROM panel")
def _(spark, sf):
    p = saved(T.brand_panel(spark, sf).select(ENTITY, DATE, "issuance"), "panel")
    return X.rank_z(p, "issuance", [DATE], "z").select(ENTITY, DATE, r6("z").alias("z"))


@query("X02_rank_z_whole_table", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round({rank_z_sql('l_quantity', 'l_returnflag')}, 6) AS z FROM lineitem")
def _(spark, sf):
    x = T.table(spark, sf, "lineitem")
    return X.rank_z(x, "l_quantity", ["l_returnflag"], "z").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r6("z").alias("z"))


@query("X03_rank_z_panel", _WINSOR + f""", v AS (SELECT entity, date, CASE WHEN revenue IS NOT NULL THEN least(greatest(revenue, lo), hi) END AS x FROM panel JOIN q USING (date))
  SELECT entity, date, round({rank_z_sql('x', 'date')}, 6) AS z FROM v""")
def _(spark, sf):
    p = T.supplier_panel(spark, sf).select(ENTITY, DATE, "revenue")
    # winsorised first whatever the number of names, so that the clip is exercised at every scale
    n = supplier_names(spark, sf)
    w = X.winsorise(p, "revenue", [DATE], "w", n)
    return X.rank_z(w, "w", [DATE], "z", n).select(ENTITY, DATE, r6("z").alias("z"))


# Oracle text: one IC row per date for columns s and r of a relation.
def ic_sql(rel: str, s: str, r: str, by: str = "date") -> str:
    return f"""SELECT {by}, CASE WHEN count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS ic, count(*) AS n_pairs FROM (
      SELECT {by}, rank() OVER (PARTITION BY {by} ORDER BY {s}) + (count(*) OVER (PARTITION BY {by}, {s}) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY {by} ORDER BY {r}) + (count(*) OVER (PARTITION BY {by}, {r}) - 1) / 2.0::DOUBLE AS b
      FROM {rel} WHERE {s} IS NOT NULL AND {r} IS NOT NULL) GROUP BY {by}"""


LABELS = BRAND + """, lab AS (SELECT *, lead(price, 8) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_7,
    lead(price, 15) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_14, lead(price, 31) OVER e / nullif(lead(price, 1) OVER e, 0) - 1 AS ret_30
  FROM panel WINDOW e AS (PARTITION BY entity ORDER BY date))"""


@query("X04_rank_ic", LABELS + f" SELECT date, round(ic, 6) AS ic, n_pairs FROM ({ic_sql('lab', 'issuance', 'ret_14')})")
def _(spark, sf):
    lab = W.label_returns(T.brand_panel(spark, sf))
    return X.rank_ic(lab, "issuance", "ret_14", [DATE], names(spark, sf)).withColumn("ic", r6("ic"))


@query("X04_rank_ic_split_groups", LABELS + f" SELECT date, round(ic, 6) AS ic, n_pairs FROM ({ic_sql('lab', 'issuance', 'ret_14')})")
def _(spark, sf):
    lab = saved(W.label_returns(T.brand_panel(spark, sf)).select(DATE, "issuance", "ret_14"), "labels")
    return X.rank_ic(lab, "issuance", "ret_14", [DATE]).withColumn("ic", r6("ic"))


@query("X05_rolling_rank_ic", LABELS + f""", i AS ({ic_sql('lab', 'revenue', 'ret_7')})
  SELECT date, round(CASE WHEN count(ic) OVER w >= 6 THEN avg(ic) OVER w END, 6) AS rolling_ic FROM i
  WINDOW w AS (ORDER BY date ROWS BETWEEN 12 PRECEDING AND CURRENT ROW)""")
def _(spark, sf):
    ic = X.rank_ic(W.label_returns(T.brand_panel(spark, sf)), "revenue", "ret_7", [DATE], names(spark, sf))
    return X.rolling_ic(ic).select(DATE, r6("rolling_ic").alias("rolling_ic"))


@query("X06_signal_diagnostics", LABELS + f""", i AS ({ic_sql('lab', 'revenue', 'ret_30')})
  SELECT round(avg(ic), 4) AS mean_ic, round(stddev_pop(ic), 4) AS ic_std, round(avg(ic) / stddev_pop(ic), 4) AS ic_ir,
    round(avg(CAST(ic > 1e-12 AS DOUBLE)), 4) AS pct_positive, count(ic) AS n_periods FROM i""")
def _(spark, sf):
    ic = X.rank_ic(W.label_returns(T.brand_panel(spark, sf)), "revenue", "ret_30", [DATE], names(spark, sf))
    return X.ic_summary(ic, [])


_SPEARMAN = BRAND + """, c AS (SELECT revenue, fees, addresses, issuance FROM panel WHERE revenue IS NOT NULL AND fees IS NOT NULL AND addresses IS NOT NULL AND issuance IS NOT NULL),
  k AS (SELECT """ + ", ".join(f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE AS {x}" for x in ("revenue", "fees", "addresses", "issuance")) + """ FROM c),
  p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS left_signal, '{b}' AS right_signal, corr({a}, {b}) AS corr FROM k"
    for a, b in (("revenue", "fees"), ("revenue", "addresses"), ("revenue", "issuance"), ("fees", "addresses"), ("fees", "issuance"), ("addresses", "issuance"))) + ")"


def _pairs(spark, sf):
    p = saved(T.brand_panel(spark, sf).select(ENTITY, DATE, "revenue", "fees", "addresses", "issuance"), "panel")
    return X.pairwise_spearman(p, ["revenue", "fees", "addresses", "issuance"], [ENTITY, DATE])


@query("X07_pairwise_spearman", _SPEARMAN + " SELECT left_signal, right_signal, round(corr, 6) AS corr FROM p")
def _(spark, sf):
    return _pairs(spark, sf).withColumn("corr", r6("corr"))


@query("X08_high_correlations", _SPEARMAN + " SELECT left_signal, right_signal, round(corr, 6) AS corr FROM p WHERE abs(corr) > 0.12")
def _(spark, sf):
    return X.high_correlations(_pairs(spark, sf)).withColumn("corr", r6("corr"))


@query("X09_minimum_observations", BRAND + """ SELECT entity, count(*) FILTER (bridge_flow <> 0) AS n_nonzero, count(*) FILTER (bridge_flow <> 0) >= 8 AS enough FROM daily GROUP BY 1""")
def _(spark, sf):
    return X.min_observations(T.brand_daily(spark, sf), "bridge_flow", [ENTITY])


@query("X10_daily_change", BRAND + """ SELECT entity, date, round((price / nullif(lag(price) OVER w, 0) - 1) * 100, 6) AS d1, round((price / nullif(lag(price, 7) OVER w, 0) - 1) * 100, 6) AS d7
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date)""")
def _(spark, sf):
    return T.brand_panel(spark, sf).select(ENTITY, DATE, r6(pct_chg("price", 1)).alias("d1"), r6(pct_chg("price", 7)).alias("d7"))


@query("X11_growth_ratio", BRAND + """, s AS (SELECT entity, date, CASE WHEN count(revenue) OVER w >= 3 THEN avg(revenue) OVER w END AS s FROM panel
    WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
  SELECT entity, date, round((s / nullif(lag(s, 14) OVER e, 0) - 1) / nullif(s / nullif(lag(s, 28) OVER e, 0) - 1, 0), 4) AS growth_ratio
  FROM s WINDOW e AS (PARTITION BY entity ORDER BY date)""")
def _(spark, sf):
    p = T.brand_panel(spark, sf).select(ENTITY, DATE, "revenue")
    return X.growth_ratio(p, "revenue", "g").select(ENTITY, DATE, r6("g", 4).alias("growth_ratio"))


@query("X12_safe_divide", BRAND + " SELECT entity, date, round(fees / nullif(burn, 0), 6) AS ratio FROM daily")
def _(spark, sf):
    return T.brand_daily(spark, sf).select(ENTITY, DATE, r6(ratio("fees", "burn")).alias("ratio"))


@query("X13_return_over_benchmark", BRAND + """ SELECT entity, date, round((price / nullif(lag(price) OVER w, 0) - 1 - (btc / lag(btc) OVER w - 1)) * 100, 6) AS over_btc
  FROM panel JOIN btc USING (date) WINDOW w AS (PARTITION BY entity ORDER BY date)""")
def _(spark, sf):
    return T.brand_panel(spark, sf, True).select(ENTITY, DATE, r6(X.over_benchmark("price", "btc")).alias("over_btc"))


def _rolling_corr_sql(window: int, least: int) -> str:
    return f""", x AS (SELECT entity, date, price / nullif(lag(price) OVER w, 0) - 1 AS a, btc / lag(btc) OVER w - 1 AS b FROM panel JOIN btc USING (date)
    WINDOW w AS (PARTITION BY entity ORDER BY date)),
  y AS (SELECT *, corr(a, b) OVER o AS c, count(*) OVER o AS n, count(*) OVER (PARTITION BY entity) AS t FROM x WHERE a IS NOT NULL AND b IS NOT NULL
    WINDOW o AS (PARTITION BY entity ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW))
  SELECT entity, date, round(CASE WHEN n >= {least} AND t >= {least} THEN c END, 5) AS corr FROM x LEFT JOIN y USING (entity, date)"""


@query("X14_rolling_corr_benchmark", BRAND + _rolling_corr_sql(30, 15))
def _(spark, sf):
    p = T.brand_panel(spark, sf, True).select(ENTITY, DATE, chg("price", 1).alias("a"), chg("btc", 1).alias("b"))
    return X.rolling_corr_observed(p, "a", "b", 30, 15, "c").select(ENTITY, DATE, r6("c", 5).alias("corr"))


@query("X15_peer_group_relative", BRAND + f""", x AS (SELECT entity, date, category, fdv / nullif(revenue, 0) AS m FROM panel JOIN ({MASTER}) USING (entity)),
  g AS (SELECT date, category, median(m) AS md FROM x GROUP BY 1, 2)
  SELECT entity, date, round((m / nullif(md, 0) - 1) * 100, 5) AS implied_growth FROM x JOIN g USING (date, category)""")
def _(spark, sf):
    cats = T.brand_master(spark, sf).select(ENTITY, "category")
    p = T.brand_panel(spark, sf).select(ENTITY, DATE, ratio("fdv", "revenue").alias("m")).join(cats, ENTITY)
    return X.versus_group_median(p, "m", [DATE, "category"], "v", names(spark, sf)).select(ENTITY, DATE, r6("v", 5).alias("implied_growth"))


BUCKET_SQL = """CASE WHEN {x} >= 0 AND {x} < 1e8 THEN 'Micro' WHEN {x} >= 1e8 AND {x} < 5e8 THEN 'Small' WHEN {x} >= 5e8 AND {x} < 1e9 THEN 'Mid'
  WHEN {x} >= 1e9 AND {x} < 5e9 THEN 'Large' WHEN {x} >= 5e9 THEN 'Mega' ELSE 'Unknown' END"""


@query("X16_value_buckets", BRAND + f" SELECT {BUCKET_SQL.format(x='mcap * 40')} AS bucket, count(*) AS n, count(mcap) AS n_valued FROM panel GROUP BY 1")
def _(spark, sf):
    p = T.brand_panel(spark, sf)
    return p.groupBy(X.value_bucket(F.col("mcap") * 40).alias("bucket")).agg(F.count("*").alias("n"), F.count("mcap").alias("n_valued"))


@query("X17_grouped_winsorise", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01::DOUBLE) AS lo, quantile_cont(l_extendedprice, 0.99::DOUBLE) AS hi
    FROM lineitem GROUP BY 1)
  SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(least(greatest(l_extendedprice, lo), hi), 4) AS clipped, round(least(l_extendedprice, hi), 4) AS capped
  FROM lineitem JOIN q USING (l_returnflag)""")
def _(spark, sf):
    x = T.table(spark, sf, "lineitem")
    both = X.winsorise(x, "l_extendedprice", ["l_returnflag"], "clipped")
    upper = X.winsorise(both, "l_extendedprice", ["l_returnflag"], "capped", lower=None)
    return upper.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", r6("clipped", 4).alias("clipped"), r6("capped", 4).alias("capped"))


_PEER = """WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25::DOUBLE) AS a, median(p_retailprice) AS m, quantile_cont(p_retailprice, 0.75::DOUBLE) AS b,
    stddev_samp(p_retailprice) AS s FROM part GROUP BY 1)
  SELECT p_partkey, round((p_retailprice - m) / CASE WHEN b - a > 1e-9 THEN b - a WHEN s > 1e-9 THEN s ELSE 1 END, 6) AS norm FROM part JOIN q USING (p_brand)"""


@query("X18_peer_normalise", _PEER)
def _(spark, sf):
    return X.peer_normalise(T.table(spark, sf, "part"), "p_retailprice", ["p_brand"], "v").select("p_partkey", r6("v").alias("norm"))


@query("X19_share_of_mask", BRAND + """, x AS (SELECT date, price > lag(price, 7) OVER (PARTITION BY entity ORDER BY date) AS up, issuance IS NOT NULL AS ok FROM panel)
  SELECT date, round(100 * avg(CAST(coalesce(up, FALSE) AS DOUBLE)) FILTER (ok), 6) AS share_up, round(100 * avg(CAST(coalesce(up, FALSE) AS DOUBLE)), 6) AS share_all FROM x GROUP BY 1""")
def _(spark, sf):
    p = T.brand_panel(spark, sf).select(DATE, (F.col("price") > F.lag("price", 7).over(by_entity())).alias("up"), F.col("issuance").isNotNull().alias("ok"))
    return p.groupBy(DATE).agg(r6(X.share(F.col("up"), F.col("ok"))).alias("share_up"), r6(X.share(F.col("up"))).alias("share_all"))
