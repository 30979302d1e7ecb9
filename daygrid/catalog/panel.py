"""Panel construction (P) over the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daygrid.catalog.base import BRAND, MASTER, NATION_DAILY, NATION_ORDERS, query, r6
from daygrid.config import Periods
from daygrid.functions.rolling import DATE, ENTITY
from daygrid.functions.text import normalise_text
from daygrid.operators import panel as P
from daygrid.sources import payloads, tables as T

DEMO_PERIODS = Periods(dt.date(1996, 1, 1), dt.date(1998, 12, 31), dt.date(1999, 1, 1), dt.date(1999, 12, 31), dt.date(2000, 2, 1))


@query("P01_daily_normalise", """
  SELECT user_id AS entity, CAST(ts AS DATE) AS date,
    arg_max(CASE WHEN event_id % 7 <> 0 THEN value END, ROW(ts, event_id)) AS value
  FROM events WHERE event_id % 7 <> 0 GROUP BY 1, 2""")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    raw = e.withColumn("text", F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string")))
    x = raw.withColumn("value", P.to_number("text")).where(F.col("value").isNotNull())
    return x.groupBy(F.col("user_id").alias(ENTITY), F.to_date("ts").alias(DATE)).agg(
        P.last_of_day(F.col("value"), F.col("ts"), F.col("event_id")).alias("value"))


@query("P02_calendar_grid", """
  WITH a AS (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem UNION ALL SELECT CAST(o_orderdate AS DATE) FROM orders),
  b AS (SELECT least(min(d), DATE '1996-06-01') AS lo, least(max(d), DATE '2000-12-31') AS hi FROM a)
  SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b""")
def _(spark, sf):
    orders = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias(DATE))
    return P.calendar([T.lines(spark, sf), orders], dt.date(1996, 6, 1), dt.date(2000, 12, 31))


@query("P03_align_panel", BRAND + " SELECT entity, date, price, revenue, issuance, deposits, supply, mcap FROM panel")
def _(spark, sf):
    return T.brand_panel(spark, sf).select(ENTITY, DATE, "price", "revenue", "issuance", "deposits", "supply", "mcap")


@query("P04_combine_first", f"""
  SELECT entity, date, coalesce(a.revenue, b.revenue) AS revenue FROM ({NATION_DAILY}) a
  FULL JOIN ({NATION_ORDERS}) b USING (entity, date)""")
def _(spark, sf):
    return P.combine_first(T.nation_revenue(spark, sf), T.nation_orders(spark, sf), ["revenue"])


@query("P04_union_first", f"""
  SELECT entity, date, coalesce(a.issuance, a.deposits, b.revenue) AS value FROM ({NATION_DAILY}) a
  FULL JOIN ({NATION_ORDERS}) b USING (entity, date)""")
def _(spark, sf):
    d, o = T.nation_revenue(spark, sf), T.nation_orders(spark, sf)
    return P.union_first([
        d.select(ENTITY, DATE, F.col("issuance").alias("value")), d.select(ENTITY, DATE, F.col("deposits").alias("value")),
        o.select(ENTITY, DATE, F.col("revenue").alias("value"))], ["value"])


@query("P05_row_coalesce", BRAND + " SELECT entity, date, coalesce(issuance, dex_volume, deposits, revenue) AS value FROM daily")
def _(spark, sf):
    return T.brand_daily(spark, sf).select(ENTITY, DATE, F.coalesce("issuance", "dex_volume", "deposits", "revenue").alias("value"))


@query("P06_static_panel", BRAND + f" SELECT entity, date, revenue, list_price FROM panel JOIN ({MASTER}) USING (entity)")
def _(spark, sf):
    return P.static_panel(T.brand_panel(spark, sf).select(ENTITY, DATE, "revenue"), T.brand_master(spark, sf), ["list_price"])


@query("P07_latest_non_null", BRAND + """ SELECT entity, arg_max(issuance, date) FILTER (issuance IS NOT NULL) AS issuance,
  arg_max(deposits, date) FILTER (deposits IS NOT NULL) AS deposits, arg_max(price, date) AS price FROM daily GROUP BY 1""")
def _(spark, sf):
    return P.latest_values(T.brand_daily(spark, sf), ["issuance", "deposits", "price"])


@query("P08_lag1_information", BRAND + """ SELECT entity, date, lag(revenue) OVER w AS lag1_revenue, lag(fees) OVER w AS lag1_fees,
  lag(tvl) OVER w AS lag1_tvl FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date)""")
def _(spark, sf):
    return P.lag_information(T.brand_panel(spark, sf), ["revenue", "fees", "tvl"]).select(ENTITY, DATE, "lag1_revenue", "lag1_fees", "lag1_tvl")


@query("P09_market_cap", BRAND + " SELECT entity, date, price * supply AS mcap FROM panel")
def _(spark, sf):
    return T.brand_panel(spark, sf).select(ENTITY, DATE, "mcap")


@query("P10_market_cap_proxy", BRAND + """, h AS (SELECT entity, date, price, CASE WHEN dex_volume IS NOT NULL THEN mcap END AS mcap FROM panel),
  s AS (SELECT entity, arg_max(price, date) FILTER (price IS NOT NULL) AS cp, arg_max(supply, date) * 2 AS cm FROM panel GROUP BY 1)
  SELECT entity, date, coalesce(mcap, price * (cm / cp)) AS mcap,
    CASE WHEN mcap IS NOT NULL THEN 'history' WHEN price IS NOT NULL THEN 'proxy' END AS mcap_source FROM h JOIN s USING (entity)""")
def _(spark, sf):
    p = T.brand_panel(spark, sf)
    snap = P.latest_values(p, ["price", "supply"]).select(
        ENTITY, F.col("price").alias("current_price"), (F.col("supply") * 2).alias("current_mcap"))
    hist = p.select(ENTITY, DATE, "price", F.when(F.col("dex_volume").isNotNull(), F.col("mcap")).alias("mcap"))
    return P.mcap_proxy(hist, snap).select(ENTITY, DATE, "mcap", "mcap_source")


_REGION_MONTH = """SELECT n_regionkey AS rk, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  sum(round(l_extendedprice)) AS value, sum(l_quantity) AS qty
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""


def region_month(spark, sf):
    dims = T.table(spark, sf, "supplier").join(T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    x = T.lines(spark, sf).join(dims.select("s_suppkey", "n_regionkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("n_regionkey").cast("string").alias("rk"), F.trunc(DATE, "month").alias(DATE)).agg(
        F.sum(F.round("l_extendedprice")).alias("value"), F.sum("l_quantity").alias("qty"))


@query("P11_fan_out", f"""SELECT coalesce(n_name, CAST(rk AS VARCHAR)) AS entity, date, value FROM ({_REGION_MONTH}) s
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) ON rk = n_regionkey""")
def _(spark, sf):
    mapping = T.table(spark, sf, "nation").where("n_regionkey < 4").select(
        F.col("n_regionkey").cast("string").alias("source_id"), F.col("n_name").alias(ENTITY))
    return P.fan_out(region_month(spark, sf), mapping, "rk").select(ENTITY, DATE, "value")


@query("P12_unpivot_pivot", BRAND + """, l AS (UNPIVOT (SELECT entity, date, price, revenue, fees FROM panel) ON price, revenue, fees INTO NAME metric VALUE value)
  SELECT entity, date, max(value) FILTER (metric = 'price') AS price, max(value) FILTER (metric = 'fees') AS fees FROM l GROUP BY 1, 2""")
def _(spark, sf):
    long = P.to_long(T.brand_panel(spark, sf), ["price", "revenue", "fees"])
    wide = P.to_wide(long.where(F.col("value").isNotNull()), ["price", "fees"])
    return wide.select(ENTITY, DATE, "price", "fees")


@query("P13_rehydrate_by_prefix", BRAND + """ SELECT entity, date, lag(revenue) OVER w AS revenue, lag(addresses) OVER w AS addresses
  FROM panel WINDOW w AS (PARTITION BY entity ORDER BY date)""")
def _(spark, sf):
    return P.columns_with_prefix(P.lag_information(T.brand_panel(spark, sf), ["revenue", "addresses"]), "lag1_")


@query("P14_period_label", """SELECT CASE WHEN l_shipdate >= '1996-01-01' AND l_shipdate < '1999-01-01' THEN 'Train'
  WHEN l_shipdate >= '1999-01-01' AND l_shipdate < '2000-01-01' THEN 'Validation' WHEN l_shipdate >= '2000-02-01' THEN 'Test'
  ELSE 'OutOfSampleGap' END AS period, count(*) AS n, min(CAST(l_shipdate AS DATE)) AS first_date FROM lineitem GROUP BY 1""")
def _(spark, sf):
    x = T.lines(spark, sf).select(DATE, P.period_label(DATE, DEMO_PERIODS).alias("period"))
    return x.groupBy("period").agg(F.count("*").alias("n"), F.min(DATE).alias("first_date"))


@query("P16_trailing_window", BRAND + """ SELECT entity, date, price, revenue FROM panel
  WHERE date >= (SELECT max(date) FROM panel) - 29""")
def _(spark, sf):
    p = T.brand_panel(spark, sf).select(ENTITY, DATE, "price", "revenue")
    last = T.bounds(spark, sf).select("hi").scalar()
    return p.where(F.col(DATE) >= F.date_sub(last, 29))


# ---- landed payloads: every order carries a small vendor document ----

def order_docs(spark, sf):
    o = T.table(spark, sf, "orders")
    return o.withColumn("sec", F.unix_timestamp("o_orderdate")).withColumn("v", F.round("o_totalprice"))


@query("P17_pairs_to_series", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, round(o_totalprice) * 2 AS value FROM orders
  UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE) + 1, round(o_totalprice) + 1 FROM orders""")
def _(spark, sf):
    ms = F.col("sec") * 1000.0
    doc = F.to_json(F.array(F.array(ms, F.col("v")), F.array(ms + 3_600_000, F.col("v") * 2), F.array(ms + 86_400_000, F.col("v") + 1)))
    return payloads.pairs_to_rows(order_docs(spark, sf).withColumn("doc", doc), "doc", ["o_orderkey"])


def _breakdown(spark, sf):
    """Order document {chain: {protocol: value}} with a repeated and two colliding leaf names."""
    c = T.table(spark, sf, "customer").join(T.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x = order_docs(spark, sf).join(c.select("c_custkey", "n_name", "n_regionkey"), F.col("o_custkey") == F.col("c_custkey"))
    leaf = F.lower(F.replace("n_name", F.lit("_"), F.lit("-")))
    q = '"'
    doc = F.concat(
        F.lit('{"Alpha": {"'), F.col("n_name"), F.lit(f'{q}: '), F.col("v").cast("bigint").cast("string"), F.lit(', "shared": 1}, "Beta": {"'),
        leaf, F.lit(f'{q}: '), (F.col("v").cast("bigint") + 5).cast("string"), F.lit(', "shared": 2, "missing": null}}'))
    return x.withColumn("doc", doc).withColumn(DATE, F.to_date("o_orderdate"))


_ORDER_NATION = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@query("P18_flatten_breakdown", f"""SELECT o_orderkey, leaf, value FROM (
  SELECT o_orderkey, n_name AS leaf, round(o_totalprice) AS value FROM {_ORDER_NATION}
  UNION ALL SELECT o_orderkey, replace(lower(n_name), '_', '-'), round(o_totalprice) + 5 FROM {_ORDER_NATION}
  UNION ALL SELECT o_orderkey, 'shared', 2.0 FROM orders UNION ALL SELECT o_orderkey, 'missing', NULL FROM orders)""")
def _(spark, sf):
    return payloads.flatten_breakdown(_breakdown(spark, sf), "doc", ["o_orderkey"])


def _wanted(spark, sf):
    return T.table(spark, sf, "nation").where("n_regionkey < 3").select(
        normalise_text("n_name").alias("match_key"), F.col("n_regionkey").alias(ENTITY))


@query("P19_breakdown_to_panel", f"""SELECT CAST(o_orderdate AS DATE) AS date, replace(lower(n_name), '_', '') AS match_key,
  sum(2 * round(o_totalprice) + 5) AS value FROM {_ORDER_NATION} WHERE n_regionkey < 3 GROUP BY 1, 2""")
def _(spark, sf):
    leaves = payloads.flatten_breakdown(_breakdown(spark, sf), "doc", ["o_orderkey", DATE])
    return payloads.breakdown_to_panel(leaves, _wanted(spark, sf), [DATE])


@query("P20_overview_metric", f"""SELECT n_regionkey AS entity, CAST(o_orderdate AS DATE) AS date,
  sum(2 * round(o_totalprice) + 5) AS value FROM {_ORDER_NATION} WHERE n_regionkey < 3 AND n_regionkey <> 1 GROUP BY 1, 2""")
def _(spark, sf):
    leaves = payloads.flatten_breakdown(_breakdown(spark, sf), "doc", ["o_orderkey", DATE])
    keys = _wanted(spark, sf).withColumn("asset_type", F.when(F.col(ENTITY) == 1, "chain").otherwise("project"))
    series = payloads.breakdown_to_panel(leaves, keys, [DATE])
    return payloads.overview_panel(series, keys.where("asset_type <> 'chain'").select(ENTITY, "match_key").distinct())


@query("P39_open_interest_breakdown", f"""SELECT n_regionkey AS entity, CAST(o_orderdate AS DATE) AS date,
  sum(2 * round(o_totalprice) + 5) AS value FROM {_ORDER_NATION} WHERE n_regionkey < 3 GROUP BY 1, 2""")
def _(spark, sf):
    leaves = payloads.flatten_breakdown(_breakdown(spark, sf), "doc", ["o_orderkey", DATE])
    keys = _wanted(spark, sf)
    return payloads.overview_panel(payloads.breakdown_to_panel(leaves, keys, [DATE]), keys.distinct())


@query("P21_child_series_sum", f"""WITH c AS (SELECT n_regionkey AS entity, date, sum(revenue) AS revenue FROM ({NATION_ORDERS})
    JOIN nation ON entity = n_nationkey WHERE n_regionkey % 2 = 0 GROUP BY 1, 2),
  k AS (SELECT n_regionkey AS entity, date, sum(revenue) AS revenue FROM ({NATION_DAILY}) JOIN nation ON entity = n_nationkey GROUP BY 1, 2)
  SELECT * FROM c UNION ALL SELECT * FROM k WHERE entity NOT IN (SELECT entity FROM c)""")
def _(spark, sf):
    n = T.table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    by_region = lambda df: df.join(n, F.col(ENTITY) == F.col("n_nationkey")).select(F.col("n_regionkey").alias(ENTITY), DATE, "revenue")
    orders = by_region(T.nation_orders(spark, sf)).where(F.col(ENTITY) % 2 == 0)
    canonical = orders.groupBy(ENTITY, DATE).agg(F.sum("revenue").alias("revenue"))
    return P.sum_children(canonical, by_region(T.nation_revenue(spark, sf)), "revenue")


@query("P22_klines", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, round(o_totalprice) AS open, round(o_totalprice) + 3 AS high,
  round(o_totalprice) - 2 AS low, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE round(o_totalprice) + 1 END AS close, 10.5 * 1e0 AS volume,
  round(o_totalprice) * 10 AS quote_volume, o_custkey AS trades FROM orders""")
def _(spark, sf):
    v = F.col("v")
    txt = lambda c: c.cast("string")
    close = F.when(F.col("o_orderkey") % 5 == 0, "bad").otherwise(txt(v + 1))
    row = F.array(txt(F.col("sec") * 1000), txt(v), txt(v + 3), txt(v - 2), close, F.lit("10.5"), txt(F.col("sec") * 1000 + 1),
                  txt(v * 10), txt(F.col("o_custkey")), F.lit("0"), F.lit("0"), F.lit("0"))
    return payloads.klines(order_docs(spark, sf).withColumn("doc", F.to_json(F.array(row))), "doc", ["o_orderkey"])


@query("P23_venue_choice", """WITH d AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, event_type,
    arg_max(CASE WHEN user_id % 10 = 0 AND event_type = 'click' THEN 5.0 ELSE value END, ROW(ts, event_id)) AS price,
    sum(CASE WHEN user_id % 7 = 0 AND event_type = 'click' THEN 0 ELSE round(value) END) AS volume
    FROM events WHERE event_type IN ('click', 'view') AND NOT (event_type = 'click' AND user_id % 11 = 0) GROUP BY 1, 2, 3),
  s AS (SELECT entity, date, price, volume FROM d WHERE event_type = 'click'),
  f AS (SELECT entity, date, price, volume FROM d WHERE event_type = 'view'),
  r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn,
        abs(price / nullif(lag(price) OVER (PARTITION BY entity ORDER BY date), 0) - 1) AS c FROM s),
  g AS (SELECT entity, sum(volume) AS v30, count(*) >= 7 AND (count(DISTINCT price) <= 2 OR
        coalesce(sum(c) FILTER (rn < (SELECT max(rn) FROM r r2 WHERE r2.entity = r.entity AND r2.rn <= 30)), 0) < 1e-8) AS flat
        FROM r WHERE rn <= 30 GROUP BY 1),
  e AS (SELECT coalesce(g.entity, k.entity) AS entity,
        k.entity IS NOT NULL AND (g.entity IS NULL OR flat) AS fp, k.entity IS NOT NULL AND (g.entity IS NULL OR v30 <= 0) AS fv
        FROM g FULL JOIN (SELECT DISTINCT entity FROM f) k ON g.entity = k.entity)
  SELECT entity, date, CASE WHEN fp THEN f.price ELSE s.price END AS price, CASE WHEN fv THEN f.volume ELSE s.volume END AS volume,
    CASE WHEN fp THEN 'futures' ELSE 'spot' END AS price_venue
  FROM s FULL JOIN f USING (entity, date) JOIN e USING (entity)
  WHERE (CASE WHEN fp THEN f.price ELSE s.price END) IS NOT NULL OR (CASE WHEN fv THEN f.volume ELSE s.volume END) IS NOT NULL""")
def _(spark, sf):
    e = T.table(spark, sf, "events").withColumn(ENTITY, F.col("user_id")).withColumn(DATE, F.to_date("ts"))
    click = F.col("event_type") == "click"
    e = e.where(F.col("event_type").isin("click", "view") & ~(click & (F.col("user_id") % 11 == 0)))
    price = F.when(click & (F.col("user_id") % 10 == 0), 5.0).otherwise(F.col("value"))
    vol = F.when(click & (F.col("user_id") % 7 == 0), 0.0).otherwise(F.round("value"))
    d = e.withColumns({"_p": price, "_v": vol}).groupBy(ENTITY, DATE, "event_type").agg(
        P.last_of_day(F.col("_p"), F.col("ts"), F.col("event_id")).alias("price"), F.sum("_v").alias("volume"))
    return P.choose_venue(d.where("event_type = 'click'").drop("event_type"), d.where("event_type = 'view'").drop("event_type"))


@query("P24_flat_series", f"""WITH d AS (SELECT entity, date, CASE WHEN entity % 4 = 0 THEN 1 ELSE revenue END AS x FROM ({NATION_DAILY})),
  r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM d),
  t AS (SELECT *, abs(x / nullif(lag(x) OVER (PARTITION BY entity ORDER BY date), 0) - 1) AS c FROM r WHERE rn <= 30)
  SELECT entity, count(*) AS n_obs, count(DISTINCT x) AS n_distinct, round(coalesce(sum(c), 0), 4) AS abs_change,
    count(*) >= 7 AND (count(DISTINCT x) <= 2 OR coalesce(sum(c), 0) < 1e-8) AS is_flat FROM t GROUP BY 1""")
def _(spark, sf):
    d = T.nation_revenue(spark, sf).withColumn("x", F.when(F.col(ENTITY) % 4 == 0, 1.0).otherwise(F.col("revenue")))
    return P.series_flags(d, "x").withColumn("abs_change", r6("abs_change", 4))


@query("P25_stablecoin_chain_supply", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
  CASE WHEN o_orderkey % 3 = 0 THEN 2 * round(o_totalprice) + 7 ELSE round(o_totalprice) END AS supply FROM orders""")
def _(spark, sf):
    v = F.col("v").cast("bigint").cast("string")
    body = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('{"peggedEUR": '), v, F.lit(', "peggedJPY": '), (F.col("v").cast("bigint") + 7).cast("string"), F.lit("}")))
    body = body.otherwise(F.concat(F.lit('{"peggedUSD": '), v, F.lit(', "peggedEUR": 3}')))
    doc = F.concat(F.lit('[{"date": '), F.col("sec").cast("string"), F.lit(', "totalCirculating": '), body, F.lit("}]"))
    return payloads.stablecoin_records(order_docs(spark, sf).withColumn("doc", doc), "doc", ["o_orderkey"])


@query("P42_total_stablecoin_supply", """SELECT CAST(o_orderdate AS DATE) AS date,
  sum(CASE WHEN o_orderkey % 3 = 0 THEN 2 * round(o_totalprice) + 7 ELSE round(o_totalprice) END) AS supply FROM orders GROUP BY 1""")
def _(spark, sf):
    from daygrid.catalog.base import QUERIES
    return QUERIES["P25_stablecoin_chain_supply"](spark, sf).groupBy(DATE).agg(F.sum("supply").alias("supply"))


@query("P26_bridge_net_flow", f"""SELECT s_nationkey AS entity, CAST(l_shipdate AS DATE) AS date,
  sum(CASE WHEN l_linestatus = 'O' THEN round(l_extendedprice) WHEN l_linestatus = 'F' THEN -round(l_extendedprice) ELSE 0 END) AS bridge_flow
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def _(spark, sf):
    return T.nation_revenue(spark, sf).select(ENTITY, DATE, "bridge_flow")


@query("P27_tvl_series", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, round(o_totalprice) AS tvl FROM orders""")
def _(spark, sf):
    field = F.when(F.col("o_orderkey") % 2 == 0, '"tvl": ').otherwise('"totalLiquidityUSD": ')
    doc = F.concat(F.lit('[{"date": '), F.col("sec").cast("string"), F.lit(", "), field, F.col("v").cast("bigint").cast("string"), F.lit("}]"))
    return payloads.tvl_records(order_docs(spark, sf).withColumn("doc", doc), "doc", ["o_orderkey"])


@query("P28_annualised_funding", """SELECT user_id, round(avg(value / 1000) * 109500, 4) AS funding_annualised, count(*) AS n_rates FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC) AS rn FROM events) WHERE rn <= 21 GROUP BY 1""")
def _(spark, sf):
    e = T.table(spark, sf, "events").withColumn("rate", F.col("value") / 1000)
    return P.annualised_funding(e, "user_id", "ts", "rate").withColumn("funding_annualised", r6("funding_annualised", 4))


@query("P29_open_interest_history", """SELECT user_id AS entity, date_trunc('hour', ts) AS ts, arg_max(coalesce(
  CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END, value), event_id) AS open_interest
  FROM events GROUP BY 1, 2""")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    k = F.from_json("props", "struct<k:double>")["k"]
    v = F.coalesce(F.when(F.col("event_id") % 3 == 0, k), F.col("value"))
    return e.groupBy(F.col("user_id").alias(ENTITY), F.date_trunc("hour", "ts").alias("ts")).agg(F.max_by(v, "event_id").alias("open_interest"))


@query("P30_range_chart", """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, round(o_totalprice) AS v FROM orders),
  y AS (SELECT o_orderkey, date, v AS prices, v * 10 AS market_caps, NULL::DOUBLE AS total_volumes FROM x
        UNION ALL SELECT o_orderkey, date + 1, v + 1, NULL, v * 3 FROM x)
  SELECT * FROM y WHERE date >= '1996-01-01' AND date < '2000-01-01'""")
def _(spark, sf):
    ms, v = F.col("sec") * 1000.0, F.col("v")
    pair = lambda t, x: F.array(t, x)
    doc = F.to_json(F.struct(
        F.array(pair(ms, v), pair(ms + 86_400_000, v + 1)).alias("prices"), F.array(pair(ms, v * 10)).alias("market_caps"),
        F.array(pair(ms + 86_400_000, v * 3)).alias("total_volumes")))
    return payloads.range_chart(order_docs(spark, sf).withColumn("doc", doc), "doc", ["o_orderkey"], dt.date(1996, 1, 1), dt.date(2000, 1, 1))


@query("P31_metric_records", """SELECT o_orderkey, 'c' || o_custkey AS slug, CAST(o_orderdate AS DATE) + i AS date,
  CASE WHEN i = 0 THEN round(o_totalprice) END AS value FROM orders, (SELECT unnest([0, 1]) AS i)""")
def _(spark, sf):
    day = F.to_date("o_orderdate")
    rec = F.array(F.struct(day.cast("string").alias("date"), F.col("v").alias("value")),
                  F.struct(F.concat(F.date_add(day, 1).cast("string"), F.lit("T00:00:00")).alias("date"), F.lit(None).cast("double").alias("value")))
    doc = F.to_json(F.map_from_arrays(F.array(F.concat(F.lit("c"), F.col("o_custkey"))), F.array(rec)))
    return payloads.metric_records(order_docs(spark, sf).withColumn("doc", doc), "doc", ["o_orderkey"])


@query("P32_project_metrics", """SELECT s_nationkey AS entity, CAST(l_shipdate AS DATE) AS date, sum(round(l_extendedprice)) FILTER (l_returnflag = 'A') AS a,
  sum(round(l_extendedprice)) FILTER (l_returnflag = 'N') AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2""")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias(ENTITY))
    x = T.lines(spark, sf).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    series = x.groupBy(ENTITY, DATE, F.lower("l_returnflag").alias("metric")).agg(F.sum(F.round("l_extendedprice")).alias("value"))
    catalogue = series.select("metric").distinct().where(F.col("metric").isin("a", "n"))
    return P.to_wide(series.join(catalogue, "metric", "left_semi"), ["a", "n"])


@query("P33_multi_symbol_panel", """WITH daily AS (SELECT p_brand AS entity, CAST(l_shipdate AS DATE) AS date, arg_max(l_extendedprice / l_quantity,
    ROW(l_orderkey, l_linenumber, l_extendedprice / l_quantity)) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
  SELECT entity, date, price AS close FROM daily""")
def _(spark, sf):
    part = T.table(spark, sf, "part")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    x = T.lines(spark, sf).join(part.select("p_partkey", F.col("p_brand").alias(ENTITY)), F.col("l_partkey") == F.col("p_partkey"))
    return x.groupBy(ENTITY, DATE).agg(P.last_of_day(unit, F.col("l_orderkey"), F.col("l_linenumber"), unit).alias("close"))


@query("P34_tradable_symbols", """SELECT DISTINCT 'C' || o_custkey AS symbol FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW')""")
def _(spark, sf):
    o = T.table(spark, sf, "orders")
    rows = o.select(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("symbol"), F.when(F.col("o_orderstatus") == "F", "TRADING").otherwise("BREAK").alias("status"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "5-LOW", "2-HIGH"), "USDT").otherwise("BTC").alias("quote_asset"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "PERPETUAL").when(F.col("o_orderpriority") == "2-HIGH", "CURRENT_QUARTER").alias("contract_type"))
    return payloads.tradable_symbols(rows)


@query("P35_market_upsert", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(spark, sf):
    o = T.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    fresh, cached = o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'")
    return P.upsert_first(fresh, cached, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")]).drop("o_orderstatus")


@query("P36_aggregator_panels", f"""SELECT n_name AS entity, date, value / qty AS price, value AS mcap, qty AS volume
  FROM ({_REGION_MONTH}) JOIN nation ON rk = n_regionkey""")
def _(spark, sf):
    mapping = T.table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("source_id"), F.col("n_name").alias(ENTITY))
    out = P.fan_out(region_month(spark, sf), mapping, "rk")
    return out.select(ENTITY, DATE, (F.col("value") / F.col("qty")).alias("price"), F.col("value").alias("mcap"), F.col("qty").alias("volume"))


@query("P37_fallback_sources", """WITH m AS (SELECT s_suppkey AS entity, CASE WHEN s_suppkey % 9 <> 0 THEN s_nationkey END AS source_id,
    CASE WHEN s_suppkey % 2 = 0 THEN 'S' END AS spot, CASE WHEN s_suppkey % 3 = 0 THEN 'F' END AS fut,
    CASE WHEN s_suppkey % 5 = 0 THEN 'chain' ELSE 'project' END AS asset_type, s_acctbal AS size FROM supplier),
  p AS (SELECT *, CASE WHEN spot IS NULL THEN 2 ELSE 0 END + CASE WHEN fut IS NULL THEN 0 ELSE 1 END AS priority FROM m
        WHERE source_id IS NOT NULL AND (spot IS NULL OR asset_type = 'chain'))
  SELECT entity, source_id, priority, size FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY priority DESC, size DESC NULLS LAST, entity) AS rn
    FROM p) WHERE rn = 1""")
def _(spark, sf):
    s, k = T.table(spark, sf, "supplier"), F.col("s_suppkey")
    master = s.select(k.alias(ENTITY), F.when(k % 9 != 0, F.col("s_nationkey")).alias("source_id"), F.when(k % 2 == 0, "S").alias("spot_symbol"),
                      F.when(k % 3 == 0, "F").alias("futures_symbol"), F.when(k % 5 == 0, "chain").otherwise("project").alias("asset_type"), "s_acctbal")
    return P.fallback_sources(master, F.col("s_acctbal")).select(ENTITY, "source_id", "priority", "size")


@query("P38_gap_fallback", f"""WITH a AS (SELECT entity, date, revenue FROM ({NATION_DAILY}) WHERE entity % 3 <> 0),
  b AS (SELECT entity, date, revenue FROM ({NATION_ORDERS}))
  SELECT * FROM a UNION ALL SELECT * FROM b WHERE entity NOT IN (SELECT entity FROM a)""")
def _(spark, sf):
    primary = T.nation_revenue(spark, sf).where(F.col(ENTITY) % 3 != 0)
    return P.fill_missing_entities(primary, T.nation_orders(spark, sf), "revenue")


@query("P40_metrics_by_type", """WITH s AS (SELECT s_nationkey AS source_id, CAST(l_shipdate AS DATE) AS date, l_returnflag AS f,
    sum(round(l_extendedprice)) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
  w AS (SELECT source_id, date, max(value) FILTER (f = 'A') AS a, max(value) FILTER (f = 'N') AS n, max(value) FILTER (f = 'R') AS r FROM s GROUP BY 1, 2),
  x AS (SELECT 'n' || source_id AS entity, 'revenue' AS metric, date, CASE WHEN source_id % 2 = 0 THEN a ELSE coalesce(n, r) END AS value FROM w
        UNION ALL SELECT 'n' || source_id, 'fees', date, CASE WHEN source_id % 2 = 0 THEN n END FROM w)
  SELECT * FROM x WHERE value IS NOT NULL""")
def _(spark, sf):
    s = T.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("source_id"))
    series = T.lines(spark, sf).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(
        "source_id", DATE, F.col("l_returnflag").alias("vendor_metric")).agg(F.sum(F.round("l_extendedprice")).alias("value"))
    master = T.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("source_id"), F.concat(F.lit("n"), F.col("n_nationkey")).alias(ENTITY),
        F.when(F.col("n_nationkey") % 2 == 0, "chain").otherwise("project").alias("asset_type"))
    ids = spark.createDataFrame([("chain", "A", "revenue", 0), ("chain", "N", "fees", 0), ("project", "N", "revenue", 0), ("project", "R", "revenue", 1)],
                                "asset_type string, vendor_metric string, metric string, precedence int")
    return P.metric_by_type(series, master, ids)


@query("P41_unit_price_chart", """SELECT o_orderkey, 'coin:' || o_custkey AS coin, CAST(o_orderdate AS DATE) + i AS date, round(o_totalprice) + i AS price
  FROM orders, (SELECT unnest([0, 1]) AS i)""")
def _(spark, sf):
    pts = F.array(*[F.struct((F.col("sec") + i * 86_400).alias("timestamp"), (F.col("v") + i).alias("price")) for i in (0, 1)])
    coin = F.struct(F.lit("X").alias("symbol"), pts.alias("prices"))
    doc = F.to_json(F.struct(F.map_from_arrays(F.array(F.concat(F.lit("coin:"), F.col("o_custkey"))), F.array(coin)).alias("coins")))
    return payloads.price_points(order_docs(spark, sf).withColumn("doc", doc), "doc", ["o_orderkey"])
