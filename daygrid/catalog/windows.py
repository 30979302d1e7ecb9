"""Joins, frames, limits and text rules that other operators use inside, each as a query of its own."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from daygrid.catalog.base import NATION_ORDERS, query, r6
from daygrid.functions import rolling as R
from daygrid.functions.rolling import DATE, ENTITY
from daygrid.functions.text import display_name, visible_text
from daygrid.sources import tables as T
from daygrid.sources.store import beside

_D = f"WITH d AS ({NATION_ORDERS})"
_FRAME = "PARTITION BY entity ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW"


def daily(spark, sf):
    return T.nation_orders(spark, sf)


@query("J09_as_of_bounded", """WITH o AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders), l AS (SELECT DISTINCT o_custkey AS ck, CAST(l_shipdate AS DATE) AS ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT o_custkey, date, CASE WHEN date_diff('day', ship, date) <= 7 THEN ship END AS ship FROM o ASOF LEFT JOIN l ON o_custkey = ck AND date >= ship""")
def _(spark, sf):
    """The last value at or before each date, unless it is older than seven days."""
    o = T.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias(DATE))
    ship = F.to_date("l_shipdate")
    right = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), ship.alias("ship")).join(o.drop(DATE), "o_orderkey").select("o_custkey", F.col("ship").alias(DATE), "ship").distinct()
    left = o.select("o_custkey", DATE, F.lit(True).alias("ask")).distinct()
    w = Window.partitionBy("o_custkey").orderBy(DATE, F.col("ask").asc_nulls_first())
    both = right.unionByName(left, allowMissingColumns=True).withColumn("ship", R.ffill("ship", None, w)).where("ask")
    return both.select("o_custkey", DATE, F.when(F.datediff(DATE, "ship") <= 7, F.col("ship")).alias("ship"))


_MONTH = "CAST(year(date) * 12 + month(date) AS INT)"
_WEIGHTS = f"{_D}, m AS (SELECT {_MONTH} AS m, entity, sum(revenue) AS v FROM d GROUP BY 1, 2), w AS (SELECT m, entity, v / sum(v) OVER (PARTITION BY m) AS w FROM m)"


def monthly(spark, sf):
    return daily(spark, sf).groupBy((F.year(DATE) * 12 + F.month(DATE)).alias("m"), ENTITY).agg(F.sum("revenue").alias("v"), F.sum("n_orders").alias("n"))


@query("J14_full_outer_turnover", _WEIGHTS + """ SELECT m, round(sum(abs(coalesce(b.w, 0) - coalesce(a.w, 0))), 8) + 0.0::DOUBLE AS turnover FROM w b FULL JOIN (SELECT m + 1 AS m, entity, w FROM w) a USING (m, entity) GROUP BY 1""")
def _(spark, sf):
    rows = monthly(spark, sf)
    w = rows.join(rows.groupBy("m").agg(F.sum("v").alias("t")), "m").select("m", ENTITY, (F.col("v") / F.col("t")).alias("w"))
    old = w.select((F.col("m") + 1).alias("m"), ENTITY, F.col("w").alias("old"))
    step = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))
    return w.join(old, ["m", ENTITY], "full").groupBy("m").agg(r6(F.sum(step), 8).alias("turnover"))


@query("J16_entity_by_calendar", f"{_D}, m AS (SELECT {_MONTH} AS m, entity, sum(n_orders) AS n FROM d GROUP BY 1, 2) SELECT n_nationkey AS entity, c.m, CAST(coalesce(n, 0) AS BIGINT) AS n FROM nation CROSS JOIN (SELECT DISTINCT m FROM m) c LEFT JOIN m ON m.m = c.m AND entity = n_nationkey")
def _(spark, sf):
    """Every entity with every month: the calendar travels as one value and is exploded beside the entities."""
    rows = monthly(spark, sf).select("m", ENTITY, "n")
    grid = beside(T.table(spark, sf, "nation").select(F.col("n_nationkey").alias(ENTITY)), rows.select("m").distinct())
    return grid.join(rows, [ENTITY, "m"], "left").select(ENTITY, "m", F.coalesce("n", F.lit(0)).alias("n"))


@query("J17_self_join_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey AS region FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(spark, sf):
    n = T.table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), "n_nationkey")
    a, b = n.withColumnRenamed("n_nationkey", "a"), n.withColumnRenamed("n_nationkey", "b")
    return a.join(b, "region").where("a < b").select("a", "b", "region")


@query("N01_lag", f"{_D} SELECT entity, date, lag(revenue) OVER e AS before, round(revenue / nullif(lag(revenue, 7) OVER e, 0) - 1, 8) + 0.0::DOUBLE AS change FROM d WINDOW e AS (PARTITION BY entity ORDER BY date)")
def _(spark, sf):
    return daily(spark, sf).select(ENTITY, DATE, R.lag("revenue", 1).alias("before"), r6(R.chg("revenue", 7), 8).alias("change"))


@query("N02_lead", f"{_D} SELECT entity, date, lead(date) OVER e AS until, lead(revenue, 5) OVER e AS later FROM d WINDOW e AS (PARTITION BY entity ORDER BY date)")
def _(spark, sf):
    return daily(spark, sf).select(ENTITY, DATE, F.lead(DATE).over(R.by_entity()).alias("until"), F.lead("revenue", 5).over(R.by_entity()).alias("later"))


_BUSY = "CASE WHEN n_orders > 1 THEN revenue END"


def busy():
    return F.when(F.col("n_orders") > 1, F.col("revenue"))


@query("N03_trailing_minimum_count", f"{_D} SELECT entity, date, CASE WHEN count({_BUSY}) OVER f >= 10 THEN round(avg({_BUSY}) OVER f, 6) END AS mean FROM d WINDOW f AS ({_FRAME.format(29)})")
def _(spark, sf):
    return daily(spark, sf).withColumn("x", busy()).select(ENTITY, DATE, r6(R.roll(F.avg, "x", 30, 10)).alias("mean"))


@query("N04_trailing_full", f"{_D} SELECT entity, date, CASE WHEN count(*) OVER f >= 20 THEN sum(revenue) OVER f END AS total FROM d WINDOW f AS ({_FRAME.format(19)})")
def _(spark, sf):
    return daily(spark, sf).select(ENTITY, DATE, R.roll(F.sum, "revenue", 20).alias("total"))


@query("N05_expanding", f"{_D} SELECT entity, date, max(revenue) OVER f AS peak, round(revenue / max(revenue) OVER f - 1, 8) + 0.0::DOUBLE AS drawdown FROM d WINDOW f AS ({_FRAME.format('UNBOUNDED')})")
def _(spark, sf):
    peak = R.running(F.max, "revenue")
    return daily(spark, sf).select(ENTITY, DATE, peak.alias("peak"), r6(F.col("revenue") / peak - 1, 8).alias("drawdown"))


@query("N06_rolling_std_corr", f"""{_D} SELECT entity, date, CASE WHEN count(*) OVER s >= 10 THEN round(stddev_samp(revenue) OVER s, 4) END AS deviation,
  CASE WHEN count(*) OVER c >= 15 THEN round(covar_pop(revenue, n_orders) OVER c / nullif(stddev_pop(revenue) OVER c * stddev_pop(n_orders) OVER c, 0), 6) + 0.0::DOUBLE END AS correlation FROM d WINDOW s AS ({_FRAME.format(19)}), c AS ({_FRAME.format(29)})""")
def _(spark, sf):
    return daily(spark, sf).select(ENTITY, DATE, r6(R.roll(F.stddev_samp, "revenue", 20, 10), 4).alias("deviation"), r6(R.roll_corr("revenue", "n_orders", 30, 15, R.by_entity())).alias("correlation"))


@query("N07_rolling_extremes", f"{_D} SELECT entity, date, max(revenue) OVER f AS hi, min(revenue) OVER f AS lo FROM d WINDOW f AS ({_FRAME.format(19)})")
def _(spark, sf):
    return daily(spark, sf).select(ENTITY, DATE, R.roll(F.max, "revenue", 20, 1).alias("hi"), R.roll(F.min, "revenue", 20, 1).alias("lo"))


@query("N08_forward_fill", f"{_D}, x AS (SELECT *, {_BUSY} AS x FROM d) SELECT entity, date, last_value(x IGNORE NULLS) OVER ({_FRAME.format(3)}) AS bounded, last_value(x IGNORE NULLS) OVER ({_FRAME.format('UNBOUNDED')}) AS filled FROM x")
def _(spark, sf):
    return daily(spark, sf).withColumn("x", busy()).select(ENTITY, DATE, R.ffill("x", 3).alias("bounded"), R.ffill("x").alias("filled"))


@query("N09_ranks", f"""{_D} SELECT entity, date, rank() OVER (PARTITION BY date ORDER BY n_orders) + (count(*) OVER (PARTITION BY date, n_orders) - 1) / 2.0::DOUBLE AS mean_rank, rank() OVER (PARTITION BY date ORDER BY n_orders DESC) AS min_rank,
  row_number() OVER (PARTITION BY date ORDER BY n_orders DESC, entity) AS place FROM d""")
def _(spark, sf):
    up, down = R.by_date().orderBy("n_orders"), R.by_date().orderBy(F.desc("n_orders"))
    ties = F.count("*").over(Window.partitionBy(DATE, "n_orders"))
    return daily(spark, sf).select(ENTITY, DATE, (F.rank().over(up) + (ties - 1) / 2.0).alias("mean_rank"), F.rank().over(down).cast("long").alias("min_rank"),
                                   F.row_number().over(R.by_date().orderBy(F.desc("n_orders"), ENTITY)).cast("long").alias("place"))


@query("N10_first_value", f"{_D}, x AS (SELECT *, {_BUSY} AS x FROM d), f AS (SELECT *, first_value(x IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM x) SELECT entity, date, f AS first, round(revenue / f * 100, 6) AS rebased FROM f")
def _(spark, sf):
    first = R.first_value("x")
    return daily(spark, sf).withColumn("x", busy()).select(ENTITY, DATE, first.alias("first"), r6(F.try_divide("revenue", first) * 100).alias("rebased"))


@query("N11_every_kth_row", f"{_D} SELECT entity, date, revenue FROM d QUALIFY (row_number() OVER (PARTITION BY entity ORDER BY date) - 1) % 7 = 0")
def _(spark, sf):
    return daily(spark, sf).withColumn("n", F.row_number().over(R.by_entity())).where((F.col("n") - 1) % 7 == 0).select(ENTITY, DATE, "revenue")


@query("O04_n_largest", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def _(spark, sf):
    return T.table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)


@query("O06_quota_limit", """SELECT * FROM (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 20)
  UNION ALL SELECT * FROM (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 80)""")
def _(spark, sf):
    """Of one kind up to its quota, of the others the rest: two top-k cuts, no sort of the whole."""
    rows = T.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    top = lambda part, n: part.orderBy(F.desc("c_acctbal"), "c_custkey").limit(n)
    kind = F.col("c_mktsegment") == "BUILDING"
    return top(rows.where(kind), 20).unionByName(top(rows.where(~kind), 80))


@query("U05_set_intersect_size", """WITH b AS (SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS INT) AS m, list_distinct(list(l_partkey)) AS parts FROM lineitem GROUP BY 1, 2)
  SELECT a.l_suppkey, a.m, CAST(len(list_intersect(a.parts, c.parts)) AS INT) AS kept FROM b a JOIN b c ON a.l_suppkey = c.l_suppkey AND a.m = c.m + 1""")
def _(spark, sf):
    m = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    baskets = T.table(spark, sf, "lineitem").groupBy("l_suppkey", m.alias("m")).agg(F.collect_set("l_partkey").alias("parts"))
    old = baskets.select("l_suppkey", (F.col("m") + 1).alias("m"), F.col("parts").alias("old"))
    return baskets.join(old, ["l_suppkey", "m"]).select("l_suppkey", "m", F.size(F.array_intersect("parts", "old")).alias("kept"))


@query("Z03_title_case_and_references", r"""WITH x AS (SELECT p_partkey, replace(p_name, ' ', '-') || '_' || lower(p_type) || '-of-' || p_size AS slug, '<p>' || p_name || ' &amp; ' || p_type || '&nbsp;&lt;' || p_size || '&gt; &quot;' || p_brand || '&#39;</p>' AS html FROM part)
  SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(replace(slug, '_', '-'), '-'), lambda w: w <> ''), lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS name,
    trim(p) AS text FROM (SELECT *, regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '<p>', ' '), '</p>', ' '), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g') AS p FROM x)""")
def _(spark, sf):
    p, lit = T.table(spark, sf, "part"), F.lit
    slug = F.concat(F.replace("p_name", lit(" "), lit("-")), lit("_"), F.lower("p_type"), lit("-of-"), F.col("p_size").cast("string"))
    html = F.concat(lit("<p>"), "p_name", lit(" &amp; "), "p_type", lit("&nbsp;&lt;"), F.col("p_size").cast("string"), lit("&gt; &quot;"), "p_brand", lit("&#39;</p>"))
    return p.select("p_partkey", display_name(slug).alias("name"), visible_text(html).alias("text"))
