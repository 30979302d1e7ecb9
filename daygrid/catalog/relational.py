"""Relational categories (D, Q, J, H, N, O, U, Z): the shapes the reference's panels reduce to."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from daygrid.catalog.base import NATION_ORDERS, query, r6
from daygrid.operators import events as V
from daygrid.operators import ordered
from daygrid.operators import panel as P
from daygrid.sources import files
from daygrid.sources import tables as T
from daygrid.sources.store import folder


def t(name):
    return lambda spark, sf: T.table(spark, sf, name)


lineitem, orders, customer, supplier, part, nation, region, events, documents, labels = (t(n) for n in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region", "events", "documents", "labels"))


def scratch(spark, name):
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def simple(name, sql):
    """Registers fn(spark, sf) -> DataFrame under `name`."""
    return query(name, sql)


@simple("D01_parquet_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def _(s, d):
    return orders(s, d).where("o_orderdate >= '2000-01-01'").select("o_orderkey", "o_totalprice")


_DAY = "SELECT CAST(o_orderdate AS DATE) AS date, sum(round(o_totalprice)) AS v FROM orders GROUP BY 1"


def daily_orders(s, d):
    return orders(s, d).groupBy(F.to_date("o_orderdate").alias("date")).agg(F.sum(F.round("o_totalprice")).alias("v"))


@simple("D02_parquet_write", f"SELECT * FROM ({_DAY}) WHERE date >= DATE '1999-06-01'")
def _(s, d):
    path = scratch(s, "panel")
    files.write_panel(daily_orders(s, d), path)
    return s.read.parquet(path).where("month >= '1999-06' AND date >= '1999-06-01'").select("date", "v")


@simple("D03_read_merge_write", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def _(s, d):
    path = scratch(s, "events")
    o = orders(s, d).select("o_custkey", "o_orderkey")
    files.write_version(o.where("o_orderkey % 2 = 0"), path, 1)
    merged = V.upsert_events(files.read_latest(s, path), o, ["o_custkey"], ["o_orderkey"])
    files.write_version(merged, path, 2)
    return files.read_latest(s, path)


@simple("D04_csv_scan", f"SELECT date, v FROM ({_DAY})")
def _(s, d):
    path = scratch(s, "csv")
    files.write_csv(daily_orders(s, d), path)
    return files.read_csv(s, path, "date date, v double")


@simple("D05_csv_write", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    path = scratch(s, "csv")
    files.write_csv(orders(s, d).groupBy("o_orderstatus").agg(F.count("*").alias("n")), path)
    return files.read_csv(s, path, "o_orderstatus string, n bigint")


@simple("D06_json_scan", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    path = scratch(s, "json")
    files.write_json(events(s, d).select("event_id", F.from_json("props", "struct<k:bigint>").alias("props")), path)
    return files.read_json(s, path, "event_id bigint, props struct<k:bigint>").select("event_id", "props.k")


@simple("D07_json_write", """SELECT o_orderstatus, count(*) AS n, sum(round(o_totalprice)) AS total FROM orders GROUP BY 1""")
def _(s, d):
    path = scratch(s, "json")
    files.write_json(orders(s, d).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.round("o_totalprice")).alias("total")), path)
    return files.read_json(s, path, "o_orderstatus string, n bigint, total double")


@simple("D08_page_scan", "SELECT page_id, length(html) AS n FROM pages")
def _(s, d):
    """Pages are landed as one text file each, as a crawler leaves them, and read back as whole files."""
    path = scratch(s, "pages")
    files.write_texts(T.table(s, d, "pages"), path, "page_id", "html")
    text = F.substr(F.col("text"), F.instr("text", "\n") + 1)
    return files.read_texts(s, path).select(F.substring_index("text", "\n", 1).try_cast("bigint").alias("page_id"), F.length(text).cast("bigint").alias("n"))


@simple("D09_column_projection", "SELECT s_suppkey, s_acctbal FROM supplier")
def _(s, d):
    return supplier(s, d).select("s_suppkey", "s_acctbal")


@simple("Q01_select_rename_drop", "SELECT o_orderkey AS id, o_totalprice AS total FROM orders")
def _(s, d):
    return orders(s, d).drop("o_orderstatus", "o_orderdate", "o_orderpriority", "o_custkey").withColumnsRenamed({"o_orderkey": "id", "o_totalprice": "total"})


@simple("Q02_null_predicates", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def _(s, d):
    return documents(s, d).join(labels(s, d), "doc_id", "left").where(F.col("quality").isNull()).select("doc_id")


@simple("Q03_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def _(s, d):
    return lineitem(s, d).where(F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber", "l_quantity")


@simple("Q04_set_membership", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(s, d):
    return customer(s, d).where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@simple("Q05_regex", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^small|widget$')")
def _(s, d):
    return part(s, d).where(F.col("p_name").rlike("(?i)^small|widget$")).select("p_partkey")


@simple("Q06_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-07-01'")
def _(s, d):
    return orders(s, d).where("o_orderdate >= '1998-01-01' AND o_orderdate < '1998-07-01'").select("o_orderkey")


@simple("Q07_mask_algebra", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_returnflag = 'R' OR l_tax > 0.06) AND NOT l_linestatus = 'O'")
def _(s, d):
    ok = ((F.col("l_returnflag") == "R") | (F.col("l_tax") > 0.06)) & ~(F.col("l_linestatus") == "O")
    return lineitem(s, d).where(F.coalesce(ok, F.lit(False))).select("l_orderkey", "l_linenumber", "l_partkey")


@simple("Q08_conditional_column", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def _(s, d):
    x = F.col("o_totalprice")
    return orders(s, d).select("o_orderkey", F.when(x > 300000, "high").when(x > 100000, "mid").otherwise("low").alias("band"))


@simple("J01_left_join", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(s, d):
    # orders are counted before the join: one row per customer crosses the shuffle
    n = orders(s, d).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return customer(s, d).join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@simple("J02_inner_join", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    return lineitem(s, d).join(orders(s, d), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus")


@simple("J03_full_outer_on_date", f"SELECT date, a.v AS orders_v, b.q AS line_q FROM ({_DAY}) a FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q FROM lineitem GROUP BY 1) b USING (date)")
def _(s, d):
    q = T.lines(s, d).groupBy("date").agg(F.sum("l_quantity").alias("line_q"))
    return daily_orders(s, d).withColumnRenamed("v", "orders_v").join(q, "date", "full")


@simple("J04_union_of_grids", "SELECT DISTINCT s_nationkey AS entity, CAST(l_shipdate AS DATE) AS date FROM lineitem JOIN supplier ON l_suppkey = s_suppkey UNION SELECT DISTINCT c_nationkey, CAST(o_orderdate AS DATE) FROM orders JOIN customer ON o_custkey = c_custkey")
def _(s, d):
    return T.nation_revenue(s, d).select("entity", "date").unionByName(T.nation_orders(s, d).select("entity", "date")).distinct()


@simple("J05_join_on_index", "SELECT s_suppkey, s_acctbal, q FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def _(s, d):
    q = lineitem(s, d).groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.sum("l_quantity").alias("q"))
    return supplier(s, d).join(q, "s_suppkey", "left").select("s_suppkey", "s_acctbal", "q")


@simple("J06_map_lookup", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    return supplier(s, d).join(nation(s, d), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@simple("J07_date_broadcast", f"WITH m AS (SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT s_nationkey AS entity, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) / max(q) AS share FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN m ON m.date = CAST(l_shipdate AS DATE) GROUP BY 1, 2")
def _(s, d):
    day = T.lines(s, d).groupBy("date").agg(F.sum("l_quantity").alias("q"))
    return T.with_benchmark(T.nation_revenue(s, d).select("entity", "date", "qty"), day).select("entity", "date", (F.col("qty") / F.col("q")).alias("share"))


@simple("J08_as_of_backward", """SELECT o.o_custkey, o.date, l.ship FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders) o ASOF LEFT JOIN (SELECT DISTINCT o_custkey AS ck, CAST(l_shipdate AS DATE) AS ship FROM lineitem JOIN orders ON l_orderkey = o_orderkey) l ON o.o_custkey = l.ck AND o.date >= l.ship""")
def _(s, d):
    """As-of without a range join: both sides in one ordered stream per key, the last right date carried.

    Both sides are reduced to days first, so a key holds at most the calendar.
    """
    o = orders(s, d)
    right = lineitem(s, d).join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.to_date("l_shipdate").alias("date"), F.to_date("l_shipdate").alias("ship")).distinct()
    left = o.select("o_custkey", F.to_date("o_orderdate").alias("date"), F.lit(True).alias("ask")).distinct()
    w = Window.partitionBy("o_custkey").orderBy("date", F.col("ask").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = right.unionByName(left, allowMissingColumns=True).withColumn("ship", F.last("ship", True).over(w))
    return both.where(F.col("ask")).select("o_custkey", "date", "ship")


@simple("J10_cascading_join", "SELECT c_custkey, coalesce(s.s_name, n.n_name) AS name FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey LEFT JOIN nation n ON n_nationkey = c_nationkey")
def _(s, d):
    a = customer(s, d).join(supplier(s, d).select(F.col("s_suppkey").alias("c_custkey"), "s_name"), "c_custkey", "left")
    return a.join(nation(s, d), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("s_name", "n_name").alias("name"))


@simple("J11_unique_key_join", "SELECT p_partkey, u.k AS only_part FROM part JOIN (SELECT p_name, min(p_partkey) AS k FROM part WHERE p_size > 40 GROUP BY 1 HAVING count(*) = 1) u USING (p_name)")
def _(s, d):
    from daygrid.operators.resolve import unique_lookup

    u = unique_lookup(part(s, d).where("p_size > 40"), F.col("p_name"), "p_partkey")
    return part(s, d).join(u, F.col("p_name") == F.col("key")).select("p_partkey", F.col("target").alias("only_part"))


@simple("J12_semi_join", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    return orders(s, d).join(lineitem(s, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@simple("J13_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def _(s, d):
    return orders(s, d).join(lineitem(s, d).select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@simple("J15_range_join", "SELECT CASE WHEN l_quantity < 10 THEN 'a' WHEN l_quantity < 25 THEN 'b' ELSE 'c' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def _(s, d):
    b = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in (("a", 0.0, 10.0), ("b", 10.0, 25.0), ("c", 25.0, 1e9))])
    x = F.col("l_quantity")
    return lineitem(s, d).groupBy(F.filter(b, lambda k: (x >= k["lo"]) & (x < k["hi"]))[0]["n"].alias("bucket")).agg(F.count("*").alias("n"))


@simple("H01_group_aggregates", "SELECT l_returnflag, l_linestatus, avg(l_quantity) AS mean_q, sum(l_quantity) AS sum_q, count(*) AS n, min(l_quantity) AS lo, max(l_quantity) AS hi, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2")
def _(s, d):
    q = "l_quantity"
    return lineitem(s, d).groupBy("l_returnflag", "l_linestatus").agg(F.avg(q).alias("mean_q"), F.sum(q).alias("sum_q"), F.count("*").alias("n"), F.min(q).alias("lo"), F.max(q).alias("hi"), F.count_distinct("l_suppkey").alias("suppliers"))


@simple("H02_first_last", "SELECT o_custkey, arg_min(o_totalprice, ROW(o_orderdate, o_orderkey)) AS first_total, arg_max(o_totalprice, ROW(o_orderdate, o_orderkey)) AS last_total FROM orders GROUP BY 1")
def _(s, d):
    k = F.struct("o_orderdate", "o_orderkey")
    return orders(s, d).groupBy("o_custkey").agg(F.min_by("o_totalprice", k).alias("first_total"), F.max_by("o_totalprice", k).alias("last_total"))


@simple("H03_median_quantile", "SELECT c_nationkey, median(c_acctbal) AS med, round(quantile_cont(c_acctbal, 0.9::DOUBLE), 6) AS p90 FROM customer GROUP BY 1")
def _(s, d):
    return ordered.group_quantiles(customer(s, d), ["c_nationkey"], "c_acctbal", {"med": 0.5, "p90": 0.9}).withColumn("p90", r6("p90"))


@simple("H04_deviations", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS s, round(stddev_pop(l_quantity), 6) AS p FROM lineitem GROUP BY 1")
def _(s, d):
    return lineitem(s, d).groupBy("l_returnflag").agg(r6(F.stddev_samp("l_quantity")).alias("s"), r6(F.stddev_pop("l_quantity")).alias("p"))


@simple("H05_covariance_correlation", "SELECT l_returnflag, round(covar_samp(l_quantity, l_tax), 6) + 0.0::DOUBLE AS c, round(var_pop(l_tax), 8) AS v, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def _(s, d):
    return lineitem(s, d).groupBy("l_returnflag").agg(r6(F.covar_samp("l_quantity", "l_tax")).alias("c"), r6(F.var_pop("l_tax"), 8).alias("v"), r6(F.corr("l_quantity", "l_extendedprice")).alias("r"))


@simple("H06_spearman", "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem) SELECT l_returnflag, round(corr(a, b), 6) AS ic, count(*) AS n_pairs FROM r GROUP BY 1")
def _(s, d):
    from daygrid.operators.cross_section import rank_ic

    return rank_ic(lineitem(s, d), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("ic", r6("ic"))


@simple("H07_cumulative_product", "SELECT entity, date, round(product(1 + (revenue % 10) / 1000) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS nav FROM (" + NATION_ORDERS + ")")
def _(s, d):
    w = Window.partitionBy("entity").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return T.nation_orders(s, d).select("entity", "date", r6(F.product(1 + (F.col("revenue") % 10) / 1000).over(w)).alias("nav"))


@simple("H08_conditional_aggregate", "SELECT o_custkey, round(avg((o_totalprice > 200000)::INT::DOUBLE), 6) AS hit_rate, count(*) FILTER (o_orderstatus = 'F') AS n_f FROM orders GROUP BY 1")
def _(s, d):
    return orders(s, d).groupBy("o_custkey").agg(r6(F.avg((F.col("o_totalprice") > 200000).cast("double"))).alias("hit_rate"), F.count_if(F.col("o_orderstatus") == "F").alias("n_f"))


@simple("H09_sum_min_count", "SELECT l_suppkey, sum(l_quantity) FILTER (l_tax > 0.079) AS q FROM lineitem GROUP BY 1")
def _(s, d):
    return lineitem(s, d).groupBy("l_suppkey").agg(F.sum(F.when(F.col("l_tax") > 0.079, F.col("l_quantity"))).alias("q"))


@simple("H10_ordered_distinct", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(s, d):
    best = F.max_by(F.struct("o_orderkey"), F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    return orders(s, d).groupBy("o_custkey").agg(best.alias("r")).select("o_custkey", "r.o_orderkey")


@simple("H11_grouping_sets", "SELECT CASE WHEN GROUPING(o_orderstatus) = 0 THEN 'status' WHEN GROUPING(o_orderpriority) = 0 THEN 'priority' ELSE 'aggregate' END AS group_type, coalesce(o_orderstatus, o_orderpriority, 'Aggregate') AS grp, count(*) AS n FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")
def _(s, d):
    o = orders(s, d)
    g = o.groupingSets([[], [F.col("o_orderstatus")], [F.col("o_orderpriority")]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").alias("gs"), F.grouping("o_orderpriority").alias("gp"))
    return g.select(F.when(F.col("gs") == 0, "status").when(F.col("gp") == 0, "priority").otherwise("aggregate").alias("group_type"), F.coalesce("o_orderstatus", "o_orderpriority", F.lit("Aggregate")).alias("grp"), "n")


@simple("H12_pivot", "SELECT year(o_orderdate) AS y, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def _(s, d):
    p = orders(s, d).groupBy(F.year("o_orderdate").cast("bigint").alias("y")).pivot("o_orderstatus", ["F", "O"]).agg(F.count("o_orderkey"))
    return p.select("y", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@simple("H13_collect_set", "SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_name)), '|') AS names FROM nation GROUP BY 1")
def _(s, d):
    return nation(s, d).groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), "|").alias("names"))


@simple("N12_running_share", "SELECT s_nationkey, sum(round(s_acctbal)) AS v, round(sum(round(s_acctbal)) * 100 / sum(sum(round(s_acctbal))) OVER (), 6) AS pct FROM supplier GROUP BY 1")
def _(s, d):
    g = supplier(s, d).groupBy("s_nationkey").agg(F.sum(F.round("s_acctbal")).alias("v"))
    return g.select("s_nationkey", "v", r6(F.col("v") * 100 / F.sum("v").over(Window.partitionBy(F.lit(0)))).alias("pct"))


@simple("O01_multi_key_sort", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey DESC, s_acctbal, s_suppkey")
def _(s, d):
    return supplier(s, d).select("s_suppkey", "s_nationkey", "s_acctbal").orderBy(F.desc_nulls_last("s_nationkey"), "s_acctbal", "s_suppkey")


@simple("O02_global_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 60")
def _(s, d):
    return orders(s, d).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(60)


@simple("O03_top_k_per_group", "SELECT o_custkey, o_orderkey, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders(s, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", "rn")


@simple("O05_tail_k", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events(s, d).withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("user_id", "event_id")


@simple("U01_union_by_name", "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(s, d):
    a = customer(s, d).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return a.unionByName(supplier(s, d).select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")), allowMissingColumns=True)


@simple("U02_union_dedupe", "SELECT id, min(src) AS src FROM (SELECT c_custkey AS id, 0 AS src FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier) GROUP BY 1")
def _(s, d):
    a, b = customer(s, d).select(F.col("c_custkey").alias("id")), supplier(s, d).select(F.col("s_suppkey").alias("id"))
    return P.upsert_first(a.withColumn("src", F.lit(0)), b.withColumn("src", F.lit(1)), "id", [F.col("src")])


@simple("U03_key_intersection", "SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders")
def _(s, d):
    return T.lines(s, d).select("date").intersect(orders(s, d).select(F.to_date("o_orderdate").alias("date")))


@simple("U04_key_difference", "SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders")
def _(s, d):
    return T.lines(s, d).select("date").distinct().join(orders(s, d).select(F.to_date("o_orderdate").alias("date")), "date", "left_anti")


@simple("Z01_string_functions", "SELECT p_partkey, upper(p_name) AS u, split_part(p_name, ' ', 2) AS second, starts_with(p_type, 'S') AS st, contains(p_name, 'ring') AS c, replace(p_brand, '#', '-') AS b FROM part")
def _(s, d):
    return part(s, d).select("p_partkey", F.upper("p_name").alias("u"), F.split("p_name", " ")[1].alias("second"), F.col("p_type").startswith("S").alias("st"), F.col("p_name").contains("ring").alias("c"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("b"))


@simple("Z02_regex_functions", "SELECT doc_id, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS n, regexp_extract(text, '([a-z]+)\\.', 1) AS w FROM documents")
def _(s, d):
    return documents(s, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).cast("bigint").alias("n"), F.regexp_extract("text", r"([a-z]+)\.", 1).alias("w"))


@simple("Z04_date_functions", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(o_orderdate AS DATE) + 30 AS later, CAST(o_orderdate - INTERVAL 3 MONTH AS DATE) AS before, quarter(o_orderdate)::INT AS q, (DATE '2002-01-01' - CAST(o_orderdate AS DATE))::INT AS age FROM orders")
def _(s, d):
    day = F.to_date("o_orderdate")
    return orders(s, d).select("o_orderkey", F.trunc(day, "month").alias("m"), F.date_add(day, 30).alias("later"), F.add_months(day, -3).alias("before"), F.quarter(day).alias("q"), F.datediff(F.lit("2002-01-01").cast("date"), day).alias("age"))


@simple("Z05_math_functions", "SELECT s_suppkey, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 6) AS r, sign(s_acctbal)::INT AS g, least(greatest(s_acctbal, 0), 5000) AS c, round(pow(s_acctbal / 1000, 2), 6) AS p FROM supplier")
def _(s, d):
    x = F.col("s_acctbal")
    return supplier(s, d).select("s_suppkey", F.abs(x).alias("a"), r6(F.sqrt(F.abs(x))).alias("r"), F.signum(x).cast("int").alias("g"), F.least(F.greatest(x, F.lit(0.0)), F.lit(5000.0)).alias("c"), r6(F.pow(x / 1000, F.lit(2.0))).alias("p"))


@simple("Z06_null_handling", "SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, quality, -1) AS t FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    j = documents(s, d).join(labels(s, d), "doc_id", "left")
    return j.select("doc_id", F.coalesce("toxic", "quality", F.lit(-1)).alias("t"), "quality").fillna(0, ["quality"])


@simple("Z07_no_infinity", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round(l_extendedprice / nullif(l_tax, 0), 4) AS x FROM lineitem")
def _(s, d):
    return lineitem(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", r6(F.try_divide("l_extendedprice", "l_tax"), 4).alias("x"))


@simple("Z08_array_functions", "SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type, p_brand, p_type])), ',') AS a, list_contains([p_type, p_brand], 'SMALL') AS c FROM part")
def _(s, d):
    a = F.array("p_type", "p_brand")
    return part(s, d).select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.array_union(a, F.array("p_type")))), ",").alias("a"), F.array_contains(a, "SMALL").alias("c"))


@simple("Z09_map_functions", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events")
def _(s, d):
    return events(s, d).select("event_id", F.explode(F.from_json("props", "map<string,double>")).alias("key", "value"))


@simple("Z10_json_nested_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return events(s, d).select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@simple("Z11_type_coercion", "SELECT doc_id, try_cast(substr(source, 4) AS DOUBLE) AS n, try_cast(lang AS DOUBLE) AS bad FROM documents")
def _(s, d):
    return documents(s, d).select("doc_id", F.substr("source", F.lit(4)).try_cast("double").alias("n"), F.col("lang").try_cast("double").alias("bad"))
