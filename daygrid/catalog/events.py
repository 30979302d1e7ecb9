"""Events, filings and market monitor (V) over pages, documents, orders and lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from daygrid.catalog.base import BRAND, MASTER, NATION_DAILY, query, r6
from daygrid.catalog.panel import order_docs
from daygrid.functions.rolling import DATE, ENTITY
from daygrid.functions.text import suffix_number, visible_text
from daygrid.operators import events as V
from daygrid.operators import panel as P
from daygrid.sources import tables as T
from daygrid.sources.store import saved, spread

_VIS = "html"
for _p, _to in (("(?is)<script.*?</script>", " "), ("(?is)<style.*?</style>", " "), ("(?is)<noscript.*?</noscript>", " "), ("(?is)<br\\s*/?>", " "), ("(?is)</(p|div|section|article|li|tr|h[1-6])>", " "), ("(?is)<[^>]+>", " ")):
    _VIS = f"regexp_replace({_VIS}, '{_p}', '{_to}', 'g')"
for _a, _b in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _VIS = f"replace({_VIS}, '{_a}', '{_b}')"


@query("V01_html_to_text", f"SELECT page_id, trim(regexp_replace({_VIS}, '\\s+', ' ', 'g')) AS text FROM pages")
def _(spark, sf):
    return spread(T.table(spark, sf, "pages").select("page_id", "html")).select("page_id", visible_text("html").alias("text"))


# Every document ends in two or three unlock cards; a filler longer than the look-back separates them from the prose.
_FILL = "x" * 200


def unlock_pages(spark, sf):
    d, k = spread(T.table(spark, sf, "documents").select("doc_id", "text")), F.col("doc_id")
    s = lambda c: c.cast("string")
    card = F.concat(F.lit(" Unlock Value $"), s(k % 90 + 1), F.lit("."), s(k % 10), F.when(k % 3 == 0, "m").when(k % 3 == 1, "k").otherwise(""), F.lit("  421,"), F.lpad(s(k % 1000), 3, "0"), F.lit(" ABC 0.0"), s(k % 9 + 1),
                    F.lit("% (0.5% of float) Mar "), s(k % 28 + 1), F.lit(",  2025 10:00 PM "), F.when(k % 4 == 0, "Core Contributors").when(k % 4 == 1, "seed investors").when(k % 4 == 2, "Zeta Fund").otherwise("foundation"), F.lit(" $5 "))
    second = F.concat(F.lit("Unlock Value $7 , APRIL 2, 2026 Airdrop"), F.when(k % 5 == 0, f" {_FILL} May 3, 2026 for rewards").otherwise(""))
    return d.select("doc_id", F.concat("text", F.lit(f" {_FILL}"), card, second).alias("page"))


@query("V02_unlock_events", """WITH k AS (SELECT doc_id AS k FROM documents WHERE text IS NOT NULL)
  SELECT k AS doc_id, 'unlock' AS event_type, make_date(2025, 3, (k % 28 + 1)::INT) AS date, CASE k % 4 WHEN 0 THEN 'Core Contributors' WHEN 1 THEN 'Investors' WHEN 2 THEN 'Zeta Fund' ELSE 'Foundation' END AS recipient,
    CASE k % 4 WHEN 0 THEN 'Potential Selling' WHEN 1 THEN 'Potential Selling' WHEN 2 THEN 'Zeta Fund' ELSE 'Foundation' END AS bucket, (421000 + k % 1000)::DOUBLE AS token_amount, 'ABC' AS token_symbol,
    ((k % 90 + 1) || '.' || (k % 10))::DOUBLE * CASE k % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 ELSE 1 END AS value_usd, ('0.0' || (k % 9 + 1))::DOUBLE AS pct_supply, 0.5::DOUBLE AS pct_float FROM k
  UNION ALL SELECT k, 'unlock', DATE '2026-04-02', 'Airdrop', 'Airdrop', NULL, '', 7, NULL, NULL FROM k
  UNION ALL SELECT k, 'unlock', DATE '2026-05-03', 'Rewards', 'Rewards', NULL, '', NULL, NULL, NULL FROM k WHERE k % 5 = 0""")
def _(spark, sf):
    return V.unlock_events(unlock_pages(spark, sf), "page", ["doc_id"])


@query("V03_suffix_numbers", """SELECT p_partkey, (p_size * 1000 + 0.5::DOUBLE) * CASE p_partkey % 5 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 WHEN 3 THEN 1e12 ELSE 1 END AS value FROM part""")
def _(spark, sf):
    k = F.col("p_partkey") % 5
    text = F.concat(F.col("p_size").cast("string"), F.lit(",000.5"))
    return T.table(spark, sf, "part").select("p_partkey", suffix_number(text, F.when(k == 0, "K").when(k == 1, "m").when(k == 2, "b").when(k == 3, "T")).alias("value"))


@query("V04_field_extractors", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Team' WHEN 1 THEN 'Alpha Labs' END AS recipient, CASE doc_id % 3 WHEN 0 THEN 12000.0::DOUBLE WHEN 1 THEN 3.5 END AS usd, CASE doc_id % 3 WHEN 2 THEN '' ELSE 'XYZ' END AS symbol,
  CASE doc_id % 3 WHEN 2 THEN NULL ELSE (doc_id % 500)::DOUBLE END AS amount FROM documents""")
def _(spark, sf):
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.concat(F.lit("the team 5 PM "), (k % 500).cast("string"), F.lit(" XYZ Unlock Value $12 k"))).when(
        k % 3 == 1, F.concat((k % 500).cast("string"), F.lit(" XYZ GMT+02:00 Alpha Labs $3.5"))).otherwise("nothing of note")
    d = T.table(spark, sf, "documents").select("doc_id", text.alias("c"))
    c = F.col("c")
    return d.select("doc_id", V.recipient(c).alias("recipient"), V.usd_value(c).alias("usd"), V.token_symbol(c).alias("symbol"), V.token_amount(c, V.token_symbol(c)).alias("amount"))


@query("V05_recipient_bucket", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Potential Selling' WHEN c_custkey % 4 = 1 THEN 'Other' ELSE c_mktsegment END AS bucket FROM customer""")
def _(spark, sf):
    k = F.col("c_custkey") % 4
    r = F.when(k == 0, F.concat(F.lit("Early INVESTOR "), "c_mktsegment")).when(k == 1, "  ").otherwise(F.col("c_mktsegment"))
    return T.table(spark, sf, "customer").select("c_custkey", V.emission_bucket(r).alias("bucket"))


@query("V06_governance_events", """SELECT o_orderkey, 'governance' AS event_type, CAST(o_orderdate AS DATE) AS date, CAST(o_orderdate AS DATE) + 7 AS end_date, 'Governance' AS bucket, round(o_totalprice) AS value_usd, CASE WHEN o_orderkey % 2 = 0 THEN 'closed' ELSE '' END AS state,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Snapshot proposal' ELSE 'Plan ' || o_orderkey END AS title, 'Snapshot space: dao' || (o_orderkey % 4) AS notes, CASE WHEN o_orderkey % 4 = 0 THEN 'https://gov' ELSE 'https://snapshot.box/#/dao' || (o_orderkey % 4) || '/proposal/p' || o_orderkey END AS source_url FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    s = lambda m: (k % m).cast("string")
    pid = F.when(k % 4 != 0, F.concat(F.lit("p"), k.cast("string")))
    p = F.struct(pid.alias("id"), F.when(k % 3 != 0, F.concat(F.lit("Plan "), k.cast("string"))).otherwise("").alias("title"), F.col("sec").alias("start"), (F.col("sec") + 7 * 86_400).alias("end"), F.when(k % 2 == 0, "closed").alias("state"),
                 F.col("v").alias("scores_total"), F.array(F.lit("Yes"), F.lit("No")).alias("choices"), F.struct(F.concat(F.lit("dao"), s(4)).alias("id")).alias("space"))
    doc = F.to_json(F.struct(F.struct(F.array(p).alias("proposals")).alias("data")))
    return V.governance_events(order_docs(spark, sf).withColumn("doc", doc).withColumn("url", F.lit("https://gov")), "doc", ["o_orderkey"], "url")


@query("V07_event_upsert", """SELECT o_custkey, o_orderpriority, o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'fresh' END AS note FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, sf):
    o = T.table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate", "o_orderstatus")
    stored, fresh = o.where("o_orderstatus <> 'O'"), o.where("o_orderstatus = 'O'").withColumn("note", F.lit("fresh"))
    return V.upsert_events(stored, fresh, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey", "note")


FACT_SQL = """WITH fx AS (SELECT o_orderkey AS k, 'C' || (o_custkey % 20) AS ticker, make_date(year(o_orderdate)::INT, 1, 1) AS start, CASE o_orderkey % 4 WHEN 0 THEN make_date(year(o_orderdate)::INT, 3, 31) WHEN 1 THEN make_date(year(o_orderdate)::INT, 6, 30) WHEN 2 THEN make_date(year(o_orderdate)::INT, 9, 30) ELSE make_date(year(o_orderdate)::INT, 12, 31) END AS "end",
    CAST(o_orderdate AS DATE) + 40 AS filed, CASE o_orderkey % 4 WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q2' WHEN 2 THEN 'Q3' ELSE 'FY' END AS fp, CASE WHEN o_orderkey % 4 = 3 THEN '10-K' WHEN o_orderkey % 37 = 0 THEN '8-K' ELSE '10-Q' END AS form, 'a' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS accn, round(o_totalprice) AS value FROM orders),
  facts AS (SELECT *, ("end" - start + 1)::INT AS duration FROM fx WHERE form <> '8-K'),
  lf AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, start, "end" ORDER BY filed DESC, accn DESC) = 1)"""


def filing_documents(spark, sf):
    k = F.col("o_orderkey")
    y = F.year("o_orderdate")
    ends = [F.make_date(y, F.lit(m), F.lit(d)) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    q = k % 4
    end = F.when(q == 0, ends[0]).when(q == 1, ends[1]).when(q == 2, ends[2]).otherwise(ends[3])
    fact = F.struct(F.make_date(y, F.lit(1), F.lit(1)).cast("string").alias("start"), end.cast("string").alias("end"), F.date_add(F.to_date("o_orderdate"), 40).cast("string").alias("filed"),
                    F.when(q == 3, "10-K").when(k % 37 == 0, "8-K").otherwise("10-Q").alias("form"), F.when(q == 3, "FY").otherwise(F.concat(F.lit("Q"), (q + 1).cast("string"))).alias("fp"),
                    F.concat(F.lit("a"), F.lpad(k.cast("string"), 9, "0")).alias("accn"), y.alias("fy"), F.col("v").alias("val"))
    doc = F.to_json(F.struct(F.struct(F.array(fact, fact.withField("start", F.lit("bad"))).alias("USD")).alias("units")))
    return order_docs(spark, sf).select(k.alias("k"), F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("ticker"), doc.alias("doc"))


def facts(spark, sf):
    return V.filing_facts(filing_documents(spark, sf), "doc", ["k", "ticker"])


@query("V08_filing_facts", FACT_SQL + ' SELECT k, ticker, start, "end", filed, fp, form, accn, value, duration FROM facts')
def _(spark, sf):
    return facts(spark, sf).drop("fy")


@query("V09_latest_restatement", FACT_SQL + ' SELECT ticker, start, "end", filed, accn, value FROM lf')
def _(spark, sf):
    return V.latest_facts(facts(spark, sf)).select("ticker", "start", "end", "filed", "accn", "value")


@query("V10_ytd_to_quarter", FACT_SQL + """, dl AS (SELECT *, lag("end") OVER w AS pe, lag(value) OVER w AS pv FROM lf WINDOW w AS (PARTITION BY ticker, start ORDER BY "end")),
  qs AS (SELECT ticker, start, "end", value, duration, 'reported_quarter' AS source FROM lf WHERE duration BETWEEN 70 AND 110 UNION ALL SELECT ticker, pe + 1, "end", value - pv, ("end" - pe)::INT, 'derived_from_ytd_delta' FROM dl WHERE duration > 110 AND pe IS NOT NULL AND value >= pv),
  qq AS (SELECT *, year("end") || 'Q' || quarter("end") AS quarter FROM qs QUALIFY row_number() OVER (PARTITION BY ticker, start, "end" ORDER BY source DESC) = 1)
  SELECT ticker, start, "end", value, duration, source, quarter FROM qq""")
def _(spark, sf):
    q = V.quarterly_from_ytd(saved(facts(spark, sf).drop("k"), "facts"))
    return q.select("ticker", "start", "end", "value", "duration", "source", "quarter")


@query("V11_ytd_duration_test", FACT_SQL + """, v AS (SELECT k, fp, duration + (k % 3)::INT * 30 AS d FROM facts) SELECT k, CASE fp WHEN 'Q1' THEN d BETWEEN 70 AND 110 WHEN 'Q2' THEN d BETWEEN 140 AND 220 WHEN 'Q3' THEN d BETWEEN 230 AND 310 ELSE d BETWEEN 340 AND 390 END AS valid FROM v""")
def _(spark, sf):
    f = facts(spark, sf).withColumn("duration", F.col("duration") + (F.col("k") % 3).cast("int") * 30)
    return f.select("k", V.valid_ytd().alias("valid"))


_TODAY = dt.date(2000, 7, 15)


@query("V12_current_ytd_share", FACT_SQL + """, ok AS (SELECT * FROM facts WHERE "end" >= DATE '2000-01-01' AND ("end" >= DATE '2000-07-15' - 90 OR filed >= DATE '2000-07-15' - 90)),
  l AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY ticker, start, "end" ORDER BY filed DESC, accn DESC) = 1), s AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY "end" DESC, filed DESC, duration DESC, accn DESC) = 1)
  SELECT ticker, "end", filed, value, round(value / sum(value) OVER () * 100, 6) AS pct_of_total FROM s""")
def _(spark, sf):
    out = V.current_ytd(facts(spark, sf).drop("k"), F.lit(_TODAY))
    return out.select("ticker", "end", "filed", "value", r6("pct_of_total").alias("pct_of_total"))


FILING_SQL = """WITH fl AS (SELECT o_custkey % 25 AS issuer, o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN '10-K' WHEN 0 THEN '8-K' ELSE '10-Q' END AS form, CAST(o_orderdate AS DATE) AS filed, CAST(o_orderdate AS DATE) - (o_orderkey % 90)::INT AS period, 'n-' || o_orderkey AS accn,
  CASE WHEN o_orderkey % 6 <> 0 THEN 'n' || o_orderkey || '/doc.htm' ELSE '' END AS document FROM orders)"""


def filings(spark, sf):
    """Each order carries two filings as parallel arrays, the second with a short document array."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    form = F.when(k % 4 == 3, "10-K").when(k % 4 == 0, "8-K").otherwise("10-Q")
    rec = F.struct(F.array(form).alias("form"), F.array(day.cast("string")).alias("filingDate"), F.array(F.date_sub(day, (k % 90).cast("int")).cast("string")).alias("reportDate"), F.array(F.concat(F.lit("n-"), k.cast("string"))).alias("accessionNumber"),
                   F.when(k % 6 != 0, F.array(F.lit("doc.htm"))).otherwise(F.array().cast("array<string>")).alias("primaryDocument"))
    rows = T.table(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("issuer"), k.alias("k"), rec.alias("recent"))
    return V.filing_list(rows, "recent", ["issuer", "k"])


@query("V13_parallel_arrays", FILING_SQL + " SELECT issuer, k, form, filed, period, accn, document FROM fl")
def _(spark, sf):
    return filings(spark, sf)


def issuers(spark, sf):
    n = F.col("n_nationkey")
    fye = F.when(n % 4 == 0, "1231").when(n % 4 == 1, "06-30").when(n % 4 == 2, "0229").otherwise("bad")
    return T.table(spark, sf, "nation").select(n.cast("bigint").alias("issuer"), fye.alias("fye"))


_ENDS = """, isr AS (SELECT n_nationkey AS issuer, CASE n_nationkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 6 WHEN 2 THEN 2 ELSE 12 END AS m, CASE n_nationkey % 4 WHEN 0 THEN 31 WHEN 1 THEN 30 WHEN 2 THEN 29 ELSE 31 END AS d FROM nation),
  qe AS (SELECT DISTINCT issuer, CAST(CAST(make_date(y::INT, m, 1) + (least(d, day(last_day(make_date(y::INT, m, 1)))) - 1)::INT AS DATE) - to_months(o) AS DATE) AS period FROM isr, range({a}, {b}) t(y), (SELECT unnest([0, 3, 6, 9])::INT AS o))"""


@query("V14_fiscal_quarter_ends", "WITH z AS (SELECT 1)" + _ENDS.format(a=1999, b=2001) + " SELECT issuer, period FROM qe")
def _(spark, sf):
    return V.quarter_ends(issuers(spark, sf), ["issuer"], "fye", F.lit(1999), F.lit(2000))


@query("V15_filing_lag_and_next", FILING_SQL + _ENDS.format(a=1990, b=2003) + """, lg AS (SELECT issuer, form, round_even(median(filed - period), 0)::INT AS lag_days FROM fl WHERE filed - period > 0 AND filed - period < 150 GROUP BY 1, 2),
  la AS (SELECT issuer, max(period) AS l FROM fl WHERE form IN ('10-Q', '10-K') AND filed <= DATE '2001-06-01' GROUP BY 1), nx AS (SELECT issuer, min(period) AS period FROM qe JOIN la USING (issuer) WHERE period > l AND period <= DATE '2001-08-15' + 140 AND year(period) >= year(l) - 1 GROUP BY 1),
  f AS (SELECT nx.issuer, period, CASE WHEN strftime(period, '%m%d') = CASE issuer % 4 WHEN 0 THEN '1231' WHEN 1 THEN '0630' WHEN 2 THEN '0229' ELSE '0000' END THEN '10-K' ELSE '10-Q' END AS form FROM nx),
  e AS (SELECT f.*, period + coalesce(lag_days, CASE WHEN f.form = '10-K' THEN 75 ELSE 45 END) AS expected FROM f LEFT JOIN (SELECT issuer, form, round_even(median(filed - period), 0)::INT AS lag_days FROM fl WHERE filed <= DATE '2001-06-01' AND filed - period > 0 AND filed - period < 150 GROUP BY 1, 2) g ON g.issuer = f.issuer AND g.form = f.form)
  SELECT issuer, form, period, expected, (expected - DATE '2001-08-15')::INT AS days, CASE WHEN expected - DATE '2001-08-15' < -30 THEN 'Past estimate' WHEN expected - DATE '2001-08-15' < 0 THEN 'Due/Watch' WHEN expected - DATE '2001-08-15' <= 14 THEN 'Upcoming' ELSE 'Scheduled' END AS status FROM e""")
def _(spark, sf):
    f = saved(filings(spark, sf).where(F.col("filed") <= F.lit(dt.date(2001, 6, 1))), "filings")
    return V.next_filing(f, issuers(spark, sf), "issuer", "fye", F.lit(dt.date(2001, 8, 15)))


@query("V16_notable_filings", FILING_SQL + " SELECT issuer, k, form, filed, accn FROM fl WHERE form IN ('8-K', '10-K') AND filed >= DATE '2001-07-20' - 45")
def _(spark, sf):
    return V.notable_filings(filings(spark, sf), ["8-K", "10-K"], F.lit(dt.date(2001, 7, 20))).select("issuer", "k", "form", "filed", "accn")


_PROT = """WITH p AS (SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal / 100 END AS c7, sum(round(l_extendedprice)) FILTER (l_returnflag = 'A') AS t7, CASE WHEN s_suppkey % 2 = 0 THEN sum(round(l_extendedprice)) FILTER (l_returnflag = 'N') END AS p7,
    sum(l_quantity) FILTER (l_linestatus = 'O') AS t1, sum(l_quantity) FILTER (l_linestatus = 'F') AS p1 FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_acctbal),
  m AS (SELECT ticker, coalesce(c7, CASE WHEN p7 > 0 THEN (t7 / p7 - 1) * 100 END, CASE WHEN p1 > 0 THEN (t1 / p1 - 1) * 100 END) AS change, coalesce(t7, t1) AS latest FROM p)"""


@query("V17_overview_movers", _PROT + """, k AS (SELECT * FROM m WHERE change IS NOT NULL AND latest >= 10000) SELECT 'gainer' AS side, ticker, round(change, 6) + 0.0::DOUBLE AS change, latest FROM (FROM k ORDER BY change DESC, ticker LIMIT 5)
  UNION ALL SELECT 'loser', ticker, round(change, 6) + 0.0::DOUBLE, latest FROM (FROM k ORDER BY change, ticker LIMIT 5)""")
def _(spark, sf):
    flag, st = F.col("l_returnflag"), F.col("l_linestatus")
    ext = F.round("l_extendedprice")
    agg = T.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.when(flag == "A", ext)).alias("total_7d"), F.sum(F.when(flag == "N", ext)).alias("_p7"), F.sum(F.when(st == "O", F.col("l_quantity"))).alias("total_24h"), F.sum(F.when(st == "F", F.col("l_quantity"))).alias("prior_24h"))
    j = agg.join(T.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = j.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") / 100).alias("change_7d"), "total_7d", F.when(F.col("s_suppkey") % 2 == 0, F.col("_p7")).alias("prior_7d"), "total_24h", "prior_24h")
    return V.overview_movers(saved(rows, "overview")).select("side", "ticker", r6("change").alias("change"), "latest")


_MK = f"""mk AS (SELECT entity AS source_id, list_price AS price, n_parts * 1e6 AS fdv, n_parts * 1e5 AS volume, (n * 7 % 19 - 9) * 1.5::DOUBLE AS chg_7d, CASE WHEN n % 6 <> 0 THEN (n * 5 % 23 - 11) * 2.25::DOUBLE END AS chg_30d FROM ({MASTER}))"""


def markets(spark, sf):
    m = T.brand_master(spark, sf)
    n = F.col("n")
    return m.select(F.col(ENTITY).alias("source_id"), F.col("list_price").alias("price"), (F.col("n_parts") * 1e6).alias("fdv"), (F.col("n_parts") * 1e5).alias("volume"), ((n * 7 % 19 - 9) * 1.5).alias("chg_7d"), F.when(n % 6 != 0, (n * 5 % 23 - 11) * 2.25).alias("chg_30d"))


@query("V18_token_movers", BRAND + f""", {_MK}, v AS (SELECT entity AS source_id, sum(volume) AS v FROM daily WHERE date >= (SELECT max(date) FROM days) - 29 GROUP BY 1),
  ok AS (SELECT 'T' || substr(source_id, 7) AS ticker, price, fdv, v AS volume_30d, chg_7d, chg_30d FROM mk JOIN v USING (source_id) WHERE fdv >= 2e7 AND v >= 100000),
  l AS (SELECT ticker, price, fdv, volume_30d, '7D Price' AS horizon, chg_7d AS change FROM ok UNION ALL SELECT ticker, price, fdv, volume_30d, '30D Price', chg_30d FROM ok WHERE chg_30d IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY change DESC, ticker) AS a, row_number() OVER (PARTITION BY horizon ORDER BY change, ticker) AS b FROM l)
  SELECT horizon, 'gainer' AS side, CAST(a AS INT) AS pos, ticker, change, volume_30d FROM r WHERE a <= 5 UNION ALL SELECT horizon, 'loser', CAST(b AS INT), ticker, change, volume_30d FROM r WHERE b <= 5""")
def _(spark, sf):
    last = T.bounds(spark, sf).select("hi").scalar()
    d = T.brand_daily(spark, sf).where(F.col(DATE) >= F.date_sub(last, 29))
    ts = d.select(F.col(ENTITY).alias("source_id"), F.concat(F.lit("T"), F.substr(ENTITY, F.lit(7))).alias("ticker"), DATE, "volume")
    return V.token_movers(ts, markets(spark, sf), 2e7, 100_000.0).select("horizon", "side", "pos", "ticker", "change", "volume_30d")


@query("V19_sector_performance", f"""WITH {_MK}, t AS (SELECT 't' || m.n AS ticker, m.category AS sector, fdv AS value, chg_7d AS change, fdv / (1 + chg_7d / 100) AS b FROM mk JOIN ({MASTER}) m ON m.entity = source_id)
  SELECT sector, sum(value) AS latest, round(sum(b), 3) AS base, count(DISTINCT ticker) AS tokens, round((sum(value) / sum(b) - 1) * 100, 6) + 0.0::DOUBLE AS change,
    array_to_string(list_sort(list(upper(ticker))), ', ') AS token_list FROM t GROUP BY 1""")
def _(spark, sf):
    cats = T.brand_master(spark, sf).select(F.col(ENTITY).alias("source_id"), F.concat(F.lit("t"), F.col("n").cast("string")).alias("ticker"), F.col("category").alias("sector"))
    t = markets(spark, sf).join(cats, "source_id").select("ticker", "sector", F.col("fdv").alias("value"), F.col("chg_7d").alias("change"))
    return V.sector_performance(t).select("sector", "latest", r6("base", 3).alias("base"), "tokens", r6("change").alias("change"), "token_list")


@query("V20_chain_fee_totals", """WITH c AS (SELECT CASE o_custkey % 30 WHEN 0 THEN 'BNB Chain' ELSE 'Chain' || (o_custkey % 30) END AS chain, 2 * round(o_totalprice) + 1 AS v FROM orders UNION ALL SELECT 'OP Mainnet', 3.0 FROM orders)
  SELECT chain, sum(v) AS fees FROM c GROUP BY 1""")
def _(spark, sf):
    v = F.col("v")
    name = F.when(F.col("o_custkey") % 30 == 0, "BSC").otherwise(F.concat(F.lit("chain"), (F.col("o_custkey") % 30).cast("string")))
    part = lambda *kv: F.create_map(*[F.lit(x) if not hasattr(x, "alias") else x for x in kv])
    doc = F.to_json(F.map_from_arrays(F.array(name, F.lit("op mainnet")), F.array(part("a", v, "b", v + 1), part("a", F.lit(3.0)))))
    return V.chain_totals(order_docs(spark, sf).withColumn("doc", doc), "doc")


_FLOW = f"WITH nf AS (SELECT entity, sum(bridge_flow) AS flow FROM ({NATION_DAILY}) GROUP BY 1)"


@query("V21_signed_top", _FLOW + " SELECT * FROM nf WHERE flow <> 0")
def _(spark, sf):
    nf = T.nation_revenue(spark, sf).groupBy(ENTITY).agg(F.sum("bridge_flow").alias("flow"))
    return V.signed_top(saved(nf, "flows"), "flow", ENTITY)


@query("V22_stablecoin_day_change", f"""WITH d AS (SELECT entity, date, dex_volume AS v, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM ({NATION_DAILY}) WHERE dex_volume IS NOT NULL)
  SELECT entity, max(v) FILTER (rn = 1) - max(v) FILTER (rn = 2) AS change, max(v) FILTER (rn = 1) AS supply, max(date) AS as_of FROM d WHERE rn <= 2 GROUP BY 1 HAVING count(*) = 2""")
def _(spark, sf):
    return V.last_change(T.nation_revenue(spark, sf), ENTITY, "dex_volume")


@query("V23_bridge_net_flows", f"""WITH d AS (SELECT entity, arg_max(CASE WHEN entity % 6 <> 0 THEN deposits END, date) FILTER (deposits IS NOT NULL AND entity % 6 <> 0) AS a, arg_max(dex_volume, date) FILTER (dex_volume IS NOT NULL AND entity % 4 <> 0) AS b FROM ({NATION_DAILY}) GROUP BY 1)
  SELECT entity, coalesce(a, 0) - coalesce(b, 0) AS net_flow, coalesce(a, 0) AS deposits, coalesce(b, 0) AS withdrawals FROM d WHERE a IS NOT NULL OR b IS NOT NULL""")
def _(spark, sf):
    d = T.nation_revenue(spark, sf).select(ENTITY, DATE, F.when(F.col(ENTITY) % 6 != 0, F.col("deposits")).alias("deposits"), F.when(F.col(ENTITY) % 4 != 0, F.col("dex_volume")).alias("withdrawals"))
    return V.net_flows(P.latest_values(d, ["deposits", "withdrawals"]), ENTITY)


_SER = BRAND + ", se AS (SELECT date, " + ", ".join(f"max(price) FILTER (entity = 'Brand#{n}') AS p{n}" for n in (1, 2, 3)) + " FROM sparse GROUP BY 1)"
_UP = "OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def three_series(spark, sf):
    """Unfilled daily prices of three brands, one row per calendar day."""
    d = T.brand_daily(spark, sf).where(F.col(ENTITY).isin("Brand#1", "Brand#2", "Brand#3"))
    wide = d.groupBy(DATE).agg(*[F.max(F.when(F.col(ENTITY) == f"Brand#{n}", F.col("price"))).alias(f"p{n}") for n in (1, 2, 3)])
    days = T.bounds(spark, sf).select(F.explode(F.sequence("lo", "hi")).alias(DATE))
    return days.join(wide, DATE, "left")


@query("V24_indexed_benchmarks", _SER + ", ff AS (SELECT date, " + ", ".join(f"last_value(p{n} IGNORE NULLS) {_UP} AS p{n}" for n in (1, 2, 3)) + " FROM se), ok AS (SELECT * FROM ff WHERE p1 IS NOT NULL AND p2 IS NOT NULL AND p3 IS NOT NULL) SELECT date, " + ", ".join(
    f"round(p{n} / first_value(p{n}) OVER (ORDER BY date) * 100, 6) AS p{n}" for n in (1, 2, 3)) + " FROM ok")
def _(spark, sf):
    return V.indexed_table(three_series(spark, sf), ["p1", "p2", "p3"]).select(DATE, *[r6(f"p{n}").alias(f"p{n}") for n in (1, 2, 3)])


@query("V25_ratio_series", _SER + f""", ff AS (SELECT date, last_value(p1 IGNORE NULLS) {_UP} AS a, last_value(p2 IGNORE NULLS) {_UP} AS b FROM se), r AS (SELECT date, a / b AS r FROM ff WHERE a IS NOT NULL AND b IS NOT NULL)
  SELECT date, round(r, 6) AS ratio, round((r / lag(r, 7) OVER (ORDER BY date) - 1) * 100, 6) + 0.0::DOUBLE AS change, round(r / first_value(r) OVER (ORDER BY date) * 100, 6) AS indexed FROM r""")
def _(spark, sf):
    return V.ratio_series(three_series(spark, sf), "p1", "p2").select(DATE, r6("ratio").alias("ratio"), r6("change").alias("change"), r6("indexed").alias("indexed"))


@query("V26_equity_changes", BRAND + """, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rn FROM daily), g AS (SELECT entity, max(price) FILTER (rn = 1) AS l, max(price) FILTER (rn = 2) AS a, max(price) FILTER (rn = 6) AS b, avg(volume) FILTER (rn <= 5) AS v, avg(volume) FILTER (rn BETWEEN 6 AND 10) AS w, max(date) AS as_of FROM r WHERE rn <= 10 GROUP BY 1)
  SELECT entity, round(l, 6) AS last, round((l / a - 1) * 100, 6) + 0.0::DOUBLE AS price_1d, round((l / b - 1) * 100, 6) + 0.0::DOUBLE AS price_5d, round((v / w - 1) * 100, 6) + 0.0::DOUBLE AS volume_5d, as_of FROM g""")
def _(spark, sf):
    out = V.equity_changes(T.brand_daily(spark, sf).select(ENTITY, DATE, F.col("price").alias("close"), "volume"), ENTITY)
    return out.select(ENTITY, *[r6(c).alias(c) for c in ("last", "price_1d", "price_5d", "volume_5d")], "as_of")


@query("V27_pi_cycle", BRAND + """, m AS (SELECT date, CASE WHEN count(btc) OVER a >= 111 THEN avg(btc) OVER a END AS x, CASE WHEN count(btc) OVER b >= 350 THEN avg(btc) OVER b * 2 END AS y FROM btc WHERE btc IS NOT NULL
    WINDOW a AS (ORDER BY date ROWS BETWEEN 110 PRECEDING AND CURRENT ROW), b AS (ORDER BY date ROWS BETWEEN 349 PRECEDING AND CURRENT ROW)), d AS (SELECT *, (x / y - 1) * 100 AS g FROM m)
  SELECT date, round(x, 6) AS dma_111, round(y, 6) AS dma_350x2, round(g, 6) + 0.0::DOUBLE AS distance, round(g - lag(g) OVER (ORDER BY date), 6) + 0.0::DOUBLE AS distance_change, x >= y AS triggered FROM d""")
def _(spark, sf):
    out = V.pi_cycle(T.market_close(T.brand_daily(spark, sf), T.bounds(spark, sf)), "btc")
    return out.select(DATE, *[r6(c).alias(c) for c in ("dma_111", "dma_350x2", "distance", "distance_change")], "triggered")


_MON = "WITH mo AS (SELECT max(CAST(l_shipdate AS DATE)) AS date, sum(l_quantity) AS v FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT BETWEEN DATE '1997-03-01' AND DATE '1997-04-30' GROUP BY date_trunc('month', l_shipdate))"


def monthly(spark, sf):
    x = T.lines(spark, sf).where(~F.col(DATE).between(F.lit(dt.date(1997, 3, 1)), F.lit(dt.date(1997, 4, 30))))
    return x.groupBy(F.trunc(DATE, "month").alias("_m")).agg(F.max(DATE).alias(DATE), F.sum("l_quantity").alias("v")).drop("_m")


@query("V28_year_over_year", _MON + """, x AS (SELECT date, v, CAST(date - INTERVAL 12 MONTH AS DATE) AS t FROM mo) SELECT x.date, round((x.v / y.v - 1) * 100, 6) + 0.0::DOUBLE AS yoy FROM x ASOF LEFT JOIN mo y ON x.t >= y.date""")
def _(spark, sf):
    return V.year_over_year(monthly(spark, sf), "v").withColumn("yoy", r6("yoy"))


@query("V29_money_supply_change", _MON + " SELECT date, round((v / lag(v, 4) OVER (ORDER BY date) - 1) * 100, 6) + 0.0::DOUBLE AS change FROM mo")
def _(spark, sf):
    return V.observations_back(monthly(spark, sf), "v").withColumn("change", r6("change"))


@query("V30_chart_payloads", """WITH a AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, round(o_totalprice) AS v FROM orders) SELECT o_orderkey, date, v AS x, CASE WHEN TRUE THEN v + 1 END AS y FROM a
  UNION ALL SELECT o_orderkey, date + 1, v * 2, NULL FROM a""")
def _(spark, sf):
    ms = F.col("sec") * 1000.0
    pt = lambda t, n, v: F.struct(t.alias("timestamp"), v.alias(n))
    docs = order_docs(spark, sf).withColumns({"a": F.to_json(F.array(pt(ms, "p", F.col("v")), pt(ms + 86_400_000, "p", F.col("v") * 2))), "b": F.to_json(F.array(pt(F.col("sec") * 1.0, "q", F.col("v") + 1)))})
    one = V.points_frame(docs, "a", {"p": "x"}, ["o_orderkey"], F.lit(True))
    two = V.points_frame(docs, "b", {"q": "y"}, ["o_orderkey"], F.lit(False))
    return V.merge_charts([one, two], ["o_orderkey"])


@query("V31_epoch_unit", """SELECT count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, TRUE AS millis FROM orders""")
def _(spark, sf):
    from daygrid.sources import payloads

    o = order_docs(spark, sf).withColumn("t", F.col("sec") * 1000.0)
    ms = payloads.epoch_unit(o, "t")
    day = F.to_date(payloads.epoch_to_timestamp(F.col("t"), ms))
    return o.agg(F.count("*").alias("n"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.first(ms).alias("millis"))


@query("V32_embedded_table", """SELECT page_id, CASE i WHEN 0 THEN 'Zed' || page_id ELSE 'BNB Chain' END AS chain, page_id * (1 - 2 * i) * 1.0::DOUBLE AS net_flow, page_id * 2.0::DOUBLE AS deposits, CASE i WHEN 0 THEN page_id * 1.0::DOUBLE END AS withdrawals FROM pages, (SELECT unnest([0, 1]) AS i) WHERE page_id % 3 <> 0""")
def _(spark, sf):
    k = F.col("page_id").cast("double")
    row = lambda name, f, w: F.struct(name.alias("name"), f.alias("prevDayNetFlow"), (k * 2).alias("prevDayUsdDeposits"), w.alias("prevDayUsdWithdrawals"))
    table = F.array(row(F.concat(F.lit("zed"), F.col("page_id").cast("string")), k, k), row(F.lit("bsc"), -k, F.lit(None).cast("double")), row(F.lit("gone"), F.lit(None).cast("double"), k))
    data = F.to_json(F.struct(F.struct(F.struct(table.alias("tableData")).alias("pageProps")).alias("props")))
    script = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>"))).otherwise("")
    return V.embedded_table(T.table(spark, sf, "pages").withColumn("html", F.concat("html", script)), "html", ["page_id"])


@query("V33_canonical_chain", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'BNB Chain' WHEN 1 THEN 'Unknown' ELSE 'Nation_' || n_nationkey END AS chain FROM nation")
def _(spark, sf):
    n = F.col("n_nationkey")
    name = F.when(n % 3 == 0, " BSC ").when(n % 3 == 1, "").otherwise(F.concat(F.lit("nation_"), n.cast("string")))
    return T.table(spark, sf, "nation").select("n_nationkey", V.canonical_chain(name).alias("chain"))


@query("V34_watchlist_prices", """WITH h AS (SELECT o_custkey AS k, list(o_totalprice ORDER BY o_orderdate, o_orderkey) AS h FROM orders GROUP BY 1)
  SELECT c_name AS name, c_custkey AS symbol, CASE WHEN c_custkey % 2 = 0 THEN 'Token' ELSE 'equity' END AS asset_type, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END ELSE h[-1] END AS price,
    round(CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal / 100 END WHEN len(h) >= 2 AND h[1] > 0 THEN (h[-1] / h[1] - 1) * 100 END, 6) + 0.0::DOUBLE AS week_change,
    CASE WHEN (CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END ELSE h[-1] END) IS NULL THEN 'Unavailable' WHEN c_custkey % 2 = 0 THEN 'Market' ELSE 'History' END AS source FROM customer LEFT JOIN h ON k = c_custkey""")
def _(spark, sf):
    c, k = T.table(spark, sf, "customer"), F.col("c_custkey")
    watch = c.select(F.col("c_name").alias("name"), k.alias("symbol"), F.when(k % 2 == 0, "Token").otherwise("equity").alias("asset_type"))
    tokens = c.where(k % 5 != 0).select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("price"), (F.col("c_acctbal") / 100).alias("change_7d"))
    o = T.table(spark, sf, "orders")
    # a history needs its first and last point only, so no order list is gathered
    edge = F.struct("o_orderdate", "o_orderkey")
    h = o.groupBy(F.col("o_custkey").alias("symbol")).agg(F.min_by("o_totalprice", edge).alias("a"), F.max_by("o_totalprice", edge).alias("b"), F.count("*").alias("n"))
    equities = h.select("symbol", F.when(F.col("n") >= 2, F.array("a", "b")).otherwise(F.array("b")).alias("history"))
    return V.watchlist_prices(watch, tokens, equities).withColumn("week_change", r6("week_change"))
