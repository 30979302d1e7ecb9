"""Entity resolution (E): part, supplier, customer and nation act as vendor directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from daygrid.catalog.base import BRAND, MASTER, query
from daygrid.functions.rolling import DATE
from daygrid.functions.text import display_name, normalise_text, slugify, strip_version
from daygrid.operators import resolve as E
from daygrid.sources import tables as T

NORM = "regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '', 'g')"
SLUG = "trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '-')"
VW = r"\b(v\d+(?:\+\d+)?|version\s*\d+|slipstream|classic|legacy)\b"
PLAIN = "regexp_replace(lower(coalesce({x}, '')), '[()\\[\\],.]', ' ', 'g')"

PROTO = """WITH pr AS (SELECT p_partkey AS k, replace(p_name, ' ', '-') || '-' || p_partkey AS slug,
    p_name || CASE p_partkey % 4 WHEN 0 THEN ' V2' WHEN 1 THEN ' (Classic)' ELSE '' END AS name,
    CASE WHEN p_partkey % 97 = 0 THEN 'USDT' WHEN p_partkey % 53 = 0 THEN '-' ELSE lower(substr(p_name, 1, 3)) || (p_partkey % 50) END AS symbol,
    CASE p_type WHEN 'SMALL' THEN 'Dexs' WHEN 'ECONOMY' THEN 'Lending' WHEN 'STANDARD' THEN 'Yield' WHEN 'PROMO' THEN 'CEX' WHEN 'LARGE' THEN 'Liquid Staking' ELSE 'Other' END AS category,
    CASE WHEN p_partkey % 6 <> 0 THEN round(p_retailprice) END AS tvl, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 2 END AS mcap,
    CASE WHEN p_partkey % 5 = 0 THEN 'g-' || (p_partkey % 40) END AS gecko_id,
    CASE WHEN p_partkey % 7 = 0 THEN 'parent#' || split_part(p_name, ' ', 1) WHEN p_partkey % 11 = 0 THEN 'Some Group ' || split_part(p_name, ' ', 2) END AS parent,
    [p_brand, 'Brand#' || (p_partkey % 3)] AS chains, p_partkey % 29 <> 0 AS latest_ok FROM part)"""


def protocols(spark, sf):
    p, k, n = T.table(spark, sf, "part"), F.col("p_partkey"), F.col("p_name")
    ks = lambda m: (k % m).cast("string")
    cat = F.coalesce(F.create_map(*[F.lit(x) for kv in (("SMALL", "Dexs"), ("ECONOMY", "Lending"), ("STANDARD", "Yield"), ("PROMO", "CEX"), ("LARGE", "Liquid Staking")) for x in kv])[F.col("p_type")], F.lit("Other"))
    return p.select(
        k.alias("k"), F.concat(F.replace(n, F.lit(" "), F.lit("-")), F.lit("-"), k.cast("string")).alias("slug"),
        F.concat(n, F.when(k % 4 == 0, " V2").when(k % 4 == 1, " (Classic)").otherwise("")).alias("name"),
        F.when(k % 97 == 0, "USDT").when(k % 53 == 0, "-").otherwise(F.concat(F.lower(F.substring(n, 1, 3)), ks(50))).alias("symbol"), cat.alias("category"),
        F.when(k % 6 != 0, F.round("p_retailprice")).alias("tvl"), F.when(k % 3 == 0, F.col("p_retailprice") * 2).alias("mcap"), F.when(k % 5 == 0, F.concat(F.lit("g-"), ks(40))).alias("gecko_id"),
        F.when(k % 7 == 0, F.concat(F.lit("parent#"), F.split(n, " ")[0])).when(k % 11 == 0, F.concat(F.lit("Some Group "), F.split(n, " ")[1])).alias("parent"),
        F.array(F.col("p_brand"), F.concat(F.lit("Brand#"), ks(3))).alias("chains"), (k % 29 != 0).alias("latest_ok"), F.lit(None).cast("boolean").alias("disabled"))


@query("E01_normalise_text", PROTO + f" SELECT k, {NORM.format(x='name')} AS text_key, {NORM.format(x='symbol')} AS symbol_key FROM pr")
def _(spark, sf):
    return protocols(spark, sf).select("k", normalise_text("name").alias("text_key"), normalise_text("symbol").alias("symbol_key"))


@query("E02_slugify", PROTO + f" SELECT k, {SLUG.format(x='name')} AS slug FROM pr")
def _(spark, sf):
    return protocols(spark, sf).select("k", slugify("name").alias("slug"))


_DISP = "array_to_string([CASE WHEN len(w) <= 3 THEN upper(w) ELSE upper(w[1:1]) || lower(w[2:]) END for w in string_split(replace({x}, '_', '-'), '-') if w <> ''], ' ')"


@query("E03_display_name", PROTO + f" SELECT k, {_DISP.format(x='slug')} AS name FROM pr")
def _(spark, sf):
    return protocols(spark, sf).select("k", display_name("slug").alias("name"))


_BASE = NORM.format(x="regexp_replace(" + PLAIN.format(x="{x}") + f", '{VW}', ' ', 'g')")
_VER = "regexp_matches(" + PLAIN.format(x="{x}") + f", '{VW}')"


def _fill(t, x):
    return t.replace("{x}", x)


@query("E04_strip_version", PROTO + f" SELECT k, {_fill(_BASE, 'name')} AS base, {_fill(_VER, 'name')} AS versioned FROM pr")
def _(spark, sf):
    base, ver = strip_version("name")
    return protocols(spark, sf).select("k", base.alias("base"), ver.alias("versioned"))


_KEY = f"""CASE WHEN parent LIKE 'parent#%' THEN 'parent:' || substr(parent, 8) WHEN coalesce(parent, '') <> '' THEN 'parent:' || {SLUG.format(x='parent')}
  WHEN coalesce(nullif({NORM.format(x='gecko_id')}, ''), {NORM.format(x='symbol')}) <> '' AND {_fill(_BASE, 'name')} <> '' AND ({_fill(_VER, 'name')} OR {_fill(_VER, "replace(slug, '-', ' ')")})
  THEN 'heuristic:' || coalesce(nullif({NORM.format(x='gecko_id')}, ''), {NORM.format(x='symbol')}) || ':' || {_fill(_BASE, 'name')} ELSE 'slug:' || slug END"""


@query("E05_group_key", PROTO + f" SELECT k, {_KEY} AS group_key FROM pr")
def _(spark, sf):
    return protocols(spark, sf).select("k", E.group_key().alias("group_key"))


_CANDF = f"""latest_ok AND {NORM.format(x='symbol')} NOT IN ('', 'usdt', 'usdc', 'dai') AND lower(category) <> 'cex' AND NOT contains({NORM.format(x='name')}, 'wrapped') AND NOT starts_with({NORM.format(x='name')}, 'staked')
  AND NOT contains({NORM.format(x='name')}, 'pegged')"""


@query("E06_candidate_filter", PROTO + f" SELECT k, {_CANDF} AS candidate FROM pr")
def _(spark, sf):
    return protocols(spark, sf).select("k", E.protocol_candidate().alias("candidate"))


_CP = "CASE lower(category) WHEN 'dexs' THEN 1 WHEN 'lending' THEN 2 WHEN 'liquid staking' THEN 3 WHEN 'yield' THEN 3 ELSE 99 END"
_GROUPED = PROTO + f""", cd AS (SELECT *, {_KEY} AS group_key, coalesce(tvl, 0) AS t, upper(nullif(symbol, '-')) AS sym FROM pr WHERE {_CANDF}),
  rk AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY t DESC, slug) AS pos, row_number() OVER (PARTITION BY group_key ORDER BY {_CP}, t DESC, slug) AS cpos FROM cd),
  gr AS (SELECT group_key, count(*) AS n, max(slug) FILTER (pos = 1) AS best_slug, max(name) FILTER (pos = 1) AS best_name, sum(t) AS tvl, max(mcap) AS mcap, arg_min(gecko_id, pos) FILTER (gecko_id IS NOT NULL) AS gecko_id,
    arg_min(sym, pos) FILTER (sym IS NOT NULL) AS ticker, max(category) FILTER (cpos = 1) AS category, list_sort(list_distinct(flatten(list(chains)))) AS chains, list(slug ORDER BY pos) AS child FROM rk GROUP BY 1)"""


@query("E07_category_by_priority", _GROUPED + " SELECT group_key, category FROM gr")
def _(spark, sf):
    return E.asset_frame(protocols(spark, sf)).select("group_key", "category")


@query("E08_first_valid_and_children", _GROUPED + " SELECT group_key, gecko_id, ticker, array_to_string(child, '|') AS child_slugs FROM gr")
def _(spark, sf):
    return E.asset_frame(protocols(spark, sf)).select("group_key", "gecko_id", "ticker", "child_slugs")


_CANON = "CASE WHEN group_key LIKE 'parent:%' AND n > 1 THEN substr(group_key, 8) ELSE best_slug END"


@query("E09_asset_frame", _GROUPED + f""", af AS (SELECT {_CANON} AS entity, group_key, ticker, CASE WHEN n > 1 AND group_key LIKE 'parent:%' THEN {_DISP.format(x=_CANON)} || ' (Combined)' WHEN n > 1 THEN split_part(best_name, ' V', 1) || ' (Combined)' ELSE best_name END AS name,
    'project' AS asset_type, category, gecko_id, array_to_string(child, '|') AS child_slugs, array_to_string(chains, '|') AS chains, CASE WHEN tvl > 0 THEN tvl END AS tvl, mcap,
    CASE WHEN group_key LIKE 'parent:%' AND n > 1 THEN 'parent_group' ELSE 'exact_slug' END AS match_method, CASE WHEN group_key LIKE 'parent:%' OR n = 1 THEN 1.0::DOUBLE ELSE 0.86 END AS match_confidence FROM gr)
  SELECT * FROM af UNION ALL SELECT 'chain:' || replace(lower(n_name), '_', '-'), 'chain:' || replace(lower(n_name), '_', '-'), 'N' || n_nationkey, n_name, 'chain', 'L1 / L2', 'g' || n_nationkey, NULL, n_name, CASE WHEN n_regionkey > 0 THEN n_regionkey * 100.0::DOUBLE END, NULL, 'chain_gecko_id', 1.0
  FROM nation WHERE n_nationkey % 4 <> 0""")
def _(spark, sf):
    n = T.table(spark, sf, "nation")
    chains = n.select(F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("symbol"), F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("g"), F.col("n_nationkey"))).alias("gecko_id"), (F.col("n_regionkey") * 100.0).alias("tvl"))
    return E.asset_frame(protocols(spark, sf), chains)


def directory(spark, sf):
    """Nested vendor directory built from the suppliers, some slugs twice."""
    s, k = T.table(spark, sf, "supplier"), F.col("s_suppkey")
    bal = F.col("s_acctbal")
    return s.select(
        F.when(k % 17 != 0, F.concat(F.lit("sup-"), (k % 80).cast("string"))).alias("slug"), k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("s"), k.cast("string"))).otherwise("").alias("code"),
        F.when(k % 2 == 0, F.col("s_name")).alias("title"), F.col("s_name").alias("name"), F.when(k % 5 == 0, "Infrastructure").when(k % 7 == 0, "Spot ETF").alias("type"), F.lit("token").alias("asset_class"),
        F.when(k % 4 == 0, "DeFi").alias("sector"), F.when(k % 11 == 0, "Treasury").otherwise("App").alias("category"), F.struct(F.when(k % 2 == 0, bal).alias("usd")).alias("price"),
        F.struct(F.when(k % 3 != 0, bal * 10).alias("usd"), k.cast("int").alias("rank"), (bal / 100).alias("pct_7d"), (bal / 50).alias("pct_30d")).alias("market_cap"),
        F.struct(F.lit(None).cast("double").alias("usd")).alias("fdv"), F.struct(F.when(k % 6 == 0, F.concat(F.lit("proj-"), k.cast("string"))).alias("slug")).alias("project"), F.when(k % 8 == 0, True).alias("is_preview"), k.alias("seq"))


_DIR = """WITH d AS (SELECT s_suppkey AS k, 'sup-' || (s_suppkey % 80) AS slug, s_name, s_acctbal AS b, CASE WHEN s_suppkey % 5 = 0 THEN 'Infrastructure' WHEN s_suppkey % 7 = 0 THEN 'Spot ETF' END AS type,
  CASE WHEN s_suppkey % 4 = 0 THEN 'DeFi' END AS sector, CASE WHEN s_suppkey % 11 = 0 THEN 'Treasury' ELSE 'App' END AS category FROM supplier WHERE s_suppkey % 17 <> 0)"""


@query("E10_directory_frame", _DIR + """ SELECT 'bw:' || slug AS asset_id, slug AS entity, CASE WHEN k % 3 = 0 THEN 'S' || k END AS ticker, s_name AS name, CASE WHEN type = 'Infrastructure' THEN 'chain' WHEN type = 'Spot ETF' THEN 'etf' WHEN category = 'Treasury' THEN 'treasury' ELSE 'project' END AS asset_type,
  coalesce(type, 'token') AS sector, coalesce(sector, type, category) AS category, k % 2 = 0 AS has_price, k % 3 <> 0 AS has_market_cap, FALSE AS has_fdv FROM d QUALIFY row_number() OVER (PARTITION BY slug ORDER BY k) = 1""")
def _(spark, sf):
    return E.directory_frame(directory(spark, sf))


@query("E25_directory_metadata", _DIR + """ SELECT slug AS entity, CASE WHEN k % 6 = 0 THEN 'proj-' || k ELSE slug END AS metric_slug, 'token' AS asset_class, k % 8 = 0 AS is_preview, CASE WHEN k % 2 = 0 THEN b END AS price,
  CASE WHEN k % 3 <> 0 THEN b * 10 END AS mcap, CAST(k AS INT) AS mcap_rank, b / 100 AS price_7d_pct, b / 50 AS price_30d_pct FROM d""")
def _(spark, sf):
    return E.directory_metadata(directory(spark, sf))


LEFT = """WITH m AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 6 = 0 THEN 'supplier-' || (c_custkey % 150) ELSE 'cust-' || c_custkey END AS slug, 'S' || (c_custkey % 30) AS ticker,
    CASE c_custkey % 4 WHEN 1 THEN 'Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') || ' (Combined)' WHEN 2 THEN 'supplier ' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') WHEN 3 THEN 'Dup Name' ELSE c_name END AS name,
    CASE WHEN c_custkey % 5 = 0 THEN 'supplier-' || (c_custkey % 130) END AS dslug, CASE WHEN c_custkey % 9 = 0 THEN 'Supplier-' || (c_custkey % 120) END AS gecko, c_custkey % 10 = 0 AS is_chain,
    CASE WHEN c_custkey % 100 = 10 THEN 'supplier-5' END AS ovr FROM customer),
  c AS (SELECT 'supplier-' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 0 THEN 'Dup Name' ELSE s_name END AS name, 'S' || (s_suppkey % 30) AS symbol FROM supplier)""" + f""",
  cn AS (SELECT {NORM.format(x='name')} AS n, min(id) AS id, min(symbol) AS symbol FROM c GROUP BY 1 HAVING count(*) = 1),
  cs AS (SELECT {NORM.format(x='name')} || '|' || {NORM.format(x='symbol')} AS n, min(id) AS id FROM c GROUP BY 1 HAVING count(*) = 1)"""


def left_and_coins(spark, sf):
    c, k = T.table(spark, sf, "customer"), F.col("c_custkey")
    pad = F.lpad((k % 150).cast("string"), 9, "0")
    num = lambda m: (k % m).cast("string")
    name = F.when(k % 4 == 1, F.concat(F.lit("Supplier#"), pad, F.lit(" (Combined)"))).when(k % 4 == 2, F.concat(F.lit("supplier "), pad)).when(k % 4 == 3, "Dup Name").otherwise(F.col("c_name"))
    left = c.select(k.alias("entity"), F.when(k % 6 == 0, F.concat(F.lit("supplier-"), num(150))).otherwise(F.concat(F.lit("cust-"), k.cast("string"))).alias("slug"), F.concat(F.lit("S"), num(30)).alias("ticker"), name.alias("name"),
                    F.when(k % 5 == 0, F.concat(F.lit("supplier-"), num(130))).alias("dslug"), F.when(k % 9 == 0, F.concat(F.lit("Supplier-"), num(120))).alias("gecko"), (k % 10 == 0).alias("is_chain"),
                    F.when(k % 100 == 10, "supplier-5").alias("override"))
    s, j = T.table(spark, sf, "supplier"), F.col("s_suppkey")
    coins = s.select(F.concat(F.lit("supplier-"), j.cast("string")).alias("id"), F.when(j % 10 == 0, "Dup Name").otherwise(F.col("s_name")).alias("name"), F.concat(F.lit("S"), (j % 30).cast("string")).alias("symbol"))
    return left, coins


_PLAINN = "replace(m.name, ' (Combined)', '')"


@query("E11_name_symbol_score", LEFT + f""" SELECT m.entity, CASE WHEN a AND b THEN 'exact_name_symbol' WHEN a THEN 'exact_name' WHEN b THEN 'symbol_only' ELSE 'unmatched' END AS method, CASE WHEN a AND b THEN 0.92::DOUBLE WHEN a THEN 0.82 WHEN b THEN 0.55 ELSE 0 END AS confidence
  FROM (SELECT m.entity, {NORM.format(x='m.name')} = {NORM.format(x='c.name')} AS a, {NORM.format(x='m.ticker')} = {NORM.format(x='c.symbol')} AS b FROM m JOIN c ON c.id = 'supplier-' || (m.entity % 100)) m""")
def _(spark, sf):
    left, coins = left_and_coins(spark, sf)
    pairs = left.withColumn("id", F.concat(F.lit("supplier-"), (F.col("entity") % 100).cast("string"))).join(coins.select("id", F.col("name").alias("cname"), "symbol"), "id")
    method, conf = E.match_score(F.col("name"), F.col("ticker"), F.col("cname"), F.col("symbol"))
    return pairs.select("entity", method.alias("method"), conf.alias("confidence"))


@query("E12_unique_lookup", LEFT + " SELECT n AS key, id AS target FROM cn")
def _(spark, sf):
    return E.unique_lookup(left_and_coins(spark, sf)[1], normalise_text("name"), "id")


_CG = LEFT + f""", x AS (SELECT m.*, o.id AS i0, g.id AS i1, d.id AS i2, s.id AS i3, cs.id AS i4, cn.id AS i5, cn.symbol AS sy FROM m LEFT JOIN c o ON o.id = m.ovr LEFT JOIN c g ON g.id = lower(m.gecko) LEFT JOIN c d ON d.id = lower(m.dslug) LEFT JOIN c s ON s.id = lower(m.slug)
    LEFT JOIN cs ON cs.n = {NORM.format(x=_PLAINN)} || '|' || {NORM.format(x='m.ticker')} LEFT JOIN cn ON cn.n = {NORM.format(x=_PLAINN)}),
  cgm AS (SELECT entity, 'coingecko' AS source, CASE WHEN i0 IS NOT NULL THEN 'coingecko_override' WHEN i1 IS NOT NULL THEN 'coingecko_known_id' WHEN i2 IS NOT NULL THEN 'coingecko_exact_slug' WHEN i3 IS NOT NULL THEN 'coingecko_exact_id'
      WHEN i4 IS NOT NULL THEN 'coingecko_exact_name_symbol' WHEN i5 IS NOT NULL AND NOT contains(name, '(Combined)') THEN 'coingecko_exact_name' WHEN i5 IS NOT NULL AND lower(sy) = lower(ticker) THEN 'coingecko_symbol_only' ELSE 'unmatched' END AS method,
    CASE WHEN i0 IS NOT NULL THEN 0.98::DOUBLE WHEN i1 IS NOT NULL THEN 0.97 WHEN i2 IS NOT NULL THEN 0.9 WHEN i3 IS NOT NULL THEN 0.9 WHEN i4 IS NOT NULL THEN 0.92 WHEN i5 IS NOT NULL AND NOT contains(name, '(Combined)') THEN 0.82
      WHEN i5 IS NOT NULL AND lower(sy) = lower(ticker) THEN 0.55 ELSE 0 END AS confidence,
    coalesce(i0, i1, i2, i3, i4, CASE WHEN NOT contains(name, '(Combined)') THEN i5 END) AS target FROM x)"""


def match_coins(spark, sf):
    left, coins = left_and_coins(spark, sf)
    plain = F.replace("name", F.lit(" (Combined)"), F.lit(""))
    by_id = E.any_lookup(coins, F.lower("id"), "id")
    pair = E.unique_lookup(coins, E.pair_key(F.col("name"), F.col("symbol")), "id")
    by_name = E.unique_lookup(coins, normalise_text("name"), "id")
    # the name step rescores with the name as shown, so combined names keep no name match
    shown = ~F.col("name").contains("(Combined)")
    steps = [E.Step("coingecko_override", 0.98, F.lower("override"), by_id), E.Step("coingecko_known_id", 0.97, F.lower("gecko"), by_id), E.Step("coingecko_exact_slug", 0.9, F.lower("dslug"), by_id),
             E.Step("coingecko_exact_id", 0.9, F.lower("slug"), by_id), E.Step("coingecko_exact_name_symbol", 0.92, E.pair_key(plain, F.col("ticker")), pair),
             E.Step("coingecko_exact_name", 0.82, F.when(shown, normalise_text(plain)), by_name)]
    return E.cascade_match(left, "entity", steps, "coingecko")


@query("E13_match_market_data", _CG + " SELECT entity, source, method, confidence, target FROM cgm")
def _(spark, sf):
    return match_coins(spark, sf)


@query("E14_match_directory", LEFT + f""", x AS (SELECT m.entity, d.id AS i0, s.id AS i1, cs.id AS i2, cn.id AS i3 FROM m LEFT JOIN c d ON d.id = lower(m.dslug) LEFT JOIN c s ON s.id = lower(m.slug)
    LEFT JOIN cs ON cs.n = {NORM.format(x=_PLAINN)} || '|' || {NORM.format(x='m.ticker')} LEFT JOIN cn ON cn.n = {NORM.format(x=_PLAINN)})
  SELECT entity, 'blockworks' AS source, CASE WHEN coalesce(i0, i1) IS NOT NULL THEN 'blockworks_exact_slug' WHEN i2 IS NOT NULL THEN 'blockworks_exact_name_symbol' WHEN i3 IS NOT NULL THEN 'blockworks_exact_name' ELSE 'unmatched' END AS method,
    CASE WHEN coalesce(i0, i1) IS NOT NULL THEN 0.9::DOUBLE WHEN i2 IS NOT NULL THEN 0.86 WHEN i3 IS NOT NULL THEN 0.76 ELSE 0 END AS confidence, coalesce(i0, i1, i2, i3) AS target FROM x""")
def _(spark, sf):
    left, coins = left_and_coins(spark, sf)
    plain = F.replace("name", F.lit(" (Combined)"), F.lit(""))
    by_id = E.any_lookup(coins, F.lower("id"), "id")
    steps = [E.Step("blockworks_exact_slug", 0.9, F.lower("dslug"), by_id), E.Step("blockworks_exact_slug", 0.9, F.lower("slug"), by_id),
             E.Step("blockworks_exact_name_symbol", 0.86, E.pair_key(plain, F.col("ticker")), E.unique_lookup(coins, E.pair_key(F.col("name"), F.col("symbol")), "id")),
             E.Step("blockworks_exact_name", 0.76, normalise_text(plain), E.unique_lookup(coins, normalise_text("name"), "id"))]
    return E.cascade_match(left, "entity", steps, "blockworks")


@query("E15_match_protocol", LEFT + f""", x AS (SELECT m.*, s.id AS i1, cs.id AS i2, cn.id AS i3 FROM m LEFT JOIN c s ON s.id = lower(m.slug) LEFT JOIN cs ON cs.n = {NORM.format(x='m.name')} || '|' || {NORM.format(x='m.ticker')} LEFT JOIN cn ON cn.n = {NORM.format(x='m.name')})
  SELECT entity, 'defillama' AS source, CASE WHEN is_chain THEN 'defillama_chain_name' WHEN i1 IS NOT NULL THEN 'defillama_exact_slug' WHEN i2 IS NOT NULL THEN 'defillama_exact_name_symbol' WHEN i3 IS NOT NULL THEN 'defillama_exact_name' ELSE 'unmatched' END AS method,
    CASE WHEN is_chain THEN 0.86::DOUBLE WHEN i1 IS NOT NULL THEN 0.88 WHEN i2 IS NOT NULL THEN 0.9 WHEN i3 IS NOT NULL THEN 0.82 ELSE 0 END AS confidence, CASE WHEN is_chain THEN name ELSE coalesce(i1, i2, i3) END AS target FROM x""")
def _(spark, sf):
    left, coins = left_and_coins(spark, sf)
    chains = left.where("is_chain").select("entity", F.lit("defillama").alias("source"), F.lit("defillama_chain_name").alias("method"), F.lit(0.86).alias("confidence"), F.col("name").alias("target"))
    steps = [E.Step("defillama_exact_slug", 0.88, F.lower("slug"), E.any_lookup(coins, F.lower("id"), "id")),
             E.Step("defillama_exact_name_symbol", 0.9, E.pair_key(F.col("name"), F.col("ticker")), E.unique_lookup(coins, E.pair_key(F.col("name"), F.col("symbol")), "id")),
             E.Step("defillama_exact_name", 0.82, normalise_text("name"), E.unique_lookup(coins, normalise_text("name"), "id"))]
    return chains.unionByName(E.cascade_match(left.where("NOT is_chain"), "entity", steps, "defillama"))


@query("E16_match_venue", LEFT + """, sp AS (SELECT DISTINCT 'S' || (s_suppkey % 20) || 'USDT' AS symbol FROM supplier), fu AS (SELECT DISTINCT 'S' || (s_suppkey % 12) || 'USDT' AS symbol FROM supplier),
  x AS (SELECT entity, CASE WHEN entity % 8 = 0 THEN 'S3USDT' END AS cf, upper(ticker) || 'USDT' AS ex FROM m),
  y AS (SELECT *, CASE WHEN cf IN (SELECT symbol FROM sp) THEN cf WHEN ex IN (SELECT symbol FROM sp) THEN ex END AS spot_symbol, CASE WHEN cf IN (SELECT symbol FROM fu) THEN cf WHEN ex IN (SELECT symbol FROM fu) THEN ex END AS futures_symbol FROM x)
  SELECT entity, spot_symbol, futures_symbol, CASE WHEN coalesce(spot_symbol, futures_symbol) IS NULL THEN 'binance_unmatched' WHEN coalesce(cf = spot_symbol OR cf = futures_symbol, FALSE) THEN 'binance_config_slug' ELSE 'binance_exact_symbol' END AS method,
    CASE WHEN coalesce(spot_symbol, futures_symbol) IS NULL THEN 0.0::DOUBLE ELSE 0.95 END AS confidence FROM y""")
def _(spark, sf):
    left, _ = left_and_coins(spark, sf)
    j = F.col("s_suppkey")
    sym = lambda m: T.table(spark, sf, "supplier").select(F.concat(F.lit("S"), (j % m).cast("string"), F.lit("USDT")).alias("symbol")).distinct()
    return E.venue_match(left, F.when(F.col("entity") % 8 == 0, "S3USDT"), sym(20), sym(12))


@query("E17_match_audit", _CG + """, b AS (SELECT entity, method, confidence FROM cgm UNION ALL SELECT entity, 'venue', 0.95 FROM m WHERE entity % 4 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY confidence DESC, method DESC) AS rn FROM b)
  SELECT m.entity, coalesce(method, 'blockworks_only') AS match_method, coalesce(confidence, 1.0::DOUBLE) AS match_confidence FROM m LEFT JOIN r ON r.entity = m.entity AND rn = 1""")
def _(spark, sf):
    left, _ = left_and_coins(spark, sf)
    venue = left.where("entity % 4 = 0").select("entity", F.lit("venue").alias("method"), F.lit(0.95).alias("confidence"))
    audits = match_coins(spark, sf).select("entity", "method", "confidence").unionByName(venue)
    return E.attach_audit(left.select("entity"), audits)


# Every vendor metric id of every family, and two that belong to none.
_IDS = ("token-price-usd", "token-market-cap-usd", "market-cap-usd", "token-fdv-usd", "fdv-usd", "rev-usd", "revenue-total-usd", "app-revenue-total-usd", "dex-revenue-usd", "lending-revenue-total-usd",
        "transaction-fee-total-usd", "dex-fees-usd", "fees-total-usd", "app-fees-total-usd", "mev-tips-fees-usd", "lending-deposit-total-usd", "lending-tvl-total-usd", "tvl-total-usd", "other-a", "other-b")
_ID_LIST = "[" + ", ".join(f"'{i}'" for i in _IDS) + "]"
_CAT = f"""SELECT s_suppkey AS entity, list_sort(list_distinct([ids[s_suppkey % 20 + 1], ids[s_suppkey * 7 % 20 + 1], ids[s_suppkey * 13 % 20 + 1], 'other-b'])) AS identifiers FROM supplier, (SELECT {_ID_LIST} AS ids)"""
_FLAGS = """list_has_any(identifiers, ['token-price-usd']) AS has_price, list_has_any(identifiers, ['token-market-cap-usd', 'market-cap-usd']) AS has_market_cap,
    list_has_any(identifiers, ['token-fdv-usd', 'fdv-usd']) AS has_fdv,
    list_has_any(identifiers, ['rev-usd', 'revenue-total-usd', 'app-revenue-total-usd', 'dex-revenue-usd', 'lending-revenue-total-usd']) AS has_revenue,
    list_has_any(identifiers, ['transaction-fee-total-usd', 'dex-fees-usd', 'fees-total-usd', 'app-fees-total-usd', 'mev-tips-fees-usd']) AS has_fees,
    list_has_any(identifiers, ['lending-deposit-total-usd']) AS has_lending_deposits, list_has_any(identifiers, ['lending-tvl-total-usd', 'tvl-total-usd']) AS has_blockworks_tvl"""


def catalogue(spark, sf):
    k, ids = F.col("s_suppkey"), F.array(*[F.lit(i) for i in _IDS])
    return T.table(spark, sf, "supplier").select(k.alias("entity"), F.array(*[F.element_at(ids, (k * m % 20 + 1).cast("int")) for m in (1, 7, 13)], F.lit("other-b"), F.lit("")).alias("identifiers"))


@query("E18_metric_coverage", f"SELECT entity, {_FLAGS}, CAST(len(identifiers) AS INT) AS metric_count, array_to_string(identifiers, ',') AS identifiers FROM ({_CAT})")
def _(spark, sf):
    return E.metric_coverage(catalogue(spark, sf)).withColumn("identifiers", F.array_join("identifiers", ","))


@query("E19_coverage_flags", BRAND + f""" , l AS (SELECT entity, arg_max(issuance, date) AS i, arg_max(price, date) AS p FROM panel WHERE date = (SELECT max(date) FROM panel) - 20 GROUP BY 1), l2 AS (SELECT entity, issuance AS i, price AS p, dex_volume AS d FROM panel WHERE date = (SELECT max(date) FROM panel) - 20)
  SELECT entity, coalesce(p IS NOT NULL, FALSE) AS has_price, coalesce(i IS NOT NULL, FALSE) AS has_revenue, coalesce(d IS NOT NULL, FALSE) AS has_tvl, CASE WHEN d IS NOT NULL THEN 'defillama' END AS primary_tvl_source FROM ({MASTER}) LEFT JOIN l2 USING (entity)""")
def _(spark, sf):
    p = T.brand_panel(spark, sf).select("entity", DATE, "price", "issuance", "dex_volume")
    day = F.date_sub(T.bounds(spark, sf).select("hi").scalar(), 20)
    snap = p.where(F.col(DATE) == day)
    m = T.brand_master(spark, sf).select("entity")
    return E.coverage_flags(m, snap, {"has_price": "price", "has_revenue": "issuance", "has_tvl": "dex_volume"}).select("entity", "has_price", "has_revenue", "has_tvl", "primary_tvl_source")


@query("E20_asset_master", _DIR + f""", f AS (SELECT slug AS entity, k, CASE WHEN k % 3 = 0 THEN 'S' || k END AS ticker FROM d QUALIFY row_number() OVER (PARTITION BY slug ORDER BY k) = 1),
  c AS (SELECT 'sup-' || entity AS entity, {_FLAGS} FROM ({_CAT}))
  SELECT f.entity, ticker, k % 2 = 0 OR coalesce(has_price, FALSE) AS has_price, k % 3 <> 0 OR coalesce(has_market_cap, FALSE) AS has_market_cap, coalesce(has_fdv, FALSE) AS has_fdv, coalesce(has_revenue, FALSE) AS has_revenue, coalesce(has_fees, FALSE) AS has_fees,
    coalesce(has_lending_deposits, FALSE) AS has_lending_deposits, coalesce(has_blockworks_tvl, FALSE) AS has_blockworks_tvl, CASE WHEN k % 4 = 0 THEN 'cg-' || f.entity END AS coingecko_id, coalesce(k % 5 = 0, FALSE) AS has_defillama_tvl,
    'blockworks_only' AS match_method, 1.0::DOUBLE AS match_confidence, CASE WHEN k % 5 = 0 THEN 'defillama' WHEN has_blockworks_tvl THEN 'blockworks' END AS primary_tvl_source FROM f LEFT JOIN c USING (entity)""")
def _(spark, sf):
    d = directory(spark, sf)
    cov = E.metric_coverage(catalogue(spark, sf)).withColumn("entity", F.concat(F.lit("sup-"), F.col("entity").cast("string")))
    frame = E.directory_frame(d)
    first = d.where("slug IS NOT NULL").groupBy("slug").agg(F.min("id").alias("k")).withColumnRenamed("slug", "entity")
    cg = first.where("k % 4 = 0").select("entity", F.concat(F.lit("cg-"), "entity").alias("coingecko_id"))
    dl = first.where("k % 5 = 0").select("entity", F.lit(True).alias("has_defillama_tvl"))
    out = E.asset_master(frame, cov, [cg, dl])
    return out.select("entity", "ticker", *E.METRIC_GROUPS, "coingecko_id", "has_defillama_tvl", "match_method", "match_confidence", "primary_tvl_source")


@query("E21_label_normalise", """WITH x AS (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN ' Rollup ' WHEN 'ECONOMY' THEN 'Perpetuals' WHEN 'STANDARD' THEN 'Decentralized Exchanges' WHEN 'PROMO' THEN 'Restaking' WHEN 'LARGE' THEN 'Oracle' END AS c FROM part),
  y AS (SELECT *, CASE lower(trim(c)) WHEN 'rollup' THEN 'L1 / L2' WHEN 'perpetuals' THEN 'Perps' WHEN 'decentralized exchanges' THEN 'DEX' WHEN 'restaking' THEN 'Yield / Restaking' ELSE coalesce(trim(c), 'Uncategorised') END AS category FROM x)
  SELECT p_partkey, category, CASE WHEN category IN ('Perps', 'DEX', 'Yield / Restaking') THEN 'DeFi' WHEN category = 'L1 / L2' THEN 'Infrastructure' ELSE 'Other' END AS sector FROM y""")
def _(spark, sf):
    names = {"SMALL": " Rollup ", "ECONOMY": "Perpetuals", "STANDARD": "Decentralized Exchanges", "PROMO": "Restaking", "LARGE": "Oracle"}
    c = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("p_type")]
    p = T.table(spark, sf, "part").select("p_partkey", c.alias("c")).withColumn("category", E.canonical_category("c")).withColumn("s", F.lit(None).cast("string"))
    return p.select("p_partkey", "category", E.canonical_sector("s", "category").alias("sector"))


@query("E22_match_keys", PROTO + f", z AS (SELECT k, unnest([{NORM.format(x='name')}, {NORM.format(x='slug')}, {NORM.format(x='symbol')}, 'k' || k]) AS match_key FROM pr) SELECT DISTINCT k AS entity, match_key FROM z WHERE match_key <> ''")
def _(spark, sf):
    m = protocols(spark, sf).select(F.col("k").alias("entity"), F.concat("name", F.lit(" (Combined)")).alias("shown"), "name", "slug", F.concat("symbol", F.lit("|K-"), F.col("k").cast("string")).alias("child_slugs"))
    return E.match_keys(m.drop("shown"))


@query("E23_chain_slug", LEFT + " SELECT m.entity, coalesce(a.id, b.id, e.id) AS chain_slug FROM m LEFT JOIN c a ON a.id = lower(gecko) LEFT JOIN c b ON b.id = dslug LEFT JOIN c e ON e.id = slug")
def _(spark, sf):
    left, coins = left_and_coins(spark, sf)
    out = E.first_known(left, [F.col("gecko"), F.col("dslug"), F.col("slug")], coins.select(F.col("id").alias("known")), "chain_slug")
    return out.select("entity", "chain_slug")


@query("E24_platform_address", """SELECT c_custkey AS entity, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN 'base' ELSE 'ethereum' END WHEN c_custkey % 3 = 0 THEN 'base' END AS chain,
  CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN 'b' ELSE 'e' END WHEN c_custkey % 3 = 0 THEN 'b' END || c_custkey AS address FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def _(spark, sf):
    c, k = T.table(spark, sf, "customer"), F.col("c_custkey")
    addr = lambda p, cond: F.when(cond, F.concat(F.lit(p), k.cast("string"))).otherwise("")
    m = F.map_from_arrays(F.array(F.lit("ethereum"), F.lit("base"), F.lit("moon")), F.array(addr("e", k % 2 == 0), addr("b", k % 3 == 0), F.lit("x")))
    coins = c.select(k.alias("entity"), m.alias("platforms"), F.when(k % 3 == 0, "Base ").alias("preferred_chain"))
    return E.platform_address(coins, spark.createDataFrame([("ethereum", "ethereum", 0), ("base", "base", 1)], "platform string, chain string, pos int"))


@query("E26_source_links", LEFT + """ SELECT entity, coalesce(CASE WHEN is_chain THEN 'https://defillama.com/chain/' || replace(dslug, ' ', '%20') ELSE 'https://defillama.com/protocol/' || dslug END, slug) AS url FROM m""")
def _(spark, sf):
    left, _ = left_and_coins(spark, sf)
    rows = left.withColumn("kind", F.when(F.col("is_chain"), "chain").otherwise("project"))
    return rows.select("entity", E.source_links("dslug", "kind", "slug").alias("url"))


@query("E27_source_audit", BRAND + f""", h AS (SELECT entity, count(price) > 0 AS has_price_history, count(CASE WHEN entity <> 'Brand#9' THEN dex_volume END) > 0 AS has_true_market_cap, count(mcap) > 0 AS has_market_cap_history, count(revenue) > 0 AS has_revenue_history FROM panel GROUP BY 1)
  SELECT *, has_market_cap_history AND NOT has_true_market_cap AS uses_mcap_proxy FROM h""")
def _(spark, sf):
    p = T.brand_panel(spark, sf).withColumn("hist", F.when(F.col("entity") != "Brand#9", F.col("dex_volume")))
    return E.source_audit(T.brands(spark, sf), p, "hist", "mcap")


