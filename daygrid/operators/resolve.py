"""Entity resolution and the asset master (E operators)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.functions.text import display_name, normalise_text, slugify, strip_version

# Directory rows that are no protocols, and category order.
EXCLUDED_SYMBOLS = ("", "usdt", "usdc", "dai", "fdusd", "tusd", "usdd", "usdp", "usde", "usds", "busd", "lusd", "frax", "gho")
EXCLUDED_CATEGORIES = ("cex", "stablecoins", "stablecoin", "tokenizedtreasury", "tokenisedtreasury", "treasurymanager", "reservecurrency")
CATEGORY_PRIORITY = {"derivatives": 0, "perps": 0, "dexs": 1, "dex": 1, "lending": 2, "rwa lending": 2, "liquid staking": 3, "yield": 3, "restaking": 3, "bridge": 4}
# Vendor metric ids that show a metric family is covered.
METRIC_GROUPS = {"has_price": ("token-price-usd",),
                 "has_market_cap": ("token-market-cap-usd", "market-cap-usd"),
                 "has_fdv": ("token-fdv-usd", "fdv-usd"),
                 "has_revenue": ("rev-usd", "revenue-total-usd", "app-revenue-total-usd", "dex-revenue-usd", "lending-revenue-total-usd"),
                 "has_fees": ("transaction-fee-total-usd", "dex-fees-usd", "fees-total-usd", "app-fees-total-usd", "mev-tips-fees-usd"),
                 "has_lending_deposits": ("lending-deposit-total-usd",),
                 "has_blockworks_tvl": ("lending-tvl-total-usd", "tvl-total-usd")}
# Category synonyms.
LABELS = {"l1": "L1 / L2", "l2": "L1 / L2", "l1/l2": "L1 / L2", "rollup": "L1 / L2", "derivatives": "Perps", "perpetuals": "Perps", "perps": "Perps",
          "decentralized exchanges": "DEX", "liquid staking": "Yield / Restaking", "restaking": "Yield / Restaking"}
DEFI = ("dex", "dexs", "lending", "liquid staking", "yield", "yield / restaking", "derivatives", "perps", "decentralized exchanges")


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def group_key(slug: str = "slug", name: str = "name", parent: str = "parent", gecko: str = "gecko_id", symbol: str = "symbol") -> Column:
    """Parent, else token identity and base name of versioned rows, else the slug."""
    p = F.trim(F.coalesce(F.col(parent), F.lit("")))
    name_base, name_v = strip_version(name)
    slug_base, slug_v = strip_version(F.replace(F.trim(slug), F.lit("-"), F.lit(" ")))
    base = F.when(name_base != "", name_base).otherwise(slug_base)
    token = F.when(normalise_text(gecko) != "", normalise_text(gecko)).otherwise(normalise_text(symbol))
    return (F.when(p.startswith("parent#"), F.concat(F.lit("parent:"), F.substr(p, F.lit(8))))
            .when(p != "", F.concat(F.lit("parent:"), slugify(p)))
            .when((token != "") & (base != "") & (name_v | slug_v), F.concat(F.lit("heuristic:"), token, F.lit(":"), base))
            .otherwise(F.concat(F.lit("slug:"), F.trim(slug))))


def protocol_candidate() -> Column:
    """Whether a directory row (slug, name, symbol, category, tvl, latest_ok, disabled) is a protocol."""
    name = normalise_text("name")
    bad = ((F.trim(F.coalesce("slug", F.lit(""))) == "") | ~F.coalesce("latest_ok", F.lit(True)) | F.coalesce("disabled", F.lit(False))
           | normalise_text("symbol").isin(*EXCLUDED_SYMBOLS) | normalise_text("category").isin(*EXCLUDED_CATEGORIES)
           | name.contains("wrapped") | name.startswith("staked") | name.contains("pegged") | (name.contains("aggregate") & F.col("tvl").isNull()))
    return ~bad


def category_priority(category: str = "category") -> Column:
    return F.coalesce(_literal_map(CATEGORY_PRIORITY)[F.lower(F.trim(category))], F.lit(99))


def asset_frame(protocols: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Protocol variants grouped to one asset: summed TVL, largest cap, union of chains, fields of the best row.

    Everything is a mergeable aggregate of the group.  Order within a group is
    TVL descending, then slug; the ordered list of slugs is the only part that
    grows with it and is part of the result.
    """
    rows = protocols.where(protocol_candidate()).withColumns({"group_key": group_key(), "_tvl": F.coalesce("tvl", F.lit(0.0)),
                                                             "name": F.coalesce("name", display_name("slug")),
                                                             "symbol": F.upper(F.when(F.trim("symbol").isin("", "-"), None).otherwise(F.trim("symbol")))})
    order = F.struct((-F.col("_tvl")).alias("t"), F.col("slug").alias("s"))
    valid = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.trim(c) != ""), order))
    cat_order = F.struct(category_priority().alias("p"), (-F.col("_tvl")).alias("t"), F.col("slug").alias("s"))
    g = rows.groupBy("group_key").agg(
        F.count("*").alias("_n"), F.min_by("slug", order).alias("best_slug"), F.min_by("name", order).alias("best_name"), F.sum("_tvl").alias("tvl"),
        F.max("mcap").alias("mcap"), valid("gecko_id").alias("gecko_id"), valid("symbol").alias("ticker"), F.min_by("category", cat_order).alias("category"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("chains")))).alias("chains"),
        F.transform(F.array_sort(F.collect_list(order)), lambda x: x["s"]).alias("child_slugs"))
    parent, grouped = F.col("group_key").startswith("parent:"), F.col("_n") > 1
    canonical = F.when(parent & grouped, F.substr("group_key", F.lit(8))).otherwise(F.col("best_slug"))
    name = (F.when(grouped & parent, F.concat(display_name(canonical), F.lit(" (Combined)")))
            .when(grouped, F.concat(F.element_at(F.split("best_name", " V"), 1), F.lit(" (Combined)"))).otherwise(F.col("best_name")))
    out = g.select(
        canonical.alias("entity"), "group_key", "ticker", name.alias("name"), F.lit("project").alias("asset_type"), "category", "gecko_id",
        F.array_join("child_slugs", "|").alias("child_slugs"), F.array_join("chains", "|").alias("chains"), F.when(F.col("tvl") > 0, F.col("tvl")).alias("tvl"), "mcap",
        F.when(parent & grouped, "parent_group").otherwise("exact_slug").alias("match_method"), F.when(parent | ~grouped, 1.0).otherwise(0.86).alias("match_confidence"))
    if chains is None:
        return out
    sym = F.upper(F.trim("symbol"))
    c = chains.where(F.col("name").isNotNull() & F.col("gecko_id").isNotNull() & ~F.lower(F.coalesce(F.trim("symbol"), F.lit(""))).isin(*EXCLUDED_SYMBOLS, "-"))
    key = F.concat(F.lit("chain:"), slugify("name"))
    c = c.select(key.alias("entity"), key.alias("group_key"), sym.alias("ticker"), "name", F.lit("chain").alias("asset_type"), F.lit("L1 / L2").alias("category"), "gecko_id",
                 F.col("name").alias("chains"), F.when(F.col("tvl") > 0, F.col("tvl")).alias("tvl"), F.lit("chain_gecko_id").alias("match_method"), F.lit(1.0).alias("match_confidence"))
    return out.unionByName(c, allowMissingColumns=True)


def asset_type(kind: str, category: str, sector: str, slug: str) -> Column:
    t, c, s, k = (F.lower(F.trim(F.coalesce(F.col(x), F.lit("")))) for x in (kind, category, sector, slug))
    chain = t.isin("infrastructure", "chain") | (c == "infrastructure") | s.isin("l1", "l2", "l1/l2")
    etf = t.contains("etf") | c.contains("etf") | k.isin("ibit", "fbtc", "gbtc", "etha")
    return F.when(chain, "chain").when(etf, "etf").when(t.contains("treasury") | c.contains("treasury"), "treasury").otherwise("project")


def directory_frame(rows: DataFrame) -> DataFrame:
    """Nested directory rows to the flat left-hand list; the first row of a slug is kept.

    rows: slug, id, code, title, name, type, asset_class, sector, category, price.usd, market_cap.{usd,rank,pct_7d,pct_30d}, fdv.usd, seq.
    """
    w = Window.partitionBy("slug").orderBy("seq")
    one = rows.where(F.coalesce("slug", F.lit("")) != "").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
    return one.select(
        F.concat(F.lit("bw:"), "slug").alias("asset_id"), F.col("slug").alias("entity"), F.upper(F.nullif("code", F.lit(""))).alias("ticker"),
        F.coalesce("title", "name", "slug").alias("name"), asset_type("type", "category", "sector", "slug").alias("asset_type"),
        F.coalesce("type", "asset_class").alias("sector"), F.coalesce("sector", "type", "category").alias("category"),
        F.col("price.usd").isNotNull().alias("has_price"), F.col("market_cap.usd").isNotNull().alias("has_market_cap"), F.col("fdv.usd").isNotNull().alias("has_fdv"))


def directory_metadata(rows: DataFrame) -> DataFrame:
    """Nested price, cap, rank and changes to flat columns."""
    return rows.where(F.coalesce("slug", F.lit("")) != "").select(
        F.col("slug").alias("entity"), F.coalesce("project.slug", "slug").alias("metric_slug"), "asset_class", F.coalesce("is_preview", F.lit(False)).alias("is_preview"),
        F.col("price.usd").alias("price"), F.col("market_cap.usd").alias("mcap"), F.col("market_cap.rank").alias("mcap_rank"),
        F.col("market_cap.pct_7d").alias("price_7d_pct"), F.col("market_cap.pct_30d").alias("price_30d_pct"))


def match_score(name: Column, ticker: Column, other_name: Column, other_symbol: Column) -> tuple[Column, Column]:
    """(method, confidence) of a name and symbol comparison."""
    n, s = normalise_text(name) == normalise_text(other_name), normalise_text(ticker) == normalise_text(other_symbol)
    return (F.when(n & s, "exact_name_symbol").when(n, "exact_name").when(s, "symbol_only").otherwise("unmatched"),
            F.when(n & s, 0.92).when(n, 0.82).when(s, 0.55).otherwise(0.0))


def unique_lookup(rows: DataFrame, key: Column, target: str) -> DataFrame:
    """key -> target for keys that exactly one row has."""
    named = rows.select(key.alias("key"), F.col(target).alias("target")).where(F.col("key").isNotNull() & (F.col("key") != ""))
    return named.groupBy("key").agg(F.count("*").alias("_n"), F.first("target").alias("target")).where(F.col("_n") == 1).drop("_n")


def any_lookup(rows: DataFrame, key: Column, target: str) -> DataFrame:
    """key -> target for ids that are unique by nature."""
    return rows.select(key.alias("key"), F.col(target).alias("target")).where(F.coalesce("key", F.lit("")) != "")


@dataclass(frozen=True)
class Step:
    method: str
    confidence: float
    left_key: Column
    lookup: DataFrame


def cascade_match(left: DataFrame, key: str, steps: list[Step], source: str) -> DataFrame:
    """First matching step wins: (key, source, method, confidence, target), one row per left row.

    All steps share one join: left keys are tagged with their step, lookups
    likewise, and the lowest step per row is kept.  A key that a third of the
    rows share stays one row on the right, so the join never multiplies.
    """
    tagged = left.select(key, F.posexplode(F.array(*[s.left_key.cast("string") for s in steps])).alias("step", "key")).where(F.coalesce("key", F.lit("")) != "")
    right = None
    for i, s in enumerate(steps):
        one = s.lookup.select(F.lit(i).alias("step"), F.col("key").cast("string").alias("key"), "target")
        right = one if right is None else right.unionByName(one)
    hits = tagged.join(right, ["step", "key"]).groupBy(key).agg(F.min_by(F.struct("step", "target"), "step").alias("_h"))
    names = _literal_map({i: s.method for i, s in enumerate(steps)})
    conf = _literal_map({i: s.confidence for i, s in enumerate(steps)})
    found = left.select(key).join(hits, key, "left")
    step = F.col("_h.step")
    return found.select(key, F.lit(source).alias("source"), F.coalesce(names[step], F.lit("unmatched")).alias("method"),
                        F.coalesce(conf[step], F.lit(0.0)).alias("confidence"), F.col("_h.target").alias("target"))


def pair_key(name: Column, symbol: Column) -> Column:
    """Joint name and symbol key, empty when both parts are."""
    n, s = normalise_text(name), normalise_text(symbol)
    return F.when((n == "") & (s == ""), "").otherwise(F.concat(n, F.lit("|"), s))


def venue_match(master: DataFrame, configured: Column, spot: DataFrame, futures: DataFrame) -> DataFrame:
    """Configured pair, else TICKER+USDT, against the symbol sets of both venues."""
    exact = F.concat(F.upper("ticker"), F.lit("USDT"))
    rows = master.select("entity", configured.alias("_c"), exact.alias("_e"))
    for venue, symbols in (("spot", spot), ("futures", futures)):
        for k in ("_c", "_e"):
            rows = rows.join(symbols.select(F.col("symbol").alias(k), F.lit(True).alias(f"{venue}{k}")), k, "left")
    pick = lambda v: F.when(F.col(f"{v}_c"), F.col("_c")).when(F.col(f"{v}_e"), F.col("_e"))
    out = rows.withColumns({"spot_symbol": pick("spot"), "futures_symbol": pick("futures")})
    hit = F.col("spot_symbol").isNotNull() | F.col("futures_symbol").isNotNull()
    by_config = F.coalesce((F.col("_c") == F.col("spot_symbol")) | (F.col("_c") == F.col("futures_symbol")), F.lit(False))
    return out.select("entity", "spot_symbol", "futures_symbol", F.when(hit, F.when(by_config, "binance_config_slug").otherwise("binance_exact_symbol")).otherwise("binance_unmatched").alias("method"),
                      F.when(hit, 0.95).otherwise(0.0).alias("confidence"))


def attach_audit(master: DataFrame, audits: DataFrame, key: str = "entity") -> DataFrame:
    """Highest confidence per entity (method name on a tie); the default for entities without audit."""
    best = audits.groupBy(key).agg(F.max_by(F.struct("method", "confidence"), F.struct("confidence", F.col("method"))).alias("_b"))
    return master.join(best, key, "left").withColumns({
        "match_method": F.coalesce("_b.method", F.lit("blockworks_only")), "match_confidence": F.coalesce("_b.confidence", F.lit(1.0))}).drop("_b")


def metric_coverage(catalogue: DataFrame) -> DataFrame:
    """Advertised metric ids (entity, array `identifiers`) to family flags, count and sorted list."""
    ids = F.array_sort(F.array_distinct(F.filter("identifiers", lambda i: i.isNotNull() & (i != ""))))
    rows = catalogue.select("entity", ids.alias("identifiers"))
    return rows.select("entity", *[F.arrays_overlap("identifiers", F.array(*[F.lit(x) for x in known])).alias(f) for f, known in METRIC_GROUPS.items()],
                       F.size("identifiers").alias("metric_count"), "identifiers")


def coverage_flags(master: DataFrame, snapshot: DataFrame, flags: dict[str, str]) -> DataFrame:
    """has_* flags from non-null snapshot metrics, and the primary TVL source."""
    have = snapshot.select("entity", *[F.col(m).isNotNull().alias(f) for f, m in flags.items()])
    out = master.drop(*flags).join(have, "entity", "left").fillna(False, list(flags))
    return out.withColumn("primary_tvl_source", F.when(F.col("has_tvl"), "defillama"))


def asset_master(directory: DataFrame, coverage: DataFrame, matches: list[DataFrame]) -> DataFrame:
    """Directory plus metric coverage (flags are OR-ed) plus vendor ids, with defaults and the TVL source."""
    no = F.lit(False)
    c = coverage.select("entity", *[F.col(f).alias(f"_{f}") for f in METRIC_GROUPS])
    out = directory.join(c, "entity", "left")
    for f in METRIC_GROUPS:
        own = F.col(f) if f in directory.columns else no
        out = out.withColumn(f, F.coalesce(own, no) | F.coalesce(f"_{f}", no)).drop(f"_{f}")
    for m in matches:
        out = out.join(m, "entity", "left")
    have = set(out.columns)
    defaults = {"match_method": "blockworks_only", "match_confidence": 1.0, "has_defillama_tvl": False, "has_blockworks_tvl": False}
    out = out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v) for k, v in defaults.items()})
    return out.withColumn("primary_tvl_source", F.when(F.col("has_defillama_tvl"), "defillama").when(F.col("has_blockworks_tvl"), "blockworks"))


def canonical_category(category: str) -> Column:
    return F.coalesce(_literal_map(LABELS)[F.lower(F.trim(category))], F.trim(category), F.lit("Uncategorised"))


def canonical_sector(sector: str, category: str) -> Column:
    c = F.lower(F.trim(F.coalesce(F.col(category), F.lit(""))))
    return F.when(c.isin(*DEFI), "DeFi").when(c == "l1 / l2", "Infrastructure").otherwise(F.coalesce(F.trim(sector), F.lit("Other")))


def match_keys(master: DataFrame) -> DataFrame:
    """(entity, match_key): normalised name, name without ' (Combined)', slug and child slugs."""
    plain = F.replace("name", F.lit(" (Combined)"), F.lit(""))
    children = F.split(F.coalesce("child_slugs", F.lit("")), "\\|")
    keys = F.array_distinct(F.concat(F.array(normalise_text("name"), normalise_text(plain), normalise_text("slug")), F.transform(children, lambda s: normalise_text(s))))
    return master.select("entity", F.explode(F.filter(keys, lambda k: k != "")).alias("match_key"))


def first_known(master: DataFrame, candidates: list[Column], known: DataFrame, out: str) -> DataFrame:
    """First candidate that is in the known list (one join for all candidates)."""
    tagged = master.select("entity", F.posexplode(F.array(*[F.lower(c.cast("string")) for c in candidates])).alias("_p", out))
    hit = tagged.join(known.select(F.col("known").alias(out)).distinct(), out, "left_semi").groupBy("entity").agg(F.min_by(out, "_p").alias(out))
    return master.join(hit, "entity", "left")


def platform_address(coins: DataFrame, priority: DataFrame, preferred: str = "preferred_chain") -> DataFrame:
    """Supported platform address: the preferred chain first, then by priority.

    coins: entity, platforms map, preferred chain; priority: platform, chain, pos (a fixed short list).
    """
    rows = coins.select("entity", preferred, F.explode("platforms").alias("platform", "address")).where(F.coalesce("address", F.lit("")) != "")
    ranked = rows.join(F.broadcast(priority), "platform")
    order = F.struct((F.col("chain") != F.coalesce(F.lower(F.trim(preferred)), F.lit(""))).alias("other"), F.col("pos").alias("pos"))
    return ranked.groupBy("entity").agg(F.min_by(F.struct("chain", "address"), order).alias("_b")).select("entity", "_b.*")


def source_links(slug: str, kind: str, fallback: str) -> Column:
    s = F.nullif(F.col(slug), F.lit(""))
    url = F.when(F.col(kind) == "chain", F.concat(F.lit("https://defillama.com/chain/"), F.replace(s, F.lit(" "), F.lit("%20")))).otherwise(F.concat(F.lit("https://defillama.com/protocol/"), s))
    return F.coalesce(url, F.col(fallback))


def source_audit(master: DataFrame, panel: DataFrame, history: str, proxied: str) -> DataFrame:
    """Which histories an entity has, and whether its cap rests on the proxy."""
    have = panel.groupBy("entity").agg(
        (F.count("price") > 0).alias("has_price_history"), (F.count(history) > 0).alias("has_true_market_cap"), (F.count(proxied) > 0).alias("has_market_cap_history"),
        (F.count("revenue") > 0).alias("has_revenue_history"))
    out = master.select("entity").join(have, "entity", "left").fillna(False)
    return out.withColumn("uses_mcap_proxy", F.col("has_market_cap_history") & ~F.col("has_true_market_cap"))
