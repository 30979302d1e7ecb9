"""Events, filings and market monitor (V operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daygrid.functions.rolling import DATE, chg, ffill, first_value, lag, no_nan, ratio, roll
from daygrid.functions.text import collapse_space, extract_or_null, suffix_number

# Labels and patterns of unlock pages.
RECIPIENTS = ("Core Contributors", "Contributors", "Team", "Investors", "Private Sale", "Seed Investors", "Advisors", "Founders", "Foundation",
              "Ecosystem", "Community", "Treasury", "Rewards", "Liquidity", "Airdrop")
SELLING = ("advisor", "contributor", "core contributor", "employee", "founder", "investor", "private sale", "seed", "team")
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December"
DATE_TEXT = rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}},\s+\d{{4}}\b"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
UNLOCK_VALUE = rf"(?i)Unlock Value\s*\$({NUMBER})\s*([kmbt])?"
USD = rf"(?i)\$({NUMBER})\s*([kmbt])?\b"
PERCENT = r"([0-9]+(?:\.[0-9]+)?)\s*%"
FLOAT_PERCENT = r"(?i)\(?\s*([0-9]+(?:\.[0-9]+)?)\s*%\s+of\s+float\s*\)?"
NAMED_RECIPIENT = r"(?:GMT[+-]\d{2}:?\d{2}|AM|PM)\s+([A-Z][A-Za-z0-9 /&+.-]{2,60}?)\s+\$"
AMOUNT_SYMBOL = rf"\b({NUMBER})\s+([A-Z][A-Z0-9]{{1,12}})\b"
BEFORE, AFTER = 180, 420


def emission_bucket(recipient: Column) -> Column:
    """Potential selling for insiders, else the recipient itself."""
    t = F.trim(F.coalesce(recipient, F.lit("")))
    return F.when(F.lower(t).rlike("|".join(SELLING)), "Potential Selling").when(t == "", "Other").otherwise(t)


def recipient(chunk: Column) -> Column:
    """First label of the ordered list that occurs, else the capitalised name before a dollar sign."""
    named = F.coalesce(*[F.when(chunk.rlike(rf"(?i)\b{label}\b"), label) for label in RECIPIENTS])
    return F.coalesce(named, collapse_or_null(extract_or_null(chunk, NAMED_RECIPIENT)))


def collapse_or_null(x: Column) -> Column:
    return F.when(x.isNotNull(), collapse_space(x))


def usd_value(chunk: Column) -> Column:
    pick = lambda p: suffix_number(extract_or_null(chunk, p, 1), F.regexp_extract(chunk, p, 2))
    return F.when(chunk.rlike(UNLOCK_VALUE), pick(UNLOCK_VALUE)).otherwise(pick(USD))


def token_symbol(chunk: Column) -> Column:
    """Last upper-case symbol that follows a number, day-part marks aside."""
    found = F.filter(F.regexp_extract_all(chunk, F.lit(AMOUNT_SYMBOL), F.lit(2)), lambda s: ~s.isin("AM", "PM", "GMT"))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def token_amount(chunk: Column, symbol: Column) -> Column:
    own = F.concat(F.lit(rf"\b({NUMBER})\s+\Q"), symbol, F.lit(r"\E\b"))
    named = F.when(symbol != "", F.try_element_at(F.regexp_extract_all(chunk, own, F.lit(1)), F.lit(1)))
    any_ = F.try_element_at(F.regexp_extract_all(chunk, F.lit(AMOUNT_SYMBOL), F.lit(1)), F.lit(-1))
    return suffix_number(F.coalesce(named, any_), F.lit(None).cast("string"))


def percentages(chunk: Column) -> tuple[Column, Column]:
    """(percent of supply, percent of float): supply is the first percentage that is not the float one."""
    flt = extract_or_null(chunk, FLOAT_PERCENT).try_cast("double")
    every = F.transform(F.regexp_extract_all(chunk, F.lit(PERCENT), F.lit(1)), lambda x: x.try_cast("double"))
    return F.try_element_at(F.filter(every, lambda v: flt.isNull() | (F.abs(v - flt) > 1e-12)), F.lit(1)), flt


def unlock_events(pages: DataFrame, text: str, keys: list[str], ticker: str | None = None) -> DataFrame:
    """Unlock events of whole page texts: one row per parsable date with any of recipient, value or amount.

    The text is split at its dates.  A date's chunk runs from the last
    'Unlock Value' since the previous date (else 180 characters before) to the
    next date (at the end of the page, 420 characters).
    """
    clean = collapse_space(text)
    rows = pages.withColumn("_t", clean).where((F.col("_t") != "") & ~F.substring("_t", 1, 200).contains("Just a moment"))
    rows = rows.withColumns({"_d": F.regexp_extract_all("_t", F.lit(DATE_TEXT), F.lit(0)), "_p": F.split("_t", DATE_TEXT, -1)}).where(F.size("_d") > 0)
    width = lambda xs, n: F.aggregate(F.slice(xs, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    each = rows.select(*keys, *([ticker] if ticker else []), "_t", "_p", "_d", F.posexplode("_d").alias("_i", "_when"))
    start = width(F.col("_p"), F.col("_i") + 1) + width(F.col("_d"), F.col("_i"))
    piece, after = F.col("_p")[F.col("_i")], F.col("_p")[F.col("_i") + 1]
    mark = F.substring_index(piece, "Unlock Value", -1)
    lead = F.when(piece.contains("Unlock Value"), F.concat(F.lit("Unlock Value"), mark)).otherwise(
        F.substr("_t", F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE))))
    tail = F.when(F.col("_i") < F.size("_d") - 1, after).otherwise(F.substring(after, 1, AFTER))
    parts = each.select(*keys, *([ticker] if ticker else []), "_i", "_when", F.concat(lead, "_when", tail).alias("_c"))
    c = F.col("_c")
    day = F.regexp_replace(F.initcap("_when"), r"\s+", " ")
    parsed = F.coalesce(F.try_to_timestamp(day, F.lit("MMM d, yyyy")), F.try_to_timestamp(day, F.lit("MMMM d, yyyy")))
    own = F.upper(F.coalesce(F.col(ticker), F.lit(""))) if ticker else F.lit("")
    pct_supply, pct_float = percentages(c)
    out = parts.withColumns({DATE: F.to_date(parsed), "_rec": recipient(c), "value_usd": usd_value(c), "token_symbol": F.when(own != "", own).otherwise(token_symbol(c)), "pct_supply": pct_supply, "pct_float": pct_float})
    out = out.withColumn("token_amount", token_amount(c, F.col("token_symbol")))
    out = out.where(F.col(DATE).isNotNull() & (F.col("_rec").isNotNull() | F.col("value_usd").isNotNull() | F.col("token_amount").isNotNull()))
    out = out.withColumns({"recipient": F.coalesce("_rec", F.lit("Unknown")), "bucket": emission_bucket(F.col("_rec"))})
    one = Window.partitionBy(*keys, DATE, "recipient", "token_amount", "value_usd").orderBy("_i")
    kept = out.withColumn("_rn", F.row_number().over(one)).where(F.col("_rn") == 1)
    return kept.select(*keys, F.lit("unlock").alias("event_type"), DATE, "recipient", "bucket", "token_amount", "token_symbol", "value_usd", "pct_supply", "pct_float")


GOVERNANCE = ("struct<data:struct<proposals:array<struct<id:string,title:string,start:bigint,end:bigint,state:string,scores_total:double,"
              "choices:array<string>,space:struct<id:string,name:string>>>>>")


def governance_events(df: DataFrame, payload: str, keys: list[str], fallback_url: str) -> DataFrame:
    p = df.select(*keys, fallback_url, F.explode(F.from_json(payload, GOVERNANCE)["data"]["proposals"]).alias("p"))
    space, pid = F.coalesce("p.space.id", F.lit("")), F.coalesce("p.id", F.lit(""))
    url = F.concat(F.lit("https://snapshot.box/#/"), space, F.lit("/proposal/"), pid)
    return p.select(*keys, F.lit("governance").alias("event_type"), F.to_date(F.timestamp_seconds("p.start")).alias(DATE), F.to_date(F.timestamp_seconds("p.end")).alias("end_date"),
                    F.lit("Governance").alias("bucket"), F.col("p.scores_total").alias("value_usd"), F.coalesce("p.state", F.lit("")).alias("state"),
                    F.coalesce(F.nullif("p.title", F.lit("")), F.lit("Snapshot proposal")).alias("title"), F.concat(F.lit("Snapshot space: "), F.coalesce("p.space.name", space)).alias("notes"),
                    F.when((space != "") & (pid != ""), url).otherwise(F.col(fallback_url)).alias("source_url"))


def upsert_events(stored: DataFrame, fresh: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Append, fill absent columns with null, keep the last row per key."""
    both = stored.withColumn("_load", F.lit(0)).unionByName(fresh.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc("_load"), *[F.desc(c) for c in order])
    return both.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn", "_load")


# ---- filings ----

FACTS = "struct<units:struct<USD:array<struct<start:string,end:string,filed:string,form:string,fp:string,accn:string,frame:string,fy:int,val:double>>>>"


def filing_facts(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """10-K and 10-Q dollar facts with inclusive duration; incomplete facts dropped."""
    f = df.select(*keys, F.inline(F.from_json(payload, FACTS)["units"]["USD"])).where(F.col("form").isin("10-K", "10-Q"))
    day = lambda c: F.to_date(F.col(c).try_cast("timestamp"))
    out = f.select(*keys, day("start").alias("start"), day("end").alias("end"), day("filed").alias("filed"), "fy", F.coalesce("fp", F.lit("")).alias("fp"), "form", "accn", no_nan("val").alias("value"))
    return out.dropna(subset=["start", "end", "filed", "value"]).withColumn("duration", F.datediff("end", "start") + 1)


def valid_ytd(fp: str = "fp", days: str = "duration") -> Column:
    """Plausible day ranges of year-to-date facts by fiscal period."""
    f, d = F.upper(F.col(fp)), F.col(days)
    return F.coalesce(F.when(f == "Q1", d.between(70, 110)).when(f == "Q2", d.between(140, 220)).when(f == "Q3", d.between(230, 310)).when(f == "FY", d.between(340, 390)), F.lit(False))


def latest_facts(facts: DataFrame) -> DataFrame:
    """Last filed restatement per (ticker, start, end)."""
    rest = [c for c in facts.columns if c not in ("ticker", "start", "end")]
    best = F.max_by(F.struct(*rest), F.struct("filed", "accn", "value"))
    return facts.groupBy("ticker", "start", "end").agg(best.alias("_f")).select("ticker", "start", "end", *[f"_f.{c}" for c in rest])


def quarterly_from_ytd(facts: DataFrame, quarters: int | None = None) -> DataFrame:
    """Quarters as reported, or as the difference of successive year-to-date facts of one year start; all, or the last few."""
    cum = latest_facts(facts.where(valid_ytd()))
    w = Window.partitionBy("ticker", "start").orderBy("end")
    cols = ["ticker", "start", "end", "filed", "accn", "value", "duration", "source"]
    reported = cum.where(F.col("duration").between(70, 110)).withColumn("source", F.lit("reported_quarter")).select(*cols)
    delta = cum.withColumns({"_pe": F.lag("end").over(w), "_pv": F.lag("value").over(w)}).where((F.col("duration") > 110) & F.col("_pe").isNotNull())
    derived = delta.select("ticker", F.date_add("_pe", 1).alias("start"), "end", "filed", "accn", (F.col("value") - F.col("_pv")).alias("value"), F.datediff("end", "_pe").alias("duration"), F.lit("derived_from_ytd_delta").alias("source"))
    both = reported.unionByName(derived.where(F.col("value") >= 0))
    best = Window.partitionBy("ticker", "start", "end").orderBy(F.desc("source"), F.desc("filed"), F.desc("accn"))
    one = both.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") == 1).drop("_rn")
    one = one.withColumn("quarter", F.concat(F.year("end"), F.lit("Q"), F.quarter("end")))
    if quarters is None:
        return one
    recent = one.select("quarter").distinct().orderBy(F.desc("quarter")).limit(quarters)
    return one.join(F.broadcast(recent), "quarter", "left_semi")


def current_ytd(facts: DataFrame, today: Column, trailing: int = 90) -> DataFrame:
    """Latest eligible current-year fact per company and its share of the total."""
    cut = F.date_sub(today, trailing)
    ok = facts.where(valid_ytd() & (F.col("end") >= F.trunc(today, "year")) & ((F.col("end") >= cut) | (F.col("filed") >= cut)))
    rest = [c for c in facts.columns if c != "ticker"]
    best = F.max_by(F.struct(*rest), F.struct("end", "filed", "duration", "accn", "value"))
    one = latest_facts(ok).groupBy("ticker").agg(best.alias("_f")).select("ticker", "_f.*")
    total = one.agg(F.sum("value")).scalar()
    return one.withColumn("pct_of_total", F.when(total > 0, F.col("value") / total * 100.0))


def filing_list(df: DataFrame, recent: str, keys: list[str]) -> DataFrame:
    """Struct of parallel arrays to one row per filing; short arrays give nulls."""
    z = F.arrays_zip(*[F.col(f"{recent}.{c}") for c in ("form", "filingDate", "reportDate", "accessionNumber", "primaryDocument")])
    r = df.select(*keys, F.explode(z).alias("z"))
    g = lambda i: F.col(f"z.{i}")
    day = lambda c: F.to_date(c.try_cast("timestamp"))
    acc = F.replace(F.coalesce(g("accessionNumber"), F.lit("")), F.lit("-"), F.lit(""))
    doc = F.coalesce(g("primaryDocument"), F.lit(""))
    return r.select(*keys, F.coalesce(g("form"), F.lit("")).alias("form"), day(g("filingDate")).alias("filed"), day(g("reportDate")).alias("period"), g("accessionNumber").alias("accn"),
                    F.when((acc != "") & (doc != ""), F.concat_ws("/", acc, doc)).otherwise("").alias("document"))


def quarter_ends(issuers: DataFrame, keys: list[str], fye: str, first_year: Column, last_year: Column) -> DataFrame:
    """Four quarter ends per fiscal year from a 'MMDD' year end; short months keep their last day."""
    digits = F.regexp_replace(F.coalesce(F.col(fye), F.lit("1231")), r"\D", "")
    text = F.when(F.length(digits) == 4, digits).otherwise("1231")
    month = F.greatest(F.least(F.substring(text, 1, 2).cast("int"), F.lit(12)), F.lit(1))
    dom = F.greatest(F.least(F.substring(text, 3, 2).cast("int"), F.lit(31)), F.lit(1))
    years = issuers.select(*keys, month.alias("_m"), dom.alias("_d"), F.explode(F.sequence(first_year, last_year)).alias("_y"))
    first = F.make_date("_y", "_m", F.lit(1))
    end = years.withColumn("_e", F.date_add(first, F.least(F.col("_d"), F.day(F.last_day(first))) - 1))
    return end.select(*keys, F.explode(F.array(*[F.add_months("_e", -k) for k in (9, 6, 3)], F.col("_e"))).alias("period")).distinct()


def filing_lag(filings: DataFrame, keys: list[str]) -> DataFrame:
    """Median days from period end to filing per form, of lags between 1 and 149 days."""
    lags = filings.withColumn("lag", F.datediff("filed", "period")).where((F.col("lag") > 0) & (F.col("lag") < 150))
    # at most 149 distinct lags per form, so the exact percentile keeps a short histogram
    return lags.groupBy(*keys, "form").agg(F.bround(F.median("lag")).cast("int").alias("lag_days"))


def next_filing(filings: DataFrame, issuers: DataFrame, key: str, fye: str, today: Column) -> DataFrame:
    """First fiscal period after the last filed one, with its expected date and status."""
    periodic = filings.where(F.col("form").isin("10-Q", "10-K") & F.col("period").isNotNull())
    last = periodic.groupBy(key).agg(F.max("period").alias("_last")).join(issuers.select(key, fye), key)
    ends = quarter_ends(last, [key, "_last", fye], fye, F.year("_last"), F.year(today) + 1)
    nxt = ends.where((F.col("period") > F.col("_last")) & (F.col("period") <= F.date_add(today, 140))).groupBy(key, fye).agg(F.min("period").alias("period"))
    digits = F.lpad(F.regexp_replace(F.coalesce(F.col(fye), F.lit("1231")), r"\D", ""), 4, "0")
    form = F.when(F.date_format("period", "MMdd") == digits, "10-K").otherwise("10-Q")
    out = nxt.withColumn("form", form).join(filing_lag(filings, [key]), [key, "form"], "left")
    due = F.date_add("period", F.coalesce("lag_days", F.when(F.col("form") == "10-K", 75).otherwise(45)))
    days = F.datediff(due, today)
    status = F.when(days < -30, "Past estimate").when(days < 0, "Due/Watch").when(days <= 14, "Upcoming").otherwise("Scheduled")
    return out.select(key, "form", "period", due.alias("expected"), days.alias("days"), status.alias("status"))


def notable_filings(filings: DataFrame, forms: list[str], today: Column, days: int = 45, n: int | None = None) -> DataFrame:
    """Filings of the given forms in the last days, all or the n latest."""
    rows = filings.where(F.col("form").isin(*forms) & (F.col("filed") >= F.date_sub(today, days)))
    return rows if n is None else rows.orderBy(F.desc("filed"), "accn").limit(n)


# ---- market monitor ----

def protocol_change() -> Column:
    """Best available change in percent: given 7d, weekly totals, daily totals."""
    over = lambda a, b: F.when(F.col(b) > 0, (F.try_divide(a, b) - 1.0) * 100.0)
    return F.coalesce(F.col("change_7d"), over("total_7d", "prior_7d"), over("total_24h", "prior_24h"))


def overview_movers(rows: DataFrame, floor: float = 10_000.0, n: int = 5, tie: str = "ticker") -> DataFrame:
    ok = rows.withColumns({"change": protocol_change(), "latest": F.coalesce("total_7d", "total_24h")}).where(F.col("change").isNotNull() & (F.col("latest") >= floor))
    return two_sided(ok, "change", n, tie)


def two_sided(rows: DataFrame, value: str, n: int, tie: str) -> DataFrame:
    """n largest and n smallest rows as gainers and losers."""
    top = rows.orderBy(F.desc(value), tie).limit(n).withColumn("side", F.lit("gainer"))
    low = rows.orderBy(F.asc(value), tie).limit(n).withColumn("side", F.lit("loser"))
    return top.unionByName(low)


def token_movers(ts: DataFrame, markets: DataFrame, min_fdv: float = 100_000_000.0, min_volume: float = 10_000_000.0, n: int = 5) -> DataFrame:
    """Gainers and losers on two horizons among tokens of enough FDV and 30-day volume.

    ts: source_id, ticker, date, volume; markets: source_id, price, fdv, volume, chg_7d, chg_30d.
    """
    meta = ts.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.max_by("ticker", DATE).alias("ticker"), F.sum("volume").alias("_v30"))
    m = meta.join(markets, "source_id").withColumn("volume_30d", F.coalesce("_v30", F.col("volume") * 30.0))
    ok = m.where((F.col("fdv") >= min_fdv) & (F.col("volume_30d") >= min_volume))
    long = ok.select("ticker", "price", "fdv", "volume_30d", F.inline(F.array(F.struct(F.lit("7D Price").alias("horizon"), F.col("chg_7d").alias("change")), F.struct(F.lit("30D Price").alias("horizon"), F.col("chg_30d").alias("change"))))).where(F.col("change").isNotNull())
    up = Window.partitionBy("horizon").orderBy(F.desc("change"), "ticker")
    dn = Window.partitionBy("horizon").orderBy("change", "ticker")
    top = long.withColumn("pos", F.row_number().over(up)).where(F.col("pos") <= n).withColumn("side", F.lit("gainer"))
    low = long.withColumn("pos", F.row_number().over(dn)).where(F.col("pos") <= n).withColumn("side", F.lit("loser"))
    return top.unionByName(low)


def sector_performance(tokens: DataFrame, show: int | None = None) -> DataFrame:
    """Cap-weighted change per sector: base value is latest / (1 + change); tokens as a list, whole or its beginning.

    tokens: ticker, sector, value, change (percent).
    """
    base = F.try_divide(F.col("value"), 1.0 + F.col("change") / 100.0)
    ok = tokens.withColumn("_b", base).where((F.col("value") > 0) & (F.col("_b") > 0))
    sums = ok.groupBy("sector").agg(F.sum("value").alias("latest"), F.sum("_b").alias("base"), F.count_distinct("ticker").alias("tokens"))
    first = ok.select("sector", F.upper("ticker").alias("t")).where(F.trim("t") != "").distinct()
    if show is not None:
        # the first names in order are picked by rank before they are gathered
        w = Window.partitionBy("sector").orderBy("t")
        first = first.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= show + 1)
    listed = first.groupBy("sector").agg(F.array_sort(F.collect_list("t")).alias("_l"))
    text = F.array_join("_l", ", ")
    if show is not None:
        text = F.when(F.size("_l") > show, F.concat(F.array_join(F.slice("_l", 1, show), ", "), F.lit(", ..."))).otherwise(text)
    return sums.join(listed, "sector", "left").select("sector", "latest", "base", "tokens", ((F.try_divide("latest", "base") - 1.0) * 100.0).alias("change"), text.alias("token_list"))


# Display names of chains.
CHAIN_NAMES = {"bsc": "BNB Chain", "hyperliquid l1": "Hyperliquid", "op mainnet": "OP Mainnet", "polygon pos": "Polygon PoS", "zksync era": "zkSync Era", "edgex l1": "edgeX"}


def canonical_chain(name: Column, overrides: dict[str, str] | None = None) -> Column:
    names = CHAIN_NAMES if overrides is None else overrides
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    t = F.trim(F.coalesce(name, F.lit("")))
    return F.when(t == "", "Unknown").otherwise(F.coalesce(m[F.lower(t)], F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))))


def chain_totals(df: DataFrame, breakdown: str, n: int | None = None) -> DataFrame:
    """Nested per-protocol breakdown {chain: {part: value}} summed by chain, all or the n largest."""
    chains = df.select(F.explode(F.from_json(breakdown, "map<string,map<string,double>>")).alias("chain", "_v"))
    parts = F.aggregate(F.filter(F.map_values("_v"), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    out = chains.groupBy(canonical_chain(F.col("chain")).alias("chain")).agg(F.sum(parts).alias("fees")).where(F.col("fees") > 0)
    return out if n is None else out.orderBy(F.desc("fees"), "chain").limit(n)


def signed_top(rows: DataFrame, value: str, tie: str, n: int | None = None) -> DataFrame:
    """Positive and negative rows, all or the n largest and the n most negative."""
    if n is None:
        return rows.where(F.col(value) != 0)
    up = rows.where(F.col(value) > 0).orderBy(F.desc(value), tie).limit(n)
    return up.unionByName(rows.where(F.col(value) < 0).orderBy(F.asc(value), tie).limit(n))


def last_change(series: DataFrame, key: str, value: str) -> DataFrame:
    """Last minus previous value per key."""
    w = Window.partitionBy(key).orderBy(F.desc(DATE))
    two = series.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2)
    at = lambda i: F.max(F.when(F.col("_rn") == i, F.col(value)))
    out = two.groupBy(key).agg((at(1) - at(2)).alias("change"), at(1).alias("supply"), F.max(DATE).alias("as_of"))
    return out.where(F.col("change").isNotNull())


def net_flows(flows: DataFrame, key: str) -> DataFrame:
    """Deposits minus withdrawals, a missing side as zero, absent when both are."""
    zero = F.lit(0.0)
    rows = flows.where(F.col("deposits").isNotNull() | F.col("withdrawals").isNotNull())
    return rows.select(key, (F.coalesce("deposits", zero) - F.coalesce("withdrawals", zero)).alias("net_flow"), F.coalesce("deposits", zero).alias("deposits"), F.coalesce("withdrawals", zero).alias("withdrawals"))


def _days():
    return Window.partitionBy(F.lit(0)).orderBy(DATE)


def indexed_table(series: DataFrame, columns: list[str]) -> DataFrame:
    """Series (one row per day) carried forward, rebased to 100 at the first day all of them have."""
    filled = series.select(DATE, *[ffill(c, None, _days()).alias(c) for c in columns]).dropna(subset=columns)
    return filled.select(DATE, *[(F.col(c) / first_value(c, _days()) * 100.0).alias(c) for c in columns])


def ratio_series(series: DataFrame, top: str, bottom: str, back: int = 7) -> DataFrame:
    """Ratio over the forward-filled union of days and its change over `back` rows."""
    f = series.select(DATE, ffill(top, None, _days()).alias("a"), ffill(bottom, None, _days()).alias("b")).dropna(subset=["a", "b"]).withColumn("ratio", ratio("a", "b"))
    return f.select(DATE, "ratio", (chg("ratio", back, _days()) * 100.0).alias("change"), (F.col("ratio") / first_value("ratio", _days()) * 100.0).alias("indexed"))


def equity_changes(bars: DataFrame, key: str) -> DataFrame:
    """Latest 1- and 5-row price change and mean of the last five volumes against the five before."""
    w = Window.partitionBy(key).orderBy(F.desc(DATE))
    rows = bars.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 10)
    at = lambda i: F.max(F.when(F.col("_rn") == i, F.col("close")))
    vol = lambda a, b: F.avg(F.when(F.col("_rn").between(a, b), F.col("volume")))
    n = F.count("*")
    out = rows.groupBy(key).agg(at(1).alias("last"), at(2).alias("_p1"), at(6).alias("_p5"), vol(1, 5).alias("_v1"), vol(6, 10).alias("_v2"), n.alias("_n"), F.max(DATE).alias("as_of"))
    pct = lambda a, b: (ratio(a, b) - 1.0) * 100.0
    return out.select(key, "last", pct("last", "_p1").alias("price_1d"), pct("last", "_p5").alias("price_5d"), F.when(F.col("_n") >= 10, pct("_v1", "_v2")).alias("volume_5d"), "as_of")


def pi_cycle(series: DataFrame, price: str) -> DataFrame:
    """111-day mean against twice the 350-day mean, distance in percent and its one-day change."""
    w = _days()
    m = series.where(F.col(price).isNotNull()).select(DATE, roll(F.avg, price, 111, 111, w).alias("dma_111"), (roll(F.avg, price, 350, 350, w) * 2.0).alias("dma_350x2"))
    d = m.withColumn("distance", (ratio("dma_111", "dma_350x2") - 1.0) * 100.0)
    return d.select(DATE, "dma_111", "dma_350x2", "distance", (F.col("distance") - lag("distance", 1, w)).alias("distance_change"), (F.col("dma_111") >= F.col("dma_350x2")).alias("triggered"))


def year_over_year(monthly: DataFrame, value: str) -> DataFrame:
    """Change against the latest observation on or before twelve months earlier.

    As-of lookup without a range join: the target dates are merged into the
    series and the last observation is carried to them.  One row per date.
    """
    obs = monthly.where(F.col(value).isNotNull()).select(DATE, F.col(value).alias("v"))
    asks = obs.select(F.add_months(DATE, -12).alias(DATE), F.col(DATE).alias("_for"), F.col("v").alias("_now"))
    w = Window.partitionBy(F.lit(0)).orderBy(DATE, F.col("_for").asc_nulls_first())
    merged = obs.unionByName(asks, allowMissingColumns=True)
    base = merged.withColumn("_base", ffill("v", None, w)).where(F.col("_for").isNotNull())
    return base.select(F.col("_for").alias(DATE), ((ratio("_now", "_base") - 1.0) * 100.0).alias("yoy"))


def observations_back(series: DataFrame, value: str, k: int = 4) -> DataFrame:
    """Change against the k-th observation back."""
    return series.where(F.col(value).isNotNull()).select(DATE, (chg(value, k, _days()) * 100.0).alias("change"))


def points_frame(df: DataFrame, payload: str, columns: dict[str, str], keys: list[str], millis: Column, max_points: int | None = None) -> DataFrame:
    """`[{timestamp, ..}]` payloads to dated rows, all or the last points per key."""
    schema = "array<struct<timestamp:double," + ",".join(f"{c}:double" for c in columns) + ">>"
    rows = df.select(*keys, F.inline(F.from_json(payload, schema)))
    ts = F.timestamp_seconds(F.col("timestamp") / F.when(millis, 1000.0).otherwise(1.0))
    out = rows.where(F.col("timestamp").isNotNull()).select(*keys, F.to_date(ts).alias(DATE), *[F.col(a).alias(b) for a, b in columns.items()])
    if max_points is None:
        return out
    w = Window.partitionBy(*keys).orderBy(F.desc(DATE))
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_points).drop("_rn")


def merge_charts(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Outer merge of charts by date."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, [*keys, DATE], "full")
    return out


def embedded_table(pages: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """Table rows from the JSON of a page's data script."""
    script = extract_or_null(F.col(html), r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>')
    schema = "struct<props:struct<pageProps:struct<tableData:array<struct<name:string,prevDayNetFlow:double,prevDayUsdDeposits:double,prevDayUsdWithdrawals:double>>>>>"
    rows = pages.select(*keys, F.inline(F.from_json(script, schema)["props"]["pageProps"]["tableData"]))
    return rows.where(F.col("prevDayNetFlow").isNotNull()).select(*keys, canonical_chain(F.col("name")).alias("chain"), F.col("prevDayNetFlow").alias("net_flow"), F.col("prevDayUsdDeposits").alias("deposits"), F.col("prevDayUsdWithdrawals").alias("withdrawals"))


def watchlist_prices(watchlist: DataFrame, tokens: DataFrame, equities: DataFrame) -> DataFrame:
    """Tokens take the market row, equities the last of their history; week change from first and last point.

    watchlist: name, symbol, asset_type; tokens: name, price, change_7d; equities: symbol, history array.
    """
    token = F.lower(F.coalesce("asset_type", F.lit(""))) == "token"
    t = tokens.select("name", F.col("price").alias("_tp"), F.col("change_7d").alias("_tc"))
    j = watchlist.join(t, "name", "left").join(equities.select("symbol", F.col("history").alias("_h")), "symbol", "left")
    first, last = F.try_element_at("_h", F.lit(1)), F.try_element_at("_h", F.lit(-1))
    week = F.when((F.size("_h") >= 2) & (first > 0), (F.try_divide(last, first) - 1.0) * 100.0)
    price = F.when(token, F.col("_tp")).otherwise(last)
    return j.select("name", "symbol", "asset_type", price.alias("price"), F.when(token, F.col("_tc")).otherwise(week).alias("week_change"), F.when(price.isNull(), "Unavailable").when(token, "Market").otherwise("History").alias("source"))
