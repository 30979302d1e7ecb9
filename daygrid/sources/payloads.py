"""Landed vendor payloads (JSON text columns) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daygrid.functions.text import normalise_text
from daygrid.operators.panel import to_number

PAIRS = "array<array<double>>"
KLINE = "array<array<string>>"


def epoch_to_timestamp(x: Column, millis: Column | bool) -> Column:
    scale = F.when(millis if isinstance(millis, Column) else F.lit(millis), 1000.0).otherwise(1.0)
    return F.timestamp_seconds(x.cast("double") / scale)


def pairs_to_rows(df: DataFrame, payload: str, keys: list[str], value: str = "value", millis: bool = True) -> DataFrame:
    """`[[ts, value], ..]` to one row per day, the last point of a day winning."""
    points = df.select(*keys, F.posexplode(F.from_json(payload, PAIRS)).alias("_pos", "_p"))
    ts = epoch_to_timestamp(F.col("_p")[0], millis)
    rows = points.select(*keys, ts.alias("_ts"), F.to_date(ts).alias("date"), F.col("_p")[1].alias("_v"), "_pos")
    return rows.groupBy(*keys, "date").agg(F.max_by("_v", F.struct("_ts", "_pos")).alias(value))


def range_chart(df: DataFrame, payload: str, keys: list[str], start, end, millis: bool = True) -> DataFrame:
    """Three `[ts, value]` arrays merged by day; start inclusive, end exclusive."""
    names = ("prices", "market_caps", "total_volumes")
    schema = "struct<" + ",".join(f"{n}:{PAIRS}" for n in names) + ">"
    parsed = df.withColumn("_j", F.from_json(payload, schema))

    def named(n: str) -> Column:
        points = F.coalesce(F.col(f"_j.{n}"), F.array().cast(PAIRS))
        return F.transform(points, lambda p: F.struct(F.lit(n).alias("name"), p.alias("p")))

    tagged = F.concat(*[named(n) for n in names])
    rows = parsed.select(*keys, F.explode(tagged).alias("_t"))
    ts = epoch_to_timestamp(F.col("_t.p")[0], millis)
    rows = rows.select(*keys, F.to_date(ts).alias("date"), ts.alias("_ts"), F.col("_t.name").alias("_n"), F.col("_t.p")[1].alias("_v"))
    rows = rows.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
    return rows.groupBy(*keys, "date").agg(*[
        F.max_by(F.when(F.col("_n") == n, F.col("_v")), F.when(F.col("_n") == n, F.col("_ts"))).alias(n) for n in names
    ])


def klines(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Twelve-field positional arrays to typed daily bars."""
    # Field order of a kline row.
    fields = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades")
    rows = df.select(*keys, F.explode(F.from_json(payload, KLINE)).alias("_k"))
    typed = rows.select(*keys, *[to_number(F.col("_k")[i]).alias(n) for i, n in enumerate(fields)])
    day = F.to_date(F.timestamp_millis(F.col("open_time").cast("bigint")))
    return typed.withColumn("date", day).drop("open_time", "close_time").withColumn("trades", F.col("trades").cast("bigint"))


def flatten_breakdown(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """`{chain: {protocol: value}}` to leaves; of equal leaf names the last one wins."""
    schema = "map<string,map<string,double>>"
    outer = df.select(*keys, F.posexplode(F.map_entries(F.from_json(payload, schema))).alias("_o", "_e"))
    inner = outer.select(*keys, "_o", F.col("_e.key").alias("chain"), F.posexplode(F.map_entries("_e.value")).alias("_i", "_l"))
    return inner.groupBy(*keys, F.col("_l.key").alias("leaf")).agg(F.max_by("_l.value", F.struct("_o", "_i")).alias("value"))


def breakdown_to_panel(leaves: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Keep wanted normalised names and add collisions; nulls are skipped in the sum."""
    named = leaves.withColumn("match_key", normalise_text("leaf"))
    return named.join(wanted.select("match_key").distinct(), "match_key", "left_semi").groupBy(*keys, "match_key").agg(F.sum("value").alias("value"))


def overview_panel(source: DataFrame, match_keys: DataFrame) -> DataFrame:
    """Sum of every matched key per entity and day; null if all are null.

    match_keys: entity, match_key (distinct per entity).
    """
    return source.join(match_keys, "match_key").groupBy("entity", "date").agg(F.sum("value").alias("value"))


def metric_records(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """`{slug: [{date, value}, ..]}` to rows."""
    schema = "map<string,array<struct<date:string,value:double>>>"
    by_slug = df.select(*keys, F.explode(F.from_json(payload, schema)).alias("slug", "_recs"))
    return by_slug.select(*keys, "slug", F.inline("_recs")).withColumn("date", F.to_date(F.col("date").try_cast("timestamp")))


def price_points(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """`{coins: {id: {prices: [{timestamp, price}]}}}` to rows."""
    schema = "struct<coins:map<string,struct<symbol:string,prices:array<struct<timestamp:bigint,price:double>>>>>"
    coins = df.select(*keys, F.explode(F.from_json(payload, schema)["coins"]).alias("coin", "_c"))
    rows = coins.select(*keys, "coin", F.inline("_c.prices"))
    return rows.select(*keys, "coin", F.to_date(F.timestamp_seconds("timestamp")).alias("date"), "price")


def tvl_records(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """TVL records to daily values; the value field is chosen by presence."""
    schema = "array<struct<date:bigint,totalLiquidityUSD:double,tvl:double>>"
    rows = df.select(*keys, F.inline(F.from_json(payload, schema)))
    return rows.select(*keys, F.to_date(F.timestamp_seconds("date")).alias("date"), F.coalesce("totalLiquidityUSD", "tvl").alias("tvl"))


def stablecoin_records(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Pegged-USD circulating supply; the direct field, else the sum of nested values."""
    schema = "array<struct<date:bigint,totalCirculating:map<string,double>>>"
    rows = df.select(*keys, F.inline(F.from_json(payload, schema)))
    pegged = F.element_at("totalCirculating", "peggedUSD")
    total = F.aggregate(F.filter(F.map_values("totalCirculating"), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)
    return rows.select(*keys, F.to_date(F.timestamp_seconds("date")).alias("date"), F.coalesce(pegged, total).alias("supply"))


def tradable_symbols(rows: DataFrame, quote: str = "USDT") -> DataFrame:
    """Trading symbols of one quote asset, perpetual or spot."""
    contract = F.col("contract_type").isNull() | (F.col("contract_type") == "PERPETUAL")
    return rows.where((F.col("status") == "TRADING") & (F.col("quote_asset") == quote) & contract).select("symbol").distinct()


def epoch_unit(df: DataFrame, column: str) -> Column:
    """Scalar: whether the epochs of a column are milliseconds (median above 1e10)."""
    # the median exceeds the bound when at least half of the values do
    above = F.avg((F.col(column) > 1e10).cast("double"))
    return df.agg((above > 0.5).alias("ms")).scalar()
