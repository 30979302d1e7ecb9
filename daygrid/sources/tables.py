"""Parquet readers and the panels derived from the star-schema tables.

Money sums are whole units per line, so every sum is exact whatever the order
in which partitions are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daygrid.config import SETTINGS
from daygrid.functions.rolling import DATE, ENTITY, by_entity, ffill, running
from daygrid.operators import panel as P

FLOWS = ("revenue", "fees", "issuance", "burn", "tips", "priority", "other_fees", "gross_profit", "addresses",
         "volume", "open_interest", "dex_volume", "deposits", "bridge_flow")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn(DATE, F.to_date("l_shipdate"))


def _daily(rows: DataFrame) -> DataFrame:
    ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")

    def total(x, when=None):
        x = F.round(x)
        return F.sum(x if when is None else F.when(when, x))

    flag, status, no = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    return rows.groupBy(ENTITY, DATE).agg(
        # the day's mean unit price: a sum over a sum keeps the whole daily table a hash aggregate
        (total(ext) / F.sum("l_quantity")).alias("price"),
        total(ext * (1 - disc)).alias("revenue"),
        total(ext * tax).alias("fees"),
        total(ext, flag == "R").alias("issuance"),
        total(ext * disc).alias("burn"),
        total(ext * tax, no == 1).alias("tips"),
        total(ext * tax, no == 2).alias("priority"),
        total(ext * tax, no == 3).alias("other_fees"),
        total(ext * (1 - disc) * (1 - tax)).alias("gross_profit"),
        F.count_distinct("l_suppkey").cast("double").alias("addresses"),
        total(ext).alias("volume"),
        F.sum(F.when(flag == "N", F.col("l_quantity"))).alias("open_interest"),
        total(ext, flag == "A").alias("dex_volume"),
        total(ext, status == "O").alias("deposits"),
        (F.coalesce(total(ext, status == "O"), F.lit(0.0)) - F.coalesce(total(ext, status == "F"), F.lit(0.0))).alias("bridge_flow"),
        F.sum("l_quantity").alias("qty"),
        F.coalesce(F.sum(F.when(status == "O", F.col("l_quantity"))), F.lit(0.0)).alias("qty_open"),
    )


def brand_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per brand and day that has lines."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias(ENTITY))
    return _daily(lines(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey")))


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide cross-section: one row per supplier and day that has lines."""
    return _daily(lines(spark, sf_dir).withColumn(ENTITY, F.col("l_suppkey")))


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.date_bounds(lines(spark, sf_dir).select(DATE))


def _dense_panel(daily: DataFrame, entities: DataFrame, limits: DataFrame, names: int | None = None) -> DataFrame:
    dense = P.densify(daily, entities, limits, ["price", *FLOWS, "qty", "qty_open"], names)
    filled = {m: ffill(m, SETTINGS.max_fill_days) for m in ("price", *FLOWS)}
    whole = by_entity().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    supply = running(F.sum, F.coalesce("qty", zero))
    out = dense.select(
        ENTITY, DATE, *[c.alias(m) for m, c in filled.items()],
        supply.alias("supply"), running(F.sum, F.coalesce("qty_open", zero)).alias("staked"),
        running(F.sum, F.coalesce("deposits", zero)).alias("tvl"),
        running(F.sum, F.coalesce("dex_volume", zero)).alias("stablecoin_supply"),
        F.sum("qty").over(whole).alias("_total"),
    )
    return out.withColumns({"mcap": F.col("price") * F.col("supply"), "fdv": F.col("price") * F.col("_total")}).drop("_total")


def market_close(daily: DataFrame, limits: DataFrame) -> DataFrame:
    """Benchmark: market-wide mean unit price per day, carried over empty days."""
    seen = daily.groupBy(DATE).agg(F.sum("volume").alias("v"), F.sum("qty").alias("q")).select(
        DATE, F.try_divide("v", "q").alias("close"))
    days = limits.select(F.explode(F.sequence("lo", "hi")).alias(DATE))
    w = Window.partitionBy(F.lit(0)).orderBy(DATE)
    return days.join(seen, DATE, "left").select(DATE, ffill("close", None, w).alias("btc"))


def with_benchmark(panel: DataFrame, series: DataFrame) -> DataFrame:
    """Date join of a one-row-per-day series: its size is bounded by the calendar."""
    return panel.join(F.broadcast(series), DATE, "left")


def brand_panel(spark: SparkSession, sf_dir: str, benchmark: bool = False) -> DataFrame:
    daily, limits = brand_daily(spark, sf_dir), bounds(spark, sf_dir)
    out = _dense_panel(daily, brands(spark, sf_dir), limits)
    return with_benchmark(out, market_close(daily, limits)) if benchmark else out


def brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias(ENTITY)).distinct()


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias(ENTITY))


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = suppliers(spark, sf_dir)
    return _dense_panel(supplier_daily(spark, sf_dir), s, bounds(spark, sf_dir), s.count())


def brand_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset dimension of the brands: a few labels and venue symbols per brand."""
    n = F.substr(F.col(ENTITY), F.lit(7)).cast("int")
    ticker = F.concat(F.lit("T"), n.cast("string"))
    # Labels of the demo dimension.
    labels = F.array(*[F.lit(x) for x in ("DEX", "Lending", "L1 / L2", "Perps", "Stablecoins")])
    agg = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias(ENTITY)).agg(
        F.sum(F.round(F.col("p_retailprice") * 100)).alias("_cents"), F.count("*").alias("n_parts"))
    return agg.select(
        ENTITY, ticker.alias("ticker"), F.concat(F.lit("Project "), n.cast("string")).alias("name"),
        labels[n % 5].alias("category"), F.when(n % 5 == 2, "chain").otherwise("project").alias("asset_type"),
        F.when(n % 3 != 0, F.concat(ticker, F.lit("USDT"))).alias("futures_symbol"),
        F.when(n % 2 == 0, F.concat(ticker, F.lit("USDT"))).alias("spot_symbol"),
        F.lower(F.replace(ENTITY, F.lit("#"), F.lit("-"))).alias("slug"), n.alias("n"), "n_parts",
        (F.col("_cents") / F.col("n_parts") / 100.0).alias("list_price"),
    )


def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nation by day: revenue and flows."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return _daily(lines(spark, sf_dir).join(s, F.col("l_suppkey") == F.col("s_suppkey")).withColumn(ENTITY, F.col("s_nationkey")))


def nation_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer nation by day: order totals in whole units."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf_dir, "orders").withColumn(DATE, F.to_date("o_orderdate"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias(ENTITY), DATE).agg(
        F.sum(F.round("o_totalprice")).alias("revenue"), F.count("*").alias("n_orders"))
