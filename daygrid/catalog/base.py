"""Registry of queries and the DuckDB text shared by their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(x: Column | str, k: int = 6) -> Column:
    """Rounding shared with the oracles; adding zero folds minus zero."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x, k) + 0.0


def daily_sql(entity: str, source: str) -> str:
    return f"""
    SELECT {entity} AS entity, CAST(l_shipdate AS DATE) AS date,
      sum(round(l_extendedprice)) / sum(l_quantity) AS price,
      sum(round(l_extendedprice * (1 - l_discount))) AS revenue,
      sum(round(l_extendedprice * l_tax)) AS fees,
      sum(round(l_extendedprice)) FILTER (l_returnflag = 'R') AS issuance,
      sum(round(l_extendedprice * l_discount)) AS burn,
      sum(round(l_extendedprice * l_tax)) FILTER (l_linenumber = 1) AS tips,
      sum(round(l_extendedprice * l_tax)) FILTER (l_linenumber = 2) AS priority,
      sum(round(l_extendedprice * l_tax)) FILTER (l_linenumber = 3) AS other_fees,
      sum(round(l_extendedprice * (1 - l_discount) * (1 - l_tax))) AS gross_profit,
      CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS addresses,
      sum(round(l_extendedprice)) AS volume,
      sum(l_quantity) FILTER (l_returnflag = 'N') AS open_interest,
      sum(round(l_extendedprice)) FILTER (l_returnflag = 'A') AS dex_volume,
      sum(round(l_extendedprice)) FILTER (l_linestatus = 'O') AS deposits,
      coalesce(sum(round(l_extendedprice)) FILTER (l_linestatus = 'O'), 0)
        - coalesce(sum(round(l_extendedprice)) FILTER (l_linestatus = 'F'), 0) AS bridge_flow,
      sum(l_quantity) AS qty,
      coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0) AS qty_open
    FROM {source} GROUP BY 1, 2"""


_FILLED = ("price", "revenue", "fees", "issuance", "burn", "tips", "priority", "other_fees", "gross_profit",
           "addresses", "volume", "open_interest", "dex_volume", "deposits", "bridge_flow")


def panel_sql(daily: str, entities: str) -> str:
    """WITH list giving `daily`, `grid`, `sparse`, `panel` and `btc` (no trailing comma)."""
    filled = ", ".join(f"last_value({m} IGNORE NULLS) OVER f AS {m}" for m in _FILLED)
    return f"""WITH daily AS ({daily}),
    lim AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem),
    days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM lim),
    grid AS (SELECT entity, date FROM ({entities}) CROSS JOIN days),
    sparse AS (SELECT * FROM grid LEFT JOIN daily USING (entity, date)),
    filled AS (SELECT entity, date, {filled},
        sum(coalesce(qty, 0)) OVER c AS supply, sum(coalesce(qty_open, 0)) OVER c AS staked,
        sum(coalesce(deposits, 0)) OVER c AS tvl, sum(coalesce(dex_volume, 0)) OVER c AS stablecoin_supply,
        sum(qty) OVER (PARTITION BY entity) AS total_qty
      FROM sparse
      WINDOW f AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
             c AS (PARTITION BY entity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    panel AS (SELECT *, price * supply AS mcap, price * total_qty AS fdv FROM filled),
    seen AS (SELECT date, sum(volume) / sum(qty) AS close FROM daily GROUP BY 1),
    btc AS (SELECT date, last_value(close IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS btc
            FROM days LEFT JOIN seen USING (date))"""


BRAND = panel_sql(
    daily_sql("p_brand", "lineitem JOIN part ON l_partkey = p_partkey"), "SELECT DISTINCT p_brand AS entity FROM part")
SUPPLIER = panel_sql(daily_sql("l_suppkey", "lineitem"), "SELECT s_suppkey AS entity FROM supplier")
NATION_DAILY = daily_sql("s_nationkey", "lineitem JOIN supplier ON l_suppkey = s_suppkey")
NATION_ORDERS = """SELECT c_nationkey AS entity, CAST(o_orderdate AS DATE) AS date, sum(round(o_totalprice)) AS revenue,
    count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
MASTER = """SELECT entity, 'T' || n AS ticker, 'Project ' || n AS name,
    (['DEX', 'Lending', 'L1 / L2', 'Perps', 'Stablecoins'])[n % 5 + 1] AS category,
    CASE WHEN n % 5 = 2 THEN 'chain' ELSE 'project' END AS asset_type,
    CASE WHEN n % 3 <> 0 THEN 'T' || n || 'USDT' END AS futures_symbol,
    CASE WHEN n % 2 = 0 THEN 'T' || n || 'USDT' END AS spot_symbol,
    lower(replace(entity, '#', '-')) AS slug, n, n_parts, cents / n_parts / 100 AS list_price
    FROM (SELECT p_brand AS entity, CAST(substr(p_brand, 7) AS INT) AS n, sum(round(p_retailprice * 100)) AS cents,
          count(*) AS n_parts FROM part GROUP BY 1, 2)"""
