"""Registered queries against their SQL at the smallest scale, and the driver contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("P03_align_panel", "P19_breakdown_to_panel", "P22_klines", "X01_winsorise_split_groups", "X04_rank_ic", "F10_mc_fees_reversion", "F16_growth_composite", "M04_momentum_breadth", "L01_stablecoin_growth",
          "C04_regime_composite", "I28_classifier", "G06_apply_to_composite", "E09_asset_frame", "E13_match_market_data", "S12_histogram", "V02_unlock_events", "V10_ytd_to_quarter", "V28_year_over_year", "J08_as_of_backward")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    b = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=key)
    assert a == b


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["date", "ic", "n_pairs"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
