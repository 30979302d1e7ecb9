import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from daygrid.functions.text import display_name, slugify, visible_text
from daygrid.operators import events as V
from daygrid.operators import exposure as G
from daygrid.operators import regime as I
from daygrid.operators import score as C
from daygrid.operators import screener as S

D = dt.date


def bench(spark):
    rng = np.random.default_rng(2)
    drift = np.r_[np.full(180, .004), np.full(70, -.02), np.full(115, .006)]
    p = 100 * np.exp((drift + rng.normal(0, .01, 365)).cumsum())
    return spark.createDataFrame([(D(2023, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(p)], "date date, btc double")


def test_crash_cuts_exposure_and_overlay_keeps_ranks(spark):
    diag = G.diagnostics(bench(spark))
    crash = diag.where("date BETWEEN '2023-07-15' AND '2023-09-15'").agg(F.avg("exposure")).first()[0]
    assert crash < 1
    assert diag.agg(F.min("exposure"), F.max("exposure")).first()[0] >= 0.25
    rng = np.random.default_rng(0)
    rows = [(e, D(2023, 8, d), float(rng.normal())) for e in "abcd" for d in (1, 2, 3)]
    out = G.apply_exposure(spark.createDataFrame(rows, "entity string, date date, s double"), diag, "s").toPandas()
    for _, g in out.groupby("date"):
        assert (g.s.rank() == g.adjusted.rank()).all()


def test_exposure_between_composite_dates_is_not_seen(spark):
    s = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 3), 1.0)], "entity string, date date, s double")
    e = spark.createDataFrame([(D(2024, 1, 1), 0.5), (D(2024, 1, 2), 9.0)], "date date, exposure double")
    assert [r["adjusted"] for r in G.apply_exposure(s, e, "s").orderBy("date").collect()] == [0.5, 0.5]


def test_day_sees_completed_week_only(spark):
    days = pd.date_range("2023-12-01", "2024-08-15")
    vals = np.linspace(40_000, 70_000, len(days))
    rows = [(d.date(), 1e6 if d == pd.Timestamp("2024-07-15") else float(v)) for d, v in zip(days, vals)]
    b = spark.createDataFrame(rows, "date date, btc double")
    r = G.weekly_regime(b, b).where("date = '2024-07-15'").first()
    assert r["btc_weekly_close"] < 1e5 and r["btc_close"] == 1e6


def test_fixed_and_renormalised_composites_differ_on_missing_family(spark):
    w = spark.createDataFrame([("a", D(2024, 1, 1), 1.0, None, 1.0), ("b", D(2024, 1, 1), 1.0, 1.0, 1.0)], "entity string, date date, fundamentals double, momentum double, flows double")
    fixed = {r["entity"]: r["composite"] for r in C.composite_fixed(w).collect()}
    ren = {r["entity"]: r["c"] for r in w.withColumn("c", C.renormalised({"fundamentals": .55, "momentum": .175, "flows": .125})).collect()}
    assert abs(fixed["a"] - .675 / .85) < 1e-9 and abs(fixed["b"] - 1) < 1e-9
    assert abs(ren["a"] - 1) < 1e-9 and abs(ren["b"] - 1) < 1e-9


def test_universe_uses_history_of_the_day(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    rows = [("a", d, 1.0, 2e6, 5e7 if i < 110 else 2e8) for i, d in enumerate(days)]
    p = spark.createDataFrame(rows, "entity string, date date, price double, volume double, mcap double")
    m = spark.createDataFrame([("a", False, "AUSDT")], "entity string, excluded boolean, futures_symbol string")
    out = C.eligibility(p, m).orderBy("date").toPandas()
    assert not out.eligible_base[109] and out.eligible_base[110] and not out.eligible_sensitivity.any() and out.shortable.all()


FEATURES = ("close sma slope ret_1w ret_4w ret_12w pct_above diff_8w highs lows lows_prev g30 g90 vol_chg price_chg_8w funding oi_pct basis dxy dxy_chg yield_bps ai_ret mvrv_z dd btc_f5 btc_f20 eth_f5 eth_f20 "
            "issuance_bn purchases_bn credit_bps eq1 eq2 eq1_slope eq2_slope mnav_mstr mnav_bmnr mnav_purr").split()


def feature_row(spark, **kw):
    ints = {"token_weeks", "supply_rows", "vol_rows", "eq_rows", "coin_rank"}
    cols = ["week date", *[f"{c} double" for c in FEATURES], *[f"{c} int" for c in sorted(ints)], "tightening boolean"]
    vals = [D(2024, 1, 1), *[kw.get(c) for c in FEATURES], *[kw.get(c) for c in sorted(ints)], kw.get("tightening")]
    return spark.createDataFrame([tuple(vals)], ", ".join(cols))


def test_missing_inputs_fall_back_to_choppy(spark):
    rows = I.indicator_rows(feature_row(spark)).toPandas().set_index("indicator")
    assert rows.loc["BTC ETF flows", "score"] == 2 and rows.loc["BTC ETF flows", "choppy"] == 100
    assert rows.loc["Stablecoin supply growth", "score"] == 0 and rows.loc["Funding rates", "score"] == 1
    assert set(rows.score) <= {0, 1, 2} and len(rows) == 28
    fams = I.family_scores(I.indicator_rows(feature_row(spark), ["funding"])).toPandas().set_index("family")
    assert len(fams) == 7 and fams.loc["Macro / AI", "choppy"] == 100 and fams.loc["Macro / AI", "read"].startswith("No indicator data")


def test_drawdown_override_at_one_decimal_and_bounds(spark):
    for dd, want in ((-14.94, "Choppy"), (-14.96, "Risk-off"), (-15.0, "Risk-off")):
        out = I.classify(I.indicator_rows(feature_row(spark, dd=dd))).first()
        assert out["regime"] == want
        assert all(0 <= out[f"{v}_score"] <= 100 for v in I.VOTES)


def test_unlock_cards(spark):
    text = ("Unlock Value $17.88m 421,879 HYPE 0.042% (0.18% of float) May 29, 2026 10:00 PM Core Contributors $1 "
            "Unlock Value $17.88m 421,879 HYPE 0.042% (0.18% of float) June 29, 2026 10:00 PM Core Contributors")
    df = spark.createDataFrame([("hyperliquid", text, "hype"), ("x", "Just a moment... May 29, 2026 Team", "x"), ("y", None, "y")], "slug string, text string, ticker string")
    out = V.unlock_events(df, "text", ["slug"], "ticker").orderBy("date").toPandas()
    assert out.slug.tolist() == ["hyperliquid"] * 2 and out.date.tolist() == [D(2026, 5, 29), D(2026, 6, 29)]
    assert np.allclose(out.value_usd, 17_880_000) and np.allclose(out.token_amount, 421_879) and np.allclose(out.pct_supply, .042) and np.allclose(out.pct_float, .18)
    assert set(out.bucket) == {"Potential Selling"} and set(out.token_symbol) == {"HYPE"}


def test_return_correlations(spark):
    rng = np.random.default_rng(4)
    rows = [(D(2024, 1, 1) + dt.timedelta(days=i), t, float(100 + i + rng.normal())) for i in range(65) for t in ("BTC", "HYPE", "ETH")]
    df = spark.createDataFrame(rows, "date date, ticker string, price double")
    out = S.return_correlations(df, "HYPE", ["BTC", "HYPE", "BTC", "MISSING"]).orderBy("pos").toPandas()
    assert out.benchmark.tolist() == ["BTC", "HYPE", "MISSING"] and out["corr"][1] == 1.0 and out.observations.tolist() == [35, 35, 0]
    assert out.note[2] == "Benchmark has no price history." and pd.isna(out["corr"][2])


def test_text_helpers(spark):
    raw = "<p>A&nbsp;&amp;amp; &#x41;<br>b</p><script>x<p></script><NOSCRIPT>n</NOSCRIPT><h1>T</h1>"
    df = spark.createDataFrame([(raw, "aave-v3_core", "A & B--c!")], "h string, s string, n string")
    r = df.select(visible_text("h").alias("t"), display_name("s").alias("d"), slugify("n").alias("g")).first()
    assert r["t"] == "A &amp; A b T" and r["d"] == "Aave V3 Core" and r["g"] == "a-b-c"
