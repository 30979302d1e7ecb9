import datetime as dt
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from daygrid.config import Periods
from daygrid.operators import panel as P
from daygrid.operators import research as W
from daygrid.plans import signals as S
from daygrid.sources import files, tables as T

D = dt.date


def long_panel(spark, wide: pd.DataFrame, name="price"):
    rows = [(c, d.date(), None if pd.isna(v) else float(v)) for c in wide for d, v in wide[c].items()]
    return spark.createDataFrame(rows, f"entity string, date date, {name} double")


def test_align_fills_seven_days_only_and_covers_empty_entities(spark):
    daily = spark.createDataFrame([("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 12), 2.0)], "entity string, date date, x double")
    ents = spark.createDataFrame([("a",), ("b",)], "entity string")
    out = P.align(daily, ents, P.date_bounds(daily), ["x"]).toPandas().sort_values(["entity", "date"])
    a = out[out.entity == "a"].x.tolist()
    assert a[:8] == [1.0] * 8 and np.isnan(a[8:11]).all() and a[11] == 2.0
    assert out[out.entity == "b"].x.isna().all() and len(out) == 24


def test_labels_enter_next_day(spark):
    idx = pd.date_range("2024-05-01", periods=45)
    lab = W.label_returns(long_panel(spark, pd.DataFrame({"a": 100.0 + np.arange(45)}, index=idx)), keep_legs=True).orderBy("date").toPandas()
    assert lab.entry_7[0] == 101 and lab.exit_7[0] == 108 and abs(lab.ret_7[0] - (108 / 101 - 1)) < 1e-15
    assert lab.ret_30.notna().sum() == 45 - 31


def test_purged_periods_and_folds(spark):
    days = spark.createDataFrame([(d.date(),) for d in pd.date_range("2024-05-01", "2026-05-05")], "date date")
    last = lambda p: W.period_dates(days, p, 30, Periods()).agg(F.max("date")).first()[0]
    assert (last("Train"), last("Validation"), last("Test")) == (D(2025, 3, 30), D(2025, 9, 30), D(2026, 4, 4))
    folds = W.walk_forward_folds(days, Periods()).orderBy("validation_start").toPandas()
    assert folds.fold.tolist() == [f"fold_{i + 1}" for i in range(len(folds))] and len(folds) == 4
    assert ((pd.to_datetime(folds.validation_start) - pd.to_datetime(folds.train_end)).dt.days == 15).all()


def test_sign_ignores_test_labels(spark):
    idx = pd.date_range("2024-05-01", "2026-05-05")
    rows = []
    for e in range(6):
        for d in idx:
            r = float(e) if d <= pd.Timestamp("2025-04-01") else -100.0 * e if d >= pd.Timestamp("2025-11-01") else None
            rows.append((str(e), d.date(), float(e), r, r, r))
    frame = spark.createDataFrame(rows, "entity string, date date, z double, ret_7 double, ret_14 double, ret_30 double")
    days = frame.select("date").distinct()
    dates = {h: W.period_dates(days, "Train", h, Periods()) for h in (7, 14, 30)}
    reg = spark.createDataFrame([(0, "momentum", "s")], "seq int, family string, signal string")
    row = W.ic_table(W.signal_ics(frame, {"z": ("momentum", "s")}, dates, 6), reg).first()
    assert row["sign"] == 1 and abs(row["mean_ic_avg"] - 1.0) < 1e-12 and row["selected"]


def test_greedy_dedupe_order(spark):
    t = spark.createDataFrame([(i, "f", s, ic, 1, True) for i, (s, ic) in enumerate((("a", .1), ("b", .3), ("c", .2)))], "seq int, family string, signal string, mean_ic_avg double, sign int, selected boolean")
    c = spark.createDataFrame([("f", "a", "b", 0, 1, .95), ("f", "a", "c", 0, 2, .99), ("f", "b", "c", 1, 2, .5)], "family string, left_signal string, right_signal string, left_seq int, right_seq int, corr double")
    out = {r["signal"]: (r["selected"], r["dedupe_reason"]) for r in W.dedupe_signals(t, c).collect()}
    assert out["a"] == (False, "train corr >= 0.90 with b") and out["b"][0] and out["c"][0]


def test_signals_against_pandas_and_without_lookahead(spark):
    rng = np.random.default_rng(1)
    idx = pd.date_range("2024-01-01", periods=260)
    price = pd.DataFrame(np.exp(rng.normal(0, .03, (260, 4)).cumsum(0)) * 50, index=idx, columns=list("abcd"))
    rev = pd.DataFrame(rng.uniform(1, 9, (260, 4)).round(3), index=idx, columns=list("abcd"))
    rev.iloc[40:44, 1] = np.nan
    panel = long_panel(spark, price).join(long_panel(spark, rev, "revenue"), ["entity", "date"])
    names = ["revenue_growth", "revenue_stability", "vol_adj_momentum", "momentum_breadth", "realised_vol", "drawdown_from_ath"]
    got = S.signal_frame(panel, names, 4).toPandas().set_index(["date", "entity"]).sort_index()
    sm = rev.rolling(7, min_periods=3).mean()
    ch = lambda x, k: x / x.shift(k) - 1
    want = {"revenue_growth": ch(sm, 14), "revenue_stability": 1 / (ch(sm, 7).rolling(91, min_periods=30).std() + 1e-8),
            "vol_adj_momentum": ch(price, 21) / (ch(price, 1).rolling(21, min_periods=10).std() * np.sqrt(365) + 1e-8),
            "momentum_breadth": (ch(price, 7) > 0).astype(float).rolling(91, min_periods=39).mean(),
            "realised_vol": -(ch(price, 1).rolling(28, min_periods=14).std() * np.sqrt(365)), "drawdown_from_ath": (price - price.cummax()) / (price.cummax() + 1e-8)}
    for n, w in want.items():
        w = w.stack(future_stack=True)
        w.index = pd.MultiIndex.from_tuples([(d.date(), e) for d, e in w.index], names=["date", "entity"])
        np.testing.assert_allclose(got[n].astype(float).to_numpy(), w.sort_index().to_numpy(), rtol=1e-9, atol=1e-9)
    cut = idx[200].date()
    part = S.signal_frame(panel.where(F.col("date") <= F.lit(cut)), names, 4).toPandas().set_index(["date", "entity"]).sort_index()
    np.testing.assert_allclose(part.astype(float).to_numpy(), got.loc[:cut].astype(float).to_numpy(), equal_nan=True)


def test_signal_plan_has_one_entity_exchange_and_no_product(spark):
    sf = "/root/testdata/sf0.001"
    daily, limits = T.brand_daily(spark, sf), T.bounds(spark, sf)
    ents = spark.createDataFrame([(f"Brand#{i}",) for i in range(1, 26)], "entity string")
    panel = P.align(daily, ents, limits, ["price", "revenue", "dex_volume"])
    plan = S.signal_frame(panel, ["revenue_growth", "vol_adj_momentum", "dex_volume_growth"], 25)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert len(re.findall(r"hashpartitioning\(entity#\d+, \d+\)", plan)) == 1


def test_written_panel_prunes_months_and_versions(spark, tmp_path):
    df = spark.createDataFrame([("a", D(2024, m, 1), 1.0) for m in (1, 2, 3)], "entity string, date date, x double")
    files.write_panel(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p")).where("month = '2024-02'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().executedPlan().toString()
    files.write_version(df, str(tmp_path / "v"), 1)
    files.write_version(df.limit(1), str(tmp_path / "v"), 2)
    assert files.read_latest(spark, str(tmp_path / "v")).count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("one\ntwo")
    assert files.read_texts(spark, str(tmp_path / "t")).first()["text"] == "one\ntwo"


def test_landed_pages_share_folders_and_come_back_whole(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [(i, None if i == 3 else f"<p>{i}\né</p>\n") for i in range(40)]
    files.write_texts(spark.createDataFrame(rows, "id long, html string"), path, "id", "html", 4)
    got = files.read_texts(spark, path).select("text", "path").collect()
    assert sorted(r["text"] for r in got) == sorted(f"{i}\n{t or ''}" for i, t in rows)
    assert len({r["path"] for r in got}) == 40 and len({r["path"].rsplit("/", 1)[0] for r in got}) <= 4


def test_a_wide_panel_is_dealt_by_its_number_of_entities(spark):
    daily = spark.createDataFrame([(f"e{i}", dt.date(2024, 1, 1 + i % 3), float(i)) for i in range(9)], "entity string, date date, m double")
    narrow, wide = (P.densify(daily, daily.select("entity"), P.date_bounds(daily), ["m"], n) for n in (None, 5000))
    assert wide.rdd.getNumPartitions() == 25
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect())) and wide.count() == 27
