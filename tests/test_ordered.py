"""Split groups against brute force, with ties, nulls and one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daygrid.operators import cross_section as X
from daygrid.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 6000
    g = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    v = np.where(rng.random(n) < 0.4, 5.0, rng.normal(size=n).round(2))
    pdf = pd.DataFrame({"id": range(n), "g": g, "v": v})
    pdf.loc[rng.random(n) < 0.05, "v"] = np.nan
    pdf["w"] = pdf["v"].fillna(0) * 0.3 + rng.normal(size=n).round(1)
    df = spark.createDataFrame(pdf).selectExpr("id", "g", "nanvl(v, null) v", "w")
    return df, pdf


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_counts_do_not_depend_on_the_cut_points(skewed, ranges):
    df, pdf = skewed
    got = ordered.cumulative_counts(df, ["g"], "v", ranges).toPandas().set_index(["g", "v"]).sort_index()
    want = pdf.dropna().groupby("g")["v"].apply(lambda s: s.value_counts().sort_index().cumsum())
    assert (got["upto"].to_numpy() == want.to_numpy()).all()


def test_average_ranks_and_quantiles(skewed):
    df, pdf = skewed
    got = ordered.average_ranks(df, ["g"], "v").toPandas().sort_values("id")
    want = pdf.groupby("g")["v"].rank(method="average")
    np.testing.assert_allclose(got["avg_rank"].astype(float).to_numpy(), want.to_numpy())
    q = ordered.group_quantiles(df, ["g"], "v", {"lo": 0.01, "m": 0.5, "hi": 0.99}).toPandas().set_index("g").sort_index()
    for name, p in (("lo", 0.01), ("m", 0.5), ("hi", 0.99)):
        np.testing.assert_allclose(q[name].to_numpy(), pdf.groupby("g")["v"].quantile(p).sort_index().to_numpy())


def test_both_routes_agree(skewed):
    df, _ = skewed
    for fn in (lambda m: X.rank_z(df, "v", ["g"], "z", m, winsor=True), lambda m: X.winsorise(df, "v", ["g"], "z", m),
               lambda m: X.peer_normalise(df, "v", ["g"], "z", m), lambda m: X.versus_group_median(df, "v", ["g"], "z", m)):
        a, b = (fn(m).select("id", "z").toPandas().sort_values("id")["z"].astype(float).to_numpy() for m in (10_000, None))
        np.testing.assert_allclose(a, b, atol=1e-9)
    a, b = (X.rank_ic(df, "v", "w", ["g"], m).toPandas().sort_values("g")["ic"].to_numpy() for m in (10_000, None))
    np.testing.assert_allclose(a, b, atol=1e-12)


def test_rank_z_mean_zero_unit_deviation_and_three_names(spark):
    df = spark.createDataFrame([("d", float(i)) for i in range(9)] + [("e", 1.0), ("e", 2.0)], "d string, x double")
    out = X.rank_z(df, "x", ["d"], "z", 10).toPandas()
    z = out[out.d == "d"].z
    assert abs(z.mean()) < 1e-12 and abs(z.std(ddof=0) - 1) < 1e-12
    assert out[out.d == "e"].z.isna().all()


@pytest.mark.parametrize("n, moved", [(100, False), (101, True)])
def test_winsorising_moves_ranks_only_above_hundred_names(spark, n, moved):
    df = spark.createDataFrame([("d", float(i) ** 2) for i in range(n)], "d string, x double")
    plain, cut = (X.rank_z(df, "x", ["d"], "z", 1000, winsor=w).orderBy("x").toPandas().z.to_numpy() for w in (False, True))
    assert (not np.allclose(plain, cut)) == moved


def test_pairwise_spearman_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"entity": range(300), "date": 1, "a": rng.normal(size=300).round(1)})
    pdf["b"] = pdf.a + rng.normal(size=300).round(1)
    pdf["c"] = rng.normal(size=300)
    got = X.pairwise_spearman(spark.createDataFrame(pdf), ["a", "b", "c"], ["entity", "date"]).toPandas()
    want = pdf[["a", "b", "c"]].rank().corr()
    for r in got.itertuples():
        assert abs(r.corr - want.loc[r.left_signal, r.right_signal]) < 1e-12


def test_a_hot_tie_spreads_over_ranges_and_ranks_stay_exact(spark):
    rng = np.random.default_rng(8)
    n = 20_000
    pdf = pd.DataFrame({"id": range(n), "g": np.where(rng.random(n) < 0.8, "hot", "b"), "v": np.where(rng.random(n) < 0.6, 1.0, rng.integers(-3, 6, n).astype(float))})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(pdf)
        ranged = df.repartitionByRange("g", "v", F.xxhash64("id", "g", "v")).groupBy(F.spark_partition_id()).count().toPandas()["count"]
        got = ordered.average_ranks(df, ["g"], "v").toPandas().sort_values("id")
        low = ordered.winsorised_ranks(df, ["g"], "v", 0.02, 0.9).toPandas().sort_values("id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranged.max() < 0.4 * n
    np.testing.assert_allclose(got["avg_rank"].to_numpy(), pdf.groupby("g")["v"].rank().to_numpy())
    assert (got["n_names"].to_numpy() == pdf.groupby("g")["v"].transform("count").to_numpy()).all()
    clipped = pdf.groupby("g")["v"].transform(lambda s: s.clip(s.quantile(0.02), s.quantile(0.9)))
    np.testing.assert_allclose(low["avg_rank"].to_numpy(), clipped.groupby(pdf.g).rank().to_numpy())


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0], [5.0] * 9, [1.0, None, None], [None], [1.0, 1.0, 2.0, 2.0, 2.0, 9.0, None]])
def test_small_groups_nulls_and_null_groups(spark, values):
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)] + [(100, None, 1.0)], "id int, g string, v double")
    want = pd.Series(values, dtype=float)
    for got, ranks in ((ordered.average_ranks(df, ["g"], "v"), want.rank()),
                       (ordered.winsorised_ranks(df, ["g"], "v", 0.2, 0.7), want.clip(want.quantile(0.2), want.quantile(0.7)).rank())):
        pdf = got.toPandas().set_index("id").sort_index()
        np.testing.assert_allclose(pdf["avg_rank"].astype(float).to_numpy()[:-1], ranks.to_numpy())
        assert pd.isna(pdf.loc[100, "avg_rank"])


def test_more_rows_make_more_ranges_not_larger_ones(spark, tmp_path):
    """Every range is a task of its own of a bounded number of rows, whatever the number of shuffle partitions."""
    n = 1_000_000
    df = spark.range(0, n, 1, 4).select("id", F.lit("hot").alias("g"), F.when(F.col("id") % 2 == 0, 0.0).otherwise((F.col("id") % 977).cast("double")).alias("v"))
    written, saved = [], ordered.saved
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ordered, "saved", lambda frame, label: written.append((label, saved(frame, label))) or written[-1][1])
        quantiles = ordered.group_quantiles(df, ["g"], "v", {"m": 0.75}).first()
    rows = next(frame for label, frame in written if label == "ranges")
    held = rows.groupBy(F.input_file_name()).agg(F.count("*").alias("n"), F.count_distinct("_range").alias("ranges")).toPandas()
    assert held["n"].max() < 2 * 200_000 and len(held) == 5 and held["ranges"].max() == 1
    odd = np.arange(1, n, 2) % 977
    assert quantiles["m"] == np.quantile(np.concatenate([np.zeros(n // 2), odd]), 0.75)


def test_wide_cross_sections_fill_tasks_by_their_names(spark):
    df = spark.createDataFrame([(d, float((7 * i + d) % 101)) for d in range(3) for i in range(200)], "d int, v double")
    narrow, wide = (X.winsorise(df, "v", ["d"], "w", n) for n in (200, 5000))
    assert wide.rdd.getNumPartitions() == 25
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, wide.collect()))
