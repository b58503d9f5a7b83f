"""Hot keys: same rows as the plain operation, and no task with the whole key."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinpanel.operators import scale as K
from kinpanel.operators.joins import asof_join
from kinpanel.operators.ordering import exact_quantiles, running_totals
from kinpanel.stats.holdout import draw_split, holdout_split
from kinpanel.stats.metrics import roc_auc


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of 30,000 rows has key 0, many have a NULL key, the rest is spread."""
    return spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, None)
        .otherwise(F.col("id") % 997 + 1).cast("int").alias("k"), (F.col("id") * 7919 % 1000).cast("int").alias("v"))


def test_hot_keys_are_few_and_found(skewed):
    found = {r["k"]: r["__salts"] for r in K.hot_keys(skewed, ["k"], rows=300).collect()}
    assert set(found) == {0, None} and found[0] == 34
    assert K.hot_keys(skewed, ["k"]) is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_join_equals_plain(spark, skewed, listed, how, null_safe):
    right = spark.createDataFrame([(0, "a"), (0, "b"), (5, "c"), (None, "n")], "k int, w string")
    salted = K.salted_join(skewed, right, ["k"], how, null_safe=null_safe, rows=300)
    other = right.withColumnRenamed("k", "rk")
    cond = skewed["k"].eqNullSafe(other["rk"]) if null_safe else skewed["k"] == other["rk"]
    plain = skewed.join(other, cond, how).drop("rk")
    assert sorted(salted.columns) == sorted(plain.columns)
    assert listed(salted.select(*plain.columns)) == listed(plain)


def test_hot_key_is_spread_over_join_partitions(spark, skewed):
    right = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    sizes = {}
    for name, rows in (("plain", 10**9), ("salted", 300)):
        old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            joined = K.salted_join(skewed, right, ["k"], rows=rows).withColumn("p", F.spark_partition_id())
            sizes[name] = [r["count"] for r in joined.groupBy("p").count().collect()]
        finally:
            for c, v in old.items():
                spark.conf.set(c, v)
    assert sum(sizes["plain"]) == sum(sizes["salted"])
    assert max(sizes["plain"]) > 10_000 and max(sizes["salted"]) < 6_000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_equal_rows_and_null_keys_are_spread(spark, how):
    """One key with three distinct rows, and as many NULL keys: neither stays in one task."""
    left = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, 1).cast("int").alias("k"), (F.col("id") % 3).alias("v"))
    right = spark.createDataFrame([(1, "a")], "k int, w string")
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for c, v in zip(old, ("-1", "false")):
        spark.conf.set(c, v)
    try:
        joined = K.salted_join(left, right, ["k"], how, rows=300).withColumn("p", F.spark_partition_id())
        sizes = {(r["k"], r["p"]): r["count"] for r in joined.groupBy("k", "p").count().collect()}
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    for key in (1, None) if how == "left" else (1,):
        own = [n for (k, _), n in sizes.items() if k == key]
        assert sum(own) == 15_000 and len(own) > 4 and max(own) < 6_000


def test_group_statistics_equal_a_window(skewed, listed, monkeypatch):
    monkeypatch.setattr(K, "HOT_ROWS", 300)
    w = Window.partitionBy("k")
    want = skewed.withColumn("lo", F.min("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    assert listed(K.attach_stats(skewed, ["k"], lo=F.min("v"), n=F.count(F.lit(1)))) == listed(want)
    best = want.filter(F.col("v") == F.col("lo")).select("id", "k", "v")
    assert listed(K.keep_at_extreme(skewed, ["k"], "v", "min")) == listed(best)


def test_counted_join_both_ways(skewed, spark, listed):
    small = spark.createDataFrame([(0, "a"), (5, "c")], "k int, w string")
    few, many = (K.join_counted(skewed, small, ["k"], "left", rows=limit) for limit in (10, 1))
    assert listed(few) == listed(many)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().toString()


@pytest.mark.parametrize("options", [{"parts": 1}, {"parts": 7}, {"few_times": True}, {"parts": 40, "hot": 2}])
def test_asof_against_brute_force(spark, listed, options, monkeypatch):
    if "hot" in options:
        monkeypatch.setattr(K, "HOT_ROWS", options.pop("hot"))
    draw = random.Random(5)
    left = [(draw.choice([1, 1, 1, 2, 3]), draw.randrange(60), i) for i in range(300)]
    right = [(draw.choice([1, 1, 2]), draw.randrange(60), 1000 + i) for i in range(80)]
    got = asof_join(spark.createDataFrame(left, "k int, lt int, l int"), spark.createDataFrame(right, "k int, rt int, r int"),
                    ["k"], "lt", "rt", "left", **options)
    want = []
    for k, t, l in left:
        known = [x for x in right if x[0] == k and x[1] <= t]
        last = max((x[1] for x in known), default=None)
        want += [(l, x[2]) for x in known if x[1] == last] or [(l, None)]
    assert listed(got, "l", "r") == sorted(want, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = pd.DataFrame({"g": rng.integers(0, 3, 4000), "v": np.round(rng.lognormal(3, 2, 4000), 1)})
    got = exact_quantiles(spark.createDataFrame(data), ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.99}, parts=16)
    for row in got.collect():
        want = np.quantile(data.v[data.g == row["g"]], [0.25, 0.5, 0.99])
        assert np.allclose([row["a"], row["b"], row["c"]], want)


def test_running_totals_without_groups(spark):
    df = spark.createDataFrame([(float(i * 37 % 101), 1 + i % 4) for i in range(101)], "s double, n int")
    got = {r["s"]: (r["before_n"], r["total_n"]) for r in running_totals(df, [], "s", ["n"], parts=8).collect()}
    sizes = {float(i * 37 % 101): 1 + i % 4 for i in range(101)}
    assert got == {s: (sum(n for t, n in sizes.items() if t < s), sum(sizes.values())) for s in sizes}


def test_auc_against_all_pairs(spark):
    draw = random.Random(2)
    data = [(draw.randrange(2), float(draw.randrange(12))) for _ in range(200)]
    pos, neg = ([s for y, s in data if y == side] for side in (1, 0))
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = roc_auc(spark.createDataFrame(data, "y int, s double"), "y", "s").first()[0]
    assert got == pytest.approx(want)
    assert roc_auc(spark.createDataFrame([(1, 1.0)], "y int, s double"), "y", "s").first()[0] is None


def test_holdout_sizes_and_repeatability(spark, listed):
    df = spark.range(1001)
    for prop, size in ((0.0, 0), (0.29, 290), (0.7, 700), (1.0, 1001)):
        split = holdout_split(df, "id", prop, 2, "s")
        assert [r[1] for r in listed(split.groupBy("rep").agg(F.sum("in_train")))] == [size, size]
    assert listed(holdout_split(df, "id", 0.5, 1)) == listed(holdout_split(df.repartition(7), "id", 0.5, 1))


def test_drawn_split_is_exact_and_uniform():
    counts, rng = np.array([50, 30, 0, 20]), np.random.default_rng(3)
    drawn = np.array([draw_split(counts, 37, rng) for _ in range(4000)])
    assert (drawn.sum(axis=1) == 37).all() and (drawn <= counts).all() and (drawn >= 0).all()
    assert np.allclose(drawn.mean(axis=0), counts * 0.37, atol=0.15)
    # hypergeometric variance of the first cell
    assert drawn[:, 0].var() == pytest.approx(37 * 0.5 * 0.5 * 63 / 99, rel=0.1)
    huge = np.array([10**12, 3 * 10**11])
    assert draw_split(huge, 4 * 10**11, rng).sum() == 4 * 10**11


def test_no_scratch_outside_the_named_folder(spark):
    from kinpanel.session import scratch_path, shared_dir

    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/")
