"""Ordered operators against pandas and numpy, with keys that hold most of the rows."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from halospark.operators import joins, ordered


def _skewed(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.6, 7, rng.integers(0, 50, n))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n), "v": rng.integers(0, 90, n).astype(float)})
    return pdf, spark.createDataFrame(pdf)


def test_running_total_of_a_hot_key(spark):
    pdf, df = _skewed(spark)
    got = ordered.running_total(df, ["k"], [F.col("t")], F.col("v"), "run", "all").toPandas()
    want = pdf.sort_values(["k", "t"])
    want["run"] = want.groupby("k").v.cumsum()
    want["all"] = want.groupby("k").v.transform("sum")
    cols = ["k", "t", "v", "run", "all"]
    assert np.array_equal(got.sort_values(["k", "t"])[cols].to_numpy(), want[cols].to_numpy())


def test_row_number_and_samples(spark):
    pdf, df = _skewed(spark)
    numbered = ordered.with_row_number(df, [F.col("t")], "rn", "n").toPandas()
    assert (numbered.rn == numbered.t + 1).all() and (numbered.n == len(pdf)).all()
    assert sorted(r.t for r in ordered.every_nth(df, [F.col("t")], 100).collect()) == list(range(99, 3000, 100))
    taken = ordered.stride_sample(df, 7, [F.col("t")], rank="r").toPandas().sort_values("t")
    assert taken.t.tolist() == [i * 428 for i in range(7)] and taken.r.tolist() == list(range(7))
    # nothing but ties: still every number once
    ties = ordered.with_row_number(df.withColumn("c", F.lit(1)), [F.col("c")], "rn").toPandas()
    assert sorted(ties.rn) == list(range(1, 3001))
    # fewer rows than asked for: all of them
    assert ordered.stride_sample(df.where("t < 5"), 7, [F.col("t")]).count() == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_blocked_diff_equals_plain_diff(spark, seed):
    _, df = _skewed(spark, 1500, seed)
    plain = ordered.with_diff(df, "k", "t", "v", "d")
    cut = ordered.with_diff(df, "k", "t", "v", "d", block=F.floor(F.col("t") / 97))
    assert sorted(plain.collect()) == sorted(cut.select(*plain.columns).collect())


def test_quantiles_match_numpy(spark):
    pdf, df = _skewed(spark)
    probs = {"lo": 0.0, "q16": 0.16, "mid": 0.5, "q99": 0.99, "hi": 1.0}
    got = ordered.group_quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    for k, group in pdf.groupby("k"):
        assert np.allclose(got.loc[k, list(probs)], np.quantile(group.v, list(probs.values())))
    whole = ordered.group_quantiles(df, [], "v", probs).collect()[0]
    assert np.allclose(list(whole), np.quantile(pdf.v, list(probs.values())))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=30), st.floats(0, 1))
def test_quantile_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ordered.group_quantiles(df, [], "v", {"q": p}).collect()[0].q
    assert np.isclose(got, np.quantile(values, p))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_matches_merge_asof(spark, direction, exact):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.integers(0, 3, 400), "t": rng.integers(0, 500, 400), "id": range(400)})
    right = pd.DataFrame({"k": rng.integers(0, 3, 90), "t": rng.integers(0, 500, 90)}).drop_duplicates()
    right["v"] = range(len(right))
    want = pd.merge_asof(
        left.sort_values("t"), right.sort_values("t"), on="t", by="k", direction=direction, allow_exact_matches=exact
    )
    for block in (None, F.floor(F.col("t") / 40)):
        got = joins.asof_join(
            spark.createDataFrame(left), spark.createDataFrame(right), "t", ["k"], ["v"], direction, exact, block
        ).toPandas()
        a = got.sort_values("id").v.astype(float).fillna(-1).tolist()
        assert a == want.sort_values("id").v.fillna(-1).tolist()


def test_interpolation_matches_numpy(spark):
    knots = spark.createDataFrame([(0.0, 1.0), (1.0, 3.0), (4.0, 0.0)], "x double, y double")
    xs = [-0.1, 0.0, 0.5, 1.0, 2.5, 4.0, 4.1]
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = [r.o for r in joins.interpolate(df, "v", knots, "x", "y", "o").collect()]
    assert got[0] is None and got[-1] is None
    assert np.allclose(got[1:-1], np.interp(xs[1:-1], [0, 1, 4], [1, 3, 0]))


@pytest.mark.parametrize("grid", [[3.0], [1.0, 1.0, 2.0, 2.5], [0.0, *(1000.0 + i for i in range(50)), 1e6], []])
def test_snap_after_counts_grid_times(spark, grid):
    times = [None, -1.0, 0.0, 0.5, 1.0, 2.0, 2.2, 2.5, 3.0, 999.9, 1000.0, 1001.5, 1049.0, 5e5, 1e6, 2e6]
    df = spark.createDataFrame([(t,) for t in times], "t double")
    table = spark.createDataFrame([(g,) for g in grid], "a double")
    got = {r.t: (r.s, r.f) for r in joins.with_snap_before(joins.with_snap_after(df, "t", table, "s"), "t", table, "f").collect()}
    for t in times:
        n = sum(g <= t for g in grid) if t is not None else 0
        assert got[t] == (n, n - 1), t


def test_grids_and_knots_of_any_size(spark):
    grid = spark.range(6000).select(F.col("id").cast("double").alias("a"))
    df = spark.createDataFrame([(1.0,), (4999.5,), (7000.0,)], "t double")
    assert sorted(r.s for r in joins.with_snap_after(df, "t", grid, "s").collect()) == [2, 5000, 6000]
    knots = grid.withColumn("y", F.col("a") * 2)
    assert [r.y for r in joins.interpolate(df, "t", knots, "a", "y", "y").orderBy("t").collect()] == [2.0, 9999.0, None]


def test_crowded_and_repeated_knots_in_a_deep_tree(spark, monkeypatch):
    """A tree of several levels over knots that crowd and repeat, against bisection; a third of the events are equal."""
    monkeypatch.setattr(joins, "FANOUT", 4)
    rng = np.random.default_rng(3)
    for n in (4, 5, 16, 17, 64, 333):
        k = np.sort(np.concatenate([rng.random(n // 2) * 1e-9, np.repeat(rng.random(max(1, n // 8)), 2), rng.random(n) * 1e3]))[:n]
        t = np.concatenate([rng.choice(k, 40), rng.random(40) * 1e-9, rng.random(20) * 1e3, [-1.0, 2e3], np.full(50, k[n // 2])])
        grid = spark.createDataFrame([(float(x), i) for i, x in enumerate(k)], "a double, y long").repartition(3)
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "id long, t double")
        tree = joins.Knots(grid, "a")
        assert (len(tree.levels) > 1) == (n > 16)
        got = joins.with_snaps(df, "t", tree, after="s", before="f").orderBy("id").collect()
        assert [r.s for r in got] == np.searchsorted(k, t, side="right").tolist()
        assert all(r.f == r.s - 1 for r in got)
        distinct = np.unique(k)
        knots = spark.createDataFrame([(float(x), float(x) * 3) for x in distinct], "a double, y double")
        y = [r.o for r in joins.interpolate(df, "t", knots, "a", "y", "o").orderBy("id").collect()]
        inside = (t >= distinct[0]) & (t <= distinct[-1])
        assert [v is not None for v in y] == inside.tolist()
        assert np.allclose([v for v in y if v is not None], t[inside] * 3, rtol=1e-9)


def test_asof_plans_have_no_single_task_window(spark):
    grid = spark.range(20).select(F.col("id").cast("double").alias("a"))
    df = spark.range(100).select(F.col("id").cast("double").alias("t"))
    plan = joins.with_snaps(df, "t", grid, after="s", before="f")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan and "Join" not in plan


def test_redshift_plan(spark):
    schema = "name string, zlo double, zhi double"
    plan = spark.createDataFrame([("b", 0.6, 0.8), ("c", -0.05, 0.05)], schema)
    df = spark.createDataFrame([(0.7,), (0.6,), (0.8,), (0.0,), (0.85,)], "z double")
    got = sorted((r.z, r["name"]) for r in joins.snapshot_for_redshift(df, "z", plan).collect())
    assert got == [(0.0, "c"), (0.6, "b"), (0.7, "b"), (0.8, None), (0.85, None)]
    bad = plan.union(spark.createDataFrame([("a", 0.8, 0.0)], schema))
    with pytest.raises(Exception, match="bad redshift interval"):
        joins.snapshot_for_redshift(df, "z", bad).collect()


def test_asof_ties_repeat_themselves(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 1.0)], "k long, t double")
    right = spark.createDataFrame([(1, 3.0, v) for v in (2.0, 9.0, 4.0)], "k long, t double, v double")
    for part in (1, 7):
        back = joins.asof_join(left, right.repartition(part), "t", ["k"], ["v"]).orderBy("t").collect()
        ahead = joins.asof_join(left, right.repartition(part), "t", ["k"], ["v"], direction="forward").orderBy("t").collect()
        assert [r.v for r in back] == [None, 9.0] and [r.v for r in ahead] == [2.0, None]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_join_equals_plain_join(spark, how):
    pdf, df = _skewed(spark)
    small = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (99, "d")], "k long, tag string")
    plain = df.join(small, "k", how)
    assert sorted(map(str, plain.collect())) == sorted(map(str, joins.join_skewed(df, small, ["k"], how).collect()))
    cut = joins.join_skewed(df, small, ["k"], how, ["t"])
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))
    with pytest.raises(ValueError):
        joins.join_skewed(df, small, ["k"], "full")


def test_skewed_join_counts_its_copies(spark, tmp_path):
    """A side that could be broadcast once, but not SALTS times, is not broadcast."""
    spark.range(60_000).selectExpr("id AS k", "id % 7 AS tag").write.parquet(str(tmp_path / "small"))
    spark.range(1000).selectExpr("id AS k", "id AS t").write.parquet(str(tmp_path / "big"))
    small, big = (spark.read.parquet(str(tmp_path / name)) for name in ("small", "big"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(4 << 20))
    try:
        joined = joins.join_skewed(big, small, ["k"], "left")
        assert joined.count() == 1000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
