"""Paired tests, adjusted p-values, selection rules and table differences on literal tables."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions.ranks import average_ranks, running_total
from stratalens.operators import paired as P
from stratalens.operators import partitions as V
from stratalens.operators import reports as R


def test_signed_rank_exact_p(spark):
    d = [1.5, -0.5, 2.5, 3.5, -4.5, 5.5, 6.5]
    df = spark.createDataFrame([("g", x) for x in d] + [("g", 0.0)], "g string, d double")
    row = P.signed_rank(df, ["g"]).head()
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(sum(r for r, x in zip(ranks, d) if x > 0), sum(r for r, x in zip(ranks, d) if x < 0))
    sums = [sum(r for r, s in zip(range(1, 8), signs) if s) for signs in itertools.product([0, 1], repeat=7)]
    assert row.n_nonzero == 7 and np.isclose(row.wilcoxon_p, min(1, 2 * np.mean([s <= w for s in sums])))
    normal = P.signed_rank(df, ["g"], "normal").head()
    assert not np.isclose(normal.wilcoxon_p, row.wilcoxon_p)


def test_all_zero_differences_have_no_p(spark):
    df = spark.createDataFrame([("g", 0.0), ("g", 0.0)], "g string, d double")
    row = P.compare_pairs(df, ["g"]).head()
    assert row.wilcoxon_p is None and row.rank_biserial is None and row.win_rate == 0.0


def test_holm_passes_nulls_through(spark):
    df = spark.createDataFrame([("f", 1, 0.01), ("f", 2, 0.04), ("f", 3, None), ("f", 4, 0.03)], "fam string, i int, wilcoxon_p double")
    got = {r.i: r.p_holm for r in P.holm(df, ["fam"]).collect()}
    assert np.isclose(got[1], 0.03) and np.isclose(got[4], 0.06) and np.isclose(got[2], 0.06) and got[3] is None


@pytest.mark.parametrize("bound", [5, 10_000])
def test_running_totals_of_a_crowded_group(spark, bound):
    rng = np.random.default_rng(0)
    rows = [("big", int(v), int(rng.integers(1, 9))) for v in rng.permutation(300)] + [("small", 1, 4)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    got = {(r.g, r.v): r.t for r in running_total(df, ["g"], "v", "n", "t", bound).collect()}
    acc = 0
    for _, v, n in sorted(r for r in rows if r[0] == "big"):
        acc += n
        assert got["big", v] == acc
    assert got["small", 1] == 4


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("g", x) for x in [3.0, 1.0, 3.0, 2.0]], "g string, x double")
    assert {r.x: r.avg_rank for r in average_ranks(df, ["g"], "x").collect()} == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5}


def test_table_diff_nulls_and_tolerance(spark):
    old = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 5.0, "c"), (5, None, None)], "k int, x double, s string")
    new = spark.createDataFrame([(1, 1.0 + 1e-14, "a"), (2, 2.0, "b"), (4, 5.0, "c"), (5, None, None)], "k int, x double, s string")
    got = sorted((r.k, r["column"], r.kind) for r in R.table_diff(old, new, ["k"], ["x", "s"]).collect())
    assert got == [(2, "x", "changed"), (3, "(whole row)", "dropped"), (4, "(whole row)", "added")]


def test_split_invariance_raises(spark):
    rows = [("a", 1, "s", "db", 0.1, 1.0, sp, v) for sp, v in (("severity", 0.5), ("symmetric", 0.6))]
    df = spark.createDataFrame(rows, "arm string, seed int, sel_id string, method string, delta double, t double, split string, f1 double")
    with pytest.raises(ValueError):
        R.split_invariance(df, ["f1"])


def test_non_dominated_keeps_equal_points(spark):
    df = spark.createDataFrame([("g", 1, 1.0, 1.0), ("g", 2, 1.0, 1.0), ("g", 3, 0.5, 2.0), ("g", 4, 0.5, 1.5), ("g", 5, None, 9.0)], "g string, i int, a double, b double")
    assert sorted(r.i for r in R.non_dominated(df, "a", "b", ["g"]).collect()) == [1, 2, 3]


def test_perfect_and_trivial_partitions(spark):
    df = spark.createDataFrame([("p", i % 3, (i + 1) % 3) for i in range(30)] + [("one", 0, 0) for _ in range(5)], "g string, a int, b int")
    got = {r.g: r for r in V.agreement(df, "a", "b", ["g"]).collect()}
    for g in got.values():
        assert np.isclose(g.ari, 1) and np.isclose(g.nmi, 1) and np.isclose(g.ami, 1) and np.isclose(g.v_measure, 1)


def test_recovery_needs_two_classes(spark):
    df = spark.createDataFrame([(0, 1), (0, 2), (1, -1)], "truth int, part int")
    row = V.recovery(df, "truth", "part", ["part"]).head()
    assert row.n_kept == 2 and row.ari is None


def test_log_gamma(spark):
    import math

    xs = [1.0, 1.5, 2.0, 7.0, 100.0, 1e6]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", V.log_gamma(F.col("x")).alias("g"))
    for r in df.collect():
        assert abs(r.g - math.lgamma(r.x)) <= 1e-9 * max(1.0, abs(r.g))
