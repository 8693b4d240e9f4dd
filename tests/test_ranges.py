"""Quantiles and range explanations against numpy, including the paths for large groups."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratalens.operators import characteristics
from stratalens.operators import predicates as P
from stratalens.operators.quantiles import exact_quantiles, extents
from stratalens.operators.scaling import Scaler, fit_scaler


def table(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    a = np.round(rng.gamma(2.0, 3.0, n), 2)
    b = rng.integers(0, 5, n).astype(float)
    c = np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 50, n))  # one value holds two fifths of the rows
    sel = np.where(a > 8, "high", np.where(b > 3, "late", None))
    rows = [(float(a[i]), float(b[i]), float(c[i]), sel[i]) for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, sel string"), np.c_[a, b, c], sel


@pytest.mark.parametrize("limit", [10, 10_000])
def test_quantiles_match_numpy(spark, limit):
    df, x, _ = table(spark)
    df = df.withColumn("g", F.lit("all"))
    ext = extents(df, ["g"], ["a", "b", "c"])
    probs = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    targets = ext.select("*", F.explode(F.array(*[F.lit(p) for p in probs])).alias("p")).withColumn("target", F.col("p").cast("string"))
    got = {(r.feature, float(r.target)): r.value for r in exact_quantiles(df, ["g"], ["a", "b", "c"], targets, limit).collect()}
    for j, f in enumerate("abc"):
        for p in probs:
            assert np.isclose(got[f, p], np.quantile(x[:, j], p)), (f, p)


def f1(mask, y):
    tp = (mask & y).sum()
    p = tp / mask.sum() if mask.sum() else 0.0
    r = tp / y.sum() if y.sum() else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0


def brute(x, y, t, split):
    sel = x[y]
    lo, hi = [], []
    for j in range(x.shape[1]):
        v, med = sel[:, j], np.median(sel[:, j])
        left, right = med - v.min(), v.max() - med
        ls = 0.5 if split == "symmetric" or left + right <= 0 else left / (left + right)
        lo.append(np.quantile(v, (1 - t) * ls))
        hi.append(np.quantile(v, 1 - (1 - t) * (1 - ls)))
    masks = [(x[:, j] >= lo[j] - 1e-12) & (x[:, j] <= hi[j] + 1e-12) for j in range(x.shape[1])]
    current, best, path = np.ones(len(x), bool), f1(np.ones(len(x), bool), y), []
    while True:
        options = [(f1(current & masks[j], y), -j) for j in range(len(masks)) if j not in path]
        if not options or max(options)[0] <= best + 1e-6:
            return lo, hi, path, best
        best, j = max(options)
        path.append(-j)
        current &= masks[-j]


@pytest.mark.parametrize("limit", [15, 10_000])
@pytest.mark.parametrize("t,split", [(1.0, "severity"), (0.9, "severity"), (0.8, "symmetric")])
def test_greedy_conjunction(spark, limit, t, split):
    df, x, sel = table(spark, seed=3)
    rows = P.generate("db", df, ["a", "b", "c"], [(t, split)], limit=limit).collect()
    for name in ("high", "late"):
        lo, hi, path, best = brute(x, sel == name, t, split)
        got = {r.feature: r for r in rows if r.sel == name}
        assert np.allclose([got[f].sel_min for f in "abc"], lo) and np.allclose([got[f].sel_max for f in "abc"], hi)
        steps = sorted((r.predicate_step, "abc".index(r.feature)) for r in got.values() if r.in_predicate)
        assert [j for _, j in steps] == path
        assert np.isclose(got["a"].predicate_f1, best)


def test_overlapping_selections_agree_with_single_ones(spark):
    df, _, _ = table(spark, seed=5)
    both = df.withColumn("sel", F.array_compact(F.array(F.when(F.col("a") > 6, "x"), F.when(F.col("b") > 2, "y"))))
    many = {(r.sel, r.feature): r for r in P.generate("db", both, ["a", "b", "c"], [(0.9, "severity")]).collect()}
    for name, test in (("x", F.col("a") > 6), ("y", F.col("b") > 2)):
        for r in P.generate("db", df.withColumn("sel", F.when(test, name)), ["a", "b", "c"], [(0.9, "severity")]).collect():
            assert many[name, r.feature].asDict() == r.asDict()


def test_many_columns_use_several_words(spark):
    rng = np.random.default_rng(1)
    n, d = 60, 70
    x = rng.normal(size=(n, d))
    y = x[:, 65] > 0.5
    names = [f"f{j}" for j in range(d)]
    df = spark.createDataFrame([(*map(float, x[i]), "s" if y[i] else None) for i in range(n)], ", ".join(f"{c} double" for c in names) + ", sel string")
    rows = P.generate("db", df, names, [(1.0, "severity")]).collect()
    _, _, path, best = brute(x, y, 1.0, "severity")
    steps = sorted((r.predicate_step, int(r.feature[1:])) for r in rows if r.in_predicate)
    assert [j for _, j in steps] == path and np.isclose(rows[0].predicate_f1, best)


def test_admitted_rows_and_empty_predicate(spark):
    df, x, sel = table(spark, seed=2)
    preds = spark.createDataFrame(
        [("p", "a", 2.0, 9.0, True), ("p", "b", 0.0, 2.0, True), ("q", "a", 0.0, 0.0, False)],
        "sel string, feature string, sel_min double, sel_max double, active boolean",
    )
    rows = df.withColumn("member", F.col("sel")).drop("sel")
    got = {r.sel: r["count"] for r in P.admitted(rows, ["a", "b", "c"], preds, ["sel"], ["member"]).groupBy("sel").count().collect()}
    assert got["p"] == ((x[:, 0] >= 2) & (x[:, 0] <= 9) & (x[:, 1] <= 2)).sum()
    assert got["q"] == len(x)


def test_thresholds_and_methods_are_checked(spark):
    df, _, _ = table(spark)
    with pytest.raises(ValueError):
        P.marginal_ranges(df, ["a"], [(0.0, "severity")])
    with pytest.raises(ValueError):
        P.marginal_ranges(df, ["a"], [(0.9, "lopsided")])
    with pytest.raises(ValueError):
        P.generate("other", df, ["a"], [(0.9, "severity")])


def test_scaler_uses_population_spread_and_keeps_constants(spark):
    df, x, _ = table(spark)
    df = df.withColumn("flat", F.lit(0.1))
    got = {r.feature: r for r in fit_scaler(df, ["a", "flat"]).collect()}
    assert np.isclose(got["a"]["std"], x[:, 0].std()) and got["flat"]["std"] == 1.0
    assert Scaler.fit(df, ["a"], normalize=False).std["a"] == 1.0


def test_centroids_of_wide_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2000))
    rows = [(None if i % 3 == 2 else f"g{i % 3}", i % 2, x[i].tolist()) for i in range(90)]
    rows[0][2][5] = None
    rows += [("g0", 0, None), ("empty", 7, None)]
    df = spark.createDataFrame(rows, "name string, part int, v array<double>").repartition(5)
    got = {(r.name, r.part): r.centroid for r in characteristics.centroids(df, "v", 2000, ["name", "part"]).collect()}
    assert len(got) == 7 and got["empty", 7] == [None] * 2000
    for g in range(3):
        for part in range(2):
            at = [i for i in range(90) if i % 3 == g and i % 2 == part]
            want = x[at].mean(axis=0)
            if (g, part) == (0, 0):
                want[5] = x[at[1:], 5].mean()
            assert np.allclose(got[None if g == 2 else f"g{g}", part], want)
    assert characteristics.centroids(df.limit(0), "v", 2000, ["name"]).collect() == []


def test_partial_sums_are_handed_on_before_they_grow(monkeypatch):
    monkeypatch.setattr(characteristics, "HELD_SUMS", 8)
    names = pa.array([f"k{i % 7}" for i in range(70)])
    batch = pa.RecordBatch.from_arrays([names, pa.array([[float(i), 1.0] for i in range(70)])], names=["key", "v"])
    sums, sizes = {}, []
    for out in characteristics._partial_sums(iter([batch.slice(i, 10) for i in range(0, 70, 10)])):
        sizes.append(out.num_rows)
        for key, total, count in zip(*(c.to_pylist() for c in out.columns), strict=True):
            old = sums.get(key, (0.0, 0))
            sums[key] = (old[0] + total[0], old[1] + count[0])
    assert max(sizes) <= 7 and len(sizes) > 1
    assert sums == {f"k{k}": (sum(range(k, 70, 7)), 10) for k in range(7)}


def test_a_sweep_makes_its_rows_once(spark):
    """Rows that cost something to make are made once, however many passes read them."""
    from stratalens.operators.stability import stability_sweep

    made = spark.sparkContext.accumulator(0)

    def costly(x):
        made.add(1)
        return float(x % 17)

    rows = spark.range(60).select(F.col("id").alias("row_id"), F.when(F.col("id") < 30, "a").otherwise("b").alias("sel"), F.udf(costly, "double")("id").alias("f"))
    drawn = spark.range(60).where("id < 25").select(F.lit("a").alias("sel"), F.lit(0.1).alias("delta"), F.explode(F.array(F.lit(0), F.lit(1))).alias("rep"), F.col("id").alias("row_id"))
    got = stability_sweep(rows, ["f"], drawn, [(1.0, "severity")], ("threshold",)).collect()
    assert [(r.sel, r.method, r.jaccard_admitted) for r in got] == [("a", "threshold", 1.0)]
    assert made.value == 60
