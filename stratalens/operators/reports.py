"""Report tables: summaries with tests, table differences, acceptance rules, bound checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..session import hold
from . import paired as P
from .quantiles import medians, with_medians

# Which scores are better when larger, and the test level.
HIGHER_IS_BETTER = {"trustworthiness": True, "continuity": True, "mrre_false": True, "mrre_missing": True, "stress": False}
PRIMARY_METRICS = ("trustworthiness", "continuity")
STABILITY_UP = {"jaccard_admitted": True, "f1_sd": False}
ALPHA = 0.05
F1_FLOOR = 0.9
ADEQUACY = 0.7
TOLERANCE = 1e-12


def _up(metrics: dict[str, bool], column: str = "metric") -> Column:
    return F.col(column).isin([m for m, up in metrics.items() if up])


def stability_summary(records: DataFrame, strict: float = 1.0) -> DataFrame:
    """Relaxed thresholds against the strict one, per (arm, method, split, delta, metric, t).

    ``records`` holds (arm, method, split, delta, t, seed, sel_id, jaccard_admitted, f1_sd,
    f1, coverage). Holm's correction runs over the thresholds of one family.
    """
    family = ["arm", "method", "split", "delta"]
    records = hold(records)
    middle = hold(medians(records, [*family, "t"], {"median_f1": "f1", "median_coverage": "coverage"}))
    strict_f1 = middle.where(F.col("t") == strict).select(*family, F.col("median_f1").alias("strict_f1"))
    long = P.long_metrics(records, [*family, "t", "seed", "sel_id"], list(STABILITY_UP))
    values = long.groupBy(*family, "metric", "t", "seed", "sel_id").agg(F.avg("value").alias("value"))
    values = hold(values)
    base = values.where(F.col("t") == strict).select(*family, "metric", "seed", "sel_id", F.col("value").alias("strict_value"))
    relaxed = values.where(F.col("t") != strict)
    pairs = relaxed.join(base, [*family, "metric", "seed", "sel_id"]).dropna(subset=["value", "strict_value"])
    pairs = hold(pairs.withColumn("d", F.col("value") - F.col("strict_value")))
    by = [*family, "metric", "t"]
    tested = P.compare_pairs(pairs, by, _up(STABILITY_UP))
    units = pairs.groupBy(*by).agg(F.count_distinct("sel_id").alias("n_selections"), F.count_distinct("seed").alias("n_seeds"))
    own = medians(relaxed, by, {"median_value": "value"})
    strict_own = medians(base, [*family, "metric"], {"median_strict": "strict_value"})
    out = tested.join(units, by).join(own, by).join(strict_own, [*family, "metric"])
    out = out.join(middle, [*family, "t"]).join(strict_f1, family).withColumn("f1_ratio", ratio(F.col("median_f1"), F.col("strict_f1")))
    return P.holm(out, [*family, "metric"], order=[F.col("t").desc()]).drop("strict_f1")


def operating_points(summary: DataFrame) -> DataFrame:
    """Largest relaxed threshold that gains stability significantly and keeps F1, per family."""
    family = ["arm", "method", "split", "delta"]
    rows = summary.where(F.col("metric") == "jaccard_admitted")
    good = (F.col("median_delta") > 0) & (F.col("p_holm") < ALPHA) & (F.col("f1_ratio") >= F1_FLOOR)
    return rows.groupBy(*family).agg(
        F.max(F.when(good, F.col("t"))).alias("t_star"),
        F.coalesce(F.bool_or(good), F.lit(False)).alias("supported"),
        F.max("n_pairs").alias("n_pairs"), F.max("n_selections").alias("n_selections"), F.max("n_seeds").alias("n_seeds"),
    )


def split_summary(records: DataFrame, delta: float, strict: float = 1.0) -> DataFrame:
    """Severity against symmetric tails at the same threshold, on F1, at one perturbation size."""
    chosen = records.where((F.col("delta") == delta) & (F.col("t") != strict))
    by = ["arm", "method", "t"]
    pairs = P.paired_differences(chosen, ["seed", "sel_id"], "split", "severity", "symmetric", "f1", by)
    return P.compare_pairs(pairs, by).withColumnRenamed("median_delta", "median_diff")


def split_invariance(records: DataFrame, columns: Sequence[str], strict: float = 1.0, tolerance: float = 1e-8) -> DataFrame:
    """Largest difference between the tail splits at the strict threshold; raises if there is one."""
    unit = ["arm", "seed", "sel_id", "method", "delta"]
    long = P.long_metrics(records.where(F.col("t") == strict), [*unit, "split"], columns)
    pairs = P.paired_differences(long, unit, "split", "severity", "symmetric", "value", ["metric"])
    out = pairs.groupBy("metric").agg(F.max(F.abs("d")).alias("max_difference"), F.count("*").alias("n_pairs"))
    broken = [r["metric"] for r in out.where(F.col("max_difference") > tolerance).collect()]
    if broken:
        raise ValueError(f"tail splits differ at t={strict}: {', '.join(broken)}")
    return out


def matched_leaf_summary(matches: DataFrame) -> DataFrame:
    """Agreement of strongly matched leaves per (method, t), the weak share beside it."""
    weak = matches.groupBy("method").agg(F.avg(F.col("weak_match").cast("double")).alias("weak_match_frac"))
    kept = matches.where(~F.col("weak_match"))
    strong = kept.groupBy("method", "t").agg(
        F.count("*").alias("n_matched_pairs"), F.avg("jaccard_admitted").alias("mean_jaccard_admitted"), F.avg("match_jaccard").alias("mean_match_jaccard"),
    )
    strong = with_medians(strong, kept, ["method", "t"], {"median_jaccard_admitted": "jaccard_admitted"})
    return strong.join(weak, "method")


def own_versus_global(regions: DataFrame, first: str = "hier", second: str = "flat") -> DataFrame:
    """Per (dataset, method, region_def, metric): own projection against the sliced global one."""
    by = ["dataset", "method", "region_def", "metric"]
    long = P.long_metrics(regions, ["dataset", "method", "region_def", "seed", "region", "cond"], list(HIGHER_IS_BETTER))
    pairs = P.paired_differences(long, ["seed", "region"], "cond", first, second, "value", by)
    return P.compare_pairs(pairs, by, _up(HIGHER_IS_BETTER)).withColumn("primary", F.col("metric").isin(*PRIMARY_METRICS))


def planted_summary(records: DataFrame) -> DataFrame:
    """Tree against flat clustering per (rho, nesting); every number from the same paired rows."""
    by = ["rho", "nesting"]
    side = lambda c: F.avg(F.when(F.col("condition") == c, F.col("within_g_ari")))
    wide = records.groupBy(*by, "seed").agg(
        side("hierarchical").alias("tree"), side("flat_full").alias("flat"), side("oracle_conditional").alias("oracle")
    )
    pairs = wide.dropna(subset=["tree", "flat"]).withColumn("d", F.col("tree") - F.col("flat"))
    means = pairs.groupBy(*by).agg(
        F.count("oracle").alias("n_oracle"), F.avg("tree").alias("hier_mean"), F.avg("flat").alias("flat_mean"), F.avg("oracle").alias("oracle_mean")
    )
    seeds = wide.groupBy(*by).agg(F.count("*").alias("n_seeds"))
    out = P.compare_pairs(pairs, by).join(means, by).join(seeds, by)
    return out.withColumn("oracle_relative", ratio(F.col("hier_mean"), F.col("oracle_mean"))).drop("oracle_mean")


def drop_repeated_control(records: DataFrame, control: Column, level: str) -> tuple[DataFrame, DataFrame]:
    """(records with the control at its smallest level only, (n_dropped) of the rest)."""
    least = records.agg(F.min(F.when(control, F.col(level))).alias("m")).head()["m"]
    repeated = F.coalesce(control & (F.col(level) != F.lit(least)), F.lit(False))
    return records.where(~repeated), records.agg(F.count_if(repeated).alias("n_dropped"))


def crossover(records: DataFrame, level: str, value: str, floor: float = ADEQUACY, by: Sequence[str] = ()) -> DataFrame:
    """Smallest level whose mean falls under the floor."""
    means = records.groupBy(*by, level).agg(F.avg(value).alias("m"))
    return means.groupBy(*by).agg(F.min(F.when(F.col("m") < floor, F.col(level))).alias("crossover"))


def gap_table(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    means = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    return with_medians(means, df, by, {"median": value}).select(*by, "mean", "median", "count")


def table_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = TOLERANCE) -> DataFrame:
    """(keys..., column, kind, old, new): dropped rows, added rows and changed cells.

    Two nulls are equal; numbers differ beyond ``tolerance``, other values when unequal.
    """
    kinds = dict(old.dtypes)
    shared = [c for c in values if c in old.columns and c in new.columns]
    a = old.select(*keys, F.lit(True).alias("__a"), *[F.col(c).alias(f"__o_{c}") for c in shared])
    b = new.select(*keys, F.lit(True).alias("__b"), *[F.col(c).alias(f"__n_{c}") for c in shared])
    both = a.join(b, list(keys), "full_outer")
    cells = [
        F.when(F.col("__b").isNull(), F.struct(F.lit("(whole row)").alias("column"), F.lit("dropped").alias("kind"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))),
        F.when(F.col("__a").isNull(), F.struct(F.lit("(whole row)").alias("column"), F.lit("added").alias("kind"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))),
    ]
    for c in shared:
        o, n = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        numeric = kinds[c] not in ("string", "boolean", "date", "timestamp")
        moved = F.abs(o - n) > tolerance if numeric else o != n
        differs = F.coalesce(moved, ~o.eqNullSafe(n)) & F.col("__a").isNotNull() & F.col("__b").isNotNull()
        cells.append(F.when(differs, F.struct(F.lit(c).alias("column"), F.lit("changed").alias("kind"), o.cast("string").alias("old"), n.cast("string").alias("new"))))
    return both.select(*keys, F.inline(F.array_compact(F.array(*cells))))


def verdict_flips(old: DataFrame, new: DataFrame, keys: Sequence[str], p: str = "wilcoxon_p", alpha: float = ALPHA) -> DataFrame:
    """Rows whose p-value crosses the level; a missing p is not significant."""
    a = old.select(*keys, F.col(p).alias("p_old"))
    b = new.select(*keys, F.col(p).alias("p_new"))
    significant = lambda c: F.coalesce(F.col(c) < alpha, F.lit(False))
    return a.join(b, list(keys)).where(significant("p_old") != significant("p_new"))


def attach_counting_misses(left: DataFrame, right: DataFrame, keys: Sequence[str], marker: str) -> tuple[DataFrame, DataFrame]:
    """(left join, (n_rows, n_unmatched)): rows without a partner stay and are counted."""
    joined = left.join(right.withColumn("__hit", F.lit(True)), list(keys), "left")
    counts = joined.agg(F.count("*").alias("n_rows"), F.count_if(F.col("__hit").isNull()).alias("n_unmatched"))
    return joined.withColumn(marker, F.col("__hit").isNotNull()).drop("__hit"), counts


def running_best(trials: DataFrame, value: str, by: Sequence[str], order: str, maximize: bool = True) -> DataFrame:
    sofar = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(value) if maximize else F.min(value)
    return trials.withColumn("best_so_far", best.over(sofar))


def gains(df: DataFrame, baseline: str = "baseline", best: str = "best") -> DataFrame:
    gain = F.col(best) - F.col(baseline)
    scale = F.when(F.col(baseline) != 0, F.abs(baseline)).otherwise(1.0)
    return df.withColumns({"gain": gain, "gain_pct": F.lit(100.0) * gain / scale})


def finite_or_worst(value: str, worst: float) -> Column:
    v = F.col(value).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(worst)).otherwise(v)


def degenerate(max_noise: float = 0.5, min_coverage: float = 0.8) -> Column:
    """A run that cannot compete: too few leaves, a missing score, too much noise, too little scored."""
    return (
        (F.coalesce("n_leaves", F.lit(0)) < 2)
        | F.col("dbcv_leaf").isNull()
        | F.col("tnc_mean").isNull()
        | (F.coalesce("noise_frac", F.lit(1.0)) >= max_noise)
        | (F.coalesce("scored_coverage", F.lit(0.0)) < min_coverage)
    )


def non_dominated(rows: DataFrame, first: str, second: str, by: Sequence[str]) -> DataFrame:
    """Rows no other row beats on both objectives (both maximised).

    Equal points are kept together. One pass in order of the first objective with the best
    second objective seen so far; no row is compared with every other.
    """
    points = rows.select(*by, first, second).dropna().distinct()
    tops = points.groupBy(*by, first).agg(F.max(second).alias("__top"))
    seen = Window.partitionBy(*by).orderBy(F.col(first).desc()).rowsBetween(Window.unboundedPreceding, -1)
    front = tops.withColumn("__seen", F.max("__top").over(seen))
    front = front.where(F.col("__seen").isNull() | (F.col("__top") > F.col("__seen")))
    return rows.join(front.select(*by, first, F.col("__top").alias(second)), [*by, first, second], "left_semi")


def pick_candidate(front: DataFrame, by: Sequence[str], floor: DataFrame, margin: float = 0.01) -> DataFrame:
    """From the front, rows reaching the floor (by..., floor) less ``margin``; best score, then fastest, then shallowest."""
    order = Window.partitionBy(*by).orderBy(F.col("dbcv_leaf").desc(), "build_seconds", "hierarchical_layers", "trial")
    eligible = front.join(floor, list(by)).where(F.col("tnc_mean") >= F.col("floor") - margin)
    return eligible.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn", "floor")


def acceptance(runs: DataFrame, by: Sequence[str], n_validation: int, time_limit: float = 180.0, min_leaf: int = 21) -> DataFrame:
    """Six rules on baseline test builds against candidate builds, one row per group.

    ``runs`` holds (by..., arm in baseline/preset, split, dbcv_leaf, tnc_mean, build_seconds,
    noise_frac, ari, median_leaf_size, exception).
    """
    base = (F.col("arm") == "baseline") & (F.col("split") == "test")
    cand = F.col("arm") == "preset"
    on = lambda side, c: F.when(side, F.col(c))
    wide = runs.groupBy(*by).agg(
        F.max(on(base, "dbcv_leaf")).alias("b_dbcv_max"), F.min(on(cand, "dbcv_leaf")).alias("p_dbcv_min"),
        F.avg(on(base, "tnc_mean")).alias("b_tnc"), F.avg(on(cand, "tnc_mean")).alias("p_tnc"),
        F.avg(on(base, "noise_frac")).alias("b_noise"), F.avg(on(cand, "noise_frac")).alias("p_noise"),
        F.avg(on(base, "ari")).alias("b_ari"), F.avg(on(cand, "ari")).alias("p_ari"),
        F.count_if(cand & F.col("exception").isNull()).alias("n_ok"), F.count_if(cand).alias("n_cand"),
        F.min(F.when(cand, F.coalesce("median_leaf_size", F.lit(0.0)))).alias("p_leaf_min"),
    )
    wide = with_medians(wide, runs, by, {"b_sec": on(base, "build_seconds"), "p_sec": on(cand, "build_seconds")})
    no = F.lit(False)
    rules = {
        "a1_separation": F.coalesce(F.col("p_dbcv_min") > F.col("b_dbcv_max"), no),
        "a2_view": F.coalesce(F.col("p_tnc") >= F.col("b_tnc") - 0.01, no),
        "a3_interactive": F.coalesce(F.col("p_sec") <= F.least(F.lit(time_limit), 3.0 * F.col("b_sec")), no),
        "a4_reliable": F.col("n_ok") == n_validation,
        "a5_granularity": F.coalesce((F.col("n_cand") > 0) & (F.col("p_leaf_min") >= min_leaf) & (F.col("p_noise") <= F.col("b_noise") + 0.05), no),
        "a6_labels": F.coalesce(F.col("p_ari") >= F.col("b_ari") - 0.05, F.lit(True)),
    }
    judged = wide.withColumns(rules)
    adopted = F.lit(True)
    for r in rules:
        adopted = adopted & F.col(r)
    return judged.select(*by, adopted.alias("adopted"), *rules)


def acceptance_numbers(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """The numbers behind ``acceptance``, per side: means, extremes, medians, leaf counts and unprojected nodes.

    ``runs`` holds n_leaves and unembedded_nodes besides the columns of ``acceptance``.
    """
    sides = {"baseline": (F.col("arm") == "baseline") & (F.col("split") == "test"), "preset": F.col("arm") == "preset"}
    means = {"dbcv": "dbcv_leaf", "tnc": "tnc_mean", "ari": "ari", "noise": "noise_frac"}
    out, middle = [], {}
    for side, chosen in sides.items():
        on = lambda c: F.when(chosen, F.col(c))  # noqa: E731, B023
        out += [F.avg(on(c)).alias(f"{side}_{name}_mean") for name, c in means.items()]
        out.append((F.max if side == "baseline" else F.min)(on("dbcv_leaf")).alias(f"{side}_dbcv_{'max' if side == 'baseline' else 'min'}"))
        out.append(F.array_sort(F.collect_list(on("n_leaves"))).alias(f"{side}_leaves"))
        out.append(F.coalesce(F.sum(on("unembedded_nodes")), F.lit(0)).cast("bigint").alias(f"{side}_unembedded_nodes"))
        middle[f"{side}_seconds_median"] = on("build_seconds")
    return with_medians(runs.groupBy(*by).agg(*out), runs, by, middle)


def median_check(values: DataFrame, bounds: DataFrame, by: Sequence[str], stage: Sequence[str] = ()) -> DataFrame:
    """(by..., n, median, median_of_stage_medians, verdict) against a table (by..., lo, ceiling).

    A group passes when the median of its values reaches ``lo`` and stays under ``ceiling``
    where there is one. The median of the medians per ``stage`` stands beside it for reading.
    """
    rows = values.join(bounds, list(by))
    ends = rows.groupBy(*by).agg(F.count("value").alias("n"), F.max("lo").alias("lo"), F.max("ceiling").alias("ceiling"))
    found = with_medians(ends, rows, by, {"median": "value"})
    found = with_medians(found, medians(rows, [*by, *stage], {"m": "value"}), by, {"median_of_stage_medians": "m"})
    good = (F.col("median") >= F.col("lo")) & (F.col("ceiling").isNull() | (F.col("median") < F.col("ceiling")))
    return found.select(*by, "n", "median", "median_of_stage_medians", F.when(good, "pass").otherwise("fail").alias("verdict"))


def median_pair_check(values: DataFrame, by: Sequence[str], level: str, strict, relaxed, rules: DataFrame) -> DataFrame:
    """(by..., n_strict, n_relaxed, strict_median, relaxed_median, verdict) of two levels of a setting.

    ``rules`` holds (by..., dims, strict_lo, strict_hi, relaxed_lo, relaxed_hi). Where bands are
    given both medians must lie in theirs; else the relaxed median must be below the strict
    one and that below half of ``dims``.
    """
    on = lambda v: F.when(F.col(level) == v, F.col("value"))
    counts = values.groupBy(*by).agg(F.count(on(strict)).alias("n_strict"), F.count(on(relaxed)).alias("n_relaxed"))
    found = with_medians(counts, values, by, {"strict_median": on(strict), "relaxed_median": on(relaxed)}).join(rules, list(by))
    s, r = F.col("strict_median"), F.col("relaxed_median")
    banded = s.between(F.col("strict_lo"), F.col("strict_hi")) & r.between(F.col("relaxed_lo"), F.col("relaxed_hi"))
    good = F.when(F.col("strict_lo").isNotNull(), banded).otherwise((r < s) & (s < F.col("dims") / 2))
    return found.select(*by, "n_strict", "n_relaxed", "strict_median", "relaxed_median", F.when(F.coalesce(good, F.lit(False)), "pass").otherwise("fail").alias("verdict"))


def bound_check(statistics: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Grouped values against a bound table (by..., lo, hi, band_lo, band_hi): pass, excursion or fail.

    A group passes when all its values lie within the bounds, and counts as an excursion
    when all lie within the wider band.
    """
    v = F.col("value")
    within = lambda lo, hi: F.bool_and((v >= F.coalesce(lo, F.lit(float("-inf")))) & (v <= F.coalesce(hi, F.lit(float("inf")))))
    rows = statistics.join(bounds, list(by))
    judged = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        within(F.col("lo"), F.col("hi")).alias("inside"), within(F.col("band_lo"), F.col("band_hi")).alias("in_band"),
    )
    verdict = F.when(F.col("inside"), "pass").when(F.col("in_band"), "excursion").otherwise("fail")
    judged = with_medians(judged.withColumn("verdict", verdict), rows, by, {"median": "value"})
    return judged.select(*by, "n", "median", "verdict")


def pooled_check(pairs: DataFrame, band: float = 0.05, wins: tuple[float, float] = (0.5, 0.8)) -> DataFrame:
    """Pooled paired check: small positive median, win rate in range, p-value, verdict."""
    one = pairs.withColumn("__all", F.lit(1))
    out = P.compare_pairs(one, ["__all"]).drop("__all", "rank_biserial")
    good = (F.col("median_delta") > 0) & (F.col("median_delta") <= band) & F.col("win_rate").between(*wins)
    return out.withColumn("verdict", F.when(good, "pass").otherwise("fail"))


def example_leaf(shapes: DataFrame, leaves: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., build, leaf_id, leaf_n): the leaf of median size in the build of median leaf count.

    Without a build of exactly the median count the nearest one is taken; ties go to the
    earlier build. Of an even number of leaves the larger middle one, equal sizes by leaf id.
    """
    mid = medians(shapes, by, {"mid": "n_leaves"}).withColumn("mid", F.floor("mid"))
    near = Window.partitionBy(*by).orderBy(F.abs(F.col("n_leaves") - F.col("mid")), "build")
    build = shapes.join(mid, list(by)).withColumn("rn", F.row_number().over(near)).where("rn = 1").select(*by, "build")
    sizes = leaves.select(*by, "build", "leaf_id", "leaf_n").distinct().join(build, [*by, "build"])
    order = Window.partitionBy(*by).orderBy("leaf_n", "leaf_id")
    ranked = sizes.withColumns({"rn": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(*by))})
    return ranked.where(F.col("rn") == F.floor(F.col("n") / 2)).drop("rn", "n")


def skip_table(regions: DataFrame, scored: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Every region without a score, with its reason."""
    missing = regions.join(scored.select(*keys).distinct(), list(keys), "left_anti")
    reason = F.when(F.col("n") < min_rows, "too_small").otherwise("not_scored")
    return missing.select(*keys, "n", reason.alias("reason"))


def unequal_k(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(n_regions, n_violations): regions whose arms were scored with different neighbourhood sizes."""
    per = scored.groupBy(*keys).agg(F.count_distinct("k").alias("n_k"))
    return per.agg(F.count("*").alias("n_regions"), F.count_if(F.col("n_k") > 1).alias("n_violations"))


def mean_by(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"))


def best_configurations(results: DataFrame, value: str, by: Sequence[str], worst: float, tie: str) -> DataFrame:
    """Best row per group, non-finite values last, ties by ``tie``."""
    order = Window.partitionBy(*by).orderBy(finite_or_worst(value, worst).desc(), tie)
    return results.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def pooled_report(records: DataFrame, by: Sequence[str], band: float = 0.05, wins: tuple[float, float] = (0.5, 0.8)) -> tuple[DataFrame, DataFrame]:
    """(pooled row, rows per group) of records (by..., eligible, d, second).

    The pooled row is that of ``pooled_check`` with the median of ``second`` and the number of
    eligible records without ``d``, which are left out of it.
    """
    chosen = records.where("eligible").withColumn("__all", F.lit(1))
    scored = chosen.where(F.col("d").isNotNull())
    unscored = chosen.agg(F.count_if(F.col("d").isNull()).alias("n_unscored"))
    other = medians(scored, ["__all"], {"median_second": "second"}).drop("__all")
    # One row each.
    pooled = pooled_check(scored.drop("__all"), band, wins).join(other).join(unscored)
    counts = scored.groupBy(*by).agg(F.avg((F.col("d") > 0).cast("double")).alias("win_rate"), F.count("*").alias("n"))
    return pooled, with_medians(counts, scored, by, {"median": "d"}).select(*by, "median", "win_rate", "n")
