"""How far range explanations move when the selection or the tree behind them moves a little."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import f1_columns, finite
from ..session import hold
from .predicate_table import HI, LO, PRED, beside, id_column, named, numbered, packed, within
from .predicates import check_conditions, generate
from .quantiles import GROUP_LIMIT, order_statistics

# Tests of one group written out as plain columns; beyond, arrays and a generic test.
SHORT_TESTS = 120

# Fixed sizes: smallest selection, and neighbours behind the boundary pool.
MIN_SELECTION = 20
POOL_K = 10


def size_gate(sizes: DataFrame, total: int, min_members: int = MIN_SELECTION, min_outside: int = POOL_K) -> DataFrame:
    """(sel, n_selected, eligible): enough members, and enough rows outside for a pool."""
    ok = (F.col("n_selected") >= min_members) & (F.lit(total) - F.col("n_selected") >= min_outside)
    return sizes.withColumn("eligible", ok)


def _draw(seed: int, *columns: str) -> Column:
    """A seeded number in [0, 1) per row and replicate, independent of partitioning.

    52 bits of an md5 digest of "seed|column|...", which other engines compute as well.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _lowest(rows: DataFrame, keys: Sequence[str], take: Column, limit: int) -> DataFrame:
    """Rows whose draw ``u`` is among the ``take`` lowest of their group, found by exact cut values."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi"))
    ranks = sizes.withColumns({"feature": F.lit("u"), "rank": F.least(take, F.col("n")) - 1}).where(F.col("rank") >= 0)
    cut = order_statistics(rows, keys, ["u"], ranks.select(*keys, "feature", "rank", "n", "lo", "hi"), limit)
    return rows.join(cut.select(*keys, F.col("value").alias("cut")), list(keys)).where(F.col("u") <= F.col("cut")).drop("cut")


def perturbed_selections(
    selection: DataFrame, pool: DataFrame, deltas: Sequence[float], replicates: int, seed: int = 42, limit: int = GROUP_LIMIT
) -> DataFrame:
    """(sel, delta, rep, row_id): members with a few exchanged for rows of the boundary pool.

    ``max(1, round(delta * n))`` members leave and as many pool rows enter (all of a smaller
    pool). Draws depend on the seed, the replicate and the row only, so every condition
    sees the same replicates.
    """
    cases = F.array(*[F.struct(F.lit(float(d)).alias("delta"), F.lit(r).alias("rep")) for d in deltas for r in range(replicates)])
    keys = ["sel", "delta", "rep"]
    sizes = hold(selection.groupBy("sel").agg(F.count("*").alias("n_sel")))
    swaps = F.greatest(F.lit(1), F.bround(F.col("delta") * F.col("n_sel"))).cast("bigint")

    def cast(rows: DataFrame, salt: int) -> DataFrame:
        return rows.join(sizes, "sel").select("sel", "row_id", "n_sel", F.inline(cases)).withColumns(
            {"u": _draw(seed + salt, "sel", "delta", "rep", "row_id"), "swaps": swaps}
        )

    members = cast(selection, 0)
    leaving = _lowest(members, [*keys, "swaps"], F.col("swaps"), limit).select(*keys, "row_id")
    entering = _lowest(cast(pool, 1), [*keys, "swaps"], F.col("swaps"), limit).select(*keys, "row_id")
    staying = members.select(*keys, "row_id").join(leaving, [*keys, "row_id"], "left_anti")
    return staying.unionByName(entering)


def with_selections(background: DataFrame, selections: DataFrame, name: Column, id_column: str = "row_id") -> DataFrame:
    """Background rows with ``sel`` as the array of (named) selections they belong to."""
    lists = selections.select(id_column, name.alias("__sel")).groupBy(id_column).agg(F.collect_list("__sel").alias("sel"))
    return background.drop("sel").join(lists, id_column, "left")


def admission_patterns(
    background: DataFrame, features: Sequence[str], predicates: DataFrame, group: Sequence[str], rep: str, member: str | None = None
) -> DataFrame:
    """(group..., selected, pattern, n): rows counted by which predicates of a group admit them.

    ``predicates`` holds (group..., rep, feature, sel_min, sel_max, active); a group's
    predicates become one boolean array per row, so agreement between all of them follows
    from a small table of counted patterns, without joining rows to rows. With ``member`` a
    row is selected when that column equals the group's first id.
    """
    reps = packed(predicates, features, [*group, rep], F.col("active"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(rep).alias("rep"), LO, HI)))
    joint = reps.groupBy(*group).agg(listed.alias("__reps"))
    flat = lambda side: F.flatten(F.transform("__reps", lambda x: x[side]))
    table = numbered(joint.select(*group, F.size("__reps").alias("__m"), flat(LO).alias(LO), flat(HI).alias(HI)), group)
    width = len(features)
    per = table.agg(F.max("__m")).head()[0] or 1
    short = per * width <= SHORT_TESTS
    numbers = [finite(f).alias(f"x{j}") for j, f in enumerate(features)] if short else [F.array(*[finite(f) for f in features]).alias("x")]
    rows = background.select(*numbers, *([F.col(member).alias("member")] if member else []))
    both = beside(rows, table, per * width)
    chosen = F.coalesce(F.col("member") == F.col(id_column(group[0])), F.lit(False)) if member else F.lit(False)
    if short:
        bits = " + ".join(f"if({_all_within(k, width)}, {1 << k}L, 0L)" for k in range(per))
        counted = both.select(PRED, "__m", chosen.alias("selected"), F.expr(f"{bits} as code")).groupBy(PRED, "__m", "selected", "code").agg(F.count("*").alias("n"))
        pattern = F.expr("transform(sequence(0, __m - 1), k -> (shiftright(code, k) & 1L) = 1L)")
        counted = counted.select(PRED, "selected", pattern.alias("pattern"), "n")
    else:
        cell = f"k * {width} + j"
        test = f"forall(sequence(0, {width - 1}), j -> get({LO}, {cell}) is null or coalesce(x[j] between get({LO}, {cell}) and get({HI}, {cell}), false))"
        pattern = F.expr(f"transform(sequence(0, __m - 1), k -> {test})")
        counted = both.select(PRED, chosen.alias("selected"), pattern.alias("pattern")).groupBy(PRED, "selected", "pattern").agg(F.count("*").alias("n"))
    return named(counted, table, group, "selected", "pattern", "n")


def _all_within(k: int, width: int) -> str:
    return " and ".join(f"coalesce({within(f'x{j}', k * width + j)}, get({LO}, {k * width + j}) is null)" for j in range(width))


def _pair_counts(patterns: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., i, j, both, any): admitted rows in common and altogether, i < j."""
    pairs = F.expr("flatten(transform(sequence(0, size(pattern) - 1), i -> transform(sequence(0, size(pattern) - 1), j -> named_struct('i', i, 'j', j, 'p', pattern[i], 'q', pattern[j]))))")
    cells = patterns.select(*group, "n", F.inline(pairs)).where("i < j")
    return cells.groupBy(*group, "i", "j").agg(
        F.sum(F.when(F.col("p") & F.col("q"), F.col("n")).otherwise(0)).alias("both"),
        F.sum(F.when(F.col("p") | F.col("q"), F.col("n")).otherwise(0)).alias("any"),
    )


def mean_admitted_jaccard(patterns: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean overlap of admitted sets over all pairs; two empty sets are the same set."""
    overlap = F.when(F.col("any") > 0, F.col("both") / F.col("any")).otherwise(1.0)
    return _pair_counts(patterns, group).groupBy(*group).agg(F.avg(overlap).alias("jaccard_admitted"))


def f1_by_replicate(patterns: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group..., rep_ix, f1) of every predicate against the group's base selection."""
    cells = patterns.select(*group, "selected", "n", F.posexplode("pattern").alias("rep_ix", "ok"))
    sums = cells.groupBy(*group, "rep_ix").agg(
        F.sum(F.when(F.col("ok") & F.col("selected"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("predicted"),
        F.sum(F.when(F.col("selected"), F.col("n")).otherwise(0)).alias("actual"),
    )
    f1, _, _ = f1_columns(F.col("tp"), F.col("predicted"), F.col("actual"))
    return sums.select(*group, "rep_ix", f1.alias("f1"))


def f1_spread(patterns: DataFrame, group: Sequence[str]) -> DataFrame:
    return f1_by_replicate(patterns, group).groupBy(*group).agg(F.stddev_samp("f1").alias("f1_sd"))


def clause_jaccard(predicates: DataFrame, group: Sequence[str], rep: str) -> DataFrame:
    """Mean overlap of the clause sets of all pairs of replicates; two empty sets are the same set."""
    clauses = F.collect_set(F.when(F.col("active"), F.col("feature")))
    sets = hold(predicates.groupBy(*group, rep).agg(F.array_sort(clauses).alias("c")))
    other = sets.select(*group, F.col(rep).alias("__r"), F.col("c").alias("d"))
    pairs = sets.join(other, list(group)).where(F.col(rep) < F.col("__r"))
    union = F.size(F.array_union("c", "d"))
    overlap = F.when(union > 0, F.size(F.array_intersect("c", "d")) / union).otherwise(1.0)
    return pairs.groupBy(*group).agg(F.avg(overlap).alias("jaccard_clauses"))


def bound_spread(predicates: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean over columns of the sample deviation of both bounds across replicates."""
    per = predicates.groupBy(*group, "feature").agg(F.stddev_samp("sel_min").alias("a"), F.stddev_samp("sel_max").alias("b"))
    return per.groupBy(*group).agg(((F.avg("a") + F.avg("b")) / 2).alias("bound_sd"))


def stability_sweep(
    background: DataFrame, features: Sequence[str], perturbed: DataFrame, conditions: Sequence[tuple[float, str]],
    methods: Sequence[str] = ("db", "threshold"),
) -> DataFrame:
    """(sel, method, split, t, delta, scores...): every condition on every selection, replicates shared.

    ``background`` holds (row_id, sel, features...) with the base selection of each row. All
    replicates of all selections are explained in the same passes.
    """
    check_conditions(conditions)
    name = F.concat_ws("#", "sel", F.col("delta").cast("string"), F.col("rep").cast("string"))
    # Every method and condition reads the rows several times, whatever it takes to make them.
    background = hold(background.select("row_id", "sel", *features))
    marked = hold(with_selections(background, perturbed, name))
    base_rows = background.withColumn("sel", F.col("sel"))
    parts = F.split("sel", "#")
    out = None
    for method in methods:
        rows = generate(method, marked, features, conditions)
        rows = rows.withColumn("active", F.col("in_predicate") if method == "db" else F.lit(True))
        rows = hold(rows.select(parts[0].alias("base"), parts[1].cast("double").alias("delta"), parts[2].cast("int").alias("rep"), "t", "split", "feature", "sel_min", "sel_max", "active"))
        group = ["base", "delta", "t", "split"]
        patterns = hold(admission_patterns(base_rows, features, rows, group, "rep", "sel"))
        table = mean_admitted_jaccard(patterns, group).join(f1_spread(patterns, group), group).join(bound_spread(rows, group), group)
        clauses = clause_jaccard(rows, group, "rep") if method == "db" else None
        table = table.join(clauses, group, "left") if clauses is not None else table.withColumn("jaccard_clauses", F.lit(None).cast("double"))
        own = generate(method, background, features, conditions)
        own = own.withColumn("active", F.col("in_predicate") if method == "db" else F.lit(True))
        own = hold(own.select(F.col("sel").alias("base"), "t", "split", "feature", "sel_min", "sel_max", "active", F.lit(0).alias("rep")))
        single = ["base", "t", "split"]
        counted = hold(admission_patterns(base_rows, features, own, single, "rep", "sel"))
        f1 = f1_by_replicate(counted, single).select(*single, "f1")
        spread = counted.groupBy(*single).agg((F.sum(F.when(F.col("pattern")[0], F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))
        length = own.groupBy(*single).agg(F.count_if("active").alias("length"))
        table = table.join(f1, single).join(spread, single).join(length, single).withColumn("method", F.lit(method))
        out = table if out is None else out.unionByName(table)
    return out.withColumnRenamed("base", "sel")


def leaf_overlaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """(leaf_a, leaf_b, jaccard) of leaves that share rows; inputs are (row_id, leaf)."""
    a, b = first.select("row_id", F.col("leaf").alias("leaf_a")), second.select("row_id", F.col("leaf").alias("leaf_b"))
    both = a.join(b, "row_id").groupBy("leaf_a", "leaf_b").agg(F.count("*").alias("both"))
    na = a.groupBy("leaf_a").agg(F.count("*").alias("na"))
    nb = b.groupBy("leaf_b").agg(F.count("*").alias("nb"))
    joined = both.join(na, "leaf_a").join(nb, "leaf_b")
    return joined.select("leaf_a", "leaf_b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def greedy_matches(overlaps: DataFrame) -> DataFrame:
    """(leaf_a, leaf_b, jaccard): one-to-one matches, always the best remaining pair.

    Pairs that are each other's best can be taken at once: nothing better can touch either
    of them, so rounds of mutual best pairs give the same matches as one pair at a time.
    """
    live = hold(overlaps.where(F.col("jaccard") > 0))
    kept = None
    while live.limit(1).count():
        best = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(F.col("jaccard").desc(), "leaf_a", "leaf_b"))
        taken = hold(live.withColumns({"ra": best("leaf_a"), "rb": best("leaf_b")}).where("ra = 1 and rb = 1").drop("ra", "rb"))
        kept = taken if kept is None else kept.unionByName(taken)
        live = hold(live.join(taken.select("leaf_a"), "leaf_a", "left_anti").join(taken.select("leaf_b"), "leaf_b", "left_anti"))
    return kept if kept is not None else live


def matched_predicates(
    background: DataFrame, features: Sequence[str], matches: DataFrame, first: DataFrame, second: DataFrame, ids: Sequence[str]
) -> DataFrame:
    """(leaf_a, leaf_b, ids..., match_jaccard, jaccard_admitted, weak_match) of matched leaves.

    ``first`` and ``second`` hold (leaf, ids..., feature, sel_min, sel_max, active) of two builds.
    """
    a = matches.join(first.withColumnRenamed("leaf", "leaf_a"), "leaf_a").withColumn("rep", F.lit(0))
    b = matches.join(second.withColumnRenamed("leaf", "leaf_b"), "leaf_b").withColumn("rep", F.lit(1))
    both = a.unionByName(b)
    group = ["leaf_a", "leaf_b", *ids]
    patterns = admission_patterns(background, features, both, group, "rep")
    agreed = mean_admitted_jaccard(patterns, group)
    return agreed.join(matches.withColumnRenamed("jaccard", "match_jaccard"), ["leaf_a", "leaf_b"]).withColumn("weak_match", F.col("match_jaccard") < 0.5)
