"""Range explanations of selections: marginal ranges, clause scores, greedy conjunctions.

Ranges are found and tested on the columns as stored. Scaling is increasing and affine, so
membership is the same, closed edges cannot move by rounding, and no scaled copy of the
table is made. ``scaled_ranges`` states the bounds in scaled units where they are reported.

A selection is a label of rows: ``sel`` is a string (each row in at most one selection), an
array of strings (overlapping selections), or null (a row that only serves as background).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import f1_columns, finite, ratio
from ..session import hold
from .predicate_table import LO, PRED, beside, id_column, named, numbered, packed, within
from .quantiles import GROUP_LIMIT, exact_quantiles, extents, largest_group, value_ranks
from .scaling import Scaler, fit_scaler

GAIN = 1e-6
FULL, CORE = 1.0, 0.9
WORD_BITS = 60
SELECTED_BIT = 1 << 61


def check_threshold(threshold: float) -> float:
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold must be in (0, 1], got {threshold}")
    return float(threshold)


def check_conditions(conditions: Sequence[tuple[float, str]]) -> None:
    for t, split in conditions:
        check_threshold(t)
        if split not in ("severity", "symmetric"):
            raise ValueError(f"unknown tail split: {split}")


def _is_array(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.ArrayType)


def selection_rows(background: DataFrame, features: Sequence[str]) -> DataFrame:
    """(sel, features...) of the selected rows only."""
    sel = F.explode("sel") if _is_array(background, "sel") else F.col("sel")
    return background.where(F.col("sel").isNotNull()).select(sel.alias("sel"), *[finite(f).alias(f) for f in features])


def tail_shares(
    selected: DataFrame, features: Sequence[str], limit: int = GROUP_LIMIT, ext: DataFrame | None = None, ranked: DataFrame | None = None
) -> DataFrame:
    """(sel, feature, n, lo, hi, median, left_share): trim shares by how far each tail reaches."""
    ext = hold(extents(selected, ["sel"], features)) if ext is None else ext
    middle = ext.withColumns({"target": F.lit("median"), "p": F.lit(0.5)})
    mid = exact_quantiles(selected, ["sel"], features, middle, limit, largest_group(ext), ranked)
    both = ext.join(mid.select("sel", "feature", F.col("value").alias("median")), ["sel", "feature"])
    left, right = F.col("median") - F.col("lo"), F.col("hi") - F.col("median")
    return hold(both.withColumn("left_share", F.when(left + right > 0, left / (left + right)).otherwise(0.5)))


def _spans(background: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(extents per selection, extents of all rows); one pass when each row has at most one selection."""
    numbers = background.select("sel", *[finite(f).alias(f) for f in features])
    if _is_array(background, "sel"):
        whole = extents(numbers, [], features)
        own = hold(extents(selection_rows(background, features), ["sel"], features))
    else:
        every = hold(extents(numbers, ["sel"], features))
        whole = every.groupBy("feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        own = every.where(F.col("sel").isNotNull())
    return own, whole.select("feature", F.col("lo").alias("global_min"), F.col("hi").alias("global_max"))


def marginal_ranges(
    background: DataFrame,
    features: Sequence[str],
    conditions: Sequence[tuple[float, str]] = ((0.9, "severity"),),
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """(sel, t, split, feature, sel_min, sel_max, sel_range, global_min, global_max).

    Of the share ``1 - t`` trimmed, each tail loses its part; all selections, columns and
    conditions come out of the same passes.
    """
    check_conditions(conditions)
    chosen = selection_rows(background, features)
    ext, span = _spans(background, features)
    trimmed = [(t, s) for t, s in conditions if t < 1]
    largest = largest_group(ext) if trimmed else 0
    ranked = value_ranks(chosen, ["sel"], features).persist() if trimmed and largest <= limit else None
    if any(s == "severity" for _, s in trimmed):
        base = tail_shares(chosen, features, limit, ext, ranked)
    else:
        base = ext.withColumn("left_share", F.lit(0.5))
    cases = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(s).alias("split")) for t, s in conditions])
    plan = base.select("sel", "feature", "n", "lo", "hi", "left_share", F.inline(cases)).withColumn(
        "left_share", F.when(F.col("split") == "severity", F.col("left_share")).otherwise(0.5)
    )
    if trimmed:
        trim = F.lit(1.0) - F.col("t")
        ends = F.array(
            F.struct(F.lit("a").alias("side"), (trim * F.col("left_share")).alias("p")),
            F.struct(F.lit("b").alias("side"), (F.lit(1.0) - trim * (F.lit(1.0) - F.col("left_share"))).alias("p")),
        )
        targets = plan.where(F.col("t") < 1).select("sel", "feature", "n", "lo", "hi", "t", "split", F.inline(ends))
        targets = hold(targets.withColumn("target", F.concat_ws("|", F.col("t").cast("string"), "split", "side")))
        found = exact_quantiles(chosen, ["sel"], features, targets, limit, largest, ranked)
        sides = F.split("target", "\\|")
        side = lambda x: F.max(F.when(sides[2] == x, F.col("value")))
        bounds = found.groupBy("sel", "feature", sides[0].cast("double").alias("t"), sides[1].alias("split")).agg(side("a").alias("q_lo"), side("b").alias("q_hi"))
        plan = plan.join(bounds, ["sel", "feature", "t", "split"], "left")
        low, high = F.coalesce("q_lo", "lo"), F.coalesce("q_hi", "hi")
    else:
        low, high = F.col("lo"), F.col("hi")
    out = hold(
        plan.join(span, "feature").select(
            "sel", "t", "split", "feature", low.alias("sel_min"), high.alias("sel_max"), (high - low).alias("sel_range"), "global_min", "global_max"
        )
    )
    if ranked is not None:
        ranked.unpersist()
    return out


def scaled_ranges(ranges: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same bounds in the units of a scaler table (by..., feature, mean, std)."""
    joined = ranges.join(stats, [*by, "feature"])
    unit = {c: (F.col(c) - F.col("mean")) / F.col("std") for c in ("sel_min", "sel_max", "global_min", "global_max")}
    unit["sel_range"] = F.col("sel_range") / F.col("std")
    return joined.withColumns(unit).drop("mean", "std")


def _text(value: object) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _code(features: Sequence[str], selected: str) -> str:
    """Clause membership packed into longs, one bit per column; the top bit marks selected rows."""
    words = []
    for start in range(0, len(features), WORD_BITS):
        bits = [f"if({within(f'`{f}`', start + bit)}, {1 << bit}L, 0L)" for bit, f in enumerate(features[start : start + WORD_BITS])]
        if start == 0:
            bits.append(f"if({selected}, {SELECTED_BIT}L, 0L)")
        words.append(" + ".join(bits))
    # One word stays a plain long, which keeps the counting key small.
    return words[0] if len(words) == 1 else f"array({', '.join(words)})"


def signatures(background: DataFrame, features: Sequence[str], ranges: DataFrame, scope: str | None = None) -> DataFrame:
    """(sel, t, split, selected, words, n): rows compressed to their clause memberships.

    Predicates are a table beside the rows (``predicate_table``). Rows are counted per signature
    before anything else is shuffled, so what moves is the number of distinct signatures. With
    ``scope`` a predicate meets only rows whose scope equals the part of its label before the last "/".
    """
    ids = ["sel", "t", "split"]
    numbers = background.select("sel", *([scope] if scope else []), *[finite(f).alias(f) for f in features])
    own = F.regexp_extract("sel", "^(.*)/[^/]+$", 1) if scope else None
    table = numbered(packed(ranges, features, ids), ids, own)
    label = id_column("sel")
    mine = f"array_contains(sel, {label})" if _is_array(background, "sel") else f"sel = {label}"
    single = len(features) <= WORD_BITS
    first = "code" if single else "code[0]"
    words = f"array(code & ~{SELECTED_BIT}L)" if single else f"transform(code, (w, i) -> if(i = 0, w & ~{SELECTED_BIT}L, w))"
    code = _code(features, f"coalesce({mine}, false)")
    counts = beside(numbers, table, len(features), scope).select(PRED, F.expr(f"{code} as code")).groupBy(PRED, "code").agg(F.count("*").alias("n"))
    marked = counts.select(PRED, F.expr(f"({first} & {SELECTED_BIT}L) != 0 as selected"), F.expr(f"{words} as words"), "n")
    return named(marked, table, ids, "selected", "words", "n")


def clause_scores(sigs: DataFrame, features: Sequence[str]) -> DataFrame:
    """(sel, t, split, actual, total, feature, ix, tp, predicted) of every single clause."""
    ids = ["sel", "t", "split"]
    sums, cells = [], []
    for i, f in enumerate(features):
        on = f"(words[{i // WORD_BITS}] & {1 << (i % WORD_BITS)}L) != 0"
        sums += [F.expr(f"sum(if({on} and selected, n, 0L)) as tp{i}"), F.expr(f"sum(if({on}, n, 0L)) as pp{i}")]
        cells.append(f"named_struct('feature', {_text(f)}, 'ix', {i}, 'tp', tp{i}, 'predicted', pp{i})")
    wide = sigs.groupBy(*ids).agg(F.expr("sum(if(selected, n, 0L)) as actual"), F.sum("n").alias("total"), *sums)
    return wide.select(*ids, "actual", "total", F.expr(f"inline(array({', '.join(cells)}))"))


def greedy_conjunctions(sigs: DataFrame, features: Sequence[str], max_steps: int | None = None) -> DataFrame:
    """(sel, t, split, feature, predicate_step) of the chosen clauses, plus the final F1 per predicate.

    All predicates advance together. A step is one aggregate over the signature table; the
    state carried on is one row per predicate. Ties go to the first column.
    """
    ids = ["sel", "t", "split"]
    hits = F.when(F.col("selected"), F.col("n")).otherwise(0)
    start = sigs.groupBy(*ids).agg(F.sum(hits).alias("actual"), F.sum("n").alias("total"))
    f1, _, _ = f1_columns(F.col("actual"), F.col("total"), F.col("actual"))
    width = (len(features) + WORD_BITS - 1) // WORD_BITS
    none = F.array_repeat(F.lit(0).cast("bigint"), width)
    state = hold(
        start.select(*ids, "actual", f1.alias("predicate_f1"), none.alias("chosen"), F.array().cast("array<string>").alias("path"), F.lit(True).alias("open"))
    )
    order = Window.partitionBy(*ids).orderBy(F.col("f1").desc(), F.col("ix"))
    for _ in range(max_steps or len(features)):
        live = state.where("open")
        if not live.limit(1).count():
            break
        joined = sigs.join(live.select(*ids, "chosen"), ids)
        kept = joined.where(
            F.forall(F.arrays_zip("words", "chosen"), lambda z: z["words"].bitwiseAND(z["chosen"]) == z["chosen"])
        )
        scores = clause_scores(kept, features).drop("actual")
        f1, _, _ = f1_columns(F.col("tp"), F.col("predicted"), F.col("actual"))
        scored = scores.join(live, ids).withColumn("f1", f1).where(~F.array_contains("path", F.col("feature")))
        best = scored.withColumn("rn", F.row_number().over(order)).where("rn = 1")
        gain = F.col("f1") > F.col("predicate_f1") + F.lit(GAIN)
        mask = F.array(
            *[F.when(F.floor(F.col("ix") / WORD_BITS) == w, F.pow(F.lit(2.0), F.col("ix") % WORD_BITS).cast("bigint")).otherwise(0) for w in range(width)]
        )
        step = best.select(
            *ids, "actual",
            F.when(gain, F.col("f1")).otherwise(F.col("predicate_f1")).alias("predicate_f1"),
            F.when(gain, F.transform(F.arrays_zip(F.col("chosen"), mask.alias("m")), lambda z: z["chosen"].bitwiseOR(z["m"]))).otherwise(F.col("chosen")).alias("chosen"),
            F.when(gain, F.concat("path", F.array("feature"))).otherwise(F.col("path")).alias("path"),
            gain.alias("open"),
        )
        finished = live.join(step.select(*ids), ids, "left_anti").withColumn("open", F.lit(False))
        state = hold(state.where("not open").unionByName(step).unionByName(finished))
    return state.select(*ids, "predicate_f1", "path")


def explain(background: DataFrame, features: Sequence[str], ranges: DataFrame, scope: str | None = None) -> DataFrame:
    """Predicate rows: ranges with clause scores, membership in the greedy conjunction and its F1."""
    ids = ["sel", "t", "split"]
    sigs = hold(signatures(background, features, ranges, scope))
    f1, precision, recall = f1_columns(F.col("tp"), F.col("predicted"), F.col("actual"))
    single = clause_scores(sigs, features).select(
        *ids, "feature", f1.alias("clause_f1"), precision.alias("clause_precision"), recall.alias("clause_recall")
    )
    greedy = greedy_conjunctions(sigs, features)
    step = F.array_position("path", F.col("feature")).cast("int")
    return (
        ranges.join(single, [*ids, "feature"])
        .join(greedy, ids)
        .withColumn("in_predicate", step > 0)
        .withColumn("predicate_step", F.when(step > 0, step - 1))
        .drop("path")
    )


def unscored(ranges: DataFrame) -> DataFrame:
    """Ranges of a selection without labels to score against: all scores zero, no clause."""
    zero = F.lit(0.0)
    return ranges.withColumns(
        {"clause_f1": zero, "clause_precision": zero, "clause_recall": zero, "in_predicate": F.lit(False),
         "predicate_step": F.lit(None).cast("int"), "predicate_f1": zero}
    )


def generate(
    method: str, background: DataFrame, features: Sequence[str], conditions: Sequence[tuple[float, str]],
    labelled: bool = True, limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Predicates of every selection by method: plain ranges ("threshold", "hm") or greedy ("db")."""
    if method not in ("threshold", "hm", "db"):
        raise ValueError(f"unknown predicate method: {method}")
    ranges = marginal_ranges(background, features, conditions, limit)
    if method != "db":
        return ranges
    if not labelled:
        return unscored(ranges)
    return explain(background, features, ranges)


def scope_background(
    df: DataFrame, features: Sequence[str], node: Column, scope: str, normalize: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(background rows, scaler table) of a scope.

    Local: the node's rows with a scaler fitted to them, whatever ``normalize`` says.
    Global: all rows with the root scaler, or raw units without normalisation.
    """
    if scope not in ("local", "global"):
        raise ValueError(f"unknown scope: {scope}")
    rows = df.where(node) if scope == "local" else df
    if scope == "local" or normalize:
        stats = fit_scaler(rows, features)
    else:
        stats = Scaler.fit(rows, features, normalize=False).table(df.sparkSession)
    return rows, stats


def full_and_core(background: DataFrame, features: Sequence[str], stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(predicate rows at t = 1 and t = 0.9, one summary row per selection taken from t = 1)."""
    rows = generate("db", background, features, [(FULL, "severity"), (CORE, "severity")])
    rows = rows.withColumn("part", F.when(F.col("t") == FULL, "full").otherwise("trimmed"))
    if stats is not None:
        rows = scaled_ranges(rows, stats)
    rows = hold(rows)
    sizes = selection_rows(background, features).groupBy("sel").agg(F.count("*").alias("n_selected"))
    summary = (
        rows.where(F.col("t") == FULL)
        .groupBy("sel")
        .agg(
            F.max("predicate_f1").alias("predicate_f1"),
            F.count_if("in_predicate").alias("n_features_used"),
            F.count("*").alias("n_features_total"),
        )
        .join(sizes, "sel")
    )
    return rows, summary


def children_against_parents(members: DataFrame, features: Sequence[str]) -> DataFrame:
    """Kept clauses of every child against the rest of its parent, with the trimmed core beside.

    ``members`` holds (node_id, sel, features...): each row once per node it belongs to,
    ``sel`` naming the child it falls into (null for noise). All children of all nodes
    are explained in the same passes; each is judged on its parent's rows only.
    """
    conds = [(FULL, "severity"), (CORE, "severity")]
    ranges = marginal_ranges(members, features, conds)
    local = extents(members, ["node_id"], features).select("node_id", "feature", F.col("lo").alias("global_min"), F.col("hi").alias("global_max"))
    parent = F.regexp_extract("sel", "^(.*)/[^/]+$", 1)
    ranges = ranges.drop("global_min", "global_max").withColumn("node_id", parent).join(local, ["node_id", "feature"])
    ranges = hold(ranges)
    rows = explain(members, features, ranges, scope="node_id")
    full = rows.where((F.col("t") == FULL) & F.col("in_predicate"))
    core = rows.where(F.col("t") == CORE).select("sel", "feature", F.col("sel_min").alias("core_min"), F.col("sel_max").alias("core_max"))
    return full.join(core, ["sel", "feature"], "left").drop("t", "split")


def display_order(rows: DataFrame) -> DataFrame:
    """Rank for showing: clauses of the predicate first, then by single-clause F1, then by name."""
    order = Window.partitionBy("sel", "t", "split").orderBy(F.col("in_predicate").desc(), F.col("clause_f1").desc(), "feature")
    return rows.withColumn("position", F.row_number().over(order))


def active_clauses(rows: DataFrame, method: str) -> DataFrame:
    return rows.where("in_predicate") if method == "db" else rows


def admitted(background: DataFrame, features: Sequence[str], predicates: DataFrame, ids: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., ids...) of the rows that satisfy every active clause of a predicate.

    ``predicates`` holds (ids..., feature, sel_min, sel_max, active). A predicate without
    an active clause admits everything. Predicates are a table beside the rows, in one scan.
    """
    table = numbered(packed(predicates, features, ids, F.col("active")), ids)
    numbers = background.select(*keep, *[finite(f).alias(f) for f in features if f not in keep])
    test = " and ".join(f"coalesce({within(f'`{f}`', i)}, get({LO}, {i}) is null)" for i, f in enumerate(features))
    hits = beside(numbers, table, len(features)).where(test)
    return hits.select(*keep, *[F.col(id_column(c)).alias(c) for c in ids])


def quality(background: DataFrame, features: Sequence[str], predicates: DataFrame, ids: Sequence[str], sel_of: str = "sel", member: str = "sel") -> DataFrame:
    """(ids..., f1, precision, recall, coverage, length) of admitted sets against the selections.

    ``sel_of`` is the id column naming the selection a predicate is judged against,
    ``member`` the column of ``background`` that holds the row's selection(s).
    """
    predicates = hold(predicates)  # read by the scan and the lengths
    base = background.withColumnRenamed(member, "__member")
    hit = admitted(base, features, predicates, ids, ["__member"])
    mine = F.array_contains("__member", F.col(sel_of)) if _is_array(base, "__member") else F.col("__member") == F.col(sel_of)
    counts = hit.groupBy(*ids).agg(F.count("*").alias("predicted"), F.count_if(mine).alias("tp"))
    listed = F.explode("__member") if _is_array(base, "__member") else F.col("__member")
    sizes = base.select(listed.alias(sel_of)).where(F.col(sel_of).isNotNull()).groupBy(sel_of).agg(F.count("*").alias("actual"))
    total = background.agg(F.count("*")).head()[0]
    lengths = predicates.groupBy(*ids).agg(F.count_if("active").alias("length"))
    f1, precision, recall = f1_columns(F.col("tp"), F.col("predicted"), F.col("actual"))
    joined = lengths.join(counts, list(ids), "left").fillna(0, ["predicted", "tp"]).join(sizes, sel_of)
    return joined.select(
        *ids, f1.alias("f1"), precision.alias("precision"), recall.alias("recall"),
        (F.col("predicted") / F.lit(total)).alias("coverage"), "length",
    )


def clauses_json(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One JSON list of clauses per predicate, in column order."""
    clause = F.struct("feature", "sel_min", "sel_max", "in_predicate", F.col("predicate_step").alias("step"))
    return rows.groupBy(*ids).agg(F.to_json(F.array_sort(F.collect_list(clause))).alias("clauses"))


def dimension_recovery(rows: DataFrame, truth: DataFrame, method: str, ids: Sequence[str]) -> DataFrame:
    """Columns a predicate names against the truly relevant ones.

    ``truth`` holds (sel, feature). A greedy predicate names its clauses; plain ranges name
    as many columns as are relevant, the most selective first, ties in column order (``ix``).
    """
    relevant = truth.groupBy("sel").agg(F.collect_set("feature").alias("true_set"))
    if method == "db":
        named = rows.groupBy(*ids).agg(F.collect_list(F.when(F.col("in_predicate"), F.col("feature"))).alias("found"))
        both = named.join(relevant, "sel")
    else:
        span = F.col("global_max") - F.col("global_min")
        share = F.col("sel_range") / F.greatest(span, F.lit(1e-12))
        ranked = rows.join(relevant, "sel").withColumn(
            "rn", F.row_number().over(Window.partitionBy(*ids).orderBy(share, "ix"))
        )
        named = F.collect_list(F.when(F.col("rn") <= F.size("true_set"), F.col("feature")))
        both = ranked.groupBy(*ids, "true_set").agg(named.alias("found"))
    common = F.size(F.array_intersect("found", "true_set"))
    precision = ratio(common, F.size("found"), 0.0)
    recall = ratio(common, F.size("true_set"), 0.0)
    return both.select(
        *ids, precision.alias("dim_precision"), recall.alias("dim_recall"),
        ratio(2 * precision * recall, precision + recall, 0.0).alias("dim_f1"), F.size("found").alias("n_dims_found"),
    )
