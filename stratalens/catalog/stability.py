"""Stability of range explanations over orders: selections are order states in a year."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours as N
from ..operators import predicates as P
from ..operators import reports as R
from ..operators import stability as S
from ..session import hold
from . import query
from . import range_sql as Q
from .inputs import LINE_FEATURES, rounded, spread_lines, table
from .inputs import letter_points, letter_rows, LETTER_COLUMNS

DELTAS = [0.05, 0.1]
REPS = 4


def languages(spark, sf):
    """Documents with their letter shares; a language is a selection."""
    return letter_rows(spark, sf).withColumn("sel", F.col("lang"))


def replicas(spark, sf):
    points = letter_points(spark, sf)
    selection = languages(spark, sf).select("sel", "row_id")
    pool = hold(N.boundary_pool(points, selection, S.POOL_K))
    return selection, pool, S.perturbed_selections(selection, pool, DELTAS, REPS)


@query(
    "b1_perturbed_selections",
    f"""with n as (select lang as sel, count(*) as n from documents group by 1), d as (select unnest([0.05, 0.1])::double as delta, unnest([0.05, 0.1])::decimal(9, 4) as dd),
        r as (select unnest(range(0, {REPS}))::int as rep)
        select sel, delta, rep, n - greatest(1, cast(round_even(dd * n, 0) as bigint)) as n_kept, true as all_from_pool, true as at_most_swapped from n, d, r""",
)
def b1(spark, sf):
    selection, pool, out = replicas(spark, sf)
    marked = out.join(selection.withColumn("member", F.lit(True)), ["sel", "row_id"], "left").join(pool.withColumn("pooled", F.lit(True)), ["sel", "row_id"], "left")
    n = selection.groupBy("sel").agg(F.count("*").alias("n"))
    sums = marked.groupBy("sel", "delta", "rep").agg(
        F.count("member").alias("n_kept"), F.count("*").alias("m"), F.bool_and(F.col("member").isNotNull() | F.col("pooled").isNotNull()).alias("all_from_pool")
    )
    return sums.join(n, "sel").select("sel", "delta", "rep", "n_kept", "all_from_pool", (F.col("m") <= F.col("n")).alias("at_most_swapped"))


@query("b2_stability_sweep")
def b2(spark, sf):
    _, _, out = replicas(spark, sf)
    return rounded(S.stability_sweep(languages(spark, sf), LETTER_COLUMNS, out, [(1.0, "severity"), (0.9, "severity")]))


# Orders of a status, exchanged with urgent orders of others. Draws are md5 digests, so SQL lists the same rows.
ORDER_COLUMNS = ["o_totalprice", "o_custkey", "day"]
DRAWS = 2
CONDITIONS = [(1.0, "severity"), (0.9, "severity")]


def orders_by_status(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("sel"), "o_orderpriority", "o_totalprice", "o_custkey", F.dayofmonth("o_orderdate").alias("day"))


def drawn_orders(spark, sf):
    rows = orders_by_status(spark, sf)
    urgent = rows.where(F.col("o_orderpriority") == "1-URGENT").select("row_id", F.col("sel").alias("own"))
    pool = rows.select("sel").distinct().join(urgent, F.col("sel") != F.col("own")).select("sel", "row_id")
    return rows, S.perturbed_selections(rows.select("sel", "row_id"), pool, DELTAS, DRAWS)


def draw_sql(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || sel || '|' || delta || '|' || rep || '|' || row_id), 1, 13))::bigint"


DRAWN_SQL = f"""o as materialized (select o_orderkey as row_id, o_orderstatus as status, o_orderpriority as pri, o_totalprice, o_custkey, extract(day from o_orderdate) as day from orders),
  sizes as (select status as sel, count(*) as n_sel from o group by 1),
  cases as (select sel, delta, rep, greatest(1, cast(round_even(dd * n_sel, 0) as bigint)) as swaps
            from sizes, (values (0.05::double, 0.05::decimal(9, 4)), (0.1::double, 0.1::decimal(9, 4))) d(delta, dd), (select unnest(range(0, {DRAWS}))::int as rep)),
  member as (select c.*, row_id, {draw_sql(42)} as u from cases c join o on o.status = c.sel),
  pooled as (select c.*, row_id, {draw_sql(43)} as u from cases c join o on o.status <> c.sel where pri = '1-URGENT'),
  drawn as materialized (select sel, delta, rep, row_id from (select *, row_number() over (partition by sel, delta, rep order by u) as rn from member) where rn > swaps
            union all select sel, delta, rep, row_id from (select *, row_number() over (partition by sel, delta, rep order by u) as rn from pooled) where rn <= swaps)"""


@query("b1_drawn_rows", f"with {DRAWN_SQL} select sel, delta, rep, row_id from drawn")
def b1_drawn(spark, sf):
    return drawn_orders(spark, sf)[1]


def sweep_sql(method: str) -> str:
    """One method's rows of the sweep over ``drawn``: explained draws (``p``), the base selection (``own``), their agreement."""
    ranges = Q.ranges_cte(CONDITIONS, "marked", "part", ORDER_COLUMNS)
    base = Q.ranges_cte(CONDITIONS, "o", "status", ORDER_COLUMNS)
    if method == "db":
        once = Q.signature_cte("part", ORDER_COLUMNS).replace("from src join wide b on true", "from o src join wide b on true left join parts d on d.row_id = src.row_id and d.part = b.sel")
        rest = f"{once.replace('coalesce(part = b.sel, false)', 'd.row_id is not null')}, {Q.greedy_cte(ORDER_COLUMNS)}"
        p = f"with {ranges}, {rest} select *, in_predicate as active from predicate"
        own = f"with {base}, {Q.signature_cte('status', ORDER_COLUMNS)}, {Q.greedy_cte(ORDER_COLUMNS)} select *, in_predicate as active from predicate"
        clauses = "case when len(c0) + len(c1) = 0 then 1.0 else len(list_intersect(c0, c1))::double / len(list_distinct(list_concat(c0, c1))) end"
    else:
        p, own = (f"with {cte} select *, true as active from ranges" for cte in (ranges, base))
        clauses = "null::double"
    bounds = ", ".join(f"max(case when ix = {i} and active then sel_min end) as lo{i}, max(case when ix = {i} and active then sel_max end) as hi{i}" for i in range(len(ORDER_COLUMNS)))
    test = " and ".join(f"(lo{i} is null or o.{f} between lo{i} and hi{i})" for i, f in enumerate(ORDER_COLUMNS))
    keys = "sel, delta, t, split"
    clause_set = lambda rep: f"coalesce(list(feature) filter (active and rep = {rep}), [])"
    return f"""(with parts as (select row_id, sel || '#' || delta || '#' || rep as part from drawn), marked as (select o.*, part from o left join parts using (row_id)),
      p as materialized (select split_part(sel, '#', 1) as sel, split_part(sel, '#', 2)::double as delta, split_part(sel, '#', 3)::int as rep, * exclude (sel) from ({p})), own as materialized ({own}),
      w as (select {keys}, rep, {bounds} from p group by all), ow as (select sel, t, split, {bounds}, count_if(active) as length from own group by sel, t, split),
      hit as materialized (select {keys}, rep, status = sel as mine, row_id from o join w on {test}),
      per as (select {keys}, row_id, count(*) as c from hit group by all),
      jac as (select {keys}, count_if(c = {DRAWS})::double / count(*) as jaccard_admitted from per group by all),
      f as (select {keys}, rep, n_sel as actual, count_if(mine)::double as tp, count(*)::double as pp from hit join sizes using (sel) group by all),
      spread as (select {keys}, stddev_samp({Q.F1}) as f1_sd from f group by all),
      dev as (select {keys}, feature, stddev_samp(sel_min) as a, stddev_samp(sel_max) as b from p group by all),
      bound as (select {keys}, (avg(a) + avg(b)) / 2 as bound_sd from dev group by all),
      sets as (select {keys}, {clause_set(0)} as c0, {clause_set(1)} as c1 from p group by all),
      oh as (select sel, t, split, length, n_sel as actual, count_if(status = sel)::double as tp, count(*)::double as pp from o join ow on {test} join sizes using (sel) group by all)
      select sel, '{method}' as method, split, t, delta, round(jaccard_admitted, 6) as jaccard_admitted, round(f1_sd, 6) as f1_sd, round(bound_sd, 6) as bound_sd,
        round({clauses}, 6) as jaccard_clauses, round({Q.F1}, 6) as f1, round(pp / (select count(*) from o), 6) as coverage, length
      from jac join spread using ({keys}) join bound using ({keys}) join sets using ({keys}) join oh using (sel, t, split))"""


@query("b2_drawn_sweep", f"with {DRAWN_SQL} select * from {sweep_sql('db')} union all select * from {sweep_sql('threshold')}")
def b2_drawn(spark, sf):
    rows, drawn = drawn_orders(spark, sf)
    return rounded(S.stability_sweep(rows.drop("o_orderpriority"), ORDER_COLUMNS, hold(drawn), CONDITIONS))


# Replicates with a fixed rule, so that SQL can follow: line numbers split a flag's rows
# into overlapping parts, each leaving out one line number.
REP_SQL = "(select l.*, case when l_linenumber <> k then l_returnflag || '#' || k end as part, l_returnflag as base, k from lineitem l, (values (1), (2), (3)) r(k))"
PARTS = [1, 2, 3]


def parts(spark, sf):
    """(base, rep, t, split, feature, sel_min, sel_max, in_predicate) of three parts of every flag, and the rows."""
    names = [F.when(F.col("l_linenumber") != k, F.concat(F.col("l_returnflag"), F.lit(f"#{k}"))) for k in PARTS]
    # Ranges, signatures and patterns read them several times.
    rows = hold(spread_lines(spark, sf).select("l_returnflag", *LINE_FEATURES, F.array_compact(F.array(*names)).alias("sel")))
    found = P.generate("db", rows, LINE_FEATURES, Q.FULL_CORE)
    split = F.split("sel", "#")
    preds = found.select(split[0].alias("base"), split[1].cast("int").alias("rep"), "t", "split", "feature", "sel_min", "sel_max", "in_predicate")
    return hold(preds), rows.drop("sel")


PARTS_CTE = f"""{Q.ranges_cte(Q.FULL_CORE, REP_SQL, 'part')}, pr as (select split_part(sel, '#', 1) as base, cast(split_part(sel, '#', 2) as int) as rep, t, split, feature, ix, sel_min, sel_max from ranges),
  wide as (select base, rep, t, split, {', '.join(f'max(case when ix = {i} then sel_min end) as lo{i}, max(case when ix = {i} then sel_max end) as hi{i}' for i in range(4))} from pr group by all),
  hit as (select w.base, w.t, w.split, w.rep, l.l_returnflag = w.base as selected, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey from lineitem l join wide w
     on {' and '.join(f'l.{f} between lo{i} and hi{i}' for i, f in enumerate(LINE_FEATURES))}),
  per as (select base, t, split, selected, l_orderkey, l_linenumber, l_partkey, l_suppkey, list(rep) as reps from hit group by all),
  pat as (select base, t, split, selected, list_contains(reps, 1) as a, list_contains(reps, 2) as b, list_contains(reps, 3) as c, count(*) as n from per group by all)"""

GROUP = ["base", "t", "split"]


def patterns(spark, sf):
    preds, rows = parts(spark, sf)
    return hold(S.admission_patterns(rows, LINE_FEATURES, preds.withColumn("active", F.lit(True)), GROUP, "rep", "l_returnflag"))


def overlap(x: str, y: str) -> str:
    return f"sum(case when {x} and {y} then n else 0 end)::double / sum(case when {x} or {y} then n else 0 end)"


@query(
    "b3_admitted_jaccard",
    f"with {PARTS_CTE} select base, t, split, round(({overlap('a', 'b')} + {overlap('a', 'c')} + {overlap('b', 'c')}) / 3, 6) as jaccard_admitted from pat group by 1, 2, 3",
)
def b3(spark, sf):
    return rounded(S.mean_admitted_jaccard(patterns(spark, sf), GROUP))


@query(
    "b4_clause_jaccard",
    f"""with {Q.ranges_cte(Q.FULL_CORE, REP_SQL, 'part').replace('src as (select * from', 'src as materialized (select * from')},
        lsrc as (select * from lineitem), {Q.signature_cte('part').replace('from src join wide b on true', "from lsrc src join wide b on true").replace("coalesce(part = b.sel, false)", "src.l_returnflag = split_part(b.sel, '#', 1) and src.l_linenumber <> cast(split_part(b.sel, '#', 2) as int)")}, {Q.greedy_cte()},
        sets as (select split_part(sel, '#', 1) as base, split_part(sel, '#', 2) as rep, t, split, list(feature order by feature) filter (in_predicate) as c from predicate group by all),
        pairs as (select a.base, a.t, a.split, coalesce(a.c, []) as c, coalesce(b.c, []) as d from sets a join sets b on a.base = b.base and a.t = b.t and a.split = b.split and a.rep < b.rep)
        select base, t, split, round(avg(case when len(c) + len(d) = 0 then 1.0 else len(list_intersect(c, d))::double / len(list_distinct(list_concat(c, d))) end), 6) as jaccard_clauses from pairs group by 1, 2, 3""",
)
def b4(spark, sf):
    preds, _ = parts(spark, sf)
    return rounded(S.clause_jaccard(preds.withColumnRenamed("in_predicate", "active"), GROUP, "rep"))


@query(
    "b5_bound_spread",
    f"""with {PARTS_CTE}, s as (select base, t, split, feature, stddev_samp(sel_min) as a, stddev_samp(sel_max) as b from pr group by all)
        select base, t, split, round((avg(a) + avg(b)) / 2, 6) as bound_sd from s group by 1, 2, 3""",
)
def b5(spark, sf):
    return rounded(S.bound_spread(parts(spark, sf)[0], GROUP))


@query(
    "b6_f1_spread",
    f"""with {PARTS_CTE}, act as (select l_returnflag as base, count(*) as actual from lineitem group by 1),
        f as (select base, t, split, rep, count_if(selected)::double as tp, count(*)::double as pp from hit group by all)
        select base, t, split, round(stddev_samp({Q.F1}), 6) as f1_sd from f join act using (base) group by 1, 2, 3""",
)
def b6(spark, sf):
    return rounded(S.f1_spread(patterns(spark, sf), GROUP))


# Two builds of the same orders: leaves by (status, price band), the bands shifted in the second.
BUILDS_SQL = """a as (select o_orderkey as row_id, o_orderstatus || floor(o_totalprice / 100000)::int as leaf from orders),
  b as (select o_orderkey as row_id, o_orderstatus || floor((o_totalprice + 37000) / 100000)::int as leaf from orders),
  j as (select leaf_a, leaf_b, shared::double / (na + nb - shared) as jaccard from (select a.leaf as leaf_a, b.leaf as leaf_b, count(*) as shared from a join b using (row_id) group by all)
     join (select leaf as leaf_a, count(*) as na from a group by 1) using (leaf_a) join (select leaf as leaf_b, count(*) as nb from b group by 1) using (leaf_b))"""


def two_builds(spark, sf):
    o = table(spark, sf, "orders")
    leaf = lambda shift: F.concat("o_orderstatus", F.floor((F.col("o_totalprice") + shift) / 100000).cast("int").cast("string"))
    rows = o.select(F.col("o_orderkey").alias("row_id"), "o_totalprice", F.dayofmonth("o_orderdate").alias("day"), leaf(0).alias("leaf_a"), leaf(37000).alias("leaf_b"))
    first = rows.select("row_id", F.col("leaf_a").alias("leaf"))
    second = rows.select("row_id", F.col("leaf_b").alias("leaf"))
    return rows, first, second


# The best remaining pair, one at a time, in the order (jaccard, names).
GREEDY_SQL = f"""with recursive {BUILDS_SQL}, o as materialized (select *, row_number() over (order by jaccard desc, leaf_a, leaf_b) as r from j),
  g(r, used_a, used_b, taken) as (select 0::bigint, []::varchar[], []::varchar[], false union all
    select o.r, case when free then list_append(used_a, leaf_a) else used_a end, case when free then list_append(used_b, leaf_b) else used_b end, free
    from (select o.*, g.used_a, g.used_b, not list_contains(g.used_a, o.leaf_a) and not list_contains(g.used_b, o.leaf_b) as free from g join o on o.r = g.r + 1) o),
  m as (select leaf_a, leaf_b, jaccard from o join g using (r) where taken)"""


@query("b7_greedy_matches", f"{GREEDY_SQL} select leaf_a, leaf_b, round(jaccard, 6) as jaccard from m")
def b7(spark, sf):
    _, first, second = two_builds(spark, sf)
    return rounded(S.greedy_matches(S.leaf_overlaps(first, second)))


@query(
    "b8_matched_predicates",
    f"""{GREEDY_SQL}, rows as (select o_orderkey as row_id, o_totalprice, extract(day from o_orderdate) as day from orders),
        pa as (select leaf, min(o_totalprice) as p0, max(o_totalprice) as p1, min(day) as d0, max(day) as d1 from a join rows using (row_id) group by 1),
        pb as (select leaf, min(o_totalprice) as p0, max(o_totalprice) as p1, min(day) as d0, max(day) as d1 from b join rows using (row_id) group by 1),
        t as (select m.leaf_a, m.leaf_b, any_value(jaccard) as mj, count_if(x and y)::double / count_if(x or y) as ja from (select m.*, o_totalprice between pa.p0 and pa.p1 and day between pa.d0 and pa.d1 as x,
            o_totalprice between pb.p0 and pb.p1 and day between pb.d0 and pb.d1 as y from m join pa on pa.leaf = leaf_a join pb on pb.leaf = leaf_b join rows on true) m group by 1, 2)
        select leaf_a, leaf_b, 1.0::double as t, round(ja, 6) as jaccard_admitted, round(mj, 6) as match_jaccard, mj < 0.5 as weak_match from t""",
)
def b8(spark, sf):
    rows, first, second = two_builds(spark, sf)
    matches = hold(S.greedy_matches(S.leaf_overlaps(first, second)))
    features = ["o_totalprice", "day"]
    preds = [
        P.marginal_ranges(rows.withColumn("sel", F.col(c)), features, [(1.0, "severity")]).select(F.col("sel").alias("leaf"), "t", "feature", "sel_min", "sel_max", F.lit(True).alias("active"))
        for c in ("leaf_a", "leaf_b")
    ]
    return rounded(S.matched_predicates(rows, features, matches, preds[0], preds[1], ["t"]))


@query(
    "b9_size_gate",
    "select source as sel, count(*) as n_selected, count(*) >= 20 and (select count(*) from documents) - count(*) >= 10 as eligible from documents group by 1",
)
def b9(spark, sf):
    d = table(spark, sf, "documents")
    return S.size_gate(d.groupBy(F.col("source").alias("sel")).agg(F.count("*").alias("n_selected")), d.count())


@query(
    "b10_split_invariance",
    "select metric, 0.0::double as max_difference, (select count(distinct l_returnflag) from lineitem) as n_pairs from (values ('f1'), ('coverage')) m(metric)",
)
def b10(spark, sf):
    src = spread_lines(spark, sf).withColumn("sel", F.col("l_returnflag"))
    rows = P.generate("db", src, LINE_FEATURES, [(1.0, "severity"), (1.0, "symmetric")]).withColumn("active", F.col("in_predicate"))
    scores = P.quality(src, LINE_FEATURES, rows, ["sel", "t", "split"])
    records = scores.select(F.lit("lines").alias("arm"), F.lit(0).alias("seed"), F.col("sel").alias("sel_id"), F.lit("db").alias("method"), F.lit(0.0).alias("delta"), "t", "split", "f1", "coverage")
    return R.split_invariance(records, ["f1", "coverage"])
