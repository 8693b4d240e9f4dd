"""Range explanations over lineitem: which ranges separate the rows of one flag from all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import predicates as P
from ..operators.scaling import fit_scaler
from . import query
from . import range_sql as Q
from .inputs import LINE_FEATURES, ORDER_TREE_SQL, order_rows, rounded, spread_lines

SEVERAL = [(1.0, "severity"), (0.95, "severity"), (0.9, "severity"), (0.9, "symmetric")]


def flagged(spark, sf):
    return spread_lines(spark, sf).withColumn("sel", F.col("l_returnflag"))


@query("r1_marginal_range", f"with {Q.ranges_cte([(0.9, 'severity')])} select sel, t, split, feature, {Q.r6(Q.BOUNDS)} from ranges")
def r1(spark, sf):
    return rounded(P.marginal_ranges(flagged(spark, sf), LINE_FEATURES, [(0.9, "severity")]))


@query("r2_tail_split", f"with {Q.ranges_cte([(0.9, 'severity')])} select sel, feature, n, lo, hi, round(med, 6) as median, round(ls, 6) as left_share from plan")
def r2(spark, sf):
    return rounded(P.tail_shares(P.selection_rows(flagged(spark, sf), LINE_FEATURES), LINE_FEATURES))


@query(
    "r3_threshold_methods",
    f"with {Q.ranges_cte(SEVERAL)} select method, sel, t, split, feature, {Q.r6(Q.BOUNDS)} from ranges, (values ('threshold'), ('hm')) m(method)",
)
def r3(spark, sf):
    both = [P.generate(m, flagged(spark, sf), LINE_FEATURES, SEVERAL).withColumn("method", F.lit(m)) for m in ("threshold", "hm")]
    return rounded(both[0].unionByName(both[1]))


@query(
    "r4_clause_scores",
    f"with {Q.predicate_cte([(0.9, 'severity')])} select sel, feature, {Q.r6(Q.SCORES)} from clause",
)
def r4(spark, sf):
    rows = P.explain(flagged(spark, sf), LINE_FEATURES, P.marginal_ranges(flagged(spark, sf), LINE_FEATURES))
    return rounded(rows.select("sel", "feature", *Q.SCORES))


@query(
    "r5_greedy_conjunction",
    f"with {Q.predicate_cte(SEVERAL)} select sel, t, split, feature, in_predicate, predicate_step, round(predicate_f1, 6) as predicate_f1 from predicate",
)
def r5(spark, sf):
    rows = P.generate("db", flagged(spark, sf), LINE_FEATURES, SEVERAL)
    return rounded(rows.select("sel", "t", "split", "feature", "in_predicate", "predicate_step", "predicate_f1"))


QUANTITY_SEL = "case when l_quantity > 30 and l_discount < 0.05 then 'bulk' when l_extendedprice < 20000 then 'small' end"


@query(
    "r5_greedy_planted",
    f"""with {Q.predicate_cte(Q.FULL_CORE, 'planted', f'(select *, {QUANTITY_SEL} as planted from lineitem)')}
        select sel, t, split, feature, in_predicate, predicate_step, round(predicate_f1, 6) as predicate_f1, {Q.r6(Q.SCORES)} from predicate""",
)
def r5b(spark, sf):
    rows = P.generate("db", planted(spark, sf), LINE_FEATURES, Q.FULL_CORE)
    return rounded(rows.select("sel", "t", "split", "feature", "in_predicate", "predicate_step", "predicate_f1", *Q.SCORES))


def planted(spark, sf):
    bulk = (F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05)
    return spread_lines(spark, sf).withColumn("sel", F.when(bulk, "bulk").when(F.col("l_extendedprice") < 20000, "small"))


@query(
    "r6_unlabelled_ranges",
    f"""with {Q.ranges_cte([(0.9, 'severity')])} select sel, feature, {Q.r6(['sel_min', 'sel_max'])}, 0.0::double as clause_f1,
        false as in_predicate, cast(null as int) as predicate_step, 0.0::double as predicate_f1 from ranges""",
)
def r6(spark, sf):
    rows = P.generate("db", flagged(spark, sf), LINE_FEATURES, [(0.9, "severity")], labelled=False)
    return rounded(rows.select("sel", "feature", "sel_min", "sel_max", "clause_f1", "in_predicate", "predicate_step", "predicate_f1"))


OPEN_SEL = "case when l_returnflag = 'R' and l_quantity > 40 then 'big' end"
NODE_SRC = f"(select *, {OPEN_SEL} as chosen from lineitem where l_returnflag = 'R')"
ALL_SRC = f"(select *, {OPEN_SEL} as chosen from lineitem)"


@query(
    "r7_scope",
    " union all ".join(
        f"""select * from (with {Q.predicate_cte([(0.9, 'severity')], 'chosen', src)}, {Q.scaler_cte('src')}
            select '{name}' as scope, p.feature, in_predicate, round(clause_f1, 6) as clause_f1, {'%s' % (Q.r6(Q.BOUNDS) if raw else Q.scaled())}
            from predicate p join scaler s using (feature))"""
        for name, src, raw in (("local", NODE_SRC, False), ("global", ALL_SRC, False), ("global_raw", ALL_SRC, True))
    ),
)
def r7(spark, sf):
    src = spread_lines(spark, sf).withColumn("sel", F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "big"))
    node = F.col("l_returnflag") == "R"
    out = None
    for name, scope, norm in (("local", "local", False), ("global", "global", True), ("global_raw", "global", False)):
        rows, stats = P.scope_background(src, LINE_FEATURES, node, scope, norm)
        found = P.scaled_ranges(P.generate("db", rows, LINE_FEATURES, [(0.9, "severity")]), stats)
        part = found.select(F.lit(name).alias("scope"), "feature", "in_predicate", "clause_f1", *Q.BOUNDS)
        out = part if out is None else out.unionByName(part)
    return rounded(out)


PREDICATE_COLUMNS = ["sel", "part", "feature", *Q.BOUNDS, *Q.SCORES, "in_predicate", "predicate_step", "predicate_f1"]


@query(
    "r8_full_and_core",
    f"""with {Q.predicate_cte()}, {Q.scaler_cte('src')}
        select sel, case when t = 1 then 'full' else 'trimmed' end as part, p.feature, {Q.scaled()}, {Q.r6(Q.SCORES)}, in_predicate, predicate_step,
        round(predicate_f1, 6) as predicate_f1 from predicate p join scaler s using (feature)""",
)
def r8(spark, sf):
    src = flagged(spark, sf)
    rows, _ = P.full_and_core(src, LINE_FEATURES, fit_scaler(src, LINE_FEATURES))
    return rounded(rows.select(*PREDICATE_COLUMNS))


@query(
    "r8_summary",
    f"""with {Q.predicate_cte(Q.FULL_CORE, 'planted', f'(select *, {QUANTITY_SEL} as planted from lineitem)')}
        select sel, round(max(predicate_f1), 6) as predicate_f1, cast(count_if(in_predicate) as bigint) as n_features_used, count(*) as n_features_total,
        (select count(*) from src where planted = sel) as n_selected from predicate where t = 1 group by sel""",
)
def r8s(spark, sf):
    return rounded(P.full_and_core(planted(spark, sf), LINE_FEATURES)[1])


TREE_FEATURES = ["o_totalprice", "day_of_month", "order_year"]
CHILD_SRC = """(select 'root' as node_id, case when c1 >= 0 then 'root/' || c1 end as child, o_totalprice, day_of_month, order_year from tree_rows
   union all select 'root/' || c1, case when c2 >= 0 then 'root/' || c1 || '/' || c2 end, o_totalprice, day_of_month, order_year from tree_rows where c1 >= 0)"""


def child_rows(spark, sf):
    """(node_id, sel, features): each order under the root and under its status node."""
    first = F.concat_ws("/", F.lit("root"), F.col("c1").cast("string"))
    second = F.concat_ws("/", first, F.col("c2").cast("string"))
    inner = F.col("c1") >= 0
    cells = F.array_compact(
        F.array(
            F.struct(F.lit("root").alias("node_id"), F.when(inner, first).alias("sel")),
            F.when(inner, F.struct(first.alias("node_id"), F.when(F.col("c2") >= 0, second).alias("sel"))),
        )
    )
    return order_rows(spark, sf).select(F.inline(cells), *TREE_FEATURES)


@query(
    "r9_children_against_parent",
    f"""with {ORDER_TREE_SQL}, {Q.predicate_cte(Q.FULL_CORE, 'child', CHILD_SRC, TREE_FEATURES, 'node_id')}
        select regexp_extract(f.sel, '^(.*)/[^/]+$', 1) as node_id, f.sel, f.feature, {', '.join(f'round(f.{c}, 6) as {c}' for c in [*Q.BOUNDS, *Q.SCORES])},
        f.in_predicate, f.predicate_step, round(f.predicate_f1, 6) as predicate_f1, round(c.sel_min, 6) as core_min, round(c.sel_max, 6) as core_max
        from predicate f left join predicate c on f.sel = c.sel and f.feature = c.feature and c.t < 1 where f.t = 1 and f.in_predicate""",
)
def r9(spark, sf):
    return rounded(P.children_against_parents(child_rows(spark, sf), TREE_FEATURES))


@query(
    "r10_display_order",
    f"""with {Q.predicate_cte()} select sel, t, feature, cast(row_number() over (partition by sel, t, split
        order by in_predicate desc, clause_f1 desc, feature) as int) as position from predicate""",
)
def r10(spark, sf):
    rows = P.generate("db", flagged(spark, sf), LINE_FEATURES, Q.FULL_CORE)
    return P.display_order(rows).select("sel", "t", "feature", "position")


def active_rows(spark, sf, src=None):
    """Greedy and plain predicates side by side, with the flag that says which clauses count."""
    src = flagged(spark, sf) if src is None else src
    rows = P.generate("db", src, LINE_FEATURES, Q.FULL_CORE)
    keep = ["sel", "t", "feature", "sel_min", "sel_max"]
    return rows.select(*keep, F.lit("db").alias("method"), F.col("in_predicate").alias("active")).unionByName(
        rows.select(*keep, F.lit("threshold").alias("method"), F.lit(True).alias("active"))
    )


PLANTED_SRC = f"(select *, {QUANTITY_SEL} as planted from lineitem)"
ACTIVE_CTE = f"""{Q.predicate_cte(Q.FULL_CORE, 'planted', PLANTED_SRC)},
    act as (select sel, t, feature, ix, sel_min, sel_max, 'db' as method, in_predicate as active from predicate
            union all select sel, t, feature, ix, sel_min, sel_max, 'threshold', true from predicate),
    need as (select sel, t, method, sum(case when active then 1 << ix else 0 end)::int as mask, count_if(active) as length from act group by 1, 2, 3),
    admit as (select d.sel, d.t, d.method, sum(n) as predicted, sum(case when selected then n else 0 end) as tp
              from need d join sig s using (sel, t) where (s.mask & d.mask) = d.mask group by 1, 2, 3)"""


@query("r11_admitted_rows", f"with {ACTIVE_CTE} select sel, t, method, cast(predicted as bigint) as n_admitted, cast(tp as bigint) as n_members from admit")
def r11(spark, sf):
    src = planted(spark, sf)
    preds = active_rows(spark, sf, src)
    hit = P.admitted(src.withColumnRenamed("sel", "member"), LINE_FEATURES, preds, ["sel", "t", "method"], ["member"])
    return hit.groupBy("sel", "t", "method").agg(F.count("*").alias("n_admitted"), F.count_if(F.col("member") == F.col("sel")).alias("n_members"))


@query(
    "r12_predicate_quality",
    f"""with {ACTIVE_CTE}, q as (select d.sel, d.t, d.method, length, coalesce(tp, 0)::double as tp, coalesce(predicted, 0)::double as pp, actual::double as actual, total
          from need d left join admit using (sel, t, method) join tot using (sel, t))
        select sel, t, method, round({Q.F1}, 6) as f1, round(coalesce(tp / nullif(pp, 0), 0), 6) as precision, round(coalesce(tp / nullif(actual, 0), 0), 6) as recall,
        round(pp / total, 6) as coverage, cast(length as bigint) as length from q""",
)
def r12(spark, sf):
    src = planted(spark, sf)
    return rounded(P.quality(src, LINE_FEATURES, active_rows(spark, sf, src), ["sel", "t", "method"]))


@query(
    "r13_clauses_json",
    f"""with {Q.predicate_cte([(1.0, 'severity')])} select sel, t, split, count(*) as n_clauses, cast(count_if(in_predicate) as bigint) as n_used,
        string_agg(feature, ',' order by feature) as features from predicate group by 1, 2, 3""",
)
def r13(spark, sf):
    rows = P.generate("db", flagged(spark, sf), LINE_FEATURES, [(1.0, "severity")])
    packed = P.clauses_json(rows, ["sel", "t", "split"])
    schema = "array<struct<feature:string,sel_min:double,sel_max:double,in_predicate:boolean,step:int>>"
    back = packed.withColumn("c", F.from_json("clauses", schema))
    return back.select(
        "sel", "t", "split", F.size("c").cast("bigint").alias("n_clauses"),
        F.size(F.filter("c", lambda x: x["in_predicate"])).cast("bigint").alias("n_used"),
        F.array_join(F.transform("c", lambda x: x["feature"]), ",").alias("features"),
    )


TRUTH = [("bulk", "l_quantity"), ("bulk", "l_discount"), ("small", "l_extendedprice")]
RECOVERY = """round(coalesce(common / nullif(n_found, 0), 0), 6) as dim_precision, round(common / n_true, 6) as dim_recall,
   round(case when common > 0 then 2 * (common / n_found) * (common / n_true) / ((common / n_found) + (common / n_true)) else 0 end, 6) as dim_f1,
   cast(n_found as int) as n_dims_found"""


@query(
    "r14_dimension_recovery",
    f"""with {Q.predicate_cte(Q.FULL_CORE, 'planted', PLANTED_SRC)},
        truth as (select * from (values {', '.join(f"('{a}', '{b}')" for a, b in TRUTH)}) t(sel, feature)),
        sizes as (select sel, count(*)::double as n_true from truth group by 1),
        db as (select 'db' as method, p.sel, t, any_value(n_true) as n_true, count_if(in_predicate)::double as n_found,
               count_if(in_predicate and x.feature is not null)::double as common
               from predicate p join sizes using (sel) left join truth x on x.sel = p.sel and x.feature = p.feature group by p.sel, t),
        ranked as (select p.*, n_true, row_number() over (partition by p.sel, t order by sel_range / greatest(global_max - global_min, 1e-12), ix) as rn
               from predicate p join sizes using (sel)),
        th as (select 'threshold' as method, r.sel, t, any_value(n_true) as n_true, count_if(rn <= n_true)::double as n_found,
               count_if(rn <= n_true and x.feature is not null)::double as common
               from ranked r left join truth x on x.sel = r.sel and x.feature = r.feature group by r.sel, t)
        select method, sel, t, {RECOVERY} from (select * from db union all select * from th)""",
)
def r14(spark, sf):
    rows = P.generate("db", planted(spark, sf), LINE_FEATURES, Q.FULL_CORE)
    ix = F.array_position(F.array(*[F.lit(f) for f in LINE_FEATURES]), F.col("feature"))
    truth = spark.createDataFrame(TRUTH, "sel string, feature string")
    parts = [
        P.dimension_recovery(rows.withColumn("ix", ix), truth, m, ["sel", "t"]).withColumn("method", F.lit(m)) for m in ("db", "threshold")
    ]
    return rounded(parts[0].unionByName(parts[1]))
