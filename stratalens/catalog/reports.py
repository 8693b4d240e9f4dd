"""Paired tests and report tables. Result records are grouped out of lineitem, orders and events:
units are suppliers, replicates are line numbers, conditions are line states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import paired as P
from ..operators import reports as R
from . import query
from .inputs import lines, rounded, table

METRICS = ["trustworthiness", "continuity", "mrre_false", "mrre_missing", "stress"]

REGIONS = """regions as (select l_returnflag as dataset, case when l_linenumber <= 3 then 'PCA' else 'UMAP' end as method, 'leaf' as region_def,
  l_linenumber as seed, l_suppkey as region, case when l_linestatus = 'O' then 'hier' else 'flat' end as cond, count(*) as n,
  round(sum(l_discount * 100)) / count(*) as trustworthiness, round(sum(l_tax * 100)) / count(*) as continuity, sum(l_quantity) / count(*) as mrre_false,
  max(l_tax) as mrre_missing, round(avg(l_extendedprice), 2) as stress from lineitem group by all)"""


def regions(spark, sf):
    return (
        lines(spark, sf)
        .groupBy(
            F.col("l_returnflag").alias("dataset"), F.when(F.col("l_linenumber") <= 3, "PCA").otherwise("UMAP").alias("method"),
            F.lit("leaf").alias("region_def"), F.col("l_linenumber").alias("seed"), F.col("l_suppkey").alias("region"),
            F.when(F.col("l_linestatus") == "O", "hier").otherwise("flat").alias("cond"),
        )
        .agg(
            F.count("*").alias("n"), (F.round(F.sum(F.col("l_discount") * 100)) / F.count("*")).alias("trustworthiness"),
            (F.round(F.sum(F.col("l_tax") * 100)) / F.count("*")).alias("continuity"), (F.sum("l_quantity") / F.count("*")).alias("mrre_false"), F.max("l_tax").alias("mrre_missing"),
            F.round(F.avg("l_extendedprice"), 2).alias("stress"),
        )
    )


def compare_cte(name: str, by: str, higher: str = "true", source: str = "pairs") -> str:
    """CTE ``name``: effect sizes and signed-rank p (normal approximation, ties corrected) of ``source(by, d)``."""
    return f"""{name}_nz as (select {by}, d, rank() over (partition by {by} order by abs(d)) + (count(*) over (partition by {by}, abs(d)) - 1) / 2.0 as r,
      count(*) over (partition by {by}, abs(d)) as ties from {source} where d <> 0),
    {name}_w as (select {by}, count(*)::double as n_nonzero, sum(case when d > 0 then r else 0 end)::double as w_plus, sum(case when d < 0 then r else 0 end)::double as w_minus,
      sum(ties::double * ties - 1) as tie_term from {name}_nz group by all),
    {name}_z as (select *, abs(least(w_plus, w_minus) - n_nonzero * (n_nonzero + 1) / 4) / sqrt((n_nonzero * (n_nonzero + 1) * (2 * n_nonzero + 1) - tie_term / 2) / 24) / sqrt(2) as x from {name}_w),
    {name}_p as (select *, case when x > 6 then 0 when x = 0 then 1 else 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 400), lambda k:
        exp(2 * k * ln(2) + (2 * k + 1) * ln(x) + lgamma(k + 1) - lgamma(2 * k + 2) - x * x))) end as wilcoxon_p from {name}_z),
    {name}_e as (select {by}, count(*) as n_pairs, quantile_cont(d, 0.5) as median_delta, avg(case when (case when {higher} then d > 0 else d < 0 end) then 1.0 else 0.0 end) as win_rate,
      (count_if(case when {higher} then d > 0 else d < 0 end) - count_if(case when {higher} then d < 0 else d > 0 end))::double / nullif(count_if(d <> 0), 0) as rank_biserial from {source} group by all),
    {name} as (select e.*, wilcoxon_p from {name}_e e left join {name}_p using ({by}))"""


PAIRS = f"""{REGIONS}, sided as (select dataset, method, seed, region, max(case when cond = 'hier' then trustworthiness end) as first_value,
   max(case when cond = 'flat' then trustworthiness end) as second_value from regions group by all),
   pairs as (select *, first_value - second_value as d from sided where first_value is not null and second_value is not null)"""


def trust_pairs(spark, sf):
    return P.paired_differences(regions(spark, sf), ["seed", "region"], "cond", "hier", "flat", "trustworthiness", ["dataset", "method"])


BY = ["dataset", "method"]


@query("t1_paired_differences", f"with {PAIRS} select dataset, method, seed, region, round(first_value, 6) as first_value, round(second_value, 6) as second_value, round(d, 6) as d from pairs")
def t1(spark, sf):
    return rounded(trust_pairs(spark, sf))


@query(
    "t2_effect_sizes",
    f"with {PAIRS}, {compare_cte('c', 'dataset, method', 'false')} select dataset, method, n_pairs, round(median_delta, 6) as median_delta, round(win_rate, 6) as win_rate from c",
)
def t2(spark, sf):
    return rounded(P.effect_sizes(trust_pairs(spark, sf), BY, higher=False).drop("rank_biserial"))


@query(
    "t3_signed_rank",
    f"with {PAIRS}, {compare_cte('c', 'dataset, method')} select dataset, method, cast(n_nonzero as bigint) as n_nonzero, w_plus, w_minus, tie_term, round(wilcoxon_p, 6) as wilcoxon_p from c_p",
)
def t3(spark, sf):
    return rounded(P.signed_rank(trust_pairs(spark, sf), BY))


@query("t4_rank_biserial", f"with {PAIRS}, {compare_cte('c', 'dataset, method')} select dataset, method, round(rank_biserial, 6) as rank_biserial from c")
def t4(spark, sf):
    return rounded(P.effect_sizes(trust_pairs(spark, sf), BY).select(*BY, "rank_biserial"))


@query(
    "t5_holm",
    f"""with {PAIRS}, {compare_cte('c', 'dataset, method')}, r as (select *, row_number() over (order by wilcoxon_p) as rn, count(*) over () as m from c where wilcoxon_p is not null)
        select dataset, method, round(least(1, max((m - rn + 1) * wilcoxon_p) over (order by rn)), 6) as p_holm from r""",
)
def t5(spark, sf):
    tested = P.compare_pairs(trust_pairs(spark, sf), BY).withColumn("family", F.lit("all"))
    return rounded(P.holm(tested, ["family"]).select(*BY, "p_holm"))


STABILITY = """recs as (select l_returnflag as arm, case when l_linenumber % 2 = 0 then 'db' else 'threshold' end as method,
  case when l_linestatus = 'O' then 'severity' else 'symmetric' end as split, case when l_partkey % 2 = 0 then 0.1 else 0.05 end::double as delta,
  case when l_tax < 0.03 then 1.0 when l_tax < 0.06 then 0.95 else 0.9 end::double as t, l_linenumber as seed, l_suppkey as sel_id,
  round(avg(l_discount) * 10, 4) as jaccard_admitted, round(avg(l_quantity) / 50, 4) as f1_sd, round(avg(l_extendedprice) / 100000, 4) as f1,
  round(avg(l_discount), 4) as coverage from lineitem group by all)"""


def stability_records(spark, sf):
    tax = F.col("l_tax")
    return (
        lines(spark, sf)
        .groupBy(
            F.col("l_returnflag").alias("arm"), F.when(F.col("l_linenumber") % 2 == 0, "db").otherwise("threshold").alias("method"),
            F.when(F.col("l_linestatus") == "O", "severity").otherwise("symmetric").alias("split"),
            F.when(F.col("l_partkey") % 2 == 0, 0.1).otherwise(0.05).alias("delta"),
            F.when(tax < 0.03, 1.0).when(tax < 0.06, 0.95).otherwise(0.9).alias("t"),
            F.col("l_linenumber").alias("seed"), F.col("l_suppkey").alias("sel_id"),
        )
        .agg(
            F.round(F.avg("l_discount") * 10, 4).alias("jaccard_admitted"), F.round(F.avg("l_quantity") / 50, 4).alias("f1_sd"),
            F.round(F.avg("l_extendedprice") / 100000, 4).alias("f1"), F.round(F.avg("l_discount"), 4).alias("coverage"),
        )
    )


SUMMARY = f"""{STABILITY}, vals as (select arm, method, split, delta, 'jaccard_admitted' as metric, t, seed, sel_id, jaccard_admitted as value from recs
    union all select arm, method, split, delta, 'f1_sd', t, seed, sel_id, f1_sd from recs),
  base as (select * exclude (t), value as strict_value from vals where t = 1),
  pairs as (select v.arm, v.method, v.split, v.delta, v.metric, v.t, v.seed, v.sel_id, v.value - b.strict_value as d from vals v
    join base b using (arm, method, split, delta, metric, seed, sel_id) where v.t < 1),
  {compare_cte('c', 'arm, method, split, delta, metric, t', "metric = 'jaccard_admitted'")},
  med as (select arm, method, split, delta, t, quantile_cont(f1, 0.5) as median_f1, quantile_cont(coverage, 0.5) as median_coverage from recs group by all),
  u as (select arm, method, split, delta, metric, t, count(distinct sel_id) as n_selections, count(distinct seed) as n_seeds from pairs group by all),
  own as (select arm, method, split, delta, metric, t, quantile_cont(value, 0.5) as median_value from vals group by all),
  ranked as (select c.*, n_selections, n_seeds, o.median_value, s.median_value as median_strict, m.median_f1, m.median_coverage, m.median_f1 / nullif(m1.median_f1, 0) as f1_ratio,
      row_number() over (partition by c.arm, c.method, c.split, c.delta, c.metric order by wilcoxon_p nulls last, c.t desc) as rn,
      count(wilcoxon_p) over (partition by c.arm, c.method, c.split, c.delta, c.metric) as m
      from c join u using (arm, method, split, delta, metric, t) join own o using (arm, method, split, delta, metric, t)
      join (select * exclude (t) from own where t = 1) s using (arm, method, split, delta, metric)
      join med m using (arm, method, split, delta, t) join (select * exclude (t) from med where t = 1) m1 using (arm, method, split, delta)),
  summary as (select *, case when wilcoxon_p is not null then least(1, max((m - rn + 1) * wilcoxon_p) over (partition by arm, method, split, delta, metric order by rn)) end as p_holm from ranked)"""

SUMMARY_NUMBERS = ["median_delta", "win_rate", "rank_biserial", "wilcoxon_p", "median_value", "median_strict", "median_f1", "median_coverage", "f1_ratio", "p_holm"]


@query(
    "t6_stability_summary",
    f"with {SUMMARY} select arm, method, split, delta, metric, t, n_pairs, n_selections, n_seeds, {', '.join(f'round({c}, 6) as {c}' for c in SUMMARY_NUMBERS)} from summary",
)
def t6(spark, sf):
    return rounded(R.stability_summary(stability_records(spark, sf)))


@query(
    "t7_operating_points",
    f"""with {SUMMARY}, j as (select *, median_delta > 0 and p_holm < 0.05 and f1_ratio >= 0.9 as good from summary where metric = 'jaccard_admitted')
        select arm, method, split, delta, max(case when good then t end) as t_star, coalesce(bool_or(good), false) as supported, max(n_pairs) as n_pairs,
        max(n_selections) as n_selections, max(n_seeds) as n_seeds from j group by all""",
)
def t7(spark, sf):
    return R.operating_points(R.stability_summary(stability_records(spark, sf)))


@query(
    "t8_split_summary",
    f"""with {STABILITY}, s as (select arm, method, t, seed, sel_id, max(case when split = 'severity' then f1 end) as a, max(case when split = 'symmetric' then f1 end) as b
          from recs where delta = 0.1 and t <> 1 group by all), pairs as (select *, a - b as d from s where a is not null and b is not null),
        {compare_cte('c', 'arm, method, t')}
        select arm, method, t, n_pairs, round(median_delta, 6) as median_diff, round(win_rate, 6) as win_rate, round(rank_biserial, 6) as rank_biserial, round(wilcoxon_p, 6) as wilcoxon_p from c""",
)
def t8(spark, sf):
    return rounded(R.split_summary(stability_records(spark, sf), 0.1))


@query(
    "t9_matched_leaf_summary",
    """with m as (select l_returnflag as method, l_linenumber as t, l_suppkey, round(avg(l_discount) * 10, 4) as jaccard_admitted, round(avg(l_quantity) / 50, 4) as match_jaccard from lineitem group by all),
       w as (select method, avg(case when match_jaccard < 0.5 then 1.0 else 0.0 end) as weak from m group by 1)
       select method, t, count(*) as n_matched_pairs, round(avg(jaccard_admitted), 6) as mean_jaccard_admitted, round(quantile_cont(jaccard_admitted, 0.5), 6) as median_jaccard_admitted,
       round(avg(match_jaccard), 6) as mean_match_jaccard, round(any_value(weak), 6) as weak_match_frac from m join w using (method) where match_jaccard >= 0.5 group by 1, 2""",
)
def t9(spark, sf):
    m = lines(spark, sf).groupBy(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("t"), "l_suppkey").agg(
        F.round(F.avg("l_discount") * 10, 4).alias("jaccard_admitted"), F.round(F.avg("l_quantity") / 50, 4).alias("match_jaccard")
    )
    return rounded(R.matched_leaf_summary(m.withColumn("weak_match", F.col("match_jaccard") < 0.5)))


@query(
    "t10_own_versus_global",
    f"""with {REGIONS}, long as ({' union all '.join(f"select dataset, method, region_def, seed, region, cond, '{m}' as metric, {m} as value from regions" for m in METRICS)}),
        s as (select dataset, method, region_def, metric, seed, region, max(case when cond = 'hier' then value end) as a, max(case when cond = 'flat' then value end) as b from long group by all),
        pairs as (select *, a - b as d from s where a is not null and b is not null),
        {compare_cte('c', 'dataset, method, region_def, metric', "metric <> 'stress'")}
        select dataset, method, region_def, metric, n_pairs, round(median_delta, 6) as median_delta, round(win_rate, 6) as win_rate, round(rank_biserial, 6) as rank_biserial,
        round(wilcoxon_p, 6) as wilcoxon_p, metric in ('trustworthiness', 'continuity') as "primary" from c""",
)
def t10(spark, sf):
    return rounded(R.own_versus_global(regions(spark, sf)))


PLANTED = """recs as (select l_linenumber as rho, case when l_returnflag = 'N' then 'non_nested' else 'nested' end as nesting, l_suppkey as seed,
   case l_partkey % 3 when 0 then 'hierarchical' when 1 then 'flat_full' else 'oracle_conditional' end as condition, round(avg(l_discount) * 10, 4) as within_g_ari from lineitem group by all)"""


def planted_records(spark, sf):
    kind = F.col("l_partkey") % 3
    return (
        lines(spark, sf)
        .groupBy(
            F.col("l_linenumber").alias("rho"), F.when(F.col("l_returnflag") == "N", "non_nested").otherwise("nested").alias("nesting"), F.col("l_suppkey").alias("seed"),
            F.when(kind == 0, "hierarchical").when(kind == 1, "flat_full").otherwise("oracle_conditional").alias("condition"),
        )
        .agg(F.round(F.avg("l_discount") * 10, 4).alias("within_g_ari"))
    )


@query(
    "t11_planted_summary",
    f"""with {PLANTED}, w as (select rho, nesting, seed, max(case when condition = 'hierarchical' then within_g_ari end) as tree, max(case when condition = 'flat_full' then within_g_ari end) as flat,
          max(case when condition = 'oracle_conditional' then within_g_ari end) as oracle from recs group by all),
        pairs as (select *, tree - flat as d from w where tree is not null and flat is not null), {compare_cte('c', 'rho, nesting')},
        m as (select rho, nesting, count(oracle) as n_oracle, avg(tree) as hier_mean, avg(flat) as flat_mean, avg(oracle) as om from pairs group by all),
        s as (select rho, nesting, count(*) as n_seeds from w group by all)
        select rho, nesting, n_pairs, round(median_delta, 6) as median_delta, round(win_rate, 6) as win_rate, round(rank_biserial, 6) as rank_biserial, round(wilcoxon_p, 6) as wilcoxon_p,
        n_oracle, round(hier_mean, 6) as hier_mean, round(flat_mean, 6) as flat_mean, n_seeds, round(hier_mean / nullif(om, 0), 6) as oracle_relative
        from c join m using (rho, nesting) join s using (rho, nesting)""",
)
def t11(spark, sf):
    return rounded(R.planted_summary(planted_records(spark, sf)))


@query(
    "t12_drop_repeated_control",
    f"""with {PLANTED}, low as (select min(rho) as m from recs where nesting = 'non_nested')
        select nesting, rho, count(*) as n_rows, (select count(*) from recs, low where nesting = 'non_nested' and rho <> m) as n_dropped
        from recs, low where nesting <> 'non_nested' or rho = m group by 1, 2""",
)
def t12(spark, sf):
    kept, dropped = R.drop_repeated_control(planted_records(spark, sf), F.col("nesting") == "non_nested", "rho")
    n = dropped.head()["n_dropped"]
    return kept.groupBy("nesting", "rho").agg(F.count("*").alias("n_rows")).withColumn("n_dropped", F.lit(n).cast("bigint"))


@query(
    "t13_crossover",
    """select l_returnflag, min(case when m < 0.51 then l_linenumber end) as crossover from
       (select l_returnflag, l_linenumber, avg(l_quantity) / 50 as m from lineitem group by all) group by 1""",
)
def t13(spark, sf):
    src = lines(spark, sf).withColumn("share", F.col("l_quantity") / 50)
    return R.crossover(src, "l_linenumber", "share", 0.51, ["l_returnflag"])


@query("t14_gap_table", f"with {PAIRS} select dataset, round(avg(d), 6) as mean, round(quantile_cont(d, 0.5), 6) as median, count(d) as count from pairs group by 1")
def t14(spark, sf):
    return rounded(R.gap_table(trust_pairs(spark, sf), "d", ["dataset"]))


def order_summary(spark, sf, parity):
    """Orders of the even or the odd years per customer; both together are the whole table."""
    o = table(spark, sf, "orders").where(F.year("o_orderdate") % 2 == parity)
    return o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.floor(F.max("o_totalprice")).cast("bigint").alias("top"))


@query(
    "t15_table_diff",
    """with s as (select extract(year from o_orderdate) % 2 as parity, o_custkey, count(*) as n, cast(floor(max(o_totalprice)) as bigint) as top from orders group by all),
       a as (select * from s where parity = 0), b as (select * from s where parity = 1)
       select a.o_custkey, '(whole row)' as "column", 'dropped' as kind, null::varchar as "old", null::varchar as "new" from a anti join b using (o_custkey)
       union all select b.o_custkey, '(whole row)', 'added', null, null from b anti join a using (o_custkey)
       union all select o_custkey, 'n', 'changed', a.n::varchar, b.n::varchar from a join b using (o_custkey) where a.n <> b.n
       union all select o_custkey, 'top', 'changed', a.top::varchar, b.top::varchar from a join b using (o_custkey) where a.top <> b.top""",
)
def t15(spark, sf):
    return R.table_diff(order_summary(spark, sf, 0), order_summary(spark, sf, 1), ["o_custkey"], ["n", "top"])


@query(
    "t16_verdict_flips",
    """select l_suppkey, l_linenumber, p_old, p_new from (select l_suppkey, l_linenumber, round(avg(l_discount), 4) as p_old, round(avg(l_tax), 4) as p_new from lineitem group by all)
       where (p_old < 0.05) <> (p_new < 0.05)""",
)
def t16(spark, sf):
    p = lambda c: lines(spark, sf).groupBy("l_suppkey", "l_linenumber").agg(F.round(F.avg(c), 4).alias("wilcoxon_p"))
    return R.verdict_flips(p("l_discount"), p("l_tax"), ["l_suppkey", "l_linenumber"])


@query(
    "t18_counted_left_join",
    """select count(*) as n_rows, cast(count_if(o_custkey is null) as bigint) as n_unmatched from customer left join
       (select distinct user_id as o_custkey from events) on c_custkey = o_custkey""",
)
def t18(spark, sf):
    tuned = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias("best"))
    return R.attach_counting_misses(table(spark, sf, "customer"), tuned, ["c_custkey"], "matched")[1]


@query("t19_pearson", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as pearson_r, count(*) as n from lineitem group by 1")
def t19(spark, sf):
    return rounded(P.pearson(lines(spark, sf), "l_quantity", "l_extendedprice", ["l_returnflag"]))


@query(
    "t20_spearman",
    f"""with {REGIONS}, x as (select dataset, (trustworthiness + continuity) / 2 as tc, mrre_false as purity from regions),
        r as (select dataset, rank() over (partition by dataset order by tc) + (count(*) over (partition by dataset, tc) - 1) / 2.0 as rx,
          rank() over (partition by dataset order by purity) + (count(*) over (partition by dataset, purity) - 1) / 2.0 as ry from x)
        select dataset, round(corr(rx, ry), 6) as spearman_rho, count(*) as n_leaves from r group by 1""",
)
def t20(spark, sf):
    x = regions(spark, sf).select("dataset", ((F.col("trustworthiness") + F.col("continuity")) / 2).alias("tc"), F.col("mrre_false").alias("purity"))
    return rounded(P.spearman(x, "tc", "purity", ["dataset"]))


@query(
    "t21_running_best",
    "select event_type, user_id, event_id, value, max(value) over (partition by event_type, user_id order by event_id) as best_so_far from events",
)
def t21(spark, sf):
    e = table(spark, sf, "events").select("event_type", "user_id", "event_id", "value")
    return R.running_best(e, "value", ["event_type", "user_id"], "event_id")


@query(
    "t22_gains",
    """select o_custkey, baseline, best, round(best - baseline, 6) as gain, round(100.0 * (best - baseline) / case when baseline <> 0 then abs(baseline) else 1 end, 6) as gain_pct
       from (select o_custkey, min(o_totalprice - 1500) as baseline, max(o_totalprice) as best from orders group by 1)""",
)
def t22(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.col("o_totalprice") - 1500).alias("baseline"), F.max("o_totalprice").alias("best"))
    return rounded(R.gains(o))


@query(
    "t23_degenerate_runs",
    """select run, round(case when n % 4 = 0 then -1.0 else m / 100 end, 6) as objective,
       leaves < 2 or n % 4 = 0 or n % 7 = 0 or noise >= 0.25 or cover < 0.8 as degenerate from (select l_suppkey as run, count(*) as n, avg(l_quantity) as m,
       count(distinct l_returnflag) as leaves, avg(case when l_discount < 0.02 then 1.0 else 0.0 end) as noise, avg(case when l_tax < 0.07 then 1.0 else 0.0 end) as cover from lineitem group by 1)""",
)
def t23(spark, sf):
    share = lambda c: F.avg(c.cast("double"))
    g = lines(spark, sf).groupBy(F.col("l_suppkey").alias("run")).agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.count_distinct("l_returnflag").alias("n_leaves"),
        share(F.col("l_discount") < 0.02).alias("noise_frac"), share(F.col("l_tax") < 0.07).alias("scored_coverage"),
    )
    g = g.withColumns({
        "raw": F.when(F.col("n") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("m") / 100),
        "dbcv_leaf": F.when(F.col("n") % 4 != 0, F.col("m")), "tnc_mean": F.when(F.col("n") % 7 != 0, F.col("m")),
    })
    return rounded(g.select("run", R.finite_or_worst("raw", -1.0).alias("objective"), R.degenerate(max_noise=0.25).alias("degenerate")))


TRIALS = """trials as (select l_returnflag as dataset, l_suppkey as trial, round(avg(l_discount) * 10, 4) as dbcv_leaf, round(avg(l_tax) * 10, 4) as tnc_mean,
  round(avg(l_quantity), 2) as build_seconds, max(l_linenumber) as hierarchical_layers from lineitem group by all)"""


def trials(spark, sf):
    return lines(spark, sf).groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("trial")).agg(
        F.round(F.avg("l_discount") * 10, 4).alias("dbcv_leaf"), F.round(F.avg("l_tax") * 10, 4).alias("tnc_mean"),
        F.round(F.avg("l_quantity"), 2).alias("build_seconds"), F.max("l_linenumber").alias("hierarchical_layers"),
    )


@query(
    "t24_non_dominated",
    f"""with {TRIALS}, front as (select * from trials a where not exists (select 1 from trials b where a.dataset = b.dataset and b.dbcv_leaf >= a.dbcv_leaf and b.tnc_mean >= a.tnc_mean
          and (b.dbcv_leaf > a.dbcv_leaf or b.tnc_mean > a.tnc_mean))), fl as (select dataset, avg(tnc_mean) as floor from trials group by 1),
        pick as (select * from (select f.*, row_number() over (partition by dataset order by dbcv_leaf desc, build_seconds, hierarchical_layers, trial) as rn from front f join fl using (dataset)
          where tnc_mean >= floor - 0.01) where rn = 1)
        select f.dataset, f.trial, f.dbcv_leaf, f.tnc_mean, p.trial is not null as picked from front f left join pick p on p.dataset = f.dataset and p.trial = f.trial""",
)
def t24(spark, sf):
    t = trials(spark, sf)
    front = R.non_dominated(t, "dbcv_leaf", "tnc_mean", ["dataset"])
    floor = t.groupBy("dataset").agg(F.avg("tnc_mean").alias("floor"))
    pick = R.pick_candidate(front, ["dataset"], floor).select("dataset", "trial", F.lit(True).alias("hit"))
    return front.join(pick, ["dataset", "trial"], "left").select("dataset", "trial", "dbcv_leaf", "tnc_mean", F.coalesce("hit", F.lit(False)).alias("picked"))


RUNS = """runs as (select l_suppkey as dataset, l_linenumber as build, case when l_linestatus = 'F' then 'baseline' else 'preset' end as arm, 'test' as split,
  round(min(l_discount) + max(l_tax), 4) as dbcv_leaf, round(avg(l_tax) * 10, 4) as tnc_mean, round(avg(l_quantity), 2) as build_seconds, round(avg(l_discount), 4) as noise_frac,
  round(avg(l_tax), 4) as ari, round(avg(l_quantity), 2) as median_leaf_size, case when max(l_quantity) = 50 and count(*) % 6 = 0 then 'error' end as exception from lineitem group by all)"""


@query(
    "t25_acceptance",
    f"""with {RUNS}, w as (select dataset, max(case when arm = 'baseline' then dbcv_leaf end) as bd, min(case when arm = 'preset' then dbcv_leaf end) as pd,
          avg(case when arm = 'baseline' then tnc_mean end) as bt, avg(case when arm = 'preset' then tnc_mean end) as pt,
          quantile_cont(case when arm = 'baseline' then build_seconds end, 0.5) as bs, quantile_cont(case when arm = 'preset' then build_seconds end, 0.5) as ps,
          avg(case when arm = 'baseline' then noise_frac end) as bn, avg(case when arm = 'preset' then noise_frac end) as pn,
          avg(case when arm = 'baseline' then ari end) as ba, avg(case when arm = 'preset' then ari end) as pa,
          count_if(arm = 'preset' and exception is null) as ok, min(case when arm = 'preset' then median_leaf_size end) as leaf from runs group by 1),
        r as (select dataset, coalesce(pd > bd, false) as a1_separation, coalesce(pt >= bt - 0.01, false) as a2_view, coalesce(ps <= least(180, 3 * bs), false) as a3_interactive,
          ok = 7 as a4_reliable, coalesce(leaf >= 21 and pn <= bn + 0.05, false) as a5_granularity, coalesce(pa >= ba - 0.05, true) as a6_labels from w)
        select *, a1_separation and a2_view and a3_interactive and a4_reliable and a5_granularity and a6_labels as adopted from r""",
)
def t25(spark, sf):
    return R.acceptance(build_runs(spark, sf), ["dataset"], n_validation=7)


def build_runs(spark, sf, *more):
    return lines(spark, sf).groupBy(
        F.col("l_suppkey").alias("dataset"), F.col("l_linenumber").alias("build"),
        F.when(F.col("l_linestatus") == "F", "baseline").otherwise("preset").alias("arm"), F.lit("test").alias("split"),
    ).agg(
        F.round(F.min("l_discount") + F.max("l_tax"), 4).alias("dbcv_leaf"), F.round(F.avg("l_tax") * 10, 4).alias("tnc_mean"),
        F.round(F.avg("l_quantity"), 2).alias("build_seconds"), F.round(F.avg("l_discount"), 4).alias("noise_frac"), F.round(F.avg("l_tax"), 4).alias("ari"),
        F.round(F.avg("l_quantity"), 2).alias("median_leaf_size"),
        F.when((F.max("l_quantity") == 50) & (F.count("*") % 6 == 0), "error").alias("exception"), *more,
    )


@query(
    "t25_acceptance_numbers",
    f"""with {RUNS.replace(" as exception", " as exception, count(*) as n_leaves, cast(sum(case when l_discount = 0 then 1 else 0 end) as bigint) as unembedded_nodes")}
        select dataset, round(avg(case when arm = 'baseline' then dbcv_leaf end), 6) as baseline_dbcv_mean, round(avg(case when arm = 'preset' then dbcv_leaf end), 6) as preset_dbcv_mean,
          round(avg(case when arm = 'baseline' then tnc_mean end), 6) as baseline_tnc_mean, round(avg(case when arm = 'preset' then tnc_mean end), 6) as preset_tnc_mean,
          round(avg(case when arm = 'baseline' then ari end), 6) as baseline_ari_mean, round(avg(case when arm = 'preset' then ari end), 6) as preset_ari_mean,
          round(avg(case when arm = 'baseline' then noise_frac end), 6) as baseline_noise_mean, round(avg(case when arm = 'preset' then noise_frac end), 6) as preset_noise_mean,
          round(max(case when arm = 'baseline' then dbcv_leaf end), 6) as baseline_dbcv_max, round(min(case when arm = 'preset' then dbcv_leaf end), 6) as preset_dbcv_min,
          coalesce(array_to_string(list(n_leaves order by n_leaves) filter (arm = 'baseline'), ','), '') as baseline_leaves, coalesce(array_to_string(list(n_leaves order by n_leaves) filter (arm = 'preset'), ','), '') as preset_leaves,
          coalesce(cast(sum(case when arm = 'baseline' then unembedded_nodes end) as bigint), 0) as baseline_unembedded_nodes, coalesce(cast(sum(case when arm = 'preset' then unembedded_nodes end) as bigint), 0) as preset_unembedded_nodes,
          round(quantile_cont(case when arm = 'baseline' then build_seconds end, 0.5), 6) as baseline_seconds_median, round(quantile_cont(case when arm = 'preset' then build_seconds end, 0.5), 6) as preset_seconds_median
        from runs group by 1""",
)
def t25_numbers(spark, sf):
    runs = build_runs(spark, sf, F.count("*").alias("n_leaves"), F.count_if(F.col("l_discount") == 0).alias("unembedded_nodes"))
    out = R.acceptance_numbers(runs, ["dataset"])
    lists = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("baseline_leaves", "preset_leaves")}
    return rounded(out.withColumns(lists))


MEDIAN_BOUNDS = [("click", 40.0, None), ("view", 1.0, 45.0), ("error", 60.0, None), ("signup", 0.0, 1000.0)]


@query(
    "t26_median_check",
    f"""with b as (select * from (values {', '.join('(' + ', '.join('null' if v is None else repr(v) for v in r) + ')' for r in MEDIAN_BOUNDS)}) t(event_type, lo, ceiling)),
        m as (select event_type, count(value) as n, quantile_cont(value, 0.5) as median from events group by 1),
        s as (select event_type, quantile_cont(m, 0.5) as mm from (select event_type, user_id, quantile_cont(value, 0.5) as m from events group by 1, 2) group by 1)
        select event_type, n, round(median, 6) as median, round(mm, 6) as median_of_stage_medians, case when median >= lo and (ceiling is null or median < ceiling) then 'pass' else 'fail' end as verdict
        from m join s using (event_type) join b using (event_type)""",
)
def t26_median(spark, sf):
    bounds = spark.createDataFrame(MEDIAN_BOUNDS, "event_type string, lo double, ceiling double")
    return rounded(R.median_check(table(spark, sf, "events").select("event_type", "user_id", "value"), bounds, ["event_type"], ["user_id"]))


PAIR_RULES = [("A", 64, None, None, None, None), ("N", 40, None, None, None, None), ("R", 64, 20.0, 30.0, 20.0, 30.0)]


@query(
    "t26_median_pairs",
    f"""with u as (select * from (values {', '.join('(' + ', '.join('null' if v is None else repr(v) for v in r) + ')' for r in PAIR_RULES)}) t(l_returnflag, dims, sl, sh, rl, rh)),
        m as (select l_returnflag, count(case when l_linenumber = 1 then 1 end) as n_strict, count(case when l_linenumber = 4 then 1 end) as n_relaxed,
          quantile_cont(case when l_linenumber = 1 then l_quantity end, 0.5) as s, quantile_cont(case when l_linenumber = 4 then l_quantity end, 0.5) as r from lineitem group by 1)
        select l_returnflag, n_strict, n_relaxed, round(s, 6) as strict_median, round(r, 6) as relaxed_median,
          case when case when sl is not null then s between sl and sh and r between rl and rh else r < s and s < dims / 2 end then 'pass' else 'fail' end as verdict from m join u using (l_returnflag)""",
)
def t26_pairs(spark, sf):
    rules = spark.createDataFrame(PAIR_RULES, "l_returnflag string, dims int, strict_lo double, strict_hi double, relaxed_lo double, relaxed_hi double")
    values = lines(spark, sf).withColumn("value", F.col("l_quantity"))
    return rounded(R.median_pair_check(values, ["l_returnflag"], "l_linenumber", 1, 4, rules))


DELTAS = "records as (select event_type as dataset, user_id % 3 <> 0 as eligible, case when user_id % 7 <> 0 then round((value - 50) / 1000, 4) end as d, value / 100 as second from events)"


def deltas(spark, sf):
    d = F.when(F.col("user_id") % 7 != 0, F.round((F.col("value") - 50) / 1000, 4))
    return table(spark, sf, "events").select(F.col("event_type").alias("dataset"), (F.col("user_id") % 3 != 0).alias("eligible"), d.alias("d"), (F.col("value") / 100).alias("second"))


@query(
    "t27_pooled_groups",
    f"""with {DELTAS} select dataset, round(quantile_cont(d, 0.5), 6) as median, round(avg(case when d > 0 then 1.0 else 0 end), 6) as win_rate, count(*) as n from records where eligible and d is not null group by 1""",
)
def t27_groups(spark, sf):
    return rounded(R.pooled_report(deltas(spark, sf), ["dataset"])[1])


@query(
    "t27_pooled_row",
    f"""with {DELTAS}, one as (select 1 as k, d from records where eligible and d is not null), {compare_cte('c', 'k', source='one')}
        select n_pairs, round(median_delta, 6) as median_delta, round(win_rate, 6) as win_rate, round(wilcoxon_p, 6) as wilcoxon_p,
          case when median_delta > 0 and median_delta <= 0.05 and win_rate between 0.5 and 0.8 then 'pass' else 'fail' end as verdict,
          (select round(quantile_cont(second, 0.5), 6) from records where eligible and d is not null) as median_second, (select count(*) from records where eligible and d is null) as n_unscored from c""",
)
def t27_row(spark, sf):
    return rounded(R.pooled_report(deltas(spark, sf), ["dataset"])[0])


BOUNDS = [("click", 0.0, 500.0, 0.0, 600.0), ("view", 1.0, 300.0, 0.0, 400.0), ("error", 0.0, 100.0, 0.0, 150.0), ("signup", None, 400.0, None, 450.0)]


@query(
    "t26_bound_check",
    f"""with b as (select * from (values {', '.join('(' + ', '.join('null' if v is None else repr(v) for v in r) + ')' for r in BOUNDS)}) t(event_type, lo, hi, blo, bhi))
        select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as median, case when bool_and(value >= coalesce(lo, -1e300) and value <= hi) then 'pass'
        when bool_and(value >= coalesce(blo, -1e300) and value <= bhi) then 'excursion' else 'fail' end as verdict from events join b using (event_type) group by 1""",
)
def t26(spark, sf):
    bounds = spark.createDataFrame(BOUNDS, "event_type string, lo double, hi double, band_lo double, band_hi double")
    return rounded(R.bound_check(table(spark, sf, "events").select("event_type", "value"), bounds, ["event_type"]))


@query(
    "t27_pooled_check",
    f"""with {PAIRS}, one as (select 1 as k, d from pairs), {compare_cte('c', 'k', source='one')} select n_pairs, round(median_delta, 6) as median_delta, round(win_rate, 6) as win_rate,
        round(wilcoxon_p, 6) as wilcoxon_p, case when median_delta > 0 and median_delta <= 0.05 and win_rate between 0.5 and 0.8 then 'pass' else 'fail' end as verdict from c""",
)
def t27(spark, sf):
    return rounded(R.pooled_check(trust_pairs(spark, sf)))


@query(
    "t30_example_leaf",
    """with leaves as (select l_returnflag as dataset, l_linenumber as build, l_suppkey as leaf_id, count(*) as leaf_n from lineitem group by all),
       shape as (select dataset, build, count(*) as n_leaves from leaves group by all), mid as (select dataset, floor(quantile_cont(n_leaves, 0.5)) as m from shape group by 1),
       b as (select * from (select dataset, build, row_number() over (partition by dataset order by abs(n_leaves - m), build) as rn from shape join mid using (dataset)) where rn = 1),
       r as (select l.*, row_number() over (partition by dataset order by leaf_n, leaf_id) - 1 as k, count(*) over (partition by dataset) as n from leaves l join b using (dataset, build))
       select dataset, build, leaf_id, leaf_n from r where k = n // 2""",
)
def t30(spark, sf):
    leaves = lines(spark, sf).groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("build"), F.col("l_suppkey").alias("leaf_id")).agg(F.count("*").alias("leaf_n"))
    shapes = leaves.groupBy("dataset", "build").agg(F.count("*").alias("n_leaves"))
    return R.example_leaf(shapes, leaves, ["dataset"])


@query(
    "t31_skipped_regions",
    f"""with {REGIONS}, per as (select dataset, seed, region, sum(n) as n, count(distinct cond) as arms from regions group by all),
        k as (select dataset, seed, region, count(distinct n) as nk from regions group by all)
        select dataset, seed, region, cast(n as bigint) as n, case when n < 10 then 'too_small' else 'not_scored' end as reason,
        (select count(*) from k) as n_regions, (select cast(count_if(nk > 1) as bigint) from k) as n_violations from per where n < 20 or arms < 2""",
)
def t31(spark, sf):
    reg = regions(spark, sf)
    keys = ["dataset", "seed", "region"]
    per = reg.groupBy(*keys).agg(F.sum("n").alias("n"), F.count_distinct("cond").alias("arms"))
    scored = per.where((F.col("n") >= 20) & (F.col("arms") == 2))
    check = R.unequal_k(reg.withColumn("k", F.col("n")), keys).head()
    return R.skip_table(per, scored, keys, 10).withColumns({"n_regions": F.lit(check["n_regions"]).cast("bigint"), "n_violations": F.lit(check["n_violations"]).cast("bigint")})


@query(
    "t32_best_configuration",
    f"""with {TRIALS} select dataset, trial, dbcv_leaf from (select *, row_number() over (partition by dataset order by case when trial % 9 = 0 then -1.0 else dbcv_leaf end desc, trial) as rn from trials) where rn = 1""",
)
def t32(spark, sf):
    t = trials(spark, sf).withColumn("score", F.when(F.col("trial") % 9 != 0, F.col("dbcv_leaf")))
    return R.best_configurations(t, "score", ["dataset"], -1.0, "trial").select("dataset", "trial", "dbcv_leaf")


@query("t33_mean_by_method", f"with {REGIONS} select dataset, method, round(avg(trustworthiness), 6) as mean_trustworthiness from regions group by 1, 2")
def t33(spark, sf):
    return rounded(R.mean_by(regions(spark, sf), "trustworthiness", ["dataset", "method"]))
