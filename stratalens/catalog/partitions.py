"""Agreement of partitions: quantity bands of lineitem as classes, other bands as clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import partitions as P
from . import query
from .inputs import lines, rounded

ROWS_SQL = """t as (select l_returnflag as grp, cast(floor(l_quantity / 10) as int) as fine, cast(floor(l_extendedprice / 30000) as int) as coarse,
   case when l_discount = 0 then -1 else cast(floor(l_quantity / 7) as int) end as part,
   case when l_tax = 0 then -1 else cast(floor(l_quantity / 16) as int) end as flat from lineitem)"""


def rows(spark, sf):
    band = lambda c, w: F.floor(F.col(c) / w).cast("int")
    return lines(spark, sf).select(
        F.col("l_returnflag").alias("grp"), band("l_quantity", 10).alias("fine"), band("l_extendedprice", 30000).alias("coarse"),
        F.when(F.col("l_discount") == 0, -1).otherwise(band("l_quantity", 7)).alias("part"),
        F.when(F.col("l_tax") == 0, -1).otherwise(band("l_quantity", 16)).alias("flat"),
    )


def agree_cte(name: str, source: str, truth: str, part: str, keys: str) -> str:
    """CTEs ending in ``name(keys, n, mi, ha, hb, ka, kb, sab, sa, sb, ari, nmi, h, c, v)``."""
    k = keys
    return f"""{name}_c as (select {k}, {truth} as a, {part} as b, count(*)::double as n from {source} group by all),
    {name}_a as (select {k}, a, sum(n) as an from {name}_c group by all), {name}_b as (select {k}, b, sum(n) as bn from {name}_c group by all),
    {name}_t as (select {k}, sum(n) as t from {name}_c group by all),
    {name}_j as (select {k}, any_value(t) as n, sum(n / t * ln(n * t / (an * bn))) as mi, sum(n * (n - 1) / 2) as sab
        from {name}_c join {name}_a using ({k}, a) join {name}_b using ({k}, b) join {name}_t using ({k}) group by all),
    {name}_ha as (select {k}, sum(-an / t * ln(an / t)) as ha, sum(an * (an - 1) / 2) as sa, count(*) as ka from {name}_a join {name}_t using ({k}) group by all),
    {name}_hb as (select {k}, sum(-bn / t * ln(bn / t)) as hb, sum(bn * (bn - 1) / 2) as sb, count(*) as kb from {name}_b join {name}_t using ({k}) group by all),
    {name} as (select *, case when sab = sa and sab = sb then 1.0 else (sab - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)) end as ari,
        case when ka = 1 and kb = 1 then 1.0 else mi / ((ha + hb) / 2) end as nmi, case when ka = 1 then 1.0 else mi / ha end as h, case when kb = 1 then 1.0 else mi / hb end as c,
        case when ka = 1 then 1.0 else mi / ha end * case when kb = 1 then 1.0 else mi / hb end * 2 / (case when ka = 1 then 1.0 else mi / ha end + case when kb = 1 then 1.0 else mi / hb end) as v
        from {name}_j join {name}_ha using ({k}) join {name}_hb using ({k}))"""


ALL_NOISE = f"with {ROWS_SQL}, {agree_cte('g', 't', 'fine', 'part', 'grp')}"


@query("v1_adjusted_rand", f"{ALL_NOISE} select grp, round(ari, 6) as ari from g")
def v1(spark, sf):
    return rounded(P.agreement(rows(spark, sf), "fine", "part", ["grp"], False).select("grp", "ari"))


@query("v2_normalised_information", f"{ALL_NOISE} select grp, round(nmi, 6) as nmi from g")
def v2(spark, sf):
    return rounded(P.agreement(rows(spark, sf), "fine", "part", ["grp"], False).select("grp", "nmi"))


@query(
    "v3_adjusted_information",
    f"""{ALL_NOISE}, pairs as (select grp, an, bn, t from g_a join g_b using (grp) join g_t using (grp)),
        terms as (select grp, an, bn, t, unnest(range(greatest(1, cast(an + bn - t as bigint)), cast(least(an, bn) as bigint) + 1))::double as k from pairs),
        e as (select grp, sum(k / t * ln(t * k / (an * bn)) * exp(lgamma(an + 1) + lgamma(bn + 1) + lgamma(t - an + 1) + lgamma(t - bn + 1) - lgamma(t + 1)
              - lgamma(k + 1) - lgamma(an - k + 1) - lgamma(bn - k + 1) - lgamma(t - an - bn + k + 1))) as emi from terms group by 1)
        select grp, round((mi - emi) / ((ha + hb) / 2 - emi), 6) as ami from g join e using (grp)""",
)
def v3(spark, sf):
    return rounded(P.agreement(rows(spark, sf), "fine", "part", ["grp"]).select("grp", "ami"))


@query("v4_homogeneity", f"{ALL_NOISE} select grp, round(h, 6) as homogeneity, round(c, 6) as completeness, round(v, 6) as v_measure from g")
def v4(spark, sf):
    return rounded(P.agreement(rows(spark, sf), "fine", "part", ["grp"], False).select("grp", "homogeneity", "completeness", "v_measure"))


@query(
    "v5_recovery_without_noise",
    f"""with {ROWS_SQL}, kept as (select * from t where part <> -1 and flat <> -1), {agree_cte('g', 'kept', 'fine', 'part', 'grp')}
        select grp, cast(n as bigint) as n_kept, round(ari, 6) as ari, round(nmi, 6) as nmi from g""",
)
def v5(spark, sf):
    return rounded(P.recovery(rows(spark, sf), "fine", "part", ["part", "flat"], ["grp"]))


@query(
    "v6_within_group_rand",
    f"""with {ROWS_SQL}, kept as (select * from t where part <> -1), {agree_cte('g', 'kept', 'fine', 'part', 'grp, coarse')}
        select grp, round(avg(ari), 6) as within_group_ari, count(*) as n_groups from g where n >= 2 and ka >= 2 group by 1""",
)
def v6(spark, sf):
    return rounded(P.within_group_ari(rows(spark, sf), "fine", "part", "coarse", ["grp"]))


MODAL_SQL = """mc as (select grp, part, coarse, count(*) as n from t group by all),
  modal as (select grp, part, case when part = -1 then -1 else coarse end as modal from (select *, row_number() over (partition by grp, part order by n desc, coarse) as rn from mc) where rn = 1)"""


@query(
    "v7_modal_labels",
    f"""with {ROWS_SQL}, {MODAL_SQL}, m as (select * from t join modal using (grp, part) where part <> -1), {agree_cte('g', 'm', 'coarse', 'modal', 'grp')}
        select grp, part, modal, round(ari, 6) as coarse_ari from modal join g using (grp)""",
)
def v7(spark, sf):
    t = rows(spark, sf)
    labels = P.modal_labels(t, "part", "coarse", ["grp"])
    ari = P.agreement(P.to_modal(t.where(F.col("part") != -1), "part", "coarse", ["grp"]), "coarse", "modal", ["grp"], False)
    return rounded(labels.join(ari.select("grp", F.col("ari").alias("coarse_ari")), "grp"))


@query(
    "v8_merge_count",
    f"""with {ROWS_SQL} select grp, cast(count_if(n > 1) as bigint) as merges from (select grp, flat, fine, count(distinct part) as n from t
        where flat <> -1 and part <> -1 group by all) group by 1""",
)
def v8(spark, sf):
    return P.merge_count(rows(spark, sf), "flat", "part", "fine", ["grp"])


@query(
    "v9_condition_vector",
    f"""with {ROWS_SQL}, {MODAL_SQL}, kept as (select * from t where part <> -1), m as (select * from kept join modal using (grp, part)),
        {agree_cte('g', 'kept', 'fine', 'part', 'grp')}, {agree_cte('cg', 'm', 'coarse', 'modal', 'grp')}, {agree_cte('w', 'kept', 'fine', 'part', 'grp, coarse')},
        s as (select grp, avg(case when part = -1 then 1.0 else 0.0 end) as noise, count(distinct case when part <> -1 then part end) as k from t group by 1)
        select s.grp, round(noise, 6) as noise_frac, k as n_clusters, round(k / 6.0, 6) as frag_ratio, round(g.h, 6) as h, round(g.c, 6) as c, round(g.v, 6) as v,
        round(g.ari, 6) as ari, round(g.nmi, 6) as nmi, round(cg.ari, 6) as coarse_ari,
        (select round(avg(ari), 6) from w where w.grp = s.grp and w.n >= 2 and w.ka >= 2) as within_g_ari from s join g using (grp) join cg on cg.grp = s.grp""",
)
def v9(spark, sf):
    return rounded(P.condition_vector(rows(spark, sf), "part", "fine", "coarse", 6, ["grp"]))
