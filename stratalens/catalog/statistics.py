"""Scaling, column statistics and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import characteristics as CH
from ..operators import histograms as H
from ..operators import scaling as S
from ..roles import extra_columns
from . import query
from .inputs import LINE_FEATURES, lines, order_rows, rounded, table, vectors


def union_sql(template: str, features=LINE_FEATURES) -> str:
    return " union all ".join(template.replace("{f}", f) for f in features)


@query("a1_fit_scaler", union_sql("select '{f}' as feature, round(avg({f}), 6) as mean, round(stddev_pop({f}), 6) as std from lineitem"))
def a1(spark, sf):
    return rounded(S.fit_scaler(lines(spark, sf), LINE_FEATURES))


SCALED = ", ".join(f"({f} - s.m_{f}) / s.s_{f} as {f}" for f in LINE_FEATURES)
STATS = ", ".join(f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}" for f in LINE_FEATURES)


@query(
    "a2_apply_scaler",
    f"""with s as (select {STATS} from lineitem),
        z as (select l_orderkey, l_linenumber, {SCALED} from lineitem, s)
        select l_orderkey, l_linenumber, {', '.join(f'round({f}, 6) as {f}' for f in LINE_FEATURES)} from z""",
)
def a2(spark, sf):
    src = lines(spark, sf)
    out = S.apply_scaler(src, S.Scaler.fit(src, LINE_FEATURES), LINE_FEATURES)
    return rounded(out.select("l_orderkey", "l_linenumber", *LINE_FEATURES))


@query(
    "a3_node_scaler",
    union_sql(
        "select l_returnflag as node_id, '{f}' as feature, round(avg({f}), 6) as mean, round(stddev_pop({f}), 6) as std from lineitem group by 1"
    ),
)
def a3(spark, sf):
    src = lines(spark, sf).withColumnRenamed("l_returnflag", "node_id")
    return rounded(S.fit_scaler(src, LINE_FEATURES, ["node_id"]))


@query(
    "a4_feature_characteristics",
    union_sql(
        """select l_returnflag as node_id, '{f}' as feature, round((avg({f}) - any_value(m)) / any_value(s), 6) as z_mean,
           round(stddev_samp({f}) / any_value(s), 6) as z_std, round(avg({f}), 6) as raw_mean, true as is_feature
           from lineitem, (select avg({f}) as m, stddev_pop({f}) as s from lineitem) group by 1"""
    ),
)
def a4(spark, sf):
    src = lines(spark, sf).withColumnRenamed("l_returnflag", "node_id")
    return rounded(CH.feature_characteristics(src, LINE_FEATURES, S.Scaler.fit(src, LINE_FEATURES), ["node_id"]))


A5_EXTRA = ["l_suppkey", "l_linenumber", "is_open"]


@query(
    "a5_extra_characteristics",
    """with t as (select *, cast(l_linestatus = 'O' as int) as is_open from lineitem) """
    + " union all ".join(
        f"""select l_returnflag as parent_id, l_linestatus as node_id, '{f}' as feature,
            round((avg({f}) - any_value(m)) / any_value(s), 6) as z_mean, round(stddev_pop({f}) / any_value(s), 6) as z_std,
            round(avg({f}), 6) as raw_mean, false as is_feature
            from t join (select l_returnflag, avg({f}) as m, stddev_pop({f}) as s from t group by 1) using (l_returnflag)
            group by 1, 2"""
        for f in A5_EXTRA
    ),
)
def a5(spark, sf):
    src = lines(spark, sf).select(
        F.col("l_returnflag").alias("parent_id"), F.col("l_linestatus").alias("node_id"), "l_suppkey", "l_linenumber",
        (F.col("l_linestatus") == "O").alias("is_open"),
    )
    return rounded(CH.extra_characteristics(src, src, A5_EXTRA, ["parent_id", "node_id"], ["parent_id"]))


@query(
    "a6_selection_characteristics",
    """with space as (select *, l_quantity > 30 as sel from lineitem where l_returnflag = 'R') """
    + union_sql(
        """select '{f}' as feature, round((avg({f}) - any_value(m)) / any_value(s), 6) as z_mean,
           round(stddev_samp({f}) / any_value(s), 6) as z_std, round(avg({f}), 6) as raw_mean, true as is_feature
           from space, (select avg({f}) as m, stddev_pop({f}) as s from lineitem) where sel""",
        ["l_extendedprice", "l_discount"],
    )
    + " union all "
    + union_sql(
        """select '{f}' as feature, round((avg({f}) - any_value(m)) / any_value(s), 6) as z_mean,
           round(stddev_pop({f}) / any_value(s), 6) as z_std, round(avg({f}), 6) as raw_mean, false as is_feature
           from space, (select avg({f}) as m, stddev_pop({f}) as s from space) where sel""",
        ["l_quantity", "l_tax"],
    ),
)
def a6(spark, sf):
    src = lines(spark, sf)
    feats = ["l_extendedprice", "l_discount"]
    space = src.where(F.col("l_returnflag") == "R").select(
        "l_extendedprice", "l_discount", "l_quantity", "l_tax", "l_linestatus", (F.col("l_quantity") > 30).alias("sel")
    )
    extras = [c for c in extra_columns(space, feats) if c != "sel"]
    return rounded(CH.selection_characteristics(space, "sel", feats, extras, S.Scaler.fit(src, feats)))


TARGET_CASES = {
    "target_returned": "cast(l_returnflag = 'R' as int)",
    "target_open": "cast(l_linestatus = 'O' as int)",
    "target_line": "l_linenumber",
}


@query(
    "a7_selection_targets",
    " union all ".join(
        f"""select '{c}' as feature, {'true' if c != 'target_line' else 'false'} as is_boolean,
            cast(min(case when l_quantity > 30 then {e} end) as double) as sel_min, cast(max(case when l_quantity > 30 then {e} end) as double) as sel_max,
            round(avg(case when l_quantity > 30 then {e} end), 6) as sel_mean, cast(min({e}) as double) as global_min,
            cast(max({e}) as double) as global_max, round(avg({e}), 6) as global_mean from lineitem"""
        for c, e in TARGET_CASES.items()
    ),
)
def a7(spark, sf):
    src = lines(spark, sf).select(
        (F.col("l_quantity") > 30).alias("sel"), (F.col("l_returnflag") == "R").alias("target_returned"),
        (F.col("l_linestatus") == "O").alias("target_open"), F.col("l_linenumber").alias("target_line"),
    )
    return rounded(CH.selection_targets(src, [*TARGET_CASES, "target_unknown"], "sel"))


@query(
    "a8_is_boolean",
    " union all ".join(f"select '{c}' as feature, bool_and({c} in (0, 1)) as is_boolean from labels" for c in ("toxic", "quality", "doc_id"))
    + " union all select 'nothing', false",
)
def a8(spark, sf):
    src = table(spark, sf, "labels").withColumns({"nothing": F.lit("x"), "sel": F.lit(True)})
    return CH.selection_targets(src, ["toxic", "quality", "doc_id", "nothing"], "sel").select("feature", "is_boolean")


@query(
    "a10_centroids",
    """select label as cluster, i - 1 as dim, round(avg(cast(embedding[i] as double)), 6) as value
       from embeddings, (select cast(unnest(range(1, 65)) as int) as i) group by 1, 2""",
)
def a10(spark, sf):
    c = CH.centroids(vectors(spark, sf).withColumnRenamed("label", "cluster"), "features", 64, ["cluster"])
    return rounded(c.select("cluster", F.posexplode("centroid").alias("dim", "value")))


def histogram_sql(col: str, source: str, bins: int) -> str:
    return f"""select '{col}' as feature, bin, coalesce(n, 0) as n, round(coalesce(n, 0) / max(n) over (), 6) as height
        from (select cast(unnest(range(0, {bins})) as int) as bin) g left join (
          select cast(least({bins - 1}, floor(({col} - lo) / (hi - lo) * {bins})) as int) as bin, count(*) as n
          from {source}, (select min({col}) as lo, max({col}) as hi from {source}) where {col} is not null group by 1) c using (bin)"""


@query(
    "a11_column_histograms",
    histogram_sql("value", "events", 28) + " union all "
    + "select 'flat', bin, case when bin = 0 then (select count(*) from events) else 0 end, case when bin = 0 then 1.0 else 0.0 end from (select cast(unnest(range(0, 28)) as int) as bin)",
)
def a11(spark, sf):
    e = table(spark, sf, "events").select("value", F.lit(3.0).alias("flat"))
    return rounded(H.column_histograms(e, ["value", "flat"]))


EVENT_SCORE = "value / max(value) over (partition by event_type)"


@query(
    "a12_outlier_histogram",
    f"""with s as (select event_type as node_id, {EVENT_SCORE} as v from events),
        c as (select node_id, cast(least(23, floor(v * 24)) as int) as bin, count(*) as n from s where v is not null group by 1, 2),
        g as (select distinct node_id, b.bin from c, (select cast(unnest(range(0, 24)) as int) as bin) b)
        select node_id, bin, coalesce(n, 0) as n, round(coalesce(n, 0) / max(n) over (partition by node_id), 6) as height
        from g left join c using (node_id, bin)""",
)
def a12(spark, sf):
    return rounded(H.score_histogram(event_scores(spark, sf), "outlier_score", ["node_id"]))


def event_scores(spark, sf):
    e = table(spark, sf, "events")
    peak = e.groupBy("event_type").agg(F.max("value").alias("peak"))
    return e.join(peak, "event_type").select(
        F.col("event_type").alias("node_id"), F.col("event_id").alias("row_id"), (F.col("value") / F.col("peak")).alias("outlier_score")
    )


@query(
    "a13_outlier_summary",
    f"""select node_id, round(max(v), 6) as max_score, round(avg(v), 6) as mean_score, count(v) as n_scored
        from (select event_type as node_id, {EVENT_SCORE} as v from events) group by 1""",
)
def a13(spark, sf):
    return rounded(H.score_summary(event_scores(spark, sf)))
