"""Sources, sinks and row operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..operators import rows as R
from ..session import shared_dir
from ..sources import identity, readers, runs, writers
from . import query
from .inputs import LINE_FEATURES, lines, order_membership, order_rows, rounded, table, vectors


def scratch(spark, name: str) -> str:
    """The name of a fresh folder below the shared one; Spark itself makes it, wherever it is."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("s1_read_delimited", "select o_orderkey, o_totalprice, o_orderpriority from orders")
def s1(spark, sf):
    path = scratch(spark, "s1") + "/orders"
    src = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    src.write.option("header", True).option("sep", ";").csv(path)
    return readers.read_delimited(spark, path, ";", src.schema)


@query(
    "s2_stack_sources",
    """select is_customer, count(*) as n, round(avg(balance), 6) as mean_balance
       from (select true as is_customer, c_acctbal as balance from customer
             union all select false, s_acctbal from supplier) group by is_customer""",
)
def s2(spark, sf):
    stacked = readers.stack_sources(
        {
            True: table(spark, sf, "customer").select(F.col("c_acctbal").alias("balance")),
            False: table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance")),
        },
        "is_customer",
    )
    return rounded(stacked.groupBy("is_customer").agg(F.count("*").alias("n"), F.avg("balance").alias("mean_balance")))


@query("s3_rename_role", "select doc_id as row_id, quality as target_quality from labels")
def s3(spark, sf):
    t = readers.rename_role(table(spark, sf, "labels"), "doc_id", "row_id")
    return readers.rename_role(t, "quality", "target_quality").select("row_id", "target_quality")


S4_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(
    "s4_assign_row_id",
    f"""select cast(row_number() over (order by {', '.join(S4_ORDER)}) - 1 as bigint) as row_id,
               l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem""",
)
def s4(spark, sf):
    src = lines(spark, sf).select(*S4_ORDER)
    return identity.assign_row_id(src, S4_ORDER).select("row_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "s5_subsample",
    """select least(count(*), 1000) as n_rows, least(count(*), 1000) as n_ids, least(count(*), 1000) as n_known
       from orders""",
)
def s5(spark, sf):
    o = table(spark, sf, "orders")
    got = identity.subsample(o, 1000, seed=42, id_column="o_orderkey").select("o_orderkey")
    known = o.select("o_orderkey", F.lit(1).alias("known"))
    return got.join(known, "o_orderkey", "left").agg(
        F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_ids"), F.count("known").alias("n_known")
    )


@query(
    "s6_train_validation_split",
    """select part, cast(n as bigint) as n_rows from
       (select 'train' as part, count(*) - cast(floor(count(*) * 0.2) as bigint) as n from orders
        union all select 'validation', cast(floor(count(*) * 0.2) as bigint) from orders)""",
)
def s6(spark, sf):
    train, val = identity.train_validation_split(table(spark, sf, "orders"), 0.2, seed=42, id_column="o_orderkey")
    tagged = train.select(F.lit("train").alias("part")).unionAll(val.select(F.lit("validation").alias("part")))
    return tagged.groupBy("part").agg(F.count("*").alias("n_rows"))


ORDER_DRAW_SQL = "row_number() over (order by ('0x' || substr(md5('42|' || o_orderkey), 1, 15))::bigint, o_orderkey)"


@query("s5_drawn_rows", f"select o_orderkey from (select o_orderkey, {ORDER_DRAW_SQL} as rn from orders) where rn <= 1000")
def s5_drawn(spark, sf):
    return identity.subsample(table(spark, sf, "orders"), 1000, seed=42, id_column="o_orderkey").select("o_orderkey")


@query(
    "s6_drawn_rows",
    f"""select case when rn <= floor(0.2 * n) then 'validation' else 'train' end as part, o_orderkey
        from (select o_orderkey, {ORDER_DRAW_SQL} as rn, count(*) over () as n from orders)""",
)
def s6_drawn(spark, sf):
    train, val = identity.train_validation_split(table(spark, sf, "orders"), 0.2, seed=42, id_column="o_orderkey")
    return train.select(F.lit("train").alias("part"), "o_orderkey").unionByName(val.select(F.lit("validation").alias("part"), "o_orderkey"))


@query(
    "s7_write_tables",
    """select kind, n, round(mean_value, 6) as mean_value from (
         select count(*) as n, avg(o_totalprice) as mean_value from orders) t,
         (values ('csv'), ('json'), ('parquet')) k(kind)
       union all select 'empty', 0, null""",
)
def s7(spark, sf):
    path = scratch(spark, "s7")
    src = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = None
    for kind in ("csv", "json", "parquet"):
        writers.write_table(src, f"{path}/{kind}", kind)
        back = readers.read_result(spark, f"{path}/{kind}", src.schema, kind)
        part = back.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_value"))
        out = part if out is None else out.unionAll(part)
    writers.write_table(src.where(F.col("o_totalprice").isNull()), f"{path}/none", "csv")
    none = readers.read_result(spark, f"{path}/none", src.schema)
    part = none.agg(F.lit("empty").alias("kind"), F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_value"))
    return rounded(out.unionAll(part))


@query(
    "s8_export_selection",
    """select l_quantity, l_discount, l_returnflag = 'R' as target_returned, l_linestatus = 'O' as target_open
       from lineitem where l_quantity >= 45""",
)
def s8(spark, sf):
    path = scratch(spark, "s8") + "/selection"
    src = (
        lines(spark, sf)
        .withColumn("row_id", F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
        .select(
            "row_id",
            (F.col("l_returnflag") == "R").alias("target_returned"),
            (F.col("l_linestatus") == "O").alias("target_open"),
            "l_quantity",
            "l_discount",
        )
    )
    writers.export_selection(src, src.where(F.col("l_quantity") >= 45), path, ["l_quantity", "l_discount"])
    schema = "l_quantity double, l_discount double, target_returned boolean, target_open boolean"
    return readers.read_delimited(spark, path, ",", schema)


@query(
    "s9_stored_runs",
    """select step, was_hit, n_rows from (select count(*) as n_rows from supplier) t,
       (values ('first', false), ('again', true), ('forced', false)) s(step, was_hit)""",
)
def s9(spark, sf):
    store = runs.RunStore(spark, scratch(spark, "s9"))
    key = Config.of(hierarchical_layers=2).run_key(sf, ["s_acctbal"])
    build = lambda: {"rows": table(spark, sf, "supplier")}
    out = None
    for step, force in (("first", False), ("again", False), ("forced", True)):
        tables, hit = store.get_or_build(key, ["rows"], build, force)
        part = tables["rows"].agg(F.lit(step).alias("step"), F.lit(hit).alias("was_hit"), F.count("*").alias("n_rows"))
        out = part if out is None else out.unionAll(part)
    return out


@query("s10_read_result", "select o_orderstatus, count(*) as n, round(avg(o_totalprice), 6) as mean_price from orders group by 1")
def s10(spark, sf):
    path = scratch(spark, "s10") + "/summary"
    o = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))
    writers.write_table(o, path, "csv")
    return rounded(readers.read_result(spark, path, "o_orderstatus string, n bigint, mean_price double"))


@query(
    "p2_fetch_rows",
    """select cast(rank() over (order by l.doc_id desc) - 1 as bigint) as position, l.doc_id as row_id, d.lang, d.n_chars
       from labels l join documents d using (doc_id)""",
)
def p2(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")
    ids = identity.assign_row_id(
        table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), (-F.col("doc_id")).alias("back")), ["back"], "position"
    )
    return R.fetch_rows(docs, ids, ["lang", "n_chars"])


@query(
    "p3_finite",
    """select kind, n_rows, n_numbers, round(mean_value, 6) as mean_value from (
       select event_type as kind, count(*) as n_rows, count(v) as n_numbers, avg(v) as mean_value from (
         select event_type, case when user_id % 5 = 0 then null
                                 when user_id % 5 = 1 then null
                                 when user_id % 5 = 2 then null
                                 when user_id % 5 = 3 then cast(value > 50 as int)
                                 else value end as v from events) group by event_type)""",
)
def p3(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("user_id") % 5
    text = (
        F.when(kind == 0, "NaN")
        .when(kind == 1, "Infinity")
        .when(kind == 2, F.col("event_type"))
        .otherwise(F.col("value").cast("string"))
    )
    v = F.when(kind == 3, C.finite(F.col("value") > 50)).otherwise(C.finite(text))
    return rounded(
        e.select("event_type", v.alias("v"))
        .groupBy(F.col("event_type").alias("kind"))
        .agg(F.count("*").alias("n_rows"), F.count("v").alias("n_numbers"), F.avg("v").alias("mean_value"))
    )


P4_WINDOWS = {"o_totalprice": (100000.0, 300000.0), "target_day": (5.0, 20.0), "o_custkey": (-1e18, 1e18)}


@query(
    "p4_range_filter",
    """select o_orderkey as row_id, (o_totalprice between 100000 and 300000) and (extract(day from o_orderdate) between 5 and 20) as matches,
       'o_totalprice,target_day' as clauses from orders""",
)
def p4(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_custkey", F.dayofmonth("o_orderdate").alias("target_day")
    )
    matches, clauses = R.range_filter(o, P4_WINDOWS)
    return matches.withColumn("clauses", F.lit(",".join(sorted(clauses))))


@query(
    "p5_usable_columns",
    """select 'value' as feature, min(value) as lo, max(value) as hi, min(value) < max(value) as usable from events
       union all select 'constant', 1.0, 1.0, false union all select 'nothing', null, null, false""",
)
def p5(spark, sf):
    e = table(spark, sf, "events").select("value", F.lit(1.0).alias("constant"), F.lit("x").alias("nothing"))
    return R.column_bounds(e, ["value", "constant", "nothing"])


@query(
    "p6_selection_guard",
    "select * from (values ('all', 'whole'), ('none', 'empty'), ('some', 'ok')) t(selection, state)",
)
def p6(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderstatus")
    states = {
        "all": R.usable_selection(o, o),
        "none": R.usable_selection(o, o.where(F.col("o_totalprice").isNull())),
        "some": R.usable_selection(o, o.where(F.col("o_orderstatus") == "F")),
    }
    total = o.agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(k).alias("selection"), F.lit(v).alias("state")) for k, v in states.items()])
    return total.select(F.inline(pairs))


def _pixel_table(spark, sf):
    v = vectors(spark, sf)
    return v.select("row_id", "label", *[(F.col("features")[i] * 2 + 0.5).alias(f"px_{i}") for i in range(64)])


@query(
    "p10_row_pixels",
    """select vec_id as row_id, array_to_string([cast(floor(greatest(0.0, least(255.0, (cast(x as double) * 2 + 0.5) * 255))) as int)
         for x in embedding], ',') as pixels from embeddings""",
)
def p10(spark, sf):
    t = _pixel_table(spark, sf)
    return t.select("row_id", F.array_join(C.pixels([f"px_{i}" for i in range(64)]), ",").alias("pixels"))


@query(
    "p11_scale_by_constant",
    "select label, round(avg((cast(embedding[1] as double) * 2 + 0.5) / 16.0), 6) as px_0, round(avg((cast(embedding[64] as double) * 2 + 0.5) / 16.0), 6) as px_63 from embeddings group by label",
)
def p11(spark, sf):
    cols = [f"px_{i}" for i in range(64)]
    t = C.scaled_by_constant(_pixel_table(spark, sf), cols, 16)
    return rounded(t.groupBy("label").agg(F.avg("px_0").alias("px_0"), F.avg("px_63").alias("px_63")))


@query(
    "p12_one_hot",
    "select vec_id as row_id, " + ", ".join(f"label = {c} as target_{c}" for c in range(10)) + " from embeddings",
)
def p12(spark, sf):
    return C.one_hot(vectors(spark, sf).select("row_id", "label"), "label", range(10))


@query(
    "p13_decode_one_hot",
    "select vec_id as row_id, case when label < 9 then label else 0 end as class_id from embeddings",
)
def p13(spark, sf):
    # Class 9 has no column, so its rows carry no flag and decode to 0.
    t = C.one_hot(vectors(spark, sf).select("row_id", "label"), "label", range(9))
    return t.select("row_id", C.class_labels(t).alias("class_id"))


@query(
    "p14_label_from_text",
    "select doc_id as row_id, cast(len(regexp_replace(text, '[^1-9]', '', 'g')) // 2 as int) as rings from documents",
)
def p14(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), C.ring_count("text").alias("rings"))


@query(
    "k14_top_outliers",
    """select * from (select event_type as node_id, event_id as row_id, value as outlier_score, user_id,
         cast(row_number() over (partition by event_type order by value desc, event_id) as int) as rank
       from events where value is not null) where rank <= 100""",
)
def k14(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("event_id", "row_id")
    scores = e.select(F.col("event_type").alias("node_id"), "row_id", F.col("value").alias("outlier_score"))
    return R.with_full_rows(R.top_outliers(scores), e, ["user_id"])
