"""SQL text for range explanations, assembled from common table expressions."""

from __future__ import annotations

from .inputs import LINE_FEATURES

Conditions = list[tuple[float, str]]
FULL_CORE: Conditions = [(1.0, "severity"), (0.9, "severity")]


def ranges_cte(conditions: Conditions, source: str = "lineitem", sel: str = "l_returnflag", features=LINE_FEATURES, scope: str | None = None) -> str:
    """CTEs up to ``ranges(sel, t, split, feature, ix, sel_min, sel_max, sel_range, global_min, global_max)``."""
    cells = " union all ".join(
        f"select {sel} as sel, '{f}' as feature, {i} as ix, cast({f} as double) as value from src where {sel} is not null" for i, f in enumerate(features)
    )
    if scope is None:
        span = " union all ".join(f"select '{f}' as feature, cast(min({f}) as double) as global_min, cast(max({f}) as double) as global_max from src" for f in features)
        join = "join span using (feature)"
    else:
        span = " union all ".join(f"select {scope} as node_id, '{f}' as feature, cast(min({f}) as double) as global_min, cast(max({f}) as double) as global_max from src group by 1" for f in features)
        join = "join span on span.feature = e.feature and span.node_id = regexp_extract(e.sel, '^(.*)/[^/]+$', 1)"
    values = ", ".join(f"({t}::double, '{s}')" for t, s in conditions)
    return f"""src as (select * from {source}), cells as ({cells}),
    ext as (select sel, feature, ix, count(*) as n, min(value) as lo, max(value) as hi, quantile_cont(value, 0.5) as med from cells group by 1, 2, 3),
    span as ({span}),
    plan as (select e.*, t, split, case when split = 'symmetric' or hi <= lo then 0.5 else (med - lo) / (hi - lo) end as ls
             from ext e, (values {values}) c(t, split)),
    pos as (select *, (1.0::double - t) * ls * (n - 1) as pa, (1.0::double - (1.0::double - t) * (1.0::double - ls)) * (n - 1) as pb from plan),
    ordered as (select sel, feature, value, row_number() over (partition by sel, feature order by value) - 1 as r from cells),
    quant as (select p.sel, p.feature, p.t, p.split, any_value(pa) as pa, any_value(pb) as pb,
        max(case when r = floor(pa) then value end) as a0, max(case when r = least(floor(pa) + 1, n - 1) then value end) as a1,
        max(case when r = floor(pb) then value end) as b0, max(case when r = least(floor(pb) + 1, n - 1) then value end) as b1
        from pos p join ordered o on p.sel = o.sel and p.feature = o.feature
          and r in (floor(pa), least(floor(pa) + 1, n - 1), floor(pb), least(floor(pb) + 1, n - 1)) group by 1, 2, 3, 4),
    bounds as (select e.sel, q.t, q.split, e.feature, e.ix,
        case when q.t = 1 then e.lo else a0 + (pa - floor(pa)) * (a1 - a0) end as sel_min,
        case when q.t = 1 then e.hi else b0 + (pb - floor(pb)) * (b1 - b0) end as sel_max
        from ext e join quant q on e.sel = q.sel and e.feature = q.feature),
    ranges as (select e.*, sel_max - sel_min as sel_range, global_min, global_max from bounds e {join})"""


def signature_cte(sel: str = "l_returnflag", features=LINE_FEATURES, scope: str | None = None) -> str:
    lows = ", ".join(f"max(case when ix = {i} then sel_min end) as lo{i}, max(case when ix = {i} then sel_max end) as hi{i}" for i in range(len(features)))
    mask = " + ".join(f"(case when src.{f} between lo{i} and hi{i} then {1 << i} else 0 end)" for i, f in enumerate(features))
    on = f"on src.{scope} = regexp_extract(b.sel, '^(.*)/[^/]+$', 1)" if scope else "on true"
    return f"""wide as (select sel, t, split, {lows} from ranges group by 1, 2, 3),
    sig as (select b.sel, b.t, b.split, coalesce({f'src.{sel}' if scope else sel} = b.sel, false) as selected, {mask} as mask, count(*) as n
            from src join wide b {on} group by 1, 2, 3, 4, 5),
    tot as (select sel, t, split, sum(case when selected then n else 0 end) as actual, sum(n) as total from sig group by 1, 2, 3)"""


F1 = "(case when pp > 0 and actual > 0 and tp > 0 then 2 * (tp / pp) * (tp / actual) / ((tp / pp) + (tp / actual)) else 0.0::double end)"


def greedy_cte(features=LINE_FEATURES) -> str:
    d = len(features)
    out = f"""feats as (select * from (values {', '.join(f"('{f}', {i})" for i, f in enumerate(features))}) f(feature, ix)),
    single as (select g.sel, g.t, g.split, f.feature, f.ix, any_value(actual)::double as actual,
        sum(case when selected and (mask & (1 << f.ix)) > 0 then n else 0 end)::double as tp,
        sum(case when (mask & (1 << f.ix)) > 0 then n else 0 end)::double as pp
        from sig g join tot using (sel, t, split), feats f group by 1, 2, 3, 4, 5),
    clause as (select *, {F1} as clause_f1, coalesce(tp / nullif(pp, 0), 0) as clause_precision, coalesce(tp / nullif(actual, 0), 0) as clause_recall from single),
    g0 as (select sel, t, split, actual::double as actual, 0 as chosen, []::int[] as path,
           case when total > 0 and actual > 0 then 2 * (actual / total) / ((actual / total) + 1) else 0.0::double end as f1, true as open from tot)"""
    for k in range(1, d + 1):
        p = f"g{k - 1}"
        out += f""",
    c{k} as (select p.sel, p.t, p.split, f.ix, any_value(p.actual) as actual,
        sum(case when selected and (mask & (p.chosen | (1 << f.ix))) = (p.chosen | (1 << f.ix)) then n else 0 end)::double as tp,
        sum(case when (mask & (p.chosen | (1 << f.ix))) = (p.chosen | (1 << f.ix)) then n else 0 end)::double as pp
        from {p} p join sig using (sel, t, split), feats f where p.open and (p.chosen & (1 << f.ix)) = 0 group by 1, 2, 3, 4),
    b{k} as (select * from (select *, {F1} as f1, row_number() over (partition by sel, t, split order by {F1} desc, ix) as rn from c{k}) where rn = 1),
    g{k} as (select p.sel, p.t, p.split, p.actual,
        case when b.f1 > p.f1 + 1e-6 then p.chosen | (1 << b.ix) else p.chosen end as chosen,
        case when b.f1 > p.f1 + 1e-6 then list_append(p.path, b.ix) else p.path end as path,
        case when b.f1 > p.f1 + 1e-6 then b.f1 else p.f1 end as f1, coalesce(b.f1 > p.f1 + 1e-6, false) as open
        from {p} p left join b{k} b using (sel, t, split))"""
    out += f""",
    predicate as (select r.*, clause_f1, clause_precision, clause_recall, g.f1 as predicate_f1,
        coalesce(list_position(g.path, r.ix), 0) > 0 as in_predicate,
        case when list_position(g.path, r.ix) > 0 then cast(list_position(g.path, r.ix) - 1 as int) end as predicate_step
        from ranges r join clause using (sel, t, split, feature) join g{d} g using (sel, t, split))"""
    return out


def predicate_cte(conditions: Conditions = FULL_CORE, sel: str = "l_returnflag", source: str = "lineitem", features=LINE_FEATURES, scope: str | None = None) -> str:
    return f"{ranges_cte(conditions, source, sel, features, scope)}, {signature_cte(sel, features, scope)}, {greedy_cte(features)}"


BOUNDS = ["sel_min", "sel_max", "sel_range", "global_min", "global_max"]
SCORES = ["clause_f1", "clause_precision", "clause_recall"]


def r6(cols) -> str:
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


def scaled(cols=BOUNDS, alias: str = "s") -> str:
    return ", ".join(
        f"round({c} / {alias}.std, 6) as {c}" if c == "sel_range" else f"round(({c} - {alias}.mean) / {alias}.std, 6) as {c}" for c in cols
    )


def scaler_cte(source: str, features=LINE_FEATURES, name: str = "scaler") -> str:
    return f"{name} as (" + " union all ".join(f"select '{f}' as feature, avg({f}) as mean, stddev_pop({f}) as std from {source}" for f in features) + ")"
