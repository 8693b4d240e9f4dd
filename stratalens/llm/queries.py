"""Registered queries of this subpackage, with SQL where it can state the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bag_minhash, compression_quality, cost_packing, cross_polytope, deleted_interpolation, filter_audit, html_content, license_scan, merkle_manifest, paragraph_dedup, piece_scan, quality_rules, url_rules
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The rules of ``op8_url_rules``: (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_bag_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op2_paragraph_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.passages(read(spark, sf_dir, "documents"))


@query("op3_html_content")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract(read(spark, sf_dir, "pages"))


@query("op4_deleted_interpolation")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(read(spark, sf_dir, "documents"))


@query("op5_compression_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return compression_quality.score(docs, compression_quality.fit(docs, read(spark, sf_dir, "labels")))


@query("op6_cross_polytope")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return cross_polytope.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query("op7_piece_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as a digest, and what decoding gives back."""
    coded = piece_scan.encode(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return coded.select(
        "doc_id", "n_chars", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.length("decoded").cast("long").alias("decoded_chars"), F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32")
    )


_URL_SQL = f"""
with rules(host, path, verdict) as (values {', '.join(map(str, RULES))}),
pages_of as (
  select row_number() over () as r, page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
hits as (
  select p.r, arg_max(u.host || u.path, length(u.host || u.path)) as rule, arg_max(u.verdict, length(u.host || u.path)) as verdict
  from pages_of p join rules u on (p.host = u.host or ends_with(p.host, '.' || u.host)) and starts_with(p.path, u.path)
  group by p.r)
select p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') as verdict from pages_of p left join hits h using (r)
"""


@query("op8_url_rules", _URL_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(read(spark, sf_dir, "pages"), rules)


@query("op9_cost_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


_STOP_SQL = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
_WORD_SQL = r"[^\x20\x09-\x0D]"
_RULES_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD_SQL}+') as w from documents),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD_SQL}')) as lines from d),
win as (
  select r, unnest(range(1, len(w) - 1)) as i,
         unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as x
  from d where len(w) >= 3),
again as (select r, i from win qualify count(*) over (partition by r, x) > 1),
hit as (
  select r, count(distinct p) as n
  from (select r, i as p from again union all select r, i + 1 from again union all select r, i + 2 from again) group by r),
m as (
  select doc_id, len(w) as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(hit.n, 0) as n_repeat_words, len(lines) as n_lines,
         length(regexp_replace(t, '\P{{L}}', '', 'g')) as letters, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) as uppers,
         len(list_filter(w, lambda x: lower(x) in ({_STOP_SQL}))) as stops,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) as dots,
         len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•‣·]\s'))) as bullets
  from d join l using (r) left join hit using (r)),
z as (
  select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
         coalesce(word_chars / nullif(n_words, 0)::double, 0.0) as mean_word_chars, coalesce(n_symbols / nullif(n_words, 0)::double, 0.0) as symbol_ratio,
         coalesce(uppers / nullif(letters, 0)::double, 0.0) as upper_ratio, coalesce(letters / nullif(word_chars, 0)::double, 0.0) as letter_ratio,
         coalesce(stops / nullif(n_words, 0)::double, 0.0) as stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0)::double, 0.0) as dup_line_ratio,
         coalesce(dots / nullif(n_lines, 0)::double, 0.0) as ellipsis_line_ratio, coalesce(bullets / nullif(n_lines, 0)::double, 0.0) as bullet_line_ratio,
         n_words < {quality_rules.MIN_WORDS} or 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words as base_failed
  from m)
select *, not base_failed and {' and '.join(
    f'{t.measure} {op} {v}' for t in quality_rules.THRESHOLDS for op, v in (('>=', t.low), ('<=', t.high)) if v is not None)} as kept
from z
"""


@query("op10_quality_rules", _RULES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(read(spark, sf_dir, "documents"))


_AUDIT_SQL = rf"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD_SQL}+') as w from documents),
l as (select doc_id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic from labels group by doc_id),
f as (
  select part, case when len(w) < 50 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 65 * len(w) then 'B' else '' end
         || case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) then 'C' else '' end || case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end
         || case when coalesce(min(doc_id) over (partition by t) < doc_id, false) then 'E' else '' end as fails, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from d left join l using (doc_id)),
m as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by part, fails),
x(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select p.l || q.l || r.l || s.l || t.l as filter_order
  from x p join x q on q.l <> p.l join x r on r.l not in (p.l, q.l) join x s on s.l not in (p.l, q.l, r.l) join x t on t.l not in (p.l, q.l, r.l, s.l)),
steps as (select filter_order, unnest(range(1, 6)) as step from orders),
fate as (
  select part, filter_order, step, n, good, toxic, fails, contains(fails, substr(filter_order, step, 1)) as fails_own,
         len(list_filter(string_split(substr(filter_order, 1, step - 1), ''), lambda k: k <> '' and contains(fails, k))) > 0 as gone
  from m, steps),
s as (
  select part, filter_order, step, substr(filter_order, step, 1) as own, coalesce(sum(n) filter (not gone and not fails_own), 0)::bigint as kept,
         coalesce(sum(n) filter (not gone and fails_own), 0)::bigint as removed, coalesce(sum(n) filter (gone and fails_own), 0)::bigint as redundant,
         coalesce(sum(n) filter (fails = substr(filter_order, step, 1)), 0)::bigint as unique_fails, coalesce(sum(good) filter (not gone and fails_own), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (not gone and fails_own), 0)::bigint as toxic_lost
  from fate group by part, filter_order, step)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from s
"""


@query("op11_filter_audit", _AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = filter_audit.survival_words(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return filter_audit.audit(filter_audit.survivors(words))


#: The rows that op12 tampers with: those whose crc32 of the id's decimals it divides.
TAMPERED = 7

_ENCODED_SQL = " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang"))
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda k: ord(k)::bigint)),
              lambda c, k: list_reduce([xor(c, k), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, (u & 1) * 3988292384))), 4294967295)"""
_MERKLE_SQL = f"""
with recursive d as (
  select doc_id, lang, sha256({_ENCODED_SQL} || coalesce(strlen(n_chars::varchar)::varchar || ':' || n_chars::varchar, '-') || coalesce(strlen(text)::varchar || ':' || text, '-')) as leaf,
         sha256({_ENCODED_SQL} || coalesce(strlen((n_chars + 1)::varchar)::varchar || ':' || (n_chars + 1)::varchar, '-') || coalesce(strlen(text)::varchar || ':' || text, '-')) as other,
         coalesce({_CRC_SQL} % {TAMPERED} = 0, false) as tampered
  from documents),
leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from d),
up(lang, level, i, h, n) as (
  select lang, 0, i, leaf, n from leaves
  union all
  select lang, any_value(level) + 1, i // 2, sha256(string_agg(h, '' order by i)), (any_value(n) + 1) // 2 from up where n > 1 group by lang, i // 2),
subroots as (select lang, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from up where n = 1),
top(level, i, h, n) as (
  select 0, i, h, n from subroots
  union all
  select any_value(level) + 1, i // 2, sha256(string_agg(h, '' order by i)), (any_value(n) + 1) // 2 from top where n > 1 group by i // 2),
steps as (
  select l.lang, l.i as leaf_i, u.level, l.i >> u.level as node, s.h as sibling
  from leaves l join (select distinct lang, level from up where n > 1) u on l.lang is not distinct from u.lang
  left join up s on s.lang is not distinct from l.lang and s.level = u.level and s.i = xor(l.i >> u.level, 1)
  union all
  select l.lang, l.i, 1000 + t.level, b.i >> t.level, s.h
  from leaves l join subroots b on l.lang is not distinct from b.lang join (select distinct level from top where n > 1) t on true
  left join top s on s.level = t.level and s.i = xor(b.i >> t.level, 1)),
proofs as (
  select lang, leaf_i, list({{'odd': node % 2 = 1, 's': sibling}} order by level) as p, coalesce(string_agg(sibling, '' order by level), '') as joined from steps group by lang, leaf_i),
r as (
  select l.doc_id, l.leaf, b.h as subroot, (select h from top where n = 1) as root, sha256(coalesce(p.joined, '')) as proof_sha256,
         list_reduce(list_prepend({{'odd': false, 's': case when l.tampered then l.other else l.leaf end}}, coalesce(p.p, [])),
                     lambda a, x: {{'odd': false, 's': sha256(case when x.s is null then a.s when x.odd then x.s || a.s else a.s || x.s end)}}).s as folded_root
  from leaves l join subroots b on l.lang is not distinct from b.lang left join proofs p on p.lang is not distinct from l.lang and p.leaf_i = l.i)
select *, folded_root = root as verified from r
"""


@query("op12_merkle_manifest", _MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's leaf, roots and proof, and whether the row as some are tampered with still leads to the root."""
    docs = read(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    changed = merkle_manifest.digest_of([docs[c] + 1 if c == "n_chars" else docs[c] for c in merkle_manifest.COLUMNS])
    found = merkle_manifest.manifest(docs, changes={"changed": F.when(hit, changed)})
    found = found.withColumn("folded_root", merkle_manifest.folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle_manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_license_scan")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))
