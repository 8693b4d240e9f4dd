"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

An url is expanded only into the shapes (labels of the host, characters of the path) that some
rule has, so the expansion is exact and bounded by the rules, however long the url is. The join
is on the first characters of a digest; the whole digest is compared afterwards, then the
longest rule (host and path together) wins and block wins between equal rules.

Defined cases: a null url or one without ``://`` has empty host and path and fits no rule;
an url that no rule fits is allowed; repeated rows are judged one by one; an empty table of
pages gives an empty result and an empty table of rules allows everything; other columns are
not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_CHARS = 8
DEFAULT = "allow"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, _URL, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression.cast("binary"), 256)


def prepare(rules: DataFrame) -> DataFrame:
    """(prefix, digest, rule, rule_verdict, n_labels, n_path) of rules (host, path, verdict); one row per distinct rule."""
    host, path = F.coalesce(rules["host"], F.lit("")), F.coalesce(rules["path"], F.lit(""))
    own = rules.select(F.translate(host, string.ascii_uppercase, string.ascii_lowercase).alias("h"), path.alias("p"), rules["verdict"].alias("v")).where("h <> ''")
    one = own.groupBy("h", "p").agg(F.max("v").alias("rule_verdict"))  # 'block' sorts after 'allow'
    rule = F.concat("h", "p")
    digest = _digest(F.concat_ws("\n", "h", "p"))
    return one.select(
        F.substring(digest, 1, PREFIX_CHARS).alias("prefix"), digest.alias("digest"), rule.alias("rule"), "rule_verdict",
        F.size(F.split("h", r"\.", -1)).alias("n_labels"), F.length("p").alias("n_path"),
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = DEFAULT) -> DataFrame:
    """Columns ``keep`` with host, path, rule and verdict, one row per row of ``pages``."""
    ready = prepare(rules)
    # Pairs of label and character counts: as many as rules have shapes, not as many as rules.
    shapes = sorted((r.n_labels, r.n_path) for r in ready.select("n_labels", "n_path").distinct().collect())
    own = pages.select(
        F.monotonically_increasing_id().alias("__row"), *keep, host_of(pages[url].cast("string")).alias("host"), path_of(pages[url].cast("string")).alias("path")
    )
    if not shapes:
        return own.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    own = own.withColumn("__labels", F.split("host", r"\.", -1))
    possible = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in shapes])
    fits = F.filter(possible, lambda s: (s.a <= F.size("__labels")) & (s.b <= F.length("path")))
    expression = lambda s: F.concat(F.array_join(F.slice("__labels", F.size("__labels") - s.a + 1, s.a), "."), F.lit("\n"), F.substr("path", F.lit(1), s.b))
    wide = own.select("__row", *keep, "host", "path", F.explode_outer(F.transform(fits, expression)).alias("__e"))
    wide = wide.withColumn("__digest", _digest(F.col("__e"))).drop("__e")
    # Urls without an expression fit no prefix, and get one of their own so that they don't gather in one task.
    wide = wide.withColumn("__prefix", F.coalesce(F.substring("__digest", 1, PREFIX_CHARS), F.concat(F.lit("-"), F.col("__row").cast("string"))))
    hit = wide.join(ready, F.col("__prefix") == F.col("prefix"), "left")
    # What shares a prefix is confirmed by the whole digest.
    found = F.when(F.col("__digest") == F.col("digest"), F.struct(F.length("rule").alias("n"), F.col("rule_verdict"), F.col("rule")))
    best = hit.groupBy("__row", *keep, "host", "path").agg(F.max(found).alias("best"))
    return best.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
