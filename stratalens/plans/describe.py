"""Describe a selection inside an analysed node: ranges, characteristics and held-out columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import predicates as P
from ..operators.characteristics import selection_characteristics, selection_targets
from ..operators.rows import require_partial
from ..operators.scaling import Scaler


def describe_selection(
    df: DataFrame, features: Sequence[str], node: DataFrame, selection: DataFrame, config: Config = Config(),
    extras: Sequence[str] = (), targets: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Tables ``full``, ``trimmed``, ``summary``, ``characteristics`` and ``targets`` of a selection.

    ``node`` and ``selection`` hold row ids. A selection of the whole node is refused; an
    empty one gives the same tables without rows.
    """
    some = require_partial(node, selection)
    if not some:  # any row stands in, for the shape of the tables
        node = df.select("row_id")
        selection = node.orderBy("row_id").limit(1)
    inside = node.select("row_id", F.lit(True).alias("in_node"))
    chosen = selection.select("row_id", F.lit(True).alias("selected"))
    tagged = df.join(inside, "row_id", "left").join(chosen, "row_id", "left")
    tagged = tagged.withColumns({"in_node": F.coalesce("in_node", F.lit(False)), "selected": F.coalesce("selected", F.lit(False)) & F.coalesce("in_node", F.lit(False))})
    tagged = tagged.withColumn("sel", F.when(F.col("selected"), "selection"))
    rows, stats = P.scope_background(tagged, features, F.col("in_node"), config.predicate_scope, config.normalize)
    found, summary = P.full_and_core(rows, features, stats)
    space = tagged.where("in_node")
    root = Scaler.fit(df, features, config.normalize)
    out = {
        "full": found.where("part = 'full'"),
        "trimmed": found.where("part = 'trimmed'"),
        "summary": summary,
        "characteristics": selection_characteristics(space, "selected", features, extras, root),
        "targets": selection_targets(tagged, targets, "selected"),
    }
    return out if some else {name: table.limit(0) for name, table in out.items()}
