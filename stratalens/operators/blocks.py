"""Distance work between rows of the same node, cut into bounded blocks.

Exact neighbour and rank questions need distances, never a table of all pairs: a task gets
at most one block of query rows and one block of candidate rows, and hands on only its
reduced answer (a few neighbours, counts or sums per query row). Where the question has a
reach (the k-th neighbour, a radius), rows are first placed by their nearest pivot and the
triangle inequality decides which blocks a candidate has to visit at all. A crowded node or
cell is cut into more blocks, so its size sets the number of tasks, not the size of one.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, hold

BLOCK_ROWS = 2048
# Where every row meets every other, larger blocks are read so many times less; work on them goes by tiles.
WIDE = 8
PIVOTS = 1024
NODE = "node_id"


@dataclass(frozen=True)
class Reach:
    """How far a query may have to look: to its k-th candidate, a fixed radius, or as far as a column of its row says.

    ``foreign`` names a column of both sides whose equal values need not meet: cells that hold
    nothing else are skipped.
    """

    k: int | None = None
    radius: float | None = None
    column: str | None = None
    foreign: str | None = None


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(len(column), -1)


def distances(a: np.ndarray, b: np.ndarray, rows: int = 32) -> np.ndarray:
    """Euclidean distances; the sum runs dimension by dimension, so equal inputs give equal bits in any block."""
    out = np.zeros((len(a), len(b)))
    across, diff = np.ascontiguousarray(b.T), np.empty((min(rows, len(a)), len(b)))
    for start in range(0, len(a), rows):
        part = out[start : start + rows]
        room = diff[: len(part)]
        for j in range(a.shape[1]):
            np.subtract(a[start : start + rows, j, None], across[j], out=room)
            np.multiply(room, room, out=room)
            part += room
    return np.sqrt(out, out=out)


def pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The entries (i, j) of ``distances(a, b)``, bit by bit."""
    out = np.zeros(len(i))
    for k in range(a.shape[1]):
        diff = a[i, k] - b[j, k]
        out += diff * diff
    return np.sqrt(out, out=out)


class Squares:
    """Squared distances by a matrix product, tile by tile, and a bound of how far they may be off.

    The product costs a fraction of the sum over dimensions, but its last digits depend on the
    tile. What is decided by them (ties, limits) is taken from ``pair_distances``. ``tame`` is
    false where a vector is not finite or its square is beyond a double: nothing is bounded then.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        middle = b.mean(axis=0) if len(b) else 0.0
        with np.errstate(over="ignore", invalid="ignore"):
            self.a, self.b = a - middle, b - middle
            self.na, self.nb = (self.a**2).sum(axis=1), (self.b**2).sum(axis=1)
        top = max(self.na.max(initial=0.0), self.nb.max(initial=0.0))
        self.tame = bool(np.isfinite(a).all() and np.isfinite(b).all() and np.isfinite(top) and top < 1e300)
        # Entries below this are those of the origin or so near to it that their squares lose digits.
        self.tiny = 1e-280
        self.unit = 8.0 * (a.shape[1] + 4) * np.finfo(float).eps

    def tile(self, at: slice, on: slice) -> np.ndarray:
        d2 = (self.a[at] * -2.0) @ self.b[on].T
        d2 += self.na[at, None]
        d2 += self.nb[None, on]
        return d2

    def slack(self, at: slice, on: slice) -> np.ndarray:
        """Per row of a tile: how far an entry may be from the square of the exact distance."""
        return self.unit * (self.na[at] + self.nb[on].max(initial=0.0)) + self.tiny


def slices(n: int, size: int) -> list[slice]:
    return [slice(start, min(start + size, n)) for start in range(0, n, size)]


TILE_ROWS, TILE_COLUMNS = 64, 4096
# Below so many dimensions the sum over them costs no more than a product and its repairs.
FEW = 12


def lengths(a: np.ndarray, b: np.ndarray, squares: Squares | None = None, at: slice = slice(None)) -> np.ndarray:
    """Distances of the rows ``at`` of ``a`` for sums over many pairs: some last digits may differ from ``distances``.

    Pairs that are near for the size of their vectors lose digits in the product and are measured one by one.
    """
    if a.shape[1] < FEW:
        return distances(a[at], b)
    squares = squares or Squares(a, b)
    if not squares.tame:
        return distances(a[at], b)
    d2 = squares.tile(at, slice(None))
    i, j = np.nonzero(d2 < (1e-3 * (squares.na[at] + squares.nb.max(initial=0.0)) + squares.tiny)[:, None])
    if 8 * len(i) > d2.size:
        return distances(a[at], b)
    d2[i, j] = 0.0
    out = np.sqrt(d2, out=d2)
    out[i, j] = pair_distances(a[at], b, i, j)
    return out


def nearest_pairs(
    a: np.ndarray, b: np.ndarray, mine: np.ndarray, ids: np.ndarray, k: int, within: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, distance) of the k nearest of every row of ``a`` but those of its own id; ``ids`` ascending, so ties go to the lower id.

    The same as ``smallest`` of all ``distances``: the product only leaves out what cannot be among them. ``within``
    holds a distance per row beyond which nothing is asked.
    """
    squares = Squares(a, b)
    k = min(k, len(b))
    if k == 0 or not len(a):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    if not squares.tame:
        found = []
        for at in slices(len(a), 256):
            d = distances(a[at], b)
            d[mine[at, None] == ids[None, :]] = np.inf
            if within is not None:
                d[d > within[at, None]] = np.inf
            rows, cols = smallest(d, ids, k)
            found.append((rows + at.start, cols, d[rows, cols]))
        return tuple(np.concatenate(x) for x in zip(*found))
    out = []
    for at in slices(len(a), TILE_ROWS):
        bound = np.full(at.stop - at.start, np.inf) if within is None else within[at] ** 2 * (1 + 1e-12) + squares.slack(at, slice(None))
        rows, cols, low = [], [], []
        for on in slices(len(b), TILE_COLUMNS):
            d2, slack = squares.tile(at, on), squares.slack(at, on)
            own_i, own_j = same_ids(mine[at], ids[on])
            d2[own_i, own_j] = np.inf
            if not rows and within is None or np.count_nonzero(d2 <= (bound + slack)[:, None]) > 4 * k * len(d2):
                if k <= d2.shape[1]:
                    bound = np.minimum(bound, np.partition(d2, k - 1, axis=1)[:, k - 1] + slack)
            i, j = np.nonzero((d2 <= (bound + slack)[:, None]) & (d2 < np.inf))
            rows.append(i)
            cols.append(j + on.start)
            low.append(d2[i, j] - slack[i])
        i, j = np.concatenate(rows), np.concatenate(cols)
        keep = np.concatenate(low) <= bound[i]
        i, j = i[keep], j[keep]
        d = pair_distances(a[at], b, i, j)
        if within is not None:
            near = d <= within[at][i]
            i, j, d = i[near], j[near], d[near]
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        out.append((i[first] + at.start, j[first], d[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def same_ids(mine: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of equal ids; ``ids`` ascending."""
    low, high = np.searchsorted(ids, mine, side="left"), np.searchsorted(ids, mine, side="right")
    n = high - low
    rows = np.repeat(np.arange(len(mine)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k smallest finite entries per row; ``ids`` ascending, so ties go to the lower id."""
    k = min(k, d.shape[1])
    if k == 0 or not len(d):
        return np.empty(0, int), np.empty(0, int)
    cut = np.partition(d, k - 1, axis=1)[:, k - 1]
    rows, cols = np.nonzero((d <= cut[:, None]) & np.isfinite(d))
    order = np.lexsort((ids[cols], d[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[place < k], cols[place < k]


_DTYPES = {"bigint": "int64", "int": "int32", "double": "float64", "string": "object"}


def guarded(fn, schema: str):
    """``fn`` on blocks with rows on both sides; a chunk may be empty on one. Text columns leave as plain lists."""
    columns = dict(part.strip().split(" ", 1) for part in schema.split(","))

    def run(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({c: pd.Series(dtype=_DTYPES[t]) for c, t in columns.items()})
        out = fn(q.reset_index(drop=True), s.reset_index(drop=True))
        return pd.DataFrame({c: pd.Series(np.asarray(out[c], dtype=_DTYPES[t])) for c, t in columns.items()})

    return run


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, so that both sides of a cogroup may share a source."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _place_schema(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", cell int, reach double"


def _placer(pivots: dict[str, np.ndarray], vector: str):
    def place(batches):
        for pdf in batches:
            cell = np.zeros(len(pdf), dtype="int32")
            reach = np.zeros(len(pdf))
            for node, at in pdf.groupby(NODE).indices.items():
                if node in pivots and len(at):
                    d = distances(matrix(pdf[vector].iloc[at]), pivots[node])
                    cell[at] = d.argmin(axis=1)
                    reach[at] = d.min(axis=1)
            yield pdf.assign(cell=cell, reach=reach)

    return place


def _cell_plan(queries: DataFrame, candidates: DataFrame, pivots: dict, reach: Reach, block_rows: int) -> list[tuple]:
    """(node, query cell, candidate cell, least pivot distance, query chunks, candidate chunks) worth visiting.

    All inputs are per cell; the number of cells is bounded by the number of pivots.
    """
    of = lambda df: {(r[NODE], r["cell"]): r for r in df.collect()}
    # Rows without a distance have no reach and meet nobody.
    big = F.col(NODE).isin(list(pivots)) & F.col("reach").isNotNull() & ~F.isnan("reach")
    kind = F.col(reach.foreign) if reach.foreign else F.lit(None)
    facts = [F.count("*").alias("n"), F.max("reach").alias("far"), F.min(kind).alias("low"), F.max(kind).alias("high")]
    limit_of = F.max(reach.column if reach.column else F.lit(reach.radius)).alias("limit")
    q = of(queries.where(big).groupBy(NODE, "cell").agg(*facts, limit_of))
    s = of(candidates.where(big).groupBy(NODE, "cell").agg(*facts))
    near: dict[tuple, list[float]] = {}
    if reach.k:
        nearest = Window.partitionBy(NODE, "cell").orderBy("reach")
        first = candidates.where(big).select(NODE, "cell", "reach").withColumn("rn", F.row_number().over(nearest))
        for r in first.where(F.col("rn") <= reach.k + 1).collect():
            near.setdefault((r[NODE], r["cell"]), []).append(r["reach"])
    plan = []
    for node, points in pivots.items():
        apart = distances(points, points)
        cells = sorted(c for n, c in s if n == node)
        for c in sorted(c for n, c in q if n == node):
            far = q[node, c]["far"]
            if reach.k:
                # Any k + 1 candidates bound the k-th neighbour; one of them may be the row itself.
                bounds = np.sort(np.concatenate([far + apart[c, e] + np.array(near[node, e]) for e in cells]))
                limit = bounds[reach.k] if len(bounds) > reach.k else math.inf
            else:
                limit = q[node, c]["limit"]
            for e in cells:
                kinds = {v for r in (q[node, c], s[node, e]) for v in (r["low"], r["high"])}
                if reach.foreign and len(kinds) == 1:
                    continue
                least = apart[c, e] - far - limit
                least -= 1e-9 * (1.0 + abs(apart[c, e]))  # room for rounding
                if s[node, e]["far"] >= least:
                    plan.append(
                        (node, c, e, float(max(least, -1.0)), math.ceil(q[node, c]["n"] / block_rows), math.ceil(s[node, e]["n"] / block_rows))
                    )
    return plan


_PLAN_SCHEMA = f"{NODE} string, q_cell int, s_cell int, least double, q_chunks bigint, s_chunks bigint"
_KEY = [NODE, "q_cell", "q_chunk", "s_cell", "s_chunk"]


def chunks(n: Column, block_rows: int) -> Column:
    """Into how many chunks a side is cut where all its rows meet the other side.

    Every chunk is read once per chunk of the other side, so chunks are ``WIDE`` blocks long;
    smaller nodes have ``WIDE`` chunks, enough pairs to go round.
    """
    return F.greatest(F.ceil(n / (WIDE * block_rows)), F.least(F.lit(WIDE), F.ceil(n / block_rows)))


def draw_pivots(candidates: DataFrame, sizes: DataFrame, vector: str, block_rows: int) -> dict[str, np.ndarray]:
    """Pivots of the nodes of ``sizes`` (node_id, nq, ns) that take more than one block.

    They are drawn by hash among rows that have a distance; which rows they are changes the work, never the answer.
    """
    crowded = sizes.where(F.greatest("nq", "ns") > block_rows)
    total = crowded.agg(F.sum("ns")).head()[0]
    if not total:
        return {}
    share = min(1.0, min(PIVOTS, max(1, total // block_rows)) / total)
    drawn = F.pmod(F.xxhash64(F.lit(7), "row_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    found: dict[str, list] = {}
    for r in finite_rows(candidates, vector).join(crowded.select(NODE), NODE, "left_semi").where(drawn).select(NODE, vector).limit(2 * PIVOTS).collect():
        found.setdefault(r[NODE], []).append(r[vector])
    return {n: np.unique(np.array(v, dtype=float), axis=0) for n, v in found.items()}


def _placed(df: DataFrame, pivots: dict[str, np.ndarray], vector: str) -> DataFrame:
    """Rows with their cell and their distance from its pivot; they are read by the cell statistics and by the blocks."""
    if not pivots:
        return df.withColumns({"cell": F.lit(0), "reach": F.lit(0.0)})
    return cut_lineage(df.mapInPandas(_placer(pivots, vector), _place_schema(df)))


def placed_rows(points: DataFrame, vector: str = "features", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """Rows placed once, and the pivots, for several calls of ``block_join`` on them."""
    sizes = points.groupBy(NODE).agg(F.count("*").alias("nq")).withColumn("ns", F.col("nq"))
    pivots = draw_pivots(points, hold(sizes), vector, block_rows)
    return _placed(points, pivots, vector), pivots


def block_join(
    queries: DataFrame,
    candidates: DataFrame,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    vector: str = "features",
    reach: Reach | None = None,
    block_rows: int = BLOCK_ROWS,
    once: bool = False,
    pivots: dict[str, np.ndarray] | None = None,
    tiled: bool = False,
) -> tuple[DataFrame, bool]:
    """(answers, whole): ``fn(query block, candidate block)`` over the blocks that matter.

    Both sides hold (node_id string, row_id bigint, ``vector``, ...). ``whole`` is true when
    every node fitted into one block, so each query row was answered exactly once; else the
    caller merges partial answers. ``once`` visits each unordered pair of blocks once, for
    symmetric work on one table. ``pivots`` says that both sides come from ``placed_rows``.
    Without ``reach`` blocks are up to ``WIDE`` times larger, and with ``tiled`` also those of
    wide vectors with one: ``fn`` then goes by tiles and never holds a block's distances at once.
    """
    same = queries is candidates
    fn = guarded(fn, schema)
    nq = queries.groupBy(NODE).agg(F.count("*").alias("nq"), F.max(F.size(vector)).alias("width"))
    sizes = nq.withColumn("ns", F.col("nq")) if same else nq.join(candidates.groupBy(NODE).agg(F.count("*").alias("ns")), NODE)
    sizes = hold(sizes)
    largest, width = sizes.agg(F.max(F.greatest("nq", "ns")), F.max("width")).head()
    largest = largest or 0
    if largest <= block_rows:
        if same:
            return queries.groupBy(NODE).applyInPandas(lambda g: fn(g, g), schema), True
        return queries.groupBy(NODE).cogroup(_fresh(candidates).groupBy(NODE)).applyInPandas(lambda q, s: fn(q, s), schema), True

    if tiled and reach is not None:
        # The wider the vectors, the dearer their transport and the less pivots tell: larger cells, at least ``WIDE``.
        block_rows *= max(1, min(WIDE, (width or 0) // 8, largest // (WIDE * block_rows)))
    if pivots is None:
        pivots = draw_pivots(candidates, sizes, vector, block_rows) if reach is not None else {}
        q = _placed(queries, pivots, vector)
        s = q if same else _placed(candidates, pivots, vector)
    else:
        q, s = queries, candidates
    plain = sizes.where(~F.col(NODE).isin(list(pivots))) if pivots else sizes
    plan = plain.select(
        NODE, F.lit(0).alias("q_cell"), F.lit(0).alias("s_cell"), F.lit(-1.0).alias("least"),
        chunks(F.col("nq"), block_rows).alias("q_chunks"), chunks(F.col("ns"), block_rows).alias("s_chunks"),
    )
    if pivots:
        rows = _cell_plan(q, s, pivots, reach, block_rows)
        plan = plan.unionByName(queries.sparkSession.createDataFrame(rows, _PLAN_SCHEMA))
    return meet(q.withColumnRenamed("cell", "q_cell").drop("reach"), s, plan, fn, schema, once=once), False


def meet(asks: DataFrame, rows: DataFrame, plan: DataFrame, fn, schema: str, *more: str, once: bool = False) -> DataFrame:
    """``fn(query block, candidate block)`` over the chunks of the cell pairs of a plan.

    ``asks`` has ``q_cell``, ``rows`` has ``cell`` and ``reach``; ``more`` names columns that
    part the queries further, found in ``asks`` and ``plan``.
    """
    key = [*_KEY, *more]
    chunk = lambda n: F.pmod(F.xxhash64(F.lit(11), "row_id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    asks = asks.join(plan, [NODE, "q_cell", *more])
    asks = asks.withColumn("q_chunk", chunk("q_chunks")).withColumn("s_chunk", spread("s_chunks")).drop("least", "q_chunks", "s_chunks")
    gives = rows.withColumnRenamed("cell", "s_cell").join(plan, [NODE, "s_cell"]).where(F.col("reach") >= F.col("least"))
    gives = gives.withColumn("s_chunk", chunk("s_chunks")).withColumn("q_chunk", spread("q_chunks")).drop("least", "q_chunks", "s_chunks", "reach")
    if once:
        ordered = (F.col("q_cell") < F.col("s_cell")) | ((F.col("q_cell") == F.col("s_cell")) & (F.col("q_chunk") <= F.col("s_chunk")))
        asks, gives = asks.where(ordered), gives.where(ordered)
    return asks.groupBy(*key).cogroup(_fresh(gives).groupBy(*key)).applyInPandas(lambda a, b: fn(a, b), schema)


def finite_rows(df: DataFrame, vector: str) -> DataFrame:
    """Rows that have a distance at all."""
    known = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))
    return df.where(F.coalesce(F.forall(vector, lambda x: known(x.cast("double"))), F.lit(False)))


class Guide:
    """Which cells a row has to visit for its k nearest candidates outside its selection.

    ``facts`` holds (node_id, cell, sels, n, far, near) per cell and set of selections: rows, largest reach and the
    k + 1 smallest ones. ``NONE`` is the selection of rows that leave out nobody.
    """

    NONE = ""

    def __init__(self, pivots: dict[str, np.ndarray], facts: list, k: int, names: list[str]):
        self.pivots = pivots
        self.apart = {node: distances(points, points) for node, points in pivots.items()}
        self.index = {name: i for i, name in enumerate(names)}
        self.far, self.kth = ({node: np.full((len(names), len(points)), start) for node, points in pivots.items()} for start in (-np.inf, np.inf))
        reaches: dict[tuple, list[float]] = {}
        for node, cell, sels, _, far, near in facts:
            inside = {self.index[x] for x in sels or ()}
            for i in (i for i in range(len(names)) if i not in inside):
                self.far[node][i, cell] = max(self.far[node][i, cell], far)
                reaches.setdefault((node, i, cell), []).extend(near)
        for (node, i, cell), near in reaches.items():
            if len(near) > k:
                self.kth[node][i, cell] = sorted(near)[k]

    def _tiles(self, pdf: pd.DataFrame, vector: str):
        for (node, name), at in pdf.groupby([NODE, "of"]).indices.items():
            for part in slices(len(at), 1024):
                here = at[part]
                yield node, self.index[name], here, distances(matrix(pdf[vector].iloc[here]), self.pivots[node])

    def first(self, vector: str):
        """Adds ``q_cell``, where k candidates are known to be near."""

        def run(batches):
            for pdf in batches:
                cell = np.zeros(len(pdf), dtype="int32")
                for node, i, here, d in self._tiles(pdf, vector):
                    known = np.isfinite(self.kth[node][i])
                    some = np.isfinite(self.far[node][i])
                    cell[here] = np.where(known, d + self.kth[node][i], np.inf).argmin(axis=1) if known.any() else np.where(some, d, np.inf).argmin(axis=1)
                yield pdf.assign(q_cell=cell)

        return run

    def others(self, vector: str):
        """A row per further cell that may hold a candidate within ``within``."""

        def run(batches):
            for pdf in batches:
                rows, cells = [np.zeros(0, int)], [np.zeros(0, int)]
                first, within = pdf["q_cell"].to_numpy(), pdf["within"].to_numpy()
                for node, i, here, d in self._tiles(pdf, vector):
                    own, limit = d.argmin(axis=1), within[here, None]
                    apart = self.apart[node][own]
                    with np.errstate(all="ignore"):
                        room = 1e-9 * (1.0 + d)
                        out = d - self.far[node][i] - limit > room
                        # A cell's rows are on its side of the plane between its pivot and the row's own.
                        out |= (d * d - d[np.arange(len(d)), own, None] ** 2) / (2.0 * apart) - limit > room * (1.0 + d / apart)
                    out |= ~np.isfinite(self.far[node][i])
                    out[np.arange(len(d)), first[here]] = True
                    r, c = np.nonzero(~out)
                    rows.append(here[r])
                    cells.append(c)
                rows, cells = np.concatenate(rows), np.concatenate(cells).astype("int32")
                for part in slices(len(rows), 1 << 16):
                    yield pdf.iloc[rows[part]].assign(q_cell=cells[part])

        return run


# Most pairs of a selection and a cell that are told to the tasks.
GUIDED = 1 << 20


def guided_nearest(queries: DataFrame, candidates: DataFrame, k: int, block, schema: str, vector: str, pivots: dict[str, np.ndarray], block_rows: int = BLOCK_ROWS) -> DataFrame | None:
    """Partial lists of the k nearest candidates of all queries, or None where there are too many selections to tell.

    ``queries`` have ``of``, the name of a selection or ``Guide.NONE``, ``candidates`` have ``sels``, those they are in.
    A query visits the cell that is known to hold k candidates near it, then every other cell that may hold one
    within the k-th distance found; ``block`` finds them, within ``within`` where that is not null.
    """
    names = [r["of"] for r in queries.select("of").distinct().limit(GUIDED).collect()]
    if len(names) * sum(len(x) for x in pivots.values()) > GUIDED:
        return None
    names = sorted({*names, Guide.NONE})
    rows = _placed(candidates, pivots, vector)
    told = rows.withColumn("sels", F.array_sort(F.filter(F.coalesce("sels", F.array().cast("array<string>")), lambda x: x.isin(names))))
    order = Window.partitionBy(NODE, "cell", "sels").orderBy("reach")
    nearest = F.array_sort(F.collect_list(F.when(F.col("rn") <= k + 1, F.col("reach"))))
    facts = told.withColumn("rn", F.row_number().over(order)).groupBy(NODE, "cell", "sels").agg(F.count("*").alias("n"), F.max("reach").alias("far"), nearest.alias("near"))
    facts = facts.limit(GUIDED // (k + 1) + 1).collect()
    if len(facts) > GUIDED // (k + 1):
        return None
    guide = Guide(pivots, [tuple(r) for r in facts], k, names)
    fields = ", ".join(f"`{n}` {t}" for n, t in queries.dtypes)
    asks = cut_lineage(queries.mapInPandas(guide.first(vector), f"{fields}, q_cell int"))
    fn = guarded(block, schema)

    def visited(asks: DataFrame) -> DataFrame:
        nq = asks.groupBy(NODE, "q_cell").agg(F.count("*").alias("nq"))
        ns = rows.groupBy(NODE, F.col("cell").alias("q_cell")).agg(F.count("*").alias("ns"))
        plan = nq.join(ns, [NODE, "q_cell"]).select(
            NODE, "q_cell", F.col("q_cell").alias("s_cell"), F.lit(-1.0).alias("least"), chunks(F.col("nq"), block_rows).alias("q_chunks"), chunks(F.col("ns"), block_rows).alias("s_chunks")
        )
        return meet(asks, rows, hold(plan), fn, schema)

    found = hold(visited(asks.withColumn("within", F.lit(math.inf))))
    place = F.row_number().over(Window.partitionBy(NODE, "of", "row_id").orderBy("dist"))
    kth = found.withColumn("rank", place).where(F.col("rank") == k).select(NODE, "of", "row_id", F.col("dist").alias("within"))
    asks = asks.join(kth, [NODE, "of", "row_id"], "left").withColumn("within", F.coalesce("within", F.lit(math.inf)))
    further = asks.mapInPandas(guide.others(vector), f"{fields}, q_cell int, within double")
    return found.unionByName(visited(further))
