"""Quality classifier by compression: dictionaries of good and of bad text, and which one helps more.

Two zstandard dictionaries are built from labelled texts. A text is compressed in blocks of
``BLOCK`` bytes with each of them, so that a long text is measured like a short one; the
difference of the two sizes per byte becomes a score through a logistic curve, fitted on
labelled texts that built neither dictionary.

The fit looks at most at ``rows_per_class`` labelled rows of each class, the first by the hash of
their id, of at most ``MAX_CHARS`` characters each: that bounds what the driver gathers. Scoring
reads every whole text in one pass without a shuffle.

Defined cases: a null or empty text has no difference and gets the curve's value at zero;
labels other than 0 and 1, labels without a document and null ids are not learnt from; without
labels of both classes every score is the share of label 1, or one half without any label;
repeated rows are scored one by one; an empty table gives an empty result; other columns are
not looked at by ``score`` and kept by ``accepted``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, whole_text

ROWS_PER_CLASS = 3000
MAX_CHARS = 32_768
FOLDS = 5
HELD_OUT = 0
ACCEPT = 0.3
DICTIONARY = 112_640
BLOCK = 1024
#: Bytes added to a text's size, so that a handful of bytes can't decide for a tiny text.
PRIOR_BYTES = 200
LEVEL = 3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts themselves where they are too few to train on."""
    import zstandard

    blocks = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[:DICTIONARY]


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    slope: float = 0.0
    intercept: float = 0.0
    _sizes: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return (self.good, self.bad, self.slope, self.intercept)

    def __setstate__(self, state):
        self.good, self.bad, self.slope, self.intercept = state
        self._sizes = []

    def difference(self, text: bytes) -> float:
        """Bytes that the good dictionary saves over the bad one, per byte of the text."""
        if not text or not self.slope and not self.good:
            return 0.0
        if not self._sizes:
            import zstandard

            for raw in (self.good, self.bad):
                held = zstandard.ZstdCompressionDict(raw)
                held.precompute_compress(level=LEVEL)
                self._sizes.append(zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_dict_id=False))
        good, bad = (sum(len(c.compress(b)) for b in _blocks(text)) for c in self._sizes)
        return (bad - good) / (len(text) + PRIOR_BYTES)

    def score(self, text: bytes) -> float:
        z = self.slope * self.difference(text) + self.intercept
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(slope, intercept) of largest likelihood by Newton steps, with a faint pull to zero."""
    centre, width = x.mean(), x.std() or 1.0
    design = np.stack([(x - centre) / width, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / width), float(w[1] - w[0] * centre / width)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", rows_per_class: int = ROWS_PER_CLASS) -> Model:
    """Learn from labelled documents outside the held-out fold."""
    known = labels.select(labels[id_column].cast("long").alias("k"), labels[label].cast("int").alias("y"))
    known = known.where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & (fold_of(F.col("k"), FOLDS) != HELD_OUT)).distinct()
    own = docs.select(docs[id_column].cast("long").alias("k"), whole_text(docs, text).alias("t")).where(F.length("t").between(1, MAX_CHARS))
    drawn = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(rows_per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    # At most two times rows_per_class ids, whatever the tables hold.
    rows = own.join(F.broadcast(drawn), "k").groupBy("k", "y", "h").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: (r.h, r.k, r.y))
    shares = [r.y for r in rows]
    if len(set(shares)) < 2:
        share = min(max(sum(shares) / len(shares), 1e-3), 1 - 1e-3) if shares else 0.5
        return Model(intercept=math.log(share / (1 - share)))
    by = {y: [r.t.encode() for r in rows if r.y == y] for y in (0, 1)}
    # Every other text of a class builds its dictionary, the rest fit the curve.
    model = Model(good=dictionary(by[1][::2]), bad=dictionary(by[0][::2]))
    rest = [(t, y) for y in (0, 1) for t in (by[y][1::2] or by[y])]
    x = np.array([model.difference(t) for t, _ in rest])
    model.slope, model.intercept = logistic(x, np.array([y for _, y in rest], dtype=float))
    return model


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [model.score(t.as_buffer().to_pybytes()) for t in batch.column(2)]
            out = [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= ACCEPT) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "score", "predicted"])

    key = docs[id_column].cast("long")
    return docs.select(key.alias("doc_id"), (fold_of(key, FOLDS) == HELD_OUT).alias("held_out"), whole_text(docs, text).alias("text")).mapInArrow(scored, SCHEMA)


def accepted(docs: DataFrame, model: Model, text: str = "text", threshold: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with their columns."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")
            keep = pa.array([model.score(t.as_buffer().to_pybytes()) >= threshold for t in texts], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(kept, docs.schema)
