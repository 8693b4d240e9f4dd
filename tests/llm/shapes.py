"""Small tables with every awkward case."""

from __future__ import annotations

import random

WORDS = "the of and river stone walks under bright morning with seven quiet horses that never drink from deep wells near old towers of salt".split()
#: Columns whose names operators use for their own ends.
CLASH = "text2 string, v string, c string, row string, score string, kept string, n_words string, k string, r string, fold string, b string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(WORDS)[:3] for _ in range(2)) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(n))


def documents(spark, texts):
    """Rows (doc_id, text) in the shape of documents with clashing columns."""
    extra = ["x"] * len(CLASH.split(","))
    rows = [(i, t, None, "src0", None if t is None else len(t), *extra) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def awkward():
    """Null and empty texts, a null id, copies, a repeated row, one very long text, white space, other scripts."""
    long_text = " ".join(prose(i, 400) for i in range(60))
    base = prose(7, 120)
    return [
        (1, base), (2, base), (3, None), (4, ""), (5, " \n\t "), (None, base), (None, None), (6, prose(8, 90)), (6, prose(8, 90)),
        (7, long_text), (8, "word"), (9, "Ünï çödé 中文 字符 \x0b tab\tand 😀"), (10, "the " * 300), (11, "a\x1cb\x00c d"), (12, "x" * 40_000),
    ]
