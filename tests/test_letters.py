"""Letter shares of documents whose text is empty or missing, in tables of one block and of many."""

import numpy as np
import pytest

import __spark_entry__ as entry
from stratalens.catalog.inputs import LETTER_COLUMNS, letter_points, letter_rows
from stratalens.operators import density as D
from stratalens.operators import projection as PR


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of made-up letters; 3 is empty, 4 has no text."""
    rng, letters = np.random.default_rng(5), list("héuzow" + "abcdefgij")
    texts = ["".join(rng.choice(letters, 40, p=rng.dirichlet(np.full(len(letters), 8.0)))) for _ in range(60)]
    rows = [(i, {3: "", 4: None}.get(i, t), "de" if i % 2 else "fr", "web", 40) for i, t in enumerate(texts)]
    top = tmp_path_factory.mktemp("letters")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"file://{top}/documents.parquet")
    return str(top)


def test_an_empty_text_has_no_shares(spark, folder):
    rows = {r["row_id"]: r for r in letter_rows(spark, folder).collect()}
    assert len(rows) == 60
    assert all(rows[i][c] is None for i in (3, 4) for c in LETTER_COLUMNS)
    assert all(rows[i][c] is not None for i in rows if i not in (3, 4) for c in LETTER_COLUMNS)


def test_documents_without_text_have_no_place(spark, folder):
    placed, _ = PR.pca(letter_points(spark, folder), 6, 2)
    assert sorted(r["row_id"] for r in placed.collect()) == [i for i in range(60) if i not in (3, 4)]


@pytest.mark.parametrize("query", ["k3_dbscan", "k4_hdbscan"])
def test_documents_without_text_are_noise(spark, folder, query):
    labels = {r["row_id"]: r["label"] for r in entry.queries()[query](spark, folder).collect()}
    assert len(labels) == 60 and labels[3] == labels[4] == -1


def test_rows_without_distances_are_no_pivots(spark):
    rng = np.random.default_rng(6)
    rows = [("n", i, [None, 0.0] if i % 3 == 0 else [float("nan"), 1.0] if i % 3 == 1 else [float(v) for v in rng.normal(0, 1, 2) + 8 * (i % 2)]) for i in range(240)]
    points = spark.createDataFrame(rows, "node_id string, row_id long, features array<double>")
    held = {r["row_id"]: r["label"] for r in D.dbscan(points, 1.0, 4, block_rows=8).collect()}
    whole = {r["row_id"]: r["label"] for r in D.dbscan(points, 1.0, 4).collect()}
    assert held == whole and len(held) == 240
    assert all(held[i] == -1 for i in held if i % 3 < 2) and len({held[i] for i in held if i % 3 == 2} - {-1}) >= 2


def test_validity_takes_rows_without_distances_as_noise(spark):
    rng = np.random.default_rng(7)
    good = [("n", i, [float(v) for v in rng.normal(0, 1, 2) + 8 * (i % 2)], i % 2) for i in range(80)]
    odd = [("n", 100, None, 0), ("n", 101, [None, 1.0], 1), ("n", 102, [float("nan"), 1.0], 1), ("n", 103, [1.0, 2.0], -1)]
    schema = "node_id string, row_id long, features array<double>, label int"
    alone = D.density_validity(spark.createDataFrame(good, schema)).first()
    both = D.density_validity(spark.createDataFrame(good + odd, schema)).first()
    assert both["dbcv"] == pytest.approx(alone["dbcv"] * 80 / 84) and (both["status"], both["n_clusters"]) == ("ok", 2)
