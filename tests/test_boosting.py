"""Trees grown in one task against Spark's own fit, and the settings of the registered model queries."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bedside.operators import boosting, models


@pytest.fixture(scope="module")
def training(spark):
    base = spark.range(0, 600, 1, 2).select("id", F.rand(3).alias("x"), F.floor(F.rand(5) * 40).alias("few"), F.rand(7).alias("noise"))
    shifted = F.col("x") + F.col("few") / 50 + 0.3 * F.col("noise")
    return base.withColumns({"same": F.lit(1.0), "label": (shifted > 0.9).cast("int"), "half": (F.col("id") % 2).cast("int")}).cache()


COLUMNS = ("x", "few", "noise", "same", "half")


@pytest.mark.parametrize("min_rows, depth", [(100, 6), (20, 6), (40, 3)])  # in small nodes splits may tie
def test_one_task_grows_the_trees_of_sparks_fit(training, min_rows, depth):
    params = models.GbtParams(learning_rate=0.3, max_depth=depth, min_rows=min_rows)
    rows = models._assemble(training, COLUMNS, "label", ["id"]).cache()
    ours, theirs = models._fit(rows, "label", params, 8), models._fit(rows, "label", params, 8, max_cells=0)
    assert isinstance(ours, boosting.Grown) and not isinstance(theirs, boosting.Grown)
    assert ours.sizes() == [t.numNodes for t in theirs.trees] == [t.numNodes for t in ours.trees] and ours.getNumTrees == 8
    splits = ["tree", "feature", F.round("threshold", 9).alias("threshold"), "rows"]
    a, b = (models.node_table(models.Trained(m, COLUMNS, 8)).select(*splits) for m in (ours, theirs))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0
    assert np.allclose(ours.featureImportances, theirs.featureImportances.toArray(), atol=1e-9)
    assert np.allclose(ours.evaluateEachIteration(rows), theirs.evaluateEachIteration(rows), atol=1e-9)
    for n in (8, 3):
        mine = models.predict(models.Trained(models.first_trees(ours, n), COLUMNS, n), training, "label", ["id"])
        other = models.predict(models.Trained(models.first_trees(theirs, n), COLUMNS, n), training, "label", ["id"])
        loaded = ours.first(n, models._model_folder()).transform(rows).select("id", vector_to_array("probability")[1].alias("score"))
        found = [dict(s.select("id", "score").collect()) for s in (mine, other, loaded)]
        assert len(found[0]) == 600
        assert all(abs(found[0][i] - found[1][i]) < 1e-9 and abs(found[0][i] - found[2][i]) < 1e-12 for i in found[1])


def test_rows_with_equal_bins_count_as_often_as_they_come(training):
    params = models.GbtParams(learning_rate=0.3, max_depth=3, min_rows=60)
    once = models._fit(models._assemble(training, COLUMNS, "label"), "label", models.GbtParams(0.3, 3, 20), 5)
    thrice = models._fit(models._assemble(training.union(training).union(training), COLUMNS, "label"), "label", params, 5)
    assert once.sizes() == thrice.sizes() and np.allclose(once._nodes["threshold"], thrice._nodes["threshold"], equal_nan=True)
    assert (3 * once._nodes["n"] == thrice._nodes["n"]).all() and np.allclose(3 * once._nodes["total"], thrice._nodes["total"])


def test_thresholds():
    assert boosting.thresholds(np.array([3.0, 1.0, 1.0, 2.0]), 32).tolist() == [1.5, 2.5]
    assert len(boosting.thresholds(np.full(9, 4.0), 32)) == 0
    cuts = boosting.thresholds(np.arange(1000.0), 10)
    assert cuts.tolist() == [100 * i - 0.5 for i in range(1, 10)]
    crowd = boosting.thresholds(np.array([0.0] * 900 + list(range(1, 101))), 4)
    assert 1 <= len(crowd) <= 3 and (np.diff(crowd) > 0).all()


def test_many_features_are_collapsed_by_ranks():
    bins = np.random.default_rng(1).integers(0, 2, (40, 300))
    bins[3:] = bins[2]
    label = np.arange(300) % 2
    places, counts = boosting.collapse(bins, 32, label)
    assert counts.sum() == 300 and len(places) == len({(*b, y) for b, y in zip(bins.T.tolist(), label.tolist())}) <= 16


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Documents with labels, many enough for nodes of 100 rows."""
    rng, place = np.random.default_rng(4), tmp_path_factory.mktemp("tables")
    n = 420
    words, commas = rng.integers(1, 200, n), rng.integers(0, 9, n)
    texts = ["a " * int(w) + "," * int(c) + "1\n" * int(w % 5) + "*" * int(c % 3) for w, c in zip(words, commas)]
    quality = ((words + 10 * commas + rng.normal(0, 40, n)) > 110).astype(int)
    pq.write_table(pa.table({"doc_id": np.arange(n), "text": texts}), place / "documents.parquet")
    pq.write_table(pa.table({"doc_id": np.arange(n), "quality": quality, "toxic": 1 - quality}), place / "labels.parquet")
    return str(place)


@pytest.fixture
def fits(monkeypatch):
    """The settings and rounds of every fit."""
    seen, fit = [], models._fit
    monkeypatch.setattr(models, "_fit", lambda rows, label, params, rounds: seen.append((params, rounds)) or fit(rows, label, params, rounds))
    return seen


PUBLISHED = models.GbtParams(learning_rate=0.035, max_depth=6, min_rows=100, rounds=3000, patience=100)


@pytest.fixture(scope="module")
def copied(folder, tmp_path_factory):
    """The same tables in other folders: what a query trains is kept per folder."""

    def copy() -> str:
        place = tmp_path_factory.mktemp("copy")
        for name in ("documents", "labels"):
            pq.write_table(pq.read_table(f"{folder}/{name}.parquet"), place / f"{name}.parquet")
        return str(place)

    return copy


def test_gbt_auc_trains_with_the_published_settings(spark, copied, fits):
    found = {r["part"]: r["auc"] for r in entry.queries()["gbt_auc"](spark, copied()).collect()}
    assert {params for params, _ in fits} == {PUBLISHED}
    assert sum(rounds >= 200 for _, rounds in fits) >= 5  # a fold is first fitted for twice the patience, then for more if it still gains
    assert set(found) == {"out_of_fold", "test"} and min(found.values()) > 0.7


def test_gbt_importance_counts_the_trees_of_the_published_settings(spark, copied, fits):
    found = entry.queries()["gbt_importance"](spark, copied()).collect()
    assert {params for params, _ in fits} == {PUBLISHED} and len(found) == 12
    assert sum(r["split_mean"] for r in found) > 30 and abs(sum(r["gain_mean"] for r in found) - 100) < 1e-6  # a tree of some 270 rows has one split


ELIMINATED = models.GbtParams(learning_rate=0.03, max_depth=6, min_rows=20, rounds=300, seed=1)


def test_rfe_eliminates_with_the_published_settings(spark, copied, fits):
    found = entry.queries()["rfe"](spark, copied()).collect()
    assert fits == [(ELIMINATED, 300)] * 72  # 12 feature counts on the paths of five folds and of all rows
    assert sorted(r["n_features"] for r in found) == list(range(1, 13)) and sum(r["chosen"] for r in found) == 1


def test_rfe_grid_scores_every_count_with_the_published_settings(spark, copied, fits):
    found = entry.queries()["rfe_grid"](spark, copied()).collect()
    assert fits == [(ELIMINATED, 300)] * 72
    assert sorted(tuple(r) for r in found) == [(n, True, True) for n in range(1, 13)]
