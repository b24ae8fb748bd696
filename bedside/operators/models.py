"""Gradient-boosted classification with cross-validation, importance and feature elimination on Spark ML.

Fits are distributed jobs over one row per entity; the driver only steps through folds, rounds and feature
counts. Trees here grow level by level, so 60 leaves become depth 6.

* Early stopping fits once and cuts the ensemble back to its best round: boosting never changes earlier trees, so the first
  trees of a long fit are the short one. A fit that had not yet stopped is repeated twice as long.
* Folds are independent and their jobs are short, so they are fitted side by side from threads of the driver.
* Rows with their folds are written once to the folder all executors share: fits and predictions, dozens in an elimination, read those
  narrow rows and not what led to them.
* What a model learnt is a table: its nodes as Spark saves them, read back as a DataFrame. Importance is an aggregation of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedside.operators import boosting, metrics
from bedside.operators.features import assign_folds
from bedside.sources import sinks


@dataclass(frozen=True)
class GbtParams:
    """Training parameters; defaults follow the current notebook, ``OLD`` the earlier one."""

    learning_rate: float = 0.035
    max_depth: int = 6
    min_rows: int = 100
    rounds: int = 3000
    patience: int = 100
    feature_fraction: float = 1.0
    seed: int = 520


# fixed values: the three published settings
DEFAULT = GbtParams()
SELECTED = GbtParams(rounds=300)
OLD = GbtParams(feature_fraction=0.7)
ELIMINATION = GbtParams(learning_rate=0.03, max_depth=6, min_rows=20, rounds=300, seed=1)

#: What a fit returns, by the plan it took.
Model = GBTClassificationModel | boosting.Grown
#: Values (rows times features) that one task boosts: 256 MB.
MAX_CELLS = 1 << 25


@dataclass(frozen=True)
class Trained:
    """A model, the columns it reads, and its rounds; no model where there was nothing to learn from."""

    model: Model | None
    columns: tuple[str, ...]
    rounds: int


@dataclass(frozen=True)
class CrossValidated:
    """Held-out predictions of the training rows, mean predictions of the test rows, tree nodes and importance per fold."""

    out_of_fold: DataFrame
    test: DataFrame | None
    nodes: DataFrame
    importance: DataFrame
    folds: tuple[Trained, ...]


def _assemble(df: DataFrame, columns: Sequence[str], label: str, keep: Sequence[str] = ()) -> DataFrame:
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    kept = [c for c in dict.fromkeys([*keep, label]) if c in df.columns]
    return assembler.transform(df).select(*kept, "features")


def _fit(train: DataFrame, label: str, params: GbtParams, rounds: int, max_cells: int | None = None) -> Model:
    """Rows that fit one task are boosted there; more rows, and nodes that look at some features only, take Spark's own fit."""
    fraction = "all" if params.feature_fraction >= 1 else str(params.feature_fraction)
    learner = GBTClassifier(
        labelCol=label,
        stepSize=params.learning_rate,
        maxDepth=params.max_depth,
        minInstancesPerNode=params.min_rows,
        maxIter=rounds,
        featureSubsetStrategy=fraction,
        seed=params.seed,
    )
    cells = F.sum(F.size(vector_to_array("features"))).alias("cells")
    held = train.agg(cells, F.count(F.when(F.coalesce(F.col(label).isin(0, 1), F.lit(False)), None).otherwise(1)).alias("other")).first()
    if fraction != "all" or held["other"] or not 0 < (held["cells"] or 0) <= (MAX_CELLS if max_cells is None else max_cells):  # other labels are refused there
        return learner.fit(train)
    return boosting.fit(learner, train, _model_folder())


def _model_folder() -> str:
    """A new folder among those all executors share, which goes when the driver ends."""
    return sinks.passing_folder(SparkSession.builder.getOrCreate(), f"model-{uuid.uuid4().hex}")


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """Round with the least loss before ``patience`` rounds pass without a gain, and whether that came."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def tree_sizes(model: Model) -> list[int]:
    """Number of nodes of each tree."""
    return model.sizes() if isinstance(model, boosting.Grown) else [t.numNodes for t in model.trees]


def first_trees(model: Model, n: int) -> Model:
    """The model after its first ``n`` rounds."""
    if n >= model.getNumTrees:
        return model
    if isinstance(model, boosting.Grown):
        return model.first(n, _model_folder())
    context = SparkContext.getOrCreate()  # threads have no active session
    jvm, gateway = context._jvm, context._gateway
    trees, weights = model._java_obj.trees(), model.treeWeights
    some = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    factors = gateway.new_array(jvm.double, n)
    for i in range(n):
        some[i], factors[i] = trees[i], weights[i]
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, some, factors))


def splitting_rounds(sizes: Sequence[int]) -> int:
    """Rounds before the first tree that found no split: from there on no tree of a fit on all features finds one."""
    return next((i for i, nodes in enumerate(sizes) if nodes <= 1), len(sizes))


def train_gbt(
    train: DataFrame, valid: DataFrame | None, columns: Sequence[str], label: str, params: GbtParams = DEFAULT
) -> Trained:
    """Fit with early stopping on ``valid``; without it all rounds are used. Inputs must hold no nulls.

    The first fit takes twice ``patience`` rounds, which usually shows the best one; the ensemble is then cut back to it. Only while
    the validation loss is still improving is a fit repeated with twice the rounds, up to ``params.rounds``. Rounds without any split end a fit as
    well, at one tree at least. Without rows or columns there is no model.
    """
    if not columns or train.isEmpty():
        return Trained(None, tuple(columns), 0)
    rows = _assemble(train, columns, label).cache()
    held = None
    try:
        if valid is None:
            return Trained(_fit(rows, label, params, params.rounds), tuple(columns), params.rounds)
        held = _assemble(valid, columns, label).cache()
        whole = params.feature_fraction >= 1
        probe = _fit(rows, label, params, 1) if whole else None
        if probe is not None and tree_sizes(probe)[0] <= 1:
            return Trained(probe, tuple(columns), 1)
        stage = min(params.rounds, 2 * params.patience)
        while True:
            model = _fit(rows, label, params, stage)
            able = splitting_rounds(tree_sizes(model)) if whole else stage
            best, stopped = best_round(model.evaluateEachIteration(held)[: max(1, able)], params.patience)
            if stopped or able < stage or stage == params.rounds:
                return Trained(first_trees(model, best), tuple(columns), best)
            stage = min(params.rounds, 2 * stage)
    finally:
        rows.unpersist()
        if held is not None:
            held.unpersist()


def predict(trained: Trained, df: DataFrame, label: str, keep: Sequence[str], score: str = "score") -> DataFrame:
    """Probability of the positive class, null without a model."""
    if trained.model is None:
        return df.select(*dict.fromkeys([*keep, label]), F.lit(None).cast("double").alias(score))
    rows = _assemble(df, trained.columns, label, keep)
    kept = [c for c in dict.fromkeys([*keep, label]) if c in rows.columns]
    if isinstance(trained.model, boosting.Grown):
        return trained.model.scored(rows, score).select(*kept, score)
    scored = trained.model.transform(rows)
    return scored.select(*kept, vector_to_array("probability")[1].alias(score))


def cross_predict(
    train: DataFrame,
    test: DataFrame | None,
    columns: Sequence[str],
    label: str,
    key: str,
    k: int = 5,
    seed: int = 520,
    params: GbtParams = DEFAULT,
) -> CrossValidated:
    """k fits, each scoring its held-out fold and the whole test set; test scores are averaged per row."""
    wanted = dict.fromkeys([key, label, *columns])
    folded = _written(assign_folds(train, key, k, seed).select(*wanted, "fold"), "train")
    test = _written(test.select(*wanted), "test") if test is not None else None

    def fit(fold: int) -> Trained:
        inside, outside = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        return train_gbt(inside, outside, columns, label, params)

    fits = _side_by_side(train.sparkSession, fit, range(k))
    held_out = [predict(fitted, folded.filter(F.col("fold") == fold), label, [key, "fold"]) for fold, fitted in enumerate(fits)]
    tests = [predict(fitted, test, label, [key]) for fitted in fits] if test is not None else []
    nodes = _union([node_table(fitted).withColumn("fold", F.lit(fold)) for fold, fitted in enumerate(fits)])
    mean_test = None
    if tests:
        mean_test = _union(tests).groupBy(key, label).agg(F.avg("score").alias("score"))
    return CrossValidated(_union(held_out), mean_test, nodes, feature_importance(nodes, columns, ["fold"], k), tuple(fits))


def _side_by_side(spark: SparkSession, work: Callable, numbers: Sequence[int]) -> list:
    """``work`` of all numbers from one thread each, as Spark's own cross-validator does it."""
    pool = ThreadPool(processes=max(1, len(numbers)))
    try:
        return pool.map(inheritable_thread_target(spark)(work), numbers)
    finally:
        pool.close()


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as files that outlive a lost executor; they go when the driver ends."""
    return sinks.materialize(rows, sinks.passing_folder(rows.sparkSession, f"{name}-{uuid.uuid4().hex}"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


NODES = "tree int, node int, feature string, threshold double, gain double, rows bigint, prediction double, left_node int, right_node int"


def node_table(trained: Trained, folder: str | None = None) -> DataFrame:
    """One row per tree node: ``tree, node, feature, threshold, gain, rows, prediction, left_node, right_node``; leaves have no feature.

    The model is saved to ``folder`` (by default a new one in the folder all executors share, which goes when the driver ends) and Spark reads
    the nodes from there.
    """
    spark = SparkSession.builder.getOrCreate()
    if trained.model is None:
        return spark.createDataFrame([], NODES)
    if folder is None:
        folder = _model_folder()
    if isinstance(trained.model, boosting.Grown):
        trained.model.save(folder)
    else:
        trained.model.write().overwrite().save(folder)
    n, inner = F.col("nodeData"), F.col("nodeData.split.featureIndex") >= 0
    names = F.array(*[F.lit(c) for c in trained.columns])
    return spark.read.parquet(f"{folder}/data").select(
        F.col("treeID").alias("tree"),
        n["id"].alias("node"),
        F.when(inner, F.get(names, n["split"]["featureIndex"])).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, n["gain"]).alias("gain"),
        n["rawCount"].alias("rows"),
        n["prediction"].alias("prediction"),
        F.when(inner, n["leftChild"]).alias("left_node"),
        F.when(inner, n["rightChild"]).alias("right_node"),
    )


def feature_importance(nodes: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = 1) -> DataFrame:
    """``feature, gain, split`` of all columns, unused ones included: share of the gain times rows in percent, and number of splits.

    ``by`` may name the fold of the nodes, one of 0 to ``k - 1``.
    """
    spark = nodes.sparkSession
    weight = F.sum(F.col("gain") * F.col("rows"))
    used = nodes.filter("feature IS NOT NULL").groupBy("feature", *by).agg(weight.alias("weight"), F.count("*").alias("split"))
    every = spark.range(len(columns)).select(F.get(F.array(*[F.lit(c) for c in columns]), F.col("id").cast("int")).alias("feature"))
    for name in by:
        every = every.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    total = F.sum("weight").over(Window.partitionBy(*by))
    share = F.coalesce(100 * F.col("weight") / F.when(total > 0, total), F.lit(0.0))
    return every.join(used, ["feature", *by], "left").select("feature", share.alias("gain"), F.coalesce("split", F.lit(0)).alias("split"), *by)


def merge_importance(
    importance: DataFrame, feature: str = "feature", columns: Sequence[str] = ("gain", "split")
) -> DataFrame:
    """Mean importance per feature over folds, runs or files, and how many named it."""
    means = [F.avg(c).alias(f"{c}_mean") for c in columns]
    return importance.groupBy(feature).agg(*means, F.count(F.lit(1)).alias("n"))


def top_features(importance: DataFrame, n: int = 25, by: str = "gain", feature: str = "feature") -> DataFrame:
    """The report of the ``n`` strongest features."""
    return importance.orderBy(F.desc(by), feature).limit(n)


@dataclass(frozen=True)
class Elimination:
    """Mean held-out log-loss per feature count, the best count and the features kept at it."""

    scores: dict[int, float]
    best: int
    selected: tuple[str, ...]


def rfe_cv(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    key: str,
    step: int = 1,
    k: int = 5,
    min_features: int = 1,
    seed: int = 520,
    params: GbtParams = ELIMINATION,
) -> Elimination:
    """Recursive elimination of the weakest features, the count chosen by cross-validated log-loss.

    Every fold walks its own elimination path; the final features are those at the best count (the smaller one on ties) of a path over
    all rows, which is walked beside the folds' paths. With c columns this is about c / step * (k + 1) fits.
    """
    folded = _written(assign_folds(df, key, k, seed).select(*dict.fromkeys([key, label, *columns]), "fold"), "train")

    def walk(fold: int) -> dict:
        """Loss per feature count; from the path over all rows the features."""
        if fold == k:
            return {len(fitted.columns): fitted.columns for fitted in _elimination_path(folded, columns, label, step, min_features, params)}
        inside, outside = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        losses = {}
        for fitted in _elimination_path(inside, columns, label, step, min_features, params):
            scored = predict(fitted, outside, label, [key])
            losses[len(fitted.columns)] = metrics.log_loss(scored, "score", label).first()["log_loss"]
        return losses

    *found, paths = _side_by_side(df.sparkSession, walk, range(k + 1))
    known = {size: [losses[size] for losses in found if losses[size] is not None] for size in found[0]}  # an empty fold says nothing
    scores = {size: sum(losses) / len(losses) for size, losses in known.items()}
    best = min(sorted(scores), key=scores.get)
    return Elimination(scores, best, paths[best])


def _elimination_path(train: DataFrame, columns: Sequence[str], label: str, step: int, until: int, params: GbtParams):
    """Fits on ever fewer features, dropping the ``step`` weakest each time, down to ``until``."""
    left = list(columns)
    while True:
        fitted = train_gbt(train, None, left, label, params)
        yield fitted
        if len(left) <= until:
            return
        gains = fitted.model.featureImportances  # one number a feature
        ranked = sorted(left, key=lambda c: (float(gains[left.index(c)]), c))
        weakest = set(ranked[: min(step, len(left) - until)])
        left = [c for c in left if c not in weakest]
