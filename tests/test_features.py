import math
import random

import pytest
from pyspark.sql import functions as F

from bedside.functions.student import t_p_value
from bedside.operators import features, metrics, models, stats


def test_features_skip_nulls_and_null_entities(frame, rows):
    wide = frame("k bigint, t bigint, a double, b double", [(1, 0, 1.0, None), (1, 1, 3.0, None), (2, 0, None, 4.0), (None, 0, 9.0, 9.0)])
    out = features.aggregate_features(wide, "k", drop=["t"])
    assert out.columns == ["k", "a_max", "b_max", "a_min", "b_min", "a_mean", "b_mean"]
    assert rows(out) == [(1, 3.0, None, 1.0, None, 2.0, None), (2, None, 4.0, None, 4.0, None, 4.0)]
    both = features.build_features(wide.select("k", "a"), wide.filter("k = 1").select("k", "b"), "k")
    assert rows(both, "k", "a_mean") == [(1, 2.0)]
    assert rows(features.with_group_stats(wide, "k", ["t"]).filter("k = 1"), "a", "a_max", "a_min") == [(1.0, 3.0, 1.0), (3.0, 3.0, 1.0)]


def test_paired(frame, rows):
    v = frame("k bigint, a double", [(1, 1.0), (2, 2.0)])
    lab = frame("k bigint, b double", [(1, 5.0), (2, 6.0)])
    out = features.build_features_paired((v, lab), (v.filter("k = 1"), lab), "k")
    assert rows(out, "label", "k", "a_max", "b_min") == [(0, 1, 1.0, 5.0), (0, 2, 2.0, 6.0), (1, 1, 1.0, 5.0)]


def test_missing_filter_keeps_the_limit(frame, rows):
    data = [(i, 1.0 if i < 1 else None, 1.0 if i < 2 else None, None) for i in range(5)]
    df = frame("k bigint, a double, b double, c double", data)
    assert rows(features.missing_rates(df, ["a", "c"])) == [("a", 0.8), ("c", 1.0)]
    assert features.filter_missing_columns(df, 0.8).columns == ["k", "a", "b"]
    assert features.filter_missing_columns(df, 0.6, always=["c"]).columns == ["c", "k", "b"]
    assert features.drop_all_null(df.drop("k")).count() == 2


def test_label_summary(frame, rows):
    df = frame("label int", [(1,), (0,), (0,), (1,)])
    assert rows(features.label_summary(df, "label")) == [(50.0, 2, 4)]


def test_split_and_folds_are_stable(spark):
    df = spark.range(2000).toDF("id")
    train, test = features.split(df, "id")
    assert train.count() + test.count() == 2000 and 330 < test.count() < 470
    again = features.split(df.repartition(13), "id")[1]
    assert test.exceptAll(again).count() == 0
    sizes = [r["count"] for r in features.assign_folds(df, "id").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == 2000 and min(sizes) > 330


@pytest.mark.parametrize("strategy,value", [("mean", 4.0), ("median", 2.0)])
def test_imputation_learns_from_training_rows(frame, strategy, value):
    train = frame("a double", [(1.0,), (2.0,), (9.0,), (None,)])
    model = features.fit_imputer(train, ["a"], strategy)
    assert model.transform(frame("a double", [(None,), (50.0,)])).first()["a"] == value
    assert features.with_null_flags(train, ["a"]).filter("a_isnull = 1").count() == 1


@pytest.mark.parametrize("max_rows", [30, 10**6])
def test_exact_quantiles(frame, max_rows):
    rng = random.Random(5)
    data = [(rng.choice([7.0, 7.0, 7.0, rng.uniform(0, 1000)]), rng.expovariate(1.0) if i % 3 else None) for i in range(400)]
    out = stats.exact_quantiles(frame("a double, b double", data), ["a", "b"], (0.0, 0.25, 0.5, 0.9, 1.0), max_rows)
    for r in out.collect():
        values = sorted(row["ab".index(r["variable"])] for row in data if row["ab".index(r["variable"])] is not None)
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            place = q * (len(values) - 1)
            low = math.floor(place)
            high = min(low + 1, len(values) - 1)
            expected = values[low] + (values[high] - values[low]) * (place - low)
            assert abs(r[stats.quantile_name(q)] - expected) < 1e-9


def test_describe_and_correlation(frame):
    df = frame("a double, b double, c double", [(1.0, 2.0, None), (2.0, 4.0, None), (3.0, 6.5, None), (None, 1.0, None)])
    out = {r["variable"]: r for r in stats.describe(df, ["a", "b", "c"]).collect()}
    assert (out["a"]["count"], out["a"]["mean"], out["a"]["std"], out["a"]["q50"]) == (3, 2.0, 1.0, 2.0)
    assert out["b"]["min"] == 1.0 and out["b"]["max"] == 6.5 and out["c"]["count"] == 0 and out["c"]["q50"] is None
    corr = {(r["variable_a"], r["variable_b"]): r["corr"] for r in stats.correlation_matrix(df, ["a", "b"]).collect()}
    assert abs(corr["a", "b"] - 0.9979487157886735) < 1e-12 and corr["a", "b"] == corr["b", "a"]


def two_sided_p(t, df, steps=20_000):
    """By Simpson's rule: with t = sqrt(df) tan(a), the density is a power of the cosine."""
    end = math.atan(abs(t) / math.sqrt(df))
    weight = lambda i: 1 if i in (0, steps) else 4 if i % 2 else 2
    area = sum(weight(i) * math.cos(end * i / steps) ** (df - 1) for i in range(steps + 1)) * end / steps / 3
    return 1 - 2 * area * math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)


def test_p_values(frame):
    known = [
        (2.0, 10.0, 0.07338803477074037), (1.0, 1.0, 0.5), (0.0, 5.0, 1.0), (-2.228138852, 10.0, 0.05), (1.959963985, 1e9, 0.05),
        (12.706204736, 1.0, 0.05), (5.0, 1e8, 5.733031437583869e-07), (2.9, 1e8, 0.003731627), (1e200, 4.0, 0.0),
    ]
    rng = random.Random(2)
    drawn = [(rng.uniform(-6, 6), 10 ** rng.uniform(-0.3, 5)) for _ in range(60)]
    undefined = [(None, 3.0), (1.0, None), (math.nan, 2.0), (math.inf, 2.0), (1.0, 0.0), (1.0, -2.0), (1.0, math.inf), (1.0, math.nan)]
    rows = [(t, df, p) for t, df, p in known] + [(t, df, two_sided_p(t, df)) for t, df in drawn] + [(*u, None) for u in undefined]
    for r in frame("t double, df double, p double", rows).withColumn("found", t_p_value("t", "df")).collect():
        if r["p"] is None:
            assert r["found"] is None, r
        else:
            assert abs(r["found"] - r["p"]) < 1e-8, r


def test_table_one(frame):
    data = [(0, 1.0, None), (0, 2.0, None), (0, 3.0, None), (1, 4.0, None), (1, 6.0, 1.0), (1, 9.0, 2.0), (1, None, 2.0), (None, 99.0, 1.0)]
    out = {r["variable"]: r for r in stats.table_one(frame("g int, a double, b double", data), ["a", "b"], "g").collect()}
    a = out["a"]
    assert (a["isnull"], a["n0"], a["n1"], a["mean0"], a["sd0"]) == (1, 3, 3, 2.0, 1.0) and a["test"] == "Two Sample T-test"
    # Welch by hand: variances 1 and 19/3 over three rows each
    se = math.sqrt(1 / 3 + (19 / 3) / 3)
    assert abs(a["t"] - (2.0 - 19 / 3) / se) < 1e-12
    assert abs(a["p_value"] - two_sided_p(a["t"], a["df"])) < 1e-9 and 0.05 < a["p_value"] < 0.15
    assert out["b"]["test"] == "Not tested" and out["b"]["p_value"] is None and out["b"]["mean0"] is None


@pytest.fixture
def scored(frame):
    rng = random.Random(11)
    data = [(g, round(rng.random(), 2), int(rng.random() < 0.4)) for g in (1, 2) for _ in range(150)]
    return data, frame("g int, score double, label int", data)


def _auc(data):
    pos = [s for _, s, y in data if y]
    neg = [s for _, s, y in data if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("max_rows", [15, 10**6])
def test_auc(scored, max_rows):
    data, df = scored
    assert abs(metrics.auc(df, "score", "label", max_rows=max_rows).first()["auc"] - _auc(data)) < 1e-12
    for r in metrics.auc(df, "score", "label", ["g"], max_rows).collect():
        assert abs(r["auc"] - _auc([d for d in data if d[0] == r["g"]])) < 1e-12
    assert metrics.auc(df.filter("label = 1"), "score", "label").first()["auc"] is None


@pytest.mark.parametrize("max_rows", [15, 10**6])
@pytest.mark.parametrize("corners", [False, True])
def test_roc(scored, max_rows, corners):
    data, df = scored
    p, n = sum(y for _, _, y in data), sum(1 - y for _, _, y in data)
    scores = sorted({s for _, s, _ in data}, reverse=True)
    steps = [(s, sum(y for _, t, y in data if t == s), sum(1 - y for _, t, y in data if t == s)) for s in scores]
    expected, tp, fp = {(scores[0] + 1, 0.0, 0.0)}, 0, 0
    for i, (s, a, b) in enumerate(steps):
        tp, fp = tp + a, fp + b
        straight = 0 < i < len(steps) - 1 and steps[i][1:] == steps[i + 1][1:]
        if not (corners and straight):
            expected.add((s, fp / n, tp / p))
    out = metrics.roc_points(df, "score", "label", (), corners, max_rows)
    assert {tuple(r) for r in out.select("threshold", "fpr", "tpr").collect()} == expected


def test_losses(frame):
    df = frame("p double, label int", [(0.9, 1), (0.2, 0), (0.4, 1), (1.0, 0)])
    expected = -(math.log(0.9) + math.log(0.8) + math.log(0.4) + math.log(1e-15)) / 4
    assert abs(metrics.log_loss(df, "p", "label").first()["log_loss"] - expected) < 0.01
    assert metrics.error_rate(df, "p", "label").first()["error_rate"] == 0.5


def test_best_round():
    assert models.best_round([5, 4, 3, 3.5, 3.6], 2) == (3, True)
    assert models.best_round([5, 4, 3, 3.5], 2) == (3, False)
    assert models.best_round([5, 6, 4, 5, 5, 3], 2) == (3, True)


@pytest.fixture(scope="module")
def training(spark):
    base = spark.range(400).withColumn("noise", F.rand(3)).withColumn("x", F.rand(5)).withColumn("z", F.lit(1.0))
    return base.withColumn("label", (F.col("x") + 0.2 * F.col("noise") > 0.6).cast("int")).cache()


PARAMS = models.GbtParams(learning_rate=0.3, max_depth=2, min_rows=5, rounds=4, patience=2)


def test_cross_validation(training):
    train, test = features.split(training, "id")
    cv = models.cross_predict(train, test, ["x", "noise", "z"], "label", "id", k=2, params=PARAMS)
    assert cv.out_of_fold.count() == train.count() and cv.test.count() == test.count()
    assert 0.9 < metrics.auc(cv.out_of_fold, "score", "label").first()["auc"] <= 1.0
    first = {(r["fold"], r["feature"]): (r["gain"], r["split"]) for r in cv.importance.collect()}
    assert len(first) == 6 and all(first[f, "z"] == (0.0, 0) for f in (0, 1))
    for fold in (0, 1):
        assert abs(sum(g for (f, _), (g, _) in first.items() if f == fold) - 100.0) < 1e-9
        assert max((g, c) for (f, c), (g, _) in first.items() if f == fold)[1] == "x"
    inner = sum((tree.numNodes - 1) // 2 for tree in cv.folds[0].model.trees)
    assert sum(s for (f, _), (_, s) in first.items() if f == 0) == inner
    again = models.cross_predict(train, None, ["x", "noise", "z"], "label", "id", k=2, params=PARAMS)
    assert again.test is None and again.importance.exceptAll(cv.importance).count() == 0
    merged = models.merge_importance(cv.importance)
    assert models.top_features(merged, 1, "gain_mean").first()["feature"] == "x"


def test_a_cut_model_is_the_shorter_fit(training):
    rows = models._assemble(training, ["x", "noise"], "label", ["id"])
    long = models._fit(rows, "label", PARAMS, 6)
    for n in (1, 3, 6):
        cut, short = models.first_trees(long, n), models._fit(rows, "label", PARAMS, n)
        assert cut.getNumTrees == n
        a, b = ({r["id"]: r["probability"][1] for r in m.transform(rows).collect()} for m in (cut, short))
        assert max(abs(a[i] - b[i]) for i in a) < 1e-12


def test_early_stopping_takes_the_best_round(training, monkeypatch):
    train, valid = features.split(training.withColumn("label", (F.col("noise") > 0.5).cast("int")), "id")
    fits = []
    fit = models._fit
    monkeypatch.setattr(models, "_fit", lambda rows, label, params, rounds: fits.append(rounds) or fit(rows, label, params, rounds))
    params = models.GbtParams(learning_rate=0.8, max_depth=4, min_rows=2, rounds=64, patience=3)
    found = models.train_gbt(train, valid, ["x"], "label", params)  # nothing to learn: the loss soon gets worse
    assert fits == [1, 6] and found.rounds == found.model.getNumTrees <= 3
    losses = fit(models._assemble(train, ["x"], "label"), "label", params, 6).evaluateEachIteration(models._assemble(valid, ["x"], "label"))
    assert models.best_round(losses, 3) == (found.rounds, True)
    fits.clear()
    steady = models.train_gbt(train, valid, ["noise"], "label", models.GbtParams(learning_rate=0.05, max_depth=1, min_rows=2, rounds=9, patience=2))
    assert fits == [1, 4, 8, 9] and steady.rounds == 9
    fits.clear()
    assert models.train_gbt(train, valid, ["noise"], "label", models.GbtParams(min_rows=1000)).rounds == 1 and fits == [1]
    assert models.splitting_rounds([3, 5, 1, 3]) == 2 and models.splitting_rounds([3]) == 1


def test_node_table(training):
    fitted = models.Trained(models._fit(models._assemble(training, ["x", "noise", "z"], "label"), "label", PARAMS, 3), ("x", "noise", "z"), 3)
    nodes = models.node_table(fitted)
    kept = {(r["tree"], r["node"]): r for r in nodes.collect()}
    assert len(kept) == sum(t.numNodes for t in fitted.model.trees) and all(kept[t, 0]["rows"] == 400 for t in range(3))
    for (tree, _), r in kept.items():
        if r["feature"] is None:
            assert r["left_node"] is None and r["gain"] is None
        else:
            assert r["rows"] == kept[tree, r["left_node"]]["rows"] + kept[tree, r["right_node"]]["rows"] and r["gain"] > 0
    # the nodes alone predict what the model predicts
    row = training.select("x", "noise", "z").first().asDict()
    margin = 0.0
    for tree, weight in enumerate(fitted.model.treeWeights):
        at = kept[tree, 0]
        while at["feature"] is not None:
            at = kept[tree, at["left_node"] if row[at["feature"]] <= at["threshold"] else at["right_node"]]
        margin += weight * at["prediction"]
    score = fitted.model.transform(models._assemble(training.limit(1), fitted.columns, "label")).first()["probability"][1]
    assert abs(score - 1 / (1 + math.exp(-2 * margin))) < 1e-12
    shares = {r["feature"]: r["gain"] for r in models.feature_importance(nodes, fitted.columns).collect()}
    for i, c in enumerate(fitted.columns):
        assert abs(shares[c] - 100 * fitted.model.featureImportances[i]) < 1e-9


def test_elimination(training):
    found = models.rfe_cv(training, ["x", "noise", "z"], "label", "id", k=2, params=PARAMS)
    assert set(found.scores) == {1, 2, 3} and found.best == len(found.selected) and "x" in found.selected


@pytest.fixture
def counted(spark, training):
    """The training rows with a column that counts how often it is worked out, and that count."""
    seen = spark.sparkContext.accumulator(0)

    def worked_out(x):
        seen.add(1)
        return x

    return training.withColumn("x", F.udf(worked_out, "double")("x")), seen


def test_elimination_works_its_rows_out_once(counted):
    rows, seen = counted
    found = models.rfe_cv(rows, ["x", "noise", "z"], "label", "id", k=2, params=PARAMS)
    assert set(found.scores) == {1, 2, 3} and "x" in found.selected
    assert seen.value == 400


def test_cross_validation_works_its_rows_out_once(counted):
    rows, seen = counted
    train, test = rows.filter("id < 300"), rows.filter("id >= 300")
    cv = models.cross_predict(train, test, ["x", "noise", "z"], "label", "id", k=2, params=PARAMS)
    assert cv.out_of_fold.count() == 300 and cv.test.count() == 100 and cv.importance.count() == 6
    assert seen.value == 400


def test_elimination_keeps_the_features_of_the_path_over_all_rows(training):
    names = ["x", "noise", "z"]
    found = models.rfe_cv(training, names, "label", "id", step=2, k=2, params=PARAMS)
    assert set(found.scores) == {3, 1}
    path = [fitted.columns for fitted in models._elimination_path(training, names, "label", 2, found.best, PARAMS)]
    assert found.selected == path[-1]


def test_modeling_steps(training):
    from bedside.plans import modeling

    feature = training.select(
        "id", F.when(F.col("noise") > 0.3, F.col("x")).alias("x"), "noise", F.when(F.col("id") < 10, 1.0).alias("sparse")
    )
    data = modeling.prepare(feature, training.select("id", "label"), "id", "label")
    assert data.columns == ("x", "noise", "x_isnull", "noise_isnull")
    assert data.train.filter(features_missing(data.columns)).count() == 0
    cv = modeling.cross_validate(data, "id", "label", PARAMS, k=2)
    scores = {r["part"]: r for r in modeling.evaluate(cv, "label").collect()}
    assert set(scores) == {"valid", "test"} and scores["valid"]["auc"] > 0.7 and scores["test"]["error_rate"] < 0.5
    found, again = modeling.select_and_retrain(data, "id", "label", 3, 2, PARAMS, PARAMS)
    assert set(found.scores) == {4, 1} and again.out_of_fold.count() == data.train.count()


def features_missing(columns):
    return " or ".join(f"{c} is null" for c in columns)
