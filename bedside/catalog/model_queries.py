"""Statistics, metrics and models on documents, labels, line items and events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedside.catalog.derived import Tables
from bedside.catalog.registry import query, rounded
from bedside.functions.time import parse_timestamp
from bedside.operators import features, metrics, models, stats
from bedside.plans import modeling

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_QUANTILES = {0.25: "q25", 0.5: "q50", 0.75: "q75"}


@query(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min,
                   {', '.join(f'round(quantile_cont({c}, {q}), 6) AS {n}' for q, n in _QUANTILES.items())}, max({c}) AS max FROM lineitem"""
        for c in _NUMBERS
    ),
)
def describe(t: Tables) -> DataFrame:
    out = stats.describe(t["lineitem"], _NUMBERS)
    return out.select("variable", "count", "min", "max", *rounded("mean", "std", *_QUANTILES.values()))


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, round(corr({a}, {b}), 9) AS corr FROM lineitem" for a in _NUMBERS for b in _NUMBERS
    ),
)
def corr_matrix(t: Tables) -> DataFrame:
    out = stats.correlation_matrix(t["lineitem"], _NUMBERS)
    return out.select("variable_a", "variable_b", *rounded("corr", digits=9))


# ---- document features ----

_TEXT_FEATURES = {
    "chars": ("length(text)", "length(text)"),
    "words": ("size(split(text, ' '))", "len(string_split(text, ' '))"),
    "lines": ("length(text) - length(replace(text, '\\n', ''))", "length(text) - length(replace(text, E'\\n', ''))"),
    "digits": (
        "length(text) - length(regexp_replace(text, '[0-9]', ''))",
        "length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))",
    ),
    "commas": ("length(text) - length(replace(text, ',', ''))", "length(text) - length(replace(text, ',', ''))"),
    "stars": (
        "nullif(length(text) - length(replace(text, '*', '')), 0)",
        "nullif(length(text) - length(replace(text, '*', '')), 0)",
    ),
}
_FEATURE_NAMES = list(_TEXT_FEATURES)
_LABELLED_SQL = "SELECT doc_id, quality, toxic, " + ", ".join(
    f"CAST({sql} AS DOUBLE) AS {n}" for n, (_, sql) in _TEXT_FEATURES.items()
) + " FROM documents JOIN labels USING (doc_id)"


def labelled_documents(t: Tables) -> DataFrame:
    joined = t["documents"].select("doc_id", "text").join(t["labels"], "doc_id", "inner")
    columns = [F.expr(sql).cast("double").alias(n) for n, (sql, _) in _TEXT_FEATURES.items()]
    return joined.select("doc_id", "quality", "toxic", *columns)


@query("document_features", _LABELLED_SQL)
def document_features(t: Tables) -> DataFrame:
    return labelled_documents(t)


_WELCH = """
    SELECT variable, "isnull", n0, n1, round(mean0, 6) AS mean0, round(sd0, 6) AS sd0, round(mean1, 6) AS mean1, round(sd1, 6) AS sd1,
           round((mean0 - mean1) / sqrt(e0 + e1), 6) AS t,
           round((e0 + e1) * (e0 + e1) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)), 6) AS df
    FROM (SELECT *, sd0 * sd0 / n0 AS e0, sd1 * sd1 / n1 AS e1 FROM summary)"""


@query(
    "table_one_stats",
    f"WITH d AS ({_LABELLED_SQL}), summary AS ("
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, count(*) FILTER ({c} IS NULL) AS isnull,
                   count({c}) FILTER (quality = 0) AS n0, count({c}) FILTER (quality = 1) AS n1,
                   avg({c}) FILTER (quality = 0) AS mean0, avg({c}) FILTER (quality = 1) AS mean1,
                   stddev_samp({c}) FILTER (quality = 0) AS sd0, stddev_samp({c}) FILTER (quality = 1) AS sd1 FROM d"""
        for c in _FEATURE_NAMES
    )
    + f") {_WELCH}",
)
def table_one_stats(t: Tables) -> DataFrame:
    out = stats.table_one(labelled_documents(t), _FEATURE_NAMES, "quality")
    return out.select("variable", "isnull", "n0", "n1", *rounded("mean0", "sd0", "mean1", "sd1", "t", "df"))


# p = 1 less the density's integral over [-t, t], by Simpson's rule over the angle a with t = sqrt(df) tan(a)
P_VALUE_SQL = """CASE WHEN t IS NOT NULL THEN round(1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * atan(abs(t) / sqrt(df)) / 6000 *
    list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                                                   * pow(cos(atan(abs(t) / sqrt(df)) * i / 2000), df - 1))), 6) END"""


@query(
    "table_one_p",
    f"""WITH d AS ({_LABELLED_SQL}), long AS ({" UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS x, quality FROM d" for c in _FEATURE_NAMES)}),
    s AS (SELECT variable, count(x) FILTER (quality = 0) AS n0, count(x) FILTER (quality = 1) AS n1, avg(x) FILTER (quality = 0) - avg(x) FILTER (quality = 1) AS gap,
                 var_samp(x) FILTER (quality = 0) / n0 AS e0, var_samp(x) FILTER (quality = 1) / n1 AS e1 FROM long GROUP BY variable),
    w AS (SELECT variable, CASE WHEN e0 + e1 > 0 THEN gap / sqrt(e0 + e1) END AS t, (e0 + e1) ** 2 / (e0 ** 2 / (n0 - 1) + e1 ** 2 / (n1 - 1)) AS df FROM s)
    SELECT variable, CASE WHEN t IS NULL THEN 'Not tested' ELSE 'Two Sample T-test' END AS test, {P_VALUE_SQL} AS p_value FROM w""",
)
def table_one_p(t: Tables) -> DataFrame:
    """The p-value; the SQL finds it by numerical integration."""
    return stats.table_one(labelled_documents(t), _FEATURE_NAMES, "quality").select("variable", "test", *rounded("p_value"))


@query(
    "document_missing_rate",
    f"WITH d AS ({_LABELLED_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, round(avg(CAST({c} IS NULL AS INT)), 9) AS missing_rate FROM d" for c in _FEATURE_NAMES
    ),
)
def document_missing_rate(t: Tables) -> DataFrame:
    rates = features.missing_rates(labelled_documents(t), _FEATURE_NAMES)
    return rates.select("variable", *rounded("missing_rate", digits=9))


@query(
    "filter_missing",
    f"WITH d AS ({_LABELLED_SQL}) SELECT doc_id, {', '.join(c for c in _FEATURE_NAMES if c != 'stars')} FROM d",
)
def filter_missing(t: Tables) -> DataFrame:
    """Documents without any star leave that column mostly empty, so the filter drops it."""
    kept = labelled_documents(t).select("doc_id", *_FEATURE_NAMES)
    return features.filter_missing_columns(kept, 0.5, always=["doc_id"])


@query(
    "filter_missing_values",
    f"""WITH d AS ({_LABELLED_SQL}),
    v AS (SELECT doc_id, unnest([{", ".join(f"'{c}'" for c in _FEATURE_NAMES)}]) AS variable, unnest([{", ".join(_FEATURE_NAMES)}]) AS value FROM d),
    r AS (SELECT variable FROM v GROUP BY variable HAVING avg(CAST(value IS NULL AS INT)) <= 0.5)
    SELECT doc_id, variable, value FROM v JOIN r USING (variable)""",
)
def filter_missing_values(t: Tables) -> DataFrame:
    """The same filter in long form, so that the SQL has to find the sparse columns itself."""
    kept = filter_missing(t)
    return kept.unpivot(["doc_id"], [c for c in kept.columns if c != "doc_id"], "variable", "value")


def _hash_sql(key: str, buckets: int, seed: int) -> str:
    return f"CAST(CAST('0x' || substr(md5(concat({key}, ':', '{seed}')), 1, 8) AS BIGINT) % {buckets} AS INT)"


@query("folds", f"SELECT doc_id, {_hash_sql('doc_id', 5, 520)} AS fold FROM documents")
def folds(t: Tables) -> DataFrame:
    return features.assign_folds(t["documents"].select("doc_id"), "doc_id")


@query("holdout", f"SELECT doc_id, CAST({_hash_sql('doc_id', 1000, 42)} < 200 AS INT) AS is_test FROM documents")
def holdout(t: Tables) -> DataFrame:
    return features.with_holdout(t["documents"].select("doc_id"), "doc_id")


@query(
    "impute_mean",
    f"""
    WITH d AS ({_LABELLED_SQL}), h AS (SELECT *, CAST({_hash_sql('doc_id', 1000, 42)} < 200 AS INT) AS is_test FROM d),
    m AS (SELECT avg(stars) AS mean_stars FROM h WHERE is_test = 0)
    SELECT doc_id, is_test, round(coalesce(stars, mean_stars), 6) AS stars FROM h, m""",
)
def impute_mean(t: Tables) -> DataFrame:
    marked = features.with_holdout(labelled_documents(t), "doc_id")
    fitted = features.fit_imputer(marked.filter("is_test = 0"), ["stars"])
    return fitted.transform(marked).select("doc_id", "is_test", *rounded("stars"))


# ---- metrics: event value as score, purchase as the positive label ----

_SCORED_SQL = "SELECT value AS score, CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS label, event_type FROM events"


def scored(t: Tables) -> DataFrame:
    return t.events().select(
        F.col("value").alias("score"), F.col("event_type").isin("purchase", "click").cast("int").alias("label"), "user_id"
    )


@query(
    "auc_rank",
    f"""
    WITH s AS ({_SCORED_SQL}), ranked AS (
        SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM s)
    SELECT round((sum(r) FILTER (label = 1) - p * (p + 1) / 2) / (p * n), 9) AS auc
    FROM ranked, (SELECT sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM s) GROUP BY p, n""",
)
def auc_rank(t: Tables) -> DataFrame:
    return metrics.auc(scored(t), "score", "label").select(*rounded("auc", digits=9))


@query(
    "auc_by_user",
    """
    WITH s AS (SELECT user_id, value AS score, CASE WHEN event_type IN ('purchase', 'click') THEN 1 ELSE 0 END AS label FROM events),
    pairs AS (SELECT p.user_id, avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END) AS auc
              FROM s p JOIN s n ON n.user_id = p.user_id AND n.label = 0 WHERE p.label = 1 GROUP BY p.user_id)
    SELECT u.user_id, round(auc, 9) AS auc FROM (SELECT DISTINCT user_id FROM s) u LEFT JOIN pairs USING (user_id)""",
)
def auc_by_user(t: Tables) -> DataFrame:
    return metrics.auc(scored(t), "score", "label", by=["user_id"]).select("user_id", *rounded("auc", digits=9))


_ROC = f"""
    counted AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ({_SCORED_SQL}) GROUP BY score),
    points AS (SELECT score AS threshold, sum(neg) OVER w / sum(neg) OVER ()::DOUBLE AS fpr, sum(pos) OVER w / sum(pos) OVER ()::DOUBLE AS tpr,
                      pos, neg, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg, row_number() OVER w AS place
               FROM counted WINDOW w AS (ORDER BY score DESC)),
    origin AS (SELECT max(score) + 1 AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM counted)"""
_ROUND_ROC = "SELECT round(threshold, 6) AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr"


@query(
    "roc_points",
    f"WITH {_ROC} {_ROUND_ROC} FROM (SELECT threshold, fpr, tpr FROM points UNION ALL SELECT * FROM origin)",
)
def roc_points(t: Tables) -> DataFrame:
    return metrics.roc_points(scored(t), "score", "label").select(*rounded("threshold"), *rounded("fpr", "tpr", digits=9))


@query(
    "roc_corners",
    f"""WITH {_ROC} {_ROUND_ROC} FROM (SELECT threshold, fpr, tpr FROM points
        WHERE place = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg UNION ALL SELECT * FROM origin)""",
)
def roc_corners(t: Tables) -> DataFrame:
    points = metrics.roc_points(scored(t), "score", "label", drop_intermediate=True)
    return points.select(*rounded("threshold"), *rounded("fpr", "tpr", digits=9))


def _as_probability(t: Tables) -> DataFrame:
    return scored(t).withColumn("p", F.least(F.col("score") / 300, F.lit(1.0)))


_PROBABILITY = f"(SELECT *, least(score / 300, 1.0::DOUBLE) AS p FROM ({_SCORED_SQL}))"


@query(
    "log_loss",
    f"""SELECT round(avg(-CASE label WHEN 1 THEN ln(greatest(least(p, 1 - 1e-15), 1e-15)) ELSE ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END), 6) AS log_loss
        FROM {_PROBABILITY}""",
)
def log_loss(t: Tables) -> DataFrame:
    return metrics.log_loss(_as_probability(t), "p", "label").select(*rounded("log_loss"))


@query(
    "error_rate",
    f"SELECT round(avg(CASE WHEN CAST(p > 0.5 AS INT) <> label THEN 1.0::DOUBLE ELSE 0 END), 9) AS error_rate FROM {_PROBABILITY}",
)
def error_rate(t: Tables) -> DataFrame:
    return metrics.error_rate(_as_probability(t), "p", "label").select(*rounded("error_rate", digits=9))


@query("parse_timestamps", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def parse_timestamps(t: Tables) -> DataFrame:
    slashed = F.date_format("ts", "yyyy/M/d HH:mm:ss")
    dashed = F.date_format("ts", "yyyy-M-d HH:mm:ss")
    written = F.when(F.col("event_type") == "click", slashed).otherwise(dashed)
    return t.events().select("event_id", parse_timestamp(written).alias("parsed"))


# ---- models ----

# what is trained has no SQL; what follows for any training run from rows, folds and labels is checked by SQL

_DATA_SQL = f"""d AS ({_LABELLED_SQL}),
    h AS (SELECT *, {_hash_sql('doc_id', 5, 520)} AS fold, CAST({_hash_sql('doc_id', 1000, 42)} < 200 AS INT) AS is_test FROM d)"""


def _documents(t: Tables) -> modeling.Prepared:
    rows = t.once("labelled_documents", lambda: labelled_documents(t))  # read by several steps, and the texts only here
    return modeling.prepare(rows.select("doc_id", *_FEATURE_NAMES), rows.select("doc_id", "quality"), "doc_id", "quality", 1.0)


def _predictions(cv: models.CrossValidated, key: str, label: str) -> DataFrame:
    held_out = cv.out_of_fold.select(key, label, "score", "fold", F.lit("out_of_fold").alias("part"))
    return held_out.unionByName(cv.test.select(key, label, "score", F.lit(None).cast("int").alias("fold"), F.lit("test").alias("part")))


def trained(t: Tables, name: str, prepared, key: str, label: str, params: models.GbtParams) -> tuple[DataFrame, DataFrame]:
    """Predictions and tree nodes of five folds, trained once per application."""

    def run() -> DataFrame:
        cv = modeling.cross_validate(prepared(), key, label, params)
        t.once(f"{name}_nodes", lambda: cv.nodes)
        return _predictions(cv, key, label)

    predictions = t.once(f"{name}_predictions", run)
    return predictions, t.once(f"{name}_nodes", lambda: predictions)


#: The published settings.
SETTINGS = models.DEFAULT


def _gbt(t: Tables, params: models.GbtParams = SETTINGS, name: str = "gbt") -> tuple[DataFrame, DataFrame]:
    return trained(t, name, lambda: _documents(t), "doc_id", "quality", params)


@query("gbt_cv")
def gbt_cv(t: Tables) -> DataFrame:
    """Held-out and test predictions of every labelled document, with the published settings."""
    return _gbt(t)[0].select("doc_id", "quality", "score", "part")


def coverage(predictions: DataFrame) -> DataFrame:
    """Rows per part and fold, their positive labels, and scores that are no probabilities."""
    label = next(c for c in ("quality", "og_label") if c in predictions.columns)
    wrong = F.count(F.when(~F.col("score").between(0, 1), 1)).alias("not_probabilities")
    return predictions.groupBy("part", "fold").agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positive"), wrong)


def coverage_sql(source: str, label: str) -> str:
    return f"""SELECT part, fold, count(*) AS n, CAST(sum({label}) AS BIGINT) AS positive, CAST(0 AS BIGINT) AS not_probabilities
        FROM (SELECT CASE is_test WHEN 1 THEN 'test' ELSE 'out_of_fold' END AS part, CASE is_test WHEN 0 THEN fold END AS fold, {label} FROM {source})
        GROUP BY part, fold"""


@query("gbt_coverage", f"WITH {_DATA_SQL} {coverage_sql('h', 'quality')}")
def gbt_coverage(t: Tables) -> DataFrame:
    """Every labelled document is scored once, by the model of the fold it was held out from, or by all if it is a test row."""
    return coverage(_gbt(t)[0])


_OTHER_FOLDS = "FROM h JOIN (SELECT unnest(range(5)) AS f) ON f <> fold WHERE is_test = 0 GROUP BY f"


@query(
    "gbt_roots",
    f"""WITH {_DATA_SQL} SELECT CAST(f AS INT) AS fold, count(*) AS rows, round(avg(2 * quality - 1), 9) AS prediction {_OTHER_FOLDS}""",
)
def gbt_roots(t: Tables) -> DataFrame:
    """The first tree's root of each fold has seen the rows of the other folds and predicts their mean margin."""
    roots = _gbt(t)[1].filter("tree = 0 AND node = 0")
    return roots.select("fold", "rows", *rounded("prediction", digits=9))


@query(
    "gbt_node_balance",
    "SELECT CAST(unnest(range(5)) AS INT) AS fold, CAST(0 AS BIGINT) AS unbalanced, CAST(0 AS BIGINT) AS too_small",
)
def gbt_node_balance(t: Tables) -> DataFrame:
    """Inner nodes whose children do not hold their rows, and nodes below the published 100 rows: none in any fold."""
    nodes = _gbt(t)[1]
    child = nodes.select("fold", "tree", F.col("node").alias("child"), F.col("rows").alias("held"))
    inner = nodes.filter("feature IS NOT NULL").withColumn("child", F.explode(F.array("left_node", "right_node")))
    held = inner.join(child, ["fold", "tree", "child"]).groupBy("fold", "tree", "node").agg(F.first("rows").alias("rows"), F.sum("held").alias("held"), F.min("held").alias("least"))
    wrong = held.groupBy("fold").agg(
        F.count(F.when(F.col("rows") != F.col("held"), 1)).alias("unbalanced"), F.count(F.when(F.col("least") < 100, 1)).alias("too_small")
    )
    folds = nodes.select("fold").distinct()
    return folds.join(wrong, "fold", "left").select("fold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("unbalanced", "too_small")])


def _documents_columns() -> list[str]:
    return [*_FEATURE_NAMES, *[f"{c}_isnull" for c in _FEATURE_NAMES]]


@query(
    "gbt_importance_shares",
    """SELECT CAST(unnest(range(5)) AS INT) AS fold, CAST(12 AS BIGINT) AS n_features, true AS shares_complete, true AS splits_have_gain""",
)
def gbt_importance_shares(t: Tables) -> DataFrame:
    """Per fold: importance covers all features, its shares add up to 100 (or nothing was split), a feature has gain where it has splits."""
    importance = models.feature_importance(_gbt(t)[1], _documents_columns(), ["fold"], 5)
    total = F.round(F.sum("gain"), 6)
    return importance.groupBy("fold").agg(
        F.count("*").alias("n_features"),
        ((total == 100) | ((total == 0) & (F.sum("split") == 0))).alias("shares_complete"),
        F.bool_and((F.col("gain") > 0) == (F.col("split") > 0)).alias("splits_have_gain"),
    )


@query("gbt_auc")
def gbt_auc(t: Tables) -> DataFrame:
    return metrics.auc(gbt_cv(t), "score", "quality", by=["part"])


@query("model_report")
def model_report(t: Tables) -> DataFrame:
    """AUC, log-loss and error rate of held-out and test predictions."""
    return modeling.scores(gbt_cv(t).replace({"out_of_fold": "valid"}, subset=["part"]), "quality")


@query("gbt_importance")
def gbt_importance(t: Tables) -> DataFrame:
    importance = models.feature_importance(_gbt(t)[1], _documents_columns(), ["fold"], 5)
    return models.top_features(models.merge_importance(importance), 25, by="gain_mean")


_SHORT = models.GbtParams(learning_rate=0.3, max_depth=3, min_rows=10, rounds=6, patience=3)


@query("gbt_feature_fraction", f"WITH {_DATA_SQL} {coverage_sql('h', 'quality')}")
def gbt_feature_fraction(t: Tables) -> DataFrame:
    """The earlier setting: each node looks at 0.7 of the features."""
    return coverage(_gbt(t, replace(_SHORT, feature_fraction=models.OLD.feature_fraction), "gbt_fraction")[0])


def _eliminated(t: Tables) -> DataFrame:
    """``n_features, log_loss, chosen, selected``: one row per feature count."""

    def run() -> DataFrame:
        data = _documents(t)
        found = models.rfe_cv(data.train, data.columns, "quality", "doc_id", step=1, k=5, params=models.ELIMINATION)
        sizes = [(size, loss, size == found.best, list(found.selected)) for size, loss in sorted(found.scores.items())]  # one a feature
        return t.spark.createDataFrame(sizes, "n_features int, log_loss double, chosen boolean, selected array<string>")

    return t.once("rfe", run)


@query("rfe")
def rfe(t: Tables) -> DataFrame:
    """Mean held-out loss per feature count, one feature dropped at a time over five folds, with the chosen count marked; published settings."""
    return _eliminated(t).drop("selected")


@query(
    "rfe_grid",
    "SELECT CAST(unnest(range(1, 13)) AS INT) AS n_features, true AS scored, true AS consistent",
)
def rfe_grid(t: Tables) -> DataFrame:
    """Every feature count from all to one is scored; the chosen one has the least loss and as many features are kept."""
    least = F.min("log_loss").over(Window.partitionBy(F.size("selected")))
    consistent = F.col("chosen") == ((F.col("n_features") == F.size("selected")) & (F.col("log_loss") == least))
    return _eliminated(t).select("n_features", (F.col("log_loss") > 0).alias("scored"), consistent.alias("consistent"))


@query("gbt_selected", f"WITH {_DATA_SQL} {coverage_sql('h', 'quality')}")
def gbt_selected(t: Tables) -> DataFrame:
    """Cross-validation once more on the features that elimination kept."""
    kept = _eliminated(t).filter("chosen").first()["selected"]  # names of features
    data = _documents(t)
    chosen = lambda: modeling.Prepared(data.train, data.test, tuple(kept))
    return coverage(trained(t, "gbt_selected", chosen, "doc_id", "quality", _SHORT)[0])


@query(
    "impute_median",
    f"""WITH {_DATA_SQL}, m AS (SELECT quantile_disc(stars, 0.5) AS middle FROM h WHERE is_test = 0)
    SELECT doc_id, is_test, coalesce(stars, middle) AS stars FROM h, m""",
)
def impute_median(t: Tables) -> DataFrame:
    marked = features.with_holdout(labelled_documents(t), "doc_id")
    fitted = features.fit_imputer(marked.filter("is_test = 0"), ["stars"], "median")
    return fitted.transform(marked).select("doc_id", "is_test", "stars")


@query("drop_empty_rows", "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM (SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem) WHERE l_discount IS NOT NULL OR l_tax IS NOT NULL")
def drop_empty_rows(t: Tables) -> DataFrame:
    """Rows in which none of the measured columns holds a value are dropped."""
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", *[F.nullif(F.col(c), F.lit(0)).alias(c) for c in ("l_discount", "l_tax")])
    return features.drop_all_null(lines, ["l_discount", "l_tax"])
