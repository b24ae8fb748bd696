"""Descriptive statistics, correlations and group comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedside.functions.student import t_p_value
from bedside.operators import pieces
from bedside.operators.pieces import PIECE


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], quantiles: Sequence[float], max_rows: int | None = pieces.MAX_ROWS
) -> DataFrame:
    """(variable, q<percent>...) with linear interpolation between neighbouring ranks, exact at any size.

    Columns of up to ``max_rows`` values use the built-in exact percentile, whose buffer holds them all. Larger
    ones are cut into pieces along their range and the pieces only counted; the counts tell which piece holds
    each wanted rank. Only those pieces are ranked, value by value with multiplicity, so neither a whole
    column nor a heavy value ends up in one task.
    """
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if max_rows is None or max(typed.agg(*[F.count(c) for c in columns]).first()) <= max_rows:
        wanted = F.array(*[F.lit(float(q)) for q in quantiles])
        found = typed.agg(*[F.percentile(c, wanted).alias(c) for c in columns])
        names = [quantile_name(q) for q in quantiles]
        entries = [
            F.struct(F.lit(c).alias("variable"), *[F.col(c)[i].alias(name) for i, name in enumerate(names)])
            for c in columns
        ]
        return found.select(F.inline(F.array(*entries)))
    long = typed.unpivot([], list(columns), "variable", "v").filter(F.col("v").isNotNull())
    cut = pieces.cut_rows(long, ["variable"], "v", max_rows)
    counted = _ranked_in_pieces(cut.rows, quantiles)
    found = []
    for i, q in enumerate(quantiles):
        low, high = _ranks(q, F.col("total"))
        found.append(F.min(F.when(F.col("upto") > low, F.col("v"))).alias(f"lo{i}"))
        found.append(F.min(F.when(F.col("upto") > high, F.col("v"))).alias(f"hi{i}"))
    ends = counted.groupBy("variable").agg(F.first("total").alias("total"), *found)
    return ends.select("variable", *[_interpolate(i, q).alias(quantile_name(q)) for i, q in enumerate(quantiles)])


def _ranked_in_pieces(rows: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Distinct values with the count up to each and in all, of those pieces only that hold a wanted rank."""
    by_piece = Window.partitionBy("variable").orderBy(PIECE)
    sizes = (
        rows.groupBy("variable", PIECE)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(by_piece))
        .withColumn("total", F.sum("n").over(Window.partitionBy("variable")))
        .withColumn("skipped", F.col("upto") - F.col("n"))
    )
    holds = F.lit(False)
    for q in quantiles:
        for rank in _ranks(q, F.col("total")):
            holds = holds | ((rank >= F.col("skipped")) & (rank < F.col("upto")))
    # at most two pieces per column and quantile
    needed = sizes.filter(holds).select(
        F.col("variable").alias("__v"), F.col(PIECE).alias("__p"), "skipped", "total"
    )
    match = (F.col("variable") == F.col("__v")) & F.col(PIECE).eqNullSafe(F.col("__p"))
    in_piece = pieces.upto(Window.partitionBy("variable", PIECE).orderBy("v"))
    return (
        rows.join(F.broadcast(needed), match, "inner")
        .groupBy("variable", PIECE, "v", "skipped", "total")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.col("skipped") + F.sum("n").over(in_piece))
    )


def quantile_name(q: float) -> str:
    return f"q{round(q * 100)}"


def _ranks(q: float, total):
    place = (total - 1) * F.lit(q)
    return F.floor(place), F.ceil(place)


def _interpolate(i: int, q: float):
    place = (F.col("total") - 1) * F.lit(q)
    low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
    return low + (high - low) * (place - F.floor(place))


def describe(df: DataFrame, columns: Sequence[str], max_rows: int | None = pieces.MAX_ROWS) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, as rows."""
    moments = df.agg(
        F.array(*[
            F.struct(
                F.lit(c).alias("variable"),
                F.count(c).alias("count"),
                F.avg(c).alias("mean"),
                F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"),
                F.max(c).cast("double").alias("max"),
            )
            for c in columns
        ]).alias("rows")
    ).select(F.inline("rows"))
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75), max_rows)
    return moments.join(quartiles, "variable", "left").select(
        "variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable_a, variable_b, corr) of all pairs in one aggregation, rows with a missing partner skipped."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    entries = []
    for a, b in pairs:
        value = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
        entries.append(F.struct(F.lit(a).alias("variable_a"), F.lit(b).alias("variable_b"), value.alias("corr")))
    upper = df.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))
    lower = upper.filter("variable_a <> variable_b").select(
        F.col("variable_b").alias("variable_a"), F.col("variable_a").alias("variable_b"), "corr"
    )
    return upper.unionByName(lower)


def table_one(df: DataFrame, columns: Sequence[str], group: str, values: tuple = (0, 1)) -> DataFrame:
    """Per variable: missing count, size, mean and sd in both groups, Welch's t, its degrees of freedom and p.

    Unequal variances, two-sided. A variable that is empty in a group is reported as not tested. One pass over
    the rows; the p-value is an expression on the summary, one row per variable.
    """
    entries = []
    for c in columns:
        fields = [F.lit(c).alias("variable"), F.count(F.when(F.col(c).isNull(), 1)).alias("isnull")]
        for i, g in enumerate(values):
            mine = F.when(F.col(group) == g, F.col(c).cast("double"))
            fields += [
                F.count(mine).alias(f"n{i}"),
                F.avg(mine).alias(f"mean{i}"),
                F.stddev_samp(mine).alias(f"sd{i}"),
            ]
        entries.append(F.struct(*fields))
    grouped = df.filter(F.col(group).isin(*values))
    summary = grouped.agg(F.array(*entries).alias("rows")).select(F.inline("rows"))
    se0 = F.col("sd0") * F.col("sd0") / F.col("n0")
    se1 = F.col("sd1") * F.col("sd1") / F.col("n1")
    tested = (F.col("n0") > 1) & (F.col("n1") > 1) & (se0 + se1 > 0)
    t = (F.col("mean0") - F.col("mean1")) / F.sqrt(se0 + se1)
    dof = (se0 + se1) * (se0 + se1) / (se0 * se0 / (F.col("n0") - 1) + se1 * se1 / (F.col("n1") - 1))
    return (
        summary.withColumn("t", F.when(tested, t))
        .withColumn("df", F.when(tested, dof))
        .withColumn("p_value", t_p_value("t", "df"))
        .withColumn("test", F.when(tested, "Two Sample T-test").otherwise("Not tested"))
    )
