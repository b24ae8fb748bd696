"""Concept relations: urine output, weights, consciousness, body size, echo reports."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedside.functions import text
from bedside.functions.time import order_micros, plus_hours
from bedside.operators import events, intervals, rolling, pieces
from bedside.operators.intervals import interval_join
from bedside.specs import echo as echo_spec
from bedside.specs import fluids

ROLLING_SPANS = {"urineoutput_6hr": 5, "urineoutput_12hr": 11, "urineoutput_24hr": 23}


def not_error() -> Column:
    """Rows whose error flag is anything but 1, unknown included."""
    return ~F.col("error").eqNullSafe(F.lit(1))


def urine_output(outputevents: DataFrame) -> DataFrame:
    """Urine volume per stay and time, irrigant counted as negative."""
    present = outputevents.filter(F.col("icustay_id").isNotNull())
    return events.signed_total(
        present,
        ["icustay_id", "charttime"],
        "itemid",
        "value",
        fluids.URINE,
        [fluids.URINE_IRRIGANT_IN],
        fluids.URINE_MAX_VALUE,
    )


def rolling_sums(urine: DataFrame) -> DataFrame:
    """Forward 6/12/24 h urine sums (5, 11 and 23 hours ahead)."""
    return rolling.forward_rolling_sum(urine, ["icustay_id"], "charttime", "value", ROLLING_SPANS)


def rolling_urine_output(summed: DataFrame, weights: DataFrame) -> DataFrame:
    """Rolling sums with the weight in force; overlapping weight intervals repeat a reading."""
    weighed = intervals.attach_interval_value(
        summed, weights, ["icustay_id"], "charttime", "starttime", "endtime", "weight"
    )
    return weighed.select("icustay_id", "charttime", "weight", *ROLLING_SPANS)


def weight_durations(
    chartevents: DataFrame,
    icustays: DataFrame,
    echo: DataFrame,
    use_admit_weight: bool = False,
    echo_fallback: bool = False,
    max_rows: int | None = pieces.MAX_ROWS,
) -> DataFrame:
    """Validity intervals of weights.

    Each charted weight holds until the next, the last until two hours past discharge; the first is also used
    back to two hours before admission. Stays without any weight keep one row of nulls.

    As in the reference, the first admission weight of a stay is left out and echo weights never come into
    play. ``use_admit_weight`` keeps it, valid from two hours before admission; ``echo_fallback`` uses echo
    weights for stays without a charted one.
    """
    slack, key = fluids.INTERVAL_SLACK_HOURS, "icustay_id"
    stays = icustays.select(key, "hadm_id", "intime", "outtime").filter(F.col(key).isNotNull())
    charted = chartevents.filter(
        F.col("itemid").isin(*fluids.ADMIT_WEIGHT, *fluids.DAILY_WEIGHT)
        & F.col("valuenum").isNotNull()
        & (F.col("valuenum") != 0)
        & not_error()
        & F.col(key).isNotNull()
    ).select(
        key,
        "charttime",
        F.col("itemid").isin(*fluids.ADMIT_WEIGHT).cast("int").alias("admit"),
        F.col("valuenum").alias("weight"),
    )
    held = _charted_intervals(charted, stays, slack, use_admit_weight, max_rows)

    # a stay has charted weights unless the left-out first admission weight was the only one
    counts = charted.groupBy(key).agg(F.sum("admit").alias("admits"), F.count(F.lit(1)).alias("all"))
    spared = F.lit(0) if use_admit_weight else F.least("admits", F.lit(1))
    weighed = counts.filter(F.col("all") > spared).select(key)
    unweighed = stays.join(weighed, key, "left_anti").select(
        key,
        F.lit(None).cast("timestamp_ntz").alias("starttime"),
        F.lit(None).cast("timestamp_ntz").alias("endtime"),
        F.lit(None).cast("double").alias("weight"),
    )
    out = held.unionByName(unweighed)
    if echo_fallback:
        out = out.unionByName(_echo_intervals(echo, stays, slack, max_rows).join(weighed, key, "left_anti"))
    return out.distinct()


def _charted_intervals(
    charted: DataFrame, stays: DataFrame, slack: int, use_admit_weight: bool, max_rows: int
) -> DataFrame:
    """Charted weights as intervals in one partitioning by stay: admission weight, next time and back-fill."""
    key = ["icustay_id"]
    placed = charted.join(stays.drop("hadm_id"), key, "inner").withColumn("__t", order_micros("charttime"))
    sized = charted.withColumn("__t", order_micros("charttime"))
    cut = pieces.cut_rows(placed, key, "__t", max_rows, sized_by=sized)
    cut = cut.carry({"__a": F.sum("admit")}, lambda p: {"__admits": F.sum("__a").over(pieces.before(p))})
    admits = F.sum("admit").over(pieces.upto(cut.window("__t", "weight"))) + F.coalesce("__admits", F.lit(0))
    # among equal rows ROWS order is arbitrary, and so is which of them is left out
    cut = cut.with_column("__is_first", (F.col("admit") == 1) & (admits == 1))
    if use_admit_weight:
        before = plus_hours("intime", -slack)
        moved = F.when(F.col("__is_first"), before).otherwise(F.col("charttime"))
        # a moved row may leave its piece, so the order is cut anew
        rows = cut.result().withColumn("charttime", moved).withColumn("__t", order_micros("charttime"))
        cut = pieces.cut_rows(rows, key, "__t", max_rows)
    else:
        cut = replace(cut, rows=cut.rows.filter(~F.col("__is_first")))
    entry = F.struct("__t", "weight", "charttime")
    cut = cut.carry(
        {"__e": F.min(entry)},
        lambda p: {
            "__edge": F.lead("__e").over(p),
            "__earliest": F.min("__e").over(Window.partitionBy(*key)),
        },
        spread=use_admit_weight,
    )
    following = F.lead("charttime").over(cut.window("__t", "weight"))
    edge = F.col("__edge.charttime") if cut.cut else F.lit(None).cast("timestamp_ntz")
    earliest = F.min("charttime").over(Window.partitionBy(*cut.by))
    if cut.cut:
        earliest = F.coalesce(F.col("__earliest.charttime"), earliest)
    until = F.coalesce(following, edge, plus_hours("outtime", slack))
    cut = cut.with_column("__until", until).with_column("__earliest_time", earliest)
    own = F.struct(F.col("charttime").alias("starttime"), F.col("__until").alias("endtime"))
    back = F.struct(plus_hours("intime", -slack).alias("starttime"), F.col("charttime").alias("endtime"))
    at_start = (F.col("charttime") == F.col("__earliest_time")) & (F.col("intime") < F.col("charttime"))
    spans = F.when(at_start, F.array(own, back)).otherwise(F.array(own))
    return cut.rows.select(*key, "weight", F.explode(spans).alias("s")).select(
        *key, "s.starttime", "s.endtime", "weight"
    )


def _echo_intervals(echo: DataFrame, stays: DataFrame, slack: int, max_rows: int) -> DataFrame:
    """Echo weights as intervals, the first one reaching back to before admission."""
    readings = (
        echo.filter(F.col("weight").isNotNull() & F.col("charttime").isNotNull())
        .select("hadm_id", "charttime", (F.col("weight") * fluids.LB_TO_KG_ECHO).alias("weight"))
        .join(stays, "hadm_id", "inner")
        .withColumn("until", plus_hours("outtime", slack))
    )
    held = intervals.lead_intervals(readings, ["icustay_id"], "charttime", "weight", "until", max_rows)
    first = readings.groupBy("icustay_id").agg(
        F.min(F.struct("charttime", "weight")).alias("f"), F.first("intime").alias("intime")
    )
    before = plus_hours("intime", -slack)
    back = first.filter(F.col("f.charttime") > before).select(
        "icustay_id",
        before.alias("starttime"),
        F.col("f.charttime").alias("endtime"),
        F.col("f.weight").alias("weight"),
    )
    return held.unionByName(back).distinct()


def gcs(chartevents: DataFrame, icustays: DataFrame, max_rows: int | None = pieces.MAX_ROWS) -> DataFrame:
    """Coma scale per stay and time.

    A missing component is taken from the reading before, if it is less than six hours old and not from an
    intubated patient, else it counts as normal. Intubation is stored as a verbal score of 0 and scores 15.
    """
    codes = [c for pair in fluids.GCS_CODES.values() for c in pair]
    tube = reduce(
        lambda a, b: a | b,
        [(F.col("itemid") == code) & (F.col("value") == mark) for code, mark in fluids.GCS_INTUBATED.items()],
    )
    scored = chartevents.filter(F.col("itemid").isin(*codes) & F.col("icustay_id").isNotNull()).select(
        "icustay_id",
        "charttime",
        events.remap("itemid", fluids.GCS_CODES).alias("part"),
        F.when(tube, F.lit(0.0)).otherwise(F.col("valuenum")).alias("score"),
    )
    stays = icustays.select("icustay_id", "intime", "outtime")
    inside = interval_join(scored, stays, ["icustay_id"], "charttime", "intime", "outtime", "inner", closed=True)
    parts = list(fluids.GCS_CODES)
    wide = inside.groupBy("icustay_id", "charttime").agg(
        *[F.max(F.when(F.col("part") == p, F.col("score"))).alias(p) for p in parts]
    )
    wide = wide.withColumn("endotrachflag", F.when(F.col("gcsverbal") == 0, 1).otherwise(0))
    wide = rolling.previous_reading(
        wide, ["icustay_id"], "charttime", {f"{p}prev": p for p in parts}, fluids.GCS_REACH_HOURS, max_rows, scored
    )
    tube_before = F.coalesce(F.col("gcsverbalprev") == 0, F.lit(False))

    def total(use_previous: bool):
        terms = [
            F.coalesce(p, *([f"{p}prev"] if use_previous else []), F.lit(float(normal)))
            for p, normal in fluids.GCS_NORMAL.items()
        ]
        return reduce(lambda a, b: a + b, terms)

    sedated = (F.col("gcsverbal") == 0) | (F.col("gcsverbal").isNull() & tube_before)
    score = (
        F.when(sedated, F.lit(float(fluids.GCS_SEDATED_TOTAL))).when(tube_before, total(False)).otherwise(total(True))
    )
    return wide.withColumn("gcs", score)


def height_weight(chartevents: DataFrame) -> DataFrame:
    """First, smallest and largest height (cm) and weight (kg) per stay, two decimals.

    One aggregation: first is the value at the earliest time, so no window or de-duplication is needed.
    """
    factors = {**fluids.WEIGHT_FACTORS, **fluids.HEIGHT_FACTORS}
    factor = F.coalesce(*[
        F.when(F.col("itemid").isin(*[c for c, f in factors.items() if f == value]), F.lit(value))
        for value in dict.fromkeys(factors.values())
    ])
    readings = chartevents.filter(
        F.col("itemid").isin(*factors) & F.col("valuenum").isNotNull() & (F.col("valuenum") != 0) & not_error()
    ).select(
        "subject_id",
        "icustay_id",
        "charttime",
        F.col("itemid").isin(*fluids.HEIGHT_FACTORS).alias("is_height"),
        (F.col("valuenum") * factor).alias("amount"),
    )
    columns = []
    for name, mine in (("height", F.col("is_height")), ("weight", ~F.col("is_height"))):
        amount = F.when(mine, F.col("amount"))
        # a reading of unknown time is first only if there is no other
        place = F.struct(F.col("charttime").isNull(), F.col("charttime"), F.col("amount"))
        first = F.min(F.when(mine, place))["amount"]
        columns += [
            F.round(first, 2).alias(f"{name}_first"),
            F.round(F.min(amount), 2).alias(f"{name}_min"),
            F.round(F.max(amount), 2).alias(f"{name}_max"),
        ]
    return readings.groupBy("icustay_id", "subject_id").agg(*columns)


def echo_data(noteevents: DataFrame) -> DataFrame:
    """Structured fields of echo reports; the time of day comes from the text, the date from the row."""
    note = F.col("text")
    clock = F.concat(F.col("chartdate").cast("string"), F.lit(" "), text.capture(note, echo_spec.CLOCK_TIME), F.lit(":00"))
    return noteevents.filter(F.col("category") == echo_spec.CATEGORY).select(
        "row_id",
        "subject_id",
        "hadm_id",
        "chartdate",
        clock.try_cast("timestamp_ntz").alias("charttime"),
        *[text.capture(note, p).alias(name) for name, p in echo_spec.TEXT_FIELDS.items()],
        *[text.capture_number(note, p).alias(name) for name, p in echo_spec.NUMBER_FIELDS.items()],
    )
