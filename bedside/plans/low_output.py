"""The low-output study: index events, case/control cohort and its wide measurement windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.functions.time import plus_hours
from bedside.operators import cohort, pivots, pieces
from bedside.plans import concepts
from bedside.specs import measurements

# fixed values: eligibility and event limits
MIN_LOS_DAYS = 2
MIN_AGE = 18
MIN_CREATININE_READINGS = 2
MAX_FIRST_CREATININE = 4
CREATININE_LEAD_HOURS = 6
LOW_24H = 400
LOW_12H = 17 * 12
WINDOW_HOURS = 24
LAB_LEAD_HOURS = 6

_STAY_COLUMNS = (
    "subject_id", "hadm_id", "icustay_id", "gender", "age", "hospital_expire_flag", "intime", "outtime", "los_icu",
)
_PIVOT_KEEP = ("subject_id", "hadm_id", "icustay_id", "og_label", "starttime", "og_starttime")


@dataclass(frozen=True)
class Study:
    """The relations of the study, lazy until written."""

    urine: DataFrame
    rolling: DataFrame
    events: DataFrame
    cohort: DataFrame
    vitals: DataFrame
    labs: DataFrame


def base_cohort(icustay_detail: DataFrame, labevents: DataFrame) -> DataFrame:
    """Adult first stays of two days or more with repeated creatinine and a low first one."""
    eligible = icustay_detail.filter(
        (F.col("los_icu") >= MIN_LOS_DAYS)
        & (F.col("age") >= MIN_AGE)
        & (F.col("first_hosp_stay") == "Y")
        & (F.col("first_icu_stay") == "Y")
    ).select(*_STAY_COLUMNS)
    creatinine = labevents.filter(F.col("itemid") == measurements.CREATININE)
    return cohort.eligible_by_measure(
        eligible,
        creatinine,
        "icustay_id",
        ["hadm_id"],
        "intime",
        "outtime",
        "charttime",
        "valuenum",
        MIN_CREATININE_READINGS,
        MAX_FIRST_CREATININE,
        CREATININE_LEAD_HOURS,
    )


def clean_base(base: DataFrame, urine: DataFrame) -> DataFrame:
    """Stays of the base cohort without a negative urine volume.

    Events and controls both leave such stays out; doing it once here gives the same rows as doing it in each.
    """
    return cohort.exclude_if_exists(base, urine.filter(F.col("value") < 0), ["icustay_id"])


def low_output_events(summed: DataFrame, clean: DataFrame, chartevents: DataFrame) -> DataFrame:
    """First low output of each clean stay with a sign of circulation in the following day.

    Works on the rolling sums before weights are attached: the weight is not used and would only repeat rows.
    The sign is any positive heart rate or systolic reading, so one good reading outweighs a zero (literal).
    """
    low = (F.col("urineoutput_24hr") < LOW_24H) | (F.col("urineoutput_12hr") < LOW_12H)
    sums = ["urineoutput_24hr", "urineoutput_12hr"]
    first = cohort.first_event(summed, clean, "icustay_id", "charttime", low, "outtime", values=sums)
    placed = first.join(clean.select("icustay_id", "intime"), "icustay_id", "inner").select(
        "icustay_id",
        "intime",
        F.col("charttime").alias("og_starttime"),
        cohort.hours_to_event("intime", "charttime").alias("los_og"),
        "urineoutput_24hr",
        (F.col("urineoutput_12hr") / 12).alias("urineoutput_h"),
    )
    signs = chartevents.filter(
        F.col("itemid").isin(*measurements.HEART_RATE, *measurements.SYSTOLIC_EVIDENCE) & (F.col("valuenum") > 0)
    )
    return cohort.evidence_gate(placed, signs, "icustay_id", "og_starttime", "charttime")


def study_cohort(clean: DataFrame, events: DataFrame) -> DataFrame:
    """Cases and controls with their observation start."""
    return cohort.label_and_window(clean, events, "icustay_id", "intime", "og_starttime", "los_og")


def cohort_vitals(study: DataFrame, chartevents: DataFrame) -> DataFrame:
    """Wide vital signs of the 24 hours from the observation start."""
    return pivots.pivot_measurements(
        study,
        chartevents.filter(concepts.not_error()),
        measurements.VITALS,
        ["icustay_id"],
        "starttime",
        plus_hours("starttime", WINDOW_HOURS),
        keep=_PIVOT_KEEP,
    )


def cohort_labs(study: DataFrame, labevents: DataFrame) -> DataFrame:
    """Wide laboratory results from six hours before to 24 hours after the observation start."""
    return pivots.pivot_measurements(
        study,
        labevents,
        measurements.LABS,
        ["hadm_id"],
        plus_hours("starttime", -LAB_LEAD_HOURS),
        plus_hours("starttime", WINDOW_HOURS),
        keep=_PIVOT_KEEP,
    )


def old_vitals(study: DataFrame, chartevents: DataFrame) -> DataFrame:
    """Earlier form: vital signs up to the event, so controls give no rows."""
    return pivots.pivot_measurements(
        study,
        chartevents.filter(concepts.not_error()),
        measurements.VITALS,
        ["icustay_id"],
        "starttime",
        "og_starttime",
        keep=_PIVOT_KEEP,
    )


def old_labs(events: DataFrame, base: DataFrame, labevents: DataFrame, end: str = "og_starttime") -> DataFrame:
    """Earlier form: the older dictionary, from six hours before admission to the event column ``end``."""
    spine = events.select("icustay_id", "intime", end).join(
        base.select("icustay_id", "subject_id", "hadm_id"), "icustay_id", "inner"
    )
    return pivots.pivot_measurements(
        spine,
        labevents,
        measurements.OLD_LABS,
        ["subject_id", "hadm_id"],
        plus_hours("intime", -LAB_LEAD_HOURS),
        end,
        keep=("subject_id", "hadm_id", "icustay_id"),
    )


def first_day(wide: DataFrame, events: DataFrame, lead_hours: int = 0) -> DataFrame:
    """Rows of the first 24 hours of each event stay with ``charthour`` since admission."""
    return pivots.slice_relative(
        wide, events, ["icustay_id"], "intime", plus_hours("intime", -lead_hours), plus_hours("intime", WINDOW_HOURS)
    )


def last_day(wide: DataFrame, events: DataFrame, anchor: str = "og_starttime") -> DataFrame:
    """Rows of the last 24 hours before the event with ``charthour`` counted up to 24 at the event."""
    return pivots.slice_relative(
        wide,
        events,
        ["icustay_id"],
        anchor,
        plus_hours(anchor, -WINDOW_HOURS),
        F.col(anchor),
        hour=pivots.hours_before_anchor(),
    )


def run_study(
    icustay_detail: DataFrame,
    icustays: DataFrame,
    chartevents: DataFrame,
    labevents: DataFrame,
    outputevents: DataFrame,
    noteevents: DataFrame,
    max_rows: int | None = pieces.MAX_ROWS,
    keep=lambda name, df: df,
) -> Study:
    """The whole chain from raw relations.

    ``keep(name, frame)`` is called for the relations that several later steps read: urine totals and three
    relations of one row per stay. Pass ``lambda name, df: materialize(df, f"{folder}/{name}")`` so they are
    computed once and the lineage ends there.
    """
    urine = keep("urineoutput", concepts.urine_output(outputevents))
    echo = concepts.echo_data(noteevents)
    weights = concepts.weight_durations(chartevents, icustays, echo, max_rows=max_rows)
    summed = concepts.rolling_sums(urine)
    clean = keep("base_cohort", clean_base(base_cohort(icustay_detail, labevents), urine))
    events = keep("low_output", low_output_events(summed, clean, chartevents))
    study = keep("low_output_cohort", study_cohort(clean, events))
    rolling = concepts.rolling_urine_output(summed, weights)
    return Study(urine, rolling, events, study, cohort_vitals(study, chartevents), cohort_labs(study, labevents))
