"""Drug exposure and severity: vasopressor episodes, diuretics, SAPS."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.functions import scores, text
from bedside.functions.time import age_in_years, plus_hours
from bedside.operators import intervals, runs, pieces
from bedside.plans.concepts import not_error
from bedside.specs import diuretics, fluids
from bedside.specs.saps import SAPS_RUNGS


def infusion_runs(inputevents_cv: DataFrame, max_rows: int | None = pieces.MAX_ROWS) -> DataFrame:
    """Vasopressor deliveries per (stay, drug) from point readings; two codes store rate and amount swapped."""
    swapped = F.col("itemid").isin(*fluids.VASOPRESSOR_SWAPPED)
    doses = inputevents_cv.filter(F.col("itemid").isin(*fluids.VASOPRESSOR_CV)).select(
        "icustay_id",
        "itemid",
        "charttime",
        F.when(swapped, F.col("amount")).otherwise(F.col("rate")).alias("rate"),
        F.when(F.col("stopped").isin(*fluids.STOPPED_TEXTS), 1).otherwise(0).alias("stopped"),
    )
    return runs.dose_runs(doses, ["icustay_id", "itemid"], "charttime", "rate", "stopped", max_rows)


def order_intervals(inputevents_mv: DataFrame) -> DataFrame:
    """Vasopressor orders as one interval per link id, without rewritten orders."""
    valid = inputevents_mv.filter(
        F.col("itemid").isin(*fluids.VASOPRESSOR_MV) & (F.col("statusdescription") != fluids.INVALID_ORDER)
    )
    return intervals.collapse_linked(valid, ["icustay_id", "linkorderid"], "starttime", "endtime")


def vasopressor_durations(
    inputevents_cv: DataFrame, inputevents_mv: DataFrame, max_rows: int | None = pieces.MAX_ROWS
) -> DataFrame:
    """Vasopressor episodes per stay over all drugs, numbered within each source system."""
    readings = inputevents_cv.filter(F.col("itemid").isin(*fluids.VASOPRESSOR_CV))
    orders = inputevents_mv.filter(F.col("itemid").isin(*fluids.VASOPRESSOR_MV))
    key, start, end = ["icustay_id"], "starttime", "endtime"
    cv_limit = pieces.limit_for(readings, key, max_rows)
    mv_limit = pieces.limit_for(orders, key, max_rows)
    parts = []
    for source, raw, limit in (
        (infusion_runs(inputevents_cv, cv_limit), readings.select(*key, F.col("charttime").alias(start)), cv_limit),
        (order_intervals(inputevents_mv), orders.select(*key, start), mv_limit),
    ):
        merged = intervals.merge_intervals(source, key, start, end, limit, sized_by=raw)
        parts.append(intervals.number_episodes(merged, key, start, end, "vasonum", limit, sized_by=raw))
    return parts[0].unionByName(parts[1]).distinct()


def diuretic_exposure(
    inputevents_mv: DataFrame,
    inputevents_cv: DataFrame,
    prescriptions: DataFrame,
    max_rows: int | None = pieces.MAX_ROWS,
) -> DataFrame:
    """Daily diuretic doses from three sources with resistance flag, sequence and equivalents."""
    columns = ["subject_id", "hadm_id", "drug", "startdate", "dose", "dose_unit_rx", "route"]

    def infused(df: DataFrame, names: dict, time: str) -> DataFrame:
        drug = F.coalesce(*[F.when(F.col("itemid") == code, F.lit(name)) for code, name in names.items()])
        return df.filter(F.col("itemid").isin(*names)).select(
            "subject_id",
            "hadm_id",
            drug.alias("drug"),
            F.col(time).cast("date").alias("startdate"),
            F.col("amount").alias("dose"),
            F.col("amountuom").alias("dose_unit_rx"),
            F.lit("IV").alias("route"),
        )

    unwanted = reduce(
        lambda a, b: a | b, [text.contains_ignoring_case("dose_val_rx", t) for t in diuretics.UNWANTED_DOSE_TEXT]
    )
    named = text.first_keyword("drug", diuretics.PRESCRIBED)
    prescribed = prescriptions.filter(named.isNotNull() & ~unwanted).select(
        "subject_id",
        "hadm_id",
        named.alias("drug"),
        F.col("startdate").cast("date").alias("startdate"),
        F.col("dose_val_rx").try_cast("double").alias("dose"),
        "dose_unit_rx",
        text.first_keyword("route", diuretics.ROUTES).alias("route"),
    )
    doses = (
        infused(inputevents_mv, diuretics.MV_DRUGS, "starttime")
        .unionByName(infused(inputevents_cv, diuretics.CV_DRUGS, "charttime").filter(F.col("dose").isNotNull()))
        .unionByName(prescribed)
        .select(columns)
    )
    # the raw rows bound the doses and are counted without looking at their texts
    raw = (
        inputevents_mv.select("hadm_id", F.col("starttime").cast("date").alias("startdate"))
        .unionByName(inputevents_cv.select("hadm_id", F.col("charttime").cast("date").alias("startdate")))
        .unionByName(prescriptions.select("hadm_id", F.col("startdate").cast("date").alias("startdate")))
    )
    return daily_exposure(doses, "hadm_id", max_rows, sized_by=raw)


def daily_exposure(
    doses: DataFrame, entity: str, max_rows: int | None = pieces.MAX_ROWS, sized_by: DataFrame | None = None
) -> DataFrame:
    """Daily dose per drug, unit and route; ``druguse_seq`` numbers an entity's days by date.

    Columns wanted: subject_id, hadm_id, drug, startdate (date), dose, dose_unit_rx, route.
    """
    daily = doses.groupBy("subject_id", "hadm_id", "drug", "startdate", "dose_unit_rx", "route").agg(
        F.sum("dose").alias("dose")
    )
    flagged = daily.withColumn("date", F.col("startdate")).withColumn("diur_resis", _resistance())
    numbered = pieces.add_row_number(
        flagged,
        [entity],
        F.unix_date("startdate"),
        ["subject_id", "drug", "route", "dose_unit_rx"],
        "druguse_seq",
        max_rows,
        sized_by=doses.select(entity, "startdate") if sized_by is None else sized_by,
    )
    return numbered.withColumn("unit", _equivalents())


def _is(drug: str, route: str | None) -> Column:
    hit = F.col("drug") == drug
    return hit if route is None else hit & (F.col("route") == route)


def _resistance() -> Column:
    flag = F.when(F.col("route") == diuretics.CRITICAL_ROUTE, 1)
    for drug, route, limit in diuretics.RESISTANCE:
        flag = flag.when(_is(drug, route) & (F.col("dose") > limit), 1)
    return flag


def _equivalents() -> Column:
    return F.coalesce(*[
        F.when(_is(drug, route), F.col("dose") / F.lit(float(size))) for drug, route, size in diuretics.EQUIVALENTS
    ])


def mask_ventilation(chartevents: DataFrame, icustays: DataFrame) -> DataFrame:
    """Stays with a CPAP or BiPAP mask recorded on their first day."""
    masks = chartevents.filter(
        F.col("itemid").isin(*fluids.CPAP_CODES) & F.lower("value").rlike(fluids.CPAP_PATTERN) & not_error()
    ).select("icustay_id", "charttime")
    days = icustays.select("icustay_id", "intime", plus_hours("intime", 24).alias("dayend"))
    seen = intervals.interval_join(masks, days, ["icustay_id"], "charttime", "intime", "dayend", "inner", closed=True)
    return seen.select("icustay_id").distinct().withColumn("cpap", F.lit(1))


def saps(
    icustays: DataFrame,
    admissions: DataFrame,
    patients: DataFrame,
    chartevents: DataFrame,
    gcsfirstday: DataFrame,
    vitalsfirstday: DataFrame,
    uofirstday: DataFrame,
    ventfirstday: DataFrame,
    labsfirstday: DataFrame,
) -> DataFrame:
    """Severity score of each stay with its fifteen components; missing components count zero in the total."""
    both = ["glucose_min", "glucose_max"]
    labs = labsfirstday.withColumnsRenamed({c: f"lab_{c}" for c in both})
    known = (
        icustays.join(admissions.select("hadm_id"), "hadm_id", "left_semi")
        .join(patients.select("subject_id", "dob"), "subject_id", "inner")
        .join(mask_ventilation(chartevents, icustays), "icustay_id", "left")
        .join(gcsfirstday, "icustay_id", "left")
        .join(vitalsfirstday, "icustay_id", "left")
        .join(uofirstday, "icustay_id", "left")
        .join(ventfirstday, "icustay_id", "left")
        .join(labs, "icustay_id", "left")
        .withColumns({c: F.coalesce(c, f"lab_{c}") for c in both})
        .withColumn("age", age_in_years("dob", "intime"))
        .withColumn("ventilated", F.coalesce("mechvent", "cpap"))
    )
    parts = known.select(
        "icustay_id",
        *[scores.score_ladder(F.col(guard), rungs).alias(name) for name, (guard, rungs) in SAPS_RUNGS.items()],
    )
    scored = icustays.select("subject_id", "hadm_id", "icustay_id").join(parts, "icustay_id", "left")
    return scored.select(
        "subject_id", "hadm_id", "icustay_id", scores.total_score(list(SAPS_RUNGS)).alias("saps"), *SAPS_RUNGS
    )
