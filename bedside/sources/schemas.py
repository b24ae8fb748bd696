"""Explicit schemas, as DDL, of the input relations and of the file fixtures."""

from __future__ import annotations

from bedside.specs.measurements import LAB_CODES, VITALS

_IDS = "subject_id bigint, hadm_id bigint, icustay_id bigint"

TABLES: dict[str, str] = {
    "icustay_detail": (
        f"{_IDS}, gender string, age double, hospital_expire_flag int, intime timestamp_ntz, outtime timestamp_ntz, "
        "los_icu double, first_hosp_stay string, first_icu_stay string"
    ),
    "icustays": f"{_IDS}, intime timestamp_ntz, outtime timestamp_ntz",
    "admissions": "hadm_id bigint",
    "patients": "subject_id bigint, dob timestamp_ntz",
    "chartevents": (
        "subject_id bigint, icustay_id bigint, itemid int, charttime timestamp_ntz, value string, "
        "valuenum double, error int"
    ),
    "labevents": (
        "subject_id bigint, hadm_id bigint, itemid int, charttime timestamp_ntz, value string, valuenum double"
    ),
    "outputevents": "icustay_id bigint, itemid int, charttime timestamp_ntz, value double",
    "inputevents_cv": (
        f"{_IDS}, charttime timestamp_ntz, itemid int, rate double, amount double, amountuom string, stopped string"
    ),
    "inputevents_mv": (
        f"{_IDS}, linkorderid bigint, itemid int, starttime timestamp_ntz, endtime timestamp_ntz, amount double, "
        "amountuom string, statusdescription string"
    ),
    "prescriptions": (
        "subject_id bigint, hadm_id bigint, drug string, startdate timestamp_ntz, dose_val_rx string, "
        "dose_unit_rx string, route string"
    ),
    "noteevents": (
        "row_id bigint, subject_id bigint, hadm_id bigint, chartdate date, category string, text string"
    ),
    "gcsfirstday": "icustay_id bigint, mingcs double",
    "vitalsfirstday": (
        "icustay_id bigint, "
        + ", ".join(
            f"{v}_{a} double" for v in ("heartrate", "sysbp", "resprate", "tempc", "glucose") for a in ("min", "max")
        )
    ),
    "uofirstday": "icustay_id bigint, urineoutput double",
    "ventfirstday": "icustay_id bigint, mechvent int",
    "labsfirstday": (
        "icustay_id bigint, "
        + ", ".join(
            f"{v}_{a} double"
            for v in ("glucose", "bun", "hematocrit", "wbc", "sodium", "potassium", "bicarbonate")
            for a in ("min", "max")
        )
    ),
}

# files: timestamps are declared as text and parsed after reading, since two layouts occur
_WIDE_HEAD = (
    f"{_IDS}, og_label int, intime string, og_starttime string, charttime string, charttime_h double, "
)
_EPISODE_TAIL = "starttime string, endtime string, duration_hours double"
FILES: dict[str, str] = {
    "wide_vitals": (_WIDE_HEAD + ", ".join(f"{v} double" for v in VITALS)),
    "wide_labs": (_WIDE_HEAD + ", ".join(f"{v} double" for v in LAB_CODES)),
    "vasopressor_episodes": (
        f"icustay_id bigint, vasonum int, {_EPISODE_TAIL}, starttime_h double, endtime_h double"
    ),
    "vasopressor_episodes_short": f"icustay_id bigint, vasonum int, {_EPISODE_TAIL}",
    "ventilation_episodes": (
        f"icustay_id bigint, ventnum int, {_EPISODE_TAIL}, starttime_h double, endtime_h double"
    ),
    "ventilation_episodes_short": f"icustay_id bigint, ventnum int, {_EPISODE_TAIL}",
    "importance": "position int, feature string, gain double, split bigint",
    "importance_oldest": "position int, split bigint",
}


def column_names(ddl: str) -> list[str]:
    return [column.split()[0] for column in ddl.split(",")]
