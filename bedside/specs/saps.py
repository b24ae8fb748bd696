"""Severity score table: per component the guard column and its rungs in order."""

# fixed values: (predicate, points), first match wins; a value that fits no rung scores nothing
SAPS_RUNGS = {
    "age_score": ("age", (
        ("age <= 45", 0), ("age <= 55", 1), ("age <= 65", 2), ("age <= 75", 3), ("age > 75", 4),
    )),
    "hr_score": ("heartrate_max", (
        ("heartrate_max >= 180", 4), ("heartrate_min < 40", 4),
        ("heartrate_max >= 140", 3), ("heartrate_min <= 54", 3),
        ("heartrate_max >= 110", 2), ("heartrate_min <= 69", 2),
        ("heartrate_max between 70 and 109 and heartrate_min between 70 and 109", 0),
    )),
    "sysbp_score": ("sysbp_min", (
        ("sysbp_max >= 190", 4), ("sysbp_min < 55", 4),
        ("sysbp_max >= 150", 2), ("sysbp_min <= 79", 2),
        ("sysbp_max between 80 and 149 and sysbp_min between 80 and 149", 0),
    )),
    "resp_score": ("resprate_min", (
        ("resprate_max >= 50", 4), ("resprate_min < 6", 4), ("resprate_max >= 35", 3), ("resprate_min <= 9", 2),
        ("resprate_max >= 25", 1), ("resprate_min <= 11", 1),
        ("resprate_max between 12 and 24 and resprate_min between 12 and 24", 0),
    )),
    "temp_score": ("tempc_max", (
        ("tempc_max >= 41.0", 4), ("tempc_min < 30.0", 4),
        ("tempc_max >= 39.0", 3), ("tempc_min <= 31.9", 3),
        ("tempc_min <= 33.9", 2),
        ("tempc_max > 38.4", 1), ("tempc_min < 36.0", 1),
        ("tempc_max between 36.0 and 38.4 and tempc_min between 36.0 and 38.4", 0),
    )),
    "uo_score": ("urineoutput", (
        ("urineoutput > 5000", 2), ("urineoutput >= 3500", 1), ("urineoutput >= 700", 0),
        ("urineoutput >= 500", 2), ("urineoutput >= 200", 3), ("urineoutput < 200", 4),
    )),
    "vent_score": ("ventilated", (
        ("cpap = 1", 3), ("mechvent = 1", 3), ("true", 0),
    )),
    "bun_score": ("bun_max", (
        ("bun_max >= 55", 4), ("bun_max >= 36", 3), ("bun_max >= 29", 2), ("bun_max >= 7.5", 1), ("bun_min < 3.5", 1),
        ("bun_max >= 3.5 and bun_max < 7.5 and bun_min >= 3.5 and bun_min < 7.5", 0),
    )),
    "hematocrit_score": ("hematocrit_max", (
        ("hematocrit_max >= 60", 4), ("hematocrit_min < 20", 4),
        ("hematocrit_max >= 50", 2), ("hematocrit_min < 30", 2), ("hematocrit_max >= 46", 1),
        ("hematocrit_max >= 30 and hematocrit_max < 46 and hematocrit_min >= 30 and hematocrit_min < 46", 0),
    )),
    "wbc_score": ("wbc_max", (
        ("wbc_max >= 40", 4), ("wbc_min < 1", 4), ("wbc_max >= 20", 2), ("wbc_min < 3", 2), ("wbc_max >= 15", 1),
        ("wbc_max >= 3 and wbc_max < 15 and wbc_min >= 3 and wbc_min < 15", 0),
    )),
    "glucose_score": ("glucose_max", (
        ("glucose_max >= 44.5", 4), ("glucose_min < 1.6", 4),
        ("glucose_max >= 27.8", 3), ("glucose_min < 2.8", 3),
        ("glucose_min < 3.9", 2), ("glucose_max >= 14", 1),
        ("glucose_max >= 3.9 and glucose_max < 14 and glucose_min >= 3.9 and glucose_min < 14", 0),
    )),
    "potassium_score": ("potassium_max", (
        ("potassium_max >= 7", 4), ("potassium_min < 2.5", 4), ("potassium_max >= 6", 3), ("potassium_min < 3", 2),
        ("potassium_max >= 5.5", 1), ("potassium_min < 3.5", 1),
        ("potassium_max >= 3.5 and potassium_max < 5.5 and potassium_min >= 3.5 and potassium_min < 5.5", 0),
    )),
    "sodium_score": ("sodium_max", (
        ("sodium_max >= 180", 4), ("sodium_min < 110", 4),
        ("sodium_max >= 161", 3), ("sodium_min < 120", 3),
        ("sodium_max >= 156", 2), ("sodium_min < 130", 2), ("sodium_max >= 151", 1),
        ("sodium_max >= 130 and sodium_max < 151 and sodium_min >= 130 and sodium_min < 151", 0),
    )),
    "bicarbonate_score": ("bicarbonate_max", (
        ("bicarbonate_min < 5", 4), ("bicarbonate_max >= 40", 3), ("bicarbonate_min < 10", 3),
        ("bicarbonate_max >= 30", 1), ("bicarbonate_min < 20", 1),
        ("bicarbonate_max >= 20 and bicarbonate_max < 30 and bicarbonate_min >= 20 and bicarbonate_min < 30", 0),
    )),
    "gcs_score": ("mingcs", (
        ("mingcs < 3", None), ("mingcs = 3", 4), ("mingcs < 7", 3), ("mingcs < 10", 2), ("mingcs < 13", 1),
        ("mingcs between 13 and 15", 0),
    )),
}
