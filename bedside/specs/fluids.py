"""Item codes of urine output, body size, consciousness and drugs."""

# fixed values: urine output codes; irrigant in counts negative
URINE_IRRIGANT_IN = 227488
URINE = (
    40055, 43175, 40069, 40094, 40715, 40473, 40085, 40057, 40056, 40405, 40428, 40086, 40096, 40651,
    226559, 226560, 226561, 226584, 226563, 226564, 226565, 226567, 226557, 226558, 227488, 227489,
)
URINE_MAX_VALUE = 5000

# fixed values: weights for validity intervals
ADMIT_WEIGHT = (762, 226512)
DAILY_WEIGHT = (763, 224639)
LB_TO_KG_ECHO = 0.453592
INTERVAL_SLACK_HOURS = 2

# fixed values: height and weight codes with their factor to kg or cm
WEIGHT_FACTORS = {762: 1.0, 763: 1.0, 3723: 1.0, 3580: 1.0, 3581: 0.45359237, 3582: 0.0283495231, 226512: 1.0}
HEIGHT_FACTORS = {920: 2.54, 1394: 2.54, 4187: 2.54, 3486: 2.54, 3485: 1.0, 4188: 1.0, 226707: 2.54}

# fixed values: Glasgow coma scale components, both code systems, and the texts that mark intubation
GCS_CODES = {"gcsmotor": (454, 223901), "gcsverbal": (723, 223900), "gcseyes": (184, 220739)}
GCS_NORMAL = {"gcsmotor": 6, "gcsverbal": 5, "gcseyes": 4}
GCS_INTUBATED = {723: "1.0 ET/Trach", 223900: "No Response-ETT"}
GCS_SEDATED_TOTAL = 15
GCS_REACH_HOURS = 6

# fixed values: vasopressor codes; the swapped pair stores its rate in the amount column
VASOPRESSOR_CV = (
    30047, 30120, 30044, 30119, 30309, 30127, 30128, 30051, 30043, 30307, 30042, 30306, 30125, 42273, 42802,
)
VASOPRESSOR_SWAPPED = (42273, 42802)
VASOPRESSOR_MV = (221906, 221289, 221749, 222315, 221662, 221653, 221986)
STOPPED_TEXTS = ("Stopped", "D/C'd")
INVALID_ORDER = "Rewritten"

# fixed values: mask ventilation
CPAP_CODES = (467, 469, 226732)
CPAP_PATTERN = "(cpap mask|bipap mask)"
