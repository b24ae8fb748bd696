"""Wide-column dictionaries of the bedside and laboratory pivots."""

from __future__ import annotations

from bedside.operators.pivots import Measure, Spec

# fixed values: item codes and plausible ranges of the vital signs
VITALS: Spec = {
    "heartrate": (Measure((211, 220045), above=0, below=300),),
    "sysbp": (Measure((51, 442, 455, 6701, 220179, 220050), above=0, below=400),),
    "diasbp": (Measure((8368, 8440, 8441, 8555, 220180, 220051), above=0, below=300),),
    "meanbp": (Measure((456, 52, 6702, 443, 220052, 220181, 225312), above=0, below=300),),
    "resprate": (Measure((615, 618, 220210, 224690), above=0, below=70),),
    "tempc": (
        Measure((223761, 678), above=70, below=120, convert="(value - 32) / 1.8D"),
        Measure((223762, 676), above=10, below=50),
    ),
    "spo2": (Measure((646, 220277), above=0, at_most=100),),
}

# fixed values: laboratory item codes, current dictionary
LAB_CODES = {
    "po2": 50821,
    "pco2": 50818,
    "arterial_ph": 50820,
    "lactate": 50813,
    "be": 50802,
    "bicarbonate": 50803,
    "sao2": 50817,
    "total_co2": 50804,
    "hemoglobin": 51222,
    "serum_rbc": 51279,
    "serum_wbc": 51301,
    "plt": 51265,
    "neutrophils": 51256,
    "hematocrit": 51221,
    "urine_ph": 51491,
    "urine_specific_gravity": 51498,
    "urine_rbc": 51493,
    "urine_wbc": 51516,
    "epithelial_cells": 51476,
    "urine_protein": 51492,
    "nitrite": 51487,
    "alt": 50861,
    "ast": 50878,
    "serum_albumin": 50862,
    "total_protein": 50976,
    "bilirubin_direct": 50883,
    "bilirubin_indirect": 50884,
    "troponin_t": 51003,
    "alp": 50863,
    "r_gt": 50927,
    "glucose": 50931,
    "bun": 51006,
    "creatinine": 50912,
    "uric_acid": 51007,
    "creatine_kinase": 50910,
    "crp": 50889,
    "ld": 50954,
    "calcium": 50893,
    "phosphate": 50970,
    "magnesium": 50960,
    "potassium": 50971,
    "sodium": 50983,
    "chloride": 50902,
    "amylase": 50867,
    "lipase": 50956,
    "ck_mb": 50911,
    "ntprobnp": 50963,
    "thrombin": 51297,
    "ptt": 51275,
    "pt": 51274,
    "inr": 51237,
    "fibrinogen": 51214,
    "d_dimer": 51196,
}

# fixed values: laboratory item codes, earlier dictionary (numbers)
OLD_LAB_CODES = {
    "po2": 50821,
    "pco2": 50818,
    "arterialph": 50820,
    "potassium": 50822,
    "calcium": 50808,
    "sodium": 50824,
    "chloride": 50806,
    "glucose": 50809,
    "bicarbonate": 50882,
    "be": 50802,
    "arterialwbc": 51301,
    "arterialrbc": 51279,
    "plt": 51265,
    "crp": 50889,
    "lactate": 50813,
    "alt": 50861,
    "ast": 50878,
    "creatinine": 50912,
    "bun": 51006,
    "amylase": 50867,
    "lipase": 50956,
    "urine_ph": 51094,
    "urine_wbc": 51516,
    "urine_protein": 51492,
    "urine_glucose": 51478,
    "urine_bilirubin": 51464,
    "urine_ketone": 51484,
    "urine_rbc": 51493,
    "specificgravity": 51498,
    "urobilinogen": 51514,
    "aptt": 51275,
    "pt": 51274,
    "inr": 51237,
    "d_dimer": 51196,
    "fib": 51214,
}

# fixed values: laboratory item codes, earlier dictionary (text results)
OLD_LAB_TEXT_CODES = {"urine_blood": 51466, "urine_color": 51508}

LABS: Spec = {name: (Measure((code,), above=0),) for name, code in LAB_CODES.items()}

OLD_LABS: Spec = {
    **{
        name: (Measure((code,), above=0, below=800 if name == "po2" else None),)
        for name, code in OLD_LAB_CODES.items()
    },
    **{name: (Measure((code,), text=True),) for name, code in OLD_LAB_TEXT_CODES.items()},
}

CREATININE = 50912
HEART_RATE = (211, 220045)
SYSTOLIC_EVIDENCE = (6, 51, 455, 6701, 220050, 220179)
