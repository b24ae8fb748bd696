"""The derived clinical relations once more, as SQL for the checking engine."""

from __future__ import annotations

from bedside.catalog import codes

_HOUR = "INTERVAL 1 HOUR"


def _code(numbers: list[int]) -> str:
    return f"([{', '.join(map(str, numbers))}])[k + 1]"


def _day_columns() -> str:
    spread = {
        "heartrate": ("click", "value + 40"), "sysbp": ("view", "value * 2"), "resprate": ("error", "value / 2"),
        "tempc": ("purchase", "30 + value / 8"), "vital_glucose": ("signup", "value / 4"),
        "glucose": ("error", "value / 4"), "bun": ("click", "value / 2"), "hematocrit": ("signup", "value / 1.5::DOUBLE"),
        "wbc": ("click", "value / 3"), "sodium": ("view", "100 + value"), "potassium": ("purchase", "2 + value / 20"),
        "bicarbonate": ("error", "value / 2"),
    }
    return ", ".join(
        f"{f}({sql}) FILTER (event_type = '{kind}') AS {name}_{f}"
        for name, (kind, sql) in spread.items()
        for f in ("min", "max")
    )


RELATIONS = {
    "readings": """
        SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k,
               TIMESTAMP '2024-01-01' + to_microseconds(
                   ((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 480000000) * 60000000) AS moment
        FROM events""",
    "icustays": """
        SELECT user_id + 2000000 AS subject_id, user_id + 1000000 AS hadm_id, user_id AS icustay_id,
               min(moment) AS intime, max(moment) AS outtime
        FROM readings GROUP BY user_id""",
    "all_stays": """
        SELECT c_custkey + 2000000 AS subject_id, c_custkey + 1000000 AS hadm_id, c_custkey AS icustay_id,
               coalesce(intime, TIMESTAMP '2024-01-01') AS intime, coalesce(outtime, TIMESTAMP '2024-01-05') AS outtime
        FROM customer LEFT JOIN icustays ON icustay_id = c_custkey""",
    "icustay_detail": """
        SELECT i.*, CASE WHEN c_mktsegment < 'F' THEN 'M' ELSE 'F' END AS gender,
               floor(abs(c_acctbal) * 3 / 365) AS age, CAST(c_acctbal < 0 AS INT) AS hospital_expire_flag,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'N' ELSE 'Y' END AS first_icu_stay, 'Y' AS first_hosp_stay,
               (epoch_us(outtime) - epoch_us(intime)) / 86400000000.0::DOUBLE AS los_icu
        FROM icustays i JOIN customer ON c_custkey = icustay_id""",
    "patients": """
        SELECT c_custkey + 2000000 AS subject_id,
               DATE '2024-01-01' - CAST(floor(abs(c_acctbal)) * 3 AS INT) AS dob FROM customer""",
    "admissions": "SELECT c_custkey + 1000000 AS hadm_id FROM customer",
    "chartevents": f"""
        SELECT subject_id, icustay_id, itemid, charttime,
               CASE WHEN itemid = 723 AND kind = 'click' THEN '1.0 ET/Trach'
                    WHEN itemid = 223900 AND kind = 'click' THEN 'No Response-ETT'
                    WHEN itemid IN (467, 469, 226732) AND kind = 'click' THEN 'CPAP Mask'
                    WHEN itemid IN (467, 469, 226732) AND kind = 'view' THEN 'Bipap mask [Left]'
                    ELSE kind END AS value,
               CASE WHEN kind = 'error' AND k > 90 THEN NULL
                    WHEN itemid IN (454, 223901, 723, 223900, 184, 220739) THEN least(6.0, floor(v / 20) + 1)
                    ELSE v END AS valuenum,
               CASE WHEN kind = 'purchase' AND k BETWEEN 30 AND 40 THEN 1 WHEN kind = 'view' THEN 0 END AS error
        FROM (SELECT user_id + 2000000 AS subject_id, user_id AS icustay_id, {_code(codes.CHART)} AS itemid,
                     moment AS charttime, event_type AS kind, value AS v, k FROM readings)""",
    "labevents": f"""
        SELECT user_id + 2000000 AS subject_id, user_id + 1000000 AS hadm_id, {_code(codes.LABS)} AS itemid,
               moment AS charttime, event_type AS value, value / 10 - 0.5 AS valuenum FROM readings""",
    "outputevents": """
        SELECT user_id AS icustay_id,
               CASE event_type WHEN 'signup' THEN CASE WHEN k < 2 THEN 227488 ELSE 227489 END
                   WHEN 'click' THEN 40055 WHEN 'view' THEN 226559 WHEN 'purchase' THEN 40069 ELSE 220050 END AS itemid,
               moment AS charttime, value * CASE WHEN k > 97 THEN 40 ELSE 2 END AS value
        FROM readings""",
    "inputevents_cv": f"""
        SELECT icustay_id, charttime, itemid, CASE WHEN itemid = 42273 THEN k ELSE r END::DOUBLE AS rate,
               CASE WHEN itemid = 42273 THEN r ELSE k END::DOUBLE AS amount, stopped
        FROM (SELECT user_id AS icustay_id, moment AS charttime, {_code(codes.VASOPRESSORS)} AS itemid, k,
                     CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 0 ELSE value END AS r,
                     CASE WHEN event_type = 'error' THEN CASE WHEN k < 50 THEN 'Stopped' ELSE 'D/C''d' END END AS stopped
              FROM readings)""",
    "inputevents_mv": """
        SELECT o_custkey + 2000000 AS subject_id, o_custkey + 1000000 AS hadm_id, o_custkey AS icustay_id,
               o_orderkey // 4 AS linkorderid,
               CASE WHEN o_orderpriority < '2' THEN 221906 WHEN o_orderpriority < '3' THEN 221794
                    WHEN o_orderpriority < '4' THEN 228340 ELSE 222315 END AS itemid,
               o_orderdate AS starttime, o_orderdate + to_minutes(CAST(floor(o_totalprice / 20) AS BIGINT)) AS endtime,
               floor(o_totalprice / 2000) AS amount, 'mg' AS amountuom,
               CASE WHEN o_orderstatus = 'P' THEN 'Rewritten' ELSE 'FinishedRunning' END AS statusdescription
        FROM orders""",
    "drug_inputs_cv": """
        SELECT l_suppkey + 2000000 AS subject_id, l_suppkey + 1000000 AS hadm_id, l_shipdate AS charttime,
               CASE WHEN l_linenumber < 3 THEN 45275 WHEN l_linenumber < 6 THEN 30123 ELSE 30047 END AS itemid,
               CASE WHEN l_quantity < 45 THEN l_quantity END AS amount, 'mg' AS amountuom
        FROM lineitem WHERE l_returnflag = 'A'""",
    "prescriptions": """
        SELECT l_suppkey + 2000000 AS subject_id, l_suppkey + 1000000 AS hadm_id,
               CASE regexp_extract(p_name, '([a-z]+)$', 1) WHEN 'ring' THEN 'Furosemide 20mg/2mL'
                   WHEN 'plate' THEN 'TORSEMIDE' WHEN 'bolt' THEN 'Bumetanide' WHEN 'gear' THEN 'Ethacrynic Acid'
                   WHEN 'rod' THEN 'Lasix' WHEN 'gizmo' THEN 'torasemide' ELSE p_name END AS drug,
               l_shipdate AS startdate,
               CASE WHEN l_linenumber = 7 THEN concat(q, '-', q)
                    WHEN l_linenumber = 6 AND l_quantity > 45 THEN NULL
                    WHEN l_linenumber = 6 AND l_quantity < 5 THEN 'J20'
                    WHEN l_linenumber = 5 THEN concat(q, '0') ELSE q END AS dose_val_rx,
               'mg' AS dose_unit_rx,
               CASE WHEN l_linestatus = 'O' THEN 'IV DRIP' WHEN l_linenumber < 3 THEN 'PO/NG'
                    WHEN l_linenumber < 4 THEN 'Per G Tube' ELSE 'SC' END AS route
        FROM (SELECT *, CAST(CAST(floor(l_quantity) AS INT) AS VARCHAR) AS q FROM lineitem WHERE l_returnflag <> 'A')
        JOIN part ON p_partkey = l_partkey""",
    "noteevents": r"""
        SELECT doc_id AS row_id, doc_id + 2000000 AS subject_id, doc_id + 1000000 AS hadm_id,
               DATE '2024-01-01' + CAST(doc_id % 28 AS INT) AS chartdate,
               CASE WHEN lang = 'de' THEN 'Nursing' ELSE 'Echo' END AS category,
               concat(CASE WHEN lang <> 'fr' THEN concat('Date/Time: [**2101-1-1**] at ', n_chars % 24, ':',
                                                         lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0'), E'\n') ELSE '' END,
                      'Indication: ', source, E' check\nHeight: (in) ',
                      CASE WHEN lang = 'fr' THEN '[** 60 **]' ELSE CAST(n_chars AS VARCHAR) END,
                      E'\nWeight (lb): ', n_chars, E'.5\nBSA (m2): ', CASE WHEN lang = 'fr' THEN '*' ELSE '1.75' END,
                      E' m2\nBP (mm Hg): ', n_chars, E'/80\nHR (bpm): ', CASE WHEN lang = 'en' THEN '72' ELSE 'unknown' END,
                      E'\nStatus: Inpatient\r\nTest: TTE (Complete)\nDoppler: \nTechnical Quality: Adequate\n', text) AS text
        FROM documents""",
    "first_day": f"""
        SELECT icustay_id, {_day_columns()},
               floor(min(value) FILTER (event_type = 'signup') / 5) + 2 AS mingcs,
               sum(value * 10) FILTER (event_type = 'view') AS urineoutput,
               max(CASE WHEN k > 90 THEN 1 WHEN k > 50 THEN 0 END) AS mechvent
        FROM readings JOIN icustays ON icustay_id = user_id WHERE moment <= intime + 24 * {_HOUR} GROUP BY icustay_id""",
}

_NEEDS = {
    "readings": [],
    "icustays": ["readings"],
    "all_stays": ["icustays"],
    "icustay_detail": ["icustays"],
    "chartevents": ["readings"],
    "labevents": ["readings"],
    "outputevents": ["readings"],
    "inputevents_cv": ["readings"],
    "first_day": ["readings", "icustays"],
}


def with_relations(names: list[str], steps: dict[str, str], final: str) -> str:
    """A statement whose CTEs are the named relations, what they need, and the given steps in order."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        ordered.setdefault(name, RELATIONS[name])

    for name in names:
        add(name)
    ordered.update(steps)
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ordered.items())
    return f"WITH {body}\n{final}"
