from datetime import date, datetime, timedelta

import pytest

from bedside.plans import exposures
from bedside.sources.schemas import TABLES, column_names
from bedside.specs.saps import SAPS_RUNGS

DAY = datetime(2024, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


def ddl(name):
    return TABLES[name]


@pytest.mark.parametrize("max_rows", [2, 10**6])
def test_vasopressors(frame, rows, max_rows):
    def cv(code, hour, rate, amount=None, stopped=None):
        return (2001, 101, 1, at(hour), code, rate, amount, "mg", stopped)

    def mv(link, start, end, status="FinishedRunning", code=221906):
        return (2001, 101, 1, link, code, at(start), at(end), 1.0, "mg", status)

    points = frame(ddl("inputevents_cv"), [
        cv(30047, 0, 1.0), cv(30047, 1, 2.0), cv(30047, 2, 0.0),
        cv(30120, 1, 1.0), cv(30120, 5, 1.0, stopped="D/C'd"),  # overlaps the first drug
        cv(42273, 10, None, 3.0), cv(42273, 12, None, 3.0, "Stopped"),  # rate sits in the amount column
        cv(40055, 20, 1.0), cv(40055, 30, 1.0),  # no vasopressor
    ])
    orders = frame(ddl("inputevents_mv"), [
        mv(1, 0, 2), mv(1, 2, 4), mv(2, 4, 6), mv(3, 7, 8), mv(4, 8, 20, "Rewritten"), mv(5, 9, 30, code=1),
    ])
    out = exposures.vasopressor_durations(points, orders, max_rows)
    assert rows(out) == [
        (1, 1, at(0), at(5), 5.0), (1, 1, at(0), at(6), 6.0), (1, 2, at(7), at(8), 1.0), (1, 2, at(10), at(12), 2.0),
    ]


@pytest.mark.parametrize("max_rows", [2, 10**6])
def test_diuretics(frame, max_rows):
    mv = frame(ddl("inputevents_mv"), [
        (1, 10, 5, 1, 221794, at(1), at(2), 50.0, "mg", "x"), (1, 10, 5, 2, 228340, at(5), at(6), 40.0, "mg", "x"),
        (1, 10, 5, 3, 1, at(5), at(6), 40.0, "mg", "x"),
    ])
    cv = frame(ddl("inputevents_cv"), [
        (1, 10, 5, at(30), 45275, None, 3.0, "mg", None), (1, 10, 5, at(31), 30123, None, None, "mg", None),
    ])
    pr = frame(ddl("prescriptions"), [
        (1, 10, "Furosemide 40mg", at(48), "170", "mg", "PO/NG"),
        (1, 10, "LASIX", at(72), "500", "mg", "IV DRIP"),  # no rule and no equivalent
        (1, 10, "Torsemide", at(96), "41", "mg", "PO"),
        (1, 10, "Ethacrynic Acid", at(120), "20-40", "mg", "PO"),  # dropped
        (1, 10, "Ethacrynic Acid", at(120), "J20", "mg", "PO"),  # dropped
        (1, 10, "Ethacrynic Acid", at(120), None, "mg", "PO"),  # dropped
        (1, 10, "Bumetanide", at(144), "1", "mg", "PER G TUBE"),
        (1, 10, "Aspirin", at(144), "1", "mg", "PO"),
    ])
    out = exposures.diuretic_exposure(mv, cv, pr, max_rows).orderBy("druguse_seq")
    found = [(r["druguse_seq"], r["drug"], r["startdate"], r["dose"], r["route"], r["diur_resis"], r["unit"]) for r in out.collect()]
    assert found == [
        (1, "furosemide", date(2024, 1, 1), 90.0, "IV", 1, 2.25),
        (2, "bumetanide", date(2024, 1, 2), 3.0, "IV", 1, 1.5),
        (3, "furosemide", date(2024, 1, 3), 170.0, "PO", 1, 2.125),
        (4, "lasix", date(2024, 1, 4), 500.0, "IV", None, None),
        (5, "torasemide", date(2024, 1, 5), 41.0, "PO", 1, 2.05),
        (6, "bumetanide", date(2024, 1, 7), 1.0, "G TUBE", 1, 0.5),
    ]


@pytest.fixture
def saps_of(frame):
    def build(vitals=None, labs=None, gcs=None, urine=None, vent=None, mask=None, dob="1964-01-01"):
        stays = frame(ddl("icustays"), [(1, 10, 100, DAY, at(100))])
        v = vitals or {}
        lab = labs or {}
        chart = [(1, 100, 467, at(hour), text, None, error) for hour, text, error in mask or []]
        out = exposures.saps(
            stays,
            frame(ddl("admissions"), [(10,)]),
            frame(ddl("patients"), [(1, f"{dob} 00:00:00")]),
            frame(ddl("chartevents"), chart),
            frame(ddl("gcsfirstday"), [(100, gcs)]),
            frame(ddl("vitalsfirstday"), [(100, *[v.get(c) for c in column_names(TABLES["vitalsfirstday"])[1:]])]),
            frame(ddl("uofirstday"), [(100, urine)]),
            frame(ddl("ventfirstday"), [(100, vent)] if vent is not None else []),
            frame(ddl("labsfirstday"), [(100, *[lab.get(c) for c in column_names(TABLES["labsfirstday"])[1:]])]),
        )
        return out.first().asDict()

    return build


def test_saps_without_data(saps_of):
    row = saps_of()
    assert row["age_score"] == 2 and row["saps"] == 2  # sixty years by days over the mean year
    assert all(row[c] is None for c in SAPS_RUNGS if c != "age_score")


def test_saps_gap_scores_nothing(saps_of):
    row = saps_of(vitals={"heartrate_max": 109.5, "heartrate_min": 80.0}, dob="2000-01-01")
    assert row["hr_score"] is None and row["saps"] == 0


def test_saps_components(saps_of):
    row = saps_of(
        vitals={"heartrate_max": 140.0, "heartrate_min": 60.0, "sysbp_min": 80.0, "sysbp_max": 149.0, "tempc_max": 38.5,
                "tempc_min": 36.5, "resprate_min": 5.0, "resprate_max": 20.0, "glucose_max": 50.0, "glucose_min": 5.0},
        labs={"glucose_max": 5.0, "glucose_min": 5.0, "bun_max": 7.5, "bun_min": 4.0, "potassium_max": 5.0, "potassium_min": 2.9},
        gcs=2.0, urine=600.0, mask=[(1, "Cpap Mask", None), (30, "cpap mask", None)],
    )
    expected = {"hr_score": 3, "sysbp_score": 0, "temp_score": 1, "resp_score": 4, "glucose_score": 4, "bun_score": 1,
                "potassium_score": 2, "gcs_score": None, "uo_score": 2, "vent_score": 3, "wbc_score": None}
    assert {k: row[k] for k in expected} == expected
    assert row["saps"] == sum(v or 0 for k, v in row.items() if k in SAPS_RUNGS)


@pytest.mark.parametrize("mask,vent,score", [
    ([(25, "cpap mask", None)], None, None), ([(1, "cpap mask", 1)], None, None), ([(1, "bipap mask xl", 0)], 0, 3),
    (None, 1, 3), (None, 0, 0),
])
def test_saps_ventilation(saps_of, mask, vent, score):
    assert saps_of(mask=mask, vent=vent)["vent_score"] == score


def test_saps_query_keeps_one_aggregation_of_the_first_day(spark, frame, tmp_path):
    from bedside.catalog.registry import QUERIES

    kinds = ["click", "view", "error", "purchase", "signup"]
    events = [(i, at(i), 1 + i % 3, kinds[i % 5], 10.0 * (i % 9), f'{{"k": {(7 * i) % 100}}}') for i in range(60)]
    frame("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", events).write.parquet(f"{tmp_path}/events.parquet")
    people = [(1, "BUILDING", 900.0), (2, "MACHINERY", -20.0)]  # the third stay has no patient
    frame("c_custkey bigint, c_mktsegment string, c_acctbal double", people).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["saps"](spark, str(tmp_path))
    scans = [s for s in found._jdf.queryExecution().optimizedPlan().collectLeaves().mkString("\n").split("\n") if "props" in s]
    assert len(scans) == 1  # the mask readings; a sort-merge join for every other copy would hold its memory in the same task
    assert {r["icustay_id"]: r["age_score"] is not None for r in found.collect()} == {1: True, 2: True, 3: False}
