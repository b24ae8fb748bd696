from datetime import datetime, timedelta

import pytest

from bedside.plans import concepts
from bedside.sources.schemas import TABLES

DAY = datetime(2024, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


CHART = TABLES["chartevents"]
STAYS = "subject_id bigint, hadm_id bigint, icustay_id bigint, intime timestamp_ntz, outtime timestamp_ntz"
ECHO = "hadm_id bigint, charttime timestamp_ntz, weight double"


def chart(stay, code, hours, number=None, text=None, error=None):
    return (stay + 2000 if stay else None, stay, code, at(hours), text, number, error)


def test_urine_output(frame, rows):
    df = frame("icustay_id bigint, itemid int, charttime timestamp_ntz, value double", [
        (1, 40055, at(0), 100.0), (1, 226559, at(0), 50.0), (1, 227488, at(0), 200.0),  # irrigant in is negative
        (1, 40055, at(1), 4999.0), (1, 40055, at(2), 5000.0),  # limit is strict
        (1, 220045, at(3), 10.0), (None, 40055, at(0), 10.0), (2, 40069, at(0), 7.0),
    ])
    assert rows(concepts.urine_output(df)) == [(1, at(0), -50.0), (1, at(1), 4999.0), (2, at(0), 7.0)]


@pytest.mark.parametrize("max_rows", [2, 10**6])
def test_weights(frame, rows, max_rows):
    stays = frame(STAYS, [(2001, 101, 1, at(0), at(100)), (2002, 102, 2, at(0), at(50)), (2003, 103, 3, at(0), at(50)),
                          (2004, 104, 4, at(10), at(50))])
    df = frame(CHART, [
        chart(1, 762, 1, 70.0), chart(1, 763, 10, 71.0), chart(1, 226512, 20, 72.0), chart(1, 763, 30, 73.0),
        chart(1, 763, 40, 0.0), chart(1, 763, 41, 99.0, error=1), chart(1, 763, 42, None), chart(1, 211, 43, 60.0),
        chart(2, 762, 5, 80.0),  # only an admission weight
        chart(4, 763, 5, 60.0, error=0), chart(4, 763, 20, 61.0),  # charted before admission: no back-fill
    ])
    out = concepts.weight_durations(df, stays, frame(ECHO, []), max_rows=max_rows)
    assert rows(out) == [
        (1, at(-2), at(10), 71.0), (1, at(10), at(20), 71.0), (1, at(20), at(30), 72.0), (1, at(30), at(102), 73.0),
        (2, None, None, None), (3, None, None, None), (4, at(5), at(20), 60.0), (4, at(20), at(52), 61.0),
    ]


@pytest.mark.parametrize("max_rows", [2, 10**6])
def test_weights_with_admission(frame, rows, max_rows):
    stays = frame(STAYS, [(2001, 101, 1, at(0), at(100))])
    df = frame(CHART, [chart(1, 762, 15, 70.0), chart(1, 763, 10, 71.0), chart(1, 763, 30, 73.0), chart(1, 762, 31, 74.0)])
    out = concepts.weight_durations(df, stays, frame(ECHO, []), use_admit_weight=True, max_rows=max_rows)
    assert rows(out) == [
        (1, at(-2), at(10), 70.0), (1, at(10), at(30), 71.0), (1, at(30), at(31), 73.0), (1, at(31), at(102), 74.0),
    ]


@pytest.mark.parametrize("max_rows", [1, 10**6])
def test_weights_from_echo(frame, rows, max_rows):
    stays = frame(STAYS, [(2001, 101, 1, at(0), at(100)), (2002, 102, 2, at(0), at(50))])
    df = frame(CHART, [chart(1, 763, 10, 71.0)])
    echo = frame(ECHO, [(101, at(1), 100.0), (102, at(5), 100.0), (102, at(9), 200.0), (102, at(10), None)])
    out = concepts.weight_durations(df, stays, echo, echo_fallback=True, max_rows=max_rows)
    assert rows(out.filter("icustay_id = 2 and weight is not null"), "starttime", "endtime", "weight") == [
        (at(-2), at(5), 45.3592), (at(5), at(9), 45.3592), (at(9), at(52), 90.7184),
    ]
    assert rows(out.filter("icustay_id = 1"), "weight") == [(71.0,), (71.0,)]


def test_rolling_with_weight(frame, rows):
    urine = frame("icustay_id bigint, charttime timestamp_ntz, value double", [(1, at(0), 10.0), (1, at(8), 20.0)])
    weights = frame("icustay_id bigint, starttime timestamp_ntz, endtime timestamp_ntz, weight double", [(1, at(0), at(8), 70.0)])
    out = concepts.rolling_urine_output(concepts.rolling_sums(urine), weights)
    assert rows(out) == [(1, at(0), 70.0, 10.0, 30.0, 30.0), (1, at(8), None, 20.0, 20.0, 20.0)]


@pytest.mark.parametrize("max_rows", [2, 10**6])
def test_gcs(frame, max_rows):
    stays = frame(STAYS, [(2001, 101, 1, at(0), at(100)), (2002, 102, 2, at(0), at(100))])
    df = frame(CHART, [
        chart(1, 454, 0, 4.0), chart(1, 723, 0, 3.0), chart(1, 184, 0, 2.0),  # 9
        chart(1, 223901, 5, 5.0),  # rest from the reading before: 5 + 3 + 2
        chart(1, 220739, 11, 1.0),  # exactly six hours later: not used, 6 + 5 + 1
        chart(1, 723, 12, 1.0, "1.0 ET/Trach"),  # intubated: 15
        chart(1, 454, 13, 3.0),  # intubated before and verbal unknown: 15
        chart(1, 223900, 30, 2.0, "No Response-ETT"),
        chart(1, 723, 31, 2.0), chart(1, 454, 31, None),  # intubated before, now talking: 6 + 2 + 4
        chart(1, 454, 101, 1.0),  # after discharge
        chart(2, 454, 0, None),  # all unknown: 15 from the defaults
    ])
    out = concepts.gcs(df, stays, max_rows)
    found = {(r["icustay_id"], r["charttime"]): (r["gcs"], r["endotrachflag"]) for r in out.collect()}
    assert found == {
        (1, at(0)): (9.0, 0), (1, at(5)): (10.0, 0), (1, at(11)): (12.0, 0), (1, at(12)): (15.0, 1),
        (1, at(13)): (15.0, 0), (1, at(30)): (15.0, 1), (1, at(31)): (12.0, 0), (2, at(0)): (15.0, 0),
    }


def test_height_weight(frame):
    df = frame(CHART, [
        chart(1, 3581, 5, 100.0), chart(1, 762, 9, 60.0), chart(1, 3582, 1, 2000.0),  # lb, kg, oz
        chart(1, 920, 2, 70.0), chart(1, 3485, 3, 180.0), chart(1, 226707, 4, 0.0), chart(1, 920, 0, 60.0, error=1),
        chart(1, 226531, 0, 500.0),  # never selected
        chart(2, 4188, 0, 150.0),
    ])
    out = {r["icustay_id"]: r.asDict() for r in concepts.height_weight(df).collect()}
    assert out[1] | {"subject_id": 0} == {
        "icustay_id": 1, "subject_id": 0, "height_first": 177.8, "height_min": 177.8, "height_max": 180.0,
        "weight_first": 56.7, "weight_min": 45.36, "weight_max": 60.0,
    }
    assert out[2]["weight_first"] is None and out[2]["height_first"] == 150.0


REPORT = (
    "PATIENT/TEST INFORMATION:\nIndication: Murmur.\nHeight: (in) 65\nWeight (lb): {weight}\nBSA (m2): 1.68 m2\n"
    "BP (mm Hg): {bp}\nHR (bpm): 80\nStatus: Inpatient\r\nDate/Time: [**2118-3-4**] at {clock}\nTest: \n"
    "Doppler: Full\nContrast: None\nTechnical Quality: Good\n"
)


def test_echo(frame):
    ddl = TABLES["noteevents"]
    out = concepts.echo_data(frame(ddl, [
        (1, 10, 100, "2118-03-04", "Echo", REPORT.format(weight="140", bp="120/70", clock="9:05")),
        (2, 10, 100, "2118-03-04", "Echo", REPORT.format(weight="[** 3 **]", bp="120/x", clock="14:30")),
        (3, 10, 100, "2118-03-04", "Echo", "nothing here"),
        (4, 10, 100, "2118-03-04", "Nursing", REPORT),
        (5, 10, 100, "2118-03-04", "Echo", REPORT.format(weight="20-40", bp="99/50", clock="99:99")),
    ]))
    found = {r["row_id"]: r for r in out.collect()}
    assert sorted(found) == [1, 2, 3, 5]
    one = found[1]
    assert one["charttime"] == datetime(2118, 3, 4, 9, 5) and one["indication"] == "Murmur."
    assert (one["height"], one["weight"], one["bsa"], one["bp"], one["bpsys"], one["bpdias"], one["hr"]) == (
        65.0, 140.0, 1.68, "120/70", 120.0, 70.0, 80.0,
    )
    assert one["status"] == "Inpatient\r" and one["test"] == "" and one["technicalquality"] == "Good"
    assert found[2]["weight"] is None and found[2]["bpsys"] is None and found[2]["bp"] == "120/x"
    assert all(found[3][c] is None for c in ("charttime", "indication", "weight", "test"))
    assert found[5]["weight"] is None and found[5]["charttime"] is None
