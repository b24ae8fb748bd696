"""Eligibility, index events, windows and the whole study on a handful of stays."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from bedside.operators import cohort, pivots
from bedside.plans import low_output
from bedside.sources.schemas import TABLES
from bedside.sources.sinks import keep_in
from bedside.specs.measurements import LABS, OLD_LABS, VITALS

DAY = datetime(2024, 1, 1)


def at(hours):
    return DAY + timedelta(hours=hours)


def detail(stay, age=60.0, los=4.0, hosp="Y", icu="Y"):
    return (2000 + stay, 100 + stay, stay, "F", age, 0, at(0), at(24 * los), los, hosp, icu)


def lab(stay, code, hour, number, text=None):
    return (2000 + stay, 100 + stay, code, at(hour), text, number)


def chart(stay, code, hour, number, error=None):
    return (2000 + stay, stay, code, at(hour), None, number, error)


def test_eligibility(frame, rows):
    stays = frame(TABLES["icustay_detail"], [
        detail(1), detail(2), detail(3), detail(4), detail(5), detail(6, age=17.9), detail(7, los=1.9),
        detail(8, hosp="N"), detail(9, icu="N"), detail(10),
    ])
    labs = frame(TABLES["labevents"], [
        *[lab(s, 50912, h, 1.0) for s in (1, 6, 7, 8, 9) for h in (1, 2)],
        lab(2, 50912, 1, 1.0),  # one reading only
        lab(3, 50912, -5, 1.0), lab(3, 50912, 1, 9.0), lab(3, 50912, 2, 9.0),  # first reading before admission counts
        lab(4, 50912, -5, 4.1), lab(4, 50912, 1, 1.0), lab(4, 50912, 2, 1.0),  # first one too high
        lab(5, 50912, -7, 9.0), lab(5, 50912, 0, 4.0), lab(5, 50912, 0, 5.0), lab(5, 50912, 96, 9.0),  # tie: one passes; ends inclusive
        lab(10, 50912, 1, None), lab(10, 50912, 2, 1.0),  # first value unknown
    ])
    assert rows(low_output.base_cohort(stays, labs), "icustay_id") == [(1,), (3,), (5,)]


def test_first_event_and_gate(frame, rows):
    readings = frame("k bigint, t timestamp_ntz, v double", [
        (1, at(1), 500.0), (1, at(2), 399.0), (1, at(3), 1.0),
        (2, at(73), 1.0),  # less than a day before the end
        (3, at(72), 1.0),  # exactly a day before it
    ])
    spine = frame("k bigint, outtime timestamp_ntz", [(1, at(96)), (2, at(96)), (3, at(96)), (4, at(96))])
    first = cohort.first_event(readings, spine, "k", "t", F.col("v") < 400, "outtime", values=["v"])
    assert rows(first, "k", "t", "v") == [(1, at(2), 399.0), (3, at(72), 1.0)]
    assert rows(cohort.value_at_event(readings, first, "k", "t", ["v"])) == [(1, at(2), 399.0), (3, at(72), 1.0)]

    signs = frame("k bigint, seen timestamp_ntz", [(1, at(26)), (1, at(5)), (3, at(97)), (3, at(71))])
    assert rows(cohort.evidence_gate(first, signs, "k", "t", "seen")) == [(1, at(2), 399.0)]
    assert rows(cohort.exclude_if_exists(first, signs, ["k"])) == []


def test_labels(frame, rows):
    base = frame("k bigint, intime timestamp_ntz", [(1, at(0)), (2, at(0)), (3, at(0)), (4, at(0))])
    found = frame("k bigint, event timestamp_ntz, hours double", [(1, at(30), 30.0), (2, at(24), 24.0), (3, at(23), 23.0)])
    out = cohort.label_and_window(base, found, "k", "intime", "event", "hours")
    assert rows(out, "k", "starttime", "event", "og_label") == [
        (1, at(6), at(30), 1), (2, at(0), at(24), 1), (4, at(0), None, 0),
    ]


COHORT = (
    "subject_id bigint, hadm_id bigint, icustay_id bigint, intime timestamp_ntz, starttime timestamp_ntz, "
    "og_starttime timestamp_ntz, og_label int"
)


def test_vital_bounds(frame):
    spine = frame(COHORT, [(2001, 101, 1, at(0), at(10), at(34), 1)])
    df = frame(TABLES["chartevents"], [
        chart(1, 211, 10, 80.0), chart(1, 220045, 10, 90.0),  # both bounds of the window count, larger value wins
        chart(1, 646, 34, 100.0), chart(1, 646, 33, 100.5),  # spo2 of 100 is kept
        chart(1, 211, 11, 300.0), chart(1, 211, 12, 0.0), chart(1, 211, 13, 299.9),  # strict
        chart(1, 223761, 14, 98.6), chart(1, 676, 15, 37.5), chart(1, 223761, 16, 70.0), chart(1, 676, 17, 50.0),
        chart(1, 211, 18, 70.0, 1), chart(1, 211, 19, 71.0, 0), chart(1, 999, 20, 71.0), chart(1, 211, 34.5, 1.0),
    ])
    out = {r["charttime"]: r for r in low_output.cohort_vitals(spine, df).collect()}
    assert set(out) == {at(h) for h in (10, 34, 33, 11, 12, 13, 14, 15, 16, 17, 19)}
    assert out[at(10)]["heartrate"] == 90.0 and out[at(34)]["spo2"] == 100.0 and out[at(33)]["spo2"] is None
    assert out[at(11)]["heartrate"] is None and out[at(12)]["heartrate"] is None and out[at(13)]["heartrate"] == 299.9
    assert abs(out[at(14)]["tempc"] - 37.0) < 1e-9 and out[at(15)]["tempc"] == 37.5
    assert out[at(16)]["tempc"] is None and out[at(17)]["tempc"] is None and out[at(19)]["heartrate"] == 71.0


def test_lab_pivots(frame):
    spine = frame(COHORT, [(2001, 101, 1, at(0), at(10), at(34), 1)])
    df = frame(TABLES["labevents"], [
        lab(1, 50821, 4, 90.0), lab(1, 50821, 3.9, 90.0), lab(1, 50802, 5, -3.0), lab(1, 51466, 6, None, "NEG"),
        lab(1, 51466, 6, None, "TR"), lab(1, 50821, 7, 800.0), lab(1, 50822, 8, 4.0),
    ])
    new = {r["charttime"]: r for r in low_output.cohort_labs(spine, df).collect()}
    assert set(new) == {at(4), at(5), at(7)} and new[at(5)]["be"] is None and new[at(7)]["po2"] == 800.0
    assert len(LABS) == 53 and len(OLD_LABS) == 37 and len(VITALS) == 7
    events = spine.select("icustay_id", "intime", "og_starttime")
    old = {r["charttime"]: r for r in low_output.old_labs(events, spine.drop("intime", "og_starttime"), df).collect()}
    assert old[at(6)]["urine_blood"] == "TR" and old[at(7)]["po2"] is None and old[at(8)]["potassium"] == 4.0


def test_relative_slices(frame, rows):
    wide = frame("icustay_id bigint, charttime timestamp_ntz, x double", [
        (1, at(-3), 0.0), (1, at(0), 1.0), (1, at(24), 2.0), (1, at(24.5), 3.0), (1, at(40), 4.0), (1, at(40.1), 5.0), (2, at(0), 6.0),
    ])
    events = frame("icustay_id bigint, intime timestamp_ntz, og_starttime timestamp_ntz", [(1, at(0), at(40)), (2, at(0), None)])
    assert rows(low_output.first_day(wide, events), "x", "charthour") == [(1.0, 0.0), (2.0, 24.0), (6.0, 0.0)]
    assert rows(low_output.first_day(wide, events, 6), "x", "charthour")[0] == (0.0, -3.0)
    assert rows(low_output.last_day(wide, events), "x", "charthour") == [(2.0, 8.0), (3.0, 8.5), (4.0, 24.0)]
    line = pivots.timeline(wide, events, ["icustay_id"], "intime", "og_starttime")
    assert rows(line.filter("x = 3.0"), "charttime_h", "window_start_h", "og_start_h", "window_end_h") == [(24.5, 16.0, 40.0, 64.0)]
    episodes = frame("icustay_id bigint, starttime timestamp_ntz, endtime timestamp_ntz", [(1, at(1.26), at(9))])
    assert rows(pivots.episode_hours(episodes, events, ["icustay_id"], "intime"), "starttime_h", "endtime_h") == [(1.3, 9.0)]


def test_whole_study(frame, rows, tmp_path):
    """Stay 1 has low output after 30 h, 2 never, 3 too early, 4 has a negative volume, 5 no circulation."""
    stays = [detail(s) for s in range(1, 6)]
    labs = [lab(s, 50912, h, 1.0) for s in range(1, 6) for h in (1, 2)] + [lab(1, 50821, 7, 95.0), lab(2, 50821, 7, 96.0)]
    urine = []
    for s in range(1, 6):
        for h in range(0, 96):
            low = (s == 1 and h >= 30) or (s == 3 and h >= 3) or (s == 5 and h >= 30)
            urine.append((s, 40055, at(h), 10.0 if low else 100.0))
    urine.append((4, 227488, at(50), 1000.0))
    beats = [chart(s, 211, h, 0.0 if s == 5 and h >= 20 else 80.0) for s in range(1, 6) for h in range(0, 96, 2)]
    study = low_output.run_study(
        frame(TABLES["icustay_detail"], stays),
        frame(TABLES["icustays"], [d[:3] + d[6:8] for d in stays]),
        frame(TABLES["chartevents"], beats),
        frame(TABLES["labevents"], labs),
        frame(TABLES["outputevents"], urine),
        frame(TABLES["noteevents"], []),
        keep=keep_in(str(tmp_path)),
    )
    events = {r["icustay_id"]: r for r in study.events.collect()}
    assert set(events) == {1, 3}
    # from hour 29 one normal and 23 low readings make 330 ml in a day; the 12 h sum is 100 + 11 * 10
    assert events[1]["og_starttime"] == at(29) and events[1]["los_og"] == 29.0
    assert (events[1]["urineoutput_24hr"], events[1]["urineoutput_h"]) == (330.0, 17.5)
    cohort_rows = rows(study.cohort, "icustay_id", "og_label", "starttime")
    assert cohort_rows == [(1, 1, at(5)), (2, 0, at(0)), (5, 0, at(0))]
    assert {r["icustay_id"] for r in study.vitals.collect()} == {1, 2, 5}
    assert rows(study.labs.filter("po2 is not null"), "icustay_id", "po2") == [(1, 95.0), (2, 96.0)]
    assert study.rolling.count() == 5 * 96
