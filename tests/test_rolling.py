import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from bedside.functions.time import micros_between
from bedside.operators import rolling

SPANS = {"s6": 5, "s12": 11, "s24": 23}
DDL = "k bigint, t timestamp_ntz, v double"


def test_bounds_are_inclusive(frame, rows):
    df = frame(DDL, [
        (1, "2024-01-01 00:00:00", 1.0),
        (1, "2024-01-01 05:00:00", 10.0),
        (1, "2024-01-01 23:00:00", 100.0),
        (1, "2024-01-01 23:00:01", 1000.0),
        (2, "2024-01-01 00:00:00", 5.0),
        (None, "2024-01-01 00:00:00", 7.0),
    ])
    out = rolling.forward_rolling_sum(df, ["k"], "t", "v", SPANS)
    assert rows(out, "k", "v", "s6", "s12", "s24") == [
        (1, 1.0, 11.0, 11.0, 111.0),
        (1, 10.0, 10.0, 10.0, 1110.0),
        (1, 100.0, 1100.0, 1100.0, 1100.0),
        (1, 1000.0, 1000.0, 1000.0, 1000.0),
        (2, 5.0, 5.0, 5.0, 5.0),
    ]


def test_against_scan(frame):
    rng = random.Random(3)
    start = datetime(2024, 3, 9)
    data = []
    for k, n in ((1, 300), (2, 30), (3, 1)):
        minutes = rng.sample(range(20 * 24 * 60), n)
        data += [(k, start + timedelta(minutes=m), float(rng.randrange(100))) for m in minutes]
    out = rolling.forward_rolling_sum(frame(DDL, data), ["k"], "t", "v", SPANS)
    for name, hours in SPANS.items():
        expected = {
            (k, t): sum(w for j, u, w in data if j == k and t <= u <= t + timedelta(hours=hours)) for k, t, _ in data
        }
        assert {(r["k"], r["t"]): r[name] for r in out.collect()} == expected


def test_hostile_values(frame):
    """Equal times, unknown times and values, tiny and huge values, infinities, times far apart; rows stay rows."""
    start = datetime(2024, 1, 1)
    values = [1e-10, 2.5, None, 1e20, -1.0, float("inf"), 7.0, 3.0]
    data = [(1, start + timedelta(hours=h), v) for h in (0, 0, 4, 22, 23, 46) for v in values]
    data += [(1, None, 5.0), (1, None, 6.0), (2, datetime(1, 1, 1), 1.0), (2, datetime(9999, 1, 1), None), (3, start, None)]
    out = rolling.forward_rolling_sum(frame(DDL, data), ["k"], "t", "v", {"s1": 1, "s23": 23})
    assert out.columns == ["k", "t", "v", "s1", "s23"]

    def total(k, t, hours):
        held = [w for j, u, w in data if j == k and w is not None and (u is None if t is None else u is not None and t <= u <= t + timedelta(hours=min(hours, 23) if t.year < 9999 else 0))]
        return f"{sum(held):.9g}" if held else "None"

    expected = Counter((k, t, str(v), total(k, t, 1), total(k, t, 23)) for k, t, v in data)
    shown = lambda x: "None" if x is None else f"{x:.9g}"
    assert Counter((r["k"], r["t"], str(r["v"]), shown(r["s1"]), shown(r["s23"])) for r in out.collect()) == expected


def test_not_a_number_stays_in_its_frames(frame, rows):
    data = [(1, datetime(2024, 1, 1) + timedelta(hours=10 * h), v) for h, v in enumerate((1.0, float("nan"), 2.0, 4.0, 8.0))]
    out = rolling.forward_rolling_sum(frame(DDL, data), ["k"], "t", "v", {"s": 23})
    found = [r["s"] for r in sorted(out.collect(), key=lambda r: r["t"])]
    assert [str(x) for x in found] == ["nan", "nan", "14.0", "12.0", "8.0"]


def test_daylight_saving_zone_does_not_matter(spark, frame, rows):
    df = frame(DDL, [(1, "2024-03-10 00:30:00", 1.0), (1, "2024-03-10 05:30:00", 2.0), (1, "2024-03-10 05:31:00", 4.0)])
    skipped = frame("a timestamp_ntz, b timestamp_ntz", [("2024-03-10 01:00:00", "2024-03-10 02:30:00.000001")])
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        out = rows(rolling.forward_rolling_sum(df, ["k"], "t", "v", {"s": 5}), "s")
        assert skipped.select(micros_between("a", "b")).first()[0] == 5_400_000_001
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert out == [(3.0,), (4.0,), (6.0,)]


@pytest.mark.parametrize("max_rows", [2, 10**6])
def test_previous_reading_limit_is_strict(frame, rows, max_rows):
    df = frame(DDL, [
        (1, "2024-01-01 00:00:00", 1.0),
        (1, "2024-01-01 05:59:59", 2.0),
        (1, "2024-01-01 11:59:59", 3.0),
        (2, "2024-01-01 00:00:00", 9.0),
    ])
    out = rolling.previous_reading(df, ["k"], "t", {"p": "v"}, 6, max_rows)
    assert rows(out, "v", "p") == [(1.0, None), (2.0, 1.0), (3.0, None), (9.0, None)]
