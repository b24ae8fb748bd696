import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bedside.operators import intervals

DDL = "k bigint, s timestamp_ntz, e timestamp_ntz"
DAY = datetime(2024, 1, 1)


def at(minutes):
    return DAY + timedelta(minutes=minutes)


def merged_by_scan(data):
    out = []
    for k in sorted({k for k, _, _ in data}):
        current = None
        for s, e in sorted((s, e) for j, s, e in data if j == k and s <= e):
            if current and s <= current[1]:
                current[1] = max(current[1], e)
            else:
                current = [s, e]
                out.append((k, current))
    return sorted((k, tuple(v)) for k, v in out)


@pytest.mark.parametrize("max_rows", [2, 10**6])
def test_merge_cases(frame, max_rows):
    data = [
        (1, at(0), at(10)), (1, at(10), at(20)),  # touching
        (1, at(30), at(60)), (1, at(35), at(40)), (1, at(50), at(70)),  # nested, then overlapping the longer one
        (1, at(100), at(110)), (1, at(100), at(110)), (1, at(100), at(105)),  # identical
        (2, at(0), at(10)), (2, at(10) + timedelta(seconds=1), at(20)),  # a second apart
        (2, at(40), at(30)),  # ends before it starts: dropped
    ]
    out = intervals.merge_intervals(frame(DDL, data), ["k"], "s", "e", max_rows)
    assert sorted((r["k"], (r["s"], r["e"])) for r in out.collect()) == merged_by_scan(data)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("max_rows", [15, 10**6])
def test_merge_random(frame, seed, max_rows):
    rng = random.Random(seed)
    data = []
    for _ in range(400):
        k = 1 if rng.random() < 0.5 else rng.randrange(2, 6)
        s = rng.randrange(6000)
        data.append((k, at(s), at(s + rng.choice([0, 3, 10, 400]) * (rng.random() < 0.5) + rng.randrange(12))))
    out = intervals.merge_intervals(frame(DDL, data), ["k"], "s", "e", max_rows)
    assert sorted((r["k"], (r["s"], r["e"])) for r in out.collect()) == merged_by_scan(data)


def test_point_lookup(frame, rows):
    points = frame("k bigint, t timestamp_ntz", [(1, at(0)), (1, at(60)), (1, at(5000)), (2, at(0)), (None, at(0))])
    held = frame("k bigint, s timestamp_ntz, e timestamp_ntz, w double", [
        (1, at(0), at(60), 1.0), (1, at(60), at(9000), 2.0), (1, at(4000), at(6000), 3.0), (1, None, at(9000), 4.0),
    ])
    out = intervals.attach_interval_value(points, held, ["k"], "t", "s", "e", "w")
    assert rows(out) == [
        (None, at(0), None), (1, at(0), 1.0), (1, at(60), 2.0), (1, at(5000), 2.0), (1, at(5000), 3.0), (2, at(0), None),
    ]


def test_lookup_in_a_crowd(frame):
    """Seconds-long, day-long and years-long intervals of one entity, before and after 1970 too."""
    rng = random.Random(4)
    starts = sorted(rng.sample(range(5000), 120))
    held = [(1, at(s), at(e), float(s)) for s, e in zip(starts, [*starts[1:], 5200])] + [(1, at(100), at(3000), -1.0), (2, at(0), at(4000), 0.5)]
    held += [(1, at(s), at(s) + timedelta(seconds=rng.choice([1, 40, 3000])), 1e6 + i) for i, s in enumerate(rng.choices(range(5000), k=300))]
    held += [(1, datetime(1950, 1, 1), datetime(2030, 1, 1), -2.0), (2, datetime(1, 1, 1), datetime(9999, 12, 31), -3.0), (1, at(7), at(7), -4.0), (1, at(9), at(8), -5.0), (None, at(0), at(9), -6.0)]
    points = [(k, at(rng.randrange(5300)) + timedelta(seconds=rng.randrange(60))) for k in (1, 1, 1, 2) for _ in range(60)]
    points += [(1, datetime(1960, 2, 3)), (1, at(7)), (1, at(7)), (2, datetime(1, 1, 1)), (None, at(1)), (1, None), (3, at(0))]
    for closed in (False, True):
        out = intervals.attach_intervals(
            frame("k bigint, t timestamp_ntz", points), frame("k bigint, s timestamp_ntz, e timestamp_ntz, w double", held), ["k"], "t", "s", "e", closed
        )
        expected = []
        for k, t in points:
            found = [(s, e, w) for j, s, e, w in held if k is not None and t is not None and j == k and s <= t and (t <= e if closed else t < e)]
            expected += [(k, t, *f) for f in found or [(None, None, None)]]
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, expected))


def test_an_interval_lies_in_two_buckets_of_its_class_at_most(frame):
    rng = random.Random(9)
    held = [(1, at(0) + timedelta(microseconds=s), at(0) + timedelta(microseconds=s + rng.randrange(2 ** rng.randrange(1, 58)))) for s in rng.choices(range(10**12), k=400)]
    held += [(1, datetime(1, 1, 1), datetime(9999, 12, 31))]
    placed = intervals.placed_by_size(frame(DDL, held), "s", "e", closed=True)
    copies = placed.groupBy("s", "e").agg(F.countDistinct("__bucket").alias("n"), F.countDistinct("__size").alias("sizes")).collect()
    assert len(copies) == len(set(held)) and max(r["n"] for r in copies) == 2 and {r["sizes"] for r in copies} == {1}
    assert placed.select("__size").distinct().count() > 5


def test_lookup_in_a_crowd_of_overlaps(spark):
    """Many long intervals that start almost at once, and one that reaches over all times."""
    held = spark.range(12_000).selectExpr(
        "1L AS k", "timestampadd(MICROSECOND, id, timestamp_ntz'2024-01-01') AS s", "timestampadd(MICROSECOND, id, timestamp_ntz'2024-01-04') AS e",
        "cast(id AS double) AS w")
    ages = spark.sql("SELECT 1L AS k, timestamp_ntz'0001-01-01' AS s, timestamp_ntz'9999-12-31' AS e, -1.0D AS w")
    points = spark.sql("SELECT 1L AS k, timestamp_ntz'2024-01-02' AS t UNION ALL SELECT 1L, timestamp_ntz'2031-01-01' UNION ALL SELECT 2L, timestamp_ntz'2031-01-01'")
    out = intervals.attach_interval_value(points, held.unionByName(ages), ["k"], "t", "s", "e", "w")
    found = {(r["k"], r["t"].year): r["n"] for r in out.groupBy("k", "t").agg(F.count("w").alias("n")).collect()}
    assert found == {(1, 2024): 12_001, (1, 2031): 1, (2, 2031): 0}


def test_closed_window_holds_both_ends(frame, rows):
    points = frame("k bigint, t timestamp_ntz", [(1, at(0)), (1, at(1440)), (1, at(1441))])
    windows = frame(DDL, [(1, at(0), at(1440))])
    out = intervals.interval_join(points, windows, ["k"], "t", "s", "e", "inner", closed=True)
    assert rows(out, "t") == [(at(0),), (at(1440),)]


@pytest.mark.parametrize("max_rows", [3, 10**6])
def test_lead_intervals(frame, rows, max_rows):
    df = frame("k bigint, t timestamp_ntz, w double, until timestamp_ntz", [
        (1, at(10 * i), float(i), at(999)) for i in range(8)
    ] + [(1, at(70), 9.5, at(999))])
    out = intervals.lead_intervals(df, ["k"], "t", "w", "until", max_rows)
    expected = [(1, at(10 * i), at(10 * i + 10), float(i)) for i in range(7)]
    assert rows(out) == sorted([*expected, (1, at(70), at(70), 7.0), (1, at(70), at(999), 9.5)])


def test_numbering_and_links(frame, rows):
    df = frame("k bigint, link bigint, s timestamp_ntz, e timestamp_ntz", [
        (1, 7, at(0), at(60)), (1, 7, at(30), at(90)), (1, 8, at(200), at(230)),
    ])
    linked = intervals.collapse_linked(df, ["k", "link"], "s", "e")
    assert rows(linked) == [(1, 7, at(0), at(90)), (1, 8, at(200), at(230))]
    out = intervals.number_episodes(linked, ["k"], "s", "e", "n")
    assert rows(out, "n", "duration_hours") == [(1, 1.5), (2, 0.5)]
