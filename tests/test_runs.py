"""Dose runs against a plain scan that follows the rules one by one."""

import random
from datetime import datetime, timedelta

import pytest

from bedside.operators import runs

DDL = "k bigint, drug int, t timestamp_ntz, rate double, stopped int"
DAY = datetime(2024, 1, 1)


def scan(data):
    readings = {}
    for k, drug, t, rate, stopped in data:
        if k is None:
            continue
        old = readings.get((k, drug, t), (None, 0))
        best = rate if old[0] is None else old[0] if rate is None else max(old[0], rate)
        readings[k, drug, t] = (best, max(old[1], stopped))
    out = []
    for group in {(k, d) for k, d, _ in readings}:
        series = sorted((t, *v) for (k, d, t), v in readings.items() if (k, d) == group)
        episodes, run, seen = {}, None, []
        in_force = None
        for i, (t, rate, stopped) in enumerate(series):
            before = in_force
            earlier_known = any(r is not None for _, r, _ in series[:i])
            in_force = rate if rate is not None else before
            if rate is not None and rate > 0 and not earlier_known:
                flag = 1
            elif rate == 0 and before == 0:
                flag = 0
            elif in_force == 0 and before == 0:
                flag = 0
            elif before == 0:
                flag = 1
            elif i and series[i - 1][2] == 1:
                flag = 1
            else:
                flag = None
            if flag is not None:
                run = (run or 0) + flag
            ends = stopped == 1 or rate == 0 or i == len(series) - 1
            if run:
                episodes.setdefault(run, []).append((t, rate, ends))
        for number, part in episodes.items():
            start = min((t for t, r, _ in part if r is not None), default=None)
            end = min((t for t, _, e in part if e), default=None)
            peak = max((r for _, r, _ in part if r is not None), default=0)
            if end is not None and part[0][0] != end and peak > 0:
                out.append((*group, number, start, end))
    return sorted(out)


def result(df, max_rows):
    return sorted(tuple(r) for r in runs.dose_runs(df, ["k", "drug"], "t", "rate", "stopped", max_rows).collect())


def series(*steps):
    return [(1, 1, DAY + timedelta(hours=i), rate, stopped) for i, (rate, stopped) in enumerate(steps)]


CASES = {
    "leading zeros": series((0.0, 0), (0.0, 0), (2.0, 0), (3.0, 0), (0.0, 0)),
    "null inside": series((2.0, 0), (None, 0), (None, 0), (0.0, 0), (0.0, 0)),
    "stop and restart": series((2.0, 0), (2.0, 1), (3.0, 0), (3.0, 0), (0.0, 0)),
    "only zero": series((0.0, 0), (0.0, 0), (0.0, 0)),
    "open end": series((1.0, 0), (1.0, 0), (1.0, 0)),
    "leading nulls": series((None, 0), (None, 1), (1.0, 0), (1.0, 0)),
    "single": series((1.0, 0)),
    "null after zero": series((1.0, 0), (0.0, 0), (None, 0), (2.0, 0), (2.0, 0)),
}


@pytest.mark.parametrize("max_rows", [2, 10**6])
@pytest.mark.parametrize("name", CASES)
def test_cases(frame, name, max_rows):
    assert result(frame(DDL, CASES[name]), max_rows) == scan(CASES[name])


@pytest.mark.parametrize("max_rows", [12, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_random(frame, seed, max_rows):
    rng = random.Random(seed)
    data = []
    for _ in range(500):
        k = rng.choice([1, 1, 1, 2, 3, None])
        rate = rng.choice([None, 0.0, 0.0, 1.0, 2.5])
        data.append((k, rng.choice([7, 8]), DAY + timedelta(minutes=rng.randrange(900)), rate, int(rng.random() < 0.1)))
    expected = scan(data)
    assert len(expected) > 20 and result(frame(DDL, data), max_rows) == expected
