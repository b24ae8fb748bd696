"""Heavy keys give the same answers as plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from bedside.functions.time import order_micros
from bedside.operators import pieces


@pytest.fixture
def skewed(frame):
    """One key holds a third of the rows, clustered at one end; one key is null."""
    rng = random.Random(7)
    rows = []
    for i in range(900):
        key = 1 if i < 300 else rng.choice([2, 3, 4, None])
        x = int(rng.expovariate(1 / 50)) * 10 if key == 1 else rng.randrange(2000)
        rows.append((i, key, x, round(rng.uniform(-5, 5), 2)))
    return rows, frame("id bigint, k int, x bigint, v double", rows)


def _by_key(rows):
    groups = {}
    for i, k, x, v in rows:
        groups.setdefault(k, []).append((x, i, v))
    return {k: sorted(g) for k, g in groups.items()}


@pytest.mark.parametrize("max_rows", [10, 10**6])
def test_row_number(skewed, max_rows):
    rows, df = skewed
    out = pieces.add_row_number(df, ["k"], "x", ["id"], "rn", max_rows)
    assert out.columns == [*df.columns, "rn"]
    expected = {i: n for g in _by_key(rows).values() for n, (_, i, _) in enumerate(g, 1)}
    assert {r["id"]: r["rn"] for r in out.collect()} == expected


@pytest.mark.parametrize("max_rows", [25, 10**6])
def test_global_row_number(skewed, max_rows):
    rows, df = skewed
    out = pieces.add_row_number(df, [], "x", ["id"], "rn", max_rows)
    expected = {i: n for n, (_, i) in enumerate(sorted((x, i) for i, _, x, _ in rows), 1)}
    assert {r["id"]: r["rn"] for r in out.collect()} == expected


@pytest.mark.parametrize("max_rows", [10, 10**6])
def test_neighbours(skewed, max_rows):
    rows, df = skewed
    nxt = pieces.add_next(df, ["k"], "x", {"other": "id"}, ["id"], max_rows)
    prv = pieces.add_previous(df, ["k"], "x", {"other": "id"}, ["id"], max_rows)
    after, ahead = {}, {}
    for g in _by_key(rows).values():
        ids = [i for _, i, _ in g]
        after.update(zip(ids, [*ids[1:], None]))
        ahead.update(zip(ids, [None, *ids[:-1]]))
    assert {r["id"]: r["other"] for r in nxt.collect()} == after
    assert {r["id"]: r["other"] for r in prv.collect()} == ahead


@pytest.mark.parametrize("max_rows", [10, 10**6])
def test_running_sums(frame, max_rows):
    rows = [(k, x, (x * 7 + k) % 11) for k in (1, 2) for x in range(0, 200 if k == 1 else 5)]
    out = pieces.add_running_sums(frame("k int, x bigint, v bigint", rows), ["k"], "x", {"total": "v"}, max_rows)
    for k in (1, 2):
        total, expected = 0, []
        for _, x, v in sorted(r for r in rows if r[0] == k):
            total += v
            expected.append((x, total))
        assert sorted((r["x"], r["total"]) for r in out.filter(f"k = {k}").collect()) == expected


def test_pieces_are_bounded(skewed):
    """Clustered values are cut twice, so pieces stay near the limit unless values tie."""
    _, df = skewed
    cut = pieces.cut_rows(df.filter("k = 1"), ["k"], "x", 40)
    sizes = [r["count"] for r in cut.rows.groupBy(pieces.PIECE).count().collect()]
    assert cut.cut and sum(sizes) == 300 and max(sizes) <= 80


def test_plain_plan_without_heavy_keys(skewed):
    _, df = skewed
    assert not pieces.cut_rows(df, ["k"], "x", 1000).cut


def test_heavy_plan_spreads_by_piece(skewed):
    _, df = skewed
    plan = pieces.add_row_number(df, ["k"], "x", ["id"], "rn", 10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k#" in plan and f"{pieces.PIECE}#" in plan and "Cartesian" not in plan


@pytest.mark.parametrize("order", ["d", "t"])
def test_cut_and_plain_agree_on_hostile_order_values(frame, order):
    """Unknown, infinite and undefined order values, ties and outliers give the same rows whether a key is cut or not."""
    from datetime import datetime, timedelta

    inf = float("inf")
    numbers = [None, None, None, None, -inf, -inf, -1e300, 0.0, 0.0, 0.5, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0, 1e300, inf, inf, float("nan"), float("nan")]
    times = [None if x is None or x != x else datetime(1, 1, 1) if x < -1 else datetime(9999, 1, 1) if x > 9 else datetime(2024, 1, 1) + timedelta(hours=x) for x in numbers]
    df = frame("k bigint, d double, t timestamp_ntz, v bigint", [(1, d, t, i) for i, (d, t) in enumerate(zip(numbers, times))] + [(2, 1.0, None, 99), (None, 1.0, None, 98)])
    place = F.col("d") if order == "d" else order_micros("t")

    def result(limit):
        out = df.withColumn("o", place)
        out = pieces.add_row_number(out, ["k"], "o", ["v"], "n", limit)
        out = pieces.add_previous(out, ["k"], "o", {"p": "v"}, ["v"], limit)
        out = pieces.add_next(out, ["k"], "o", {"f": "v"}, ["v"], limit)
        return sorted(map(str, (tuple(r[c] for c in ("k", "v", "n", "p", "f")) for r in out.collect())))

    assert result(3) == result(10**6)


@pytest.mark.parametrize("crowd", ["tied", "null", "infinite", "undefined", "nested"])
def test_crowds_of_one_order_value_are_cut_along_the_tie_break(frame, crowd):
    """A thousand rows that an order value does not tell apart leave no piece above twice the limit."""
    value = {"tied": 5.0, "null": None, "infinite": float("inf"), "undefined": float("nan")}
    # nested: ever closer crowds, so that equal widths would leave nearly all rows in one piece
    orders = [2.0 ** -(i // 25) for i in range(1000)] if crowd == "nested" else [value[crowd]] * 1000
    rows = [(1, x, i) for i, x in enumerate(orders)] + [(1, float(i), 1000 + i) for i in range(-20, 20)] + [(2, 1.0, -1)]
    df = frame("k int, x double, id bigint", rows).repartition(4)
    cut = pieces.cut_rows(df, ["k"], "x", 10, ties=["id"])
    sizes = [r["count"] for r in cut.rows.filter("k = 1").groupBy(pieces.PIECE).count().collect()]
    assert cut.cut and sum(sizes) == 1040 and max(sizes) <= 20

    def result(limit):
        out = pieces.add_row_number(df, ["k"], "x", ["id"], "n", limit)
        out = pieces.add_previous(out, ["k"], "x", {"p": "id"}, ["id"], limit)
        return sorted(map(str, out.select("k", "id", "n", "p").collect()))

    assert result(10) == result(None)


def test_texts_and_times_as_tie_break(frame):
    rows = [(1, 3, None if i % 50 == 0 else f"w{i:04d}", f"2024-01-01T00:{i % 60:02d}:00") for i in range(600)]
    df = frame("k int, x int, s string, t timestamp_ntz", rows)
    cut = pieces.cut_rows(df, ["k"], "x", 20, ties=["s", "t"])
    sizes = [r["count"] for r in cut.rows.groupBy(pieces.PIECE).count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 40
    wide = pieces.add_row_number(df, ["k"], "x", ["s", "t"], "n", 20)
    assert sorted(r["n"] for r in wide.collect()) == list(range(1, 601))


def test_rows_of_one_place_stay_together(frame):
    df = frame("k int, x int", [(1, 7)] * 100)
    assert not pieces.cut_rows(df, ["k"], "x", 10).cut
    df = frame("k int, x int", [(1, 7)] * 100 + [(1, i) for i in range(100)])
    cut = pieces.cut_rows(df, ["k"], "x", 10)
    sizes = sorted(r["count"] for r in cut.rows.groupBy(pieces.PIECE).count().collect())
    assert sum(sizes) == 200 and sizes[-1] <= 120 and sizes[-2] <= 20
