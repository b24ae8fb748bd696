"""Removal of repeated byte strings by interval expansion on Burrows-Wheeler transforms.

A byte goes if it is covered by a string of ``length`` bytes (``LENGTH`` by default; grams are five eighths of it) that also starts anywhere else in the collection, the same text included.
Strings never cross texts, overlaps count, and all strings are judged on the input.

Dealing out. The key of a window (of ``length`` bytes) is the smallest hash of its ``gram``-byte strings, so equal windows have equal keys.
Consecutive windows mostly share their key; such a run of windows is one entry (key, text, start, count, digest of its bytes).
Entries are dealt by key to fragments, which hold a bounded number of entries at any size of the input. There

* runs with equal bytes are repeats at once, which settles copies of passages, however many, without moving text;
* keys with several different runs (the places where copies begin to differ) need their text.

The transform. The distinct texts of such runs are fetched, once each, and gathered by key into shards of bounded size. Each shard
sorts the suffixes of its texts to a depth of ``length`` and derives the longest common prefixes of neighbours from the transform:
breadth-first backward extension over intervals finds the boundaries with common prefix 0, 1, 2, ... and stops at ``length``, so
only boundaries between suffixes that share that much remain open. A window at such a boundary is a repeat.

A key with more than ``CROWD`` different runs (a passage in a great many texts) is too large for one shard; its windows are
dealt by digest and counted there instead, exactly as well.

Texts are identified by a 128-bit digest of their bytes, so repeated rows, null or repeated ids and clashing names do no harm. Null texts
are empty; texts shorter than ``length`` bytes keep all bytes. Where a cut leaves part of a character, the digest holds its
bytes and the text leaves them out. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, free_name, shuffle_partitions, table, text_or_empty

LENGTH = 400
GRAM = 250
#: Entries in a fragment (about), bytes of text in a shard (about), different runs of a key that a shard still takes.
FRAGMENT = 200_000
SHARD_BYTES = 2_000_000
CROWD = 1_000
PIECE_BYTES = 1 << 18
#: Bytes of text in an Arrow batch (about): a batch is held by the executor and, copied, by its worker.
BATCH_BYTES = 4_000_000
MAX_RUN = 255

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if _POWERS.get("n", 0) < n:
        size = max(n, 4 * PIECE_BYTES)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of ``data``: position-free sums of byte weights times powers."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size)) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, text number, start within the text, windows, digest, whether the run may repeat itself) of the runs of all texts."""
    none = np.zeros(0, np.int64)
    first = np.concatenate([[0], ends[:-1]])
    n = len(data) - length + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64), none.astype(bool)
    rolling = Rolling(data)
    grams = rolling.windows(gram)
    key = sliding_min(grams, length - gram + 1)  # by start of the window
    text = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))[:n]
    fits = np.arange(n) + length <= ends[text]
    begin = np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])]) & fits
    begin = np.flatnonzero(begin)
    last = np.flatnonzero(fits & np.concatenate([(key[1:] != key[:-1]) | (text[1:] != text[:-1]) | ~fits[1:], [True]])) + 1
    size = last - begin
    if len(size) and size.max() > MAX_RUN:  # periodic texts
        pieces = -(-size // MAX_RUN)
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(begin, pieces) + step * MAX_RUN
        size = np.minimum(np.repeat(last, pieces) - start, MAX_RUN)
        begin = start
    own = text[begin]
    within = np.zeros(len(begin), bool)
    for t in np.unique(own).tolist():
        part = grams[first[t] : max(first[t], ends[t] - gram + 1)]
        ordered = np.sort(part)
        if (ordered[1:] == ordered[:-1]).any():  # the text repeats a gram: look which runs hold their smallest gram twice
            for r in np.flatnonzero(own == t).tolist():
                region = grams[begin[r] : begin[r] + size[r] + length - gram]
                within[r] = np.count_nonzero(region == key[begin[r]]) > 1
    return key[begin], own, begin - first[own], size, rolling.of(begin, begin + size - 1 + length), within


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, ends) of neighbouring texts of about ``PIECE_BYTES`` in all."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(column):
        stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + PIECE_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        yield begin, data[offsets[begin] : offsets[stop]], offsets[begin + 1 : stop + 1] - offsets[begin]
        begin = stop


ENTRY = np.dtype([("key", "<u8"), ("digest", "<u8"), ("text", "V16"), ("start", "<u4"), ("size", "u1"), ("self", "u1")])
ENTRIES = "fragment bigint, entries binary"


def _deal(rows: np.ndarray, by: np.ndarray, n_fragments: int) -> pa.RecordBatch:
    """Rows packed by the fragment that the number ``by`` falls into (evenly spread numbers; keys, as minima, are mixed first)."""
    fragment = ((by >> np.uint64(32)) * np.uint64(n_fragments)) >> np.uint64(32)
    order = np.argsort(fragment, kind="stable")
    rows, fragment = rows[order], fragment[order]
    bounds = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1], [True]])) if len(rows) else np.zeros(1, np.int64)
    packed = [rows[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(fragment[bounds[:-1]].astype(np.int64), pa.int64()), pa.array(packed, pa.binary())], ["fragment", "entries"])


def _entries(n_fragments: int, length: int, gram: int):
    """Batches of (digest of the text, text) to packed entries."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.frombuffer(b"".join(batch.column(0).to_pylist()), "V16")
            found, size = [], 0
            for number, data, ends in _pieces(batch.column(1)):
                key, own, start, count, digest, within = runs_of(data, ends, length, gram)
                rows = np.empty(len(key), ENTRY)
                rows["key"], rows["digest"], rows["text"], rows["start"], rows["size"], rows["self"] = key, digest, names[number + own], start, count, within
                found.append(rows)
                size += len(rows)
                if size > 250_000:
                    yield _deal(all_ := np.concatenate(found), _mix(all_["key"]), n_fragments)
                    found, size = [], 0
            if size:
                yield _deal(all_ := np.concatenate(found), _mix(all_["key"]), n_fragments)

    return make


MARKS = "text binary, starts array<int>, sizes array<int>"
#: kind: 0 settled repeats, 1 texts for a shard, 2 texts of a crowded key
FOUND = "kind int, text binary, starts array<int>, sizes array<int>, keys array<bigint>, digests array<bigint>, known array<boolean>"


def _unpack(group: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column("entries")])


def _by_text(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in the order of their texts, first row of each text and the end)."""
    pair = rows["text"].view([("a", "<u8"), ("b", "<u8")]) if rows["text"].flags["C_CONTIGUOUS"] else np.ascontiguousarray(rows["text"]).view([("a", "<u8"), ("b", "<u8")])
    order = np.lexsort((rows["start"], pair["b"], pair["a"]))
    rows, pair = rows[order], pair[order]
    new = np.concatenate([[True], pair[1:] != pair[:-1]]) if len(rows) else np.zeros(0, bool)
    return rows, np.append(np.flatnonzero(new), len(rows))


def _lists(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))


def _settle(group: pa.Table) -> pa.Table:
    """A fragment's entries: runs that are repeats, and runs whose text is needed."""
    rows = _unpack(group, ENTRY)
    rows = rows[np.lexsort((rows["digest"], rows["key"]))]
    new_key = np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]])
    new_run = new_key | np.concatenate([[True], rows["digest"][1:] != rows["digest"][:-1]])
    run, key = np.cumsum(new_run) - 1, np.cumsum(new_key) - 1
    times = np.bincount(run)
    kinds = np.bincount(key[new_run])  # different runs of each key
    alone = np.zeros(len(kinds), np.int64)
    np.add.at(alone, key, rows["self"])
    repeat = times[run] > 1
    wanted = new_run & ((kinds[key] > 1) | (alone[key] > 0))
    crowded = kinds[key] > CROWD
    tables = []
    for kind, chosen in ((0, repeat), (1, wanted & ~crowded), (2, wanted & crowded)):
        mine, known = rows[chosen], repeat[chosen]
        pair = np.ascontiguousarray(mine["text"]).view([("a", "<u8"), ("b", "<u8")])
        order = np.lexsort((mine["start"], pair["b"], pair["a"]))
        mine, known, pair = mine[order], known[order], pair[order]
        if kind == 0 and len(mine):  # copies of a text come once each; one mark does for all of them
            fresh = np.concatenate([[True], (pair[1:] != pair[:-1]) | (mine["start"][1:] != mine["start"][:-1])])
            mine, known, pair = mine[fresh], known[fresh], pair[fresh]
        bounds = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1], [True]])) if len(mine) else np.zeros(1, np.int64)
        names = [x.tobytes() for x in mine["text"][bounds[:-1]]]
        empty = np.zeros(len(bounds), np.int32)
        texts_needed = kind > 0
        tables.append(
            pa.Table.from_arrays(
                [
                    pa.array(np.full(len(names), kind, np.int32)),
                    pa.array(names, pa.binary()),
                    _lists(mine["start"].astype(np.int32), bounds, pa.int32()),
                    _lists(mine["size"].astype(np.int32), bounds, pa.int32()),
                    _lists(mine["key"].view(np.int64) if texts_needed else empty[:0].astype(np.int64), bounds if texts_needed else empty, pa.int64()),
                    _lists(mine["digest"].view(np.int64) if texts_needed else empty[:0].astype(np.int64), bounds if texts_needed else empty, pa.int64()),
                    _lists(known if texts_needed else np.zeros(0, bool), bounds if texts_needed else empty, pa.bool_()),
                ],
                names=["kind", "text", "starts", "sizes", "keys", "digests", "known"],
            )
        )
    return pa.concat_tables(tables)


# -- the transform


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least (equal ones by place); symbols are below 512, 0 ends a text."""
    n = len(symbols)
    packed = np.zeros(n, np.int64)
    for k in range(7):
        packed <<= 9
        packed[: max(0, n - k)] |= symbols[k:]
    reach = 7

    def ranks(values, order):
        ordered = values[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        return rank

    order = np.argsort(packed, kind="stable")
    rank = ranks(packed, order)
    while reach < depth and rank[order[-1]] < n - 1:
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - reach)] = rank[reach:] + 1
        value = rank * (n + 1) + follow
        order = np.argsort(value, kind="stable")
        rank = ranks(value, order)
        reach *= 2
    return order


def open_boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the common prefix of the suffixes ``order[i - 1]`` and ``order[i]`` has at least ``length`` symbols.

    Intervals of suffixes that begin with one string are extended to the left by the symbols of the transform. The first string whose
    interval ends at a boundary is one symbol longer than the common prefix there; it is extended further, others are not. Strings
    hold no end sign but as their last symbol. The work is one step per boundary below ``length``.
    """
    n = len(symbols)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1
    sign = np.where(before >= 0, symbols[before], 0)  # the transform
    to = place[before]  # where the extended suffix stands; of no use where the sign is 0
    unset = np.ones(n + 1, bool)
    unset[0] = unset[n] = False
    counts = np.bincount(symbols, minlength=512)
    stops = np.cumsum(counts)
    starts = stops - counts
    # strings of one symbol
    have = counts > 0
    low, high = starts[have], stops[have]
    for _ in range(length):
        fresh = unset[high] | (high == n)
        unset[high] = False
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        width = high - low
        single = width == 1
        one = low[single]
        one = one[sign[one] != 0]
        next_low, next_high = [to[one]], [to[one] + 1]
        low, width = low[~single], width[~single]
        if len(low):
            owner = np.repeat(np.arange(len(low)), width)
            at = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            used = sign[at] != 0
            owner, target = owner[used], to[at[used]]
            if len(target):
                in_order = np.argsort(target)
                owner, target = owner[in_order], target[in_order]
                s = symbols[order[target]]
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (s[1:] != s[:-1])])
                begin = np.flatnonzero(new)
                next_low.append(target[begin])
                next_high.append(target[np.append(begin[1:], len(target)) - 1] + 1)
        low, high = np.concatenate(next_low), np.concatenate(next_high)
    return unset[:n]


def repeated_starts(texts: list[np.ndarray], sizes: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each text, whether the string of ``length`` at each of its first ``sizes`` places also starts elsewhere in the texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1)
    symbols = np.zeros(int(ends[-1]), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends - 1] = False
    symbols[inside] = np.concatenate(texts).astype(np.int64) + 1
    order = suffix_order(symbols, length)
    touching = open_boundaries(symbols, order, length)
    repeat = np.empty(len(symbols), bool)
    repeat[order] = touching | np.append(touching[1:], False)
    return [repeat[e - m - 1 : e - m - 1 + k] for e, m, k in zip(ends.tolist(), lengths.tolist(), sizes.tolist())]


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2] - edges[::2]


def _expand(group: pa.Table, length: int) -> pa.Table:
    """Repeats among the texts of a shard, for the runs that are not settled yet."""
    order = np.lexsort((group.column("digest").to_numpy(), group.column("key").to_numpy()))
    group = group.take(pa.array(order))
    key, digest = group.column("key").to_numpy(), group.column("digest").to_numpy()
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])])
    group = group.take(pa.array(np.flatnonzero(fresh)))
    texts = [np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("bytes")]
    sizes, known, begin = group.column("size").to_numpy(), np.array(group.column("known").to_pylist(), bool), group.column("start").to_numpy()
    names, starts, counts = [], [], []
    if not known.all():
        for name, at, done, flags in zip(group.column("text").to_pylist(), begin.tolist(), known.tolist(), repeated_starts(texts, sizes, length)):
            if not done and flags.any():
                s, c = _stretches(flags)
                names.append(name)
                starts.append((s + at).tolist())
                counts.append(c.tolist())
    return pa.Table.from_arrays([pa.array(names, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["text", "starts", "sizes"])


WINDOW = np.dtype([("digest", "<u8"), ("check", "<u8"), ("text", "V16"), ("start", "<u4")])


def _windows(n_fragments: int, length: int):
    """Batches of run texts to packed windows, dealt by digest."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            rows = zip(batch.column("text").to_pylist(), batch.column("start").to_pylist(), batch.column("size").to_pylist(), batch.column("bytes"))
            for name, start, size, data in rows:
                data = np.frombuffer(data.as_buffer(), np.uint8)
                windows = np.empty(size, WINDOW)
                windows["digest"] = Rolling(data).windows(length)
                windows["check"] = Rolling(data[::-1]).windows(length)[::-1]
                windows["text"] = np.frombuffer(name, "V16")[0]
                windows["start"] = start + np.arange(size)
                found.append(windows)
            if found:
                all_ = np.concatenate(found)
                yield _deal(all_, all_["digest"], n_fragments)

    return make


def _count_windows(group: pa.Table) -> pa.Table:
    rows = _unpack(group, WINDOW)
    rows = rows[np.lexsort((rows["check"], rows["digest"]))]
    same = (rows["digest"][1:] == rows["digest"][:-1]) & (rows["check"][1:] == rows["check"][:-1])
    rows = rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(rows) > 1 else rows[:0]
    rows, bounds = _by_text(rows) if len(rows) else (rows, np.zeros(1, np.int64))
    names = [x.tobytes() for x in rows["text"][bounds[:-1]]]
    ones = np.ones(len(rows), np.int32)
    return pa.Table.from_arrays([pa.array(names, pa.binary()), _lists(rows["start"].astype(np.int32), bounds, pa.int32()), _lists(ones, bounds, pa.int32())], names=["text", "starts", "sizes"])


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs inside; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_name(text: Column) -> Column:
    """The 128-bit digest that stands for a text."""
    return F.unhex(F.md5(text))


def repeat_marks(docs: DataFrame, scratch: Scratch, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``text`` (digest), ``starts``, ``sizes``: per text the runs of places where a repeated string starts."""
    spark, gram = docs.sparkSession, GRAM * length // LENGTH
    read = docs.select(text_or_empty(text).alias("t")).filter(F.octet_length("t") >= length)
    read = read.select(text_name(F.col("t")).alias("text"), F.col("t").cast("binary").alias("bytes"))
    size = F.octet_length(F.col(text))
    total, long, n_long = docs.agg(F.sum(size), F.sum(F.when(size >= length, size)), F.count(F.when(size >= length, 1))).first()
    total = total or 0
    batch_rows = max(1, BATCH_BYTES * n_long // (long or 1))
    expected = 2 * total / (length - gram + 2)
    n_fragments = max(shuffle_partitions(spark), math.ceil(expected / FRAGMENT))
    found = read.mapInArrow(_entries(n_fragments, length, gram), ENTRIES).groupBy("fragment").applyInArrow(_settle, FOUND)
    with batches_of(spark, batch_rows):
        found = scratch.keep(found, "found")
    settled = found.filter("kind = 0").select("text", "starts", "sizes")

    needed = found.filter("kind > 0")
    asked = needed.groupBy("text").agg(
        F.flatten(F.collect_list(F.arrays_zip(F.transform("keys", lambda k: F.col("kind")).alias("kind"), "starts", "sizes", "keys", "digests", "known"))).alias("runs")
    )
    fields = "text binary, kind int, start int, size int, key bigint, digest bigint, known boolean, bytes binary"

    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in fields.split(", ")])

        for batch in batches:
            columns = [[] for _ in kinds]
            for name, runs, data in zip(batch.column("text"), batch.column("runs"), batch.column("bytes")):
                name, data = name.as_py(), data.as_py()
                for r in runs.as_py():
                    row = (name, r["kind"], r["starts"], r["sizes"], r["keys"], r["digests"], r["known"], data[r["starts"] : r["starts"] + r["sizes"] - 1 + length])
                    for column, value in zip(columns, row):
                        column.append(value)
                if len(columns[0]) >= 20_000:
                    yield made()
                    columns = [[] for _ in kinds]
            yield made()

    once = read.join(needed.select("text"), "text", "left_semi").dropDuplicates(["text"])
    with batches_of(spark, batch_rows):
        texts = scratch.keep(once.join(asked, "text").mapInArrow(cut, fields), "texts")
    volume, windows = texts.agg(F.sum(F.when(F.col("kind") == 1, F.octet_length("bytes"))), F.sum(F.when(F.col("kind") == 2, F.col("size")))).first()
    shards = max(min(shuffle_partitions(spark), math.ceil((volume or 0) / 100_000)), math.ceil((volume or 0) / SHARD_BYTES), 1)
    expanded = texts.filter("kind = 1").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInArrow(lambda group: _expand(group, length), MARKS)
    marks = settled.unionByName(expanded)
    if windows:
        n = max(shuffle_partitions(spark), math.ceil(windows / FRAGMENT))
        counted = texts.filter("kind = 2").select("text", "start", "size", "bytes").mapInArrow(_windows(n, length), ENTRIES).groupBy("fragment").applyInArrow(_count_windows, MARKS)
        marks = marks.unionByName(counted)
    joined = marks.groupBy("text").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("sizes")).alias("sizes"))
    return scratch.keep(joined, "marks")


def kept_bytes(data: bytes, starts, sizes, length: int = LENGTH) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs) for runs of places where repeated strings start."""
    if starts is None or not len(starts):
        return data, 0, 0
    begin = np.asarray(starts, np.int64)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + np.asarray(sizes, np.int64) - 1 + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(np.count_nonzero(gone)), spans


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of the batch, with about ``BATCH_BYTES`` in a column of texts; an empty batch stays."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(batch):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + BATCH_BYTES, "right")))
        yield batch.slice(begin, stop - begin)
        begin = stop
    if not len(batch):
        yield batch


def remove_repeats(docs: DataFrame, scratch: Scratch, text: str = "text", digest: bool = False, length: int = LENGTH) -> DataFrame:
    """``docs`` with the bytes of repeated strings of ``length`` bytes taken out of its text.

    With ``digest`` come ``n_bytes, n_removed, n_spans, kept_sha256`` (underscores are added to taken names) before the text.
    """
    marks = repeat_marks(docs, scratch, text, length)
    own = [c for c in docs.columns if c != text]
    names = {c: free_name(c, docs.columns) for c in ("text_name", "mark_starts", "mark_sizes", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
    name, starts, sizes = names["text_name"], names["mark_starts"], names["mark_sizes"]
    named = docs.withColumn(text, text_or_empty(text)).withColumn(name, text_name(F.col(text)))
    joined = named.join(marks.withColumnsRenamed({"text": name, "starts": starts, "sizes": sizes}), name, "left")
    out_names = [*([names[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")] if digest else []), text]
    kinds = [*(["long", "long", "long", "string"] if digest else []), "string"]
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema
    for c, k in zip(out_names, kinds):
        schema = schema.add(c, k)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(own)
        for batch in (part for whole in batches for part in sliced(whole, at)):
            texts = batch.column(at).to_pylist()
            rows = []
            for data, s, c in zip(texts, batch.column(at + 1), batch.column(at + 2)):
                data = data.encode()
                kept, removed, spans = kept_bytes(data, s.values.to_numpy() if s.is_valid else None, c.values.to_numpy() if c.is_valid else None, length)
                figures = (len(data), removed, spans, hashlib.sha256(kept).hexdigest()) if digest else ()
                rows.append((*figures, kept.decode("utf-8", "ignore")))
            columns = zip(*rows) if rows else [()] * len(out_names)
            kinds_ = ([pa.int64()] * 3 + [pa.string()] if digest else []) + [pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *[pa.array(c, k) for c, k in zip(columns, kinds_)]], [*own, *out_names])

    rewritten = joined.select(*[F.col(f"`{c}`") for c in own], text, starts, sizes).mapInArrow(rewrite, schema)
    return rewritten if digest else rewritten.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_suffix_dedup(spark, folder):
    return remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), Scratch(spark), digest=True)
