"""WARC archives: round trips, the same bytes again, roles of equal payloads, and damage that readers notice."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException

from bedside.llm import warc_files as w


@pytest.fixture
def pages(spark):
    def build(rows):
        return spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id bigint, url string, html string, shard int, digest string")

    return build


def brute(rows, min_bytes=0):
    best = {}
    for page, url, html in rows:
        key, owner = html or "", (page is not None, page or 0, url is not None, url or "")
        best[key] = max(best.get(key, owner), owner)
    out = []
    for page, url, html in rows:
        data = (html or "").encode()
        owner = (page is not None, page or 0, url is not None, url or "")
        first = best[html or ""]
        again = len(data) >= min_bytes and owner != first
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if again else "response", first[1] if again and first[0] else None))
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def hostile(n=120):
    rnd = random.Random(4)
    texts = ["", "a", "<p>ü \U0001f600</p>", "x" * 200_000, "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n"] + [f"<p>{rnd.random()}</p>" for _ in range(30)]
    rows = [(rnd.randrange(-50, 5000), f"http://h{rnd.randrange(3)}/{i}", rnd.choice(texts)) for i in range(n)]
    rows += [(None, None, "a"), (None, "u", "b"), (7, None, None), (7, "", ""), (8, "a b\r\nX-Page-Id: 9\x7fü", "a"), (2**62, "far", "a"), (-(2**62), "far", "far")]
    return rows + rows[:9] + [(5, "http://same", "same")] * 40


@pytest.mark.parametrize("shard_bytes, file_bytes", [(1, 1), (5_000, 1_000), (1 << 30, 1 << 30)])
def test_round_trip(spark, scratch, pages, shard_bytes, file_bytes):
    rows = hostile()
    folder = scratch.path("archive")
    w.write_archive(pages(rows), folder, scratch, shard_bytes=shard_bytes, file_bytes=file_bytes)
    got = w.read_archive(spark, folder, payloads=True)
    assert found(got) == brute(rows)
    stored = {(r.page_id, bytes(r.payload)) for r in got.collect() if r.record_type == "response"}
    assert stored <= {(p, (h or "").encode()) for p, _, h in rows}
    # each revisit names the record of a response with the same payload
    by_name = {r.record_id: r for r in got.collect()}
    for r in by_name.values():
        if r.record_type == "revisit" and r.refers_to is not None:
            assert any(o.page_id == r.refers_to and o.payload_digest == r.payload_digest and o.record_type == "response" for o in by_name.values())


def test_small_payloads_are_no_revisits(spark, scratch, pages):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "xyz"), (4, "d", "xyz"), (5, "e", None), (6, "f", "")]
    folder = scratch.path("archive")
    w.write_archive(pages(rows), folder, scratch, min_bytes=3)
    assert found(w.read_archive(spark, folder)) == brute(rows, 3)


def test_hot_payload_goes_by_broadcast_and_by_join(spark, scratch, pages, monkeypatch):
    rows = [(i, f"u{i}", "hot" if i % 3 else f"pair {i // 6}") for i in range(300)]
    for hot in (1, 1 << 10):
        monkeypatch.setattr(w, "HOT", hot)
        folder = scratch.path(f"archive{hot}")
        w.write_archive(pages(rows), folder, scratch)
        assert found(w.read_archive(spark, folder)) == brute(rows)


def files_of(folder):
    base = folder.removeprefix("file://")
    return {n: open(os.path.join(base, n), "rb").read() for n in sorted(os.listdir(base)) if n.endswith(".gz")}


def test_same_bytes_again_in_any_order(spark, scratch, pages):
    rows = hostile()
    first, second = scratch.path("one"), scratch.path("two")
    w.write_archive(pages(rows), first, scratch, shard_bytes=5_000, file_bytes=2_000)
    w.write_archive(pages(rows[::-1]).repartition(5), second, scratch, shard_bytes=5_000, file_bytes=2_000)
    a, b = files_of(first), files_of(second)
    assert a == b and len(a) > 3
    assert not os.path.exists(os.path.join(first.removeprefix("file://"), "_temporary"))
    # ids ascend over the files in the order of their names
    ids = [int(line.split(b": ")[1]) for data in a.values() for line in gzip.decompress(data).split(b"\r\n") if line.startswith(b"X-Page-Id: ")]
    assert [i for i in ids if i != 9] == sorted(i for i in ids if i != 9)
    manifest = [json.loads(r.value) for r in spark.read.text(f"{first}/manifest").collect()]
    assert {m["name"]: (m["bytes"], m["sha256"]) for m in manifest} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in a.items()}


def test_files_roll_by_compressed_size(spark, scratch, pages):
    rnd = random.Random(1)
    rows = [(i, f"u{i}", "".join(rnd.choices("abcdefghij", k=3000))) for i in range(200)]
    folder = scratch.path("archive")
    w.write_archive(pages(rows), folder, scratch, shard_bytes=1 << 30, file_bytes=50_000)
    sizes = [len(d) for d in files_of(folder).values()]
    assert len(sizes) > 4 and max(sizes) < 55_000 and sum(s > 45_000 for s in sizes) >= len(sizes) - 1


def test_unlisted_files_do_not_exist_and_repeated_commits_do(spark, scratch, pages):
    rows = [(i, f"u{i}", f"t{i}") for i in range(20)]
    folder = scratch.path("archive")
    w.write_archive(pages(rows), folder, scratch)
    base = folder.removeprefix("file://")
    open(os.path.join(base, "part-000009-000000.warc.gz"), "wb").write(b"half")
    assert found(w.read_archive(spark, folder)) == brute(rows)
    # a second attempt of the commit finds its files in place; one whose file is nowhere fails
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"temporary": ["_temporary/gone"], "name": ["part-000000-000000.warc.gz"]})
    assert list(w._commit(folder)(iter([batch]))) == [batch]
    lost = pa.RecordBatch.from_pydict({"temporary": ["_temporary/gone"], "name": ["nowhere"]})
    with pytest.raises(FileNotFoundError):
        list(w._commit(folder)(iter([lost])))


def test_damage_is_noticed(spark, scratch, pages):
    folder = scratch.path("archive")
    w.write_archive(pages([(1, "u", "payload one"), (2, "v", "payload two")]), folder, scratch)
    name, data = next(iter(files_of(folder).items()))
    plain = gzip.decompress(data).replace(b"payload one", b"payload 0ne")
    open(os.path.join(folder.removeprefix("file://"), name), "wb").write(gzip.compress(plain))
    with pytest.raises(PySparkException, match="does not meet its digest"):
        w.read_archive(spark, folder).collect()


def test_empty_table(spark, scratch, pages):
    folder = scratch.path("archive")
    w.write_archive(pages([]), folder, scratch)
    assert w.read_archive(spark, folder).collect() == []


def test_borders_split_heavy_ranges(spark):
    rows = [(i, 10) for i in range(1000)] + [(10**15 + i, 10) for i in range(1000)] + [(5, 5_000), (-(2**62), 1)]
    starts = w.borders(spark.createDataFrame(rows, "page_id bigint, bytes bigint"), 500)
    assert list(starts) == sorted(set(starts.tolist())) and starts[0] == w.LOWEST
    sizes = Counter()
    for i, b in rows:
        sizes[int(np.searchsorted(starts, i, "right"))] += b
    assert max(sizes.values()) <= 5_000 + 2 * 500 and len(starts) >= 30
    assert sum(v > 1_100 for v in sizes.values()) == 1
