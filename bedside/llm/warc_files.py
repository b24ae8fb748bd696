"""WARC archives written in order by sharded tasks, the same bytes at every run, and read back with their digests checked.

Writing.

1. Digests. One pass keeps id, URL, size, SHA-1 and SHA-256 of every payload; rows equal in all of these are one record with a number of
   copies. Records of one SHA-256 are equal payloads: the one with the largest (id, URL) is the response, the others revisit it. Payloads
   shared by more than a thousandth of all records are a table of at most ``HOT`` rows, which is broadcast; the others are joined by digest.
2. Shards. A histogram of bytes over ranges of ids, refined where a range is too heavy, gives the borders of shards of about
   ``shard_bytes``: by sums over the data alone, so a rerun has the same ones. There are at most ``SHARDS``.
3. Files. Records travel to their shard once and are sorted by id there. A record's own row comes before its payload, so a task streams. Every record is
   a gzip member; a file rolls when its members reach ``file_bytes``. Headers are made anew: record id (from id, URL and digest), length, block and
   payload digests. Files are written under temporary names that no other attempt shares.
4. Commit. The names that Spark's successful attempts returned are the manifest. Its files are renamed, which a repeated task finds
   done, then the manifest is written. Readers open only what it lists, so a half-written archive does not exist for them.

Reading. Files are dealt to tasks and streamed record by record; a block or payload that does not meet its digest raises an error.

Null payloads are empty. Null ids come first and have no id header; null URLs have no target. Control characters and spaces of URLs
are percent-encoded in the header. A revisit of a response without an id refers to null. Repeated rows come back as often as they were. One id stays in one
shard. An empty table gives an archive without files and no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, shuffle_partitions, table

SHARD_BYTES = 16 << 20
FILE_BYTES = 4 << 20
#: Upper bounds of shards, of ranges in the histogram, and of payloads that are broadcast.
SHARDS = 1 << 16
RANGES = 1 << 18
HOT = 1 << 10
#: Records, and bytes of their payloads, in a batch.
ROWS = 1024
BYTES = 4 << 20
LOWEST = -(1 << 63)
DATE = "1970-01-01T00:00:00Z"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ESCAPES = {c: f"%{c:02X}" for c in [*range(33), 127]}
MANIFEST = "shard int, number int, temporary string, name string, records bigint, bytes bigint, sha256 string"
RECORD = "page_id bigint, url string, record_id string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """A name that depends on the record alone."""
    return str(uuid.UUID(bytes=hashlib.sha256(repr((page_id, url, digest)).encode()).digest()[:16], version=5))


# -- what each record will be


def records(pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """A row per different (id, URL, payload): ``page_id, url, digest, sha1, bytes, copies, first`` (the response it revisits, else null)."""
    seen = pages.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    each = scratch.keep(seen.groupBy("page_id", "url", "digest", "sha1", "bytes").agg(F.count("*").alias("copies")), "records")
    owner = F.struct("page_id", "url")  # nulls are smallest
    shared = each.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max(owner).alias("first")).filter("n > 1")
    shared = scratch.keep(shared, "shared")
    hot = F.col("n") * HOT > each.count()
    often, seldom = shared.filter(hot).drop("n"), shared.filter(~hot).drop("n")  # fewer than HOT rows in the one
    first = F.when(~F.col("first").eqNullSafe(owner), F.col("first")).alias("first")
    by_often = each.join(F.broadcast(often), "digest")
    by_seldom = each.join(F.broadcast(often), "digest", "left_anti").join(seldom, "digest", "left")
    # without a common payload there is no first one, which is not the same as one without id and URL
    return by_often.unionByName(by_seldom).select(*each.columns, F.when(F.col("first").isNotNull(), first).alias("first"))


def borders(sizes: DataFrame, shard_bytes: int) -> np.ndarray:
    """Smallest ids of the shards: ranges of ids that hold about ``shard_bytes`` each (columns ``page_id, bytes``)."""
    low, high, total = sizes.agg(F.min("page_id"), F.max("page_id"), F.sum("bytes")).first()
    if low is None:
        return np.array([LOWEST], np.int64)
    aim = max(shard_bytes, -(-total // SHARDS))
    edges = _split([(low, high + 1)], RANGES)
    while True:
        found = {r.range: r.bytes for r in _histogram(sizes, np.array([a for a, _ in edges], np.int64)).collect()}  # at most RANGES rows
        heavy = [i for i, (a, b) in enumerate(edges) if found.get(i, 0) > aim and b - a > 1]
        if not heavy:
            break
        # neighbours that are light together need no border between them, heavy ranges get new ones inside
        apart, before, spared = [], 0, set(heavy)
        for i, (a, b) in enumerate(edges):
            if i in spared:
                apart += _split([(a, b)], max(2, RANGES // (2 * len(heavy))))
                before = aim
            elif not apart or before + found.get(i, 0) > aim // 4:
                apart.append((a, b))
                before = found.get(i, 0)
            else:
                apart[-1] = (apart[-1][0], b)
                before += found.get(i, 0)
        edges = apart
    starts, shard, before = [LOWEST], 0, 0
    for i, (a, _) in enumerate(edges):
        if before // aim > shard:
            shard = before // aim
            starts.append(a)
        before += found.get(i, 0)
    return np.array(starts, np.int64)


def _split(ranges: list[tuple[int, int]], pieces: int) -> list[tuple[int, int]]:
    out = []
    for a, b in ranges:
        n = min(pieces, b - a)
        cuts = [a + (b - a) * i // n for i in range(n + 1)]
        out += list(zip(cuts[:-1], cuts[1:]))
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LOWEST).to_numpy(zero_copy_only=False)


def _histogram(sizes: DataFrame, starts: np.ndarray) -> DataFrame:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(starts), np.int64)
        for batch in batches:
            at = np.maximum(np.searchsorted(starts, _ids(batch.column("page_id")), "right") - 1, 0)
            np.add.at(held, at, batch.column("bytes").to_numpy())
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(held[there])], ["range", "bytes"])

    return sizes.select("page_id", "bytes").mapInArrow(add, "range int, bytes bigint").groupBy("range").agg(F.sum("bytes").alias("bytes"))


def _with_shard(rows: DataFrame, starts: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def shard(ids):
        found = np.searchsorted(starts, ids.fillna(LOWEST).astype("int64").to_numpy(), "right") - 1
        return type(ids)(found.astype("int32"))

    return rows.withColumn("shard", shard("page_id"))


# -- records as bytes


def block_of(payload: bytes | None, size: int) -> bytes:
    """An HTTP response with the payload, or its header alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return head + (payload or b"")


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member of its own, without a time in it."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}", "", ""]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(lines).encode()) + deflate.compress(block + b"\r\n\r\n") + deflate.flush()


def page_member(row: dict, payload: bytes, date: str) -> bytes:
    first, digest = row["first"], base32_digest(bytes.fromhex(row["sha1"]))
    block = block_of(None if first else payload, row["bytes"])
    headers = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{record_id(row['page_id'], row['url'], row['digest'])}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _target(row["url"])),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{base32_digest(hashlib.sha1(block).digest())}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", row["page_id"]),
        ("X-Copies", row["copies"] if row["copies"] > 1 else None),
    ]
    if first:
        headers += [
            ("WARC-Profile", SAME),
            ("WARC-Refers-To", f"<urn:uuid:{record_id(first['page_id'], first['url'], row['digest'])}>"),
            ("WARC-Refers-To-Target-URI", _target(first["url"])),
            ("X-Refers-To-Page-Id", first["page_id"]),
        ]
    return member(headers, block)


def _target(url: str | None) -> str | None:
    return None if url is None else url.translate(ESCAPES)


# -- files


def file_system(uri: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


@dataclass
class _File:
    """Members of a file that is still growing."""

    shard: int
    number: int
    records: int = 0
    size: int = 0
    members: list[bytes] = field(default_factory=list)

    def add(self, data: bytes) -> None:
        self.members.append(data)
        self.size += len(data)
        self.records += 1

    @property
    def name(self) -> str:
        return f"part-{self.shard:06d}-{self.number:06d}.warc.gz"

    def write(self, folder: str, date: str) -> tuple:
        system, base = file_system(folder)
        temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
        info = f"software: bedside\r\nformat: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
        name = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{record_id(None, self.name, '')}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
        data = b"".join([member(name, info), *self.members])
        system.create_dir(f"{base}/_temporary", recursive=True)
        with system.open_output_stream(f"{base}/{temporary}", compression=None) as out:
            out.write(data)
        return self.shard, self.number, temporary, self.name, self.records, len(data), hashlib.sha256(data).hexdigest()


def _writer(folder: str, file_bytes: int, date: str):
    """Sorted rows (a record's own row before its payload) to files; one row per file."""

    def sorted_rows(batches):
        for batch in batches:
            names = ["shard", "page_id", "url", "digest", "sha1", "bytes", "copies", "first", "payload"]
            columns = [batch.column(n) for n in names]
            for i in range(batch.num_rows):
                yield dict(zip(names, (c[i].as_py() for c in columns)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = [c.split()[0] for c in MANIFEST.split(", ")]

        def row(done: _File) -> pa.RecordBatch:
            values = done.write(folder, date)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for shard, rows in groupby(sorted_rows(batches), key=lambda r: r["shard"]):
            growing, record = _File(shard, 0), None
            for r in rows:
                if r["copies"] is not None:
                    record = r
                elif record is not None:  # the first of its payload rows; further ones are copies
                    growing.add(page_member(record, r["payload"], date))
                    record = None
                    if growing.size >= file_bytes:
                        yield row(growing)
                        growing = _File(shard, growing.number + 1)
            if growing.records:
                yield row(growing)

    return write


def write_archive(
    pages: DataFrame,
    folder: str,
    scratch: Scratch,
    min_bytes: int = 0,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
    date: str = DATE,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> None:
    """Writes an archive of ``pages`` to ``folder`` (a place that all executors reach), with its manifest."""
    from pyarrow import fs

    payload = F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload)
    planned = scratch.keep(records(rows, scratch, min_bytes), "planned")
    starts = borders(planned.select("page_id", (F.col("bytes") + 1).alias("bytes")), shard_bytes)
    with_payload = rows.withColumn("digest", F.sha2("payload", 256))
    together = _with_shard(planned.unionByName(with_payload, allowMissingColumns=True), starts)
    order = ["shard", F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "digest", F.col("copies").asc_nulls_last()]
    dealt = together.repartition(2 * len(starts), "shard").sortWithinPartitions(*order)
    written = scratch.keep(dealt.mapInArrow(_writer(folder, file_bytes, date), MANIFEST), "written")
    done = scratch.keep(written.mapInArrow(_commit(folder), MANIFEST), "committed")
    done.drop("temporary").write.mode("overwrite").json(f"{folder.rstrip('/')}/manifest")
    scratch.drop("written", "committed")
    system, base = file_system(folder)
    if system.get_file_info(f"{base}/_temporary").type == fs.FileType.Directory:
        system.delete_dir(f"{base}/_temporary")  # what failed attempts left


def _commit(folder: str):
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = file_system(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist()):
                if system.get_file_info(f"{base}/{temporary}").type != fs.FileType.NotFound:
                    system.move(f"{base}/{temporary}", f"{base}/{name}")
                elif system.get_file_info(f"{base}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{temporary} and {name}")
            yield batch

    return rename


# -- reading


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('WARC-Record-ID')} is cut off")
        yield headers, block


def page_of(headers: dict[str, str], block: bytes) -> tuple[tuple, bytes, int]:
    """A record's values (see ``RECORD``), its payload, and how often it counts; digests are checked."""
    name = headers["WARC-Record-ID"]
    if headers["WARC-Block-Digest"] != f"sha1:{base32_digest(hashlib.sha1(block).digest())}":
        raise ValueError(f"block of {name} does not meet its digest")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")).split(b":")[1])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_digest(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of {name} does not meet its digest")
    number = lambda key: int(headers[key]) if key in headers else None
    values = number("X-Page-Id"), headers.get("WARC-Target-URI"), name[10:-1], kind, size, digest, number("X-Refers-To-Page-Id")
    return values, payload, number("X-Copies") or 1


def read_archive(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row per page of the archive (see ``RECORD``); with ``payloads`` also the stored payload, null for revisits."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]
    listed = MANIFEST.replace("temporary string, ", "")
    files = spark.read.schema(listed).json(f"{folder.rstrip('/')}/manifest").select("name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                held = 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parse(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        values, payload, copies = page_of(headers, block)
                        stored = (payload if values[3] == "response" else None,) if payloads else ()
                        for _ in range(copies):
                            rows.append(values + stored)
                            held += len(payload) if payloads else 0
                            if len(rows) == ROWS or held > BYTES:
                                yield batch_of()
                                rows.clear()
                                held = 0
        if rows:
            yield batch_of()

    return files.repartition(shuffle_partitions(spark), "name").mapInArrow(read, schema)


def op11_warc_files(spark, folder):
    scratch = Scratch(spark)
    path = scratch.path("warc")
    write_archive(table(spark, folder, "pages"), path, scratch)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "(strpos('0123456789abcdef', substr(hex, {0} + 1, 1)) - 1)"
_FIVE_BITS = f"((({_DIGIT.format('(5 * i) // 4')} * 16 + {_DIGIT.format('((5 * i) // 4 + 1)')}) >> (3 - (5 * i) % 4)) & 31)"

OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS hex FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_FIVE_BITS} AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM m
"""
