"""Exact integer k-means over zone maps: vectors in Hilbert order, blocks with boxes, candidate centroids per block.

Components become integers, ``floor(scale * x)`` with x as double, and everything after that is integer arithmetic.

1. Order. Cells of a quarter standard deviation per dimension give each vector a key on a Hilbert curve through all dimensions.
   Rows are range-partitioned by (key, hash of the id), so that many equal vectors spread over partitions, and sorted by the key.
2. Zone maps. ``block`` neighbours in that order make one row of the block table: ids, vectors in the narrowest integer type,
   and the smallest and largest component per dimension. The table is written once to the shared folder.
3. Rounds. A block first compares its box with the centroids: a centroid is out if its smallest distance to the box is above the
   largest distance of another one, or if the difference of its distance and another's (linear over the box) is positive everywhere. Only what
   is left is compared with the vectors, by one matrix product; where one centroid is left, nothing is compared. A task adds up counts
   and sums of its blocks and gives them away once, Spark adds them per centroid and dimension, and the driver sees just these sums.

Matrix products over doubles are exact where all intermediate integers stay below 2^53; blocks beyond that take 64-bit integers, and
beyond 2^63 integers of any length. Sums travel as 60-bit limbs. So finite vectors of any size take part. Distances
and inertias that do not fit a long are null.

Rows take no part if the vector is null, has another number of components, or holds a null or non-finite component. A null id is an id as any
other and comes last among the first centroids. Repeated rows are vectors of their own. With fewer vectors than ``k`` there are fewer centroids;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, shuffle_partitions, table

#: Vectors in a block; bits of the Hilbert cell per dimension; bits of a limb of a sum.
BLOCK = 256
BITS = 4
LIMB = 60
LONG = 1 << 63
#: Rows of the sums that are no dimension.
COUNT, DISTANCE = -1, -2


@dataclass(frozen=True)
class Clusters:
    rows: DataFrame  # vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256
    centroids: list[tuple[int, ...]]
    rounds_run: int


def kept_vectors(vectors: DataFrame, dims: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``vec`` (array of double) of the rows that take part."""
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter((F.size(vector) == dims) & fine).select(F.col(vec_id).alias("vec_id"), x.alias("vec"))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit integers, or as Python integers where these do not fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
    if not scaled.size or np.abs(scaled).max() < 2.0**62:
        return scaled.astype(np.int64)
    exact = [math.floor(s) if math.isfinite(s) else int(v) * scale for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist())]
    return np.array(exact, dtype=object).reshape(x.shape)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of the rows of ``cells`` (each in ``[0, 2^bits)``), as rows of big-endian bytes."""
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of the coarser levels
        low = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).reshape(bits * dims, -1)
    return np.packbits(planes.T.astype(np.uint8), axis=1)


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def in_hilbert_order(kept: DataFrame, dims: int) -> DataFrame:
    """``kept`` with partitions that follow each other along the curve, each sorted."""
    spread = kept.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    spread = {r.d: (r.m, r.s) for r in spread.collect()}  # one row a dimension
    middle = np.array([spread.get(d, (0.0, 1.0))[0] for d in range(dims)])
    step = np.array([spread.get(d, (0.0, 1.0))[1] for d in range(dims)]) / (1 << (BITS - 2))
    middle, step = (np.where(np.isfinite(v), v, 0.0) for v in (middle, step))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(all="ignore"):
                place = np.floor((_matrix(batch.column("vec"), dims) - middle) / np.where(step > 0, step, 1.0))
            cells = np.clip(np.nan_to_num(place) + (1 << (BITS - 1)), 0, (1 << BITS) - 1)
            found = [row.tobytes() for row in hilbert_keys(cells, BITS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["vec_id", "vec", "key"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    keyed = kept.mapInArrow(keys, f"vec_id {kind}, vec array<double>, key binary")
    return keyed.repartitionByRange(shuffle_partitions(kept.sparkSession), "key", F.xxhash64("vec_id")).sortWithinPartitions("key")


def blocks(ordered: DataFrame, dims: int, scale: int, size: int = BLOCK) -> DataFrame:
    """The block table: ``ids, kind, vectors, low, high`` (components little-endian in the type ``kind``, or doubles before scaling)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def rows(final: bool) -> Iterator[pa.RecordBatch]:
            together = pa.Table.from_batches(waiting).combine_chunks()
            end = len(together) if final else len(together) // size * size
            ids, kinds, vectors, low, high = [], [], [], [], []
            for at in range(0, end, size):
                piece = together.slice(at, min(size, end - at)).combine_chunks()
                raw = _matrix(piece.column("vec").combine_chunks(), dims)
                x = whole(raw, scale)
                kind = "f8" if x.dtype == object else next(k for k in ("i1", "i2", "i4", "i8") if np.array_equal(x, x.astype(f"<{k}")))
                ids.append(piece.column("vec_id").combine_chunks())
                kinds.append(kind)
                stored = raw if kind == "f8" else x
                for to, values in ((vectors, stored), (low, stored.min(0)), (high, stored.max(0))):
                    to.append(values.astype(f"<{kind}").tobytes())
            waiting[:] = together.slice(end).to_batches() if end < len(together) else []
            if ids:
                cuts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), pa.concat_arrays(ids))
                columns = [lists, pa.array(kinds), *(pa.array(v, pa.binary()) for v in (vectors, low, high))]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "kind", "vectors", "low", "high"])

        for batch in batches:
            if batch.num_rows:
                waiting.append(batch.select(["vec_id", "vec"]))
                if sum(b.num_rows for b in waiting) >= 16 * size:
                    yield from rows(False)
        if waiting:
            yield from rows(True)

    kind = ordered.schema["vec_id"].dataType.simpleString()
    return ordered.mapInArrow(cut, f"ids array<{kind}>, kind string, vectors binary, low binary, high binary")


class Centroids:
    """Centroids, and exact answers about blocks."""

    def __init__(self, centroids: list[tuple[int, ...]]):
        self.exact = np.array(centroids, dtype=object).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        self.largest = max((abs(v) for c in centroids for v in c), default=0)
        self.plain = self.exact.astype(np.int64) if self.largest < LONG else None
        self.doubles = self.plain.astype(np.float64) if self.largest < 1 << 53 else None

    def typed(self, largest: int):
        """The centroids in the narrowest arithmetic in which squared distances to components up to ``largest`` are exact."""
        reach = (largest + self.largest) ** 2 * max(1, self.exact.shape[1])
        return self.doubles if 2 * reach < 1 << 53 else self.plain if 2 * reach < LONG else self.exact

    def candidates(self, low: np.ndarray, high: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Numbers of the centroids that may be the nearest one (ties included) of a vector in the box."""
        low, high = low.astype(c.dtype), high.astype(c.dtype)
        nearest = np.maximum(np.maximum(low - c, c - high), 0)
        farthest = np.maximum(np.abs(c - low), np.abs(c - high))
        nearest, farthest = (nearest * nearest).sum(1), (farthest * farthest).sum(1)
        left = np.flatnonzero(nearest <= farthest.min())
        if len(left) > 1:
            some, norms = c[left], (c[left] * c[left]).sum(1)
            gap = some[:, None, :] - some[None, :, :]  # [i, j]: distance to j less distance to i is 2x(ci - cj) + |cj|^2 - |ci|^2
            least = 2 * np.minimum(gap * low, gap * high).sum(2) + norms[None, :] - norms[:, None]
            left = left[~(least > 0).any(0)]
        return left

    def assign(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cluster and squared distance per row of ``x``, and ``x`` in the arithmetic used."""
        c = self.typed(max(abs(int(v)) for v in (*low, *high)))
        left = self.candidates(low, high, c)
        x, some = x.astype(c.dtype), c[left]
        if len(left) == 1:
            away = x - some[0]
            return np.full(len(x), left[0]), (away * away).sum(1), x
        if c.dtype == np.float64:
            distances = (x * x).sum(1)[:, None] - 2 * (x @ some.T) + (some * some).sum(1)
        else:
            distances = np.stack([((x - one) ** 2).sum(1) for one in some], axis=1)
        # the first of equal distances is the smaller number
        picked = np.argmin(distances, axis=1)
        return left[picked], distances[np.arange(len(x)), picked], x


def _read_blocks(batches: Iterator[pa.RecordBatch], dims: int, scale: int):
    for batch in batches:
        for i in range(batch.num_rows):
            kind = batch.column("kind")[i].as_py()
            parts = []
            for name in ("vectors", "low", "high"):
                values = np.frombuffer(batch.column(name)[i].as_buffer(), f"<{kind}").reshape(-1, dims)
                parts.append(whole(values, scale) if kind == "f8" else values.astype(np.int64))
            yield batch.column("ids")[i].values, parts[0], parts[1][0], parts[2][0]


def _limbs(value: int) -> list[tuple[int, int]]:
    sign, value, out, at = (-1 if value < 0 else 1), abs(value), [], 0
    while value:
        out.append((at, sign * (value & ((1 << LIMB) - 1))))
        value >>= LIMB
        at += 1
    return out


def totals(stored: DataFrame, centroids: list[tuple[int, ...]], dims: int, scale: int) -> dict[int, dict[int, int]]:
    """Per centroid: sums of its vectors' components, their count (``COUNT``) and the sum of their distances (``DISTANCE``)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Centroids(centroids)
        sums = [[0] * dims for _ in centroids]
        counts, distances = [0] * len(centroids), [0] * len(centroids)
        for _, x, low, high in _read_blocks(batches, dims, scale):
            clusters, away, x = at.assign(x, low, high)
            for c in np.unique(clusters).tolist():
                mine = clusters == c
                sums[c] = [a + int(b) for a, b in zip(sums[c], x[mine].sum(0))]
                counts[c] += int(mine.sum())
                distances[c] += sum(map(int, away[mine]))
        rows = [
            (c, d, limb, value)
            for c in range(len(centroids))
            for d, total in [*enumerate(sums[c]), (COUNT, counts[c]), (DISTANCE, distances[c])]
            for limb, value in _limbs(total)
        ]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["cluster", "d", "limb", "value"])

    parts = stored.select("ids", "kind", "vectors", "low", "high").mapInArrow(add, "cluster int, d int, limb int, value bigint")
    summed = parts.groupBy("cluster", "d", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[int, dict[int, int]] = {c: {} for c in range(len(centroids))}
    for r in summed.collect():  # at most k * (dims + 2) sums
        out[r.cluster][r.d] = out[r.cluster].get(r.d, 0) + (int(r.value) << (LIMB * r.limb))
    return out


def first_centroids(kept: DataFrame, k: int, seed: str, scale: int) -> list[tuple[int, ...]]:
    """The ``k`` vectors whose ids have the smallest hashes, in the order of these."""
    mark = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(mark.asc_nulls_last(), "vec").limit(k).select("vec").collect()
    return [tuple(int(v) for v in whole(np.array([r.vec], np.float64), scale)[0]) for r in first]


def cluster(
    vectors: DataFrame, scratch: Scratch, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:", block: int = BLOCK, vec_id: str = "vec_id", vector: str = "embedding"
) -> Clusters:
    """Lloyd's rounds from the hashed first centroids; a last assignment follows the last round."""
    kept = kept_vectors(vectors, dims, vec_id, vector)
    stored = scratch.keep(blocks(in_hilbert_order(kept, dims), dims, scale, block), "blocks")
    centroids = first_centroids(kept, k, seed, scale)
    done = 0
    for done in range(1, rounds + 1):
        sums = totals(stored, centroids, dims, scale)
        moved = [tuple(t.get(d, 0) // t[COUNT] for d in range(dims)) if COUNT in t else centroids[c] for c, t in sums.items()]
        if moved == centroids:  # all later rounds would repeat this one
            break
        centroids = moved
    sums = totals(stored, centroids, dims, scale)
    inertias = [sums[c].get(DISTANCE, 0) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def short(value: int) -> int | None:
        return value if value < LONG else None

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = Centroids(centroids)
        per_cluster, names = pa.array([short(i) for i in inertias], pa.int64()), pa.array(digests, pa.string())
        for ids, x, low, high in _read_blocks(batches, dims, scale):
            clusters, away, _ = at.assign(x, low, high)
            picks = pa.array(clusters, pa.int32())
            distances = pa.array([short(int(a)) for a in away], pa.int64())
            total = pa.array([short(sum(inertias))] * len(clusters), pa.int64())
            columns = [ids, picks, distances, per_cluster.take(picks), total, names.take(picks)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return Clusters(stored.mapInArrow(label, schema), centroids, done)


def op13_centroid_clusters(spark, folder):
    return cluster(table(spark, folder, "embeddings"), Scratch(spark)).rows


def _sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> str:
    """All rounds as common tables, one after another, over (vector, dimension, value) rows."""
    steps = [
        f"""kept AS MATERIALIZED (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"long AS MATERIALIZED (SELECT r, unnest(range({dims})) AS d, unnest(v) AS x FROM kept)",
        f"""c0 AS MATERIALIZED (SELECT c, unnest(range({dims})) AS d, unnest(v) AS x
        FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {k}))""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, c, s FROM (SELECT l.r, m.c, sum((l.x - m.x) * (l.x - m.x)) AS s FROM long l JOIN c{n} m USING (d) GROUP BY l.r, m.c)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY s, c) = 1)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT m.c, m.d, CASE WHEN t.n IS NULL THEN m.x ELSE CAST((t.s - ((t.s % t.n) + t.n) % t.n) // t.n AS BIGINT) END AS x
                FROM c{n} m LEFT JOIN (SELECT a.c, l.d, sum(l.x) AS s, count(*) AS n FROM a{n} a JOIN long l USING (r) GROUP BY a.c, l.d) t ON t.c = m.c AND t.d = m.d)"""
            )
    steps.append(f"digests AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
    SELECT kept.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.s AS BIGINT) AS distance,
           CAST(sum(a.s) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.s) OVER () AS BIGINT) AS inertia, digests.h AS centroid_sha256
    FROM a{rounds} a JOIN kept USING (r) JOIN digests USING (c)"""
    )


OP13_SQL = _sql()
