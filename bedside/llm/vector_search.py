"""Exact top-k search by inner product over a vector-approximation file.

Components become integers, ``floor(scale * x)``. Equal vectors are one class, which keeps its smallest ``k + 1`` ids: more can
never be among the k best of any query. Each class is stored twice: as one byte per component (the cell it falls into) and as
the exact vector. Cells divide the range of the vector's own largest component, to a power of two, so vectors of very different size do not
coarsen each other's bounds.

1. Scan: cells are packed into segments, query vectors into blocks, and every block meets every segment once (an equality join
   on block and segment group, so neither side is broadcast and no task holds more than a segment and a block). A matrix
   product gives the lower corner of each cell; a constant per query turns it into bounds of the score. A segment passes on
   the vectors whose upper bound reaches its (k+1)-th best lower bound.
2. First reads: per query the ``first_reads`` candidates with the highest upper bounds are scored exactly. The (k+1)-th best
   exact score is then a proven limit.
3. Last reads: the other candidates are read only if their upper bound reaches that limit. What stays unread cannot belong to
   the result.

Scores are longs where both vectors are small enough and decimals of 38 digits otherwise, so they are exact at any size of the components
up to 2^56 after scaling (from there on a score may have more digits than any column can hold).

Rows take no part if the id or the vector is null, or if a component is null, not finite, or beyond that. Vectors meet only vectors of their own length. Repeated equal rows count once; a row with the query's id and another vector is a candidate. An empty table gives no rows.
Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, shuffle_partitions, table

SCALE = 256
LIMIT = 1 << 56
#: Bits of a component once its vector is brought to a common size, before it falls into a cell.
BITS = 20
#: Cells per component, vectors in a segment, queries in a block.
CELLS = 64
SEGMENT = 4096
BLOCK = 512


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id`` and ``vec`` (array of long) of the rows that take part, each once."""
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    fine = F.forall(
        F.col(vector),
        lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(F.lit(float(SCALE)) * x.cast("double")) < float(LIMIT)),
    )
    taking = vectors.filter(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).filter(fine)
    return taking.select(F.col(vec_id).cast("long").alias("id"), scaled.cast("array<bigint>").alias("vec")).distinct()


def top_k(vectors: DataFrame, is_query: Column, k: int, scratch: Scratch, vec_id: str = "vec_id", vector: str = "embedding", first_reads: int | None = None) -> DataFrame:
    """The ``k`` best rows of each query row: ``query_id, rank, vec_id, score``; ``is_query`` is a condition on ``id``."""
    spark = vectors.sparkSession
    first_reads = first_reads or 4 * (k + 1)
    rows = scratch.keep(integer_vectors(vectors, vec_id, vector), "rows")
    smallest = Window.partitionBy("vec").orderBy("id")
    classes = (
        rows.withColumn("n", F.row_number().over(smallest))
        .filter(F.col("n") <= k + 1)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("id"), "ids", "vec", F.size("vec").alias("dims"))
        # a class is named by its smallest id and a digest, since one id may come with several vectors
        .withColumn("key", F.struct("id", F.xxhash64("vec").alias("digest")))
        .withColumn("largest", F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x))), F.lit(0)))
    )
    classes = scratch.keep(classes, "classes")
    asked = rows.filter(is_query).withColumnRenamed("id", "query_id").join(classes.select("vec", "key"), "vec").select("query_id", "key")
    asked = scratch.keep(asked, "asked")
    query_classes = classes.join(asked.select("key").distinct(), "key", "left_semi")

    n, n_queries = classes.count(), query_classes.count()
    segments, blocks = max(1, math.ceil(n / SEGMENT)), max(1, math.ceil(n_queries / BLOCK))
    groups = min(segments, max(1, math.ceil(2 * shuffle_partitions(spark) / blocks)))

    # the power of two that brings the largest component just below 2^BITS, up or down
    unit = F.pow(F.lit(2.0), (F.length(F.bin("largest")) - BITS).cast("double"))
    low, width = -(1 << BITS), (2 << BITS) // CELLS
    place = lambda x: F.floor((F.floor(x.cast("double") / F.col("unit")) - low) / width)
    cells = F.transform(F.col("vec"), lambda x: F.least(place(x), F.lit(CELLS - 1)).cast("byte"))
    packed = (
        classes.withColumn("unit", unit)
        .groupBy("dims", F.pmod(F.xxhash64("key"), F.lit(segments)).alias("segment"))
        .agg(F.collect_list(F.struct(F.col("id"), F.col("key.digest").alias("digest"), "unit", cells.alias("cells"))).alias("stored"))
        .select("dims", (F.col("segment") % groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "stored")
    )
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    asking = (
        query_classes.groupBy("dims", block.alias("block"))
        .agg(F.collect_list(F.struct(F.col("id"), F.col("key.digest").alias("digest"), F.col("vec"))).alias("asking"))
        .select("dims", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("group"), "block", "asking")
    )
    met = packed.join(asking.hint("shuffle_hash"), ["dims", "group", "block"]).select("dims", "stored", "asking")
    schema = "q struct<id:bigint,digest:bigint>, key struct<id:bigint,digest:bigint>, bound double"
    found = met.mapInArrow(_bounds(k + 1, float(low), float(width)), schema)
    by_bound = Window.partitionBy("q").orderBy(F.col("bound").desc(), "key")
    found = scratch.keep(found.withColumn("place", F.row_number().over(by_bound)), "candidates")

    first = scratch.keep(_exact(found.filter(F.col("place") <= first_reads), classes), "first_reads")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "key")
    limits = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k + 1).select("q", F.col("score").alias("limit"))
    rest = found.filter(F.col("place") > first_reads).join(limits, "q").filter(F.col("bound") >= F.col("limit").cast("double"))
    scored = first.unionByName(_exact(rest.drop("limit"), classes))

    members = scored.join(classes.select("key", "ids"), "key").select("q", "key", "score", F.explode("ids").alias("vec_id"))
    closest = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    short = members.withColumn("n", F.row_number().over(closest)).filter(F.col("n") <= k + 1).drop("n")
    answers = asked.withColumnRenamed("key", "q").join(short, "q")
    answers = answers.filter(~((F.col("vec_id") == F.col("query_id")) & (F.col("q") == F.col("key"))))
    ranks = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return answers.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _exact(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``q, key, score`` with the exact vectors read for just these pairs."""
    mine = classes.select(F.col("key").alias("q"), F.col("vec").alias("q_vec"), F.col("largest").alias("q_largest"))
    other = classes.select("key", "vec", "largest")

    def dot(kind: str) -> Column:
        pairs = F.zip_with("q_vec", "vec", lambda a, b: (a.cast(kind) * b.cast(kind)).cast("bigint" if kind == "bigint" else "decimal(38,0)"))
        zero = F.lit(0).cast("bigint" if kind == "bigint" else "decimal(38,0)")
        return F.aggregate(pairs, zero, lambda s, x: (s + x).cast("bigint" if kind == "bigint" else "decimal(38,0)")).cast("decimal(38,0)")

    fits = F.col("q_largest").cast("double") * F.col("largest") * (F.size("vec") + 1) < 2.0**62
    product = F.when(fits, dot("bigint")).otherwise(dot("decimal(19,0)"))
    return pairs.select("q", "key").join(other, "key").join(mine, "q").select("q", "key", product.alias("score"))


def _bounds(wanted: int, low: float, width: float):
    """Batches of (segment, block) to the pairs that may be among the ``wanted`` best within the segment."""

    def matrix(column, dims):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.struct([("id", pa.int64()), ("digest", pa.int64())])
        for batch in batches:
            for row in range(batch.num_rows):
                dims = batch.column("dims")[row].as_py()
                stored, asking = batch.column("stored")[row].values, batch.column("asking")[row].values
                q = matrix(asking.field("vec"), dims) if dims else np.zeros((len(asking), 0))
                c = matrix(stored.field("cells"), dims) if dims else np.zeros((len(stored), 0))
                # a component lies between its cell's corner and the next one, times the vector's unit, but for a rounded division
                unit = stored.field("unit").to_numpy(zero_copy_only=False)
                corner = (q @ c.T) * width + (low - 1) * q.sum(1)[:, None]
                # rounding of sums over doubles is far below this margin
                margin = 1e-9 * (np.abs(q).sum(1) * (abs(low) + width * CELLS)) + 1
                upper = (corner + ((width + 2) * np.maximum(q, 0).sum(1) + margin)[:, None]) * unit
                lower = (corner + ((width + 2) * np.minimum(q, 0).sum(1) - margin)[:, None]) * unit
                n = c.shape[0]
                if n > wanted:
                    limit = np.partition(lower, n - wanted, axis=1)[:, n - wanted]
                    qi, vi = np.nonzero(upper >= limit[:, None])
                else:
                    qi, vi = map(np.ravel, np.indices(upper.shape))
                for at in range(0, len(qi), 100_000):
                    i, j = qi[at : at + 100_000], vi[at : at + 100_000]
                    take = lambda side, ix: pa.StructArray.from_arrays(
                        [side.field("id").take(pa.array(ix)), side.field("digest").take(pa.array(ix))], fields=list(pair)
                    )
                    yield pa.RecordBatch.from_arrays([take(asking, i), take(stored, j), pa.array(upper[i, j])], ["q", "key", "bound"])

    return scan


def op2_vector_search(spark, folder):
    found = top_k(table(spark, folder, "embeddings"), F.col("id") % 50 == 0, 5, Scratch(spark))
    return found.withColumn("score", F.col("score").try_cast("bigint"))


OP2_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.v, v.v) AS BIGINT) AS score
      FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.v) = len(v.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
