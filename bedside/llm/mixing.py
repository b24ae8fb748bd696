"""Mixing sources to target weights by systematic sampling.

Targets: sources in code-point order (null last) take the weights 5, 2, 1, 5, ... of the words of the whole collection. A
target stops at three times its source's words; what is cut is shared by weight among the rest until none is above. That
fixed point is found at once: with the sources ordered by cap / weight the stopped ones come first.

Sampling: within a source every document has the same expected copies, target / source words. Documents are put in the order
of (size, id, text digest, other columns), the expected copies are summed up along it, one random offset is added, and a
document is emitted once per integer boundary that its step crosses. Neighbours in that order have like sizes, so the words
taken miss the target by about one document at most.

The order is made by one range partitioning over (source, size, ...), so a source with a third of all rows is spread over as
many partitions as it needs. The place of a row within its partition comes with the sorted write; the counts per partition
and source (a small table) give the places before it. No window runs over rows.

Null texts have size 0, null sources are one source, empty tables give empty results. Repeated rows are rows of their own.
Rows equal in all ordering columns are interchangeable. Helper columns take names that the input does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedside.llm.common import Scratch, free_name, shuffle_partitions, table, text_or_empty, word_count

#: Weights that repeat along the ordered sources, the cap on copies, and the seed of the offsets.
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Fixed-point unit of expected copies.
UNIT = 1 << 40


def source_targets(sizes: DataFrame, source: str, size: str) -> DataFrame:
    """One row per source: ``source``, ``source_size`` and ``target``.

    The windows here run over the table of sources, one row each after a pre-aggregation, not over documents.
    """
    sums = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    caps = sums.withColumn("weight", weight).withColumn("cap", (CAP * F.col("source_size")).cast("double"))
    order = Window.orderBy((F.col("cap") / F.col("weight")), F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = (
        caps.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("stopped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(onward))
        .withColumn("share", (F.col("total") - F.col("stopped_before")) / F.col("weight_left"))
        .withColumn("stopped", F.col("weight") * F.col("share") >= F.col("cap"))
    )
    share = F.first(F.when(~F.col("stopped"), F.col("share")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.when(F.col("stopped"), F.col("cap")).otherwise(F.col("weight") * F.col("open_share"))
    return steps.withColumn("open_share", share).select(source, "source_size", target.alias("target"))


def mix(docs: DataFrame, scratch: Scratch, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: bool = True):
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (under free names, returned too).

    ``carry=False`` leaves the other columns behind and returns the id and source only.
    """
    names = {k: free_name(k, docs.columns) for k in ("size", "source_size", "target", "copies", "taken", "digest", "rest", "place", "part")}
    size, digest, rest, place, part = (names[k] for k in ("size", "digest", "rest", "place", "part"))
    own = docs.columns if carry else [doc_id, source]
    others = [c for c in docs.columns if c not in (text, source, doc_id)] if carry else []
    sized = docs.select(
        *[F.col(f"`{c}`") for c in own],
        word_count(text_or_empty(text)).alias(size),
        F.md5(text_or_empty(text)).alias(digest),
        (F.to_json(F.struct(*[F.col(f"`{c}`") for c in others])) if others else F.lit("")).alias(rest),
    )
    order = [F.col(source).asc_nulls_last(), F.col(size).asc(), F.col(doc_id).asc_nulls_first(), F.col(digest).asc(), F.col(rest).asc()]
    ranged = sized.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    # the id counts the rows of a partition in its sorted order; the upper bits are the partition
    number = F.monotonically_increasing_id()
    placed = ranged.drop(digest, rest).withColumn(place, number)
    placed = scratch.keep(placed, "mix_order")
    placed = placed.withColumn(part, F.shiftright(F.col(place), 33)).withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))

    pieces = placed.groupBy(source, part).agg(F.min(place).alias("piece_start"), F.count("*").alias("piece_rows"), F.sum(size).alias("piece_size"))
    targets = source_targets(pieces, source, "piece_size")
    along = Window.partitionBy(source).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("rows_before", F.coalesce(F.sum("piece_rows").over(along), F.lit(0)))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.concat(F.lit(":"), F.col(source)), F.lit("")))), 1, 10), 16, 10)
    targets = targets.withColumnRenamed(source, "target_source")
    pieces = pieces.join(targets, F.col(source).eqNullSafe(F.col("target_source"))).select(
        F.col(source).alias("piece_source"),
        F.col(part).alias("piece_part"),
        (F.col("rows_before") - F.col("piece_start")).alias("shift"),
        F.col("source_size").alias(names["source_size"]),
        F.col("target").alias(names["target"]),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT))))
        .otherwise(0)
        .cast("decimal(14,0)")
        .alias("step"),
        offset.cast("decimal(14,0)").alias("offset"),
    )
    joined = placed.join(pieces, F.col(source).eqNullSafe(F.col("piece_source")) & (F.col(part) == F.col("piece_part")))
    rank = F.col(place) + F.col("shift")  # from 0
    copies = _boundaries(F.col("offset"), F.col("step"), rank + 1) - _boundaries(F.col("offset"), F.col("step"), rank)
    out = joined.withColumn(names["copies"], copies).withColumn(names["taken"], F.col(names["copies"]) * F.col(size))
    keep = [F.col(f"`{c}`") for c in own] + [F.col(names[k]) for k in ("size", "source_size", "target", "copies", "taken")]
    return out.select(*keep), names


def _boundaries(offset, step, k):
    """Integer boundaries crossed by the first ``k`` documents, in exact decimal arithmetic."""
    total = offset + step * k.cast("decimal(18,0)")
    return F.call_function("div", total, F.lit(UNIT).cast("decimal(14,0)")).cast("long")


def mixed_rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it was drawn, with its own columns only."""
    drawn, names = mix(docs, scratch)
    copy = free_name("copy", drawn.columns)
    repeated = drawn.filter(F.col(names["copies"]) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    drawn, _ = mix(docs, Scratch(spark), carry=False)
    return drawn.select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
o AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
t AS (SELECT source, source_size, CASE WHEN weight * share >= cap THEN cap
             ELSE weight * (SELECT min_by(share, cap / weight) FROM o WHERE weight * share < cap) END AS target FROM o),
u AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST, d.digest) AS k,
             CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size * {UNIT}.0) ELSE 0 END AS HUGEINT) AS step,
             CAST(concat('0x', substr(md5(concat('{SEED}', coalesce(concat(':', d.source), ''))), 1, 10)) AS HUGEINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((((start + step * k) // {UNIT}) - ((start + step * (k - 1)) // {UNIT})) * size AS BIGINT) AS taken
FROM u"""
