"""Time-range rolling sums and previous-reading lookup per entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedside.functions.time import MICROS_PER_HOUR, order_micros
from bedside.operators import pieces


def forward_rolling_sum(df: DataFrame, keys: Sequence[str], time: str, value: str, spans: dict[str, int]) -> DataFrame:
    """Sum of ``value`` from each reading until ``span`` hours later, both ends included.

    ``spans`` maps output column to hours. The time line of a key is cut into buckets as long as the longest span. Every reading
    goes to its own bucket and, as a follower that is only summed, to the one before; so each bucket holds all its frames, range
    frames run per (key, bucket), and a key of any size is spread over its buckets. There is one plan for all sizes. Readings at
    one time are rows of their own; readings without a time are one another's frame, as in a window over the whole key.
    """
    rows = _placed(df, keys, time)
    width = F.lit(max(spans.values()) * MICROS_PER_HOUR)
    at = F.floor(F.col("__t") / width).cast("long")
    mine = F.struct(at.alias("__bucket"), F.lit(True).alias("__own"))
    before = F.struct((at - 1).alias("__bucket"), F.lit(False).alias("__own"))
    placed = F.explode(F.when(F.col("__t").isNull(), F.array(mine)).otherwise(F.array(mine, before)))
    spread = rows.withColumn("__p", placed).select("*", "__p.__bucket", "__p.__own")
    # asked for explicitly: a frame that is partitioned by key alone would satisfy the window and keep a key in one task
    spread = spread.drop("__p").repartition(*keys, "__bucket")
    w = Window.partitionBy(*keys, "__bucket").orderBy("__t")
    frames = {
        name: F.sum(value).over(w.rangeBetween(Window.currentRow, span * MICROS_PER_HOUR)).cast("double")
        for name, span in spans.items()
    }
    return spread.withColumns(frames).filter("__own").select(*df.columns, *spans)


def previous_reading(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: dict[str, str],
    within_hours: int | None = None,
    max_rows: int | None = pieces.MAX_ROWS,
    sized_by: DataFrame | None = None,
) -> DataFrame:
    """Values ``{output: input}`` of the preceding reading, null if it is ``within_hours`` or more back."""
    sized = None if sized_by is None else _placed(sized_by, keys, time)
    wanted = {f"__p_{out}": src for out, src in columns.items()}
    found = pieces.add_previous(
        _placed(df, keys, time), keys, "__t", {"__p_t": "__t", **wanted}, max_rows=max_rows, sized_by=sized
    )
    fresh = F.lit(True)
    if within_hours is not None:
        fresh = F.col("__p_t") > F.col("__t") - F.lit(within_hours * MICROS_PER_HOUR)
    return found.select(*df.columns, *[F.when(fresh, F.col(f"__p_{out}")).alias(out) for out in columns])


def _placed(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows with a known entity and their place in time."""
    return df.filter(pieces.present(*keys)).withColumn("__t", order_micros(time))
