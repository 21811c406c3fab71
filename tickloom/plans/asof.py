"""Point-in-time (as-of) joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import CELL
from .ranks import cells as cut


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    cols: Sequence[str],
    strict: bool,
    bucket_seconds: int | None = None,
    right_order: Sequence[str] = (),
    **split: int,
) -> DataFrame:
    """Left rows with ``cols`` of the last right row before (``strict``) or at-or-before them.

    Both sides are tagged, united and ordered within (key, cell); what a cell inherits from earlier cells
    comes from a small summary. Cells are cut at sampled times (:func:`~.ranks.cells`), so they hold about as
    many times each, however unevenly a key is spread; ``bucket_seconds`` asks for fixed time buckets
    instead. Left rows without a match keep nulls. ``right_order`` breaks ties between right rows of equal time.
    """
    keys = list(keys)
    payload = F.struct(*[F.col(c) for c in cols])
    left_tag, right_tag = (0, 1) if strict else (1, 0)
    tie = F.struct(*[F.col(c) for c in right_order]) if right_order else F.struct(F.lit(0).alias("z"))
    lrows = left.select(
        *keys,
        F.unix_micros(F.col(left_time)).alias("_us"),
        F.lit(left_tag).alias("_tag"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    rrows = right.select(
        *keys,
        F.unix_micros(F.col(right_time)).alias("_us"),
        F.lit(right_tag).alias("_tag"),
        payload.alias("_pay"),
        tie.alias("_tie"),
    )
    both = lrows.unionByName(rrows, allowMissingColumns=True)
    if bucket_seconds:
        both = both.withColumn("_b", F.floor(F.col("_us") / F.lit(bucket_seconds * 1_000_000.0)))
    else:
        both = cut(both, keys, "_us", **split).withColumnRenamed(CELL, "_b")
    cells = [*keys, "_b"]
    latest = both.groupBy(*cells).agg(
        F.max_by("_pay", F.when(F.col("_pay").isNotNull(), F.struct("_us", "_tie"))).alias("_end")
    )
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = latest.select(*cells, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    local = (
        Window.partitionBy(*cells)
        .orderBy("_us", "_tag", F.col("_tie").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    hit = both.withColumn("_hit", F.last("_pay", ignorenulls=True).over(local)).filter(F.col("_left").isNotNull())
    out = hit.join(carry, cells, "left").withColumn("_m", F.coalesce("_hit", "_carry"))
    return out.select("_left.*", *[F.col(f"_m.{c}").alias(c) for c in cols])


def missing_matches(joined: DataFrame, col: str) -> DataFrame:
    """Count of left rows without a match: the caller decides whether that is an error."""
    return joined.agg(F.count_if(F.col(col).isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_rows"))
