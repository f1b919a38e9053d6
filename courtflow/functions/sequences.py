"""Ordered work on one long timeline without putting a match in one task.

A timeline is cut into chunks of consecutive positions. Windows of a bounded
radius run inside ``(keys, chunk)`` with a halo of copied neighbour rows, and
running values that reach back without bound are carried between chunks through
a table with one row per chunk. A match that holds a third of all rows is thus
spread over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_FRAMES = 16384
CHUNK, HOME = "_chunk", "_home"


def chunk_of(position: str | Column, size: int) -> Column:
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(size)).cast("bigint")


def with_halo(df: DataFrame, position: str, before: int, after: int, size: int = CHUNK_FRAMES) -> DataFrame:
    """Give each row to its chunk and to the neighbours that look at it.

    A row is copied to every chunk holding a row that reaches ``before`` units
    back or ``after`` units forward to it; ``_home`` marks the original. Chunks
    are never shorter than the window.
    """
    size = max(size, before + after + 1)
    low, high = chunk_of(F.col(position) - after, size), chunk_of(F.col(position) + before, size)
    return df.withColumn(CHUNK, F.explode(F.sequence(low, high))).withColumn(
        HOME, F.col(CHUNK) == chunk_of(position, size)
    )


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(HOME)).drop(CHUNK, HOME)


def chunk_window(keys: Sequence[str], position: str, *more: Column) -> W:
    return W.partitionBy(*keys, CHUNK).orderBy(F.col(position), *more)


def cluster_starts(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    gap: float,
    size: int,
    out: str = "cluster",
    at_gap: bool = False,
) -> DataFrame:
    """Label rows with the first position of their gap-free run.

    A run ends where the next position is more than ``gap`` away (or exactly
    ``gap`` away too, with ``at_gap``).
    """
    keys = list(keys)

    def breaks(distance: Column) -> Column:
        return distance >= gap if at_gap else distance > gap

    local = df.withColumn(CHUNK, chunk_of(position, size))
    w = W.partitionBy(*keys, CHUNK).orderBy(position)
    previous = F.lag(position).over(w)
    local = local.withColumn("_brk", F.when(breaks(F.col(position) - previous), F.col(position)))
    local = local.withColumn("_run", F.max("_brk").over(w.rangeBetween(W.unboundedPreceding, W.currentRow)))
    heads = local.groupBy(*keys, CHUNK).agg(
        F.min(position).alias("_first"), F.max(position).alias("_last"), F.max("_brk").alias("_lastbrk")
    )
    wh = W.partitionBy(*keys).orderBy(CHUNK)
    before = F.lag("_last").over(wh)
    opens = before.isNull() | breaks(F.col("_first") - before)
    heads = heads.withColumn("_open", F.when(opens, F.col("_first")))
    heads = heads.withColumn("_tail", F.coalesce("_lastbrk", "_open"))
    heads = heads.withColumn("_carry", F.max("_tail").over(wh.rowsBetween(W.unboundedPreceding, -1)))
    heads = heads.select(*keys, CHUNK, F.coalesce("_open", "_carry").alias("_entry"))
    joined = local.join(heads, [*keys, CHUNK])
    return joined.withColumn(out, F.coalesce("_run", "_entry")).drop(CHUNK, "_brk", "_run", "_entry")


def running_count(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    size: int,
    out: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """``row_number`` per key in position order, counted chunk by chunk."""
    keys = list(keys)
    local = df.withColumn(CHUNK, chunk_of(position, size))
    w = W.partitionBy(*keys, CHUNK).orderBy(position, *tie)
    local = local.withColumn("_n", F.row_number().over(w))
    heads = df.groupBy(*keys, chunk_of(position, size).alias(CHUNK)).agg(F.count("*").alias("_c"))
    wh = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(*keys, CHUNK, F.coalesce(F.sum("_c").over(wh), F.lit(0)).alias("_base"))
    return (
        local.join(heads, [*keys, CHUNK])
        .withColumn(out, (F.col("_n") + F.col("_base")).cast("bigint"))
        .drop(CHUNK, "_n", "_base")
    )


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    size: int,
    out: str,
    inclusive: bool = False,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Latest non-null ``value`` before each row, however far back it lies.

    Rows at one position stand in the order of the ``tie`` columns.
    """
    keys = list(keys)
    local = df.withColumn(CHUNK, chunk_of(position, size)).withColumn("_v", value)
    w = W.partitionBy(*keys, CHUNK).orderBy(position, *tie)
    local = local.withColumn(
        "_near", F.last("_v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1))
    )
    heads = local.groupBy(*keys, CHUNK).agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(position, *tie))).alias("_tail")
    )
    wh = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    heads = heads.select(*keys, CHUNK, F.last("_tail", ignorenulls=True).over(wh).alias("_carry"))
    return (
        local.join(heads, [*keys, CHUNK])
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop(CHUNK, "_v", "_near", "_carry")
    )


def runs(df: DataFrame, keys: Sequence[str], position: str, size: int = CHUNK_FRAMES) -> DataFrame:
    """Ranges of consecutive integer positions: ``start``, ``end``, ``length``."""
    labelled = cluster_starts(df.select(*keys, position).distinct(), keys, position, 1, size, "start")
    return (
        labelled.groupBy(*keys, "start")
        .agg(F.max(position).alias("end"))
        .withColumn("length", F.col("end") - F.col("start") + 1)
    )


def band_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_pos: str,
    right_pos: str,
    tolerance: float,
) -> DataFrame:
    """Pairs with ``|left_pos - right_pos| <= tolerance`` through a bucket equi-join."""
    width = float(tolerance)
    a = left.withColumn("_b", F.floor(F.col(left_pos) / F.lit(width)).cast("bigint"))
    bucket = F.floor(F.col(right_pos) / F.lit(width)).cast("bigint")
    b = right.withColumn("_b", F.explode(F.sequence(bucket - 1, bucket + 1)))
    return a.join(b, [*keys, "_b"]).filter(F.abs(F.col(left_pos) - F.col(right_pos)) <= tolerance).drop("_b")


def spread_join(many: DataFrame, few: DataFrame, keys: Sequence[str], shares: int = 32, how: str = "inner") -> DataFrame:
    """Join a table with one that has few rows per key, where one key may hold most rows.

    Rows of ``many`` go to one of ``shares`` parts of their key by a hash of their
    values; every part gets the key's rows of ``few``.
    """
    row = many.withColumn("_share", F.pmod(F.xxhash64(*[F.col(c) for c in many.columns]), F.lit(shares)))
    part = few.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    return row.join(part, [*keys, "_share"], how).drop("_share")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    position: str,
    start: str,
    end: str,
    bucket: int,
    how: str = "inner",
) -> DataFrame:
    """Points inside closed intervals; each interval is listed in the buckets it covers."""
    a = points.withColumn("_b", chunk_of(position, bucket))
    b = intervals.withColumn("_b", F.explode(F.sequence(chunk_of(start, bucket), chunk_of(end, bucket))))
    inside = (F.col(position) >= F.col(start)) & (F.col(position) <= F.col(end))
    on = [a[k].eqNullSafe(b[k]) if how != "inner" else a[k] == b[k] for k in keys] + [a["_b"] == b["_b"], inside]
    condition = on[0]
    for part in on[1:]:
        condition = condition & part
    out = a.join(b, condition, how)
    for k in [*keys, "_b"]:
        out = out.drop(b[k])
    return out.drop(a["_b"])


def merged_starts(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    gap: float,
    size: float,
    out: str = "cluster",
) -> DataFrame:
    """Label intervals with the first start of their chain of neighbours.

    An interval joins the chain when it starts within ``gap`` of the furthest end
    so far. Furthest ends and labels are carried between chunks of the start axis.
    """
    keys = list(keys)
    w = W.partitionBy(*keys, CHUNK).orderBy(start, end)
    local = df.withColumn(CHUNK, F.floor(F.col(start) / F.lit(size)).cast("bigint"))
    local = local.withColumn("_reach", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)))
    before = W.partitionBy(*keys).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)
    ends = local.groupBy(*keys, CHUNK).agg(F.max(end).alias("_m"))
    ends = ends.select(*keys, CHUNK, F.max("_m").over(before).alias("_far"))
    local = local.join(ends, [*keys, CHUNK])
    reach = F.greatest("_reach", "_far")
    local = local.withColumn("_brk", F.when(reach.isNull() | (F.col(start) > reach + gap), F.col(start)))
    # Equal starts belong together, in whatever order they were sorted.
    peers = W.partitionBy(*keys, CHUNK).orderBy(start).rangeBetween(W.unboundedPreceding, W.currentRow)
    local = local.withColumn("_run", F.max("_brk").over(peers))
    heads = local.groupBy(*keys, CHUNK).agg(F.max("_brk").alias("_m"))
    heads = heads.select(*keys, CHUNK, F.max("_m").over(before).alias("_carry"))
    return (
        local.join(heads, [*keys, CHUNK])
        .withColumn(out, F.coalesce("_run", "_carry"))
        .drop(CHUNK, "_reach", "_far", "_brk", "_run", "_carry")
    )
