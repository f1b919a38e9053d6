"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-partitioned by document id.  Each partition's byte and row totals
give, once summed in order, the place of every partition in the whole; a running
sum inside the partition gives the place of every row.  Cutting those places at
equal targets yields contiguous, balanced shards.  Only ids, sizes and checksums
move; texts do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.tables import keep, n_bytes

#: Bytes that every row counts besides its text.
ROW_BYTES = 8


def prefix_sums(rows: DataFrame, order: list[str], size: str) -> tuple[DataFrame, int]:
    """``rows`` with ``start`` (sizes of all rows before) and ``row`` (their number), and the sum of all sizes.

    The one-task window runs over one row per partition.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The last key only splits rows that are alike in every respect.
    ranged = rows.repartitionByRange(n, *order, F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    ranged = keep(ranged)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy("part")
        .agg(F.sum(size).alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
        .select(
            "part",
            F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"),
            F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("part_first"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("start", F.coalesce(F.sum(size).over(inside), F.lit(0)))
        .withColumn("row", F.coalesce(F.count(F.lit(1)).over(inside), F.lit(0)))
        .join(F.broadcast(totals), "part")  # one row per shuffle partition
        .withColumn("start", F.col("start") + F.col("part_start"))
        .withColumn("row", F.col("row") + F.col("part_first"))
        .drop("part", "part_start", "part_first")
    )
    total = ranged.agg(F.sum(size)).first()[0] or 0
    return placed, int(total)


def shard_by_bytes(docs: DataFrame, shards: int, tie: str | None = None) -> DataFrame:
    """Put every row into one of ``shards`` contiguous shards of near-equal bytes.

    Rows stand in the order of doc_id (null first), then of a hash of their text
    or of the column ``tie``, so repeated rows are neighbours.  A row goes to the shard in which its middle
    byte lies.  Returns doc_id, size (UTF-8 bytes of the text, none for null, plus
    8), text_crc32 (0 for null), shard and slot (place within the shard).  Shards
    may be empty where rows are few or very long; other columns are not read.
    """
    rows = docs.select(
        "doc_id",
        (n_bytes() + F.lit(ROW_BYTES)).alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        (F.col(tie) if tie else F.xxhash64("text")).alias("tie"),
    )
    placed, total = prefix_sums(rows, ["doc_id", "tie"], "size")
    target = F.call_function("div", (F.col("start") * 2 + F.col("size")) * shards, F.lit(2 * max(total, 1)))
    cut = placed.withColumn("shard", F.least(F.lit(shards - 1), target).cast("int"))
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"), *(["tie"] if tie else [])
    )


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """The rows of ``docs`` with shard and slot of ``shard_by_bytes``; whole rows are shuffled once.

    Rows that are equal in all columns take the places of all of them.
    """
    whole = docs.select("doc_id", F.xxhash64(*docs.columns).alias("tie"), F.struct(*docs.columns).alias("whole"), "text")
    places = shard_by_bytes(whole.select("doc_id", "text", F.col("tie").alias("mark")), shards, "mark")
    places = places.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("shard", "slot")).alias("places"))  # as many as a row has repeats
    one = whole.groupBy("doc_id", "tie").agg(F.first("whole").alias("whole")).alias("one")
    same = F.col("one.doc_id").eqNullSafe(F.col("places.doc_id")) & (F.col("one.tie") == F.col("places.tie"))
    return one.join(places.alias("places"), same).select("whole", F.explode("places.places").alias("place")).select("whole.*", "place.shard", "place.slot")
