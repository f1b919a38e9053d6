"""Stored records: upserts, latest rows, pages."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from courtflow.session import cut_lineage

MAX_PAGE = 100


def batch_duplicates(batch: DataFrame, key: str) -> DataFrame:
    """Ids that a batch writes more than once; such a batch is refused."""
    return batch.groupBy(key).agg(F.count("*").alias("uses")).filter("uses > 1")


def upserted(current: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Table after replacing whole rows by id.

    Rows with a new version leave by anti-join, so the stored side is never sorted.
    """
    return current.join(batch.select(key), key, "left_anti").unionByName(batch)


def upsert_parquet(batch: DataFrame, path: str, target: str, key: str, partition_by: Sequence[str] = ()) -> None:
    """Read ``path``, apply ``batch`` and write the result to the new folder ``target``."""
    if not batch_duplicates(batch, key).isEmpty():
        raise ValueError(f"batch repeats {key}")
    current = batch.sparkSession.read.schema(batch.schema).parquet(path)
    upserted(current, cut_lineage(batch), key).write.mode("errorifexists").partitionBy(*partition_by).parquet(target)


def bucket_of(key: str, buckets: int) -> Column:
    """Part of the key space that a record lives in."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Store records by key space part (column ``part``), so that a later upsert rewrites only some parts."""
    parts = rows.withColumn("part", bucket_of(key, buckets)).repartition("part")
    parts.write.mode("errorifexists").partitionBy("part").parquet(path)


def upsert_touched(batch: DataFrame, path: str, key: str, buckets: int) -> None:
    """Replace records by id in a table of ``write_bucketed``; files of other parts keep their names.

    Only the parts that the batch falls into are read, and only they are swapped at
    commit.  The new rows are checkpointed before the swap, so lost executors do not
    send a task back to files that are gone.
    """
    if not batch_duplicates(batch, key).isEmpty():
        raise ValueError(f"batch repeats {key}")
    batch = cut_lineage(batch.withColumn("part", bucket_of(key, buckets)))
    touched = [r["part"] for r in batch.select("part").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    current = batch.sparkSession.read.schema(batch.schema).parquet(path).filter(F.col("part").isin(touched))
    merged = cut_lineage(upserted(current.select(*batch.columns), batch, key))
    merged.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def latest(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Newest row per key, by an aggregate that combines on the map side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, "v.*")


def page(rows: DataFrame, where: Column, order: Sequence[Column], limit: int, offset: int) -> DataFrame:
    """One page of a match's records with the total count (limit 1 to 100).

    Sorting with a limit keeps only the first rows per task; the count is its own
    small aggregate.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must lie between 1 and 100 and offset must not be negative")
    found = rows.filter(where)
    total = found.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    part = found.orderBy(*order).offset(offset).limit(limit)
    return part.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")


PIVOTS = 64


def deep_page(rows: DataFrame, where: Column, order: Sequence[str], limit: int, offset: int, few: int = 10_000) -> DataFrame:
    """One page at any depth, in ascending order with nulls first, with the total count.

    The rows are gone through twice: once for their ``order`` columns, which are kept in a
    checkpoint, and once for the page.  In between its place is found by counting keys between
    up to 64 random pivots, and only the interval that holds key number ``offset`` is looked at
    again, until it has at most ``few`` keys or equal ones only.  The second time starts at the
    interval's lower end and stops at a pivot behind the page, so no task ever gets the rows
    before the page, and sources can leave out the others by the first column.
    Rows equal in ``order`` stand by a hash of all their values, so pages never overlap.
    An offset beyond the last row gives an empty page.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must lie between 1 and 100 and offset must not be negative")
    found = rows.filter(where)
    keys = cut_lineage(found.select(*order))
    total = keys.count()
    low, equal, high, skip = _place(keys, order, limit, offset, total, few)
    near = found.withColumn("_h", F.xxhash64(*rows.columns)).filter(_between(order, equal or low, high, equal is not None))
    if equal is None:
        part = near.orderBy(*order, "_h").offset(skip).limit(limit)
    else:
        ties = near.filter(_key(order) == _at(keys, order, equal))
        hashes = cut_lineage(ties.select("_h"))
        many = hashes.count()
        same = max(0, min(limit, many - skip))
        low, twin, top, skip = _place(hashes, ["_h"], same or 1, skip, many, few)
        part = ties.filter(_between(["_h"], twin or low, top, twin is not None))
        # Of rows that are the same in every value any will do.
        part = part.orderBy("_h").offset(skip).limit(same) if twin is None else _from_twins(part, twin["_h"], skip, same, hashes)
        if same < limit:
            part = part.unionByName(near.filter(_key(order) > _at(keys, order, equal)).orderBy(*order, "_h").limit(limit - same))
    return part.drop("_h").withColumn("total", F.lit(total).cast("bigint"))


def _from_twins(rows: DataFrame, twin: int, skip: int, limit: int, hashes: DataFrame) -> DataFrame:
    """Rows from the ``skip``-th of those with hash ``twin`` on."""
    same = min(limit, hashes.filter(F.col("_h") == twin).count() - skip)
    part = rows.filter(F.col("_h") == twin).limit(same)
    return part if same == limit else part.unionByName(rows.filter(F.col("_h") > twin).orderBy("_h").limit(limit - same))


def _key(order: Sequence[str]) -> Column:
    return F.struct(*order)


def _at(rows: DataFrame, order: Sequence[str], key: Row) -> Column:
    return F.struct(*[F.lit(key[c]).cast(rows.schema[c].dataType).alias(c) for c in order])


def _between(order: Sequence[str], low: Row | None, high: Row | None, closed: bool) -> Column:
    """Rows above ``low`` (or at it, if closed) and up to ``high``; the first column is named
    alone too, because sources understand that."""
    first, inside = F.col(order[0]), F.lit(True)
    lits = lambda key: F.struct(*[F.lit(key[c]).alias(c) for c in order])
    if low is not None:
        inside = inside & ((_key(order) >= lits(low)) if closed else (_key(order) > lits(low)))
        if low[order[0]] is not None:
            inside = inside & (first >= F.lit(low[order[0]]))
    if high is not None:
        inside = inside & (_key(order) <= lits(high))
        inside = inside & (first.isNull() if high[order[0]] is None else first.isNull() | (first <= F.lit(high[order[0]])))
    return inside


def _place(keys: DataFrame, order: Sequence[str], limit: int, offset: int, size: int, few: int) -> tuple:
    """Where a page starts: the key below it or, among equals, the key itself; a key at or behind
    the page's last (null: none known); and how many keys to skip from there."""
    low = high = top = None
    while size > few and offset < size:
        part = keys.filter(_key(order) > _at(keys, order, low)) if low is not None else keys
        part = part.filter(_key(order) < _at(keys, order, high)) if high is not None else part
        part = part.select(_key(order).alias("_key"))
        pivots = sorted_keys(part.orderBy(F.rand()).limit(PIVOTS))
        marks = F.array(*[_at(keys, order, p) for p in pivots])
        # Odd places are rows equal to a pivot, even ones the rows between two pivots.
        place = 2 * F.size(F.filter(marks, lambda p: p <= F.col("_key"))) - F.array_contains(marks, F.col("_key")).cast("int")
        counts = dict(map(tuple, part.groupBy(place.alias("i")).agg(F.count("*")).collect()))
        upto = list(accumulate(counts.get(i, 0) for i in range(2 * len(pivots) + 1)))
        here = next(i for i, n in enumerate(upto) if offset < n)
        top = next((pivots[i // 2] for i, n in enumerate(upto) if n >= offset + limit and i % 2), top)
        offset, size = offset - (upto[here - 1] if here else 0), counts[here]
        if here % 2:
            return None, pivots[here // 2], top, offset
        low = pivots[here // 2 - 1] if here else low
        high = pivots[here // 2] if here // 2 < len(pivots) else high
    return low, None, top, offset


def sorted_keys(keys: DataFrame) -> list:
    """Distinct keys of a small table in Spark's own order."""
    return [r["_key"] for r in keys.distinct().orderBy("_key").collect()]
