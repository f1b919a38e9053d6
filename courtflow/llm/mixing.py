"""Mix sources to target weights with hash thresholds, without sorting.

Every document gets a 48-bit hash.  Words are summed by source and by the hash's
leading 12 bits; the running sum shows in which bucket a source's budget ends.
Only that bucket is summed again by the next 12 bits, and so on, until the
threshold is exact.  A document is taken once more than the full passes of its
source if its hash lies below the threshold, so a smaller budget always takes a
subset of what a larger one takes, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtflow.llm.tables import keep, word_count

LEVELS, BITS = 4, 12
#: Parts into which rows of one id, source and text are divided when they are numbered.
SHARES = 16
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)


def water_filling(sources: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Targets by weight that share ``share`` of all sizes; none is above ``cap`` times its source's size.

    What a capped source leaves is shared by the others in proportion to their
    weights.  In order of cap by weight, the capped sources come first, so running
    sums over one row per source find them.
    """
    by_name = Window.orderBy("key")
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), "key")
    whole = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kinds = F.array(*[F.lit(w) for w in weights])
    out = (
        sources.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("goal", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("before", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", (F.col("goal") - F.col("before")) * F.col("weight") >= F.col("most") * F.col("rest"))
        .withColumn("gone", F.coalesce(F.sum(F.when(F.col("capped"), F.col("most"))).over(whole), F.lit(0.0)))
        .withColumn("open", F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole), F.lit(0)))
    )
    level = (F.col("goal") - F.col("gone")) * F.col("weight") / F.when(F.col("open") > 0, F.col("open"))
    return out.select("key", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per key, the hash below which the sizes sum up to the budget as nearly as whole hashes allow.

    ``rows`` has key, hash (below 2**48) and size; ``budgets`` has key and budget.
    Keys whose budget covers all their rows get 2**48.
    """
    top = LEVELS * BITS
    # lead: the leading bits settled so far; left: what of the budget is not used up before that bucket.
    open_ = budgets.select("key", F.lit(0).cast("long").alias("lead"), F.col("budget").alias("left"))
    last = None
    for level in range(1, LEVELS + 1):
        cell = F.shiftright(F.col("hash"), top - level * BITS)
        sums = rows.groupBy("key", cell.alias("cell")).agg(F.sum("size").alias("sum")) if level == 1 else (
            rows.withColumn("lead", F.shiftright(F.col("hash"), top - (level - 1) * BITS))
            .join(open_.select("key", "lead"), ["key", "lead"], "left_semi")
            .groupBy("key", cell.alias("cell")).agg(F.sum("size").alias("sum"))
        )
        running = Window.partitionBy("key").orderBy("cell")
        last = (
            sums.withColumn("upto", F.sum("sum").over(running))
            .join(open_.select("key", "left"), "key")
            .where(F.col("upto") > F.col("left"))
            .groupBy("key").agg(F.min(F.struct("cell", "sum", "upto", "left")).alias("b"))
            .select("key", F.col("b.cell").alias("lead"), "b.sum", (F.col("b.left") - (F.col("b.upto") - F.col("b.sum"))).alias("left"))
        )
        last = keep(last)  # one row per key
        open_ = last
    # The last bucket is one hash value; it goes in if that comes nearer to the budget.
    nearer = F.when(F.col("sum") - F.col("left") < F.col("left"), 1).otherwise(0)
    found = last.select("key", (F.col("lead") + nearer).alias("below"))
    return budgets.join(found, "key", "left").select("key", F.coalesce("below", F.lit(1 << top)).alias("below"))


def _hash(copy) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.col("identity"), F.lit("/"), copy.cast("string"))), 1, 12), 16, 10).cast("long")


def _marked(docs: DataFrame, *columns) -> DataFrame:
    """``columns`` with key (sorts null last), identity, same (its 64-bit hash) and hash of every row as if none were repeated."""
    key = F.coalesce(F.concat(F.lit("0"), F.col("source")), F.lit("1"))
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key, F.md5(F.coalesce("text", F.lit("")))]
    rows = docs.select(*columns, key.alias("key"), F.md5(F.concat_ws("/", *parts)).alias("identity"))
    return rows.withColumns({"same": F.xxhash64("identity"), "hash": _hash(F.lit(0))})


def _repeated(rows: DataFrame) -> DataFrame:
    """The values of ``same`` that more than one row has, once for each share of ``_copies``."""
    more = rows.groupBy("same").count().where("count > 1")
    return keep(more.select("same", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share")))


def _copies(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Number the rows that are equal in id, source and text, and give each a hash of its own.

    Only repeated rows are moved.  They are numbered within the partitions of a
    written table; running totals of one row per partition give the first number
    of each, so no task holds all rows of a text that fills much of the table.
    """
    if repeated.isEmpty():
        return rows.drop("identity", "same")
    shared = rows.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(SHARES)).cast("int"))
    once = rows.join(repeated.where("share = 0").select("same"), "same", "left_anti")
    again = keep(shared.join(repeated, ["same", "share"], "left_semi").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("same").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = again.groupBy("same", "part").agg(F.count(F.lit(1)).alias("n"))
    firsts = firsts.select("same", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy("same", "part").orderBy("share")) - 1
    again = again.withColumn("place", place).join(firsts, ["same", "part"])
    again = again.withColumn("hash", _hash(F.col("first") + F.col("place")))
    columns = [c for c in rows.columns if c not in ("identity", "same")]
    return once.select(*columns).union(again.select(*columns))


def _plan(rows: DataFrame, share: float, cap: int, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: key, source_size, target, full (passes of all its rows), below (hashes that are taken once more)."""
    sources = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    targets = keep(
        water_filling(sources, share, float(cap), weights)
        .withColumn("full", F.least(F.lit(cap), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)).cast("int"))
        .withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    )
    cuts = thresholds(rows, targets.select("key", "budget"))
    # A source that is already taken as often as allowed has nothing left to add.
    # Written, so that the planner knows its size: where that is small, rows join it without a shuffle.
    return keep(targets.join(cuts, "key").select(
        "key", "source_size", "target", "full", F.when((F.col("budget") > 0) & (F.col("full") < cap), F.col("below")).otherwise(0).alias("below")
    ))


def mix_sources(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """How many words of each document a mix by source weights takes, repeats counted.

    Sizes are words separated by ASCII white space (null text: none).  Returns
    doc_id, source, size, source_size, target (of the source), passes (times the
    document is taken) and taken.  No document is taken more than ``cap`` times.
    Null is a source of its own, the last.  The hash comes from doc_id, source and
    text and, for rows equal in all three, a running number, so ids may be missing
    or repeated.  An empty table gives no rows, and a source without words has
    target 0.
    """
    rows = keep(_marked(docs, "doc_id", "source", word_count().alias("size")))
    rows = _copies(rows, _repeated(rows))
    passes = F.col("full") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return rows.join(_plan(rows, share, cap, weights), "key").select(
        "doc_id", "source", "size", "source_size", "target", passes.alias("passes"), (F.col("size") * passes).alias("taken")
    )


def take(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as often as ``mix_sources`` takes them; texts are not shuffled where the plan has few sources."""
    sizes = keep(_marked(docs, word_count().alias("size")))
    repeated = _repeated(sizes)
    plan = _plan(_copies(sizes, repeated), share, cap, weights).select("key", "full", "below")
    rows = _copies(_marked(docs, F.struct(*docs.columns).alias("whole")), repeated).join(plan, "key")
    times = F.col("full") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)
    return rows.select("whole", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("time")).select("whole.*")
