"""Order-dependent decisions as one streaming pass over Spark-sorted rows.

``sorted_fold`` runs a small state machine over each group of a table that Spark
has partitioned and sorted (with spill). Groups are short clusters, and only the
state of the group at hand is held, never its rows.

``settle`` takes rows from the best down in chunks of a line, whatever the length of
a chain of rows that touch each other.

``state_fold`` is for machines whose state runs through a whole timeline. The
timeline is cut into chunks which run at the same time from a guessed entry
state; chunks whose guess differs from the state their predecessor ended with
run again, until all agree. The result equals the sequential run.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from courtflow.functions.sequences import CHUNK, HOME, chunk_of
from courtflow.session import cut_lineage


def _rows(batch: pa.RecordBatch, names: Sequence[str]) -> list[tuple]:
    """Values of some columns row by row; not-a-number counts as unknown."""
    columns = []
    for name in names:
        column = batch.column(name)
        values = column.to_pylist()
        columns.append([None if v != v else v for v in values] if pa.types.is_floating(column.type) else values)
    return list(zip(*columns, strict=True))


def _appended(batch: pa.RecordBatch, results: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    """``batch`` untouched, with one more column for every field."""
    columns = zip(*results, strict=True) if results else [()] * len(fields)
    arrays = [pa.array(list(values), field.type) for values, field in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *fields.names])


def sorted_fold(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence,
    machine: Callable[[], Any],
    inputs: Sequence[str],
    outputs: str,
) -> DataFrame:
    """Append ``outputs`` computed by ``machine().step(*inputs)`` row by row.

    A fresh machine starts at every new value of ``group``. Other columns pass
    through as they are.
    """
    group, inputs = list(group), list(inputs)
    added = T._parse_datatype_string(outputs)
    fields = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            results = []
            for key, row in zip(_rows(batch, group), _rows(batch, inputs), strict=True):
                if key != current:
                    current, state = key, machine()
                results.append(state.step(*row))
            yield _appended(batch, results, fields)

    ordered = df.repartition(*group).sortWithinPartitions(*group, *order)
    return ordered.mapInArrow(run, T.StructType([*df.schema.fields, *added.fields]))


def group_fold(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence,
    decide: Callable[[list[tuple]], Iterator[tuple]],
    inputs: Sequence[str],
    outputs: str,
) -> DataFrame:
    """Rows ``(*group, *outputs)`` that ``decide`` makes of a group's ``inputs``, in order.

    A task holds the rows of one group; groups are small things like a frame.
    """
    group, inputs = list(group), list(inputs)
    schema = T.StructType([*[df.schema[g] for g in group], *T._parse_datatype_string(outputs).fields])
    fields = to_arrow_schema(schema)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), fields, strict=True)], fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, [], []
        for batch in batches:
            for key, row in zip(_rows(batch, group), _rows(batch, inputs), strict=True):
                if key != current:
                    out += [(*current, *x) for x in decide(held)] if held else []
                    current, held = key, []
                held.append(row)
            if len(out) >= 10_000:
                yield made(out)
                out = []
        out += [(*current, *x) for x in decide(held)] if held else []
        if out:
            yield made(out)

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def state_fold(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    order: Sequence[str],
    machine: Callable[[Any], Any],
    inputs: Sequence[str],
    outputs: str,
    size: int,
    max_rounds: int | None = None,
    entries: Callable[..., tuple[bool, list]] | None = None,
    tail: int = 0,
) -> DataFrame:
    """Run ``machine(state)`` along each timeline; see the module text.

    ``entries(*inputs)`` lists the states that a row can leave behind, and whether they
    are all that are possible from there on. Where the guessed entry was wrong, every
    chunk is then walked from all states that the last ``tail`` positions before it can
    leave; walks that meet go on as one. What comes out is the chunk as a table from
    entry to end, and a pass over one row per chunk puts these tables one after the
    other: all entries are known at once, and chunks run again once, not one by one.

    ``machine`` takes a plain picklable state (``None`` at the start), offers
    ``step(*inputs)`` for a row and ``state()`` for what it carries on, or
    ``state_at(position)`` for what of it still matters from there on; where that is
    ``None``, the next chunk's guess was right. A later round reads and writes only the chunks that run again; a table with one row
    per chunk tells which round of a chunk holds. A state is written once per chunk, not beside each row, and may be large.
    """
    keys, inputs = list(keys), list(inputs)
    added = T._parse_datatype_string(outputs)
    names = [f.name for f in added.fields]
    source = df.withColumn(CHUNK, chunk_of(position, size))
    base = source.schema.fields
    states = T.StructType([T.StructField("_used", T.BinaryType()), T.StructField("_end", T.BinaryType())])
    schema = T.StructType([*base, *added.fields, *states.fields])
    fields = to_arrow_schema(T.StructType([*added.fields, *states.fields]))
    group = [*keys, CHUNK]
    columns = [f.name for f in base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, used = None, None, None
        held, results = None, []  # the last batch waits until it is known whether its chunk goes on

        def end() -> tuple[bytes, bytes]:
            at = getattr(state, "state_at", None)
            return used, pickle.dumps(at((current[-1] + 1) * size) if at else state.state())

        for batch in batches:
            fresh, kept = [], []
            for key, row, (entry,) in zip(_rows(batch, group), _rows(batch, inputs), _rows(batch, ["_entry"]), strict=True):
                if key != current:
                    rows_before = fresh or results
                    if rows_before and rows_before[-1][-1] is None:
                        rows_before[-1] = (*rows_before[-1][:-2], *end())
                    current, used = key, entry or pickle.dumps(None)
                    state = machine(pickle.loads(used))
                kept.append(entry is None)
                if entry is None:
                    fresh.append((*state.step(*row), None, None))
            if not fresh:
                continue
            if held is not None:
                yield _appended(held, results, fields)
            held, results = batch.drop_columns(["_entry"]).filter(pa.array(kept)), fresh
        if held is not None:
            results[-1] = (*results[-1][:-2], *end())
            yield _appended(held, results, fields)

    def one_round(rows: DataFrame, entered: DataFrame | None = None) -> DataFrame:
        """Run chunks, each from its row in ``entered``, which stands before the chunk's own rows."""
        rows = rows.withColumn("_entry", F.lit(None).cast("binary"))
        if entered is not None:
            rows = rows.unionByName(entered.select(*group, "_entry"), allowMissingColumns=True)
        ordered = rows.repartition(*group).sortWithinPartitions(*group, F.col("_entry").isNull(), position, *order)
        return cut_lineage(ordered.mapInArrow(run, schema))

    def ends_of(part: DataFrame, number: int) -> DataFrame:
        ends = part.filter(F.col("_end").isNotNull()).groupBy(*group).agg(F.first("_end").alias("_end"), F.first("_used").alias("_used"))
        return ends.withColumn("_round", F.lit(number))

    key_fields = to_arrow_schema(T.StructType([source.schema[k] for k in group]))
    table_type = T._parse_datatype_string("ways array<struct<entry:binary,end:binary>>")

    def walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's end for each state that the rows before it can leave."""
        current, guesses, walks = None, {}, None

        def ended() -> pa.RecordBatch:
            ways = []
            for walker, begun in walks:
                at = getattr(walker, "state_at", None)
                end = pickle.dumps(at((current[-1] + 1) * size) if at else walker.state())
                ways += [{"entry": b, "end": end} for b in begun]
            arrays = [pa.array([v], f.type) for v, f in zip(current, key_fields, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([ways], to_arrow_schema(table_type)[0].type)], [*group, "ways"])

        for batch in batches:
            for key, row, (lead,) in zip(_rows(batch, group), _rows(batch, inputs), _rows(batch, ["_lead"]), strict=True):
                if key != current:
                    if walks:
                        yield ended()
                    current, guesses, walks = key, {}, None
                if lead:
                    alone, states = entries(*row)
                    guesses = ({} if alone else guesses) | {pickle.dumps(x): x for x in states}
                    continue
                if walks is None:
                    walks = [(machine(x), [b]) for b, x in guesses.items()]
                for walker, _ in walks:
                    walker.step(*row)
                if len(walks) > 1:
                    met: dict = {}
                    for walker, begun in walks:
                        met.setdefault(pickle.dumps(walker.state()), (walker, []))[1].extend(begun)
                    walks = list(met.values())
        if walks:
            yield ended()

    def composed() -> DataFrame:
        """The entry of each chunk that follows from the tables of those before, where it is not the first guess."""
        rows = parts[0].select(*columns)
        lead = rows.filter(F.col(position) >= (F.col(CHUNK) + 1) * size - tail).withColumn(CHUNK, F.col(CHUNK) + 1)
        both = rows.withColumn("_lead", F.lit(False)).unionByName(lead.withColumn("_lead", F.lit(True)))
        ordered = both.repartition(*group).sortWithinPartitions(*group, position, *order)
        tables = ordered.mapInArrow(walk_all, T.StructType([*[source.schema[k] for k in group], *table_type.fields]))
        chunks = ends.join(tables, group, "left")
        known = sorted_fold(chunks, keys, [CHUNK], _Compose, ("_used", "_end", "ways"), "_entry binary")
        return known.filter(F.col("_entry").isNotNull() & ~F.col("_entry").eqNullSafe(F.col("_used"))).select(*group, "_entry")

    parts = [one_round(source)]
    ends = cut_lineage(ends_of(parts[0], 0))
    while True:
        wanted = ends.withColumn("_want", F.lag("_end").over(W.partitionBy(*keys).orderBy(CHUNK)))
        stale = wanted.filter(F.col("_want").isNotNull() & ~F.col("_want").eqNullSafe(F.col("_used"))).select(
            *group, F.col("_want").alias("_entry")
        )
        stale = cut_lineage(stale)
        if stale.isEmpty():
            break
        if entries is not None and len(parts) == 1:
            stale = cut_lineage(composed())
        if max_rounds is not None and len(parts) >= max_rounds:
            raise RuntimeError("chunk states did not settle")
        parts.append(one_round(parts[0].select(*columns).join(stale.select(*group), group, "left_semi").select(*columns), stale))
        redone = ends_of(parts[-1], len(parts) - 1)
        ends = cut_lineage(ends.join(stale.select(*group), group, "left_anti").unionByName(redone))
    result = None
    for number, part in enumerate(parts):
        held = part.select(*columns, *names) if len(parts) == 1 else part.select(*columns, *names).join(
            ends.filter(F.col("_round") == number).select(*group), group, "left_semi"
        )
        result = held if result is None else result.unionByName(held)
    return result.drop(CHUNK)


class _Compose:
    """Follows the chunks of a timeline through their tables from entry to end."""

    def __init__(self) -> None:
        self.entry: bytes | None = pickle.dumps(None)

    def step(self, used: bytes, end: bytes, ways: Any) -> tuple:
        entry, table = self.entry, {w["entry"]: w["end"] for w in ways or ()} | {used: end}
        # Where the way in is unknown, the way out still is if all known ones lead there.
        self.entry = table.get(entry) if entry is not None else end if len(set(table.values())) == 1 else None
        return (entry,)


OPEN, TAKEN, GONE = 0, 1, 2
STATE, _NEW = "_state", "_new"


def settle(
    df: DataFrame,
    keys: Sequence[str],
    low: Column,
    high: Column,
    reach: float,
    size: float,
    order: Sequence,
    machine: Callable[[], Any],
    inputs: Sequence[str],
    outputs: str = "",
) -> DataFrame:
    """Take rows from the best down, where only better rows near a row can bar it.

    Two rows can touch only if ``[low - reach, high + reach]`` of one meets
    ``[low, high]`` of the other. The line is cut into chunks of ``size``; a row is at
    home in the chunk of ``low`` and a guest in the others within its reach. Every
    chunk runs through its rows in ``order``: ``machine().step(home, state, *inputs)``
    gives TAKEN, GONE or OPEN (and ``outputs``), OPEN for guests not yet decided and
    for whatever hangs on an open row. Only chunks that are left with open rows run
    again, with what was taken near them. The best open row hangs on none, so every
    round decides some; a round is needed only where a string of decisions crosses
    from chunk to chunk. No task holds more than a chunk and its guests.

    Returns the rows with ``taken`` and ``outputs``.
    """
    keys, inputs = list(keys), list(inputs)
    columns = df.columns
    more = [f.name for f in T._parse_datatype_string(outputs).fields] if outputs else []

    def spread(rows: DataFrame) -> DataFrame:
        first, last = chunk_of(F.col("_low") - reach, size), chunk_of(F.col("_high") + reach, size)
        return rows.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(HOME, F.col(CHUNK) == chunk_of("_low", size))

    def one_round(rows: DataFrame) -> DataFrame:
        out = sorted_fold(rows, [*keys, CHUNK], order, machine, (HOME, STATE, *inputs), f"{_NEW} int" + (f", {outputs}" if outputs else ""))
        mine = out.filter(F.col(HOME) & (F.col(STATE) == OPEN))
        return cut_lineage(mine.select(*columns, "_low", "_high", F.col(_NEW).alias(STATE), *more))

    parts = [one_round(spread(df.withColumn("_low", low).withColumn("_high", high).withColumn(STATE, F.lit(OPEN))))]
    while True:
        left = parts[-1].filter(F.col(STATE) == OPEN)
        if left.isEmpty():
            break
        parts[-1] = parts[-1].filter(F.col(STATE) != OPEN)
        rows = left.select(*columns, "_low", "_high", STATE)
        for part in parts:
            rows = rows.unionByName(part.filter(F.col(STATE) == TAKEN).select(*columns, "_low", "_high", STATE))
        busy = left.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], chunk_of("_low", size).alias("_at")).distinct()
        near = F.col(CHUNK) == F.col("_at")
        for i, k in enumerate(keys):
            near = near & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        parts.append(one_round(spread(rows).join(busy, near, "left_semi")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select(*columns, (F.col(STATE) == TAKEN).alias("taken"), *more)


class GreedyPairs:
    """One-to-one matching in one go: take a proposal if neither side is taken yet."""

    def __init__(self) -> None:
        self.left: set = set()
        self.right: set = set()

    def step(self, left: Any, right: Any) -> tuple[bool]:
        if left in self.left or right in self.right:
            return (False,)
        self.left.add(left)
        self.right.add(right)
        return (True,)


class SettlePairs:
    """One-to-one matching for ``settle``."""

    def __init__(self) -> None:
        self.left: dict = {}
        self.right: dict = {}

    def step(self, home: bool, state: int, left: Any, right: Any) -> tuple[int]:
        found = {self.left.get(left), self.right.get(right)}
        if state == OPEN:
            state = GONE if TAKEN in found else OPEN if OPEN in found or not home else TAKEN
        if state == TAKEN or (state == OPEN and TAKEN not in found):
            # What is open may still go; a later taken partner overrides it.
            self.left[left] = max(state, self.left.get(left, OPEN))
            self.right[right] = max(state, self.right.get(right, OPEN))
        return (state,)


class SettleApart:
    """Suppression on a line for ``settle``: a row goes if a better one that stays is nearer than allowed."""

    def __init__(self, distance: float, inclusive: bool) -> None:
        self.distance, self.inclusive = distance, inclusive
        self.width = max(distance, 1e-12)
        self.cells: dict[int, list[tuple[float, int]]] = {}

    def step(self, home: bool, state: int, position: float) -> tuple[int]:
        cell = int(position // self.width)
        if state == OPEN:
            found = set()
            for c in range(cell - 1, cell + 2):
                for other, kind in self.cells.get(c, ()):
                    apart = abs(position - other)
                    if apart < self.distance or (self.inclusive and apart == self.distance):
                        found.add(kind)
            state = GONE if TAKEN in found else OPEN if OPEN in found or not home else TAKEN
        if state != GONE:
            self.cells.setdefault(cell, []).append((position, state))
        return (state,)
