"""Remove repeated byte strings with a difference cover and bucket-wise suffix sorting.

A window is the first ``WIDTH`` bytes of a suffix.  Sorting all suffixes of a
corpus would need many times its size; here only suffixes that can tie are sorted,
and long ties are settled as a whole.

1. Cover samples.  In every text the positions whose remainder modulo ``PERIOD``
   lies in ``COVER`` are sampled.  Any two positions reach sampled ones together
   within ``PERIOD`` steps, so two equal windows hold two equal sampled strings of
   ``SAMPLE`` bytes at one offset.  All blocks' sampled strings are ranked in
   buckets of the key space: is the rank held once or more often?  A suffix that
   reaches no shared rank ties with none for a whole window and drops out.
2. Suffix buckets.  Suffixes left over are put together by the least hash among
   the ``GRAM``-byte strings of their window, which equal windows have in common.
   Neighbouring suffixes with the same least string make a run.  A bucket sorts
   its runs by string, then by all bytes under the run: a run whose bytes an
   earlier block has ties with that run in all its windows, however long the tie
   is.  It also learns whether the string has runs with other bytes.
3. Only first runs of strings that have runs with other bytes, mostly the ends of
   matches, are sorted window by window, again bucket by bucket.
4. Every block marks the windows that start earlier, in itself or before it, and
   takes out the bytes under them.

Strings are compared by 64-bit fingerprints.  Memory is bound by a block of text
and a bucket of keys; a string in a third of all texts is sent once per block.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm import kernels as K
from courtflow.llm.blocks import KEYS_SCHEMA, Blocks, answers_in_order, ask, in_order, keys_table, send_keys
from courtflow.llm.tables import keep

WIDTH = 100
#: Differences of these eight give every remainder modulo 57.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
SAMPLE = WIDTH - PERIOD + 1
GRAM = 32
#: Answers about a run.
EARLIER, MIXED = 1, 2
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"


class _Block:
    """The bytes of a block in document order, and their windows."""

    def __init__(self, table: pa.Table, space: int):
        self.space = space
        self.table = in_order(table)
        self.number = table.column("block")[0].as_py()
        self.data, self.offsets = K.text_bytes(self.table.column("text"))
        self.prefix = K.prefix_sums(self.data)
        lengths = np.diff(self.offsets)
        place = np.arange(len(self.data), dtype=np.int32) - np.repeat(self.offsets[:-1].astype(np.int32), lengths)
        self.left = np.repeat(lengths.astype(np.int32), lengths) - place  # bytes up to the end of the text
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        self.sampled = np.flatnonzero(in_cover[place % PERIOD] & (self.left >= SAMPLE))

    def samples(self) -> np.ndarray:
        return K.window_hash(self.prefix, SAMPLE, self.sampled) >> np.uint64(64 - self.space)

    def suffixes(self, answer: pa.Table) -> np.ndarray:
        """Starts of the windows that reach a sample whose rank is shared."""
        keys, which, _ = K.grouped(self.samples())
        seen = np.zeros(len(self.data) + PERIOD + 1, np.int32)
        seen[self.sampled[answers_in_order(answer, len(keys))[which] > 0] + 1] = 1
        seen = np.cumsum(seen, dtype=np.int32)
        n = len(self.data)
        return np.flatnonzero((seen[PERIOD : PERIOD + n] > seen[:n]) & (self.left >= WIDTH))

    def runs(self, starts: np.ndarray) -> Runs:
        """Runs of neighbouring windows with the same least string."""
        if not len(starts):
            none = np.zeros(0, np.int64)
            return Runs(none, none, none.view(np.uint64), none.view(np.uint64))
        low = np.uint64((1 << max(1, len(self.data).bit_length())) - 1)
        least = K.window_hash(self.prefix, GRAM)
        least = (least & ~low) | np.arange(len(least), dtype=np.uint64)  # of equal strings the leftmost
        reach = WIDTH - GRAM + 1
        step = 1
        while 2 * step <= reach:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = np.minimum(least[: len(least) - (reach - step)], least[reach - step :])
        anchor = (least[starts] & low).astype(np.int64)
        begins = np.ones(len(starts), bool)
        begins[1:] = (np.diff(starts) != 1) | (np.diff(anchor) != 0)
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(starts)) - 1
        a, e = starts[first], starts[last] + WIDTH
        string = K.window_hash(self.prefix, GRAM, anchor[first])
        body = K.mix(K.span_hash(self.prefix, a, e) ^ K.mix((anchor[first] - a).astype(np.uint64)))
        return Runs(first, last + 1, string, body)


class Runs(NamedTuple):
    """Runs of windows: which they are, their least string, all their bytes."""

    first: np.ndarray
    end: np.ndarray
    string: np.ndarray
    body: np.ndarray

    def distinct(self, space: int):
        """Order of the runs by string and bytes, the first of each kind in it, and the kind of each place in the order."""
        string = self.string >> np.uint64(64 - space)
        order = np.lexsort((self.body, string))  # stable: equal runs stay in text order
        begins = np.ones(len(order), bool)
        begins[1:] = (string[order][1:] != string[order][:-1]) | (self.body[order][1:] != self.body[order][:-1])
        return order, np.flatnonzero(begins), np.cumsum(begins) - 1


def answer_of(table: pa.Table, size: int, step: str | None = None) -> np.ndarray:
    if step is not None:
        table = table.filter(pc.equal(table.column("step"), step))
    return answers_in_order(table, size)


def _repeated(keys, _, counts):
    order = np.argsort(keys, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(keys[order]) > 0) + 1])
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    out = np.zeros(len(keys), np.uint8)
    out[order] = np.repeat(total > 1, np.diff(np.append(first, len(keys))))
    return out


def _about_runs(keys, blocks, bodies):
    order = np.lexsort((bodies, keys))  # keys come in the order of their blocks
    string = np.ones(len(keys), bool)
    string[1:] = keys[order][1:] != keys[order][:-1]
    body = string.copy()
    body[1:] |= bodies[order][1:] != bodies[order][:-1]
    begins = np.flatnonzero(string)
    kinds = np.add.reduceat(body.astype(np.int64), begins)
    out = np.zeros(len(keys), np.uint8)
    out[order] = np.where(body, 0, EARLIER) | np.where(np.repeat(kinds, np.diff(np.append(begins, len(keys)))) > 1, MIXED, 0)
    return out


def _in_earlier_block(keys, blocks, _):
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.zeros(len(keys), np.uint8)
    out[order[1:]] = ranked[1:] == ranked[:-1]  # a block sends a key once
    return out


def remove_repeats(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """Remove every byte under a ``WIDTH``-byte string that also starts earlier.

    Earlier: in a document with a smaller doc_id, or before it in the same one.
    Strings are judged on the input and never cross documents.  Null texts count
    as empty, shorter texts are kept whole.  Null doc_ids stand first; rows that
    share a doc_id stand in the order of a hash of their texts.  Returns doc_id,
    n_bytes, n_removed, spans (maximal removed runs as byte offsets), kept_sha256
    and, if ``with_kept``, the kept bytes (they may end within a code point).
    Other columns are not read.
    """
    blocks = Blocks(docs)
    bits = blocks.buckets_for(len(COVER) / PERIOD)
    space = bits + 32
    own_bits = blocks.buckets_for(0.1)

    texts = blocks.rows.groupBy("block")

    def send_samples(table: pa.Table) -> pa.Table:
        block = _Block(table, space)
        keys, counts = K.distinct(block.samples())
        return keys_table(send_keys(block.number, keys, space, bits, np.minimum(counts, 255).astype(np.uint8)))

    ranks = keep(ask(texts.applyInArrow(send_samples, KEYS_SCHEMA), _repeated, space, bits).withColumn("step", F.lit("ranks")))

    def send_runs(table: pa.Table, answer: pa.Table) -> pa.Table:
        block = _Block(table, space)
        runs = block.runs(block.suffixes(answer))
        order, kinds, _ = runs.distinct(space)
        chosen = order[kinds]
        return keys_table(send_keys(block.number, runs.string[chosen] >> np.uint64(64 - space), space, bits, runs.body[chosen]))

    asked = texts.cogroup(ranks.groupBy("block")).applyInArrow(send_runs, KEYS_SCHEMA)
    about_runs = keep(ask(asked, _about_runs, space, bits, np.uint64).withColumn("step", F.lit("runs")))
    known = ranks.union(about_runs)

    def settle(block: _Block, answer: pa.Table):
        """Starts of all windows left, which of them are known to start earlier, and which are to be sorted one by one."""
        starts = block.suffixes(answer.filter(pc.equal(answer.column("step"), "ranks")))
        runs = block.runs(starts)
        order, kinds, kind = runs.distinct(space)
        got = answer_of(answer, len(kinds), "runs")
        of_run = np.zeros(len(order), np.uint8)
        of_run[order] = got[kind]
        again = np.ones(len(order), bool)
        again[order[kinds]] = False  # the first of its kind in the block
        sizes = runs.end - runs.first
        earlier = (of_run & EARLIER > 0) | again
        return starts, np.repeat(earlier, sizes), np.flatnonzero(np.repeat(~earlier & (of_run & MIXED > 0), sizes))

    def send_suffixes(table: pa.Table, answer: pa.Table) -> pa.Table:
        block = _Block(table, space)
        starts, _, single = settle(block, answer)
        return keys_table(send_keys(block.number, K.distinct(K.window_hash(block.prefix, WIDTH, starts[single]))[0], 64, own_bits))

    suffixes = texts.cogroup(known.groupBy("block")).applyInArrow(send_suffixes, KEYS_SCHEMA)
    answers = known.union(ask(suffixes, _in_earlier_block, 64, own_bits).withColumn("step", F.lit("suffixes")))

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        block = _Block(table, space)
        starts, earlier, single = settle(block, answer)
        windows = K.window_hash(block.prefix, WIDTH, starts[single])
        keys, which, first = K.grouped(windows)
        before = answer_of(answer, len(keys), "suffixes")
        earlier[single] = (before[which] > 0) | (first[which] != np.arange(len(windows)))
        starts = starts[earlier]
        steps = np.zeros(len(block.data) + WIDTH + 1, np.int64)
        steps[starts] += 1
        steps[starts + WIDTH] -= 1
        gone = np.cumsum(steps)[: len(block.data)] > 0
        rows = []
        # Runs end where a text ends.
        edge = np.zeros(len(gone) + 1, bool)
        edge[block.offsets] = True
        begins = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]])))
        ends = np.flatnonzero(gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))) + 1
        bounds = np.searchsorted(begins, block.offsets)
        for i, doc_id in enumerate(block.table.column("doc_id").to_pylist()):
            a, b = int(block.offsets[i]), int(block.offsets[i + 1])
            spans = [(int(x) - a, int(y) - a) for x, y in zip(begins[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]], strict=True)]
            kept = block.data[a:b][~gone[a:b]].tobytes() if spans else block.data[a:b].tobytes()
            rows.append({
                "doc_id": doc_id, "n_bytes": b - a, "n_removed": b - a - len(kept), "spans": [{"start": x, "end": y} for x, y in spans],
                "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_kept else None,
            })
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.Table.from_pylist(rows, pa.schema([
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept_sha256", pa.string()), ("kept", pa.binary()),
        ]))

    out = texts.cogroup(answers.groupBy("block")).applyInArrow(cut, RESULT)
    return out if with_kept else out.drop("kept")
