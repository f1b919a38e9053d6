"""Remove lines that repeat an earlier line, give or take one word.

Two lines are within the bound if they have the same words, or, with at least
``EDIT_FROM`` words each, if one word put in, left out or changed makes them the
same.  Deletion neighbourhood: two lines within one edit agree after leaving out
at most one word each, so each line is keyed by itself and by all variants
without one word.  A changed word leaves equal variants with the gap at the same
place of equally long lines; a word put in or left out makes one line's variant
the other line.  Keys carry place and length, so equal keys verify the distance
(up to collisions of 64-bit fingerprints), all lines of a key are within the
bound of each other, and the earliest holder of a key decides for all: no pairs
are listed.

Variants are emitted only for lines that can have a partner: one edit leaves the
first or the second half of a line alone, so a line shares such a half with its
partner.  Keys are looked up block by block (see ``blocks``).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm import kernels as K
from courtflow.llm.blocks import KEYS_SCHEMA, Blocks, answers_in_order, ask, in_order, keys_table, send_keys
from courtflow.llm.tables import keep

EDIT_FROM = 5
#: What a key is held as: a whole line, a line without one word.
WHOLE, VARIANT = 1, 2
RESULT = "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept string"


class _Lines:
    """The lines of a block in document order."""

    def __init__(self, table: pa.Table):
        self.table = in_order(table)
        self.number = table.column("block")[0].as_py()
        self.data, self.offsets = K.text_bytes(self.table.column("text"))
        has_text = self.offsets[:-1][np.diff(self.offsets) > 0]
        self.starts = np.unique(np.concatenate([has_text, np.flatnonzero(self.data == 10) + 1]))
        # A line break that ends a text is followed by an empty line of that text.
        self.owner = np.searchsorted(self.offsets, self.starts, "left") - 1
        at_start = np.isin(self.starts, has_text)
        self.owner[at_start] = np.searchsorted(self.offsets, self.starts[at_start], "right") - 1
        if len(self.data):
            ends_broken = has_text[1:][self.data[has_text[1:] - 1] == 10] if len(has_text) > 1 else has_text[:0]
            if len(ends_broken):  # such an empty line starts where the next text does
                again = np.searchsorted(self.starts, ends_broken)
                self.owner = np.insert(self.owner, again, np.searchsorted(self.offsets, ends_broken - 1, "right") - 1)
                self.starts = np.insert(self.starts, again, ends_broken)
        begins, ends, _ = K.words(self.data, self.offsets, K.SPACE)
        self.values = K.span_hash(K.prefix_sums(self.data), begins, ends)
        self.first = np.searchsorted(begins, np.append(self.starts, len(self.data)))
        power, self.inverse = K._power_tables(len(self.values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values * power[: len(self.values)])])
        self.sizes = np.diff(self.first)
        self.whole = self._key(self.first[:-1], self.first[1:], self.sizes)

    def _key(self, a, b, salt, kind: int = 0):
        return K.mix((self.sums[b] - self.sums[a]) * self.inverse[a] + K.mix(salt.astype(np.uint64) * np.uint64(8) + np.uint64(kind)))

    def first_ones(self) -> np.ndarray:
        """Which lines have words and are the first of their kind in the block."""
        out = np.zeros(len(self.sizes), bool)
        some = np.flatnonzero(self.sizes > 0)
        out[some[K.grouped(self.whole[some])[2]]] = True
        return out

    def halves(self, lines: np.ndarray) -> np.ndarray:
        """Four keys per line: its halves as one of its own length, and of the length below."""
        a, b = self.first[lines], self.first[lines + 1]
        out = []
        for c in (b - a, b - a - 1):
            out += [self._key(a, a + c // 2, c, 1), self._key(b - (c - c // 2), b, c, 2)]
        return np.column_stack(out)

    def variants(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the lines, what they are held as, and the lines they belong to."""
        n = self.sizes[lines]
        of = np.repeat(lines, n)
        a, b = self.first[of], self.first[of + 1]
        i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + a
        left, right = self.sums[i] - self.sums[a], self.sums[b] - self.sums[i + 1]
        size, place = (b - a).astype(np.uint64), (i - a).astype(np.uint64)
        changed = K.mix((left + right) * self.inverse[a] + K.mix((size * np.uint64(1 << 32) + place) * np.uint64(8) + np.uint64(3)))
        less = K.mix(left * self.inverse[a] + right * self.inverse[a + 1] + K.mix((size - np.uint64(1)) * np.uint64(8)))
        keys = np.concatenate([self.whole[lines], less, changed])
        roles = np.repeat(np.array([WHOLE, VARIANT, WHOLE | VARIANT], np.uint8), [len(lines), len(less), len(changed)])
        return keys, roles, np.concatenate([lines, of, of])


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    begins = np.ones(len(keys), bool)
    begins[1:] = keys[order][1:] != keys[order][:-1]
    return order, np.flatnonzero(begins), np.cumsum(begins) - 1


def _shared_or_earlier(keys, _, counts):
    """1: another line has the key; 2: one of an earlier block."""
    order, first, group = _grouped(keys)
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    out = np.zeros(len(keys), np.uint8)
    out[order] = (total > 1)[group] | ((np.arange(len(keys)) != first[group]) * np.uint8(2))
    return out


def _held_earlier(keys, blocks, roles):
    """Bits of what earlier blocks hold the key as."""
    order, first, group = _grouped(keys)
    out = np.zeros(len(keys), np.uint8)
    for role in (WHOLE, VARIANT):
        least = np.minimum.reduceat(np.where(roles[order] & role, blocks[order], np.iinfo(np.int64).max), first)
        out[order] |= (least[group] < blocks[order]).astype(np.uint8) * np.uint8(role)
    return out


def remove_similar_lines(docs: DataFrame, with_kept: bool = True) -> DataFrame:
    """Remove every line within the bound of an earlier one, be that one kept or not.

    Lines end at line breaks, their words at ASCII white space; earlier means in a
    document with a smaller doc_id (null first, rows of one id by a hash of their
    texts) or above it.  Lines without words stay.  Returns doc_id, n_lines (0 for
    null and empty texts), n_removed, kept_sha256 and, if ``with_kept``, the kept
    lines joined by line breaks.  Other columns are not read.
    """
    blocks = Blocks(docs)
    bits, own_bits = blocks.buckets_for(0.02), blocks.buckets_for(0.1)

    def half_keys(lines: _Lines):
        fresh = np.flatnonzero(lines.first_ones())
        long = fresh[lines.sizes[fresh] >= EDIT_FROM]
        halves = lines.halves(long)
        keys, at, _ = K.grouped(np.concatenate([lines.whole[fresh], halves.reshape(-1)]))
        return fresh, long, keys, at, np.bincount(at, minlength=len(keys))

    def send_halves(table: pa.Table) -> pa.Table:
        lines = _Lines(table)
        _, _, keys, _, counts = half_keys(lines)
        return keys_table(send_keys(lines.number, keys, 64, bits, np.minimum(counts, 255).astype(np.uint8)))

    asked = blocks.rows.groupBy("block").applyInArrow(send_halves, KEYS_SCHEMA)
    shared = keep(ask(asked, _shared_or_earlier, 64, bits))

    def candidates(lines: _Lines, answer: pa.Table):
        """Which lines repeat one word for word, and the others that may be near one."""
        fresh, long, keys, at, _ = half_keys(lines)
        got = answers_in_order(answer, len(keys))[at]
        repeated = lines.sizes > 0
        repeated[fresh] = (got[: len(fresh)] & 2) > 0
        near = (got[len(fresh) :].reshape(-1, 4) & 1).any(axis=1)
        return repeated, long[near & ~repeated[long]]

    def send_variants(table: pa.Table, answer: pa.Table) -> pa.Table:
        lines = _Lines(table)
        keys, roles, _ = lines.variants(candidates(lines, answer)[1])
        order, first, _ = _grouped(keys)
        if not len(keys):
            return keys_table([])
        return keys_table(send_keys(lines.number, keys[order][first], 64, own_bits, np.bitwise_or.reduceat(roles[order], first)))

    texts = blocks.rows.groupBy("block")
    variants = texts.cogroup(shared.groupBy("block")).applyInArrow(send_variants, KEYS_SCHEMA)
    earlier = ask(variants, _held_earlier, 64, own_bits)
    both = shared.withColumn("of_variants", F.lit(False)).union(earlier.withColumn("of_variants", F.lit(True)))

    def cut(table: pa.Table, answer: pa.Table) -> pa.Table:
        lines = _Lines(table)
        of_variants = answer.column("of_variants").to_numpy()
        gone, near = candidates(lines, answer.filter(pa.array(~of_variants)))
        keys, roles, of = lines.variants(near)
        if len(keys):
            order, first, group = _grouped(keys)
            before = answers_in_order(answer.filter(pa.array(of_variants)), len(first))[group]
            own, line = roles[order], of[order]
            for mine, theirs in ((VARIANT, WHOLE), (WHOLE, VARIANT)):
                least = np.minimum.reduceat(np.where(own & theirs, line, np.iinfo(np.int64).max), first)[group]
                hit = ((own & mine) > 0) & (((before & theirs) > 0) | (least < line))
                gone[line[hit]] = True
        bounds = np.searchsorted(lines.owner, np.arange(lines.table.num_rows + 1))
        rows = []
        for i, doc_id in enumerate(lines.table.column("doc_id").to_pylist()):
            a, b = int(bounds[i]), int(bounds[i + 1])
            lost = gone[a:b]
            text = lines.data[lines.offsets[i] : lines.offsets[i + 1]].tobytes()
            if lost.any():
                text = b"\n".join(x for x, g in zip(text.split(b"\n"), lost.tolist(), strict=True) if not g)
            rows.append({"doc_id": doc_id, "n_lines": b - a, "n_removed": int(lost.sum()), "kept_sha256": hashlib.sha256(text).hexdigest(), "kept": text.decode() if with_kept else None})
        return pa.Table.from_pylist(rows, pa.schema([
            ("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()),
        ]))

    out = texts.cogroup(both.groupBy("block")).applyInArrow(cut, RESULT)
    return out if with_kept else out.drop("kept")
