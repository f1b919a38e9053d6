"""Document fingerprints by consistent weighted sampling.

A document is a bag of words with counts as weights.  For every sample k and word
w, three variates come from a hash of (k, w) alone: r and c from Gamma(2, 1), b
from the unit interval.  With weight x the word is quantised to
``t = floor(ln x / r + b)`` and gets ``ln a = ln c - r (t - b) - r``; the sample is
the pair (w, t) of least a.  Two documents agree in a sample with a probability
that equals their generalised Jaccard similarity, the sum of the lesser weights
over the sum of the greater.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from courtflow.llm import kernels as K
from courtflow.llm.blocks import Blocks, in_order

#: Samples of a fingerprint; an estimate's standard error is at most a sixteenth.
SAMPLES = 64
#: Texts whose words are sampled together, so that their arrays stay in the cache.
GROUP = 64
#: Characters of texts that are worked on together, besides as much again of edited texts.
PIECE = 1 << 20


def weighted_words(text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of every text, their counts, and the bounds of the texts."""
    data, offsets = K.text_bytes(text)
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets, K.SPACE)
    hashes = K.span_hash(K.prefix_sums(data), starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes[a:b].sort()
    begins = np.ones(len(hashes), bool)
    begins[1:] = hashes[1:] != hashes[:-1]
    begins[first[first < len(hashes)]] = True
    at = np.flatnonzero(begins)
    return hashes[at], np.diff(np.append(at, len(hashes))), np.searchsorted(at, first)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in (0, 1) from each 64-bit value."""
    scale, half = np.float32(2.0**-32), np.float32(2.0**-33)
    return (x >> np.uint64(32)).astype(np.float32) * scale + half, (x & np.uint64(0xFFFFFFFF)).astype(np.float32) * scale + half


def _variates(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seeds = [np.uint64((3 * k + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(3)]
    (u1, u2), (u3, u4), (b, _) = (_unit(K.mix(words ^ s)) for s in seeds)
    return -np.log(u1 * u2), np.log(-np.log(u3 * u4)), b


def signatures(text) -> np.ndarray:
    """``SAMPLES`` 16-bit samples of every text; a text without words has zeros."""
    words, weights, bounds = weighted_words(text)
    out = np.zeros((len(bounds) - 1, SAMPLES), np.uint16)
    if not len(words):
        return out
    distinct, which, _ = K.grouped(words)
    logs = np.log(weights).astype(np.float32)
    groups = []
    for a in range(0, len(out), GROUP):
        rows = np.arange(a, min(a + GROUP, len(out)))
        rows = rows[bounds[rows + 1] > bounds[rows]]
        if len(rows):
            lo, hi = int(bounds[rows[0]]), int(bounds[rows[-1] + 1])
            groups.append((rows, slice(lo, hi), bounds[rows] - lo, np.diff(np.append(bounds[rows], hi))))
    for k in range(SAMPLES):
        r, log_c, b = _variates(distinct, k)
        for rows, own, begins, sizes in groups:
            at = which[own]
            ri, bi = r[at], b[at]
            t = np.floor(logs[own] / ri + bi)
            a = log_c[at] - ri * (t - bi) - ri
            least = np.repeat(np.minimum.reduceat(a, begins), sizes)
            hit = np.flatnonzero(a == least)
            hit = hit[np.searchsorted(hit, begins)]  # the first of each text
            out[rows, k] = K.mix(words[own][hit] ^ K.mix(t[hit].astype(np.int64).view(np.uint64) + np.uint64(k))).astype(np.uint16)
    return out


def likeness(x: np.ndarray, y: np.ndarray, x_empty: np.ndarray, y_empty: np.ndarray) -> np.ndarray:
    """Share of equal samples; two texts without words are alike, one of them and another text are not."""
    return np.where(x_empty | y_empty, (x_empty & y_empty).astype(float), (x == y).mean(axis=1))


def as_text(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def fingerprint(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns of every row with ``fingerprint``, a string of 16-bit hex samples; null counts as empty."""

    def of_batches(batches):
        for batch in K.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(as_text(signatures(batch.column("text"))))], [*carry, "fingerprint"])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(of_batches, docs.select(*carry).schema.add("fingerprint", "string"))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points (rounded down) replaced by as many of the following text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to it and to the next document's.

    Next: in ascending doc_id (null first; rows of one id by a hash of their
    texts); after the last comes the first.  Texts are shuffled once, in contiguous
    blocks that also get the first document of the block behind.  Null texts count
    as empty.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next; other columns are not read.
    """

    def of_block(table: pa.Table) -> pa.Table:
        guests = table.filter(pa.array(table.column("guest").to_numpy() > 0))
        own = in_order(table.filter(pa.array(table.column("guest").to_numpy() == 0)))
        texts = [t or "" for t in own.column("text").to_pylist()]
        if not texts:  # only a guest: another block holds its own row
            return pa.Table.from_pydict({f: [] for f in names}, schema=kind)
        texts.append(next((t or "" for t in in_order(guests).column("text").to_pylist()), texts[0]))
        ids, parts, a = own.column("doc_id").combine_chunks(), [], 0
        while a < len(texts) - 1:
            b, size = a + 1, len(texts[a])
            while b < len(texts) - 1 and size < PIECE:
                size += len(texts[b])
                b += 1
            parts.append(pa.Table.from_arrays([ids.slice(a, b - a), *of_texts(texts[a : b + 1])], schema=kind))
            a = b
        return pa.concat_tables(parts)

    def of_texts(texts: list[str]) -> list[pa.Array]:
        """Columns of all texts but the last, which only follows."""
        changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
        m = len(changed)
        prints = signatures(pa.array(texts + changed))
        empty = np.array([not t.strip(" \t\n\v\f\r") for t in texts + changed])
        mine, after, other = slice(0, m), slice(1, m + 1), slice(m + 1, None)
        shown = as_text(prints)
        return [
            pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(shown[mine]), pa.array(shown[other]),
            pa.array(likeness(prints[mine], prints[other], empty[mine], empty[other])), pa.array(likeness(prints[mine], prints[after], empty[mine], empty[after])),
        ]

    kind = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])
    names = kind.names
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return Blocks(docs, halo=True).rows.groupBy("block").applyInArrow(of_block, schema)
