"""Blocks of documents and questions about keys that span all of them.

Documents stand in one order (doc_id, null first, then a hash of the text) and
are cut into contiguous blocks of about equal bytes.  A block fits in a task, and
a lower block number means earlier documents.

A key question is answered in two shuffles.  Every block sends its distinct keys,
packed into one array per bucket of the key space; so a key in a third of all
documents is sent once per block.  A bucket sees all blocks' arrays, works out
one byte per key and sends it back in the order in which it came.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.sharding import prefix_sums
from courtflow.llm.tables import n_bytes

#: Text bytes in a block; a task that works on one needs some tens of times as much.
BLOCK_BYTES = 4 << 20
#: Keys that a bucket should hold at most.
BUCKET_KEYS = 3_000_000
KEYS_SCHEMA = "bucket int, block int, keys binary, more binary"
ANSWERS_SCHEMA = "block int, bucket int, answer binary"


class Blocks:
    """``rows``: doc_id, text, tie, block and ``extra`` columns; ``count`` blocks of ``total`` bytes in all."""

    def __init__(self, docs: DataFrame, extra: tuple[str, ...] = (), halo: bool = False, block_bytes: int | None = None):
        block_bytes = block_bytes or BLOCK_BYTES
        sized = docs.select("doc_id", F.xxhash64("text").alias("tie"), (n_bytes() + F.lit(64)).alias("size"))
        placed, self.total = prefix_sums(sized, ["doc_id", "tie"], "size")
        firsts = (
            placed.withColumn("block", F.call_function("div", F.col("start"), F.lit(block_bytes)))
            .groupBy("block")
            .agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("first"))
        )
        # One row per block: 32 bytes for every four megabytes of text.
        bounds = sorted({(r.first.known, r.first.doc_id or 0, r.first.tie) for r in firsts.select("first").collect()})
        self.count = max(1, len(bounds))

        @F.udf("array<int>")
        def block_of(doc_id, tie):
            key = (doc_id is not None, doc_id or 0, tie)
            at = max(0, bisect.bisect_right(bounds, key) - 1)
            return [at, (at - 1) % len(bounds)] if halo and bounds[at] == key else [at]

        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), *extra)
        if halo:
            rows = rows.withColumn("at", block_of("doc_id", "tie"))
            rows = rows.select("*", F.posexplode("at").alias("guest", "block")).drop("at")
        else:
            rows = rows.withColumn("block", block_of("doc_id", "tie")[0])
        self.rows = rows

    def buckets_for(self, per_byte: float) -> int:
        """Bits of the bucket number for so many keys per byte of text."""
        return max(2, int(np.ceil(np.log2(max(1.0, self.total * per_byte / BUCKET_KEYS)))))


def packed(values: np.ndarray, width: int) -> bytes:
    """Unsigned values in ``width`` bytes each, as planes, highest byte first, which compress well when sorted."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(planes.T[::-1]).tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes[::-1].T
    return out.reshape(-1).view("<u8").copy()


def send_keys(block: int, keys: np.ndarray, space: int, bits: int, more: np.ndarray | None = None) -> list[dict]:
    """Rows for ``KEYS_SCHEMA``: sorted keys below 2**``space``, cut by their leading ``bits``."""
    width = (space - bits + 7) // 8
    cuts = np.searchsorted(keys >> np.uint64(space - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [
        {"bucket": k, "block": block, "keys": packed(keys[a:b], width), "more": more[a:b].tobytes() if more is not None else None}
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        if a < b
    ]


def keys_table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())]))


def ask(keys: DataFrame, answer: Callable[[np.ndarray, np.ndarray, np.ndarray | None], np.ndarray], space: int, bits: int, kind: type = np.uint8) -> DataFrame:
    """Answer the keys of all blocks: ``answer(keys, block of each, more)`` gives one byte for each key of one bucket.

    Keys come without their leading ``bits``, which are those of the bucket, or
    with some of them; ``kind`` is the type of what was sent with each key.
    """
    width = (space - bits + 7) // 8

    def of_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        parts = [unpacked(k, width) for k in pdf["keys"]]
        sizes = np.array([len(p) for p in parts])
        more = None if pdf["more"].isna().any() else np.concatenate([np.frombuffer(m, kind) for m in pdf["more"]])
        got = answer(np.concatenate(parts), np.repeat(pdf["block"].to_numpy(np.int64), sizes), more).astype(np.uint8)
        ends = np.cumsum(sizes)
        return pd.DataFrame({
            "block": pdf["block"].to_numpy(), "bucket": pdf["bucket"].to_numpy(),
            "answer": [got[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)],
        })

    return keys.groupBy("bucket").applyInPandas(of_bucket, ANSWERS_SCHEMA)


def answers_in_order(table: pa.Table, size: int) -> np.ndarray:
    """One byte per key of a block, in the order of the keys that it sent."""
    if not table.num_rows:
        return np.zeros(size, np.uint8)
    order = np.argsort(table.column("bucket").to_numpy())
    parts = table.column("answer").to_pylist()
    return np.concatenate([np.frombuffer(parts[i], np.uint8) for i in order])


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a block in document order."""
    known = table.column("doc_id").is_valid().to_numpy()
    ids = table.column("doc_id").fill_null(0).to_numpy()
    return table.take(pa.array(np.lexsort((table.column("tie").to_numpy(), ids, known))))
