"""The trie of conversation prefixes, from vertical bitmaps.

Conversations are dealt into shards by a hash of their id.  A shard indexes every
(position, turn) with the set of its conversations that have this turn there, as the
bits of one number.  A depth-first walk meets a node's set with postings: the turn
of the least conversation left names the posting, the intersection is a child, and
its conversations are struck out, so there is one intersection per node.  Popcounts
are the members, and the conversations that end at a node are its end list.

A node is named by a hash of its turns, so the shards' nodes are added up by name.
Sums over subtrees go back through the shards: a node's value is given to the one
shard that holds its smallest member, and that conversation passes through all nodes
above, so every shard sums what it was given along its own tree.

A shard holds some 40 bytes a turn and never a text; the longest conversation must
fit in a task this way.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm.tables import keep

#: Turns that a shard should hold.
SHARD_TURNS = 2048
#: Ids that are joined to one piece of an end list.
PIECE = 20_000
NODES = "shard long, at int, up int, last int, key binary, depth long, n long, first long, n_bytes long, childless boolean, ends array<long>"
SUMS = "key binary, conv_id long, depth long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def narrow(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text) and n_bytes of every turn; a null role or text counts as empty.

    Rows without conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")
    )


def _walk(table: pa.Table) -> pa.Table:
    """The nodes of one shard in depth-first order."""
    order = pc.sort_indices(table, [("conv_id", "ascending"), ("turn", "ascending"), ("digest", "ascending")], null_placement="at_start")
    table = table.take(order)
    ids: list[int] = []
    turns: list[list[bytes]] = []
    sizes: dict[bytes, int] = {}
    for conv, digest, size in zip(*(table.column(c).to_pylist() for c in ("conv_id", "digest", "n_bytes")), strict=True):
        if not ids or ids[-1] != conv:
            ids.append(conv)
            turns.append([])
        if digest is not None:
            turns[-1].append(digest)
            sizes[digest] = size
    postings: list[dict[bytes, int]] = []
    ends: dict[int, int] = {}
    for i, own in enumerate(turns):
        bit = 1 << i
        ends[len(own)] = ends.get(len(own), 0) | bit
        for position, digest in enumerate(own):
            if position == len(postings):
                postings.append({})
            postings[position][digest] = postings[position].get(digest, 0) | bit
    out: dict[str, list] = {c: [] for c in ("up", "key", "depth", "n", "first", "n_bytes", "childless", "ends")}
    stack = [(-1, 0, (1 << len(ids)) - 1, b"", 0)]
    while stack:
        up, depth, members, key, size = stack.pop()
        at = len(out["up"])
        here = members & ends.get(depth, 0)
        rest = members & ~here
        below = []
        while rest:
            least = (rest & -rest).bit_length() - 1
            digest = turns[least][depth]
            child = members & postings[depth][digest]
            rest &= ~child
            below.append((at, depth + 1, child, hashlib.blake2b(key + digest, digest_size=16).digest(), sizes[digest]))
        stack.extend(reversed(below))
        listed = []
        while here:
            least = here & -here
            listed.append(ids[least.bit_length() - 1])
            here ^= least
        first = ids[(members & -members).bit_length() - 1]
        for name, value in zip(out, (up, key, depth, members.bit_count(), first, size, not below, listed), strict=True):
            out[name].append(value)
    last = list(range(len(out["up"])))
    for at in range(len(last) - 1, 0, -1):
        last[out["up"][at]] = max(last[out["up"][at]], last[at])
    shard = table.column("shard")[0].as_py()
    return pa.table({
        "shard": pa.array([shard] * len(last), pa.int64()), "at": pa.array(range(len(last)), pa.int32()), "up": pa.array(out["up"], pa.int32()), "last": pa.array(last, pa.int32()),
        "key": pa.array(out["key"], pa.binary()), **{c: pa.array(out[c], pa.int64()) for c in ("depth", "n", "first", "n_bytes")},
        "childless": pa.array(out["childless"], pa.bool_()), "ends": pa.array(out["ends"], pa.list_(pa.int64())),
    })


def _sums(table: pa.Table) -> pa.Table:
    """Sums over the subtrees of one shard of the values it was given, and the children it was given."""
    table = table.take(pc.sort_indices(table, [("at", "ascending")]))
    up, last = table.column("up").to_numpy(), table.column("last").to_numpy()
    own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
    conv = table.column("conv_id").to_numpy()

    def subtree(values: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(np.where(own, values, 0))])
        return upto[last + 1] - upto[:-1]

    children = np.bincount(up[own & (up >= 0)], minlength=len(up)).astype(np.int64)
    leaf = table.column("leaf").to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.table({
        "key": table.column("key"), "conv_id": table.column("conv_id"), "depth": table.column("depth"), "n_convs": table.column("n_convs"),
        "parent_conv_id": pa.array(np.where(up >= 0, conv[up], 0), pa.int64(), mask=up < 0),
        "n_children": pa.array(children), "n_leaves": pa.array(subtree(leaf)), "saved_tokens": pa.array(subtree(table.column("saved").to_numpy())),
    })


def _pieces(batches):
    """Ordered rows of (key, conv_id) as pieces of text, each with its least id."""
    key, ids = None, []

    def row():
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "least": pa.array([ids[0]], pa.int64()), "text": pa.array([",".join(map(str, ids))], pa.string())})

    for batch in batches:
        for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (k != key or len(ids) == PIECE):
                yield row()
                ids = []
            key = k
            ids.append(conv)
    if ids:
        yield row()


def _hashes(batches):
    """Ordered pieces of each key as one SHA-256."""
    key, running = None, None

    def row():
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([running.hexdigest()], pa.string())})

    for batch in batches:
        for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if running is None or k != key:
                if running is not None:
                    yield row()
                key, running = k, hashlib.sha256(text.encode())
            else:
                running.update(("," + text).encode())
    if running is not None:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """key and ends_sha256: the decimal conv_ids of each key, ascending and joined by commas, hashed.

    A key that holds most conversations is cut by ranges of ids; only the texts of
    whole ranges then meet in one task, one after the other.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = ranged.mapInArrow(_pieces, "key binary, least long, text string")
    return pieces.repartition(n, "key").sortWithinPartitions("key", "least").mapInArrow(_hashes, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per distinct prefix of the conversations in ``turns`` (as ``narrow`` gives them).

    conv_id (smallest member), depth (turns), parent_conv_id (null for the root),
    n_convs (members), n_children, n_leaves (childless nodes in the subtree, itself
    included), saved_tokens (over the subtree: bytes of each node's last text times its
    members but one) and ends_sha256 (of the ids of the conversations that end here).

    Turns stand in the order of turn (null first), ties in that of their digests;
    repeated rows are turns of their own.  A row whose digest is null is no turn but
    makes its conversation a member of the root.  Without rows there are no nodes.
    """
    count = turns.count()
    shards = max(1, -(-count // shard_turns))
    dealt = turns.select("conv_id", "turn", "digest", "n_bytes", F.pmod(F.xxhash64("conv_id"), F.lit(shards)).alias("shard"))
    local = keep(dealt.groupBy("shard").applyInArrow(_walk, NODES))
    merged = local.groupBy("key").agg(
        F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.bool_and("childless").alias("leaf"), ((F.sum("n") - 1) * F.max("n_bytes")).alias("saved")
    )
    back = local.select("shard", "at", "up", "last", "key", "depth", "first").join(merged, "key").withColumn("own", F.col("first") == F.col("conv_id")).drop("first")
    nodes = back.groupBy("shard").applyInArrow(_sums, SUMS).groupBy("key").agg(
        *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")], *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    )
    ends = end_digests(local.select("key", F.explode("ends").alias("conv_id")))
    return nodes.join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")
    )
