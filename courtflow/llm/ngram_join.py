"""Jaccard join of documents on word shingles with several global token orders.

Under any total order of the shingles, two sets with Jaccard similarity t share a
shingle among their first ``n - ceil(t n) + 1``.  The first order puts shingles of
one document foremost, then rarer before more frequent; the others put shingles
of one document foremost, then follow different hashes.  Shingles of one document
can be shared with none, so a text keeps only what is left of its prefix behind
them: most texts keep nothing and are out.  Candidates must meet in the prefixes
of every order before they are verified exactly.

Groups of copies would make quadratically many pairs.  Rows of equal text are one
node from the start.  Nodes that agree in their first shingles under two hash
orders are compared with one leader first, the one with the least shingles of its
own, and what is linked to it is one class; a second round has other leaders.  The
join then pairs nodes of different classes only, which is all that components
need.  It puts out a pair only if the shingles that one has and the other lacks
can be few enough: those of one document, and the bits in which parity maps of the
others differ, are a lower bound of their number.

Documents' frequencies are looked up block by block (see ``blocks``): only keys
and one byte per key are shuffled, and texts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm import kernels as K
from courtflow.llm.blocks import KEYS_SCHEMA, Blocks, answers_in_order, ask, keys_table, send_keys
from courtflow.llm.graph import components
from courtflow.llm.tables import free_name, keep

SIMILARITY = (4, 5)  # 0.8 as a fraction
SHINGLE = 5
#: Hash orders whose first shingles choose leaders, two to a band.
BANDS = 4
#: Bits of the parity map of a node's shared shingles.
MAP_BITS = 512
SETS_SCHEMA = "doc_id long, node long, n int, own int, tokens binary, first array<long>, second array<long>, third array<long>, map array<long>"


def shingle_sets(text, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every text, and their bounds; a text of fewer words is one shingle."""
    data, offsets = K.text_bytes(text)
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets, K.SPACE)
    hashes = K.span_hash(K.prefix_sums(data), starts, ends)
    values, at = K.grams(hashes, first, size)
    owner = np.searchsorted(first, at, "right") - 1
    counts = np.diff(first)
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            whole = sum((hashes[first[short] + i] * np.uint64(pow(0xD6E8FEB86659FD93, i, 1 << 64)) for i in range(k)), np.zeros(len(short), np.uint64))
            values, owner = np.concatenate([values, K.mix(whole + np.uint64(k))]), np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    return K.distinct_per_text(values[order], np.searchsorted(owner[order], np.arange(len(counts) + 1)))


def _order(tokens: np.ndarray, salt: int) -> np.ndarray:
    return K.mix(tokens ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64)))


def _longs(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def token_sets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, node (hash of its text), n (set size); and where it may have links, once per text and block:
    tokens (shingles that other documents have, sorted) and its prefixes under three orders."""
    blocks = Blocks(docs)
    bits = blocks.buckets_for(0.2)
    space = bits + 32

    def send(table: pa.Table) -> pa.Table:
        values, _ = shingle_sets(table.column("text"))
        keys, counts = K.distinct(values >> np.uint64(64 - space))
        return keys_table(send_keys(table.column("block")[0].as_py(), keys, space, bits, np.minimum(counts, 255).astype(np.uint8)))

    def frequency(keys, _, counts):
        _, at, _ = K.grouped(keys)
        total = np.bincount(at, counts.astype(np.float64))
        return np.minimum(255, np.ceil(8 * np.log2(total)))[at]

    asked = blocks.rows.groupBy("block").applyInArrow(send, KEYS_SCHEMA)
    answers = ask(asked, frequency, space, bits)
    up, down = SIMILARITY

    def use(table: pa.Table, answer: pa.Table) -> pa.Table:
        values, bounds = shingle_sets(table.column("text"))
        keys, which, _ = K.grouped(values >> np.uint64(64 - space))
        rank = answers_in_order(answer, len(keys))[which]
        n = np.diff(bounds)
        shared = np.concatenate([[0], np.cumsum(rank > 0)])[bounds]
        left = np.diff(shared) - -(-up * n // down) + 1  # of the prefix, behind the document's own shingles
        nodes = table.column("tie").to_pylist()
        seen: set[int] = set()
        tokens, prefixes, maps = [None] * len(n), ([None] * len(n), [None] * len(n), [None] * len(n)), [None] * len(n)
        for i in np.flatnonzero((left > 0) & (n > 0)).tolist():
            if nodes[i] in seen:
                continue
            seen.add(nodes[i])
            own, ranks = values[bounds[i] : bounds[i + 1]], rank[bounds[i] : bounds[i + 1]]
            own, ranks = own[ranks > 0], ranks[ranks > 0]
            tokens[i] = own.tobytes()
            maps[i] = _longs(np.packbits((np.bincount(own % np.uint64(MAP_BITS), minlength=MAP_BITS) % 2).astype(bool)).view(np.uint64))
            prefixes[0][i] = _longs(own[np.lexsort((own, ranks))[: left[i]]])
            for k in (1, 2):
                prefixes[k][i] = _longs(own[np.argsort(_order(own, k))[: left[i]]])
        longs = pa.list_(pa.int64())
        return pa.table({
            "doc_id": table.column("doc_id"), "node": table.column("tie"), "n": pa.array(n, pa.int32()), "own": pa.array(n - np.diff(shared), pa.int32()), "tokens": pa.array(tokens, pa.binary()),
            "first": pa.array(prefixes[0], longs), "second": pa.array(prefixes[1], longs), "third": pa.array(prefixes[2], longs),
            "map": pa.array(maps, longs),
        })

    return blocks.rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(use, SETS_SCHEMA)


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have at least the similarity."""
    up, down = SIMILARITY
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def check(batches):
        for batch in batches:
            left, right = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            size = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            both = np.array([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)) for x, y in zip(left, right, strict=True)], np.int64)
            good = pa.array(down * both >= up * (size - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(good)

    return pairs.join(one, "a").join(two, "b").select("a", "na", "ta", "b", "nb", "tb").mapInArrow(check, "a long, b long")


def _band_keys(nodes: DataFrame) -> DataFrame:
    """node and key of every band: nodes with a key have the first two shingles of two orders in common."""

    def bands(batches):
        for batch in batches:
            keys = []
            for data in batch.column("tokens").to_pylist():
                own = np.frombuffer(data, np.uint64)
                least = [int(_order(own, 10 + k).min()) for k in range(2 * BANDS)]
                keys.append(_longs(K.mix(np.array([(least[2 * b] * 3 + least[2 * b + 1] * 5 + b) % (1 << 64) for b in range(BANDS)], np.uint64))))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("own"), pa.array(keys, pa.list_(pa.int64()))], ["node", "own", "keys"])

    return nodes.select("node", "own", "tokens").mapInArrow(bands, "node long, own int, keys array<long>").select("node", "own", F.explode("keys").alias("key"))


def _leader_pairs(keyed: DataFrame, rank: list[str]) -> DataFrame:
    """Pairs of a node and the leader of each key, the node that is least by ``rank``; keys of one class make none."""
    heads = keyed.groupBy("key").agg(F.min_by(F.struct("node", "root"), F.struct(*rank)).alias("head"), F.min("root").alias("x"), F.max("root").alias("y"))
    heads = heads.where("x <> y").select("key", F.col("head.node").alias("b"), F.col("head.root").alias("rb"))
    return keyed.join(heads, "key").where("root <> rb").select(F.col("node").alias("a"), "b").distinct()


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _candidates(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of nodes of different classes that meet in the prefixes of all three orders, in size and in their maps."""
    up, down = SIMILARITY
    known = keep(_with_class(nodes.select("node", "n", "own", "map", "first"), classes))
    index = known.select("node", "root", F.explode("first").alias("token"))
    # In a token's bucket every pair of classes has a node outside the largest class.
    mixed = (
        index.groupBy("token", "root").agg(F.count(F.lit(1)).alias("m"))
        .groupBy("token").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
        .where("roots > 1").select("token", "main")
    )
    index = keep(index.join(mixed, "token").select("token", "node", "main").join(known.drop("first"), "node"))
    left = index.where("root <> main").select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "root", "n", "own", "map")])
    right = index.select("token", "main", *[F.col(c).alias(f"{c}_b") for c in ("node", "root", "n", "own", "map")])
    sizes = (F.col("n_a") * up <= F.col("n_b") * down) & (F.col("n_b") * up <= F.col("n_a") * down)
    apart = F.col("own_a") + F.col("own_b") + sum((F.bit_count(F.col("map_a")[k].bitwiseXOR(F.col("map_b")[k])) for k in range(MAP_BITS // 64)), F.lit(0))
    near = apart * (down + up) <= (F.col("n_a") + F.col("n_b")) * (down - up)
    once = (F.col("root_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    pairs = left.join(right, "token").where((F.col("root_a") != F.col("root_b")) & sizes & once & near)
    pairs = pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    one = nodes.select(F.col("node").alias("a"), F.col("second").alias("sa"), F.col("third").alias("ta"))
    two = nodes.select(F.col("node").alias("b"), F.col("second").alias("sb"), F.col("third").alias("tb"))
    return pairs.join(one, "a").join(two, "b").where(F.arrays_overlap("sa", "sb") & F.arrays_overlap("ta", "tb")).select("a", "b")


def _families(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``token_sets`` of ``docs``, and node, n, root (of the component) and component_id, one row per distinct text."""
    sets = keep(token_sets(docs))
    nodes = keep(sets.where("tokens IS NOT NULL").drop("doc_id").dropDuplicates(["node"]))
    keyed = keep(_band_keys(nodes))
    near = keep(verified(_leader_pairs(keyed.withColumn("root", F.col("node")), ["own", "node"]), nodes))
    classes = keep(components(near))
    other = keyed.withColumn("draw", F.xxhash64("node", "key"))
    near = keep(near.union(verified(_leader_pairs(_with_class(other, classes), ["draw"]), nodes)))
    classes = keep(components(near))
    more = verified(_candidates(nodes, classes), nodes)
    roots = components(near.union(more))
    own = sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n").alias("n"))
    own = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets, own.join(least, "root").select("node", "n", "root", "component_id")


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links lead to) for every row.

    Words are runs of characters other than ASCII white space, lower-cased in A to
    Z.  Rows of one text are linked with each other unless it has no words; null
    and wordless texts have no shingles and are linked with nothing, so their
    component is their own doc_id.  Rows without doc_id take part by their text;
    a component without any doc_id has none.  Other columns are not read.
    """
    sets, families = _families(docs)
    labels = families.select("node", "component_id")
    return sets.select("doc_id", "node", F.col("n").alias("n_shingles")).join(labels, "node").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies of a row that stays.

    One row of each component stays, the one with the least doc_id (null comes
    last; of rows that share it, the one with the least hash of its values; of rows
    equal in all values, any one).  Texts without shingles all stay.
    """
    node, value = F.xxhash64("text"), F.xxhash64(*docs.columns)
    families = _families(docs)[1].where("n > 0").select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    # Repeated rows are counted first, so a text or an id in much of the table is one row from here on.
    rows = docs.select(F.col("doc_id").alias("_id"), node.alias("_node"), value.alias("_value"))
    rows = rows.groupBy("_id", "_node").agg(F.min("_value").alias("_value"), F.count(F.lit(1)).alias("_m"))
    rows = keep(rows.join(families, "_node"))
    first = F.min(F.struct(F.col("_id").isNull().alias("nameless"), "_id", "_value", "_node")).alias("h")
    heads = rows.groupBy("_root").agg(first).select(F.col("h._id").alias("_head"), F.col("h._node").alias("_head_node"))
    at_head = F.col("_id").eqNullSafe(F.col("_head")) & (F.col("_node") == F.col("_head_node"))
    # Only what goes or needs a choice: other rows stay as they are.
    known = keep(rows.join(heads, at_head, "left").where("_head_node IS NULL OR _m > 1").select("_id", "_node", F.col("_head_node").isNotNull().alias("_stays")))
    at_id, at_node = free_name(docs, "id"), free_name(docs, "node")
    known = known.withColumnsRenamed({"_id": at_id, "_node": at_node})
    here = docs["doc_id"].eqNullSafe(F.col(at_id)) & (F.xxhash64(docs["text"]) == F.col(at_node))
    single = docs.join(known, here, "left_anti")
    repeated = docs.join(known.where("_stays"), here, "left_semi")
    chosen = repeated.select(F.col("doc_id").alias("_id"), node.alias("_node"), value.alias("_value"), F.struct(*docs.columns).alias("_row"))
    chosen = chosen.groupBy("_id", "_node").agg(F.min_by("_row", "_value").alias("_row"))
    return single.select(*docs.columns).union(chosen.select("_row.*"))
