"""Find benchmark passages in documents by winnowing.

Words are hashed and every run of ``GRAM`` words gives a fingerprint.  Of each
``SPAN - GRAM + 1`` consecutive fingerprints the least is kept (the last of
equals), so a document and an item that share ``SPAN`` consecutive words share a
kept fingerprint within them.  Items shorter than ``SPAN`` words keep the one
fingerprint of all their words, and documents keep every run of such a length.

Kept fingerprints are joined, each with the words around it, and every hit is
extended to both sides: runs of at least ``SPAN`` equal words are occurrences.
Before the join a bit table of fixed size, filled from the benchmark, drops
document fingerprints that no item has; it is ``FILTER_BITS`` bits whatever the
tables hold, and only makes more rows pass when it fills up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm import kernels as K
from courtflow.llm.tables import free_name

SPAN, GRAM = 10, 4
WINDOW = SPAN - GRAM + 1
#: Words around a fingerprint that any window with it can reach: SPAN - GRAM to either side.
REACH = SPAN - GRAM
FILTER_BITS = 23
HITS = "row long, doc_id long, n_words long, hits array<struct<print:long,at:long,length:int,words:binary>>"


def word_hashes(text) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.text_bytes(text)
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets, K.NOT_ALNUM)
    return K.span_hash(K.prefix_sums(data), starts, ends), first


def winnowed(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints and the number of their first word, for texts of ``SPAN`` words or more."""
    prints, at = K.grams(words, first, GRAM)
    m = len(prints) - WINDOW + 1
    if m <= 0:
        return prints[:0], at[:0]
    whole = np.flatnonzero(at[WINDOW - 1 :] - at[:m] == WINDOW - 1)  # windows that lie in one text
    owner = np.searchsorted(first, at, "right")
    whole = whole[owner[whole] == owner[whole + WINDOW - 1]]
    least = np.lib.stride_tricks.sliding_window_view(prints[::-1], WINDOW)[::-1][whole]
    chosen = np.unique(whole + WINDOW - 1 - np.argmin(least, axis=1))
    return prints[chosen], at[chosen]


def context(words: np.ndarray, begin: int, end: int, at: int, length: int) -> bytes:
    """Words from ``REACH`` before a run to ``REACH`` behind it, with 0 beyond the text."""
    out = np.zeros(2 * REACH + length, np.uint64)
    a, b = max(begin, at - REACH), min(end, at + length + REACH)
    out[a - at + REACH : b - at + REACH] = words[a:b] | np.uint64(1)
    return out.tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def item_prints(benchmark: DataFrame) -> DataFrame:
    """item_id, print, length (words of the run) and words (around it) of every kept fingerprint of the items."""

    def of_items(batches):
        for batch in K.pieces(batches, "text"):
            words, first = word_hashes(batch.column("text"))
            prints, at = winnowed(words, first)
            owner = np.searchsorted(first, at, "right") - 1
            rows = [(i, int(p), GRAM, context(words, first[i], first[i + 1], a, GRAM)) for i, p, a in zip(owner.tolist(), _signed(prints).tolist(), at.tolist(), strict=True)]
            counts = np.diff(first)
            for n in range(1, SPAN):
                short = np.flatnonzero(counts == n)
                prints, at = K.grams(words, first, n)
                for i in short.tolist():
                    a = int(first[i])
                    rows.append((i, int(_signed(prints)[np.searchsorted(at, a)]), n, context(words, a, a + n, a, n)))
            ids = batch.column("item_id").to_pylist()
            yield pa.RecordBatch.from_pydict({
                "item_id": pa.array([ids[r[0]] for r in rows], pa.int64()), "print": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([r[2] for r in rows], pa.int32()), "words": pa.array([r[3] for r in rows], pa.binary()),
            })

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(of_items, "item_id long, print long, length int, words binary")


def _filter(prints: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The bit table of the items' fingerprints, and the lengths of short items."""
    cells = prints.select(F.pmod(F.col("print"), F.lit(1 << FILTER_BITS)).alias("at")).selectExpr("at - at % 32 AS cell", "shiftleft(1L, cast(at % 32 AS int)) AS bit")
    table = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for cell, bits in cells.groupBy("cell").agg(F.bit_or("bit")).toLocalIterator():  # at most one row per 32 bits of the table
        table[cell // 32] = bits
    lengths = [r[0] for r in prints.select("length").distinct().where(F.col("length") != GRAM).collect()]  # below SPAN
    has_four = prints.where((F.col("length") == GRAM) & (F.octet_length("words") == 8 * (2 * REACH + GRAM))).limit(1).count()
    return table, sorted({*lengths, *([GRAM] if has_four else [])})


def document_hits(docs: DataFrame, table: np.ndarray, lengths: list[int]) -> DataFrame:
    """One row per document with the fingerprints that may be an item's."""

    def of_documents(batches):
        for batch in K.pieces(batches, "text"):
            words, first = word_hashes(batch.column("text"))
            found = [(GRAM, *winnowed(words, first))] + [(n, *K.grams(words, first, n)) for n in lengths]
            hits: list[list] = [[] for _ in range(len(first) - 1)]
            for n, prints, at in found:
                cell = (_signed(prints) % (1 << FILTER_BITS)).astype(np.uint64)
                good = np.flatnonzero((table[(cell >> np.uint64(5)).astype(np.int64)] >> (cell & np.uint64(31)).astype(np.uint32)) & np.uint32(1))
                owner = np.searchsorted(first, at[good], "right") - 1
                for i, p, a in zip(owner.tolist(), _signed(prints[good]).tolist(), at[good].tolist(), strict=True):
                    begin, end = int(first[i]), int(first[i + 1])
                    hits[i].append({"print": p, "at": a - begin, "length": n, "words": context(words, begin, end, a, n)})
            kind = pa.list_(pa.struct([("print", pa.int64()), ("at", pa.int64()), ("length", pa.int32()), ("words", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(hits, kind)], ["row", "doc_id", "n_words", "hits"]
            )

    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(of_documents, HITS)


def occurrences(hits: DataFrame, prints: DataFrame) -> DataFrame:
    """row, item_id, start and end (in words) of the runs of equal words around shared fingerprints."""

    def extend(batches):
        for batch in batches:
            n = batch.column("length").to_numpy()
            at = batch.column("at").to_numpy()
            starts, ends, good = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), bool)
            for i, (x, y) in enumerate(zip(batch.column("words").to_pylist(), batch.column("item_words").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                same = (x == y) & (x != 0)
                if not same[REACH : REACH + n[i]].all():
                    continue
                before = REACH if same[:REACH].all() else int(np.argmin(same[:REACH][::-1]))
                after = REACH if same[REACH + n[i] :].all() else int(np.argmin(same[REACH + n[i] :]))
                short = not y[:REACH].any() and not y[REACH + n[i] :].any()  # the item is this run
                starts[i], ends[i] = at[i] - before, at[i] + n[i] + after
                if short:
                    starts[i], ends[i] = at[i], at[i] + n[i]
                good[i] = short or ends[i] - starts[i] >= SPAN
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("item_id"), pa.array(starts), pa.array(ends)], ["row", "item_id", "start", "end"]
            ).filter(pa.array(good))

    flat = hits.select("row", F.explode("hits").alias("h")).select("row", "h.*").distinct()
    joined = flat.join(prints.withColumnRenamed("words", "item_words"), ["print", "length"])
    return joined.select("row", "at", "length", "words", "item_id", "item_words").mapInArrow(extend, "row long, item_id long, start long, end long")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item.

    Words are runs of ASCII letters and digits and of other code points, with A to
    Z lower-cased.  A window is ``SPAN`` consecutive words of an item, or all of a
    shorter one.  Returns row (a hash of doc_id and text), doc_id, n_words, n_hit, spans (hit runs in words), items
    (ids with a window in the document, ordered as strings).  Null and wordless
    texts have no words and no hits, such items no windows; items without id count
    for words and spans and are not listed, and rows of equal doc_id and text are
    told apart only by what they have in common.  Other columns are not read.
    """
    prints = item_prints(benchmark).distinct()
    table, lengths = _filter(prints)
    hits = document_hits(docs, table, lengths)
    found = occurrences(hits, prints).groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"),
        F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("items"),
    )
    # Runs in order of their start, merged where they overlap or touch.
    merged = F.expr("""aggregate(runs, cast(array() as array<struct<start:bigint,end:bigint>>), (done, r) ->
        if(size(done) > 0 and done[size(done) - 1].end >= r.start,
           concat(slice(done, 1, size(done) - 1), array(named_struct('start', done[size(done) - 1].start, 'end', greatest(done[size(done) - 1].end, r.end)))),
           concat(done, array(r))))""")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    found = found.withColumn("spans", merged).withColumn("n_hit", n_hit).drop("runs")
    return hits.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans",
    )


def items_digest(items: str = "items"):
    """SHA-256 of the ids, comma-joined."""
    return F.sha2(F.concat_ws(",", items), 256)


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that have a word in an occurrence of a benchmark window."""
    row = free_name(docs, "row")
    hit = contamination(docs, benchmark).where("n_hit > 0").select(F.col("row").alias(row))
    return docs.join(hit, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]) == F.col(row), "left_anti")
