"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut a text's bytes into tokens.  In every batch, pandas'
``merge_asof``, keyed by document, finds for each token start of one side the token
of the other side that covers it; both directions together are all overlaps.
Overlapping tokens that end together are linked, and their ends cut the tokens into
the smallest groups that hold the same bytes on both sides.

Links are counted over the corpus as pairs of ids.  A document's links are kept as
its distinct pairs with their numbers, so texts are tokenized once; the counts come
back to the documents as a broadcast table of checked size, or by a join beyond it.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtflow.llm import kernels as K
from courtflow.llm.tables import keep

#: Pairs of ids whose counts are sent to all tasks at most (17 bytes each); more are joined.
SENT_PAIRS = 4_000_000
#: Distinct pairs that a counting task holds before it passes them on.
HELD_PAIRS = 2_000_000
#: Shares that rows of one pair are split into where counts are joined.
SALT = 32
GROUPS = "groups array<struct<start:bigint,end:bigint,a:array<bigint>,b:array<bigint>>>"
#: Fixed value: how byte-level vocabularies split a text before their merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Vocabulary:
    """Ids of texts, and the bytes of each id."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        names = [str(i).encode() for i in range(len(entries))]
        width = len(names[-1]) + 1
        self.digits = np.array([len(n) for n in names], np.int64)
        self.names = np.frombuffer(b"".join(n.ljust(width, b"\0") for n in names), np.uint8).reshape(-1, width)

    def encode(self, texts: list[str]) -> list:
        raise NotImplementedError

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids in order."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.bytes[np.repeat(self.begins[ids] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ByteLevel(Vocabulary):
    """A byte-level BPE file; the space that begins each text is added here."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = content["model"]["vocab"]
        special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}
        entries = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, at in vocabulary.items():
            entries[at] = token.encode() if token in special else bytes(letters[c] for c in token)
        super().__init__(entries)
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in content["model"]["merges"]]
        places = [vocabulary[m] for m in merged]
        before = content.get("pre_tokenizer") or {}
        plain = content.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.fast = self.slow = None
        if plain and places == sorted(places) and all(0 <= a < 256 for a in (vocabulary[c] for c in letters)):
            import tiktoken

            # Ids stand in the order of the merges, so they are the ranks as well.
            ranks = {entries[at]: at for token, at in vocabulary.items() if token not in special}
            self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        else:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            self.slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list:
        if self.fast is not None:
            return [self.fast.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        return [self.slow.encode(" " + t, add_special_tokens=False).ids for t in texts]


class Pieces(Vocabulary):
    """A SentencePiece model, which adds the space that begins each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        super().__init__([
            bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(m.get_piece_size())
        ])

    def encode(self, texts: list[str]) -> list:
        return self.model.encode(texts, num_threads=1)


@lru_cache(8)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in a worker."""
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


def _flat(ids: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(i) for i in ids], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *[np.asarray(i, np.int64) for i in ids]]), sizes


def _agrees(side: Vocabulary, ids: np.ndarray, sizes: np.ndarray, body: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which documents' tokens spell their bytes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    same = np.bincount(owner, side.lengths[ids], len(sizes)).astype(np.int64) == lengths
    own = np.repeat(same, lengths)
    differs = side.spelled(ids[same[owner]]) != body[own]
    where = np.repeat(np.arange(len(sizes)), lengths)[own][differs]
    same[where] = False
    return same


class Aligned:
    """Tokens, links and groups of one batch; documents whose tokens do not spell a space and their text have none."""

    def __init__(self, texts: list[str | None], a: Vocabulary, b: Vocabulary):
        self.count, self.a, self.b = len(texts), a, b
        kept = np.flatnonzero([bool(t) for t in texts])
        some = [texts[i] for i in kept]
        spelled = [(" " + t).encode() for t in some]
        lengths = np.array([len(s) for s in spelled], np.int64)
        body = np.frombuffer(b"".join(spelled), np.uint8)
        ids_a, sizes_a = _flat(a.encode(some))
        ids_b, sizes_b = _flat(b.encode(some))
        good = _agrees(a, ids_a, sizes_a, body, lengths) & _agrees(b, ids_b, sizes_b, body, lengths)
        self.ids_a, self.ids_b = ids_a[np.repeat(good, sizes_a)], ids_b[np.repeat(good, sizes_b)]
        self.docs = kept[good]
        self.doc_a, self.doc_b = np.repeat(self.docs, sizes_a[good]), np.repeat(self.docs, sizes_b[good])
        # Places count through the batch, so every document's first token begins where the last one's ended.
        self.end_a, self.end_b = np.cumsum(a.lengths[self.ids_a]), np.cumsum(b.lengths[self.ids_b])
        base = np.concatenate([[0], np.cumsum(lengths[good])])
        self.base = dict(zip(self.docs.tolist(), base.tolist(), strict=False))
        left = pd.DataFrame({"doc": self.doc_a, "start": self.end_a - a.lengths[self.ids_a], "token": np.arange(len(self.ids_a))})
        right = pd.DataFrame({"doc": self.doc_b, "start": self.end_b - b.lengths[self.ids_b], "token": np.arange(len(self.ids_b))})
        over = pd.merge_asof(left, right, on="start", by="doc", suffixes=("_a", "_b"))
        under = pd.merge_asof(right, left, on="start", by="doc", suffixes=("_b", "_a"))
        # Tokens that begin together are found in both directions; they count once.
        under = under[under["start"].to_numpy() != left["start"].to_numpy()[under["token_a"].to_numpy(np.int64)]]
        self.over_a, self.over_b = (np.concatenate([over[c].to_numpy(np.int64), under[c].to_numpy(np.int64)]) for c in ("token_a", "token_b"))
        together = self.end_a[self.over_a] == self.end_b[self.over_b]
        order = np.argsort(self.over_a[together], kind="stable")
        self.link_a, self.link_b = self.over_a[together][order], self.over_b[together][order]
        self.keys = self.ids_a[self.link_a] << 32 | self.ids_b[self.link_b]
        self.link_doc = self.doc_a[self.link_a]

    def numbers(self) -> dict[str, np.ndarray]:
        """n_a, n_b, n_groups and n_links of each document."""
        per = lambda owner: np.bincount(owner, minlength=self.count).astype(np.int64)
        links = per(self.link_doc)
        return {"n_a": per(self.doc_a), "n_b": per(self.doc_b), "n_groups": links, "n_links": links}

    def digests(self) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``: the ids of each group; empty without tokens."""
        group_a = np.searchsorted(self.link_a, np.arange(len(self.ids_a)))
        group_b = np.searchsorted(self.link_b, np.arange(len(self.ids_b)))
        before = np.concatenate([[0], self.link_b + 1])
        width = max(self.a.names.shape[1], self.b.names.shape[1])
        text = np.zeros((len(self.ids_a) + len(self.ids_b), width), np.uint8)
        sizes = np.zeros(len(text), np.int64)
        for side, ids, place, last, mark in (
            (self.a, self.ids_a, np.arange(len(self.ids_a)) + before[group_a], self.link_a, ord("|")),
            (self.b, self.ids_b, np.arange(len(self.ids_b)) + self.link_a[group_b] + 1 if len(self.link_a) else np.zeros(0, np.int64), self.link_b, ord(";")),
        ):
            closing = np.full(len(ids), ord(","), np.uint8)
            closing[last] = mark
            text[place, : side.names.shape[1]] = side.names[ids]
            text[place, side.digits[ids]] = closing
            sizes[place] = side.digits[ids] + 1
        flat = text.reshape(-1)
        flat = flat[flat != 0].tobytes()
        tokens = np.bincount(self.doc_a, minlength=self.count) + np.bincount(self.doc_b, minlength=self.count)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(tokens)])].tolist()
        return [hashlib.sha256(flat[p : q - 1]).hexdigest() if p < q else "" for p, q in zip(ends[:-1], ends[1:], strict=True)]

    def groups(self) -> list[list[dict]]:
        """Per document its groups: bytes from and to, counted with the space in front, and both sides' ids."""
        out: list[list[dict]] = [[] for _ in range(self.count)]
        at_a = at_b = 0
        for la, lb, doc in zip(self.link_a.tolist(), self.link_b.tolist(), self.link_doc.tolist(), strict=True):
            start = int(self.end_a[at_a] - self.a.lengths[self.ids_a[at_a]]) - self.base[doc]
            out[doc].append({"start": start, "end": int(self.end_a[la]) - self.base[doc], "a": self.ids_a[at_a : la + 1].tolist(), "b": self.ids_b[at_b : lb + 1].tolist()})
            at_a, at_b = la + 1, lb + 1
        return out

    def pairs(self) -> list[bytes]:
        """Per document its distinct pairs of linked ids and their numbers, packed by ``packed_pairs``."""
        order = np.lexsort((self.keys, self.link_doc))
        keys, docs = self.keys[order], self.link_doc[order]
        begins = np.ones(len(keys), bool)
        begins[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        at = np.flatnonzero(begins)
        times = np.diff(np.append(at, len(keys)))
        bounds = np.searchsorted(docs[at], np.arange(self.count + 1)).tolist()
        return [packed_pairs(keys[at[p:q]], times[p:q]) for p, q in zip(bounds[:-1], bounds[1:], strict=True)]


def packed_pairs(keys: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted keys and numbers as byte planes, which compress well."""
    return np.concatenate([keys, times]).astype("<i8").view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).tobytes() if len(keys) else b""


def unpacked_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, 8, -1).transpose(0, 2, 1)).view("<i8").reshape(2, -1)
    return both[0], both[1]


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Every row of ``docs`` with ``groups``: array of start, end (bytes of space and text), a and b (ids)."""
    docs = docs.drop("groups")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))]))

    def run(batches):
        for batch in K.pieces(batches, "text"):
            found = Aligned(batch.column("text").to_pylist(), vocabulary(path_a), vocabulary(path_b)).groups()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "groups"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T.StructType.fromDDL(GROUPS).fields]))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Kept table: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (packed) and row (unique) of every row of ``docs``.

    Texts that are null or empty, or that one side does not spell byte for byte
    (control of a model's own space mark, for one), have no tokens: zeros and an
    empty digest.  Whole texts are tokenized; a task holds the tokens of one piece
    of texts, or of one longer text.  Repeated rows and ids are rows of their own;
    other columns are not read; no rows give no rows.
    """

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in K.pieces(batches, "text"):
            found = Aligned(batch.column("text").to_pylist(), vocabulary(path_a), vocabulary(path_b))
            columns = {"doc_id": batch.column("doc_id"), **{k: pa.array(v) for k, v in found.numbers().items()}}
            columns |= {"groups_sha256": pa.array(found.digests(), pa.string()), "pairs": pa.array(found.pairs(), pa.binary())}
            yield pa.RecordBatch.from_pydict(columns | {"row": pa.array((part << 40) + at + np.arange(found.count))})
            at += found.count

    schema = docs.select("doc_id").schema
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        schema = schema.add(name, "long")
    return keep(docs.select("doc_id", "text").mapInArrow(run, schema.add("groups_sha256", "string").add("pairs", "binary").add("row", "long")))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Kept table of all pairs: a, b, n (links in the corpus) and best (whether no pair of this b has more)."""

    def count(batches):
        keys, times, held = [], [], 0

        def merged():
            all_keys, where = np.unique(np.concatenate(keys), return_inverse=True)
            return all_keys, np.bincount(where, np.concatenate(times)).astype(np.int64)

        def table():
            k, n = merged()
            return pa.RecordBatch.from_pydict({"a": pa.array(k >> 32), "b": pa.array(k & 0xFFFFFFFF), "n": pa.array(n)})

        for batch in batches:
            for data in batch.column("pairs").to_pylist():
                if data:
                    k, n = unpacked_pairs(data)
                    keys.append(k)
                    times.append(n)
                    held += len(k)
                    if held > HELD_PAIRS:
                        k, n = merged()
                        if len(k) > HELD_PAIRS // 2:
                            yield table()
                            k, n = k[:0], n[:0]
                        keys, times, held = [k], [n], len(k)
        if keys:
            yield table()

    total = aligned.select("pairs").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # One id has at most as many partners as the other vocabulary has entries.
    return keep(total.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b"))))


def link_scores(aligned: DataFrame, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """``aligned`` with n_best (links whose count is the highest of their b) and count_sum (counts of all links)."""
    counts = pair_counts(aligned)
    if counts.count() <= sent_pairs:
        return _scored_by_value(aligned, counts)
    asked = aligned.select("row", "pairs").mapInArrow(_exploded, "row long, a long, b long, times long")
    share = F.pmod(F.xxhash64("row"), F.lit(SALT)).alias("share")
    offered = counts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>")))
    found = asked.select("*", share).join(offered, ["a", "b", "share"]).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return aligned.join(found, "row", "left").select(*[c for c in aligned.columns if c not in ("row", "pairs")], zero("n_best"), zero("count_sum"))


def _exploded(batches):
    for batch in batches:
        for row, data in zip(batch.column("row").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            if data:
                keys, times = unpacked_pairs(data)
                yield pa.RecordBatch.from_pydict({"row": pa.array(np.full(len(keys), row)), "a": pa.array(keys >> 32), "b": pa.array(keys & 0xFFFFFFFF), "times": pa.array(times)})


def _scored_by_value(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The same with ``counts``, whose size was checked, in every worker."""
    table = counts.select((F.shiftleft("a", 32) + F.col("b")).alias("key"), "n", "best").orderBy("key").toPandas()
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("key", "n", "best")))
    carried = [c for c in aligned.columns if c not in ("row", "pairs")]

    def run(batches):
        known, numbers, best = sent.value
        for batch in batches:
            data = batch.column("pairs").to_pylist()
            parts = [unpacked_pairs(d) if d else (known[:0], known[:0]) for d in data]
            owner = np.repeat(np.arange(len(data)), [len(k) for k, _ in parts])
            keys, times = (np.concatenate([p[i] for p in parts]) if parts else known[:0] for i in (0, 1))
            at = np.searchsorted(known, keys)
            n_best, count_sum = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
            np.add.at(n_best, owner, np.where(best[at], times, 0))
            np.add.at(count_sum, owner, times * numbers[at])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(n_best), pa.array(count_sum)], [*carried, "n_best", "count_sum"])

    return aligned.mapInArrow(run, aligned.select(*carried).schema.add("n_best", "long").add("count_sum", "long"))
