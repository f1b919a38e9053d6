"""Language identification with hyperdimensional profiles.

Every letter (and the gap between words) has a random vector of ``DIMENSIONS``
signs, made from its code point alone.  A trigram's vector binds the vectors of
its letters, rotated by their places, with products; a document's vector bundles
its trigrams' vectors, weighted by their counts.  A language's prototype is the
sum of its documents' vectors, each scaled by its number of trigrams.  Documents
get the language whose prototype has the largest cosine.

Bundling is linear, so documents become counts over the trigrams of their piece
and are multiplied with those trigrams' vectors, some thousand trigrams at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm import kernels as K

DIMENSIONS = 512
UNKNOWN = "und"
#: Trigrams whose vectors are held at once.
TILE = 4096
#: A text of so many trigrams is in none of the learned languages if its cosine is below the floor.
ENOUGH, FLOOR = 50, 0.15


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """Signs (int8) of the letters with these code points."""
    words = K.mix(K.mix(points.astype(np.uint64)[:, None] + np.uint64(1)) + np.arange(DIMENSIONS // 64, dtype=np.uint64)[None, :])
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1)
    return bits.astype(np.int8) * 2 - 1


def trigram_counts(texts: list[str | None]):
    """Code points of the piece's letters, its trigrams (as three letter indices), and their occurrences as (text, trigram)."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])
    owner = np.concatenate([[0], owner])[: len(points)]
    points = np.where(_letters()[points], points, 0)
    kept = np.ones(len(points), bool)
    kept[1:] = (points[1:] != 0) | (points[:-1] != 0)  # one gap between words
    points, owner = points[kept], owner[kept]
    alphabet = np.flatnonzero(np.bincount(points, minlength=1))
    number = np.zeros(int(alphabet[-1]) + 1, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    ids, m = number[points], len(alphabet)
    middle = np.flatnonzero(points[1:-1] != 0) + 1  # no trigram reaches across a gap, nor into another text
    code = (ids[middle - 1] * m + ids[middle]) * m + ids[middle + 1]
    if m**3 <= 1 << 22:
        present = np.flatnonzero(np.bincount(code, minlength=1))
        place = np.zeros(m**3, np.int64)
        place[present] = np.arange(len(present))
        which = place[code]
    else:
        present, which = np.unique(code, return_inverse=True)
    return alphabet, present, owner[middle], which


def trigram_vectors(alphabet: np.ndarray, present: np.ndarray) -> np.ndarray:
    m, signs = len(alphabet), letter_vectors(alphabet)
    first, second, third = np.roll(signs, 2, axis=1)[present // (m * m)], np.roll(signs, 1, axis=1)[present // m % m], signs[present % m]
    return (first * second * third).astype(np.float32)


def _tiles(present: np.ndarray, which: np.ndarray):
    """Occurrences of ``TILE`` trigrams at a time: first trigram, end, the occurrences (in the order of their texts) and their trigrams in the tile."""
    if len(present) <= TILE:
        yield 0, len(present), slice(None), which
        return
    order = np.argsort(which // TILE, kind="stable")
    bounds = np.searchsorted(which[order] // TILE, np.arange(-(-len(present) // TILE) + 1))
    for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        yield k * TILE, min(len(present), (k + 1) * TILE), order[a:b], which[order[a:b]] - k * TILE


def bundles(texts: list[str | None], group: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bundled vector (float64) and its number of trigrams; memory does not grow with the alphabet."""
    alphabet, present, owner, which = trigram_counts(texts)
    out = np.zeros((len(texts), DIMENSIONS))
    for first, end, at, local in _tiles(present, which):
        vectors = trigram_vectors(alphabet, present[first:end])
        own = owner[at]
        bounds = np.searchsorted(own, np.arange(len(texts) + 1))
        width = end - first
        for a in range(0, len(texts), group):
            b = min(len(texts), a + group)
            some = slice(bounds[a], bounds[b])
            if bounds[a] < bounds[b]:
                flat = np.bincount((own[some] - a) * width + local[some], minlength=(b - a) * width)
                out[a:b] += flat.reshape(b - a, width).astype(np.float32) @ vectors
    return out, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def bundled_shares(texts: list[str], labels: np.ndarray, kinds: int) -> np.ndarray:
    """Per label (a number below ``kinds``) the sum of its texts' vectors, each divided by the text's number of trigrams."""
    alphabet, present, owner, which = trigram_counts(texts)
    out = np.zeros((kinds, DIMENSIONS))
    share = 1 / np.maximum(1, np.bincount(owner, minlength=len(texts)))
    for first, end, at, local in _tiles(present, which):
        own, width = owner[at], end - first
        weights = np.bincount(labels[own] * width + local, share[own], kinds * width).reshape(kinds, width)
        out += weights @ trigram_vectors(alphabet, present[first:end])
    return out


@dataclass
class Prototypes:
    """One unit vector per language; a row of ``DIMENSIONS`` numbers for each."""

    langs: list[str]
    vectors: np.ndarray


def learn(labelled: DataFrame) -> Prototypes:
    """Prototypes of all values of ``lang`` in ``labelled`` (text, lang); rows without either or without letters teach nothing.

    Repeated rows teach as often as they stand; without rows nothing is learned.
    What reaches the driver is one vector per language.
    """

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in K.pieces(batches, "text"):
            here, labels = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            for lang, vector in zip(here.tolist(), bundled_shares(batch.column("text").to_pylist(), labels, len(here)), strict=True):
                sums[lang] = sums.get(lang, 0) + vector
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(sums), pa.string()), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))}
        )

    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(bundle, "lang string, vector array<double>")
    # Sums of fixed-point numbers do not depend on their order.
    total = rows.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum((F.col("x") * 1e6).cast("decimal(38,0)")).cast("double").alias("x"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v")).select("lang", "v.x").orderBy("lang").collect()
    rows = [r for r in rows if any(r.x)]
    vectors = np.array([r.x for r in rows]).reshape(len(rows), DIMENSIONS)
    return Prototypes([r.lang for r in rows], vectors / np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True)))


def identify(docs: DataFrame, prototypes: Prototypes, carry: list[str]) -> DataFrame:
    """``carry`` columns of every row with lang_pred, score (the largest cosine, 0 to 1, six digits) and trigrams (their number).

    Whole texts are used, and only they go to Python.  Null texts and texts without
    letters get ``und`` and 0, as do all rows if nothing was learned.  Equal texts
    get equal results, of equal cosines the language that comes first holds; no rows
    give no rows.
    """

    def of_piece(texts: list[str | None]) -> pa.StructArray:
        bundled, trigrams = bundles(texts)
        known = (trigrams > 0) & bool(prototypes.langs)
        if prototypes.langs:
            cosine = bundled @ prototypes.vectors.T / np.maximum(1e-12, np.linalg.norm(bundled, axis=1))[:, None]
            best = np.argmax(cosine, axis=1)
            score = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        else:
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        langs = [prototypes.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
        columns = [pa.array(langs, pa.string()), pa.array(np.where(known, np.round(score, 6), 0.0)), pa.array(trigrams)]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "trigrams"])

    def of_texts(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        none = pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("trigrams", pa.int64())]))
        return pa.concat_arrays([none, *(of_piece(piece.column("text").to_pylist()) for piece in K.pieces([batch], "text"))])

    # Marked so that a filter on the result does not make it run twice.
    language = F.arrow_udf(of_texts, "lang_pred string, score double, trigrams long").asNondeterministic()
    found = docs.select(*carry, language("text").alias("_found"))
    return found.select(*carry, "_found.lang_pred", "_found.score", "_found.trigrams")


def rejected(enough: int = ENOUGH, floor: float = FLOOR):
    """Whether a row of ``identify`` is in none of the learned languages.

    It is so without letters, or with at least ``enough`` trigrams and a score below
    ``floor``.  Short texts stay, as their cosines scatter; with ``enough`` 0 the
    floor holds for texts of every length.
    """
    return (F.col("lang_pred") == UNKNOWN) | ((F.col("trigrams") >= enough) & (F.col("score") < floor))


def remainder(modulus: int, of: str = "doc_id"):
    """crc32 of an id as text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(of).cast("string").cast("binary")) % modulus
