"""Toxicity from a learned lexicon, misspellings and the words around.

1. Words, and stems (leading letters) of words, are counted in all rows of label 1.
   Those that could be associated with it beyond chance, given how many there are,
   are counted in all other labelled rows; those that are make the lexicon.
2. The lexicon is a trie.  The automaton that accepts everything within one edit
   of its words is the product of the trie and Levenshtein automata; its states are
   worked out when a word first reaches them.  Most words leave it after a few
   letters.  A path without edits through a stem's node accepts every ending.
3. Every match is looked at in a window of words: within a pair of quotation marks
   it counts as quoted.  Counts of exact, stem, misspelled and quoted matches go
   into a logistic model that is fitted on a bounded sample.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtflow.llm import kernels as K
from courtflow.llm.tables import keep

#: Labelled rows that the weights are fitted on at most, and terms that a task counts before it sends them on.
SAMPLE, TERMS = 20_000, 200_000
#: Terms looked for in one pass over the rows of label 0 (some 100 bytes each in a task); more terms take more passes.
SOUGHT = 300_000
#: Terms whose numbers travel together.
BIN = 4096
STEMS = (4, 5, 6, 7, 8)
#: Words shorter than this are matched exactly only; with 0 all are matched within one edit.
FUZZY_FROM = 5
#: Words to either side of a match that are searched for quotation marks.
CONTEXT = 8
WORD = re.compile(r"[^\W_]+")
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"
EXACT, STEM, FUZZY = 0, 1, 2


class Matcher:
    """Which lexicon entry a word meets: exactly, by its stem, or within one edit."""

    def __init__(self, words: list[str], stems: list[str], fuzzy_from: int = FUZZY_FROM):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[set[int]] = [set()]
        for kind, entries in ((EXACT, words), (STEM, stems)):
            for entry in entries:
                at = 0
                for letter in entry:
                    if letter not in self.children[at]:
                        self.children[at][letter] = len(self.children)
                        self.children.append({})
                        self.ends.append(set())
                    at = self.children[at][letter]
                self.ends[at].add(kind)
                if kind == EXACT and len(entry) >= fuzzy_from:
                    self.ends[at].add(FUZZY)
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)}, False)

    def _state(self, places: set[tuple[int, int]], stem: bool) -> int:
        """Number of the state that is in ``places`` (trie node, edits) after leaving out letters of the entry."""
        full = set(places)
        for node, edits in places:
            if edits == 0:
                full |= {(child, 1) for child in self.children[node].values()}
        stem = stem or any(edits == 0 and STEM in self.ends[node] for node, edits in places)
        key = frozenset({*full, ("stem", 0)} if stem else full)
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.number[key]

    def _move(self, state: int, letter: str) -> int:
        after: set[tuple[int, int]] = set()
        stem = False
        for node, edits in self.sets[state]:
            if node == "stem":
                stem = True
                continue
            if letter in self.children[node]:
                after.add((self.children[node][letter], edits))
            if edits == 0:
                after.add((node, 1))  # an additional letter
                after |= {(child, 1) for child in self.children[node].values()}  # another letter
        to = self._state(after, stem) if after or stem else -1
        self.moves[state][letter] = to
        return to

    def match(self, word: str) -> int | None:
        state = self.start
        for letter in word:
            to = self.moves[state].get(letter)
            if to is None:
                to = self._move(state, letter)
            if to < 0:
                return None
            state = to
        kinds = set()
        for node, edits in self.sets[state]:
            if node == "stem":
                kinds.add(STEM)
            elif edits == 0 and EXACT in self.ends[node]:
                kinds.add(EXACT)
            elif FUZZY in self.ends[node]:
                kinds.add(FUZZY)
        return min(kinds, default=None)


def _quoted(text: str, begin: int, end: int, spans: list[tuple[int, int]], at: int) -> bool:
    before = text[spans[max(0, at - CONTEXT)][0] : begin]
    behind = text[end : spans[min(len(spans) - 1, at + CONTEXT)][1]]
    opened = max((before.rfind(q) for q in OPENING), default=-1)
    closed = any(q in behind for q in CLOSING)
    straight = before.count('"') % 2 == 1 or any(before.rfind(q) > before.rfind(c) for q, c in zip(OPENING[1:], CLOSING[1:], strict=True))
    return opened >= 0 and closed and straight


def features(texts: list[str | None], matcher: Matcher) -> np.ndarray:
    """Per text: logarithms of its exact, stem, misspelled and quoted matches, and whether it has an unquoted one."""
    lowered = [(t or "").lower() for t in texts]
    words = [WORD.findall(t) for t in lowered]
    kinds = {w: kind for w in set().union(*words) if (kind := matcher.match(w)) is not None} if words else {}
    out = np.zeros((len(texts), 4))
    for i, own in enumerate(words):
        if kinds.keys().isdisjoint(own):
            continue
        spans = [m.span() for m in WORD.finditer(lowered[i])]
        for at, word in enumerate(own):
            kind = kinds.get(word)
            if kind is not None:
                out[i, 3 if _quoted(lowered[i], *spans[at], spans, at) else kind] += 1
    return np.column_stack([np.log1p(out), out[:, :3].sum(axis=1) > 0])


@dataclass
class Model:
    words: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))
    fuzzy_from: int = FUZZY_FROM

    def matcher(self) -> Matcher:
        return Matcher(self.words, self.stems, self.fuzzy_from)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    """Weights of a logistic model, the constant first, by Newton's method with a quadratic penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _association(a, b, pos: int, neg: int):
    """Log-likelihood ratio of a term in ``a`` of ``pos`` and ``b`` of ``neg`` rows."""
    n, m = float(pos + neg), a + b
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    return 2 * (part(a, m * pos / n) + part(b, m * neg / n) + part(pos - a, (n - m) * pos / n) + part(neg - b, (n - m) * neg / n))


def _terms(word: str) -> list[str]:
    """A word and its stems, which begin with an asterisk."""
    return [word, *("*" + word[:k] for k in STEMS if len(word) > k)]


def _counted(batches):
    """Terms of the texts and in how many of them each occurs, some more than once in the end."""
    seen: Counter = Counter()

    def table():
        return pa.RecordBatch.from_pydict({"term": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    for batch in K.pieces(batches, "text"):
        for text in batch.column("text").to_pylist():
            seen.update({term for word in set(WORD.findall(text.lower())) for term in _terms(word)})
        if len(seen) > TERMS:
            yield table()
            seen = Counter()
    yield table()


def _counts_of(rows: DataFrame, terms: list[str]) -> DataFrame:
    """In how many texts of ``rows`` each of ``terms`` occurs; those that occur in none may be missing.

    A task sends one row for every ``BIN`` terms, whose numbers are added up as arrays.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast({t: i for i, t in enumerate(sorted(terms))})

    def count(batches):
        place = sent.value
        total = np.zeros(-(-len(place) // BIN) * BIN, np.int64)
        for batch in K.pieces(batches, "text"):
            own = [set(WORD.findall(text.lower())) for text in batch.column("text").to_pylist()]
            met = {word: hits for word in set().union(*own) if (hits := [place[t] for t in _terms(word) if t in place])}
            found = [i for words in own for i in {i for word in words & met.keys() for i in met[word]}]
            total += np.bincount(found, minlength=len(total)).astype(np.int64) if found else 0
        parts = total.reshape(-1, BIN)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_pydict({"bin": pa.array(some), "numbers": pa.array([parts[k].tobytes() for k in some], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, numbers in zip(batch.column("bin").to_pylist(), batch.column("numbers").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(numbers, np.int64)
        names = list(sent.value) if sums else []
        for k, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"term": pa.array([names[k * BIN + i] for i in at], pa.string()), "b": pa.array(total[at])})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("text").mapInArrow(count, "bin long, numbers binary").repartition(parts, "bin").mapInArrow(add, "term string, b long")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fuzzy_from: int = FUZZY_FROM) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Null labels, ids and texts teach nothing; of several labels of one id the largest
    holds, and repeated rows of ``docs`` count as often as they stand.  The lexicon is
    counted on all labelled rows, the weights are fitted on at most ``sample`` ids,
    those with the least hashes (equal hashes by id).  Without rows of label 1 or of
    label 0, empty tables included, there is no lexicon and all texts score alike.

    Texts are shuffled once, for the join with their labels.  The lexicon and the
    weights reach the driver, as do up to ``SOUGHT`` terms at a time.
    """
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    # Labels grow with the texts, so the join is planned the same way at every size.
    labelled = keep(texts.join(chosen.hint("merge"), "doc_id").select("doc_id", "text", "y"))
    sizes = {r.y: r.n for r in labelled.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        return Model(weights=np.array([30.0 if pos else -30.0, 0, 0, 0, 0, 0]))
    positive, negative = labelled.where("y = 1"), labelled.where("y = 0")
    terms = keep(positive.select("text").mapInArrow(_counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("a")))
    # A term in no row of label 1 can't be associated with it, so those in some row are all that are tried.
    beyond_chance = 2 * math.log(max(2, terms.count())) + 3
    a, b = F.col("a").cast("double"), F.coalesce(F.col("b"), F.lit(0)).cast("double")
    # Nothing is more telling than to be in no row of label 0; what falls short then always does.
    hopeful = terms.where(_association(a, F.lit(0.0), pos, neg) >= beyond_chance)
    passes = max(1, -(-hopeful.count() // SOUGHT))
    found = []
    for k in range(passes):
        part = hopeful if passes == 1 else hopeful.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == k)
        sought = [r.term for r in part.select("term").collect()]
        counted = part.join(_counts_of(negative, sought), "term", "left")
        found += (
            counted.where(a * neg > b * pos * 5).withColumn("llr", _association(a, b, pos, neg)).where(F.col("llr") >= beyond_chance).select("llr", "term").collect()
        )
    found.sort(key=lambda r: (-r.llr, r.term))
    words = [r.term for r in found if r.term[0] != "*"]
    stems = [r.term[1:] for r in found if r.term[0] == "*"]
    ids = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
    rows = labelled.join(F.broadcast(ids), "doc_id").select("text", "y")  # at most ``sample`` ids
    sent, matcher = rows.sparkSession.sparkContext.broadcast((words, stems)), []

    def of_rows(batches):
        if not matcher:
            matcher.append(Matcher(*sent.value, fuzzy_from))
        for batch in K.pieces(batches, "text"):
            x = features(batch.column("text").to_pylist(), matcher[0])
            yield pa.RecordBatch.from_pydict({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "y": batch.column("y")})

    points = rows.mapInArrow(of_rows, "x array<double>, y int").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("x", "y").collect()  # at most ``sample``
    x = np.repeat(np.array([p.x for p in points]), [p.n for p in points], axis=0)
    return Model(words, stems, _fit(x, np.repeat([float(p.y) for p in points], [p.n for p in points])), fuzzy_from)


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """``carry`` columns of every row with score (0 to 1), from its whole text.

    Null counts as empty; texts without matches, empty ones too, share one score, and
    equal texts score alike.  No rows give no rows.
    """
    sent, matcher = docs.sparkSession.sparkContext.broadcast(model), []

    def of_batches(batches):
        if not matcher:
            matcher.append(sent.value.matcher())
        for batch in K.pieces(batches, "_text"):
            scores = sent.value.scores(features(batch.column("_text").to_pylist(), matcher[0]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(scores, pa.float64())], [*carry, "score"])

    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(of_batches, docs.select(*carry).schema.add("score", "double"))
