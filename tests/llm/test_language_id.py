import random
import tracemalloc

import numpy as np
import pytest
from conftest import SF
from courtflow.llm import queries
from courtflow.llm.language_id import DIMENSIONS, bundled_shares, bundles, identify, learn, letter_vectors, rejected
from helpers import clashing, documents, empty, odd


def plain_vector(text):
    """Bundle of the bound trigrams, one at a time."""
    out = np.zeros(DIMENSIONS)
    gaps = "".join(c if c.isalpha() else "\0" for c in " " + text.lower() + " ")
    while "\0\0" in gaps:
        gaps = gaps.replace("\0\0", "\0")
    for i in range(len(gaps) - 2):
        if gaps[i + 1] != "\0":
            a, b, c = letter_vectors(np.array([ord(x) for x in gaps[i : i + 3]]))
            out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


@pytest.mark.parametrize("tile", [3, 4096])
def test_bundles_equal_plain_ones(tile, monkeypatch):
    monkeypatch.setattr("courtflow.llm.language_id.TILE", tile)
    texts = ["Hello, wörld!! 12 a", "", "x", "日本語 テスト abc", "...", "A" * 50, None]
    got, sizes = bundles(texts, 2)
    want = np.array([plain_vector(t or "") for t in texts])
    assert np.array_equal(got, want) and sizes.tolist() == [11, 0, 1, 9, 0, 50, 0]
    labels = np.array([0, 0, 1, 1, 2, 0, 2])
    shares = bundled_shares(texts, labels, 3)
    plain = [sum(want[i] / max(1, sizes[i]) for i in range(len(texts)) if labels[i] == k) for k in range(3)]
    assert np.allclose(shares, plain)


def test_memory_does_not_grow_with_the_alphabet():
    rnd = random.Random(1)
    text = "".join(chr(rnd.randrange(0x4E00, 0x9FA0)) for _ in range(200_000))
    tracemalloc.start()
    bundles([text] * 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20  # 200,000 vectors alone would be as much


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_rows(spark):
    df = odd(spark)
    prototypes = learn(clashing(df))
    got = identify(df, prototypes, ["doc_id", "text"]).collect()
    assert len(got) == df.count() and set(prototypes.langs) == {"de", "en"}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert identify(empty(spark), prototypes, ["doc_id"]).count() == 0
    nothing = learn(empty(spark))
    assert nothing.langs == [] and {r.lang_pred for r in identify(documents(spark, [(1, "abc def")]), nothing, ["doc_id"]).collect()} == {"und"}


def test_rejection_at_every_length(spark):
    rows = spark.createDataFrame([("en", 0.1, 10), ("en", 0.1, 60), ("en", 0.9, 60), ("und", 0.0, 0)], "lang_pred string, score double, trigrams long")
    assert [r[0] for r in rows.select(rejected()).collect()] == [False, True, False, True]
    assert [r[0] for r in rows.select(rejected(enough=0)).collect()] == [True, True, False, True]
