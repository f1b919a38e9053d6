import hashlib
import random

from courtflow.llm import blocks
from courtflow.llm.suffix_dedup import remove_repeats
from helpers import clashing, documents, empty, odd


def brute(rows, width=100):
    """rows: (doc_id, text) in order."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            window = data[i : i + width]
            if window in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in df.collect()), key=str)


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BUCKET_KEYS", 500)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdeé ", k=6))
    passage = ["".join(word() for _ in range(30)) for _ in range(4)]
    rows = []
    for i in range(60):
        text = "".join(word() for _ in range(rnd.randrange(0, 120)))
        if i % 3 == 0:
            text += rnd.choice(passage)[rnd.randrange(60) :] + word()
        if i % 7 == 0:
            text += "ab" * 150
        rows.append((i, rows[rnd.randrange(len(rows))][1] if i % 11 == 10 else text))
    real = blocks.Blocks.__init__
    monkeypatch.setattr(blocks.Blocks, "__init__", lambda self, docs, **k: real(self, docs, **k, block_bytes=3000))
    got = rows_of(remove_repeats(documents(spark, rows)))
    assert got == sorted(brute(rows), key=str)
    assert sum(r[2] for r in got) > 3000


def test_odd_rows(spark):
    df = odd(spark)
    got = rows_of(remove_repeats(clashing(df)))
    assert len(got) == df.count()
    by = [(r.doc_id, r.text) for r in df.collect()]
    by = [r for r in by if r[0] is None] + sorted((r for r in by if r[0] is not None), key=lambda r: r[0])
    assert got == sorted(brute(by), key=str)
    assert remove_repeats(empty(spark)).count() == 0
