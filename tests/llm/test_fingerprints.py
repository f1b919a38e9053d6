import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from courtflow.llm import blocks
from courtflow.llm.fingerprints import as_text, compare_with_edits, fingerprint, signatures
from helpers import clashing, documents, empty, odd


def generalised_jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    return sum(min(a[w], b[w]) for w in a | b) / sum(max(a[w], b[w]) for w in a | b)


def test_collision_rate_is_the_generalised_jaccard_similarity():
    rnd = random.Random(5)
    pairs = []
    for _ in range(300):
        words = [f"w{rnd.randrange(60)}" for _ in range(200)]
        cut = rnd.randrange(200)
        pairs.append((" ".join(words), " ".join(words[:cut] + [f"v{rnd.randrange(60)}" for _ in range(cut, 200)])))
    a, b = signatures(pa.array([p[0] for p in pairs])), signatures(pa.array([p[1] for p in pairs]))
    error = (a == b).mean(axis=1) - np.array([generalised_jaccard(*p) for p in pairs])
    assert abs(error.mean()) < 0.02
    assert np.sqrt((error**2).mean()) < 0.07


def test_edits_over_many_blocks(spark, monkeypatch):
    real = blocks.Blocks.__init__
    monkeypatch.setattr(blocks.Blocks, "__init__", lambda self, docs, **k: real(self, docs, **k, block_bytes=700))
    rnd = random.Random(9)
    rows = [(7 * i % 101, " ".join(rnd.choice(["é", "a", "bb", "x"]) * rnd.randrange(1, 4) for _ in range(rnd.randrange(0, 50)))) for i in range(101)]
    got = {r.doc_id: r for r in compare_with_edits(documents(spark, rows)).collect()}
    rows.sort()
    assert len(got) == 101
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % 101][1]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        a, b, c = as_text(signatures(pa.array([text, changed, following])))
        assert (r.fingerprint, r.edited_fingerprint) == (a, b)
        alike = lambda x, y: sum(x[i : i + 4] == y[i : i + 4] for i in range(0, len(x), 4)) / 64
        if text and following and changed:
            assert (r.near_edited, r.near_next) == (alike(a, b), alike(a, c))


def test_odd_rows(spark):
    df = odd(spark)
    got = compare_with_edits(clashing(df)).collect()
    assert len(got) == df.count()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 1 and {r.fingerprint for r in got if r.doc_id == 4} <= {r.fingerprint for r in got if r.doc_id == 5}
    assert compare_with_edits(empty(spark)).count() == 0 and fingerprint(empty(spark), ["doc_id"]).count() == 0
    one = compare_with_edits(documents(spark, [(1, "only one text here")])).collect()
    assert one[0].near_next == 1.0
