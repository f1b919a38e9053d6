import random

from courtflow.llm import blocks
from courtflow.llm.ngram_join import link_components
from helpers import clashing, documents, empty, odd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in (text or "").translate(LOWER).translate({c: " " for c in range(9, 14)}).split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def family(rnd, size, length, edits):
    base = [f"w{rnd.randrange(200)}" for _ in range(length)]
    for _ in range(size):
        own = list(base)
        for _ in range(rnd.randrange(edits)):
            own[rnd.randrange(length)] = f"v{rnd.randrange(5000)}"
        yield " ".join(own)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BUCKET_KEYS", 3000)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    rnd = random.Random(4)
    texts = [*family(rnd, 120, 60, 6), *family(rnd, 60, 25, 4), *family(rnd, 40, 8, 3), *family(rnd, 30, 3, 2)]
    texts += [" ".join(f"w{rnd.randrange(200)}" for _ in range(rnd.randrange(80))) for _ in range(60)]
    texts += rnd.choices(texts, k=40)
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    got = rows_of(link_components(documents(spark, rows)))
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) - 60


def test_odd_rows(spark):
    df = odd(spark)
    assert rows_of(link_components(clashing(df))) == brute([(r.doc_id, r.text) for r in df.collect()])
    assert link_components(empty(spark)).count() == 0
