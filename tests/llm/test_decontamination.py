import random
import re

from courtflow.llm.decontamination import SPAN, contamination, uncontaminated
from helpers import clashing, documents, empty, odd

KIND = "item_id long, text string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items):
    out = []
    for doc_id, text in rows:
        w, hit, ids = words(text), set(), set()
        for item_id, passage in items:
            v = words(passage)
            n = min(SPAN, len(v))
            for i in range(len(v) - n + 1 if n else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[i : i + n]:
                        hit.update(range(k, k + n))
                        ids.update([item_id] if item_id is not None else [])
        out.append((doc_id, len(w), len(hit), sorted(map(str, ids))))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()), key=str)


def test_equals_brute_force_with_short_and_repetitive_items(spark):
    rnd = random.Random(8)
    draw = lambda n, k: [rnd.choice([f"w{i}" for i in range(k)]) for _ in range(n)]
    items = [(i, " ".join(draw(rnd.randrange(0, 30), 40))) for i in range(30)] + [(90 + n, " ".join(draw(n, 3))) for n in range(1, 10)]
    items += [(200, "a a a a a a a a a a a a a"), (201, None), (202, "Zoë, x-Y 9"), (203, "zoë x y 9")]
    rows = []
    for i in range(150):
        w = draw(rnd.randrange(40), 40)
        for _ in range(rnd.randrange(3)):
            v = words(rnd.choice(items)[1])
            a = rnd.randrange(len(v) + 1)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = v[a : a + rnd.randrange(1, 25)]
        rows.append((i, rnd.choice([" ", ", ", "-"]).join(w)))
    rows.append((999, "a " * 30 + "ZOË x y 9"))
    docs, benchmark = documents(spark, rows), spark.createDataFrame(items, KIND)
    got = rows_of(contamination(docs, benchmark))
    assert got == brute(rows, items)
    assert sum(r[2] > 0 for r in got) > 50
    assert sorted(r.doc_id for r in uncontaminated(docs, benchmark).collect()) == sorted(r[0] for r in got if not r[2])


def test_odd_rows(spark):
    df = odd(spark)
    items = [(1, "the quick brown fox jumps over the lazy dog the"), (None, "no id"), (2, None), (3, "straße"), (None, "straße 12")]
    benchmark = spark.createDataFrame(items, KIND)
    want = brute([(r.doc_id, r.text) for r in df.collect()], items)
    assert rows_of(contamination(clashing(df), clashing(benchmark))) == want
    kept = uncontaminated(df, spark.createDataFrame([(None, "no id")], KIND)).collect()
    assert len(kept) == df.count() - 1 and all("no id" not in (r.text or "") for r in kept)
    assert uncontaminated(clashing(df), benchmark).columns == clashing(df).columns
    assert contamination(empty(spark), benchmark).count() == 0
    assert all(r.n_hit == 0 for r in contamination(df, spark.createDataFrame([], KIND)).collect())
