import random

from courtflow.llm.toxicity import EXACT, FUZZY, STEM, Matcher, _quoted, learn, score
from helpers import clashing, documents, empty, odd

LABELS = "doc_id long, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abc", k=rnd.randrange(2, 8))) for _ in range(25)]
    stems = ["cabca", "bbbb"]
    matcher = Matcher(words, stems)
    seen = set()
    for _ in range(4000):
        w = "".join(rnd.choices("abcd", k=rnd.randrange(1, 9)))
        want = EXACT if w in words else STEM if any(w.startswith(s) for s in stems) else FUZZY if any(len(x) >= 5 and distance(w, x) <= 1 for x in words) else None
        assert matcher.match(w) == want, w
        seen.add(want)
    assert seen == {EXACT, STEM, FUZZY, None}


def test_quotation():
    text = 'he said "you fool" and left'
    spans = [(0, 2), (3, 7), (9, 12), (13, 17), (19, 22), (23, 27)]
    assert _quoted(text, 13, 17, spans, 3) and not _quoted(text, 3, 7, spans, 1)
    assert _quoted("a «b c» d", 3, 4, [(0, 1), (3, 4), (5, 6), (8, 9)], 1)


def test_learned_scores(spark):
    rnd = random.Random(3)
    draw = lambda: [rnd.choice([f"word{i}" for i in range(300)]) for _ in range(40)]
    rows, labels = [], []
    for i in range(900):
        w, toxic = draw(), i % 5 == 0
        if toxic:
            w[rnd.randrange(40)] = rnd.choice(["villain", "numbskull", "grumbleA", "grumbleBe", "grumbleCee"] if i < 800 else ["vilain", "numbskulll", "grumbleZz"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    docs = documents(spark, rows)
    model = learn(docs, spark.createDataFrame(labels[:800], LABELS))
    assert {"villain", "numbskull"} <= set(model.words) and any("grumble".startswith(s) or s.startswith("grumb") for s in model.stems)
    got = {r.doc_id: r.score for r in score(docs, model, ["doc_id"]).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels)


def test_odd_rows(spark):
    df = odd(spark)
    some = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (5, None), (5, 0), (5, 1)], LABELS)
    got = score(clashing(df), learn(clashing(df), clashing(some)), ["doc_id"]).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    none = learn(df, spark.createDataFrame([], LABELS))
    assert all(r.score < 0.3 for r in score(df, none, ["doc_id"]).collect())
    assert score(empty(spark), none, ["doc_id"]).count() == 0
