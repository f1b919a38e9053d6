import hashlib
import random

from courtflow.llm import blocks
from courtflow.llm.line_dedup import remove_similar_lines
from helpers import clashing, documents, empty, odd


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def words(line):
    return [w for w in line.translate({c: " " for c in range(9, 14)}).split(" ") if w]


def brute(rows):
    before, out = [], []
    for doc_id, text in rows:
        lines, kept = (text or "").split("\n") if text else [], []
        for line in lines:
            w = words(line)
            if not w or not any(w == v or len(w) >= 5 and len(v) >= 5 and abs(len(w) - len(v)) < 2 and distance(w, v) <= 1 for v in before):
                kept.append(line)
            if w:
                before.append(w)
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def test_equals_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BUCKET_KEYS", 400)
    real = blocks.Blocks.__init__
    monkeypatch.setattr(blocks.Blocks, "__init__", lambda self, docs, **k: real(self, docs, **k, block_bytes=1500))
    rnd = random.Random(2)
    base = [[rnd.choice("abcdefgh") * rnd.randrange(1, 3) for _ in range(rnd.randrange(1, 12))] for _ in range(25)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rnd.randrange(0, 7)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                at = rnd.randrange(len(line) + 1)
                line[at : at + rnd.randrange(2)] = rnd.choice([[], ["new"], [rnd.choice("xyz")]])
            lines.append(rnd.choice([" ", "\t", "  "]).join(line))
        rows.append((i, "\n".join(lines)))
    got = rows_of(remove_similar_lines(documents(spark, rows)))
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 50


def test_odd_rows(spark):
    df = odd(spark, [(20, "a\n\nb\n"), (21, "\n"), (22, "b\n"), (23, "x\n"), (24, "x")])
    by = [(r.doc_id, r.text) for r in df.collect()]
    by = [r for r in by if r[0] is None and r[1] is None] + [r for r in by if r[0] is None and r[1]] + sorted((r for r in by if r[0] is not None), key=lambda r: r[0])
    assert rows_of(remove_similar_lines(clashing(df))) == brute(by)
    assert remove_similar_lines(empty(spark)).count() == 0
