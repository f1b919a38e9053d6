"""Decisions from the best down equal a plain loop, however long a chain and however it is cut."""

import random

import pytest
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions import folds
from courtflow.operators import matching as M
from courtflow.operators import rallies as R


def loop_pairs(pairs):
    left, right, out = set(), set(), []
    for p, t, *_ in sorted(pairs, key=lambda x: (x[2], x[0], x[1])):
        if p not in left and t not in right:
            left.add(p)
            right.add(t)
            out.append((p, t))
    return sorted(out)


def chain(n, delta):
    """Predicted event i may be true event i or i + 1, so all proposals hang together."""
    return [(i, i + k, delta(2 * i + k), float(i)) for i in range(n) for k in (0, 1)]


def matched(spark, pairs, size):
    df = spark.createDataFrame(pairs, "p long, t long, d double, at double").withColumn("m", F.lit(1))
    got = M.greedy_pairs(df, ["m"], "p", "t", F.col("at"), F.col("at") + 1, [F.asc("d"), F.asc("p"), F.asc("t")], size, 1.0)
    return sorted((r.p, r.t) for r in got.collect())


@pytest.mark.parametrize("size", [6.0, 1e6])
def test_small_chains(spark, size):
    rnd = random.Random(5)
    for make in (lambda i: rnd.random(), lambda i: float(i % 3)):
        pairs = chain(60, make)
        assert matched(spark, pairs, size) == loop_pairs(pairs)


def test_a_chain_of_100000_in_many_tasks(spark, monkeypatch):
    rnd = random.Random(6)
    pairs = chain(50_000, lambda i: rnd.random())
    largest = []
    plain = folds.sorted_fold

    def watched(df, group, *rest):
        largest.append(df.groupBy(*group).count().agg(F.max("count")).first()[0])
        return plain(df, group, *rest)

    monkeypatch.setattr(folds, "sorted_fold", watched)
    assert matched(spark, pairs, 4000.0) == loop_pairs(pairs)
    assert len(largest) <= 4 and max(largest) <= 8020


def test_a_chain_without_a_best_row_but_one_end(spark):
    """Every decision hangs on the next: a round per chunk, and still the plain result."""
    pairs = chain(200, lambda i: -float(i))
    assert matched(spark, pairs, 50.0) == loop_pairs(pairs)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("size", [60, 100_000])
def test_suppression(spark, size, inclusive):
    rnd = random.Random(9)
    rows = [(1, f, rnd.random()) for f in sorted(rnd.sample(range(900), 400))] + [(2, f, float(f)) for f in range(0, 300, 2)] + [(None, f, 1.0) for f in range(0, 40, 3)]
    kept, want = {}, []
    for m, f, s in sorted(rows, key=lambda r: (-r[2], r[1])):
        if all(abs(f - g) > 5 or (not inclusive and abs(f - g) == 5) for g in kept.get(m, ())):
            kept.setdefault(m, []).append(f)
            want.append((m, f))
    df = spark.createDataFrame(rows, "m int, f long, s double")
    got = [(r.m, r.f) for r in M.suppress_near(df, ["m"], "f", "s", 5, inclusive, size).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("chunk", [700, 100_000])
def test_bursts(spark, chunk):
    s, video, rnd = C.RallySettings(), C.Video(), random.Random(4)
    rows, at = [], 0
    for i in range(160):
        at += rnd.randrange(5, 130)
        end = at + rnd.randrange(10, 200)
        rows.append((1, i, at, end, round(rnd.random(), 2), rnd.random()))
        at = end
    kept, want = [], []
    for _, i, a, b, q, c in sorted(rows, key=lambda r: (-r[4], r[2] - r[3], -r[5], r[1])):
        best = None
        for j, x, y, p in kept:
            gap = max(0.0, ((a - y - 1) if a >= x else (x - b - 1)) / video.fps)
            if gap <= s.handoff_window_s and p - q >= s.handoff_margin and (best is None or p > best[1]):
                best = (j, p, gap)
        if best is None:
            kept.append((i, a, b, q))
        want.append((i, best is None, best and best[0], best and round(best[2], 6)))
    df = spark.createDataFrame(rows, "match_id long, candidate_no long, start_frame long, end_frame long, quality double, confidence double")
    got = [(r.candidate_no, r.accepted, r.stronger_no, r.gap_s if r.gap_s is None else round(r.gap_s, 6)) for r in R.resolve_bursts(df, video, s, chunk).collect()]
    assert sorted(got) == sorted(want) and any(not w[1] for w in want)
