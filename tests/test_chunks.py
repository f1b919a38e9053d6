"""Results do not depend on how a timeline is cut."""

import numpy as np
import pandas as pd
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.catalog import events as CE
from courtflow.catalog import players as CP
from courtflow.functions import sequences as S
from courtflow.operators import audio as AU
from courtflow.operators import ball as B
from courtflow.operators import datasets as DS
from courtflow.operators import events as X
from courtflow.operators import hitters as HT
from courtflow.operators import players as PL
from courtflow.operators import positions as P
from courtflow.operators import rallies as R
from courtflow.operators import shots as SH

V = C.Video()


def same(small, large, *cols):
    a, b = rows_of(small, *cols), rows_of(large, *cols)
    assert a and a == b


@pytest.mark.parametrize("chunk", [7, 32])
def test_position_windows(tables, chunk):
    raw = tables.raw_positions
    cols = ["match_id", "role", "frame", "sx_m", "sy_m", "status"]
    same(P.smooth(raw, chunk=chunk), P.smooth(raw), *cols)
    same(P.steps(raw, chunk=chunk), P.steps(raw), "match_id", "role", "frame", "step_m", "outcome")
    same(P.player_summary(raw, 30.0, chunk=chunk), P.player_summary(raw, 30.0))
    same(P.contributing_ranges(raw, chunk=chunk), P.contributing_ranges(raw))


@pytest.mark.parametrize("chunk", [16, 64])
def test_ball_windows(tables, chunk):
    ball, cand = tables.ball, tables.candidates
    same(B.temporal_support(cand, V, chunk=chunk), B.temporal_support(cand, V), "frame", "detection_id", "support")
    same(B.smooth(ball, V, chunk=chunk), B.smooth(ball, V), "frame", "sx_px", "sy_px")
    same(B.fill_gaps(ball, V, chunk=chunk), B.fill_gaps(ball, V), "frame", "status", "x_px", "confidence")
    same(B.longest_missing(ball, chunk=chunk), B.longest_missing(ball))
    same(X.local_shape(ball, 6, 2, chunk=chunk), X.local_shape(ball, 6, 2), "frame", "bx", "by", "ax", "ay", "continuity")


def test_rally_windows(tables):
    a, b = R.kinematics(tables.ball, V, chunk=100), R.kinematics(tables.ball, V)
    same(a, b, "frame", "speed", "baseline", "onset", "refined_start", "displacement")


def test_onsets_gather_their_points_once(tables):
    onsets = R.kinematics(tables.ball, V).filter("onset").select("match_id", "frame", "refined_start")
    plan = onsets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_widest_pair_is_the_largest_distance():
    rng = np.random.default_rng(3)
    xs = pd.Series([rng.normal(size=n) for n in (1, 2, 37, 5)] + [None, np.array([])])
    ys = pd.Series([rng.normal(size=n) for n in (1, 2, 37, 5)] + [None, np.array([])])
    want = [max(np.hypot(a - c, b - d) for a, b in zip(x, y) for c, d in zip(x, y)) for x, y in zip(xs[:4], ys[:4])]
    got = R.widest_pair.func(xs, ys)
    assert np.allclose(got[:4], want) and got[4:].isna().all()


@pytest.mark.parametrize("chunk", [50, 300])
def test_association_over_chunks(tables, chunk):
    supported = B.temporal_support(tables.candidates, V)
    same(B.associate(supported, V, chunk=chunk), B.associate(supported, V))


@pytest.mark.parametrize("chunk", [60, 250])
def test_rally_walk_over_chunks(tables, chunk):
    kin = R.kinematics(tables.ball, V)
    jumps = R.onset_jumps(kin, V)
    from courtflow.functions.folds import state_fold

    walk = lambda size: state_fold(jumps, R.KEYS, "frame", (), R._Cursor, ("frame", "cursor"), "taken boolean", size)
    same(walk(chunk), walk(16384), "frame", "taken")


def test_tracklets_over_chunks(tables):
    ground = CP.ground_of(tables)
    same(PL.tracklets(ground, V, chunk=5), PL.tracklets(ground, V), "frame", "detection_id", "tracklet_id", "link")
    same(PL.tracklets(ground, V, chunk=13), PL.tracklets(ground, V), "frame", "detection_id", "tracklet_id", "link")


def test_identities_over_chunks(tables):
    obs, a = CP._observations(tables), CP.anchors_of(tables)
    seeds = a.select("match_id", "role", "side", F.col("anchor_frame").alias("frame"), F.col("detection_id").alias("observation_id"), F.lit(True).alias("manual"))
    same(PL.resolve_identities(obs, seeds, chunk=17), PL.resolve_identities(obs, seeds))


def test_hitters_over_chunks(tables):
    contacts = CP.plain_contacts(tables)
    players = CP.players_at(tables, contacts)
    same(HT.identify(contacts, players, V, chunk=90), HT.identify(contacts, players, V), "frame", "hitter_id", "hitter_confidence", "context_used")


def test_running_lookups(tables):
    ball = tables.ball
    same(SH.linked_speeds(ball, V, chunk=40), SH.linked_speeds(ball, V))
    points = ball.select("match_id", "frame")
    same(X.bounce_context(points, CE.bounces_of(tables), 30.0, 0.08, chunk=25), X.bounce_context(points, CE.bounces_of(tables), 30.0, 0.08))
    same(AU.peaks(AU.robust_scores(CP.audio_features(tables)), chunk=20), AU.peaks(AU.robust_scores(CP.audio_features(tables))), "window_ix", "z")
    same(R.player_reset(tables.raw_positions, 30.0, chunk=60), R.player_reset(tables.raw_positions, 30.0))


def _clusters(values, gap, at_gap):
    out, start, before = {}, None, None
    for v in sorted(values):
        if before is None or (v - before >= gap if at_gap else v - before > gap):
            start = v
        out[v] = start
        before = v
    return out


@pytest.mark.parametrize("size", [3, 10, 1000])
@pytest.mark.parametrize("at_gap", [True, False])
def test_cluster_starts(spark, size, at_gap):
    rng = np.random.default_rng(5)
    values = sorted(set(rng.integers(0, 400, 90).tolist()))
    df = spark.createDataFrame([(1, v) for v in values], "k int, p bigint")
    got = {r.p: r.c for r in S.cluster_starts(df, ["k"], "p", 4, size, "c", at_gap).collect()}
    assert got == _clusters(values, 4, at_gap)


@pytest.mark.parametrize("size", [5, 40, 5000])
def test_merged_starts(spark, size):
    rng = np.random.default_rng(8)
    spans = [(int(s), int(s + d)) for s, d in zip(rng.integers(0, 900, 80), rng.integers(0, 60, 80))] + [(100, 130), (100, 130)]
    df = spark.createDataFrame([(1, i, s, e) for i, (s, e) in enumerate(spans)], "k int, i int, s bigint, e bigint")
    got = {r.i: r.cluster for r in S.merged_starts(df, ["k"], "s", "e", 2, size).collect()}
    reach, label, want = None, None, {}
    for i, (s, e) in sorted(enumerate(spans), key=lambda x: x[1]):
        if reach is None or s > reach + 2:
            label = s
        reach = e if reach is None else max(reach, e)
        want[i] = label
    assert got == want


@pytest.mark.parametrize("size", [4, 1000])
def test_running_count_and_last_before(spark, size):
    rng = np.random.default_rng(2)
    values = sorted(set(rng.integers(0, 200, 60).tolist()))
    df = spark.createDataFrame([(1, v, v if v % 5 == 0 else None) for v in values], "k int, p bigint, m bigint")
    got = {r.p: r.n for r in S.running_count(df, ["k"], "p", size, "n").collect()}
    assert got == {v: i for i, v in enumerate(values, 1)}
    back = {r.p: r.b for r in S.last_before(df, ["k"], "p", F.col("m"), size, "b").collect()}
    assert back == {v: max([w for w in values if w < v and w % 5 == 0], default=None) for v in values}


@pytest.mark.parametrize("width", [0.1, 3.0, 500.0])
def test_exact_median(spark, width):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"k": rng.integers(0, 4, 301), "v": rng.normal(0, 5, 301).round(2)})
    got = {r.k: r.m for r in AU.exact_median(spark.createDataFrame(frame), ["k"], "v", width, "m").collect()}
    want = frame.groupby("k").v.median()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want.index)


@pytest.mark.parametrize("most", [1, 7])
def test_exact_median_refines_only_the_middle(spark, most):
    """Mostly silence, all values in one wide bucket, and a key of a single value."""
    rng = np.random.default_rng(4)
    values = np.concatenate([np.zeros(300), rng.normal(0, 0.01, 200).round(5), rng.normal(0, 1e-4, 300)])
    keys = np.concatenate([np.zeros(300), np.zeros(200), np.ones(300)]).astype(int)
    frame = pd.concat([pd.DataFrame({"k": keys, "v": values}), pd.DataFrame({"k": [2, 3, 3], "v": [5.0, -1.0, 4.0]})])
    got = {r.k: r.m for r in AU.exact_median(spark.createDataFrame(frame), ["k"], "v", 100.0, "m", most).collect()}
    want = frame.groupby("k").v.median()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want.index) and len(got) == 4


def test_sample_exactly_is_whole_and_seeded(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    one = rows_of(DS.sample_exactly(df, ["k"], 40, 7, "id"))
    assert len(one) == 120 and one == rows_of(DS.sample_exactly(df.repartition(5), ["k"], 40, 7, "id"))
    assert one != rows_of(DS.sample_exactly(df, ["k"], 40, 8, "id"))


def test_folds_keep_large_ids_beside_nulls(spark):
    from courtflow.functions.folds import sorted_fold, state_fold

    class _Sum:
        def __init__(self, state=None):
            self.total = state or 0

        def state(self):
            return self.total

        def step(self, value):
            self.total += value or 0
            return (self.total,)

    ids = [2**53 + 1, None, 2**53 + 3, None, -(2**62) - 1]
    df = spark.createDataFrame([(1, k, i, v) for k, (i, v) in enumerate(zip(ids, [5, None, 7, 2**53 + 1, 1]))], "match_id long, frame long, big long, value long")
    want = [(i, t) for i, t in zip(ids, [5, 5, 12, 2**53 + 13, 2**53 + 14])]
    for out in (
        sorted_fold(df, ["match_id"], ["frame"], _Sum, ["value"], "total bigint"),
        state_fold(df, ["match_id"], "frame", (), _Sum, ["value"], "total bigint", 2),
    ):
        assert [(r.big, r.total) for r in out.orderBy("frame").collect()] == want


def test_steady_persons_need_two_rounds(spark, monkeypatch):
    """Four persons who walk slowly keep one name each through twenty chunks."""
    from functools import partial

    from courtflow.functions.folds import state_fold

    rows = [(1, f, f * 4 + p, f / 30.0, 100.0 + 400 * p, 500.0, 1.0 + p + f / 900, 3.0 if p < 2 else 10.0, "near_side" if p < 2 else "far_side", 400.0, 500.0) for f in range(800) for p in range(4)]
    kind = "match_id long, frame long, detection_id long, t_s double, gx_px double, gy_px double, x_m double, y_m double, side string, t double, b double"
    ground = spark.createDataFrame(rows, kind)
    monkeypatch.setattr(PL, "state_fold", partial(state_fold, max_rounds=2))
    got = PL.tracklets(ground, V, chunk=40).select("detection_id", "tracklet_id").collect()
    assert len(got) == 3200 and all(r.tracklet_id == r.detection_id % 4 for r in got)


def test_walks_settle_in_few_rounds(tables, monkeypatch):
    """Results over twenty chunks equal one chunk's, in at most three rounds."""
    from functools import partial

    from courtflow.functions.folds import state_fold
    from courtflow.operators import hitters

    few = partial(state_fold, max_rounds=3)
    for module in (B, hitters):
        monkeypatch.setattr(module, "state_fold", few)
    supported = B.temporal_support(tables.candidates, V)
    same(B.associate(supported, V, chunk=50), B.associate(supported, V))
    contacts = CP.plain_contacts(tables)
    people = CP.players_at(tables, contacts)
    same(HT.identify(contacts, people, V, chunk=50), HT.identify(contacts, people, V), "frame", "hitter_id", "hitter_confidence", "context_used")
