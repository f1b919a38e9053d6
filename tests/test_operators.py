"""Small examples with known answers, and random cases against plain loops."""

import json
import math
import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.catalog import events as CE
from courtflow.functions import geometry as G
from courtflow.functions.roster import roster
from courtflow.operators import analytics as A
from courtflow.operators import audio as AU
from courtflow.operators import ball as B
from courtflow.operators import corrections as K
from courtflow.operators import datasets as DS
from courtflow.operators import evaluation as E
from courtflow.operators import events as X
from courtflow.operators import hitters as HT
from courtflow.operators import matching as M
from courtflow.operators import positions as P
from courtflow.operators import rallies as R
from courtflow.operators import regions as RG
from courtflow.operators import shots as SH

V = C.Video()


# --- matching ---------------------------------------------------------------

def greedy(pairs):
    used_a, used_b, out = set(), set(), set()
    for *_, a, b in sorted(pairs):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_time_matches_equal_plain_greedy(spark, seed):
    rng = random.Random(seed)
    p = [(1, i, round(rng.uniform(0, 60), 3), rng.choice([0.5, 0.7, 0.9])) for i in range(250)]
    t = [(1, j, round(rng.uniform(0, 60), 3)) for j in range(250)]
    got = M.time_matches(
        spark.createDataFrame(p, "m int, a bigint, pt double, s double"), spark.createDataFrame(t, "m int, b bigint, tt double"),
        ["m"], "a", "b", "pt", "tt", "s", 0.1)
    want = greedy([(abs(x[2] - y[2]), -x[3], x[1], y[1], x[1], y[1]) for x in p for y in t if abs(x[2] - y[2]) <= 0.1])
    assert {(r.a, r.b) for r in got.collect()} == want


@pytest.mark.parametrize("inclusive", [True, False])
def test_suppression_equals_plain_loop(spark, inclusive):
    rng = random.Random(4)
    rows = {f: rng.choice([0.4, 0.5, 0.6, 0.9]) for f in rng.sample(range(600), 220)}
    df = spark.createDataFrame([(1, f, c) for f, c in rows.items()], "m int, f bigint, c double")
    got = {r.f for r in M.suppress_near(df, ["m"], "f", "c", 5, inclusive, 50).collect()}
    kept = []
    for f, _ in sorted(rows.items(), key=lambda x: (-x[1], x[0])):
        if not any(abs(f - k) < 5 or (inclusive and abs(f - k) == 5) for k in kept):
            kept.append(f)
    assert got == set(kept)


def test_reviews_take_the_nearest_free_one(spark):
    rng = random.Random(9)
    shots = [("h", i, round(rng.uniform(0, 30), 3)) for i in range(80)]
    reviews = [("h", j, round(rng.uniform(0, 30), 3)) for j in range(60)]
    got = {(r.shot_id, r.review_id) for r in DS.overlay_reviews(
        spark.createDataFrame(shots, "source_hash string, shot_id bigint, shot_s double"),
        spark.createDataFrame(reviews, "source_hash string, review_id bigint, review_s double")).collect()}
    free, want = dict((j, t) for _, j, t in reviews), set()
    for _, i, t in sorted(shots, key=lambda s: (s[2], s[1])):
        if free:
            j = min(free, key=lambda j: (abs(free[j] - t), j))
            if abs(free[j] - t) <= 0.25:
                want.add((i, j))
                del free[j]
    assert got == want


def test_dense_reviews_are_not_listed_as_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("every shot met every review of its gate")

    monkeypatch.setattr(DS, "band_join", refuse, raising=False)
    rng = random.Random(11)
    # Many on equal times; reviews thin out, so that chunks begin with all taken as well as with many free.
    shots = [("h", i, rng.randrange(150) / 30) for i in range(900)]
    reviews = [("h", j, rng.randrange(1500) ** 2 / 4.5e5) for j in range(900)]
    want, free = set(), {j: t for _, j, t in reviews}
    for _, i, t in sorted(shots, key=lambda s: (s[2], s[1])):
        j = min(free, key=lambda j: (abs(t - free[j]), j))
        if abs(t - free[j]) <= 0.25:
            want.add((i, j))
            del free[j]
    for size in (0.6, 4.0):
        got = DS.overlay_reviews(
            spark.createDataFrame([*shots, shots[3], ("h", 999, None)], "source_hash string, shot_id bigint, shot_s double"),
            spark.createDataFrame([*reviews, reviews[5]], "source_hash string, review_id bigint, review_s double"), size=size).collect()
        assert sorted((r.shot_id, r.review_id) for r in got) == sorted(want)


def iou(a, b):
    w, h = max(0.0, min(a[2], b[2]) - max(a[0], b[0])), max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def test_box_matching_equals_plain_loop(spark):
    rng = random.Random(6)
    box = lambda: (lambda x, y: (x, y, x + rng.uniform(20, 60), y + rng.uniform(20, 60)))(rng.uniform(0, 90), rng.uniform(0, 90))
    det = [(f, f * 100 + i, *box(), round(rng.random(), 3)) for f in range(30) for i in range(8)]
    true = [(f, f * 100 + i, *box(), "near") for f in range(30) for i in range(6)]
    got = {r.box_id: r.truth_id for r in E.match_boxes(
        spark.createDataFrame(det, "frame_id bigint, box_id bigint, l double, t double, r double, b double, confidence double"),
        spark.createDataFrame(true, "frame_id bigint, truth_id bigint, l double, t double, r double, b double, side string"), 0.3).collect()}
    want = {}
    for f in range(30):
        free = [t for t in true if t[0] == f]
        for d in sorted((d for d in det if d[0] == f), key=lambda d: (-d[6], d[1])):
            best = max(free, key=lambda t: iou(d[2:6], t[2:6]), default=None)
            hit = best is not None and iou(d[2:6], best[2:6]) >= 0.3
            want[d[1]] = best[1] if hit else None
            if hit:
                free.remove(best)
    assert got == want and any(want.values())


def test_splits_equal_plain_greedy(spark):
    rng = random.Random(3)
    sizes = {f"u{i}": rng.choice([1, 2, 2, 5, 9]) for i in range(60)}
    rows = [(u,) for u, n in sizes.items() for _ in range(n)]
    got = {r.unit: (r.size, r.split) for r in DS.assign_splits(spark.createDataFrame(rows, "u string"), F.col("u"), seed=11).collect()}
    assert {u: s for u, (s, _) in got.items()} == sizes
    total, counts = len(rows), [0, 0, 0]
    targets = [0.7 * total, 0.15 * total, 0.15 * total]
    want: dict = {}
    for size in sorted(set(sizes.values()), reverse=True):
        for _ in range(sum(s == size for s in sizes.values())):
            pick = min(range(3), key=lambda i: (sum(abs(c + (size if i == j else 0) - t) for j, (c, t) in enumerate(zip(counts, targets))), i))
            counts[pick] += size
            want[size, DS.SPLITS[pick]] = want.get((size, DS.SPLITS[pick]), 0) + 1
    have: dict = {}
    for s, split in got.values():
        have[s, split] = have.get((s, split), 0) + 1
    assert have == want


# --- analytics --------------------------------------------------------------

def test_match_example(spark):
    rallies = spark.createDataFrame([(1, 1, 0, 4, 0.0, 0.4, 0.8), (1, 2, 5, 9, 0.5, 0.9, 0.6)], "match_id bigint, rally_id bigint, start_frame bigint, end_frame bigint, start_s double, end_s double, confidence double")
    kinds = [("ME", "SERVE"), ("OPPONENT_1", "RETURN"), ("ME", "DROP"), ("OPPONENT_2", "SERVE"), ("UNKNOWN", "UNKNOWN")]
    shots = spark.createDataFrame(
        [(1, 1 if i < 3 else 2, i, i + 1 if i < 3 else i - 2, h, k, 0.7, 0.8, 3.0, 4.6, "inside") for i, (h, k) in enumerate(kinds)],
        "match_id bigint, rally_id bigint, shot_id bigint, shot_index bigint, hitter_id string, shot_type string, confidence double, hitter_confidence double, hitter_x_m double, hitter_y_m double, hitter_region string")
    m = A.match_metrics(rallies, shots).first()
    assert (m.rally_count, m.shot_count, m.longest_rally_id, m.longest_shots) == (2, 5, 1, 3)
    assert m.mean_length == 2.5 and abs(m.mean_duration_s - 0.4) < 1e-9
    hits = {(r.player_id, r.shot_type): (r.n, r.rate) for r in A.player_hits(shots).collect()}
    assert hits["ME", "DROP"] == (1, 0.5) and hits["PARTNER", "DROP"] == (0, None)
    third = A.third_shots(shots).first()
    assert (third.third_shots, third.drop_rate, third.drive_rate) == (1, 1.0, 0.0)
    cells = {(r.zone, r.shot_type): (r.n, r.zone_total) for r in A.shot_selection(shots).collect()}
    assert cells["kitchen", "DROP"] == (1, 4) and cells["backcourt", "DROP"] == (0, 0)


def test_document_reads_its_shots_once(spark):
    rng = random.Random(8)
    rallies = spark.createDataFrame(
        [(m, r, 50 * r, 50 * r + 30, 2.0 * r, 2.0 * r + rng.random(), rng.random()) for m in (1, 2, 3) for r in range(4)] + [(None, 1, 0, 9, 0.0, 0.3, 0.5)],
        "match_id bigint, rally_id bigint, start_frame bigint, end_frame bigint, start_s double, end_s double, confidence double")
    rows = [
        (rng.choice([1, 2, 4, None]), rng.choice([0, 1, 2, 7, None]), i, rng.randint(1, 4), rng.choice([*C.ROLES, "UNKNOWN"]), rng.choice(C.SHOT_TYPES),
         rng.random(), rng.random(), 3.0, rng.uniform(0, 13), rng.choice(["inside", "near", "ambiguous"])) for i in range(200)]
    read = spark.sparkContext.accumulator(0)
    shots = spark.createDataFrame(
        spark.sparkContext.parallelize(rows, 4).map(lambda row: (read.add(1), row)[1]),
        "match_id bigint, rally_id bigint, shot_id bigint, shot_index bigint, hitter_id string, shot_type string, confidence double, hitter_confidence double, hitter_x_m double, hitter_y_m double, hitter_region string")
    positions = spark.createDataFrame(
        [(1, role, f, f / 30, 3.0, 4.0, 0.9, "inside", "observed") for role in C.ROLES for f in range(9)],
        "match_id bigint, role string, frame bigint, t_s double, x_m double, y_m double, confidence double, region string, state string")
    docs = {d.match_id: json.loads(d.metrics) for d in A.match_document(rallies, shots, positions, 30.0).collect()}
    assert read.value == len(rows)
    assert set(docs) == {1, 2, 3, None} and docs[None] == {"match": docs[None]["match"]} and docs[None]["match"]["shot_count"] == 0

    def kept(row):
        return {k: round(v, 9) if isinstance(v, float) else v for k, v in row.items() if v is not None and k != "match_id"}

    parts = {"match": A.match_metrics(rallies, shots), "players": A.player_hits(shots, rallies), "thirdShots": A.third_shots(shots, rallies),
             "shotSelection": A.shot_selection(shots, rallies), "dataQuality": A.data_quality(rallies, shots)}
    for name, part in parts.items():
        for m in (1, 2, 3):
            want = [kept(r.asDict()) for r in part.filter(F.col("match_id") == m).collect()]
            got = docs[m][name] if isinstance(docs[m][name], list) else [docs[m][name]]
            got = [kept(g) for g in got]
            assert len(got) == len(want) and all(w in got for w in want), (m, name)


def test_zone_lines_belong_to_the_kitchen(spark):
    ys = [C.NEAR_KITCHEN_Y_M, C.FAR_KITCHEN_Y_M, C.NEAR_KITCHEN_Y_M - 1e-6, C.NEAR_KITCHEN_Y_M - C.NVZ_DEPTH_M - 0.01, C.FAR_KITCHEN_Y_M + 1.0]
    got = [r.z for r in spark.createDataFrame([(i, y) for i, y in enumerate(ys)], "i int, y double").select("i", G.zone("y").alias("z")).orderBy("i").collect()]
    assert got == ["kitchen", "kitchen", "transitionZone", "backcourt", "transitionZone"]


def test_missing_frames_are_never_bridged(spark):
    rows = [(1, "ME", f, f / 10, 3.0 + f * 0.1, 4.0, 0.9, "inside", "observed") for f in (0, 1, 2, 5, 6)] + [(1, "ME", 3, 0.3, None, None, 0.0, "ambiguous", "temporarily_missing"), (1, "ME", 4, 0.4, 3.4, 4.0, 0.1, "inside", "observed")]
    raw = spark.createDataFrame(rows, "match_id bigint, role string, frame bigint, t_s double, x_m double, y_m double, confidence double, region string, state string")
    out = {r.frame: r for r in P.smooth(raw).collect()}
    assert out[3].sx_m is None and out[4].sx_m is None and out[4].status == "below_confidence_threshold"
    assert out[2].support_frames == [0, 1, 2] and out[5].support_frames == [5, 6]
    s = P.player_summary(raw, 10.0).first()
    assert (s.eligible_frames, s.steps, s.gap_steps) == (5, 3, 1)


def test_smoothing_is_bounded_and_damps_a_spike(spark):
    xs = [3.0, 3.0, 4.5, 3.0, 3.0]
    raw = spark.createDataFrame([(1, "ME", i, i / 30, x, 4.0, 0.9, "inside", "observed") for i, x in enumerate(xs)], "match_id bigint, role string, frame bigint, t_s double, x_m double, y_m double, confidence double, region string, state string")
    out = {r.frame: r.sx_m for r in P.smooth(raw).collect()}
    assert abs(out[2] - 4.2) < 1e-9 and out[1] == 3.0


# --- ball -------------------------------------------------------------------

CAND = "match_id bigint, frame bigint, t_s double, detection_id bigint, x_px double, y_px double, confidence double, relevance double"


def line(frames, extra=()):
    rows = [(1, f, f / 30, f * 10, 500.0 + 6 * f, 400.0, 0.6, 1.0) for f in frames]
    return rows + [(1, f, f / 30, f * 10 + 1, x, y, 0.95, 0.0) for f, x, y in extra]


def test_distractor_loses_and_short_gap_is_filled(spark):
    df = spark.createDataFrame(line([0, 1, 2, 3, 5, 6, 7], [(2, 1700.0, 80.0), (5, 1700.0, 90.0)]), CAND)
    frames = spark.createDataFrame([(1, 9)], "match_id bigint, frame_count bigint")
    out = {r.frame: r for r in B.reconstruct(df, frames, V).collect()}
    assert [out[f].status for f in range(9)] == ["OBSERVED"] * 4 + ["INTERPOLATED"] + ["OBSERVED"] * 3 + ["UNKNOWN"]
    assert out[2].detection_id == 20 and out[2].rejected_ids == [21] and abs(out[4].x_px - 524.0) < 1e-9
    assert abs(out[4].confidence - min(out[3].confidence, out[5].confidence) * 0.85) < 1e-9


def test_long_gap_splits_segments_and_lone_points_go(spark):
    df = spark.createDataFrame(line([0, 1, 2, 20, 21, 22, 50]), CAND)
    got = rows_of(B.associate(B.temporal_support(df, V), V), "frame", "segment_id")
    assert got == [(0, 0), (1, 0), (2, 0), (20, 20), (21, 20), (22, 20)]


def test_link_may_span_one_frame_more_than_the_gap(spark):
    df = spark.createDataFrame(line([0, 1, 8, 9]), CAND)
    assert {r.segment_id for r in B.associate(B.temporal_support(df, V), V).collect()} == {0}
    df = spark.createDataFrame(line([0, 1, 9, 10]), CAND)
    assert {r.segment_id for r in B.associate(B.temporal_support(df, V), V).collect()} == {0, 9}


# --- rallies and events -----------------------------------------------------

def test_audio_and_players_only_raise_confidence(tables):
    plain = {(r.match_id, r.start_frame): r for r in R.segment_rallies(tables.ball, V).collect()}
    heard = {(r.match_id, r.start_frame): r for r in R.segment_rallies(tables.ball, V, audio=tables.audio).collect()}
    assert plain.keys() == heard.keys() and plain
    assert all(heard[k].end_frame == r.end_frame and heard[k].confidence >= r.confidence - 1e-12 for k, r in plain.items())


def test_audio_never_adds_or_lowers_a_bounce(tables):
    rows = lambda audio: {(r.match_id, r.frame): r for r in X.detect_bounces(tables.ball, V, CE.CORNERS, CE.H, audio).collect()}
    none, some = rows(tables.audio.filter("false")), rows(tables.audio)
    assert none.keys() == some.keys() and none
    assert all(r.evidence_mode != "VISUAL_PLUS_AUDIO" and some[k].fused >= r.fused for k, r in none.items())


def test_no_bounce_across_segments(spark):
    y = [400 + 20 * i for i in range(8)] + [540 - 20 * i for i in range(8)]
    track = spark.createDataFrame([(1, i, i / 30, "OBSERVED", 0 if i < 8 else 1, 700.0, float(v)) for i, v in enumerate(y)], "match_id bigint, frame bigint, t_s double, status string, segment_id bigint, x_px double, y_px double")
    assert X.bounce_candidates(track, V, CE.CORNERS, CE.H).count() == 0
    whole = track.withColumn("segment_id", F.lit(0).cast("bigint"))
    found = X.bounce_candidates(whole, V, CE.CORNERS, CE.H)
    assert {r.frame for r in M.suppress_near(found, ["match_id"], "frame", "visual", 5, False, 100).collect()} <= {6, 7, 8, 9} and found.count()


def test_rally_pairs_report_broken_alternation(spark):
    marks = ["RALLY_START", "RALLY_END", "RALLY_END", "RALLY_START", "RALLY_START", "RALLY_END", "RALLY_START"]
    df = spark.createDataFrame([(1, i, m, i * 10) for i, m in enumerate(marks)], "match_id bigint, event_id bigint, type string, frame bigint")
    good, bad = R.paired_rallies(df, chunk=3)
    assert rows_of(good, "start_event", "end_event") == [(0, 1), (4, 5)]
    assert rows_of(bad, "event_id", "reason") == [(2, "end_without_start"), (4, "start_before_end"), (6, "start_without_end")]


# --- hitters and shots ------------------------------------------------------

def _contacts(spark, rows):
    return spark.createDataFrame(rows, "match_id bigint, frame bigint, t_s double, visual double, rally_id bigint, by double, ay double")


def _players(spark, rows):
    return spark.createDataFrame(rows, "match_id bigint, frame bigint, role string, side string, region string, state string, tracking_confidence double, inside boolean, proximity double, distance_px double")


def test_clear_hitter_and_even_players(spark):
    contacts = _contacts(spark, [(1, 10, 0.33, 0.9, 1, 300.0, -300.0), (1, 40, 1.33, 0.9, 1, 300.0, -300.0), (1, 70, 2.3, 0.5, 1, 300.0, -300.0)])
    near = lambda f, d: (1, f, "ME", "near_side", "inside", "observed", 0.9, d == 0, 1.0 - d / 264, float(d))
    far = lambda f, d: (1, f, "OPPONENT_1", "far_side", "inside", "observed", 0.9, d == 0, 1.0 - d / 264, float(d))
    same = (1, 40, "PARTNER", "near_side", "inside", "observed", 0.9, True, 1.0, 0.0)
    out = {r.frame: r for r in HT.identify(contacts, _players(spark, [near(10, 0), far(10, 250), near(40, 0), same, near(70, 0)]), V).collect()}
    assert out[10].hitter_id == "ME" and out[10].hitter_side == "near_side"
    assert out[40].hitter_id == "UNKNOWN" and abs(out[40].hitter_confidence - 1.0) < 1e-9 and out[40].context_used
    assert out[70].hitter_id == "UNKNOWN" and not out[70].context_used


FEAT = "match_id bigint, rally_id bigint, shot_index bigint, hitter_id string, hitter_confidence double, hitter_side string, hitter_y_m double, known_fraction double, known_points bigint, initial_speed double, bounce_id bigint, landing_y_m double, height_ratio double, visual double"


@pytest.mark.parametrize("changes,kind", [
    ({"bounce_id": 1, "landing_y_m": 12.0, "hitter_y_m": 0.5}, "SERVE"),
    ({"shot_index": 3, "height_ratio": 0.2}, "OVERHEAD"),
    ({"bounce_id": 1, "landing_y_m": 7.5, "hitter_y_m": 4.4, "initial_speed": 0.2}, "DINK"),
    ({"bounce_id": 1, "landing_y_m": 7.5, "hitter_y_m": 3.0, "initial_speed": 0.3, "shot_index": 4}, "DROP"),
    ({"shot_index": 3, "hitter_y_m": 4.4, "initial_speed": 0.2}, "VOLLEY"),
    ({"initial_speed": 0.6}, "DRIVE"),
    ({"initial_speed": 0.4}, "OTHER"),
    ({"initial_speed": None}, "UNKNOWN"),
    ({"hitter_id": "UNKNOWN"}, "UNKNOWN"),
    ({"known_fraction": 0.4}, "UNKNOWN"),
])
def test_shot_rules(spark, changes, kind):
    base = {"match_id": 1, "rally_id": 1, "shot_index": 1, "hitter_id": "ME", "hitter_confidence": 0.9, "hitter_side": "near_side", "hitter_y_m": 3.0, "known_fraction": 0.9,
            "known_points": 9, "initial_speed": 0.5, "bounce_id": None, "landing_y_m": None, "height_ratio": 0.8, "visual": 0.9}
    row = {**base, **changes}
    assert SH.classify(spark.createDataFrame([tuple(row.values())], FEAT)).first().shot_type == kind


def test_return_needs_a_serve_before_it(spark):
    serve = (1, 1, 1, "ME", 0.9, "near_side", 0.5, 0.9, 9, 0.5, 5, 12.0, 0.8, 0.9)
    second = (1, 1, 2, "OPPONENT_1", 0.9, "far_side", 12.0, 0.9, 9, 0.4, None, None, 0.8, 0.9)
    kinds = lambda rows: [r.shot_type for r in SH.classify(spark.createDataFrame(rows, FEAT)).orderBy("shot_index").collect()]
    assert kinds([serve, second]) == ["SERVE", "RETURN"]
    assert kinds([(*serve[:10], None, None, *serve[12:]), second]) == ["DRIVE", "OTHER"]


# --- corrections, text, regions ---------------------------------------------

def test_oldest_correction_has_the_last_word(spark):
    c = spark.createDataFrame([(1, 10, "shot_type", 7, "DROP", "ME", 5, True, True), (1, 11, "shot_type", 7, "DINK", "ME", 9, True, True), (1, 12, "shot_type", 7, "LOB", "ME", 1, True, False), (1, 13, "hitter", 7, "LOB", "PARTNER", 3, True, True)],
                              "match_id bigint, correction_id bigint, type string, target_id bigint, new_type string, new_hitter string, corrected_at bigint, active boolean, verified boolean")
    shots = spark.createDataFrame([(1, 7, "DRIVE", "OPPONENT_1"), (1, 8, "DRIVE", "ME")], "match_id bigint, shot_id bigint, shot_type string, hitter_id string")
    got = rows_of(K.corrected_shots(shots, c), "shot_id", "shot_type", "effective_type", "effective_hitter")
    assert got == [(7, "DRIVE", "DROP", "PARTNER"), (8, "DRIVE", "DRIVE", "ME")]


@pytest.mark.parametrize("title,names", [
    ("TiloBerta vs RuthAnsgar", ["Tilo", "Berta", "Ruth", "Ansgar"]),
    ("\tTilo & Berta Versus Ruth & Ansgar\n", ["Tilo", "Berta", "Ruth", "Ansgar"]),
    ("31-12-99 Tilo+Berta vs. Ruth/Ansgar", ["Tilo", "Berta", "Ruth", "Ansgar"]),
    ("Eva-Lotte, D'Arcy VS Imre, Wu", ["Eva-Lotte", "D'Arcy", "Imre", "Wu"]),
    ("Tilo vs Ruth", None), ("Tilo & Berta vs tilo & Ansgar", None), ("TiloBertaFinn vs RuthAnsgar", None), ("doubles on Friday", None),
])
def test_roster(spark, title, names):
    assert spark.createDataFrame([(title,)], "t string").select(roster(F.col("t")).alias("n")).first().n == names


@pytest.mark.parametrize("width,height,size,overlap", [(1920, 1080, 640, 0.2), (500, 400, 640, 0.2), (1280, 720, 640, 0.25)])
def test_tiles_cover_the_frame(spark, width, height, size, overlap):
    def starts(extent):
        tile = min(size, extent)
        if extent <= tile:
            return [0]
        step = max(1, round(tile * (1 - overlap)))
        out = list(range(0, extent - tile + 1, step))
        return out if out[-1] == extent - tile else [*out, extent - tile]

    video = spark.createDataFrame([(1, width, height)], "match_id bigint, width bigint, height bigint")
    got = {(r.tile_left, r.tile_top) for r in RG.tiles(RG.full_frame(video), size, overlap).collect()}
    assert got == {(x, y) for x in starts(width) for y in starts(height)}


# --- audio ------------------------------------------------------------------

@pytest.mark.parametrize("count", [1000, 1013, 733, 25])
def test_windows_and_spectra(spark, count):
    rate, block = 1000, 100
    rng = np.random.default_rng(1)
    samples = rng.normal(0, 0.2, (count, 2))
    blocks = [(1, b, [samples[b * block : (b + 1) * block, c].tolist() for c in range(2)]) for b in range(math.ceil(count / block))]
    size, hop = AU.frame_lengths(rate)
    starts = [0] if count <= size else sorted({*range(0, count - size + 1, hop), count - size})
    out = {r.start: r for r in AU.spectra(AU.cut_windows(spark.createDataFrame(blocks, "match_id bigint, block_ix bigint, channels array<array<double>>"), block, rate), rate).collect()}
    assert sorted(out) == starts
    taper = np.hanning(size)
    for s in starts[:: max(1, len(starts) // 7)] + starts[-1:]:
        part = np.zeros((size, 2))
        part[: len(samples[s : s + size])] = samples[s : s + size]
        joint = np.sqrt(np.mean(np.abs(np.fft.rfft(part * taper[:, None], axis=0)) ** 2, axis=1))
        assert np.allclose(out[s].spectrum, np.log1p(joint)) and abs(out[s].peak - np.abs(part).max()) < 1e-12
        assert out[s].peak_sample == s + int(np.argmax(np.abs(part))) // 2


def test_impulses_in_noise_are_found(spark):
    rate, block = 1000, 100
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.005, 4000)
    for at in (700, 1500, 1520, 3100):
        x[at : at + 6] += 0.8 * np.array([1, -1, 0.8, -0.7, 0.4, -0.2])
    blocks = [(1, b, [x[b * block : (b + 1) * block].tolist()]) for b in range(40)]
    out = AU.analyse(spark.createDataFrame(blocks, "match_id bigint, block_ix bigint, channels array<array<double>>"), block, rate, C.AudioSettings(low_hz=100, high_hz=300)).collect()
    found = sorted(r.peak_sample for r in out)
    assert len(found) == 3 and all(abs(f - w) <= 40 for f, w in zip(found, (700, 1510, 3100)))
    assert all(0.5 <= r.confidence <= 1 for r in out)
