"""Queries over bounces, contacts, audio fusion and their evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.catalog.ball import CORNERS, D, V, in_quad_sql
from courtflow.catalog.base import SHARED, query
from courtflow.catalog.positions import LEN, WID
from courtflow.fixtures import num
from courtflow.functions import geometry as G
from courtflow.functions.sequences import band_join
from courtflow.operators import evaluation as E
from courtflow.operators import events as X


def _solve() -> list[float]:
    """Image-to-court matrix that takes the image trapezoid to the court."""
    target = [(0.0, 0.0), (C.COURT_WIDTH_M, 0.0), (C.COURT_WIDTH_M, C.COURT_LENGTH_M), (0.0, C.COURT_LENGTH_M)]
    rows, rhs = [], []
    for (x, y), (u, v) in zip(CORNERS, target):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    return [*map(float, np.linalg.solve(np.array(rows), np.array(rhs))), 1.0]


H = _solve()
HI = list(map(float, (lambda m: (m / m[2, 2]).ravel())(np.linalg.inv(np.array(H).reshape(3, 3)))))


def project_sql(x: str, y: str, h: list[float] = H) -> tuple[str, str]:
    n = [f"({num(v)})" for v in h]
    den = f"({n[6]} * {x} + {n[7]} * {y} + {n[8]})"
    return (
        f"(case when abs{den} >= 1e-12 then ({n[0]} * {x} + {n[1]} * {y} + {n[2]}) / {den} end)",
        f"(case when abs{den} >= 1e-12 then ({n[3]} * {x} + {n[4]} * {y} + {n[5]}) / {den} end)",
    )


def _shape_sql(w: int) -> str:
    return f"""
select *, y_px - greatest(minb, mina) as prominence_px, same / {2 * w + 1} as continuity, obs / same as observed_fraction from (
select k.*, count(*) over sb as nb, count(*) over sa as na, coalesce(regr_slope(x_px, t_s) over b, 0) as bx, coalesce(regr_slope(y_px, t_s) over b, 0) as by_,
  coalesce(regr_slope(x_px, t_s) over a, 0) as ax, coalesce(regr_slope(y_px, t_s) over a, 0) as ay, min(y_px) over sb as minb, min(y_px) over sa as mina,
  count(*) over r as same, count(*) filter (where status = 'OBSERVED') over r as obs
from fx_ball k where x_px is not null
window b as (partition by match_id, segment_id order by frame range between {w} preceding and current row), a as (partition by match_id, segment_id order by frame range between current row and {w} following),
 sb as (partition by match_id, segment_id order by frame range between {w} preceding and 1 preceding), sa as (partition by match_id, segment_id order by frame range between 1 following and {w} following),
 r as (partition by match_id, segment_id order by frame range between {w} preceding and {w} following)) where nb >= 2 and na >= 2
  and frame >= {w} and frame < (select max(frame) + 1 from fx_ball z) - {w}
"""


def angle_sql(ax: str, ay: str, bx: str, by: str) -> str:
    na, nb = f"sqrt({ax} * {ax} + {ay} * {ay})", f"sqrt({bx} * {bx} + {by} * {by})"
    return f"(case when {na} <= 1e-12 or {nb} <= 1e-12 then 0 else degrees(acos(greatest(-1e0, least(1e0, ({ax} * {bx} + {ay} * {by}) / ({na} * {nb}))))) end)"


SHARED["ck_shape6"] = _shape_sql(6)
SHARED["ck_shape5"] = _shape_sql(5)


@query("w9_two_sided_slopes", "select match_id, frame, bx, by_ as b_y, ax, ay from ck_shape6", "bx b_y ax ay")
def w9(t):
    return X.local_shape(t.ball, 6, 2).select("match_id", "frame", "bx", F.col("by").alias("b_y"), "ax", "ay")


@query("w10_prominence_continuity", "select match_id, frame, prominence_px, continuity, observed_fraction from ck_shape6", "prominence_px continuity observed_fraction")
def w10(t):
    return X.local_shape(t.ball, 6, 2).select("match_id", "frame", "prominence_px", "continuity", "observed_fraction")


# Rallies on the ball timeline: the moving bursts of the fixture.
SHARED["ck_rl"] = "select match_id, frame as start_frame, frame + 159 as end_frame, frame as rally_id, 5e-1 + frame / 3e3 as confidence from fx_ball where frame % 250 = 0"


def rallies_of(t):
    f = F.col("frame")
    return t.ball.filter(f % 250 == 0).select("match_id", f.alias("start_frame"), (f + 159).alias("end_frame"), f.alias("rally_id"), (F.lit(0.5) + f / 3e3).alias("confidence"))


@query("j2_event_rally", "select b.match_id, b.frame, r.rally_id, r.confidence as rally_confidence from fx_ball b left join ck_rl r on r.match_id = b.match_id and b.frame between r.start_frame and r.end_frame", "rally_confidence")
def j2(t):
    return X.with_rally(t.ball.select("match_id", "frame"), rallies_of(t))


PX, PY = project_sql("x_px", "y_px")
SHARED["ck_bnc"] = f"""
select *, case when inside and visual >= 55e-2 and cx between 0 and {WID} and cy between 0 and {LEN} then cx end as court_x_m,
  case when inside and visual >= 55e-2 and cx between 0 and {WID} and cy between 0 and {LEN} then cy end as court_y_m
from (select *, least(1e0, 27e-2 * least(1e0, reversal / 12e-2) + 18e-2 * least(1e0, prominence / 45e-4) + 13e-2 * least(1e0, least(by_, -ay) / (54e-3 * {D}))
   + 17e-2 * continuity + 1e-1 * observed_fraction + 1e-1 * cast(inside as int) + 5e-2 * case when status = 'OBSERVED' then 1e0 else 55e-2 end + coalesce(5e-2 * rc, 0)) as visual,
   {PX} as cx, {PY} as cy, {angle_sql('bx', 'by_', 'ax', 'ay')} as direction_deg
 from (select s.*, (by_ - ay) / {D} as reversal, prominence_px / {D} as prominence, {in_quad_sql('x_px', 'y_px')} as inside, r.rally_id, r.confidence as rc
   from ck_shape6 s left join ck_rl r on r.match_id = s.match_id and s.frame between r.start_frame and r.end_frame)
 where by_ >= 18e-3 * {D} and ay <= -18e-3 * {D} and reversal >= 4e-2 and prominence >= 15e-4 and continuity >= 65e-2)
where visual >= 35e-2
"""


@query("f6_bounce_candidates", "select match_id, frame, visual, reversal, prominence, direction_deg, rally_id, court_x_m, court_y_m from ck_bnc", "visual reversal prominence direction_deg court_x_m court_y_m")
def f6_candidates(t):
    return X.bounce_candidates(t.ball, V, CORNERS, H, rallies_of(t)).select("match_id", "frame", "visual", "reversal", "prominence", "direction_deg", "rally_id", "court_x_m", "court_y_m")


def nms_sql(table: str, distance: int, op: str) -> str:
    return f"""select match_id, unnest(kept) as frame from (select match_id, list_reduce(list([frame] order by visual desc, frame),
      lambda acc, x: case when len(list_filter(acc, lambda a: abs(a - x[1]) {op} {distance})) > 0 then acc else list_concat(acc, x) end) as kept from {table} group by 1)"""


SHARED["ck_bkept"] = f"select b.* from ck_bnc b join ({nms_sql('ck_bnc', 5, '<')}) k on k.match_id = b.match_id and k.frame = b.frame"


@query("f3_bounce_suppression", "select match_id, frame, visual from ck_bkept", "visual")
def f3(t):
    raw = X.bounce_candidates(t.ball, V, CORNERS, H, rallies_of(t)).select("match_id", "frame", "visual")
    return X.suppress_near(raw, ["match_id"], "frame", "visual", 5, False, 16384)


def greedy_sql(proposals: str) -> str:
    """``proposals`` gives match_id, a, b, d, s: greedy by (d, -s, a, b)."""
    return f"""select match_id, unnest(kept) as m from (select match_id, list_reduce(list([{{'a': a, 'b': b, 'd': d}}] order by d, s desc, a, b),
      lambda acc, x: case when len(list_filter(acc, lambda o: o.a = x[1].a or o.b = x[1].b)) > 0 then acc else list_concat(acc, x) end) as kept from ({proposals}) group by 1)"""


def audio_sql(table: str) -> str:
    return greedy_sql(
        f"select e.match_id, e.frame as a, u.transient_id as b, abs(e.t_s - u.video_s) as d, u.confidence as s from {table} e join fx_audio u on u.match_id = e.match_id and abs(e.t_s - u.video_s) <= 9e-2"
    )


def evidence_sql(table: str, accepted: str) -> str:
    return f"""select e.*, m.m.b as transient_id, coalesce(u.confidence * (5e-1 + 5e-1 * (1 - m.m.d / 9e-2)), 0) as audio_confidence, m.m.d as audio_delta_s,
      least(1e0, e.visual + 2e-1 * (1 - e.visual) * coalesce(u.confidence * (5e-1 + 5e-1 * (1 - m.m.d / 9e-2)), 0)) as fused
    from {table} e left join ({audio_sql(table)}) m on m.match_id = e.match_id and m.m.a = e.frame left join fx_audio u on u.match_id = e.match_id and u.transient_id = m.m.b"""


SHARED["ck_bounce"] = f"""
select *, visual >= 8e-1 as accepted_visual, fused >= 8e-1 as accepted_fused,
 case when fused < 8e-1 then 'LOW_CONFIDENCE' when transient_id is not null then 'VISUAL_PLUS_AUDIO' else 'VISUAL_ONLY' end as evidence_mode from ({evidence_sql('ck_bkept', '8e-1')})
"""
BCOLS = "match_id, frame, visual, transient_id, audio_confidence, audio_delta_s, fused, accepted_visual, accepted_fused, evidence_mode, court_x_m, court_y_m, rally_id"


@query("f6_bounces", f"select {BCOLS} from ck_bounce", "visual audio_confidence audio_delta_s fused court_x_m court_y_m")
def f6(t):
    return X.detect_bounces(t.ball, V, CORNERS, H, t.audio, rallies_of(t)).select(*BCOLS.split(", "))


def bounces_of(t):
    """Reviewed-like bounces at the top of each arc, as input for contacts."""
    f = F.col("frame")
    return t.ball.filter((f % 19 == 9) & (F.col("status") == "OBSERVED")).select("match_id", "frame", (F.lit(0.5) + F.col("k") / 211).alias("confidence"))


SHARED["ck_bn"] = "select match_id, frame, 5e-1 + k / 211e0 as confidence from fx_ball where frame % 19 = 9 and status = 'OBSERVED'"
SHARED["ck_bctx"] = """
select *, (frame - bounce_frame) / 30e0 as bounce_gap_s from (select match_id, frame, coincident, case when coincident then nf else pf end as bounce_frame from (
 select match_id, frame, pf, case when xf is null or (pf is not null and frame - pf <= xf - frame) then pf else xf end as nf,
   coalesce(abs(case when xf is null or (pf is not null and frame - pf <= xf - frame) then pf else xf end - frame) / 30e0 <= 8e-2, false) as coincident
 from (select b.match_id, b.frame, (select max(q.frame) from ck_bn q where q.match_id = b.match_id and q.frame <= b.frame) as pf,
   (select min(q.frame) from ck_bn q where q.match_id = b.match_id and q.frame > b.frame) as xf from fx_ball b)))
"""


@query(
    "j4_bounce_context",
    "select c.match_id, c.frame, c.coincident, c.bounce_frame, n.confidence as bounce_confidence, c.bounce_gap_s from ck_bctx c left join ck_bn n on n.match_id = c.match_id and n.frame = c.bounce_frame",
    "bounce_confidence bounce_gap_s",
)
def j4(t):
    return X.bounce_context(t.ball.select("match_id", "frame"), bounces_of(t), V.fps, 0.08)


SHARED["ck_players"] = f"""
select *, row_number() over (partition by match_id, frame order by distance_px, role) as rank from (
select p.*, b.x_px, b.y_px, sqrt(power(greatest(p.l - b.x_px, 0e0, b.x_px - p.r_px), 2) + power(greatest(p.t - b.y_px, 0e0, b.y_px - p.b), 2)) as distance_px,
  b.x_px between p.l and p.r_px and b.y_px between p.t and p.b as inside,
  greatest(0e0, 1 - sqrt(power(greatest(p.l - b.x_px, 0e0, b.x_px - p.r_px), 2) + power(greatest(p.t - b.y_px, 0e0, b.y_px - p.b), 2)) / (12e-2 * {D})) as proximity
from fx_player_boxes p join fx_ball b on b.match_id = p.match_id and b.frame = p.frame where b.x_px is not null)
"""


@query("j12_candidate_players", "select match_id, frame, role, rank, distance_px, inside, proximity from ck_players", "distance_px proximity")
def j12(t):
    points = t.ball.filter("x_px is not null")
    return X.candidate_players(points, t.player_boxes, V, 0.12).select("match_id", "frame", "role", "rank", "distance_px", "inside", "proximity")


@query("e5_point_box_distance", "select match_id, frame, role, distance_px, inside from ck_players", "distance_px")
def e5(t):
    both = t.ball.filter("x_px is not null").select("match_id", "frame", "x_px", "y_px").join(t.player_boxes, ["match_id", "frame"])
    return both.select("match_id", "frame", "role", G.box_distance("x_px", "y_px", "l", "t", "r_px", "b").alias("distance_px"), G.inside_box("x_px", "y_px", "l", "t", "r_px", "b").alias("inside"))


SB, SA = f"sqrt(bx * bx + by_ * by_) / {D}", f"sqrt(ax * ax + ay * ay) / {D}"
SHARED["ck_con"] = f"""
select * from (select g.*, p.role as nearest_role, r.rally_id, c.bounce_gap_s, least(1e0, 28e-2 * least(1e0, velocity_change / 18e-2)
   + 2e-1 * greatest(least(1e0, direction_deg / 90), least(1e0, greatest(0e0, speed_ratio - 1) / 135e-2)) + 14e-2 * continuity + 9e-2 * observed_fraction
   + 5e-2 * case when g.status = 'OBSERVED' then 1e0 else 55e-2 end + 17e-2 * coalesce(p.proximity * p.tracking_confidence, 0)
   + 4e-2 * case p.region when 'inside' then 1e0 when 'near' then 65e-2 else 0 end + coalesce(4e-2 * r.confidence, 0)
   + 3e-2 * case when c.bounce_gap_s between 1e-1 and 3e0 then n.confidence else 0 end) as visual
 from (select *, sqrt(power(ax - bx, 2) + power(ay - by_, 2)) / {D} as velocity_change, {angle_sql('bx', 'by_', 'ax', 'ay')} as direction_deg,
    greatest({SB}, {SA}) / greatest(1e-6, least({SB}, {SA})) as speed_ratio from ck_shape5) g
 join ck_bctx c on c.match_id = g.match_id and c.frame = g.frame and not c.coincident left join ck_bn n on n.match_id = c.match_id and n.frame = c.bounce_frame
 left join ck_players p on p.match_id = g.match_id and p.frame = g.frame and p.rank = 1
 left join ck_rl r on r.match_id = g.match_id and g.frame between r.start_frame and r.end_frame
 where velocity_change >= 6e-2 and (direction_deg >= 22 or speed_ratio >= 135e-2) and continuity >= 65e-2) where visual >= 4e-1
"""


@query("f7_contact_candidates", "select match_id, frame, visual, velocity_change, direction_deg, speed_ratio, nearest_role, rally_id, bounce_gap_s from ck_con", "visual velocity_change direction_deg speed_ratio bounce_gap_s")
def f7_candidates(t):
    return X.contact_candidates(t.ball, t.player_boxes, V, bounces_of(t), rallies_of(t)).select(
        "match_id", "frame", "visual", "velocity_change", "direction_deg", "speed_ratio", "nearest_role", "rally_id", "bounce_gap_s")


SHARED["ck_ckept"] = f"select b.* from ck_con b join ({nms_sql('ck_con', 4, '<=')}) k on k.match_id = b.match_id and k.frame = b.frame"
SHARED["ck_contact"] = f"""
select *, visual >= 78e-2 as accepted_visual, fused >= 78e-2 as accepted_fused, lag(frame) over (partition by match_id order by frame) as previous_frame,
 case when fused < 78e-2 then 'LOW_CONFIDENCE' when transient_id is not null then 'VISUAL_PLUS_AUDIO' else 'VISUAL_ONLY' end as evidence_mode from ({evidence_sql('ck_ckept', '78e-2')})
"""
CCOLS = "match_id, frame, visual, transient_id, audio_confidence, fused, accepted_visual, accepted_fused, evidence_mode, nearest_role, rally_id, previous_frame"


def contacts_of(t):
    return X.detect_contacts(t.ball, t.player_boxes, V, bounces_of(t), t.audio, rallies_of(t))


@query("f7_contacts", f"select {CCOLS}, (frame - previous_frame) / 30e0 as since_previous_s from ck_contact", "visual audio_confidence fused since_previous_s")
def f7(t):
    return contacts_of(t).select(*CCOLS.split(", "), "since_previous_s")


@query("w19_previous_contact", "select match_id, frame, previous_frame, (frame - previous_frame) / 30e0 as since_previous_s from ck_contact", "since_previous_s")
def w19(t):
    return contacts_of(t).select("match_id", "frame", "previous_frame", "since_previous_s")


STATS = """select match_id, count(*) as candidates, count(*) filter (where accepted_visual) as accepted_visual, count(*) filter (where accepted_fused) as accepted_fused,
  count(transient_id) as audio_matched, count(*) filter (where evidence_mode = 'VISUAL_ONLY') as visual_only, count(*) filter (where evidence_mode = 'VISUAL_PLUS_AUDIO') as visual_plus_audio,
  count(*) filter (where evidence_mode = 'LOW_CONFIDENCE') as low_confidence, avg(visual) as mean_visual, avg(fused) as mean_fused from {t} group by 1"""


@query("a17_bounce_statistics", STATS.format(t="ck_bounce"), "mean_visual mean_fused")
def a17_bounce(t):
    return X.stage_statistics(X.detect_bounces(t.ball, V, CORNERS, H, t.audio, rallies_of(t)))


@query("a17_contact_statistics", STATS.format(t="ck_contact"), "mean_visual mean_fused")
def a17_contact(t):
    return X.stage_statistics(contacts_of(t))


@query("e15_fused_confidence", "select match_id, event_id, least(1e0, visual + 2e-1 * (1 - visual) * (1 - fused)) as fused2 from fx_predicted", "fused2")
def e15(t):
    return t.predicted.select("match_id", "event_id", X.fuse(F.col("visual"), 1 - F.col("fused"), 0.2).alias("fused2"))


@query("e16_velocity_angle", f"select match_id, frame, round({angle_sql('(x_px - 960)', '(y_px - 500)', '(k - 50)', '(3e0 - frame % 7)')}, 4) as angle from fx_ball where x_px is not null", "angle")
def e16(t):
    angle = G.angle_degrees(F.col("x_px") - 960, F.col("y_px") - 500, F.col("k") - 50, F.lit(3.0) - F.col("frame") % 7)
    return t.ball.filter("x_px is not null").select("match_id", "frame", F.round(angle, 4).alias("angle"))


@query("e6_in_court_polygon", f"select match_id, frame, {in_quad_sql('x_px', 'y_px')} as inside from fx_ball where x_px is not null")
def e6(t):
    return t.ball.filter("x_px is not null").select("match_id", "frame", G.in_convex("x_px", "y_px", CORNERS).alias("inside"))


# --- evaluation -------------------------------------------------------------

@query(
    "j6_time_tolerance_join",
    "select p.match_id, p.event_id, q.event_id as truth_id, p.t_s - q.t_s as signed_s from fx_predicted p join fx_truth q on q.match_id = p.match_id and abs(p.t_s - q.t_s) <= 12e-2",
    "signed_s",
)
def j6(t):
    right = t.truth.select("match_id", F.col("event_id").alias("truth_id"), F.col("t_s").alias("truth_s"))
    return band_join(t.predicted, right, ["match_id"], "t_s", "truth_s", 0.12).select("match_id", "event_id", "truth_id", (F.col("t_s") - F.col("truth_s")).alias("signed_s"))


def _pairs(score: str, where: str, tol: str) -> str:
    return greedy_sql(f"select p.match_id, p.event_id as a, q.event_id as b, abs(p.t_s - q.t_s) as d, p.{score} as s from fx_predicted p join fx_truth q on q.match_id = p.match_id and abs(p.t_s - q.t_s) <= {tol} where {where}")


@query("j7_greedy_matches", f"select match_id, m.a as event_id, m.b as truth_id, m.d as delta_s from ({_pairs('visual', 'true', '12e-2')})", "delta_s")
def j7(t):
    right = t.truth.select("match_id", F.col("event_id").alias("truth_id"), F.col("t_s").alias("truth_s"))
    hits = E.time_matches(t.predicted.select("match_id", "event_id", "t_s", "visual"), right, ["match_id"], "event_id", "truth_id", "t_s", "truth_s", "visual", 0.12)
    return hits.select("match_id", "event_id", "truth_id", "delta_s")


SCOPE = "exists (select 1 from ck_rl r where r.match_id = p.match_id and p.frame between greatest(0, r.start_frame - 9) and r.end_frame + 9)"


def eval_sql(score: str, accepted: str, tol: str, scope: str) -> str:
    strong = f"p.{score} >= {accepted}"
    return f"""select *, above - evaluated as ignored, evaluated - matched as false_events, truth - matched as missed,
      case when evaluated > 0 then matched / evaluated else 0 end as precision, case when truth > 0 then matched / truth else 0 end as recall,
      case when matched > 0 then 2 * (matched / evaluated) * (matched / truth) / (matched / evaluated + matched / truth) else 0 end as f1
    from (select q.match_id, coalesce(truth, 0) as truth, coalesce(above, 0) as above, coalesce(evaluated, 0) as evaluated, coalesce(matched, 0) as matched, mean_signed_ms, mean_absolute_ms, max_absolute_ms
    from (select match_id, sum(n) as truth from (select match_id, 1 as n from fx_truth union all select distinct match_id, 0 from fx_predicted) group by 1) q
    left join (select match_id, count(*) as above, count(*) filter (where {scope}) as evaluated from fx_predicted p where {strong} group by 1) n on n.match_id = q.match_id
    left join (select k.match_id, count(*) as matched, avg(p.t_s - u.t_s) * 1000 as mean_signed_ms, avg(k.m.d) * 1000 as mean_absolute_ms, max(k.m.d) * 1000 as max_absolute_ms
       from ({_pairs(score, strong + ' and ' + scope, tol)}) k join fx_predicted p on p.event_id = k.m.a join fx_truth u on u.event_id = k.m.b group by 1) m on m.match_id = q.match_id)"""


EV = "mean_signed_ms mean_absolute_ms max_absolute_ms precision recall f1"


@query("a23_bounce_evaluation", eval_sql("fused", "8e-1", "12e-2", "true"), EV)
def a23_bounce(t):
    return E.evaluate_events(t.predicted, t.truth, "fused", 0.8, 0.12)


@query("a23_contact_evaluation_sparse", eval_sql("visual", "78e-2", "1e-1", SCOPE), EV)
def a23_contact(t):
    return E.evaluate_events(t.predicted, t.truth, "visual", 0.78, 0.1, E.in_reviewed(t.predicted, rallies_of(t), 9))


def _mode(score: str, prefix: str) -> str:
    return f"select match_id, precision as {prefix}_precision, recall as {prefix}_recall, f1 as {prefix}_f1 from ({eval_sql(score, '78e-2', '1e-1', 'true')})"


@query(
    "a23_mode_comparison",
    f"select v.*, f.* exclude match_id, fused_precision - vision_precision as precision_delta, fused_recall - vision_recall as recall_delta, fused_f1 - vision_f1 as f1_delta "
    f"from ({_mode('visual', 'vision')}) v join ({_mode('fused', 'fused')}) f on f.match_id = v.match_id",
    "vision_precision vision_recall vision_f1 fused_precision fused_recall fused_f1 precision_delta recall_delta f1_delta",
)
def a23_modes(t):
    return E.compare_modes(t.predicted, t.truth, 0.78, 0.1)


@query("p5_reviewed_scope", f"select match_id, event_id from fx_predicted p where {SCOPE}")
def p5(t):
    return E.in_reviewed(t.predicted, rallies_of(t), 9).select("match_id", "event_id")


@query("p5_near_truth_scope", "select match_id, event_id from fx_predicted p where exists (select 1 from fx_truth q where q.match_id = p.match_id and abs(p.frame - q.frame) <= 3)")
def p5n(t):
    return E.near_truth(t.predicted, t.truth, 3).select("match_id", "event_id")


SHARED["ck_prl"] = "select match_id, candidate_no as p_id, start_frame as p_start, end_frame as p_end from fx_bursts where candidate_no % 3 <> 0"
SHARED["ck_arl"] = "select match_id, candidate_no as a_id, start_frame + candidate_no % 11 - 5 as a_start, end_frame + candidate_no % 13 - 4 as a_end from fx_bursts where candidate_no % 4 <> 0"
SHARED["ck_rlscope"] = "select * from ck_prl p where exists (select 1 from ck_arl a where a.match_id = p.match_id and p.p_end >= greatest(0, a.a_start - 60) and p.p_start <= a.a_end + 60)"
IOU = "greatest(0, least(p_end, a_end) - greatest(p_start, a_start) + 1) / (greatest(p_end, a_end) - least(p_start, a_start) + 1)"
SHARED["ck_rlm"] = f"""
select match_id, unnest(kept) as m from (select match_id, list_reduce(list([{{'a': p_id, 'b': a_id, 'iou': iou, 'se': se, 'ee': ee}}] order by iou desc, abs(se) + abs(ee), abs(se), p_id, a_id),
  lambda acc, x: case when len(list_filter(acc, lambda o: o.a = x[1].a or o.b = x[1].b)) > 0 then acc else list_concat(acc, x) end) as kept
 from (select p.match_id, p_id, a_id, {IOU} as iou, p_start - a_start as se, p_end - a_end as ee from ck_rlscope p join ck_arl a on a.match_id = p.match_id
   where {IOU} >= 25e-2 or (abs(p_start - a_start) <= 45 and abs(p_end - a_end) <= 45)) group by 1)
"""


def _pred_rallies(t):
    b = t.bursts
    p = b.filter("candidate_no % 3 <> 0").select("match_id", F.col("candidate_no").alias("p_id"), F.col("start_frame").alias("p_start"), F.col("end_frame").alias("p_end"))
    no = F.col("candidate_no")
    a = b.filter("candidate_no % 4 <> 0").select("match_id", no.alias("a_id"), (F.col("start_frame") + no % 11 - 5).alias("a_start"), (F.col("end_frame") + no % 13 - 4).alias("a_end"))
    return p, a


@query("j8_rally_matches", "select match_id, m.a as p_id, m.b as a_id, m.iou as iou, m.se as start_error, m.ee as end_error from ck_rlm", "iou")
def j8(t):
    p, a = _pred_rallies(t)
    hits = E.interval_matches(E.rally_scope(p, a, 60), a, ["match_id"], 45, 0.25)
    return hits.select("match_id", "p_id", "a_id", "iou", "start_error", "end_error")


@query(
    "a24_rally_evaluation",
    """select *, predicted - evaluated as ignored, evaluated - matched as false_rallies, annotated - matched as missed, case when evaluated > 0 then matched / evaluated else 0 end as precision, case when annotated > 0 then matched / annotated else 0 end as recall from (
    select a.match_id, annotated, coalesce(predicted, 0) as predicted, coalesce(evaluated, 0) as evaluated, coalesce(matched, 0) as matched, mean_iou, mean_start_s, mean_abs_start_s, max_abs_start_s, mean_end_s, mean_abs_end_s, max_abs_end_s
    from (select match_id, sum(n) as annotated from (select match_id, 1 as n from ck_arl union all select distinct match_id, 0 from ck_prl) group by 1) a left join (select match_id, count(*) as predicted from ck_prl group by 1) p on p.match_id = a.match_id
    left join (select match_id, count(*) as evaluated from ck_rlscope group by 1) e on e.match_id = a.match_id
    left join (select match_id, count(*) as matched, avg(m.iou) as mean_iou, avg(m.se / 30e0) as mean_start_s, avg(abs(m.se) / 30e0) as mean_abs_start_s, max(abs(m.se) / 30e0) as max_abs_start_s,
       avg(m.ee / 30e0) as mean_end_s, avg(abs(m.ee) / 30e0) as mean_abs_end_s, max(abs(m.ee) / 30e0) as max_abs_end_s from ck_rlm group by 1) m on m.match_id = a.match_id)""",
    "mean_iou mean_start_s mean_abs_start_s max_abs_start_s mean_end_s mean_abs_end_s max_abs_end_s precision recall",
)
def a24(t):
    p, a = _pred_rallies(t)
    return E.evaluate_rallies(p, a, 30.0)


SHARED["ck_hm"] = f"""
select k.match_id, p.player_id as ph, u.player_id as ah, coalesce(p.true_side, 'unavailable') as side
from ({greedy_sql("select p.match_id, p.event_id as a, q.event_id as b, abs(p.t_s - q.t_s) as d, p.visual as s from fx_predicted p join fx_truth q on q.match_id = p.match_id and abs(p.t_s - q.t_s) <= 1e-1 where p.visual >= 78e-2 and q.player_id <> 'UNKNOWN'")}) k
join fx_predicted p on p.event_id = k.m.a join fx_truth u on u.event_id = k.m.b
"""


def _hitter_matches(t):
    return E.labelled_matches(t.predicted.filter("visual >= 0.78"), t.truth.filter("player_id <> 'UNKNOWN'"), "visual", 0.1, "player_id", ["true_side"])


@query(
    "a25_hitter_accuracy",
    """select *, evaluated - correct - unknown as incorrect, correct / evaluated as accuracy, (evaluated - unknown) / evaluated as assignment_coverage, case when evaluated > unknown then correct / (evaluated - unknown) end as decisive_accuracy
    from (select match_id, scope, count(*) as evaluated, count(*) filter (where ph = ah) as correct, count(*) filter (where ph = 'UNKNOWN') as unknown
     from (select *, 'overall' as scope from ck_hm union all select *, side from ck_hm) group by 1, 2)""",
    "accuracy assignment_coverage decisive_accuracy",
)
def a25(t):
    return E.hitter_accuracy(_hitter_matches(t))


@query(
    "a25_hitter_confusion",
    "select a.actual, " + ", ".join(f"count(*) filter (where ph = '{p}') as \"{p}\"" for p in (*C.ROLES, "UNKNOWN")) + " from (select unnest(['ME','PARTNER','OPPONENT_1','OPPONENT_2']) as actual) a left join ck_hm h on h.ah = a.actual group by 1",
)
def a25c(t):
    return E.confusion(_hitter_matches(t), C.ROLES, (*C.ROLES, C.UNKNOWN))


SHARED["ck_sm2"] = f"""
select k.match_id, p.shot_type as ps, u.shot_type as sa from ({_pairs('fused', 'true', '12e-2')}) k join fx_predicted p on p.event_id = k.m.a join fx_truth u on u.event_id = k.m.b
"""


def _shot_matches(t):
    return E.labelled_matches(t.predicted, t.truth, "fused", 0.12, "shot_type")


@query(
    "a26_shot_report",
    """select *, case when support > 0 then true_positive / support else 0 end as recall, case when predicted > 0 then true_positive / predicted else 0 end as precision,
     case when true_positive > 0 then 2 * (true_positive / predicted) * (true_positive / support) / (true_positive / predicted + true_positive / support) else 0 end as f1
    from (select label, (select count(*) from fx_truth where shot_type = label) as support, (select count(*) from ck_sm2 where sa = label) as matched_support,
      (select count(*) from ck_sm2 where sa = label and ps = label) as true_positive, (select count(*) from ck_sm2 where ps = label) as predicted
     from (select unnest(['SERVE','RETURN','DRIVE','DROP','DINK','VOLLEY','OVERHEAD','OTHER','UNKNOWN']) as label))""",
    "precision recall f1",
)
def a26(t):
    return E.classification_report(_shot_matches(t), t.truth)


@query(
    "a26_shot_confusion",
    "select a.actual, " + ", ".join(f"count(*) filter (where ps = '{p}') as \"{p}\"" for p in C.SHOT_TYPES) + " from (select unnest(['SERVE','RETURN','DRIVE','DROP','DINK','VOLLEY','OVERHEAD','OTHER','UNKNOWN']) as actual) a left join ck_sm2 h on h.sa = a.actual group by 1",
)
def a26c(t):
    return E.confusion(_shot_matches(t), C.SHOT_TYPES, C.SHOT_TYPES)


SHARED["ck_ioup"] = """
select d.frame_id, d.box_id, g.truth_id, greatest(0e0, least(d.r, g.r) - greatest(d.l, g.l)) * greatest(0e0, least(d.b, g.b) - greatest(d.t, g.t)) as inter,
  (d.r - d.l) * (d.b - d.t) as da, (g.r - g.l) * (g.b - g.t) as ga, d.confidence as c, row_number() over (partition by d.frame_id, d.box_id order by g.truth_id) as gi
from fx_boxes d join fx_truth_boxes g on g.frame_id = d.frame_id
"""
@query(
    "e4_box_iou",
    "select frame_id, box_id, truth_id, case when da + ga - inter > 0 then inter / (da + ga - inter) else 0 end as iou from ck_ioup where box_id = truth_id",
    "iou",
)
def e4(t):
    d = t.boxes.select("frame_id", "box_id", *[F.col(c).alias(f"d{c}") for c in "ltrb"])
    g = t.truth_boxes.select("frame_id", "truth_id", *[F.col(c).alias(f"g{c}") for c in "ltrb"])
    both = d.join(g, (d.frame_id == g.frame_id) & (d.box_id == g.truth_id)).drop(g.frame_id)
    return both.select("frame_id", "box_id", "truth_id", G.box_iou(("dl", "dt", "dr", "db"), ("gl", "gt", "gr", "gb")).alias("iou"))


@query("e3_box_points", "select frame_id, box_id, (l + r) / 2 as cx, (t + b) / 2 as cy, (l + r) / 2 as gx, b as gy from fx_boxes", "cx cy gx gy")
def e3(t):
    c, g = G.box_center("l", "t", "r", "b"), G.ground_point("l", "r", "b")
    return t.boxes.select("frame_id", "box_id", c[0].alias("cx"), c[1].alias("cy"), g[0].alias("gx"), g[1].alias("gy"))


# Per frame: detections from the most confident down, each with its true boxes by falling IoU.
SHARED["ck_boxopt"] = """
select d.frame_id, d.box_id, d.confidence, list({'n': -iou, 't': truth_id} order by -iou, truth_id) filter (where iou >= 5e-1) as opts from fx_boxes d
left join (select frame_id, box_id, truth_id, case when da + ga - inter > 0 then inter / (da + ga - inter) else 0 end as iou from ck_ioup) p on p.frame_id = d.frame_id and p.box_id = d.box_id group by 1, 2, 3
"""
SHARED["ck_boxm"] = """
select frame_id, unnest(kept[2:]) as m from (select frame_id, list_reduce(list_prepend([{'box': cast(-1 as bigint), 'opts': cast(null as struct(n double, t bigint)[]), 'got': cast(null as struct(n double, t bigint))}],
   list([{'box': box_id, 'opts': opts, 'got': cast(null as struct(n double, t bigint))}] order by confidence desc, box_id)),
  lambda acc, x: list_concat(acc, [{'box': x[1].box, 'opts': x[1].opts, 'got': list_filter(x[1].opts, lambda o: len(list_filter(acc, lambda a: a.got.t = o.t)) = 0)[1]}])) as kept from ck_boxopt group by 1)
"""
SHARED["ck_boxr"] = "select frame_id, m.box as box_id, m.got.t as truth_id, -m.got.n as iou from ck_boxm"


@query("f2_frame_box_matching", "select * from ck_boxr", "iou")
def f2(t):
    return E.match_boxes(t.boxes, t.truth_boxes).select("frame_id", "box_id", "truth_id", "iou")


def _clips(t):
    return t.dataset_frames.select("source_id", "clip_start_s", "clip_end_s")


SHARED["ck_dur"] = """
select sum(e - s) as d from (select source_id, min(clip_start_s) as s, max(clip_end_s) as e from (
      select *, sum(cast(brk as int)) over (partition by source_id order by clip_start_s, clip_end_s rows unbounded preceding) as g from (
       select *, coalesce(clip_start_s > max(clip_end_s) over (partition by source_id order by clip_start_s, clip_end_s rows between unbounded preceding and 1 preceding), true) as brk
       from (select distinct source_id, clip_start_s, clip_end_s from fx_dataset_frames))) group by source_id, g)
"""


@query(
    "a27_detection_metrics",
    """select predicted, truth, true_positives, covered_frames, positive_frames, d as duration_s, predicted - true_positives as false_positives, truth - true_positives as false_negatives,
      true_positives / predicted as precision, true_positives / truth as recall, covered_frames / positive_frames as coverage, (predicted - true_positives) / (d / 60) as fp_per_minute
    from (select count(*) as predicted, count(truth_id) as true_positives, count(distinct case when truth_id is not null then frame_id end) as covered_frames from ck_boxr),
      (select count(*) as truth, count(distinct frame_id) as positive_frames from fx_truth_boxes), ck_dur""",
    "duration_s precision recall coverage fp_per_minute",
)
def a27(t):
    return E.detection_metrics(E.match_boxes(t.boxes, t.truth_boxes), t.truth_boxes, E.merged_duration(_clips(t)))


@query(
    "a27_side_metrics",
    """select *, true_positives / truth as recall, covered_frames / positive_frames as coverage from (select side, count(*) as truth, count(b.truth_id) as true_positives, count(distinct g.frame_id) as positive_frames,
      count(distinct case when b.truth_id is not null then g.frame_id end) as covered_frames from fx_truth_boxes g left join (select distinct frame_id, truth_id from ck_boxr) b on b.frame_id = g.frame_id and b.truth_id = g.truth_id
    where side in ('near', 'far') group by 1)""",
    "recall coverage",
)
def a27s(t):
    return E.side_metrics(E.match_boxes(t.boxes, t.truth_boxes), t.truth_boxes)


@query(
    "a28_merged_duration",
    """select source_id, sum(e - s) as duration_s, count(*) as ranges from (select source_id, min(clip_start_s) as s, max(clip_end_s) as e from (
      select *, sum(cast(brk as int)) over (partition by source_id order by clip_start_s, clip_end_s rows unbounded preceding) as g from (
       select *, coalesce(clip_start_s > max(clip_end_s) over (partition by source_id order by clip_start_s, clip_end_s rows between unbounded preceding and 1 preceding), true) as brk
       from (select distinct source_id, clip_start_s, clip_end_s from fx_dataset_frames))) group by source_id, g) group by 1""",
    "duration_s",
)
def a28(t):
    return E.merged_duration(_clips(t))


SHARED["ck_boxopt5"] = SHARED["ck_boxopt"].replace("p.box_id = d.box_id group by", "p.box_id = d.box_id where d.confidence >= 5e-1 group by")
SHARED["ck_boxm5"] = SHARED["ck_boxm"].replace("ck_boxopt", "ck_boxopt5")


@query(
    "a29_strategy_comparison",
    """select *, true_positives / predicted as precision, covered_frames / frames as coverage from (select strategy, count(*) as predicted, count(m.got.t) as true_positives, count(distinct frame_id) as frames,
      count(distinct case when m.got.t is not null then frame_id end) as covered_frames from (select 'full' as strategy, * from ck_boxm union all select 'confident', * from ck_boxm5) group by 1)""",
    "precision coverage",
)
def a29(t):
    full = E.match_boxes(t.boxes, t.truth_boxes).withColumn("strategy", F.lit("full"))
    strict = E.match_boxes(t.boxes, t.truth_boxes, min_confidence=0.5).withColumn("strategy", F.lit("confident"))
    return E.compare_strategies(full.unionByName(strict))


@query(
    "o3_frame_set_difference",
    "select frame_id, n, 'left' as only_in from (select frame_id, count(*) as n from fx_boxes group by 1) where frame_id not in (select frame_id from fx_truth_boxes)",
)
def o3(t):
    a, b = t.boxes.select("frame_id").distinct(), t.truth_boxes.select("frame_id").distinct()
    diff = E.frame_set_difference(a, b, ["frame_id"])
    return diff.join(t.boxes.groupBy("frame_id").agg(F.count("*").alias("n")), "frame_id").select("frame_id", "n", "only_in")
