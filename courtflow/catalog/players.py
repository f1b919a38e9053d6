"""Queries over persons, identities, hitters, shots and audio."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.catalog.ball import D, V
from courtflow.catalog.base import SHARED, query
from courtflow.catalog.events import H, HI, bounces_of, contacts_of, greedy_sql, project_sql, rallies_of
from courtflow.catalog.positions import FAR, LEN, NEAR, NET, WID
from courtflow.functions import geometry as G
from courtflow.functions.sequences import spread_join
from courtflow.operators import audio as A
from courtflow.operators import events as X
from courtflow.operators import hitters as HT
from courtflow.operators import players as PL
from courtflow.operators import quality as Q
from courtflow.operators import shots as S

RMSE = 0.06
GX, GY = project_sql("((l + r_px) / 2)", "b")
SHARED["ck_ground0"] = f"""
select *, case when gy_px >= 1079 then 'frame_edge_clipped' when x_m is null then 'transform_invalid' else 'projected' end as projection,
  x_m between 0 and {WID} and y_m between 0 and {LEN} as ins,
  sqrt(power(greatest(0e0, -x_m, x_m - {WID}), 2) + power(greatest(0e0, -y_m, y_m - {LEN}), 2)) as away
from (select *, (l + r_px) / 2 as gx_px, b as gy_px, case when b < 1079 then {GX} end as x_m, case when b < 1079 then {GY} end as y_m from fx_persons)
"""
SHARED["ck_ground"] = f"""
select *, case when x_m is null then 'ambiguous' when ins then 'inside' when away <= 15e-1 then 'near' else 'outside' end as region,
  case when x_m is null then 0 else least(1e0, room / 25e-2) * greatest(25e-2, 1 - 6e-2 / 15e-1) end as region_confidence,
  case when x_m is null then true else room < 25e-2 end as border_ambiguous,
  case when x_m is null then 'ambiguous' when y_m - {NET} < -25e-2 then 'near_side' when y_m - {NET} > 25e-2 then 'far_side' else 'ambiguous' end as side,
  case when x_m is null then 0 else least(1e0, abs(y_m - {NET}) / 25e-2) end as side_confidence
from (select *, case when ins then least(x_m, {WID} - x_m, y_m, {LEN} - y_m) when away <= 15e-1 then least(away, 15e-1 - away) else away - 15e-1 end as room from ck_ground0)
"""


def ground_of(t):
    return PL.assess_ground(t.persons, H, RMSE, V.height)


PXS, PYS = project_sql("((l + r_px) / 2)", "b")
BX, BY = project_sql("x_m", "y_m", HI)


@query("e1_homography", f"select match_id, detection_id, {PXS} as x_m, {PYS} as y_m from fx_persons", "x_m y_m")
def e1(t):
    gx, gy = G.ground_point("l", "r_px", "b")
    rows = t.persons.withColumn("gx", gx).withColumn("gy", gy)
    x, y = G.project("gx", "gy", H)
    return rows.select("match_id", "detection_id", x.alias("x_m"), y.alias("y_m"))


@query("e1_homography_inverse", f"select match_id, role, frame, {BX} as x_px, {BY} as y_px from fx_raw_positions where x_m is not null", "x_px y_px")
def e1i(t):
    x, y = G.project("x_m", "y_m", HI)
    return t.raw_positions.filter("x_m is not null").select("match_id", "role", "frame", x.alias("x_px"), y.alias("y_px"))


# Landmarks: a court grid seen with noise; one calibration per match.
LANDMARKS = """
select cast(floor(event_id / 400) as bigint) as match_id, event_id % 400 as landmark, (event_id % 4) * 2032e-3 as cx, cast(floor(event_id % 400 / 4) as bigint) * 223e-2 as cy,
  cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from {events} where event_id % 400 < 28
"""
BXL, BYL = project_sql("cx", "cy", HI)
SHARED["ck_land"] = f"select *, {BXL} + (k - 50) / 13e0 as u, {BYL} + (k % 17 - 8) / 5e0 as v, k % 9 <> 0 as inlier from ({LANDMARKS.format(events='events')})"
PU, PV = project_sql("u", "v")
SHARED["ck_resid"] = f"select *, sqrt(power({PU} - cx, 2) + power({PV} - cy, 2)) as court_m, sqrt(power({BXL} - u, 2) + power({BYL} - v, 2)) as image_px from ck_land"


def landmarks_of(t):
    rows = t.spark.sql(LANDMARKS, events=t.read("events"))
    u, v = G.project("cx", "cy", HI)
    return rows.withColumn("u", u + (F.col("k") - 50) / 13).withColumn("v", v + (F.col("k") % 17 - 8) / 5).withColumn("inlier", F.col("k") % 9 != 0)


@query("e2_landmark_residuals", "select match_id, landmark, court_m, image_px from ck_resid", "court_m image_px")
def e2r(t):
    return Q.landmark_residuals(landmarks_of(t), H, HI).select("match_id", "landmark", "court_m", "image_px")


@query(
    "e2_calibration_quality",
    f"""select *, case when warnings <> '' then 'warning' else 'pass' end as status from (
    select *, concat_ws(',', case when n = 4 then 'four_points_only' end, case when outliers > 0 then 'outliers' end, case when rmse_px > 3e-3 * {D} then 'image_rmse' end,
      case when rmse_m > 8e-2 then 'court_rmse' end) as warnings from (
    select match_id, count(*) as n, count(*) filter (where not inlier) as outliers, sqrt(avg(court_m * court_m)) as rmse_m, max(court_m) as max_m, sqrt(avg(image_px * image_px)) as rmse_px, max(image_px) as max_px,
      sqrt(avg(court_m * court_m) filter (where inlier)) as inlier_rmse_m, sqrt(avg(image_px * image_px) filter (where inlier)) as inlier_rmse_px from ck_resid group by 1))""",
    "rmse_m max_m rmse_px max_px inlier_rmse_m inlier_rmse_px",
)
def e2(t):
    out = Q.calibration_quality(Q.landmark_residuals(landmarks_of(t), H, HI), V)
    return out.withColumn("warnings", F.concat_ws(",", "warnings"))


@query("e8_court_region", "select match_id, detection_id, region, region_confidence, border_ambiguous from ck_ground", "region_confidence")
def e8(t):
    return ground_of(t).select("match_id", "detection_id", "region", "region_confidence", "border_ambiguous")


@query("e9_court_side", "select match_id, detection_id, side, side_confidence from ck_ground", "side_confidence")
def e9(t):
    return ground_of(t).select("match_id", "detection_id", "side", "side_confidence")


@query("e10_ground_assessment", "select match_id, detection_id, projection, x_m, y_m, region, side from ck_ground", "x_m y_m")
def e10(t):
    return ground_of(t).select("match_id", "detection_id", "projection", "x_m", "y_m", "region", "side")


@query("f11_tracklets")
def f11(t):
    return PL.tracklets(ground_of(t), V).select("match_id", "frame", "detection_id", "tracklet_id", "link")


@query(
    "a16_tracklet_summary",
    """select *, observations >= 15 and court_support >= 6e-1 and dominant_side <> 'ambiguous' as eligible from (
    select *, (inside_n + 5e-1 * near_n) / observations as court_support, observations / span as persistence,
      55e-2 * ((inside_n + 5e-1 * near_n) / observations) + 45e-2 * (observations / span) as score,
      case when near_side_n > far_side_n then 'near_side' when far_side_n > near_side_n then 'far_side' else 'ambiguous' end as dominant_side from (
    select match_id, tracker_id as tracklet_id, count(*) as observations, count(*) filter (where region = 'inside') as inside_n, count(*) filter (where region = 'near') as near_n,
      count(*) filter (where region = 'outside') as outside_n, count(*) filter (where region = 'ambiguous') as ambiguous_n, count(*) filter (where side = 'near_side') as near_side_n,
      count(*) filter (where side = 'far_side') as far_side_n, max(frame) - min(frame) + 1 as span from ck_ground group by 1, 2))""",
    "court_support persistence score",
)
def a16(t):
    return PL.tracklet_summary(ground_of(t).withColumn("tracklet_id", F.col("tracker_id")))


# Manual anchors: the person of each role at frame 10 + 20 * role, a little off.
SHARED["ck_anchor"] = """
select match_id, case r when 0 then 'ME' when 1 then 'PARTNER' when 2 then 'OPPONENT_1' else 'OPPONENT_2' end as role, frame as anchor_frame, t_s as anchor_s, side, tracker_id, detection_id,
  gx_px + 7e0 as anchor_x_px, gy_px - 9e0 as anchor_y_px from ck_ground where frame = 10 + 20 * r
"""


def anchors_of(t):
    g = ground_of(t).filter("frame = 10 + 20 * r")
    role = F.element_at(F.array(*map(F.lit, C.ROLES)), F.col("r").cast("int") + 1)
    return g.select("match_id", role.alias("role"), F.col("frame").alias("anchor_frame"), F.col("t_s").alias("anchor_s"), "side", "tracker_id", "detection_id",
                    (F.col("gx_px") + 7).alias("anchor_x_px"), (F.col("gy_px") - 9).alias("anchor_y_px"))


@query(
    "j10_anchor_rebinding",
    "select match_id, m.a as role, m.b as detection_id, m.d as distance_px from ("
    + greedy_sql(
        f"select a.match_id, a.role as a, g.detection_id as b, sqrt(power(g.gx_px - anchor_x_px, 2) + power(g.gy_px - anchor_y_px, 2)) as d, 0 as s from ck_anchor a join ck_ground g on g.match_id = a.match_id and g.frame = a.anchor_frame and g.side = a.side "
        f"where sqrt(power(g.gx_px - anchor_x_px, 2) + power(g.gy_px - anchor_y_px, 2)) <= {D} * 8e-2"
    )
    + ")",
    "distance_px",
)
def j10(t):
    return PL.rebind_anchors(anchors_of(t), ground_of(t), V.diagonal).select("match_id", "role", "detection_id", "distance_px")


@query("f18_tracker_observations", "select p.match_id, p.detection_id, p.tracker_id, p.confidence, g.region from fx_persons p join ck_ground g on g.match_id = p.match_id and g.detection_id = p.detection_id", "confidence")
def f18(t):
    links = t.persons.select("match_id", "detection_id", "tracker_id")
    return links.join(ground_of(t).drop("tracker_id"), ["match_id", "detection_id"]).select("match_id", "detection_id", "tracker_id", "confidence", "region")


SHARED["ck_desc"] = "select label % 5 as match_id, vec_id as observation_id, vec_id % 3 as tracker_id, vec_id / 30e0 as t_s, embedding from fx_vectors"
SHARED["ck_danchor"] = """
select match_id, role, ix % 3 as tracker_id, 2e0 * ix + 1 as anchor_s from (select distinct match_id from ck_desc)
cross join (select unnest(['ME','PARTNER','OPPONENT_1','OPPONENT_2']) as role, unnest([0, 1, 2, 3]) as ix)
"""
SHARED["ck_proto"] = """
select match_id, role, count(*) as crops, list_transform(range(1, 65), lambda i: avg_list[i] / sqrt(list_sum(list_transform(avg_list, lambda v: v * v)))) as prototype from (
 select match_id, role, 1 as one, list(m order by i) as avg_list from (select d.match_id, a.role, u.i, avg(cast(d.embedding[u.i] as double)) as m
  from ck_desc d join ck_danchor a on a.match_id = d.match_id and a.tracker_id = d.tracker_id and abs(d.t_s - a.anchor_s) <= 3 cross join (select unnest(range(1, 65)) as i) u group by 1, 2, 3) group by 1, 2) group by 1, 2, avg_list
"""
SHARED["ck_crops"] = "select d.match_id, a.role, count(*) as crops from ck_desc d join ck_danchor a on a.match_id = d.match_id and a.tracker_id = d.tracker_id and abs(d.t_s - a.anchor_s) <= 3 group by 1, 2"


def descriptors_of(t):
    v = t.vectors
    return v.select((F.col("label") % 5).alias("match_id"), F.col("vec_id").alias("observation_id"), (F.col("vec_id") % 3).alias("tracker_id"), (F.col("vec_id") / 30).alias("t_s"), "embedding")


def prototypes_of(t):
    d = descriptors_of(t)
    cells = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(i % 3).cast("bigint").alias("tracker_id"), F.lit(2.0 * i + 1).alias("anchor_s")) for i, r in enumerate(C.ROLES)])
    return d, PL.appearance_prototypes(d, d.select("match_id").distinct().select("match_id", F.inline(cells)))


@query("a21_appearance_prototypes", "select p.match_id, p.role, c.crops, prototype[1] as p1, prototype[33] as p33, prototype[64] as p64 from ck_proto p join ck_crops c on c.match_id = p.match_id and c.role = p.role", "p1 p33 p64")
def a21(t):
    p = prototypes_of(t)[1]
    return p.select("match_id", "role", "crops", F.col("prototype")[0].alias("p1"), F.col("prototype")[32].alias("p33"), F.col("prototype")[63].alias("p64"))


@query(
    "e22_appearance_similarity",
    "select d.match_id, d.observation_id, p.role, least(1e0, greatest(0e0, list_sum(list_transform(range(1, 65), lambda i: cast(d.embedding[i] as double) * p.prototype[i])))) as similarity from ck_desc d join ck_proto p on p.match_id = d.match_id",
    "similarity",
)
def e22(t):
    d, p = prototypes_of(t)
    return spread_join(d, p, ["match_id"]).select("match_id", "observation_id", "role", PL.cosine("embedding", "prototype").alias("similarity"))


SIM = "select cast(floor(event_id / 400) as bigint) as match_id, cast(floor(event_id / 4) as bigint) as observation_id, case event_id % 4 when 0 then 'ME' when 1 then 'PARTNER' when 2 then 'OPPONENT_1' else 'OPPONENT_2' end as role, case when event_id % 4 < 2 then 'near_side' else 'far_side' end as side, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) / 99e0 as similarity from {events}"
SHARED["ck_sim"] = SIM.format(events="events")


@query("a22_appearance_margin", "select a.match_id, a.observation_id, a.role, a.similarity - max(b.similarity) as margin from ck_sim a left join ck_sim b on b.observation_id = a.observation_id and b.side = a.side and b.role <> a.role group by 1, 2, 3, a.similarity", "margin")
def a22(t):
    return PL.appearance_margins(t.spark.sql(SIM, events=t.read("events"))).select("match_id", "observation_id", "role", "margin")


def _observations(t):
    g = ground_of(t)
    return g.withColumn("observation_id", F.col("detection_id"))


# What each observation brings for a role, by tracker id followed so far and by another.
SHARED["ck_idterm"] = f"""
select *, case when keeps then 55e-2 + 15e-2 * confidence + 10e-2 * place + 5e-2 * half end as same,
  case when changes then 18e-2 + 12e-2 * confidence + 15e-2 * place + 10e-2 * half end as other
from (select a.match_id, a.role, a.anchor_frame as first, g.frame, g.detection_id as id, g.t_s as t, g.tracker_id as k, g.x_m as x, g.y_m as y, g.confidence,
    case g.region when 'inside' then 1e0 when 'near' then 65e-2 else 25e-2 end as place, case when g.side = a.side then 1e0 else 45e-2 end as half,
    not (a.side <> 'ambiguous' and g.side <> 'ambiguous' and g.side <> a.side)
      and (g.region <> 'outside' or coalesce(g.x_m between 0 and {WID} and not (g.y_m between 0 and {LEN}), false)) as keeps,
    not (a.side <> 'ambiguous' and g.side <> 'ambiguous' and g.side <> a.side) and g.region not in ('outside', 'ambiguous') and g.x_m is not null as changes
  from ck_anchor a join ck_ground g on g.match_id = a.match_id)
"""
_ID_NOTHING = "'id': cast(null as bigint), 'sc': cast(null as double), 'm': cast(null as varchar)"
SHARED["ck_idframe"] = """
select match_id, role, frame, abs(frame - first) as far, frame > first as ahead, list({'id': id, 't': t, 'k': k, 'x': x, 'y': y, 'same': same, 'other': other} order by id) as c
from ck_idterm where frame <> first group by match_id, role, frame, first
"""
_MOVED = "case when p.x is not null and o.x is not null then 1 - sqrt(power(o.x - p.x, 2) + power(o.y - p.y, 2)) / (5e-1 + 8e0 * abs(o.t - p.t)) when o.k is not distinct from p.k then 35e-2 else -1e0 end"
_SCORE = f"""case when o.t = p.t or abs(o.t - p.t) > 3 or {_MOVED} < 0 then null
  when o.k is not distinct from p.k then case when o.same is not null then least(1e0, o.same + 15e-2 * {_MOVED}) end
  when o.other is not null then least(1e0, o.other + 30e-2 * {_MOVED} + 15e-2 * greatest(0e0, 1 - abs(o.t - p.t) / 3)) end"""
_RANKED = f"list_sort(list_filter(list_transform(x[1].c, lambda o: {{'n': -({_SCORE}), 'id': o.id, 't': o.t, 'k': o.k, 'x': o.x, 'y': o.y}}), lambda z: z.n <= -45e-2))"
_FOLLOW = """{'f': x[1].f, 'c': x[1].c, 'id': s[1].id, 'sc': -s[1].n,
  'm': case when len(s) = 0 then null when s[1].k is distinct from p.k and not (abs(x[1].f - p.f) > 1 and -s[1].n >= 65e-2) then 'id_change_requires_review'
    when s[1].k is distinct from p.k or abs(x[1].f - p.f) > 1 then 'reacquisition' else 'continuity' end,
  'p': case when len(s) = 0 then p else {'f': x[1].f, 't': s[1].t, 'k': s[1].k, 'x': s[1].x, 'y': s[1].y} end}"""
# One walk forwards and one backwards from each anchor; a state holds what was followed last.
SHARED["ck_idwalk"] = f"""
select match_id, role, unnest(kept[2:]) as h from (
 select f.match_id, f.role, f.ahead, list_reduce(list_prepend([{{'f': any_value(g.frame), 'c': any_value(f.c)[1:0], {_ID_NOTHING}, 'p': {{'f': any_value(g.frame), 't': any_value(g.t_s), 'k': any_value(g.tracker_id), 'x': any_value(g.x_m), 'y': any_value(g.y_m)}}}}],
    list([{{'f': f.frame, 'c': f.c, {_ID_NOTHING}, 'p': {{'f': cast(null as bigint), 't': cast(null as double), 'k': cast(null as bigint), 'x': cast(null as double), 'y': cast(null as double)}}}}] order by f.far)),
  lambda acc, x: list_concat(acc, list_transform(list_transform([acc[len(acc)].p], lambda p: {{'p': p, 's': {_RANKED}}}), lambda w: list_transform([w.p], lambda p: list_transform([w.s], lambda s: {_FOLLOW})[1])[1]))) as kept
 from ck_idframe f join ck_anchor a on a.match_id = f.match_id and a.role = f.role join ck_ground g on g.match_id = a.match_id and g.detection_id = a.detection_id group by 1, 2, 3)
"""


@query(
    "f12_logical_identities",
    """select match_id, role, h.f as frame, h.id as observation_id, h.sc as confidence, h.m as method from ck_idwalk where h.id is not null
    union all select match_id, role, anchor_frame, detection_id, 1e0, 'seed' from ck_anchor""",
    "confidence",
)
def f12(t):
    obs, a = _observations(t), anchors_of(t)
    seeds = a.select("match_id", "role", "side", F.col("anchor_frame").alias("frame"), F.col("detection_id").alias("observation_id"), F.lit(True).alias("manual"))
    return PL.resolve_identities(obs, seeds)


CLAIM = "select cast(floor(event_id / 400) as bigint) as match_id, cast(floor(event_id % 400 / 4) as bigint) as frame, cast(floor(event_id / 2) as bigint) as observation_id, case event_id % 4 when 0 then 'ME' when 1 then 'PARTNER' when 2 then 'OPPONENT_1' else 'OPPONENT_2' end as role, round(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) / 9e0, 0) as confidence from {events}"
SHARED["ck_claim"] = CLAIM.format(events="events")


@query("f13_exclusive_claims", "select match_id, frame, observation_id, role, confidence from (select *, row_number() over (partition by match_id, frame, observation_id order by confidence desc, case role when 'ME' then 1 when 'PARTNER' then 2 when 'OPPONENT_1' then 3 else 4 end) as rn from ck_claim) where rn = 1", "confidence")
def f13(t):
    return PL.exclusive_claims(t.spark.sql(CLAIM, events=t.read("events"))).select("match_id", "frame", "observation_id", "role", "confidence")


SHARED["ck_chosen"] = "select match_id, case r when 0 then 'ME' when 1 then 'PARTNER' when 2 then 'OPPONENT_1' else 'OPPONENT_2' end as role, frame, detection_id as observation_id, confidence, tracker_id, case when frame = 10 then 'seed' else 'continuity' end as method from fx_persons where confidence >= 37e-2"
SHARED["ck_states"] = """
select *, case when pf is null then 'observed' when tracker_id <> pt and (frame - pf <= 1 or confidence < 65e-2) then 'suspected_identity_switch' when tracker_id <> pt or frame - pf > 1 then 'reacquired' else 'observed' end as state
from (select *, lag(frame) over w as pf, lag(tracker_id) over w as pt from ck_chosen window w as (partition by match_id, role order by frame))
"""


def states_of(t):
    p = t.persons
    role = F.element_at(F.array(*map(F.lit, C.ROLES)), F.col("r").cast("int") + 1)
    obs = p.withColumn("observation_id", F.col("detection_id"))
    chosen = obs.filter(F.col("confidence") >= 0.37).select("match_id", role.alias("role"), "frame", "observation_id", "confidence", F.when(F.col("frame") == 10, "seed").otherwise("continuity").alias("method"))
    return PL.track_states(chosen, obs)


@query("w15_track_states", "select match_id, role, frame, state, pt as previous_tracker_id from ck_states")
def w15(t):
    return states_of(t).select("match_id", "role", "frame", "state", "previous_tracker_id")


@query(
    "a15_tracking_summary",
    """select s.match_id, s.role, s.observed_frames, s.switches, s.reacquisitions, s.observed_frames / 100 as coverage, case when observed_frames = 0 then 100 else coalesce(g.n, 0) end as missing_frames,
      case when observed_frames = 0 then 0 else g.st end as missing_start, case when observed_frames = 0 then 100 else coalesce(g.n, 0) end / 30e0 as missing_s
    from (select m.match_id, r.role, count(x.role) as observed_frames, count(*) filter (where state = 'suspected_identity_switch') as switches, count(*) filter (where state = 'reacquired') as reacquisitions
      from (select distinct match_id from fx_persons) m cross join (select unnest(['ME', 'PARTNER', 'OPPONENT_1', 'OPPONENT_2']) as role) r
      left join ck_states x on x.match_id = m.match_id and x.role = r.role group by 1, 2) s
    left join (select *, row_number() over (partition by match_id, role order by n desc, st) as rn from (
      select match_id, role, coalesce(pf, -1) + 1 as st, frame - coalesce(pf, -1) - 1 as n from ck_states where frame - coalesce(pf, -1) > 1
      union all select match_id, role, max(frame) + 1, 99 - max(frame) from ck_states group by 1, 2 having max(frame) < 99)) g on g.match_id = s.match_id and g.role = s.role and g.rn = 1""",
    "coverage missing_s",
)
def a15(t):
    matches = t.persons.select("match_id").distinct().withColumn("frame_count", F.lit(100).cast("bigint"))
    return PL.tracking_summary(states_of(t), matches, 30.0)


@query("s2_rows_with_boxes", "select c.match_id, c.role, c.frame, p.l, p.t, p.r_px as r, p.b from ck_chosen c join fx_persons p on p.match_id = c.match_id and p.detection_id = c.observation_id", "l t r b")
def s2(t):
    from courtflow.sources.artifacts import with_boxes

    rows = states_of(t).select("match_id", "role", "frame", "observation_id")
    return with_boxes(rows, t.persons.withColumnRenamed("r", "role_ix").withColumnRenamed("r_px", "r")).drop("observation_id")


# --- hitters and shots ------------------------------------------------------

CN = "select b.match_id, b.frame, b.t_s, b.x_px, b.y_px, 6e-1 + b.k / 251e0 as visual, cast(floor(b.frame / 250) as bigint) * 250 as rally_id, (b.k - 50) * 11e0 as by_, (47 - b.k) * 9e0 as ay from fx_ball b where b.frame % 37 = 5 and b.x_px is not null and b.frame % 250 < 160"
SHARED["ck_cn"] = CN


def plain_contacts(t):
    b = t.ball.filter("frame % 37 = 5 and x_px is not null and frame % 250 < 160")
    return b.select("match_id", "frame", "t_s", "x_px", "y_px", (F.lit(0.6) + F.col("k") / 251).alias("visual"), (F.floor(F.col("frame") / 250) * 250).alias("rally_id"),
                    ((F.col("k") - 50) * 11.0).alias("by"), ((47 - F.col("k")) * 9.0).alias("ay"))


def players_at(t, contacts):
    return X.candidate_players(contacts, t.player_boxes, V, 0.12)


SHARED["ck_pscore"] = f"""
select c.match_id, c.frame, p.role, 35e-2 * case when p.inside then 1 else p.proximity end
  + 17e-2 * p.tracking_confidence * case p.state when 'observed' then 1e0 when 'reacquired' then 85e-2 when 'suspected_identity_switch' then 3e-1 else 0 end
  + 18e-2 * case when n > 0 then hits / n else 5e-1 end + 12e-2 * c.visual + 8e-2 * case p.region when 'inside' then 1e0 when 'near' then 65e-2 when 'ambiguous' then 35e-2 else 0 end as base_score
from (select c.*, p.role as rr, (cast(abs(by_) / {D} >= 15e-3 as int) + cast(abs(ay) / {D} >= 15e-3 as int)) as n,
    cast(abs(by_) / {D} >= 15e-3 and sign(by_) = case when p.side = 'near_side' then 1 else -1 end as int) + cast(abs(ay) / {D} >= 15e-3 and sign(ay) = case when p.side = 'near_side' then -1 else 1 end as int) as hits
  from ck_cn c join ck_players p on p.match_id = c.match_id and p.frame = c.frame) c
join ck_players p on p.match_id = c.match_id and p.frame = c.frame and p.role = c.rr
"""


@query("f14_player_scores", "select * from ck_pscore", "base_score")
def f14_scores(t):
    c = plain_contacts(t)
    rows = players_at(t, c).drop("x_px", "y_px").join(c.select("match_id", "frame", "visual", "by", "ay"), ["match_id", "frame"])
    return HT.score_players(rows, V).select("match_id", "frame", "role", "base_score")


def hitters_of(t, contacts):
    return HT.identify(contacts, players_at(t, contacts), V)


# One step of the walk over contacts: score with the hitter before, decide, carry on.
SHARED["ck_hin"] = """
select c.match_id, c.frame, c.t_s, c.visual, c.rally_id, list({'role': s.role, 'side': p.side, 'base': s.base_score, 'near': p.inside or p.distance_px / DIAG <= 12e-2, 'tr': p.tracking_confidence} order by s.role) as ps
from ck_cn c join ck_pscore s on s.match_id = c.match_id and s.frame = c.frame join ck_players p on p.match_id = s.match_id and p.frame = s.frame and p.role = s.role group by 1, 2, 3, 4, 5
""".replace("DIAG", D)
_NONE = "'id': cast(null as varchar), 'conf': cast(null as double), 'side': cast(null as varchar), 'best': cast(null as double), 'margin': cast(null as double), 'used': false, 'ps': cast(null as varchar), 'pt': cast(null as double), 'pr': cast(null as bigint)"
_IN = "'f': frame, 't': t_s, 'v': visual, 'r': rally_id, 'p': ps"
_SCORED = """list_sort(list_transform(x[1].p, lambda p: {'n': -least(1e0, greatest(0e0, p.base + 1e-1 * case when use.u and use.a.ps is not null then case when p.side <> use.a.ps then 1e0 else 0e0 end else 5e-1 end)), 'role': p.role, 'side': p.side, 'near': p.near, 'tr': p.tr}))"""
_DECIDE = """{'f': x[1].f, 't': x[1].t, 'v': x[1].v, 'r': x[1].r, 'p': x[1].p, 'id': case when d.sure then d.s[1].role else 'UNKNOWN' end,
  'conf': case when d.sure then -d.s[1].n else 1 - least(1e0, greatest(0e0, least(x[1].v / 78e-2, -d.s[1].n / 62e-2, d.m / 8e-2, d.s[1].tr / 45e-2, case when d.s[1].near then 1e0 else 0e0 end))) end,
  'side': case when d.sure then d.s[1].side end, 'best': -d.s[1].n, 'margin': d.m, 'used': d.u,
  'ps': case when x[1].v < 78e-2 then d.a.ps when d.sure and -d.s[1].n >= 7e-1 then d.s[1].side end, 'pt': case when x[1].v < 78e-2 then d.a.pt when d.sure and -d.s[1].n >= 7e-1 then x[1].t end,
  'pr': case when x[1].v < 78e-2 then d.a.pr when d.sure and -d.s[1].n >= 7e-1 then x[1].r end}"""
_SURE = "{'s': s.s, 'm': s.s[2].n - s.s[1].n, 'u': s.u, 'a': s.a, 'sure': x[1].v >= 78e-2 and s.s[1].near and s.s[1].tr >= 45e-2 and -s.s[1].n >= 62e-2 and s.s[2].n - s.s[1].n >= 8e-2}"
SHARED["ck_hwalk"] = f"""
select match_id, unnest(kept[2:]) as h from (select match_id, list_reduce(list_prepend([{{'f': cast(-1 as bigint), 't': cast(-1 as double), 'v': cast(0 as double), 'r': cast(null as bigint), 'p': any_value(ps)[1:0], {_NONE}}}], list([{{{_IN}, {_NONE}}}] order by frame)),
  lambda acc, x: list_concat(acc, list_transform(list_transform(list_transform([{{'a': acc[len(acc)], 'u': acc[len(acc)].pt is not null and x[1].t - acc[len(acc)].pt <= 4 and x[1].r = acc[len(acc)].pr}}],
     lambda use: {{'s': {_SCORED}, 'u': use.u, 'a': use.a}}), lambda s: {_SURE}), lambda d: {_DECIDE}))) as kept from ck_hin group by 1)
"""


@query(
    "f14_hitters",
    "select match_id, h.f as frame, h.t as t_s, h.v as visual, h.r as rally_id, h.id as hitter_id, h.conf as hitter_confidence, h.side as hitter_side, h.best as best_score, h.margin as margin, h.used as context_used, cast(case when h.id = 'UNKNOWN' then 4 else 3 end as bigint) as alternatives from ck_hwalk",
    "t_s visual hitter_confidence best_score margin",
)
def f14(t):
    out = hitters_of(t, plain_contacts(t))
    return out.withColumn("alternatives", F.size("alternatives").cast("bigint"))


@query(
    "a17_hitter_statistics",
    "select match_id, count(*) as contacts, count(*) filter (where h.id <> 'UNKNOWN') as assigned, count(*) filter (where h.id = 'UNKNOWN') as unknown, "
    + ", ".join(f"count(*) filter (where h.id = '{r}') as {r}" for r in C.ROLES)
    + ", avg(h.conf) filter (where h.id <> 'UNKNOWN') as mean_assigned_confidence, count(*) filter (where h.id <> 'UNKNOWN') / count(*) as assignment_rate from ck_hwalk group by 1",
    "mean_assigned_confidence assignment_rate",
)
def a17_hitters(t):
    return HT.statistics(hitters_of(t, plain_contacts(t)))


SHARED["ck_shot"] = """
select c.match_id, c.frame, r.rally_id, row_number() over w as shot_index, lead(c.frame) over w as next_frame, coalesce(lead(c.frame) over w, r.end_frame) as end_frame
from ck_cn c join ck_rl r on r.match_id = c.match_id and c.frame between r.start_frame and r.end_frame window w as (partition by c.match_id, r.rally_id order by c.frame)
"""


@query("w17_shot_frames", "select * from ck_shot")
def w17(t):
    return S.shot_frames(plain_contacts(t), rallies_of(t)).select("match_id", "frame", "rally_id", "shot_index", "next_frame", "end_frame")


def _bounces(t):
    f = F.col("frame")
    return bounces_of(t).withColumn("bounce_id", f).withColumn("court_x_m", f % 60 / 10).withColumn("court_y_m", f % 130 / 10)


SHARED["ck_shotb"] = """
select s.*, b.frame as bounce_frame, b.frame % 130 / 1e1 as landing_y_m from ck_shot s left join ck_bn b on b.match_id = s.match_id and b.frame = (select min(q.frame) from ck_bn q where q.match_id = s.match_id
  and q.frame > s.frame and case when s.next_frame is not null then q.frame < s.end_frame else q.frame <= s.end_frame end)
"""


@query("j5_first_bounce", "select match_id, frame, bounce_frame, landing_y_m from ck_shotb", "landing_y_m")
def j5(t):
    return S.first_bounce(S.shot_frames(plain_contacts(t), rallies_of(t)), _bounces(t)).select("match_id", "frame", "bounce_frame", "landing_y_m")


SHARED["ck_link"] = f"""
select match_id, frame, pf, case when segment_id = ps and t_s > pt then d / ({D} * (t_s - pt)) end as speed from (
 select *, lag(frame) over w as pf, lag(segment_id) over w as ps, lag(t_s) over w as pt, sqrt(power(x_px - lag(x_px) over w, 2) + power(y_px - lag(y_px) over w, 2)) as d
 from fx_ball where x_px is not null window w as (partition by match_id order by frame))
"""
SHARED["ck_traj"] = """
select s.match_id, s.frame, count(*) filter (where status = 'OBSERVED') as observed, count(*) filter (where status = 'INTERPOLATED') as interpolated, count(*) filter (where status = 'UNKNOWN') as unknown,
  arg_min(b.x_px, b.frame) filter (where b.x_px is not null) as first_x, arg_max(b.x_px, b.frame) filter (where b.x_px is not null) as last_x,
  arg_min(l.speed, l.frame) filter (where l.speed is not null and l.pf >= s.frame) as initial_speed, max(l.speed) filter (where l.pf >= s.frame) as peak_speed,
  count(b.x_px) as known_points, count(b.x_px) / count(*) as known_fraction
from ck_shot s join fx_ball b on b.match_id = s.match_id and b.frame between s.frame and s.end_frame left join ck_link l on l.match_id = b.match_id and l.frame = b.frame group by 1, 2
"""


@query("w18_trajectory_summary", "select * from ck_traj", "first_x last_x initial_speed peak_speed known_fraction")
def w18(t):
    out = S.trajectory_summary(S.shot_frames(plain_contacts(t), rallies_of(t)), t.ball, V)
    return out.select("match_id", "frame", "observed", "interpolated", "unknown", F.col("first.x_px").alias("first_x"), F.col("last.x_px").alias("last_x"), "initial_speed", "peak_speed", "known_points", "known_fraction")


@query("e24_contact_height", "select c.match_id, c.frame, p.role, (c.y_px - p.t) / (p.b - p.t) as height_ratio from ck_cn c join fx_player_boxes p on p.match_id = c.match_id and p.frame = c.frame", "height_ratio")
def e24(t):
    both = plain_contacts(t).drop("by", "ay").join(t.player_boxes, ["match_id", "frame"])
    return both.select("match_id", "frame", "role", S.height_ratio("y_px", "t", "b").alias("height_ratio"))


FEATS = """
select cast(floor(event_id / 1000) as bigint) as match_id, cast(floor(event_id / 8) as bigint) as rally_id, event_id % 8 + 1 as shot_index, case k % 6 when 0 then 'UNKNOWN' when 1 then 'ME' when 2 then 'PARTNER' else 'OPPONENT_1' end as hitter_id,
 5e-1 + (k % 41) / 83e0 as hitter_confidence, case when k % 6 in (1, 2) then 'near_side' else 'far_side' end as hitter_side,
 case when k % 19 = 0 then null when k % 6 in (1, 2) then 46e-1 - v / 2e1 else 88e-1 + v / 2e1 end as hitter_y_m,
 4e-1 + (k % 51) / 87e0 as known_fraction, (k + event_id) % 9 as known_points, case when k % 23 = 0 then null else 5e-2 + (v * 7e0) % 61e-2 end as initial_speed,
 case when (k + event_id) % 2 = 0 then event_id end as bounce_id, case when (k + event_id) % 2 = 0 then 45e-1 + (k % 45) / 1e1 end as landing_y_m,
 (k % 10) / 1e1 as height_ratio, 7e-1 + (k % 31) / 113e0 as visual
from (select event_id, value as v, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from {events}) z
"""
SHARED["ck_feat"] = FEATS.format(events="events")
DEP = f"case when hitter_side = 'near_side' then greatest(0e0, {NEAR} - hitter_y_m) else greatest(0e0, hitter_y_m - {FAR}) end"
OPP = f"case when hitter_side = 'near_side' then landing_y_m between {NET} and {FAR} else landing_y_m between {NEAR} and {NET} end"
SHARED["ck_cls"] = f"""
select *, case when miss then 'UNKNOWN' when serve then 'SERVE' when shot_index = 2 and coalesce(ps and pb, false) then 'RETURN'
  when late and height_ratio <= 45e-2 and initial_speed >= 35e-2 then 'OVERHEAD' when coalesce(opp, false) and depth_m <= 9e-1 and initial_speed <= 28e-2 then 'DINK'
  when coalesce(opp, false) and depth_m >= 9e-1 and initial_speed <= 38e-2 then 'DROP' when late and depth_m <= 9e-1 then 'VOLLEY' when initial_speed >= 45e-2 then 'DRIVE' else 'OTHER' end as shot_type
from (select *, shot_index > 2 and not coalesce(pb, false) as late from (select *, lag(serve) over w as ps, lag(bounce_id is not null) over w as pb from (
 select *, not miss and shot_index = 1 and bounce_id is not null and depth_m >= 12e-1 as serve from (
 select *, {DEP} as depth_m, {OPP} as opp, hitter_id = 'UNKNOWN' or hitter_confidence < 62e-2 or hitter_y_m is null or known_fraction < 5e-1 or known_points < 3 or initial_speed is null as miss from ck_feat))
 window w as (partition by match_id, rally_id order by shot_index)))
"""


@query(
    "f15_shot_rules",
    """select match_id, rally_id, shot_index, shot_type, depth_m, opp as in_opponent_kitchen, case when miss then 1 - greatest(0e0, least(1e0, case when hitter_id <> 'UNKNOWN' then 1e0 else 0 end, case when hitter_y_m is not null then 1e0 else 0 end,
      case when initial_speed is not null then 1e0 else 0 end, hitter_confidence / 62e-2, known_fraction / 5e-1, known_points / 3))
     else least(1e0, least(visual, hitter_confidence, greatest(5e-1, known_fraction)) * (7e-1 + 3e-1 * case shot_type when 'SERVE' then least(1e0, depth_m / 12e-1) when 'RETURN' then 1 when 'OVERHEAD' then least(1e0, initial_speed / 35e-2)
       when 'DINK' then 1 - least(1e0, initial_speed / 28e-2) when 'DROP' then least(1e0, depth_m / 9e-1) when 'VOLLEY' then 1 - least(1e0, depth_m / 9e-1) when 'DRIVE' then least(1e0, initial_speed / 45e-2) else 5e-1 end)) end as confidence from ck_cls""",
    "depth_m confidence",
)
def f15(t):
    features = t.spark.sql(FEATS, events=t.read("events"))
    return S.classify(features).select("match_id", "rally_id", "shot_index", "shot_type", "depth_m", "in_opponent_kitchen", "confidence")


@query("e25_landing_kitchen", f"select match_id, rally_id, shot_index, {OPP} as in_opponent_kitchen from ck_feat where landing_y_m is not null")
def e25(t):
    features = t.spark.sql(FEATS, events=t.read("events"))
    return features.filter("landing_y_m is not null").select("match_id", "rally_id", "shot_index", G.lands_in_opponent_kitchen("landing_y_m", "hitter_side").alias("in_opponent_kitchen"))


def shots_of(t):
    from courtflow.session import cut_lineage

    contacts = cut_lineage(contacts_of(t))
    hitters = hitters_of(t, contacts)
    boxes = t.player_boxes
    y = F.when(F.col("side") == "near_side", F.lit(4.4) - F.col("t") / 200).otherwise(F.lit(9.0) + F.col("t") / 200)
    positions = boxes.select("match_id", "frame", "role", "side", (F.col("l") / 320).alias("px_m"), y.alias("py_m"))
    return S.reconstruct(t.ball, rallies_of(t), contacts, _bounces(t), hitters, boxes, positions, V)


@query("f16_shots")
def f16(t):
    return shots_of(t).select("match_id", "shot_no", "rally_id", "shot_index", "frame", "end_frame", "hitter_id", "bounce_id", "shot_type", "confidence", "initial_speed")


@query("a17_shot_statistics")
def a17_shots(t):
    return S.statistics(shots_of(t))


# --- audio ------------------------------------------------------------------

AF = "select cast(floor(event_id / 1000) as bigint) as match_id, event_id % 1000 as window_ix, value as onset, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) / 400e0 as peak, (event_id % 1000) * 160 + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as peak_sample from {events}"
SHARED["ck_af"] = AF.format(events="events")
SHARED["ck_z"] = """
select *, (onset - baseline) / scale as z from (select *, greatest(14826e-4 * median(abs(onset - baseline)) over (partition by match_id), 1e-6) as scale from (
 select *, median(onset) over (partition by match_id) as baseline from ck_af))
"""


def audio_features(t):
    return t.spark.sql(AF, events=t.read("events"))


@query("a19_robust_threshold", "select match_id, window_ix, baseline, scale, z from ck_z", "baseline scale z")
def a19(t):
    return A.robust_scores(audio_features(t), width=2.0).select("match_id", "window_ix", "baseline", "scale", "z")


SHARED["ck_peak"] = "select * from (select *, lag(z) over w as pz, lead(z) over w as nz from ck_z window w as (partition by match_id order by window_ix)) where pz is not null and z >= 4 and z >= pz and (nz is null or z > nz)"


@query("w21_peaks", "select match_id, window_ix, z from ck_peak", "z")
def w21(t):
    return A.peaks(A.robust_scores(audio_features(t), width=2.0)).select("match_id", "window_ix", "z")


SHARED["ck_tkept"] = """
select match_id, unnest(kept) as p from (select match_id, list_reduce(list([peak_sample] order by z desc, peak_sample),
 lambda acc, x: case when len(list_filter(acc, lambda a: abs(a - x[1]) < 1280)) > 0 then acc else list_concat(acc, x) end) as kept from ck_peak group by 1)
"""


@query(
    "f4_audio_transients",
    "select p.match_id, p.window_ix, p.peak_sample, p.z, least(1e0, 85e-2 * (5e-1 + 5e-1 * (1 - exp(-(z - 4) / 4))) + 15e-2 * least(1e0, peak * 4)) as confidence from ck_peak p join ck_tkept k on k.match_id = p.match_id and k.p = p.peak_sample",
    "z confidence",
)
def f4(t):
    return A.transients(A.robust_scores(audio_features(t), width=2.0), 16000).select("match_id", "window_ix", "peak_sample", "z", "confidence")


@query(
    "w20_spectral_flux",
    """select match_id, vec_id, case when p is null then 0 else sqrt(list_sum(list_transform(range(1, 65), lambda i: power(greatest(embedding[i] - p[i], 0), 2))) / 64) end as onset from (
    select label as match_id, vec_id, embedding, lag(embedding) over (partition by label order by vec_id) as p from (select label, vec_id, list_transform(embedding, lambda v: cast(v as double)) as embedding from fx_vectors))""",
    "onset",
)
def w20(t):
    rows = t.vectors.select(F.col("label").alias("match_id"), "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("spectrum"))
    return A.spectral_flux(rows, position="vec_id").select("match_id", "vec_id", "onset")


def sample_blocks(t, block: int = 100):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    rows = t.read("events").select(
        F.floor(F.col("event_id") / 1000).alias("match_id"), F.floor(F.col("event_id") % 1000 / block).alias("block_ix"),
        F.struct("event_id", (F.col("value") / 400 * F.sin(F.col("event_id") * 1.7)).alias("a"), ((k - 50) / 100).alias("b")).alias("s"))
    ordered = rows.groupBy("match_id", "block_ix").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return ordered.select("match_id", "block_ix", F.array(F.transform("s", lambda v: v["a"]), F.transform("s", lambda v: v["b"])).alias("channels"))


SHARED["ck_smp"] = f"""
select cast(floor(event_id / 1000) as bigint) as match_id, event_id % 1000 as n, value / 400 * sin(event_id * 17e-1) as a, (cast(regexp_extract(props, '([0-9]+)', 1) as bigint) - 50) / 100e0 as b from events
"""
SHARED["ck_cut"] = "select w.st, s.match_id, s.n - w.st as i, s.a, s.b from ck_smp s join (select unnest(list_distinct(range(0, 969, 10) || [968])) as st) w on s.n >= w.st and s.n < w.st + 32"
SHARED["ck_dft"] = """
select match_id, st, k, sqrt(((pow(sum(a * h * cos(2 * pi() * k * i / 32)), 2) + pow(sum(a * h * sin(2 * pi() * k * i / 32)), 2)) + (pow(sum(b * h * cos(2 * pi() * k * i / 32)), 2) + pow(sum(b * h * sin(2 * pi() * k * i / 32)), 2))) / 2) as mag
from (select *, 5e-1 - 5e-1 * cos(2 * pi() * i / 31) as h from ck_cut) cross join (select unnest(range(0, 17)) as k) group by 1, 2, 3
"""
SHARED["ck_spec"] = """
select match_id, st, sum(k * 3125e-2 * mag * mag) / sum(mag * mag) as centroid_hz, arg_max(k, mag) filter (where k > 0) * 3125e-2 as dominant_hz,
  sum(mag * mag) filter (where k * 3125e-2 < 500) / sum(mag * mag) as low, coalesce(sum(mag * mag) filter (where k * 3125e-2 >= 500), 0) / sum(mag * mag) as mid from ck_dft group by 1, 2
"""
SHARED["ck_amp"] = """
select match_id, st, max(greatest(abs(a), abs(b))) as peak, sqrt(sum(a * a + b * b) / 64) as rms, st + arg_max(i, [greatest(abs(a), abs(b)), -i]) as peak_sample,
  count(*) filter (where neg <> pneg) / 31 as zero_crossing from (select *, (a + b) / 2 < 0 as neg, lag((a + b) / 2 < 0) over (partition by match_id, st order by i) as pneg from ck_cut) group by 1, 2
"""


@query(
    "f17_audio_windows",
    "select a.match_id, a.st as start, a.peak_sample, a.peak, a.rms, centroid_hz, dominant_hz, low, mid, greatest(0, 1 - low - mid) as high, zero_crossing from ck_amp a join ck_spec s on s.match_id = a.match_id and s.st = a.st",
    "peak rms centroid_hz dominant_hz low mid high zero_crossing",
)
def f17(t):
    out = A.spectra(A.cut_windows(sample_blocks(t), 100, 1000), 1000)
    return out.drop("spectrum", "channel_peak", "channel_rms", "channel_spectra")


SHARED["ck_flux"] = """
select match_id, st, sqrt(avg(power(greatest(l - p, 0), 2))) as onset from (select match_id, st, ln(1 + mag) as l, coalesce(lag(ln(1 + mag)) over (partition by match_id, k order by st), 1e9) as p from ck_dft) group by 1, 2
"""
SHARED["ck_fz"] = """
select *, (onset - baseline) / scale as z from (select *, greatest(14826e-4 * median(abs(onset - baseline)) over (partition by match_id), 1e-6) as scale from (select *, median(onset) over (partition by match_id) as baseline from ck_flux))
"""
SHARED["ck_fpk"] = """
select z.*, a.peak_sample, a.peak from (select *, lag(z) over w as pz, lead(z) over w as nz from ck_fz window w as (partition by match_id order by st)) z join ck_amp a on a.match_id = z.match_id and a.st = z.st
where pz is not null and z >= 2 and z >= pz and (nz is null or z > nz)
"""
SHARED["ck_fkept"] = """
select match_id, unnest(kept) as k from (select match_id, list_reduce(list([{'st': st, 'p': peak_sample}] order by z desc, peak_sample),
 lambda acc, x: case when len(list_filter(acc, lambda a: abs(a.p - x[1].p) < 80)) > 0 then acc else list_concat(acc, x) end) as kept from ck_fpk group by 1)
"""


@query(
    "f17_audio_analysis",
    """select p.match_id, p.st as start, p.peak_sample, p.onset, p.z, least(1e0, 85e-2 * (5e-1 + 5e-1 * (1 - exp(-(z - 2) / 2))) + 15e-2 * least(1e0, peak * 4)) as confidence, p.peak_sample / 1000e0 as analysis_s
    from ck_fpk p join ck_fkept k on k.match_id = p.match_id and k.k.st = p.st""",
    "onset z confidence analysis_s",
)
def f17_all(t):
    s = C.AudioSettings(strength=2.0, low_hz=100.0, high_hz=300.0)
    return A.analyse(sample_blocks(t), 100, 1000, s).select("match_id", "start", "peak_sample", "onset", "z", "confidence", "analysis_s")
