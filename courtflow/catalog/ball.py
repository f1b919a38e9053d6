"""Queries over the ball timeline and rallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.catalog.base import SHARED, query
from courtflow.fixtures import num
from courtflow.operators import ball as B
from courtflow.operators import rallies as R

V = C.Video()
D = num(V.diagonal)
CORNERS = [(400.0, 950.0), (1520.0, 950.0), (1200.0, 350.0), (720.0, 350.0)]


def in_quad_sql(x: str, y: str) -> str:
    signs = [
        f"(({bx - ax!r}e0) * ({y} - {num(ay)}) - ({by - ay!r}e0) * ({x} - {num(ax)}))"
        for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:] + CORNERS[:1])
    ]
    return "((" + " and ".join(f"{s} >= 0" for s in signs) + ") or (" + " and ".join(f"{s} <= 0" for s in signs) + "))"


@query(
    "e7_ball_relevance",
    f"""select match_id, frame, case when {in_quad_sql('x_px', 'y_px')} then 1e0 when dx > 230.4e0 or dy > m then 0e0
      else greatest(45e-2, 75e-2 - 3e-1 * greatest(dx / 230.4e0, greatest(0e0, dy) / m)) end as relevance
    from (select *, greatest(400e0 - x_px, 0e0, x_px - 1520e0) as dx, case when y_px < 350 then 350e0 - y_px else y_px - 950e0 end as dy,
            case when y_px < 350 then 540e0 else 64.8e0 end as m from fx_ball where x_px is not null)""",
    "relevance",
)
def e7(t):
    rel = B.relevance("x_px", "y_px", CORNERS, V)
    return t.ball.filter("x_px is not null").select("match_id", "frame", rel.alias("relevance"))


@query(
    "w13_temporal_support",
    f"""select match_id, frame, detection_id, (cast(bool_or(coalesce(hit and d < 0, false)) as int) + cast(bool_or(coalesce(hit and d > 0, false)) as int)) / 2 as support
    from (select a.match_id, a.frame, a.detection_id, b.frame - a.frame as d,
      sqrt(power(a.x_px - b.x_px, 2) + power(a.y_px - b.y_px, 2)) <= {D} * (12e-3 + 3e0 * (abs(b.frame - a.frame) / 30e0)) as hit
      from fx_candidates a left join fx_candidates b on a.match_id = b.match_id and b.frame between a.frame - 6 and a.frame + 6 and b.frame <> a.frame) group by 1, 2, 3""",
    "support",
)
def w13(t):
    return B.temporal_support(t.candidates, V).select("match_id", "frame", "detection_id", "support")


SHARED["ck_sup"] = """
select c.*, s.support from fx_candidates c join (
select match_id, frame, detection_id, (cast(bool_or(coalesce(hit and d < 0, false)) as int) + cast(bool_or(coalesce(hit and d > 0, false)) as int)) / 2 as support
    from (select a.match_id, a.frame, a.detection_id, b.frame - a.frame as d,
      sqrt(power(a.x_px - b.x_px, 2) + power(a.y_px - b.y_px, 2)) <= DIAG * (12e-3 + 3e0 * (abs(b.frame - a.frame) / 30e0)) as hit
      from fx_candidates a left join fx_candidates b on a.match_id = b.match_id and b.frame between a.frame - 6 and a.frame + 6 and b.frame <> a.frame) group by 1, 2, 3) s
  on c.match_id = s.match_id and c.frame = s.frame and c.detection_id = s.detection_id
""".replace("DIAG", D)


def _h(dx: str, dy: str) -> str:
    return f"sqrt(({dx}) * ({dx}) + ({dy}) * ({dy}))"


# Walk over the frames that hold candidates. The last element carries the running segment:
# l and q are its last two points, seg the frame in which it starts.
_PT = "struct(f bigint, t double, x double, y double)"
_NO = f"'sel': cast(null as bigint), 'sc': cast(null as double), 'seg': cast(null as bigint), 'l': cast(null as {_PT}), 'q': cast(null as {_PT})"
_STATE = "case when x[1].f - acc[len(acc)].l.f > 7 then {'seg': cast(null as bigint), 'l': cast(null as PT), 'q': cast(null as PT)} else {'seg': acc[len(acc)].seg, 'l': acc[len(acc)].l, 'q': acc[len(acc)].q} end".replace("PT", _PT)
_L1 = "list_transform(x[1].c, lambda k: {'k': k, 'dt': k.t - s.l.t, 'vx': case when s.q.t < s.l.t then (s.l.x - s.q.x) / (s.l.t - s.q.t) end, 'vy': case when s.q.t < s.l.t then (s.l.y - s.q.y) / (s.l.t - s.q.t) end})"
_L2 = (
    f"list_transform({_L1}, lambda m: {{'k': m.k, 'sp': {_h('m.k.x - s.l.x', 'm.k.y - s.l.y')} / (m.dt * {D}), "
    f"'turn': coalesce({_h('(m.k.x - s.l.x) / m.dt - m.vx', '(m.k.y - s.l.y) / m.dt - m.vy')} / (m.dt * {D}), 0e0), "
    f"'miss': {_h('m.k.x - (s.l.x + coalesce(m.vx, 0e0) * m.dt)', 'm.k.y - (s.l.y + coalesce(m.vy, 0e0) * m.dt)')}, 'gate': {D} * (12e-3 + 3e0 * m.dt)}})"
)
_L3 = f"list_filter({_L2}, lambda m: m.sp <= 3 and m.turn <= 80 and m.miss <= m.gate)"
_L4 = f"list_transform({_L3}, lambda m: {{'n': -(42e-2 * (1 - m.miss / m.gate) + 18e-2 * (1 - m.turn / 80) + 18e-2 * m.k.rel + 12e-2 * m.k.conf + 1e-1 * m.k.sup), 'c': -m.k.conf, 'i': -m.k.id, 't': m.k.t, 'x': m.k.x, 'y': m.k.y}})"
_LINK = f"list_sort(list_filter(case when s.l is null then [] else {_L4} end, lambda m: -m.n >= 32e-2))"
_START = "list_sort(list_filter(list_transform(x[1].c, lambda k: {'n': -(45e-2 * k.rel + 35e-2 * k.sup + 2e-1 * k.conf), 'c': -k.conf, 'i': -k.id, 't': k.t, 'x': k.x, 'y': k.y, 'r': k.rel}), lambda m: m.r > 0 and -m.n >= 4e-1))"


def _take(source: str, seg: str, q: str) -> str:
    point = f"{{'f': x[1].f, 't': {source}[1].t, 'x': {source}[1].x, 'y': {source}[1].y}}"
    return f"{{'f': x[1].f, 'c': x[1].c, 'sel': -{source}[1].i, 'sc': -{source}[1].n, 'seg': {seg}, 'l': {point}, 'q': {q}}}"


_STEP = f"""case when len(w.link) > 0 then {_take('w.link', 'w.s.seg', 'w.s.l')}
  when w.s.l is not null and x[1].f - w.s.l.f <= 6 then {{'f': x[1].f, 'c': x[1].c, 'sel': cast(null as bigint), 'sc': cast(null as double), 'seg': w.s.seg, 'l': w.s.l, 'q': w.s.q}}
  when len(w.start) > 0 then {_take('w.start', 'x[1].f', f'cast(null as {_PT})')} else {{'f': x[1].f, 'c': x[1].c, {_NO}}} end"""
SHARED["ck_cand"] = "select match_id, frame, list({'id': detection_id, 't': t_s, 'x': x_px, 'y': y_px, 'conf': confidence, 'rel': cast(relevance as double), 'sup': cast(support as double)} order by detection_id) as c from ck_sup group by 1, 2"
SHARED["ck_bwalk"] = f"""
select match_id, unnest(kept[2:]) as h from (select match_id, list_reduce(list_prepend([{{'f': cast(-100 as bigint), 'c': any_value(c)[1:0], {_NO}}}], list([{{'f': frame, 'c': c, {_NO}}}] order by frame)),
  lambda acc, x: list_concat(acc, list_transform(list_transform([{_STATE}], lambda s: {{'s': s, 'link': {_LINK}, 'start': {_START}}}), lambda w: {_STEP}))) as kept from ck_cand group by 1)
"""
SHARED["ck_pick"] = "select * from (select match_id, h.f as frame, h.sel as detection_id, h.sc as link_confidence, h.seg as segment_id, count(*) over (partition by match_id, h.seg) as n from ck_bwalk where h.sel is not null) where n >= 2"


@query("f8_ball_association", "select match_id, frame, detection_id, link_confidence, segment_id from ck_pick", "link_confidence")
def f8(t):
    return B.associate(B.temporal_support(t.candidates, V), V)


@query("f9_ball_reconstruction", "select * from ck_final9", "t_s x_px y_px detection_confidence relevance support confidence sx_px sy_px")
def f9(t):
    matches = t.ball.groupBy("match_id").agg((F.max("frame") + 1).alias("frame_count"))
    out = B.reconstruct(t.candidates, matches, V)
    return out.withColumn("rejected", F.size("rejected_ids").cast("bigint")).drop("rejected_ids")


OBS = "select match_id, frame, case when status = 'OBSERVED' then 'OBSERVED' else 'UNKNOWN' end as status, case when status = 'OBSERVED' then segment_id end as segment_id, case when status = 'OBSERVED' then x_px end as x_px, case when status = 'OBSERVED' then y_px end as y_px, case when status = 'OBSERVED' then confidence end as confidence from fx_ball"
SHARED["ck_obs"] = OBS
SHARED["ck_fill"] = """
select o.match_id, o.frame, o.status, o.segment_id, o.x_px, o.y_px, o.confidence, p.frame as pf, n.frame as nf, p.segment_id as seg,
  p.x_px as px, n.x_px as nx, p.y_px as py, n.y_px as ny, p.confidence as pc, n.confidence as nc,
  o.status <> 'OBSERVED' and p.segment_id = n.segment_id and n.frame - p.frame - 1 <= 3 as fill
from ck_obs o
left join ck_obs p on p.match_id = o.match_id and p.frame = (select max(q.frame) from ck_obs q where q.match_id = o.match_id and q.status = 'OBSERVED' and q.frame between o.frame - 3 and o.frame - 1)
left join ck_obs n on n.match_id = o.match_id and n.frame = (select min(q.frame) from ck_obs q where q.match_id = o.match_id and q.status = 'OBSERVED' and q.frame between o.frame + 1 and o.frame + 3)
"""


@query(
    "w11_gap_interpolation",
    """select match_id, frame, case when fill then 'INTERPOLATED' else status end as status, case when fill then seg else segment_id end as segment_id,
    case when fill then px + (frame - pf) / (nf - pf) * (nx - px) else x_px end as x_px, case when fill then py + (frame - pf) / (nf - pf) * (ny - py) else y_px end as y_px,
    case when fill then least(pc, nc) * power(85e-2, nf - pf - 1) else confidence end as confidence from ck_fill""",
    "x_px y_px confidence",
)
def w11(t):
    seen = F.col("status") == "OBSERVED"
    track = t.ball.select("match_id", "frame", F.when(seen, "OBSERVED").otherwise("UNKNOWN").alias("status"),
                          *[F.when(seen, F.col(c)).alias(c) for c in ("segment_id", "x_px", "y_px", "confidence")])
    return B.fill_gaps(track, V)


SHARED["ck_bsm"] = """
select a.match_id, a.frame, any_value(a.x_px) as x, any_value(a.y_px) as y, sum(b.x_px * greatest(b.confidence, 5e-2)) / sum(greatest(b.confidence, 5e-2)) as mx,
  sum(b.y_px * greatest(b.confidence, 5e-2)) / sum(greatest(b.confidence, 5e-2)) as my
from (select *, lag(status) over w as m1, lead(status) over w as p1 from fx_ball window w as (partition by match_id order by frame)) a
join fx_ball b on a.match_id = b.match_id and a.status <> 'UNKNOWN' and b.status <> 'UNKNOWN' and a.segment_id = b.segment_id
  and (abs(a.frame - b.frame) <= 1 or (b.frame = a.frame - 2 and a.m1 <> 'UNKNOWN') or (b.frame = a.frame + 2 and a.p1 <> 'UNKNOWN'))
group by 1, 2
"""


@query(
    "w12_ball_smoothing",
    f"""select b.match_id, b.frame, case when d > lim then x + (mx - x) * lim / d else mx end as sx_px, case when d > lim then y + (my - y) * lim / d else my end as sy_px
    from fx_ball b left join (select *, sqrt(power(mx - x, 2) + power(my - y, 2)) as d, {D} * 15e-3 as lim from ck_bsm) s on b.match_id = s.match_id and b.frame = s.frame""",
    "sx_px sy_px",
)
def w12(t):
    return B.smooth(t.ball, V).select("match_id", "frame", "sx_px", "sy_px")


SHARED["ck_obs9"] = """
select b.match_id, b.frame, case when p.frame is null then 'UNKNOWN' else 'OBSERVED' end as status, p.seg_no as segment_id, s.x_px, s.y_px, p.link_confidence as confidence, p.detection_id, s.confidence as detection_confidence, s.relevance, s.support
from fx_ball b left join (select *, dense_rank() over (partition by match_id order by segment_id) as seg_no from ck_pick) p on p.match_id = b.match_id and p.frame = b.frame
left join ck_sup s on s.match_id = p.match_id and s.frame = p.frame and s.detection_id = p.detection_id
"""
SHARED["ck_fill9"] = SHARED["ck_fill"].replace("ck_obs", "ck_obs9")
SHARED["ck_tr9"] = """
select match_id, frame, case when fill then 'INTERPOLATED' else status end as status, case when fill then seg else segment_id end as segment_id, case when fill then px + (frame - pf) / (nf - pf) * (nx - px) else x_px end as x_px,
  case when fill then py + (frame - pf) / (nf - pf) * (ny - py) else y_px end as y_px, case when fill then least(pc, nc) * power(85e-2, nf - pf - 1) else confidence end as confidence from ck_fill9
"""
SHARED["ck_bsm9"] = SHARED["ck_bsm"].replace("fx_ball", "ck_tr9")
SHARED["ck_final9"] = f"""
select k.match_id, k.frame, k.frame / 30e0 as t_s, o.detection_id, k.x_px, k.y_px, o.detection_confidence, o.relevance, o.support, k.confidence, k.segment_id, k.status, coalesce(c.n, 0) as candidate_count,
  case when d > lim then x + (mx - x) * lim / d else mx end as sx_px, case when d > lim then y + (my - y) * lim / d else my end as sy_px, coalesce(c.n, 0) - cast(o.detection_id is not null as bigint) as rejected
from ck_tr9 k join ck_obs9 o on o.match_id = k.match_id and o.frame = k.frame left join (select match_id, frame, count(*) as n from fx_candidates group by 1, 2) c on c.match_id = k.match_id and c.frame = k.frame
left join (select *, sqrt(power(mx - x, 2) + power(my - y, 2)) as d, {D} * 15e-3 as lim from ck_bsm9) m on m.match_id = k.match_id and m.frame = k.frame
"""
SHARED["ck_lost"] = """
select match_id, min(frame) as start_frame, max(frame) as end_frame, count(*) as missing_frames from
(select *, frame - row_number() over (partition by match_id order by frame) as g from fx_ball where status = 'UNKNOWN') group by match_id, g
"""
SHARED["ck_longest"] = "select * exclude rn from (select *, row_number() over (partition by match_id order by missing_frames desc, start_frame) as rn from ck_lost) where rn = 1"


@query("w4_longest_missing", "select * from ck_longest")
def w4(t):
    return B.longest_missing(t.ball)


@query(
    "a14_trajectory_coverage",
    """select c.*, l.start_frame, l.end_frame, coalesce(l.missing_frames, 0) as missing_frames, coalesce(l.missing_frames, 0) / 30e0 as missing_s from
    (select match_id, count(*) as frames, count(*) filter (where status = 'OBSERVED') as observed, count(*) filter (where status = 'INTERPOLATED') as interpolated,
      count(*) filter (where status = 'UNKNOWN') as unknown, count(*) filter (where status <> 'UNKNOWN') / count(*) as coverage,
      count(*) filter (where status = 'OBSERVED') / count(*) as observed_coverage,
      count(*) filter (where status = 'INTERPOLATED') / count(*) filter (where status <> 'UNKNOWN') as interpolated_fraction,
      count(distinct segment_id) as segments from fx_ball group by 1) c left join ck_longest l on c.match_id = l.match_id""",
    "coverage observed_coverage interpolated_fraction missing_s",
)
def a14(t):
    return B.coverage(t.ball, V.fps)


SHARED["ck_speed"] = f"""
select b.match_id, b.frame, b.status, b.segment_id, b.x_px, b.y_px, s.speed, coalesce(s.speed >= 1e-1, false) as moving, b.x_px is not null as known
from fx_ball b left join (select match_id, frame, case when segment_id = lag(segment_id) over w and (frame - lag(frame) over w) / 30e0 <= 2e-1
   then sqrt(power(x_px - lag(x_px) over w, 2) + power(y_px - lag(y_px) over w, 2)) / ({D} * ((frame - lag(frame) over w) / 30e0)) end as speed
  from fx_ball where x_px is not null window w as (partition by match_id order by frame)) s on b.match_id = s.match_id and b.frame = s.frame
"""


@query("w5_ball_speed", "select match_id, frame, speed from ck_speed where speed is not null", "speed")
def w5(t):
    return R.ball_speed(t.ball, V).filter("speed is not null").select("match_id", "frame", "speed")


SHARED["ck_kin0"] = """
select *, avg(cast(moving as int)) over (partition by match_id order by frame rows between 4 preceding and 4 following) as support_fraction,
  coalesce(quantile_cont(coalesce(speed, 0), 5e-1) over (partition by match_id order by frame rows between 12 preceding and 1 preceding), 0) as baseline,
  avg(cast(known as int)) over f as known_fraction, avg(cast(moving as int)) over f as motion_fraction,
  max(case when not moving then frame end) over b as still, max(case when not known then frame end) over b as blank, greatest(0, frame - 12) as early
from ck_speed window f as (partition by match_id order by frame rows between current row and 36 following), b as (partition by match_id order by frame rows between 12 preceding and 1 preceding)
"""
SHARED["ck_gate"] = """
select * from (select *, speed / greatest(baseline, 5e-2) as surge from ck_kin0) where speed >= 18e-2 and (surge >= 16e-1 or speed - baseline >= 1e-1)
  and known_fraction >= 3e-1 and motion_fraction >= 2e-1
"""
SHARED["ck_onset"] = f"""
select g.*, displacement, case when greatest(early, coalesce(still + 1, early)) < g.frame then greatest(early, coalesce(still + 1, early))
    else greatest(early, coalesce(blank + 1, early)) end as refined_start
from ck_gate g join (select g.match_id, g.frame, max(sqrt(power(a.x_px - b.x_px, 2) + power(a.y_px - b.y_px, 2))) / {D} as displacement
  from ck_gate g join ck_speed a on a.match_id = g.match_id and a.known and a.frame between g.frame and g.frame + 36
  join ck_speed b on b.match_id = g.match_id and b.known and b.frame between g.frame and g.frame + 36 group by 1, 2) d
 on g.match_id = d.match_id and g.frame = d.frame where displacement >= 6e-2
"""


@query("w6_motion_support", "select match_id, frame, moving, support_fraction, support_fraction >= 25e-2 as supported from ck_kin0", "support_fraction")
def w6(t):
    return R.motion_support(R.ball_speed(t.ball, V), V).select("match_id", "frame", "moving", "support_fraction", "supported")


@query("w7_serve_onsets", "select match_id, frame, speed, baseline, surge, known_fraction, motion_fraction, displacement from ck_onset", "speed baseline surge known_fraction motion_fraction displacement")
def w7(t):
    return R.kinematics(t.ball, V).filter("onset").select("match_id", "frame", "speed", "baseline", "surge", "known_fraction", "motion_fraction", "displacement")


@query("w8_refined_starts", "select match_id, frame, refined_start from ck_onset")
def w8(t):
    return R.kinematics(t.ball, V).filter("onset").select("match_id", "frame", "refined_start")


SHARED["ck_quiet"] = """
select match_id, frame from (select match_id, frame, sum(cast(support_fraction >= 25e-2 as int)) over w as s, count(*) over w as n from ck_kin0
  window w as (partition by match_id order by frame rows between current row and 26 following)) where s = 0 and n = 27
"""
SHARED["ck_rest"] = """
select match_id, frame from (select match_id, frame, sum(cast(moving as int)) over w as s, count(*) over w as n from ck_kin0
  window w as (partition by match_id order by frame rows between current row and 14 following)) where s = 0 and n = 15
"""
SHARED["ck_nat0"] = """
select o.match_id, o.frame, o.refined_start as st, l.n - 1 as lastf, least(l.n - 1, o.refined_start + 1350) as fin,
  (select min(q.frame) from ck_quiet q where q.match_id = o.match_id and q.frame >= least(l.n - 1, o.refined_start + 22)) as q,
  (select min(q.frame) from ck_rest q where q.match_id = o.match_id and q.frame >= o.refined_start) as rs
from ck_onset o join (select match_id, count(*) as n from fx_ball group by 1) l on l.match_id = o.match_id
"""


def _settle(start: str, still: str) -> str:
    lm = f"(select max(m.frame) from ck_speed m where m.match_id = z.match_id and m.moving and m.frame between {start} and {still})"
    kn = f"(select max(m.frame) from ck_speed m where m.match_id = z.match_id and m.known and m.frame <= least({still}, {lm} + 8))"
    return f"case when {lm} is null then {start} else {kn} end"


SHARED["ck_nat"] = f"select z.*, case when z.q <= z.fin then {_settle('z.st', 'z.q')} else z.fin end as nat from ck_nat0 z"
SHARED["ck_again"] = """
select z.*, (select min(o.frame) from ck_onset o where o.match_id = z.match_id and o.frame > z.frame and o.frame <= z.nat
   and o.refined_start >= greatest(z.st + 75, z.rs + 15)) as again from ck_nat z
"""
SHARED["ck_again2"] = "select a.*, o.refined_start as ar from ck_again a left join ck_onset o on o.match_id = a.match_id and o.frame = a.again"
SHARED["ck_jump"] = f"""
select match_id, frame, st as start_frame, e as end_frame, case when again is not null then again else greatest(frame + 1, e + 30) end as cursor, e - st + 1 >= 22 as long_enough
from (select z.*, case when z.again is not null then {_settle('z.st', 'greatest(z.st, z.ar - 15)')} else z.nat end as e from ck_again2 z)
"""
SHARED["ck_walk"] = """
select match_id, unnest(kept) as k from (select match_id, list_reduce(list([{'frame': frame, 's': start_frame, 'e': end_frame, 'cursor': cursor, 'ok': long_enough}] order by frame),
  lambda acc, x: case when x[1].frame >= acc[len(acc)].cursor then list_concat(acc, x) else acc end) as kept from ck_jump group by 1)
"""
SHARED["ck_rally"] = "select match_id, k.frame as onset_frame, k.s as start_frame, k.e as end_frame, row_number() over (partition by match_id order by k.frame) as candidate_no from ck_walk where k.ok"


@query("f10_onset_jumps", "select match_id, frame, start_frame, end_frame, cursor, long_enough from ck_jump")
def f10_jumps(t):
    return R.onset_jumps(R.kinematics(t.ball, V), V)


@query("f10_rally_cursor", "select match_id, onset_frame, start_frame, end_frame, candidate_no from ck_rally")
def f10(t):
    return R.candidate_rallies(R.kinematics(t.ball, V), V)


SHARED["ck_evid"] = """
select r.*, observed, interpolated, unknown, s.known_fraction, s.motion_fraction, sustained_fraction, max_speed, frames,
  (start_frame - coalesce((select max(q.frame) from ck_kin0 q where q.match_id = r.match_id and q.known and q.frame < r.start_frame), -1) - 1) / 30e0 as preceding_unknown_s,
  (coalesce((select min(q.frame) from ck_kin0 q where q.match_id = r.match_id and q.known and q.frame > r.end_frame), (select max(frame) + 1 from fx_ball b where b.match_id = r.match_id)) - end_frame - 1) / 30e0 as following_unknown_s,
  case when pe is not null then greatest(0e0, (start_frame - pe - 1) / 30e0) end as since_previous_s,
  least(99e-2, 25e-2 + 3e-1 * (least(1e0, o.surge / 32e-1) + least(1e0, o.displacement / 12e-2) + least(1e0, o.motion_fraction / 4e-1)) / 3
     + 25e-2 * least(1e0, s.motion_fraction / 45e-2) + 15e-2 * least(1e0, s.known_fraction / 7e-1)) as confidence,
  35e-2 * s.motion_fraction + 25e-2 * s.known_fraction + 2e-1 * sustained_fraction + 2e-1 * least(1e0, frames / 30e0 / 4e0) as quality
from (select *, lag(end_frame) over (partition by match_id order by start_frame) as pe from ck_rally) r
join (select r.match_id, r.candidate_no, count(*) filter (where status = 'OBSERVED') as observed, count(*) filter (where status = 'INTERPOLATED') as interpolated,
   count(*) filter (where status = 'UNKNOWN') as unknown, count(*) filter (where known) / count(*) as known_fraction, avg(cast(moving as int)) as motion_fraction,
   avg(cast(support_fraction >= 25e-2 as int)) as sustained_fraction, max(case when speed <> 0 then speed end) as max_speed, count(*) as frames
  from ck_rally r join ck_kin0 k on k.match_id = r.match_id and k.frame between r.start_frame and r.end_frame group by 1, 2) s
  on s.match_id = r.match_id and s.candidate_no = r.candidate_no
join ck_onset o on o.match_id = r.match_id and o.frame = r.onset_frame
"""


@query("a18_rally_evidence", "select * exclude pe from ck_evid", "known_fraction motion_fraction sustained_fraction max_speed preceding_unknown_s following_unknown_s since_previous_s confidence quality")
def a18(t):
    from courtflow.session import cut_lineage

    kin = cut_lineage(R.kinematics(t.ball, V))
    return R.interval_support(kin, R.candidate_rallies(kin, V), V).drop("segments")


SHARED["ck_burst"] = """
select match_id, unnest(kept) as k from (select match_id, list_reduce(list([{'no': candidate_no, 's': start_frame, 'e': end_frame, 'q': quality}] order by quality desc, end_frame - start_frame desc, confidence desc, candidate_no),
  lambda acc, x: case when len(list_filter(acc, lambda a: (case when x[1].s >= a.s then x[1].s - a.e - 1 else a.s - x[1].e - 1 end) <= 675e-1 and a.q - x[1].q >= 5e-2)) > 0 then acc else list_concat(acc, x) end) as kept
 from fx_bursts group by 1)
"""


@query(
    "f5_adjacent_bursts",
    """select b.match_id, b.candidate_no, k.k is not null as accepted, s.no as stronger_no, s.gap_s, s.q - b.quality as margin from fx_bursts b
    left join ck_burst k on k.match_id = b.match_id and k.k.no = b.candidate_no
    left join (select b.match_id, b.candidate_no, k.k.no as no, k.k.q as q,
         greatest(0e0, (case when b.start_frame >= k.k.s then b.start_frame - k.k.e - 1 else k.k.s - b.end_frame - 1 end) / 30e0) as gap_s,
         row_number() over (partition by b.match_id, b.candidate_no order by k.k.q desc) as rn
       from fx_bursts b join ck_burst k on k.match_id = b.match_id and k.k.no <> b.candidate_no and k.k.q - b.quality >= 5e-2
         and (case when b.start_frame >= k.k.s then b.start_frame - k.k.e - 1 else k.k.s - b.end_frame - 1 end) <= 675e-1) s
      on s.match_id = b.match_id and s.candidate_no = b.candidate_no and s.rn = 1""",
    "gap_s margin",
)
def f5(t):
    return R.resolve_bursts(t.bursts, V).select("match_id", "candidate_no", "accepted", "stronger_no", "gap_s", "margin")


SHARED["ck_evid2"] = """
select e.* exclude (confidence, pe), r.reset_score, coalesce(u.hit, false) as audio_support, least(99e-2, e.confidence + coalesce(3e-2 * r.reset_score, 0) + case when u.hit then 2e-2 else 0 end) as confidence
from ck_evid e left join (select match_id, frame, case when roles >= 3 then slow / roles end as reset_score from ck_reset) r on r.match_id = e.match_id and r.frame = e.start_frame
left join (select distinct e.match_id, e.candidate_no, true as hit from ck_evid e join fx_audio a on a.match_id = e.match_id and (abs(a.video_s - e.start_frame / 30e0) <= 12e-2 or abs(a.video_s - e.end_frame / 30e0) <= 12e-2)) u
  on u.match_id = e.match_id and u.candidate_no = e.candidate_no
"""
SHARED["ck_burst2"] = SHARED["ck_burst"].replace("fx_bursts", "ck_evid2")


@query(
    "f10_segmented_rallies",
    """select b.*, k.k is not null as accepted, s.no as stronger_no, s.gap_s, s.q - b.quality as margin from ck_evid2 b left join ck_burst2 k on k.match_id = b.match_id and k.k.no = b.candidate_no
    left join (select b.match_id, b.candidate_no, k.k.no as no, k.k.q as q, greatest(0e0, (case when b.start_frame >= k.k.s then b.start_frame - k.k.e - 1 else k.k.s - b.end_frame - 1 end) / 30e0) as gap_s,
         row_number() over (partition by b.match_id, b.candidate_no order by k.k.q desc) as rn from ck_evid2 b join ck_burst2 k on k.match_id = b.match_id and k.k.no <> b.candidate_no and k.k.q - b.quality >= 5e-2
         and (case when b.start_frame >= k.k.s then b.start_frame - k.k.e - 1 else k.k.s - b.end_frame - 1 end) <= 675e-1) s on s.match_id = b.match_id and s.candidate_no = b.candidate_no and s.rn = 1 and k.k is null""",
    "known_fraction motion_fraction sustained_fraction max_speed preceding_unknown_s following_unknown_s since_previous_s confidence quality reset_score gap_s margin",
)
def f10_all(t):
    reset = R.player_reset(t.raw_positions, V.fps)
    out = R.segment_rallies(t.ball, V, reset=reset, audio=t.audio)
    return out.drop("segments")


SHARED["ck_reset"] = """
select match_id, frame, count(med) as roles, count(*) filter (where med <= 125e-2) as slow from (
 select *, quantile_cont(v, 5e-1) over (partition by match_id, role order by frame rows between 30 preceding and current row) as med from (
  select p.match_id, p.role, p.frame, s.v from fx_raw_positions p left join (
   select match_id, role, frame, case when frame - lag(frame) over w <= 2 then sqrt(power(x_m - lag(x_m) over w, 2) + power(y_m - lag(y_m) over w, 2)) / ((frame - lag(frame) over w) / 30e0) end as v
   from fx_raw_positions where x_m is not null window w as (partition by match_id, role order by frame)) s on s.match_id = p.match_id and s.role = p.role and s.frame = p.frame)) group by 1, 2
"""


@query("w14_player_reset", "select *, case when roles >= 3 then slow / roles end as reset_score from ck_reset", "reset_score")
def w14(t):
    return R.player_reset(t.raw_positions, V.fps)


SHARED["ck_marks"] = """
select *, lag(type) over w as pt, lag(frame) over w as pf, lag(event_id) over w as pe, lead(type) over w as nt from fx_annotations where type like 'RALLY%' window w as (partition by match_id order by event_id)
"""


@query("w16_rally_pairs", "select match_id, pe as start_event, event_id as end_event, pf as start_frame, frame as end_frame from ck_marks where type = 'RALLY_END' and pt = 'RALLY_START' and frame >= pf")
def w16(t):
    return R.paired_rallies(t.annotations)[0]


@query(
    "w16_alternation_errors",
    """select match_id, event_id, case when type = 'RALLY_START' then 'start_before_end' when coalesce(pt, '') <> 'RALLY_START' then 'end_without_start' else 'end_precedes_start' end as reason
    from ck_marks where (type = 'RALLY_START' and pt = 'RALLY_START') or (type = 'RALLY_END' and (coalesce(pt, '') <> 'RALLY_START' or frame < pf))
    union all select match_id, event_id, 'start_without_end' from ck_marks where type = 'RALLY_START' and nt is null""",
)
def w16e(t):
    return R.paired_rallies(t.annotations)[1]
