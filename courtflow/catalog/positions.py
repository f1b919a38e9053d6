"""Queries over player positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.catalog.base import SHARED, query
from courtflow.fixtures import num
from courtflow.functions import geometry as G
from courtflow.operators import positions as P

NEAR, FAR = num(C.NEAR_KITCHEN_Y_M), num(C.FAR_KITCHEN_Y_M)
NET, LEN, WID, DEP = num(C.NET_Y_M), num(C.COURT_LENGTH_M), num(C.COURT_WIDTH_M), num(C.NVZ_DEPTH_M)


def zone_sql(y: str) -> str:
    return (
        f"case when {y} between {NEAR} and {FAR} then 'kitchen' when {y} between {NEAR} - {DEP} and {NEAR} "
        f"or {y} between {FAR} and {FAR} + {DEP} then 'transitionZone' when {y} is not null then 'backcourt' end"
    )


def setback_sql(y: str) -> str:
    return f"case when {y} <= {NET} then greatest(0e0, {NEAR} - {y}) else greatest(0e0, {y} - {FAR}) end"


IN = f"x_m between 0 and {WID} and y_m between 0 and {LEN}"
SHARED["ck_ok"] = "select * from fx_raw_positions where x_m is not null and region in ('inside', 'near')"
SHARED["ck_steps"] = """
select *, case when pf is null then null when frame - pf <> 1 or dt <= 0 or dt > 2e-1 then 'gap'
  when d / dt > 8e0 then 'speed' else 'accepted' end as outcome
from (select *, frame as f2, lag(frame) over w as pf, t_s - lag(t_s) over w as dt, x_m - lag(x_m) over w as dx,
        sqrt(power(x_m - lag(x_m) over w, 2) + power(y_m - lag(y_m) over w, 2)) as d
      from ck_ok window w as (partition by match_id, role order by frame))
"""
SHARED["ck_elig"] = """
select *, x_m is not null and state <> 'suspected_identity_switch' and confidence >= 45e-2 as el from fx_raw_positions
"""
SHARED["ck_near"] = """
select a.match_id, a.role, a.frame, a.x_m as ax, a.y_m as ay, b.frame as bf, b.x_m as x, b.y_m as y, greatest(b.confidence, 1e-6) as w
from (select *, lag(el) over w as m1, lead(el) over w as p1 from ck_elig window w as (partition by match_id, role order by frame)) a
join ck_elig b on a.match_id = b.match_id and a.role = b.role and a.el and b.el
  and (abs(a.frame - b.frame) <= 1 or (b.frame = a.frame - 2 and a.m1) or (b.frame = a.frame + 2 and a.p1))
"""
SHARED["ck_med"] = """
select match_id, role, frame, any_value(ax) as ax, any_value(ay) as ay, count(*) as support,
  min(case when cx >= tot / 2 then x end) as mx, min(case when cy >= tot / 2 then y end) as my
from (select *, sum(w) over (partition by match_id, role, frame order by x, bf rows unbounded preceding) as cx,
        sum(w) over (partition by match_id, role, frame order by y, bf rows unbounded preceding) as cy,
        sum(w) over (partition by match_id, role, frame) as tot from ck_near)
group by match_id, role, frame
"""
SHARED["ck_smooth"] = """
select e.match_id, e.role, e.frame, e.t_s, e.region, e.x_m as raw_x_m,
  case when x_m is null then 'missing_raw_court_coordinate' when state = 'suspected_identity_switch' then state
    when confidence < 45e-2 then 'below_confidence_threshold' else 'smoothed' end as status,
  case when d > 3e-1 then ax + (mx - ax) * 3e-1 / d else mx end as x_m,
  case when d > 3e-1 then ay + (my - ay) * 3e-1 / d else my end as y_m, support
from ck_elig e left join (select *, sqrt(power(mx - ax, 2) + power(my - ay, 2)) as d from ck_med) m
  on e.match_id = m.match_id and e.role = m.role and e.frame = m.frame
"""


@query("e11_zone", f"select match_id, role, frame, {zone_sql('y_m')} as zone from fx_raw_positions")
def e11(t):
    return t.raw_positions.select("match_id", "role", "frame", G.zone("y_m").alias("zone"))


@query("e12_kitchen_setback", f"select match_id, role, frame, {setback_sql('y_m')} as setback_m from fx_raw_positions where y_m is not null", "setback_m")
def e12(t):
    return t.raw_positions.filter("y_m is not null").select("match_id", "role", "frame", G.kitchen_setback("y_m").alias("setback_m"))


@query(
    "p1_metric_populations",
    f"select match_id, role, count(*) filter (where x_m is not null and region in ('inside','near')) as eligible, "
    f"count(*) filter (where x_m is not null and region in ('inside','near') and {IN}) as in_court from fx_raw_positions group by 1, 2",
)
def p1(t):
    return t.raw_positions.groupBy("match_id", "role").agg(
        F.count_if(P.metric_eligible()).alias("eligible"), F.count_if(P.in_court_eligible()).alias("in_court")
    )


@query("p2_smoothing_status", "select status, count(*) as n from ck_smooth group by 1")
def p2(t):
    return t.raw_positions.groupBy(P.smoothing_status().alias("status")).agg(F.count("*").alias("n"))


OFFSETS = [("ME", 0.1, -0.2), ("OPPONENT_2", -0.05, 0.15)]


@query(
    "p3_manual_offset",
    "select match_id, role, frame, x_m, y_m, x_m + case role when 'ME' then 1e-1 when 'OPPONENT_2' then -5e-2 else 0 end as cx_m, "
    "y_m + case role when 'ME' then -2e-1 when 'OPPONENT_2' then 15e-2 else 0 end as cy_m from fx_raw_positions",
    "x_m y_m cx_m cy_m",
)
def p3(t):
    rows = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(x).alias("dx_m"), F.lit(y).alias("dy_m")) for r, x, y in OFFSETS])
    offsets = t.raw_positions.select("match_id").distinct().select("match_id", F.inline(rows))
    return P.apply_offsets(t.raw_positions, offsets).select("match_id", "role", "frame", "x_m", "y_m", "cx_m", "cy_m")


@query(
    "w1_smoothed_positions",
    "select match_id, role, frame, status, x_m as sx_m, y_m as sy_m, coalesce(support, 0) as support from ck_smooth",
    "sx_m sy_m",
)
def w1(t):
    out = P.smooth(t.raw_positions)
    size = F.coalesce(F.size("support_frames"), F.lit(0))
    size = F.when(F.col("support_frames").isNull(), 0).otherwise(size).cast("bigint")
    return out.select("match_id", "role", "frame", "status", "sx_m", "sy_m", size.alias("support"))


@query(
    "w2_movement_steps",
    "select match_id, role, frame, d as step_m, outcome from ck_steps where outcome in ('accepted', 'speed')",
    "step_m",
)
def w2(t):
    return P.steps(t.raw_positions).filter("outcome is not null").select("match_id", "role", "frame", "step_m", "outcome")


@query(
    "w3_frame_ranges",
    'select match_id, role, min(frame) as "start", max(frame) as "end", count(*) as length from '
    "(select *, frame - row_number() over (partition by match_id, role order by frame) as g from ck_ok) group by match_id, role, g",
)
def w3(t):
    return P.contributing_ranges(t.raw_positions)


@query(
    "a1_distance_travelled",
    "select match_id, role, sum(d) filter (where outcome = 'accepted') as distance_m, count(*) filter (where outcome = 'accepted') as steps, "
    "count(*) filter (where outcome = 'gap') as gap_steps, count(*) filter (where outcome = 'speed') as speed_steps from ck_steps group by 1, 2",
    "distance_m",
)
def a1(t):
    return P.movement(P.steps(t.raw_positions)).select("match_id", "role", "distance_m", "steps", "gap_steps", "speed_steps")


@query(
    "a2_court_occupancy",
    f"""select c.*, frames / 30e0 as seconds, case when in_court_frames > 0 then frames / in_court_frames end as share from
    (select g.match_id, g.role, z.zone, count(k.zone) filter (where k.zone = z.zone) as frames, count(k.zone) as in_court_frames
     from (select distinct match_id, role from fx_raw_positions) g
     cross join (select unnest(['kitchen', 'transitionZone', 'backcourt']) as zone) z
     left join (select match_id, role, {zone_sql('y_m')} as zone from ck_ok where {IN}) k on g.match_id = k.match_id and g.role = k.role
     group by 1, 2, 3) c""",
    "seconds share",
)
def a2(t):
    return P.occupancy(t.raw_positions, 30.0)


@query(
    "a3_kitchen_distance",
    f"select match_id, role, avg({setback_sql('y_m')}) filter (where ok) as kitchen_distance_m, count(*) filter (where ok) as samples "
    f"from (select *, x_m is not null and region in ('inside','near') and {IN} as ok from fx_raw_positions) group by 1, 2",
    "kitchen_distance_m",
)
def a3(t):
    return P.kitchen_distance(t.raw_positions)


JOINT = """
select a.match_id, case a.role when 'ME' then 'nearTeam' else 'farTeam' end as team, a.frame, a.x_m as ax, a.y_m as ay, b.x_m as bx, b.y_m as by_
from ck_ok a join ck_ok b on a.match_id = b.match_id and a.frame = b.frame
 and ((a.role = 'ME' and b.role = 'PARTNER') or (a.role = 'OPPONENT_1' and b.role = 'OPPONENT_2'))
"""
SHARED["ck_joint"] = JOINT


@query("j1_partner_frames", "select match_id, team, frame, ax, ay, bx, by_ as b_y from ck_joint", "ax ay bx b_y")
def j1(t):
    return P.joint_frames(t.raw_positions).withColumnRenamed("by", "b_y")


@query(
    "a4_partner_spacing",
    "select g.match_id, g.team, s.spacing_m, coalesce(s.samples, 0) as samples, coalesce(s.samples, 0) / g.n as coverage from "
    "(select match_id, team, max(frame) + 1 as n from fx_raw_positions cross join (select unnest(['nearTeam', 'farTeam']) as team) group by 1, 2) g "
    "left join (select match_id, team, avg(sqrt(power(ax - bx, 2) + power(ay - by_, 2))) as spacing_m, count(*) as samples from ck_joint group by 1, 2) s "
    "on g.match_id = s.match_id and g.team = s.team",
    "spacing_m coverage",
)
def a4(t):
    return P.partner_spacing(t.raw_positions)


@query(
    "a5_lateral_movement",
    "select match_id, role, sum(abs(dx)) filter (where outcome = 'accepted') as lateral_m, "
    "sum(abs(dx)) filter (where outcome = 'accepted') / sum(dt) filter (where outcome = 'accepted') as mean_lateral_mps, "
    "max(abs(dx) / dt) filter (where outcome = 'accepted') as max_lateral_mps, max(x_m) - min(x_m) as lateral_range_m, "
    "stddev_pop(x_m) as lateral_stddev_m from ck_steps group by 1, 2",
    "lateral_m mean_lateral_mps max_lateral_mps lateral_range_m lateral_stddev_m",
)
def a5(t):
    raw = t.raw_positions
    return (
        P.movement(P.steps(raw)).select("match_id", "role", "lateral_m", "mean_lateral_mps", "max_lateral_mps")
        .join(P.lateral(raw), ["match_id", "role"])
    )


@query(
    "a6_position_coverage",
    "select match_id, role, count(*) as source_frames, count(x_m) as raw_frames, "
    "count(*) filter (where x_m is not null and region in ('inside','near')) as eligible_frames, "
    "count(*) filter (where x_m is not null and region in ('inside','near')) / count(*) as coverage from fx_raw_positions group by 1, 2",
    "coverage",
)
def a6(t):
    return P.coverage(t.raw_positions)


SHARED["ck_sm_ok"] = f"""
select *, x_m is not null and region in ('inside', 'near') as ok, x_m is not null and region in ('inside', 'near') and {IN} as inc from ck_smooth
"""
SHARED["ck_sm_steps"] = """
select match_id, role, sum(d) filter (where o = 'accepted') as distance_m, count(*) filter (where o = 'accepted') as steps,
  count(*) filter (where o = 'gap') as gap_steps, count(*) filter (where o = 'speed') as speed_steps, sum(abs(dx)) filter (where o = 'accepted') as lateral_m,
  sum(abs(dx)) filter (where o = 'accepted') / sum(dt) filter (where o = 'accepted') as mean_lateral_mps, max(abs(dx) / dt) filter (where o = 'accepted') as max_lateral_mps
from (select *, case when pf is null then null when frame - pf <> 1 or dt <= 0 or dt > 2e-1 then 'gap' when d / dt > 8e0 then 'speed' else 'accepted' end as o
 from (select match_id, role, frame, lag(frame) over w as pf, t_s - lag(t_s) over w as dt, x_m - lag(x_m) over w as dx,
        sqrt(power(x_m - lag(x_m) over w, 2) + power(y_m - lag(y_m) over w, 2)) as d
      from ck_sm_ok where ok window w as (partition by match_id, role order by frame))) group by 1, 2
"""

SHARED["ck_sm_spacing"] = """
select a.match_id, a.role = 'ME' as team, avg(sqrt(power(a.x_m - b.x_m, 2) + power(a.y_m - b.y_m, 2))) as spacing_m, count(*) as samples
from ck_sm_ok a join ck_sm_ok b on b.match_id = a.match_id and b.frame = a.frame and b.role = case a.role when 'ME' then 'PARTNER' else 'OPPONENT_2' end
where a.role in ('ME', 'OPPONENT_1') and a.ok and b.ok group by 1, 2
"""


def _zone_cols() -> str:
    z = zone_sql("y_m")
    return ", ".join(
        f"count(*) filter (where inc and {z} = '{n}') as \"{n}_frames\", count(*) filter (where inc and {z} = '{n}') / 30e0 as \"{n}_seconds\", "
        f"case when count(*) filter (where inc) > 0 then count(*) filter (where inc and {z} = '{n}') / count(*) filter (where inc) end as \"{n}_share\""
        for n in C.ZONES
    )


@query(
    "a13_player_summary",
    f"""select b.*, s.* exclude (match_id, role), p.spacing_m, coalesce(p.samples, 0) as spacing_samples, coalesce(p.samples, 0) / n.frame_count as spacing_coverage from (
      select match_id, role, count(*) as source_frames, count(raw_x_m) as raw_frames, count(x_m) as smoothed_frames,
        count(*) filter (where ok) as eligible_frames, count(*) filter (where inc) as in_court_frames,
        avg({setback_sql('y_m')}) filter (where inc) as kitchen_distance_m, max(x_m) filter (where ok) - min(x_m) filter (where ok) as lateral_range_m,
        stddev_pop(x_m) filter (where ok) as lateral_stddev_m, {_zone_cols()}, count(*) filter (where ok) / count(*) as coverage from ck_sm_ok group by 1, 2) b
      left join ck_sm_steps s on b.match_id = s.match_id and b.role = s.role
      join (select match_id, max(frame) + 1 as frame_count from ck_sm_ok group by 1) n on n.match_id = b.match_id
      left join ck_sm_spacing p on p.match_id = b.match_id and p.team = (b.role in ('ME', 'PARTNER'))""",
    'spacing_m spacing_coverage mean_lateral_mps max_lateral_mps lateral_stddev_m kitchen_seconds "transitionZone_seconds" backcourt_seconds distance_m lateral_m kitchen_distance_m lateral_range_m kitchen_share "transitionZone_share" backcourt_share coverage'.replace('"', ""),
)
def a13(t):
    return P.player_summary(t.raw_positions, 30.0)


@query(
    "a20_position_heatmap",
    f"select match_id, role, cast(least(floor(y_m / {LEN} * 96), 95) as bigint) as row_ix, cast(least(floor(x_m / {WID} * 48), 47) as bigint) as col_ix, "
    f"count(*) as frames from ck_ok where {IN} group by 1, 2, 3, 4",
)
def a20(t):
    return P.heatmap(t.raw_positions)
