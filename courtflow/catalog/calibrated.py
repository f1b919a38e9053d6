"""Queries in which every match has its own frame rate, image size and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow.catalog.base import SHARED, query
from courtflow.catalog.events import HI, H, angle_sql, rallies_of
from courtflow.catalog.players import landmarks_of
from courtflow.catalog.positions import LEN, NET, WID
from courtflow.fixtures import num
from courtflow.functions import geometry as G
from courtflow.operators import ball as B
from courtflow.operators import events as X
from courtflow.operators import players as PL
from courtflow.operators import quality as Q


def _entries() -> str:
    """Matrices of a match whose image is the plain one, scaled by s and moved by dx and dy."""
    h, g = [num(v) for v in H], [num(v) for v in HI]
    out = []
    for r in (0, 3, 6):
        out += [f"({h[r]}) / s as h{r}", f"({h[r + 1]}) / s as h{r + 1}", f"({h[r + 2]}) - ({h[r]}) * dx / s - ({h[r + 1]}) * dy / s as h{r + 2}"]
    for c in range(3):
        out += [f"s * ({g[c]}) + dx * ({g[6 + c]}) as g{c}", f"s * ({g[3 + c]}) + dy * ({g[6 + c]}) as g{3 + c}", f"({g[6 + c]}) as g{6 + c}"]
    return ", ".join(out)


# One row per match; every eleventh match lacks its calibration.
CALIBRATIONS = f"""
select match_id, fps, width, height, rmse_m, {_entries()}
from (select match_id, case match_id % 3 when 0 then 25e0 when 1 then 30e0 else 60e0 end as fps,
        1920 + 160 * (match_id % 4) as width, 1080 + 90 * (match_id % 4) as height, 3e-2 + (match_id % 7) / 1e2 as rmse_m,
        1e0 + (match_id % 4) / 12e0 as s, 16e0 * (match_id % 5) - 32e0 as dx, 9e0 * (match_id % 3) as dy
      from (select cast(floor(event_id / 400) as bigint) as match_id from {{events}} group by 1) m where match_id % 11 <> 10) c
"""
SHARED["ck_cal"] = CALIBRATIONS.format(events="events")


def calibrations_of(t):
    rows = t.spark.sql(CALIBRATIONS, events=t.read("events"))
    matrix = lambda letter: F.array(*[F.col(f"{letter}{i}") for i in range(9)])
    return rows.select("match_id", "fps", "width", "height", "rmse_m", matrix("h").alias("image_to_court"), matrix("g").alias("court_to_image"))


def _project(x: str, y: str, m: str) -> tuple[str, str]:
    den = f"({m}6 * {x} + {m}7 * {y} + {m}8)"
    return tuple(f"(case when abs{den} >= 1e-12 then ({m}{r} * {x} + {m}{r + 1} * {y} + {m}{r + 2}) / {den} end)" for r in (0, 3))


_CORNERS = [_project(x, y, "g") for x, y in (("0e0", "0e0"), (WID, "0e0"), (WID, LEN), ("0e0", LEN))]
SHARED["ck_cam"] = "select *, sqrt(cast(width as double) * width + cast(height as double) * height) as diag, " + ", ".join(
    f"{x} as qx{i}, {y} as qy{i}" for i, (x, y) in enumerate(_CORNERS)) + " from ck_cal"
_SIGNS = [f"((qx{j} - qx{i}) * (y_px - qy{i}) - (qy{j} - qy{i}) * (x_px - qx{i}))" for i, j in ((0, 1), (1, 2), (2, 3), (3, 0))]
INSIDE = "((" + " and ".join(f"{s} >= 0" for s in _SIGNS) + ") or (" + " and ".join(f"{s} <= 0" for s in _SIGNS) + "))"

_GX, _GY = _project("((l + r_px) / 2)", "b", "h")


@query("e1_match_homography", f"select p.match_id, detection_id, {_GX} as x_m, {_GY} as y_m from fx_persons p left join ck_cal c on c.match_id = p.match_id", "x_m y_m")
def e1(t):
    x, y = G.ground_point("l", "r_px", "b")
    rows = G.calibrated(t.persons.withColumn("gx", x).withColumn("gy", y), calibrations_of(t))
    x, y = G.project("gx", "gy", G.coefficients("image_to_court"))
    return rows.select("match_id", "detection_id", x.alias("x_m"), y.alias("y_m"))


_PX, _PY = _project("cx", "cy", "g")


@query("e1_match_homography_inverse", f"select p.match_id, role, frame, {_PX} as x_px, {_PY} as y_px from (select *, x_m as cx, y_m as cy from fx_raw_positions) p left join ck_cal c on c.match_id = p.match_id", "x_px y_px")
def e1_inverse(t):
    rows = G.calibrated(t.raw_positions, calibrations_of(t))
    x, y = G.project("x_m", "y_m", G.coefficients("court_to_image"))
    return rows.select("match_id", "role", "frame", x.alias("x_px"), y.alias("y_px"))


_U, _V = _project("u", "v", "h")


@query(
    "e2_match_calibration",
    f"""select *, case when warnings <> '' then 'warning' else 'pass' end as status from (
    select * exclude (diag), concat_ws(',', case when n = 4 then 'four_points_only' end, case when outliers > 0 then 'outliers' end, case when rmse_px > 3e-3 * diag then 'image_rmse' end,
      case when rmse_m > 8e-2 then 'court_rmse' end) as warnings from (
    select match_id, any_value(diag) as diag, count(*) as n, count(*) filter (where not inlier) as outliers, sqrt(avg(court_m * court_m)) as rmse_m, max(court_m) as max_m, sqrt(avg(image_px * image_px)) as rmse_px, max(image_px) as max_px,
      sqrt(avg(court_m * court_m) filter (where inlier)) as inlier_rmse_m, sqrt(avg(image_px * image_px) filter (where inlier)) as inlier_rmse_px
    from (select l.*, c.diag, sqrt(power({_U} - cx, 2) + power({_V} - cy, 2)) as court_m, sqrt(power({_PX} - u, 2) + power({_PY} - v, 2)) as image_px
          from ck_land l left join ck_cam c on c.match_id = l.match_id) group by 1))""",
    "rmse_m max_m rmse_px max_px inlier_rmse_m inlier_rmse_px",
)
def e2(t):
    calibrations = calibrations_of(t)
    camera = G.camera_of(calibrations)
    rows = G.calibrated(landmarks_of(t), calibrations)
    out = Q.calibration_quality(Q.landmark_residuals(rows, camera.homography, camera.inverse), camera)
    return out.withColumn("warnings", F.concat_ws(",", "warnings"))


_LEFT, _RIGHT = "least(qx0, qx1, qx2, qx3)", "greatest(qx0, qx1, qx2, qx3)"
_TOP, _BOTTOM = "least(qy0, qy1, qy2, qy3)", "greatest(qy0, qy1, qy2, qy3)"


@query(
    "e7_match_relevance",
    f"""select match_id, frame, case when qx0 is null then null when inside then 1e0 when dx > width * 12e-2 or dy > m then 0e0
      else greatest(45e-2, 75e-2 - 3e-1 * greatest(dx / (width * 12e-2), greatest(0e0, dy) / m)) end as relevance
    from (select b.match_id, b.frame, width, qx0, {INSIDE} as inside, greatest({_LEFT} - x_px, 0e0, x_px - {_RIGHT}) as dx,
            case when y_px < {_TOP} then {_TOP} - y_px else y_px - {_BOTTOM} end as dy, case when y_px < {_TOP} then height * 5e-1 else height * 6e-2 end as m
          from fx_ball b left join ck_cam c on c.match_id = b.match_id where x_px is not null)""",
    "relevance",
)
def e7(t):
    calibrations = calibrations_of(t)
    camera = G.camera_of(calibrations)
    rows = G.calibrated(t.ball.filter("x_px is not null"), calibrations)
    return rows.select("match_id", "frame", B.relevance("x_px", "y_px", camera.corners, camera).alias("relevance"))


SHARED["ck_cground"] = f"""
select *, case when gone then 'frame_edge_clipped' when x_m is null then 'transform_invalid' else 'projected' end as projection,
  case when x_m is null then 'ambiguous' when ins then 'inside' when away <= 15e-1 then 'near' else 'outside' end as region,
  case when x_m is null then 0 else least(1e0, room / 25e-2) * greatest(25e-2, 1 - rmse_m / 15e-1) end as region_confidence,
  case when x_m is null then 'ambiguous' when y_m - {NET} < -25e-2 then 'near_side' when y_m - {NET} > 25e-2 then 'far_side' else 'ambiguous' end as side
from (select *, case when ins then least(x_m, {WID} - x_m, y_m, {LEN} - y_m) when away <= 15e-1 then least(away, 15e-1 - away) else away - 15e-1 end as room
  from (select *, x_m between 0 and {WID} and y_m between 0 and {LEN} as ins, sqrt(power(greatest(0e0, -x_m, x_m - {WID}), 2) + power(greatest(0e0, -y_m, y_m - {LEN}), 2)) as away
    from (select p.match_id, detection_id, rmse_m, coalesce(b >= height - 1, false) as gone, case when b < height - 1 then {_GX} end as x_m, case when b < height - 1 then {_GY} end as y_m
      from fx_persons p left join ck_cal c on c.match_id = p.match_id)))
"""


@query("e10_match_ground", "select match_id, detection_id, projection, x_m, y_m, region, region_confidence, side from ck_cground", "x_m y_m region_confidence")
def e10(t):
    calibrations = calibrations_of(t)
    camera = G.camera_of(calibrations)
    out = PL.assess_ground(G.calibrated(t.persons, calibrations), camera.homography, F.col("rmse_m"), camera.height)
    return out.select("match_id", "detection_id", "projection", "x_m", "y_m", "region", "region_confidence", "side")


SHARED["ck_ctrack"] = """
select b.*, fps, diag, height, width, qx0, qx1, qx2, qx3, qy0, qy1, qy2, qy3, h0, h1, h2, h3, h4, h5, h6, h7, h8,
  cast(greatest(2, round_even(2e-1 * fps, 0)) as bigint) as w, cast(greatest(1, round_even(18e-2 * fps, 0)) as bigint) as apart
from fx_ball b join ck_cam c on c.match_id = b.match_id
"""
SHARED["ck_cshape"] = """
select *, y_px - greatest(minb, mina) as prominence_px, same / (2e0 * w + 1) as continuity, obs / same as observed_fraction from (
select k.*, count(*) over sb as nb, count(*) over sa as na, coalesce(regr_slope(x_px, t_s) over b, 0) as bx, coalesce(regr_slope(y_px, t_s) over b, 0) as by_,
  coalesce(regr_slope(x_px, t_s) over a, 0) as ax, coalesce(regr_slope(y_px, t_s) over a, 0) as ay, min(y_px) over sb as minb, min(y_px) over sa as mina,
  count(*) over r as same, count(*) filter (where status = 'OBSERVED') over r as obs
from ck_ctrack k where x_px is not null
window b as (partition by match_id, segment_id order by frame range between w preceding and current row), a as (partition by match_id, segment_id order by frame range between current row and w following),
 sb as (partition by match_id, segment_id order by frame range between w preceding and 1 preceding), sa as (partition by match_id, segment_id order by frame range between 1 following and w following),
 r as (partition by match_id, segment_id order by frame range between w preceding and w following)) s where nb >= 2 and na >= 2
  and frame >= w and frame < (select max(frame) + 1 from fx_ball z where z.match_id = s.match_id) - w
"""
_X, _Y = _project("x_px", "y_px", "h")
SHARED["ck_cbnc"] = f"""
select *, case when inside and visual >= 55e-2 and cx between 0 and {WID} and cy between 0 and {LEN} then cx end as court_x_m,
  case when inside and visual >= 55e-2 and cx between 0 and {WID} and cy between 0 and {LEN} then cy end as court_y_m
from (select *, least(1e0, 27e-2 * least(1e0, reversal / 12e-2) + 18e-2 * least(1e0, prominence / 45e-4) + 13e-2 * least(1e0, least(by_, -ay) / (54e-3 * diag))
   + 17e-2 * continuity + 1e-1 * observed_fraction + 1e-1 * cast(inside as int) + 5e-2 * case when status = 'OBSERVED' then 1e0 else 55e-2 end + coalesce(5e-2 * rc, 0)) as visual,
   {_X} as cx, {_Y} as cy, {angle_sql('bx', 'by_', 'ax', 'ay')} as direction_deg
 from (select s.*, (by_ - ay) / diag as reversal, prominence_px / diag as prominence, {INSIDE} as inside, r.rally_id, r.confidence as rc
   from ck_cshape s left join ck_rl r on r.match_id = s.match_id and s.frame between r.start_frame and r.end_frame)
 where by_ >= 18e-3 * diag and ay <= -18e-3 * diag and reversal >= 4e-2 and prominence >= 15e-4 and continuity >= 65e-2)
where visual >= 35e-2
"""
_COLUMNS = "match_id, frame, visual, reversal, prominence, direction_deg, rally_id, court_x_m, court_y_m"


def track_of(t):
    calibrations = calibrations_of(t)
    return G.calibrated(t.ball, calibrations, "inner"), G.camera_of(calibrations)


@query("f6_match_bounce_candidates", f"select {_COLUMNS} from ck_cbnc", "visual reversal prominence direction_deg court_x_m court_y_m")
def f6_candidates(t):
    track, camera = track_of(t)
    return X.bounce_candidates(track, camera, camera.corners, camera.homography, rallies_of(t)).select(*_COLUMNS.split(", "))


@query(
    "f6_match_bounces",
    """select b.match_id, b.frame, visual, court_x_m, court_y_m from ck_cbnc b join (
      select match_id, unnest(kept) as frame from (select match_id, list_reduce(fs, lambda acc, x: case when len(list_filter(acc, lambda a: abs(a - x[1]) < apart)) > 0 then acc else list_concat(acc, x) end) as kept
        from (select match_id, any_value(apart) as apart, list([frame] order by visual desc, frame) as fs from ck_cbnc group by 1))) k on k.match_id = b.match_id and k.frame = b.frame""",
    "visual court_x_m court_y_m",
)
def f6(t):
    track, camera = track_of(t)
    found = X.detect_bounces(track, camera, camera.corners, camera.homography, t.audio, rallies_of(t))
    return found.select("match_id", "frame", "visual", "court_x_m", "court_y_m")
