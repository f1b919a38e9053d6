"""Queries over rallies, shots and teams."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.catalog.base import SHARED, query
from courtflow.catalog.positions import LEN, NEAR, FAR, NET, WID, zone_sql
from courtflow.functions.sequences import interval_join
from courtflow.operators import analytics as A
from courtflow.operators import positions as P

SHARED["ck_len"] = """
select r.*, end_s - start_s as duration_s, coalesce(n, 0) as shot_count from fx_star_rallies r
left join (select match_id, rally_id, count(*) as n from fx_shots group by 1, 2) s on r.match_id = s.match_id and r.rally_id = s.rally_id
"""
SHARED["ck_best"] = """
select * from (select *, row_number() over (partition by match_id order by shot_count desc, duration_s desc, start_frame, rally_id) as rn from ck_len) where rn = 1
"""


@query("t1_longest_rally", "select match_id, rally_id, shot_count, duration_s, start_frame from ck_best", "duration_s")
def t1(t):
    return A.longest_rally(A.rally_lengths(t.star_rallies, t.shots))


@query(
    "a7_match_metrics",
    "select l.match_id, count(*) as rally_count, cast(sum(l.shot_count) as bigint) as shot_count, avg(l.duration_s) as mean_duration_s, "
    "sum(l.shot_count) / count(*) as mean_length, avg(l.confidence) as mean_rally_confidence, any_value(b.rally_id) as longest_rally_id, "
    "any_value(b.shot_count) as longest_shots from ck_len l join ck_best b on l.match_id = b.match_id group by 1",
    "mean_duration_s mean_length mean_rally_confidence",
)
def a7(t):
    return A.match_metrics(t.star_rallies, t.shots)


@query(
    "a8_player_hits",
    """select g.match_id, g.player_id, coalesce(c.hits, 0) as hits, coalesce(c.classified, 0) as classified, g.shot_type,
      coalesce(n.n, 0) as n, case when c.classified > 0 then coalesce(n.n, 0) / c.classified end as rate
    from (select distinct match_id, player_id, shot_type from fx_star_rallies s
            cross join (select unnest(['ME','PARTNER','OPPONENT_1','OPPONENT_2']) as player_id) cross join (select unnest(['DINK','DROP','DRIVE','VOLLEY','OVERHEAD']) as shot_type) k) g
    left join (select match_id, hitter_id, count(*) as hits, count(*) filter (where shot_type <> 'UNKNOWN') as classified from fx_shots group by 1, 2) c
      on c.match_id = g.match_id and c.hitter_id = g.player_id
    left join (select match_id, hitter_id, shot_type, count(*) as n from fx_shots group by 1, 2, 3) n
      on n.match_id = g.match_id and n.hitter_id = g.player_id and n.shot_type = g.shot_type""".replace("distinct match_id, player_id, shot_type", "distinct s.match_id, player_id, k.shot_type"),
    "rate",
)
def a8(t):
    return A.player_hits(t.shots, t.star_rallies)


@query(
    "a9_third_shot_rates",
    """select *, case when classified > 0 then drops / classified end as drop_rate, case when classified > 0 then drives / classified end as drive_rate
    from (select m.match_id, count(*) filter (where shot_index = 3) as third_shots,
      count(*) filter (where shot_index = 3 and shot_type <> 'UNKNOWN') as classified,
      count(*) filter (where shot_index = 3 and shot_type = 'DROP') as drops,
      count(*) filter (where shot_index = 3 and shot_type = 'DRIVE') as drives
      from (select distinct match_id from fx_star_rallies) m left join fx_shots s on s.match_id = m.match_id group by 1)""",
    "drop_rate drive_rate",
)
def a9(t):
    return A.third_shots(t.shots, t.star_rallies)


SHARED["ck_zone_shots"] = f"""
select match_id, shot_type, case when hitter_x_m is not null and hitter_region in ('inside', 'near') then {zone_sql('hitter_y_m')} end as zone from fx_shots
"""


@query(
    "a10_shot_selection",
    """select m.match_id, excluded_position, excluded_type, z.zone, k.shot_type, coalesce(n, 0) as n, coalesce(zt, 0) as zone_total,
      case when zt > 0 then coalesce(n, 0) / zt end as rate
    from (select r.match_id, count(shot_type) filter (where zone is null) as excluded_position, count(*) filter (where zone is not null and shot_type = 'UNKNOWN') as excluded_type
          from (select distinct match_id from fx_star_rallies) r left join ck_zone_shots s on s.match_id = r.match_id group by 1) m
    cross join (select unnest(['kitchen','transitionZone','backcourt']) as zone) z
    cross join (select unnest(['SERVE','RETURN','DRIVE','DROP','DINK','VOLLEY','OVERHEAD','OTHER']) as shot_type) k
    left join (select match_id, zone, shot_type, count(*) as n from ck_zone_shots where shot_type <> 'UNKNOWN' group by 1, 2, 3) c
      on c.match_id = m.match_id and c.zone = z.zone and c.shot_type = k.shot_type
    left join (select match_id, zone, count(*) as zt from ck_zone_shots where shot_type <> 'UNKNOWN' group by 1, 2) d
      on d.match_id = m.match_id and d.zone = z.zone""",
    "rate",
)
def a10(t):
    return A.shot_selection(t.shots, t.star_rallies)


REACH = "9e-1"


def _at(x: str, y: str) -> str:
    return (
        f"({x} between 0 and {WID} and {y} between 0 and {LEN} and case when team = 'nearTeam' then {y} between {NEAR} - {REACH} and {NET} "
        f"else {y} between {NET} and {FAR} + {REACH} end)"
    )


SHARED["ck_arrive"] = f"""
select *, case when evaluable then fst end as arrival_frame, case when evaluable then fst is not null end as arrived,
  case when evaluable then fst / 30e0 end as arrival_s
from (select r.match_id, r.rally_id, r.team, count(j.frame) / (r.end_frame - r.start_frame + 1) as coverage,
   count(j.frame) / (r.end_frame - r.start_frame + 1) >= 5e-1 as evaluable,
   min(j.frame) filter (where {_at('ax', 'ay')} and {_at('bx', 'by_')}) as fst
  from (select * from fx_rallies cross join (select unnest(['nearTeam', 'farTeam']) as team)) r
  left join (select match_id, team as jt, frame, ax, ay, bx, by_ from ck_joint) j
    on j.match_id = r.match_id and j.jt = r.team and j.frame between r.start_frame and r.end_frame
  group by r.match_id, r.rally_id, r.team, r.start_frame, r.end_frame)
"""


@query(
    "j3_rally_frames",
    "select r.match_id, r.rally_id, p.role, count(*) as frames, avg(p.confidence) as confidence from fx_rallies r join fx_raw_positions p "
    "on p.match_id = r.match_id and p.frame between r.start_frame and r.end_frame group by 1, 2, 3",
    "confidence",
)
def j3(t):
    frames = t.raw_positions.select("match_id", "role", "frame", "confidence")
    rallies = t.rallies.select("match_id", "rally_id", "start_frame", "end_frame")
    joined = interval_join(frames, rallies, ["match_id"], "frame", "start_frame", "end_frame", A.RALLY_BUCKET_FRAMES)
    return joined.groupBy("match_id", "rally_id", "role").agg(F.count("*").alias("frames"), F.avg("confidence").alias("confidence"))


@query(
    "a11_kitchen_arrival",
    "select match_id, rally_id, team, coverage, evaluable, arrival_frame, arrived, arrival_s from ck_arrive",
    "coverage arrival_s",
)
def a11(t):
    return A.kitchen_arrivals(t.rallies, t.raw_positions, 30.0)


@query(
    "a11_kitchen_arrival_rate",
    "select *, case when evaluable > 0 then arrivals / evaluable end as rate from (select match_id, team, count(*) filter (where arrived) as arrivals, "
    "count(*) filter (where evaluable) as evaluable, count(*) filter (where not evaluable) as low_coverage from ck_arrive group by 1, 2)",
    "rate",
)
def a11_rate(t):
    return A.kitchen_arrival_rate(A.kitchen_arrivals(t.rallies, t.raw_positions, 30.0))


@query(
    "a12_data_quality",
    "select r.match_id, mean_rally_confidence, coalesce(unknown_hitters, 0) as unknown_hitters, coalesce(unknown_types, 0) as unknown_types, mean_shot_confidence, mean_hitter_confidence from "
    "(select match_id, avg(confidence) as mean_rally_confidence from fx_star_rallies group by 1) r left join "
    "(select match_id, count(*) filter (where hitter_id = 'UNKNOWN') as unknown_hitters, count(*) filter (where shot_type = 'UNKNOWN') as unknown_types, "
    "avg(confidence) as mean_shot_confidence, avg(hitter_confidence) filter (where hitter_id <> 'UNKNOWN') as mean_hitter_confidence from fx_shots group by 1) s "
    "on r.match_id = s.match_id",
    "mean_rally_confidence mean_shot_confidence mean_hitter_confidence",
)
def a12_quality(t):
    return A.data_quality(t.star_rallies, t.shots)


@query(
    "a12_match_document",
    """select m.match_id, m.rally_count, m.shot_count, third, distance_m from
    (select r.match_id, count(distinct r.rally_id) as rally_count, count(s.shot_id) as shot_count, count(*) filter (where s.shot_index = 3) as third
       from fx_rallies r left join ck_doc_shots s on s.match_id = r.match_id and s.rally_id = r.rally_id group by 1) m
    left join (select match_id, sum(d) as distance_m from ck_steps where outcome = 'accepted' group by 1) d on d.match_id = m.match_id""",
    "distance_m",
    {"ck_doc_shots": "select match_id % 25 as match_id, rally_id % 4 as rally_id, shot_id, shot_index from fx_shots where match_id % 25 in (select match_id from fx_rallies)"},
)
def a12(t):
    shots = t.shots.withColumn("match_id", F.col("match_id") % 25).withColumn("rally_id", F.col("rally_id") % 4)
    doc = A.match_document(t.rallies, shots, t.raw_positions, 30.0)
    part = F.from_json(
        "metrics",
        "match struct<rally_count:bigint,shot_count:bigint>, thirdShots struct<third_shots:bigint>, movement array<struct<distance_m:double>>",
    )
    total = F.aggregate("d.movement", F.lit(0.0), lambda a, m: a + F.coalesce(m["distance_m"], F.lit(0.0)))
    return doc.withColumn("d", part).select(
        "match_id",
        F.col("d.match.rally_count").alias("rally_count"),
        F.col("d.match.shot_count").alias("shot_count"),
        F.col("d.thirdShots.third_shots").alias("third"),
        total.alias("distance_m"),
    )


ROLES = C.ROLES
