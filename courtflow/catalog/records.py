"""Queries over quality checks, storage, corrections, datasets and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.catalog.ball import CORNERS, V
from courtflow.catalog.base import SHARED, query
from courtflow.catalog.events import greedy_sql
from courtflow.catalog.positions import LEN, WID
from courtflow.functions import taxonomy as TX
from courtflow.functions.roster import roster
from courtflow.operators import corrections as K
from courtflow.operators import datasets as DS
from courtflow.operators import quality as Q
from courtflow.operators import regions as RG
from courtflow.operators import timeline as TL
from courtflow.sources import racket_pose as RP
from courtflow.sources import store as ST

k_sql = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"

# --- quality ----------------------------------------------------------------


@query(
    "s3_frame_completeness",
    """select match_id, first_frame, last_frame, rows, frames, bad_times, concat_ws(',', case when first_frame <> 0 then 'does_not_start_at_zero' end, case when rows <> frames then 'duplicate_frames' end,
      case when last_frame - first_frame + 1 <> frames then 'missing_frames' end, case when bad_times > 0 then 'timestamps_off' end) as reasons
    from (select match_id, min(frame) as first_frame, max(frame) as last_frame, count(*) as rows, count(distinct frame) as frames, count(distinct case when abs(t_s - frame / 30e0) > 1e-6 then frame end) as bad_times from fx_ball
      where match_id % 2 = 0 or k <> 50 group by 1) where first_frame <> 0 or rows <> frames or last_frame - first_frame + 1 <> frames or bad_times > 0""",
)
def s3(t):
    out = Q.frame_completeness(t.ball.filter("match_id % 2 = 0 or k <> 50"), ["match_id"], V.fps)
    return out.withColumn("reasons", F.concat_ws(",", "reasons"))


VID = "select cast(floor(event_id / 400) as bigint) as match_id, cast(1920 as bigint) as width, cast(1080 - 360 * (event_id % 800 / 400) as bigint) as height, cast(400 as bigint) as frame_count, 30e0 as fps, 13e0 + value / 1e3 as duration_s from {events} where event_id % 400 = 0"
VID2 = "select cast(floor(event_id / 400) as bigint) as match_id, cast(1920 as bigint) as width, cast(1080 as bigint) as height, cast(400 + event_id / 400 % 3 as bigint) as frame_count, 30e0 + case when event_id % 1600 = 0 then 1e-2 else 0 end as fps, 13e0 + value / 1e3 + case when event_id % 2000 = 0 then 1e0 else 0 end as duration_s from {events} where event_id % 400 = 0"
SHARED["ck_vid"], SHARED["ck_vid2"] = VID.format(events="events"), VID2.format(events="events")


@query(
    "s4_source_compatibility",
    """select * from (select a.match_id, concat_ws(',', case when a.width <> b.width then 'width' end, case when a.height <> b.height then 'height' end, case when a.frame_count <> b.frame_count then 'frame_count' end,
      case when abs(a.fps - b.fps) > greatest(1e-6 * greatest(abs(a.fps), abs(b.fps)), 1e-6) then 'fps' end, case when abs(a.duration_s - b.duration_s) > greatest(1e-6 * greatest(abs(a.duration_s), abs(b.duration_s)), 1e-3) then 'duration_s' end) as fields
    from ck_vid a join ck_vid2 b on a.match_id = b.match_id) where fields <> ''""",
)
def s4(t):
    events = t.read("events")
    out = Q.source_mismatches(t.spark.sql(VID, events=events), t.spark.sql(VID2, events=events))
    return out.withColumn("fields", F.concat_ws(",", "fields"))


@query(
    "s5_lineage",
    "select s.match_id, s.named_hash, r.actual_hash from (select o_custkey as match_id, sha256(concat('rallies:', cast(o_custkey + case when o_custkey % 7 = 0 then 1 else 0 end as varchar))) as named_hash from orders group by 1, 2) s "
    "left join (select o_custkey as match_id, sha256(concat('rallies:', cast(o_custkey as varchar))) as actual_hash from orders where o_custkey % 11 <> 0 group by 1, 2) r on r.match_id = s.match_id where s.named_hash is distinct from r.actual_hash",
)
def s5(t):
    key = F.col("o_custkey")
    named = key + F.when(key % 7 == 0, 1).otherwise(0)
    h = lambda c: F.sha2(F.concat(F.lit("rallies:"), c.cast("string")), 256)
    shots = t.read("orders").select(key.alias("match_id"), h(named).alias("rallies_hash"))
    rallies = t.read("orders").filter(key % 11 != 0).select(key.alias("match_id")).distinct().withColumn("content_hash", h(F.col("match_id")))
    return Q.lineage_breaks(shots, rallies)


@query(
    "s6_rally_order",
    """select match_id, candidate_no as rally_id, start_frame, unnest(reasons) as reason from (select *, list_filter([case when end_frame < start_frame or end_frame >= 3000 then 'invalid_interval' end,
      case when start_frame <= lag(end_frame) over (partition by match_id order by start_frame, candidate_no) then 'overlaps_previous' end], lambda x: x is not null) as reasons
      from (select b.*, count(*) over (partition by match_id, start_frame) as same from fx_bursts b) where same = 1)""",
)
def s6(t):
    b = t.bursts
    single = b.groupBy("match_id", "start_frame").agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    rows = b.join(single, ["match_id", "start_frame"]).withColumnRenamed("candidate_no", "rally_id")
    return Q.rally_violations(rows, 3000)


SHARED["ck_bursts2"] = "select * from fx_bursts union all select * replace (end_frame + 5 as end_frame) from fx_bursts where candidate_no % 13 = 0"


@query(
    "s6_rally_order_all",
    """select match_id, candidate_no as rally_id, start_frame, unnest(reasons) as reason from (select *, list_filter([case when start_frame < 0 or end_frame < start_frame or end_frame >= 3000 then 'invalid_interval' end,
      case when start_frame <= lag(end_frame) over (partition by match_id order by start_frame, candidate_no, end_frame) then 'overlaps_previous' end,
      case when count(*) over (partition by match_id, candidate_no) > 1 then 'duplicate_id' end], lambda x: x is not null) as reasons from ck_bursts2)""",
)
def s6_all(t):
    # Every burst, and each thirteenth id once more with the same start: ties and used ids are reported too.
    b = t.bursts.withColumnRenamed("candidate_no", "rally_id")
    again = b.filter("rally_id % 13 = 0").withColumn("end_frame", F.col("end_frame") + 5)
    return Q.rally_violations(b.unionByName(again), 3000)


@query(
    "s6_shot_index",
    """select match_id, rally_id, count(*) as shots, 'unknown_rally' as reason from fx_shots s where not exists (select 1 from fx_star_rallies r where r.match_id = s.match_id and r.rally_id = s.rally_id and r.rally_id % 13 <> 0) group by 1, 2
    union all select match_id, rally_id, count(*), 'index_not_contiguous' from fx_shots group by 1, 2 having min(shot_index) <> 1 or max(shot_index) <> count(distinct shot_index) or count(*) <> count(distinct shot_index)""",
)
def s6s(t):
    return Q.shot_violations(t.shots, t.star_rallies.filter("rally_id % 13 <> 0"))


REC = "select event_id, case when event_id % 97 = 0 then cast('NaN' as double) when event_id % 89 = 0 then cast('Infinity' as double) else value end as score, case when event_id % 31 = 0 then concat('{{\"$set\": ', cast(event_id as {text}), '}}') when event_id % 37 = 0 then concat('{{\"a.b\": {{\"c\": ', cast(event_id as {text}), '}}}}') when event_id % 41 = 0 then 'no json' else props end as payload from {events}"
SHARED["ck_rec"] = REC.format(events="events", text="varchar")


@query(
    "s7_record_validation",
    "select event_id, unnest(list_filter([case when isnan(score) or isinf(score) then 'not_finite' end, case when json_valid(payload) and (event_id % 31 = 0 or event_id % 37 = 0) then 'unsafe_field_name' end, "
    "case when not json_valid(payload) then 'not_an_object' end], lambda x: x is not null)) as reason from ck_rec",
)
def s7(t):
    return Q.record_violations(_records(t), "event_id", "payload", ["score"])


def _records(t):
    e = t.read("events")
    i = F.col("event_id")
    score = F.when(i % 97 == 0, float("nan")).when(i % 89 == 0, float("inf")).otherwise(F.col("value"))
    payload = (
        F.when(i % 31 == 0, F.concat(F.lit('{"$set": '), i.cast("string"), F.lit("}")))
        .when(i % 37 == 0, F.concat(F.lit('{"a.b": {"c": '), i.cast("string"), F.lit("}}")))
        .when(i % 41 == 0, "no json").otherwise(F.col("props")))
    return e.select("event_id", score.alias("score"), payload.alias("payload"))


@query("s9_unique_active_corrections", "select match_id, type, target_collection, target_id % 5 as target, count(*) as uses from fx_corrections where active group by 1, 2, 3, 4 having count(*) > 1")
def s9(t):
    rows = t.corrections.withColumn("target", F.col("target_id") % 5)
    return Q.duplicate_keys(rows, ["match_id", "type", "target_collection", "target"], F.col("active"))


SHARED["ck_c2"] = "select correction_id, type, case when correction_id % 7 = 0 then target_id + 1 else target_id end as target_id, case when correction_id % 5 = 0 then null else target_collection end as target_collection from fx_corrections"


@query(
    "s10_immutable_fields",
    """select * from (select a.correction_id, concat_ws(',', case when a.type is distinct from b.type then 'type' end, case when a.target_id is distinct from b.target_id then 'target_id' end, case when a.target_collection is distinct from b.target_collection then 'target_collection' end) as fields
    from (select distinct correction_id, type, target_id, target_collection from fx_corrections) a join (select distinct * from ck_c2) b on a.correction_id = b.correction_id) where fields <> ''""",
)
def s10(t):
    old = t.corrections.select("correction_id", "type", "target_id", "target_collection").distinct()
    no = F.col("correction_id")
    new = old.select("correction_id", "type", F.when(no % 7 == 0, F.col("target_id") + 1).otherwise(F.col("target_id")).alias("target_id"), F.when(no % 5 != 0, F.col("target_collection")).alias("target_collection"))
    out = Q.immutable_changes(old, new, "correction_id", ["type", "target_id", "target_collection"])
    return out.withColumn("fields", F.concat_ws(",", "fields"))


# --- storage ----------------------------------------------------------------


@query("s8_upsert", "select o_orderkey as id, case when o_orderkey % 3 = 0 then 'new' else o_orderstatus end as status, case when o_orderkey % 3 = 0 then o_totalprice * 2 else o_totalprice end as price from orders", "price")
def s8(t):
    rows = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    batch = rows.filter("id % 3 = 0").select("id", F.lit("new").alias("status"), (F.col("price") * 2).alias("price"))
    return ST.upserted(rows, batch, "id")


@query("s8_batch_duplicates", "select l_orderkey as id, count(*) as uses from lineitem group by 1 having count(*) > 1")
def s8d(t):
    return ST.batch_duplicates(t.read("lineitem").select(F.col("l_orderkey").alias("id")), "id")


@query("t2_latest_per_match", "select match_id, rally_id, start_s from (select *, row_number() over (partition by match_id order by end_s desc, rally_id desc) as rn from fx_star_rallies) where rn = 1", "start_s")
def t2(t):
    return ST.latest(t.star_rallies, ["match_id"], "end_s", "rally_id").select("match_id", "rally_id", "start_s")


@query("t3_record_page", "select match_id, shot_id, shot_index, shot_type, (select count(*) from fx_shots where match_id = 7) as total from fx_shots where match_id = 7 order by rally_id, shot_index, shot_id limit 20 offset 10")
def t3(t):
    out = ST.page(t.shots, F.col("match_id") == 7, [F.asc("rally_id"), F.asc("shot_index"), F.asc("shot_id")], 20, 10)
    return out.select("match_id", "shot_id", "shot_index", "shot_type", "total")


@query("t3_deep_page", "select match_id, rally_id, shot_id, shot_index, (select count(*) from fx_shots) as total from fx_shots order by rally_id, shot_index, shot_id limit 100 offset 9900")
def t3_deep(t):
    out = ST.deep_page(t.shots, F.lit(True), ["rally_id", "shot_index", "shot_id"], 100, 9900, few=500)
    return out.select("match_id", "rally_id", "shot_id", "shot_index", "total")


# --- timeline ---------------------------------------------------------------


@query("e13_media_time", f"select event_id, 15e-1 + event_id / 30e0 as video_media_s, 25e-2 + event_id * 160 / 16000e0 + ({k_sql} - 50) / 1000e0 as audio_media_s from events", "video_media_s audio_media_s")
def e13(t):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    i = F.col("event_id")
    return t.read("events").select("event_id", TL.frame_to_media(i, 30.0, 1.5).alias("video_media_s"), TL.sample_to_media(i * 160, 16000, 0.25, k - 50).alias("audio_media_s"))


TRN = "select match_id, transient_id, video_s as media_s, video_s + 2e-2 as analysis_s, 5e-1 as audio_start_s, 4e-1 as video_start_s, confidence * 100 - 40 as offset_ms, 30e0 as duration_s from {fx_audio}"
SHARED["ck_trn"] = TRN.format(fx_audio="fx_audio")


def _transients(t):
    return t.audio.select("match_id", "transient_id", F.col("video_s").alias("media_s"), (F.col("video_s") + 0.02).alias("analysis_s"), F.lit(0.5).alias("audio_start_s"), F.lit(0.4).alias("video_start_s"), (F.col("confidence") * 100 - 40).alias("offset_ms"), F.lit(30.0).alias("duration_s"))


@query("e14_transients_rally", "select match_id, transient_id, greatest(0e0, media_s - video_start_s) as video_s from ck_trn where media_s - video_start_s between -1 / 30e0 and duration_s + 1 / 30e0", "video_s")
def e14(t):
    return TL.transients_from_media(_transients(t), 30.0).select("match_id", "transient_id", "video_s")


@query("e14_transients_event", "select match_id, transient_id, greatest(0e0, v) as video_s from (select *, audio_start_s + analysis_s + offset_ms / 1000e0 - video_start_s as v from ck_trn) where v between -1 / 30e0 and duration_s + 1 / 30e0", "video_s")
def e14b(t):
    return TL.transients_from_analysis(_transients(t), 30.0).select("match_id", "transient_id", "video_s")


@query(
    "o1_event_timeline",
    """select match_id, concat('rally-', cast(rally_id as varchar), '-start') as event, 'rally' as kind, start_s as at_s, confidence from fx_rallies
    union all select match_id, concat('rally-', cast(rally_id as varchar), '-end'), 'rally', end_s, confidence from fx_rallies
    union all select match_id, concat('contact-', cast(event_id as varchar)), 'contact', t_s, fused from fx_predicted
    union all select match_id, concat('bounce-', cast(event_id as varchar)), 'bounce', t_s, frame / 1e3 from fx_truth where event_id % 3 <> 0
    union all select match_id, concat('shot-', cast(event_id as varchar)), 'shot', coalesce(case when event_id % 2 = 0 then t_s + 1 end, t_s), visual from fx_predicted""",
    "at_s confidence",
)
def o1(t):
    p = t.predicted
    contacts = p.select("match_id", F.col("event_id").alias("contact_id"), "t_s", "fused")
    truth = t.truth.select("match_id", F.col("event_id").alias("bounce_id"), "t_s", (F.col("frame") / 1e3).alias("confidence"), (F.col("event_id") % 3 != 0).alias("is_bounce"))
    shots = p.select("match_id", F.col("event_id").alias("shot_id"), F.when(F.col("event_id") % 2 == 0, F.col("t_s") + 1).alias("contact_s"), "t_s", F.col("visual").alias("confidence"))
    return TL.event_timeline(t.rallies, contacts, truth, shots)


@query("p8_landing_points", f"select match_id, shot_id, shot_type, hitter_x_m, hitter_y_m from fx_shots where hitter_x_m between 0 and {WID} and hitter_y_m between 0 and {LEN}", "hitter_x_m hitter_y_m")
def p8(t):
    return TL.landing_points(t.shots, "hitter_x_m", "hitter_y_m").select("match_id", "shot_id", "shot_type", "hitter_x_m", "hitter_y_m")


LAB = "select match_id, event_id * 2 + {odd} as event_id, cast(floor(frame / 20) as bigint) as frame, case event_id % 4 when 0 then 'SHOT_TYPE' when 1 then 'PADDLE_CONTACT' when 2 then 'SERVE_CONTACT' else 'BOUNCE' end as type, case when event_id % 5 = 0 then null when event_id % 9 = 0 then 'lob' else lower(shot_type) end as shot_type from {fx_predicted}"
SHARED["ck_lab"] = LAB.format(fx_predicted="fx_predicted", odd=0) + " union all " + LAB.format(fx_predicted="fx_truth", odd=1)


def _labels(t):
    cols = ("match_id", "event_id", "frame", "shot_type")
    e = t.predicted.select(*cols, F.lit(0).alias("odd")).unionByName(t.truth.select(*cols, F.lit(1).alias("odd")))
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("SHOT_TYPE", "PADDLE_CONTACT", "SERVE_CONTACT", "BOUNCE"))), (i % 4 + 1).cast("int"))
    return e.select("match_id", (i * 2 + F.col("odd")).alias("event_id"), F.floor(F.col("frame") / 20).alias("frame"), kind.alias("type"), F.when(i % 5 == 0, None).when(i % 9 == 0, "lob").otherwise(F.lower("shot_type")).alias("shot_type"))


TYPES = ", ".join(f"'{x}'" for x in C.SHOT_TYPES)


@query(
    "t4_label_precedence",
    f"select match_id, frame, shot_type from (select match_id, frame, upper(shot_type) as shot_type, row_number() over (partition by match_id, frame order by case when type = 'SHOT_TYPE' then 0 else 1 end, event_id) as rn from ck_lab where type <> 'BOUNCE' and upper(shot_type) in ({TYPES})) where rn = 1",
)
def t4(t):
    return TL.shot_labels(_labels(t), list(C.SHOT_TYPES))[0].select("match_id", "frame", "shot_type")


@query("t4_unsupported_labels", f"select match_id, count(*) filter (where upper(shot_type) not in ({TYPES})) as unsupported from ck_lab where type <> 'BOUNCE' and shot_type is not null group by 1")
def t4u(t):
    return TL.shot_labels(_labels(t), list(C.SHOT_TYPES))[1]


# --- corrections ------------------------------------------------------------

SHARED["ck_cval"] = """
select correction_id, type2 as type, case type2
  when 'player_identity' then case when correction_id % 5 = 0 then '{"displayName":" "}' when correction_id % 7 = 0 then '{"team":"A"}' else '{"playerId":"P1"}' end
  when 'rally_boundary' then concat('{"startFrame":', cast(corrected_at as varchar), case when correction_id % 3 = 0 then '.5' else '' end, ',"endFrame":', cast(corrected_at + revision * 10 - 15 as varchar), '}')
  when 'bounce' then case when correction_id % 4 = 0 then '{"frame":3}' when correction_id % 6 = 1 then '{"isBounce":false,"timestampSeconds":-1}' else '{"isBounce":true,"frame":12}' end
  when 'hitter' then case when correction_id % 4 = 0 then '{"playerId":""}' else '{"playerId":"ME"}' end
  else case when correction_id % 5 = 0 then '{}' when correction_id % 7 = 0 then '{"shotType":"LOB"}' else concat('{"shotType":"', new_type, '"}') end end as value, corrected_at, revision
from (select *, case when correction_id % 10 = 7 then 'bounce' else type end as type2 from fx_corrections)
"""


def correction_values(t):
    c = t.corrections
    n = F.col("correction_id")
    kind = F.when(n % 10 == 7, "bounce").otherwise(F.col("type"))
    at, rev = F.col("corrected_at"), F.col("revision")
    boundary = F.concat(F.lit('{"startFrame":'), at.cast("string"), F.when(n % 3 == 0, ".5").otherwise(""), F.lit(',"endFrame":'), (at + rev * 10 - 15).cast("string"), F.lit("}"))
    value = (
        F.when(kind == "player_identity", F.when(n % 5 == 0, '{"displayName":" "}').when(n % 7 == 0, '{"team":"A"}').otherwise('{"playerId":"P1"}'))
        .when(kind == "rally_boundary", boundary)
        .when(kind == "bounce", F.when(n % 4 == 0, '{"frame":3}').when(n % 6 == 1, '{"isBounce":false,"timestampSeconds":-1}').otherwise('{"isBounce":true,"frame":12}'))
        .when(kind == "hitter", F.when(n % 4 == 0, '{"playerId":""}').otherwise('{"playerId":"ME"}'))
        .otherwise(F.when(n % 5 == 0, "{}").when(n % 7 == 0, '{"shotType":"LOB"}').otherwise(F.concat(F.lit('{"shotType":"'), F.col("new_type"), F.lit('"}')))))
    return c.withColumn("type", kind).withColumn("value", value)


@query(
    "p6_correction_validation",
    """select correction_id, type, reason from (select *, case when value = '{}' then 'empty'
      when type = 'player_identity' and value like '%team%' then 'field_not_allowed' when type = 'player_identity' and value like '%" "%' then 'identity_empty'
      when type = 'rally_boundary' and (correction_id % 3 = 0 or corrected_at + revision * 10 - 15 < 0) then 'boundary_not_a_number' when type = 'rally_boundary' and revision * 10 - 15 < 0 then 'boundary_order'
      when type = 'bounce' and value not like '%isBounce%' then 'bounce_flag' when type = 'bounce' and value like '%-1%' then 'bounce_time'
      when type = 'hitter' and value like '%""%' then 'hitter_empty' when type = 'shot_type' and value like '%LOB%' then 'shot_type_unknown' end as reason from ck_cval) where reason is not null""",
)
def p6(t):
    return K.validate(correction_values(t)).select("correction_id", "type", "reason")


@query(
    "p7_prediction_snapshot",
    """select c.match_id, c.correction_id, case c.type when 'shot_type' then concat('{"shot_type":"', s.shot_type, '"}') when 'hitter' then concat('{"hitter_id":"', s.hitter_id, '"}') end as prediction
    from (select distinct match_id, correction_id, type, target_id from fx_corrections) c join (select distinct match_id, shot_id, shot_type, hitter_id from fx_shots) s on s.match_id = c.match_id and s.shot_id = c.target_id where c.type in ('shot_type', 'hitter')""",
)
def p7(t):
    c = t.corrections.filter("type in ('shot_type', 'hitter')").select("match_id", "correction_id", "type", F.col("target_id").alias("shot_id")).distinct()
    s = t.shots.select("match_id", "shot_id", "shot_type", "hitter_id").distinct()
    snap = K.snapshot(F.col("type"), {"shot_type": ("shot_type",), "hitter": ("hitter_id",)})
    return c.join(s, ["match_id", "shot_id"]).select("match_id", "correction_id", snap.alias("prediction"))


SHARED["ck_snap"] = """
select match_id, 'shot_type' as type, shot_id as target_id, concat('{"shot_type":"', shot_type, '"}') as prediction from fx_shots
union select match_id, 'hitter', shot_id, concat('{"hitter_id":"', hitter_id, '"}') from fx_shots
union select match_id, 'bounce', shot_id, concat('{"is_bounce":true,"frame":', cast(shot_index * 30 as varchar), ',"at_s":', cast(shot_index * 1e0 as varchar),
  case when hitter_x_m is null then '' else concat(',"court_x_m":', cast(hitter_x_m as varchar), ',"court_y_m":', cast(hitter_y_m as varchar)) end, '}') from fx_shots
union select match_id, 'player_identity', shot_id, concat('{"player_id":"', hitter_id, '","logical_identity":"', hitter_id, '","display_name":"Player ', hitter_id, '"}') from fx_shots
union select match_id, 'rally_boundary', rally_id, concat('{"start_frame":', cast(start_frame as varchar), ',"end_frame":', cast(start_frame + 30 as varchar), ',"start_s":', cast(start_s as varchar), ',"end_s":', cast(end_s as varchar), '}') from fx_star_rallies
"""


@query(
    "p7_prediction_snapshot_all",
    """select c.match_id, c.correction_id, c.type, s.prediction from (select distinct match_id, correction_id, case when correction_id % 10 = 7 and type <> 'rally_boundary' then 'bounce' else type end as type, target_id from fx_corrections) c
    join ck_snap s on s.match_id = c.match_id and s.type = c.type and s.target_id = c.target_id""",
)
def p7_all(t):
    # A shot row stands for the bounce and the player that a correction names as well.
    kind = F.when((F.col("correction_id") % 10 == 7) & (F.col("type") != "rally_boundary"), "bounce").otherwise(F.col("type"))
    c = t.corrections.withColumn("type", kind).select("match_id", "correction_id", "type", "target_id").distinct()
    shots = t.shots.select("match_id", F.col("shot_id").alias("target_id"), F.lit(False).alias("rally"), "shot_type", "hitter_id", F.lit(True).alias("is_bounce"), (F.col("shot_index") * 30).alias("frame"), (F.col("shot_index") * 1.0).alias("at_s"), F.col("hitter_x_m").alias("court_x_m"), F.col("hitter_y_m").alias("court_y_m"),
                           F.col("hitter_id").alias("player_id"), F.col("hitter_id").alias("logical_identity"), F.concat(F.lit("Player "), "hitter_id").alias("display_name"))
    rallies = t.star_rallies.select("match_id", F.col("rally_id").alias("target_id"), F.lit(True).alias("rally"), "start_frame", (F.col("start_frame") + 30).alias("end_frame"), "start_s", "end_s")
    records = shots.unionByName(rallies, allowMissingColumns=True).distinct()
    c = c.withColumn("rally", F.col("type") == "rally_boundary")
    return c.join(records, ["match_id", "target_id", "rally"]).select("match_id", "correction_id", "type", K.snapshot(F.col("type"), K.SNAPSHOT).alias("prediction"))


@query(
    "j13_correction_targets",
    """select distinct c.match_id, c.correction_id, r.record_id from fx_corrections c join (select distinct match_id, shot_id as record_id, rally_id as player_id from fx_shots) r
    on r.match_id = c.match_id and (r.record_id = c.target_id or r.player_id = c.target_id) where c.active and c.verified""",
)
def j13(t):
    # A record that is listed twice is reached once all the same: what comes out is distinct.
    records = t.shots.select("match_id", F.col("shot_id").alias("record_id"), F.col("rally_id").alias("player_id"))
    return K.targets(t.corrections, records)


SHARED["ck_win"] = "select * from (select *, row_number() over (partition by match_id, target_id, type order by corrected_at, correction_id, new_type, new_hitter, new_start_s, new_end_s) as rn from fx_corrections where active and verified) where rn = 1"
SHARED["ck_cshot"] = """
select s.*, coalesce(a.new_type, s.shot_type) as effective_type, coalesce(b.new_hitter, s.hitter_id) as effective_hitter from fx_shots s
left join ck_win a on a.match_id = s.match_id and a.target_id = s.shot_id and a.type = 'shot_type' left join ck_win b on b.match_id = s.match_id and b.target_id = s.shot_id and b.type = 'hitter'
"""
SHARED["ck_crally"] = """
select r.*, coalesce(b.new_start_s, r.start_s) as effective_start_s, coalesce(b.new_end_s, r.end_s) as effective_end_s from fx_star_rallies r
left join ck_win b on b.match_id = r.match_id and b.target_id = r.rally_id and b.type = 'rally_boundary'
"""


@query("d8_corrected_shots", "select match_id, shot_id, shot_index, shot_type, hitter_id, effective_type, effective_hitter from ck_cshot")
def d8(t):
    return K.corrected_shots(t.shots, t.corrections).select("match_id", "shot_id", "shot_index", "shot_type", "hitter_id", "effective_type", "effective_hitter")


IDM = "select o_custkey as match_id, o_orderkey as player_no, concat('P', cast(o_orderkey % 7 as {text})) as player_id, case o_orderkey % 5 when 0 then 'ME' when 1 then 'PARTNER' when 2 then 'OPPONENT_1' when 3 then 'OPPONENT_2' end as logical, case when o_orderkey % 3 = 0 then 'PARTNER' end as effective from {orders}"
SHARED["ck_players2"] = IDM.format(orders="orders", text="varchar")
SHARED["ck_idmap"] = """
select match_id, name, arg_max(identity, [player_no, pos]) as identity from (
 select match_id, player_no, player_id as name, 0 as pos, coalesce(effective, logical, player_id) as identity from ck_players2
 union all select match_id, player_no, logical, 1, coalesce(effective, logical, player_id) from ck_players2 where logical is not null) group by 1, 2
"""


def _identities(t):
    o = F.col("o_orderkey")
    role = F.when(o % 5 < 4, F.element_at(F.array(*map(F.lit, C.ROLES)), (F.least(o % 5, F.lit(3)) + 1).cast("int")))
    players = t.read("orders").select(
        F.col("o_custkey").alias("match_id"), o.alias("player_no"), F.concat(F.lit("P"), (o % 7).cast("string")).alias("player_id"), role.alias("logical"), F.when(o % 3 == 0, "PARTNER").alias("effective"))
    return K.identity_map(players)


@query("j14_identity_map", "select * from ck_idmap")
def j14(t):
    return _identities(t)


@query(
    "a32_corrected_match_metrics",
    """select r.match_id, rally_count, mean_duration_s, predicted_mean_duration_s, coalesce(shot_count, 0) as shot_count, coalesce(shot_count, 0) / rally_count as mean_length from (
      select match_id, count(*) as rally_count, avg(effective_end_s - effective_start_s) filter (where effective_end_s >= effective_start_s) as mean_duration_s, avg(end_s - start_s) as predicted_mean_duration_s from ck_crally group by 1) r
    left join (select match_id, count(*) as shot_count from fx_shots group by 1) s on s.match_id = r.match_id""",
    "mean_duration_s predicted_mean_duration_s mean_length",
)
def a32m(t):
    return K.match_metrics(K.corrected_rallies(t.star_rallies, t.corrections), K.corrected_shots(t.shots, t.corrections))


SHARED["ck_cid"] = "select s.match_id, s.shot_index, s.effective_type, coalesce(i.identity, s.effective_hitter) as who from ck_cshot s left join ck_idmap i on i.match_id = s.match_id and i.name = s.effective_hitter"


@query(
    "a32_corrected_player_metrics",
    """select g.match_id, g.player_id, g.shot_type, count(c.who) as hits, count(*) filter (where c.effective_type <> 'UNKNOWN') as classified, count(*) filter (where c.effective_type = g.shot_type) as n,
      case when count(*) filter (where c.effective_type <> 'UNKNOWN') > 0 then count(*) filter (where c.effective_type = g.shot_type) / count(*) filter (where c.effective_type <> 'UNKNOWN') end as rate
    from (select distinct match_id, player_id, k.shot_type from fx_shots cross join (select unnest(['ME','PARTNER','OPPONENT_1','OPPONENT_2']) as player_id) cross join (select unnest(['DINK','DROP','DRIVE','VOLLEY','OVERHEAD']) as shot_type) k) g
    left join ck_cid c on c.match_id = g.match_id and c.who = g.player_id group by 1, 2, 3""",
    "rate",
)
def a32p(t):
    return K.player_metrics(K.apply_identities(K.corrected_shots(t.shots, t.corrections), _identities(t)))


@query(
    "a32_corrected_tactical_metrics",
    """select *, case when classified > 0 then drops / classified end as drop_rate, case when classified > 0 then drives / classified end as drive_rate, case when pc > 0 then pd / pc end as predicted_drop_rate, case when pc > 0 then pv / pc end as predicted_drive_rate
    from (select match_id, count(*) filter (where shot_index = 3) as third_shots, count(*) filter (where shot_index = 3 and effective_type <> 'UNKNOWN') as classified, count(*) filter (where shot_index = 3 and effective_type = 'DROP') as drops,
     count(*) filter (where shot_index = 3 and effective_type = 'DRIVE') as drives, count(*) filter (where shot_index = 3 and shot_type <> 'UNKNOWN') as pc, count(*) filter (where shot_index = 3 and shot_type = 'DROP') as pd,
     count(*) filter (where shot_index = 3 and shot_type = 'DRIVE') as pv from ck_cshot group by 1)""",
    "drop_rate drive_rate predicted_drop_rate predicted_drive_rate",
)
def a32t(t):
    out = K.tactical_metrics(K.corrected_shots(t.shots, t.corrections))
    none = t.shots.filter("shot_index = 3").groupBy("match_id").agg(
        F.count_if(F.col("shot_type") != "UNKNOWN").alias("pc"), F.count_if(F.col("shot_type") == "DROP").alias("pd"), F.count_if(F.col("shot_type") == "DRIVE").alias("pv"))
    return out.join(none, "match_id", "left").fillna(0, ["pc", "pd", "pv"])


@query("d9_revision_history", "select match_id, correction_id, revision + 1 as entries, corrected_at as last_at from (select distinct match_id, correction_id, revision, corrected_at from fx_corrections)")
def d9(t):
    c = t.corrections.select("match_id", "correction_id", "revision", "corrected_at").distinct()
    old = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("revision")), lambda r: F.struct(r.alias("revision"), (F.col("corrected_at") - r).alias("at")))
    out = K.append_history(c.withColumn("history", old), [(F.col("revision") + 1).alias("revision"), F.col("corrected_at").alias("at")])
    return out.select("match_id", "correction_id", F.size("history").cast("bigint").alias("entries"), F.element_at("history", -1)["at"].alias("last_at"))


# --- datasets ---------------------------------------------------------------

CLIP = "select source as source_id, doc_id as clip_id, (doc_id % 300) * 3e0 + (n_chars % 10) / 1e1 as start_s, (doc_id % 300) * 3e0 + (n_chars % 10) / 1e1 + 1e0 + (n_chars % 7) / 3e0 as end_s from {documents}"
SHARED["ck_clip"] = CLIP.format(documents="documents")
SHARED["ck_cf"] = "select source_id, clip_id, u.frame, u.frame - cast(greatest(0, ceil(start_s * 10 - 1e-9)) as bigint) as off from ck_clip, lateral (select unnest(range(cast(greatest(0, ceil(start_s * 10 - 1e-9)) as bigint), cast(ceil(end_s * 10 - 1e-9) as bigint))) as frame) u"


def _clip_frames(t):
    return DS.clip_frames(t.spark.sql(CLIP, documents=t.read("documents")), 10.0)


@query("d1_clip_frames", "select source_id, clip_id, count(*) as frames, min(frame) as first_frame, max(frame) as last_frame from ck_cf group by 1, 2")
def d1(t):
    return _clip_frames(t).groupBy("source_id", "clip_id").agg(F.count("*").alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


@query("d1_clip_overlaps", "select source_id, frame, count(*) as clips from ck_cf group by 1, 2 having count(*) > 1")
def d1o(t):
    return DS.overlapping_frames(_clip_frames(t))


@query("d2_cadence_sample", "select source_id, clip_id, frame from ck_cf where off % 5 = 0")
def d2(t):
    return DS.every_nth(_clip_frames(t), 5).select("source_id", "clip_id", "frame")


@query("d3_seeded_sample", "select source_id, clip_id, frame from (select *, row_number() over (partition by source_id order by md5(concat_ws(':', '42', cast(clip_id as varchar), cast(frame as varchar)))) as rn from ck_cf) where rn <= 25")
def d3(t):
    return DS.sample_exactly(_clip_frames(t), ["source_id"], 25, 42, "clip_id", "frame").select("source_id", "clip_id", "frame")


@query("d4_uniform_indices", "select match_id, s.sample, cast(floor((s.sample * (n - 1) + 4) / 9) as bigint) as frame, null as violation from (select c_custkey as match_id, c_custkey % 977 as n from customer) cross join (select unnest(range(0, 10)) as sample) s where n >= 10 union all select c_custkey, null, null, 'fewer_frames_than_samples' from customer where c_custkey % 977 < 10")
def d4(t):
    m = t.read("customer").select(F.col("c_custkey").alias("match_id"), (F.col("c_custkey") % 977).alias("frame_count"))
    return DS.uniform_indices(m, 10)


SHARED["ck_units"] = "select concat(source_id, ':', clip_id) as unit, count(*) as size from fx_dataset_frames group by 1"
SHARED["ck_unitn"] = "select *, row_number() over (order by size desc, md5(concat_ws(':', '7', unit))) as i, sum(size) over () as total from ck_units"
_ERR = lambda a, b, c: f"(abs(c0 + {a} - 70e-2 * u.total) + abs(c1 + {b} - 15e-2 * u.total) + abs(c2 + {c} - 15e-2 * u.total))"
_E0, _E1, _E2 = _ERR("u.size", 0, 0), _ERR(0, "u.size", 0), _ERR(0, 0, "u.size")
SHARED["ck_assign"] = f"""
select cast(0 as bigint) as i, cast(null as varchar) as unit, cast(0 as bigint) as size, cast(0 as hugeint) as c0, cast(0 as hugeint) as c1, cast(0 as hugeint) as c2, -1 as s
union all select i, unit, size, c0 + case when p = 0 then size else 0 end, c1 + case when p = 1 then size else 0 end, c2 + case when p = 2 then size else 0 end, p from (
 select u.i, u.unit, u.size, a.c0, a.c1, a.c2, case when {_E0} <= {_E1} and {_E0} <= {_E2} then 0 when {_E1} <= {_E2} then 1 else 2 end as p from ck_assign a join ck_unitn u on u.i = a.i + 1)
"""


@query("d5_leakage_safe_split", "select unit, size, case s when 0 then 'train' when 1 then 'validation' else 'test' end as split from ck_assign where unit is not null")
def d5(t):
    unit = F.concat(F.coalesce("source_id", F.lit("")), F.lit(":"), F.coalesce("clip_id", F.lit("")))
    return DS.assign_splits(t.dataset_frames, unit, (0.70, 0.15, 0.15), 7, stepwise=True)


@query("d6_split_leaks", "select source_id as unit, count(distinct case when n_chars % 10 < 7 then 'train' when n_chars % 10 < 8 then 'validation' else 'test' end) as splits from fx_dataset_frames group by 1 having splits > 1")
def d6(t):
    r = F.col("n_chars") % 10
    return Q.split_leaks(t.dataset_frames.select(F.col("source_id").alias("unit"), F.when(r < 7, "train").when(r < 8, "validation").otherwise("test").alias("split")))


SHARED["ck_drec"] = "select source_id as video_id, clip_id as kind, record_id as target_id, label_group as value from fx_dataset_frames"
SHARED["ck_dcor"] = """
select record_id * 10 + j as correction_id, source_id as video_id, case when record_id % 17 = 0 then 'xx' else clip_id end as kind, record_id as target_id, case when record_id % 4 = 1 then 'clear_ball' else label_group end as expected, 'hard_negative' as replacement
from fx_dataset_frames cross join (select unnest([0, 1]) as j) where record_id % 3 = 0 and (j = 0 or record_id % 9 = 0)
"""


def _dataset_corrections(t):
    f = t.dataset_frames
    records = f.select(F.col("source_id").alias("video_id"), F.col("clip_id").alias("kind"), F.col("record_id").alias("target_id"), F.col("label_group").alias("value"))
    r = F.col("record_id")
    c = f.filter(r % 3 == 0).withColumn("j", F.explode(F.when(r % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    c = c.select(
        (r * 10 + F.col("j")).alias("correction_id"), F.col("source_id").alias("video_id"), F.when(r % 17 == 0, "xx").otherwise(F.col("clip_id")).alias("kind"), r.alias("target_id"),
        F.when(r % 4 == 1, "clear_ball").otherwise(F.col("label_group")).alias("expected"), F.lit("hard_negative").alias("replacement"))
    return DS.apply_dataset_corrections(records, c)


SHARED["ck_djudge"] = """
select c.*, r.value as have, case when count(*) over (partition by c.video_id, c.kind, c.target_id) > 1 then 'duplicate_target' when r.value is null then 'target_missing' when c.expected <> r.value then 'expected_differs' end as reason
from ck_dcor c left join ck_drec r on r.video_id = c.video_id and r.kind = c.kind and r.target_id = c.target_id
"""


@query("d7_corrected_records", "select r.video_id, r.kind, r.target_id, coalesce(j.replacement, r.value) as value, j.correction_id as reference from ck_drec r left join ck_djudge j on j.video_id = r.video_id and j.kind = r.kind and j.target_id = r.target_id and j.reason is null")
def d7(t):
    return _dataset_corrections(t)[0]


@query("d7_correction_audit", "select correction_id, video_id, kind, target_id, have as before, replacement as after from ck_djudge where reason is null")
def d7a(t):
    return _dataset_corrections(t)[1]


@query("d7_correction_violations", "select correction_id, reason from ck_djudge where reason is not null")
def d7v(t):
    return _dataset_corrections(t)[2]


@query(
    "j11_split_integrity",
    """select record_id, 'not_in_manifest' as reason from fx_dataset_frames where record_id % 19 = 0 union all select record_id, 'no_review' from fx_dataset_frames where quality is null
    union all select record_id, 'not_reviewed' from fx_dataset_frames where quality is not null and toxic = 1""",
)
def j11(t):
    f = t.dataset_frames
    reviews = f.filter("quality is not null").select("record_id", F.when(F.col("toxic") == 1, "open").otherwise("reviewed").alias("status"))
    return DS.integrity_violations(f.select("record_id"), f.filter("record_id % 19 <> 0"), reviews)


SHARED["ck_rsh"] = "select match_id % 4 as source_hash, event_id as shot_id, t_s as shot_s from fx_predicted"
SHARED["ck_rrv"] = "select match_id % 4 as source_hash, event_id as review_id, t_s as review_s from fx_truth"
OV = greedy_sql("select s.source_hash as match_id, s.shot_id as a, r.review_id as b, s.shot_s as d, 0 as s from ck_rsh s join ck_rrv r on r.source_hash = s.source_hash and abs(s.shot_s - r.review_s) <= 25e-2").replace(
    "order by d, s desc, a, b)", "order by d, a, e, b)").replace("0 as s from", "abs(s.shot_s - r.review_s) as e from").replace("'d': d}", "'d': e}")


@query("j9_review_overlay", f"select match_id as source_hash, m.a as shot_id, m.b as review_id, m.d as delta_s from ({OV})", "delta_s")
def j9(t):
    shots = t.predicted.select((F.col("match_id") % 4).alias("source_hash"), F.col("event_id").alias("shot_id"), F.col("t_s").alias("shot_s"))
    reviews = t.truth.select((F.col("match_id") % 4).alias("source_hash"), F.col("event_id").alias("review_id"), F.col("t_s").alias("review_s"))
    return DS.overlay_reviews(shots, reviews).select("source_hash", "shot_id", "review_id", "delta_s")


SHARED["ck_rev"] = "select case when record_id % 10 < 7 then 'train' when record_id % 10 < 8 then 'validation' else 'test' end as split, case when quality is null then 'unreviewed' else 'reviewed' end as status, coalesce(quality, 0) as objects, n_chars % 3 as suggestions, (n_chars % 97) / 97e0 as max_suggestion from fx_dataset_frames"


@query(
    "a30_review_progress",
    "select split, count(*) as total, count(*) filter (where status = 'reviewed') as reviewed, count(*) filter (where status = 'reviewed' and objects > 0) as positive, count(*) filter (where status = 'reviewed' and objects = 0) as negative, "
    "count(*) filter (where suggestions > 0) as with_suggestions, max(max_suggestion) as max_suggestion from ck_rev group by 1",
    "max_suggestion",
)
def a30(t):
    r = F.col("record_id") % 10
    f = t.dataset_frames.select(
        F.when(r < 7, "train").when(r < 8, "validation").otherwise("test").alias("split"), F.when(F.col("quality").isNull(), "unreviewed").otherwise("reviewed").alias("status"),
        F.coalesce("quality", F.lit(0)).alias("objects"), (F.col("n_chars") % 3).alias("suggestions"), ((F.col("n_chars") % 97) / 97).alias("max_suggestion"))
    return DS.review_progress(f)



SHARED["ck_lc"] = "select case when match_id % 10 < 7 then 'train' when match_id % 10 < 9 then 'validation' else 'test' end as split, shot_type, rally_id % 3 <> 0 as anchored, match_id % 4 = 0 as human from fx_shots where shot_index <> 5 or shot_type <> 'DINK'"
SHARED["ck_axes"] = """
select split, unnest(['phase', 'contact_mode', 'stroke_side', 'intent']) as axis, unnest([case when shot_type in ('SERVE', 'RETURN') then shot_type when anchored then 'RALLY' else 'UNKNOWN' end,
  case when shot_type in ('VOLLEY', 'OVERHEAD') then shot_type else 'UNKNOWN' end, 'UNKNOWN', case when shot_type in ('DINK', 'DROP', 'DRIVE', 'OTHER') then shot_type else 'UNKNOWN' end]) as label from ck_lc
"""


def _contact_labels(t):
    m = F.col("match_id")
    return t.shots.filter("shot_index <> 5 or shot_type <> 'DINK'").select(
        F.when(m % 10 < 7, "train").when(m % 10 < 9, "validation").otherwise("test").alias("split"), "shot_type", (F.col("rally_id") % 3 != 0).alias("rally_anchored"), (m % 4 == 0).alias("human_review"))


@query("a31_axis_support", "select split, axis, label, count(*) as n from ck_axes group by 1, 2, 3")
def a31(t):
    return DS.axis_support(_contact_labels(t))


@query(
    "a31_training_blockers",
    """select case split when 'validation' then 'VALIDATION_NOT_HUMAN_ACCEPTED' else 'TEST_NOT_HUMAN_ACCEPTED' end as code, cast(null as varchar) as axis, cast(null as varchar) as label, split as partition, a as actual, n as required
      from (select split, count(*) as n, count(*) filter (where human) as a from ck_lc group by 1) where split <> 'train' and a <> n
    union all select 'NO_HUMAN_ACCEPTED_TRAINING_LABELS', null, null, split, a, n from (select split, count(*) as n, count(*) filter (where human) as a from ck_lc group by 1) where split = 'train' and a = 0
    union all select case p.split when 'train' then 'INSUFFICIENT_TRAIN_CLASS_SUPPORT' else 'INSUFFICIENT_HELD_OUT_CLASS_SUPPORT' end, c.axis, c.label, p.split, coalesce(n.n, 0), case p.split when 'train' then 4000 else 900 end
     from (select distinct axis, label from ck_axes where split = 'train' and label <> 'UNKNOWN') c cross join (select unnest(['train', 'validation', 'test']) as split) p
     left join (select split, axis, label, count(*) as n from ck_axes group by 1, 2, 3) n on n.split = p.split and n.axis = c.axis and n.label = c.label
     where coalesce(n.n, 0) < case p.split when 'train' then 4000 else 900 end""",
)
def a31b(t):
    return DS.training_blockers(_contact_labels(t), 4000, 900)


@query("o2_violation_union", "select kind, count(*) as n from (select 'batch' as kind from (select l_orderkey from lineitem group by 1 having count(*) > 1) union all select 'correction' from ck_djudge where reason is not null) group by 1")
def o2(t):
    a = ST.batch_duplicates(t.read("lineitem").select(F.col("l_orderkey").alias("id")), "id").select(F.lit("batch").alias("kind"))
    b = _dataset_corrections(t)[2].select(F.lit("correction").alias("kind"))
    return a.unionByName(b).groupBy("kind").agg(F.count("*").alias("n"))


@query("a33_manifest_counts", "select source_id, label_group, count(*) as frames, count(distinct clip_id) as clips from fx_dataset_frames group by 1, 2")
def a33(t):
    return DS.manifest_counts(t.dataset_frames)


SHARED["ck_pf"] = "select match_id, frame, count(*) as n from fx_persons where confidence >= 7e-1 group by 1, 2"


@query(
    "a33_detection_statistics",
    """select m.match_id, cast(100 as bigint) as frame_count, coalesce(d, 0) as detections, coalesce(w, 0) as frames_with, 100 - coalesce(w, 0) as frames_without, coalesce(d, 0) / 100 as mean_per_frame, coalesce(mx, 0) as max_per_frame,
      case when coalesce(w, 0) < 100 then 0 else mn end as min_per_frame, min_confidence, mean_confidence, max_confidence
    from (select distinct match_id from fx_persons) m left join (select match_id, cast(sum(n) as bigint) as d, count(*) as w, max(n) as mx, min(n) as mn from ck_pf group by 1) f on f.match_id = m.match_id
    left join (select match_id, min(confidence) as min_confidence, avg(confidence) as mean_confidence, max(confidence) as max_confidence from fx_persons where confidence >= 7e-1 group by 1) c on c.match_id = m.match_id""",
    "mean_per_frame min_confidence mean_confidence max_confidence",
)
def a33d(t):
    matches = t.persons.select("match_id").distinct().withColumn("frame_count", F.lit(100).cast("bigint"))
    return DS.detection_statistics(t.persons.filter("confidence >= 0.7"), matches)


@query(
    "w22_training_windows",
    "select match_id, role, frame, h as first_history, f as last_future from (select match_id, role, frame, frame as h, lead(frame, 11) over (partition by match_id, role order by frame) as f from fx_raw_positions) where f is not null",
)
def w22(t):
    rows = t.raw_positions.select("match_id", "role", "frame", F.col("frame").alias("features"))
    out = DS.sliding_windows(rows, ["match_id", "role"], "frame", 8, 4)
    return out.select("match_id", "role", "frame", F.col("history")[0].alias("first_history"), F.col("future")[3].alias("last_future"))


# --- labels and text --------------------------------------------------------


@query(
    "e20_axes_from_label",
    "select distinct shot_type, anchored, case when shot_type in ('SERVE', 'RETURN') then shot_type when anchored then 'RALLY' else 'UNKNOWN' end as phase, case when shot_type in ('VOLLEY', 'OVERHEAD') then shot_type else 'UNKNOWN' end as contact_mode, "
    "'UNKNOWN' as stroke_side, case when shot_type in ('DINK', 'DROP', 'DRIVE', 'OTHER') then shot_type else 'UNKNOWN' end as intent from ck_lc",
)
def e20(t):
    rows = _contact_labels(t).select("shot_type", F.col("rally_anchored").alias("anchored")).distinct()
    return TX.axes_from_legacy(rows, "shot_type", "anchored")


def _decision_sql(name: str, labels: tuple, lo: int, threshold: str) -> str:
    known = [x for x in labels if x != "UNKNOWN"]
    arr = ", ".join(f"{{'n': -exp(cast(embedding[{lo + i}] as double)), 'l': '{x}'}}" for i, x in enumerate(known))
    return f"list_sort([{arr}]) as {name}_r, list_sum(list_transform([{arr}], lambda s: -s.n)) as {name}_t"


KNOWN = {"phase": TX.PHASES[:-1], "contact_mode": TX.CONTACT_MODES[:-1], "stroke_side": TX.STROKE_SIDES[:-1], "intent": TX.INTENTS[:-1]}
FROM = {"phase": 1, "contact_mode": 4, "stroke_side": 7, "intent": 10}
TH = {"phase": 0.38, "contact_mode": 0.38, "stroke_side": 0.38, "intent": 0.17}
SHARED["ck_dec0"] = "select vec_id, " + ", ".join(_decision_sql(a, KNOWN[a], FROM[a], "") for a in TX.AXES) + " from fx_vectors"
SHARED["ck_dec"] = "select vec_id, " + ", ".join(
    f"{a}_r[1].l as {a}_best, -{a}_r[1].n / {a}_t as {a}_confidence, case when -{a}_r[1].n / {a}_t < {TH[a]!r} then 'UNKNOWN' else {a}_r[1].l end as {a}_label, {a}_r[2].l as {a}_next" for a in TX.AXES) + " from ck_dec0"


def _decisions(t):
    rows = t.vectors
    for a in TX.AXES:
        part = F.transform(F.slice("embedding", FROM[a], len(KNOWN[a])), lambda v: v.cast("double"))
        rows = rows.withColumn(f"_{a}", DS.axis_decision(KNOWN[a], part, TH[a]))
    return rows


@query("e21_axis_decisions", "select * from ck_dec", " ".join(f"{a}_confidence" for a in TX.AXES))
def e21(t):
    rows = _decisions(t)
    cols = []
    for a in TX.AXES:
        d = F.col(f"_{a}")
        cols += [d["best_guess"].alias(f"{a}_best"), d["confidence"].alias(f"{a}_confidence"), d["authoritative"].alias(f"{a}_label"), d["alternatives"][0]["label"].alias(f"{a}_next")]
    return rows.select("vec_id", *cols)


def _legacy_sql(s: str) -> str:
    return (f"case when phase_{s} in ('SERVE', 'RETURN') then phase_{s} when contact_mode_{s} = 'OVERHEAD' then 'OVERHEAD' when intent_{s} in ('DINK', 'DROP', 'DRIVE') then intent_{s} "
            f"when contact_mode_{s} = 'VOLLEY' then 'VOLLEY' when phase_{s} = 'RALLY' and contact_mode_{s} <> 'UNKNOWN' and intent_{s} = 'OTHER' then 'OTHER' else 'UNKNOWN' end")


@query("e20_label_from_axes", f"select vec_id, {_legacy_sql('label')} as shot_type, {_legacy_sql('best')} as best_guess from ck_dec")
def e20b(t):
    rows = _decisions(t)
    pick = lambda f: TX.legacy_from_axes(F.col(f"_phase.{f}"), F.col(f"_contact_mode.{f}"), F.col(f"_intent.{f}"))
    return rows.select("vec_id", pick("authoritative").alias("shot_type"), pick("best_guess").alias("best_guess"))


@query(
    "e19_title_roster",
    """select match_id, case match_id % 8 when 0 then 'Ana,Bo,Cy,Dee' when 2 then 'Ana,Bo,Cy,Dee' end as names from fx_titles""",
)
def e19(t):
    return t.titles.select("match_id", F.array_join(roster(F.col("title")), ",").alias("names"))


@query(
    "e17_inference_tiles",
    "select match_id, y.i as row_ix, x.i as column_ix, x.v as tile_left, y.v as tile_top, x.v + 640 as tile_right, y.v + 640 as tile_bottom from ck_vid "
    "cross join (select unnest([0, 1, 2, 3]) as i, unnest([0, 512, 1024, 1280]) as v) x cross join lateral (select unnest([0, 1]) as i, unnest([0, height - 640]) as v) y",
)
def e17(t):
    events = t.read("events")
    videos = t.spark.sql(VID, events=events)
    return RG.tiles(RG.full_frame(videos), 640, 0.2)


@query("e17_court_roi", "select match_id, height, cast(360 as bigint) as \"left\", cast(310 as bigint) as top, cast(least(1920, 1560) as bigint) as \"right\", cast(least(height, 990) as bigint) as bottom from ck_vid")
def e17r(t):
    return RG.court_roi(t.spark.sql(VID, events=t.read("events")), CORNERS, 40).select("match_id", "height", "left", "top", "right", "bottom")


@query(
    "e18_crop_to_source",
    "select frame_id, box_id, l2 + cl as l, t2 as t, r2 + cl as r, b2 as b from (select *, least(greatest(l - 200, 0e0), 600e0) as l2, least(greatest(t, 0e0), 640e0) as t2, least(greatest(r - 200, 0e0), 600e0) as r2, least(greatest(b, 0e0), 640e0) as b2, crop_id * 320 as cl from fx_boxes) where r2 > l2 and b2 > t2",
    "l t r b",
)
def e18(t):
    b = t.boxes.withColumn("l", F.col("l") - 200).withColumn("r", F.col("r") - 200)
    b = b.withColumns({"cl": F.col("crop_id") * 320, "ct": F.lit(0), "cw": F.lit(600), "ch": F.lit(640)})
    return RG.to_source(b, "cl", "ct", "cw", "ch").select("frame_id", "box_id", "l", "t", "r", "b")


IOU1 = "greatest(0, least(a.r, x[1].r) - greatest(a.l, x[1].l)) * greatest(0, least(a.b, x[1].b) - greatest(a.t, x[1].t))"
SHARED["ck_nmsk"] = f"""
select frame_id, unnest(kept) as k from (select frame_id, list_reduce(list([{{'id': box_id, 'l': l, 't': t, 'r': r, 'b': b}}] order by confidence desc, box_id),
 lambda acc, x: case when len(list_filter(acc, lambda a: {IOU1} >= 3e-1 * ((a.r - a.l) * (a.b - a.t) + (x[1].r - x[1].l) * (x[1].b - x[1].t) - {IOU1}))) > 0 then acc else list_concat(acc, x) end) as kept from fx_boxes group by 1)
"""


@query("f1_cross_crop_nms", "select frame_id, k.id as box_id from ck_nmsk")
def f1(t):
    merged = RG.merge_crops(t.boxes, 0.3)
    return RG.kept_boxes(merged).select("frame_id", F.col("keeper_id").alias("box_id"))


SHARED["ck_rk"] = "select *, row_number() over (partition by l_orderkey order by m, v[1], v[2], v[11]) as rn from (select l_orderkey, (l_quantity * 20 + 2) as m, [l_quantity * 20 / 1920, l_extendedprice % 700 / 1080] || list_transform(range(1, 5), lambda i: 0e0) || [0e0, 0e0, 0e0, 0e0, 2e-1 + 8e0 * l_discount + (l_partkey % 97) / 1e5, 1e0] as v from lineitem)"


@query(
    "e23_racket_features",
    """select coalesce(o_orderkey, k) as match_id, cast(0 as bigint) as frame, case when o_orderkey % 2 = 1 then o_totalprice / 300 / 1920 else 0 end as v0, case when o_orderkey % 2 = 1 then 500e0 / 1080 else 0 end as v1,
      case when o_orderkey % 2 = 1 then 1e0 else 0 end as v2, 8e-1 as v3, coalesce(a[1], 0) as v4, coalesce(a[11], 0) as v14, coalesce(a[12], 0) as v15, coalesce(b[1], 0) as v16, coalesce(b[12], 0) as v27
    from orders left join (select l_orderkey as k, any_value(v) filter (where rn = 1) as a, any_value(v) filter (where rn = 2) as b from ck_rk group by 1) r on r.k = o_orderkey""",
    "v0 v1 v2 v3 v4 v14 v15 v16 v27",
)
def e23(t):
    rows = t.boxes.select(
        F.col("frame_id").alias("match_id"), F.lit(0).cast("bigint").alias("frame"), "box_id",
        F.struct(F.array(*[F.array(F.col("l") + i, F.col("t") + i) for i in range(5)]).alias("keypoints"), F.array("confidence").alias("keypoint_scores")).alias("r"))
    rackets = rows.groupBy("match_id", "frame").agg(F.array_sort(F.collect_list(F.struct("box_id", "r"))).alias("s")).withColumn("rackets", F.transform("s", lambda s: s["r"]))
    ball = t.read("orders").select(F.col("o_orderkey").alias("match_id"), F.lit(0).cast("bigint").alias("Frame"), (F.col("o_totalprice") / 300).alias("X"), F.lit(500.0).alias("Y"), (F.col("o_orderkey") % 2).cast("double").alias("Visibility"), F.lit(0.8).alias("Confidence"))
    out = RP.features(ball, rackets, ["match_id"])
    return out.select("match_id", "frame", *[F.round(F.col("features")[i], 6).alias(f"v{i}") for i in (0, 1, 2, 3, 4, 14, 15, 16, 27)])


@query("p4_accepted_events", "select match_id, event_id from fx_predicted where fused >= 8e-1")
def p4(t):
    return t.predicted.filter(F.col("fused") >= 0.8).select("match_id", "event_id")


