"""Contacts, rallies and bounces joined into classified shots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions import geometry as G
from courtflow.functions.sequences import CHUNK_FRAMES, interval_join, last_before, running_count
from courtflow.session import cut_lineage

BUCKET = 1024
IN_RALLY = ("match_id", "rally_id")


def shot_frames(contacts: DataFrame, rallies: DataFrame) -> DataFrame:
    """Contacts inside rallies with their index and last frame.

    A shot ends at the rally's next contact, or with the rally. A rally lasts
    seconds, so its contacts fit one window.
    """
    points = contacts.drop("rally_id") if "rally_id" in contacts.columns else contacts
    bounds = rallies.select("match_id", "rally_id", "start_frame", F.col("end_frame").alias("rally_end"), F.col("confidence").alias("rally_confidence"))
    rows = interval_join(points, bounds, ["match_id"], "frame", "start_frame", "rally_end", BUCKET)
    w = W.partitionBy(*IN_RALLY).orderBy("frame")
    rows = rows.withColumn("shot_index", F.row_number().over(w).cast("bigint")).withColumn("next_frame", F.lead("frame").over(w))
    return rows.withColumn("end_frame", F.greatest("frame", F.coalesce("next_frame", "rally_end"))).drop("start_frame")


def first_bounce(shots: DataFrame, bounces: DataFrame) -> DataFrame:
    """First bounce after the contact: before the next contact, or up to the rally's end."""
    b = bounces.select("match_id", F.col("frame").alias("b_frame"), "bounce_id", "court_x_m", "court_y_m")
    spans = shots.select("match_id", "frame", "end_frame", "next_frame")
    hits = interval_join(b, spans, ["match_id"], "b_frame", "frame", "end_frame", BUCKET)
    hits = hits.filter((F.col("b_frame") > F.col("frame")) & (F.col("next_frame").isNull() | (F.col("b_frame") < F.col("end_frame"))))
    first = hits.groupBy("match_id", "frame").agg(F.min_by(F.struct("bounce_id", "b_frame", "court_x_m", "court_y_m"), F.struct("b_frame", "bounce_id")).alias("b"))
    return shots.join(first, ["match_id", "frame"], "left").select(
        shots["*"], F.col("b.bounce_id").alias("bounce_id"), F.col("b.b_frame").alias("bounce_frame"),
        F.col("b.court_x_m").alias("landing_x_m"), F.col("b.court_y_m").alias("landing_y_m"))


def linked_speeds(track: DataFrame, video: C.Video, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Known frames with the speed from the known frame before, if in the same segment."""
    known = track.filter("x_px is not null").select("match_id", "frame", "t_s", "segment_id", "x_px", "y_px")
    rows = last_before(known, ("match_id",), "frame", F.struct("frame", "t_s", "segment_id", "x_px", "y_px"), chunk, "_p")
    dt = F.col("t_s") - F.col("_p.t_s")
    speed = G.distance("x_px", "y_px", "_p.x_px", "_p.y_px") / (video.diagonal * dt)
    ok = (F.col("segment_id") == F.col("_p.segment_id")) & (dt > 0)
    return rows.select("match_id", "frame", F.col("_p.frame").alias("from_frame"), F.when(ok, speed).alias("speed"))


def trajectory_summary(shots: DataFrame, track: DataFrame, video: C.Video, chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Counts, end points, initial and peak speed of the ball during each shot."""
    speeds = linked_speeds(track, video, chunk)
    frames = track.select("match_id", F.col("frame").alias("f"), "status", "x_px", "y_px", "segment_id").join(
        speeds.withColumnRenamed("frame", "f"), ["match_id", "f"], "left")
    spans = shots.select("match_id", "frame", "end_frame")
    seen = interval_join(frames, spans, ["match_id"], "f", "frame", "end_frame", BUCKET)
    known = F.col("x_px").isNotNull()
    speed = F.when(F.col("from_frame") >= F.col("frame"), F.col("speed"))
    stats = seen.groupBy("match_id", "frame").agg(
        F.count_if(F.col("status") == "OBSERVED").alias("observed"),
        F.count_if(F.col("status") == "INTERPOLATED").alias("interpolated"),
        F.count_if(F.col("status") == "UNKNOWN").alias("unknown"),
        F.count("*").alias("frames"),
        F.min_by(F.struct("x_px", "y_px"), F.when(known, F.col("f"))).alias("first"),
        F.max_by(F.struct("x_px", "y_px"), F.when(known, F.col("f"))).alias("last"),
        F.min_by(speed, F.when(speed.isNotNull(), F.col("f"))).alias("initial_speed"),
        F.max(speed).alias("peak_speed"),
        F.array_sort(F.collect_set("segment_id")).alias("segments"),
    )
    stats = stats.withColumn("known_points", F.col("observed") + F.col("interpolated"))
    return stats.withColumn("known_fraction", F.col("known_points") / F.col("frames"))


def height_ratio(y: str, t: str, b: str) -> Column:
    return F.when(F.col(b) - F.col(t) > 0, (F.col(y) - F.col(t)) / (F.col(b) - F.col(t)))


def classify(features: DataFrame, s: C.ShotSettings = C.ShotSettings()) -> DataFrame:
    """Shot class and confidence by ordered rules over one row per shot.

    Only the shot before in the rally matters: whether it bounced, and whether it
    was a serve, which itself never depends on an earlier shot.
    """
    w = W.partitionBy(*IN_RALLY).orderBy("shot_index")
    missing = (
        (F.col("hitter_id") == C.UNKNOWN) | (F.col("hitter_confidence") < s.min_hitter) | F.col("hitter_y_m").isNull()
        | (F.col("known_fraction") < s.min_coverage) | (F.col("known_points") < s.min_points) | F.col("initial_speed").isNull()
    )
    rows = features.withColumn("depth_m", G.side_setback("hitter_y_m", "hitter_side"))
    rows = rows.withColumn("_missing", F.coalesce(missing, F.lit(True)) | F.col("depth_m").isNull())
    bounced = F.col("bounce_id").isNotNull()
    serve = ~F.col("_missing") & (F.col("shot_index") == 1) & bounced & (F.col("depth_m") >= s.serve_depth_m)
    rows = rows.withColumn("_serve", serve).withColumn("_bounced", bounced)
    rows = rows.withColumn("_after_serve", F.coalesce(F.lag("_serve").over(w) & F.lag("_bounced").over(w), F.lit(False)))
    rows = rows.withColumn("_incoming", F.coalesce(F.lag("_bounced").over(w), F.lit(False)))
    rows = rows.withColumn("in_opponent_kitchen", G.lands_in_opponent_kitchen("landing_y_m", "hitter_side"))
    v, d, late = F.col("initial_speed"), F.col("depth_m"), (F.col("shot_index") > 2) & ~F.col("_incoming")
    soft = F.coalesce(F.col("in_opponent_kitchen"), F.lit(False))
    share = lambda x, y: G.cap1(x / y)
    rules = [
        ("SERVE", F.col("_serve"), share(d, s.serve_depth_m)),
        ("RETURN", (F.col("shot_index") == 2) & F.col("_after_serve"), F.lit(1.0)),
        ("OVERHEAD", late & (F.col("height_ratio") <= s.overhead_height) & (v >= s.overhead_speed), share(v, s.overhead_speed)),
        ("DINK", soft & (d <= s.kitchen_proximity_m) & (v <= s.dink_speed), 1 - share(v, s.dink_speed)),
        ("DROP", soft & (d >= s.drop_depth_m) & (v <= s.drop_speed), share(d, s.drop_depth_m)),
        ("VOLLEY", late & (d <= s.kitchen_proximity_m), 1 - share(d, s.kitchen_proximity_m)),
        ("DRIVE", v >= s.drive_speed, share(v, s.drive_speed)),
    ]
    kind = F.when(F.col("_missing"), C.UNKNOWN)
    strength = F.when(F.col("_missing"), F.lit(None).cast("double"))
    for name, cond, power in rules:
        cond = F.coalesce(cond, F.lit(False))
        kind, strength = kind.when(cond, name), strength.when(cond, power)
    rows = rows.withColumn("shot_type", kind.otherwise("OTHER")).withColumn("rule_strength", strength.otherwise(0.5))
    base = F.least("visual", "hitter_confidence", F.greatest(F.lit(s.min_coverage), F.col("known_fraction")))
    have = lambda c: F.when(c, 1.0).otherwise(0.0)
    evidence = F.least(
        have(F.col("hitter_id") != C.UNKNOWN), have(F.col("hitter_y_m").isNotNull()), have(v.isNotNull()),
        F.col("hitter_confidence") / s.min_hitter, F.col("known_fraction") / s.min_coverage, F.col("known_points") / s.min_points)
    clip = lambda c: F.greatest(F.lit(0.0), G.cap1(c))
    confidence = F.when(F.col("_missing"), 1 - clip(evidence)).otherwise(clip(base * (0.70 + 0.30 * F.col("rule_strength"))))
    return rows.withColumn("confidence", confidence).drop("_missing", "_serve", "_bounced", "_after_serve", "_incoming")


def reconstruct(
    track: DataFrame,
    rallies: DataFrame,
    contacts: DataFrame,
    bounces: DataFrame,
    hitters: DataFrame,
    boxes: DataFrame,
    positions: DataFrame,
    video: C.Video,
    s: C.ShotSettings = C.ShotSettings(),
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Shots of all matches from accepted contacts.

    ``bounces`` has bounce_id, frame, court_x_m, court_y_m; ``positions`` has a court
    point (px_m, py_m) and side per match, frame and role.
    """
    accepted = contacts.filter("accepted_fused").select("match_id", "frame", "t_s", "visual", "fused", F.col("y_px").alias("ball_y_px"))
    shots = cut_lineage(first_bounce(cut_lineage(shot_frames(accepted, rallies)), bounces))
    stats = trajectory_summary(shots, track, video, chunk)
    shots = shots.join(stats, ["match_id", "frame"])
    shots = shots.join(hitters.select("match_id", "frame", "hitter_id", "hitter_confidence"), ["match_id", "frame"], "left")
    shots = shots.withColumn("hitter_id", F.coalesce("hitter_id", F.lit(C.UNKNOWN))).withColumn("hitter_confidence", F.coalesce("hitter_confidence", F.lit(1.0)))
    who = positions.select("match_id", "frame", F.col("role").alias("hitter_id"), F.col("px_m").alias("hitter_x_m"), F.col("py_m").alias("hitter_y_m"), F.col("side").alias("hitter_side"))
    shots = shots.join(who, ["match_id", "frame", "hitter_id"], "left")
    body = boxes.select("match_id", "frame", F.col("role").alias("hitter_id"), F.col("t").alias("_t"), F.col("b").alias("_b"))
    shots = shots.join(body, ["match_id", "frame", "hitter_id"], "left").withColumn("height_ratio", height_ratio("ball_y_px", "_t", "_b")).drop("_t", "_b")
    out = classify(shots, s)
    return running_count(cut_lineage(out), ("match_id",), "frame", chunk, "shot_no")


def statistics(shots: DataFrame) -> DataFrame:
    return shots.groupBy("match_id").agg(
        F.count("*").alias("shots"), *[F.count_if(F.col("shot_type") == t).alias(t) for t in C.SHOT_TYPES],
        F.avg("confidence").alias("mean_confidence"))
