"""Bounces and paddle contacts from the ball timeline, fused with audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions import geometry as G
from courtflow.functions.sequences import CHUNK, CHUNK_FRAMES, home_rows, interval_join, last_before, spread_join, with_halo
from courtflow.operators.matching import suppress_near, time_matches
from courtflow.session import cut_lineage

KEYS = ("match_id",)


def frames_in(track: DataFrame) -> DataFrame:
    return track.groupBy("match_id").agg((F.max("frame") + 1).alias("frame_count"))


#: A radius of a match's own length, in the scale of ``in_radii``, and how far rounding may be off.
UNIT, SLACK = 10**6, 500


def in_radii(frame: str, radius: Column) -> Column:
    """A frame's place in steps of ``radius`` frames, ``UNIT`` each.

    Frames up to ``radius`` apart lie within ``UNIT + SLACK``, others beyond, for radii
    below 1,000 frames: a window of a constant range then has each match's own radius.
    """
    return F.round(F.col(frame) * F.lit(float(UNIT)) / radius).cast("bigint")


def local_shape(track: DataFrame, window: int | Column, least: int, chunk: int = CHUNK_FRAMES, reach: int | None = None) -> DataFrame:
    """Two-sided slopes, prominence and continuity at each known frame of a segment.

    All windows share one partitioning. Frames too near an end of the match, or
    with too few known neighbours on a side, are dropped.  A ``window`` that
    differs between matches is a column; ``reach`` is then the largest.
    """
    known = track.filter(F.col("x_px").isNotNull() & F.col("segment_id").isNotNull())
    if isinstance(window, int):
        reach, place, far, near = window, F.col("frame"), window, 1
    else:
        place, far, near = in_radii("frame", window), UNIT + SLACK, SLACK
    rows = with_halo(known, "frame", reach, reach, chunk)
    w = W.partitionBy(*KEYS, CHUNK, "segment_id").orderBy(place)
    before, after, around = w.rangeBetween(-far, 0), w.rangeBetween(0, far), w.rangeBetween(-far, far)
    strict_b, strict_a = w.rangeBetween(-far, -near), w.rangeBetween(near, far)
    slope = lambda c, over: F.coalesce(F.regr_slope(F.col(c), F.col("t_s")).over(over), F.lit(0.0))
    rows = rows.select(
        "*",
        F.count("*").over(strict_b).alias("n_before"), F.count("*").over(strict_a).alias("n_after"),
        slope("x_px", before).alias("bx"), slope("y_px", before).alias("by"),
        slope("x_px", after).alias("ax"), slope("y_px", after).alias("ay"),
        F.min("y_px").over(strict_b).alias("_minb"), F.min("y_px").over(strict_a).alias("_mina"),
        F.count("*").over(around).alias("_same"),
        F.count(F.when(F.col("status") == "OBSERVED", 1)).over(around).alias("_obs"),
    )
    rows = home_rows(rows).filter((F.col("n_before") >= least) & (F.col("n_after") >= least))
    rows = spread_join(rows, frames_in(track), KEYS)
    rows = rows.filter((F.col("frame") >= window) & (F.col("frame") < F.col("frame_count") - window)).drop("frame_count")
    return (
        rows.withColumn("prominence_px", F.col("y_px") - F.greatest("_minb", "_mina"))
        .withColumn("continuity", F.col("_same") / (2 * window + 1))
        .withColumn("observed_fraction", F.col("_obs") / F.col("_same"))
        .drop("_minb", "_mina", "_same", "_obs", "n_before", "n_after")
    )


def with_rally(points: DataFrame, rallies: DataFrame | None) -> DataFrame:
    """Left join of events with the first rally that holds their frame."""
    if rallies is None:
        return points.withColumn("rally_id", F.lit(None).cast("bigint")).withColumn("rally_confidence", F.lit(None).cast("double"))
    bounds = rallies.select("match_id", "start_frame", "end_frame", "rally_id", F.col("confidence").alias("rally_confidence"))
    joined = interval_join(points, bounds, ["match_id"], "frame", "start_frame", "end_frame", 2048, "left")
    first = F.row_number().over(W.partitionBy("match_id", "frame").orderBy("start_frame", "end_frame", "rally_id"))
    return joined.withColumn("_r", first).filter("_r = 1").drop("_r", "start_frame", "end_frame")


def bounce_candidates(
    track: DataFrame,
    video: C.Video | G.Camera,
    corners: list[tuple],
    homography: list,
    rallies: DataFrame | None = None,
    s: C.BounceSettings = C.BounceSettings(),
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Downward-then-upward turns in image space, scored; cheap gates come first.

    With a ``Camera``, ``track`` is ``calibrated`` and every match has its own
    window, size, corners and matrix; matches without calibration have no candidates.
    """
    window = video.frames(s.window_s, s.min_each_side)
    reach = video.reach(s.window_s, s.min_each_side) if isinstance(video, G.Camera) else None
    d = video.diagonal
    floor = s.min_vertical_speed * d
    rows = local_shape(track, window, s.min_each_side, chunk, reach)
    rows = rows.withColumn("reversal", (F.col("by") - F.col("ay")) / d).withColumn("prominence", F.col("prominence_px") / d)
    rows = rows.filter(
        (F.col("by") >= floor) & (F.col("ay") <= -floor) & (F.col("reversal") >= s.min_reversal)
        & (F.col("prominence") >= s.min_prominence) & (F.col("continuity") >= s.min_continuity)
    )
    rows = with_rally(rows, rallies).withColumn("inside_image", F.coalesce(G.in_convex("x_px", "y_px", corners), F.lit(False)))
    confidence = (
        0.27 * G.cap1(F.col("reversal") / (s.min_reversal * 3))
        + 0.18 * G.cap1(F.col("prominence") / (s.min_prominence * 3))
        + 0.13 * G.cap1(F.least(F.col("by"), -F.col("ay")) / (floor * 3))
        + 0.17 * F.col("continuity")
        + 0.10 * F.col("observed_fraction")
        + 0.10 * F.col("inside_image").cast("double")
        + 0.05 * F.when(F.col("status") == "OBSERVED", 1.0).otherwise(0.55)
        + F.coalesce(s.rally_boost * F.col("rally_confidence"), F.lit(0.0))
    )
    rows = rows.withColumn("visual", G.cap1(confidence)).filter(F.col("visual") >= s.min_candidate)
    cx, cy = G.project("x_px", "y_px", homography)
    land = F.col("inside_image") & (F.col("visual") >= s.min_projection) & G.in_court(cx, cy)
    rows = rows.withColumn("direction_deg", G.angle_degrees("bx", "by", "ax", "ay"))
    return rows.withColumn("court_x_m", F.when(land, cx)).withColumn("court_y_m", F.when(land, cy))


def fuse(visual: Column, audio: Column, weight: float) -> Column:
    return G.cap1(visual + weight * (1 - visual) * F.coalesce(audio, F.lit(0.0)))


def evidence(events: DataFrame, audio_matches: DataFrame, accepted: float, weight: float) -> DataFrame:
    """Fused confidence, acceptance flags and evidence mode; audio never adds a row."""
    out = events.join(audio_matches, ["match_id", "frame"], "left")
    out = out.withColumn("fused", fuse(F.col("visual"), F.col("audio_confidence"), weight))
    out = out.withColumn("accepted_visual", F.col("visual") >= accepted).withColumn("accepted_fused", F.col("fused") >= accepted)
    mode = F.when(~F.col("accepted_fused"), "LOW_CONFIDENCE").when(F.col("transient_id").isNotNull(), "VISUAL_PLUS_AUDIO").otherwise("VISUAL_ONLY")
    return out.withColumn("audio_confidence", F.coalesce("audio_confidence", F.lit(0.0))).withColumn("evidence_mode", mode)


def audio_matches(events: DataFrame, audio: DataFrame, tolerance_s: float) -> DataFrame:
    """Nearest free transient per event, and how much it supports the event."""
    points = events.select("match_id", "frame", "t_s", "visual")
    heard = audio.select("match_id", "transient_id", "video_s", F.col("confidence").alias("heard"))
    hits = time_matches(points, heard, ["match_id"], "frame", "transient_id", "t_s", "video_s", "heard", tolerance_s)
    support = F.col("heard") * (0.5 + 0.5 * (1 - F.col("delta_s") / tolerance_s))
    return hits.select("match_id", "frame", "transient_id", support.alias("audio_confidence"), F.col("delta_s").alias("audio_delta_s"))


def detect_bounces(
    track: DataFrame,
    video: C.Video | G.Camera,
    corners: list[tuple],
    homography: list,
    audio: DataFrame,
    rallies: DataFrame | None = None,
    s: C.BounceSettings = C.BounceSettings(),
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    raw = cut_lineage(bounce_candidates(track, video, corners, homography, rallies, s, chunk))
    apart = video.frames(s.spacing_s)
    if isinstance(apart, int):
        kept = suppress_near(raw, KEYS, "frame", "visual", apart, False, chunk)
    else:
        # Closer than the spacing is at most UNIT - UNIT / spacing in its own scale.
        raw = raw.withColumn("_place", in_radii("frame", apart))
        kept = suppress_near(raw, KEYS, "_place", "visual", UNIT - SLACK, False, chunk * UNIT // video.reach(s.spacing_s)).drop("_place")
    kept = cut_lineage(kept)
    return evidence(kept, audio_matches(kept, audio, s.tolerance_s), s.accepted, s.audio_weight)


def bounce_context(
    points: DataFrame,
    bounces: DataFrame,
    fps: float,
    exclusion_s: float,
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Bounce to relate an event to: the nearest one if coincident, else the last before.

    Adds bounce_frame, bounce_confidence, bounce_gap_s (negative for a later one)
    and coincident. Both directions are running lookups, not a join of all pairs.
    """
    marks = bounces.select("match_id", "frame", F.struct("frame", "confidence").alias("b"))
    at = points.select("match_id", "frame").distinct()
    both = at.withColumn("b", F.lit(None).cast(marks.schema["b"].dataType)).withColumn("_q", F.lit(1)).unionByName(marks.withColumn("_q", F.lit(0)))
    # A bounce on the event's own frame counts as one not after it: half a frame apart.
    both = both.withColumn("_pos", F.col("frame") * 2 + F.col("_q")).withColumn("_neg", -F.col("_pos"))
    both = last_before(both, KEYS, "_pos", F.col("b"), chunk * 2, "_prev")
    both = last_before(both, KEYS, "_neg", F.col("b"), chunk * 2, "_next").filter("_q = 1")
    exclusion = max(exclusion_s, 1.0 / fps)
    dp, dn = F.col("frame") - F.col("_prev.frame"), F.col("_next.frame") - F.col("frame")
    near = F.when(dn.isNull() | (dp <= dn), F.col("_prev")).otherwise(F.col("_next"))
    both = both.withColumn("_near", F.coalesce(near, F.col("_next")))
    hit = F.coalesce(F.abs(F.col("_near.frame") - F.col("frame")) / fps <= exclusion, F.lit(False))
    both = both.withColumn("coincident", hit)
    both = both.withColumn("_use", F.when(F.col("coincident"), F.col("_near")).otherwise(F.col("_prev")))
    out = both.select(
        "match_id", "frame", "coincident", F.col("_use.frame").alias("bounce_frame"),
        F.col("_use.confidence").alias("bounce_confidence"), ((F.col("frame") - F.col("_use.frame")) / fps).alias("bounce_gap_s"),
    )
    return points.join(out, ["match_id", "frame"])


def candidate_players(points: DataFrame, boxes: DataFrame, video: C.Video, max_fraction: float) -> DataFrame:
    """Players in an event's frame ranked by distance to the ball (at most four rows each)."""
    near = points.select("match_id", "frame", "x_px", "y_px").join(boxes, ["match_id", "frame"])
    near = near.withColumn("distance_px", G.box_distance("x_px", "y_px", "l", "t", "r_px", "b"))
    near = near.withColumn("inside", G.inside_box("x_px", "y_px", "l", "t", "r_px", "b"))
    near = near.withColumn("proximity", F.greatest(F.lit(0.0), 1 - F.col("distance_px") / (max_fraction * video.diagonal)))
    rank = F.row_number().over(W.partitionBy("match_id", "frame").orderBy("distance_px", "role"))
    return near.withColumn("rank", rank)


def contact_candidates(
    track: DataFrame,
    boxes: DataFrame,
    video: C.Video,
    bounces: DataFrame,
    rallies: DataFrame | None = None,
    s: C.ContactSettings = C.ContactSettings(),
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Velocity breaks away from bounces, scored with the nearest player."""
    window = max(s.min_each_side, round(s.window_s * video.fps))
    d = video.diagonal
    rows = local_shape(track, window, s.min_each_side, chunk)
    rows = rows.withColumn("velocity_change", G.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) / d)
    rows = rows.withColumn("direction_deg", G.angle_degrees("bx", "by", "ax", "ay"))
    sb, sa = G.hypot(F.col("bx"), F.col("by")) / d, G.hypot(F.col("ax"), F.col("ay")) / d
    rows = rows.withColumn("speed_ratio", F.greatest(sb, sa) / F.greatest(F.lit(1e-6), F.least(sb, sa)))
    rows = cut_lineage(rows.filter(
        (F.col("velocity_change") >= s.min_velocity_change)
        & ((F.col("direction_deg") >= s.min_direction_deg) | (F.col("speed_ratio") >= s.min_speed_ratio))
        & (F.col("continuity") >= s.min_continuity)
    ))
    rows = bounce_context(rows, bounces, video.fps, s.bounce_exclusion_s, chunk).filter(~F.col("coincident"))
    nearest = candidate_players(rows, boxes, video, s.max_proximity).filter("rank = 1").select(
        "match_id", "frame", F.col("role").alias("nearest_role"), "proximity", "tracking_confidence", F.col("region").alias("nearest_region"))
    rows = with_rally(rows.join(nearest, ["match_id", "frame"], "left"), rallies)
    close = F.coalesce(F.col("proximity") * F.col("tracking_confidence"), F.lit(0.0))
    court = F.when(F.col("nearest_region") == "inside", 1.0).when(F.col("nearest_region") == "near", 0.65).otherwise(0.0)
    recent = F.when(F.col("bounce_gap_s").between(0.10, s.max_bounce_gap_s), F.col("bounce_confidence")).otherwise(0.0)
    turn = F.greatest(G.cap1(F.col("direction_deg") / 90), G.cap1(F.greatest(F.lit(0.0), F.col("speed_ratio") - 1) / s.min_speed_ratio))
    visual = (
        0.28 * G.cap1(F.col("velocity_change") / (s.min_velocity_change * 3))
        + 0.20 * turn
        + 0.14 * F.col("continuity")
        + 0.09 * F.col("observed_fraction")
        + 0.05 * F.when(F.col("status") == "OBSERVED", 1.0).otherwise(0.55)
        + 0.17 * close
        + 0.04 * court
        + F.coalesce(s.rally_boost * F.col("rally_confidence"), F.lit(0.0))
        + s.bounce_boost * F.coalesce(recent, F.lit(0.0))
    )
    return rows.withColumn("visual", G.cap1(visual)).filter(F.col("visual") >= s.min_candidate).drop("coincident")


def detect_contacts(
    track: DataFrame,
    boxes: DataFrame,
    video: C.Video,
    bounces: DataFrame,
    audio: DataFrame,
    rallies: DataFrame | None = None,
    s: C.ContactSettings = C.ContactSettings(),
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    raw = cut_lineage(contact_candidates(track, boxes, video, bounces, rallies, s, chunk))
    kept = cut_lineage(suppress_near(raw, KEYS, "frame", "visual", C.frames_for(s.spacing_s, video.fps), True, chunk))
    fused = cut_lineage(evidence(kept, audio_matches(kept, audio, s.tolerance_s), s.accepted, s.audio_weight))
    previous = last_before(fused, KEYS, "frame", F.col("frame"), chunk, "previous_frame")
    return previous.withColumn("since_previous_s", (F.col("frame") - F.col("previous_frame")) / video.fps)


def stage_statistics(events: DataFrame) -> DataFrame:
    """Counts and mean confidences of one event stage per match."""
    n = F.count_if
    return events.groupBy("match_id").agg(
        F.count("*").alias("candidates"),
        n(F.col("accepted_visual")).alias("accepted_visual"),
        n(F.col("accepted_fused")).alias("accepted_fused"),
        n(F.col("transient_id").isNotNull()).alias("audio_matched"),
        n(F.col("evidence_mode") == "VISUAL_ONLY").alias("visual_only"),
        n(F.col("evidence_mode") == "VISUAL_PLUS_AUDIO").alias("visual_plus_audio"),
        n(F.col("evidence_mode") == "LOW_CONFIDENCE").alias("low_confidence"),
        F.avg("visual").alias("mean_visual"),
        F.avg("fused").alias("mean_fused"),
    )
