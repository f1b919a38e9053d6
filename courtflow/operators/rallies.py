"""Rally segmentation from ball motion, and its supporting evidence."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtflow import config as C
from courtflow.functions import geometry as G
from courtflow.functions.folds import GONE, OPEN, TAKEN, settle, state_fold
from courtflow.functions.sequences import (
    CHUNK,
    CHUNK_FRAMES,
    HOME,
    chunk_window,
    home_rows,
    interval_join,
    last_before,
    running_count,
    spread_join,
    with_halo,
)
from courtflow.session import cut_lineage

KEYS = ("match_id",)


def ball_speed(track: DataFrame, video: C.Video, s: C.RallySettings = C.RallySettings(), chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Speed against the previous known frame of the same segment, in diagonals/s."""
    gap = int(s.link_gap_s * video.fps + 1e-9)
    rows = with_halo(track, "frame", gap, 0, chunk)
    known = F.when(F.col("x_px").isNotNull(), F.struct("frame", "segment_id", "x_px", "y_px"))
    w = chunk_window(KEYS, "frame").rangeBetween(-gap, -1)
    rows = home_rows(rows.withColumn("_p", F.last(known, ignorenulls=True).over(w)))
    elapsed = (F.col("frame") - F.col("_p.frame")) / video.fps
    speed = G.distance("x_px", "y_px", "_p.x_px", "_p.y_px") / (video.diagonal * elapsed)
    linked = (F.col("segment_id") == F.col("_p.segment_id")) & (elapsed <= s.link_gap_s)
    return rows.withColumn("speed", F.when(linked, speed)).drop("_p")


def motion_support(moving: DataFrame, video: C.Video, s: C.RallySettings = C.RallySettings(), chunk: int = CHUNK_FRAMES) -> DataFrame:
    """``moving`` flag and whether enough of the frames around are moving."""
    radius = max(3, round(s.support_window_s * video.fps)) // 2
    rows = moving.withColumn("moving", F.coalesce(F.col("speed") >= s.min_motion_speed, F.lit(False)))
    rows = with_halo(rows, "frame", radius, radius, chunk)
    w = chunk_window(KEYS, "frame").rangeBetween(-radius, radius)
    rows = rows.withColumn("support_fraction", F.avg(F.col("moving").cast("int")).over(w))
    return home_rows(rows).withColumn("supported", F.col("support_fraction") >= s.min_support)


@F.pandas_udf(T.DoubleType())
def widest_pair(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Largest distance between any two points of each row's arrays (null for none)."""
    out = np.full(len(xs), np.nan)
    rows = [i for i, x in enumerate(xs) if x is not None and len(x)]
    most = max((len(xs.iat[i]) for i in rows), default=1)
    together = max(1, 2_000_000 // most**2)  # rows whose pairs are held at once
    for low in range(0, len(rows), together):
        part = rows[low : low + together]
        longest = max(len(xs.iat[i]) for i in part)
        # Shorter rows repeat their last point, which adds no new distance.
        px = np.array([np.pad(xs.iat[i], (0, longest - len(xs.iat[i])), "edge") for i in part])
        py = np.array([np.pad(ys.iat[i], (0, longest - len(ys.iat[i])), "edge") for i in part])
        squares, other = px[:, :, None] - px[:, None, :], py[:, :, None] - py[:, None, :]
        squares *= squares
        other *= other
        squares += other
        out[part] = np.sqrt(squares.max(axis=(1, 2)))
    return pd.Series(out)


# Said not to be deterministic, so that a filter on its result does not evaluate it a second time in other workers.
widest_pair = widest_pair.asNondeterministic()


def kinematics(track: DataFrame, video: C.Video, s: C.RallySettings = C.RallySettings(), chunk: int = CHUNK_FRAMES) -> DataFrame:
    """W5 to W8 in windows over one partitioning of the timeline.

    Adds speed, moving, supported, onset and refined_start. Each window looks a
    fixed number of frames around, so one halo covers their sum.
    """
    fps = video.fps
    gap = int(s.link_gap_s * fps + 1e-9)
    radius = max(3, round(s.support_window_s * fps)) // 2
    base, confirm = C.frames_for(s.serve_baseline_s, fps), C.frames_for(s.serve_confirm_s, fps)
    rows = with_halo(track, "frame", base + gap + radius, max(confirm, radius), chunk)
    w = chunk_window(KEYS, "frame")
    is_known = F.col("x_px").isNotNull()
    known = F.when(is_known, F.struct("frame", "segment_id", "x_px", "y_px"))
    rows = rows.withColumn("_p", F.last(known, ignorenulls=True).over(w.rangeBetween(-gap, -1)))
    elapsed = (F.col("frame") - F.col("_p.frame")) / fps
    linked = (F.col("segment_id") == F.col("_p.segment_id")) & (elapsed <= s.link_gap_s)
    rows = rows.withColumn(
        "speed", F.when(linked, G.distance("x_px", "y_px", "_p.x_px", "_p.y_px") / (video.diagonal * elapsed))
    ).drop("_p")
    rows = rows.withColumn("moving", F.coalesce(F.col("speed") >= s.min_motion_speed, F.lit(False)))
    around, back, ahead = w.rangeBetween(-radius, radius), w.rangeBetween(-base, -1), w.rangeBetween(0, confirm)
    rows = rows.withColumn("supported", F.avg(F.col("moving").cast("int")).over(around) >= s.min_support)
    rows = rows.withColumn("baseline", F.coalesce(F.percentile(F.coalesce("speed", F.lit(0.0)), F.lit(0.5)).over(back), F.lit(0.0)))
    rows = rows.withColumn("known_fraction", F.avg(is_known.cast("int")).over(ahead))
    rows = rows.withColumn("motion_fraction", F.avg(F.col("moving").cast("int")).over(ahead))
    early = F.greatest(F.lit(0), F.col("frame") - base)
    still = F.max(F.when(~F.col("moving"), F.col("frame"))).over(back)
    blank = F.max(F.when(~is_known, F.col("frame"))).over(back)
    rows = rows.withColumn("_walk", F.greatest(early, F.coalesce(still + 1, early)))
    rows = rows.withColumn("_walk2", F.greatest(early, F.coalesce(blank + 1, early)))
    surge = F.col("speed") / F.greatest("baseline", F.lit(s.min_motion_speed / 2))
    gate = (
        (F.col("speed") >= s.serve_min_speed)
        & ((surge >= s.serve_surge_ratio) | (F.col("speed") - F.col("baseline") >= s.min_motion_speed))
        & (F.col("known_fraction") >= s.serve_min_known)
        & (F.col("motion_fraction") >= s.serve_min_motion)
    )
    rows = rows.withColumn("surge", surge).withColumn("_gate", F.coalesce(gate, F.lit(False)) & F.col(HOME))
    # Only points in the look-ahead of a gated frame are gathered; all other arrays stay empty.
    near = F.max("_gate").over(w.rangeBetween(-confirm, 0))
    rows = rows.withColumn("_pt", F.when(is_known & near, F.struct("x_px", "y_px")))
    rows = rows.withColumn("_pts", F.collect_list("_pt").over(ahead))
    rows = home_rows(rows).withColumn("_xs", F.col("_pts.x_px")).withColumn("_ys", F.col("_pts.y_px"))
    gated = lambda c: F.when(F.col("_gate"), F.col(c))
    spread = F.nanvl(widest_pair(gated("_xs"), gated("_ys")), F.lit(0.0)) / video.diagonal
    rows = rows.withColumn("displacement", F.when(F.col("_gate"), F.coalesce(spread, F.lit(0.0))))
    rows = rows.withColumn("onset", F.coalesce(F.col("displacement") >= s.serve_min_displacement, F.lit(False)))
    walked = F.when(F.col("_walk") < F.col("frame"), F.col("_walk")).otherwise(F.col("_walk2"))
    return rows.withColumn("refined_start", F.when(F.col("onset"), walked)).drop("_xs", "_ys", "_pt", "_pts", "_walk", "_walk2", "_gate")


JUMPS = "match_id bigint, frame bigint, start_frame bigint, end_frame bigint, cursor bigint, long_enough boolean"


def _jumps_of_chunk(pdf: pd.DataFrame, last_frame: int, video: C.Video, s: C.RallySettings) -> pd.DataFrame:
    """What each onset of a chunk leads to: its end and where the search goes on."""
    fps = video.fps
    pdf = pdf.sort_values("frame")
    frame = pdf["frame"].to_numpy()
    offset = int(frame[0])
    moving, supported = pdf["moving"].to_numpy(bool), pdf["supported"].to_numpy(bool)
    known = pdf["known"].to_numpy(bool)
    size = len(frame)
    quiet, rest = C.frames_for(s.end_quiet_s, fps), C.frames_for(s.restart_quiet_s, fps)
    tail = C.frames_for(s.end_tail_s, fps, 0)
    low, high = C.frames_for(s.min_rally_s, fps), C.frames_for(s.max_rally_s, fps)
    elapsed, cool = C.frames_for(s.restart_min_elapsed_s, fps), C.frames_for(s.cooldown_s, fps)

    def run_starts(flag: np.ndarray, length: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag)))
        return np.flatnonzero(total[length:] == total[:-length]) if size >= length else np.empty(0, int)

    quiet_at, rest_at = run_starts(supported, quiet), run_starts(moving, rest)
    moves, knowns = np.flatnonzero(moving), np.flatnonzero(known)
    onsets = np.flatnonzero(pdf["onset"].to_numpy(bool))
    refined = pdf["refined_start"].to_numpy(float)
    home = pdf[HOME].to_numpy(bool)

    def settle(start: int, still: int) -> int:
        i = np.searchsorted(moves, still, "right") - 1
        if i < 0 or moves[i] < start:
            return start
        cut = min(still, int(moves[i]) + tail)
        return int(knowns[np.searchsorted(knowns, cut, "right") - 1])

    out = []
    last = last_frame - offset
    for n, at in enumerate(onsets):
        if not home[at]:
            continue
        start = int(refined[at]) - offset
        first, final = min(last, start + low), min(last, start + high)
        i = np.searchsorted(quiet_at, first)
        end = settle(start, int(quiet_at[i])) if i < len(quiet_at) and quiet_at[i] <= final else final
        again = None
        j = np.searchsorted(rest_at, start)
        if j < len(rest_at):
            need = max(start + elapsed, int(rest_at[j]) + rest)
            for later in onsets[n + 1 :]:
                if later > end:
                    break
                if int(refined[later]) - offset >= need:
                    again = later
                    break
        if again is not None:
            end = settle(start, max(start, int(refined[again]) - offset - rest))
            cursor = int(again)
        else:
            cursor = max(int(at) + 1, end + cool)
        out.append((pdf["match_id"].iat[0], at + offset, start + offset, end + offset, cursor + offset, end - start + 1 >= low))
    return pd.DataFrame(out, columns=[c.split()[0] for c in JUMPS.split(", ")])


def onset_jumps(kin: DataFrame, video: C.Video, s: C.RallySettings = C.RallySettings(), chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Rally that each onset would open, worked out for all onsets independently.

    An onset sees at most the longest rally ahead, so a chunk with that halo is
    enough, and chunks of one match run side by side.
    """
    ahead = C.frames_for(s.max_rally_s, video.fps) + C.frames_for(s.end_quiet_s, video.fps) + 1
    back = C.frames_for(s.serve_baseline_s, video.fps) + 1
    ends = kin.groupBy("match_id").agg(F.max("frame").alias("last_frame"))
    rows = kin.select("match_id", "frame", "moving", "supported", "onset", "refined_start", F.col("x_px").isNotNull().alias("known"))
    rows = spread_join(with_halo(rows, "frame", back, ahead, chunk), ends, KEYS)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        return _jumps_of_chunk(pdf, int(pdf["last_frame"].iat[0]), video, s)

    return rows.groupBy("match_id", CHUNK).applyInPandas(kernel, JUMPS)


class _Cursor:
    """Takes an onset when the search has reached it."""

    def __init__(self, state: Any) -> None:
        self.at = state or 0

    def state_at(self, frame: int) -> Any:
        return self.at if self.at > frame else None

    def step(self, frame: int, cursor: int) -> tuple[bool]:
        if frame < self.at:
            return (False,)
        self.at = cursor
        return (True,)


def candidate_rallies(kin: DataFrame, video: C.Video, s: C.RallySettings = C.RallySettings(), chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Walk the onsets of each match: rallies before neighbours are compared."""
    jumps = onset_jumps(kin, video, s, chunk)
    walked = state_fold(jumps, KEYS, "frame", (), _Cursor, ("frame", "cursor"), "taken boolean", chunk)
    rallies = walked.filter("taken and long_enough").select("match_id", F.col("frame").alias("onset_frame"), "start_frame", "end_frame")
    return running_count(rallies, KEYS, "onset_frame", chunk, "candidate_no")


def interval_support(
    kin: DataFrame,
    rallies: DataFrame,
    video: C.Video,
    s: C.RallySettings = C.RallySettings(),
    chunk: int = CHUNK_FRAMES,
    reset: DataFrame | None = None,
    audio: DataFrame | None = None,
) -> DataFrame:
    """Evidence, confidence and quality of each rally; extras only raise confidence."""
    base = rallies.select("match_id", "candidate_no", "onset_frame", "start_frame", "end_frame")
    frames = kin.select("match_id", "frame", "status", "moving", "supported", "speed", "segment_id")
    seen = interval_join(frames, base, ["match_id"], "frame", "start_frame", "end_frame", 2048)
    n = F.count("*")
    stats = seen.groupBy("match_id", "candidate_no").agg(
        F.count_if(F.col("status") == "OBSERVED").alias("observed"),
        F.count_if(F.col("status") == "INTERPOLATED").alias("interpolated"),
        F.count_if(F.col("status") == "UNKNOWN").alias("unknown"),
        (F.count_if(F.col("status") != "UNKNOWN") / n).alias("known_fraction"),
        F.avg(F.col("moving").cast("int")).alias("motion_fraction"),
        F.avg(F.col("supported").cast("int")).alias("sustained_fraction"),
        F.max(F.when(F.col("speed") != 0, F.col("speed"))).alias("max_speed"),
        F.array_sort(F.collect_set("segment_id")).alias("segments"),
        n.alias("frames"),
    )
    signal = kin.filter("onset").select("match_id", F.col("frame").alias("onset_frame"), "surge", "displacement", F.col("motion_fraction").alias("_confirm"))
    out = base.join(stats, ["match_id", "candidate_no"]).join(signal, ["match_id", "onset_frame"])
    is_known = F.when(F.col("x_px").isNotNull(), F.col("frame"))
    ahead = kin.select("match_id", "frame", "x_px").withColumn("_back", -F.col("frame"))
    prior = last_before(kin.select("match_id", "frame", "x_px"), KEYS, "frame", is_known, chunk, "_k")
    after = last_before(ahead, KEYS, "_back", is_known, chunk, "_k")
    ends = kin.groupBy("match_id").agg(F.max("frame").alias("_last"))
    out = out.join(prior.select("match_id", F.col("frame").alias("start_frame"), F.col("_k").alias("_kp")), ["match_id", "start_frame"])
    out = out.join(after.select("match_id", F.col("frame").alias("end_frame"), F.col("_k").alias("_kn")), ["match_id", "end_frame"])
    out = out.join(ends, "match_id")
    out = out.withColumn("preceding_unknown_s", (F.col("start_frame") - F.coalesce(F.col("_kp"), F.lit(-1)) - 1) / video.fps)
    out = out.withColumn("following_unknown_s", (F.coalesce(F.col("_kn"), F.col("_last") + 1) - F.col("end_frame") - 1) / video.fps)
    previous = last_before(base, KEYS, "start_frame", F.col("end_frame"), chunk, "_pe", tie=["candidate_no"]).select("match_id", "candidate_no", "_pe")
    out = out.join(previous, ["match_id", "candidate_no"])
    pause = F.greatest(F.lit(0.0), (F.col("start_frame") - F.col("_pe") - 1) / video.fps)
    out = out.withColumn("since_previous_s", F.when(F.col("_pe").isNotNull(), pause))
    serve = (
        G.cap1(F.col("surge") / (s.serve_surge_ratio * 2))
        + G.cap1(F.col("displacement") / (s.serve_min_displacement * 2))
        + G.cap1(F.col("_confirm") / max(s.serve_min_motion * 2, 0.01))
    ) / 3
    confidence = 0.25 + 0.30 * serve + 0.25 * G.cap1(F.col("motion_fraction") / 0.45) + 0.15 * G.cap1(F.col("known_fraction") / 0.70)
    if reset is not None:
        scores = reset.select("match_id", F.col("frame").alias("start_frame"), "reset_score")
        out = out.join(scores, ["match_id", "start_frame"], "left")
        confidence = confidence + F.coalesce(0.03 * F.col("reset_score"), F.lit(0.0))
    if audio is not None:
        out = out.join(boundary_audio(rallies, audio, video, s), ["match_id", "candidate_no"], "left")
        confidence = confidence + F.when(F.col("audio_support"), 0.02).otherwise(0.0)
    out = out.withColumn("confidence", F.least(F.lit(0.99), F.greatest(F.lit(0.0), confidence)))
    quality = (
        0.35 * F.col("motion_fraction") + 0.25 * F.col("known_fraction") + 0.20 * F.col("sustained_fraction")
        + 0.20 * G.cap1(F.col("frames") / video.fps / s.handoff_full_s)
    )
    return out.withColumn("quality", quality).drop("_kp", "_kn", "_last", "_pe", "_confirm", "surge", "displacement")


def boundary_audio(rallies: DataFrame, audio: DataFrame, video: C.Video, s: C.RallySettings = C.RallySettings()) -> DataFrame:
    """Whether a transient lies close to a rally's start or end."""
    from courtflow.functions.sequences import band_join

    edges = rallies.select(
        "match_id", "candidate_no",
        F.explode(F.array(F.col("start_frame") / video.fps, F.col("end_frame") / video.fps)).alias("edge_s"),
    )
    near = band_join(edges, audio.select("match_id", "video_s"), ["match_id"], "edge_s", "video_s", s.audio_tolerance_s)
    hit = near.select("match_id", "candidate_no").distinct().withColumn("audio_support", F.lit(True))
    return rallies.select("match_id", "candidate_no").join(hit, ["match_id", "candidate_no"], "left").fillna(False, ["audio_support"])


class _Bursts:
    """Accepts bursts from the strongest down, unless a clearly stronger one is near.

    Accepted and open bursts are listed in the cells, one window wide, that they touch,
    so a burst looks only at those near it.
    """

    def __init__(self, fps: float, s: C.RallySettings) -> None:
        self.fps, self.s, self.cells, self.seen = fps, s, {}, 0
        self.width = s.handoff_window_s * fps + 1

    def touched(self, start: float, end: float) -> range:
        return range(int(start // self.width), int(end // self.width) + 1)

    def step(self, home: bool, state: int, number: int, start: int, end: int, quality: float) -> tuple:
        if state == OPEN:
            listed = {o[0]: o for c in self.touched(start - self.width, end + self.width) for o in self.cells.get(c, ())}
            for rank in sorted(listed):
                _, kind, stronger, begin, finish, other = listed[rank]
                apart = (start - finish - 1) if start >= begin else (begin - end - 1)
                gap, margin = max(0.0, apart / self.fps), other - quality
                if gap <= self.s.handoff_window_s and margin >= self.s.handoff_margin:
                    # The strongest one that is near decides; while it is open, so is this one.
                    if kind == TAKEN:
                        return (GONE, stronger, gap, margin)
                    break
            else:
                state = TAKEN if home else OPEN
        entry = (self.seen, state, number, start, end, quality)
        self.seen += 1
        for c in self.touched(start, end):
            self.cells.setdefault(c, []).append(entry)
        return (state, None, None, None)


def resolve_bursts(rallies: DataFrame, video: C.Video, s: C.RallySettings = C.RallySettings(), chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Mark weaker bursts next to a stronger one; both stay, linked."""
    rallies = cut_lineage(rallies)
    longest = rallies.agg(F.max(F.col("end_frame") - F.col("start_frame"))).first()[0] or 0
    return settle(
        rallies, KEYS, F.col("start_frame"), F.col("end_frame"), s.handoff_window_s * video.fps + 1 + longest, chunk,
        [F.desc("quality"), (F.col("start_frame") - F.col("end_frame")).asc(), F.desc("confidence"), F.asc("candidate_no")],
        lambda: _Bursts(video.fps, s), ("candidate_no", "start_frame", "end_frame", "quality"), "stronger_no bigint, gap_s double, margin double",
    ).withColumnRenamed("taken", "accepted")


def number_rallies(decided: DataFrame, chunk: int = CHUNK_FRAMES) -> DataFrame:
    return running_count(decided.filter("accepted"), KEYS, "start_frame", chunk, "rally_no")


def player_reset(positions: DataFrame, fps: float, s: C.RallySettings = C.RallySettings(), chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Share of players whose median speed over the last second is low (3 players at least)."""
    trail = max(2, round(s.reset_window_s * fps))
    rows = with_halo(positions, "frame", trail + 2, 0, chunk)
    w = chunk_window(("match_id", "role"), "frame")
    point = F.when(F.col("x_m").isNotNull(), F.struct("frame", "x_m", "y_m"))
    rows = rows.withColumn("_p", F.last(point, ignorenulls=True).over(w.rangeBetween(-2, -1)))
    speed = G.distance("x_m", "y_m", "_p.x_m", "_p.y_m") / ((F.col("frame") - F.col("_p.frame")) / fps)
    rows = rows.withColumn("_v", speed)
    rows = home_rows(rows.withColumn("_median", F.percentile("_v", F.lit(0.5)).over(w.rangeBetween(-trail, 0))))
    out = rows.groupBy("match_id", "frame").agg(
        F.count("_median").alias("roles"), F.count_if(F.col("_median") <= s.reset_max_speed).alias("slow")
    )
    return out.withColumn("reset_score", F.when(F.col("roles") >= 3, F.col("slow") / F.col("roles")))


def paired_rallies(events: DataFrame, chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Rally intervals from start/end marks, and the marks that break the alternation."""
    marks = events.filter(F.col("type").isin("RALLY_START", "RALLY_END"))
    marks = last_before(marks, KEYS, "event_id", F.struct("type", "frame", "event_id"), chunk, "_p")
    start, end = F.col("type") == "RALLY_START", F.col("type") == "RALLY_END"
    opened = F.coalesce(F.col("_p.type") == "RALLY_START", F.lit(False))
    rallies = marks.filter(end & opened & (F.col("frame") >= F.col("_p.frame"))).select(
        "match_id", F.col("_p.event_id").alias("start_event"), F.col("event_id").alias("end_event"),
        F.col("_p.frame").alias("start_frame"), F.col("frame").alias("end_frame"),
    )
    reason = (
        F.when(start & opened, "start_before_end").when(end & ~opened, "end_without_start")
        .when(end & (F.col("frame") < F.col("_p.frame")), "end_precedes_start")
    )
    broken = marks.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("match_id", "event_id", "reason")
    tail = marks.groupBy("match_id").agg(F.max_by(F.struct("type", "event_id"), "event_id").alias("l"))
    tail = tail.filter(F.col("l.type") == "RALLY_START").select("match_id", F.col("l.event_id").alias("event_id"), F.lit("start_without_end").alias("reason"))
    return rallies, broken.unionByName(tail)


def segment_rallies(
    track: DataFrame, video: C.Video, s: C.RallySettings = C.RallySettings(), chunk: int = CHUNK_FRAMES,
    reset: DataFrame | None = None, audio: DataFrame | None = None,
) -> DataFrame:
    """Rallies of all matches with evidence; rejected bursts keep a link to the stronger one."""
    from courtflow.session import cut_lineage

    kin = cut_lineage(kinematics(track, video, s, chunk))
    rallies = candidate_rallies(kin, video, s, chunk)
    evidence = cut_lineage(interval_support(kin, cut_lineage(rallies), video, s, chunk, reset, audio))
    return resolve_bursts(evidence, video, s, chunk)


