"""Who hit the ball at each contact."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions import geometry as G
from courtflow.functions.folds import state_fold
from courtflow.functions.sequences import CHUNK_FRAMES
from courtflow.session import cut_lineage


def state_quality(state: Column) -> Column:
    return F.when(state == "observed", 1.0).when(state == "reacquired", 0.85).when(state == "suspected_identity_switch", 0.30).otherwise(0.0)


def court_quality(region: Column) -> Column:
    return F.when(region == "inside", 1.0).when(region == "near", 0.65).when(region == "ambiguous", 0.35).when(region == "outside", 0.0).otherwise(0.25)


def direction_quality(side: Column, before: Column, after: Column, diagonal: float, least: float) -> Column:
    """Share of clear vertical speeds that fit the player's side; 0.5 with none."""
    toward = F.when(side == "near_side", 1).when(side == "far_side", -1)
    clear_in = toward.isNotNull() & (F.abs(before) / diagonal >= least)
    clear_out = toward.isNotNull() & (F.abs(after) / diagonal >= least)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    hits = flag(clear_in & (F.signum(before) == toward)) + flag(clear_out & (F.signum(after) == -toward))
    n = flag(clear_in) + flag(clear_out)
    return F.when(n > 0, hits / n).otherwise(0.5)


def score_players(players: DataFrame, video: C.Video, s: C.HitterSettings = C.HitterSettings()) -> DataFrame:
    """Every term of a player's score but the one that needs the previous hitter.

    ``players`` has a row per contact and player: contact columns (frame, t_s,
    visual, rally_id, by, ay) and candidate columns of ``candidate_players``.
    """
    proximity = F.when(F.col("inside"), 1.0).otherwise(F.col("proximity"))
    tracking = F.col("tracking_confidence") * state_quality(F.col("state"))
    direction = direction_quality(F.col("side"), F.col("by"), F.col("ay"), video.diagonal, s.min_direction_speed)
    out = players.withColumn("direction", direction)
    base = (
        s.w_proximity * proximity + s.w_tracking * tracking + s.w_direction * F.col("direction")
        + s.w_contact * F.col("visual") + s.w_court * court_quality(F.col("region"))
    )
    return out.withColumn("base_score", base)


class _Hitters:
    """Decides contacts in time order; the previous confident hitter adds one term."""

    def __init__(self, state: Any, s: C.HitterSettings, video: C.Video) -> None:
        self.previous, self.s, self.diagonal, self.fps = state, s, video.diagonal, video.fps
        self.total = s.w_proximity + s.w_tracking + s.w_direction + s.w_contact + s.w_court + s.w_sequence

    def state_at(self, frame: int) -> Any:
        # A frame of slack, as times may be rounded.
        recent = self.previous is not None and (frame - 1) / self.fps - self.previous[1] <= self.s.context_gap_s
        return self.previous if recent else None

    def applies(self, t: float, rally: Any) -> bool:
        if self.previous is None or t - self.previous[1] > self.s.context_gap_s:
            return False
        return rally == self.previous[2]

    def step(self, t: float, visual: float, rally: Any, players: Any) -> tuple:
        s = self.s
        eligible = visual >= s.min_contact
        use = self.applies(t, rally)
        scored = []
        for p in players if players is not None else ():
            if p["role"] is None:
                continue
            fit, side = 0.5, p["side"]
            if use and side in ("near_side", "far_side") and self.previous[0] in ("near_side", "far_side"):
                fit = 1.0 if side != self.previous[0] else 0.0
            score = min(1.0, max(0.0, (p["base_score"] + s.w_sequence * fit) / self.total))
            scored.append((-score, p["role"], p))
        scored.sort(key=lambda x: x[:2])
        if not scored:
            if eligible:
                self.previous = None
            return (C.UNKNOWN, 1.0, None, None, None, use, [])
        score, best = -scored[0][0], scored[0][2]
        margin = score + scored[1][0] if len(scored) > 1 else score
        near = bool(best["inside"]) or best["distance_px"] / self.diagonal <= s.max_distance
        tracked = best["tracking_confidence"]
        sure = eligible and near and tracked >= s.min_tracking and score >= s.min_score and margin >= s.min_margin
        strengths = (visual / s.min_contact, score / s.min_score, margin / s.min_margin, tracked / s.min_tracking, 1.0 if near else 0.0)
        confidence = score if sure else 1.0 - min(1.0, max(0.0, min(strengths)))
        if eligible:
            keep = sure and score >= s.context_confidence
            self.previous = (best["side"], t, rally) if keep else None
        others = [{"role": r, "score": -n} for n, r, _ in scored if not (sure and r == best["role"])]
        return (best["role"] if sure else C.UNKNOWN, confidence, best["side"] if sure else None, score, margin, use, others)


OUTPUT = (
    "hitter_id string, hitter_confidence double, hitter_side string, best_score double, margin double, "
    "context_used boolean, alternatives array<struct<role:string,score:double>>"
)


def identify(
    contacts: DataFrame, players: DataFrame, video: C.Video, s: C.HitterSettings = C.HitterSettings(), chunk: int = CHUNK_FRAMES
) -> DataFrame:
    """Hitter of each contact, or UNKNOWN with the confidence that it is unknown.

    Scores without the sequence term are worked out in columns; only the walk over
    contacts runs in Python, chunk by chunk.
    """
    cols = contacts.select("match_id", "frame", "t_s", "visual", "rally_id", "by", "ay")
    rows = players.select("match_id", "frame", "role", "side", "region", "state", "tracking_confidence", "inside", "proximity", "distance_px")
    scored = score_players(cols.join(rows, ["match_id", "frame"]), video, s)
    pack = F.struct("role", "side", "base_score", "inside", "distance_px", "tracking_confidence")
    packed = scored.groupBy("match_id", "frame").agg(F.array_sort(F.collect_list(pack)).alias("players"))
    timeline = cut_lineage(cols.join(packed, ["match_id", "frame"], "left"))
    out = state_fold(timeline, ("match_id",), "frame", (), lambda st: _Hitters(st, s, video), ("t_s", "visual", "rally_id", "players"), OUTPUT, chunk)
    return out.drop("players", "by", "ay")


def statistics(hitters: DataFrame) -> DataFrame:
    known = F.col("hitter_id") != C.UNKNOWN
    return hitters.groupBy("match_id").agg(
        F.count("*").alias("contacts"), F.count_if(known).alias("assigned"), F.count_if(~known).alias("unknown"),
        *[F.count_if(F.col("hitter_id") == r).alias(r) for r in C.ROLES],
        F.avg(F.when(known, F.col("hitter_confidence"))).alias("mean_assigned_confidence"),
        G.ratio(F.count_if(known), F.count("*")).alias("assignment_rate"))
