"""Court size, thresholds and weights that results depend on."""

from __future__ import annotations

import math
from dataclasses import dataclass

# Court, in metres.
COURT_WIDTH_M = 6.096
COURT_LENGTH_M = 13.4112
NVZ_DEPTH_M = 2.1336
NET_Y_M = COURT_LENGTH_M / 2
NEAR_KITCHEN_Y_M = NET_Y_M - NVZ_DEPTH_M
FAR_KITCHEN_Y_M = NET_Y_M + NVZ_DEPTH_M

# Logical players, teams and shot classes.
ROLES = ("ME", "PARTNER", "OPPONENT_1", "OPPONENT_2")
TEAMS = {"nearTeam": ("ME", "PARTNER"), "farTeam": ("OPPONENT_1", "OPPONENT_2")}
UNKNOWN = "UNKNOWN"
SHOT_TYPES = ("SERVE", "RETURN", "DRIVE", "DROP", "DINK", "VOLLEY", "OVERHEAD", "OTHER", "UNKNOWN")
KNOWN_SHOT_TYPES = SHOT_TYPES[:-1]
COUNTED_SHOT_TYPES = ("DINK", "DROP", "DRIVE", "VOLLEY", "OVERHEAD")
ZONES = ("kitchen", "transitionZone", "backcourt")


@dataclass(frozen=True)
class Video:
    """Frame rate and size shared by the matches of one branch of a plan."""

    fps: float = 30.0
    width: int = 1920
    height: int = 1080

    @property
    def diagonal(self) -> float:
        return math.hypot(self.width, self.height)

    def frames(self, seconds: float, least: int = 1) -> int:
        return frames_for(seconds, self.fps, least)


def frames_for(seconds: float, fps: float, least: int = 1) -> int:
    """Whole frames for a duration; halves go to the even neighbour."""
    return max(least, round(seconds * fps))


@dataclass(frozen=True)
class PositionSettings:
    smoothing_window: int = 5
    max_adjustment_m: float = 0.30
    min_confidence: float = 0.45
    max_step_gap_s: float = 0.20
    max_step_speed: float = 8.0
    transition_depth_m: float = 2.1336


@dataclass(frozen=True)
class ArrivalSettings:
    distance_m: float = 0.90
    min_coverage: float = 0.50


@dataclass(frozen=True)
class BallSettings:
    side_margin: float = 0.12
    air_margin: float = 0.50
    bottom_margin: float = 0.06
    min_start_score: float = 0.40
    min_link_score: float = 0.32
    min_segment: int = 2
    base_gate: float = 0.012
    max_speed: float = 3.0
    max_acceleration: float = 80.0
    link_gap_s: float = 0.20
    interpolation_gap_s: float = 0.10
    smoothing_window: int = 5
    max_adjustment: float = 0.015


@dataclass(frozen=True)
class RallySettings:
    link_gap_s: float = 0.20
    min_motion_speed: float = 0.10
    support_window_s: float = 0.30
    min_support: float = 0.25
    serve_min_speed: float = 0.18
    serve_baseline_s: float = 0.40
    serve_surge_ratio: float = 1.60
    serve_confirm_s: float = 1.20
    serve_min_motion: float = 0.20
    serve_min_known: float = 0.30
    serve_min_displacement: float = 0.06
    min_rally_s: float = 0.75
    max_rally_s: float = 45.0
    end_quiet_s: float = 0.90
    end_tail_s: float = 0.25
    restart_quiet_s: float = 0.50
    restart_min_elapsed_s: float = 2.50
    cooldown_s: float = 1.0
    handoff_window_s: float = 2.25
    handoff_margin: float = 0.05
    handoff_full_s: float = 4.0
    audio_tolerance_s: float = 0.12
    reset_window_s: float = 1.0
    reset_max_speed: float = 1.25
    eval_min_iou: float = 0.25
    eval_boundary_s: float = 1.50
    sparse_margin_s: float = 2.0


@dataclass(frozen=True)
class BounceSettings:
    window_s: float = 0.20
    min_each_side: int = 2
    min_vertical_speed: float = 0.018
    min_reversal: float = 0.040
    min_prominence: float = 0.0015
    min_continuity: float = 0.65
    min_candidate: float = 0.35
    min_projection: float = 0.55
    accepted: float = 0.80
    spacing_s: float = 0.18
    audio_weight: float = 0.20
    rally_boost: float = 0.05
    tolerance_s: float = 0.09
    eval_tolerance_s: float = 0.12
    sparse_margin_s: float = 0.30


@dataclass(frozen=True)
class ContactSettings:
    window_s: float = 0.16
    min_each_side: int = 2
    min_velocity_change: float = 0.060
    min_direction_deg: float = 22.0
    min_speed_ratio: float = 1.35
    min_continuity: float = 0.65
    max_proximity: float = 0.12
    bounce_exclusion_s: float = 0.08
    max_bounce_gap_s: float = 3.0
    min_candidate: float = 0.40
    accepted: float = 0.78
    spacing_s: float = 0.12
    audio_weight: float = 0.20
    rally_boost: float = 0.04
    bounce_boost: float = 0.03
    tolerance_s: float = 0.09
    eval_tolerance_s: float = 0.10
    sparse_margin_s: float = 0.30


@dataclass(frozen=True)
class HitterSettings:
    w_proximity: float = 0.35
    w_tracking: float = 0.17
    w_direction: float = 0.18
    w_contact: float = 0.12
    w_court: float = 0.08
    w_sequence: float = 0.10
    min_contact: float = 0.78
    min_score: float = 0.62
    min_margin: float = 0.08
    max_distance: float = 0.12
    min_tracking: float = 0.45
    min_direction_speed: float = 0.015
    context_confidence: float = 0.70
    context_gap_s: float = 4.0
    eval_tolerance_s: float = 0.10


@dataclass(frozen=True)
class ShotSettings:
    min_hitter: float = 0.62
    min_coverage: float = 0.50
    min_points: int = 3
    kitchen_proximity_m: float = 0.90
    serve_depth_m: float = 1.20
    overhead_height: float = 0.45
    overhead_speed: float = 0.35
    dink_speed: float = 0.28
    drop_depth_m: float = 0.90
    drop_speed: float = 0.38
    drive_speed: float = 0.45
    eval_tolerance_s: float = 0.12


@dataclass(frozen=True)
class IsolationSettings:
    near_margin_m: float = 1.5
    boundary_m: float = 0.25
    side_m: float = 0.25
    clip_px: float = 1.0
    min_observations: int = 15
    min_support: float = 0.60
    max_gap_s: float = 1.0
    max_speed: float = 8.0
    base_distance_m: float = 0.35


@dataclass(frozen=True)
class IdentitySettings:
    min_score: float = 0.45
    switch_score: float = 0.65
    max_gap_s: float = 3.0
    max_speed: float = 8.0
    appearance_weight: float = 0.47
    min_similarity: float = 0.55
    min_margin: float = -0.05
    long_gap_similarity: float = 0.70
    long_gap_margin: float = 0.03


@dataclass(frozen=True)
class AudioSettings:
    strength: float = 4.0
    separation_s: float = 0.080
    frame_s: float = 0.032
    hop_s: float = 0.010
    low_hz: float = 500.0
    high_hz: float = 4000.0
