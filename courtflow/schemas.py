"""Explicit schemas of the stored tables; nothing is inferred on read."""

from __future__ import annotations

POINT_PX = "struct<x_px:double,y_px:double>"
POINT_M = "struct<x_m:double,y_m:double>"
BOX = "l double, t double, r double, b double"

TABLES = {
    "person_detections": f"match_id bigint, detection_id bigint, frame bigint, t_s double, {BOX}, confidence double",
    "ball_candidates": "match_id bigint, frame bigint, t_s double, detection_id bigint, x_px double, y_px double, confidence double, relevance double, supporting_ids array<string>",
    "ball_track": "match_id bigint, frame bigint, t_s double, status string, segment_id bigint, x_px double, y_px double, sx_px double, sy_px double, confidence double, rejected_ids array<bigint>",
    "player_positions": "match_id bigint, role string, frame bigint, t_s double, x_m double, y_m double, confidence double, region string, state string",
    "player_boxes": "match_id bigint, role string, frame bigint, l double, t double, r_px double, b double, tracking_confidence double, state string, side string, region string",
    "calibrations": "match_id bigint, image_to_court array<double>, court_to_image array<double>, rmse_m double",
    "audio_blocks": "match_id bigint, block_ix bigint, channels array<array<float>>",
    "audio_transients": "match_id bigint, transient_id bigint, video_s double, confidence double",
    "rallies": "match_id bigint, rally_id bigint, start_frame bigint, end_frame bigint, start_s double, end_s double, confidence double",
    "bounces": "match_id bigint, bounce_id bigint, frame bigint, visual double, fused double, court_x_m double, court_y_m double, evidence_mode string",
    "contacts": "match_id bigint, frame bigint, t_s double, x_px double, y_px double, visual double, fused double, accepted_fused boolean, rally_id bigint",
    "hitters": "match_id bigint, frame bigint, hitter_id string, hitter_confidence double, hitter_side string, alternatives array<struct<role:string,score:double>>",
    "shots": "match_id bigint, shot_no bigint, rally_id bigint, shot_index bigint, frame bigint, hitter_id string, hitter_confidence double, shot_type string, confidence double, hitter_x_m double, hitter_y_m double",
    "annotations": "match_id bigint, event_id bigint, type string, frame bigint, player_id string, shot_type string",
    "corrections": "match_id bigint, correction_id bigint, type string, target_collection string, target_id bigint, value string, active boolean, verified boolean, corrected_at bigint, revision bigint",
}
