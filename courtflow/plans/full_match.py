"""All stages from detections to match documents, for all matches at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions import geometry as G
from courtflow.functions.sequences import CHUNK_FRAMES, chunk_of
from courtflow.operators import analytics as A
from courtflow.operators import ball as B
from courtflow.operators import events as X
from courtflow.operators import hitters as HT
from courtflow.operators import positions as P
from courtflow.operators import rallies as R
from courtflow.operators import shots as SH


@dataclass
class Inputs:
    """Tables of one frame rate.

    ``candidates`` ball detections, ``matches`` (match_id, frame_count), ``positions``
    raw player positions, ``boxes`` player boxes, ``audio`` transients.  ``calibrations``
    (match_id, fps, width, height, image_to_court, court_to_image, rmse_m) give each match
    its own camera for bounces; ``corners`` and ``homography`` stand for all matches
    where there is no such table.
    """

    candidates: DataFrame
    matches: DataFrame
    positions: DataFrame
    boxes: DataFrame
    audio: DataFrame
    corners: list[tuple] | None = None
    homography: list | None = None
    video: C.Video = C.Video()
    calibrations: DataFrame | None = None


class Stages:
    """Keeps each stage as a table, so a lost run picks up after the last whole one.

    Rows are laid out by match and stretch of its timeline, in one shuffle and without
    a sampling pass: a huge match spreads over many files, and sorted files let readers
    of one match skip row groups by their statistics.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _finished(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def table(self, name: str, build: Callable[[], DataFrame], position: str | None = "frame") -> DataFrame:
        path = f"{self.folder}/{name}"
        if not self._finished(path):
            df = build()
            if position:
                df = df.repartition("match_id", chunk_of(position, CHUNK_FRAMES)).sortWithinPartitions("match_id", position)
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def find_bounces(inputs: Inputs, track: DataFrame, rallies: DataFrame) -> DataFrame:
    """Bounces under each match's own calibration, or under the one given for all."""
    if inputs.calibrations is None:
        return X.detect_bounces(track, inputs.video, inputs.corners, inputs.homography, inputs.audio, rallies)
    camera = G.camera_of(inputs.calibrations)
    seen = G.calibrated(track, inputs.calibrations, "inner")
    return X.detect_bounces(seen, camera, camera.corners, camera.homography, inputs.audio, rallies).drop(*G.CALIBRATION, "court_corners")


def analyse(inputs: Inputs, stages: Stages) -> dict[str, DataFrame]:
    v = inputs.video
    out: dict[str, DataFrame] = {}
    out["ball_track"] = stages.table("ball_track", lambda: B.reconstruct(inputs.candidates, inputs.matches, v))
    seen = F.coalesce("sx_px", "x_px"), F.coalesce("sy_px", "y_px")
    track = out["ball_track"].withColumn("x_px", seen[0]).withColumn("y_px", seen[1])
    out["player_positions"] = stages.table("player_positions", lambda: P.smooth(inputs.positions))
    smooth = out["player_positions"].withColumn("x_m", F.col("sx_m")).withColumn("y_m", F.col("sy_m"))
    found = stages.table(
        "rally_candidates",
        lambda: R.segment_rallies(track, v, reset=R.player_reset(inputs.positions, v.fps), audio=inputs.audio), "start_frame")
    out["rally_rejections"] = found.filter("not accepted")
    out["rallies"] = stages.table("rallies", lambda: R.number_rallies(found).select(
        "match_id", F.col("rally_no").alias("rally_id"), "start_frame", "end_frame",
        (F.col("start_frame") / v.fps).alias("start_s"), (F.col("end_frame") / v.fps).alias("end_s"), "confidence"), "start_frame")
    out["bounces"] = stages.table("bounces", lambda: find_bounces(inputs, track, out["rallies"]))
    prior = out["bounces"].filter("accepted_fused").select("match_id", "frame", F.col("fused").alias("confidence"))
    out["contacts"] = stages.table("contacts", lambda: X.detect_contacts(track, inputs.boxes, v, prior, inputs.audio, out["rallies"]))
    near = X.candidate_players(out["contacts"], inputs.boxes, v, C.ContactSettings().max_proximity)
    out["hitters"] = stages.table("hitters", lambda: HT.identify(out["contacts"], near, v))
    landed = out["bounces"].filter("accepted_fused").select("match_id", "frame", F.col("frame").alias("bounce_id"), "court_x_m", "court_y_m")
    places = smooth.select("match_id", "frame", "role", F.col("x_m").alias("px_m"), F.col("y_m").alias("py_m"), "region").join(
        inputs.boxes.select("match_id", "frame", "role", "side"), ["match_id", "frame", "role"])
    out["shots"] = stages.table("shots", lambda: SH.reconstruct(
        track, out["rallies"], out["contacts"], landed, out["hitters"], inputs.boxes, places, v))
    where = places.select("match_id", "frame", F.col("role").alias("hitter_id"), F.col("region").alias("hitter_region"))
    shots = out["shots"].withColumn("shot_id", F.col("shot_no")).join(where, ["match_id", "frame", "hitter_id"], "left")
    out["documents"] = stages.table("documents", lambda: A.match_document(out["rallies"], shots, smooth, v.fps), None)
    return out
