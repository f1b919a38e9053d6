"""Matches of different frame rates, sizes and matrices give what each gives alone."""

from conftest import SF
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.catalog.ball import CORNERS
from courtflow.catalog.events import HI, H
from courtflow.fixtures import Tables
from courtflow.functions import geometry as G
from courtflow.operators import events as X
from courtflow.plans.full_match import Inputs, find_bounces

KIND = "match_id bigint, fps double, width int, height int, image_to_court array<double>, court_to_image array<double>, rmse_m double"
CAMERAS = [(0, 25.0, 1920, 1080), (1, 30.0, 1280, 720), (2, 60.0, 1920, 1080), (3, 15.0, 3840, 2160)]
OUT = ("match_id", "frame", "visual", "court_x_m", "court_y_m")


def rows_of(df, names=OUT):
    """Rows in order; floats rounded, since windows sum in either order."""
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=str)


def tables(spark):
    one = Tables(spark, SF).ball.filter("match_id = 0").drop("match_id")
    ids = spark.range(5).select(F.col("id").alias("match_id"))  # the fifth has no calibration
    track = one.withColumn("match_id", F.explode(F.lit(list(range(5))).cast("array<bigint>")))
    calibrations = spark.createDataFrame([(*c, H, HI, 0.06) for c in CAMERAS], KIND)
    audio = ids.select("match_id", F.lit(7).cast("bigint").alias("transient_id"), F.lit(1.4).alias("video_s"), F.lit(0.9).alias("confidence"))
    return track, calibrations, audio


def test_each_match_has_its_own_window_size_and_spacing(spark):
    track, calibrations, audio = tables(spark)
    camera = G.camera_of(calibrations)
    assert camera.top_fps == 60.0
    seen = G.calibrated(track, calibrations)
    want_found, want_kept = [], []
    for match, fps, width, height in CAMERAS:
        alone, video = track.filter(F.col("match_id") == match), C.Video(fps, width, height)
        want_found += rows_of(X.bounce_candidates(alone, video, CORNERS, H))
        want_kept += rows_of(X.detect_bounces(alone, video, CORNERS, H, audio))
    assert {r[0] for r in want_found} == {0, 1, 2, 3} and len(want_kept) < len(want_found)
    assert rows_of(X.bounce_candidates(seen, camera, camera.corners, camera.homography)) == sorted(want_found, key=str)
    found = X.detect_bounces(seen, camera, camera.corners, camera.homography, audio, chunk=64)
    assert rows_of(found) == sorted(want_kept, key=str)
    planned = find_bounces(Inputs(None, None, None, None, audio, calibrations=calibrations), track, None)
    assert rows_of(planned) == sorted(want_kept, key=str) and "fps" not in planned.columns


def test_unusable_calibrations(spark):
    """A short or missing matrix gives no place on the court, not an error; no calibrations, no rows."""
    track, calibrations, audio = tables(spark)
    broken = spark.createDataFrame([(0, 25.0, 1920, 1080, H[:4], None, None), (1, 30.0, 1280, 720, None, [], 0.1)], KIND)
    seen, camera = G.calibrated(track, broken, "inner"), G.camera_of(broken)
    found = X.bounce_candidates(seen, camera, camera.corners, camera.homography)
    assert found.count() > 0 and found.filter("court_x_m is not null or court_y_m is not null").count() == 0
    x, y = G.project("x_px", "y_px", camera.homography)
    assert seen.filter(x.isNotNull() | y.isNotNull()).count() == 0
    empty = spark.createDataFrame([], KIND)
    camera = G.camera_of(empty)
    assert X.bounce_candidates(G.calibrated(track, empty), camera, camera.corners, camera.homography).count() == 0


def test_places_in_radii_are_exact(spark):
    rows = spark.range(1, 1000).select(F.col("id").alias("r"), F.explode(F.lit([0, 1, 977, 107999, 9_999_991]).cast("array<bigint>")).alias("f"))
    apart_by = X.in_radii("g", F.col("r")) - X.in_radii("f", F.col("r"))
    for name, step, inside in (("within", F.col("r"), True), ("beyond", F.col("r") + 1, False), ("next", F.lit(1), True)):
        apart = rows.withColumn("g", F.col("f") + step).select(apart_by.alias("d"))
        good = apart.filter((F.col("d") <= X.UNIT + X.SLACK) == F.lit(inside)).filter(F.col("d") >= X.SLACK)
        assert good.count() == apart.count(), name
