"""The whole chain on derived tables, and picking up after a lost run."""

from pyspark.sql import functions as F

from courtflow.catalog import events as CE
from courtflow.plans.full_match import Inputs, Stages, analyse


def test_chain(spark, tables, tmp_path):
    matches = tables.ball.groupBy("match_id").agg((F.max("frame") + 1).alias("frame_count"))
    role = F.col("role")
    boxes = tables.player_boxes
    half = F.when(F.col("side") == "near_side", F.lit(4.4) - F.col("t") / 200).otherwise(F.lit(9.0) + F.col("t") / 200)
    positions = boxes.select(
        "match_id", role, "frame", (F.col("frame") / 30).alias("t_s"), (F.col("l") / 400).alias("x_m"), half.alias("y_m"),
        F.col("tracking_confidence").alias("confidence"), "region", "state")
    inputs = Inputs(tables.candidates, matches, positions, boxes, tables.audio, CE.CORNERS, CE.H)
    out = analyse(inputs, Stages(spark, str(tmp_path)))
    counts = {name: df.count() for name, df in out.items()}
    assert counts["ball_track"] == tables.ball.count() and counts["documents"] == matches.count()
    assert counts["rallies"] and counts["bounces"] and counts["contacts"] == counts["hitters"] and counts["shots"]
    shots = out["shots"]
    orphans = shots.join(out["rallies"].select("match_id", "rally_id"), ["match_id", "rally_id"], "left_anti")
    assert orphans.isEmpty()
    again = analyse(inputs, Stages(spark, str(tmp_path)))
    assert {name: df.count() for name, df in again.items()} == counts
