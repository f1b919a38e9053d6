"""Inference regions, crop translation and duplicate boxes across crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.functions import geometry as G
from courtflow.functions.folds import sorted_fold


def court_roi(videos: DataFrame, corners: list[tuple], margin: int) -> DataFrame:
    """Bounding region of the projected court with a margin, kept inside the frame."""
    as_col = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else G.col(v)
    xs, ys = [as_col(c[0]) for c in corners], [as_col(c[1]) for c in corners]
    out = videos.withColumn("left", F.greatest(F.lit(0), F.floor(F.least(*xs) - margin)).cast("bigint"))
    out = out.withColumn("top", F.greatest(F.lit(0), F.floor(F.least(*ys) - margin)).cast("bigint"))
    out = out.withColumn("right", F.least(F.col("width"), F.ceil(F.greatest(*xs) + margin)).cast("bigint"))
    out = out.withColumn("bottom", F.least(F.col("height"), F.ceil(F.greatest(*ys) + margin)).cast("bigint"))
    return out.filter("right > left and bottom > top")


def full_frame(videos: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return videos.withColumns({"left": zero, "top": zero, "right": F.col("width").cast("bigint"), "bottom": F.col("height").cast("bigint")})


def _positions(start: str, stop: str, tile: Column, overlap: float) -> Column:
    stride = F.greatest(F.lit(1), F.bround(tile * (1 - overlap), 0)).cast("bigint")
    last = F.col(stop) - tile
    many = F.array_union(F.sequence(F.col(start), last, stride), F.array(last))
    return F.when(F.col(stop) - F.col(start) <= tile, F.array(F.col(start))).otherwise(many)


def tiles(regions: DataFrame, size: int, overlap: float) -> DataFrame:
    """Overlapping tiles of each region; the last of a row or column ends flush."""
    tw, th = F.least(F.lit(size), F.col("right") - F.col("left")).cast("bigint"), F.least(F.lit(size), F.col("bottom") - F.col("top")).cast("bigint")
    rows = regions.withColumns({"_w": tw, "_h": th})
    rows = rows.withColumn("_x", _positions("left", "right", F.col("_w"), overlap)).withColumn("_y", _positions("top", "bottom", F.col("_h"), overlap))
    rows = rows.select("match_id", "_w", "_h", "_x", F.posexplode("_y").alias("row_ix", "tile_top"))
    rows = rows.select("match_id", "_w", "_h", "row_ix", "tile_top", F.posexplode("_x").alias("column_ix", "tile_left"))
    return rows.select(
        "match_id", F.col("row_ix").cast("bigint").alias("row_ix"), F.col("column_ix").cast("bigint").alias("column_ix"), "tile_left", "tile_top",
        (F.col("tile_left") + F.col("_w")).alias("tile_right"), (F.col("tile_top") + F.col("_h")).alias("tile_bottom"))


def to_source(boxes: DataFrame, left: str, top: str, width: str, height: str) -> DataFrame:
    """Crop boxes clipped to their crop and moved to frame coordinates; empty ones go."""
    clip = lambda c, size: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(size).cast("double"))
    out = boxes.withColumns({"l": clip("l", width), "t": clip("t", height), "r": clip("r", width), "b": clip("b", height)})
    out = out.filter("r > l and b > t")
    return out.withColumns({"l": F.col("l") + F.col(left), "r": F.col("r") + F.col(left), "t": F.col("t") + F.col(top), "b": F.col("b") + F.col(top)})


class _Crops:
    """Keeps the most confident of overlapping boxes of a frame."""

    def __init__(self, threshold: float) -> None:
        self.threshold, self.kept = threshold, []

    def step(self, box_id: int, l: float, t: float, r: float, b: float) -> tuple:  # noqa: E741
        area = (r - l) * (b - t)
        for k, kl, kt, kr, kb in self.kept:
            w, h = min(r, kr) - max(l, kl), min(b, kb) - max(t, kt)
            if w > 0 and h > 0:
                both = w * h
                if both / (area + (kr - kl) * (kb - kt) - both) >= self.threshold:
                    return (k,)
        self.kept.append((box_id, l, t, r, b))
        return (box_id,)


def merge_crops(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Boxes with the box that stands for them; a task remembers the kept boxes of one frame."""
    return sorted_fold(
        boxes, ["frame_id"], [F.desc("confidence"), F.asc("box_id")], lambda: _Crops(threshold), ("box_id", "l", "t", "r", "b"), "keeper_id bigint")


def kept_boxes(merged: DataFrame) -> DataFrame:
    """Kept boxes with the ids that support them."""
    return merged.groupBy("frame_id", "keeper_id").agg(
        F.array_sort(F.collect_list("box_id")).alias("supporting_ids"), F.max("confidence").alias("confidence"))
