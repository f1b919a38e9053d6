"""Checks on tables: completeness, compatibility, lineage, keys and values.

Every check returns its violations as rows, so nothing is collected to raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions import geometry as G
from courtflow.functions.sequences import last_before


def landmark_residuals(landmarks: DataFrame, image_to_court: list, court_to_image: list) -> DataFrame:
    """Errors of each landmark in metres and pixels (u, v image; cx, cy court)."""
    px, py = G.project("u", "v", image_to_court)
    qx, qy = G.project("cx", "cy", court_to_image)
    return landmarks.withColumn("court_m", G.hypot(px - F.col("cx"), py - F.col("cy"))).withColumn(
        "image_px", G.hypot(qx - F.col("u"), qy - F.col("v")))


def calibration_quality(residuals: DataFrame, video: C.Video | G.Camera) -> DataFrame:
    """RMSE and maxima over all landmarks and over inliers, with the warnings they give.

    With a ``Camera`` the size of each match's own image sets its limit.
    """
    keys = ["match_id", "width", "height"] if isinstance(video, G.Camera) else ["match_id"]
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    inner = lambda c: F.sqrt(F.avg(F.when(F.col("inlier"), F.col(c) * F.col(c))))
    out = residuals.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(~F.col("inlier")).alias("outliers"),
        rms("court_m").alias("rmse_m"), F.max("court_m").alias("max_m"), rms("image_px").alias("rmse_px"), F.max("image_px").alias("max_px"),
        inner("court_m").alias("inlier_rmse_m"), inner("image_px").alias("inlier_rmse_px"))
    warnings = F.array_compact(F.array(
        F.when(F.col("n") == 4, "four_points_only"), F.when(F.col("outliers") > 0, "outliers"),
        F.when(F.col("rmse_px") > 0.003 * video.diagonal, "image_rmse"), F.when(F.col("rmse_m") > 0.08, "court_rmse")))
    out = out.withColumn("warnings", warnings).drop(*keys[1:])
    return out.withColumn("status", F.when(F.size("warnings") > 0, "warning").otherwise("pass"))


def frame_completeness(frames: DataFrame, keys: Sequence[str], fps: float, tolerance_s: float = 1e-6) -> DataFrame:
    """Timelines whose frames are not exactly 0..n-1, or whose times do not fit the rate.

    Duplicates are found from sums that partial aggregation can combine: with
    n rows between 0 and n-1 all distinct iff each frame occurs once.
    """
    per_frame = frames.groupBy(*keys, "frame").agg(
        F.count("*").alias("_c"), F.max(F.abs(F.col("t_s") - F.col("frame") / fps)).alias("_d"))
    out = per_frame.groupBy(*keys).agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.sum("_c").alias("rows"),
        F.count("*").alias("frames"), F.count_if(F.col("_d") > tolerance_s).alias("bad_times"))
    reasons = F.array_compact(F.array(
        F.when(F.col("first_frame") != 0, "does_not_start_at_zero"),
        F.when(F.col("rows") != F.col("frames"), "duplicate_frames"),
        F.when(F.col("last_frame") - F.col("first_frame") + 1 != F.col("frames"), "missing_frames"),
        F.when(F.col("bad_times") > 0, "timestamps_off")))
    return out.withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def source_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matches whose two inputs were not made from the same video."""
    names = ("width", "height", "frame_count", "fps", "duration_s")
    b = right.select("match_id", *[F.col(n).alias(f"_{n}") for n in names])
    both = left.join(b, "match_id")
    close = lambda n, rel, ab: F.abs(F.col(n) - F.col(f"_{n}")) <= F.greatest(rel * F.greatest(F.abs(n), F.abs(f"_{n}")), F.lit(ab))
    tests = {n: F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names[:3]}
    tests["fps"], tests["duration_s"] = close("fps", 1e-6, 1e-6), close("duration_s", 1e-6, 1e-3)
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), n) for n, ok in tests.items()]))
    return both.withColumn("fields", bad).filter(F.size("fields") > 0).select("match_id", "fields")


def lineage_breaks(shots: DataFrame, rallies: DataFrame) -> DataFrame:
    """Shot artifacts that name another content hash than the rallies they stand on."""
    have = rallies.select("match_id", F.col("content_hash").alias("actual_hash"))
    joined = shots.select("match_id", F.col("rallies_hash").alias("named_hash")).distinct().join(have, "match_id", "left")
    return joined.filter(~F.col("named_hash").eqNullSafe(F.col("actual_hash")))


def rally_violations(rallies: DataFrame, frame_count: Column | int, chunk: int = 16384) -> DataFrame:
    """Rallies out of range, reversed, overlapping the one before, or with a used id."""
    limit = frame_count if isinstance(frame_count, Column) else F.lit(frame_count)
    rows = last_before(rallies, ("match_id",), "start_frame", F.col("end_frame"), chunk, "_pe", tie=["rally_id", "end_frame"])
    ids = rallies.groupBy("match_id", "rally_id").agg(F.count("*").alias("_n")).filter("_n > 1")
    rows = rows.join(ids, ["match_id", "rally_id"], "left")
    reasons = F.array_compact(F.array(
        F.when((F.col("start_frame") < 0) | (F.col("end_frame") < F.col("start_frame")) | (F.col("end_frame") >= limit), "invalid_interval"),
        F.when(F.col("start_frame") <= F.col("_pe"), "overlaps_previous"), F.when(F.col("_n").isNotNull(), "duplicate_id")))
    return rows.withColumn("reason", F.explode(reasons)).select("match_id", "rally_id", "start_frame", "reason")


def shot_violations(shots: DataFrame, rallies: DataFrame) -> DataFrame:
    """Shots of no rally, and shot numbers that do not run 1, 2, 3 in their rally.

    Numbers run without a gap iff minimum, maximum and distinct count agree, so the
    rally is summed up instead of sorted. Distinct numbers are bits, 62 to a word: a
    rally is a row or few as soon as its shots meet, and rallies are looked up by these.
    """
    keys, i = ["match_id", "rally_id"], F.col("shot_index")
    bit = F.expr("shiftleft(1L, cast(pmod(shot_index, 62) as int))")
    words = shots.groupBy(*keys, F.floor(i / 62).alias("_w")).agg(
        F.min(i).alias("_lo"), F.max(i).alias("_hi"), F.bit_or(bit).alias("_bits"), F.count("*").alias("_c"))
    runs = words.groupBy(*keys).agg(
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum(F.bit_count("_bits")).alias("_d"), F.sum("_c").alias("shots"))
    whole = (F.col("_lo") == 1) & (F.col("_hi") == F.col("_d")) & (F.col("shots") == F.col("_d"))
    known = rallies.select(*keys).distinct().withColumn("_known", F.lit(True))
    reasons = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), "unknown_rally"), F.when(~F.coalesce(whole, F.lit(False)), "index_not_contiguous")))
    return runs.join(known, keys, "left").select(*keys, "shots", F.explode(reasons).alias("reason"))


RECORD_LIMIT_BYTES = 2 * 1024 * 1024
# A whole JSON string; unrolled, so that long strings need no deep matching.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# Fields whose bytes belong in a file, in lower case without underscores.
BINARY_FIELDS = (
    "audiowaveform", "audiowaveforms", "debugartifactbytes", "modelweights", "mp4bytes", "rawdetectionarrays", "rawframes", "rawvideoframes", "videobytes",
)


def record_violations(records: DataFrame, id_column: str, payload: str = "payload", numbers: Sequence[str] = (), limit: int = RECORD_LIMIT_BYTES) -> DataFrame:
    """Records with numbers that are not finite, unsafe or binary field names, or too many bytes.

    Field names, with their escapes decoded, and numbers are read at any depth: a key is unsafe
    when it is empty, starts with a dollar sign or holds a dot; a number is not finite
    when it is written NaN or Infinity or has a fraction or exponent and no finite double.
    """
    strings = F.regexp_extract_all(F.col(payload), F.lit(JSON_STRING + r"(?:\s*:)?"), F.lit(0))
    names = F.transform(F.filter(strings, lambda s: s.endswith(":")), lambda s: F.rtrim(F.substring(s, F.lit(1), F.length(s) - 1), F.lit(" \t\r\n")))
    keys = F.from_json(F.concat(F.lit("["), F.array_join(names, ","), F.lit("]")), "array<string>")
    unsafe = F.exists(keys, lambda k: (k == "") | k.startswith("$") | k.contains("."))
    binary = F.exists(keys, lambda k: F.lower(F.replace(k, F.lit("_"), F.lit(""))).isin(*BINARY_FIELDS))
    bare = F.regexp_replace(F.col(payload), JSON_STRING, '""')  # without what strings hold
    words = r"(?<![\w-])-?(?:NaN|Infinity)(?!\w)"
    floats = F.regexp_extract_all(bare, F.lit(r"-?[0-9]+(?:\.[0-9]+)?[eE][-+]?[0-9]+|-?[0-9]+\.[0-9]+"), F.lit(0))
    worded = F.coalesce(bare.rlike(words), F.lit(False))
    bad_number = worded | F.coalesce(F.exists(floats, lambda x: F.abs(x.try_cast("double")) == float("inf")), F.lit(False))
    no_object = F.get_json_object(payload, "$").isNull() & ~(worded & F.get_json_object(F.regexp_replace(bare, words, "0"), "$").isNotNull())
    for c in numbers:
        bad_number = bad_number | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(bad_number, F.lit(False)), "not_finite"), F.when(F.coalesce(unsafe, F.lit(False)), "unsafe_field_name"),
        F.when(F.coalesce(binary, F.lit(False)), "binary_field_name"),
        F.when(F.octet_length(payload) > limit, "too_large"), F.when(no_object, "not_an_object")))
    return records.withColumn("reason", F.explode(reasons)).select(id_column, "reason")


def duplicate_keys(rows: DataFrame, keys: Sequence[str], only: Column | None = None) -> DataFrame:
    """Keys used more than once, among the rows the rule covers."""
    covered = rows if only is None else rows.filter(only)
    return covered.groupBy(*keys).agg(F.count("*").alias("uses")).filter("uses > 1")


def immutable_changes(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Updates that would change a field which must never change."""
    b = new.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    changed = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fields]))
    return old.join(b, key).withColumn("fields", changed).filter(F.size("fields") > 0).select(key, "fields")


def split_leaks(rows: DataFrame, unit: str = "unit", split: str = "split") -> DataFrame:
    """Units that occur in more than one split."""
    return rows.groupBy(unit).agg(F.countDistinct(split).alias("splits")).filter("splits > 1")


def window_rank(keys: Sequence[str], *order: Column) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))
