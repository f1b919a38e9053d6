"""Clocks, the event timeline, landing points and label precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtflow.functions import geometry as G


def frame_to_media(frame: Column, fps: float, video_start_s: Column | float = 0.0) -> Column:
    start = video_start_s if isinstance(video_start_s, Column) else F.lit(float(video_start_s))
    return F.coalesce(start, F.lit(0.0)) + frame / fps


def sample_to_media(sample: Column, rate: int, audio_start_s: Column | float, offset_ms: Column | float) -> Column:
    start = audio_start_s if isinstance(audio_start_s, Column) else F.lit(float(audio_start_s))
    return F.coalesce(start, F.lit(0.0)) + sample / rate + offset_ms / 1000.0


def _on_video(df: DataFrame, t: Column, fps: float, duration: Column) -> DataFrame:
    rows = df.withColumn("_t", t).filter((F.col("_t") >= -1 / fps) & (F.col("_t") <= duration + 1 / fps))
    return rows.withColumn("video_s", F.greatest(F.lit(0.0), "_t")).drop("_t")


def transients_from_media(df: DataFrame, fps: float) -> DataFrame:
    """Transients on video time from their stored media time (rally variant)."""
    return _on_video(df, F.col("media_s") - F.col("video_start_s"), fps, F.col("duration_s"))


def transients_from_analysis(df: DataFrame, fps: float) -> DataFrame:
    """The same with the configured offset applied anew (bounce and contact variant)."""
    t = F.col("audio_start_s") + F.col("analysis_s") + F.col("offset_ms") / 1000.0 - F.col("video_start_s")
    return _on_video(df, t, fps, F.col("duration_s"))


def event_timeline(rallies: DataFrame, contacts: DataFrame, bounces: DataFrame, shots: DataFrame) -> DataFrame:
    """Rally starts and ends, contacts, bounces and shots of a match in one table.

    Times come from the first column present; refuted bounces are left out. Readers
    sort what they show; no global sort is forced on the whole table.
    """

    def time_of(df: DataFrame) -> Column:
        names = [c for c in ("timestamp", "timestamp_s", "contact_s", "media_s", "t_s") if c in df.columns]
        return F.coalesce(*names)

    def rows(df: DataFrame, kind: str, key: str, t: Column, suffix: str = "") -> DataFrame:
        label = F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"), F.lit(suffix))
        best = F.coalesce(*[c for c in ("fused", "confidence") if c in df.columns])
        return df.select("match_id", label.alias("event"), F.lit(kind).alias("kind"), t.alias("at_s"), best.alias("confidence")).filter("at_s is not null")

    kept = bounces.filter(F.coalesce("is_bounce", F.lit(True))) if "is_bounce" in bounces.columns else bounces
    return (
        rows(rallies, "rally", "rally_id", F.col("start_s"), "-start")
        .unionByName(rows(rallies, "rally", "rally_id", F.col("end_s"), "-end"))
        .unionByName(rows(contacts, "contact", "contact_id", time_of(contacts)))
        .unionByName(rows(kept, "bounce", "bounce_id", time_of(kept)))
        .unionByName(rows(shots, "shot", "shot_id", time_of(shots)))
    )


def landing_points(shots: DataFrame, x: str = "landing_x_m", y: str = "landing_y_m") -> DataFrame:
    """Landing points inside the court with their class."""
    return shots.filter(G.in_court(x, y)).withColumn("shot_type", F.coalesce("shot_type", F.lit("UNKNOWN")))


def shot_labels(events: DataFrame, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """One label per frame, shot-type marks before contact marks, the first on a tie;
    and the number of unsupported labels per match."""
    rows = events.filter(F.col("type").isin("SHOT_TYPE", "SERVE_CONTACT", "PADDLE_CONTACT") & F.col("shot_type").isNotNull())
    rows = rows.withColumn("shot_type", F.upper("shot_type")).withColumn("_ok", F.col("shot_type").isin(*known))
    first = W.partitionBy("match_id", "frame").orderBy(F.when(F.col("type") == "SHOT_TYPE", 0).otherwise(1), "event_id")
    best = rows.filter("_ok").withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_ok")
    return best, rows.groupBy("match_id").agg(F.count_if(~F.col("_ok")).alias("unsupported"))
