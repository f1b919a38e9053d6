"""Ball CSV files paired with racket-pose JSON by path, and their frame features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Frame size the coordinates are scaled by, and the widths of the feature parts.
WIDTH, HEIGHT = 1920.0, 1080.0
RACKET_VALUES = 12

BALL = "Frame bigint, X double, Y double, Visibility double, Confidence double"
RACKETS = "keypoints array<array<double>>, keypoint_scores array<double>"
KEY = ["sport", "match_id", "rally_id"]


def _keys(path: Column, folder: str, leaf: str) -> list[Column]:
    pattern = rf"([^/]+)/{folder}/([^/]+)/([^/]+)/{leaf}$"
    return [F.regexp_extract(path, pattern, i).alias(k) for i, k in enumerate(KEY, start=1)]


def read_ball(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.schema(BALL).option("header", True).csv(f"{root}/*/interp_ball/*/*/results.csv")
    rows = rows.select("*", F.col("_metadata.file_path").alias("_path"))
    return rows.select(*_keys(F.col("_path"), "interp_ball", r"results\.csv"), *BALL.replace(" bigint", "").replace(" double", "").split(", "))


def read_rackets(spark: SparkSession, root: str) -> DataFrame:
    """One row per frame with its array of racket instances."""
    text = spark.read.option("wholetext", True).text(f"{root}/*/merged_racket/*/*/result.json")
    text = text.select("value", F.col("_metadata.file_path").alias("_path"))
    frames = F.from_json("value", f"array<array<struct<{', '.join(p.replace(' ', ':', 1) for p in RACKETS.split(', '))}>>>")
    rows = text.select(*_keys(F.col("_path"), "merged_racket", r"result\.json"), F.posexplode(frames).alias("frame", "rackets"))
    return rows.withColumn("frame", F.col("frame").cast("bigint"))


def read_splits(spark: SparkSession, root: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(f"{root}/*/info/*.json").select("value", F.col("_metadata.file_path").alias("_path"))
    name = F.regexp_extract("_path", r"/info/(train|val|test)\.json$", 1)
    pairs = text.filter(name != "").select(
        F.regexp_extract("_path", r"([^/]+)/info/[^/]+$", 1).alias("sport"),
        F.when(name == "val", "validation").otherwise(name).alias("split"), F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
    return pairs.select("sport", F.col("p")[0].alias("match_id"), F.col("p")[1].alias("rally_id"), "split")


def pair(ball: DataFrame, rackets: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequences that have both files with their split, and those that break the rules."""
    both = ball.select(*KEY).distinct().join(rackets.select(*KEY).distinct(), KEY, "left_semi")
    uses = splits.groupBy(*KEY).agg(F.countDistinct("split").alias("_n"), F.count("*").alias("_c"), F.first("split").alias("split"))
    joined = both.join(uses, KEY, "left")
    reason = F.when(F.col("_n").isNull(), "no_fixed_split").when(F.col("_c") > 1, "leaks_across_splits")
    judged = joined.withColumn("reason", reason)
    return judged.filter("reason is null").select(*KEY, "split"), judged.filter("reason is not null").select(*KEY, "reason")


def racket_values(rackets: Column) -> Column:
    """24 values: the two leftmost rackets of five points, each scaled, with score and flag."""
    points = lambda i: F.flatten(F.transform(i["keypoints"], lambda p: F.array(p[0] / WIDTH, p[1] / HEIGHT)))
    score = lambda i: F.when(F.size(i["keypoint_scores"]) > 0, F.aggregate(i["keypoint_scores"], F.lit(0.0), lambda a, v: a + v) / F.size(i["keypoint_scores"])).otherwise(0.0)
    usable = F.filter(rackets, lambda i: (F.size(i["keypoints"]) == 5) & F.forall(i["keypoints"], lambda p: F.size(p) >= 2))
    ranked = F.array_sort(F.transform(usable, lambda i: F.struct(
        (F.aggregate(i["keypoints"], F.lit(0.0), lambda a, p: a + p[0]) / 5).alias("x"),
        F.concat(points(i), F.array(score(i), F.lit(1.0))).alias("v"))))
    empty = F.array_repeat(F.lit(0.0), RACKET_VALUES)
    part = lambda n: F.coalesce(F.get(ranked, F.lit(n))["v"], empty)
    return F.concat(part(0), part(1))


def features(ball: DataFrame, rackets: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Dense 28-value rows: ball position, visibility and confidence, then both rackets."""
    seen = F.col("Visibility") > 0
    b = ball.select(*keys, F.col("Frame").alias("frame"), F.array(
        F.when(seen, F.col("X") / WIDTH).otherwise(0.0), F.when(seen, F.col("Y") / HEIGHT).otherwise(0.0),
        seen.cast("double"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "Confidence"))).alias("_b"))
    r = rackets.select(*keys, "frame", racket_values(F.col("rackets")).alias("_r"))
    both = b.join(r, [*keys, "frame"], "full_outer")
    none = lambda n: F.array_repeat(F.lit(0.0), n)
    return both.select(*keys, "frame", F.concat(F.coalesce("_b", none(4)), F.coalesce("_r", none(2 * RACKET_VALUES))).alias("features"))
