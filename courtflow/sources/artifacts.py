"""JSON artifacts in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtflow import schemas


def read_records(spark: SparkSession, path: str, element_schema: str, records_key: str | None = None, fields: dict[str, str] | None = None) -> DataFrame:
    """One row per element of the array under ``records_key`` (or of the root array).

    ``fields`` renames dotted element fields, such as ``{"t_s": "time.seconds"}``.
    The file path comes along as ``source_path``.
    """
    element = T._parse_datatype_string(element_schema)
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    if records_key is None:
        rows = reader.schema(element).json(path).withColumn("source_path", F.col("_metadata.file_path"))
        rows = rows.select(F.struct(*[c for c in rows.columns if c != "source_path"]).alias("r"), "source_path")
    else:
        names = records_key.split(".")
        schema = T.ArrayType(element)
        for name in reversed(names):
            schema = T.StructType([T.StructField(name, schema)])
        rows = reader.schema(schema).json(path)
        rows = rows.select(F.explode(F.col(records_key)).alias("r"), F.col("_metadata.file_path").alias("source_path"))
    if fields is None:
        return rows.select("r.*", "source_path")
    return rows.select(*[F.col(f"r.{source}").alias(name) for name, source in fields.items()], "source_path")


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored frame or event table under its fixed schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def with_boxes(rows: DataFrame, detections: DataFrame, key: str = "observation_id") -> DataFrame:
    """Frame rows with the box of the detection they name."""
    boxes = detections.select("match_id", F.col("detection_id").alias(key), "l", "t", "r", "b")
    return rows.join(boxes, ["match_id", key], "left")


def write_once(df: DataFrame, path: str, format: str = "parquet") -> None:  # noqa: A002
    """Write an artifact; an existing one is never replaced."""
    df.write.mode("errorifexists").format(format).save(path)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file under ``path``, for lineage checks."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("content_hash"))
