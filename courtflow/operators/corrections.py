"""Audited human corrections laid over predictions that stay untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions import geometry as G
from courtflow.operators import analytics as A

# Keys a correction of each type may carry.
ALLOWED = {
    "player_identity": ("playerId", "logicalIdentity", "displayName"),
    "rally_boundary": ("startFrame", "endFrame", "startTimestamp", "endTimestamp"),
    "bounce": ("isBounce", "frame", "timestampSeconds", "courtPosition"),
    "hitter": ("playerId",),
    "shot_type": ("shotType",),
}

# Fields of the predicted record that a correction of each type replaces.
SNAPSHOT = {
    "player_identity": ("player_id", "logical_identity", "display_name"),
    "rally_boundary": ("start_frame", "end_frame", "start_s", "end_s"),
    "bounce": ("is_bounce", "frame", "at_s", "court_x_m", "court_y_m"),
    "hitter": ("hitter_id",),
    "shot_type": ("shot_type",),
}


def validate(corrections: DataFrame, type_: str = "type", value: str = "value") -> DataFrame:
    """Corrections whose JSON value breaks the rules of their type, with the reason."""
    rows = corrections.withColumn("_m", F.from_json(value, "map<string,string>"))
    kind = F.col(type_)
    field = lambda name: F.col("_m")[name]
    keys = F.coalesce(F.map_keys("_m"), F.array().cast("array<string>"))
    extra = F.lit(False)
    for name, allowed in ALLOWED.items():
        extra = F.when(kind == name, F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0).otherwise(extra)
    blank = lambda c: c.isNull() | ~c.rlike(r"\S")
    whole = lambda n: field(n).isNull() | field(n).rlike(r"^[0-9]+$")
    seconds = lambda n: field(n).isNull() | field(n).rlike(r"^[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    number = lambda n: field(n).try_cast("double")
    backwards = (number("startFrame") > number("endFrame")) | (number("startTimestamp") > number("endTimestamp"))
    identity = blank(field("playerId")) & blank(field("logicalIdentity")) & blank(field("displayName"))
    reason = (
        F.when(F.size(keys) == 0, "empty")
        .when(~kind.isin(*ALLOWED), "unknown_type")
        .when(extra, "field_not_allowed")
        .when((kind == "player_identity") & identity, "identity_empty")
        .when((kind == "rally_boundary") & ~(whole("startFrame") & whole("endFrame") & seconds("startTimestamp") & seconds("endTimestamp")), "boundary_not_a_number")
        .when((kind == "rally_boundary") & F.coalesce(backwards, F.lit(False)), "boundary_order")
        .when((kind == "bounce") & ~F.coalesce(field("isBounce").isin("true", "false"), F.lit(False)), "bounce_flag")
        .when((kind == "bounce") & ~(whole("frame") & seconds("timestampSeconds")), "bounce_time")
        .when((kind == "hitter") & blank(field("playerId")), "hitter_empty")
        .when((kind == "shot_type") & ~F.coalesce(field("shotType").isin(*C.SHOT_TYPES), F.lit(False)), "shot_type_unknown")
    )
    # Exploding the one reason found keeps the rules from being evaluated twice.
    return rows.withColumn("reason", F.explode(F.array_compact(F.array(reason)))).drop("_m")


def snapshot(type_: Column, fields: dict[str, tuple[str, ...]]) -> Column:
    """The prediction a correction of a type replaces, as JSON; nulls are left out."""
    out = F.lit(None).cast("string")
    for name, columns in fields.items():
        out = F.when(type_ == name, F.to_json(F.struct(*columns))).otherwise(out)
    return out


def usable(corrections: DataFrame) -> DataFrame:
    return corrections.filter(F.col("active") & F.col("verified"))


def winning(corrections: DataFrame, type_: str, *values: str) -> DataFrame:
    """One correction per target: applied newest first, so the oldest has the last word."""
    rows = usable(corrections).filter(F.col("type") == type_)
    return rows.groupBy("match_id", "target_id").agg(
        F.min_by(F.struct(*values), F.struct("corrected_at", "correction_id")).alias("v")
    ).select("match_id", "target_id", *[F.col(f"v.{c}").alias(c) for c in values])


def targets(corrections: DataFrame, records: DataFrame) -> DataFrame:
    """Corrections with the record they reach by record id or by player id.

    The two ways are two equi-joins; a correction that reaches a record both ways
    counts once.
    """
    c = usable(corrections).select("match_id", "correction_id", "target_id")
    r = records.select("match_id", "record_id", "player_id")
    by_record = c.join(r.withColumn("target_id", F.col("record_id")), ["match_id", "target_id"])
    by_player = c.join(r.withColumn("target_id", F.col("player_id")), ["match_id", "target_id"])
    cols = ["match_id", "correction_id", "record_id"]
    return by_record.select(*cols).unionByName(by_player.select(*cols)).distinct()


def corrected_shots(shots: DataFrame, corrections: DataFrame) -> DataFrame:
    """Shots with effective class and hitter next to the predicted ones."""
    types = winning(corrections, "shot_type", "new_type").withColumnRenamed("target_id", "shot_id")
    hitters = winning(corrections, "hitter", "new_hitter").withColumnRenamed("target_id", "shot_id")
    out = shots.join(types, ["match_id", "shot_id"], "left").join(hitters, ["match_id", "shot_id"], "left")
    out = out.withColumn("effective_type", F.coalesce("new_type", "shot_type"))
    return out.withColumn("effective_hitter", F.coalesce("new_hitter", "hitter_id")).drop("new_type", "new_hitter")


def corrected_rallies(rallies: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rallies with corrected times; predictions keep their columns."""
    bounds = winning(corrections, "rally_boundary", "new_start_s", "new_end_s").withColumnRenamed("target_id", "rally_id")
    out = rallies.join(bounds, ["match_id", "rally_id"], "left")
    out = out.withColumn("effective_start_s", F.coalesce("new_start_s", "start_s"))
    return out.withColumn("effective_end_s", F.coalesce("new_end_s", "end_s")).drop("new_start_s", "new_end_s")


def identity_map(players: DataFrame) -> DataFrame:
    """Effective identity for both names of a player: its id and its logical role.

    ``players``: match_id, player_no, player_id, logical, effective. Later players
    win where names collide.
    """
    named = players.withColumn("identity", F.coalesce("effective", "logical", "player_id"))
    names = named.select("match_id", "player_no", "identity", F.posexplode(F.array("player_id", "logical")).alias("_p", "name"))
    names = names.filter("name is not null")
    return names.groupBy("match_id", "name").agg(F.max_by("identity", F.struct("player_no", "_p")).alias("identity"))


def apply_identities(shots: DataFrame, identities: DataFrame, hitter: str = "effective_hitter") -> DataFrame:
    names = identities.withColumnRenamed("name", hitter)
    return shots.join(names, ["match_id", hitter], "left").withColumn(hitter, F.coalesce("identity", hitter)).drop("identity")


def match_metrics(rallies: DataFrame, shots: DataFrame) -> DataFrame:
    """Match metrics on corrected records; reversed rally times leave the mean."""
    span = F.when(F.col("effective_end_s") >= F.col("effective_start_s"), F.col("effective_end_s") - F.col("effective_start_s"))
    out = rallies.groupBy("match_id").agg(F.count("*").alias("rally_count"), F.avg(span).alias("mean_duration_s"), F.avg(F.col("end_s") - F.col("start_s")).alias("predicted_mean_duration_s"))
    hits = shots.groupBy("match_id").agg(F.count("*").alias("shot_count"))
    out = out.join(hits, "match_id", "left").withColumn("shot_count", F.coalesce("shot_count", F.lit(0)))
    return out.withColumn("mean_length", G.ratio(F.col("shot_count"), F.col("rally_count")))


def player_metrics(shots: DataFrame) -> DataFrame:
    effective = shots.select("match_id", F.col("effective_hitter").alias("hitter_id"), F.col("effective_type").alias("shot_type"))
    return A.player_hits(effective)


def tactical_metrics(shots: DataFrame) -> DataFrame:
    now = A.third_shots(shots.withColumn("shot_type", F.col("effective_type")))
    then = A.third_shots(shots).select("match_id", F.col("drop_rate").alias("predicted_drop_rate"), F.col("drive_rate").alias("predicted_drive_rate"))
    return now.join(then, "match_id")


def append_history(corrections: DataFrame, entry: list[Column]) -> DataFrame:
    """Add one revision entry to each correction's history."""
    return corrections.withColumn("history", F.concat("history", F.array(F.struct(*entry))))
