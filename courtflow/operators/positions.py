"""Player court positions: correction, smoothing, movement and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions import geometry as G
from courtflow.functions.sequences import CHUNK_FRAMES, chunk_window, home_rows, runs, with_halo

KEYS = ("match_id", "role")
SMOOTHED = "smoothed"


def metric_eligible(x: str = "x_m", region: str = "region") -> Column:
    return F.coalesce(F.col(x).isNotNull() & F.col(region).isin("inside", "near"), F.lit(False))


def in_court_eligible(x: str = "x_m", y: str = "y_m", region: str = "region") -> Column:
    return metric_eligible(x, region) & F.coalesce(G.in_court(x, y), F.lit(False))


def apply_offsets(raw: DataFrame, offsets: DataFrame) -> DataFrame:
    """Add ``cx_m``/``cy_m``: raw point plus the recording's offset for the role.

    ``offsets`` holds four rows per match at most (match_id, role, dx_m, dy_m).
    """
    joined = raw.join(offsets, list(KEYS), "left")
    return (
        joined.withColumn("cx_m", F.col("x_m") + F.coalesce("dx_m", F.lit(0.0)))
        .withColumn("cy_m", F.col("y_m") + F.coalesce("dy_m", F.lit(0.0)))
        .drop("dx_m", "dy_m")
    )


def smoothing_status(settings: C.PositionSettings = C.PositionSettings(), x: str = "x_m") -> Column:
    return (
        F.when(F.col(x).isNull(), "missing_raw_court_coordinate")
        .when(F.col("state") == "suspected_identity_switch", "suspected_identity_switch")
        .when(F.col("confidence") < settings.min_confidence, "below_confidence_threshold")
        .otherwise(SMOOTHED)
    )


def _weighted_median(values: list[Column], weights: list[Column]) -> Column:
    """Least value at which the weight of all values up to it reaches half.

    ``weights`` are null for neighbours left out. Plain expressions over a handful
    of columns stay inside generated code, unlike functions over an array.
    """
    at = [F.coalesce(w, F.lit(0.0)) for w in weights]
    half = sum(at[1:], at[0]) / 2
    options = []
    for v, w in zip(values, weights):
        below = [F.when(other <= v, k).otherwise(0.0) for other, k in zip(values, at)]
        options.append(F.when(w.isNotNull() & (sum(below[1:], below[0]) >= half), v))
    return F.least(*options) if len(options) > 1 else options[0]


def _smoothed(rows: DataFrame, settings: C.PositionSettings, x: str, y: str) -> DataFrame:
    """Smoothing columns on rows already laid out in chunks with their halo.

    Neighbours come by ``lag`` and ``lead`` and count while the run of eligible
    frames between them and the row is unbroken.
    """
    radius = settings.smoothing_window // 2
    w = chunk_window(KEYS, "frame")
    eligible = F.col("status") == SMOOTHED
    sample = F.when(eligible, F.struct(F.col("frame").alias("f"), F.col(x).alias("x"), F.col(y).alias("y"), F.greatest("confidence", F.lit(1e-6)).alias("w")))
    rows = rows.withColumn("_0", sample)
    for o in range(1, radius + 1):
        rows = rows.withColumn(f"_-{o}", F.lag("_0", o).over(w)).withColumn(f"_{o}", F.lead("_0", o).over(w))
    for sign in (-1, 1):
        for o in range(1, radius + 1):
            name, inner = f"_{sign * o}", f"_{sign * (o - 1)}" if o > 1 else "_0"
            whole = F.col(f"`{inner}`").isNotNull() & (F.col(f"`{name}`.f") == F.col("frame") + sign * o)
            rows = rows.withColumn(name, F.when(whole, F.col(f"`{name}`")))
    near = [F.col(f"`_{o}`") for o in range(-radius, radius + 1)]
    weights = [n["w"] for n in near]
    rows = rows.withColumn("_mx", F.when(eligible, _weighted_median([n["x"] for n in near], weights)))
    rows = rows.withColumn("_my", F.when(eligible, _weighted_median([n["y"] for n in near], weights)))
    rows = rows.withColumn("support_frames", F.when(eligible, F.array_compact(F.array(*[n["f"] for n in near]))))
    shift = G.hypot(F.col("_mx") - F.col(x), F.col("_my") - F.col(y))
    rows = rows.withColumn("_s", F.when(shift > settings.max_adjustment_m, settings.max_adjustment_m / shift))

    def bounded(median: str, raw: str) -> Column:
        moved = F.col(raw) + (F.col(median) - F.col(raw)) * F.col("_s")
        return F.when(F.col("_s").isNull(), F.col(median)).otherwise(moved)

    rows = rows.withColumn("sx_m", bounded("_mx", x)).withColumn("sy_m", bounded("_my", y))
    return rows.drop("_mx", "_my", "_s", *[f"_{o}" for o in range(-radius, radius + 1)])


def smooth(
    raw: DataFrame,
    settings: C.PositionSettings = C.PositionSettings(),
    x: str = "x_m",
    y: str = "y_m",
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Confidence-weighted component median over a short unbroken neighbourhood.

    Adds ``status``, ``sx_m``/``sy_m`` and ``support_frames``; ineligible rows stay
    null and end the neighbourhood. The shift is limited.
    """
    radius = settings.smoothing_window // 2
    rows = with_halo(raw.withColumn("status", smoothing_status(settings, x)), "frame", radius, radius, chunk)
    return home_rows(_smoothed(rows, settings, x, y))


def steps(
    positions: DataFrame,
    settings: C.PositionSettings = C.PositionSettings(),
    x: str = "x_m",
    y: str = "y_m",
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """Eligible rows with the step from the frame before.

    ``outcome`` is ``accepted``, ``speed`` (too fast) or null (no eligible row in
    the frame before, or a bad time step): those are gap exclusions or the first row.
    """
    rows = with_halo(positions.filter(metric_eligible(x)), "frame", 1, 0, chunk)
    w = chunk_window(KEYS, "frame")
    before = {c: F.lag(c).over(w) for c in ("frame", "t_s", x, y)}
    rows = rows.withColumn("_pf", before["frame"]).withColumn("dt_s", F.col("t_s") - before["t_s"])
    rows = rows.withColumn("dx_m", F.col(x) - before[x]).withColumn("dy_m", F.col(y) - before[y])
    rows = home_rows(rows)
    linked = (F.col("frame") == F.col("_pf") + 1) & (F.col("dt_s") > 0) & (F.col("dt_s") <= settings.max_step_gap_s)
    rows = rows.withColumn("step_m", F.when(linked, G.hypot(F.col("dx_m"), F.col("dy_m"))))
    outcome = F.when(F.col("step_m").isNull(), None).when(
        F.col("step_m") / F.col("dt_s") > settings.max_step_speed, "speed"
    ).otherwise("accepted")
    return rows.withColumn("outcome", outcome).drop("_pf")


def _accepted(c: Column) -> Column:
    return F.when(F.col("outcome") == "accepted", c)


def movement(stepped: DataFrame) -> DataFrame:
    """Distance travelled and step accounting per player (null without a step)."""
    accepted = F.count(_accepted(F.lit(1)))
    speed = F.count(F.when(F.col("outcome") == "speed", 1))
    lateral = F.abs(F.col("dx_m"))
    return stepped.groupBy(*KEYS).agg(
        F.sum(_accepted(F.col("step_m"))).alias("distance_m"),
        accepted.alias("steps"),
        (F.count("*") - 1 - accepted - speed).alias("gap_steps"),
        speed.alias("speed_steps"),
        F.sum(_accepted(lateral)).alias("lateral_m"),
        (F.sum(_accepted(lateral)) / F.sum(_accepted(F.col("dt_s")))).alias("mean_lateral_mps"),
        F.max(_accepted(lateral / F.col("dt_s"))).alias("max_lateral_mps"),
    )


def lateral(positions: DataFrame, x: str = "x_m") -> DataFrame:
    """Sideways range and spread over eligible rows."""
    return positions.filter(metric_eligible(x)).groupBy(*KEYS).agg(
        (F.max(x) - F.min(x)).alias("lateral_range_m"), F.stddev_pop(x).alias("lateral_stddev_m")
    )


def occupancy(
    positions: DataFrame,
    fps: float,
    settings: C.PositionSettings = C.PositionSettings(),
    x: str = "x_m",
    y: str = "y_m",
) -> DataFrame:
    """Frames, seconds and share per zone; every player has all three zones."""
    z = F.when(in_court_eligible(x, y), G.zone(y, settings.transition_depth_m))
    counts = positions.groupBy(*KEYS).agg(*[F.count(F.when(z == name, 1)).alias(name) for name in C.ZONES])
    total = sum((F.col(name) for name in C.ZONES), F.lit(0))
    long = counts.withColumn("in_court_frames", total.cast("bigint")).unpivot(
        [*KEYS, "in_court_frames"], list(C.ZONES), "zone", "frames"
    )
    return long.withColumn("seconds", F.col("frames") / fps).withColumn(
        "share", G.ratio(F.col("frames"), F.col("in_court_frames"))
    )


def kitchen_distance(positions: DataFrame, x: str = "x_m", y: str = "y_m") -> DataFrame:
    return positions.groupBy(*KEYS).agg(
        F.avg(F.when(in_court_eligible(x, y), G.kitchen_setback(y))).alias("kitchen_distance_m"),
        F.count(F.when(in_court_eligible(x, y), 1)).alias("samples"),
    )


def team_of(role: str = "role") -> Column:
    out = F.lit(None).cast("string")
    for team, roles in C.TEAMS.items():
        out = F.when(F.col(role).isin(*roles), team).otherwise(out)
    return out


def joint_frames(positions: DataFrame, x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Frames in which both partners of a team are eligible: both points in one row.

    Partners meet in a group of at most two rows keyed by match, team and frame,
    so one aggregation replaces a self-join.
    """
    rows = positions.filter(metric_eligible(x)).withColumn("team", team_of())
    first = F.col("role").isin(*[r[0] for r in C.TEAMS.values()])
    pairs = rows.groupBy("match_id", "team", "frame").agg(
        F.max(F.when(first, F.col(x))).alias("ax"),
        F.max(F.when(first, F.col(y))).alias("ay"),
        F.max(F.when(~first, F.col(x))).alias("bx"),
        F.max(F.when(~first, F.col(y))).alias("by"),
    )
    return pairs.filter(F.col("ax").isNotNull() & F.col("bx").isNotNull())


def _spacing(positions: DataFrame, x: str, y: str) -> DataFrame:
    return joint_frames(positions, x, y).groupBy("match_id", "team").agg(
        F.avg(G.distance("ax", "ay", "bx", "by")).alias("spacing_m"), F.count("*").alias("samples")
    )


def partner_spacing(positions: DataFrame, x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Mean partner distance per team, with its coverage of the match's frames."""
    size = positions.groupBy("match_id").agg((F.max("frame") + 1).alias("frame_count"))
    size = size.withColumn("team", F.explode(F.array(*map(F.lit, C.TEAMS))))
    spacing = _spacing(positions, x, y)
    out = size.join(spacing, ["match_id", "team"], "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return out.withColumn("coverage", F.col("samples") / F.col("frame_count")).drop("frame_count")


def coverage(positions: DataFrame, x: str = "x_m") -> DataFrame:
    """Eligible and source frame counts per player."""
    return positions.groupBy(*KEYS).agg(
        F.count("*").alias("source_frames"),
        F.count(F.when(F.col("x_m").isNotNull(), 1)).alias("raw_frames"),
        F.count(F.when(metric_eligible(x), 1)).alias("eligible_frames"),
        (F.count(F.when(metric_eligible(x), 1)) / F.count("*")).alias("coverage"),
    )


def contributing_ranges(positions: DataFrame, x: str = "x_m", chunk: int = CHUNK_FRAMES) -> DataFrame:
    """Unbroken frame ranges of the eligible rows."""
    return runs(positions.filter(metric_eligible(x)), KEYS, "frame", chunk)


def heatmap(positions: DataFrame, x: str = "x_m", y: str = "y_m", rows: int = 96, cols: int = 48) -> DataFrame:
    """Counts on a court grid; the far edge belongs to the last cell."""

    def cell(c: str, size: float, n: int) -> Column:
        return F.least(F.floor(F.col(c) / size * n), F.lit(n - 1)).cast("bigint")

    return (
        positions.filter(in_court_eligible(x, y))
        .groupBy(*KEYS, cell(y, C.COURT_LENGTH_M, rows).alias("row_ix"), cell(x, C.COURT_WIDTH_M, cols).alias("col_ix"))
        .agg(F.count("*").alias("frames"))
    )


def player_summary(
    raw: DataFrame,
    fps: float,
    settings: C.PositionSettings = C.PositionSettings(),
    chunk: int = CHUNK_FRAMES,
) -> DataFrame:
    """All position metrics of a player in one row, on smoothed points.

    Smoothing and steps share one layout of chunks, so the timeline is shuffled once
    for all windows, and the sums combine on the map side. Partners meet by frame;
    both get their team's spacing.
    """
    x, y = "sx_m", "sy_m"
    radius = settings.smoothing_window // 2
    ok, inside = metric_eligible(x), in_court_eligible(x, y)
    # The step needs the smoothed row before, so the halo reaches one frame further back.
    halo = with_halo(raw.withColumn("status", smoothing_status(settings)), "frame", radius + 1, radius, chunk)
    halo = _smoothed(halo, settings, "x_m", "y_m").drop("support_frames").withColumn("_ok", ok)
    w = chunk_window(KEYS, "frame")
    dt = F.col("t_s") - F.lag("t_s").over(w)
    linked = F.col("_ok") & F.lag("_ok").over(w) & (F.col("frame") == F.lag("frame").over(w) + 1)
    halo = halo.withColumn("dt_s", F.when(linked, dt))
    halo = halo.withColumn("dx_m", F.col(x) - F.lag(x).over(w)).withColumn("dy_m", F.col(y) - F.lag(y).over(w))
    # A column of the same window: partners then meet on worked-out points, not on the formula of the median.
    point = F.first(F.when(F.col("_ok"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).over(w.rowsBetween(0, 0))
    rows = home_rows(halo.withColumn("_point", point))
    timed = (F.col("dt_s") > 0) & (F.col("dt_s") <= settings.max_step_gap_s)
    rows = rows.withColumn("step_m", F.when(timed, G.hypot(F.col("dx_m"), F.col("dy_m"))))
    # Flags and values are columns of their own, so the aggregate stays small enough to be compiled.
    rows = rows.withColumn("_slow", F.col("step_m") / F.col("dt_s") <= settings.max_step_speed).withColumn("_in", inside)
    rows = rows.withColumn("_zone", F.when(F.col("_in"), G.zone(y, settings.transition_depth_m)))
    rows = rows.withColumn("_setback", F.when(F.col("_in"), G.kitchen_setback(y))).withColumn("_x", F.when(F.col("_ok"), F.col(x)))
    rows = rows.withColumn("_dt", F.when(F.col("_slow"), F.col("dt_s"))).withColumn("_side", F.when(F.col("_slow"), F.abs("dx_m")))
    n_ok, n_in, n_step, n_fast = F.count_if("_ok"), F.count_if("_in"), F.count_if("_slow"), F.count_if(~F.col("_slow"))
    out = rows.groupBy(*KEYS).agg(
        F.max("frame").alias("_last"),
        F.count("*").alias("source_frames"),
        F.count("x_m").alias("raw_frames"),
        F.count(x).alias("smoothed_frames"),
        n_ok.alias("eligible_frames"),
        n_in.alias("in_court_frames"),
        F.sum(F.when(F.col("_slow"), F.col("step_m"))).alias("distance_m"),
        n_step.alias("steps"),
        F.greatest(n_ok - 1 - n_step - n_fast, F.lit(0)).alias("gap_steps"),
        n_fast.alias("speed_steps"),
        F.sum("_side").alias("lateral_m"),
        F.try_divide(F.sum("_side"), F.sum("_dt")).alias("mean_lateral_mps"),
        F.max(F.col("_side") / F.col("_dt")).alias("max_lateral_mps"),
        F.avg("_setback").alias("kitchen_distance_m"),
        (F.max("_x") - F.min("_x")).alias("lateral_range_m"),
        F.stddev_pop("_x").alias("lateral_stddev_m"),
        *[F.count_if(F.col("_zone") == name).alias(f"{name}_frames") for name in C.ZONES],
    )
    for name in C.ZONES:
        frames = F.col(f"{name}_frames")
        out = out.withColumn(f"{name}_seconds", frames / fps).withColumn(f"{name}_share", G.ratio(frames, F.col("in_court_frames")))
    out = out.withColumn("coverage", F.col("eligible_frames") / F.col("source_frames"))
    # One row per player from here on.
    spacing = _spacing(rows, "_point.x", "_point.y").withColumnRenamed("samples", "spacing_samples")
    out = out.withColumn("team", team_of()).join(spacing, ["match_id", "team"], "left").fillna(0, "spacing_samples")
    length = F.max("_last").over(W.partitionBy("match_id")) + 1
    return out.withColumn("spacing_coverage", F.col("spacing_samples") / length).drop("team", "_last")
