"""Match, player, team and tactical metrics over rallies, shots and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions import geometry as G
from courtflow.functions.sequences import interval_join
from courtflow.operators import positions as P

RALLY_BUCKET_FRAMES = 2048


def with_duration(rallies: DataFrame) -> DataFrame:
    return rallies.withColumn("duration_s", F.col("end_s") - F.col("start_s"))


def rally_lengths(rallies: DataFrame, shots: DataFrame) -> DataFrame:
    """Rallies with their shot count; shots are summed up before the join."""
    counts = shots.groupBy("match_id", "rally_id").agg(F.count("*").alias("shot_count"))
    out = with_duration(rallies).join(counts, ["match_id", "rally_id"], "left")
    return out.withColumn("shot_count", F.coalesce("shot_count", F.lit(0)))


def longest_rally(lengths: DataFrame) -> DataFrame:
    """Top rally per match: most shots, then longest, then earliest start."""
    best = F.max(F.struct("shot_count", "duration_s", (-F.col("start_frame")).alias("early"), (-F.col("rally_id")).alias("rid")))
    return lengths.groupBy("match_id").agg(best.alias("b")).select(
        "match_id",
        (-F.col("b.rid")).alias("rally_id"),
        F.col("b.shot_count").alias("shot_count"),
        F.col("b.duration_s").alias("duration_s"),
        (-F.col("b.early")).alias("start_frame"),
    )


def match_metrics(rallies: DataFrame, shots: DataFrame) -> DataFrame:
    best = F.max(F.struct("shot_count", "duration_s", (-F.col("start_frame")).alias("early"), (-F.col("rally_id")).alias("rid")))
    out = rally_lengths(rallies, shots).groupBy("match_id").agg(
        F.count("*").alias("rally_count"),
        F.sum("shot_count").alias("shot_count"),
        F.avg("duration_s").alias("mean_duration_s"),
        (F.sum("shot_count") / F.count("*")).alias("mean_length"),
        F.avg("confidence").alias("mean_rally_confidence"),
        best.alias("b"),
    )
    return out.withColumn("longest_rally_id", -F.col("b.rid")).withColumn("longest_shots", F.col("b.shot_count")).drop("b")


def _matches(shots: DataFrame, matches: DataFrame | None) -> DataFrame:
    """Every match to report on: those given, or those with a shot."""
    return (shots if matches is None else matches).select("match_id").distinct()


def _players(shots: DataFrame, matches: DataFrame | None) -> DataFrame:
    return _matches(shots, matches).withColumn("player_id", F.explode(F.array(*map(F.lit, C.ROLES))))


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def player_hits(shots: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Hits per player and counted class, with the rate over classified hits.

    Counts for all players of a match come from one pass; players without a shot,
    in any of ``matches``, get zero counts and null rates.
    """
    counts = shots.groupBy("match_id", F.col("hitter_id").alias("player_id")).agg(
        F.count("*").alias("hits"),
        _count(F.col("shot_type") != C.UNKNOWN).alias("classified"),
        *[_count(F.col("shot_type") == name).alias(name) for name in C.COUNTED_SHOT_TYPES],
    )
    wide = _players(shots, matches).join(counts, ["match_id", "player_id"], "left").fillna(0)
    long = wide.unpivot(["match_id", "player_id", "hits", "classified"], list(C.COUNTED_SHOT_TYPES), "shot_type", "n")
    return long.withColumn("rate", G.ratio(F.col("n"), F.col("classified")))


def third_shots(shots: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Third shots with the shares of drops and drives; zero counts where a match has no shot."""
    third = F.col("shot_index") == 3
    known = third & (F.col("shot_type") != C.UNKNOWN)
    out = shots.groupBy("match_id").agg(
        _count(third).alias("third_shots"),
        _count(known).alias("classified"),
        _count(third & (F.col("shot_type") == "DROP")).alias("drops"),
        _count(third & (F.col("shot_type") == "DRIVE")).alias("drives"),
    )
    out = _matches(shots, matches).join(out, "match_id", "left").fillna(0)
    return out.withColumn("drop_rate", G.ratio(F.col("drops"), F.col("classified"))).withColumn(
        "drive_rate", G.ratio(F.col("drives"), F.col("classified"))
    )


def shot_zone(depth: float = C.NVZ_DEPTH_M) -> Column:
    ok = F.col("hitter_x_m").isNotNull() & F.col("hitter_region").isin("inside", "near")
    return F.when(ok, G.zone("hitter_y_m", depth))


def shot_selection(shots: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Class counts and rates per zone, with what was left out."""
    z = shot_zone()
    out_position, out_type = z.isNull(), z.isNotNull() & (F.col("shot_type") == C.UNKNOWN)
    names = [(zone, kind) for zone in C.ZONES for kind in C.KNOWN_SHOT_TYPES]
    wide = shots.withColumn("_z", z).groupBy("match_id").agg(
        _count(out_position).alias("excluded_position"),
        _count(out_type).alias("excluded_type"),
        *[_count((F.col("_z") == zone) & (F.col("shot_type") == kind)).alias(f"{zone}|{kind}") for zone, kind in names],
    )
    wide = _matches(shots, matches).join(wide, "match_id", "left").fillna(0)
    totals = {zone: sum((F.col(f"`{zone}|{k}`") for k in C.KNOWN_SHOT_TYPES), F.lit(0)) for zone in C.ZONES}
    cells = F.array(
        *[
            F.struct(
                F.lit(zone).alias("zone"), F.lit(kind).alias("shot_type"),
                F.col(f"`{zone}|{kind}`").alias("n"), totals[zone].cast("bigint").alias("zone_total"),
            )
            for zone, kind in names
        ]
    )
    long = wide.select("match_id", "excluded_position", "excluded_type", F.inline(cells))
    return long.withColumn("rate", G.ratio(F.col("n"), F.col("zone_total")))


def at_kitchen(team: str, y: str, x: str, reach: float) -> Column:
    near = F.col(y).between(C.NEAR_KITCHEN_Y_M - reach, C.NET_Y_M)
    far = F.col(y).between(C.NET_Y_M, C.FAR_KITCHEN_Y_M + reach)
    return G.in_court(x, y) & F.when(F.col(team) == "nearTeam", near).otherwise(far)


def kitchen_arrivals(
    rallies: DataFrame,
    positions: DataFrame,
    fps: float,
    settings: C.ArrivalSettings = C.ArrivalSettings(),
) -> DataFrame:
    """Per rally and team: joint coverage and the first frame with both at the kitchen."""
    joint = P.joint_frames(positions)
    there = at_kitchen("team", "ay", "ax", settings.distance_m) & at_kitchen("team", "by", "bx", settings.distance_m)
    joint = joint.select("match_id", "team", "frame", there.alias("there"))
    bounds = rallies.select("match_id", "rally_id", "start_frame", "end_frame")
    seen = interval_join(joint, bounds, ["match_id"], "frame", "start_frame", "end_frame", RALLY_BUCKET_FRAMES)
    seen = seen.groupBy("match_id", "rally_id", "team").agg(
        F.count("*").alias("joint"), F.min(F.when(F.col("there"), F.col("frame"))).alias("first")
    )
    out = bounds.withColumn("team", F.explode(F.array(*map(F.lit, C.TEAMS)))).join(seen, ["match_id", "rally_id", "team"], "left")
    expected = F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame") + 1)
    out = out.withColumn("coverage", F.coalesce("joint", F.lit(0)) / expected)
    out = out.withColumn("evaluable", F.col("coverage") >= settings.min_coverage)
    out = out.withColumn("arrival_frame", F.when(F.col("evaluable"), F.col("first")))
    out = out.withColumn("arrived", F.when(F.col("evaluable"), F.col("first").isNotNull()))
    return out.withColumn("arrival_s", F.col("arrival_frame") / fps).drop("first", "joint", "start_frame", "end_frame")


def kitchen_arrival_rate(arrivals: DataFrame) -> DataFrame:
    out = arrivals.groupBy("match_id", "team").agg(
        _count(F.col("arrived")).alias("arrivals"),
        _count(F.col("evaluable")).alias("evaluable"),
        _count(~F.col("evaluable")).alias("low_coverage"),
    )
    return out.withColumn("rate", G.ratio(F.col("arrivals"), F.col("evaluable")))


def data_quality(rallies: DataFrame, shots: DataFrame) -> DataFrame:
    known = F.col("hitter_id").isin(*C.ROLES)
    out = shots.groupBy("match_id").agg(
        _count(F.col("hitter_id") == C.UNKNOWN).alias("unknown_hitters"),
        _count(F.col("shot_type") == C.UNKNOWN).alias("unknown_types"),
        F.avg("confidence").alias("mean_shot_confidence"),
        F.avg(F.when(known, F.col("hitter_confidence"))).alias("mean_hitter_confidence"),
    )
    base = rallies.groupBy("match_id").agg(F.avg("confidence").alias("mean_rally_confidence"))
    return base.join(out, "match_id", "left").fillna(0, ["unknown_hitters", "unknown_types"])


def _document_tallies(rallies: DataFrame, shots: DataFrame) -> DataFrame:
    """What a document says of rallies and shots, one row per match with a rally.

    Rallies and shots meet in one aggregation by rally, so both tables are read and
    shuffled once for all parts; sums per match follow from a row per rally. Shots
    outside the rallies count for players and classes, as in the parts on their own;
    shots of matches without a rally drop out at the end.
    """
    z = shot_zone()
    columns = [
        "match_id", "rally_id", "hitter_id", "shot_type", "shot_index", z.alias("_zone"), F.col("confidence").alias("_shot_confidence"),
        F.when(F.col("hitter_id").isin(*C.ROLES), F.col("hitter_confidence")).alias("_hitter_confidence"), F.lit(True).alias("_shot"),
    ]
    opened = with_duration(rallies).select("match_id", "rally_id", "start_frame", "duration_s", "confidence", F.lit(False).alias("_shot"))
    rows = shots.select(*columns).unionByName(opened, allowMissingColumns=True)
    kind, third = F.col("shot_type"), F.col("shot_index") == 3
    flags = {
        "third_shots": third,
        "third_classified": third & (kind != C.UNKNOWN),
        "drops": third & (kind == "DROP"),
        "drives": third & (kind == "DRIVE"),
        "excluded_position": F.col("_shot") & F.col("_zone").isNull(),
        "excluded_type": F.col("_zone").isNotNull() & (kind == C.UNKNOWN),
        "unknown_hitters": F.col("hitter_id") == C.UNKNOWN,
        "unknown_types": kind == C.UNKNOWN,
    }
    for role in C.ROLES:
        own = F.col("hitter_id") == role
        flags |= {f"{role}|hits": own, f"{role}|classified": own & (kind != C.UNKNOWN)}
        flags |= {f"{role}|{name}": own & (kind == name) for name in C.COUNTED_SHOT_TYPES}
    flags |= {f"{zone}|{name}": (F.col("_zone") == zone) & (kind == name) for zone in C.ZONES for name in C.KNOWN_SHOT_TYPES}
    means = ("duration_s", "confidence", "_shot_confidence", "_hitter_confidence")
    top = F.struct("duration_s", (-F.col("start_frame")).alias("early"))
    per_rally = rows.groupBy("match_id", "rally_id").agg(
        F.count_if(~F.col("_shot")).alias("_rallies"),
        F.count_if("_shot").alias("_shots"),
        F.max(F.when(~F.col("_shot"), top)).alias("_top"),
        *[f(c).alias(f"{c}|{n}") for c in means for f, n in ((F.sum, "sum"), (F.count, "n"))],
        *[_count(flag).alias(name) for name, flag in flags.items()],
    )
    # Shots without a match or rally are in no rally.
    keyed = F.col("match_id").isNotNull() & F.col("rally_id").isNotNull()
    per_rally = per_rally.withColumn("_shots", F.when(keyed, F.col("_shots")).otherwise(0))
    best = F.struct("_shots", "_top.duration_s", "_top.early", (-F.col("rally_id")).alias("rid"))
    out = per_rally.groupBy("match_id").agg(
        F.sum("_rallies").alias("rally_count"),
        F.sum(F.col("_rallies") * F.col("_shots")).alias("shot_count"),
        F.max(F.when(F.col("_rallies") > 0, best)).alias("b"),
        *[F.try_divide(F.sum(f"{c}|sum"), F.sum(f"{c}|n")).alias(f"mean|{c}") for c in means],
        *[F.sum(name).alias(name) for name in flags],
    )
    return out.filter("rally_count > 0")


def _document_parts(tallies: DataFrame) -> DataFrame:
    """Parts of the document that rest on rallies and shots, in the fields of the tables they are named after."""

    def many(rows: list[Column]) -> Column:
        return F.when(F.col("match_id").isNotNull(), F.array_sort(F.array(*rows)))

    def cell(name: str) -> Column:
        return F.col(f"`{name}`")

    def rate(part: Column, whole: Column) -> Column:
        return G.ratio(part, whole).alias("rate")

    match = F.struct(
        "rally_count", "shot_count", cell("mean|duration_s").alias("mean_duration_s"),
        (F.col("shot_count") / F.col("rally_count")).alias("mean_length"), cell("mean|confidence").alias("mean_rally_confidence"),
        (-F.col("b.rid")).alias("longest_rally_id"), F.col("b._shots").alias("longest_shots"),
    )
    players = [
        F.struct(
            F.lit(role).alias("player_id"), cell(f"{role}|hits").alias("hits"), cell(f"{role}|classified").alias("classified"),
            F.lit(name).alias("shot_type"), cell(f"{role}|{name}").alias("n"), rate(cell(f"{role}|{name}"), cell(f"{role}|classified")),
        )
        for role in C.ROLES for name in C.COUNTED_SHOT_TYPES
    ]
    classified = cell("third_classified")
    third = F.struct(
        "third_shots", classified.alias("classified"), "drops", "drives",
        G.ratio(F.col("drops"), classified).alias("drop_rate"), G.ratio(F.col("drives"), classified).alias("drive_rate"),
    )
    selection = []
    for zone in C.ZONES:
        whole = sum((cell(f"{zone}|{name}") for name in C.KNOWN_SHOT_TYPES), F.lit(0)).cast("bigint")
        selection += [
            F.struct(
                "excluded_position", "excluded_type", F.lit(zone).alias("zone"), F.lit(name).alias("shot_type"),
                cell(f"{zone}|{name}").alias("n"), whole.alias("zone_total"), rate(cell(f"{zone}|{name}"), whole),
            )
            for name in C.KNOWN_SHOT_TYPES
        ]
    quality = F.struct(
        cell("mean|confidence").alias("mean_rally_confidence"), "unknown_hitters", "unknown_types",
        cell("mean|_shot_confidence").alias("mean_shot_confidence"), cell("mean|_hitter_confidence").alias("mean_hitter_confidence"),
    )
    keyed = F.col("match_id").isNotNull()
    return tallies.select(
        "match_id", match.alias("match"), many(players).alias("players"), F.when(keyed, third).alias("thirdShots"),
        many(selection).alias("shotSelection"), F.when(keyed, quality).alias("dataQuality"),
    )


def match_document(
    rallies: DataFrame,
    shots: DataFrame,
    positions: DataFrame,
    fps: float,
) -> DataFrame:
    """One JSON document per match with match, player, team, tactical and quality parts."""

    def nest(df: DataFrame, name: str) -> DataFrame:
        fields = [c for c in df.columns if c != "match_id"]
        return df.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    arrivals = kitchen_arrivals(rallies, positions, fps)
    parts = [
        nest(P.movement(P.steps(positions)), "movement"),
        nest(P.occupancy(positions, fps), "occupancy"),
        nest(P.partner_spacing(positions), "spacing"),
        nest(P.coverage(positions), "coverage"),
        nest(kitchen_arrival_rate(arrivals), "kitchenArrival"),
    ]
    out = _document_parts(_document_tallies(rallies, shots))
    for part in parts:
        out = out.join(part, "match_id", "left")
    names = ["match", "players", "movement", "occupancy", "spacing", "coverage", "kitchenArrival", "thirdShots", "shotSelection", "dataQuality"]
    return out.select("match_id", F.to_json(F.struct(*names)).alias("metrics"))
