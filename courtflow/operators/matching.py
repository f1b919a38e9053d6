"""One-to-one matching of predicted and true events or intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtflow.functions.folds import SettleApart, SettlePairs, settle
from courtflow.functions.sequences import band_join
from courtflow.session import cut_lineage

CHUNK_SECONDS = 600


def greedy_pairs(
    proposals: DataFrame,
    keys: Sequence[str],
    left: str,
    right: str,
    low: Column,
    high: Column,
    order: Sequence[Column],
    size: float = CHUNK_SECONDS,
    reach: float | None = None,
) -> DataFrame:
    """Accept proposals from the best down, each side once.

    ``low``/``high`` span both partners, so proposals that share a partner touch;
    ``reach`` is the longest span, measured where it is not given. ``order`` must be
    total; add ids as last terms. A chain of touching proposals is decided chunk by
    chunk, however long it is.
    """
    if reach is None:
        proposals = cut_lineage(proposals)
        reach = proposals.agg(F.max(high - low)).first()[0] or 0
    decided = settle(proposals, keys, low, high, reach, size, order, SettlePairs, (left, right))
    return decided.filter("taken").drop("taken")


def time_matches(
    predicted: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    predicted_id: str,
    truth_id: str,
    predicted_t: str,
    truth_t: str,
    score: str,
    tolerance_s: float,
) -> DataFrame:
    """Match by time: nearest first, then the higher score, then input order."""
    pairs = band_join(predicted, truth, keys, predicted_t, truth_t, tolerance_s)
    pairs = pairs.withColumn("signed_s", F.col(predicted_t) - F.col(truth_t)).withColumn("delta_s", F.abs("signed_s"))
    return greedy_pairs(
        pairs, keys, predicted_id, truth_id, F.least(predicted_t, truth_t), F.greatest(predicted_t, truth_t),
        [F.asc("delta_s"), F.desc(score), F.asc(predicted_id), F.asc(truth_id)], reach=tolerance_s,
    )


def interval_matches(
    predicted: DataFrame,
    truth: DataFrame,
    keys: Sequence[str],
    boundary_frames: int,
    min_iou: float,
    bucket: int = 1024,
) -> DataFrame:
    """Match intervals ``(p_id, p_start, p_end)`` and ``(a_id, a_start, a_end)``.

    A pair is proposed when it overlaps enough or both its boundaries are near;
    either way the intervals share a bucket once widened by the boundary tolerance.
    """
    b = boundary_frames
    spread = lambda s, e, m: F.explode(F.sequence(F.floor((F.col(s) - m) / bucket), F.floor((F.col(e) + m) / bucket)))
    p = predicted.withColumn("_b", spread("p_start", "p_end", b))
    a = truth.withColumn("_b", spread("a_start", "a_end", 0))
    start_error, end_error = F.col("p_start") - F.col("a_start"), F.col("p_end") - F.col("a_end")
    shared = F.greatest(F.lit(0), F.least("p_end", "a_end") - F.greatest("p_start", "a_start") + 1)
    union = F.greatest("p_end", "a_end") - F.least("p_start", "a_start") + 1
    pairs = p.join(a, [*keys, "_b"]).withColumn("iou", shared / union)
    # A pair that meets in several buckets is kept in the first one only.
    first = F.greatest(F.floor((F.col("p_start") - b) / bucket), F.floor(F.col("a_start") / bucket))
    near = (F.abs(start_error) <= b) & (F.abs(end_error) <= b)
    pairs = pairs.filter((F.col("_b") == first) & ((F.col("iou") >= min_iou) | near)).drop("_b")
    pairs = pairs.withColumn("start_error", start_error).withColumn("end_error", end_error)
    order = [F.desc("iou"), (F.abs("start_error") + F.abs("end_error")).asc(), F.abs("start_error").asc(), F.asc("p_id"), F.asc("a_id")]
    return greedy_pairs(pairs, keys, "p_id", "a_id", F.least("p_start", "a_start"), F.greatest("p_end", "a_end"), order, 16384)


def suppress_near(
    candidates: DataFrame,
    keys: Sequence[str],
    position: str,
    score: str,
    distance: float,
    inclusive: bool,
    size: float,
) -> DataFrame:
    """Keep the strongest of candidates closer than ``distance`` (or as close, if inclusive).

    Equally strong ones stand in the order of their positions.
    """
    decided = settle(
        candidates, keys, F.col(position), F.col(position), distance, size, [F.desc(score), F.asc(position)],
        lambda: SettleApart(distance, inclusive), (position,))
    return decided.filter("taken").drop("taken")
