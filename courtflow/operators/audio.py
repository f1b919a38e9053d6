"""Audio windows, spectral flux, robust thresholds and transients."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from courtflow import config as C
from courtflow.functions.sequences import CHUNK, chunk_window, home_rows, spread_join, with_halo
from courtflow.operators.matching import suppress_near
from courtflow.session import cut_lineage


def frame_lengths(rate: int, s: C.AudioSettings = C.AudioSettings()) -> tuple[int, int]:
    return max(2, round(rate * s.frame_s)), max(1, round(rate * s.hop_s))


def cut_windows(blocks: DataFrame, block: int, rate: int, s: C.AudioSettings = C.AudioSettings()) -> DataFrame:
    """Overlapping windows from fixed-size sample blocks, all channels in a row.

    ``blocks``: match_id, block_ix, channels array<array<float>>, each block but the
    last holding ``block`` samples, a multiple of the hop and no shorter than a
    window. A block is only joined with its successor.
    """
    size, hop = frame_lengths(rate, s)
    if block % hop or block < size:
        raise ValueError("block must be a multiple of the hop and hold a window")
    rows = with_halo(blocks, "block_ix", 0, 1, 256)
    w = chunk_window(("match_id",), "block_ix")
    rows = home_rows(rows.withColumn("_next", F.lead("channels").over(w)))
    own = F.size(F.col("channels")[0])
    joined = F.when(
        F.col("_next").isNotNull(),
        F.zip_with("channels", "_next", lambda a, b: F.concat(a, F.slice(b, 1, size))),
    ).otherwise(F.col("channels"))
    rows = rows.withColumn("_n", own).withColumn("_all", joined).withColumn("_len", F.size(F.col("_all")[0]))
    last = F.least(F.col("_n") - 1, F.col("_len") - size)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(hop))).otherwise(F.when(F.col("block_ix") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    # The final window sits flush with the end of the recording.
    # A last block shorter than a window leaves that one to the block before it.
    ends_here = F.when(F.col("_next").isNull(), F.col("_len") >= size).otherwise(F.size(F.col("_next")[0]) < size)
    flush = F.when(ends_here, F.array(F.col("_len") - size)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_s", F.explode(F.array_union(starts, flush)))
    cut = F.transform("_all", lambda c: F.slice(c, F.col("_s") + 1, size))
    return rows.select("match_id", (F.col("block_ix") * block + F.col("_s")).cast("bigint").alias("start"), cut.alias("samples"))


FEATURES = (
    "match_id bigint, start bigint, peak_sample bigint, peak double, rms double, centroid_hz double, dominant_hz double, "
    "low double, mid double, high double, zero_crossing double, spectrum array<double>, channel_peak array<double>, channel_rms array<double>, "
    "channel_spectra array<array<double>>"
)


def spectra(windows: DataFrame, rate: int, s: C.AudioSettings = C.AudioSettings()) -> DataFrame:
    """Windowed Fourier features of each window; arrays go through in Arrow batches."""
    size, _ = frame_lengths(rate, s)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taper = np.hanning(size)
        hz = np.fft.rfftfreq(size, d=1 / rate)
        for batch in batches:
            if batch.empty:
                continue
            data = np.zeros((len(batch), len(batch["samples"].iat[0]), size))
            for i, channels in enumerate(batch["samples"]):
                for j, values in enumerate(channels):
                    data[i, j, : len(values)] = values
            magnitude = np.abs(np.fft.rfft(data * taper, axis=2))
            joint = np.sqrt(np.mean(magnitude**2, axis=1))
            signal = data.mean(axis=1)
            power = joint**2
            total = power.sum(axis=1)
            safe = np.where(total > 0, total, 1.0)
            sign = np.signbit(signal)
            flat = np.abs(data).transpose(0, 2, 1).reshape(len(batch), -1)
            low = power[:, hz < s.low_hz].sum(axis=1) / safe
            mid = power[:, (hz >= s.low_hz) & (hz < s.high_hz)].sum(axis=1) / safe
            heard = total > 0
            yield pd.DataFrame({
                "match_id": batch["match_id"], "start": batch["start"],
                "peak_sample": batch["start"].to_numpy() + flat.argmax(axis=1) // data.shape[1],
                "peak": flat.max(axis=1), "rms": np.sqrt((data**2).mean(axis=(1, 2))),
                "centroid_hz": np.where(heard, (power * hz).sum(axis=1) / safe, 0.0),
                "dominant_hz": np.where(heard, hz[power[:, 1:].argmax(axis=1) + 1], 0.0),
                "low": np.where(heard, low, 0.0), "mid": np.where(heard, mid, 0.0),
                "high": np.where(heard, np.maximum(0.0, 1.0 - low - mid), 0.0),
                "zero_crossing": (sign[:, 1:] != sign[:, :-1]).mean(axis=1),
                "spectrum": list(np.log1p(joint)), "channel_peak": list(np.abs(data).max(axis=2)),
                "channel_rms": list(np.sqrt((data**2).mean(axis=2))),
                "channel_spectra": [list(map(list, m)) for m in np.log1p(magnitude)],
            })

    return windows.mapInPandas(run, FEATURES)


def spectral_flux(features: DataFrame, spectrum: str = "spectrum", out: str = "onset", chunk: int = 16384, position: str = "start") -> DataFrame:
    """RMS of the rises in log magnitude since the window before; 0 for the first.

    The predecessor is looked up inside chunks that overlap by ``chunk // 4``.
    """
    rows = with_halo(features, position, chunk // 4, 0, chunk)
    before = F.lag(spectrum).over(chunk_window(("match_id",), position))
    rows = home_rows(rows.withColumn("_p", before))
    rises = F.zip_with(spectrum, "_p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    mean = F.aggregate(rises, F.lit(0.0), lambda acc, v: acc + v * v) / F.size(spectrum)
    return rows.withColumn(out, F.when(F.col("_p").isNull(), 0.0).otherwise(F.sqrt(mean))).drop("_p")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, width: float, out: str, most: int = 50_000) -> DataFrame:
    """Median per key without gathering a key's values in one place.

    Equal values count as one row with their number, so silence is a single row.
    Distinct values are counted in buckets of ``width``; the bucket or two that hold
    the middle ranks are cut into a thousand narrower ones until none has more than
    ``most`` distinct values, and only these are ranked.
    """
    keys = list(keys)
    rows = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")))
    # Values of the buckets in question, each with the rows of its key before its bucket.
    rows = rows.withColumn("_below", F.lit(0).cast("bigint")).withColumn("_n", F.lit(None).cast("bigint"))
    while True:
        rows = rows.withColumn("_b", F.floor(F.col(value) / F.lit(width)))
        counts = rows.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"), F.count("*").alias("_values"), F.first("_below").alias("_below"), F.first("_n").alias("_n"))
        # A second middle bucket beside the first has rows before it already; both are counted from the first's.
        w = W.partitionBy(*keys)
        counts = counts.withColumn("_n", F.coalesce("_n", F.sum("_c").over(w))).withColumn(
            "_below", F.min("_below").over(w) + F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        low, high = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
        holds = lambda r: (r > F.col("_below")) & (r <= F.col("_below") + F.col("_c"))
        middle = cut_lineage(counts.filter(holds(low) | holds(high)).select(*keys, "_b", "_below", "_n", "_values"))
        rows = spread_join(rows.drop("_below", "_n"), middle, [*keys, "_b"])
        if middle.filter(F.col("_values") > most).isEmpty():
            break
        rows, width = cut_lineage(rows.drop("_values")), width / 1024
    upto = F.sum("_c").over(W.partitionBy(*keys, "_b").orderBy(value)) + F.col("_below")
    ranked = rows.withColumn("_upto", upto).withColumn("_lo", F.floor((F.col("_n") + 1) / 2)).withColumn("_hi", F.floor((F.col("_n") + 2) / 2))
    holds = lambda r: (F.col(r) <= F.col("_upto")) & (F.col(r) > F.col("_upto") - F.col("_c"))
    found = ranked.groupBy(*keys).agg(F.max(F.when(holds("_lo"), F.col(value))).alias("_a"), F.max(F.when(holds("_hi"), F.col(value))).alias("_z"))
    return found.select(*keys, ((F.col("_a") + F.col("_z")) / 2).alias(out))


def robust_scores(features: DataFrame, value: str = "onset", width: float = 0.05, keys: Sequence[str] = ("match_id",)) -> DataFrame:
    """Rows with baseline, robust scale (median deviation) and z-score per key."""
    keys = list(keys)
    centre = exact_median(features, keys, value, width, "baseline")
    rows = cut_lineage(spread_join(features, centre, keys).withColumn("_dev", F.abs(F.col(value) - F.col("baseline"))))
    scale = exact_median(rows, keys, "_dev", width, "_mad")
    rows = spread_join(rows, scale, keys).withColumn("scale", F.greatest(1.4826 * F.col("_mad"), F.lit(1e-6)))
    return rows.withColumn("z", (F.col(value) - F.col("baseline")) / F.col("scale")).drop("_dev", "_mad")


def peaks(scored: DataFrame, position: str = "window_ix", s: C.AudioSettings = C.AudioSettings(), chunk: int = 16384) -> DataFrame:
    """Local maxima at or above the threshold; a plateau counts at its last window."""
    rows = with_halo(scored, position, 1, 1, chunk)
    w = chunk_window(("match_id",), position)
    rows = rows.withColumn("_p", F.lag("z").over(w)).withColumn("_n", F.lead("z").over(w))
    rows = home_rows(rows)
    top = F.col("_p").isNotNull() & (F.col("z") >= s.strength) & (F.col("z") >= F.col("_p")) & (F.col("_n").isNull() | (F.col("z") > F.col("_n")))
    return rows.filter(top).drop("_p", "_n")


def transient_confidence(z: str = "z", peak: str = "peak", s: C.AudioSettings = C.AudioSettings()):
    excess = F.greatest(F.lit(0.0), F.col(z) - s.strength)
    onset = 0.50 + 0.50 * (1 - F.exp(-excess / s.strength))
    return F.least(F.lit(1.0), 0.85 * onset + 0.15 * F.least(F.lit(1.0), F.col(peak) * 4))


def transients(scored: DataFrame, rate: int, s: C.AudioSettings = C.AudioSettings(), position: str = "window_ix") -> DataFrame:
    """Peaks thinned to the strongest within the minimum separation, with confidence."""
    found = cut_lineage(peaks(scored, position, s))
    kept = suppress_near(found, ("match_id",), "peak_sample", "z", round(rate * s.separation_s), False, rate * 600)
    return kept.withColumn("confidence", transient_confidence("z", "peak", s))


def analyse(blocks: DataFrame, block: int, rate: int, s: C.AudioSettings = C.AudioSettings()) -> DataFrame:
    """Transients of all recordings from their sample blocks (channels combined)."""
    size, hop = frame_lengths(rate, s)
    features = spectra(cut_windows(blocks, block, rate, s), rate, s).drop("channel_spectra")
    scored = robust_scores(cut_lineage(spectral_flux(features, chunk=hop * 16384).drop("spectrum")))
    # Window starts are a hop apart but for the last one, which lies nearer.
    w = W.partitionBy("match_id", CHUNK).orderBy("start")
    wide = with_halo(scored, "start", 2 * hop, 2 * hop, hop * 16384)
    wide = wide.withColumn("_p", F.lag("z").over(w)).withColumn("_n", F.lead("z").over(w))
    top = F.col("_p").isNotNull() & (F.col("z") >= s.strength) & (F.col("z") >= F.col("_p")) & (F.col("_n").isNull() | (F.col("z") > F.col("_n")))
    found = cut_lineage(home_rows(wide).filter(top).drop("_p", "_n"))
    kept = suppress_near(found, ("match_id",), "peak_sample", "z", round(rate * s.separation_s), False, rate * 600)
    return kept.withColumn("confidence", transient_confidence("z", "peak", s)).withColumn("analysis_s", F.col("peak_sample") / rate)
