"""Time-stretching, resampling, and conforming to a tempo and key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TAU, half_up
from .spectral import cells, frames_of, overlap_add, stft


def advance_phases(cell_rows: DataFrame, n_fft: int, hop_in: int, hop_out: int, keys: tuple[str, ...] = ("track", "ch")) -> DataFrame:
    """cell_rows with re and im turned to the phase they have when frames lie hop_out apart.

    A bin's phase is its first one plus the running sum of its true frequency times hop_out: a window prefix sum, no state in Python.
    """
    w = Window.partitionBy(*keys, "b").orderBy("t")
    omega = F.lit(TAU) * F.col("b") / F.lit(float(n_fft))
    phase = F.atan2(F.round("im", 9) + F.lit(0.0), F.round("re", 9) + F.lit(0.0))
    at = cell_rows.withColumn("phase", phase)
    raw = F.col("phase") - F.lag("phase").over(w) - omega * hop_in
    dev = raw - F.lit(TAU) * half_up(raw / F.lit(TAU))
    step = F.coalesce((omega + dev / F.lit(float(hop_in))) * hop_out, F.col("phase"))
    turned = at.withColumn("step", step).withColumn("psi", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return turned.select(*keys, "t", "b", (F.col("mag") * F.cos("psi")).alias("re"), (F.col("mag") * F.sin("psi")).alias("im"))


def time_stretch(signal: DataFrame, ratio: float, n_fft: int = 2048) -> DataFrame:
    """(track, ch, i, x) ``ratio`` times as long at the same pitch, by a phase vocoder; the ratio is rounded to whole output hops.

    Unchanged: any signal for a ratio of 1 or one that is no positive number, and signals shorter than a frame.
    """
    if not ratio > 0 or abs(ratio - 1) < 1e-6:
        return signal
    hop = n_fft // 4
    out = max(1, math.floor(hop * ratio + 0.5))
    sized = signal.withColumn("n", F.max("i").over(Window.partitionBy("track", "ch")) + 1)
    long = sized.where(F.col("n") >= n_fft).drop("n")
    turned = advance_phases(cells(stft(long, n_fft, hop)), n_fft, hop, out)
    return overlap_add(frames_of(turned), n_fft, out).unionByName(sized.where(F.col("n") < n_fft).drop("n"))


def resample(signal: DataFrame, length) -> DataFrame:
    """(track, ch, i, x) with ``length`` (number, or table (track, ch, length)) samples by linear interpolation, ends fixed; length 1 keeps the first sample.

    Each output point meets its two neighbours by equality joins; a join that depends on a range isn't needed.
    """
    sizes = signal.groupBy("track", "ch").agg((F.max("i") + 1).alias("n"))
    sizes = sizes.withColumn("length", F.lit(length).cast("bigint")) if isinstance(length, int) else sizes.join(length, ["track", "ch"])
    grid = sizes.where("length > 0").select("track", "ch", "n", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)).alias("j"))
    scale = (F.col("n") - 1).cast("double") / F.greatest(F.lit(1), F.col("length") - 1)
    at = F.when(F.col("length") == 1, F.lit(0.0)).otherwise(F.col("j") * scale)
    i0 = F.floor("at").cast("bigint")
    points = grid.withColumn("at", at).withColumn("i0", i0).withColumn("i1", F.least(F.col("n") - 1, F.col("i0") + 1)).withColumn("frac", F.col("at") - F.col("i0"))
    side = lambda i, x: signal.select("track", "ch", F.col("i").alias(i), F.col("x").alias(x))
    both = points.join(side("i0", "x0"), ["track", "ch", "i0"]).join(side("i1", "x1"), ["track", "ch", "i1"])
    return both.select("track", "ch", F.col("j").alias("i"), (F.col("x0") * (1 - F.col("frac")) + F.col("x1") * F.col("frac")).alias("x"))


def _lengths(signal: DataFrame, ratio: float) -> DataFrame:
    return signal.groupBy("track", "ch").agg(F.greatest(F.lit(1), half_up((F.max("i") + 1) * F.lit(ratio))).cast("bigint").alias("length"))


def pitch_shift(signal: DataFrame, semitones: float, n_fft: int = 2048) -> DataFrame:
    """The same length, ``semitones`` higher."""
    if abs(semitones) < 1e-6:
        return signal
    return resample(time_stretch(signal, 2 ** (semitones / 12), n_fft), _lengths(signal, 1.0))


def conform(signal: DataFrame, time_ratio: float, semitones: float, n_fft: int = 2048) -> DataFrame:
    """Tempo and key in one pass: stretched by both, then resampled to round(n * time_ratio) samples. Every channel alike."""
    if abs(time_ratio - 1) < 1e-6 and abs(semitones) < 1e-6:
        return signal
    return resample(time_stretch(signal, time_ratio * 2 ** (semitones / 12), n_fft), _lengths(signal, time_ratio))
