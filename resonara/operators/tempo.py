"""Onsets, tempo, beat grid, crops."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import half_up
from .spectral import cells, stft


def onset_envelope(cell_rows: DataFrame, smooth: int = 16) -> DataFrame:
    """(track, t, env): summed rises of log1p magnitude from frame to frame, less their trailing mean, not below 0."""
    before = F.lag("mag").over(Window.partitionBy("track", "b").orderBy("t"))
    rise = F.greatest(F.lit(0.0), F.log1p("mag") - F.log1p(before))
    flux = cell_rows.withColumn("rise", F.coalesce(rise, F.lit(0.0))).groupBy("track", "t").agg(F.sum("rise").alias("flux"))
    mean = F.avg("flux").over(Window.partitionBy("track").orderBy("t").rowsBetween(1 - smooth, 0))
    return flux.select("track", "t", F.greatest(F.lit(0.0), F.col("flux") - mean).alias("env"))


def lag_bounds(frame_rate: float, low_bpm: float = 60.0, high_bpm: float = 200.0) -> tuple[int, int]:
    return max(1, math.floor(frame_rate * 60 / high_bpm + 0.5)), math.floor(frame_rate * 60 / low_bpm + 0.5)


def lag_scores(env: DataFrame, frame_rate: float, lags: tuple[int, int] | None = None, center: float = 124.0, width: float = 0.9) -> DataFrame:
    """(track, lag, ac, score): normalised autocorrelation of the envelope at each lag, and weighted by the tempo prior.

    Each row meets its earlier rows by an equality join on the exploded lag; a lag without pairs scores 0.
    """
    low, high = lags or lag_bounds(frame_rate)
    every = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("lag")
    energy = env.groupBy("track").agg(F.sum(F.col("env") * F.col("env")).alias("e")).select("track", F.when(F.col("e") > 0, F.col("e")).otherwise(1.0).alias("energy"))
    later = env.where("env > 0").select("track", "t", "env", every).withColumn("at", F.col("t") - F.col("lag"))
    pairs = later.join(env.where("env > 0").select("track", F.col("t").alias("at"), F.col("env").alias("old")), ["track", "at"]).groupBy("track", "lag").agg(F.sum(F.col("env") * F.col("old")).alias("ac"))
    grid = energy.select("track", "energy", every).join(pairs, ["track", "lag"], "left")
    octaves = F.log2(F.lit(frame_rate * 60) / F.col("lag") / F.lit(center))
    prior = F.exp(F.lit(-0.5) * octaves * octaves / F.lit(width * width))
    ac = F.coalesce("ac", F.lit(0.0)) / F.col("energy")
    return grid.select("track", "lag", ac.alias("ac"), (ac * prior).alias("score"))


def best_lag(scores: DataFrame) -> DataFrame:
    """(track, lag, confidence): the lag of the largest score, the smallest on ties; confidence is its autocorrelation, 1 at most."""
    order = Window.partitionBy("track").orderBy(F.desc("score"), "lag")
    return scores.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("track", "lag", F.least(F.lit(1.0), F.col("ac")).alias("confidence"))


def beat_phase(env: DataFrame, lags: DataFrame) -> DataFrame:
    """(track, phase): where in a beat period the envelope sums highest, the earliest on ties."""
    folded = env.join(lags.select("track", "lag"), "track").groupBy("track", F.pmod(F.col("t"), F.col("lag")).alias("phase")).agg(F.sum("env").alias("s"))
    return folded.withColumn("rn", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("s"), "phase"))).where("rn = 1").select("track", "phase")


def downbeat(env: DataFrame, lags: DataFrame, phases: DataFrame, beats: int = 4) -> DataFrame:
    """(track, first_beat_frame, first_downbeat_frame): of the bar's beats the one that is loudest on average, the earliest on ties."""
    near = F.max("env").over(Window.partitionBy("track").orderBy("t").rowsBetween(-1, 1))
    grid = env.withColumn("peak", F.greatest(F.lit(0.0), near)).join(lags.select("track", "lag"), "track").join(phases, "track")
    n = (F.col("t") - F.col("phase")) / F.col("lag")
    on = grid.where((F.col("t") >= F.col("phase")) & (F.pmod(F.col("t") - F.col("phase"), F.col("lag")) == 0))
    slots = on.groupBy("track", "lag", "phase", F.pmod(F.floor(n), F.lit(beats)).alias("slot")).agg(F.avg("peak").alias("loud"))
    order = Window.partitionBy("track").orderBy(F.desc("loud"), "slot")
    return slots.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("track", F.col("phase").alias("first_beat_frame"), (F.col("phase") + F.col("slot") * F.col("lag")).alias("first_downbeat_frame"))


def tempo_table(lags: DataFrame, grid: DataFrame, rate: float, hop: int, beats: int = 4) -> DataFrame:
    """(track, bpm, beat_period, bar_length, beats_per_bar, first_beat, first_downbeat, confidence), times in seconds."""
    period = F.col("lag") / F.lit(rate / hop)
    sec = lambda c: F.col(c) * F.lit(float(hop)) / F.lit(rate)
    return lags.join(grid, "track").select("track", (F.lit(60.0) / period).alias("bpm"), period.alias("beat_period"), (period * beats).alias("bar_length"), F.lit(beats).alias("beats_per_bar"), sec("first_beat_frame").alias("first_beat"), sec("first_downbeat_frame").alias("first_downbeat"), "confidence")


def suggest_crop(tempo: DataFrame, duration: Column, longest: float = 20.0) -> DataFrame:
    """tempo with crop_start, crop_end and bars: from the first downbeat the most of 8, 4, 2 or 1 bars that fit, moved back inside the track."""
    bar = F.col("bar_length")
    fit = F.greatest(F.lit(1), F.floor(F.least(F.lit(longest), duration) / bar))
    bars = F.when(fit >= 8, 8).when(fit >= 4, 4).when(fit >= 2, 2).otherwise(1)
    over = F.col("first_downbeat") + bars * bar > duration
    start = F.when(over, F.greatest(F.lit(0.0), duration - bars * bar)).otherwise(F.col("first_downbeat"))
    end = F.when(over, F.least(duration, start + bars * bar)).otherwise(start + bars * bar)
    return tempo.select("*", start.alias("crop_start"), end.alias("crop_end"), bars.alias("bars"))


def snap_to_bars(selections: DataFrame, longest: float = 20.0) -> DataFrame:
    """selections (beat_period, bar_length, first_beat, start, end, duration) with snap_start, snap_end and snap_bars.

    The start goes to the nearest beat, lifted to 0 or later, the length to whole bars, one at least.
    """
    beat, bar = F.col("beat_period"), F.col("bar_length")
    raw = F.col("first_beat") + half_up((F.col("start") - F.col("first_beat")) / beat) * beat
    start = F.when(raw < 0, raw + beat * F.ceil(-raw / beat)).otherwise(raw)
    most = F.greatest(F.lit(1), F.floor(F.least(F.lit(longest), F.col("duration") - start) / bar))
    bars = F.least(F.greatest(F.lit(1), half_up((F.col("end") - F.col("start")) / bar)), most)
    return selections.select("*", start.alias("snap_start"), (start + bars * bar).alias("snap_end"), bars.cast("int").alias("snap_bars"))


def analyze_tempo(mono: DataFrame, rate: float, n_fft: int = 1024, hop: int = 256, seconds: float = 60.0, longest: float = 20.0, lags: tuple[int, int] | None = None, center: float = 124.0) -> DataFrame:
    """Tempo, beat grid and suggested crop of each track of (track, ch, i, x); only its first ``seconds`` are framed.

    A track shorter than a frame has no onsets: it gets the shortest lag, without confidence, from its start.
    """
    clip = mono.where(F.col("i") < math.floor(seconds * rate))
    env = onset_envelope(cells(stft(clip, n_fft, hop)))
    found = best_lag(lag_scores(env, rate / hop, lags, center))
    grid = downbeat(env, found, beat_phase(env, found))
    duration = mono.groupBy("track").agg(((F.max("i") + 1) / F.lit(rate)).alias("duration"))
    shortest = (lags or lag_bounds(rate / hop))[0]
    every = duration.join(found.join(grid, "track", "left"), "track", "left").fillna({"lag": shortest, "confidence": 0.0, "first_beat_frame": 0, "first_downbeat_frame": 0})
    frames = ("first_beat_frame", "first_downbeat_frame")
    table = tempo_table(every.select("track", "lag", "confidence"), every.select("track", "duration", *frames), rate, hop)
    return suggest_crop(table.join(duration, "track"), F.col("duration"), longest)
