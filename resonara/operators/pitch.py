"""Chroma, tonality, musical key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spectral import cells, stft

NAMES = "C C# D D# E F F# G G# A A# B".split()
#: Krumhansl-Kessler key profiles.
MAJOR = tuple(map(float, "6.35 2.23 3.48 2.33 4.38 4.09 2.52 5.19 2.39 3.66 2.29 2.88".split()))
MINOR = tuple(map(float, "6.33 2.68 3.52 5.38 2.60 3.53 2.54 4.75 3.98 2.69 3.34 3.17".split()))
UNPITCHED = "—"


def pitch_classes(spark: SparkSession, bins: int, n_fft: int, rate: float, low: float = 65.0, high: float = 2000.0) -> DataFrame:
    """(b, pc): the pitch class of each bin between the two frequencies."""
    hz = rate / n_fft
    first, last = max(1, math.floor(low / hz)), min(bins - 1, math.ceil(high / hz))
    midi = F.floor(F.lit(69) + F.lit(12) * F.log2(F.col("b") * F.lit(hz) / F.lit(440.0)) + F.lit(0.5)).cast("int")
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("b")).select("b", F.pmod(midi, F.lit(12)).alias("pc"))


def chroma(cell_rows: DataFrame, classes: DataFrame, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by, pc, p): the share of magnitude of each of the twelve classes, all 0 for silence. The class table has at most a row a bin."""
    sums = cell_rows.join(F.broadcast(classes), "b").groupBy(*by, "pc").agg(F.sum("mag").alias("m"))
    dense = cell_rows.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pc")).join(sums, [*by, "pc"], "left")
    total = F.sum(F.coalesce("m", F.lit(0.0))).over(Window.partitionBy(*by))
    return dense.select(*by, "pc", F.when(total > 0, F.coalesce("m", F.lit(0.0)) / total).otherwise(0.0).alias("p"))


def tonality(chroma_rows: DataFrame, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by, tonality): 1 less the chroma's entropy over that of twelve equal shares; silence gives 1."""
    term = F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0)
    return chroma_rows.groupBy(*by).agg((F.lit(1.0) + F.sum(term) / F.lit(math.log(12))).alias("tonality"))


def key_scores(chroma_rows: DataFrame, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by, tonic, mode, r): correlation of the chroma with each of the 24 rotated profiles; 0 where it has no spread."""
    profile = F.array(*[F.struct(F.lit(m).alias("mode"), F.array(*map(F.lit, v)).alias("v")) for m, v in (("major", MAJOR), ("minor", MINOR))])
    each = chroma_rows.select(*by, "pc", "p", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("tonic"), F.lit(0).alias("z")).select("*", F.explode(profile).alias("m"))
    at = F.element_at(F.col("m.v"), F.pmod(F.col("pc") - F.col("tonic"), F.lit(12)) + 1)
    put = each.select(*by, "tonic", F.col("m.mode").alias("mode"), "p", at.alias("q"))
    n = F.count("*")
    cov = F.sum(F.col("p") * F.col("q")) - F.sum("p") * F.sum("q") / n
    vp, vq = F.sum(F.col("p") * F.col("p")) - F.sum("p") * F.sum("p") / n, F.sum(F.col("q") * F.col("q")) - F.sum("q") * F.sum("q") / n
    sums = put.groupBy(*by, "tonic", "mode").agg(cov.alias("cov"), vp.alias("vp"), vq.alias("vq"))
    den = F.sqrt(F.greatest(F.lit(0.0), F.col("vp")) * F.col("vq"))
    return sums.select(*by, "tonic", "mode", F.when(den > 1e-12, F.col("cov") / den).otherwise(0.0).alias("r"))


def detect_key(scores: DataFrame, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by, tonic, mode, name, confidence): the best correlation; ties go to the smaller tonic, major before minor."""
    order = Window.partitionBy(*by).orderBy(F.desc(F.round("r", 12)), "tonic", "mode")
    name = F.concat(F.element_at(F.array(*map(F.lit, NAMES)), F.col("tonic") + 1), F.lit(" "), F.col("mode"))
    return scores.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(*by, "tonic", "mode", name.alias("name"), F.col("r").alias("confidence"))


def label_pitch(chroma_rows: DataFrame, floor: float = 0.18, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by, pitch_class, tonic, mode, name, confidence, chroma): confidence is the tonality; below ``floor`` the pitch is unnamed, chroma and confidence stay."""
    packed = chroma_rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pc", "p"))), lambda z: z["p"]).alias("chroma"))
    top = chroma_rows.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("p"), "pc"))).where("rn = 1").select(*by, "pc")
    all_ = packed.join(tonality(chroma_rows, by), list(by)).join(top, list(by)).join(detect_key(key_scores(chroma_rows, by), by).drop("confidence"), list(by))
    good = F.col("tonality") >= floor
    return all_.select(*by, F.when(good, F.col("pc")).otherwise(-1).alias("pitch_class"), F.when(good, F.col("tonic")).otherwise(0).alias("tonic"), F.when(good, F.col("mode")).otherwise(F.lit("major")).alias("mode"), F.when(good, F.col("name")).otherwise(F.lit(UNPITCHED)).alias("name"), F.col("tonality").alias("confidence"), "chroma")


def analyze_pitch(mono: DataFrame, rate: float, n_fft: int = 4096, hop: int = 1024, seconds: float = 10.0) -> DataFrame:
    """The pitch of each track; a track shorter than a frame is unpitched with an empty chroma of zeros."""
    clip = mono.where(F.col("i") < math.floor(seconds * rate))
    spark = mono.sparkSession
    named = label_pitch(chroma(cells(stft(clip, n_fft, hop)), pitch_classes(spark, n_fft // 2 + 1, n_fft, rate)))
    none = F.struct(F.lit(-1).alias("pitch_class"), F.lit(0).alias("tonic"), F.lit("major").alias("mode"), F.lit(UNPITCHED).alias("name"), F.lit(0.0).alias("confidence"), F.array(*[F.lit(0.0)] * 12).alias("chroma"))
    tracks = mono.select("track").distinct()
    got = named.select("track", F.struct("pitch_class", "tonic", "mode", "name", "confidence", "chroma").alias("pitch"))
    return tracks.join(got, "track", "left").select("track", F.coalesce("pitch", none).alias("pitch")).select("track", "pitch.*")
