"""Lists of components: labels, tallies, defaults, settings, combining and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import format_time
from .arrange import mix

ORDER = ("percussive", "harmonic", "mixed")


def rms(x: Column) -> Column:
    """Root mean square, 0 for no samples."""
    return F.coalesce(F.sqrt(F.avg(x * x)), F.lit(0.0))


def order_components(parts: DataFrame, by_kind: bool = True) -> DataFrame:
    """parts (track, idx, kind, energy) with pos: percussive first, then falling energy, then as they were."""
    first = [F.when(F.col("kind") == "percussive", 0).otherwise(1)] if by_kind else []
    return parts.withColumn("pos", F.row_number().over(Window.partitionBy("track").orderBy(*first, F.desc("energy"), "idx")) - 1)


def labels(parts: DataFrame) -> DataFrame:
    """parts with label: the kind's name, numbered within it in list order."""
    n = F.row_number().over(Window.partitionBy("track", "kind").orderBy("idx"))
    return parts.withColumn("label", F.concat(F.initcap("kind"), F.lit(" "), n.cast("string")))


def tally(parts: DataFrame) -> DataFrame:
    """(track, summary) such as '3 parts (2 percussive · 1 harmonic)': counts by kind in fixed order, without zeros."""
    counts = parts.groupBy("track").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ORDER], F.count("*").alias("n"))
    items = F.filter(F.array(*[F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {k}"))) for k in ORDER]), lambda x: x.isNotNull())
    return counts.select("track", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " part (").otherwise(" parts ("), F.array_join(items, " · "), F.lit(")")).alias("summary"))


def deck_tonic(parts: DataFrame) -> DataFrame:
    """(track, tonic) of the most energetic named component, the first on ties; null where none is named."""
    named = parts.where("name <> '—'").withColumn("rn", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("energy"), "idx"))).where("rn = 1")
    return parts.select("track").distinct().join(named.select("track", "tonic"), "track", "left")


def target_defaults(decks: DataFrame) -> DataFrame:
    """(pair, target_bpm, target_tonic) from (pair, a_bpm, a_tonic, b_tonic): A's tempo, 120 without one, and the first known tonic, else C."""
    return decks.select("pair", F.floor(F.coalesce("a_bpm", F.lit(120.0)) + 0.5).cast("int").alias("target_bpm"), F.coalesce("a_tonic", "b_tonic", F.lit(0)).alias("target_tonic"))


def merge_settings(selection: DataFrame, settings: DataFrame) -> DataFrame:
    """The selected (source, idx) with their settings, defaults where unset; settings of what isn't selected are gone."""
    fade = lambda col, own: F.coalesce(col, F.when(F.col("source") == own, "fade").otherwise("hard"))
    return selection.join(settings, ["source", "idx"], "left").select("source", "idx", F.coalesce("repeats", F.lit(4)).alias("repeats"), fade("entrance", "B").alias("entrance"), fade("exit", "A").alias("exit"), F.coalesce("gain", F.lit(1.0)).alias("gain"))


def prune_selection(selection: DataFrame, parts: DataFrame) -> DataFrame:
    """The selected (source, idx) that still exist."""
    return selection.join(parts, ["source", "idx"], "left_semi")


def parse_key(key: Column) -> tuple[Column, Column]:
    """'A:3' as source and number."""
    return F.split_part(key, F.lit(":"), F.lit(1)), F.split_part(key, F.lit(":"), F.lit(2)).cast("int")


def format_key(source: Column, idx: Column) -> Column:
    return F.concat_ws(":", source, idx.cast("string"))


def peaks(signal: DataFrame, width: int, keys: tuple[str, ...] = ("track",)) -> DataFrame:
    """(keys, bucket, lo, hi): least and largest sample of each of ``width`` buckets, within [-1, 1] reached from the far side; the tail is left out."""
    n = F.max("i").over(Window.partitionBy(*keys)) + 1
    rows = signal.withColumn("step", F.greatest(F.lit(1), F.floor(n / width))).withColumn("bucket", F.floor(F.col("i") / F.col("step")))
    got = rows.where(F.col("bucket") < width).groupBy(*keys, "bucket").agg(F.least(F.lit(1.0), F.min("x")).alias("lo"), F.greatest(F.lit(-1.0), F.max("x")).alias("hi"))
    grid = signal.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))).alias("bucket"))
    return grid.join(got, [*keys, "bucket"], "left").select(*keys, "bucket", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi"))


def combine(parts: DataFrame, samples: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Several components of a track become one: (parts, samples) anew.

    parts (track, idx, kind), samples (track, idx, ch, i, x), chosen (track, idx) of two or more. The sum stands where the first of them stood; its kind
    is theirs, or 'mixed'. Others keep their order.
    """
    marked = parts.join(chosen.withColumn("sel", F.lit(True)), ["track", "idx"], "left").withColumn("sel", F.coalesce("sel", F.lit(False)))
    first = F.min(F.when(F.col("sel"), F.col("idx"))).over(Window.partitionBy("track"))
    seat = marked.withColumn("seat", F.when(F.col("sel"), first).otherwise(F.col("idx")))
    kinds = seat.groupBy("track", "seat").agg(F.when(F.count_distinct("kind") > 1, "mixed").otherwise(F.first("kind")).alias("kind"), F.max("sel").alias("merged"))
    new = kinds.withColumn("idx", F.row_number().over(Window.partitionBy("track").orderBy("seat")) - 1)
    rows = samples.join(seat.select("track", "idx", "seat"), ["track", "idx"]).join(new.select("track", "seat", F.col("idx").alias("new_idx")), ["track", "seat"])
    summed = mix(rows.select("track", F.col("new_idx").alias("mix"), F.col("idx").alias("part"), "ch", "i", "x"), ("track", "mix")).withColumnRenamed("mix", "idx")
    energy = summed.where("ch = 0").groupBy("track", "idx").agg(rms(F.col("x")).alias("energy"))
    return new.join(energy, ["track", "idx"]).select("track", "idx", "kind", "energy", "merged"), summed


def splice(parts: DataFrame, index: int, new: DataFrame) -> DataFrame:
    """parts (track, idx, kind, energy) with component ``index`` replaced by new (track, sub, kind, energy) in its place, numbered anew."""
    both = parts.where(F.col("idx") != index).select("track", "idx", F.lit(0).alias("sub"), "kind", "energy").unionByName(new.select("track", F.lit(index).alias("idx"), "sub", "kind", "energy"))
    return both.select("track", (F.row_number().over(Window.partitionBy("track").orderBy("idx", "sub")) - 1).alias("idx"), "kind", "energy")


def loop_params(start: Column, end: Column, rate: float, fade: float = 0.012) -> tuple[Column, Column]:
    """(length, crossfade) in samples of a loop between two times."""
    n = F.floor((end - start) * rate + 0.5)
    return n.cast("bigint"), F.least(F.lit(int(fade * rate + 0.5)), F.greatest(F.lit(0), n - 1)).cast("bigint")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def valid_bpm(bpm: Column, low: float = 40.0, high: float = 240.0) -> Column:
    """bpm, or null outside the accepted range."""
    return F.when((bpm >= low) & (bpm <= high), bpm)


def fixed(x: Column, digits: int) -> Column:
    """x with so many digits, halves away from zero."""
    return F.round(x, digits).cast(f"decimal(38,{digits})").cast("string")


def tempo_info(bpm: Column, beats: Column, bar: Column, confidence: Column, weak: float = 0.12) -> Column:
    """Text such as '120 BPM · 4/4 · bar 2.00s', marked where the confidence is weak."""
    note = F.when(confidence < weak, F.lit(" · low confidence")).otherwise(F.lit(""))
    return F.concat(F.floor(bpm + 0.5).cast("bigint").cast("string"), F.lit(" BPM · "), beats.cast("string"), F.lit("/4 · bar "), fixed(bar, 2), F.lit("s"), note)


def crop_info(start: Column, end: Column, bar: Column) -> Column:
    """Text such as '0:03 – 0:11 · 8.0s · 4.0 bars'."""
    return F.concat(format_time(start), F.lit(" – "), format_time(end), F.lit(" · "), fixed(end - start, 1), F.lit("s"), F.coalesce(F.concat(F.lit(" · "), fixed((end - start) / bar, 1), F.lit(" bars")), F.lit("")))
