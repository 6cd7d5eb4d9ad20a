"""Cropping, looping, mixing and rendering of samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def downmix(signal: DataFrame) -> DataFrame:
    """(track, i, x): the mean of the channels."""
    return signal.groupBy("track", "i").agg(F.avg("x").alias("x"))


def crop(signal: DataFrame, start: float, rate: float, length: int | None = None, end: float | None = None) -> DataFrame:
    """Samples from ``start`` seconds on, ``length`` of them or up to ``end`` seconds, numbered from 0; fewer at the signal's end. The bounds reach the scan."""
    a = max(0, math.floor(start * rate))
    b = a + length if length is not None else math.floor(end * rate)
    return signal.where((F.col("i") >= a) & (F.col("i") < b)).withColumn("i", F.col("i") - a)


def loop_trim(signal: DataFrame, length: int, crossfade: int, keys: list[str] | None = None) -> DataFrame:
    """``length`` samples that repeat without a click: what follows them fades out over their beginning.

    Sample i < cf meets sample m + i by an equality join; cf is cut to what follows.
    """
    keys = keys or ["track", "ch"]
    n = F.max("i").over(Window.partitionBy(*keys)) + 1
    sized = signal.withColumn("m", F.least(F.lit(length).cast("bigint"), n)).withColumn("cf", F.least(F.lit(crossfade).cast("bigint"), F.col("m"), n - F.col("m")))
    tail = sized.where((F.col("i") >= F.col("m")) & (F.col("i") < F.col("m") + F.col("cf"))).select(*keys, (F.col("i") - F.col("m")).alias("i"), F.col("x").alias("tail"))
    w = F.col("i") / F.col("cf")
    faded = F.when(F.col("tail").isNotNull(), (1 - w) * F.col("tail") + w * F.col("x")).otherwise(F.col("x"))
    return sized.where(F.col("i") < F.col("m")).join(tail, [*keys, "i"], "left").select(*keys, "i", faded.alias("x"))


def fan_out(parts: DataFrame, channels: int | None = None, by: tuple[str, ...] = ("mix",)) -> DataFrame:
    """parts (by, part, ch, i, x) with ``channels`` channels each, or as many as the widest of the mix: missing ones repeat the last."""
    own = parts.groupBy(*by, "part").agg((F.max("ch") + 1).alias("own"))
    want = F.max("own").over(Window.partitionBy(*by)) if channels is None else F.lit(channels)
    dim = own.withColumn("want", want).select(*by, "part", "own", F.explode(F.sequence(F.lit(0), F.col("want") - 1)).alias("out")).select(*by, "part", "out", F.least(F.col("out"), F.col("own") - 1).alias("ch"))
    return parts.join(dim, [*by, "part", "ch"]).select(*by, "part", F.col("out").alias("ch"), "i", "x")


def mix(parts: DataFrame, by: tuple[str, ...] = ("mix",)) -> DataFrame:
    """(by, ch, i, x): the sum of the parts, as long and as wide as the largest."""
    return fan_out(parts, None, by).groupBy(*by, "ch", "i").agg(F.sum("x").alias("x"))


def plan_timeline(slots: DataFrame, bodies: DataFrame) -> DataFrame:
    """(mix, a_body, transition_start, transition, b_start, b_body, total) in samples.

    slots: (mix, slot, n, repeats); bodies: (mix, a_n, b_n), null where there is none. The transition is as long as its longest slot.
    """
    longest = slots.groupBy("mix").agg(F.max(F.col("n") * F.greatest(F.lit(0), F.col("repeats"))).alias("transition"))
    a, b, t = (F.coalesce(c, F.lit(0)).cast("bigint") for c in ("a_n", "b_n", "transition"))
    return bodies.join(longest, "mix", "left").select("mix", a.alias("a_body"), a.alias("transition_start"), t.alias("transition"), (a + t).alias("b_start"), b.alias("b_body"), (a + t + b).alias("total"))


def slot_samples(slots: DataFrame, loops: DataFrame) -> DataFrame:
    """(mix, slot, ch, j, x): loops (mix, slot, ch, i, x) repeated under each slot's envelope; j counts from the slot's start.

    slots: (mix, slot, n, repeats, entrance, exit, gain). 'fade' goes from 0 to the gain over the first half of the slot's life, or to 0 over
    the last half; 'hard' keeps the gain. A negative gain is 0.
    """
    live = slots.withColumn("life", F.col("n") * F.greatest(F.lit(0), F.col("repeats"))).where("life > 0")
    spread = live.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("repeats") - 1)))
    rows = spread.join(loops, ["mix", "slot"])
    j = F.col("i") + F.col("r") * F.col("n")
    half = F.col("life") / 2
    g = F.greatest(F.lit(0.0), F.col("gain"))
    rise = F.when((F.col("entrance") == "fade") & (j < half), g * j / half).otherwise(g)
    level = F.when((F.col("exit") == "fade") & (j >= half), g * (F.col("life") - j) / half).otherwise(rise)
    return rows.select("mix", "slot", "ch", j.alias("j"), (F.col("x") * level).alias("x"))


def render(slots: DataFrame, loops: DataFrame, bodies: DataFrame, body_samples: DataFrame) -> DataFrame:
    """(mix, ch, i, x): the whole composition in two channels, silent where nothing plays, one sample long at least.

    body_samples: (mix, part 'a' or 'b', ch, i, x). Everything is summed on an integer sample grid.
    """
    line = plan_timeline(slots, bodies)
    looped = fan_out(slot_samples(slots, loops).withColumnsRenamed({"slot": "part", "j": "i"}).withColumn("part", F.col("part").cast("string")), 2).join(line.select("mix", F.col("transition_start").alias("at")), "mix")
    placed = fan_out(body_samples, 2).join(line.select("mix", "b_start"), "mix").withColumn("at", F.when(F.col("part") == "b", F.col("b_start")).otherwise(F.lit(0))).drop("b_start")
    sums = looped.unionByName(placed).groupBy("mix", "ch", (F.col("i") + F.col("at")).alias("i")).agg(F.sum("x").alias("x"))
    grid = line.select("mix", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(1), F.col("total")) - 1)).alias("i")).select("mix", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("ch"))
    return grid.join(sums, ["mix", "ch", "i"], "left").select("mix", "ch", "i", F.coalesce("x", F.lit(0.0)).alias("x"))


def gains(tracks: DataFrame) -> DataFrame:
    """tracks (mix, idx, mute, solo) with gain: if any has solo, those alone sound, else all that aren't muted."""
    any_solo = F.max("solo").over(Window.partitionBy("mix"))
    return tracks.withColumn("gain", F.when(F.when(any_solo, F.col("solo")).otherwise(~F.col("mute")), 1.0).otherwise(0.0))


def position(elapsed, length, loop):
    """Where playback stands after ``elapsed`` seconds: round and round in a loop, else at the end at last."""
    return F.when(length <= 0, 0.0).otherwise(F.when(loop, F.pmod(elapsed, length)).otherwise(F.least(elapsed, length)))
