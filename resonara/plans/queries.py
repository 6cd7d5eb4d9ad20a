"""One query for each signal operator, over the warehouse tables. Sizes are small, so that a direct transform in SQL can check them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import arrange, factor, match, parts, pitch, spectral, stretch, tempo
from ..sources import wav
from ..sources.shelf import Shelf
from ..sources.tables import components, days, hours, sides, table, vectors

N, HOP = 64, 16
#: Samples a second that hourly series are given, so that a frame step is a quarter of a second.
RATE = 64.0
LAGS, CENTER = (2, 20), 40.0
#: Bins of EMB get these frequencies for pitch: 32.5 Hz each.
PITCH_RATE, PITCH_FFT = 4160.0, 128


def mono(spark: SparkSession, d: str) -> DataFrame:
    return arrange.downmix(hours(spark, d)).select("track", F.lit(0).alias("ch"), "i", "x")


def mono_cells(spark: SparkSession, d: str) -> DataFrame:
    return spectral.cells(spectral.stft(mono(spark, d), N, HOP))


def tidy(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: S.tidy(F.col(c), digits) for c in columns})


# sources, slicing, mixing down


def downmix_mono(spark, d):
    return tidy(arrange.downmix(hours(spark, d)), "x")


def crop_channels(spark, d):
    return tidy(arrange.crop(hours(spark, d), 1.3, RATE, length=200), "x")


def crop_mono(spark, d):
    return tidy(arrange.crop(mono(spark, d), 0.5, RATE, end=2.25).drop("ch"), "x")


def loop_trim(spark, d):
    return tidy(arrange.loop_trim(days(spark, d), 300, 40), "x")


def rms_energy(spark, d):
    return tidy(hours(spark, d).groupBy("track", "ch").agg(parts.rms(F.col("x")).alias("rms")), "rms")


def pcm16(spark, d):
    return days(spark, d).select("track", "i", S.pcm16(F.col("x") - 0.5).alias("v"))


def wav_bytes(spark, d):
    small = days(spark, d).where("i < 50").withColumn("x", F.col("x") - 0.5)
    return wav.wav_bytes(small, 8000).select("track", F.hex("wav").alias("wav_hex"))


# transforms


def hann_frames(spark, d):
    return tidy(spectral.framed_cells(hours(spark, d).where("ch = 0"), N, HOP), "xw")


def fft_bins(spark, d):
    return tidy(mono_cells(spark, d).select("track", "t", "b", "re", "im"), "re", "im", digits=4)


def stft_magnitude(spark, d):
    return tidy(mono_cells(spark, d).select("track", "t", "b", "mag"), "mag", digits=4)


def istft_roundtrip(spark, d):
    return tidy(spectral.overlap_add(spectral.stft(mono(spark, d), N, HOP), N, HOP).drop("ch"), "x", digits=4)


def masked_reconstruct(spark, d):
    frames = spectral.stft(mono(spark, d), N, HOP)
    masks = frames.select("track", F.lit("low").alias("part"), "t", F.transform("re", lambda _, b: F.lit(1.0) / (1 + b)).alias("mask"))
    return tidy(spectral.reconstruct(frames, masks, N, HOP).select("track", "i", "x"), "x", digits=4)


# medians and masks


def median_filter(spark, d):
    return tidy(days(spark, d).select("track", "i", spectral.running_median("x", "i", 8, ["track"]).alias("median")), "median", digits=10)


def hpss_masks(spark, d):
    return tidy(spectral.hpss_masks(vectors(spark, d)).drop("mag"), "harmonic", "percussive")


def stream_ranks(spark, d):
    return tidy(spectral.stream_ranks(spectral.hpss_masks(vectors(spark, d)), presence=0.4), "percussive_share", "harmonic_share")


# factorisation


def prng_draws(spark, d):
    n = spark.range(0, 2000)
    return n.select(F.col("id").alias("n"), S.seeded_uniform(1, F.col("id")).alias("u1"), S.seeded_uniform(7, F.col("id")).alias("u7"))


def _fit(spark, d):
    streams = mono_cells(spark, d).groupBy("track", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "mag"))), lambda z: z["mag"]).alias("v"))
    fit = factor.factorize(streams.select("track", F.lit("all").alias("stream"), F.lit(1).alias("seed"), F.lit(2).alias("rank"), "t", "v"), iterations=3)
    w = fit.where("side = 'w'").select("track", F.col("a").alias("b"), F.col("b").cast("int").alias("k"), "x")
    return w, fit.where("side = 'h'").select("track", F.col("a").cast("int").alias("k"), F.col("b").alias("t"), "x")


def nmf_basis(spark, d):
    return tidy(_fit(spark, d)[0], "x")


def nmf_activations(spark, d):
    return tidy(_fit(spark, d)[1], "x", digits=4)


def component_masks(spark, d):
    cells = mono_cells(spark, d).select("track", "t", "b", F.lit(1.0).alias("stream_mask"))
    return tidy(factor.relational_masks(cells, *_fit(spark, d)), "mask")


def basis_cosines(spark, d):
    return tidy(factor.basis_cosines(_fit(spark, d)[0]), "cosine")


def component_shares(spark, d):
    return tidy(factor.component_shares(*_fit(spark, d)), "share")


def cluster_components(spark, d):
    return factor.pair_groups(*_fit(spark, d), merge=0.9)


def grouped_masks(spark, d):
    """Three components a track and the groups that they come to."""
    rows = spectral.stft(mono(spark, d), N, HOP).select("track", F.lit("all").alias("stream"), F.lit(1).alias("seed"), F.lit(3).alias("rank"), "t", F.zip_with("re", "im", F.hypot).alias("v"))
    made = factor.component_masks(rows.withColumn("stream_mask", F.transform("v", lambda _: F.lit(1.0))), iterations=3)
    return tidy(made.select("track", "part", "t", F.posexplode("mask").alias("b", "mask")), "mask")


def separate_five(spark, d):
    """All of ``separate``, two transient and three steady parts, at three iterations, so that SQL can follow."""
    _, samples = factor.separate(hours(spark, d), 48.0, N, HOP, 3, 2, 3, keep=Shelf(spark, "separate").put)
    return tidy(samples, "x", digits=4)


def split_three(spark, d):
    _, samples = factor.split(hours(spark, d).where("ch = 0"), "harmonic", 3, 48.0, N, HOP, 3, keep=Shelf(spark, "split").put)
    return tidy(samples, "x", digits=4)


def separate_stems(spark, d):
    """No SQL: 80 iterations. Tests hold the sum of the parts against the input."""
    made, _ = factor.separate(hours(spark, d), 48.0, N, HOP, keep=Shelf(spark, "separate").put)
    return made.select("track", "idx", "kind", "energy", "pitch.name", "pitch.confidence")


def split_stem(spark, d):
    _, samples = factor.split(hours(spark, d).where("ch = 0"), "harmonic", 3, 48.0, N, HOP, 20)
    return samples


# tempo


def _env(spark, d):
    return tempo.onset_envelope(mono_cells(spark, d))


def onset_envelope(spark, d):
    return tidy(_env(spark, d), "env")


def tempo_lag_scores(spark, d):
    return tidy(tempo.lag_scores(_env(spark, d), RATE / HOP, LAGS, CENTER), "ac", "score")


def best_lag(spark, d):
    return tidy(tempo.best_lag(tempo.lag_scores(_env(spark, d), RATE / HOP, LAGS, CENTER)), "confidence")


def beat_phase(spark, d):
    env = _env(spark, d)
    return tempo.beat_phase(env, tempo.best_lag(tempo.lag_scores(env, RATE / HOP, LAGS, CENTER)))


def downbeat(spark, d):
    env = _env(spark, d)
    lags = tempo.best_lag(tempo.lag_scores(env, RATE / HOP, LAGS, CENTER))
    return tempo.downbeat(env, lags, tempo.beat_phase(env, lags))


def analyze_tempo(spark, d):
    found = tempo.analyze_tempo(mono(spark, d), RATE, N, HOP, 60.0, 8.0, LAGS, CENTER)
    return tidy(found, "bpm", "beat_period", "bar_length", "first_beat", "first_downbeat", "confidence", "duration", "crop_start", "crop_end")


def _selections(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.lit(0.5).alias("beat_period"), F.lit(2.0).alias("bar_length"), F.lit(0.3).alias("first_beat"), (F.col("p_size") - 4.1).alias("start"), (F.col("p_size") - 4.1 + F.col("p_retailprice") / 100).alias("end"), F.lit(60.0).alias("duration"))


def snap_to_bars(spark, d):
    return tidy(tempo.snap_to_bars(_selections(spark, d)).select("p_partkey", "snap_start", "snap_end", "snap_bars"), "snap_start", "snap_end")


# pitch


def _chroma(spark, d):
    return pitch.chroma(vectors(spark, d), pitch.pitch_classes(spark, 64, PITCH_FFT, PITCH_RATE))


def chroma(spark, d):
    return tidy(_chroma(spark, d), "p")


def tonality(spark, d):
    return tidy(pitch.tonality(_chroma(spark, d)), "tonality")


def key_correlation(spark, d):
    return tidy(pitch.key_scores(_chroma(spark, d)), "r")


def detect_key(spark, d):
    return tidy(pitch.detect_key(pitch.key_scores(_chroma(spark, d))), "confidence")


def label_pitch(spark, d):
    got = pitch.label_pitch(_chroma(spark, d), floor=0.005)
    return tidy(got.drop("chroma"), "confidence")


# matching


def perc_descriptor(spark, d):
    return tidy(match.percussive_descriptor(mono(spark, d), RATE, N, 32, 10.0, 8, 2.0), "x")


def cosine_matrix(spark, d):
    return tidy(match.candidates(*sides(spark, d)), "similarity")


def greedy_match(spark, d):
    return tidy(match.match_components(*sides(spark, d))[0].drop("rank"), "similarity")


def unpaired(spark, d):
    a, b = sides(spark, d)
    _, ua, ub = match.match_components(a.where("idx % 5 <> 0"), b, keep=Shelf(spark, "match").put)
    return ua.withColumn("side", F.lit("a")).unionByName(ub.withColumn("side", F.lit("b")))


def semitone_distance(spark, d):
    p = table(spark, d, "part")
    a, b = (F.col("p_partkey") % 12).cast("int"), (F.col("p_size") % 12).cast("int")
    return p.select("p_partkey", S.semitone_distance(a, b).alias("semitones"))


# stretching


def resample_linear(spark, d):
    return tidy(stretch.resample(days(spark, d), 1000).drop("ch"), "x")


def time_stretch(spark, d):
    return tidy(stretch.time_stretch(mono(spark, d), 1.5, N).drop("ch"), "x", digits=4)


def pitch_shift(spark, d):
    return tidy(stretch.pitch_shift(mono(spark, d), 4, N).drop("ch"), "x", digits=4)


def conform(spark, d):
    return tidy(stretch.conform(mono(spark, d), 0.8, -3, N).drop("ch"), "x", digits=4)


# arranging


def mix_channels(spark, d):
    folded = hours(spark, d).where("ch = 0 or length(track) % 2 = 1")
    return tidy(arrange.mix(folded.select(F.lit(1).alias("mix"), F.col("track").alias("part"), "ch", "i", "x")).drop("mix"), "x")


def _slots(spark, d):
    h = hours(spark, d).where("i < 48").withColumn("mix", F.lit("m"))
    loops = h.select("mix", F.col("track").alias("slot"), "ch", "i", "x")
    size = F.length("slot")
    slots = loops.groupBy("mix", "slot").agg((F.max("i") + 1).alias("n")).select("mix", "slot", "n", (size % 4).alias("repeats"), F.when(size % 2 == 0, "fade").otherwise("hard").alias("entrance"), F.when(size % 3 == 0, "fade").otherwise("hard").alias("exit"), (size / 10.0).alias("gain"))
    body = hours(spark, d).where("i < 30").groupBy("ch", "i").agg(F.sum("x").alias("x")).withColumn("mix", F.lit("m"))
    bodies = spark.range(1).select(F.lit("m").alias("mix"), F.lit(30).alias("a_n"), F.lit(20).alias("b_n"))
    samples = body.select("mix", F.lit("a").alias("part"), "ch", "i", "x").unionByName(body.where("i < 20").select("mix", F.lit("b").alias("part"), "ch", "i", "x"))
    return slots, loops, bodies, samples


def plan_timeline(spark, d):
    slots, _, bodies, _ = _slots(spark, d)
    return arrange.plan_timeline(slots, bodies)


def fade_envelope(spark, d):
    slots, loops, _, _ = _slots(spark, d)
    return tidy(arrange.slot_samples(slots, loops).drop("mix"), "x")


def render_mix(spark, d):
    return tidy(arrange.render(*_slots(spark, d)).drop("mix"), "x")


def solo_mute(spark, d):
    c = table(spark, d, "customer")
    t = c.select(F.col("c_nationkey").alias("mix"), F.col("c_custkey").alias("idx"), (F.col("c_custkey") % 3 == 0).alias("mute"), ((F.col("c_custkey") % 7 == 0) & (F.col("c_nationkey") % 2 == 0)).alias("solo"))
    return arrange.gains(t).select("idx", "gain")


def transport_position(spark, d):
    p = table(spark, d, "part")
    at = arrange.position(F.col("p_retailprice"), F.col("p_size").cast("double"), F.col("p_partkey") % 2 == 0)
    return tidy(p.select("p_partkey", at.alias("position")), "position", digits=4)


# lists of components


def waveform_peaks(spark, d):
    return tidy(parts.peaks(days(spark, d), 120), "lo", "hi")


def component_labels(spark, d):
    return parts.labels(components(spark, d)).select("track", "idx", "label", S.kebab(F.concat("label", F.lit(".wav"))).alias("file"))


def component_order(spark, d):
    return parts.order_components(components(spark, d)).select("track", "idx", "pos")


def describe_parts(spark, d):
    return parts.tally(components(spark, d))


def deck_tonic(spark, d):
    return parts.deck_tonic(components(spark, d))


def target_defaults(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    decks = s.select(k.alias("pair"), F.when(k % 4 > 0, F.abs("s_acctbal") / 50).alias("a_bpm"), F.when(k % 3 > 0, (k % 12).cast("int")).alias("a_tonic"), F.when(k % 2 > 0, (k % 11).cast("int")).alias("b_tonic"))
    return parts.target_defaults(decks)


def _selection(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.when(F.col("c_custkey") % 2 == 0, "A").otherwise("B").alias("source"), F.col("c_custkey").alias("idx"))


def slot_settings(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0")
    k = F.col("o_orderkey")
    own = o.select(F.when(k % 2 == 0, "A").otherwise("B").alias("source"), k.alias("idx"), (1 + k % 16).cast("int").alias("repeats"), F.when(k % 5 == 0, "hard").alias("entrance"), F.when(k % 7 == 0, "fade").alias("exit"), ((k % 100) / 100.0).alias("gain"))
    return parts.merge_settings(_selection(spark, d), own)


def prune_selection(spark, d):
    have = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 4 < 2, "A").otherwise("B").alias("source"), F.col("s_suppkey").alias("idx"))
    return parts.prune_selection(_selection(spark, d), have)


def key_roundtrip(spark, d):
    key = parts.format_key(F.col("source"), F.col("idx"))
    source, idx = parts.parse_key(F.col("key"))
    return _selection(spark, d).select(key.alias("key")).select("key", source.alias("source"), idx.alias("idx"))


def combine_parts(spark, d):
    h = hours(spark, d)
    seat = h.select("track").distinct().select("track", (F.row_number().over(Window.orderBy("track")) - 1).alias("idx"))
    kinds = seat.select(F.lit("deck").alias("deck"), "track", "idx", F.when(F.col("idx") % 2 == 0, "harmonic").otherwise("percussive").alias("kind"))
    samples = h.join(seat, "track").select(F.lit("deck").alias("track"), "idx", "ch", "i", "x")
    listed = kinds.select(F.col("deck").alias("track"), "idx", "kind")
    made, _ = parts.combine(listed, samples, listed.where("idx in (1, 2)").select("track", "idx"))
    return tidy(made.drop("merged"), "energy")


def splice_split(spark, d):
    c = components(spark, d)
    new = c.select("track").distinct().select("track", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("sub")).withColumns({"kind": F.lit("harmonic"), "energy": F.col("sub").cast("double")})
    return parts.splice(c, 1, new)


def format_time(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", S.format_time(F.col("o_totalprice") / 100).alias("shown"))


def similarity_percent(spark, d):
    """Shares are summed in the order of the file, as SQL does in one thread: half percents then don't hang on how the table is cut."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_discount", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    order = Window.partitionBy("l_orderkey").orderBy("file", "at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select("l_orderkey", F.sum("l_discount").over(so_far).alias("sum"), F.count("l_discount").over(so_far).alias("n"), F.lead(F.lit(True)).over(order).alias("more"))
    return sums.where("more is null").select("l_orderkey", S.percent(F.when(F.col("n") > 0, F.col("sum") / F.col("n"))).alias("shown"))


def clamp_settings(spark, d):
    p = table(spark, d, "part")
    bpm = parts.valid_bpm(F.col("p_retailprice") / 8)
    return p.select("p_partkey", parts.clamp(F.col("p_size") - 5, 1, 16).alias("repeats"), parts.clamp(F.col("p_size") - 25, 0, 4).alias("parts"), S.tidy(bpm).alias("bpm"), F.least(F.col("p_size") + F.lit(20.0), F.col("p_retailprice") / 30).alias("crop_end"))


def loop_params(spark, d):
    p = table(spark, d, "part")
    n, cf = parts.loop_params(F.lit(1.5), F.lit(1.5) + F.col("p_size") / 7.0, 441.0)
    return p.select("p_partkey", n.alias("length"), cf.alias("crossfade"))


def info_texts(spark, d):
    p = table(spark, d, "part")
    bar = F.col("p_size") / 8.0
    info = parts.tempo_info(F.col("p_retailprice") / 10, F.lit(4), bar, F.col("p_size") / 100.0)
    return p.select("p_partkey", info.alias("tempo_text"), parts.crop_info(F.lit(3.0), F.lit(3.0) + F.col("p_size") / 4.0, F.lit(2.0)).alias("crop_text"))
