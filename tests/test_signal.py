"""Invariants of the signal operators on synthetic sounds, held against numpy where a kernel is at work."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from resonara.functions import scalars as S
from resonara.operators import arrange, factor, match, parts, pitch, spectral, stretch, tempo
from resonara.sources import wav

RATE = 16000.0


def signal(spark, *channels, track="t"):
    rows = [(track, c, i, float(x)) for c, xs in enumerate(channels) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "track string, ch int, i long, x double")


def values(df, ch=0):
    rows = df.where(F.col("ch") == ch).orderBy("i").collect() if "ch" in df.columns else df.orderBy("i").collect()
    assert [r.i for r in rows] == list(range(len(rows)))
    return np.array([r.x for r in rows])


def tone(hz, n, rate=RATE, gain=1.0):
    return gain * np.sin(2 * np.pi * hz * np.arange(n) / rate)


def clicks(n, every, gain=0.9):
    x = np.zeros(n)
    x[::every] = gain
    return x


def test_stft_equals_numpy_and_blocks_join(spark):
    x = 0.6 * np.sin(0.05 * np.arange(4000)) + 0.3 * np.sin(0.21 * np.arange(4000) + 1)
    want = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, 256)[::64] * spectral.window_values(256), axis=1)
    for block in (1, 7, 1024):
        rows = spectral.stft(signal(spark, x), 256, 64, block).orderBy("t").collect()
        assert [r.t for r in rows] == list(range(len(want)))
        assert np.allclose([r.re for r in rows], want.real) and np.allclose([r.im for r in rows], want.imag)
        back = values(spectral.overlap_add(spectral.stft(signal(spark, x), 256, 64, block), 256, 64, block=block))
        assert len(back) == (len(want) - 1) * 64 + 256 and np.abs(back[64:-64] - x[64 : len(back) - 64]).max() < 1e-9
    assert spectral.stft(signal(spark, x[:255]), 256, 64).count() == 0
    assert spectral.stft(signal(spark, x[:256]), 256, 64).count() == 1


def test_silence(spark):
    cells = spectral.cells(spectral.stft(signal(spark, np.zeros(2000)), 256, 64)).select("track", "t", "b", "mag")
    masked = spectral.hpss_masks(cells)
    assert masked.agg(F.max(F.col("harmonic") + F.col("percussive"))).first()[0] == 0
    assert tuple(spectral.stream_ranks(masked).first()) == ("t", 0.0, 0.0, 1, 0)
    assert tempo.onset_envelope(cells).agg(F.max("env")).first()[0] == 0


def test_generator_and_factorisation():
    assert np.allclose(factor.uniforms(1, 4), [0.6270739405881613, 0.002735721180215478, 0.5274470399599522, 0.9810509674716741], atol=0)
    assert np.allclose(factor.uniforms(7, 2), [0.011704753153026104, 0.06195825757458806], atol=0)
    rng = np.random.default_rng(0)
    v = rng.random((24, 2)) @ rng.random((2, 32))
    w, h = factor.nmf(v, 2, 400, 3)
    assert np.linalg.norm(v - w @ h) / np.linalg.norm(v) < 0.05
    same = np.array([[1.0, 1.0, 0.0], [1.0, 1.0, 0.1], [0.0, 0.0, 1.0]])
    assert factor.cluster(same, np.ones((3, 5))) == [[0, 1], [2]]
    tiny = np.ones((3, 5))
    tiny[2] = 1e-4
    assert sorted(map(sorted, factor.cluster(np.eye(3), tiny))) == [[0, 2], [1]]


def mixture(n=9000):
    return tone(220, n, gain=0.4) + clicks(n, 2000)


@pytest.mark.parametrize("loop", [None, (6000, 192)])
def test_separate_conserves(spark, loop):
    left = mixture()
    made, samples = factor.separate(signal(spark, left, 0.5 * left), RATE, 1024, 256, 30, loop=loop)
    kinds = [r.kind for r in made.orderBy("idx").collect()]
    assert 2 <= len(kinds) <= 4 and {"percussive", "harmonic"} == set(kinds) and kinds == sorted(kinds, reverse=True)
    for ch, want in ((0, left), (1, 0.5 * left)):
        total = values(samples.groupBy("ch", "i").agg(F.sum("x").alias("x")), ch)
        if loop:
            assert len(total) == 6000 and abs(total[0] - want[6000]) < 1e-2  # it begins with what would have come next
            assert np.abs(total[1024:] - want[1024:6000]).max() < 1e-2
        else:
            assert np.abs(total[1024:-1024] - want[1024 : len(total) - 1024]).max() < 1e-2
    assert made.where("kind = 'percussive' and pitch is not null").count() == 0


def test_split_conserves(spark):
    x = tone(180, 8000, gain=0.3) + tone(320, 8000, gain=0.2)
    made, samples = factor.split(signal(spark, x, 0.7 * x), "harmonic", 2, RATE, 1024, 256, 40)
    assert [r.kind for r in made.collect()] == ["harmonic"] * 2
    total = values(samples.groupBy("ch", "i").agg(F.sum("x").alias("x")), 1)
    assert np.abs(total[1024:-1024] - 0.7 * x[1024 : len(total) - 1024]).max() < 1e-2


def test_tempo_of_clicks(spark):
    rate = 8000
    n, beat = 10 * rate, rate // 2
    x = tone(110, n, rate, 0.05)
    for k in range(0, n - 400, beat):
        x[k : k + 400] += 0.9 * np.exp(-np.arange(400) / 80) * (-1.0) ** np.arange(400)
    r = tempo.analyze_tempo(signal(spark, x), float(rate), 512, 128).first()
    assert 116 < r.bpm < 124 and r.crop_end - r.crop_start <= 20 and r.bars in (1, 2, 4, 8)
    assert (r.crop_end - r.crop_start) / r.bar_length == pytest.approx(r.bars)
    grid = spark.createDataFrame([(0.5, 2.0, 0.1, 1.0, 6.1, 30.0), (0.5, 2.0, 0.1, 29.0, 60.0, 30.0), (0.5, 2.0, 0.1, -3.0, 1.0, 30.0)], "beat_period double, bar_length double, first_beat double, start double, end double, duration double")
    snapped = tempo.snap_to_bars(grid).collect()
    assert snapped[0].snap_bars == 3 and snapped[0].snap_start == pytest.approx(1.1)
    assert snapped[1].snap_bars == 1 and snapped[2].snap_start >= 0


def test_pitch(spark):
    n, rate = 20000, 22050.0
    noise = np.random.default_rng(1).uniform(-1, 1, n)
    chord = tone(261.63, n, rate) + tone(329.63, n, rate) + tone(392.0, n, rate)
    both = signal(spark, tone(440, n, rate), track="a").unionByName(signal(spark, noise, track="n")).unionByName(signal(spark, chord, track="c")).unionByName(signal(spark, np.zeros(1000), track="short"))
    got = {r.track: r for r in pitch.analyze_pitch(both, rate).collect()}
    assert got["a"].pitch_class == 9
    assert got["n"].name == "—" and got["n"].confidence < 0.18 and got["n"].pitch_class == -1 and sum(got["n"].chroma) == pytest.approx(1)
    assert got["c"].name == "C major"
    assert got["short"].pitch_class == -1 and got["short"].chroma == [0.0] * 12


def test_matching(spark):
    side = lambda rows: spark.createDataFrame([("p", *r) for r in rows], "pair string, idx int, kind string, v array<double>")
    a = side([(0, "harmonic", [1.0, 0.0]), (1, "percussive", [0.0, 1.0]), (2, "mixed", [0.0, 1.0]), (3, "harmonic", None)])
    b = side([(0, "percussive", [0.0, 1.0]), (1, "harmonic", [0.1, 1.0]), (2, "harmonic", [1.0, 0.1])])
    pairs, ua, ub = match.match_components(a, b)
    assert {(r.a, r.b, r.basis) for r in pairs.collect()} == {(0, 2, "tonal"), (2, 1, "tonal"), (1, 0, "percussive")}
    assert [r.idx for r in ua.collect()] == [3] and ub.count() == 0
    tie = side([(0, "harmonic", [1.0]), (1, "harmonic", [1.0])])
    assert {(r.a, r.b) for r in match.greedy_match(match.candidates(tie, tie)).collect()} == {(0, 0), (1, 1)}
    assert match.greedy_match(match.candidates(a, b), 0.9999).where("basis = 'tonal'").count() == 0
    d = match.percussive_descriptor(signal(spark, tone(400, 5000), track="x").unionByName(signal(spark, np.zeros(10), track="y")), RATE)
    norm = {r.track: r.n for r in d.groupBy("track").agg(F.sum(F.col("x") * F.col("x")).alias("n")).collect()}
    assert norm["x"] == pytest.approx(1) and norm["y"] == 0


def crossings(x):
    return (np.diff(np.signbit(x)) != 0).mean()


def test_stretching(spark):
    x = tone(330, 12000)
    s = signal(spark, x)
    assert list(values(stretch.resample(signal(spark, [0, 1, 2, 3, 4]), 9))) == [k / 2 for k in range(9)]
    assert list(values(stretch.resample(signal(spark, [5.0, 1.0]), 1))) == [5.0]
    long = values(stretch.time_stretch(s, 1.5, 1024))
    assert abs(len(long) / len(x) - 1.5) < 0.1 and abs(crossings(long) / crossings(x) - 1) < 0.1
    up = values(stretch.pitch_shift(s, 12, 1024))
    assert len(up) == len(x) and 1.8 < crossings(up) / crossings(x) < 2.2
    assert len(values(stretch.conform(s, 0.8, 3, 1024))) == 9600
    assert stretch.time_stretch(s, 1.0) is s and stretch.time_stretch(s, float("nan")) is s
    assert len(values(stretch.conform(signal(spark, x[:100]), 2.0, 0, 1024))) == 200


def test_arranging(spark):
    p = spark.createDataFrame([(1, "a", c, i, float(v)) for c, vs in enumerate(([1, 2, 3], [0, -1, -2])) for i, v in enumerate(vs)] + [(1, "b", 0, i, 10.0) for i in range(4)], "mix int, part string, ch int, i long, x double")
    assert list(values(arrange.mix(p))) == [11, 12, 13, 10] and list(values(arrange.mix(p), 1)) == [10, 9, 8, 10]
    slots = spark.createDataFrame([("m", "s", 100, 4, "fade", "hard", 1.0), ("m", "u", 100, 0, "hard", "fade", -1.0)], "mix string, slot string, n int, repeats int, entrance string, exit string, gain double")
    bodies = spark.createDataFrame([("m", 50, None)], "mix string, a_n int, b_n int")
    assert tuple(arrange.plan_timeline(slots, bodies).first()) == ("m", 50, 50, 400, 450, 0, 450)
    loops = spark.createDataFrame([("m", s, 0, i, 1.0) for s in "su" for i in range(100)], "mix string, slot string, ch int, i long, x double")
    env = {r.j: r.x for r in arrange.slot_samples(slots, loops).collect()}
    assert len(env) == 400 and env[0] == 0 and env[100] == 0.5 and env[200] == env[399] == 1
    none = spark.createDataFrame([], "mix string, part string, ch int, i long, x double")
    out = arrange.render(slots.limit(0), loops, spark.createDataFrame([("m", None, None)], "mix string, a_n int, b_n int"), none).collect()
    assert sorted((r.ch, r.i, r.x) for r in out) == [(0, 0, 0.0), (1, 0, 0.0)]
    x = np.arange(20.0)
    cut = values(arrange.loop_trim(signal(spark, x), 12, 4))
    assert list(cut[:4]) == [12, 0.75 * 13 + 0.25, 0.5 * 14 + 1, 0.25 * 15 + 2.25] and list(cut[4:]) == list(x[4:12])
    assert list(values(arrange.loop_trim(signal(spark, x), 30, 4))) == list(x)


def test_wav_round_trip(spark, tmp_path):
    x, y = tone(100, 500, gain=0.8), np.linspace(-1, 1, 500)
    wav.write_wav(signal(spark, x, y, track="My Part"), 8000, str(tmp_path))
    (tmp_path / "broken.wav").write_bytes(b"RIFFxxxx")
    rows = wav.read_wav(spark, str(tmp_path))
    assert {(r.track, r.ch, r.n, r.sample_rate) for r in rows.collect()} == {("my-part.wav", c, 500, 8000.0) for c in (0, 1)}
    back = wav.to_signal(rows)
    assert np.abs(values(back) - x).max() < 1e-4 and np.abs(values(back, 1) - y).max() < 1e-4
    assert wav.same_rate(rows) == 8000
    with pytest.raises(ValueError):
        wav.same_rate(rows.unionByName(rows.withColumn("sample_rate", F.lit(1.0))))


def riff(code, bits, ch, raw, tail=b""):
    form = struct.pack("<HHIIHH", code, ch, 8000, 8000 * ch * bits // 8, ch * bits // 8, bits) + tail
    return b"RIFF" + struct.pack("<I", 36 + len(tail) + len(raw)) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(raw)) + raw


def test_wav_formats(spark, tmp_path):
    x = np.array([[0.0, 0.25, -0.5, 1.0], [-1.0, 0.125, 0.0, 0.75]])
    for bits in (32, 64):
        assert np.array_equal(wav.decode(riff(3, bits, 2, x.T.astype(f"<f{bits // 8}").tobytes()))[1], x)
    ints = (x.T * 2.0**31).clip(-(2**31), 2**31 - 1).astype("<i4")
    guid = struct.pack("<HHI", 22, 32, 3) + b"\x01\x00" + bytes(14)
    assert np.abs(wav.decode(riff(0xFFFE, 32, 2, ints.tobytes(), guid))[1] - x).max() < 1e-6
    assert np.array_equal(wav.decode(riff(1, 24, 1, b"\x00\x00\x80\x00\x00\x40"))[1], [[-1.0, 0.5]])
    assert wav.decode(riff(1, 16, 2, b""))[1].shape == (2, 0)
    for bad in (b"", b"RIFFxxxx", riff(6, 8, 1, b"ab"), riff(1, 16, 0, b"ab")):
        with pytest.raises(ValueError):
            wav.decode(bad)
    (tmp_path / "a").mkdir()
    for n in ("x.wav", "a/x.WAV"):
        (tmp_path / n).write_bytes(riff(3, 32, 1, x[0].astype("<f4").tobytes()))
    assert {(r.track, r.n) for r in wav.read_wav(spark, str(tmp_path), strict=True).collect()} == {("x.wav", 4), ("a/x.WAV", 4)}
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxx")
    with pytest.raises(Exception, match="bad.wav"):
        wav.read_wav(spark, str(tmp_path), strict=True).count()
    with pytest.raises(ValueError, match="several tracks"):
        wav.write_wav(signal(spark, [0.0], track="My Part").unionByName(signal(spark, [0.0], track="my part")), 8000, str(tmp_path))


def test_masks_of_blocks_equal_windows(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((45, 12))
    rows = spark.createDataFrame([("t", t, [float(v) for v in grid[t]]) for t in range(45)], "track string, t long, mag array<double>")
    med = lambda x: np.array([np.median(x[max(0, k - 8) : k + 9], axis=0) for k in range(len(x))])
    h, p = med(grid) ** 2, med(grid.T).T ** 2
    for block in (3, 8, 45, 256):
        got = spectral.hpss_frames(rows, block=block).orderBy("t").collect()
        assert [r.t for r in got] == list(range(45))
        assert np.allclose([r.harmonic for r in got], h / (h + p + 1e-12)) and np.allclose([r.percussive for r in got], p / (h + p + 1e-12))


def test_tempo_of_a_track_without_a_frame(spark):
    r = tempo.analyze_tempo(signal(spark, [0.1] * 100), 8000.0, 512, 128).first()
    assert (r.confidence, r.first_beat, r.first_downbeat) == (0.0, 0.0, 0.0) and r.bpm == pytest.approx(60 * 62.5 / tempo.lag_bounds(62.5)[0])


def test_scalars(spark):
    got = spark.range(1).select(S.format_time(F.lit(125.9)), S.format_time(F.lit(float("nan"))), S.format_time(F.lit(float("inf"))), S.format_time(F.lit(None).cast("double")), S.semitone_distance(F.lit(11), F.lit(0)), S.semitone_distance(F.lit(0), F.lit(6)), S.half_up(F.lit(-2.5)), S.pcm16(F.lit(-2.0)), S.pcm16(F.lit(0.99999)), S.kebab(F.lit("Percussive  1"))).first()
    assert tuple(got) == ("2:05", "0:00", "0:00", "0:00", 1, -6, -2, -32768, 32766, "percussive-1")
    p = spark.createDataFrame([("t", 0, "percussive"), ("t", 1, "harmonic"), ("t", 2, "percussive")], "track string, idx int, kind string")
    assert [r.label for r in parts.labels(p).orderBy("idx").collect()] == ["Percussive 1", "Harmonic 1", "Percussive 2"]
    assert parts.tally(p).first().summary == "3 parts (2 percussive · 1 harmonic)"
