import numpy as np
import pytest
from pyspark.sql import functions as F

from resonara.plans.engine import Composer, Deck, load
from resonara.sources import wav

RATE = 4000


def track(hz, beat, seconds=6):
    n = seconds * RATE
    x = 0.3 * np.sin(2 * np.pi * hz * np.arange(n) / RATE)
    for k in range(0, n - 200, int(beat * RATE)):
        x[k : k + 200] += 0.6 * np.exp(-np.arange(200) / 40) * (-1.0) ** np.arange(200)
    return x


def test_two_files_to_a_transition(spark, tmp_path):
    rows = [(name, c, i, float(v)) for name, hz, beat in (("one", 220, 0.5), ("two", 262, 0.6)) for c in (0, 1) for i, v in enumerate(track(hz, beat))]
    wav.write_wav(spark.createDataFrame(rows, "track string, ch int, i long, x double"), RATE, str(tmp_path))
    decks = load(spark, str(tmp_path), n_fft=256, hop=64, iterations=10, tempo_fft=256, tempo_hop=64, shortest=512)
    a, b = decks["one.wav"], decks["two.wav"]
    for d in (a, b):
        d.analyze()
        d.select(1.0, 3.0, snap=False)
        d.decompose(1, 1)
    assert a.components.count() == 2 and a.samples.where("idx = 0 and ch = 1").count() == 2 * RATE
    with pytest.raises(ValueError):
        a.decompose(0, 0)
    both = Composer(a, b, conform_fft=256)
    pairs, ua, ub = both.matches()
    assert pairs.count() == 2 and ua.count() == ub.count() == 0
    bpm, _ = both.targets()
    assert bpm == round(a.bpm)
    out = both.render([("A", 0), ("B", 1)], {("A", 0): {"repeats": 2}}, pitch_match=False, full=True)
    loop_b = int(2 * RATE * b.bpm / bpm + 0.5)
    bodies = int(RATE * a.bpm / bpm + 0.5) + int(3 * RATE * b.bpm / bpm + 0.5)
    got = out.groupBy("ch").agg(F.count("*").alias("n"), F.max("i").alias("last")).collect()
    assert len(got) == 2 and all(r.n == r.last + 1 and abs(r.n - (bodies + max(4 * loop_b, 2 * int(2 * RATE * a.bpm / bpm + 0.5)))) <= 4 for r in got)
    n = len(both.memo)
    both.render([("A", 0)], pitch_match=False)
    assert len(both.memo) == n
    both.clear()
    a.combine([0, 1])
    assert a.components.count() == 1 and a.components.first().kind == "mixed" and a.tonic() is not None
    a.split(0, 2)
    assert [r.idx for r in a.components.orderBy("idx").collect()] == [0, 1] and a.samples.select("idx").distinct().count() == 2
    a.set_bpm(100.0)
    with pytest.raises(ValueError):
        a.set_bpm(20.0)
    with pytest.raises(ValueError):
        Composer(a, Deck(b.signal, 44100.0))
