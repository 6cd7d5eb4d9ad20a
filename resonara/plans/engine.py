"""The whole way from two tracks to a rendered transition."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arrange, factor, match, parts, stretch, tempo
from ..sources import wav
from ..sources.shelf import Shelf


@dataclass
class Deck:
    """One track (track, ch, i, x) with its tempo, crop and components."""

    signal: DataFrame
    rate: float
    longest: float = 20.0
    shortest: int = 2048
    n_fft: int = 2048
    hop: int = 512
    iterations: int = 80
    tempo_fft: int = 1024
    tempo_hop: int = 256
    found: dict | None = None
    crop: tuple[float, float] | None = None
    components: DataFrame | None = None
    samples: DataFrame | None = None

    def duration(self) -> float:
        return ((self.signal.agg(F.max("i")).first()[0] or -1) + 1) / self.rate

    def analyze(self) -> dict:
        """Tempo and suggested crop, which becomes the crop unless one is set."""
        mono = arrange.downmix(self.signal).select("track", F.lit(0).alias("ch"), "i", "x")
        row = tempo.analyze_tempo(mono, self.rate, self.tempo_fft, self.tempo_hop, longest=self.longest).first()
        self.found = row.asDict() if row else None
        if self.found and self.crop is None:
            self.crop = (self.found["crop_start"], self.found["crop_end"])
        return self.found

    @property
    def bpm(self) -> float:
        return self.found["bpm"] if self.found else 120.0

    def set_bpm(self, bpm: float) -> None:
        if not 40 <= bpm <= 240:
            raise ValueError("tempo must be 40 to 240")
        self.found = {**(self.found or {}), "bpm": bpm}

    def select(self, start: float, end: float, snap: bool = True) -> tuple[float, float]:
        """Set the crop: at most ``longest`` seconds, on the beat grid if ``snap`` and a tempo is known."""
        end = min(end, start + self.longest)
        if snap and self.found and "beat_period" in self.found:
            keys = ("beat_period", "bar_length", "first_beat")
            row = self.signal.sparkSession.createDataFrame([(*[float(self.found[k]) for k in keys], float(start), float(end), self.duration())], "beat_period double, bar_length double, first_beat double, start double, end double, duration double")
            r = tempo.snap_to_bars(row, self.longest).first()
            start, end = r.snap_start, r.snap_end
        self.crop = (start, end)
        return self.crop

    def decompose(self, percussive: int | None = None, harmonic: int | None = None, loop: bool = True) -> DataFrame:
        """Components of the crop; None leaves a stream's number of parts to the sound."""
        if percussive is not None and harmonic is not None and percussive + harmonic < 1:
            raise ValueError("at least one part is needed")
        start, end = self.crop or (0.0, min(self.longest, self.duration()))
        n = math.floor((end - start) * self.rate + 0.5)
        fade = min(math.floor(0.012 * self.rate + 0.5), max(0, n - 1)) if loop else 0
        cut = arrange.crop(self.signal, start, self.rate, length=n + fade)
        if cut.where("ch = 0").count() < self.shortest:
            raise ValueError(f"the crop is shorter than {self.shortest} samples")
        made, samples = factor.separate(cut, self.rate, self.n_fft, self.hop, self.iterations, percussive, harmonic, (n, fade) if loop else None, keep=self._keep)
        return self._set(made, samples)

    def combine(self, indices: list[int]) -> DataFrame:
        """The listed components become one, at the place of the first."""
        if len(set(indices)) < 2:
            raise ValueError("two components or more are combined")
        chosen = self.components.where(F.col("idx").isin(indices)).select("track", "idx")
        made, samples = parts.combine(self.components.select("track", "idx", "kind"), self.samples, chosen)
        self.samples = self._keep(samples)
        return self._set(self._with_pitch(self._keep(made.drop("merged"))))

    def split(self, index: int, count: int) -> DataFrame:
        """Component ``index`` becomes ``count`` finer ones in its place."""
        kind = self.components.where(F.col("idx") == index).first()["kind"]
        made, finer = factor.split(self.samples.where(F.col("idx") == index).drop("idx"), kind, count, self.rate, self.n_fft, self.hop, self.iterations, self._keep)
        made = self._keep(made)
        old = self.components.select("track", "idx", F.lit(0).alias("sub"), "kind", "energy").where(F.col("idx") != index)
        seats = old.unionByName(made.select("track", F.lit(index).alias("idx"), F.col("idx").alias("sub"), "kind", "energy"))
        spliced = parts.splice(self.components.select("track", "idx", "kind", "energy"), index, made.select("track", F.col("idx").alias("sub"), "kind", "energy"))
        order = [(r.idx, r.sub) for r in seats.select("idx", "sub").orderBy("idx", "sub").collect()]
        new = self.signal.sparkSession.createDataFrame([(a, b, k) for k, (a, b) in enumerate(order)], "idx int, sub int, seat int")
        both = self.samples.where(F.col("idx") != index).withColumn("sub", F.lit(0)).unionByName(finer.withColumn("sub", F.col("idx")).withColumn("idx", F.lit(index)))
        self.samples = self._keep(both.join(F.broadcast(new), ["idx", "sub"]).select("track", F.col("seat").alias("idx"), "ch", "i", "x"))
        return self._set(self._with_pitch(spliced))

    def _keep(self, df: DataFrame) -> DataFrame:
        """df, written to the shared folder: its lineage ends there, and later steps read it."""
        return Shelf(df.sparkSession, "deck").put(df)

    def _set(self, components: DataFrame, samples: DataFrame | None = None) -> DataFrame:
        if samples is not None:
            self.samples = self._keep(samples)
        self.components = self._keep(components)
        return self.components

    def _with_pitch(self, made: DataFrame) -> DataFrame:
        from ..operators.pitch import analyze_pitch

        tonal = self.samples.where("ch = 0").join(made.where("kind <> 'percussive'").select("track", "idx"), ["track", "idx"])
        named = analyze_pitch(tonal.select(F.concat_ws("\t", "track", F.col("idx").cast("string")).alias("track"), "ch", "i", "x"), self.rate)
        pitch = named.select(F.substring_index("track", "\t", 1).alias("track"), F.substring_index("track", "\t", -1).cast("int").alias("idx"), F.struct("pitch_class", "tonic", "mode", "name", "confidence", "chroma").alias("pitch"))
        return made.join(pitch, ["track", "idx"], "left")

    def tonic(self) -> int | None:
        row = parts.deck_tonic(self.components.select("track", "idx", "energy", F.coalesce("pitch.name", F.lit("—")).alias("name"), F.col("pitch.tonic").alias("tonic"))).first()
        return row["tonic"] if row else None

    def side(self) -> DataFrame:
        """(pair, idx, kind, v): chroma of tonal components, band descriptors of percussive ones."""
        perc = self.samples.join(self.components.where("kind = 'percussive'").select("track", "idx"), ["track", "idx"])
        desc = match.percussive_descriptor(perc.select(F.col("idx").cast("string").alias("track"), "ch", "i", "x"), self.rate)
        packed = desc.groupBy("track").agg(F.transform(F.sort_array(F.collect_list(F.struct("band", "x"))), lambda z: z["x"]).alias("d")).select(F.col("track").cast("int").alias("idx"), "d")
        v = F.when(F.col("kind") == "percussive", F.col("d")).otherwise(F.col("pitch.chroma"))
        return self.components.join(packed, "idx", "left").select(F.lit("ab").alias("pair"), "idx", "kind", v.alias("v"))


@dataclass
class Composer:
    """Matches, conforms and renders the components of two decks."""

    a: Deck
    b: Deck
    conform_fft: int = 2048
    memo: dict[tuple, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        if self.a.rate != self.b.rate:
            raise ValueError("both decks need one sample rate")

    def matches(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return match.match_components(self.a.side(), self.b.side())

    def targets(self) -> tuple[float, int]:
        a, b = self.a.tonic(), self.b.tonic()
        return float(math.floor(self.a.bpm + 0.5)), a if a is not None else b if b is not None else 0

    def conformed(self, key: tuple, signal: DataFrame, ratio: float, semitones: float) -> DataFrame:
        """Memoised by key and amounts until ``clear``."""
        full = (*key, round(ratio, 9), semitones)
        if full not in self.memo:
            self.memo[full] = stretch.conform(signal, ratio, semitones, self.conform_fft)
            self.memo[full] = Shelf(signal.sparkSession, "conform").put(self.memo[full])
        return self.memo[full]

    def clear(self) -> None:
        self.memo.clear()

    def render(self, selection: list[tuple[str, int]], settings: dict[tuple[str, int], dict] | None = None, bpm: float | None = None, tonic: int | None = None, pitch_match: bool = True, full: bool = False) -> DataFrame:
        """(mix, ch, i, x) of the selected loops ('A' or 'B', index) under their settings, with the decks' bodies around them if ``full``."""
        spark = self.a.signal.sparkSession
        own_bpm, own_tonic = self.targets()
        bpm, tonic = bpm or own_bpm, own_tonic if tonic is None else tonic
        decks = {"A": self.a, "B": self.b}
        amounts = {}
        for name, deck in decks.items():
            t = deck.tonic()
            amounts[name] = (deck.bpm / bpm, ((tonic - (tonic if t is None else t) + 18) % 12 - 6) if pitch_match else 0)
        chosen = spark.createDataFrame([(s, i) for s, i in selection], "source string, idx int")
        given = spark.createDataFrame([(s, i, v.get("repeats"), v.get("entrance"), v.get("exit"), v.get("gain")) for (s, i), v in (settings or {}).items()], "source string, idx int, repeats int, entrance string, exit string, gain double")
        merged = parts.merge_settings(chosen, given).withColumn("slot", parts.format_key(F.col("source"), F.col("idx")))
        loops = None
        for s, i in selection:
            loop = self.conformed(("loop", s, i), decks[s].samples.where(F.col("idx") == i).select("track", "ch", "i", "x"), *amounts[s])
            rows = loop.select(F.lit("mix").alias("mix"), F.lit(f"{s}:{i}").alias("slot"), "ch", "i", "x")
            loops = rows if loops is None else loops.unionByName(rows)
        if loops is None:
            loops = spark.createDataFrame([], "mix string, slot string, ch int, i long, x double")
        slots = loops.groupBy("mix", "slot").agg((F.max("i") + 1).alias("n")).join(merged, "slot").select("mix", "slot", "n", "repeats", "entrance", "exit", "gain")
        bodies = spark.createDataFrame([], "mix string, part string, ch int, i long, x double")
        if full:
            for s, part in (("A", "a"), ("B", "b")):
                deck = decks[s]
                if not deck.crop:
                    continue
                start, end = (0.0, deck.crop[0]) if s == "A" else (deck.crop[1], deck.duration())
                n = math.floor((end - start) * deck.rate + 0.5)
                if n > 0:
                    body = self.conformed(("body", s), arrange.crop(deck.signal, start, deck.rate, length=n), *amounts[s])
                    bodies = bodies.unionByName(body.select(F.lit("mix").alias("mix"), F.lit(part).alias("part"), "ch", "i", "x"))
        size = lambda p: F.max(F.when(F.col("part") == p, F.col("i") + 1))
        lengths = spark.createDataFrame([("mix",)], "mix string").join(bodies.groupBy("mix").agg(size("a").alias("a_n"), size("b").alias("b_n")), "mix", "left")
        return arrange.render(slots, loops, lengths, bodies)

    def download(self, mixed: DataFrame, folder: str) -> None:
        wav.write_wav(mixed.withColumnRenamed("mix", "track"), int(self.a.rate), folder)


def load(spark, path: str, **params) -> dict[str, Deck]:
    """A deck for each WAV file under path."""
    rows = wav.read_wav(spark, path, strict=True).cache()
    rate = wav.same_rate(rows)
    names = [r.track for r in rows.select("track").distinct().collect()]
    signal = wav.to_signal(rows)
    return {n: Deck(signal.where(F.col("track") == n), rate, **params) for n in sorted(names)}
