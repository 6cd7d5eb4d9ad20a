"""Non-negative factorisation of spectra, and separation into components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pitch import analyze_pitch
from .spectral import hpss_frames, reconstruct, stft, stream_ranks

EPS = 1e-12


def uniforms(seed: int, n: int) -> np.ndarray:
    """The first n draws of the generator of ``scalars.seeded_uniform``."""
    u32 = np.uint32
    with np.errstate(over="ignore"):
        a = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5) + np.uint64(seed)).astype(u32)
        t = (a ^ (a >> u32(15))) * (a | u32(1))
        t ^= t + (t ^ (t >> u32(7))) * (t | u32(61))
    return (t ^ (t >> u32(14))) / 2.0**32


def nmf(v: np.ndarray, rank: int, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """W (F x K) and H (K x T) by multiplicative Kullback-Leibler updates from seeded starts."""
    f, t = v.shape
    u = 0.9 * uniforms(seed, f * rank + rank * t) + 0.1
    w, h = u[: f * rank].reshape(f, rank), u[f * rank :].reshape(rank, t)
    for _ in range(iterations):
        h = h * (w.T @ (v / (w @ h + EPS))) / (w.sum(0)[:, None] + EPS)
        w = w * ((v / (w @ h + EPS)) @ h.T) / (h.sum(1)[None, :] + EPS)
    return w, h


def cluster(w: np.ndarray, h: np.ndarray, merge: float = 0.85, least: float = 0.08) -> list[list[int]]:
    """Groups of components: average linkage on basis cosines while ``merge`` is reached, then small shares join their most similar group."""
    k = w.shape[1]
    unit = w / (np.sqrt((w * w).sum(0)) + EPS)
    cos, weight = unit.T @ unit, w.sum(0) * h.sum(1)
    share = weight / (weight.sum() or 1.0)
    groups = [[i] for i in range(k)]
    link = lambda a, b: cos[np.ix_(a, b)].mean()
    while len(groups) > 1:
        sims = {(i, j): link(groups[i], groups[j]) for i in range(len(groups)) for j in range(i + 1, len(groups))}
        (i, j), best = max(sims.items(), key=lambda x: (x[1], -x[0][0], -x[0][1]))
        if best < merge:
            break
        groups[i] += groups.pop(j)
    while len(groups) > 1:
        sizes = [share[g].sum() for g in groups]
        i = int(np.argmin(sizes))
        if sizes[i] >= least:
            break
        others = [j for j in range(len(groups)) if j != i]
        j = max(others, key=lambda j: (link(groups[i], groups[j]), -j))
        groups[j] += groups[i]
        groups.pop(i)
    return groups


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    """Bins x frames from rows (t, v array)."""
    return np.stack(pdf.sort_values("t")["v"].to_numpy()).astype(float).T


def factorize(streams: DataFrame, iterations: int = 80, seed_col: str = "seed", rank_col: str = "rank") -> DataFrame:
    """(track, stream, side, a, b, x): W as (side 'w', bin, component), H as (side 'h', component, frame).

    streams: (track, stream, seed, rank, t, v array). One group a track and stream, which the crop bounds; groups run side by side.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(pdf)
        w, h = nmf(v, min(int(pdf[rank_col].iloc[0]), *v.shape), iterations, int(pdf[seed_col].iloc[0]))
        parts = []
        for side, m in (("w", w), ("h", h)):
            a, b = np.indices(m.shape)
            parts.append(pd.DataFrame({"side": side, "a": a.ravel(), "b": b.ravel(), "x": m.ravel()}))
        return pd.concat(parts).assign(track=pdf["track"].iloc[0], stream=pdf["stream"].iloc[0])[["track", "stream", "side", "a", "b", "x"]]

    return streams.groupBy("track", "stream").applyInPandas(fit, "track string, stream string, side string, a bigint, b bigint, x double")


def component_masks(streams: DataFrame, iterations: int = 80, auto: bool = True) -> DataFrame:
    """(track, stream, part, t, mask array): the soft mask of each component group, or of each component unless ``auto``.

    streams: (track, stream, seed, rank, t, v array, stream_mask array). Masks of a stream sum to its own mask.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v = _matrix(pdf)
        w, h = nmf(v, min(int(pdf["rank"].iloc[0]), *v.shape), iterations, int(pdf["seed"].iloc[0]))
        own = np.stack(pdf["stream_mask"].to_numpy()).astype(float)
        every = (w @ h).T + EPS
        rows = []
        for n, g in enumerate(cluster(w, h) if auto else [[k] for k in range(w.shape[1])]):
            rows.append(pd.DataFrame({"part": n, "t": pdf["t"].to_numpy(), "mask": list(own * (w[:, g] @ h[g]).T / every)}))
        return pd.concat(rows).assign(track=pdf["track"].iloc[0], stream=pdf["stream"].iloc[0])[["track", "stream", "part", "t", "mask"]]

    return streams.groupBy("track", "stream").applyInPandas(fit, "track string, stream string, part int, t bigint, mask array<double>")


def relational_masks(cell_rows: DataFrame, w: DataFrame, h: DataFrame) -> DataFrame:
    """(track, t, b, k, mask) from cells (track, t, b, stream_mask), W (track, b, k, x) and H (track, k, t, x), by joins."""
    wh = w.select("track", "b", "k", F.col("x").alias("wx")).join(h.select("track", "k", "t", F.col("x").alias("hx")), ["track", "k"]).select("track", "t", "b", "k", (F.col("wx") * F.col("hx")).alias("wh"))
    total = F.sum("wh").over(Window.partitionBy("track", "t", "b")) + F.lit(EPS)
    return cell_rows.select("track", "t", "b", "stream_mask").join(wh.withColumn("total", total), ["track", "t", "b"]).select("track", "t", "b", "k", (F.col("stream_mask") * F.col("wh") / F.col("total")).alias("mask"))


def basis_cosines(w: DataFrame) -> DataFrame:
    """(track, i, j, cosine) of each pair i < j of basis columns (track, b, k, x)."""
    a = w.select("track", "b", F.col("k").alias("i"), F.col("x").alias("xi"))
    c = w.select("track", "b", F.col("k").alias("j"), F.col("x").alias("xj"))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))) + F.lit(EPS)
    return a.join(c, ["track", "b"]).where("i < j").groupBy("track", "i", "j").agg((F.sum(F.col("xi") * F.col("xj")) / (norm("xi") * norm("xj"))).alias("cosine"))


def component_shares(w: DataFrame, h: DataFrame) -> DataFrame:
    """(track, k, share): basis sum times activation sum, as a share of all."""
    ws = w.groupBy("track", "k").agg(F.sum("x").alias("ws"))
    hs = h.groupBy("track", "k").agg(F.sum("x").alias("hs"))
    weight = ws.join(hs, ["track", "k"]).select("track", "k", (F.col("ws") * F.col("hs")).alias("weight"))
    total = F.sum("weight").over(Window.partitionBy("track"))
    return weight.select("track", "k", (F.col("weight") / F.when(total == 0, 1.0).otherwise(total)).alias("share"))


def pair_groups(w: DataFrame, h: DataFrame, merge: float = 0.85, least: float = 0.08) -> DataFrame:
    """(track, k, grp) for two components a track: one group if their bases agree or the smaller share is too small."""
    small = component_shares(w, h).groupBy("track").agg(F.min("share").alias("small"))
    one = basis_cosines(w).join(small, "track").select("track", ((F.col("cosine") >= merge) | (F.col("small") < least)).alias("one"))
    return w.select("track", "k").distinct().join(one, "track").select("track", "k", F.when(F.col("one"), 0).otherwise(F.col("k")).cast("int").alias("grp"))


def _loop(parts: DataFrame, keys: list[str], length: int | None, crossfade: int) -> DataFrame:
    from .arrange import loop_trim

    return loop_trim(parts, length, crossfade, keys)


def render_components(frames: DataFrame, masks: DataFrame, mono: DataFrame, rate: float, n_fft: int, hop: int, loop: tuple[int, int] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(components, samples): components (track, idx, kind, energy, pitch...), samples (track, idx, ch, i, x).

    masks: (track, kind, part, t, mask). Percussive ones come first, each kind by falling energy; a loop is trimmed and crossfaded, else cut to the signal.
    """
    label = F.concat_ws(":", "kind", F.col("part").cast("string"))
    raw = reconstruct(frames, masks.select("track", label.alias("part"), "t", "mask"), n_fft, hop)
    if loop:
        cut = _loop(raw, ["track", "part", "ch"], *loop)
    else:
        size = mono.groupBy("track").agg(F.max("i").alias("last"))
        cut = raw.join(size, "track").where(F.col("i") <= F.col("last")).drop("last")
    cut = keep(cut)
    first = cut.where("ch = 0")
    energy = first.groupBy("track", "part").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("energy"))
    kind = F.substring_index("part", ":", 1)
    order = Window.partitionBy("track").orderBy(F.when(kind == "percussive", 0).otherwise(1), F.desc("energy"), F.substring_index("part", ":", -1).cast("int"))
    ranked = energy.select("track", "part", kind.alias("kind"), "energy", (F.row_number().over(order) - 1).alias("idx"))
    tonal = first.where(kind != "percussive").select(F.to_json(F.struct("track", "part")).alias("track"), "ch", "i", "x")
    pitch = analyze_pitch(tonal, rate).withColumn("z", F.from_json("track", "track string, part string")).select("z.track", "z.part", F.struct("pitch_class", "tonic", "mode", "name", "confidence", "chroma").alias("pitch"))
    components = ranked.join(pitch, ["track", "part"], "left").select("track", "idx", "kind", "energy", "pitch")
    return components, cut.join(ranked.select("track", "part", "idx"), ["track", "part"]).select("track", "idx", "ch", "i", "x")


def separate(signal: DataFrame, rate: float, n_fft: int = 2048, hop: int = 512, iterations: int = 80, percussive: int | None = None, harmonic: int | None = None, loop: tuple[int, int] | None = None, seeds: tuple[int, int] = (1, 7), keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Components and their samples of each track of (track, ch, i, x), see ``render_components``.

    Masks come from the mean of the channels and are laid on each channel. A count fixes a stream's components; None lets shares and
    clustering decide. ``keep`` is applied to what is used more than once, the stream masks and the rendered samples: a function
    that writes a table and returns it has each of them computed once.
    """
    from .arrange import downmix

    mono = downmix(signal).select("track", F.lit(0).alias("ch"), "i", "x")
    masked = keep(hpss_frames(stft(mono, n_fft, hop).select("track", "t", F.zip_with("re", "im", F.hypot).alias("mag"))))
    ranks = stream_ranks(masked, percussive, harmonic)
    streams = []
    for kind, seed, given in (("percussive", seeds[0], percussive), ("harmonic", seeds[1], harmonic)):
        rows = masked.select("track", "t", F.zip_with("mag", kind, lambda m, w: m * w).alias("v"), F.col(kind).alias("stream_mask"))
        rank = ranks.select("track", F.col(f"k_{kind}").alias("rank")).where("rank > 0")
        streams.append(component_masks(rows.join(rank, "track").select("track", F.lit(kind).alias("stream"), F.lit(seed).alias("seed"), "rank", "t", "v", "stream_mask"), iterations, given is None))
    masks = streams[0].unionByName(streams[1]).withColumnRenamed("stream", "kind")
    return render_components(stft(signal, n_fft, hop), masks, mono, rate, n_fft, hop, loop, keep)


def split(signal: DataFrame, kind: str, count: int, rate: float, n_fft: int = 2048, hop: int = 512, iterations: int = 80, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """``count`` finer parts of each track, which is one component of ``kind``; they sum to it."""
    from .arrange import downmix

    mono = downmix(signal).select("track", F.lit(0).alias("ch"), "i", "x")
    rows = stft(mono, n_fft, hop).select("track", "t", F.zip_with("re", "im", F.hypot).alias("v"))
    masks = component_masks(rows.select("track", F.lit(kind).alias("stream"), F.lit(1).alias("seed"), F.lit(count).alias("rank"), "t", "v", F.transform("v", lambda _: F.lit(1.0)).alias("stream_mask")), iterations, auto=False)
    return render_components(stft(signal, n_fft, hop), masks.withColumnRenamed("stream", "kind"), mono, rate, n_fft, hop, keep=keep)
