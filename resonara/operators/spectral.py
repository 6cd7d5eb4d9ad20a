"""Framing, short-time spectra, their inversion, and steady / transient masks.

Signals are rows (track, ch, i, x). A signal is cut into blocks of frames, so that one task never holds more than a
block of it, however long it is; samples near a cut go to both blocks. Transforms are Arrow kernels over whole
blocks, everything on cells (track, ch, t, b, ...) stays in Catalyst.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hann

FRAME_COLUMNS = "track string, ch int, t bigint, re array<double>, im array<double>"


def window_values(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def samples_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, positions and values of a column of arrays of (i, x)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    offsets = np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
    return offsets, flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of arrays."""
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)) if k else pa.array(np.zeros(n + 1, np.int32)), pa.array(rows.ravel()))


def framed_cells(signal: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(track, ch, t, k, xw): each frame's windowed samples, relationally; the tail that fills no frame is dropped."""
    first = F.greatest(F.lit(0), F.ceil((F.col("i") - (n_fft - 1)) / hop).cast("bigint"))
    size = F.max("i").over(Window.partitionBy("track", "ch")) + 1
    counted = signal.withColumn("frames", F.greatest(F.lit(0), F.floor((size - n_fft) / hop).cast("bigint") + 1))
    last = F.least(F.floor(F.col("i") / hop).cast("bigint"), F.col("frames") - 1)
    spread = counted.where(first <= last).select("track", "ch", "i", "x", F.explode(F.sequence(first, last)).alias("t"))
    k = F.col("i") - F.col("t") * hop
    return spread.select("track", "ch", "t", k.alias("k"), (F.col("x") * hann(k, n_fft)).alias("xw"))


def stft(signal: DataFrame, n_fft: int = 2048, hop: int = 512, block: int = 1024) -> DataFrame:
    """Frames (track, ch, t, re, im) of the first n_fft / 2 + 1 bins under a periodic Hann window.

    One exchange, of the samples: a block is ``block`` frames with all samples under them. A frame is there only if
    all its samples are; signals shorter than n_fft have none.
    """
    own = F.floor(F.greatest(F.lit(0), F.ceil((F.col("i") - (n_fft - 1)) / hop)) / block)
    cut = signal.select("track", "ch", "i", "x", F.explode(F.sequence(own.cast("bigint"), F.floor(F.floor(F.col("i") / hop) / block).cast("bigint"))).alias("block"))
    blocks = cut.groupBy("track", "ch", "block").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("samples"))

    def run(batches):
        win = window_values(n_fft)
        for batch in batches:
            offsets, at, x = samples_of(batch.column(3))
            for r in range(batch.num_rows):
                a, b = offsets[r], offsets[r + 1]
                begin = batch.column(2)[r].as_py() * block * hop
                n = min(block, (int(at[b - 1]) + 1 - begin - n_fft) // hop + 1)
                if at[a] > begin or n <= 0:
                    continue
                mine = x[a + (begin - int(at[a])) : b]
                spec = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(mine, n_fft)[:: hop][:n] * win, axis=1)
                track, ch = batch.column(0)[r], batch.column(1)[r]
                yield pa.RecordBatch.from_arrays([pa.array([track.as_py()] * n, pa.string()), pa.array([ch.as_py()] * n, pa.int32()), pa.array(begin // hop + np.arange(n)), lists(np.ascontiguousarray(spec.real)), lists(np.ascontiguousarray(spec.imag))], names=["track", "ch", "t", "re", "im"])

    return blocks.mapInArrow(run, FRAME_COLUMNS)


def cells(frames: DataFrame) -> DataFrame:
    """(track, ch, t, b, re, im, mag), one row a frame and bin."""
    both = frames.select("track", "ch", "t", F.posexplode(F.arrays_zip("re", "im")).alias("b", "z"))
    return both.select("track", "ch", "t", "b", "z.re", "z.im", F.hypot("z.re", "z.im").alias("mag"))


def frames_of(cell_rows: DataFrame, keys: tuple[str, ...] = ("track", "ch")) -> DataFrame:
    """Frames from cells (keys, t, b, re, im)."""
    packed = cell_rows.groupBy(*keys, "t").agg(F.sort_array(F.collect_list(F.struct("b", "re", "im"))).alias("z"))
    return packed.select(*keys, "t", F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def overlap_add(frames: DataFrame, n_fft: int, hop: int, keys: tuple[str, ...] = ("track", "ch"), block: int = 1024) -> DataFrame:
    """(keys, i, x) from frames (keys, t, re, im): inverse transform, window, add, divide by the summed squared window where it exceeds 1e-8.

    One exchange, of frames: a block is ``block * hop`` samples with all frames that reach into it, so a signal of any length is
    added up side by side.
    """
    span = block * hop
    first = F.floor(F.col("t") * hop / span).cast("bigint")
    last = F.floor((F.col("t") * hop + (n_fft - 1)) / span).cast("bigint")
    cut = frames.select(*keys, "t", "re", "im", F.explode(F.sequence(first, last)).alias("block"))
    blocks = cut.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("t", "re", "im"))).alias("frames"))
    kinds = dict(frames.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    nk = len(keys)

    def run(batches):
        win = window_values(n_fft)
        for batch in batches:
            for r in range(batch.num_rows):
                got = batch.column(nk + 1)[r].values
                t = got.field(0).to_numpy()
                re, im = (got.field(f).flatten().to_numpy().reshape(len(t), -1) for f in (1, 2))
                y = np.fft.irfft(re + 1j * im, n_fft, axis=1) * win
                lo = batch.column(nk)[r].as_py() * span
                out, norm = np.zeros(span + 2 * n_fft), np.zeros(span + 2 * n_fft)
                for at, row in zip(t * hop - lo + n_fft, y):
                    out[at : at + n_fft] += row
                    norm[at : at + n_fft] += win * win
                end = min(span, int(t[-1]) * hop + n_fft - lo)
                out, norm = out[n_fft : n_fft + end], norm[n_fft : n_fft + end]
                yield pa.RecordBatch.from_arrays([*[pa.array([batch.column(c)[r].as_py()], batch.schema.field(c).type) for c in range(nk)], pa.array([lo]), lists(np.where(norm > 1e-8, out / np.where(norm > 1e-8, norm, 1.0), out)[None, :])], names=[*keys, "lo", "x"])

    made = blocks.mapInArrow(run, f"{head}, lo bigint, x array<double>")
    return made.select(*keys, "lo", F.posexplode("x").alias("k", "x")).select(*keys, (F.col("lo") + F.col("k")).alias("i"), "x")


def reconstruct(frames: DataFrame, masks: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(track, part, ch, i, x): each part's mask (track, part, t, mask array) laid on the frames, and inverted."""
    joined = frames.join(masks, ["track", "t"])
    scaled = [F.zip_with(c, "mask", lambda a, m: a * m).alias(c) for c in ("re", "im")]
    return overlap_add(joined.select("track", "part", "ch", "t", *scaled), n_fft, hop, ("track", "part", "ch"))


def running_median(value: str, order: str, half: int, by: list[str]) -> Column:
    """Exact median over the rows at most ``half`` before and after; windows are cut short at the ends."""
    return F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half))


def medians(x: np.ndarray, half: int) -> np.ndarray:
    """Median of each row of x with the ``half`` rows before and after it, as far as there are any."""
    n = len(x)
    out = np.empty_like(x)
    if n > 2 * half:
        out[half : n - half] = np.partition(np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1, axis=0), half, axis=-1)[..., half]
    for i in (*range(min(half, n)), *range(max(half, n - half), n)):
        out[i] = np.median(x[max(0, i - half) : i + half + 1], axis=0)
    return out


def hpss_frames(frames: DataFrame, win_t: int = 17, win_f: int = 17, power: float = 2.0, by: tuple[str, ...] = ("track",), block: int = 256) -> DataFrame:
    """(by, t, mag, harmonic, percussive arrays) from frames (by, t, mag array), t without gaps; see ``hpss_masks``.

    One exchange, of frames: a block is ``block`` frames and half a window on either side, so no task holds more of a signal.
    """
    half, nk = win_t // 2, len(by)
    first = F.greatest(F.lit(0), F.floor((F.col("t") - half) / block)).cast("bigint")
    cut = frames.select(*by, "t", "mag", F.explode(F.sequence(first, F.floor((F.col("t") + half) / block).cast("bigint"))).alias("block"))
    blocks = cut.groupBy(*by, "block").agg(F.sort_array(F.collect_list(F.struct("t", "mag"))).alias("frames"))
    kinds = dict(frames.dtypes)

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                got = batch.column(nk + 1)[r].values
                t = got.field(0).to_numpy()
                mag = got.field(1).flatten().to_numpy().reshape(len(t), -1)
                own = t // block == batch.column(nk)[r].as_py()
                if not own.any():
                    continue
                h, p = medians(mag, half)[own] ** power, medians(mag[own].T, win_f // 2).T ** power
                den = h + p + 1e-12
                keys = [pa.array([batch.column(c)[r].as_py()] * int(own.sum()), batch.schema.field(c).type) for c in range(nk)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(t[own]), *(lists(np.ascontiguousarray(m)) for m in (mag[own], h / den, p / den))], names=[*by, "t", "mag", "harmonic", "percussive"])

    return blocks.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in by) + ", t bigint, mag array<double>, harmonic array<double>, percussive array<double>")


def hpss_masks(cell_rows: DataFrame, win_t: int = 17, win_f: int = 17, power: float = 2.0, by: tuple[str, ...] = ("track",)) -> DataFrame:
    """(by, t, b, mag, harmonic, percussive): cells (by, t, b, mag), every bin of every frame, with soft masks from medians along time and along frequency.

    Both are 0 where both medians are.
    """
    packed = cell_rows.groupBy(*by, F.col("t").cast("bigint").alias("t")).agg(F.transform(F.sort_array(F.collect_list(F.struct("b", F.col("mag").cast("double").alias("mag")))), lambda z: z["mag"]).alias("mag"))
    made = hpss_frames(packed, win_t, win_f, power, by)
    return made.select(*by, "t", F.posexplode(F.arrays_zip("mag", "harmonic", "percussive")).alias("b", "z")).select(*by, "t", "b", "z.mag", "z.harmonic", "z.percussive")


def stream_ranks(masked: DataFrame, percussive: int | None = None, harmonic: int | None = None, presence: float = 0.04, most: int = 2) -> DataFrame:
    """(track, percussive_share, harmonic_share, k_percussive, k_harmonic): how many components each stream gets; of cells, or of frames with arrays.

    A share is of the summed magnitude, 0 for silence. A count fixes the rank; None leaves it to the share: none below ``presence``,
    else ``most``. If both are left to it and come to none, the larger share gets one, on a tie the percussive.
    """
    if dict(masked.dtypes)["mag"].startswith("array"):
        fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        size, part = fold("mag"), lambda c: fold(F.zip_with("mag", c, lambda m, w: m * w))
    else:
        size, part = F.col("mag"), lambda c: F.col("mag") * F.col(c)
    total = F.sum(size)
    share = lambda c: F.when(total > 0, F.sum(part(c)) / total).otherwise(0.0)
    shares = masked.groupBy("track").agg(share("percussive").alias("percussive_share"), share("harmonic").alias("harmonic_share"))
    rank = lambda given, c: F.lit(max(0, given)) if given is not None else F.when(F.col(c) < presence, 0).otherwise(most)
    ranked = shares.withColumn("kp", rank(percussive, "percussive_share")).withColumn("kh", rank(harmonic, "harmonic_share"))
    none = (F.col("kp") == 0) & (F.col("kh") == 0) & F.lit(percussive is None and harmonic is None)
    louder = F.col("percussive_share") >= F.col("harmonic_share")
    return ranked.select("track", "percussive_share", "harmonic_share", F.when(none & louder, 1).otherwise(F.col("kp")).alias("k_percussive"), F.when(none & ~louder, 1).otherwise(F.col("kh")).alias("k_harmonic"))
