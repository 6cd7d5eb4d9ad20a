"""Matching the components of two tracks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spectral import cells, stft

#: Rows of a block of one side's list, about, and how many of the other side's rows are multiplied with a block at a time.
BLOCK, STRIP = 512, 128
#: Rows of a batch that goes back to Spark, at least, but for the last.
BATCH = 50_000
#: Best partners that a part lists at first in ``best_pairs``; lists grow up to this many edges in all.
LISTED, EDGES = 64, 4_000_000
#: Place in a list below, the rounded and negated similarity above.
PLACE, NEVER = 22, 1 << 40


def bands(spark: SparkSession, bins: int, n_fft: int, rate: float, n: int = 24, low: float = 40.0) -> DataFrame:
    """(b, band): the log-spaced band of each bin from ``low`` to half the rate."""
    hz = rate / n_fft
    pos = (F.ln(F.col("id") * F.lit(hz)) - F.lit(math.log(low))) / F.lit(math.log(rate / 2) - math.log(low))
    band = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(pos * n).cast("int")))
    return spark.range(1, bins).where(F.col("id") * F.lit(hz) >= low).select(F.col("id").cast("int").alias("b"), band.alias("band"))


def descriptor(cell_rows: DataFrame, band_rows: DataFrame, n: int = 24) -> DataFrame:
    """(track, band, x): log1p mean magnitude by band, of unit length; zeros stay. The band table has at most a row a bin."""
    means = cell_rows.join(F.broadcast(band_rows), "b").groupBy("track", "band").agg(F.log1p(F.avg("mag")).alias("v"))
    dense = cell_rows.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band")).join(means, ["track", "band"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("track")))
    return dense.select("track", "band", F.when(norm > 1e-12, F.col("v") / norm).otherwise(F.col("v")).alias("x"))


def percussive_descriptor(signal: DataFrame, rate: float, n_fft: int = 1024, hop: int = 512, seconds: float = 4.0, n: int = 24, low: float = 40.0) -> DataFrame:
    """(track, band, x) of each track's first seconds; zeros for one shorter than a frame."""
    clip = signal.where((F.col("ch") == 0) & (F.col("i") < math.floor(seconds * rate)))
    got = descriptor(cells(stft(clip, n_fft, hop)), bands(signal.sparkSession, n_fft // 2 + 1, n_fft, rate, n, low), n)
    all_ = signal.select("track").distinct().select("track", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("band"))
    return all_.join(got, ["track", "band"], "left").select("track", "band", F.coalesce("x", F.lit(0.0)).alias("x"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays over their common length; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.filter(F.zip_with(x, y, lambda p, q: p * q), lambda v: v.isNotNull()), F.lit(0.0), lambda s, v: s + v)
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den > 1e-12, dot(a, b) / den).otherwise(0.0)


class Vectors:
    """Arrays of any lengths with or without nulls, for ``cosines``: (place, array) filled up with zeros."""

    def __init__(self, x: np.ndarray, lens: np.ndarray, void: np.ndarray | None):
        self.x, self.lens, self.void = x, lens, void

    @staticmethod
    def of(column: pa.ChunkedArray) -> Vectors:
        v = column.combine_chunks()
        v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
        flat, ends = v.flatten(), np.cumsum(v.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        lens = np.diff(ends, prepend=0)
        most = int(lens.max(initial=0))
        null, values = flat.is_null().to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False)
        if (lens == most).all():
            x, void = values.reshape(-1, most).T.copy(), null.reshape(-1, most).T.copy()
        else:
            x, void = np.zeros((most, len(lens))), np.ones((most, len(lens)), bool)
            row = np.repeat(np.arange(len(lens)), lens)
            place = np.arange(len(flat)) - np.repeat(ends - lens, lens)
            x[place, row], void[place, row] = values, null
        x[void] = 0.0
        return Vectors(x, lens, void if void.any() else None)

    def __len__(self) -> int:
        return len(self.lens)

    def __getitem__(self, rows) -> Vectors:
        return Vectors(self.x[:, rows], self.lens[rows], None if self.void is None else self.void[:, rows])

    def norms(self) -> np.ndarray:
        """(length, array): the norm of the first ``length`` values."""
        return np.sqrt(np.concatenate([np.zeros((1, len(self))), np.cumsum(self.x * self.x, axis=0)]))


def cosines(a: Vectors, b: Vectors) -> np.ndarray:
    """``cosine`` of all of a with all of b, bit for bit: sums run from the first value to the last."""
    dot, part = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    with np.errstate(all="ignore"):
        for k in range(min(len(a.x), len(b.x))):
            np.multiply(a.x[k][:, None], b.x[k], out=part)
            if a.void is not None:
                part[a.void[k]] = 0.0
            if b.void is not None:
                part[:, b.void[k]] = 0.0
            dot += part
        na, nb = a.norms(), b.norms()
        if len({*a.lens, *b.lens}) == 1:
            np.multiply(na[-1][:, None], nb[-1], out=part)
        else:
            n = np.minimum.outer(a.lens, b.lens)
            np.multiply(na[n, np.arange(len(a))[:, None]], nb[n, np.arange(len(b))], out=part)
        none = part <= 1e-12
        dot /= part
    dot[none] = 0.0
    return dot


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A table for each group of rows, of which the first has ``n`` = 1."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        firsts = np.flatnonzero(batch.column("n").to_numpy(zero_copy_only=False) == 1)
        edges = np.unique(np.concatenate([[0], firsts, [batch.num_rows]])).tolist()
        for lo, hi in zip(edges, edges[1:], strict=False):
            if held and batch.column("n")[lo].as_py() == 1:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, small batches put together."""
    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= BATCH:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _listed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, tonal, right, idx, v) of both sides' parts that can have a pair."""
    tonal = (F.col("kind") != "percussive").alias("tonal")
    side = lambda s, right: s.select("pair", tonal, F.lit(right).alias("right"), "idx", F.col("v").cast("array<double>").alias("v"))
    return side(a, False).unionByName(side(b, True)).where("pair is not null and tonal is not null and v is not null")


def _sides(rows: pa.Table) -> tuple[pa.Table, pa.Table]:
    right = rows["right"].to_numpy()
    return rows.filter(pa.array(~right)), rows.filter(pa.array(right))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for rows in grouped(batches):
            a, b = _sides(rows)
            va, vb, nb = Vectors.of(a["v"]), Vectors.of(b["v"]), len(b)
            pair, tonal, ia, ib = (t[c].combine_chunks() for t, c in ((a, "pair"), (a, "tonal"), (a, "idx"), (b, "idx")))
            for lo in range(0, len(a) if nb else 0, STRIP):
                hi = min(len(a), lo + STRIP)
                at, to = np.repeat(np.arange(lo, hi), nb), np.tile(np.arange(nb), hi - lo)
                yield pa.RecordBatch.from_arrays([pair.take(at), tonal.take(at), ia.take(at), ib.take(to), pa.array(cosines(va[lo:hi], vb).ravel())], ["pair", "tonal", "a", "b", "similarity"])

    return gathered(made())


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, a, b, similarity, basis): every pair of components of one side's and the other's list that are both tonal or both not.

    Sides: (pair, idx, kind, v array); v is the chroma of a tonal part, the band descriptor of a percussive one; a part without v
    has no pairs. Both lists of a (pair, tonal) are cut into blocks by a hash; each row goes to all blocks of the other side in one exchange,
    and a kernel multiplies block by block.
    """
    spark = a.sparkSession
    rows, key = _listed(a, b), ["pair", "tonal"]
    blocks = lambda right: F.ceil(F.sum((F.col("right") == right).cast("int")) / BLOCK).cast("int")
    sizes = rows.groupBy(*key).agg(blocks(False).alias("na"), blocks(True).alias("nb")).where("na > 0 and nb > 0")
    own = F.pmod(F.xxhash64("idx", "v"), F.when(F.col("right"), F.col("nb")).otherwise(F.col("na"))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.when(F.col("right"), F.col("na")).otherwise(F.col("nb")) - 1))
    dealt = rows.join(sizes, key).select(*key, "right", "idx", "v", own.alias("own"), every.alias("other"))
    group = [*key, "i", "j"]
    met = dealt.select(*key, "right", "idx", "v", F.when(F.col("right"), F.col("other")).otherwise(F.col("own")).alias("i"), F.when(F.col("right"), F.col("own")).otherwise(F.col("other")).alias("j"))
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *group).withColumn("n", F.row_number().over(Window.partitionBy(*group).orderBy("right")))
    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in rows.schema)}
    made = met.select("n", *key, "right", "idx", "v").mapInArrow(_products, f"pair {kinds['pair']}, tonal boolean, a {kinds['idx']}, b {kinds['idx']}, similarity double")
    return made.select("pair", F.col("a").cast(a.schema["idx"].dataType), F.col("b").cast(b.schema["idx"].dataType), "similarity", F.when(F.col("tonal"), "tonal").otherwise("percussive").alias("basis"))


def _best(a: Vectors, b: Vectors, k: int) -> np.ndarray:
    """(row of a, k): the best k of b for each of a in order, as numbers of similarity and place that sort in order of choice."""
    found = np.empty((len(a), min(k, len(b))), np.int64)
    for lo in range(0, len(a), STRIP):
        best = np.empty((min(STRIP, len(a) - lo), 0), np.int64)
        for at in range(0, len(b), 2 * BLOCK):
            s = cosines(a[lo : lo + STRIP], b[at : at + 2 * BLOCK])
            rounded = np.copysign(np.floor(np.abs(s) * 1e12 + 0.5), -s)
            rounded[np.isnan(s)] = NEVER
            best = np.concatenate([best, (rounded.astype(np.int64) << PLACE) + np.arange(at, at + s.shape[1])], axis=1)
            if best.shape[1] > k:
                best = np.partition(best, k - 1, axis=1)[:, :k]
        found[lo : lo + STRIP] = np.sort(best, axis=1)
    return found


def best_pairs(ia: np.ndarray, ta: np.ndarray, va: Vectors, ib: np.ndarray, tb: np.ndarray, vb: Vectors) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and of b that ``greedy_match`` pairs, in its order, without all candidates at once.

    Each free row of a lists its best free partners. The edges of all lists are taken in order, until a row that is still free has come to the end
    of its list while there may be more: what is left lists anew, twice as many. Until then no list lacks an edge that would be due.
    """
    if len(ib) >> PLACE:
        raise ValueError(f"a list of more than {1 << PLACE} components")
    (_, ca), (_, cb) = np.unique(ia, return_inverse=True), np.unique(ib, return_inverse=True)
    used_a, used_b = bytearray(len(ca)), bytearray(len(cb))
    order, made_a, made_b, k = np.argsort(ib, kind="stable"), [], [], LISTED
    while True:
        left_a = ~np.frombuffer(used_a, bool)[ca]
        left_b = ~np.frombuffer(used_b, bool)[cb]
        edges = []
        for kind in (False, True):
            a, b = np.flatnonzero(left_a & (ta == kind)), order[left_b[order] & (tb[order] == kind)]
            if len(a) and len(b):
                found = _best(va[a], vb[b], k)
                last = np.zeros(found.shape, bool)
                last[:, -1] = found.shape[1] < len(b)
                edges.append((found.ravel() >> PLACE, np.repeat(a, found.shape[1]), b[found.ravel() & ((1 << PLACE) - 1)], last.ravel()))
        if not edges:
            break
        key, a, b, last = (np.concatenate(x) for x in zip(*edges, strict=True))
        due = np.lexsort((b, ta[a], ib[b], ia[a], key))
        a, b, last, ended = a[due], b[due], last[due], True
        for x, y, cx, cy, end in zip(a.tolist(), b.tolist(), ca[a].tolist(), cb[b].tolist(), last.tolist(), strict=True):
            if used_a[cx]:
                continue
            if not used_b[cy]:
                used_a[cx] = used_b[cy] = 1
                made_a.append(x)
                made_b.append(y)
            elif end:
                ended = False
                break
        if ended:
            break
        k = max(LISTED, min(2 * k, EDGES // max(1, int(left_a.sum()))))
    return np.array(made_a, np.int64), np.array(made_b, np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made():
        for rows in grouped(batches):
            a, b = _sides(rows)
            if not len(a) or not len(b):
                continue
            (ia, ta), (ib, tb) = ((t["idx"].to_numpy(), t["tonal"].to_numpy()) for t in (a, b))
            va, vb = Vectors.of(a["v"]), Vectors.of(b["v"])
            at, to = best_pairs(ia, ta, va, ib, tb, vb)
            alike = [cosines(va[at[k : k + 16]], vb[to[k : k + 16]]).diagonal() for k in range(0, len(at), 16)]
            columns = [a["pair"].combine_chunks().take(pa.array(at)), pa.array(ia[at]), pa.array(ib[to]), pa.array(np.concatenate([*alike, np.empty(0)])), pa.array(ta[at]), pa.array(np.arange(len(at), dtype=np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["pair", "a", "b", "similarity", "tonal", "rank"])

    return gathered(made())


def matched(a: DataFrame, b: DataFrame) -> DataFrame:
    """``greedy_match(candidates(a, b))`` for lists of any length: a task holds the vectors of a pair of tracks, and of the candidates only the best."""
    spark = a.sparkSession
    rows = _listed(a, b).withColumn("idx", F.col("idx").cast("bigint")).where("idx is not null")
    kind = dict(rows.dtypes)["pair"]
    whole = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pair").withColumn("n", F.row_number().over(Window.partitionBy("pair").orderBy("right", "idx")))
    made = whole.mapInArrow(_pairs, f"pair {kind}, a bigint, b bigint, similarity double, tonal boolean, rank int")
    return made.select("pair", "a", "b", "similarity", F.when(F.col("tonal"), "tonal").otherwise("percussive").alias("basis"), "rank")


def greedy_match(cands: DataFrame, min_similarity: float | None = None) -> DataFrame:
    """(pair, a, b, similarity, basis, rank): the best candidate again and again, each index used once; ties by a, then b.

    One fold over each pair of tracks' sorted candidates, inside Catalyst: for lists of candidates that a row can hold. No floor unless one is given.
    """
    rows = cands if min_similarity is None else cands.where(F.col("similarity") >= min_similarity)
    item = F.struct((-F.round("similarity", 12)).alias("s"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "similarity", "basis")
    lists = rows.groupBy("pair").agg(F.sort_array(F.collect_list(item)).alias("c"))
    start = F.slice("c", 1, 0)

    def step(acc, x):
        free = ~F.exists(acc, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    kept = lists.select("pair", F.posexplode(F.aggregate("c", start, step)).alias("rank", "x"))
    return kept.select("pair", "x.a", "x.b", "x.similarity", "x.basis", "rank")


def unpaired(side: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """(pair, idx) of the components of a side that no pair has."""
    return side.select("pair", F.col("idx").cast("bigint").alias("idx")).join(pairs.select("pair", F.col(column).alias("idx")), ["pair", "idx"], "left_anti")


def match_components(a: DataFrame, b: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, unpaired of a, unpaired of b) for sides (pair, idx, kind, v). keep: writes the pairs, so that several results of them match once."""
    pairs = keep(matched(a, b))
    return pairs, unpaired(a, pairs, "a"), unpaired(b, pairs, "b")
