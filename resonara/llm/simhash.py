"""SimHash near-dedup with deletion-variant signatures."""

from __future__ import annotations

import re
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf, packed

WORD = re.compile(r"\w+")
BITS = 128
#: A word weighs as much as it has letters but one, LIGHT to HEAVY; a pair of neighbouring words weighs PAIR.
LIGHT, HEAVY, PAIR = 1, 6, 1
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
#: In a key the number of (segment, bit) is above this bit; segments are at most 32 bits wide.
TAG = 48
#: No side of a join is broadcast, so that none passes through the driver: Spark takes a table of exploded keys for as small as the one before.
EXCHANGED = "merge"


class _Digests(dict):
    """MD5 of words, kept from text to text."""

    def __missing__(self, w: str) -> bytes:
        if len(self) > 300_000:
            self.clear()
        self[w] = got = md5(w.encode()).digest()
        return got


class _Numbers(dict):
    """Numbers of words, in the order in which they are first met."""

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        return n


_digests = _Digests()
#: Words of the texts whose features are held at a time, about; texts are whole.
HELD_WORDS = 100_000


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def text_features(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of text, hash as two 64-bit numbers, weight) of the distinct words and distinct pairs of neighbours of texts of any length, given as words.

    Longer words are rarer ones and weigh more, so that a language's common words don't make its texts alike. A pair's hash is its first word's, each
    half turned by a bit, against its second word's.
    """
    numbers = _Numbers()
    word = np.concatenate([np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts])
    owner = np.repeat(np.arange(len(texts)), list(map(len, texts)))
    h = np.frombuffer(b"".join(map(_digests.__getitem__, numbers)), ">u8").astype(np.uint64).reshape(-1, 2)
    weight = np.clip(np.fromiter(map(len, numbers), np.int64, len(numbers)) - 1, LIGHT, HEAVY)
    some = len(numbers) + 1
    alone = _distinct(owner * some + word)
    inside = owner[1:] == owner[:-1]
    pair = _distinct((owner[:-1] * some + word[:-1])[inside] * some + word[1:][inside])
    first, second = h[pair // some % some], h[pair % some]
    hashes = np.concatenate([h[alone % some], ((first << np.uint64(1)) | (first >> np.uint64(63))) ^ second])
    return np.concatenate([alone // some, pair // some // some]), hashes, np.concatenate([weight[alone % some], np.full(len(pair), PAIR)])


def signatures(texts: list[str | None]) -> list[tuple[int, int] | None]:
    """128-bit SimHash of each text as two signed 64-bit numbers; None for a text without a word. A bit is set if features of more than half the weight have it."""
    out: list[tuple[int, int] | None] = [None] * len(texts)
    held: list[list[str]] = []
    where: list[int] = []
    size = 0

    def work() -> None:
        owner, hashes, weight = text_features(held)
        ones = np.empty((len(held), BITS), np.int64)
        for j in range(BITS // 8):  # the weight of each value of a byte, then of each bit of it
            byte = (hashes[:, j // 8] >> np.uint64(56 - 8 * (j % 8))).astype(np.int64) & 255
            values = np.bincount(owner * 256 + byte, weight, len(held) * 256).reshape(-1, 256)
            ones[:, 8 * j : 8 * j + 8] = np.rint(values @ BYTE_BITS)
        sums = np.bincount(owner, weight, len(held))
        for i, (a, b) in zip(where, np.packbits(2 * ones > sums[:, None], axis=1).view(">i8").tolist()):
            out[i] = (a, b)

    for i, t in enumerate(texts):
        words = WORD.findall(t.lower()) if t else []
        if words:
            held.append(words)
            where.append(i)
            size += len(words)
        if held and (size >= HELD_WORDS or i == len(texts) - 1):
            work()
            held, where, size = [], [], 0
    return out


def _signature_batches(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sigs = signatures(texts)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array([None if s is None else s[k] for s in sigs], pa.int64()) for k in (0, 1)]], names=["id", "s0", "s1"])


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment; none crosses from one 64-bit half to the other."""
    out = []
    for half in (0, 1):
        n = segments // 2
        cuts = [round(64 * k / n) for k in range(n + 1)]
        out += [(64 * half + a, b - a) for a, b in zip(cuts, cuts[1:])]
    return out


def _segment(first: int, width: int, s0: Column, s1: Column) -> Column:
    """Bits first .. first+width of the signature, the first one highest."""
    word = s0 if first < 64 else s1
    return F.shiftrightunsigned(word, 64 - first % 64 - width).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def near_pairs(sigs: DataFrame, segments: int = 6, radius: int = 22) -> DataFrame:
    """Pairs (a0, a1, b0, b1, distance) of distinct signatures within ``radius`` bits that share a segment up to one bit.

    Every pair within 2 * segments - 1 bits shares one (were all segments to differ by two, there would be more).
    Each signature is indexed under each segment with each one of its bits struck out. Of the keys that a pair
    shares only the first counts, which is told from the two signatures, so no distinct is needed.
    """
    bounds = segment_bounds(segments)
    widest = max(w for _, w in bounds)
    keys = []
    for n, (first, width) in enumerate(bounds):
        seg = _segment(first, width, F.col("s0"), F.col("s1"))
        for bit in range(width):
            high = F.shiftrightunsigned(seg, bit + 1)
            low = seg.bitwiseAND(F.lit((1 << bit) - 1))
            rest = F.shiftleft(high, bit).bitwiseOR(low)
            keys.append(rest + F.lit((n * widest + bit) << TAG))
    indexed = sigs.select("s0", "s1", F.explode(F.array(*keys)).alias("key"))
    a = indexed.select(F.col("key"), F.col("s0").alias("a0"), F.col("s1").alias("a1"))
    b = indexed.select(F.col("key"), F.col("s0").alias("b0"), F.col("s1").alias("b1"))
    less = (F.col("a0") < F.col("b0")) | ((F.col("a0") == F.col("b0")) & (F.col("a1") < F.col("b1")))
    x0, x1 = F.col("a0").bitwiseXOR(F.col("b0")), F.col("a1").bitwiseXOR(F.col("b1"))
    distance = F.bit_count(x0) + F.bit_count(x1)
    first_shared = F.lit(None).cast("bigint")
    for n, (first, width) in reversed(list(enumerate(bounds))):
        diff = _segment(first, width, x0, x1)
        bit = F.when(diff == 0, 0)
        for k in range(width):
            bit = bit.when(diff == 1 << k, k)
        tag = F.lit(n * widest) + bit
        first_shared = F.when(F.bit_count(diff) <= 1, tag.cast("bigint")).otherwise(first_shared)
    return a.join(b.hint(EXCHANGED), "key").where(less & (distance <= radius)).where(F.shiftrightunsigned("key", TAG) == first_shared).select("a0", "a1", "b0", "b1", distance.alias("distance"))


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the least node connected with it.

    Large-star and small-star steps in turn, each written to the shared folder, until nothing changes: a number of rounds
    about logarithmic in the longest path.
    """
    state = shelf.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint(EXCHANGED), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint(EXCHANGED), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = shelf.put(small)
        sums = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        shelf.drop(state)
        state = after
        if sums == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sums


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segments: int = 6, radius: int = 22) -> DataFrame:
    """(doc_id, group_id) of every document that has a near copy; group_id is the group's smallest doc_id.

    128-bit SimHash, by MD5, over distinct words, weighted by length, and distinct pairs of neighbours. Equal signatures are one node, so exact copies cost nothing; nodes within
    ``radius`` bits that differ by at most one bit in one of ``segments`` segments are joined by equality and verified
    (certain up to 2 * segments - 1 bits, likely beyond), and a group is a connected component. More documents than
    about 2 ** 27 ask for wider, that is fewer, segments: a key then keeps few unrelated signatures.

    A bit that features of just half the weight have is 0. Defined cases: documents without a word (null, empty, only punctuation) and those with a null identifier are in no
    group; rows that repeat an identifier count once for each signature and an identifier gets its least group; no rows - no rows.
    """
    if segments % 2 or not 4 <= segments <= 8:
        raise ValueError("segments must be 4, 6 or 8")
    shelf = Shelf(docs.sparkSession, "simhash")
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    kind = dict(read.dtypes)["id"]
    owned = shelf.put(read.mapInArrow(_signature_batches, f"id {kind}, s0 bigint, s1 bigint").where("s0 is not null"))
    nodes = shelf.put(owned.groupBy("s0", "s1").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    pairs = shelf.put(near_pairs(nodes.select("s0", "s1"), segments, radius))
    # a node goes by its least identifier
    a = pairs.join(nodes.select(F.col("s0").alias("a0"), F.col("s1").alias("a1"), F.col("least").alias("u")).hint(EXCHANGED), ["a0", "a1"])
    edges = a.join(nodes.select(F.col("s0").alias("b0"), F.col("s1").alias("b1"), F.col("least").alias("v")).hint(EXCHANGED), ["b0", "b1"]).select("u", "v")
    roots = components(edges, shelf)
    return _members(owned, nodes, roots, shelf)


def _members(owned: DataFrame, nodes: DataFrame, roots: DataFrame, shelf: Shelf) -> DataFrame:
    rooted = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    small = nodes.join(rooted.hint(EXCHANGED), nodes["least"] == rooted["node"], "left").where("root is not null or n > 1").select("s0", "s1", F.coalesce("root", "least").alias("group_id"))
    return owned.join(small.hint(EXCHANGED), ["s0", "s1"]).groupBy(F.col("id").alias("doc_id")).agg(F.min("group_id").alias("group_id"))


def near_duplicates(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, keep_id): each document that is to go, and the document of its group that stays, the one with the smallest identifier."""
    return near_groups(docs, **params).where("doc_id <> group_id").select("doc_id", F.col("group_id").alias("keep_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """docs without those that ``near_duplicates`` names. Of rows that repeat an identifier none goes for the others' sake."""
    gone = Shelf(docs.sparkSession, "near").put(near_duplicates(docs, id_col=id_col, **params).select(F.col("doc_id").alias("gone")))
    rows = packed(docs, F.col(f"`{id_col}`").alias("own"))
    return rows.join(gone, rows["own"] == gone["gone"], "left_anti").select("r.*")
