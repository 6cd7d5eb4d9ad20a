"""Language-model scoring with a weighted backoff automaton over words."""

from __future__ import annotations

import functools
import math
import re
import sys

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a run of letters, digits and underscores; any other character but these blanks is a word of its own.
TOKEN = re.compile(r"\w+|[^\w \t\n\r\f\v]")
ORDER = 3
#: Characters of a block of documents, about; a longer document is a block of its own.
BLOCK_CHARS = 4_000_000
#: Characters of the corpus that one task merges the sequences of, about.
BUCKET_CHARS = 4_000_000
#: A hash has so many bits more than the number of the corpus's characters has, 64 at most: the chance that a sequence meets a wrong one is the same at every size.
SPARE_BITS = 24
#: Words that one run reads.
RUN = 1024
BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A99)


def mix(a: np.ndarray | np.uint64, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, by planes: of small numbers the upper ones are empty."""
    return zstandard.compress(np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.uint64)


@functools.cache
def kinds() -> np.ndarray:
    """Of each character what ``TOKEN`` takes it for: 0 a blank, 1 part of a word, 2 a word of its own."""
    out = np.full(sys.maxunicode + 1, 2, np.uint8)
    for m in re.finditer(r"\w+", np.arange(len(out), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")):
        out[m.start() : m.end()] = 1
    out[list(map(ord, " \t\n\r\f\v"))] = 0
    return out


def numbered_words(texts: list[str]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """What ``TOKEN`` finds in the texts, one after the other, as places in a list of bytes whose first is the end sign's; that list, which may hold blanks too; the number of words of each text."""
    whole = "".join(texts)
    data = whole.encode()
    kind = kinds()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    cuts = np.ones(len(kind) + 1, bool)
    cuts[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cuts[begins] = True
    at = np.flatnonzero(cuts)
    byte_cuts = np.ones(len(data) + 1, bool)
    byte_cuts[:-1] = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    byte_cuts[byte_cuts] = cuts
    offsets = np.flatnonzero(byte_cuts)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    _, ends, held = pieces.dictionary.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(pieces.dictionary) + 1].tolist() if len(pieces) else [0]
    held = held.to_pybytes() if held else b""
    kept = kind[at[:-1]] > 0
    before = np.concatenate([[0], np.cumsum(kept)])[np.searchsorted(at, begins)]
    return pieces.indices.to_numpy()[kept] + 1, [b"", *(held[a:b] for a, b in zip(ends, ends[1:]))], np.diff(before)


class Block:
    """The documents of a block, each as its words and an end sign.

    size: bytes of each sign; grams: for each sign the sequences of 1 .. ORDER signs up to it, as hashes. The empty sequence has the hash 0.
    """

    def __init__(self, texts: list[str]):
        index, raw, lens = numbered_words(texts)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        sizes = np.fromiter(map(len, raw), np.int32, len(raw))
        self.lens = lens + 1
        ends = np.cumsum(self.lens) - 1
        self.starts = ends + 1 - self.lens
        flat = np.zeros(int(self.lens.sum()), np.int32)
        inner = np.ones(len(flat), bool)
        inner[ends] = False
        flat[inner] = index
        word, self.size = hashes[flat], sizes[flat]
        word[ends] = END
        before = np.concatenate([[BEGIN], word[:-1]]).astype(np.uint64)
        before[self.starts] = BEGIN
        earlier = np.concatenate([[BEGIN], before[:-1]]).astype(np.uint64)
        earlier[self.starts] = BEGIN
        pair = mix(before, word)
        self.grams = np.stack([mix(np.uint64(1), word), mix(np.uint64(2), pair), mix(mix(np.uint64(3), earlier), pair)])


def decoded(blob: bytes) -> list[str]:
    return [t.decode() for t in zstandard.decompress(blob).split(b"\xff")]  # a byte that UTF-8 never has


def cut(batches):
    """Rows (id, text) gathered to blocks (block, ids, blob, n_bytes). A block's key is its place and a hash of its texts."""
    ids, texts, size, context = [], [], 0, TaskContext.get()
    part, n = context.partitionId() if context else 0, 0

    def block():
        raw = [t.encode() for t in texts]
        whole = b"\xff".join(raw)
        key = xxhash.xxh3_64_intdigest(b"%d %d " % (part, n) + whole) >> 1
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), one(pa.concat_arrays(ids)), pa.array([zstandard.compress(whole, 3)], pa.binary()), one(pa.array(list(map(len, raw)), pa.int64()))], names=["block", "ids", "blob", "n_bytes"])

    for batch in batches:
        begin = 0
        for i, t in enumerate(batch.column(1).to_pylist()):
            texts.append(t or "")
            size += len(texts[-1]) + 1
            if size >= BLOCK_CHARS:
                ids.append(batch.column(0).slice(begin, i + 1 - begin))
                yield block()
                ids, texts, size, begin, n = [], [], 0, i + 1, n + 1
        if begin < batch.num_rows:
            ids.append(batch.column(0).slice(begin))
    if texts:
        yield block()


def blocks_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(cut, f"block bigint, ids array<{kind}>, blob binary, n_bytes array<bigint>")


def ordered(x: np.ndarray, bits: int) -> np.ndarray:
    """Places of numbers of ``bits`` bits by value, equal ones by place. The upper bits are sorted with the place below them, far faster than places by value; what differs below is put right."""
    k = len(x).bit_length()
    key = x << np.uint64(64 - bits)
    key >>= np.uint64(k)
    key <<= np.uint64(k)
    key |= np.arange(len(x), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << k) - 1)).view(np.int64)
    if bits > 64 - k:
        key >>= np.uint64(k)
        same, got = key[1:] == key[:-1], x[order]
        other = same & (got[1:] != got[:-1])
        if other.any():
            run = np.cumsum(np.concatenate([[False], ~same]), dtype=np.int32)
            mixed = np.zeros(len(x), bool)
            mixed[run[1:][other]] = True
            at = np.flatnonzero(mixed[run])
            order[at] = order[at][np.lexsort((order[at], got[at]))]
    return order


def listed(block: Block, bits: int, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``bits`` bits of all sequences of a block, the empty one first, their counts, and each place's three numbers in this list; with own how often each of these occurs in its own document, else zeros. The block's grams are used up."""
    shape, x, block.grams = block.grams.shape, block.grams.ravel(), None
    x >>= np.uint64(64 - bits)
    order = ordered(x, bits)
    x = x[order]
    new = np.concatenate([[True], x[1:] != x[:-1]])
    first = np.flatnonzero(new)
    codes, n = np.concatenate([[np.uint64(0)], x[first]]), np.concatenate([[int(block.lens.sum())], np.diff(first, append=len(x))])
    del x, first
    inverse = np.empty(len(order), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32)
    if not own:
        return codes, n, inverse.reshape(shape), np.zeros((ORDER, 1), np.int32)
    docs = np.arange(len(block.lens), dtype=np.int32)
    owner = np.concatenate([np.repeat(docs + k * len(docs), block.lens) for k in range(ORDER)])[order]  # of equal hashes a document's are neighbours
    new[1:] |= owner[1:] != owner[:-1]
    times = np.diff(np.flatnonzero(new), append=len(order)).astype(np.int32)
    there = np.empty(len(order), np.int32)
    there[order] = np.repeat(times, times)
    return codes, n, inverse.reshape(shape), there.reshape(shape)


def bucket_of(codes: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    return (((codes << np.uint64(64 - bits)) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def spans(bucket: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def sent_grams(bits: int, buckets: int, counts: bool):
    """A function from blocks to rows (bucket, block, codes, times), one for each bucket that a block has sequences of. Blocks that don't count ask only."""

    def run(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = Block(decoded(blob))
                codes, n = np.unique(made.grams.ravel() >> np.uint64(64 - bits), return_counts=True)
                codes, n = np.concatenate([[np.uint64(0)], codes]), np.concatenate([[int(made.lens.sum())], n])
                bucket = bucket_of(codes, bits, buckets)
                parts = spans(bucket)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[a]) for a, _ in parts], pa.int64()),
                        pa.array([block] * len(parts), pa.int64()),
                        pa.array([squeeze(np.diff(codes[a:b], prepend=np.uint64(0))) for a, b in parts], pa.binary()),
                        pa.array([squeeze(n[a:b] * counts) for a, b in parts], pa.binary()),
                    ],
                    names=["bucket", "block", "codes", "times"],
                )

    return run


def answered(table: pa.Table) -> pa.Table:
    """Of one bucket, for each block the places in its list of those sequences that others have too, and their counts over all."""
    block, codes, times, asks = (table.column(c).to_pylist() for c in ("block", "codes", "times", "asks"))
    lists = [np.cumsum(unsqueeze(c), dtype=np.uint64) for c in codes]
    n = np.concatenate([unsqueeze(t) for t in times]).astype(np.int64)
    lens = np.array(list(map(len, lists)))
    begin = np.concatenate([[0], np.cumsum(lens)])
    code = np.concatenate(lists)
    order = np.argsort(code)
    first = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    sums = np.add.reduceat(n[order], np.flatnonzero(first))
    total = np.empty(len(code), np.int64)
    total[order] = sums[np.cumsum(first) - 1]
    rows = []
    for k, asking in enumerate(asks):
        a, b = begin[k], begin[k + 1]
        at = np.flatnonzero((total[a:b] > n[a:b]) | (code[a:b] == 0))  # each block is told about the empty sequence
        if asking and len(at):
            rows.append((block[k], squeeze(np.diff(at, prepend=0)), squeeze(total[a:b][at])))
    bucket = table.column("bucket")[0].as_py()
    return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "at": pa.array([r[1] for r in rows], pa.binary()), "total": pa.array([r[2] for r in rows], pa.binary())})


class Automaton:
    """The part of the model that a block's documents can reach, with each document's own counts left out.

    States are contexts of 0 .. ORDER - 1 signs that others have; an arc reads a sign that others have after the context, carries its smoothed log probability, and
    leads to the longest state that ends the signs read. A failure arc carries the log weight of backing off and leads to the context without its
    first sign; below the empty context a sign is spelt, its bytes and a stop all alike likely. At a place of a text the contexts are known, so arc and
    failure weights lie by (length of the context, place), and a state is the length of its context.
    """

    def __init__(self, block: Block, counts: list[np.ndarray], others: int, rest: np.ndarray, mu: float):
        """counts: by length, how often others have the sequences up to each place; others: the number of other documents; rest: the number of their signs, by document."""
        self.block, self.has = block, np.stack([c > 0 for c in counts])
        p = np.ldexp(1.0, np.maximum(-8 * (block.size + 1), -1100))
        n = np.repeat(rest, block.lens).astype(np.float64)
        self.arc, self.fail = np.empty(self.has.shape), np.empty(self.has.shape)
        with np.errstate(divide="ignore"):
            for k, c in enumerate(counts):
                p = (c + mu * p) / (n + mu)
                np.log(p, out=self.arc[k])
                np.log(mu / (n + mu), out=self.fail[k])
                n[1:] = c[:-1]
                n[block.starts] = others
        self.spell = -(block.size + 1) * math.log(256.0)
        self.start = ORDER - 1 if others > 0 else 0

    def score(self) -> np.ndarray:
        """Log probability of each document, read once from left to right; long ones in several runs side by side, as the state before a place follows from what was found there."""
        lens, starts = self.block.lens, self.block.starts
        runs = -(-lens // RUN)
        owner = np.repeat(np.arange(len(lens)), runs)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        pos, size = starts[owner] + nth * RUN, np.minimum(RUN, lens[owner] - nth * RUN)
        order = np.argsort(-size, kind="stable")
        pos, size, owner, nth = pos[order], size[order], owner[order], nth[order]
        state, acc = np.full(len(pos), self.start), np.zeros(len(pos))
        later = np.flatnonzero(nth)
        state[later] = np.minimum(self.has[:, pos[later] - 1].sum(axis=0), ORDER - 1)
        for t in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))
            state = self.step(state[:n], pos[:n] + t, acc)
        return np.bincount(owner, acc, len(lens))

    def step(self, state: np.ndarray, place: np.ndarray, acc: np.ndarray) -> np.ndarray:
        """The states after the signs at ``place``; arcs' and failure arcs' weights are added to acc."""
        out, at = np.zeros(len(state), np.int64), np.arange(len(state))
        while len(at):
            here = place[at]
            hit = self.has[state, here]
            acc[at] += np.where(hit, self.arc[state, here], self.fail[state, here])
            out[at[hit]] = np.minimum(state[hit] + 1, ORDER - 1)
            at, state = at[~hit], state[~hit] - 1
            lost = state < 0
            acc[at[lost]] += self.spell[place[at[lost]]]
            at, state = at[~lost], state[~lost]
        return out


def lm_score(docs: DataFrame, corpus: DataFrame | None = None, mu: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, log_prob, bits_per_byte) of every document under a model of all documents of corpus, or else of all other rows of docs.

    Sequences of up to three words, two begin signs before and an end sign after each document, are counted over the whole corpus. A document of docs is scored with its own counts left out, so what only it has is
    unseen and failure arcs are taken. Smoothing is by a Dirichlet prior: p(w | h) = (n(hw) + mu p(w | h')) / (n(h) + mu), h' without
    h's first word; below the empty context a word is its bytes and a stop, each 1/256. log_prob is natural, the end sign included; bits_per_byte divides by bytes + 1.

    No task holds the model: documents are gathered to blocks, and each block sends its distinct sequences, as hashes sorted by bucket,
    to the bucket's task. This merges them and answers each block with the counts of those that others have too. A block's task makes the part
    of the automaton that its documents can reach and reads each of them once, from left to right. All exchanges are in proportion to the corpus.
    Where there are far more buckets than a block has sequences, a row holds one sequence: then it's an ordinary exchange of hashes.
    docs is read twice and must give the same partitions then, as files and written tables do; if not, an error says so.

    Defined cases: null and empty texts have 0 bytes and the end sign's probability; a null identifier is scored like others; repeated rows are documents each, so each
    is seen in the other; a text without words is the end sign alone; an empty corpus leaves spelling alone; no rows - no rows.
    """
    leave_out = corpus is None
    source = docs if leave_out else corpus
    n_docs, chars = source.agg(F.count("*"), F.coalesce(F.sum(F.length(f"`{text_col}`")), F.lit(0))).first()
    bits = min(64, int(n_docs + chars).bit_length() + SPARE_BITS)
    buckets = 1 + int(chars) // BUCKET_CHARS
    grams = "bucket bigint, block bigint, codes binary, times binary"
    send = lambda blocks, counts: blocks.select("block", "blob").mapInArrow(sent_grams(bits, buckets, counts), grams)
    asking = blocks_of(docs, id_col, text_col)
    sent = send(asking, leave_out).withColumn("asks", F.lit(True))
    if not leave_out:
        sent = sent.unionByName(send(blocks_of(corpus, id_col if id_col in corpus.columns else corpus.columns[0], text_col), True).withColumn("asks", F.lit(False)))
    answers = sent.groupBy("bucket").applyInArrow(answered, "block bigint, bucket bigint, at binary, total binary")
    held = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "at", "total")).alias("answers"))
    joined = blocks_of(docs, id_col, text_col).join(held, "block", "left").select("ids", "blob", "n_bytes", "answers")

    def run(batches):
        for batch in batches:
            for ids, blob, n_bytes, answers in zip(batch.column(0), *(batch.column(k).to_pylist() for k in (1, 2, 3))):
                if not answers:
                    raise ValueError("docs changed between two readings: write it to a table first")
                block = Block(decoded(blob))
                codes, n, inverse, own = listed(block, bits, leave_out)
                total = n * leave_out
                bucket = bucket_of(codes, bits, buckets)
                begin = {int(bucket[a]): a for a, _ in spans(bucket)}
                for x in answers:
                    total[begin[x["bucket"]] + np.cumsum(unsqueeze(x["at"]).astype(np.int64))] = unsqueeze(x["total"])
                counts = [total[at] - o for at, o in zip(inverse, own)]
                signs = total[0] - block.lens * leave_out
                del codes, n, inverse, own, total, bucket, begin
                logs = Automaton(block, counts, n_docs - leave_out, signs, mu).score()
                size = np.array(n_bytes)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(size, pa.int64()), pa.array(logs), pa.array(-logs / math.log(2) / (size + 1))], names=["doc_id", "n_bytes", "log_prob", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, log_prob double, bits_per_byte double")
