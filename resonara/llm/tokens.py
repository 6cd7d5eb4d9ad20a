"""Token counts, with overlap resynchronisation for huge documents."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before pairs are merged (public, of the byte-level BPE with 50k entries). It looks back at nothing, and ahead by at most MARGIN characters.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARGIN = 8


@lru_cache(maxsize=2)
def encoding(ranks: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a vocabulary file, and each token's length in bytes; loaded once a worker process."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lens = np.zeros(max(table.values()) + 1, np.int64)
    for token, n in table.items():
        lens[n] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}), lens


_PIECES = regex.compile(PATTERN)


def boundaries(text: str, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of text end, in characters, and how many tokens there are up to each end."""
    enc, lens = encoding(ranks)
    ends = np.cumsum(lens[np.array(enc.encode_ordinary(text), np.int64)]) if text else np.zeros(0, np.int64)
    pieces = _PIECES.findall(text)
    chars = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    at = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
    return chars, np.searchsorted(ends, at, side="right")


def chunk_bounds(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks over n characters; neighbours share ``overlap`` characters."""
    step = chunk - overlap
    return [(s, min(n, s + chunk)) for s in range(0, max(1, n - overlap), step)]


def splice(chunks: pd.DataFrame, n: int) -> int | None:
    """Tokens of a document from its chunks' boundaries, or None where two neighbours agree on none.

    The first chunk's pieces are the document's. A boundary that two chunks share and that is MARGIN before the left
    one's end is one of the document's, as cutting depends only on what follows a boundary: from there on the right chunk's pieces
    are the document's. The last such boundary is where the left chunk is left.
    """
    total, begin = 0, None
    rows = chunks.drop_duplicates("start").sort_values("start").to_dict("records")
    for left, right in zip(rows, rows[1:]):
        lt, rt = np.asarray(left["tail_at"]), np.asarray(right["head_at"])
        common = np.intersect1d(lt[lt <= left["end"] - MARGIN], rt)
        if begin is not None:
            common = common[common > begin[0]]
        if not len(common):
            return None
        p = int(common[-1])
        total += int(left["tail_n"][int(np.searchsorted(lt, p))]) - (begin[1] if begin else 0)
        begin = (p, int(right["head_n"][int(np.searchsorted(rt, p))]))
    return total + int(rows[-1]["n"]) - (begin[1] if begin else 0)


def token_counts(docs: DataFrame, ranks: str = RANKS, huge_chars: int = 32768, chunk_chars: int = 16384, overlap_chars: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_tokens) of every document, exactly as encoded whole.

    Documents of up to ``huge_chars`` characters are encoded whole in a narrow map. Longer ones are cut into overlapping
    chunks that are dealt over the cluster and encoded with offsets; a document's chunks are spliced at boundaries that both
    neighbours share and that are proven stable (see ``splice``). Where a pair shares none, the document is cut again with
    overlaps, and then chunks, four times as wide, at last into one chunk.

    ranks: a vocabulary file that every worker can read. Defined cases: a null text has null n_chars and n_tokens, the empty
    text 0 and 0; a null identifier is counted like others; each of repeated rows is counted; no rows - no rows.
    """
    if not 0 < 4 * overlap_chars <= chunk_chars:
        raise ValueError("chunk_chars must be at least four overlaps")
    kind = dict(docs.dtypes)[id_col]
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    is_huge = F.coalesce(F.length("text") > huge_chars, F.lit(False))

    def whole(batches):
        enc, _ = encoding(ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    out = f"doc_id {kind}, n_chars bigint, n_tokens bigint"
    counted = read.where(~is_huge).mapInArrow(whole, out)

    shelf = Shelf(docs.sparkSession, "tokens")
    huge = shelf.put(read.where(is_huge).withColumn("row", F.monotonically_increasing_id()).withColumn("n_chars", F.length("text").cast("bigint")))
    left = huge.count()
    pending, chunk, overlap = huge, chunk_chars, overlap_chars
    while left:
        spliced = shelf.put(_spliced(pending, ranks, chunk, overlap))
        counted = counted.unionByName(huge.select("row", "doc_id", "n_chars").join(spliced.where("n_tokens is not null").select("row", "n_tokens"), "row").select("doc_id", "n_chars", "n_tokens"))
        failed = spliced.where("n_tokens is null").select("row")
        left = failed.count()
        pending = huge.join(failed, "row", "left_semi")
        overlap *= 4
        chunk = max(chunk, 4 * overlap)
    return counted


def _spliced(pending: DataFrame, ranks: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of documents (row, text, n_chars); null where a pair of chunks shares no boundary. A text is cut in one pass."""
    def cut(batches):
        for batch in batches:
            for row, n, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                bounds = chunk_bounds(n, chunk, overlap)
                for at in range(0, len(bounds), 64):
                    some = bounds[at : at + 64]
                    columns = [pa.array([row] * len(some), pa.int64()), pa.array([n] * len(some), pa.int64()), pa.array([a for a, _ in some], pa.int32()), pa.array([text[a:b] for a, b in some])]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "n_chars", "start", "part"])

    parts = pending.select("row", "n_chars", "text").mapInArrow(cut, "row bigint, n_chars bigint, start int, part string").repartition("row", "start")

    def encode(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for start, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                at, n = boundaries(text, ranks)
                at = at + start
                head, tail = at <= start + overlap, at >= start + len(text) - overlap
                for c, x in zip(cols, (start + len(text), int(n[-1]) if len(n) else 0, at[head], n[head], at[tail], n[tail])):
                    c.append(x)
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, ints) for c in cols[2:]]], names=["row", "n_chars", "start", "end", "n", "head_at", "head_n", "tail_at", "tail_n"])

    lists = ", ".join(f"{c} array<bigint>" for c in ("head_at", "head_n", "tail_at", "tail_n"))
    done = parts.mapInArrow(encode, f"row bigint, n_chars bigint, start int, end bigint, n bigint, {lists}")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "n_tokens": pd.array([splice(pdf, int(pdf["n_chars"].iloc[0]))], "Int64")})

    return done.groupBy("row").applyInPandas(join, "row bigint, n_tokens bigint")
