"""Exact top-k search by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, numbered

#: What one term is, here and in the SQL: runs of characters of lower-case text other than ASCII punctuation, blanks and controls.
TERM = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
#: Documents whose scores one dense array holds.
BLOCK = 32768


def _terms(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


_loaded: dict[str, dict[str, int]] = {}


def _vocabulary(path: str) -> dict[str, int]:
    """The numbers of the queries' terms, read from the shared folder once a worker process."""
    if path not in _loaded:
        fs, inner = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
        t = ds.dataset(inner, format="parquet", filesystem=fs, schema=pa.schema([("term", pa.string()), ("tid", pa.int64())])).to_table()
        _loaded.clear()
        _loaded[path] = dict(zip(t.column("term").to_pylist(), t.column("tid").to_pylist()))
    return _loaded[path]


def term_counts(batches):
    """(query, term, times) of rows (query, text)."""
    for batch in batches:
        bags = [Counter(_terms(t)) for t in batch.column(1).to_pylist()]
        owner = pa.array(np.repeat(np.arange(len(bags)), list(map(len, bags))))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array([t for b in bags for t in b], pa.string()), pa.array([n for b in bags for n in b.values()], pa.int64())], names=["query", "term", "times"])


def bags_of(path: str):
    """A function that gathers rows (doc_id, text) to blocks: identifiers in order, lengths, and for each document the queries' terms in it with their counts."""

    def run(batches):
        held: list = []

        def block(ids: pa.Array, lens, size, term, tf):
            # by identifier, so that a document's place in its block breaks ties
            order = pc.sort_indices(ids)
            at = order.to_numpy()
            begin = np.cumsum(size) - size
            moved = np.repeat(begin[at], size[at]) + np.arange(len(term)) - np.repeat(np.cumsum(size[at]) - size[at], size[at])
            one = lambda x, kind=None: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if kind is None else pa.array(x, kind))
            columns = [one(ids.take(order)), one(lens[at], pa.int64()), one(size[at], pa.int32()), one(term[moved], pa.int32()), one(tf[moved], pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "lens", "size", "term", "tf"])

        def whole():
            parts = list(zip(*held))
            ids = pa.concat_arrays(parts[0])
            return block(ids, *map(np.concatenate, parts[1:]))

        known = None
        for batch in batches:
            known = known if known is not None else _vocabulary(path)
            lens, owners, terms = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = _terms(text)
                lens.append(len(words))
                hits = [known[w] for w in words if w in known]
                terms += hits
                owners += [i] * len(hits)
            pair, tf = np.unique(np.array(owners, np.int64) << 32 | np.array(terms, np.int64), return_counts=True)
            size = np.diff(np.searchsorted(pair >> 32, np.arange(len(lens) + 1)))
            held.append((batch.column(0), np.array(lens, np.int64), size, pair & 0xFFFFFFFF, tf))
            if sum(map(len, (h[1] for h in held))) >= BLOCK:
                yield whole()
                held = []
        if held:
            yield whole()

    return run


def searched(k: int, k1: float, b: float, scale: float):
    """A function from pairs of a block of documents and a block of queries to (query, doc_id, score) of each query's k best documents of the block."""

    def best(ids: pa.Array, lens, size, term, tf, weights, queries, mean: float):
        owner = np.repeat(np.arange(len(size)), size)
        known, idf = weights
        at = np.minimum(np.searchsorted(known, term), max(0, len(known) - 1))
        asked = known[at] == term if len(known) else np.zeros(len(term), bool)
        owner, tf, at = owner[asked], tf[asked], at[asked]
        norm = k1 * (1.0 - b + b * lens[owner] / (mean or 1.0))
        weight = np.floor(scale * idf[at] * (tf * (k1 + 1.0)) / (tf + norm) + 0.5).astype(np.int64)
        order = np.argsort(at, kind="stable")
        owner, weight = owner[order], weight[order]
        begin = np.searchsorted(at[order], np.arange(len(known) + 1))
        score, found = np.zeros(len(size), np.int64), []
        named = pc.is_valid(ids).to_numpy(zero_copy_only=False)
        for query, terms, times in queries:
            for t, m in zip(np.searchsorted(known, terms).tolist(), times):
                lo, hi = begin[t], begin[t + 1]
                score[owner[lo:hi]] += m * weight[lo:hi]  # a document is at most once in a term's postings
            hit = np.flatnonzero((score > 0) & named)
            if len(hit) > k:
                own = score[hit]
                hit = hit[own >= np.partition(own, len(own) - k)[len(own) - k]]  # ties at the cut stay
            hit = hit[np.lexsort((hit, -score[hit]))[:k]]
            found.append((query, hit, score[hit]))
            score[:] = 0
        return found

    def run(batches):
        for batch in batches:
            rows = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                one = {n: c[i].values for n, c in rows.items() if n != "mean"}
                array = lambda n: one[n].to_numpy(zero_copy_only=False)
                queries = [(q["query"], np.array(q["terms"], np.int64), q["times"]) for q in one["queries"].to_pylist()]
                found = best(one["ids"], array("lens"), array("size"), array("term").astype(np.int64), array("tf"), (array("known"), array("idf")), queries, rows["mean"][i].as_py())
                hits = np.concatenate([h for _, h, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _, _ in found], [len(h) for _, h, _ in found]), pa.int64()), one["ids"].take(pa.array(hits)), pa.array(np.concatenate([s for _, _, s in found]))], names=["query", "doc_id", "score"])

    return run


def top_k(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, scale: float = 1000.0, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", queries_at_once: int = 5000) -> DataFrame:
    """(query_id, query_no, rank, doc_id, score): the k best documents of every query row by BM25.

    Weights are whole numbers, floor(scale * idf * tf part + 0.5), so sums are exact whatever their order; ties are ranked by
    smaller doc_id. Document frequencies and the mean length cover all documents. The queries' terms are numbered in a table in the shared folder, which each worker
    loads: it grows with the distinct terms of the queries, not with the documents. One scan leaves blocks of documents with their
    query terms and counts in the shared folder, and statistics come from it. Queries are gathered to blocks of ``queries_at_once`` rows with
    their terms' weights, and each block of documents meets each of queries: a document block is turned into postings by term; every row of the sparse query matrix scatters its
    terms' weighted postings into a dense array of scores, the block's k best are selected, and one window merges the candidates, of which there are
    at most k a query and block. No document is skipped and no score is bounded or estimated; nothing of queries or documents goes through the driver.

    query_no tells rows with one query_id apart: they are numbered from 1 in the order of their texts. Identifiers may have any type that can be sorted.

    Defined cases: a query without terms, with a null text or a null identifier, and a document that shares no term with it or whose score rounds to 0, give no row; fewer than k
    matches give fewer rows; a term that a query repeats counts as often; null texts have no terms; documents with a null
    identifier aren't found but count in statistics; rows that repeat an identifier are each a document; no rows - no rows.
    """
    shelf = Shelf(docs.sparkSession, "topk")
    asked = queries.select(F.col(f"`{query_id}`").alias("query_id"), F.col(f"`{query_text}`").alias("text")).where("query_id is not null and text is not null")
    no = F.row_number().over(Window.partitionBy("query_id").orderBy("text"))
    asked = shelf.put(asked.withColumn("query_no", no).withColumn("query", F.monotonically_increasing_id()))
    wanted = shelf.put(asked.select("query", "text").mapInArrow(term_counts, "query bigint, term string, times bigint"))
    terms = shelf.put(wanted.select("term").distinct())
    vocabulary = shelf.put(numbered(terms, ["term"], 1 + terms.count() // 1_000_000, "tid", shelf).select("term", "tid"))
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    bags = shelf.put(read.mapInArrow(bags_of(vocabulary.shelf_path), f"ids array<{kind}>, lens array<bigint>, size array<int>, term array<int>, tf array<int>"))
    # a row of sums
    sizes = bags.select(F.size("lens").cast("double").alias("n"), F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("len")).agg(F.sum("n").alias("n"), (F.sum("len") / F.sum("n")).alias("mean"))
    df = bags.select(F.explode("term").alias("tid")).groupBy("tid").agg(F.count("*").cast("double").alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = shelf.put(wanted.join(vocabulary, "term").join(df, "tid", "left").withColumn("df", F.coalesce("df", F.lit(0.0))).crossJoin(sizes).select("query", "tid", "times", idf.alias("idf"), "mean"))
    blocks = 1 + asked.count() // queries_at_once
    in_block = rows.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    by_term = in_block.groupBy("block").agg(F.sort_array(F.collect_set(F.struct("tid", "idf"))).alias("w"), F.max("mean").alias("mean"))
    by_query = in_block.groupBy("block", "query").agg(F.collect_list("tid").alias("terms"), F.collect_list("times").alias("times")).groupBy("block").agg(F.collect_list(F.struct("query", "terms", "times")).alias("queries"))
    asking = shelf.put(by_term.join(by_query, "block").select(F.col("w.tid").alias("known"), F.col("w.idf").alias("idf"), "queries", "mean"))
    found = bags.where("size(term) > 0").crossJoin(asking).mapInArrow(searched(k, k1, b, scale), f"query bigint, doc_id {kind}, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "query_id", "query_no"), "query").select("query_id", "query_no", "rank", "doc_id", "score")
