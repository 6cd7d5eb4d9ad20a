"""Best-fit packing of documents into fixed-length training sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf, before, numbered
from .tokens import RANKS, token_counts

#: Rows that one task sorts and sweeps, about. Results don't depend on it.
PART_ROWS = 50_000


def token_estimate(text):
    """One token for four bytes of UTF-8, and one that ends the document: a guess, which no registered query uses (see ``pack_tokens``)."""
    return (F.lit(1) + F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(4))).cast("bigint")


def brackets(batches):
    """One part of the sorted rows (part, kind, id, value): its documents with the gaps they close in the part, and gaps that stay open.

    level: open gaps less waiting documents of this part, after a gap and before a document. What belongs together follows each other within a level.
    """
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    kind, ident = t.column("kind").to_numpy(), t.column("id").to_numpy()
    level = np.cumsum(1 - 2 * kind.astype(np.int64)) + kind
    order = np.argsort(level, kind="stable")
    follows = np.concatenate([[False], level[order][1:] == level[order][:-1]])
    closes = np.flatnonzero(follows & (kind[order] == 1) & (np.concatenate([[1], kind[order][:-1]]) == 0))
    bins, shut = np.full(len(kind), -1, np.int64), np.zeros(len(kind), bool)
    bins[order[closes]] = ident[order[closes - 1]]
    shut[order[closes - 1]] = True
    stay = np.flatnonzero(~shut)
    names = ["part", "pos", "kind", "id", "value", "level", "bin"]
    columns = [t.column("part").to_numpy()[stay], stay, kind[stay], ident[stay], t.column("value").to_numpy()[stay], level[stay]]
    done = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bins[stay], mask=bins[stay] < 0)], names=names)
    for at in range(0, len(stay), 10_000):
        yield done.slice(at, 10_000)


def sweep(waiting: DataFrame, gaps: DataFrame, high: int, capacity: int, parts: int, shelf: Shelf) -> DataFrame:
    """One round: (item, size, bin) for every waiting document; bin is null for those that wait on.

    Documents (item, size) and gaps (bin, gap) are range-sorted together over ``parts`` partitions, the largest first. Read in this order a gap
    opens a bracket and a document closes one: a document's gap is the nearest open one, which is the least that holds it among those
    that larger documents left. Brackets that belong together follow each other within one nesting level, and the level of a row is
    its rank: gaps before it less documents before it. Each partition settles what lies within it. What is left of
    it are documents that close earlier gaps and then gaps that stay open, each alone on its level; sums over the partitions before give
    its level in the whole, and so gaps and documents of different partitions meet by level, at most two rows a partition and level.
    The result is that of one sweep over all rows, whatever their partitions. A gap that surely holds several of the waiting documents (none is over
    ``high``) counts as so many equal ones. Where documents find no gap, one opens a sequence each time that their running total passes another capacity.
    """
    slots = F.greatest(F.lit(1), F.floor(F.col("gap") / high)).cast("int")
    offers = gaps.select(F.lit(0).alias("kind"), F.col("bin").alias("id"), slots.alias("slots"), F.floor(F.col("gap") / slots).cast("bigint").alias("value"))
    offers = offers.select("kind", "id", "value", F.explode(F.sequence(F.lit(1), F.col("slots"))).alias("slot"))
    wants = waiting.select(F.lit(1).alias("kind"), F.col("item").alias("id"), F.col("size").alias("value"), F.lit(0).alias("slot"))
    order = [F.desc("value"), F.asc("kind"), F.asc("id"), F.asc("slot")]
    sorted_ = offers.unionByName(wants).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    swept = shelf.put(sorted_.select(F.spark_partition_id().alias("part"), "kind", "id", "value").mapInArrow(brackets, "part int, pos bigint, kind int, id bigint, value bigint, level bigint, bin bigint"))
    left = swept.where("bin is null")
    # a part lowers the level by what it closes, then raises it by what it leaves open
    sums = left.groupBy("part").agg(F.sum("kind").alias("shut"), F.sum(1 - F.col("kind")).alias("open"))
    begun = before(sums, base=F.sum(F.col("open") - F.col("shut"))).join(sums, "part").withColumn("base", F.coalesce("base", F.lit(0)))
    least = before(begun, least=F.min(F.col("base") - F.col("shut"))).join(begun.select("part", "base"), "part").select("part", "base", F.least(F.lit(0), "least").alias("least"))
    ranked = left.join(least, "part").withColumn("level", F.col("level") + F.col("base"))
    # on a level that was never below before there is no gap to close
    ranked = shelf.put(ranked.withColumn("alone", (F.col("kind") == 1) & (F.col("level") <= F.col("least"))).drop("base", "least", "bin"))
    level = Window.partitionBy("level").orderBy("part", "pos")
    met = ranked.where("not alone").withColumn("bin", F.lag("id").over(level)).where("kind = 1").select(F.col("id").alias("item"), F.col("value").alias("size"), "bin")
    alone = ranked.where("alone")
    totals = before(alone.groupBy("part").agg(F.sum("value").alias("own")), earlier=F.sum("own"))
    total = F.coalesce("earlier", F.lit(0)) + F.sum("value").over(Window.partitionBy("part").orderBy("pos"))
    opens = F.ceil(F.col("total") / capacity) > F.ceil((F.col("total") - F.col("value")) / capacity)
    opened = alone.join(totals, "part").withColumn("total", total).select(F.col("id").alias("item"), F.col("value").alias("size"), F.when(opens, F.col("id")).alias("bin"))
    return swept.where("bin is not null").select(F.col("id").alias("item"), F.col("value").alias("size"), "bin").unionByName(met).unionByName(opened)


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", length=token_estimate, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, n_tokens): where each piece of each document lies.

    A document longer than ``capacity`` is cut into full sequences and a rest. Rests are packed in bands of falling size,
    each in bulk-synchronous rounds (see ``sweep``): range-sort, match, shrink the gaps, repeat with those that still wait. A round's tables
    are written to the shared folder. Partitions hold some ``part_rows`` rows of documents and gaps together, and grow in number only; nothing is broadcast by hint.
    Pieces are numbered in the order of (doc_id, piece, size) and ties go by this number, so the packing is the same for any number of partitions.

    bin_id is the number of the piece that opened the sequence. Defined cases: null and empty texts are one token long;
    a null identifier is packed like others; rows that repeat an identifier are packed each; no rows - no rows.
    """
    if capacity < 64:
        raise ValueError("capacity must be at least 64")
    spark = docs.sparkSession
    shelf = Shelf(spark, "pack")
    n = F.col("n")
    read = shelf.put(docs.select(F.col(f"`{id_col}`").alias("doc_id"), length(F.col(f"`{text_col}`")).alias("n")))
    rows = read.select("doc_id", n, F.explode(F.sequence(F.lit(0), F.floor(n / capacity).cast("int"))).alias("piece"))
    size = F.when(F.col("piece") < F.floor(n / capacity), F.lit(capacity)).otherwise(n % capacity).cast("bigint")
    some = 1 + read.count() // part_rows
    pieces = shelf.put(numbered(rows.select("doc_id", "piece", size.alias("size")).where("size > 0"), ["doc_id", "piece", "size"], some, "item", shelf))
    bands = [capacity, capacity // 2, capacity // 4, capacity // 8, capacity // 16, capacity // 64, 0]
    edges = list(zip(bands, bands[1:]))
    band = F.lit(-1)
    for k, (high, _) in enumerate(edges):
        band = F.when(F.col("size") <= (high if k else capacity - 1), k).otherwise(band)
    many = {r["band"]: (r["n"], r["most"]) for r in pieces.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.max("size").alias("most")).collect()}
    placed = [pieces.where(F.col("size") == capacity).select("item", F.col("item").alias("bin"))]
    gaps, room = shelf.put(pieces.limit(0).select(F.col("item").alias("bin"), F.col("size").alias("gap"))), (0, 0)
    for k in range(len(edges)):
        left, high = many.get(k, (0, 0))
        waiting = pieces.where(band == k).select("item", "size")
        while left:
            if not k:  # no two of the largest band fit into one sequence
                got = waiting.select("item", "size", F.col("item").alias("bin"))
            else:
                # a gap counts as one row for each of the waiting documents that it surely holds
                got = shelf.put(sweep(waiting, gaps, high, capacity, 1 + int(left + room[0] + room[1] // high) // part_rows, shelf))
            used = got.where("bin is not null").groupBy("bin").agg(F.sum("size").alias("used"), F.max(F.col("bin") == F.col("item")).alias("new"))
            old = gaps.join(used, "bin", "left").select("bin", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
            shrunk = shelf.put(old.unionByName(used.where("new").select("bin", (capacity - F.col("used")).alias("gap"))).where("gap > 0"))
            shelf.drop(gaps)
            gaps, waiting = shrunk, got.where("bin is null").select("item", "size")
            placed.append(got.where("bin is not null").select("item", "bin"))
            left, high = waiting.agg(F.count("*"), F.max("size")).first() if k else (0, 0)
            room = gaps.agg(F.count("*"), F.coalesce(F.sum("gap"), F.lit(0))).first()
    where = placed[0]
    for p in placed[1:]:
        where = where.unionByName(p)
    inside = Window.partitionBy("bin").orderBy(F.desc("size"), "item")
    laid = pieces.join(where, "item").withColumn("bin_offset", F.sum("size").over(inside) - F.col("size"))
    return laid.select("doc_id", "piece", F.col("bin").alias("bin_id"), "bin_offset", F.col("size").alias("n_tokens"))


def pack_tokens(docs: DataFrame, capacity: int = 2048, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` by the tokens of a vocabulary file, as ``token_counts`` counts them, and one that ends the document.

    Piece k of a document is its tokens from k * capacity on. Null and empty texts are the end token alone.
    """
    counted = token_counts(docs, ranks, id_col=id_col, text_col=text_col)
    return pack(counted, capacity, text_col="n_tokens", length=lambda n: F.lit(1).cast("bigint") + F.coalesce(n, F.lit(0)))
