"""Exact dedup by content sort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed


def normalised(text):
    """The compared form of a text: runs of white space are one blank, none at the ends. Letter case counts."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def thinned(batches):
    """Rows (r, norm, id, ...) without those that have a copy with a smaller or equal identifier in their batch; whole texts are compared."""
    for batch in batches:
        norm = batch.column(1).dictionary_encode().indices
        ids = pc.rank(batch.column(2), sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        code = norm.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, code))
        again = np.concatenate([[False], code[order][1:] == code[order][:-1]]) & (code[order] >= 0)
        keep = np.ones(len(code), bool)
        keep[order[again]] = False
        yield batch.filter(pa.array(keep)) if again.any() else batch


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """Keep of all documents with equal normalised text the one with the smallest identifier.

    Content sort: sampled splitters range-partition the rows by the normalised text. Splitters are drawn over
    its first ``prefix_chars`` characters and a 64-bit hash, so that the driver never holds long sampled
    texts and a prefix that half of the corpus shares is still spread over all partitions; Spark's external
    sort then orders each partition by (prefix, hash, whole text, identifier), equals are adjacent, and the
    window compares neighbours' whole texts. The window's grouping contains the range keys, so the plan has
    one exchange. Before it each Arrow batch is rid of its own copies, so that a text with many copies,
    which all have one place in the order, doesn't fill that partition with them.

    Defined cases: a null text is no content, such rows are all kept; empty and blank texts are equal to each
    other; a null identifier sorts after all others; of rows equal in text and identifier one stays; an empty
    table stays empty; all columns, whatever their names, are returned unchanged.
    """
    norm = normalised(F.col(f"`{text_col}`"))
    wide = packed(docs, norm.alias("norm"), F.col(f"`{id_col}`").alias("id"))
    wide = wide.mapInArrow(thinned, wide.schema)
    # an identifier stands in for the text of null ones, which would all have one place
    spread = F.when(F.col("norm").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("norm"))
    rows = wide.select("r", F.substring("norm", 1, prefix_chars).alias("head"), spread.alias("spread"))
    ranged = rows.repartitionByRange("head", "spread").withColumn("norm", normalised(F.col("r").getField(text_col)))
    order = Window.partitionBy("head", "spread", "norm").orderBy(F.col("r").getField(id_col).asc_nulls_last())
    ranked = ranged.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") == 1) | F.col("norm").isNull()).select("r.*")
