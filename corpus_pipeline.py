"""The corpus pipeline: toxicity, exact dedup, near-dedup, source mixing, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written and read again as the next one's docs. All but the last return the columns of docs, whatever
other ones there are besides doc_id, text and source. Nulls may be in any column; each stage says what becomes of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from resonara.llm.common import delete, passing, shared_folder, table
from resonara.llm.exact import exact_dedup
from resonara.llm.mixing import mix_sources
from resonara.llm.packing import pack_tokens
from resonara.llm.simhash import drop_near_duplicates
from resonara.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic. Null and empty texts, null identifiers and repeated rows stay; where labels are empty, null or of one kind, all stay; no rows - no rows."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, but for white space, the one with the least identifier; a null one is the largest. Null texts all stay, of empty and blank ones one; no rows - no rows."""
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least identifier. Texts without a word and null identifiers stay; rows that repeat an identifier stay or go together; no rows - no rows."""
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as a Poisson draw about its source's rate says, shuffled. A null source is a source; null and empty texts are drawn like others of theirs; equal and null identifiers share a draw; no rows - no rows."""
    return mix_sources(docs, copy_col=None)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, n_tokens) of every piece of every document. Null and empty texts are an end token; null identifiers and repeated rows are packed each; no rows - no rows."""
    return pack_tokens(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the trained tagger of the first stage nor the iterated packing of the last one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir: a written table. Those of the stages before it are deleted as soon as they are read."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
