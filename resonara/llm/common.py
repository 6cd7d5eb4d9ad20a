"""What the corpus operators share: clash-free columns, durable cuts of lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shelf import Shelf, delete, passing, shared_folder

__all__ = ["Shelf", "before", "delete", "free_name", "numbered", "packed", "passing", "shared_folder", "table"]


def packed(df: DataFrame, *computed, name: str = "r") -> DataFrame:
    """All columns of df in one struct beside computed ones, so that no input name can clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(name), *computed)


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, with underscores appended until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def before(sums: DataFrame, **columns: Column) -> DataFrame:
    """sums has one row a part of a range-sorted table; each of ``columns``, an aggregate, is taken over the parts before. A row a partition: one task sorts them."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", *[c.over(earlier).alias(n) for n, c in columns.items()])


def numbered(df: DataFrame, order: list[str | Column], parts: int, name: str, shelf: Shelf) -> DataFrame:
    """df with its rows numbered from 0 on in ``order``, whatever the number of parts: a range sort, and each part's rows counted on from those before."""
    at = F.monotonically_increasing_id()  # part and place in it
    rows = shelf.put(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", at)).withColumn("part", F.shiftright("at", 33))
    begin = before(rows.groupBy("part").agg(F.count("*").alias("n")), begin=F.sum("n"))
    place = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(begin, "part").withColumn(name, F.coalesce("begin", F.lit(0)) + place).drop("at", "part", "begin")
