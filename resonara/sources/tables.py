"""Signals and component lists made from the warehouse tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def hours(spark: SparkSession, d: str) -> DataFrame:
    """(track, ch, i, x): hourly sum (ch 0) and count (ch 1) of the events of each type on a dense grid."""
    e = table(spark, d, "events").where("ts is not null and event_type is not null")
    first = e.agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("first"))
    own = e.crossJoin(F.broadcast(first)).groupBy(F.col("event_type").alias("track"), F.expr("timestampdiff(HOUR, first, date_trunc('hour', ts)::timestamp_ntz)").alias("i")).agg(F.sum("value").alias("s"), F.count("*").cast("double").alias("c"))
    grid = own.select("track").distinct().crossJoin(F.broadcast(own.agg(F.max("i").alias("last")))).select("track", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("i"))
    dense = grid.join(own, ["track", "i"], "left")
    two = F.array(F.struct(F.lit(0).alias("ch"), F.coalesce("s", F.lit(0.0)).alias("x")), F.struct(F.lit(1).alias("ch"), F.coalesce("c", F.lit(0.0)).alias("x")))
    return dense.select("track", "i", F.explode(two).alias("z")).select("track", "z.ch", "i", "z.x")


def days(spark: SparkSession, d: str) -> DataFrame:
    """(track, ch, i, x): order totals in millions of each status's days that have orders, in order."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("track"), F.to_date("o_orderdate").alias("day")).agg((F.sum("o_totalprice") / 1e6).alias("x"))
    return o.select("track", F.lit(0).alias("ch"), (F.row_number().over(Window.partitionBy("track").orderBy("day")) - 1).cast("bigint").alias("i"), "x")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(track, t, b, mag): absolute embedding components as bins, the vectors of a label as frames."""
    e = table(spark, d, "embeddings")
    t = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("bigint")
    return e.select(F.col("label").cast("string").alias("track"), t.alias("t"), "embedding").select("track", "t", F.posexplode("embedding").alias("b", "v")).select("track", "t", "b", F.abs(F.col("v").cast("double")).alias("mag"))


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two lists of components (pair, idx, kind, v) a label: vectors with even and odd identifiers."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("string").alias("pair"), F.col("vec_id").alias("idx"), F.when(F.col("vec_id") % 3 == 0, "percussive").otherwise("harmonic").alias("kind"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.where("idx % 2 = 0"), e.where("idx % 2 = 1")


def components(spark: SparkSession, d: str) -> DataFrame:
    """(track, idx, kind, energy, name, tonic): customers of a nation as its list of components."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    kind = F.element_at(F.array(F.lit("percussive"), F.lit("harmonic"), F.lit("mixed")), (k % 3 + 1).cast("int"))
    return c.select(F.col("c_nationkey").cast("string").alias("track"), (F.row_number().over(order) - 1).alias("idx"), kind.alias("kind"), F.col("c_acctbal").alias("energy"), F.when(k % 5 == 0, "—").otherwise("named").alias("name"), (k % 12).cast("int").alias("tonic"))
