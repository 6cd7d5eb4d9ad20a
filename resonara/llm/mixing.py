"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf, free_name, packed

#: The inverse distribution is tabulated to this mean; a larger one is a sum of equal independent parts.
PART_MEAN = 500.0


def uniform(seed: int, *parts):
    """A double in [0, 1) with 52 bits, from the MD5 of seed and parts."""
    key = F.concat_ws("|", F.lit(str(seed)), *parts)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def target_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, budget: float = 1.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a source: its mass in characters over all documents, and the mean repetitions of its documents.

    The mean is budget * target share / actual share. Targets are ``weights`` (a source not named there gets
    0), or shares in proportion to mass ** alpha. A null source is a source of its own, named by null in
    ``weights`` too; a source without characters has mean 0 when weights are tempered.
    """
    mass = docs.groupBy(F.col(f"`{source_col}`").alias("src")).agg(F.coalesce(F.sum(F.length(f"`{text_col}`")), F.lit(0)).cast("double").alias("mass"))
    if weights is None:
        wanted = F.pow(F.col("mass"), F.lit(float(alpha)))
    else:
        wanted = F.lit(0.0)
        for name, w in weights.items():
            wanted = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(wanted)
    sums = mass.select(F.sum("mass").alias("all_mass"), F.sum(wanted).alias("all_wanted"))
    rate = F.lit(float(budget)) * wanted / F.col("all_wanted") * F.col("all_mass") / F.col("mass")
    return mass.crossJoin(sums).select("src", "mass", F.when((F.col("mass") > 0) & (F.col("all_wanted") > 0), rate).otherwise(0.0).alias("rate"))


def poisson_steps(mean):
    """The cumulative Poisson probabilities 0, 1, 2 ... as far as a double tells them from 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["c"]


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, budget: float = 1.0, seed: int = 20240, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", copy_col: str | None = "copy_index") -> DataFrame:
    """Repeat each document a Poisson-distributed number of times whose mean is its source's target rate, and shuffle.

    The count inverts the Poisson distribution at a uniform number hashed from seed and identifier, so a rerun
    repeats it; a document whose count is 0 goes. Source masses cover all documents; the table of rates has
    one row a source, is written first and joined by Spark's own choice: broadcast only if its measured size
    allows. Copies are dealt to partitions by a hash of (seed, identifier, copy) and sorted by it within them: a
    uniform permutation with one exchange.

    Defined cases: null source - a source of its own; null or empty text - no mass, but repeated like the others of
    its source; null identifier - all such rows share one draw, as do rows with equal identifiers; no rows -
    no rows. ``copy_col`` (1, 2, ... ; underscores are appended while the name is taken) is left out if None.
    """
    shelf = Shelf(docs.sparkSession, "mix")
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN).cast("int"))
    rates = shelf.put(target_rates(docs, weights, alpha, budget, text_col, source_col).where("rate > 0").select("src", parts.alias("parts"), poisson_steps(F.col("rate") / parts).alias("steps")).coalesce(1))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    rows = packed(docs, ident.alias("ident"), F.col(f"`{source_col}`").alias("own_src"))

    def draw(j):
        u = uniform(seed, F.col("ident"), j.cast("string"))
        return F.size(F.filter("steps", lambda c: c <= u))

    counted = rows.join(rates, F.col("own_src").eqNullSafe(F.col("src"))).select("r", "ident", F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), draw), F.lit(0), lambda a, x: a + x).alias("n"))
    copies = counted.where("n > 0").select("r", "ident", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    dealt = copies.withColumn("place", F.xxhash64(F.lit(seed), "ident", "copy")).drop("ident").repartition("place").sortWithinPartitions("place")
    extra = [] if copy_col is None else [F.col("copy").alias(free_name(docs, copy_col))]
    return dealt.select("r.*", *extra)
