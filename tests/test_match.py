"""Matching in blocks, against the same by rows; results that must not hang on how a table is cut."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from resonara.operators import match
from resonara.plans import queries
from resonara.plans.registry import ORACLE_SQL

from .conftest import SF

SIDE = "pair string, idx int, kind string, v array<double>"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lists(spark, sizes, seed=1, values=None):
    """Sides with so many parts for each pair; of every four one is percussive."""
    draw = np.random.default_rng(seed)
    side = lambda n: [(p, i, "percussive" if i % 4 == 0 else "harmonic", (draw.normal(size=5) if values is None else draw.integers(0, values, 5)).astype(float).tolist()) for p, m in n.items() for i in range(m)]
    return [spark.createDataFrame(side({p: m[k] for p, m in sizes.items()}), SIDE) for k in (0, 1)]


def by_rows(a, b):
    """What ``candidates`` gives, by a join of rows."""
    t = (F.col("kind") != "percussive").alias("t")
    left, right = a.where("v is not null").select("pair", t, F.col("idx").alias("a"), F.col("v").alias("x")), b.where("v is not null").select("pair", t, F.col("idx").alias("b"), F.col("v").alias("y"))
    return left.join(right, ["pair", "t"]).select("pair", "a", "b", match.cosine(F.col("x"), F.col("y")).alias("similarity"), F.when(F.col("t"), "tonal").otherwise("percussive").alias("basis"))


def same(got, want):
    return sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_candidates_of_lists_over_a_block(spark):
    a, b = lists(spark, {"p": (match.BLOCK * 2 + 7, 40), "q": (3, match.BLOCK + 300), "r": (2, 0), "s": (0, 2)})
    got = match.candidates(a, b)
    assert "MapInArrow" in plan(got) and "zip_with" not in plan(got)  # no value of a pair goes through an interpreted lambda
    assert [t for _, t in got.dtypes] == ["string", "int", "int", "double", "string"]
    assert same(got, by_rows(a, b))


def test_candidates_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    odd = [[], [0.0, 0.0], [1.0], [1.0, 2.0, 3.0], [None, 2.0, 3.0], [1.0, None], [None], [nan, 1.0], [inf, 1.0, 2.0], [1e-9, 1e-9], [-0.0, -1.0], [1.0, 2.0], None]
    rows = [("p", i, kind, v) for i, v in enumerate(odd) for kind in ("harmonic", "percussive", None)] + [(None, 1, "harmonic", [1.0])]
    a = spark.createDataFrame(rows, SIDE)
    assert same(match.candidates(a, a), by_rows(a, a))


def test_matching_of_long_lists_equals_the_fold(spark):
    for values in (None, 2):  # of two values, most similarities are ties
        a, b = lists(spark, {"p": (150, 170), "q": (60, 1), "r": (5, 0)}, seed=3, values=values)
        got = match.match_components(a, b)[0]
        assert "collect_list" not in plan(got)  # no row holds all candidates of a pair
        assert same(got, match.greedy_match(match.candidates(a, b)))


def test_best_pairs_list_again_what_is_left(monkeypatch):
    monkeypatch.setattr(match, "LISTED", 3)
    draw = np.random.default_rng(5)
    for n, m, distinct in ((40, 60, 100), (60, 40, 6), (50, 50, 1)):
        ia, ib = draw.permutation(n) % (n - 2), draw.permutation(m) % (m - 2)  # some numbers twice
        ta, tb = ia % 3 > 0, ib % 3 > 0
        vectors = draw.normal(size=(distinct, 4))
        va, vb = (match.Vectors(vectors[draw.integers(0, distinct, k)].T.copy(), np.full(k, 4), None) for k in (n, m))
        s = match.cosines(va, vb)
        due = sorted((-round(s[x, y], 12), ia[x], ib[y], bool(ta[x]), y) for x in range(n) for y in range(m) if ta[x] == tb[y])
        want = []
        for _, i, j, _, _ in due:
            if all(i != x and j != y for x, y in want):
                want.append((i, j))
        at, to = match.best_pairs(ia, ta, va, ib, tb, vb)
        assert list(zip(ia[at], ib[to], strict=True)) == want


def test_unpaired_of_both_sides_match_once(spark, tmp_path):
    kept = []

    def keep(df):
        df.write.parquet(f"{tmp_path}/pairs")
        kept.append(df)
        return spark.read.parquet(f"{tmp_path}/pairs")

    a, b = lists(spark, {"p": (40, 50), "q": (3, 0)}, seed=7)
    _, ua, ub = match.match_components(a, b, keep=keep)
    both = ua.unionByName(ub)
    assert len(kept) == 1 and "MapInArrow" not in plan(both)
    pairs = match.greedy_match(match.candidates(a, b))
    assert same(ua, match.unpaired(a, pairs, "a")) and same(ub, match.unpaired(b, pairs, "b")) and ua.where("pair = 'q'").count() == 3


def test_query_unpaired_matches_once(spark):
    found = queries.unpaired(spark, SF)
    assert "MapInArrow" not in plan(found) and "collect_list" not in plan(found)


def test_similarity_percent_in_the_order_of_the_file(spark, tmp_path):
    """Of shares that come to half percents, in a file that several tasks read: as SQL sums them in one thread."""
    draw, n = np.random.default_rng(11), 60_000
    keys, shares = pa.array(draw.integers(0, n // 6, n)), pa.array(draw.integers(0, 11, n) / 100)
    pq.write_table(pa.table({"l_orderkey": keys, "l_discount": shares}), f"{tmp_path}/lineitem.parquet", row_group_size=5_000)
    duck = duckdb.connect()
    duck.sql("set threads = 1")
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    cut, usual = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(cut, "32k")
    try:
        found = queries.similarity_percent(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(cut, usual)
    assert sorted(map(tuple, found)) == sorted(duck.sql(ORACLE_SQL["similarity_percent"]).fetchall())
