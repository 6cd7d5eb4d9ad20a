import hashlib
import math
from collections import Counter

import pyarrow as pa
import pytest

from resonara.llm.exact import exact_dedup, thinned
from resonara.llm.mixing import mix_sources, target_rates

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_exact_keeps_least_id_and_all_columns(spark):
    rows = [(5, "a  b", "x", 1), (3, "a b ", "y", 2), (3, "a b", "z", 3), (7, "A b", "x", 4), (8, "", "x", 5), (9, "  ", "x", 6), (10, None, "x", 7), (11, None, "x", 8), (None, "a b", "x", 9), (None, "q", "x", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, norm string, rank int").withColumnsRenamed({})
    got = exact_dedup(df)
    assert got.columns == df.columns
    ids = sorted((r.doc_id, r.rank) for r in got.collect() if r.doc_id is not None)
    assert [i for i, _ in ids] == [3, 7, 8, 10, 11] and dict(ids)[8] == 5
    assert [r.rank for r in got.collect() if r.doc_id is None] == [10]


def test_exact_long_texts_empty_table_and_clashing_names(spark):
    long = "word " * 60_000
    df = spark.createDataFrame([(1, long + "a", 0, 0, 0), (2, long + "b", 0, 0, 0), (3, long + "a", 0, 0, 0)], "doc_id long, text string, head int, spread int, r int")
    assert sorted(r.doc_id for r in exact_dedup(df).collect()) == [1, 2]
    assert exact_dedup(df.limit(0)).count() == 0


def test_batches_lose_their_own_copies_only():
    norm, ids = ["b", "a", "b", None, None, "a", "b", ""], [4, None, 2, 1, 1, 7, 2, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(norm), pa.array(ids)], names=["r", "norm", "id"])
    assert [r for b in thinned([batch, batch.slice(0, 0)]) for r in b.column(0).to_pylist()] == [2, 3, 4, 5, 7]
    words = pa.RecordBatch.from_arrays([pa.array(range(3)), pa.array(["x", "x", "y"]), pa.array(["q", "p", None])], names=["r", "norm", "id"])
    assert [b.column(0).to_pylist() for b in thinned([words])] == [[1, 2]]


def test_exact_many_copies_against_brute_force(spark):
    rows = [(i * 7919 % 5000, f"text {i % 3}" if i % 5 else f"own {i}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    want = {}
    for i, t, _ in rows:
        want[t] = min(i, want.get(t, i))
    assert sorted((r.doc_id, r.text) for r in exact_dedup(df).collect()) == sorted((i, t) for t, i in want.items())


def test_mixing_very_long_texts_and_repeated_rows(spark):
    rows = [(1, "word " * 100_000, "en", "a", 0), (2, "x", "en", "b", 0)] + [(3, "same", "en", "b", 0)] * 4
    df = spark.createDataFrame(rows, DOCS)
    got = mix_sources(df, {"a": 0.5, "b": 0.5}, budget=6.0)
    n = Counter(r.doc_id for r in got.collect())
    rates = {r.src: r.rate for r in target_rates(df, {"a": 0.5, "b": 0.5}, budget=6.0).collect()}
    assert n[1] == draws(20240, 1, rates["a"]) and rates["a"] == pytest.approx(6.0 * 0.5 * 500_017 / 500_000)
    assert n[3] % 4 == 0  # repeated rows share a draw
    assert all(len(r.text) == 500_000 for r in got.collect() if r.doc_id == 1)


def draws(seed, ident, mean):
    u = int(hashlib.md5(f"{seed}|{ident}|1".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-mean)
    c = p
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mixing_equals_brute_force(spark):
    rows = [(i, "x" * (10 + i % 7), "en", f"s{min(i % 5, 2)}" if i % 11 else None, 0) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    rates = {r.src: r.rate for r in target_rates(df).collect()}
    want = Counter({r[0]: n for r in rows if (n := draws(20240, r[0], rates[r[3]]))})
    got = mix_sources(df)
    assert Counter(r.doc_id for r in got.collect()) == want
    assert all(sorted(x.copy_index for x in got.collect() if x.doc_id == d) == list(range(1, n + 1)) for d, n in list(want.items())[:5])
    mass = {s: sum(len(r[1]) for r in rows if r[3] == s) for s in rates}
    total, sq = sum(mass.values()), sum(v**0.5 for v in mass.values())
    for s, m in mass.items():
        assert rates[s] == pytest.approx(m**0.5 / sq * total / m)


def test_mixing_weights_large_means_and_edges(spark):
    df = spark.createDataFrame([(1, "ab", "en", "a", 2), (2, "c", "en", "b", 1), (3, None, "en", "a", 0), (None, "", "en", "a", 0)], DOCS)
    n = Counter(r.doc_id for r in mix_sources(df, {"a": 1.0}, budget=2000.0, copy_col=None).collect())
    assert set(n) == {1, 3, None} and all(2700 < v < 3300 for v in n.values())
    assert mix_sources(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "0 as copy_index", "1 as ident", "2 as rate")
    assert mix_sources(clash, budget=3.0).columns == [*clash.columns, "copy_index_"]
