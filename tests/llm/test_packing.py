import bisect
import random
from collections import Counter, defaultdict

import corpus_pipeline
from pyspark.sql import functions as F

from resonara.llm.common import Shelf
from resonara.llm.packing import pack, pack_tokens, sweep
from resonara.llm.queries import op2_pack
from resonara.llm.tokens import RANKS, encoding

C = 128
SF = "/root/testdata/sf0.001"


def packed(spark, sizes, capacity=C):
    df = spark.createDataFrame([(i, str(n)) for i, n in enumerate(sizes)], "doc_id long, text string")
    return pack(df, capacity, length=lambda t: F.coalesce(t.cast("bigint"), F.lit(0))).collect()


def best_fit_decreasing(sizes, capacity=C):
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, s)
        if k == len(gaps):
            n += 1
            bisect.insort(gaps, capacity - s)
        else:
            bisect.insort(gaps, gaps.pop(k) - s)
    return n


def check(rows, sizes, capacity=C):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append((r.bin_offset, r.n_tokens))
        docs[r.doc_id].append((r.piece, r.n_tokens))
    for spans in bins.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    for i, n in enumerate(sizes):
        got = sorted(docs.get(i, []))
        assert sum(x for _, x in got) == n and [k for k, _ in got] == list(range(len(got)))
        assert all(x == capacity for _, x in got[:-1])
    return len(bins)


def test_every_piece_once_and_near_sequential_best_fit(spark):
    rng = random.Random(1)
    for sizes in ([rng.randint(1, C) for _ in range(600)], [rng.choice((5, 43, 64, 90)) for _ in range(500)], [min(5 * C, int(rng.expovariate(0.02)) + 1) for _ in range(500)]):
        n = check(packed(spark, sizes), sizes)
        full, rest = sum(s // C for s in sizes), [s % C for s in sizes if s % C]
        assert n <= 1.03 * (full + best_fit_decreasing(rest)) + 1


def test_only_small_ones_ties_and_edges(spark):
    assert check(packed(spark, [3] * 1000), [3] * 1000) <= 30
    assert check(packed(spark, [C] * 7 + [3 * C]), [C] * 7 + [3 * C]) == 10
    assert check(packed(spark, [C // 2] * 9), [C // 2] * 9) == 5
    assert packed(spark, []) == []
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "1 as item", "2 as bin", "3 as size")
    rows = pack(df).collect()
    assert sorted((r.n_tokens for r in rows if r.doc_id), key=int) == [1, 1, 1]
    assert sum(r.n_tokens for r in rows if r.doc_id is None) == 25_001


def test_sweep_gives_each_document_the_least_free_gap(spark):
    rng = random.Random(4)
    gaps = [(1000 + i, rng.randint(1, 60)) for i in range(80)]
    items = [(i, rng.randint(31, 60)) for i in range(120)]
    free, want = sorted(g for _, g in gaps), []
    for _, s in sorted(items, key=lambda x: -x[1]):
        k = bisect.bisect_left(free, s)
        want.append((s, free.pop(k) if k < len(free) else None))
    gap, each = dict(gaps), []
    for parts in (1, 2, 5, 40):
        rows = sweep(spark.createDataFrame(items, "item long, size long"), spark.createDataFrame(gaps, "bin long, gap long"), 60, C, parts, Shelf(spark, "t")).collect()
        got = {r.item: r.bin for r in rows}
        assert len(rows) == len(items) and sorted((s, gap.get(got[i]) or 0) for i, s in items) == sorted((s, g or 0) for s, g in want)
        assert all(got[i] == i for i, _ in items if got[i] is not None and got[i] not in gap)
        each.append(got)
    assert all(got == each[0] for got in each)


def test_one_packing_for_any_number_of_partitions(spark):
    rng = random.Random(11)
    df = spark.createDataFrame([(rng.randrange(300), str(min(3 * C, int(rng.expovariate(0.03)) + 1))) for _ in range(700)], "doc_id long, text string")
    number = lambda t: F.coalesce(t.cast("bigint"), F.lit(0))
    got = [Counter(map(tuple, pack(df.repartition(n), C, length=number, part_rows=rows).collect())) for n, rows in ((1, 50_000), (6, 40))]
    assert got[0] == got[1]


def test_registered_uses_pack_real_tokens(spark):
    """Every document's pieces add up to its tokens and an end token, and no sequence holds more of them than the capacity."""
    enc, _ = encoding(RANKS)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += 1 + len(enc.encode_ordinary(r.text or ""))
    for rows in (op2_pack(spark, SF).collect(), corpus_pipeline.packing_stage(spark, docs, SF).collect()):
        got, full = Counter(), Counter()
        for r in rows:
            got[r.doc_id] += r.n_tokens
            full[r.bin_id] += r.n_tokens
        assert got == want and max(full.values()) <= 2048


def test_tokens_of_null_empty_huge_and_repeated_rows(spark):
    enc, _ = encoding(RANKS)
    huge = "один два three " * 4000
    df = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, huge), (None, huge)], "key long, n_tokens string")
    rows = pack_tokens(df, id_col="key", text_col="n_tokens").collect()
    assert [r.n_tokens for r in rows if r.doc_id] == [1, 1, 1]
    assert sum(r.n_tokens for r in rows if r.doc_id is None) == 2 * (1 + len(enc.encode_ordinary(huge)))
