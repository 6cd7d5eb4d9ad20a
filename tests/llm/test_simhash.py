import random

import numpy as np

from resonara.llm.common import Shelf
from resonara.llm.simhash import components, drop_near_duplicates, near_duplicates, near_groups, near_pairs, segment_bounds, signatures

M = (1 << 64) - 1


def flips(sig, n, rng):
    x = (sig[0] & M) << 64 | sig[1] & M
    for k in rng.sample(range(128), n):
        x ^= 1 << k
    return tuple(v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & M))


def far(a, b):
    return ((a[0] ^ b[0]) & M).bit_count() + ((a[1] ^ b[1]) & M).bit_count()


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    base = [tuple(rng.randrange(-(1 << 63), 1 << 63) for _ in range(2)) for _ in range(60)]
    sigs = list({*base, *[flips(b, n, rng) for b in base for n in (1, 2, 5, 8, 11, 11, 14, 20)]})
    df = spark.createDataFrame(sigs, "s0 long, s1 long")
    for segments in (4, 6, 8):
        rows = near_pairs(df, segments, 20).collect()
        got = {((r.a0, r.a1), (r.b0, r.b1)): r.distance for r in rows}
        assert len(got) == len(rows)  # each pair once
        brute = {(a, b): far(a, b) for a in sigs for b in sigs if a < b and far(a, b) <= 20}
        assert all(brute[p] == d for p, d in got.items())
        certain = {p for p, d in brute.items() if d <= 2 * segments - 1}
        assert certain and certain <= set(got)
        shares = {p for p in brute if any((((((p[0][0] & M) << 64 | p[0][1] & M) ^ ((p[1][0] & M) << 64 | p[1][1] & M)) >> (128 - f - w)) & ((1 << w) - 1)).bit_count() <= 1 for f, w in segment_bounds(segments))}
        assert shares == set(got)


def test_recall_of_near_texts_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(4000)]
    texts = []
    for _ in range(80):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        texts.append(" ".join(words))
        for _ in range(3):
            w = list(words)
            for k in rng.sample(range(len(w)), max(1, len(w) // 40)):
                w[k] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    sigs = signatures(texts)
    brute = {(a, b) for a in range(len(texts)) for b in range(a) if far(sigs[a], sigs[b]) <= 20}
    root = {r.doc_id: r.group_id for r in near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(a in root and b in root and root[a] == root[b] for a, b in brute)
    assert len(brute) > 200 and found / len(brute) >= 0.95
    planted = [(4 * k, 4 * k + j) for k in range(80) for j in (1, 2, 3)]
    assert sum(a in root and b in root and root[a] == root[b] for a, b in planted) / len(planted) >= 0.9
    assert all(a // 4 == g // 4 for a, g in root.items())


def test_components_of_paths_and_cycles(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10_000), 300)
    edges = [(a, b) for k in range(0, 300, 50) for a, b in zip(ids[k : k + 50], ids[k + 1 : k + 50])] + [(ids[0], ids[49]), (ids[7], ids[7])]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), Shelf(spark, "t")).collect()}
    for k in range(0, 300, 50):
        part = ids[k : k + 50]
        assert all(got[i] == min(part) for i in part if i != min(part))


def test_edges_and_removal(spark):
    text = " ".join(f"distinctive{i}" for i in range(40))
    rows = [(4, text, 1), (2, text, 2), (9, text + " tail", 3), (5, None, 4), (6, "", 5), (7, "!!!", 6), (8, "!!!", 7), (None, text, 8), (10, "one two", 9), (11, "two one", 10), (12, "one two", 11), (12, "one two", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s0 int")
    assert {(r.doc_id, r.keep_id) for r in near_duplicates(df).collect()} == {(4, 2), (9, 2), (12, 10)}
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(r.s0 for r in left.collect()) == [2, 4, 5, 6, 7, 8, 9, 10]
    assert near_duplicates(df.limit(0)).count() == 0 and drop_near_duplicates(df.limit(0)).count() == 0
    assert signatures(["x " * 100_000, None])[1] is None and isinstance(np.int64(signatures(["a b"])[0][0]), np.int64)


def test_distance_rises_evenly_with_the_number_of_long_words():
    """One long word against a short one: no number of long words makes near texts far ones."""
    rng = random.Random(3)
    for n in range(12, 21):
        apart = []
        for _ in range(40):
            words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)] + [f"w{k}" for k in range(20)]
            other = [*words[: n - 1], "ab", *words[n:]]
            a, b = signatures([" ".join(words), " ".join(other)])
            apart.append(far(a, b))
        assert 6 <= sum(apart) / len(apart) <= 20, n


def test_signature_against_plain_arithmetic():
    from hashlib import md5

    for text in ("a", "one two", "One, two; one THREE three one two " * 3, "ab " * 50):
        words = text.lower().replace(",", "").replace(";", "").split()
        h = lambda w: int(md5(w.encode()).hexdigest(), 16)
        turn = lambda x: sum(((v << 1 | v >> 63) & M) << s for v, s in ((x >> 64, 64), (x & M, 0)))
        feats = [(h(w), min(6, max(1, len(w) - 1))) for w in set(words)] + [(turn(h(a)) ^ h(b), 1) for a, b in set(zip(words, words[1:]))]
        want = sum((2 * sum(w for x, w in feats if x >> k & 1) > sum(w for _, w in feats)) << k for k in range(128))
        a, b = signatures([text])[0]
        assert (a & M) << 64 | b & M == want


def test_no_table_of_near_groups_passes_through_the_driver(spark, monkeypatch):
    plans, put = [], Shelf.put

    def kept(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df)

    monkeypatch.setattr(Shelf, "put", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        text = " ".join(f"distinctive{i}" for i in range(40))
        rows = near_groups(spark.createDataFrame([(1, text), (2, text + " tail"), (3, "other words"), (4, text)], "doc_id long, text string"))
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        assert {(r.doc_id, r.group_id) for r in rows.collect()} == {(1, 1), (2, 1), (4, 1)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_keys_of_a_small_table_are_not_broadcast(spark):
    sigs = Shelf(spark, "t").put(spark.createDataFrame([(1, 2), (1, 3), (5, -9)], "s0 long, s1 long"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        pairs = near_pairs(sigs)
        assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert [(r.a1, r.b1, r.distance) for r in pairs.collect()] == [(2, 3, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
