import math
import random
from collections import Counter

from resonara.llm.topk import TERM, top_k


def brute(queries, docs, k):
    bags = [(i, Counter(TERM.findall((t or "").lower()))) for i, t in docs]
    n, mean = len(docs), sum(sum(b.values()) for _, b in bags) / len(docs)
    df = Counter(t for _, b in bags for t in b)
    out = set()
    for q, text in queries:
        scored = []
        for i, bag in bags:
            s, dl = 0, sum(bag.values())
            for t, m in Counter(TERM.findall((text or "").lower())).items():
                if t in bag and i is not None:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    s += m * math.floor(1000 * idf * (bag[t] * 2.2) / (bag[t] + 1.2 * (0.25 + 0.75 * dl / mean)) + 0.5)
            if s > 0:
                scored.append((-s, i))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_equals_brute_force_with_ties_and_passes(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(15)] + [(None, "w1 w2"), (2000, None), (2001, ""), (2002, "w1, W1! " * 5000)]
    queries = [(q, " ".join(rng.choices([*words, "nowhere"], k=rng.randint(1, 6)))) for q in range(40)] + [(90, "nowhere"), (91, ""), (92, None), (93, docs[5][1] + " " + docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as score", "2 as term").repartition(7)
    q = spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "1 as query_id")
    want = brute(queries, docs, 10)
    for at_once in (20000, 9):
        got = {(r.query_id, r.rank, r.doc_id, r.score) for r in top_k(q, d, queries_at_once=at_once).collect()}
        assert got == want
    assert top_k(q, d.limit(0)).count() == 0 and top_k(q.limit(0), d).count() == 0
    null_q = spark.createDataFrame([(None, "w1"), (1, "w1"), (1, "w1"), (1, "w2")], "item_id long, text string")
    got = top_k(null_q, d, k=3).collect()
    assert {(r.query_id, r.query_no, r.rank) for r in got} == {(1, n, r) for n in (1, 2, 3) for r in (1, 2, 3)}
    of = lambda n: [(r.rank, r.doc_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_no == n]
    assert of(1) == of(2) != of(3) and of(3) == [x[1:] for x in sorted(brute([(1, "w2")], docs, 3))]


def test_identifiers_of_any_type_and_repeated_ones(spark):
    rows = [(i, f"w{i % 3} w{i % 5}") for i in range(40)] + [(7, "w1 w1"), (7, "w1 w1")]
    want = {(r, i, s) for _, r, i, s in brute([(1, "w1 w2")], rows, 10)}
    base = spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([("one", "w1 w2")], "item_id string, text string")
    for cast in ("smallint", "decimal(9,0)", "int"):
        assert {(r.rank, int(r.doc_id), r.score) for r in top_k(q, base.withColumn("doc_id", base.doc_id.cast(cast))).collect()} == want, cast
    names = base.selectExpr("lpad(doc_id, 3, '0') as doc_id", "text")
    assert {(r.rank, int(r.doc_id), r.score) for r in top_k(q, names).collect()} == want
    raw = names.selectExpr("cast(doc_id as binary) as doc_id", "text")
    assert {(r.rank, int(bytes(r.doc_id)), r.score) for r in top_k(q, raw).collect()} == want
