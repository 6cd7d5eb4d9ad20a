import math
import random
from collections import Counter

import numpy as np
import pytest

from resonara.llm import lm
from resonara.llm.lm import TOKEN, Block, listed, lm_score, numbered_words, ordered, squeeze, unsqueeze

MU = 4.0


def framed(text):
    return [None, None, *TOKEN.findall(text or ""), "\n"]


def grams(texts):
    return Counter(tuple(w[i - k : i + 1]) for w in map(framed, texts) for i in range(2, len(w)) for k in range(3))


def brute(corpus, texts, leave_out):
    """Log probability of each text, by recursion over dictionaries of counts."""
    whole = grams(corpus)
    out = []
    for t in texts:
        n = whole - grams([t]) if leave_out else whole
        docs, signs = len(corpus) - leave_out, sum(v for g, v in n.items() if len(g) == 1)
        spell = lambda w: -8 * math.log(2) * (1 if w == "\n" else len(w.encode()) + 1)

        def logp(h, w):
            if not n[h + (w,)]:
                weight = signs if not h else docs if h[-1] is None else n[h]
                return math.log(MU / (weight + MU)) + (logp(h[1:], w) if h else spell(w))
            below = math.exp(logp(h[1:], w)) if h else math.exp(spell(w))
            return math.log((n[h + (w,)] + MU * below) / ((signs if not h else docs if h[-1] is None else n[h]) + MU))

        w = framed(t)
        out.append(sum(logp(tuple(w[i - 2 : i]), w[i]) for i in range(2, len(w))))
    return out


def sample():
    rng = random.Random(7)
    words = ["the", "cat", "sat,", "é", "on.", "a", "mat!", "日本", "x1", "under_score"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)] + ["", None, "  \n", "one off", "abc " * 3000, "z" * 5000, "the cat " * 1500]


@pytest.mark.parametrize("words", [1_000_000, 200])
def test_equals_brute_force_without_own_counts(spark, monkeypatch, words):
    monkeypatch.setattr(lm, "BUCKET_CHARS", words)
    texts = sample()
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "the cat"), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "2 as code", "3 as block").repartition(3)
    got = lm_score(df).collect()
    assert len(got) == len(rows)
    want = dict(zip((i for i, _ in rows), brute([t for _, t in rows], [t for _, t in rows], True)))
    for r in got:
        size = len((texts[r.doc_id] if r.doc_id is not None else "the cat") or "") and len((texts[r.doc_id] if r.doc_id is not None else "the cat").encode())
        assert r.n_bytes == size
        assert r.log_prob == pytest.approx(want[r.doc_id], rel=1e-9)
        assert r.bits_per_byte == pytest.approx(-want[r.doc_id] / math.log(2) / (size + 1), rel=1e-9)


def test_texts_under_another_corpus(spark):
    texts = sample()
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:30])], "doc_id long, text string").repartition(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.log_prob for r in lm_score(docs, corpus).collect()}
    for i, w in enumerate(brute(texts[:30], texts, False)):
        assert got[i] == pytest.approx(w, rel=1e-9)
    assert lm_score(docs.limit(0), corpus).count() == 0
    assert lm_score(docs, corpus.limit(0)).where("doc_id = 63").first().log_prob == pytest.approx(9 * math.log(1 / 256))


def test_copies_and_single_rows(spark):
    one = spark.createDataFrame([(1, "never seen before")], "doc_id long, text string")
    assert lm_score(one).first().log_prob == pytest.approx((6 + 5 + 7 + 1) * math.log(1 / 256))
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text), (3, " ".join(f"v{i}" for i in range(50)))]
    bits = {r.doc_id: r.bits_per_byte for r in lm_score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert bits[1] == bits[2] < bits[3] / 2
    strings = spark.createDataFrame([("a", "x y"), ("b", "x y")], "doc_id string, text string")
    assert {r.doc_id for r in lm_score(strings).collect()} == {"a", "b"}


def test_squeezed_numbers_come_back():
    for x in ([], [0], [1, 2**64 - 1, 7], list(range(1000))):
        assert unsqueeze(squeeze(np.array(x, np.uint64))).tolist() == x


def test_order_by_upper_bits_and_place():
    rng = np.random.default_rng(4)
    for bits in (8, 40, 54, 64):
        for n in (1, 2, 3, 1000, 5000):
            x = rng.integers(0, 1 << 63, n, np.uint64) << np.uint64(1) >> np.uint64(64 - bits)
            some = rng.integers(0, n, n // 2)
            x[: n // 2] = x[some] ^ rng.integers(0, 3, n // 2, np.uint64)  # alike above, other below, and equal
            assert ordered(x, bits).tolist() == np.argsort(x, kind="stable").tolist()


def test_counts_of_a_block_against_counting():
    texts = [t or "" for t in sample()]
    for bits in (6, 45, 64):  # at 6 sequences of all lengths share hashes
        block = Block(texts)
        grams = block.grams >> np.uint64(64 - bits)
        codes, n, inverse, own = listed(block, bits, True)
        doc = np.repeat(np.arange(len(texts)), block.lens)
        assert (codes[inverse] == grams).all() and codes[0] == 0 and n[0] == grams.shape[1]
        assert dict(zip(codes[1:].tolist(), n[1:].tolist())) == Counter(grams.ravel().tolist())
        for row, got in zip(grams.tolist(), own.tolist()):
            there = Counter(zip(doc.tolist(), row))
            assert got == [there[key] for key in zip(doc.tolist(), row)]


def test_words_are_those_of_the_pattern():
    rng = random.Random(8)
    odd = "a_9é日ß\u0301²Ⅷ𝟘😀!-.  \t\n\r\f\v\xa0\u2028\x00\x1c"
    texts = ["", *("".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(400)), "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000, 7)])), "", "ab", "cd", ""]
    for some in (texts, [""], ["", ""], [" "], texts[:40]):
        index, raw, lens = numbered_words(some)
        want = [TOKEN.findall(t) for t in some]
        assert lens.tolist() == list(map(len, want)) and raw[0] == b"" and len(set(raw)) == len(raw)
        assert [raw[i].decode() for i in index] == [w for ws in want for w in ws]
