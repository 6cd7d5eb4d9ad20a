import random

import pandas as pd
import pytest

from resonara.llm.tokens import RANKS, boundaries, chunk_bounds, encoding, splice, token_counts


def whole(text):
    return len(encoding(RANKS)[0].encode_ordinary(text))


def chunked(text, chunk, overlap):
    rows = []
    for s, e in chunk_bounds(len(text), chunk, overlap):
        at, n = boundaries(text[s:e], RANKS)
        at = at + s
        head, tail = at <= s + overlap, at >= e - overlap
        rows.append({"start": s, "end": e, "n": int(n[-1]) if len(n) else 0, "head_at": at[head], "head_n": n[head], "tail_at": at[tail], "tail_n": n[tail]})
    return splice(pd.DataFrame(rows), len(text))


def test_splices_equal_whole_encoding():
    rng = random.Random(8)
    parts = ["the", "Über", "l'eau", " we'll", "they've", "\n\n", "   ", "\t", "1234567", "x9", "!?", "...", "日本語テキスト", "é", "🙂", "can't", " a", "'", "''s", "ção"]
    failed = 0
    for k in range(300):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(40, 400)))
        n = chunked(text, 160, 40)
        failed += n is None
        assert n is None or n == whole(text), k
    assert failed < 150


def test_no_common_boundary_is_told():
    assert chunked("a" * 1000, 160, 40) is None
    assert chunked(" " * 1000, 160, 40) is None


def test_operator_with_widening(spark):
    rng = random.Random(3)
    words = ["alpha", "beta's", "Gamma", "123", "ñandú", "\n"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (3, 200, 900, 2500)] + ["a" * 3000, "ab " * 900 + "z" * 2000 + " cd" * 500, "", None, "日本" * 1500, " " * 2500]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(2, texts[2], 0), (None, texts[3], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = token_counts(df, huge_chars=500, chunk_chars=256, overlap_chars=32).collect()
    want = sorted((-1 if i is None else i, -1 if t is None else len(t), -1 if t is None else whole(t)) for i, t, _ in rows)
    assert sorted(tuple(-1 if v is None else v for v in (r.doc_id, r.n_chars, r.n_tokens)) for r in got) == want
    assert token_counts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_counts(df, chunk_chars=100, overlap_chars=50)
