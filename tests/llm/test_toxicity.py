import itertools

import duckdb
import numpy as np
import pytest

from resonara.llm.toxicity import WORD, chain, drop_toxic, features, fit, fitted, labelled_sample, spans_of, toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    lens = np.array([4, 1, 6, 2])
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    d, tr, first = rng.normal(size=lens.sum()), rng.normal(size=(2, 2)), 0.4
    fw, bw = chain(np.exp(d), starts, lens, np.exp(tr), np.exp(first))
    p = fw * bw / (1 + fw * bw)
    for s, n in zip(starts, lens):
        total, hot = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(first * tags[0] + sum(d[s + i] * t for i, t in enumerate(tags)) + sum(tr[a, b] for a, b in zip(tags, tags[1:])))
            total += w
            hot += w * np.array(tags)
        assert np.allclose(p[s : s + n], hot / total)


def test_held_out_accuracy():
    rows = duckdb.sql("select text, toxic from '/root/testdata/sf0.1/documents.parquet' join '/root/testdata/sf0.1/labels.parquet' using (doc_id) order by hash(doc_id)").fetchall()
    train, held = rows[:1500], rows[1500:]
    m = fit([t for t, _ in train], [y for _, y in train])
    found = np.array([s >= m.threshold for s, _ in m.tagger()([t for t, _ in held])])
    y = np.array([y for _, y in held]) == 1
    assert (found == y).mean() > 0.97 and found[y].mean() > 0.7 and found[~y].mean() < 0.02  # a tenth of the toxic labels is wrong


def test_spans_are_offsets():
    text = "Ab cd, EF gh"
    assert spans_of(text, np.array([1, 2])) == [(3, 9)] and text[3:9] == "cd, EF"
    assert [m.group() for m in WORD.finditer("a-b")] == ["a", "b"]


def docs(spark):
    bad, good = "you stupid moron number{} is w{} x{}", "you calm river number{} is w{} x{}"
    rows = [(i, (bad if i % 4 == 0 else good).format(i, i * 3, i * 7), "keep") for i in range(160)]
    return spark.createDataFrame([*rows, (900, None, "k"), (901, "", "k"), (902, "What a STUPID idea", "k"), (902, "What a STUPID idea", "k"), (None, "fine", "k")], "doc_id long, text string, toxic_score string")


def test_operator_and_edges(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)] + [(5, 1, 1), (None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity(df, labels)
    assert got.columns == ["doc_id", "text", "toxic_score", "toxic_score_", "is_toxic", "toxic_spans"]
    rows = got.collect()
    assert len(rows) == 165
    for r in rows:
        wanted = r.text is not None and ("stupid" in r.text.lower())
        assert r.is_toxic == wanted
        assert all("stupid" in r.text[s.start : s.end].lower() or "moron" in r.text[s.start : s.end] for s in r.toxic_spans)
    left = drop_toxic(df, labels)
    assert left.columns == df.columns and left.count() == sum(not r.is_toxic for r in rows)
    assert not any(r.is_toxic for r in toxicity(df, labels.where("toxic = 0")).collect())
    assert toxicity(df, labels.limit(0)).where("is_toxic").count() == 0
    assert toxicity(df.limit(0), labels).count() == 0


def brute(model, text):
    """Score and spans of a text from the probabilities of all its taggings."""
    words = list(WORD.finditer(text.lower()))
    d = [model.bias + sum(model.weights.get(f, 0.0) for f in features(m.group())) for m in words]
    total, hot = 0.0, np.zeros(len(words))
    for tags in itertools.product((0, 1), repeat=len(words)):
        w = np.exp(model.start * tags[0] + sum(x * t for x, t in zip(d, tags)) + sum(model.transition[a][b] for a, b in zip(tags, tags[1:])))
        total += w
        hot += w * np.array(tags)
    p, spans = hot / total, []
    for k in np.flatnonzero(p >= 0.5):
        if k and p[k - 1] >= 0.5:
            spans[-1] = (spans[-1][0], words[k].end())
        else:
            spans.append(words[k].span())
    return p.sum() / (p.sum() + 0.5 + 2 * model.noise * len(words)), spans


def test_scores_and_spans_against_enumeration(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    train = docs(spark)
    model = fitted(labelled_sample(train, labels, 1000, 1_000_000))
    texts = ["you stupid moron", "a calm river", "What a STUPID, moron idea; you calm moron", "fine", "stupid " * 9, "is w1 x2 stupid"]
    rows = spark.createDataFrame([(i + 10_000, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, toxic_score string")
    got = {r.doc_id - 10_000: r for r in toxicity(train.unionByName(rows), labels).collect() if r.doc_id is not None and r.doc_id >= 10_000}
    for i, t in enumerate(texts):
        score, spans = brute(model, t)
        assert got[i].toxic_score_ == pytest.approx(score, rel=1e-9) and 0 < score < 1
        assert [tuple(s) for s in got[i].toxic_spans] == spans
        assert got[i].is_toxic == (score >= model.threshold)
    clean = {got[i].toxic_score_ for i in (1, 3)}
    assert len(clean) == 2  # all marginals count, also where nothing is flagged


def test_a_score_at_the_cut_is_toxic_and_long_texts_keep_their_scores():
    texts = [f"you {'stupid moron' if i < 60 else 'calm river'} number{i} is w{i * 3} x{i * 7}" for i in range(160)]
    m = fit(texts, [1] * 60 + [0] * 100)
    (score, _), (long_bad, spans), (long_clean, none) = m.tagger()([texts[1], "calm river " * 5_000 + "stupid moron " * 30, "calm river " * 50_000])
    assert long_bad > m.threshold > long_clean and len(spans) == 1 and none == [] and spans[0][0] == 55_000
    m.threshold = score
    assert m.tagger()([texts[1]])[0][0] >= m.threshold


def test_sample_is_bounded_in_characters(spark):
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    n = [labelled_sample(docs(spark), labels, 1000, c).count() for c in (1_000_000, 2000, 0)]
    assert n[0] == 120 and 20 < n[1] < 120 and n[2] == 0
