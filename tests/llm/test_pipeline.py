import os
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from resonara.llm.common import shared_folder, table
from resonara.llm.mixing import target_rates
from resonara.llm.queries import ORACLE_SQL, QUERIES
from resonara.llm.simhash import signatures
from resonara.llm.tokens import RANKS, encoding
from resonara.llm.toxicity import toxicity

from .test_exact_mixing import draws
from .test_simhash import far

SF = "/root/testdata/sf0.001"


def near_brute(rows):
    """Rows but those whose group, by all pairs of signatures within 11 bits or that share a segment, has a smaller identifier; certain pairs and allowed ones."""
    sigs = [(r.doc_id, s) for r, s in zip(rows, signatures([r.text for r in rows])) if s is not None]
    return {(a, b): far(x, y) for i, (a, x) in enumerate(sigs) for b, y in sigs[:i] if far(x, y) <= 22}


def roots(ids, pairs):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.collect()
    first = table(spark, SF, "documents")
    clean = {r.doc_id for r in toxicity(first, table(spark, SF, "labels")).where("not is_toxic").collect()}
    assert {r.doc_id for r in kept["toxicity"]} == clean and len(kept["toxicity"]) > 0.7 * first.count()
    least = {}
    for r in kept["toxicity"]:
        t = re.sub(r"\s+", " ", r.text).strip()
        least[t] = min(r.doc_id, least.get(t, r.doc_id))
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(least.values())
    ids = [r.doc_id for r in kept["exact_dedup"]]
    pairs = near_brute(kept["exact_dedup"])
    most = {i for i, g in roots(ids, pairs).items() if i == g}
    certain = {i for i, g in roots(ids, [p for p, d in pairs.items() if d <= 11]).items() if i == g}
    near = {r.doc_id for r in kept["near_dedup"]}
    assert most <= near <= certain and len(near) == len(kept["near_dedup"]) and len(near) < len(ids)
    rates = {r.src: r.rate for r in target_rates(spark.createDataFrame(kept["near_dedup"], docs_schema(spark))).collect()}
    want = Counter({r.doc_id: n for r in kept["near_dedup"] if (n := draws(20240, r.doc_id, rates[r.source]))})
    assert Counter(r.doc_id for r in kept["mixing"]) == want
    enc, _ = encoding(RANKS)
    tokens, got, full = Counter(), Counter(), Counter()
    for r in kept["mixing"]:
        tokens[r.doc_id] += 1 + len(enc.encode_ordinary(r.text or ""))
    for r in kept["packing"]:
        got[r.doc_id] += r.n_tokens
        full[r.bin_id] += r.n_tokens
    assert got == tokens and max(full.values()) <= 2048


def docs_schema(spark):
    return table(spark, SF, "documents").schema


def test_run_gives_the_stages_result_and_leaves_one_table(spark):
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    rows = corpus_pipeline.run(spark, SF)
    made = set(os.listdir(folder)) - before
    assert len(made) == 1 and [x for x in os.listdir(f"{folder}/{made.pop()}") if not x.startswith(".")] == ["4-packing"]
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
    want = corpus_pipeline.packing_stage(spark, docs, SF)
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, want.collect())) and rows.count() > 0


def test_stages_on_nulls_clashing_columns_and_repeated_rows(spark):
    long = "word " * 60_000
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " ", "en", "a", 1), (4, long, "en", "a", 1), (5, long + "x", "de", "b", 2), (6, "same text here", None, "b", 3), (6, "same text here", None, "b", 3), (7, "same  text here", "en", "b", 3), (None, "same text here", "en", "b", 3)]
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, is_toxic string, rank int, own int, id int")
    out = {name: stage(spark, df, SF) for name, stage in corpus_pipeline.STAGES}
    assert all(out[n].columns == df.columns for n in list(out)[:4])
    ids = lambda d: sorted((-1 if r.doc_id is None else r.doc_id) for r in d.collect())
    assert ids(out["toxicity"]) == [-1, -1, 1, 2, 3, 4, 5, 6, 6, 7]
    assert ids(out["exact_dedup"]) == [-1, 1, 2, 4, 5, 6]
    assert ids(out["near_dedup"]) == [-1, -1, 1, 2, 3, 4, 6, 6]
    assert set(ids(out["mixing"])) <= {-1, 1, 2, 3, 4, 5, 6, 7}
    assert len({(r.doc_id, r.piece, r.bin_id, r.bin_offset) for r in out["packing"].collect()}) == out["packing"].count() >= 10
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), SF).count() == 0


def test_toxicity_stage_without_labels(spark, tmp_path):
    labels = table(spark, SF, "labels")
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for k, some in enumerate((labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int")), labels.where("toxic = 1"))):
        some.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert corpus_pipeline.toxicity_stage(spark, df, f"{tmp_path}/{k}").count() == 2


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5
