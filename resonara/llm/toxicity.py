"""Toxic spans by a linear-chain conditional random field."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

WORD = re.compile(r"\w+")
#: Words whose chains are read side by side, about; texts are whole.
CHAIN_WORDS = 1_000_000
SCORES = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("toxic", T.BooleanType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


def features(word: str) -> list[str]:
    """Observation features of a word: itself and its beginnings."""
    return ["w" + word, *[f"p{word[:k]}" for k in (4, 5, 6) if len(word) >= k]]


def chain(ed: np.ndarray, starts: np.ndarray, lens: np.ndarray, tr: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of tag 1 against 0 at each token.

    ed: exp(emission of 1 - emission of 0) by token, sequences one after another; tr: exp(transition) 2 x 2;
    first: exp(start of 1 - start of 0). All sequences advance together, one position a step, longest first.
    """
    order = np.argsort(-lens, kind="stable")
    st, ln = starts[order], lens[order]
    fw, bw = np.ones(len(ed)), np.ones(len(ed))
    steps = int(ln[0]) if len(ln) else 0
    alive = np.searchsorted(-ln, -np.arange(steps), side="left")
    t00, t01, t10, t11 = tr[0, 0], tr[0, 1], tr[1, 0], tr[1, 1]
    r = np.zeros(0)
    for t in range(steps):
        at = st[: alive[t]] + t
        if t == 0:
            r = ed[at] * first
        else:
            r = r[: alive[t]]
            r = ed[at] * (t01 + t11 * r) / (t00 + t10 * r)
        r = np.clip(r, 1e-30, 1e30)
        fw[at] = r
    b = np.ones(len(st))
    for t in range(steps - 2, -1, -1):
        k = alive[t + 1]
        nxt = st[:k] + t + 1
        e = ed[nxt] * b[:k]
        b[:k] = np.clip((t10 + t11 * e) / (t00 + t01 * e), 1e-30, 1e30)
        bw[nxt - 1] = b[:k]
    return fw, bw


@dataclass
class ToxicModel:
    weights: dict[str, float]
    bias: float
    transition: list[list[float]]
    start: float
    noise: float
    threshold: float

    def score(self, mass, words):
        """Expected toxic words against half a one and twice those that as many clean words have: a clean text scores a third at most, about, however long it is."""
        return mass / (mass + 0.5 + 2 * self.noise * words)

    def tagger(self):
        """A function from texts to (score, spans) for each; words' emissions are kept from call to call."""
        weights, bias, score = self.weights, self.bias, self.score

        class Emissions(dict):
            def __missing__(self, w):
                if len(self) > 400_000:
                    self.clear()
                v = bias
                for f in features(w):
                    v += weights.get(f, 0.0)
                self[w] = v
                return v

        memo, tr, first = Emissions(), np.exp(np.array(self.transition)), float(np.exp(self.start))

        def tag(texts: list[str | None]) -> list[tuple[float, list[tuple[int, int]]]]:
            out: list[tuple[float, list[tuple[int, int]]]] = [(0.0, [])] * len(texts)
            held: list[np.ndarray] = []
            first_held = size = 0
            for i, t in enumerate(texts):  # words are held for one text, their emissions for CHAIN_WORDS
                held.append(np.fromiter(map(memo.__getitem__, WORD.findall(t.lower())), np.float64) if t else np.zeros(0))
                size += len(held[-1])
                if size >= CHAIN_WORDS or i == len(texts) - 1:
                    read(texts, out, first_held, held)
                    held, first_held, size = [], i + 1, 0
            return out

        def read(texts, out, begin: int, held: list[np.ndarray]) -> None:
            lens = np.fromiter(map(len, held), np.int64, len(held))
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            fw, bw = chain(np.exp(np.clip(np.concatenate(held), -30, 30)), starts, lens, tr, first)
            fw *= bw
            p = fw / (1 + fw)
            full = np.flatnonzero(lens)
            mass = np.add.reduceat(p, starts[full]) if len(full) else np.zeros(0)
            hot = np.flatnonzero(fw >= 1)
            cut = np.searchsorted(hot, np.concatenate([starts, [len(p)]]))
            for i, m in zip(full.tolist(), score(mass, lens[full]).tolist()):
                own = hot[cut[i] : cut[i + 1]] - starts[i]
                out[begin + i] = (m, spans_of(texts[begin + i], own) if len(own) else [])

        return tag


def spans_of(text: str, at: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in text of its words number at; neighbouring words are one span."""
    wanted, spans, last = set(at.tolist()), [], -2
    # lower() may change a text's length (a dotted capital I): words are then found in the lower-case text
    low = text.lower()
    for k, m in enumerate(WORD.finditer(text if len(low) == len(text) else low)):
        if k in wanted:
            if k == last + 1:
                spans[-1] = (spans[-1][0], m.end())
            else:
                spans.append((m.start(), m.end()))
            last = k
    return spans


def families(texts: list[str]) -> np.ndarray:
    """A number for each text; texts that share a least hash of their 4-word shingles are one family."""
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    seen: dict[tuple[int, int], int] = {}
    for i, text in enumerate(texts):
        w = WORD.findall(text.lower())
        h = np.array([zlib.crc32(" ".join(w[k : k + 4]).encode()) for k in range(max(1, len(w) - 3))], np.uint64)
        for s in range(6):
            least = int(((h * np.uint64(2 * (s * 0x9E3779B1 + 0x85EBCA6B) + 1)) & np.uint64(0xFFFFFFFF)).min())
            j = seen.setdefault((s, least), i)
            parent[root(i)] = root(j)
    return np.array([root(i) for i in range(len(texts))])


class Lexicon:
    """The words of some texts as numbers, and the words' features as numbers. Token tables are arrays: a driver holds them in little memory."""

    def __init__(self, texts: list[str]):
        self.words: dict[str, int] = {}
        per = [np.fromiter((self.words.setdefault(w, len(self.words)) for w in WORD.findall(t.lower())), np.int32) for t in texts]
        self.lens = np.array([len(x) for x in per], np.int64)
        self.word = np.concatenate([*per, np.zeros(0, np.int32)])
        self.features: dict[str, int] = {}
        rows, cols = array("i"), array("i")
        for w, i in self.words.items():
            for x in features(w):
                rows.append(i)
                cols.append(self.features.setdefault(x, len(self.features)))
        self.rows, self.cols = np.frombuffer(rows, np.int32), np.frombuffer(cols, np.int32)  # by word

    def families_by_feature(self, family: np.ndarray) -> np.ndarray:
        """In how many families each feature is; -1 marks texts that don't count."""
        owner = np.repeat(family, self.lens)
        pair = np.unique(owner[owner >= 0].astype(np.int64) << 32 | self.word[owner >= 0])
        first = np.searchsorted(self.rows, np.arange(len(self.words) + 1))
        word = pair & 0xFFFFFFFF
        n = first[word + 1] - first[word]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[word], n)
        both = np.unique(np.repeat(pair >> 32, n) << 32 | self.cols[at])
        return np.bincount(both & 0xFFFFFFFF, minlength=len(self.features))


def token_labels(lexicon: Lexicon, texts: list[str], toxic: list[int], min_share: float = 0.01, min_lift: float = 3.0, chance: float = 1e-6) -> np.ndarray:
    """Labelled tokens from labelled documents.

    A feature tells of toxicity if it is in ``min_share`` of the families of near-copies of toxic documents, its smoothed log ratio against
    clean ones is at least ``min_lift``, and it would be so much more common among toxic ones by accident with a probability below ``chance`` (labels
    may be wrong, and there are many rare words). A token of a toxic document is toxic if its word or one of its beginnings tells.
    """
    fam, kind = families(texts), np.array(toxic)
    n = [len(np.unique(fam[kind == c])) for c in (0, 1)]
    clean, bad = (lexicon.families_by_feature(np.where(kind == c, fam, -1)) for c in (0, 1))
    lift = np.log((bad + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
    total, share = bad + clean, n[1] / max(1, sum(n))
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total.max(initial=0) + 1)))])
    # that so many of its families are toxic ones if each were so by the classes' shares alone: the binomial tail's first and largest term
    tail = log_fact[total] - log_fact[bad] - log_fact[clean] + bad * np.log(max(share, 1e-12)) + clean * np.log(max(1 - share, 1e-12))
    tells = (bad >= min_share * n[1]) & (lift >= min_lift) & (tail <= np.log(chance)) & (clean <= 0.05 * bad)
    hot = np.bincount(lexicon.rows, tells[lexicon.cols], len(lexicon.words)) > 0
    return (hot[lexicon.word] & (np.repeat(kind, lexicon.lens) == 1)).astype(float)


def fit(texts: list[str], toxic: list[int], rounds: int = 40, rate: float = 0.5, l2: float = 1e-4) -> ToxicModel:
    """Maximise the conditional likelihood of the labelled tokens by full-batch adaptive gradient steps."""
    lex = Lexicon(texts)
    wid, ids, lens = lex.word, lex.words, lex.lens
    if not len(wid):
        return ToxicModel({}, -30.0, [[0.0, 0.0], [0.0, 0.0]], 0.0, 0.0, 1.0)
    y = token_labels(lex, texts, toxic)
    hot_words = np.bincount(wid, y, len(ids)) > 0
    # a feature of one clean word tells no more than the bias
    used = (np.bincount(lex.cols, minlength=len(lex.features)) > 1) | (np.bincount(lex.cols, hot_words[lex.rows], len(lex.features)) > 0)
    fids = {x: k for k, x in enumerate(x for x, u in zip(lex.features, used) if u)}
    number = np.cumsum(used) - 1
    rows_a, cols_a = lex.rows[used[lex.cols]], number[lex.cols[used[lex.cols]]]
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    begins = starts[lens > 0]
    inner = np.ones(len(wid), bool)
    inner[begins] = False
    inner_at = np.flatnonzero(inner)
    y0, y1 = y[inner_at - 1], y[inner_at]
    seen_tr = np.array([[((1 - y0) * (1 - y1)).sum(), ((1 - y0) * y1).sum()], [(y0 * (1 - y1)).sum(), (y0 * y1).sum()]])
    w, bias, tr, first = np.zeros(len(fids)), float(np.log(max(1.0, y.sum()) / len(y))), np.zeros((2, 2)), 0.0  # at first all words are alike
    g2 = {"w": np.full(len(fids), 1e-8), "o": np.full(6, 1e-8)}
    scale = 1.0 / max(1.0, y.sum())
    for _ in range(rounds if y.sum() else 0):
        d = (bias + np.bincount(rows_a, w[cols_a], len(ids)))[wid]
        ed = np.exp(np.clip(d, -30, 30))
        fw, bw = chain(ed, starts, lens, np.exp(tr), float(np.exp(first)))
        p = fw * bw / (1 + fw * bw)
        gap = y - p
        gw = np.bincount(cols_a, np.bincount(wid, gap, len(ids))[rows_a], len(fids)) * scale - l2 * w
        a, b = fw[inner_at - 1], ed[inner_at] * bw[inner_at]
        e = np.exp(tr)
        one = 1 / (e[0, 0] + e[0, 1] * b + e[1, 0] * a + e[1, 1] * a * b)
        expected = e * np.array([[one.sum(), (b * one).sum()], [(a * one).sum(), (a * b * one).sum()]])
        go = np.concatenate([[gap.sum() * scale], ((seen_tr - expected) * scale).ravel() - l2 * tr.ravel(), [gap[begins].sum() * scale]])
        g2["w"] += gw * gw
        g2["o"] += go * go
        w += rate * gw / np.sqrt(g2["w"])
        step = rate * go / np.sqrt(g2["o"])
        bias, tr, first = bias + step[0], tr + step[1:5].reshape(2, 2), first + step[5]
    model = ToxicModel({x: float(w[i]) for x, i in fids.items() if abs(w[i]) > 1e-6}, float(bias) if y.sum() else -30.0, tr.tolist(), float(first), 0.0, 1.0)
    score = np.array([s for s, _ in model.tagger()(texts)])
    mass, bad = 0.5 * score / (1 - score), np.array(toxic) == 1
    model.noise = float(mass[~bad].sum() / max(1, lens[~bad].sum()))
    score = model.score(mass, lens)
    # the cut with the best F1, halfway to the next score; a score of 1 is never reached
    order = np.argsort(-score, kind="stable")
    f1 = 2 * np.cumsum(bad[order]) / (np.arange(1, len(order) + 1) + bad.sum())
    ends = np.flatnonzero(np.diff(score[order], append=-1.0))  # equal scores are on one side
    if y.sum():
        k = int(ends[np.argmax(f1[ends])])
        model.threshold = max(0.4, float(score[order[k]] + (score[order[k + 1]] if k + 1 < len(order) else 0.0)) / 2)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, fit_chars: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(h, lid, lab, txt) of at most ``per_class`` labelled documents of each class, chosen by a hash of the identifier, whole, in the hash's order as far as ``fit_chars`` characters go.

    Identifiers are chosen among the labels first: at most 2 * per_class of them are broadcast to the one scan of documents.
    A document over a sixteenth of ``fit_chars`` isn't used. Documents with contradictory labels, null labels, identifiers or texts are not used.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("lid"), F.col(f"`{label_col}`").cast("int").alias("lab")).where("lid is not null and lab in (0, 1)")
    own = own.groupBy("lid").agg(F.min("lab").alias("lab"), F.max("lab").alias("most")).where("lab = most").select("lid", "lab", F.xxhash64("lid").alias("h"))
    chosen = own.where("lab = 1").orderBy("h", "lid").limit(per_class).unionByName(own.where("lab = 0").orderBy("h", "lid").limit(per_class))
    texts = docs.select(F.col(f"`{id_col}`").alias("did"), F.col(f"`{text_col}`").alias("txt")).where("did is not null and txt is not null")
    found = texts.where(F.length("txt") <= fit_chars // 16).join(F.broadcast(chosen), F.col("did") == F.col("lid")).select("h", "lid", "lab", "txt").distinct()
    so_far = F.sum(F.length("txt")).over(Window.orderBy("h", "lid", "txt"))  # in one task, as the fit is
    return found.withColumn("so_far", so_far).where(F.col("so_far") <= fit_chars).drop("so_far")


def fitted(sample: DataFrame) -> ToxicModel:
    """The model of a sample, fitted in one task: the driver gets the weights alone, neither the texts nor the token tables."""

    def run(batches):
        got = pd.concat([pd.DataFrame({"h": [], "lid": [], "lab": [], "txt": []}), *batches]).sort_values(["h", "lid", "txt"])
        yield pd.DataFrame({"model": [json.dumps(vars(fit(got["txt"].tolist(), got["lab"].astype(int).tolist())))]})

    row = sample.repartition(1).mapInPandas(run, "model string").first()
    return ToxicModel(**json.loads(row["model"])) if row else fit([], [])


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1000, fit_chars: int = 32_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Columns of docs, and toxic_score, is_toxic and toxic_spans (start and end character of each offending passage).

    A linear-chain conditional random field with two tags is fitted on labelled tokens of at most ``per_class`` labelled
    documents of each class and ``fit_chars`` characters in all. Every whole text of docs is tagged: forward-backward gives each word's marginal, words of
    at least 0.5 are offending, and a document's score is m / (m + 1/2 + 2 c) for its summed marginals m, all words counted, and the
    sum c that as many words of clean labelled documents have. A score at or over the
    cut that separates the labelled documents best, 0.4 at least, is toxic. The scan is one narrow map: no shuffle.

    Defined cases: a null or empty text has score 0 and no spans; without labels of both kinds nothing is toxic;
    repeated rows score alike; an empty table stays empty; where docs has a column of such a name, underscores are appended to the new one's.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(labelled_sample(docs, labels, per_class, fit_chars, id_col, text_col, label_col)))
    names = [free_name(docs, c) for c in ("toxic_score", "is_toxic", "toxic_spans")]
    fields = T.StructType([*docs.schema.fields, *[T.StructField(n, f.dataType) for n, f in zip(names, SCORES.fields)]])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    column = docs.columns.index(text_col)

    def run(batches):
        tag, cut = model.value.tagger(), model.value.threshold
        for batch in batches:
            found = tag(batch.column(column).to_pylist())
            scores = [s for s, _ in found]
            spans = pa.array([[{"start": a, "end": b} for a, b in x] for _, x in found], span_type)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([s >= cut for s in scores], pa.bool_()), spans], names=fields.names)

    return docs.mapInArrow(run, fields)


def drop_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The documents that ``toxicity`` does not find toxic, with their own columns.

    Defined cases: those of ``toxicity``; null and empty texts, null identifiers and repeated rows stay, as do all rows where labels teach nothing.
    """
    flag = free_name(docs, "is_toxic")
    return toxicity(docs, labels, **params).where(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])
