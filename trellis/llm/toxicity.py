"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are on documents, so token labels come first: over a bounded sample of labelled documents, words and word beginnings
that mark the toxic ones (an exact test on document counts, near copies counted once) tag the tokens of toxic
documents; tokens of clean ones are clean. The field is fitted to these tags. A token's features are its word and its first 3 to 8 letters, hashed; transitions are free.

Scoring reads whole texts. Forward-backward gives each token's marginal; the largest, their sum and the number of likely ones
give the document's score by a logistic model. Tokens with marginals of at least 1/2 are the offending offsets.

The model's parameters are the sample's bounds: TOXIC and CLEAN documents at most, of rows whose crc32(doc_id) mod 4
isn't 2. Everything else is over all rows. Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text has no tokens and gets the score of a document without evidence; labels that are null
are passed over, and of a document with both labels the toxic one counts; without labels of both kinds every score is the share of toxic labels, or 0; rows repeated are scored alike.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOXIC, CLEAN = 400, 800
#: Weights smaller than this are dropped from the fitted model.
TINY = 0.02
AT_LEAST = 0.3
#: Tokens of a training sequence.
STEPS = 256
CACHE = 200_000
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def features(token: str) -> list[int]:
    """Hashed features of a token as it stands in a text: its word (letters and digits, lower case), and the word's first letters."""
    w = "".join(filter(str.isalnum, token)).lower()
    return [zlib.crc32(f"{k} {w[:k]}".encode()) for k in BEGINNINGS if len(w) >= k] + [zlib.crc32(f"w {w}".encode())]


@dataclass
class Model:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = -6.0
    #: Log potentials of going from tag i to tag j.
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    #: Of the document's features: largest log-odds, log(1 + sum), log(1 + number); then the constant.
    score: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -30.0]))

    def emission(self, token: str) -> float:
        return sum(map(self.weights.get, features(token), repeat(0.0)), self.bias)


def _step(x: np.ndarray, m00: float, m01: float, m10: float, m11: float) -> np.ndarray:
    """log((e^m01 + e^(m11 + x)) / (e^m00 + e^(m10 + x)))."""
    return np.logaddexp(m01, m11 + x) - np.logaddexp(m00, m10 + x)


def chains(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (emission included) and backward log-odds of tag 1 at each token; chains stand one after another.

    All chains advance together, the longest first, so a step is a few array operations over the chains that go on.
    """
    order = np.argsort(-lengths, kind="stable")
    n = lengths[order]
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))[order]
    forward, backward = emissions.copy(), np.zeros_like(emissions)
    longest = int(n[0]) if len(n) else 0
    going = np.searchsorted(-n, -np.arange(longest + 1), side="left")  # chains with more than t tokens
    (m00, m01), (m10, m11) = moves
    for t in range(1, longest):
        at = starts[: going[t]] + t
        forward[at] += _step(forward[at - 1], m00, m01, m10, m11)
    for t in range(longest - 2, -1, -1):
        at = starts[: going[t + 1]] + t
        backward[at] = _step(emissions[at + 1] + backward[at + 1], m00, m10, m01, m11)
    return forward, backward


def sigmoid(x):
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def evidence(logits: np.ndarray) -> tuple[float, float, float]:
    if not len(logits):
        return (-12.0, 0.0, 0.0)
    p = sigmoid(logits)
    return (float(min(12.0, max(-12.0, logits.max()))), math.log1p(float(p[p > 0.01].sum())), math.log1p(float((p >= 0.5).sum())))


class Vocabulary:
    """Tokens of the training sample, numbered, with their features as one flat array."""

    def __init__(self, texts: list[list[str]]):
        self.of: dict[str, int] = {}
        self.docs = [np.fromiter((self.of.setdefault(w, len(self.of)) for w in t), np.int32, len(t)) for t in texts]
        flat, sizes = array("q"), array("q")
        for w in self.of:
            f = features(w)
            flat.extend(f)
            sizes.append(len(f))
        sizes = np.frombuffer(sizes, np.int64) if sizes else np.zeros(0, np.int64)
        flat = np.frombuffer(flat, np.int64) if flat else np.zeros(0, np.int64)
        self.known, flat = np.unique(flat, return_inverse=True)
        self.flat = flat.astype(np.int32)
        self.word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.first = np.concatenate(([0], np.cumsum(sizes)))

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """The distinct features of some words."""
        n = self.first[words + 1] - self.first[words]
        return np.unique(self.flat[np.repeat(self.first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())])

    def emissions(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return np.bincount(self.word, weights[self.flat], len(self.of)) + bias

    def spread(self, by_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, by_word[self.word], len(self.known))


def apart(texts: list[list[str]], hashes: int = 16, most: int = 12) -> list[int]:
    """The texts of which fewer than `most` of the least shingle hashes agree with one text kept before: near copies count once."""
    seen: dict[tuple[int, int], list[int]] = {}
    keep = []
    for i, t in enumerate(texts):
        h = np.fromiter((zlib.crc32(" ".join(t[k : k + 3]).encode()) for k in range(max(1, len(t) - 2))), np.uint64)
        marks = [(k, int(((h * np.uint64(2654435761 + 2 * k * 40503) + np.uint64(k)) & np.uint64(0xFFFFFFFF)).min())) for k in range(hashes)]
        agree = Counter(j for m in marks for j in seen.get(m, ()))
        if max(agree.values(), default=0) < most:
            keep.append(i)
            for m in marks:
                seen.setdefault(m, []).append(i)
    return keep


def marks(vocabulary: Vocabulary, toxic: np.ndarray, false: float = 0.1) -> np.ndarray:
    """Whether each token of the vocabulary has a feature that marks toxic documents.

    A feature's p-value is the chance that, of the documents that have it, so many are toxic if labels were dealt at random
    (hypergeometric). Features are taken in order of it as far as the expected share of false ones is `false` (Benjamini and
    Hochberg), which asks for less from each marker when there are many, and holds in small and large samples alike.
    """
    df = np.zeros((2, len(vocabulary.known)), np.int64)
    for d, t in zip(vocabulary.docs, toxic):
        df[int(t), vocabulary.of_words(np.unique(d))] += 1
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    a, b = df[1], df[0]
    log = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n1 + n0 + 2)))))  # logarithms of factorials
    pick = lambda n, k: log[n] - log[k] - log[n - k]
    first = pick(n1, a) + pick(n0, b) - pick(n1 + n0, a + b)
    ratio = b * (n1 - a) / ((a + 1.0) * (n0 - b + 1.0))  # of the next term of the tail to this one; it falls from there on
    p = np.where(ratio < 1, np.exp(first) / np.maximum(1 - ratio, 1e-9), 1.0)
    usual = a + b >= 2
    p = np.where(usual & (a / max(1, n1) >= 8 * (b / max(1, n0))), p, 1.0)
    line = false * np.arange(1, len(p) + 1) / max(1, int(usual.sum()))
    under = np.flatnonzero(np.sort(p) <= line)
    good = p <= (np.sort(p)[under[-1]] if len(under) else -1.0)
    return np.bincount(vocabulary.word, good[vocabulary.flat], len(vocabulary.of)) > 0


def fit_field(model: Model, vocabulary: Vocabulary, tags: list[np.ndarray], rounds: int = 40, rate: float = 0.5, decay: float = 2e-6) -> np.ndarray:
    """Gradient ascent (Adagrad) on the log-likelihood of the tags, over sequences of at most STEPS tokens. Returns each known feature's weight."""
    words = np.concatenate(vocabulary.docs)
    y = np.concatenate(tags).astype(np.float64)
    lengths = np.array([min(STEPS, len(d) - k) for d in vocabulary.docs for k in range(0, len(d), STEPS)], np.int64)
    first = np.zeros(len(words), bool)
    first[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = True
    inner = np.flatnonzero(~first)
    seen = np.array([[np.sum((y[inner - 1] == i) & (y[inner] == j)) for j in (0, 1)] for i in (0, 1)], float)
    scale = 1.0 / max(1.0, y.sum())
    weights = np.zeros(len(vocabulary.known))
    g_w, g_b, g_m = np.full(len(weights), 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(rounds):
        by_word = vocabulary.emissions(weights, model.bias)
        e = by_word[words]
        fwd, bwd = chains(e, lengths, model.moves)
        d = (y - sigmoid(fwd + bwd)) * scale
        grad_w = vocabulary.spread(np.bincount(words, d, len(by_word))) - decay * weights
        grad_b = d.sum()
        a, b = fwd[inner - 1], e[inner] + bwd[inner]
        cell = np.stack([[model.moves[i][j] + (a if i else 0) + (b if j else 0) + 0 * a for j in (0, 1)] for i in (0, 1)])
        cell = np.exp(cell - cell.max(axis=(0, 1)))
        grad_m = (seen - (cell / cell.sum(axis=(0, 1))).sum(axis=2)) * scale - 1e-4 * model.moves
        g_w += grad_w**2
        g_b += grad_b**2
        g_m += grad_m**2
        weights += rate * grad_w / np.sqrt(g_w)
        model.bias += rate * grad_b / math.sqrt(g_b)
        model.moves = model.moves + rate * grad_m / np.sqrt(g_m)
        model.bias = min(model.bias, -3.0)
    weights[np.abs(weights) < TINY] = 0.0
    model.weights = {int(f): float(w) for f, w in zip(vocabulary.known, weights) if w}
    return weights


def fit_score(model: Model, x: np.ndarray, y: np.ndarray, share: float, rounds: int = 30, decay: float = 1.0) -> None:
    """Ridge logistic regression by Newton's method; the constant is set for the share of toxic documents among all labels."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.diag([decay] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    of = y.mean()
    w[-1] += math.log(share / (1 - share)) - math.log(of / (1 - of))
    model.score = w


def train(texts: list[str], toxic: list[int], share: float) -> Model:
    tokens = [t.split() for t in texts]
    once = apart(tokens)
    tokens, y = [tokens[i] for i in once], np.array([toxic[i] for i in once])
    model = Model()
    if not 0 < y.sum() < len(y):
        base = min(1 - 1e-6, max(1e-6, share))
        model.score = np.array([0.0, 0.0, 0.0, math.log(base / (1 - base))])
        return model
    vocabulary = Vocabulary(tokens)
    del tokens
    known = marks(vocabulary, y)
    tags = [known[d] & bool(t) for d, t in zip(vocabulary.docs, y)]
    weights = fit_field(model, vocabulary, tags)
    lengths = np.array([len(d) for d in vocabulary.docs])

    def logits():
        got = chains(vocabulary.emissions(weights, model.bias)[np.concatenate(vocabulary.docs)], lengths, model.moves)
        return np.split(got[0] + got[1], np.cumsum(lengths)[:-1])

    fit_score(model, np.array([evidence(z) for z in logits()]), y, min(0.999, max(0.001, share)))
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, clean: int = CLEAN) -> Model:
    """Fits the model on a bounded sample of the labelled rows that aren't held out, the first in a seeded order."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_y"))
    counts = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.lit(3), "doc_id"), F.col("doc_id")]
    ids = [(r[0], r[1]) for y, n in ((1, toxic), (0, clean)) for r in known.where(F.col("_y") == y).orderBy(*order).limit(n).collect()]
    if not ids:
        return train([], [], 0.0)
    pick = docs.sparkSession.createDataFrame(ids, "doc_id long, _y int")
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").where(F.col("text").isNotNull()).select("doc_id", "text", "_y").collect()  # toxic + clean rows at most
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["_y"] for r in rows], counts.get(1, 0) / max(1, sum(counts.values())))


class Scorer:
    """Scores of many texts at once; remembers tokens' emissions."""

    def __init__(self, model: Model):
        class Emissions(dict):
            def __missing__(self, token):
                if len(self) >= CACHE:
                    self.clear()
                out = self[token] = model.emission(token)
                return out

        self.model, self.get = model, Emissions().__getitem__

    def __call__(self, texts) -> tuple[np.ndarray, list[np.ndarray]]:
        """The scores, and the log-odds of each text's tokens."""
        each = []
        for t in texts:
            words = (t.as_py() or "").split()
            each.append(np.fromiter(map(self.get, words), np.float64, len(words)))
        if not each:
            return np.zeros(0), []
        lengths = np.array([len(x) for x in each], np.int64)
        fwd, bwd = chains(np.concatenate(each), lengths, self.model.moves)
        parts = np.split(fwd + bwd, np.cumsum(lengths)[:-1])
        x = np.array([evidence(z) for z in parts])
        return sigmoid(x @ self.model.score[:3] + self.model.score[3]), parts


def score_column(model: Model, text: str = "text") -> Column:
    """The score as a column: nothing else of the row goes through Python."""

    @F.arrow_udf("double")
    def toxicity(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for texts in batches:
            yield pa.array(scorer(texts)[0], pa.float64())

    return toxicity(F.col(text).cast("string"))


def clean(docs: DataFrame, model: Model, at_least: float = AT_LEAST) -> DataFrame:
    """docs without those that score at_least or more."""
    return docs.where(score_column(model) < at_least)


SCORES = "doc_id long, score double, spans array<struct<begin:int,end:int>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and spans (character offsets of offending stretches), one row per row of docs."""

    def run(batches):
        scorer = Scorer(model)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            texts = b.column(1)
            scores, parts = scorer(texts)
            spans = []
            for t, z in zip(texts, parts):
                hit = np.flatnonzero(z >= 0)
                found: list[dict] = []
                if len(hit):
                    places = [m.span() for m in re.finditer(r"\S+", t.as_py())]
                    for k, h in enumerate(hit):
                        if k and h == hit[k - 1] + 1:
                            found[-1]["end"] = places[h][1]
                        else:
                            found.append({"begin": places[h][0], "end": places[h][1]})
                spans.append(found)
            yield pa.record_batch([b.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCORES)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= AT_LEAST).cast("int").alias("predicted"), "spans")
