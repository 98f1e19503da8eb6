"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by the extreme-value law of such segments.

fit() counts the words, and the letter groups within words, of a bounded sample of labelled documents and gives each the
log-odds of the toxic class against the other with an informative Dirichlet prior, kept where its z-score is significant. A
token's score is the largest that it or a letter group in it has; without such, the token's own negative log-odds if that is
significant, else one small negative score. scan() finds all maximal scoring segments of a text in one linear pass (Ruzzo and
Tompa). With lambda, the positive root of E[exp(lambda s)] = 1 over background tokens, a segment of score S in n tokens has
E = K n exp(-lambda S) chance hits; K is the likeliest one for the best segments of the background sample, of which those
without a segment are censored. The document's score is a logistic curve of its largest -log E and of the sum of all that are
above 0, fitted on the sample.

The sample: of the labelled ids the `per_class` of least hash of each class, picked from the labels alone; only their texts
are fetched, by a broadcast of at most 2 * per_class ids.

Null and empty texts have no segment and get the lowest score. Very long texts are scanned whole, one at a time. Repeated rows
get equal scores; of rows that repeat a sampled doc_id one text is learnt from, the least. Extra columns are carried as they
are. The prior lies between the sample's share of toxic documents and one half, so scores lean towards the rarer class. An empty
table gives no rows; without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findgrid.llm.common import appended, save, small_batches

#: Bound of the training sample: documents of each class, those of least hash.
PER_CLASS = 2000
#: Lengths of letter groups within words.
GROUPS = (4, 5, 6, 7)
PRIOR = 50.0
#: (z-score, log-odds) that a feature needs: a small effect must be much more certain, as copies of documents repeat words.
KEPT = ((4.0, 3.0), (5.0, 2.0), (15.0, 1.2))
LEAST_DOCS = 5
SIGNIFICANT_E = 0.01
_TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # above 0 of words and letter groups, below 0 of words
    gap: float = -1.0  # score of a token without a weight
    lam: float = 1.0  # lambda and K of the law of chance segments
    k: float = 0.1
    curve: tuple[float, float, float] = (0.0, 0.0, -50.0)  # logistic: by the largest -log E, by their sum, constant


def segments(scores: list[tuple[int, float]], n: int, gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of n tokens of which only `scores` (position, score) differ from
    `gap` < 0.

    Each candidate points to the nearest one before it whose left sum is smaller; the search for a candidate's own goes along
    these pointers, so that each is passed once. Where there is none, all candidates before are final."""
    done: list[tuple[int, int, float]] = []
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, pointer
    total, last = 0.0, -1
    for pos, s in scores:
        total += gap * (pos - last - 1)
        last = pos
        if s <= 0:
            total += s
            continue
        start, left, total = pos, total, total + s
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= left:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < total:  # merged, it starts where that one does, and so has that one's pointer
            start, _, left, _, before = stack[j]
            del stack[j:]
            j = before
        if j < 0:
            done += [(a, b, r - x) for a, b, x, r, _ in stack]
            stack.clear()
        stack.append((start, pos + 1, left, total, j))
    return done + [(a, b, r - x) for a, b, x, r, _ in stack]


def features(token: str) -> set[str]:
    """A word (with a mark before it) and the letter groups inside it."""
    return {"=" + token, *(token[i : i + n] for n in GROUPS for i in range(len(token) - n + 1))}


class Scores(dict):
    """Token to score, computed on first use; forgets all when it holds `most` tokens."""

    def __init__(self, weights: dict[str, float], most: int = 400_000):
        self.weights, self.most = weights, most

    def __missing__(self, token: str) -> float:
        if len(self) >= self.most:
            self.clear()
        w = self.weights
        x = max((w[f] for f in features(token) if f in w), default=0.0)
        x = self[token] = x if x > 0 else w.get("=" + token, 0.0)
        return x


def best(tokens: list[str], m: Model, scores: Scores) -> float:
    """The largest score of a segment, 0 if there is none."""
    hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s]
    return max((s for _, _, s in segments(hits, len(tokens), m.gap)), default=0.0)


def evidence(tokens: list[str], m: Model, scores: Scores) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Largest -log E of a segment of the text (no segment: -10), the sum of those above 0, and the significant segments."""
    n = len(tokens)
    hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, tokens)) if s]
    found = [(a, b, math.log(m.k * n) - m.lam * s) for a, b, s in segments(hits, n, m.gap)] if hits else []
    return max((-e for _, _, e in found), default=-10.0), sum(max(0.0, -e) for _, _, e in found), [x for x in found if x[2] <= math.log(SIGNIFICANT_E)]


def _lambda(values: np.ndarray, p: np.ndarray) -> float:
    """Positive root of sum p exp(x v) = 1, by bisection; 1 if there is none."""
    if not (values > 0).any() or (values * p).sum() >= 0:
        return 1.0
    f = lambda x: float((p * np.exp(np.minimum(x * values, 700))).sum() - 1)
    lo, hi = 0.0, 1e-3
    while f(hi) < 0:
        lo, hi = hi, 2 * hi
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _constant(n: np.ndarray, s: np.ndarray, lam: float, least: float) -> float:
    """K for which K n exp(-lambda S) are likeliest unit exponentials, with texts that have no segment censored at `least`."""
    u = n * np.exp(-lam * np.maximum(s, least))
    return max(1e-9, float(max((s > 0).sum(), 1) / max(u.sum(), 1e-300)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Model from documents (doc_id, text) and labels (doc_id, toxic): per_class documents of each class at most."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") == 1).alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(n) != {True, False}:
        return Model()
    ids = [known.filter(y).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(per_class) for y in (F.col("y"), ~F.col("y"))]
    picked = F.broadcast(ids[0].unionByName(ids[1]))  # 2 * per_class rows at most
    sample = docs.filter("text IS NOT NULL").select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = small_batches(save(sample, "sample"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got: dict[str, list[int]] = {}
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                doc: Counter[str] = Counter()
                for t, c in Counter(_TOKEN.findall(text.lower())).items():
                    for f in features(t):
                        doc[f] += c
                for f, c in doc.items():
                    x = got.setdefault(f, [0, 0, 0, 0])
                    x[int(y)] += c
                    x[2 + int(y)] += 1
                if len(got) > 500_000:
                    yield pd.DataFrame([[k, *v] for k, v in got.items()], columns=["t", "n0", "n1", "d0", "d1"])
                    got = {}
        yield pd.DataFrame([[k, *v] for k, v in got.items()], columns=["t", "n0", "n1", "d0", "d1"])

    counts = sample.mapInPandas(count, "t string, n0 long, n1 long, d0 long, d1 long").groupBy("t").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d0", "d1")))
    counts = save(counts, "counts")  # of at most 2 * per_class documents
    total = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    n0, n1 = total["n0"] or 0, total["n1"] or 0
    if not n0 or not n1:
        return Model()
    # half a token each, and PRIOR tokens shared out as in both classes together
    prior = 0.5 + F.lit(PRIOR) * (F.col("n0") + F.col("n1")) / (n0 + n1)
    a1, a0 = F.col("n1") + prior, F.col("n0") + prior
    delta = F.log(a1 / (n1 + PRIOR - a1)) - F.log(a0 / (n0 + PRIOR - a0))
    z = delta / F.sqrt(1 / a1 + 1 / a0)
    speaks = reduce(lambda a, b: a | b, ((F.col("z") >= z) & (F.col("w") >= w) for z, w in KEPT))
    against = (F.col("z") <= -KEPT[0][0]) & F.col("t").startswith("=")
    kept = counts.filter(F.col("d0") + F.col("d1") >= LEAST_DOCS).select("t", delta.alias("w"), z.alias("z")).filter(speaks | against).toPandas()
    if not (kept["w"] > 0).any():
        return Model()
    weights = dict(zip(kept["t"], kept["w"].astype(float), strict=True))
    m = Model(weights, gap=0.0)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, got = Scores(weights), Counter()
        for b in batches:
            for text in b["text"]:
                got.update(map(scores.__getitem__, _TOKEN.findall(text.lower())))
        yield pd.DataFrame(list(got.items()), columns=["s", "n"])

    # the scores of background tokens give lambda; there are no more scores than weights
    back = sample.filter(~F.col("y")).mapInPandas(spread, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    values, probs = back["s"].to_numpy(float), back["n"].to_numpy(float)
    probs = (probs + 0.5) / (probs + 0.5).sum()
    m.gap = -max(0.05, 2 * float((values * probs).sum()) + 0.02)
    values = np.where(values == 0, m.gap, values)
    m.lam = _lambda(values, probs)

    def highest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(weights)
        for b in batches:
            tokens = [_TOKEN.findall(t.lower()) for t in b["text"]]
            yield pd.DataFrame({"n": [float(len(t)) for t in tokens], "s": [best(t, m, scores) for t in tokens]})

    chance = sample.filter(~F.col("y")).mapInPandas(highest, "n double, s double").filter("n > 0").toPandas()  # per_class rows at most
    m.k = _constant(chance["n"].to_numpy(float), chance["s"].to_numpy(float), m.lam, float(values[values > 0].min())) if len(chance) and (values > 0).any() else 0.1

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(weights)
        for b in batches:
            got = [evidence(_TOKEN.findall(t.lower()), m, scores) for t in b["text"]]
            yield pd.DataFrame({"x": [g[0] for g in got], "s": [g[1] for g in got], "y": b["y"]})

    seen = sample.mapInPandas(score, "x double, s double, y boolean").toPandas()
    y = seen["y"].to_numpy(float)
    # between the shares of the classes in all labelled rows and equal shares
    c = np.where(y == 1, n[True] ** 0.5 / max(y.sum(), 1), n[False] ** 0.5 / max((1 - y).sum(), 1))
    m.curve = _logistic(seen[["x", "s"]].to_numpy(float), y, c / c.sum())
    return m


def _logistic(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic fit of y on the columns of x by Newton steps with a small ridge; the constant comes last."""
    mu, sd = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mu) / sd, np.ones(len(x))])
    t = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ t, -30, 30)))
        g = z.T @ (c * (y - p)) - 1e-4 * t
        h = (z * (c * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(len(t))
        t += np.clip(np.linalg.solve(h, g), -2, 2)
    return (*(float(v) for v in t[:-1] / sd), float(t[-1] - (t[:-1] * mu / sd).sum()))


def scan(docs: DataFrame, m: Model, carry: tuple[str, ...] = ("doc_id",), passages: bool = False) -> DataFrame:
    """The columns `carry` with score, predicted and n_passages; with passages also the array of significant passages
    (start, end token, log E)."""

    def make():
        scores = Scores(m.weights)

        def one(text: str | None) -> tuple:
            x, s, found = evidence(_TOKEN.findall(text.lower()) if text is not None else [], m, scores)
            score = 1 / (1 + math.exp(-min(max(m.curve[0] * x + m.curve[1] * s + m.curve[2], -30.0), 30.0)))
            row = score, int(score >= 0.5), len(found)
            return (*row, [{"start": a, "end": z, "log_e": e} for a, z, e in found]) if passages else row

        return lambda texts: map(one, texts)

    types = {"score": pa.float64(), "predicted": pa.int32(), "n_passages": pa.int64()}
    ddl = "score double, predicted int, n_passages long"
    if passages:
        types["passages"] = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("log_e", pa.float64())]))
        ddl += ", passages array<struct<start: int, end: int, log_e: double>>"
    return appended(docs, carry, ddl, types, make)
