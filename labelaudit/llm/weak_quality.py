"""Quality classifier from weak labels.

Heuristic labellers look at a text and say good, bad or nothing. They overlap and
contradict each other, and none is right always. A text's answers form a pattern; the
patterns are counted over the whole corpus, and expectation-maximisation on these
counts estimates how often each labeller gives each answer for good and for bad texts.
The probability of "good" under that model is the soft label of every text.

A linear scorer learns the soft labels: hashed byte trigrams (square roots of their
shares, so long and short texts weigh alike) under logistic regression, fitted on a
hash sample of at most about ``train_rows`` texts, the one bound here. It scores all.

The table of patterns has at most 3 ** labellers rows, whatever the corpus, and is all
that is collected. Nothing needs given labels; those measure held-out accuracy only.

Defined results: a missing or empty text scores 0 and is not kept; equal texts score
alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from labelaudit.llm.frames import map_texts
from labelaudit.session import settle

TRAIN_ROWS = 4_000
BUCKETS = 1 << 12
GOOD, BAD, NONE = "+", "-", "0"
#: Function words of the corpus languages.
COMMON = frozenset(
    "the of and to in is it that was for on are with as at be this by er from "
    "der die das und ist den von zu mit sich des auf für im dem nicht ein "
    "le la les de des et est un une du que en au aux dans pour par pas "
    "el los las y que es del se por con una para no su".encode().split()
)
_UPPER = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LETTERS = _UPPER + bytes(range(97, 123))


def _answer(bad: bool, good: bool) -> str:
    return BAD if bad else GOOD if good else NONE


def answers(text: bytes) -> str:
    """One letter per labeller; every kind of bad text is in sight of several."""
    words = text.split()
    n = len(words)
    if not n:
        return BAD + NONE * 9

    def count(chars: bytes) -> int:
        return len(text) - len(text.translate(None, chars))

    symbols, upper = count(b"#*$%&|<>") / n, count(_UPPER) / max(1, count(_LETTERS))
    marks = count(_MARKS) / max(1, sum(map(len, words)))
    bare = [w.strip(b".,;:?\"'()") for w in words]
    plain = sum(w.translate(None, _MARKS) == w != b"" for w in bare) / n
    counts = Counter(words)
    fresh, top = len(counts) / n, max(counts.values()) / n
    again = 1 - len(set(zip(words, words[1:]))) / max(1, n - 1)
    stutter = sum(map(eq, words, words[1:])) / n
    common = sum(w.lower() in COMMON for w in bare) / n
    return "".join(
        (
            _answer(n < 20, False),
            _answer(symbols > 0.1, symbols < 0.02),
            _answer(plain < 0.75, plain > 0.9),
            _answer(marks > 0.08, marks < 0.05),
            _answer(upper > 0.4, upper < 0.12),
            _answer(n >= 50 and fresh < 0.3, n < 2000 and fresh > 0.5),
            _answer(n >= 50 and again > 0.4, again < 0.1),
            _answer(common < 0.05, common > 0.15),
            _answer(n >= 50 and top > 0.25, top < 0.15),
            _answer(stutter > 0.1, stutter < 0.03),
        )
    )


def votes(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the pattern of answers on each text."""
    return map_texts(docs, text, keep, "pattern string", lambda texts: {"pattern": [answers(t) for t in texts]})


def label_model(counts: dict[str, int], rounds: int = 200, start: float = 0.8) -> tuple[dict[str, float], dict]:
    """Probability of "good" per pattern, and the estimates, by expectation-maximisation.

    Starts where all labellers are right with probability ``start`` when they speak, so
    that the two classes keep their meaning. Counts are smoothed by one.
    """
    if not counts:
        return {}, {"prior": 0.5, "accuracy": []}
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], np.float64)
    kinds = [BAD, NONE, GOOD]
    said = np.array([[kinds.index(c) for c in p] for p in patterns])
    shown = np.eye(3)[said]  # pattern, labeller, answer
    silent = (weight[:, None] * (said == 1)).sum(axis=0) / weight.sum()
    speak = np.clip(1 - silent, 0.01, 0.99)
    right, wrong = speak * start, speak * (1 - start)
    given = np.stack([np.stack([right, 1 - speak, wrong], 1), np.stack([wrong, 1 - speak, right], 1)])  # bad, good
    prior = np.array([0.5, 0.5])
    good = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.log(prior)[:, None] + np.einsum("pla,cla->cp", shown, np.log(given))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        parts = np.stack([1 - new, new]) * weight
        prior = (parts.sum(axis=1) + 1) / (weight.sum() + 2)
        given = np.einsum("cp,pla->cla", parts, shown) + 1.0
        given /= given.sum(axis=2, keepdims=True)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    right = prior[0] * given[0, :, 0] + prior[1] * given[1, :, 2]
    wrong = prior[0] * given[0, :, 2] + prior[1] * given[1, :, 0]
    return dict(zip(patterns, new.tolist())), {"prior": float(prior[1]), "accuracy": (right / (right + wrong)).tolist()}


def trigram_shares(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams, then how evenly they are spread, and the length.

    Zeros for a text of under three bytes.
    """
    b = np.frombuffer(text, np.uint8)
    counts = np.zeros(buckets, np.float64)
    for at in range(0, len(b) - 2, 1 << 20):
        part = b[at : at + (1 << 20) + 2].astype(np.uint32)
        h = (part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]) * np.uint32(0x9E3779B1)
        counts += np.bincount(h >> np.uint32(32 - (buckets.bit_length() - 1)), minlength=buckets)
    n = counts.sum()
    shares = counts / max(1.0, n)
    spread = -(shares * np.log(np.where(shares > 0, shares, 1.0))).sum() / np.log(max(2.0, min(n, buckets)))
    return np.concatenate([np.sqrt(shares), [spread, np.log1p(min(n, 1000.0)) / 10]])


def fit_scorer(docs: DataFrame, soft: str, text: str = "text", buckets: int = BUCKETS) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on soft labels."""
    shares = map_texts(
        docs, text, [soft], "x array<double>", lambda texts: {"x": [trigram_shares(t, buckets) for t in texts]}
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), F.col(soft).alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (1 - F.col(soft)).alias("weight")),
        )
    ).alias("side")
    rows = settle(shares.select(array_to_vector("x").alias("features"), sides).select("features", "side.*").where("weight > 0"))
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50, standardization=False).fit(rows)
    return model.coefficients.toArray(), float(model.intercept)


def score(docs: DataFrame, keep: list[str], weights: np.ndarray, intercept: float, text: str = "text") -> DataFrame:
    """``keep`` columns and the probability that each text is good."""

    def run(texts: list[bytes]) -> dict[str, list]:
        x = [float(trigram_shares(t, len(weights) - 2) @ weights) + intercept for t in texts]
        return {"score": [1 / (1 + np.exp(-min(max(v, -500), 500))) if t.split() else 0.0 for v, t in zip(x, texts)]}

    return map_texts(docs, text, keep, "score double", run)


def classify(
    docs: DataFrame, keep: list[str], text: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = 0.5
) -> DataFrame:
    """``keep`` columns, score and kept of every text."""
    draw = F.pmod(F.xxhash64(*keep, text), F.lit(1 << 31)) / float(1 << 31)
    asked = settle(votes(docs.select(*keep, text, draw.alias("_draw")), ["_draw"], text))
    table = asked.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** labellers at most
    good, _ = label_model({r["pattern"]: r["n"] for r in table})
    total = sum(r["n"] for r in table)
    if not total:
        return docs.select(*keep, F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    sample = docs.where(draw < F.lit(train_rows / total)).select(text)
    labelled = votes(sample.select(F.col(text).alias("_t"), text), ["_t"], text)
    soft = docs.sparkSession.createDataFrame(sorted(good.items()), "pattern string, soft double")
    labelled = labelled.join(F.broadcast(soft), "pattern")
    weights, intercept = fit_scorer(labelled, "soft", "_t")
    return score(docs, keep, weights, intercept, text).withColumn("kept", F.col("score") >= threshold)
