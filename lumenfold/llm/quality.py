"""Operator 4, quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words, word shapes and a few whole-text tokens is shared by all grades; ordered
thresholds cut its score: P(grade <= k) = sigmoid(threshold[k] - score). From these come the expected grade and
the tail probability by which documents are selected.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import SAMPLE_ROWS, begin, finish, labelled_sample, prepare, text_slices

BITS = 18
#: Words whose scores a worker keeps; when full the store starts anew.
KEPT_WORDS = 150_000
_SHAPES = [(re.compile("[^\\W\\d_A-ZÀ-ÖØ-Þ]+"), "a"), (re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1")]


def bucket(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}{value}".encode()) & ((1 << BITS) - 1)


def shape(word: str) -> str:
    """The word with runs of small letters, capitals and digits as a, A and 0, and repeated signs as two."""
    for pattern, to in _SHAPES:
        word = pattern.sub(to, word)
    return word[:12]


def whole_text_tokens(words: list[str]) -> list[int]:
    """Buckets of tokens for a text's share of distinct words and of words equal to the one before."""
    n = max(1, len(words))
    distinct, same = len(set(words)) / n, sum(map(eq, words, words[1:])) / n
    return [bucket("distinct", str(int(distinct * 10 * min(1, n / 50)))), bucket("same", str(min(5, int(same * 20))))]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def below(self, score: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each score and threshold."""
        return 1 / (1 + np.exp(np.clip(score[:, None] - self.thresholds, -500, 500)))


def features(text: str) -> tuple[list[int], list[float]]:
    """Buckets and values: shares of words and shapes, and one for each whole-text token."""
    words = text.split()
    counts: Counter = Counter()
    for word, n in Counter(words).items():
        counts[bucket("w", word)] += n
        counts[bucket("s", shape(word))] += n
    total = max(1, len(words))
    values = {b: n / total for b, n in counts.items()}
    for b in whole_text_tokens(words):
        values[b] = values.get(b, 0) + 1.0
    return list(values), list(values.values())


def fit(x_rows: list[np.ndarray], x_values: list[np.ndarray], grades: np.ndarray, rounds: int = 150, rate: float = 0.2, ridge: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with a ridge by Adam; the thresholds stay ordered as sums of positive gaps."""
    kinds = int(grades.max()) if len(grades) else 0
    n = np.fromiter(map(len, x_rows), np.int64, len(x_rows))
    at, inside = np.unique(np.concatenate([np.empty(0, np.int64), *x_rows]), return_inverse=True)
    values = np.concatenate([np.empty(0), *x_values])
    of = np.repeat(np.arange(len(n)), n)
    weights = np.zeros(1 << BITS)
    if kinds < 1:
        return OrdinalModel(weights, np.array([-1.0]))
    share = np.array([(grades <= k).mean() for k in range(kinds)]).clip(1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = np.concatenate([np.zeros(len(at)), start[:1], gaps])
    m, s = np.zeros_like(params), np.zeros_like(params)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, rounds + 1):
        w = params[: len(at)]
        thresholds = params[len(at)] + np.concatenate([[0], np.cumsum(np.exp(params[len(at) + 1 :]))])
        score = np.bincount(of, w[inside] * values, len(n))
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        with np.errstate(over="ignore"):
            upper, lower = sigmoid(edges[grades + 1] - score), sigmoid(edges[grades] - score)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_score = (du - dl) / len(n)
        slope = np.zeros_like(params)
        slope[: len(at)] = np.bincount(inside, d_score[of] * values, len(at)) + ridge * w / len(n) * 10
        d_edges = (np.bincount(grades, dl, kinds + 1)[1:] - np.bincount(grades, du, kinds + 1)[:-1]) / len(n)
        slope[len(at)] = d_edges.sum()
        slope[len(at) + 1 :] = np.cumsum(d_edges[::-1])[::-1][1:] * np.exp(params[len(at) + 1 :])
        m, s = 0.9 * m + 0.1 * slope, 0.999 * s + 0.001 * slope**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    weights[at] = params[: len(at)]
    return OrdinalModel(weights, params[len(at)] + np.concatenate([[0], np.cumsum(np.exp(params[len(at) + 1 :]))]))


def train(documents: DataFrame, labels: DataFrame, grade: Column | None = None, rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """A model fitted on at most `rows` rated documents outside the held-out fold.

    grade: an expression on labels, from 0 up; by default 0 for bad quality, 1 for good but toxic texts and 2
    for good ones. Rows whose grade is null are left out; without rows every document gets grade 0's odds.
    """
    prepare(documents.sparkSession)
    grade = F.expr("quality * (2 - toxic)") if grade is None else grade
    rated = labels.select("doc_id", grade.cast("bigint").alias("grade")).where("grade >= 0")
    sample = labelled_sample(documents.select("doc_id", "text"), rated, rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("grade"), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
                ["doc_id", "grade", "at", "value"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "text", "grade").mapInArrow(featured, f"doc_id {kind}, grade bigint, at array<int>, value array<float>").toPandas().sort_values("doc_id")
    return fit([np.array(x, np.int64) for x in got["at"]], [np.array(x, float) for x in got["value"]], got["grade"].to_numpy(np.int64))


class WordScores(dict):
    """Word to the sum of its weights; computed when first asked for."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = x = float(self.weights[bucket("w", word)] + self.weights[bucket("s", shape(word))])
        return x

    def score(self, text: str) -> float:
        words = text.split()
        return sum(map(self.__getitem__, words)) / max(1, len(words)) + sum(float(self.weights[b]) for b in whole_text_tokens(words))


def rate(df: DataFrame, model: OrdinalModel, grade: int = 1, text: str = "text", out: str = "rating") -> DataFrame:
    """df with the struct out: score, expected_grade and tail_probability = P(grade or better).

    Null and empty texts have no words and get the score of their whole-text tokens. Rows, ties, repeats and
    other columns stay; an input column named out is replaced. Whole texts count, however long.
    """
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    @F.arrow_udf("struct<score:double,expected_grade:double,tail_probability:double>")
    def rating(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("quality")
        weights, thresholds = shared.value
        words, fitted = WordScores(weights), OrdinalModel(weights, thresholds)
        for batch in batches:
            score = np.array([words.score(t) for some in text_slices(batch) for t in some], float)
            above = 1 - fitted.below(score)
            tail = above[:, grade - 1] if 1 <= grade <= above.shape[1] else np.zeros(len(score)) if grade > 0 else np.ones(len(score))
            yield pa.StructArray.from_arrays([pa.array(score), pa.array(above.sum(1)), pa.array(tail)], ["score", "expected_grade", "tail_probability"])
        finish(words)

    return df.withColumn(out, rating(F.col(text)))
