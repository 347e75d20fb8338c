"""Operator 1, toxicity: noisy-channel deobfuscation, then a score of the restored text.

Spans that may be disguised become character lattices: look-alike signs inside words, letters repeated three times
or more or doubled throughout a word, single letters set apart, signs between the letters of a word, and words cut
in two where the character model likes the whole better. Viterbi decoding under a trigram character model of the
whole corpus, with a cost for each disguise, restores them. The words of the restored text are scored by the odds of
their whole form and of their first letters among labelled documents; a logistic function of a document's
strongest words gives the probability that it is toxic.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import begin, finish, labelled_sample, prepare, text_slices
from lumenfold.session import materialize

#: Labelled documents that the word odds and the logistic function are fitted on at most.
SAMPLE_ROWS = 20_000
#: Characters of their texts in all.
SAMPLE_CHARS = 64_000_000
KEPT_WORDS = 150_000
KEPT_SPANS = 50_000
PREFIXES = (4, 5, 6)
#: Minimum hashes by which near copies among the labelled documents count once.
COPIES = 8

#: Letters that signs and digits may stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou",
}
#: Costs, in nats, of the disguises and of leaving signs, repeated letters and gaps as they are.
SUBSTITUTED, LEFT, REPEATED, AS_IS, SPACED, APART = 1.0, 7.0, 2.5, 0.0, 0.5, 5.0
#: Costs of a gap or sign within a word of longer fragments: of dropping a sign or a space, of keeping either.
INNER, SPLIT, WHOLE = 3.0, 6.0, 0.0

LETTERS = 27  # 0 stands for all but letters
_STRIP = ".,;:!?\"'()[]{}*#%&<>-_…«»“”‘’"
_GAPS = " .-_*·"
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ .\-_*]){2,}[^\W_](?![^\W_])")
_WORDS = re.compile(r"[^\W\d_]+")


def _letter(char: str) -> int:
    base = unicodedata.normalize("NFD", "s" if char == "ß" else char.lower())[0]
    return ord(base) - 96 if "a" <= base <= "z" else 0


_TABLE = np.array([_letter(chr(i)) for i in range(0x250)] + [0], np.int64)


#: Kinds of characters, of code points below 0x3000 (letters alone beyond): 1 letters, 2 white space, 4 look-alikes, 8 signs that may stand between letters.
_KINDS = np.array(
    [c.isalpha() + 2 * c.isspace() + 4 * (c in LOOKALIKES) + 8 * (c in ".-_·") for c in map(chr, range(0x3000))] + [1], np.uint8
)


def symbols(text: str) -> np.ndarray:
    """Letters 1 to 26 without case and accents, 0 for all else."""
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x250)]


def count_trigrams(df: DataFrame, text: str = "text") -> np.ndarray:
    """How often each trigram of symbols occurs in all texts; at most 27**3 rows reach the driver."""
    prepare(df.sparkSession)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            for some in text_slices(batch.column(0)):
                s = symbols("  ".join(["", *some, ""]))
                total += np.bincount((s[:-2] * LETTERS + s[1:-1]) * LETTERS + s[2:], minlength=LETTERS**3)
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found), pa.array(total[found])], ["gram", "n"])

    counts = df.select(text).mapInArrow(grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(LETTERS**3, np.int64)
    out[counts["gram"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out.reshape(LETTERS, LETTERS, LETTERS)


def log_model(trigrams: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed by shorter contexts."""
    one = trigrams.sum((0, 1)) + 1.0
    one /= one.sum()
    two = trigrams.sum(0) + 10 * one
    two /= two.sum(1, keepdims=True)
    three = trigrams + 10 * two
    return np.log(three / three.sum(2, keepdims=True))


def gap_gains(logs: np.ndarray) -> np.ndarray:
    """How much likelier two words are as one, by the last two letters of the one and the first two of the other."""
    joined = logs[:, :, 1:, None] + logs[None, :, 1:, :]
    apart = logs[:, :, 0][:, :, None, None] + logs[:, 0, 1:][None, :, :, None] + logs[0, 1:, :][None, None]
    out = np.full((LETTERS,) * 4, -np.inf, np.float32)
    out[:, 1:, 1:, :] = (joined - apart)[:, 1:]
    return out


def marked(token: str) -> tuple[int, int] | None:
    """Where the part of a token with look-alike signs that may be disguised letters begins and ends.

    Punctuation at the ends is left out, but for a "!" or "|" before a letter. Three or more "$" at the end are
    decoration; one or two may be letters.
    """
    bare = token.rstrip(_STRIP + "|")
    if bare.endswith("$$$"):
        bare = bare.rstrip("$").rstrip(_STRIP + "|")
    begin = len(bare) - len(bare.lstrip(_STRIP.replace("!", "")))
    core = bare[begin:]
    if core.isalpha() or not any(c in LOOKALIKES for c in core) or not any(c.isalpha() for c in core):
        return None
    return begin, len(bare)


def suspects(text: str, gains: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Where the spans of a text that may be disguised begin and end, in order; those that overlap are one.

    gains: of gap_gains(); without it no words are joined. A few passes over the code points find the places.
    """
    if not text:
        return []
    found = [m.span() for m in _SPACED.finditer(text)]
    code = np.frombuffer(f"  {text}  ".encode("utf-32-le"), np.uint32)
    kind = _KINDS[np.minimum(code, 0x3000)]
    alpha = (kind & 1).astype(bool)
    # words with a letter three times in a row, or without one but mostly of doubled letters
    again = (code[1:] == code[:-1]) & alpha[1:]
    if again.any():
        edge = np.flatnonzero(alpha[1:] != alpha[:-1]) + 1
        begin, end = edge[::2], edge[1::2]
        at = np.flatnonzero(again) + 1
        word = np.searchsorted(begin, at, side="right") - 1
        pairs = np.bincount(word, minlength=len(begin))
        triple = np.zeros(len(begin), bool)
        triple[word[1:][at[1:] == at[:-1] + 1]] = True
        some = triple | ((pairs > 1) & (4 * pairs >= end - begin))
        found += zip((begin[some] - 2).tolist(), (end[some] - 2).tolist())
    # tokens that hold both look-alikes and letters
    sign = np.flatnonzero(kind & 4)
    if len(sign):
        solid = (kind & 2) == 0
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        begin, end = edge[::2], edge[1::2]
        letters = np.concatenate([[0], np.cumsum(alpha)])
        token = np.unique(np.searchsorted(begin, sign, side="right") - 1)
        token = token[letters[end[token]] > letters[begin[token]]]
        for i, j in zip((begin[token] - 2).tolist(), (end[token] - 2).tolist()):
            if part := marked(text[i:j]):
                found.append((i + part[0], i + part[1]))
    # letters, a sign, letters: with all that goes on so
    inner = np.flatnonzero(kind & 8)
    inner = inner[alpha[inner - 1] & alpha[inner + 1]]
    if len(inner):
        inside = alpha.copy()
        inside[inner] = True
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        run = np.unique(np.searchsorted(edge, inner, side="right") - 1)
        found += zip((edge[run] - 2).tolist(), (edge[run + 1] - 2).tolist())
    if gains is not None:
        letter = _TABLE[np.minimum(code, 0x250)]
        gap = np.flatnonzero(code[2:-2] == 32) + 2
        likely = gap[gains[letter[gap - 2], letter[gap - 1], letter[gap + 1], letter[gap + 2]] > SPLIT]
        if len(likely):
            edge = np.flatnonzero(alpha[1:] != alpha[:-1]) + 1
            place = np.searchsorted(edge, likely, side="right")
            found += zip((edge[place - 2] - 2).tolist(), (edge[place + 1] - 2).tolist())
    if len(found) < 2:
        return found
    found.sort()
    spans = [found[0]]
    for a, b in found[1:]:
        if a < spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


class Decoder(dict):
    """Disguised span to its most likely reading."""

    def __init__(self, logs: np.ndarray):
        super().__init__()
        self.logs = logs.tolist()
        self.gains = gap_gains(logs)

    def __missing__(self, span: str) -> str:
        if len(self) >= KEPT_SPANS:
            self.clear()
        self[span] = out = self.decode(span)
        return out

    @staticmethod
    def lattice(span: str) -> list[list[tuple[str, float]]]:
        """For each run of one character, its readings and their costs."""
        low = span.lower()
        # a span may hold several gaps: the letters about a gap are set apart if they stand alone on both sides
        gap = [c in _GAPS and 0 < i < len(low) - 1 and low[i - 1].isalnum() and low[i + 1].isalnum() for i, c in enumerate(low)]
        alone = lambda i: (i <= 0 or gap[i - 1]) and (i >= len(low) - 1 or gap[i + 1])
        slots: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(low):
            j = i + 1
            while j < len(low) and low[j] == low[i]:
                j += 1
            char, n = low[i], j - i
            if gap[i] and alone(i - 1) and alone(i + 1):
                slots.append([("", SPACED), (char, APART)])
            elif gap[i] and char not in LOOKALIKES:
                slots.append([(char, WHOLE), ("", SPLIT if char == " " else INNER)])
            elif _letter(char):
                slots.append([(char, 0.0)] if n == 1 else [(char, REPEATED), (char * 2, 0.0 if n == 2 else REPEATED), *[(char * n, AS_IS)] * (n > 2)])
            elif char in LOOKALIKES:
                for _ in range(n):
                    slots.append([*((c, SUBSTITUTED) for c in LOOKALIKES[char]), (char, LEFT)])
            else:
                slots.append([(char * n, 0.0)])
            i = j
        return slots

    def decode(self, span: str) -> str:
        logs = self.logs
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for readings in [*self.lattice(span), [(" ", 0.0)]]:
            reached: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in states.items():
                for out, price in readings:
                    x, y, total = a, b, cost + price
                    for char in out:
                        z = _letter(char)
                        total -= logs[x][y][z]
                        x, y = y, z
                    if (x, y) not in reached or total < reached[x, y][0]:
                        reached[x, y] = (total, (path, out))
            states = reached
        path = min(states.values(), key=lambda s: s[0])[1]
        parts = []
        while path:
            path, out = path
            parts.append(out)
        return "".join(reversed(parts[1:]))

    def restore(self, text: str) -> str:
        """The text with every disguised span replaced by its reading, each at its place."""
        parts, end = [], 0
        for a, b in suspects(text, self.gains):
            span = text[a:b]
            if (read := self[span]) != span.lower():
                parts += [text[end:a], read]
                end = b
        return "".join([*parts, text[end:]]) if parts else text


def feature_hashes(word: str) -> list[int]:
    """Hashes of a word's whole form and of its first letters."""
    return [zlib.crc32(f"{n}{word[:n]}".encode()) for n in PREFIXES if len(word) >= n] + [zlib.crc32(f"w{word}".encode())]


class WordEvidence(dict):
    """Word to the largest log odds of its features; 0 where none speaks for label 1."""

    def __init__(self, odds: dict[int, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = x = max(map(self.odds.get, feature_hashes(word), (0.0, 0.0, 0.0, 0.0)))
        return x

    def top(self, text: str) -> list[float]:
        """The three strongest distinct words of a text, and the number of strong ones on a log scale."""
        found = sorted(filter(None, map(self.__getitem__, set(_WORDS.findall(text.lower())))), reverse=True)
        return [*(found + [0.0, 0.0, 0.0])[:3], math.log1p(len(found))]


@dataclass
class ToxicModel:
    logs: np.ndarray
    odds: dict[int, float]
    weights: np.ndarray


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept, by Newton's method; the ridge leaves the intercept alone."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
    return w


def _odds(counts, c0: str, c1: str, base: float) -> dict[int, float]:
    p = (counts[c1] + 4 * base) / (counts[c0] + counts[c1] + 4)
    return {int(b): float(v) for b, v in zip(counts["bucket"], np.log(p / (1 - p))) if v > 0}


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Character model of all documents; word odds and weights from at most `rows` labelled ones outside the held-out fold.

    Of near copies among these, which share one of eight least hashes of 5-word runs, the odds count one. The
    weights are fitted on each half of the sample under the odds of the other half. Without labelled rows of
    both kinds, every document gets the same low score.
    """
    spark = prepare(documents.sparkSession)
    logs = log_model(count_trigrams(documents))
    sample = labelled_sample(documents.select("doc_id", "text"), labels.select("doc_id", "toxic").dropna(), rows, SAMPLE_CHARS)
    sample = materialize(sample.select(F.xxhash64("doc_id", "text").alias("id"), "text", (F.col("toxic") > 0).alias("toxic")), "labelled")
    shared = spark.sparkContext.broadcast(logs)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            found, least = [], []
            for text in batch.column("text").to_pylist():
                restored = _WORDS.findall(decoder.restore(text or "").lower())
                found.append(sorted({b for w in set(restored) for b in feature_hashes(w)}))
                runs = {zlib.crc32(" ".join(restored[i : i + 5]).encode()) for i in range(max(1, len(restored) - 4))}
                h = np.fromiter(runs, np.uint64, len(runs))
                salted = [(h * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(zlib.crc32(bytes([k])) * 0x1000193)) * np.uint64(0xFF51AFD7ED558CCD) for k in range(COPIES)]
                least.append([int((s >> np.uint64(20)).min()) * COPIES + k for k, s in enumerate(salted)])
            yield pa.record_batch([batch.column("id"), batch.column("toxic"), pa.array(found, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))], ["id", "toxic", "found", "least"])

    features = materialize(sample.mapInArrow(featured, "id bigint, toxic boolean, found array<bigint>, least array<bigint>"), "features")
    hashes = features.select("id", F.explode("least").alias("h"))
    firsts = hashes.groupBy("h").agg(F.min("id").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == COPIES)
    single = features.join(firsts.select("id"), "id", "left_semi").dropDuplicates(["id"])
    half, one = F.pmod("id", F.lit(2)), F.col("toxic").cast("long")
    sums = [F.sum(F.when(half == h, one if t else 1 - one).otherwise(0)).alias(f"c{t}{h}") for h in (0, 1) for t in (0, 1)]
    totals = single.agg(*sums).first().asDict()
    totals = {k: v or 0 for k, v in totals.items()}
    n0, n1 = totals["c00"] + totals["c01"], totals["c10"] + totals["c11"]
    if not n0 or not n1:
        return ToxicModel(logs, {}, np.array([0.0] * 4 + [-3.0]))
    counts = single.select(F.explode("found").alias("bucket"), "id", "toxic").groupBy("bucket").agg(*sums).where("c10 + c11 > 1 and c10 + c11 >= c00 + c01").toPandas()
    base = n1 / (n0 + n1)
    counts["c0"], counts["c1"] = counts.c00 + counts.c01, counts.c10 + counts.c11
    halves = spark.sparkContext.broadcast([_odds(counts, "c00", "c10", base), _odds(counts, "c01", "c11", base)])

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        evidence = [WordEvidence(halves.value[1]), WordEvidence(halves.value[0])]
        for batch in batches:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            found = [evidence[i % 2].top(decoder.restore(t or "")) for i, t in zip(ids, texts)]
            yield pa.record_batch([batch.column("id"), batch.column("toxic"), pa.array(found, pa.list_(pa.float64()))], ["id", "toxic", "x"])

    seen = sample.mapInArrow(crossed, "id bigint, toxic boolean, x array<double>").toPandas().sort_values("id")
    weights = fit_logistic(np.array([np.array(x) for x in seen["x"]]), seen["toxic"].to_numpy(float))
    return ToxicModel(logs, _odds(counts, "c0", "c1", base), weights)


def score(df: DataFrame, model: ToxicModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """df with the struct out: restored (the deobfuscated text) and score (0 to 1).

    Null and empty texts restore to an empty one and get the score of a text without evidence. Whole texts are
    read, however long. Rows, ties, repeats and other columns stay; an input column named out is replaced.
    """
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((model.logs, model.odds, model.weights))

    @F.arrow_udf("struct<restored:string,score:double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("toxicity")
        logs, odds, weights = shared.value
        decoder, evidence = Decoder(logs), WordEvidence(odds)
        for batch in batches:
            restored = [decoder.restore(t) for some in text_slices(batch) for t in some]
            x = np.array([[*evidence.top(t), 1.0] for t in restored]).reshape(-1, 5)
            value = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
            yield pa.StructArray.from_arrays([pa.array(restored, pa.string()), pa.array(value)], ["restored", "score"])
        finish(decoder, evidence)

    return df.withColumn(out, scored(F.col(text)))
