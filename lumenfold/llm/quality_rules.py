"""Operator 9, quality rules: line sequence labelling with a linear-chain conditional random field.

Each line with a word is content or boilerplate. Viterbi decoding finds the best sequence of a document, and
the share of its characters in content lines decides whether it is kept. Base rules on counts come first.

No lines are labelled, documents are; the field is fitted by hard expectation maximisation from a weak rule. At
first a line is boilerplate if its document is bad, if it equals an earlier line of the document or if it recurs in
unlike documents of the sample, else content. Then lines are labelled anew by a field without transitions that is
fitted on these labels (with transitions, the one label of a document would hold its unlike lines); a good document
whose lines would be mostly boilerplate, or a bad one whose lines would be mostly content, keeps the labels of the
weak rule. The chains of the last labels give the whole field.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import SAMPLE_ROWS, begin, finish, labelled_sample, prepare, text_slices

SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_MARKS = b"#*$%&|<>!"
_DIGITS = b"0123456789"
FEATURES = 12
_RECURS, _FIRST, _LAST = 9, 10, 11
#: A line recurs if it stands in so many unlike documents of the sample, and these are so large a share of all that hold it:
#: most documents that share a line of a copied text are like each other.
RECURS, UNLIKE = 3, 0.5
#: Lines of a chain in fitting; longer documents are cut into such chains there.
CHAIN = 64
RESULT = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,content_share:double,kept:boolean,content:array<boolean>>"
)


class Numbered(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def repeat_words(documents: list[list[bytes]]) -> np.ndarray:
    """Of each document, the words in 3-word windows that it holds twice or more."""
    sizes = np.fromiter(map(len, documents), np.int64, len(documents))
    numbers = Numbered()
    word = np.fromiter((n for d in documents for n in map(numbers.__getitem__, d)), np.int64, int(sizes.sum()))
    of = np.repeat(np.arange(len(documents)), sizes)
    if len(word) < 3:
        return np.zeros(len(documents), np.int64)
    v = len(numbers)
    key = of[:-2] * v + word[:-2]
    for follows in (word[1:-1], word[2:]):
        if int(key.max()) >= (2**62) // v:
            key = np.unique(key, return_inverse=True)[1]
        key = key * v + follows
    inside = np.flatnonzero(of[:-2] == of[2:])
    if not len(inside):
        return np.zeros(len(documents), np.int64)
    _, back, counts = np.unique(key[inside], return_inverse=True, return_counts=True)
    again = inside[counts[back] > 1]
    covered = np.zeros(len(word), bool)
    for shift in range(3):
        covered[again + shift] = True
    return np.bincount(of[covered], minlength=len(documents))


def line_hash(line: bytes) -> int:
    """A signed 64-bit hash of a line without the white space at its ends."""
    import xxhash

    return xxhash.xxh3_64_intdigest(line.strip()) - (1 << 63)


def line_features(text: str, recurring: frozenset[int] | set[int] = frozenset(), hashes: list[int] | None = None) -> tuple[list[list[float]], list[int], int]:
    """Features and characters of each line with a word, and how many of these lines equal an earlier one.

    recurring: the hashes of lines that recur; the lines' own hashes are added to the list hashes.
    """
    rows, sizes, repeats = [], [], 0
    seen: set[bytes] = set()
    for line in text.encode().split(b"\n"):
        words = line.split()
        if not words:
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        n, chars = len(words), len(line)
        h = line_hash(line) if recurring or hashes is not None else 0
        if hashes is not None:
            hashes.append(h)
        rows.append(
            [
                1.0,
                min(n, 64) / 64,
                min(1.0, 8 * (chars - len(line.translate(None, _MARKS))) / chars),
                (chars - len(line.translate(None, _UPPER))) / chars,
                (chars - len(line.translate(None, _DIGITS))) / chars,
                sum(map(eq, words, words[1:])) / n,
                len(set(words)) / n,
                float(words[-1][-1:] in b".!?"),
                float(again),
                float(h in recurring),
                0.0,
                0.0,
            ]
        )
        sizes.append(len(line.decode()))
    if rows:
        rows[0][_FIRST] = rows[-1][_LAST] = 1.0
    return rows, sizes, repeats


def recurring_lines(hashes: np.ndarray, sizes: np.ndarray) -> set[int]:
    """The lines that recur in unlike documents; sizes: lines of each document.

    Documents are alike where they have the same least hash among their other lines; that is found under four
    salts, and the least count of unlike documents holds. So the lines of copies and near copies do not recur.
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    pairs = np.unique(np.stack([hashes, of]), axis=1)
    hashes, of = pairs
    unlike: np.ndarray | None = None
    lines, line, held = np.unique(hashes, return_inverse=True, return_counts=True)
    for salt in range(1, 5):
        x = hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * salt)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        by = np.lexsort([x, of])
        first = np.flatnonzero(np.diff(of[by], prepend=-1))
        n = np.diff(np.append(first, len(by)))
        least = x[by[first]]
        # of a document of one line, a value of its own
        second = np.where(n > 1, x[by[np.minimum(first + 1, len(by) - 1)]], np.arange(len(first), dtype=np.uint64))
        place = np.searchsorted(of[by[first]], of)
        other = np.where(x == least[place], second[place], least[place])
        kinds = np.unique(np.stack([line.astype(np.uint64), other]), axis=1)[0].astype(np.int64)
        count = np.bincount(kinds, minlength=len(lines))
        unlike = count if unlike is None else np.minimum(unlike, count)
    if unlike is None:
        return set()
    return set(lines[(unlike >= RECURS) & (unlike >= UNLIKE * held)].tolist())


class Crf:
    """Two labels (0 boilerplate, 1 content) on chains of lines; all chains of a batch go through at once."""

    def __init__(self, weights: np.ndarray | None = None, steps: np.ndarray | None = None, recurring: set[int] | None = None):
        self.weights = np.zeros((FEATURES, 2)) if weights is None else weights
        self.steps = np.zeros((2, 2)) if steps is None else steps
        self.recurring = recurring or set()

    @staticmethod
    def order(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chains by falling length, where each begins, and how many are still going at each step."""
        by = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[by]
        going = np.searchsorted(-sizes[by], -np.arange(int(sizes.max(initial=0))), side="left")
        return by, starts, going

    def decode(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best label of each line; a tie is content."""
        emit = features @ self.weights
        _, starts, going = self.order(sizes)
        labels = np.ones(len(features), np.int64)
        back = np.zeros((len(features), 2), np.int8)
        best = np.zeros((len(sizes), 2))
        for t, n in enumerate(going):
            at = starts[:n] + t
            if t:
                ways = best[:n, :, None] + self.steps
                back[at] = from_ = (ways[:, 1] >= ways[:, 0]).astype(np.int8)
                best[:n] = np.take_along_axis(ways, from_[:, None, :].astype(np.int64), 1)[:, 0]
            best[:n] += emit[at]
        state = np.zeros(len(sizes), np.int64)
        for t in range(len(going) - 1, -1, -1):
            ends = going[t + 1] if t + 1 < len(going) else 0
            state[ends : going[t]] = best[ends : going[t], 1] >= best[ends : going[t], 0]
            at = starts[: going[t]] + t
            labels[at] = state[: going[t]]
            state[: going[t]] = back[at, state[: going[t]]]
        return labels

    def fit(self, features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> Crf:
        """Maximum conditional likelihood by Adam on forward-backward gradients."""
        _, starts, going = self.order(sizes)
        truth = np.eye(2)[labels]
        pairs = np.zeros((2, 2))
        first = np.zeros(len(labels), bool)
        first[np.cumsum(sizes) - sizes] = True
        follows = np.flatnonzero(~first)
        np.add.at(pairs, (labels[follows - 1], labels[follows]), 1)
        m = [np.zeros_like(self.weights), np.zeros_like(self.steps)]
        s = [np.zeros_like(self.weights), np.zeros_like(self.steps)]
        for step in range(1, rounds + 1):
            emit = features @ self.weights
            e = np.exp(emit - emit.max(1, keepdims=True))
            move = np.exp(self.steps)
            fore, scale = np.zeros_like(e), np.ones(len(e))
            for t, n in enumerate(going):
                at = starts[:n] + t
                a = e[at] if not t else (fore[at - 1] @ move) * e[at]
                scale[at] = z = a.sum(1)
                fore[at] = a / z[:, None]
            rear = np.ones_like(e)
            expected = np.zeros((2, 2))
            for t in range(len(going) - 1, 0, -1):
                at = starts[: going[t]] + t
                ahead = e[at] * rear[at] / scale[at][:, None]
                rear[at - 1] = ahead @ move.T
                expected += (fore[at - 1].T @ ahead) * move
            node = fore * rear
            node /= node.sum(1, keepdims=True)
            for k, (value, slope) in enumerate(
                ((self.weights, features.T @ (node - truth) / len(e) + ridge * self.weights), (self.steps, (expected - pairs) / len(e) + ridge * self.steps))
            ):
                m[k] = 0.9 * m[k] + 0.1 * slope
                s[k] = 0.99 * s[k] + 0.01 * slope**2
                value -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        return self


def weak_labels(features: np.ndarray, sizes: np.ndarray, good: np.ndarray) -> np.ndarray:
    """1 (content) for lines of good documents that neither repeat an earlier line nor recur elsewhere."""
    return (np.repeat(good, sizes) & (features[:, _RECURS - 1] == 0) & (features[:, _RECURS] == 0)).astype(np.int64)


def fit_documents(features: np.ndarray, sizes: np.ndarray, chars: np.ndarray, good: np.ndarray, recurring: set[int], rounds: int = 3) -> Crf:
    """A field fitted on documents of known quality by hard expectation maximisation (see above)."""
    field = Crf(recurring=recurring)
    weak = labels = weak_labels(features, sizes, good)
    cuts = np.concatenate([[n - CHAIN * k if n - CHAIN * k < CHAIN else CHAIN for k in range(-(-n // CHAIN))] for n in sizes.tolist()]).astype(np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    total = np.maximum(np.bincount(of, chars, len(sizes)), 1)
    single = np.ones(len(features), np.int64)
    for _ in range(rounds - 1):
        alone = Crf().fit(features, single, labels)
        labels = alone.decode(features, single)
        share = np.bincount(of, chars * labels, len(sizes)) / total
        labels = np.where(((share >= 0.5) == good)[of], labels, weak)
    return field.fit(features, cuts, labels)


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Crf:
    """A field fitted on the lines of at most `rows` labelled documents outside the held-out fold (and of bounded size).

    Quality above 0 is good. Documents without lines teach nothing; without any others every line is content.
    """
    prepare(documents.sparkSession)
    sample = labelled_sample(documents.select("doc_id", "text"), labels.select("doc_id", "quality").dropna(), rows)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, hashes, chars = [], [], []
            for t in batch.column("text").to_pylist():
                own: list[int] = []
                x, size, _ = line_features(t or "", hashes=own)
                found.append(np.array(x, np.float32).ravel())
                hashes.append(own)
                chars.append(size)
            columns = [pa.array(found, pa.list_(pa.float32())), pa.array(hashes, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int32()))]
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality").cast(pa.int64()), *columns], ["doc_id", "quality", "x", "h", "n"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, quality bigint, x array<float>, h array<bigint>, n array<int>"
    got = sample.select("doc_id", "text", "quality").mapInArrow(lines, shape).toPandas()
    got = got[got.h.map(len) > 0].sort_values("doc_id")
    if not len(got):
        return Crf()
    sizes = got.h.map(len).to_numpy(np.int64)
    features = np.concatenate([np.array(x, float) for x in got.x]).reshape(-1, FEATURES)
    hashes = np.concatenate([np.array(h, np.int64) for h in got.h])
    recurring = recurring_lines(hashes, sizes)
    features[:, _RECURS] = np.isin(hashes, np.fromiter(recurring, np.int64, len(recurring)))
    return fit_documents(features, sizes, np.concatenate(got.n.to_list()).astype(np.int64), (got.quality > 0).to_numpy(), recurring)


def label_lines(df: DataFrame, field: Crf, least_share: float = 0.5, text: str = "text", out: str = "rules") -> DataFrame:
    """df with the struct out: the base counts, base_failed, content (labels of the lines with a word),
    content_share (of the characters in such lines) and kept.

    kept is false where base_failed (under 50 words, or over half of the words in repeated 3-word windows), else
    content_share >= least_share. Null and empty texts have no lines: all counts 0, share 0, not kept. Rows,
    ties, repeats and other columns stay; an input column named out is replaced.
    """
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((field.weights, field.steps, field.recurring))

    @F.arrow_udf(RESULT)
    def rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("quality_rules")
        crf = Crf(*shared.value)
        for batch in batches:
            parts = [_label(crf, some, least_share) for some in text_slices(batch)]
            yield pa.concat_arrays(parts) if parts else pa.array([], _ARROW)
        finish()

    return df.withColumn(out, rules(F.col(text)))


_ARROW = pa.struct(
    [
        *[(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ("base_failed", pa.bool_()),
        ("content_share", pa.float64()),
        ("kept", pa.bool_()),
        ("content", pa.list_(pa.bool_())),
    ]
)


def _label(crf: Crf, texts: list[str], least_share: float) -> pa.StructArray:
    words = [t.encode().split() for t in texts]
    n_words = np.fromiter(map(len, words), np.int64, len(texts))
    repeats = repeat_words(words)
    lines = [line_features(t, crf.recurring) for t in texts]
    sizes = np.fromiter((len(x[0]) for x in lines), np.int64, len(texts))
    features = np.array([row for x in lines for row in x[0]], float).reshape(-1, FEATURES)
    content = crf.decode(features, sizes) > 0
    chars = np.array([n for x in lines for n in x[1]], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    total = np.bincount(of, chars, len(texts))
    share = np.where(total > 0, np.bincount(of, chars * content, len(texts)) / np.maximum(total, 1), 0.0)
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    word_chars = np.array([len(t) - sum(map(t.count, " \t\n\r\x0b\x0c")) for t in texts], np.int64)
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    dup = np.array([x[2] for x in lines], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    columns = [n_words, word_chars, symbols, dup, repeats.astype(np.int64), failed, share, ~failed & (share >= least_share)]
    return pa.StructArray.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(offsets), pa.array(content))], fields=list(_ARROW))
