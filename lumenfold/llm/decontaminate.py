"""Operator 2, benchmark decontamination with a generalised suffix automaton over words.

The normalised test items make one automaton. Training words stream through it while the longest suffix that
some item holds is tracked; where it reaches the window length, the window's words are hit. The spans of hit
words can then be cut out, and documents dropped whose hit share is over a limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import begin, finish, prepare, text_slices
from lumenfold.session import materialize

#: Item words in one broadcast automaton, by default (some 200 MB in a worker); a longer benchmark goes in blocks, each a
#: pass of its own over a written table, so that a task holds one automaton at a time. Workers with more memory
#: take larger blocks and so fewer passes: 1 000 bytes a word.
BLOCK_WORDS = 200_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>,cleaned:string>"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("cleaned", pa.string()),
    ]
)


def words_of(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of digits, a-z and all beyond ASCII."""
    return text.encode().translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of word sequences with the items that hold each window."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: dict[int, set[str]] = {}
        short: dict[int, dict[str, int]] = {}
        self.least = window
        for name, words in items:
            state = 0
            for word in words:
                state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
                owners.setdefault(state, set()).add(name)
            if 0 < len(words) < window:
                short.setdefault(state, {})[name] = len(words)
                self.least = min(self.least, len(words))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: The state of the last `window` words, for states of that length or more.
        self.last = list(range(len(self.next)))
        for v in order:
            if self.length[self.link[v]] >= window:
                self.last[v] = self.last[self.link[v]]
        for v in reversed(order):
            if self.length[self.link[v]] >= window:
                owners.setdefault(self.link[v], set()).update(owners.get(v, ()))
        self.owners = {v: frozenset(owners.get(v, ())) for v in order if self.length[v] >= window > self.length[self.link[v]]}
        #: The longest suffix of a state that holds a whole short item, that items themselves and the next one.
        self.short = short
        self.short_at = [-1] * len(self.next)
        for v in order:
            self.short_at[v] = v if v in short else self.short_at[self.link[v]] if self.link[v] > 0 else -1

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            return self._clone(last, q, word)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        elif self.length[q := self.next[p][word]] == self.length[p] + 1:
            self.link[new] = q
        else:
            self.link[new] = self._clone(p, q, word)
        return new

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(0 if like is None else self.link[like])
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, word: int) -> int:
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans [start, end) of hit words, and the items whose windows occur."""
        known = np.fromiter(map(self.vocabulary.__contains__, words), bool, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).view(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start < self.least:
                continue
            state = size = 0
            for i in range(start, end):
                word = self.vocabulary[words[i]]
                while state and word not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if (to := self.next[state].get(word)) is None:
                    continue
                state, size = to, size + 1
                reach = 0
                if size >= self.window:
                    reach = self.window
                    items |= self.owners[self.last[state]]
                if (v := self.short_at[state]) >= 0:
                    while v >= 0:
                        for name, n in self.short[v].items():
                            if n <= size:
                                items.add(name)
                                reach = max(reach, n)
                        v = self.short_at[self.link[v]] if self.link[v] > 0 else -1
                if reach:
                    begin = i + 1 - reach
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, i + 1))
        return spans, items


def _blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size, one block on the driver at a time."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in items.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        words = words_of(row[1])
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row[0], words))
        size += len(words)
    yield block


def find_leaks(df: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "leaks", longest: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """df with the struct out: n_words, n_hit, items (sorted ids as strings), spans of hit words and cleaned.

    cleaned is the text without the spans of over `longest` words; null where nothing is cut. block_words: item
    words in one automaton, and so in one pass over df.

    A window is `window` consecutive item words, or a whole item of fewer. Spans are merged and count words
    from 0, end excluded. Null and empty texts have no words, items without words no windows; items that share
    an id, and repeated items, count once; a null id is ''. Rows of df, ties, repeats and other columns stay;
    an input column named out is replaced. Without items, or without rows, nothing is hit.
    """
    spark: SparkSession = prepare(df.sparkSession)
    found = df.withColumn(out, F.lit(None).cast(RESULT))
    for k, block in enumerate(_blocks(items, item_id, item_text, block_words)):
        found = materialize(found, "leaks") if k else found
        shared = spark.sparkContext.broadcast(Automaton(block, window))
        found = found.withColumn(out, _pass(shared, longest)(F.col(text), F.col(out)))
    return found


def _pass(shared, longest: int):
    @F.arrow_udf(RESULT)
    def leaks(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        begin("decontaminate")
        automaton = shared.value
        for texts, before in batches:
            rows = []
            earlier = iter(before.to_pylist() if before.null_count < len(before) else [None] * len(before))
            for some in text_slices(texts):
                for text in some:
                    words = words_of(text)
                    spans, items = automaton.find(words)
                    if (old := next(earlier)) is not None:
                        items |= set(old["items"])
                        spans = _merged(spans + [(s["start"], s["end"]) for s in old["spans"]])
                    n_hit = sum(b - a for a, b in spans)
                    cut = [(a, b) for a, b in spans if b - a > longest]
                    rows.append({"cleaned": cut_spans(text, cut) if cut else None, "n_words": len(words), "n_hit": n_hit, "items": sorted(items), "spans": [{"start": a, "end": b} for a, b in spans]})
            yield pa.array(rows, _ARROW)
        finish()

    return leaks


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans of words; what stands between two words of a span goes with them."""
    raw = text.encode()
    at = [m.span() for m in WORD.finditer(raw.lower())]
    kept, end = [], 0
    for a, b in spans:
        kept.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*kept, raw[end:]]).decode()


def remove_leaks(df: DataFrame, text: str = "text", leaks: str = "leaks", coverage: float = 0.5) -> DataFrame:
    """df without documents whose hit share exceeds coverage, and with the cleaned texts of the others.

    Works on the column that find_leaks() adds, and keeps it. A document without words stays as it is.
    """
    clean = df.where(F.col(leaks)["n_hit"] <= coverage * F.col(leaks)["n_words"])
    return clean.withColumn(text, F.coalesce(F.col(leaks)["cleaned"], F.col(text)))
