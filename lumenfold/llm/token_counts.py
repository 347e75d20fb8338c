"""Operator 5, token counts: byte-pair merging with a heap and a linked list.

The lowest-rank adjacent pair is merged again and again; a text's count is the number of its initial symbols
less the number of merges, so that no identifiers are made. A character that the vocabulary lacks starts as
one symbol for each of its UTF-8 bytes, which never merge.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.chunks import chunks, cut_runs
from lumenfold.llm.common import prepare, text_slices

SPACE = "▁"
#: Chunks whose counts a worker keeps; when full the store starts anew.
KEPT_CHUNKS = 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else 4 if key & 7 == 5 else 8
        yield key >> 3, raw[i : i + size]
        i += size


class PieceCounter(dict):
    """Chunk to number of tokens under a sentencepiece BPE model; a missing chunk is merged when asked for."""

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        norm = dict(_fields(next(v for k, v in top if k == 3)))
        train = dict(_fields(next(v for k, v in top if k == 2)))
        if train.get(3) != 2 or not train.get(35) or norm.get(2) or norm.get(4, 1):
            raise ValueError("only BPE models with byte fallback and the identity normaliser are supported")
        self.dummy_prefix = bool(norm.get(3, 1))
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        order = sorted(plain, key=lambda i: -model.get_score(i))
        self.ranks = {model.id_to_piece(i): rank for rank, i in enumerate(order)}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ranks):
            raise ValueError("a piece holds a space or newline inside: chunks can't be counted alone")

    def __missing__(self, chunk: str) -> int:
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        self[chunk] = n = self.merge(chunk)
        return n

    def merge(self, chunk: str) -> int:
        """Tokens of one chunk: initial symbols less merges."""
        symbols: list[str | None] = list(chunk.replace(" ", SPACE))
        n, ranks = len(symbols), self.ranks
        count = sum(1 if s in ranks else len(s.encode()) for s in symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(symbols[i] + symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if symbols[i] is None or (j := after[i]) < 0 or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one of the two has merged with another since
            symbols[i] += symbols[j]
            symbols[j] = None
            count -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(both := symbols[i] + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, len(both)))
            if (h := before[i]) >= 0 and (r := ranks.get(both := symbols[h] + symbols[i])) is not None:
                heapq.heappush(heap, (r, h, len(both)))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = f" {text}" if self.dummy_prefix else text
        parts = cut_runs(text.replace(SPACE, " ")) if SPACE in text else chunks(text)
        return sum(map(self.__getitem__, parts))


@functools.lru_cache(2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(df: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with the column out: how many tokens the sentencepiece model gives each whole text.

    Null and empty texts: 0. Very long texts are merged chunk by chunk. Rows are kept one for one, with ties,
    repeats and all other columns; an input column named out is replaced. An empty table gives an empty table.
    """
    prepare(df.sparkSession)

    @F.arrow_udf("bigint")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(model_path)
        for batch in batches:
            yield pa.array([counter.count(t) for some in text_slices(batch) for t in some], pa.int64())

    return df.withColumn(out, counts(F.col(text)))
