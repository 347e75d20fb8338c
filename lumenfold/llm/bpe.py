"""Operator 10, byte-level BPE encoding and decoding in length-bucketed padded matrices.

Pieces of like length are the rows of a padded numpy matrix of ids. In each round every row merges its leftmost
pair of least rank, found through a hash table of pairs, and is compacted; rows without a mergeable pair leave.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.chunks import ChunkPool
from lumenfold.llm.common import SLICE_CHARS, begin, finish, holds, prepare

#: No rank: larger than any.
NONE = np.int32(2**31 - 1)
#: Pieces of more bytes are merged with a heap: rounds times width would grow with the square of the length.
LONGEST_ROW = 512
#: Cells of a matrix at most.
CELLS = 1 << 20


class PairTable:
    """Rank of the token that two adjacent ids concatenate to, in an open-addressing hash table."""

    def __init__(self, tokens: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in tokens.items():
            for i in range(1, len(token)):
                if (a := tokens.get(token[:i])) is not None and (b := tokens.get(token[i:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, 4 * len(keys))))))
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, values = self.slot(keys), np.array(merged, np.int32)
        while len(keys):
            empty = self.keys[slot] == 2**64 - 1
            first = np.zeros(len(keys), bool)
            first[np.unique(np.where(empty, slot, -1), return_index=True)[1]] = True
            put = empty & first
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE for pairs that don't merge and where an id is negative."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | right.astype(np.int64).view(np.uint64)
        keys[(left < 0) | (right < 0)] = np.uint64(2**64 - 2)
        slot = self.slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        on = np.flatnonzero((found != keys) & (found != 2**64 - 1))
        while len(on):
            slot[on] = (slot[on] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[on]]
            hit = found == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (found != 2**64 - 1)]
        return out


class ByteBpe:
    """Byte-level BPE by ranks: encode pieces, whole texts and decode ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(self.tokens)
        self.of_byte = np.array([self.tokens[bytes([b])] for b in range(256)], np.int32)
        most = max(self.tokens.values()) + 1
        by_id = [b""] * most
        for token, i in self.tokens.items():
            by_id[i] = token
        self.bytes_of = np.frombuffer(b"".join(by_id), np.uint8)
        self.n_bytes = np.fromiter(map(len, by_id), np.int64, most)
        self.first_byte = np.cumsum(self.n_bytes) - self.n_bytes
        self.pool = ChunkPool(self.encode_chunks)

    def encode_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks and their numbers: each match of the pattern is encoded alone."""
        cut = [self.pattern.findall(c) for c in new]
        n_parts = np.fromiter(map(len, cut), np.int64, len(cut))
        parts = list(chain.from_iterable(cut))
        names = dict(zip(dict.fromkeys(parts), count()))
        flat, lengths = self.encode_pieces([p.encode() for p in names])
        starts = np.cumsum(lengths) - lengths
        place = np.fromiter(map(names.__getitem__, parts), np.int64, len(parts))
        sizes = lengths[place]
        before = np.concatenate([[0], np.cumsum(sizes)])
        pick = np.repeat(starts[place] - before[:-1], sizes) + np.arange(before[-1])
        return flat[pick], np.diff(np.concatenate([[0], before[np.cumsum(n_parts)]]))

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and the number of ids of each. A piece that is a token is that token."""
        lengths = np.ones(len(pieces), np.int64)
        whole = np.fromiter(map(self.tokens.get, pieces, repeat(-1)), np.int32, len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rest = np.flatnonzero(whole < 0)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in rest[sizes[rest] > LONGEST_ROW].tolist():
            ids = self.encode_long(pieces[i])
            lengths[i] = len(ids)
            found.append((np.array([i]), ids))
        width, least = 4, 0
        while width <= LONGEST_ROW:
            members = rest[(sizes[rest] > least) & (sizes[rest] <= width)]
            step = CELLS // width
            for k in range(0, len(members), step):
                some = members[k : k + step]
                rows = self.merge_rows([pieces[i] for i in some.tolist()], sizes[some], width)
                inside = rows >= 0
                lengths[some] = inside.sum(1)
                found.append((some, rows[inside]))
            width, least = 2 * width, width
        ends = np.cumsum(lengths)
        flat = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        single = whole >= 0
        flat[(ends - 1)[single]] = whole[single]
        for some, ids in found:
            n = lengths[some]
            flat[np.repeat(ends[some] - np.cumsum(n), n) + np.arange(len(ids))] = ids
        return flat, lengths

    def merge_rows(self, pieces: list[bytes], size: np.ndarray, width: int) -> np.ndarray:
        """The matrix of merged ids, one row a piece, padded with -1."""
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        done = np.full_like(ids, -1)
        live = np.arange(len(pieces))
        ranks = np.full((len(pieces), width), NONE, np.int32)
        ranks[:, :-1] = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        columns = np.arange(width - 1)
        while len(live):
            at = ranks.argmin(1)
            row = np.arange(len(live))
            best = ranks[row, at]
            if (over := best == NONE).any():
                done[live[over]] = ids[over]
                keep = ~over
                live, ids, ranks, at, best = live[keep], ids[keep], ranks[keep], at[keep], best[keep]
                row = np.arange(len(live))
                if not len(live):
                    break
            ids[row, at] = best
            ids[:, :-1] = np.where(columns > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(columns >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            ranks[row, at] = np.where(at < width - 1, self.pairs(best, ids[row, np.minimum(at + 1, width - 1)]), NONE)
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.pairs(ids[some, at[some] - 1], best[some])
        return done

    def encode_long(self, piece: bytes) -> np.ndarray:
        """As merge_rows for one long piece, with a heap and a linked list."""
        parts: list[bytes | None] = [bytes([b]) for b in piece]
        n, rank = len(parts), self.tokens.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) < 0 or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(both := parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(both)))
            if (h := before[i]) >= 0 and (r := rank(both := parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(both)))
        return np.array([self.tokens[p] for p in parts if p is not None], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.pool.encode(texts)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, as an array."""
        parts = [np.empty(0, np.uint8)]
        for k in range(0, len(ids), CELLS // 4):
            some = ids[k : k + CELLS // 4]
            n = self.n_bytes[some]
            if (n == 0).any() or (some < 0).any():
                raise ValueError("an id that the vocabulary lacks")
            ends = np.cumsum(n)
            pick = np.repeat(self.first_byte[some] - ends + n, n)
            pick += np.arange(len(pick))
            parts.append(self.bytes_of[pick])
        return np.concatenate(parts)


@functools.lru_cache(2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


holds("bpe", load.cache_clear)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the column out: the ids (array of int) of each whole text under the ranks in path.

    Special strings are ordinary text. Null and empty texts: an empty array. Pieces over 512 bytes are merged
    with a heap, to the same result. Rows are kept one for one, with ties, repeats and all other columns; an
    input column named out is replaced. An empty table gives an empty table.
    """
    prepare(df.sparkSession)

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("bpe")
        bpe = load(path, pattern)
        for batch in batches:
            yield _ids(bpe, batch)
        finish()

    return df.withColumn(out, ids_of(F.col(text)))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encode() and decode() of the ids that it gives, in one pass: the ids don't go back to a second Python worker."""
    prepare(df.sparkSession)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin("bpe")
        bpe = load(path, pattern)
        for batch in batches:
            found = _ids(bpe, batch)
            yield pa.StructArray.from_arrays([found, _bytes(bpe, found)], ["ids", "decoded"])
        del found
        finish()

    both = df.withColumn("__both", both_of(F.col(text)))
    return both.withColumn(ids, F.col("__both.ids")).withColumn(out, F.col("__both.decoded")).drop("__both")


def _ids(bpe: ByteBpe, texts: pa.Array) -> pa.ListArray:
    flat, counts = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
    for ids, n in bpe.pool.encode_array(texts, SLICE_CHARS):
        flat.append(ids)
        counts.append(n)
    offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))


def _bytes(bpe: ByteBpe, lists: pa.ListArray) -> pa.Array:
    lists = lists.fill_null([]) if lists.null_count else lists
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    if ids.dtype.kind == "f":
        raise ValueError("a null among the ids")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    before = np.concatenate([[0], np.cumsum(bpe.n_bytes[ids])])
    ends = before[offsets - offsets[0]].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends), pa.py_buffer(bpe.decode(ids))])


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column out: the bytes (binary) that the ids stand for.

    Null and empty arrays: no bytes. An id that the vocabulary lacks, or a null inside an array, is an error.
    Rows, ties, repeats and other columns stay; an input column named out is replaced.
    """
    prepare(df.sparkSession)

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path, pattern)
        for batch in batches:
            yield _bytes(bpe, batch)

    return df.withColumn(out, bytes_of(F.col(ids)))
