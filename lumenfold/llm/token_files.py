"""Operator 8, token-id files with Re-Pair grammar compression.

Documents are encoded in ascending order of their ids and written in shards. Within a shard pairs of
neighbouring symbols that stand often enough to repay a rule are replaced by nonterminals, round by round until
there is none, never across the end of a document. A shard
stores its rules, how many ids each nonterminal expands to, and how many symbols and ids each document has,
so that any document, or any run of ids in it, is decoded alone.

A shard is one row of a Parquet table (whose writers and committers survive lost executors):
part, number     the range partition and the shard's place in it
before, n_ids    ids of earlier shards of the partition, ids of this one
docs             the documents' ids in order
payload          "RPG2", then as little-endian unsigned 32-bit integers: the numbers of documents, terminals,
                 rules and symbols and the bytes of a symbol (2 or 4); per document its symbols, then per document
                 its ids; the terminals; per rule its expansion length; then, in that many bytes each, per
                 rule its left and its right symbol, and the symbols. Symbols below the number of
                 terminals are terminals, others rules.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lumenfold.llm.chunks import ChunkPool
from lumenfold.llm.common import SLICE_CHARS, prepare

MAGIC = b"RPG2"
#: Ids in a shard; a longer document is a shard of its own.
SHARD_IDS = 1_000_000
#: Up to so many terminals and rules a stored symbol takes two bytes, beyond four.
NARROW = 1 << 16
#: Buckets in which pairs are counted first, as a power of two.
HASH_BITS = 20


class Encoder:
    """Ids that the tokenizers library gives whole texts; equal chunks are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.pool = ChunkPool(self.encode_new, special, limit=600_000, limit_ids=5_000_000)

    def encode_new(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        return np.array(found.ids, np.int32), np.bincount(np.array(found.word_ids, np.int64), minlength=len(new))


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Grammar:
    """Terminals, rules (pairs of symbols), expansion lengths and the symbols of one shard."""

    def __init__(self, terminals: np.ndarray, rules: np.ndarray, lengths: np.ndarray, symbols: np.ndarray):
        self.terminals, self.rules, self.lengths, self.symbols = terminals, rules, lengths, symbols

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for."""
        n = len(self.terminals)
        parts, sizes = self._rule_ids
        every = np.concatenate([np.ones(n, np.int64), sizes])
        starts = np.concatenate([np.arange(n), n + np.cumsum(sizes) - sizes])
        flat = np.concatenate([self.terminals, parts])
        size = every[symbols]
        ends = np.cumsum(size)
        pick = np.repeat(starts[symbols] - ends + size, size)
        pick += np.arange(len(pick))
        return flat[pick]

    @functools.cached_property
    def _rule_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of all rules, one after the other, and their lengths."""
        n, x = len(self.terminals), self.rules.reshape(-1)
        while len(x) and (x >= n).any():
            inner = x >= n
            size = 1 + inner.astype(np.int64)
            at = np.cumsum(size) - size
            out = np.empty(int(size.sum()), np.int64)
            out[at[~inner]] = x[~inner]
            out[at[inner]], out[at[inner] + 1] = self.rules[x[inner] - n].T
            x = out
        return self.terminals[x], self.lengths


def width_of(symbols: int) -> int:
    """Bytes of a stored symbol where there are so many terminals and rules."""
    return 2 if symbols <= NARROW else 4


def repays(width: int) -> int:
    """The least number of replacements that save more bytes than a rule (two symbols and a length) takes."""
    return (2 * width + 4) // width + 1


def compress(ids: np.ndarray, sizes: np.ndarray, least: int = 0) -> tuple[Grammar, np.ndarray]:
    """A grammar for the ids of documents of the given sizes, and the symbols that each document has.

    Each round replaces the pairs that stand often enough to repay their rules, the most frequent winning where
    two overlap; it ends where no pair repays its rule. Past NARROW symbols all of them take twice the bytes: the
    rounds go on, and of the two grammars, that at the limit and the last, the one of fewer bytes is given.
    least: replacements that a rule must make, if more than it needs to repay.
    """
    terminals, symbols = _dense(ids)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    lengths = np.ones(len(terminals), np.int64)
    rules: list[np.ndarray] = []

    def grammar() -> tuple[Grammar, np.ndarray]:
        n_symbols = np.zeros(len(sizes), np.int64)
        n_symbols[sizes > 0] = np.diff(np.concatenate([[-1], np.flatnonzero(last)]))
        return Grammar(terminals, np.concatenate([np.empty((0, 2), np.int64), *rules]), lengths[len(terminals) :], symbols), n_symbols

    narrow = None
    # where pairs begin that can still be frequent: a pair that is rare stays so, only new symbols make new ones
    live = np.flatnonzero(~last)
    while len(live):
        n = len(lengths)
        enough = max(least, repays(width_of(n + 1)))
        # a pair is one key: of 32 bits if the symbols are few enough
        shift = max(1, (n - 1).bit_length())
        kind, factor, bits = (np.uint32, 0x9E3779B1, 32) if shift <= 16 else (np.uint64, 0x9E3779B97F4A7C15, 64)
        key = (symbols[live].astype(kind) << kind(shift)) | symbols[live + 1].astype(kind)
        hashed = ((key * kind(factor)) >> kind(bits - HASH_BITS)).astype(np.int32)
        # a count of hash buckets first: only keys in full buckets are sorted
        full = (np.bincount(hashed, minlength=1 << HASH_BITS) >= enough)[hashed]
        live, key, hashed = live[full], key[full], hashed[full]
        # in a run of one symbol every second pair counts
        runs = np.concatenate([[False], (np.diff(live) == 1) & (key[1:] == key[:-1])]) if len(live) else np.empty(0, bool)
        begin = np.maximum.accumulate(np.where(runs, 0, np.arange(len(live))))
        even = np.flatnonzero((np.arange(len(live)) - begin) % 2 == 0)
        pairs, counts = np.unique(key[even], return_counts=True)
        chosen = np.flatnonzero(counts >= enough)
        if not len(chosen):
            break
        chosen = chosen[np.argsort(-counts[chosen], kind="stable")]
        if n < NARROW:
            chosen = chosen[: NARROW - n]
        elif narrow is None:
            narrow = grammar()
        pair = pairs[chosen]
        # of chosen pairs in one bucket the most frequent goes first, others wait for the next round
        bucket = ((pair * kind(factor)) >> kind(bits - HASH_BITS)).astype(np.int64)
        rank_of = np.full(1 << HASH_BITS, -1, np.int32)
        rank_of[bucket[::-1]] = np.arange(len(pair) - 1, -1, -1)
        rank = rank_of[hashed[even]]
        same = (rank >= 0) & (pair[rank] == key[even])
        at, rank = live[even[same]], rank[same]
        # of overlapping pairs the more frequent
        beside = np.diff(at) == 1
        wins = np.ones(len(at), bool)
        wins[1:] &= ~(beside & (rank[:-1] < rank[1:]))
        wins[:-1] &= ~(beside & (rank[1:] < rank[:-1]))
        at, rank = at[wins], rank[wins]
        # what lost too many places no longer repays; the most frequent pair loses none
        met = np.bincount(rank, minlength=len(pair)) >= enough
        made = met[rank]
        at, rank = at[made], (np.cumsum(met) - 1)[rank[made]]
        used = np.flatnonzero(met)
        rule = np.stack([pair[used] >> kind(shift), pair[used] & kind((1 << shift) - 1)], 1).astype(np.int64)
        rules.append(rule)
        lengths = np.concatenate([lengths, lengths[rule].sum(1)])
        if narrow is not None:
            symbols = symbols.copy()
        symbols[at] = n + rank
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        begins = np.zeros(len(symbols), bool)
        begins[live] = begins[at] = True
        symbols, last, begins = symbols[stay], last[stay], begins[stay]
        new = at - np.arange(len(at))
        begins[np.maximum(new - 1, 0)] = True
        live = np.flatnonzero(begins & ~last)
    found = grammar()
    return found if narrow is None or stored_bytes(found[0]) < stored_bytes(narrow[0]) else narrow


def stored_bytes(grammar: Grammar) -> int:
    """Bytes of a packed grammar's rules and symbols."""
    width = width_of(len(grammar.terminals) + len(grammar.rules))
    return (2 * width + 4) * len(grammar.rules) + width * len(grammar.symbols)


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and, for each id, its place among them."""
    present = np.bincount(ids) > 0 if len(ids) else np.zeros(0, bool)
    return np.flatnonzero(present), (np.cumsum(present, dtype=np.int32) - 1)[ids] if len(ids) else np.empty(0, np.int32)


def pack(grammar: Grammar, n_symbols: np.ndarray, n_ids: np.ndarray) -> bytes:
    width = width_of(len(grammar.terminals) + len(grammar.rules))
    head = np.array([len(n_ids), len(grammar.terminals), len(grammar.rules), len(grammar.symbols), width])
    parts = [head, n_symbols, n_ids, grammar.terminals, grammar.lengths]
    small = np.concatenate([grammar.rules.reshape(-1), grammar.symbols])
    return MAGIC + np.concatenate(parts).astype("<u4").tobytes() + small.astype(f"<u{width}").tobytes()


class Shard:
    """A packed shard; decodes everything, one document or a run of a document's ids."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, terminals, rules, symbols, width = np.frombuffer(payload, "<u4", 5, 4).tolist()
        at = 24

        def numbers(n: int) -> np.ndarray:
            nonlocal at
            at += 4 * n
            return np.frombuffer(payload, "<u4", n, at - 4 * n).astype(np.int64)

        self.n_symbols, self.n_ids = numbers(docs), numbers(docs)
        head, lengths = numbers(terminals), numbers(rules)
        pairs = np.frombuffer(payload, f"<u{width}", 2 * rules, at).astype(np.int64).reshape(-1, 2)
        self.grammar = Grammar(head, pairs, lengths, np.frombuffer(payload, f"<u{width}", symbols, at + 2 * rules * width))
        self.ends = np.cumsum(self.n_symbols)

    def all(self) -> np.ndarray:
        return self.grammar.expand(self.grammar.symbols)

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of document k; only the symbols that cover them are expanded."""
        symbols = self.grammar.symbols[self.ends[k] - self.n_symbols[k] : self.ends[k]]
        stop = int(self.n_ids[k]) if stop is None else min(stop, int(self.n_ids[k]))
        size = np.concatenate([np.ones(len(self.grammar.terminals), np.int64), self.grammar.lengths])[symbols]
        ends = np.cumsum(size)
        first, final = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
        before = int(ends[first - 1]) if first else 0
        return self.grammar.expand(symbols[first : final + 1])[start - before : max(start, stop) - before]


def write_shards(df: DataFrame, path: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text, append end_id and write the shards to path.

    Null and empty texts give end_id alone. Rows go by key, nulls first, then by a hash of the text and by the
    text, so that ties and repeated rows have a fixed order and all stay; the rows of one key may go to many tasks,
    rows that are equal throughout go to one, which streams them. Special strings are handled as the tokenizer
    file says. Other columns are left out; an empty table gives an empty file set.
    """
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(text).alias("place"))
    ordered = rows.repartitionByRange("doc", "place").sortWithinPartitions("doc", "place", "text").drop("place")
    kind = ordered.schema["doc"].dataType
    schema = f"part int, number int, before bigint, n_ids bigint, docs array<{kind.simpleString()}>, payload binary"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        part, number, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal docs, ids, sizes, held, number, before
            size = np.concatenate(sizes)
            grammar, n_symbols = compress(np.concatenate(ids), size)
            out = pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, sum(map(len, docs))], pa.int32()), pa.concat_arrays(docs)), pa.array([pack(grammar, n_symbols, size)], pa.binary())],
                ["part", "number", "before", "n_ids", "docs", "payload"],
            )
            number, before = number + 1, before + held
            docs, ids, sizes, held = [], [], [], 0
            return out

        for batch in batches:
            k = 0
            for flat, n in encode.pool.encode_array(batch.column("text"), SLICE_CHARS):
                ends = np.cumsum(n)
                closed = np.full(len(flat) + len(n), end_id, np.int32)
                closed[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
                if held and held + len(closed) > shard_ids:
                    yield shard()
                docs.append(batch.column("doc").slice(k, len(n)))
                ids.append(closed)
                sizes.append(n + 1)
                held += len(closed)
                k += len(ends)
        if held:
            yield shard()

    ordered.mapInArrow(shards, schema).write.parquet(path)


def read_shards(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before), n_ids and data (the ids as little-endian unsigned 32-bit integers).

    The only thing that goes through the driver is one sum for each range partition.
    """
    prepare(spark)
    stored = spark.read.parquet(path)
    sums = stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    offsets, total = {}, 0
    for row in sums:
        offsets[row["part"]] = total
        total += row["n"]
    shared = spark.sparkContext.broadcast(offsets)
    docs = stored.schema["docs"].dataType
    assert isinstance(docs, ArrayType)
    schema = StructType([StructField(key, docs.elementType), StructField("start", LongType()), StructField("n_ids", LongType())]).add("data", "binary")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                shard = Shard(batch.column("payload")[k].as_py())
                first = shared.value[batch.column("part")[k].as_py()] + batch.column("before")[k].as_py()
                ends = np.cumsum(shard.n_ids)
                data = shard.all().astype("<u4")
                offsets = (4 * np.concatenate([[0], ends])).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                columns = [batch.column("docs")[k].values, pa.array(first + ends - shard.n_ids), pa.array(shard.n_ids), binary]
                yield pa.record_batch(columns, [key, "start", "n_ids", "data"])

    return stored.select("part", "before", "docs", "payload").mapInArrow(decoded, schema)
