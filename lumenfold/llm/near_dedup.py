"""Operator 7, MinHash near-dedup by fast similarity sketching, banding and exact verification.

Each set of word shingles gets a sketch of BANDS * ROWS coordinates: in round i every shingle is hashed to one
bin and value, and bins still empty take the least value; after as many rounds as there are coordinates, round
i fills bin i alone, so that every coordinate is filled. Coordinates of two sets agree with the probability of
their similarity, with the concentration of independent ones. Equal sets are one node from the start. Nodes
that share a band are candidates:

1. Each node is verified against the least node of the bucket that it shares most often: most links of a
   group are found with one comparison a node. The nodes of a common least node are dealt to many tasks.
2. Buckets that still hold several components are compared in blocks of bounded rows and shingles: a product of
   incidence matrices gives all intersections of a block at once, and only links that join components leave it.
   No pairs are emitted for the test, and a hot bucket is spread over many tasks.

A link of similarity 0.8 is missed where none of 48 bands agrees, with a probability of 5e-9. Both steps test
links on the full sets, held as 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import begin, finish, prepare, text_slices
from lumenfold.llm.components import connected_components
from lumenfold.session import discard, materialize

BANDS, ROWS = 48, 5
#: Members of a bucket that one block holds, on average.
BLOCK = 1024
#: Shingles of all members of a block, on average; a member of more is as large as it is.
BLOCK_SHINGLES = 1 << 20
#: Nodes that one task verifies against a common least node, on average.
HUB_ROWS = 256
#: Cells of an incidence matrix at most.
CELLS = 4 << 20
#: Words whose hashes a worker keeps; when full the store starts anew.
KEPT_WORDS = 100_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return text.encode().translate(_FOLD).split()


def shingles_of(text: str, n: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(n)))) if len(words) >= n else {tuple(words)}


def linked(left: set, right: set, percent: int) -> bool:
    both = len(left & right)
    return bool(left and right) and 100 * both >= percent * (len(left) + len(right) - both)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * _A
    x ^= x >> np.uint64(33)
    x *= _B
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def shingles(self, text: str, n: int) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words = words_of(text)
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = min(n, len(words))
        x = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            x = mixed(x * _STEP + h[i : len(h) - n + 1 + i])
        return np.unique(x)


def sketch(hashes: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Fast similarity sketches, one row of `width` values for each set; sets must not be empty."""
    n = len(sizes)
    of = np.repeat(np.arange(n), sizes)
    empty = np.iinfo(np.uint64).max
    steps = _STEP * np.arange(1, 2 * width + 1, dtype=np.uint64)
    out = np.full(n * width, empty, np.uint64)
    open_bins = np.full(n, width)
    x, at = hashes, of * width
    for i in range(width):
        v = mixed(x + steps[i])
        bins = at + ((v >> np.uint64(40)) * np.uint64(width) >> np.uint64(24)).astype(np.int64)
        free = out[bins] == empty
        bins, v = bins[free], v[free]
        if len(bins):
            np.minimum.at(out, bins, mixed(v) >> np.uint64(1))
        open_bins = np.count_nonzero(out.reshape(n, width) == empty, axis=1)
        unfilled = open_bins > 0
        if not unfilled.any():
            return out.reshape(n, width)
        keep = unfilled[at // width]
        x, at = x[keep], at[keep]
    for j in range(width):
        need = out.reshape(n, width)[:, j] == empty
        some = need[at // width]
        if some.any():
            v = mixed(mixed(x[some] + steps[width + j])) >> np.uint64(1)
            np.minimum.at(out, at[some] + j, v)
    return out.reshape(n, width)


def _sketches(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(node, n_shingles, set_hash, bands) of every row; the last two are null for empty sets and null keys."""

    @F.arrow_udf("struct<n_shingles:bigint,set_hash:binary,bands:array<bigint>>")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import xxhash

        begin("near_dedup")
        words = WordHashes()
        salt = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            sizes, digests, bands = [np.empty(0, np.int64)], [], [np.empty((0, BANDS), np.int64)]
            for some in text_slices(batch, 1 << 20):
                sets = [words.shingles(t, n) for t in some]
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                sizes.append(size)
                digests += [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                found = np.zeros((len(sets), BANDS), np.uint64)
                if (full := size > 0).any():
                    rows = sketch(np.concatenate(sets), size[full], BANDS * ROWS).reshape(-1, BANDS, ROWS)
                    x = np.broadcast_to(salt, rows.shape[:2])
                    for r in range(ROWS):
                        x = mixed(x * _STEP + rows[:, :, r])
                    found[full] = x
                bands.append(found.view(np.int64))
            size, band = np.concatenate(sizes), np.concatenate(bands)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel()), mask=pa.array(size == 0)
            )
            yield pa.StructArray.from_arrays([pa.array(size), pa.array(digests, pa.binary()), lists], ["n_shingles", "set_hash", "bands"])
        finish(words)

    rows = df.select(F.col(key).alias("node"), sketched(F.col(text)).alias("s")).select("node", "s.*")
    known = F.col("node").isNotNull()
    return rows.withColumn("set_hash", F.when(known, F.col("set_hash"))).withColumn("bands", F.when(known, F.col("bands")))


def _shingle_table(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rep, shingles) with the sorted hashes of the wanted nodes' texts."""

    @F.arrow_udf("array<bigint>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = WordHashes()
        for batch in batches:
            sets = [words.shingles(t, n) for some in text_slices(batch) for t in some]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64)))
        finish(words)

    met = texts.join(wanted, texts["node"] == wanted["rep"], "left_semi")
    return materialize(met.select(F.col("node").alias("rep"), shingles(F.col("text")).alias("shingles")), "shingles")


def _confirm(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are linked; many a may share a b, which is then copied for each HUB_ROWS of them."""
    one = shingles.select(F.col("rep").alias("a"), F.col("shingles").alias("s"))
    salts = F.ceil(F.col("k") / HUB_ROWS).cast("int")
    hubs = pairs.groupBy("b").agg(F.count("*").alias("k")).select("b", salts.alias("salts"))
    copies = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    other = copies.join(shingles.select(F.col("rep").alias("b"), F.col("shingles").alias("t")), "b").drop("salts")
    dealt = pairs.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    met = dealt.join(one, "a").join(other, ["b", "salt"])
    both = F.size(F.array_intersect("s", "t"))
    return materialize(met.where(100 * both >= percent * (F.size("s") + F.size("t") - both)).select("a", "b"), "links")


def block_links(node: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray], crossed: bool, percent: int) -> list[tuple[int, int]]:
    """Places of links that join components among the sets of one block pair; crossed: only between its two sides."""
    m = len(node)
    if m < 2 or (comp == comp[0]).all():
        return []
    sizes = np.fromiter(map(len, sets), np.int64, m)
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), sizes)
    both = np.zeros((m, m), np.float64)
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    width = max(1, CELLS // m)
    edges = np.searchsorted(column, np.arange(0, len(tokens) + width, width))
    for k in range(len(edges) - 1):
        x = np.zeros((m, min(width, len(tokens) - k * width)), np.float32)
        x[row[edges[k] : edges[k + 1]], column[edges[k] : edges[k + 1]] - k * width] = 1
        both += x @ x.T
    test = 100 * both >= percent * (sizes[:, None] + sizes - both)
    test &= comp[:, None] != comp
    if crossed:
        test &= side[:, None] != side
    parents: dict = {}

    def root(c):
        while c in parents:
            c = parents[c]
        return c

    found = []
    for i, j in np.argwhere(np.triu(test, 1)).tolist():
        c, d = root(comp[i]), root(comp[j])
        if c != d:
            parents[c] = d
            found.append((i, j))
    return found


def _join_components(rest: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that share a bucket and whose shingle sets are linked.

    rest: bucket, rep, comp, m, the members of the bucket, and their shingles in all.
    """
    kind = rest.schema["rep"].dataType
    parts = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / BLOCK_SHINGLES)).cast("int")
    # whole hashes: a false link of shorter ones would join components and hide true links
    held = rest.join(shingles.select("rep", F.col("shingles").alias("tokens")), "rep")  # dealt by rep, which is even, before blocks multiply the rows of hot buckets
    blocks = held.withColumn("block", F.pmod(F.xxhash64("rep"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    blocks = blocks.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "comp", "tokens")
    rows = blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(rows: pa.RecordBatch) -> list[tuple[int, int]]:
            lists = rows.column("tokens")
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            sets = [np.unique(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            # components get numbers: they may be of any type
            comp = rows.column("comp").dictionary_encode().indices.to_numpy()
            crossed = rows.column("i")[0] != rows.column("j")[0]
            return block_links(np.arange(len(rows)), comp, rows.column("block").to_numpy(), sets, crossed, percent)

        def links(rows: pa.RecordBatch, cuts: list[int]) -> pa.RecordBatch:
            a, b = [], []
            for start, stop in zip(cuts[:-1], cuts[1:]):
                for i, j in group(rows.slice(start, stop - start)) if stop - start > 1 else ():
                    a.append(start + i)
                    b.append(start + j)
            rep = rows.column("rep")
            return pa.record_batch([rep.take(pa.array(a, pa.int64())), rep.take(pa.array(b, pa.int64()))], ["a", "b"])

        held: list[pa.RecordBatch] = []  # the group that may go on in the next batch
        for batch in batches:
            rows = pa.concat_batches([*held, batch]) if held else batch
            if not len(rows):
                continue
            key = np.stack([rows.column(c).to_numpy() for c in ("bucket", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
            yield links(rows, cuts)
            held = [rows.slice(cuts[-1])]
        if held:
            yield links(held[0], [0, len(held[0])])
        held = []
        finish()

    found = rows.mapInArrow(compared, f"a {kind.simpleString()}, b {kind.simpleString()}")
    return materialize(found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")


def _shared_nodes(sketches: DataFrame, sets: DataFrame, repeated: DataFrame) -> DataFrame:
    """Pairs (node, rep) for every set of the nodes that have several texts: such a node is linked with all of its sets."""
    own = sketches.select("node", "set_hash").where("set_hash is not null").join(repeated.select("node"), "node").distinct()
    return own.join(sets.select("set_hash", "rep"), "set_hash").select(F.col("node").alias("a"), F.col("rep").alias("b"))


def near_duplicates(df: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of df: key, n_shingles (long), component_id (the least key that links reach) and kept.

    Sets are linked where 100 * intersection >= percent * union, on distinct shingles of n words; a text of
    fewer words is one shingle, one without words (or null) has none and is linked with nothing. A null key
    takes no part: component_id null, kept. Rows that share a key are one node, which is linked with whatever
    any of their texts is linked with, and equal texts link their nodes. Other columns are left out; an empty table gives no rows.
    """
    prepare(df.sparkSession)
    sketches = materialize(_sketches(df, key, text, n), "sketches")
    sets = sketches.where("set_hash is not null").groupBy("set_hash").agg(
        F.min("node").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    sets = materialize(sets, "sets")
    repeated = materialize(sketches.where("node is not null").groupBy("node").agg(F.count("*").alias("k")).where("k > 1"), "repeated")
    again = not repeated.isEmpty()
    rows = sets.select("rep", "n", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("low"), F.max("rep").alias("high")).where("low.rep < high")
    members = rows.join(buckets.select("bucket", F.col("low.rep").alias("low"), F.col("low.n").alias("low_n")), "bucket")
    members = materialize(members.select("bucket", "rep", "n", "low", "low_n"), "members")

    fits = lambda x, y: f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"  # noqa: E731  else no link is possible
    shared = members.where("rep > low").where(fits("n", "low_n")).groupBy("rep", "low").agg(F.count("*").alias("k"))
    best = shared.groupBy("rep").agg(F.max(F.struct("k", F.struct("low"))).alias("best"))
    first = materialize(best.select(F.col("rep").alias("a"), F.col("best.col2.low").alias("b")), "pairs")
    texts = df.select(F.col(key).alias("node"), F.col(text).alias("text"))
    texts = texts.distinct() if again else texts
    shingles = _shingle_table(texts, members.select("rep").distinct(), n)
    confirmed = _confirm(first, shingles, percent)
    links = confirmed.unionAll(_shared_nodes(sketches, sets, repeated)) if again else confirmed

    known = connected_components(links)
    placed = members.join(known.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    placed = materialize(placed.select("bucket", "rep", "n", "comp"), "members")
    discard(members, first)
    parted = placed.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("comp").alias("c"), F.max("comp").alias("d")).where("c < d")
    rest = placed.drop("n").join(parted.select("bucket", "m", "total"), "bucket")
    more = _join_components(rest, shingles, percent)
    discard(placed, shingles)
    if not more.isEmpty():
        discard(known)
        known = connected_components(links.unionAll(more))
    discard(confirmed, more)

    by_set = sketches.select("node", "n_shingles", "set_hash").join(sets.select("set_hash", "rep"), "set_hash", "left")
    found = by_set.withColumn("rep", F.coalesce("rep", "node")).join(known.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep")
    return found.select(
        F.col("node").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("node") == component, F.lit(True)).alias("kept")
    )
