"""Each operator against a brute-force version, a library or a round trip, and on odd tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import bpe, chat_format, decontaminate, near_dedup, quality, quality_rules, queries, token_counts, token_files, toxicity, url_filters
from lumenfold.llm.components import connected_components

ODD = [None, "", " ", "\n\n", "a", "one two three", "x" * 30_000, "word " * 5_000, "  lead and  gaps \t\n end ", "naïve café – “quoted” 你好", "don't 1234 <|endoftext|> 'll", "a", "a"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0, i) for i, t in enumerate(ODD)] + [(None, "null key", "en", "s", 0, 1), (4, "a", "en", "s", 0, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas().set_index("doc_id").sort_index()


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_op5_counts_like_the_library(spark, sf_dir, documents, odd, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = rows_of(queries.op5_token_counts(spark, sf_dir))
    assert len(got) == len(documents)
    for doc_id, text in documents.text.items():
        assert got[doc_id].n_tokens == len(library.encode(text)) and got[doc_id].n_bytes == len(text.encode())
    for r in token_counts.count_tokens(odd, path).collect():
        assert r.n_tokens == len(library.encode(r.text or ""))
    assert token_counts.count_tokens(empty, path).count() == 0


def tiktoken_of(path):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op10_encodes_like_the_library(spark, sf_dir, documents, odd, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken_of(path)
    got = rows_of(queries.op10_byte_bpe(spark, sf_dir))
    for doc_id, text in documents.text.items():
        ids = library.encode_ordinary(text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    both = bpe.decode(bpe.encode(odd, path, P.PATTERN), path, P.PATTERN)
    assert sorted(map(repr, bpe.round_trip(odd, path, P.PATTERN).collect())) == sorted(map(repr, both.collect()))
    for r in both.collect():
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def test_op10_random_texts():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library, own = tiktoken_of(path), bpe.ByteBpe(path, P.PATTERN)
    random.seed(3)
    signs = " \n\t▁ab<s>你é \"'x  \r0\x00　\x1c\x85\xa0…."
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 20))) for _ in range(3000)] + ["ab" * 600]
    ids, n = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode_ordinary(t) for t in texts]


def test_op8_reads_back_what_the_library_gives(spark, sf_dir, documents, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: library.encode(t, add_special_tokens=False).ids + [0] for d, t in documents.text.items()}
    got, start = rows_of(queries.op8_token_files(spark, sf_dir)), 0
    for doc_id, own in ids.items():
        r = got[doc_id]
        assert (r.start, r.n_tokens) == (start, len(own)) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        start += len(own)
    token_files.write_shards(odd, str(tmp_path / "odd"), P.path("byte_bpe_50k.json"), shard_ids=2000)
    back = token_files.read_shards(spark, str(tmp_path / "odd")).collect()
    want = sorted([library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in odd.collect()])
    assert sorted(np.frombuffer(r.data, "<u4").tolist() for r in back) == want
    token_files.write_shards(empty, str(tmp_path / "empty"), P.path("byte_bpe_50k.json"))
    assert token_files.read_shards(spark, str(tmp_path / "empty")).count() == 0


def test_op8_grammar_gives_random_access():
    rng = np.random.default_rng(0)
    sizes = rng.integers(0, 400, 60)
    ids = rng.integers(0, 9, int(sizes.sum())).astype(np.int32)
    grammar, n_symbols = token_files.compress(ids, sizes, least=4)
    assert len(grammar.rules) and len(grammar.symbols) < len(ids)
    shard = token_files.Shard(token_files.pack(grammar, n_symbols, sizes))
    assert np.array_equal(shard.all(), ids)
    ends = np.cumsum(sizes)
    for k in range(60):
        own = ids[ends[k] - sizes[k] : ends[k]]
        assert np.array_equal(shard.document(k), own) and np.array_equal(shard.document(k, 3, 17), own[3:17])
    one = token_files.compress(np.zeros(1000, np.int32), np.array([1000]), least=2)
    assert np.array_equal(one[0].expand(one[0].symbols), np.zeros(1000))


def test_op8_replaces_until_no_pair_is_frequent():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 5000, 700).astype(np.int32)
    ids, sizes = np.concatenate([np.tile(own, 30), rng.integers(0, 40, 20_000)]), np.append(np.full(30, 700), 20_000)
    grammar, n_symbols = token_files.compress(ids, sizes)
    assert (n_symbols[:30] == 1).all() and grammar.lengths.max() == 700
    ends = np.cumsum(n_symbols)
    pairs = collections.Counter(p for k, e in enumerate(ends) for p in zip(grammar.symbols[e - n_symbols[k] : e].tolist(), grammar.symbols[e - n_symbols[k] + 1 : e].tolist()))
    assert max(pairs.values()) < token_files.repays(2)
    shard = token_files.Shard(token_files.pack(grammar, n_symbols, sizes))
    assert np.array_equal(shard.all(), ids) and np.array_equal(shard.document(7, 100, 300), own[100:300])


def test_op8_keeps_the_smaller_of_two_widths(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = np.array([6000, 0, 6000])
    ids = rng.integers(0, 12, 12_000)
    monkeypatch.setattr(token_files, "NARROW", 40)
    grammar, n_symbols = token_files.compress(ids, sizes)
    wide = len(grammar.terminals) + len(grammar.rules) > 40
    shard = token_files.Shard(token_files.pack(grammar, n_symbols, sizes))
    assert np.array_equal(shard.all(), ids) and np.array_equal(shard.document(2), ids[6000:])
    few = token_files.compress(np.repeat(ids[:3000], 4), np.array([12_000]))[0]
    assert token_files.stored_bytes(few) <= 2 * 12_000 and (wide or len(grammar.rules) == 28)


def thue_morse(n, a="a", b="b"):
    return "".join(b if k.bit_count() % 2 else a for k in range(n))


@pytest.mark.parametrize("n", [16, 17, 1024, 2048])
def test_chunks_with_colliding_hashes_keep_their_ids(n):
    # polynomial hashes modulo a power of two are equal on these
    texts = [thue_morse(n), thue_morse(n, "b", "a"), f"x {thue_morse(n)} y {thue_morse(n, 'b', 'a')}", "a\0", "a", "a\0\0"]
    from tokenizers import Tokenizer

    path, other = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
    library = Tokenizer.from_file(path)
    ids, sizes = token_files.Encoder(path).pool.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, sizes = bpe.ByteBpe(other, P.PATTERN).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [tiktoken_of(other).encode_ordinary(t) for t in texts]


def test_a_full_chunk_pool_keeps_what_is_met_often():
    from lumenfold.llm.chunks import ChunkPool

    random.seed(5)
    pool = ChunkPool(lambda new: (np.concatenate([np.frombuffer(c.encode(), np.uint8) for c in new]).astype(np.int32), np.array([len(c.encode()) for c in new])), limit=40, limit_ids=4000)
    words = ["".join(random.choice("ab") for _ in range(random.choice([1, 8, 9, 16, 17, 18, 300]))) for _ in range(300)]
    for _ in range(60):
        text = " ".join(random.choices(words, k=20))
        ids, n = pool.encode([text, ""])
        assert bytes(ids.astype(np.uint8)) == text.encode() and n.tolist() == [len(text), 0]
    assert pool.used < 120


def test_op10_lengths_about_the_longest_row():
    path = P.path("byte_bpe_multi_50k.tiktoken")
    library, own = tiktoken_of(path), bpe.ByteBpe(path, P.PATTERN)
    random.seed(8)
    sizes = [bpe.LONGEST_ROW + d for d in (-1, 0, 1)]
    texts = ["".join(random.choice(signs) for _ in range(n)) for n in sizes for signs in ("abcdefghij", "a", "!?", "st")]
    ids, n = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode_ordinary(t) for t in texts]


def test_op10_decode_refuses_ids_that_it_lacks(spark):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    some = spark.createDataFrame([(1, [97, None]), (2, [10**6])], "k long, ids array<int>")
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "k long, ids array<int>"), path, P.PATTERN).where("octet_length(decoded) = 0").count() == 2
    for k in (1, 2):
        with pytest.raises(Exception):  # noqa: B017
            bpe.decode(some.where(f"k = {k}"), path, P.PATTERN).collect()


def brute_leaks(text, items, window=10):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    words = fold(text)
    hit, found = set(), set()
    for name, item in items:
        own = fold(item)
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                found.add(name)
                hit.update(range(i, i + size))
    return len(words), len(hit), sorted(found)


def test_op2_against_brute_force(spark, odd, empty):
    random.seed(1)
    draw = lambda n: " ".join(random.choice("abcde") for _ in range(n))
    items = [("1", draw(30)), ("2", draw(12)), ("10", draw(4)), ("3", "Ab c"), ("4", None), ("5", "")]
    texts = [draw(random.randint(0, 80)) + " " + random.choice([items[0][1][4:30], "zz", items[2][1]]) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(int(k), t) for k, t in items], "item_id long, text string")
    for window in (5, 10):
        for r in decontaminate.find_leaks(docs, bench, window=window).collect():
            assert (r.leaks.n_words, r.leaks.n_hit, r.leaks["items"]) == brute_leaks(r.text, items, window)
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.where("false")).where("leaks.n_hit > 0").count() == 0


def test_op2_blocks_agree(spark):
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 12))) for i in range(9)], "item_id long, text string")
    whole = decontaminate.find_leaks(docs, bench).select("leaks.*").first()
    assert decontaminate.find_leaks(docs, bench, block_words=20).select("leaks.*").first() == whole


def test_op2_removes_spans(spark):
    item = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Before this, {item}! And after that there are many more words in the text here."), (2, item), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = rows_of(decontaminate.remove_leaks(decontaminate.find_leaks(docs, bench)))
    assert set(kept) == {1, 3}
    assert kept[1].text == "Before this, ! And after that there are many more words in the text here."


def test_op2_odd_and_clashing_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one two three"), (None, "lead and gaps"), (2, None)], "item_id long, text string")
    clash = odd.withColumn("leaks", F.lit("old")).withColumn("cleaned", F.lit("own"))
    found = decontaminate.remove_leaks(decontaminate.find_leaks(clash, bench), coverage=1.0)
    assert found.count() == odd.count() and found.where("cleaned = 'own'").count() == odd.count()
    assert rows_of(found.where("doc_id = 5"))[5].text == "" and found.where("text like '%gaps%'").count() == 0
    assert decontaminate.remove_leaks(decontaminate.find_leaks(empty, bench)).count() == 0


def test_op3_intervals_and_precedence(spark):
    events = spark.createDataFrame(
        [("a.org", "block", 10, "add"), ("a.org", "block", 20, "remove"), ("a.org", "block", 30, "add"), ("x.a.org/p", "allow", 5, "add"), (None, "block", 1, "add"), ("a.org", "block", 10, "add")],
        "key string, list string, listed_at long, action string",
    )
    asked = [("http://x.a.org/q", 9), ("http://x.a.org/q", 10), ("http://x.a.org/q", 20), ("http://U@X.a.org:80/p//q?z", 35), ("http://ba.org/", 35), (None, 35), ("nonsense", 35), ("http://a.org", None), ("http://x.a.org/q", 10)]
    captures = spark.createDataFrame([(i, u, t, "old") for i, (u, t) in enumerate(asked)], "page_id long, url string, fetched_at long, decided_by string")
    want = {0: (0, None, False), 1: (1, "a.org", True), 2: (0, None, False), 3: (2, "x.a.org/p", False), 4: (0, None, False), 5: (0, None, False), 6: (0, None, False), 7: (0, None, False), 8: (1, "a.org", True)}
    for limit in (100, 0):  # broadcast and salted joins
        got = url_filters.filter_urls(captures, events, broadcast_rows=limit)
        assert {r.page_id: (r.n_active, r.decided_by, r.blocked) for r in got.collect()} == want
    assert url_filters.filter_urls(captures.where("false"), events).count() == 0
    assert url_filters.filter_urls(captures, events.where("false")).where("blocked").count() == 0


def test_op3_rows_without_host_and_odd_columns(spark):
    events = spark.createDataFrame([("a.org", "block", 1, "add")], "key string, list string, listed_at long, action string")
    rows = [(None, 5), ("", 5), ("x", None), ("http://a.org/", 5), ("http://a.org/", 5), (None, None)] * 20
    captures = spark.createDataFrame(rows, "url string, fetched_at long").withColumn("__place", F.lit(1)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = url_filters.filter_urls(captures.drop("__place"), events)
    assert got.count() == 120 and got.where("blocked").count() == 40 and got.where("n_active = 0").count() == 80


def test_op6_long_conversations(spark, monkeypatch):
    rows = [(1, i, "assistant" if i % 3 else "user", f"t{i}<|x") for i in range(900)] + [(2, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    read = lambda: {r.conv_id: (r.formatted, r.loss_spans, r.loss) for r in chat_format.format_chats(table).select("*", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    got = read()
    assert got[1][2] == "".join(r[3] for r in rows[:900] if r[2] == "assistant") and got[2][1] == [] and len(got[1][1]) == 600
    monkeypatch.setattr(chat_format, "STEP", 7)
    assert read() == got


def test_op6_round_trip(spark):
    texts = ["plain", "<|im_end|>\n<|im_start|>user\nhi", r"<\|x <\\| \<|", None, "", "<|im_sep|>", "a<", "|b"]
    rows = [(1, i, ["user", "assistant", "assistant", "system"][i % 4], t) for i, t in enumerate(texts)]
    rows += [(2, 0, "as%sist<|\nant", "x"), (2, None, None, "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 1, "assistant", "lost")]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = chat_format.format_chats(table)
    back = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in got.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert back[1][0] == [(r[2], r[3] or "") for r in rows[:8]]
    assert back[1][1] == "".join(r[3] or "" for r in rows[:8] if r[2] == "assistant")
    assert back[2][0] == [("", "first"), ("as%sist<|\nant", "x")]
    assert back[3][0] == [("user", "tie")] * 2 and back[None] == ([("assistant", "lost")], "lost")
    assert chat_format.format_chats(table.where("false")).count() == 0


def brute_components(texts, n, percent):
    sets = {k: near_dedup.shingles_of(t or "", n) for k, t in texts.items()}
    keys, parent = sorted(sets), {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if near_dedup.linked(sets[a], sets[b], percent):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("n", [2, 5])
def test_op7_against_brute_force(spark, n):
    random.seed(n)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(3))
    base = [[word() for _ in range(random.choice([3, 12, 60]))] for _ in range(25)]
    texts = {}
    for i in range(240):
        words = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 5])):
            words[random.randrange(len(words))] = word()
        texts[i] = random.choice([" ", "\n"]).join(words).upper() if i % 7 == 0 else " ".join(words)
    texts |= {300: None, 301: "", 302: " \n", 303: "solo", 304: "SOLO", 305: "two words", 306: "long " * 20_000}
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, component_id int")
    want, sizes = brute_components(texts, n, 80)
    got = rows_of(near_dedup.near_duplicates(docs, n=n))
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_shingles for k, r in got.items()} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_op7_blocks_find_links_between_components(monkeypatch):
    sets = [np.arange(k, k + 20) for k in (0, 1, 2, 50, 51, 90)]
    comp, side = np.array([0, 1, 2, 3, 4, 5]), np.array([0, 1, 0, 1, 0, 1])
    for cells in (1 << 20, 12):
        monkeypatch.setattr(near_dedup, "CELLS", cells)
        found = near_dedup.block_links(np.arange(6), comp, side, sets, False, 80)
        assert sorted(found) == [(0, 1), (0, 2), (3, 4)] or sorted(found) == [(0, 1), (1, 2), (3, 4)]
        assert sorted(near_dedup.block_links(np.arange(6), comp, side, sets, True, 80)) == [(0, 1), (1, 2), (3, 4)]


def test_op7_links_are_not_lost_to_equal_low_bits(spark):
    # i and j are linked with k alone; 31 bits of their hashes would link i with j as well
    k = set(range(20))
    sets = {"i": k - {0, 1} | {100, 101}, "j": k - {2, 3} | {2 + (1 << 31), 3 + (1 << 31)}, "k": k}
    rest, hashes, want = [], [], set()
    for bucket, order in enumerate(itertools.permutations("ijk")):
        node = {c: 10 * bucket + n for n, c in enumerate(order)}
        rest += [(bucket, node[c], node[c], 3) for c in order]
        hashes += [(node[c], sorted(sets[c])) for c in order]
        want |= {(max(node[c], node["k"]), min(node[c], node["k"])) for c in "ij"}
    near_dedup.prepare(spark)
    rest = spark.createDataFrame([(*r, 66) for r in rest], "bucket long, rep long, comp long, m long, total long").coalesce(1)
    hashes = spark.createDataFrame(hashes, "rep long, shingles array<bigint>").coalesce(1)
    assert {(r.a, r.b) for r in near_dedup._join_components(rest, hashes, 80).collect()} == want


def all_links(sets, percent):
    """All pairs of unlike sets of the similarity or more, found by their rarest shingles: such sets share one of them."""
    often = collections.Counter(x for s in sets for x in s)
    seen, links = collections.defaultdict(list), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = sorted(sets[i], key=lambda x: (often[x], x))
        prefix = own[: len(own) - -(-percent * len(own) // 100) + 1]
        for j in {j for x in prefix for j in seen[x]}:
            if near_dedup.linked(sets[i], sets[j], percent):
                links.append((i, j))
        for x in prefix:
            seen[x].append(i)
    return links


def test_op7_finds_every_link_of_real_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {k: r.component_id for k, r in rows_of(queries.op7_near_dedup(spark, folder)).items()}
    by_set = collections.defaultdict(list)
    for k, t in texts.items():
        by_set[frozenset(near_dedup.shingles_of(t or "", 2))].append(k)
    sets = [s for s in by_set if s]
    assert all(len({got[k] for k in by_set[s]}) == 1 for s in sets)
    links = all_links(sets, 80)
    assert len(links) > 30 and all(got[by_set[sets[i]][0]] == got[by_set[sets[j]][0]] for i, j in links)
    parent = {min(by_set[s]): min(by_set[s]) for s in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in links:
        a, b = root(min(by_set[sets[i]])), root(min(by_set[sets[j]]))
        parent[max(a, b)] = min(a, b)
    assert all(got[k] == root(min(by_set[s])) for s in sets for k in by_set[s])


def test_op7_rows_that_share_a_key_are_one_node(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "quite another text of several words here")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, c), (7, None), (11, ""), (11, c), (12, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 3), (7, 3), (7, 3), (9, 9), (9, 9), (11, 9), (11, 9), (12, 12)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op7_large_group_and_blocks(spark, monkeypatch):
    # near copies in a ring of one-word changes, compared in many small blocks and under many copies of a hub
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "HUB_ROWS", 5)
    random.seed(12)
    base = [f"w{i}" for i in range(40)]
    texts = {}
    for i in range(120):
        words = list(base)
        for k in range(i % 6):
            words[(i * 7 + k * 11) % 40] = f"v{random.randrange(9)}"
        texts[i] = " ".join(words)
    got = rows_of(near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n=2))
    assert {k: r.component_id for k, r in got.items()} == brute_components(texts, 2, 80)[0]


def test_op7_odd_tables(spark, odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) + 2
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert {r.component_id for r in got if r.doc_id in (4, 11, 12)} == {4}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_op7_sketch_agrees_as_often_as_sets_are_similar():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    both = near_dedup.sketch(np.concatenate([a, b, a[:1]]), np.array([300, 300, 1]), 2000)
    assert abs((both[0] == both[1]).mean() - 240 / 360) < 0.05
    assert (both < np.iinfo(np.uint64).max).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(100, 140)] + [(200, k) for k in range(201, 230)] + [(5, 5), (9, None), (7, 8), (8, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 200 for i in range(200, 230)) and got[8] == 7
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_op9_counts_and_verdicts(spark, sf_dir, documents, odd, empty):
    got = rows_of(queries.op9_quality_rules(spark, sf_dir))
    for doc_id, text in documents.text.items():
        r, want = got[doc_id], brute_rules(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    for r in quality_rules.label_lines(odd, quality_rules.Crf()).collect():
        assert (r.rules.n_words, r.rules.word_chars, r.rules.n_symbols, r.rules.n_dup_lines, r.rules.n_repeat_words) == brute_rules(r.text)
    assert quality_rules.label_lines(empty, quality_rules.Crf()).count() == 0


def test_op9_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    field = quality_rules.Crf(rng.normal(size=(quality_rules.FEATURES, 2)), rng.normal(size=(2, 2)))
    sizes = np.array([1, 5, 0, 3, 7])
    x = rng.normal(size=(int(sizes.sum()), quality_rules.FEATURES))
    got, at = field.decode(x, sizes), 0
    for n in sizes:
        emit = x[at : at + n] @ field.weights
        score = lambda path: sum(emit[i, y] for i, y in enumerate(path)) + sum(field.steps[a, b] for a, b in zip(path, path[1:]))  # noqa: E731, B023
        paths = [tuple(k >> i & 1 for i in range(n)) for k in range(2**n)]
        assert n == 0 or score(tuple(got[at : at + n])) == pytest.approx(max(map(score, paths)))
        at += n


def test_op9_fit_separates_lines():
    rng = np.random.default_rng(4)
    labels = np.repeat(rng.integers(0, 2, 60), 5)
    x = np.zeros((300, quality_rules.FEATURES))
    x[:, 0], x[:, 1] = 1, labels + rng.normal(0, 0.4, 300)
    field = quality_rules.Crf().fit(x, np.full(60, 5), labels)
    assert (field.decode(x, np.full(60, 5)) == labels).mean() > 0.97


def test_op9_recurring_lines():
    # a footer of unlike documents recurs, the lines of copies and near copies do not
    rng = np.random.default_rng(3)
    copy = rng.integers(1, 1 << 60, 8)
    near = [np.append(rng.permutation(copy)[:7], i) for i in range(100, 120)]
    unlike = [np.append(rng.integers(1, 1 << 60, 6), 42) for _ in range(12)]
    documents = [*[copy] * 15, *near, *unlike, np.array([7]), np.array([7])]
    sizes = np.array([len(d) for d in documents])
    assert quality_rules.recurring_lines(np.concatenate(documents).astype(np.int64), sizes) == {42}
    assert quality_rules.recurring_lines(np.empty(0, np.int64), np.empty(0, np.int64)) == set()


def lined_documents(rng, count):
    """Texts with the true label of each line: prose and shouting in good and in bad documents, and a common footer."""
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(8, 25))).capitalize() + "."
    shout = lambda: " ".join(word().upper() + "!!" for _ in range(rng.integers(8, 25)))
    out = []
    for i in range(count):
        good = bool(rng.random() < 0.7)
        labels = [bool(rng.random() < (0.85 if good else 0.2)) for _ in range(rng.integers(3, 9))]
        if (np.mean(labels) > 0.5) != good:
            labels = [good] * len(labels)
        lines = [prose() if k else shout() for k in labels]
        if i % 3 == 0:
            lines.append("All rights are kept by their owners.")
            labels.append(False)
        out.append((good, labels, "\n".join(lines)))
    return out


def test_op9_labels_planted_lines(spark):
    rng = np.random.default_rng(11)
    documents = lined_documents(rng, 400)
    texts = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(documents)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, (g, _, _) in enumerate(documents)], "doc_id long, quality int, toxic int")
    field = quality_rules.train(texts, labels)
    assert quality_rules.line_hash(b"All rights are kept by their owners.") in field.recurring
    got = rows_of(quality_rules.label_lines(texts, field))
    hits = [a == b for i, (_, truth, _) in enumerate(documents) for a, b in zip(got[i].rules.content, truth)]
    assert np.mean(hits) > 0.95
    mixed = [0 < sum(r.rules.content) < len(r.rules.content) for r in got.values()]
    assert np.mean(mixed) > 0.3 and 0.02 < np.mean([0 < r.rules.content_share < 1 for r in got.values()])


def test_op9_lines_of_real_documents_are_mixed(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op9_quality_rules(spark, folder).collect()
    field = quality_rules.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    lined = quality_rules.label_lines(spark.read.parquet(f"{folder}/documents.parquet"), field).select("doc_id", "rules.content", "rules.content_share").collect()
    several = [r for r in lined if len(r.content) > 1]
    assert np.mean([0 < sum(r.content) < len(r.content) for r in several]) > 0.05
    labels = held_out(spark.read.parquet(f"{folder}/labels.parquet").toPandas())
    share = {r.doc_id: r.content_share for r in lined}
    assert np.mean([(share[i] >= 0.5) == (q == 1) for i, q in zip(labels.doc_id, labels.quality)]) > 0.93
    failed = {r.doc_id: r.base_failed for r in got}
    good = [i for i, q in zip(labels.doc_id, labels.quality) if q == 1 and not failed[i]]
    assert np.mean([share[i] >= 0.5 for i in good]) > 0.97


def held_out(labels):
    return labels[[zlib.crc32(str(i).encode()) % 3 == 1 for i in labels.doc_id]]


def test_op1_held_out_accuracy(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    labels = held_out(spark.read.parquet(f"{folder}/labels.parquet").toPandas())
    got = rows_of(queries.op1_toxicity(spark, folder))
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    toxic = [got[i].score for i in labels.doc_id[labels.toxic == 1]]
    clean = [got[i].score for i in labels.doc_id[labels.toxic == 0]]
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.85  # area under the curve
    assert np.mean(np.array(clean) >= 0.7) < 0.03
    model = toxicity.ToxicModel(toxicity.log_model(np.ones((27, 27, 27))), {}, np.array([0, 0, 0, 0, -3.0]))
    assert toxicity.score(odd, model).where("toxicity.score between 0 and 1").count() == len(ODD) + 2
    assert toxicity.score(empty, model).count() == 0


def test_op1_restores_disguises(spark, sf_dir):
    model = toxicity.log_model(toxicity.count_trigrams(spark.createDataFrame([("you idiot the moron is stupid and pathetic trash " * 20,)], "text string")))
    decoder = toxicity.Decoder(model)
    for seen, want in {"an 1d10t here": "idiot", "m0r0n!": "moron", "s t u p i d": "stupid", "p-a-t-h-e-t-i-c": "pathetic", "traaaash": "trash", "$tupid": "stupid"}.items():
        assert want in decoder.restore(seen), (seen, decoder.restore(seen))
    assert decoder.restore("nothing hidden here, 42 times.") == "nothing hidden here, 42 times."


def test_op1_viterbi_finds_the_cheapest_reading():
    rng = np.random.default_rng(4)
    decoder = toxicity.Decoder(np.log(rng.dirichlet(np.ones(27), (27, 27))))

    def cost(path):
        x = y = 0
        total = 0.0
        for out, price in [*path, (" ", 0.0)]:
            total += price
            for char in out:
                z = toxicity._letter(char)
                total -= decoder.logs[x][y][z]
                x, y = y, z
        return total

    for span in ("1d10t", "s t u p", "iddiioott", "st upid", "id-i.ot", "$$a@b", "aaa bbb", "*|*"):
        paths = list(itertools.product(*decoder.lattice(span)))
        best = min(map(cost, paths))
        read = decoder.decode(span)
        assert min(cost(p) for p in paths if "".join(o for o, _ in p) == read) == pytest.approx(best)


def test_op1_suspects_and_places():
    found = lambda text: [text[a:b] for a, b in toxicity.suspects(text)]
    assert found("an iddiioott, a committed letter") == ["iddiioott"]
    assert found("id-iot st_u.pid plain.") == ["id-iot", "st_u.pid"]
    assert found("1d10t$$$ |diot price$$$ m0r0n!! 42 (see) wow!!!") == ["1d10t", "|diot", "m0r0n"]
    assert found("s t u p i d and traaash") == ["s t u p i d", "traaash"]
    logs = toxicity.log_model(np.ones((27, 27, 27)))
    decoder = toxicity.Decoder(logs)
    decoder["1d"], decoder["aaa"] = "X", "Y"
    assert decoder.restore("1d x1d 1d, aaa baaab 1d") == "X x1d X, Y baaab X".replace("x1d", decoder["x1d"]).replace("baaab", decoder["baaab"])
    assert decoder.restore("") == "" and toxicity.suspects("") == []


def test_op1_joins_what_the_model_likes_whole(spark):
    model = toxicity.log_model(toxicity.count_trigrams(spark.createDataFrame([("you stupid clown the stupid moron is stupid and a clown " * 30,)], "text string")))
    decoder = toxicity.Decoder(model)
    for seen, want in {"st upid here": "stupid", "so iddiioott": "idiot", "stup-id": "stupid", "s.tupid": "stupid", "|diot": "idiot"}.items():
        if "idiot" not in want:
            assert want in decoder.restore(seen), (seen, decoder.restore(seen))
    assert decoder.restore("the clown is stupid") == "the clown is stupid"


def test_op1_time_grows_with_the_text_alone():
    import time

    decoder = toxicity.Decoder(toxicity.log_model(np.ones((27, 27, 27))))
    texts = [" ".join(f"w{k % 500}0rd{k % 7}" for k in range(n)) for n in (4_000, 64_000)]
    decoder.restore(texts[0])
    spent = []
    for text in texts:
        began = time.perf_counter()
        decoder.restore(text)
        spent.append(time.perf_counter() - began)
    assert spent[1] < 64 * max(spent[0], 0.01)


def test_op4_fit_is_the_likeliest_of_a_grid():
    rng = np.random.default_rng(6)
    x = rng.normal(size=80)
    grades = (x + rng.logistic(0, 0.7, 80) > -0.5).astype(int) + (x + rng.logistic(0, 0.7, 80) > 0.8)
    ridge = 1e-4
    model = quality.fit([np.array([5])] * 80, [np.array([v]) for v in x], grades, rounds=3000, rate=0.02, ridge=ridge)

    def loss(w, a, b):
        below = 1 / (1 + np.exp(-(np.array([[a], [b]]) - w * x)))
        p = np.stack([below[0], below[1] - below[0], 1 - below[1]])[grades, np.arange(80)]
        return -np.log(np.maximum(p, 1e-12)).mean() + 5 * ridge * w * w / 80

    w, (a, b) = model.weights[5], model.thresholds
    own = loss(w, a, b)
    brute = min(loss(u, c, d) for u in np.linspace(0, 4, 41) for c in np.linspace(-3, 1, 41) for d in np.linspace(-1, 4, 51) if c < d)
    assert own <= brute + 1e-6
    steps = [loss(w + e, a, b) for e in (-0.02, 0.02)] + [loss(w, a + e, b) for e in (-0.02, 0.02)] + [loss(w, a, b + e) for e in (-0.02, 0.02)]
    assert all(s >= own - 1e-9 for s in steps)
    # probabilities of the grades by hand
    below = 1 / (1 + np.exp(-(model.thresholds - (w * x)[:, None])))
    assert np.allclose(model.below(w * x), below)


def test_samples_are_bounded(spark, monkeypatch):
    from lumenfold.llm import common

    docs = spark.createDataFrame([(i % 30, "x" * (i + 1)) for i in range(60)] + [(99, "y" * 300_000), (None, "z")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(30)] + [(3, 0), (99, 1), (None, 1)], "doc_id long, quality int")
    got = common.labelled_sample(docs, labels, rows=1000).collect()
    assert len({r.doc_id for r in got}) == len(got) and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id != 99 for r in got)
    assert {r.quality for r in got if r.doc_id == 3} <= {0}
    few = common.labelled_sample(docs, labels, rows=1000, chars=100).collect()
    assert 0 < sum(len(r.text) for r in few) <= 100 and len(few) < len(got)
    assert len(common.labelled_sample(docs, labels, rows=5).collect()) <= 5


def test_op4_held_out_accuracy(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    labels = held_out(spark.read.parquet(f"{folder}/labels.parquet").toPandas())
    got = rows_of(queries.op4_quality(spark, folder))
    assert np.mean([got[i].kept == (q == 1) for i, q in zip(labels.doc_id, labels.quality)]) > 0.95
    model = quality.OrdinalModel(np.zeros(1 << quality.BITS), np.array([-1.0, 1.0]))
    rated = quality.rate(odd, model).select("rating.*").collect()
    assert len(rated) == len(ODD) + 2 and all(r.expected_grade == pytest.approx(1.0) for r in rated)
    assert quality.rate(empty, model).count() == 0


def test_op4_orders_five_grades():
    rng = np.random.default_rng(5)
    grades = rng.integers(0, 5, 400)
    rows = [np.array([7, 8]) for _ in grades]
    values = [np.array([g + rng.normal(0, 0.3), 1.0]) for g in grades]
    model = quality.fit(rows, values, grades)
    assert (np.diff(model.thresholds) > 0).all()
    score = np.array([v @ model.weights[[7, 8]] for v in values])
    expected = (1 - model.below(score)).sum(1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.95


@pytest.mark.parametrize("name", ["op2_decontamination", "op3_url_filters", "op6_chat_formatting"])
def test_sql_counterparts(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf_dir).toPandas()[list(want.columns)]
    key = list(want.columns)[0]
    show = lambda df: df.sort_values(key).astype(object).where(df.notna(), None).astype(str).values.tolist()
    assert show(got) == show(want)
