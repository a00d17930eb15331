"""Each operator against brute force, on edge rows and on the smallest tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import oracle
from kbspark.llm import cover_tree, elias_fano, graphs, language_id, ngram_lm, packing, pu_quality, quality_rules, queries, simhash, simhash_texts, sstable, token_rollup, trie_bpe
from kbspark.llm.common import fold, held_out, table
from kbspark.llm.encoding import IdEncoder, pack
from kbspark.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
EDGE = [
    None, "", " \n\t ", "one", "The cat sat on the mat. " * 30, "The cat sat on the mat. " * 30, "  double  spaces \n and\r\nlines ", "x <|endoftext|> y  <|endoftext|>",
    "日本語 テスト é ́ ½ Ⅷ", "a" * 3000, "word " * 60_000, "ça et là " * 40, "der und die das " * 30, "#$% | <> & *",
]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge rows with null and repeated identifiers, and columns whose names operators use themselves."""
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, f"src{i % 2}", 1, "x", "y", 0.5) for i, t in enumerate(EDGE)]
    rows += [rows[4], rows[4], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tokens string, fp string, score double").repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return table(spark, SF, "documents")


def crc(ids):
    return zlib.crc32(pack(ids))


def test_cached_ids_equal_the_library():
    rng = random.Random(1)
    odd = EDGE[1:] + ["".join(rng.choice(" \n\t'sdtAéЖ1²_.!<|>́ \x1c\x85 ") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        own = IdEncoder(tokenizer(name), max_entries=500)
        assert own.cut != "never"
        for text in odd:
            assert own.encode(text) == pack(own.library.encode(text, add_special_tokens=False).ids), (name, text)


# -- 2

def test_sstable(spark, docs, small):
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    for df in (docs, small, docs.limit(0)):
        manifest = sstable.write_shards(df, tokenizer("word_bpe_49k.json"), 2)
        got = sstable.read_shards(manifest, with_ids=True).orderBy("start").collect()
        want = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in df.select("doc_id", "text").collect()]
        key = lambda x: (x[0] is not None, x[0] or 0)
        assert [r.doc_id for r in got] == [x[0] for x in sorted(want, key=key)]
        assert Counter((r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got) == Counter((i, len(x), crc(x), pack(x)) for i, x in want)
        assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    manifest = sstable.write_shards(docs, tokenizer("word_bpe_49k.json"), 2)
    found = sstable.lookup(manifest, [4, 5, 999])
    assert len(found[4]) == 3 and len(found[5]) == 1 and not found.get(999)
    assert len(sstable.lookup(manifest, [None])[None]) == docs.filter("doc_id is null").count() > 0


def test_sstable_file():
    import io

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    for width, top in ((2, 1 << 16), (4, 1 << 32)):
        rng, out = random.Random(2), io.BytesIO()
        ids = [None, -5, 7, 7, *(rng.randrange(-(1 << 40), 1 << 40) for _ in range(2000))]
        rows = sorted(((sstable.key_of(i), [rng.randrange(top) for _ in range(rng.randrange(300))]) for i in ids), key=lambda r: r[0])
        writer = sstable.ShardWriter(out, width)
        for key, ids in rows:
            writer.add(key, pack(ids))
        writer.close()
        reader = sstable.ShardReader(Source(out.getvalue()))
        assert len(reader.blocks) > 1
        assert [(sstable.key_of(i), x) for i, x in reader.scan()] == [(k, pack(x)) for k, x in rows]
        for key, ids in rng.sample(rows, 50):
            assert pack(ids) in reader.get(sstable.id_of(key))
        assert len(reader.get(7)) >= 2 and len(reader.get(None)) == 1
        absent = list(range(1 << 50, (1 << 50) + 1000))
        assert not any(reader.get(i) for i in absent) and sum(map(reader.may_hold, absent)) < 50
        with pytest.raises(ValueError):
            writer.add(b"\0", b"")


# -- 4

def test_best_fit_and_bounds():
    rng = np.random.default_rng(4)
    for _ in range(60):
        capacity = int(rng.integers(5, 40))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 9)))
        bins, offsets, fill = packing.best_fit(sizes, capacity)
        assert fill.max() <= capacity and fill.sum() == sizes.sum()
        for b in range(len(fill)):
            own = sorted((offsets[i], sizes[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in own] == [0, *itertools.accumulate(s for _, s in own)][:-1]

        def fits(n, sizes=sorted(sizes.tolist(), reverse=True), capacity=capacity):
            def place(k, free):
                return k == len(sizes) or any(free[b] >= sizes[k] and place(k + 1, (*free[:b], free[b] - sizes[k], *free[b + 1 :])) for b in range(n))

            return place(0, (capacity,) * n)

        best = next(n for n in range(1, 10) if fits(n))
        assert packing.lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity) <= best <= len(fill)


def packed_well(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) <= capacity
    return len(by)


def test_packing(spark, docs, small):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    for df in (docs, small):
        rows = packing.pack_documents(df, tokenizer("byte_bpe_50k.json"), 0, 2048).collect()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
            first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            want.update((r.doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
        counts = np.bincount([r.length for r in rows], minlength=2049)
        assert packed_well(rows, 2048) <= packing.lower_bound(counts, 2048) + 1
    assert packing.pack_documents(docs.limit(0), tokenizer("byte_bpe_50k.json"), 0, 2048).count() == 0


def test_packing_exchanges(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(i, rng.randint(1, 100), "x") for i in range(3000)], "doc_id long, length int, extra string")
    got = packing.pack(rows, 100, per_partition=200).collect()
    assert sorted((r.doc_id, r.length, r.extra) for r in got) == sorted(map(tuple, rows.collect()))
    counts = np.bincount([r.length for r in got], minlength=101)
    # Uniform sizes are the hard case; partitions on their own would take 3 % more than the bound.
    assert packed_well(got, 100) <= 1.025 * packing.lower_bound(counts, 100)
    with pytest.raises(ValueError):
        packing.pack(rows.withColumn("Offset", F.lit(1)), 100)
    assert got and packing.pack(rows, 100, per_partition=200).certificate["at_least"] == packing.lower_bound(counts, 100)
    for bad in (0, 101, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, bad), (2, 5)], "doc_id long, length int"), 100)


# -- 5

def test_trie_bpe(spark, docs, small):
    path = tokenizer("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), trie_bpe.TrieEncoder(path)
    rng = random.Random(8)
    tokens = list(own.ids.values())
    for _ in range(5000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        word = own.bytes[a] + own.bytes[b]
        assert own._may_follow(a, b) == (own._merged([own.ids[word[i : i + 1]] for i in range(len(word))]) == [a, b])
    for text in EDGE[1:]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for df in (docs, small):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
        assert Counter(map(tuple, trie_bpe.encode_digests(df, path).collect())) == want
    assert trie_bpe.encode_digests(docs.limit(0), path).count() == 0
    # Prefixes that an earlier slice had get no second node.
    batch = trie_bpe.BatchEncoder(path)
    batch.digests([b"x some words differ, others do not: wordless"])
    before = len(batch.trie.last)
    batch.digests([b"x words do not diff some word, other wordl"])
    assert len(batch.trie.last) == before > 20
    small_one = trie_bpe.BatchEncoder(path, max_pieces=3)
    small_one.trie.max_nodes = small_one.trie.max_words = 5
    for text in EDGE[1:]:
        ids = library.encode(text, add_special_tokens=False).ids
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        assert batch.digests([text.encode()]) == small_one.digests([text.encode()]) == [want]
    rows = {r.doc_id: r for r in trie_bpe.encode_ids(docs.filter("doc_id = 8"), path).collect()}
    assert rows[8].ids == library.encode(EDGE[8], add_special_tokens=False).ids and rows[8].decoded == EDGE[8]


# -- 6

def plain_fingerprint(text, words):
    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))] if own else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {n: top(n) for n in nodes}


def test_simhash(spark, docs, small):
    for df in (docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), small):
        texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
        prints = {i: plain_fingerprint(t, 3) for i, t in texts.items()}
        near = [(a, b) for a, b in itertools.combinations(sorted(prints), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
        want = plain_components(sorted(prints), near)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, 3).collect()}
        assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    rows = simhash.near_duplicates(docs, 3).collect()
    assert len(rows) == docs.count() and {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_first(docs.drop("fp"), 3).collect()
    assert Counter(r.doc_id for r in kept) == Counter({r.component_id for r in rows}) and kept[0].__fields__ == docs.drop("fp").columns


@pytest.mark.parametrize("n", [3, 40, 400, 1200])
def test_bk_tree_links(n):
    rng = random.Random(n)
    base = [rng.getrandbits(64) for _ in range(max(1, n // 40))]
    values = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(40)})
    found = simhash._spanning(values, 3)
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    near = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3]
    assert plain_components(values, found) == plain_components(values, near)


def test_large_shards_are_split(spark):
    rng = random.Random(11)
    base = rng.getrandbits(64)
    values = list({base ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 8))) for _ in range(700)})
    prints = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    near = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3]
    found = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.links(prints, 3, shard_size=50).collect()]
    assert plain_components(values, found) == plain_components(values, near)


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    pairs = chain + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(7, 7), (1, 2), (2, 1)]
    got = {r.node: r.root for r in graphs.components(spark.createDataFrame(pairs, "a long, b long").repartition(3)).collect()}
    nodes = {x for a, b in pairs for x in (a, b) if a != b}
    want = plain_components(sorted(nodes), [(a, b) for a, b in pairs if a != b])
    assert got == want
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 7

def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs):
    db = oracle.connect("/root/testdata/sf0.01")
    oracle.same(queries.op7_risk_rules(spark, "/root/testdata/sf0.01"), db, queries.ORACLE_SQL["op7_risk_rules"])
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    rows = quality_rules.judged(docs, labels).collect()
    want = Counter((r.doc_id, *plain_measures(r.text)) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed) for r in rows)
    assert quality_rules.judged(docs.limit(0), labels).count() == 0


def test_binomial_and_cutoffs(spark):
    for n, k, p in ((50, 0, 0.01), (200, 3, 0.05), (1000, 25, 0.02), (5, 5, 0.3)):
        exact = float(sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("x")).first().x
        assert abs(got - exact) < 1e-9 * max(1, exact)
    # 2000 good rows, a tenth of which would fail the strictest cutoffs for symbols: these must not be chosen.
    rows = spark.range(2000).select(F.lit("s").alias("stratum"), *(F.lit(v).cast("long").alias(c) for c, v in (("n_words", 100), ("word_chars", 1000), ("n_dup_lines", 0), ("n_repeat_words", 0), ("n_lines", 10), ("n_capitals", 0), ("n_marks", 0))), F.when(F.col("id") % 10 == 0, 60).otherwise(0).cast("long").alias("n_symbols"))
    chosen = {r.rule: (r.cutoff, r.n_rejected) for r in quality_rules.cutoffs(rows, 0.05, 0.05).collect()}
    assert chosen["symbols"] == (0.07, 0) and chosen["marks"][0] == 0.03


# -- 3

def test_language_lattice(monkeypatch):
    names = ["", "▁", "▁a", "a", "b", "ab", "▁ab"]
    place = {x: i for i, x in enumerate(names) if x}
    pieces = language_id.Pieces(names, {i: 0 for i in range(256)})
    rng = np.random.default_rng(3)
    p = rng.random((2, 7))

    def every(word):
        if not word:
            yield []
        for k in range(1, len(word) + 1):
            if word[:k] in place:
                yield from ([place[word[:k]], *rest] for rest in every(word[k:]))
            elif k == 1:
                yield from ([0] * len(word[:1].encode()) + rest for rest in every(word[1:]))

    words = ["a", "ab", "abab", "bxa", "é", "aabba", "ababababx", "bb"]
    lattice = language_id.Lattice(pieces, words)
    got = lattice.log_likelihood(lattice.weights(p))
    for w, word in enumerate(words):
        assert np.allclose(got[w], np.log(sum(p[:, s].prod(axis=1) for s in every("▁" + word))))
    times = np.arange(1.0, len(words) + 1)
    uses = lattice.expected(lattice.weights(p[:1]), times)
    want = np.zeros(7)
    for c, word in zip(times, words, strict=True):
        paths = list(every("▁" + word))
        chances = np.array([p[0, s].prod() for s in paths])
        for s, share in zip(paths, chances / chances.sum() * c, strict=True):
            np.add.at(want, s, share)
    assert np.allclose(uses, want)
    long = language_id.Lattice(pieces, ["abx" * 5000])
    assert np.isfinite(long.log_likelihood(long.weights(p))).all()
    # Cutting the words into several lattices changes nothing.
    monkeypatch.setattr(language_id, "LATTICE", 8)
    parts = list(language_id.lattices(pieces, words))
    assert len(parts) > 2 and np.allclose(np.concatenate([x.log_likelihood(x.weights(p)) for x, _ in parts]), got)


def test_number_table():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    own = language_id.Table(keys, np.arange(len(keys)))
    assert (own.get(keys) == np.arange(len(keys))).all() and (own.get(np.setdiff1d(rng.integers(0, 1 << 40, 5000), keys)) == -1).all()


def test_language_words_that_underflow():
    pieces = language_id.Pieces.load(tokenizer("piece_bpe_32k.model"))
    odd = ["\U0001f9a9" * 18, "\U0001f9a9" * 59, "\U0001f9a9" * 500, "\U00013080" * 58, "龘靐齉爩" * 14, "龘靐齉爩" * 300, "กขฃคฅฆง" * 8, "internationalisation" + "\U0001f9a9" * 40, "x" * 70]
    own = {"a": {"the": 9, "cat": 3, **dict.fromkeys(odd, 2)}, "b": {"der": 9, "hund": 3}, "c": {"le": 9, "chat": 3}}
    model = language_id.Model.learn(pieces, own, dict.fromkeys(own, 1 / 3))
    assert np.isfinite(model.p).all() and (model.p > 0).all() and np.allclose(model.p.sum(axis=1), 1)
    only = language_id.Model.learn(pieces, {"a": {"x" * 70: 5}}, {"a": 1.0})
    assert only.p[0].max() > 10 / pieces.size  # long words are learned from
    texts = [*odd, *("cat " + x for x in odd), "der hund", "le chat", None, "", "12 34"]
    got = list(zip(*model.predict(pa.array(texts)), strict=True))
    assert all(0 <= score <= 1 for _, score in got) and [x for x, _ in got[-5:]] == ["b", "c", "und", "und", "und"]
    assert all(x == ("und", 0.0) or x[0] == "a" for x in got[: 2 * len(odd)])
    assert np.isfinite(model.logs).all()
    # One way of writing each of these: bytes only, so that the likelihood is known.
    flat = np.full((2, pieces.size), 1e-7)
    for n in (18, 59, 200):
        lattice = language_id.Lattice(pieces, ["\U0001f9a9" * n])
        assert np.allclose(lattice.log_likelihood(lattice.weights(flat)), (4 * n + 1) * math.log(1e-7))
        assert np.isclose(lattice.expected(lattice.weights(flat[:1]), np.array([3.0])).sum(), 3 * (4 * n + 1))


def test_language_id(spark, docs):
    rows = queries.op3_piece_unigrams(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    path = tokenizer("piece_bpe_32k.model")
    model = language_id.learn(docs, path, F.lit(True))
    got = language_id.identify(docs, model, path).collect()
    letters = {t: any(map(str.isalpha, t or "")) for t in EDGE}
    assert len(got) == docs.count() and sum(r.lang_pred == "und" for r in got) == sum(not letters[r.text] for r in docs.select("text").collect())
    assert language_id.keep_identified(docs, model, path).columns == docs.columns
    empty = language_id.learn(docs.limit(0), path, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, empty, path).collect()} == {"und"}


# -- 1

def test_pu_quality(spark, docs):
    sf = "/root/testdata/sf0.01"
    rows = queries.op1_nnpu(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    held = [(labels[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    network, prior = pu_quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert prior == 0.5 and {r.score for r in pu_quality.score(docs.drop("score"), network).collect()} == {0.5}
    assert pu_quality.keep_good(docs, network).columns == docs.columns


def test_prior_is_found():
    rng = np.random.default_rng(9)
    p = rng.normal(1, 0.3, (1500, pu_quality.N_FEATURES))
    u = np.concatenate([rng.normal(1, 0.3, (1050, pu_quality.N_FEATURES)), rng.normal(-1, 0.3, (450, pu_quality.N_FEATURES))])
    prior = pu_quality.estimate_prior(p, rng.permutation(u))
    assert abs(prior - 0.7) < 0.06
    net = pu_quality._fit(p, u, prior)
    assert (net.score(u[:1050]) >= 0.5).mean() > 0.97 and (net.score(u[1050:]) < 0.5).mean() > 0.97


# -- 8

def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1), (1, 2**63), (5, 3), (1000, 2**64 - 1), (20_000, 2**40), (5000, 6000)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        sequences, arrays, meta = elias_fano.load(np.frombuffer(elias_fano.dump({"x": elias_fano.EliasFano.build(values)}, {"y": np.arange(5, dtype="<u2")}, {"k": 1}), np.uint8))
        own = sequences["x"]
        asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
        at = own.search(asked)
        assert ((at >= 0) == np.isin(asked, values)).all() and (values[at[at >= 0]] == asked[at >= 0]).all()
        assert not n or (own.get(np.arange(n)) == values).all()
        assert arrays["y"].tolist() == list(range(5)) and meta == {"k": 1}


def test_tokens_of_slices():
    texts = pa.array([(t or "").encode() for t in EDGE] + [b"A\x0bb\x0cC\x1cd \xc3\x89\xff", b"", b" x"])
    for part in (texts, texts.slice(4), texts.slice(2, 3), texts.slice(9, 0), texts.slice(len(texts) - 2)):
        sizes, at, words = ngram_lm.tokens(part)
        want = [t.lower().split() + [b"\n"] for t in part.to_pylist()]
        assert [words[k] for k in at.tolist()] == list(itertools.chain.from_iterable(want)) and sizes.tolist() == list(map(len, want))


def test_language_model(spark, docs, small):
    for df in (docs, small):
        train = F.coalesce(fold(F.col("doc_id"), 7) != 2, F.lit(False))
        got = ngram_lm.score(df, ngram_lm.learn(df, train)).collect()
        split = lambda t: [*(t or "").encode().lower().split(), b"\n"]
        texts = [(r.doc_id, split(r.text)) for r in df.select("doc_id", "text").collect()]
        one, two, three = Counter(), Counter(), Counter()
        for i, x in texts:
            if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
                one.update(x)
                two.update(zip([b"\n", *x], x, strict=False))
                three.update(zip([b"\n", *x], x, x[1:], strict=False))
        n, v, k, l = sum(one.values()), len(one), ngram_lm.STRENGTH, ngram_lm.STRENGTH_3  # noqa: E741
        single = lambda w: (one[w] + 1) / (n + v + 1)
        pair = lambda c, w: (two[c, w] + k * single(w)) / (one[c] + k)
        triple = lambda b, c, w: (three[b, c, w] + l * pair(c, w)) / (two[b, c] + l)
        whole = lambda x: math.log10(pair(b"\n", x[0])) + sum(math.log10(triple(*g)) for g in zip([b"\n", *x], x, x[1:], strict=False))
        want = sorted((len(x), sum(one[w] > 0 for w in x), n, sum(math.log10(single(w)) for w in x), whole(x)) for _, x in texts)
        have = sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
        assert len(have) == len(want)
        for a, b in zip(have, want, strict=True):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9) and abs(a[4] - b[4]) <= a[0] * ngram_lm.STEP
        assert not two or abs(sum((two[b"\n", w] + k * single(w)) / (one[b"\n"] + k) for w in one) + k / (n + v + 1) / (one[b"\n"] + k) - 1) < 1e-9
    # However few shards are open at a time, the scores are the same.
    model = ngram_lm.learn(small, F.lit(True))
    one, many = ngram_lm.Reader(model, 1), ngram_lm.Reader(model, 1000)
    some = pa.array([t.encode() for t in EDGE[1:8]])
    assert [x.tolist() for x in one.score(some)] == [x.tolist() for x in many.score(some)] and len(one.words.open) == len(one.tries.open) == 1 < len(many.words.open)
    nothing = ngram_lm.score(docs, ngram_lm.learn(docs, F.lit(False))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in nothing)


# -- 9

def test_token_rollup(spark, docs):
    db = oracle.connect("/root/testdata/sf0.01")
    oracle.same(queries.op9_token_rollup(spark, "/root/testdata/sf0.01"), db, queries.ORACLE_SQL["op9_token_rollup"])
    total = token_rollup.maintained(docs).agg(F.sum("n_docs")).first()[0]
    groups = {}
    for r in docs.select("doc_id", "text").collect():
        groups.setdefault(r.text, []).append((r.doc_id is None, r.doc_id or 0))
    assert total == sum(sum(x == min(own) for x in own) for own in groups.values())
    assert token_rollup.maintained(docs.limit(0)).count() == 0


def test_rollup_commits(spark, monkeypatch):
    rows = spark.createDataFrame([("a", "en", "v1", 5), ("a", "en", "v1", 7), (None, None, "v1", None)], "source string, lang string, tokenizer string, tokens long")
    rollup = token_rollup.Rollup(spark)
    assert rollup.commit("1", token_rollup.insert(rows)) and not rollup.commit("1", token_rollup.insert(rows))
    state = lambda: {(r.source, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert state() == {("a", "v1"): (2, 12), (None, "v1"): (1, 0)}
    names = lambda: sorted(r.batch for r in rollup.batches().collect())
    gone = rows.filter("tokens = 5")
    rollup.commit("2", token_rollup.revise(gone, gone.withColumns({"tokenizer": F.lit("v2"), "tokens": F.lit(6).cast("long")})))
    assert state() == {("a", "v1"): (1, 7), ("a", "v2"): (1, 6), (None, "v1"): (1, 0)}
    before = state()
    rollup.compact()
    assert state() == before and names() == ["1", "2"] and not rollup.commit("2", token_rollup.insert(rows))
    rollup.commit("3", token_rollup.delete(rows.filter("source is null")))
    rollup.compact()
    assert (None, "v1") not in state() and names() == ["1", "2", "3"]
    # A driver that dies before it has deleted what a sum replaces, twice.
    monkeypatch.setattr(token_rollup.Rollup, "_clear", lambda self: None)
    for batch in ("4", "5"):
        rollup.commit(batch, token_rollup.insert(rows.limit(1)))
        before = state()
        rollup.compact()
        assert state() == before and not rollup.commit(batch, token_rollup.insert(rows))
    monkeypatch.undo()
    rollup.compact()
    assert state() == before and names() == ["1", "2", "3", "4", "5"] and len(rollup._state()[1]) == 0
    assert not rollup._publish(rollup._sums(*rollup._state()).withColumn("batch", F.lit("x")), rollup._state()[0])


def test_rollup_of_tokenizer_files(spark, docs):
    paths = {v: tokenizer(f"{v}.json") for v in ("word_bpe_49k", "byte_bpe_50k")}
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_rollup.by_tokenizer(docs, paths).collect()}
    library, want = Tokenizer.from_file(paths["byte_bpe_50k"]), {}
    for r in docs.collect():
        n, total = want.get((r.source, r.lang, "byte_bpe_50k"), (0, 0))
        want[r.source, r.lang, "byte_bpe_50k"] = n + 1, total + len(library.encode(r.text or "", add_special_tokens=False).ids)
    assert got == want


# -- 10

def test_cover_tree(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = np.concatenate([rng.normal(size=(150, 16)), np.repeat(centres, 12, axis=0) + rng.normal(size=(240, 16)) * 0.12]).astype(np.float32)
    vectors = np.concatenate([vectors, vectors[:3], vectors[200:201] * 2, vectors[200:201]])
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate(vectors)]
    odd = [(900, None, "x"), (901, [0.0] * 16, "x"), (902, [float("nan")] + [1.0] * 15, "x"), (903, [None] + [1.0] * 15, "x"), (904, [float("inf")] + [1.0] * 15, "x"), (905, [1.0, 2.0], "x"), (906, [2.0, 4.0], "x"), (907, [], "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label string").repartition(3)
    unit = cover_tree.unit(vectors.astype(float))
    linked = [(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9), strict=True) if i < j] + [(905, 906)]
    ids = [r[0] for r in rows + odd]
    roots, links = plain_components(ids, linked), Counter(x for pair in linked for x in pair)
    for block in (64, 2048):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.neighbours(df, 0.9, block=block).collect()}
        assert got == {i: (links[i], roots[i], roots[i] == i) for i in ids}
    assert cover_tree.neighbours(df.limit(0)).count() == 0


def test_scaled_copies_at_the_threshold(spark):
    """Copies of one direction within rounding of the threshold link by their exact cosine."""
    v = np.array([1.0, 0.0, 0.0])
    rows = [(i, (v * (i + 1)).tolist()) for i in range(24)]
    for k, cosine in enumerate((0.9 - 1e-7, 0.9 + 1e-7)):
        rows.append((100 + k, [cosine, math.sqrt(1 - cosine**2), 0.0]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (8, 64):
        got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.neighbours(df, 0.9, block=block).collect()}
        assert got[101] == (25, 0) and got[100] == (1, 0) and all(got[i] == (24, 0) for i in range(24))


def test_cover_tree_sql(spark):
    db = oracle.connect("/root/testdata/sf0.01")
    oracle.same(queries.op10_cover_tree(spark, "/root/testdata/sf0.01"), db, queries.ORACLE_SQL["op10_cover_tree"])


# -- pipeline and queries

def plain_shingles(text, words):
    own = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


@pytest.mark.parametrize("large", [2, 32])
def test_near_duplicate_stage_finds_all(spark, docs, monkeypatch, large):
    import corpus_pipeline as pipeline

    monkeypatch.setattr(simhash_texts, "LARGE", large)
    rng = random.Random(12)
    rows = [(i, t) for i, t in enumerate(EDGE)]
    for group in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(12):
            own = base[:]
            for _ in range(rng.randrange(1 + len(base) // 30)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(400)}"
            rows.append((len(rows), " ".join([f"h{group}"] * rng.randrange(3) + own)))
    sets = {i: plain_shingles(t, 5) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b])]
    far = [(a, b) for a, b in near if (plain_fingerprint(rows[a][1], 3) ^ plain_fingerprint(rows[b][1], 3)).bit_count() > 3]
    assert len(far) > 100
    want = set(plain_components(sorted(sets), near).values())
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string").repartition(3)
    kept = pipeline.STAGES[2][1](spark, df, SF)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_near_duplicate_stage_on_table(spark):
    import corpus_pipeline as pipeline

    df = table(spark, "/root/testdata/sf0.01", "documents")
    sets = {r.doc_id: plain_shingles(r.text, 5) for r in df.collect()}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if alike(sets[a], sets[b])]
    want = set(plain_components(sorted(sets), near).values())
    assert {r.doc_id for r in pipeline.STAGES[2][1](spark, df, SF).collect()} == want



def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    columns = docs.columns
    kept = docs
    for name, stage in pipeline.STAGES[:3]:
        out = stage(spark, kept, "/root/testdata/sf0.01")
        assert out.columns == columns, name
        rows = out.collect()
        assert 0 < len(rows) <= kept.count()
        kept = spark.createDataFrame(rows, docs.schema)
    prints = [plain_fingerprint(r.text, 3) for r in kept.collect()]
    assert not any((a ^ b).bit_count() <= 3 for a, b in itertools.combinations(prints, 2))
    labels = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    left = {r.doc_id for r in kept.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in good) > 0.8 * len(good)
    packed_well(pipeline.STAGES[3][1](spark, kept, SF).collect(), 2048)
    empty = spark.createDataFrame([], docs.schema)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.01").count() == 0, name


def test_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert spark.range(1).select(held_out(F.lit(None).cast("long"), 3, 1)).first()[0] is False
