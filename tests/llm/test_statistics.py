"""Divergence audit, importance resampling and toxicity: brute force, SQL, and edge rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from kbspark.llm import divergence, importance, queries, toxicity
from kbspark.llm.common import fold, table

SF = "/root/testdata/sf0.001"
EDGE = [None, "", " \n\t", "one", "The cat sat on the mat. " * 30, "The cat sat on the mat. " * 30, "Ünïcode ÉÀ wörter and 12 numbers 3x " * 9, "a" * 3000, "word " * 60_000, "x\0y A-B", "\n\n"]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge rows with null and repeated identifiers, null groups, and columns whose names operators use themselves."""
    rng = random.Random(3)
    texts = EDGE + [" ".join(rng.choice(["aa", "bb", "Cc", "dd", "é", "common", f"w{rng.randrange(30)}", "abcdefgh"[: rng.randrange(1, 8)]]) for _ in range(rng.randrange(60))) for _ in range(120)]
    rows = [(i if i != 3 else None, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3", "s4", "s5", "s6"][i % 7 if i % 3 else i % 2], "x", 7, "y", 0.5, 1) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], rows[0], rows[8], rows[8]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, term string, n long, owned string, score double, rank int").repartition(3)


def audited(rows, top=200):
    """By the definition, one pair and one term at a time."""
    own = [(r.lang or "", r.source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")]) for r in rows]
    out = []
    for lang in {o[0] for o in own}:
        mine = [o for o in own if o[0] == lang]
        kept = sorted(w for w, n in Counter(w for o in mine for w in set(o[2])).items() if n >= 3)
        count = {s: Counter(w for o in mine if o[1] == s for w in o[2] if w in set(kept)) for s in {o[1] for o in mine}}
        every = sum(count.values(), Counter())
        p = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in count.items():
            pairs = [(-sum(f(p(c, w), p(d, w)) for w in kept), o.encode(), o) for o, d in count.items() if o != s]
            terms = [(-f(p(c, w), p(every, w)), w.encode(), w) for w in kept if c[w] and p(c, w) > p(every, w)]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(items, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"light": 2, "tile_terms": 5, "tile_groups": 2}, {"light": 1}, {"light": 100}])
def test_divergence(docs, sizes):
    got = divergence.audit(docs, **sizes)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == audited(docs.collect())


def test_divergence_edges(spark, docs):
    assert divergence.audit(docs.limit(0)).count() == 0
    bare = spark.createDataFrame([("a", "s", None), ("a", "t", ""), ("b", "s", "one two")], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.audit(bare).collect())) == [("a", "s", "pair", "t", 0, 1), ("a", "t", "pair", "s", 0, 1)]
    assert sorted(map(tuple, divergence.audit(docs, top=3).filter("part = 'term'").collect())) == [r for r in audited(docs.collect(), top=3) if r[2] == "term"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def drawn(rows, target):
    feats = lambda text: (lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])(words_of(text))
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for r in rows for f in feats(r.text)), Counter(bucket(f) for x in target for f in feats(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000))))
    out = []
    for r in rows:
        own = feats(r.text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        out.append((r.doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(r.text))))
    can = sorted((o for o in out if o[4] >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    top = can[: 25 * len(can) // 100]
    rank = {}
    for k, o in enumerate(top, 1):
        rank.setdefault(o[0], []).append(k)
    return out, rank


@pytest.mark.parametrize("chunks", [{}, {"chunk_bytes": 30, "chunk_words": 7}, {"chunk_bytes": 0, "chunk_words": 1}])
def test_resampling(spark, docs, chunks):
    target = ["aa bb é common", None, "Cc dd 12 numbers", ""]
    got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), **chunks)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    want, rank = drawn(docs.collect(), target)
    key = lambda x: str(x[0])
    assert sorted((tuple(r)[:4] for r in rows), key=key) == sorted((w[:4] for w in want), key=key)
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 1 + sum(map(len, rank.values()))))
    assert {k: sorted(r.rank for r in rows if r.doc_id == k and r.rank) for k in rank} == rank


def test_resampling_edges(spark, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).count() == 0
    assert importance.resample(docs, none).count() == docs.count()


def test_joined_checksums():
    rng = random.Random(1)
    some = lambda sizes: [rng.randbytes(rng.choice(sizes)) for _ in range(60)]
    a, b = some([0, 1, 3, 70, 5000]), some([0, 1, 5, 63, 64, 65, 129, 70_000])
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    assert (importance.joined(crc(a), crc(b), np.array([len(x) for x in b])) == crc([x + y for x, y in zip(a, b, strict=True)])).all()


def test_chunks_own_each_start_once():
    text = ("Some words, über 12 of them; " * 50).encode()
    whole = importance.features(pa.array([text], pa.binary()))
    for size in (1, 2, 7, 1000):
        cut = list(importance.chunks(text, size))
        part = importance.features(pa.array([c[1] for c in cut], pa.binary()), np.array([c[0] for c in cut]))
        assert sum(c[0] for c in cut) == whole[0][0] and Counter(part[1].tolist()) == Counter(whole[1].tolist())


@pytest.mark.parametrize("name", ["op11_heavy_light", "op12_overlap_chunks"])
def test_equals_sql(spark, name):
    oracle.same(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name])


# -- 13

def made(rng, toxic):
    own = ["".join(rng.choice(["ba", "do", "ki", "lu", "me", "so", "ti"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(60, 160))]
    for _ in range(4 * toxic):
        own[rng.randrange(len(own))] = rng.choice(["vilegrump", "Snarkwort", "dregfool"])
    return " ".join(own)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(9)
    rows = [(i, made(rng, i % 4 == 0), int(i % 4 == 0)) for i in range(1200)]
    whole = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    return whole.drop("toxic"), whole.select("doc_id", "toxic"), toxicity.learn(whole.drop("toxic"), whole.select("doc_id", "toxic"), fold(F.col("doc_id"), 5) != 0)


def test_toxicity_on_rows_held_out(judged):
    docs, labels, found = judged
    assert b"vilegrump" in found.toxic and found.toxic.startswith(found.ordinary) and b"vilegrump" not in found.ordinary
    rows = toxicity.score(docs, found).filter(fold(F.col("doc_id"), 5) == 0).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) > 0.95 * len(rows)
    again = toxicity.learn(docs.repartition(2), labels, fold(F.col("doc_id"), 5) != 0)
    assert (again.ordinary, again.toxic) == (found.ordinary, found.toxic) and np.allclose(again.weights, found.weights)


def test_marks_against_plain_counts():
    rng = random.Random(2)
    toxic, ordinary = ([made(rng, kind).encode() for _ in range(150)] for kind in (1, 0))
    own, other = toxicity._contexts(toxic), toxicity._contexts(ordinary)

    def plain(texts):
        seen = set()
        for i, t in enumerate(texts):
            w = [f"<{i}", *t.decode().lower().split(), ">"]
            seen |= {(a if a[0] != "<" else "<", b, c) for a, b, c in zip(w, w[1:], w[2:], strict=False)}
        return Counter(b.encode() for _, b, _ in seen)

    assert own == plain(toxic) and other == plain(ordinary)
    n1, n0 = sum(own.values()), sum(other.values())
    count = lambda words: Counter(g for w, n in words.items() for size in toxicity.GRAMS for g in [(b" %b " % w)[i : i + size] for i in range(len(w) + 3 - size)] for _ in range(n))
    a, b = count(own), count(other)
    want = set()
    for g, n in a.items():
        p = (n + b[g]) / (n1 + n0)
        g2 = 2 * (n * math.log(n / n1 / p) + (b[g] * math.log(b[g] / n0 / p) if b[g] else 0))
        if n >= 4 and g2 > 30 and n / n1 > 5 * (b[g] + 0.5) / n0:
            want.add(g)
    assert toxicity.marks(own, other) == want and b"vilegr" in want


def test_toxicity_edges(spark, docs, judged):
    _, labels, found = judged
    plain = toxicity.score(docs, found)
    assert plain.columns == ["doc_id", "score", "predicted"] and plain.count() == docs.count()
    assert all(0 <= r.score <= 1 for r in plain.collect())
    assert toxicity.score(docs.limit(0), found).count() == 0
    kept = toxicity.drop_toxic(docs, found)
    assert kept.columns == docs.columns
    clash = docs.withColumn("_Toxicity_Score", F.lit(1))
    with pytest.raises(ValueError):
        toxicity.drop_toxic(clash, found)
    nothing = toxicity.learn(docs, labels.limit(0), F.lit(True))
    assert {(r.score, r.predicted) for r in toxicity.score(docs, nothing).collect()} == {(0.0, 0)}
    of_one = labels.withColumn("toxic", F.when(F.col("doc_id") % 2 == 0, 1))
    assert toxicity.learn(docs, of_one, F.lit(True)).weights is None
    assert toxicity.windows(b"") == toxicity.windows(b" \n") == [b"  "]
    text = b"Some words of any length, " * 40
    assert b" ".join(x.strip() for x in toxicity.windows(text)) == text.lower().strip()


def test_toxicity_query(spark):
    got = queries.QUERIES["op13_zstd_distance"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert got.count() == table(spark, SF, "documents").count()
