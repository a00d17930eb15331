"""Small sets and large groups of the near-duplicate stage, many rounds of packing, and operators on their own
in a process that has no path to the package."""

import itertools
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from kbspark.llm import packing, simhash_texts


def sets_of(text, words=5):
    own = (text or "").lower().split()
    return {tuple(own[i : i + min(words, len(own))]) for i in range(max(1, len(own) - words + 1))} if own else set()


def groups(texts):
    """Components of texts by all pairs; each has the least number of its members."""
    sets, root = [sets_of(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both * 10 >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(i) for i in range(len(texts))}


@pytest.mark.parametrize(("large", "block"), [(32, 8192), (3, 8192), (3, 7)])
def test_small_sets_lose_no_link(spark, monkeypatch, large, block):
    """Pairs whose similarity is exactly 0.8: sets of 4 and 5 shingles, 8 and 10, and larger ones."""
    monkeypatch.setattr(simhash_texts, "LARGE", large)
    monkeypatch.setattr(simhash_texts, "BLOCK", block)
    rng = random.Random(8)
    texts = []
    for size in (8, 12, 20, 44):
        for _ in range(150 if size == 8 else 30):
            own = [f"w{rng.randrange(9000)}" for _ in range(size)]
            texts += [" ".join(own), " ".join([*own, *(f"n{rng.randrange(9000)}" for _ in range((size - 4) // 4))])]
    shared = [f"s{i}" for i in range(40)]
    for _ in range(60):  # a passage that many share, with and without much else
        extra = [f"e{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 4, 6, 9, 30]))]
        texts.append(" ".join(shared + extra))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash_texts.keep_first(df).collect()} == groups(texts)


def test_many_rounds_of_packing(spark, monkeypatch):
    """Numbers of sequences stay apart over as many rounds as there are."""
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 60, 500)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "n int, length int")
    got = packing.pack(rows, 100, per_partition=5).collect()
    check_packed(got, sizes, 100)
    # What a round of very late partitions would write.
    part = pa.RecordBatch.from_arrays([pa.array([30, 70, 50], pa.int32()), pa.nulls(3, pa.int64()), pa.nulls(3, pa.int64()), pa.array([True] * 3)], names=["length", "sequence_id", "offset", "loose"])

    class Context:
        def partitionId(self):
            return 7

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: Context())
    late = pa.Table.from_batches(packing._packed(iter([part]), 100, 1 << 30))
    assert {x >> 32 for x in late["sequence_id"].to_pylist()} == {(1 << 30) + 7} and len(set(late["sequence_id"].to_pylist())) == 2


def check_packed(rows, sizes, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(n for b in bins.values() for _, n in b) == sorted(sizes)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity


ALONE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{folder}").getOrCreate()
from kbspark.llm import packing, sstable
from kbspark.llm.queries import tokenizer
docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
print("CUT", packing.cut(docs, tokenizer("byte_bpe_50k.json"), 0, 2048).count())
print("READ", sstable.read_shards(sstable.write_shards(docs, tokenizer("word_bpe_49k.json"), 2)).count())
"""


def test_operators_send_the_package_themselves(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK_", "PYSPARK_"))}
    done = subprocess.run([sys.executable, "-c", ALONE.format(root=root, folder=tmp_path)], env=env | {"PYSPARK_PYTHON": sys.executable}, cwd=tmp_path, capture_output=True, text=True, timeout=170)
    assert "CUT 2" in done.stdout and "READ 2" in done.stdout, done.stdout + done.stderr[-2000:]


def test_risk_against_plain_loops(spark):
    """The risk over all rows recomputed row by row, its slope by differences, and steps that lower it."""
    from kbspark.llm import pu_quality as pu

    rng = np.random.default_rng(11)
    p, bad = rng.normal(0.8, 1, (150, pu.N_FEATURES)), rng.normal(-0.8, 1, (150, pu.N_FEATURES))
    x, trusted = np.concatenate([p, bad]).astype(np.float32).astype(float), np.arange(300) < 40
    net = pu._fit(x[trusted], x, 0.5)
    for weights in (net.w1, net.w2):
        weights *= 0.3
    sums = pu.parts(net, x, trusted)
    score = [1 / (1 + np.exp(-float(net.raw(row[None])[0]))) for row in x]
    good = np.mean([-np.log(s) for s, t in zip(score, trusted, strict=True) if t])
    as_bad = np.mean([-np.log(1 - s) for s, t in zip(score, trusted, strict=True) if t])
    every = np.mean([-np.log(1 - s) for s in score])
    for prior in (0.3, 0.97):
        risk, negative, slope = pu.risk_and_slope(sums, prior)
        assert abs(negative - (every - prior * as_bad)) < 1e-9 and abs(risk - (prior * good + max(0, every - prior * as_bad))) < 1e-9

        def along(k, eps, prior=prior, negative=negative):
            flat = [w.copy() for w in (net.w1, net.b1, net.w2, net.b2)]
            at = k
            for w in flat:
                if at < w.size:
                    w.ravel()[at] += eps
                    break
                at -= w.size
            own = pu.parts(pu.Network(net.mean, net.scale, *flat), x, trusted)
            n_p, n_u, g, b, e = own[:5]
            part = e / n_u - prior * b / n_p
            return prior * g / n_p + part if negative >= 0 else -part

        for k in rng.integers(0, len(slope), 12):
            assert abs((along(k, 1e-5) - along(k, -1e-5)) / 2e-5 - slope[k]) < 1e-6
    rows = spark.createDataFrame([(bool(t), row.astype(np.float32).tobytes()) for t, row in zip(trusted, x, strict=True)], "trusted boolean, x binary").repartition(5)
    assert np.allclose(pu._added(rows, lambda a, t: pu.parts(net, a, t)), sums)
    after, risks = pu.refine(net, rows, 0.3, steps=4)
    assert risks[-1] < risks[0] and after.w1.shape == net.w1.shape
