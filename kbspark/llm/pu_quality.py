"""Quality classifier from positive and unlabelled texts.

Trusted good documents are the positives, other web text is unlabelled, and the share of good
documents among the unlabelled is estimated: no negative label is used. A small network is fitted
to the non-negative unbiased risk

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)),

whose second part estimates the risk on negatives; where it turns negative on a batch the step goes
the other way, so the network can't fit unlabelled texts as negatives one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotated, discard, ship, stored

#: Positives at most (about), and unlabelled documents that the network starts from.
SAMPLE = 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 512, 0.01, 1e-4

_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B)]
_MARKS = [b for b in range(0x21, 0x7F) if b not in _LETTERS]
N_FEATURES = 12 + len(_MARKS) + 26


def features(text: str | None) -> np.ndarray:
    """What a text's quality shows in: repetition, line structure, capitals, marks, letters. A null
    text counts as an empty one."""
    raw = (text or "").encode()
    own = raw.split()
    n, size = len(own), len(raw)
    out = np.zeros(N_FEATURES)
    out[0], out[1] = np.log1p(n), np.log1p(size)
    if not n:
        return out
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = bytes_[0x41:0x5B], bytes_[0x61:0x7B]
    letters = max(1, int(upper.sum() + lower.sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = list(zip(own, own[1:], strict=False))
    out[2] = (size - bytes_[[9, 10, 11, 12, 13, 32]].sum()) / n / 10
    out[3] = len(set(own)) / n
    out[4] = sum(map(eq, own, own[1:])) / n
    out[5] = len(set(pairs)) / max(1, len(pairs))
    out[6] = len(set(lines)) / len(lines)
    out[7] = len(lines) / n
    out[8] = upper.sum() / letters
    out[9] = bytes_[128:].sum() / size
    out[10] = bytes_[32] / size
    out[11] = (n < 20) * 1.0
    out[12 : 12 + len(_MARKS)] = np.sqrt(bytes_[_MARKS] / size)
    out[12 + len(_MARKS) :] = np.sqrt((upper + lower) / letters)
    return out


class Network:
    """One hidden layer; the score is the sigmoid of its output."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -50, 50)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> Network:
    """Adam on the non-negative risk with the logistic loss; without a prior, on the plain risk of
    telling positives from unlabelled, which serves to estimate it."""
    rng = np.random.default_rng(seed)
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(every.shape[1]), (every.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1))
    weights = [net.w1, net.b1, net.w2, net.b2]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    n_batches = max(1, -(-max(len(p), len(u)) // BATCH))
    for epoch in range(EPOCHS):
        p_parts, u_parts = (np.array_split(rng.permutation(max(len(x), n_batches)) % len(x), n_batches) for x in (p, u))
        for a, b in zip(p_parts, u_parts, strict=True):
            x = np.concatenate([p[a], u[b]])
            n_p, n_u = len(a), len(b)
            hidden = np.tanh(x @ net.w1 + net.b1)
            s = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -50, 50)))
            # Slopes of the logistic losses for label 1 and label 0.
            plus, minus = s - 1, s
            slope = np.zeros(len(x))
            if prior is None:
                slope[:n_p], slope[n_p:] = plus[:n_p] / n_p, minus[n_p:] / n_u
            else:
                loss_minus = -np.log1p(-np.minimum(s, 1 - 1e-12))
                negative = loss_minus[n_p:].mean() - prior * loss_minus[:n_p].mean()
                if negative >= 0:
                    slope[:n_p] = prior * (plus[:n_p] - minus[:n_p]) / n_p
                    slope[n_p:] = minus[n_p:] / n_u
                else:
                    slope[:n_p], slope[n_p:] = prior * minus[:n_p] / n_p, -minus[n_p:] / n_u
            back = slope[:, None] * net.w2 * (1 - hidden**2)
            grads = [x.T @ back + DECAY * net.w1, back.sum(axis=0), hidden.T @ slope + DECAY * net.w2, np.array([slope.sum()])]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for w, g, m, v in zip(weights, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


#: Thresholds at which shares are compared.
CUTS = 96


def _telling(positive: np.ndarray, unlabelled: np.ndarray, held: np.ndarray) -> tuple[Network, np.ndarray]:
    """A classifier that tells positives from unlabelled, and thresholds from the scores of positives that it has not seen."""
    net = _fit(positive, unlabelled, None)
    return net, np.quantile(net.raw(held), np.linspace(0.0, 0.95, CUTS))


def _share(above_p: np.ndarray, n_p: int, above_u: np.ndarray, n_u: int) -> float:
    """The prior from how many positives and unlabelled are at or above each threshold."""
    share_p, share_u = above_p / n_p, above_u / n_u
    wide = np.sqrt(np.log(4 / 0.1) / 2 / n_u) + np.sqrt(np.log(4 / 0.1) / 2 / n_p)
    best = int(np.argmin((share_u + wide) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def _above(scores: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return len(scores) - np.searchsorted(np.sort(scores), cut, "left")


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, by the best top bin of a classifier that tells
    the two apart: above any threshold, the unlabelled's share over the positives' share is at least
    the prior, and equals it where no negative scores so high. The threshold with the least upper
    confidence bound is taken. Fitting and estimating use different halves."""
    held_p, held_u = positive[1::2], unlabelled[1::2]
    if not len(held_p) or not len(held_u):
        return 0.5
    net, cut = _telling(positive[::2], unlabelled[::2], held_p)
    return _share(_above(net.raw(held_p), cut), len(held_p), _above(net.raw(held_u), cut), len(held_u))


def parts(net: Network, x: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """What rows add to the risk, as one row of sums: trusted and all rows, their losses (trusted as good, trusted as bad,
    all as bad), and the slopes of these three by the weights. Every row counts as unlabelled."""
    z = np.clip((x - net.mean) / net.scale, -8, 8)
    hidden = np.tanh(z @ net.w1 + net.b1)
    s = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -50, 50)))
    bad = -np.log1p(-np.minimum(s, 1 - 1e-12))
    out = [[trusted.sum(), len(x), -np.log(np.maximum(s[trusted], 1e-22)).sum(), bad[trusted].sum(), bad.sum()]]
    for rows, slope in ((trusted, s - 1), (trusted, s), (np.ones(len(x), bool), s)):
        own, h = slope[rows], hidden[rows]
        back = own[:, None] * net.w2 * (1 - h**2)
        out += [(z[rows].T @ back).ravel(), back.sum(axis=0), h.T @ own, [own.sum()]]
    return np.concatenate(out)


def risk_and_slope(sums: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The non-negative risk, its part on negatives before it is cut at nothing, and the direction's slope: where
    that part is negative, the one that brings it back."""
    n_p, n_u, good, bad, all_bad = sums[:5]
    plus, minus, every = sums[5:].reshape(3, -1)
    negative = all_bad / n_u - prior * bad / n_p
    risk = prior * good / n_p + max(0.0, negative)
    if negative >= 0:
        return risk, negative, prior * (plus - minus) / n_p + every / n_u
    return risk, negative, prior * minus / n_p - every / n_u


def _added(rows: DataFrame, make) -> np.ndarray:
    """The sum over all rows of the vectors that ``make(x, trusted)`` makes of a batch: tasks add up their own, then
    ``SUMS`` tasks theirs, so that the driver gets few however many there are."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
                own = make(x, batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SUMS], pa.int32()), pa.array([total.astype(float).tobytes()], pa.binary())], names=["bucket", "v"])

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("v").to_pylist():
                own = np.frombuffer(v)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    found = rows.mapInArrow(first, "bucket int, v binary").repartition(SUMS, "bucket").mapInArrow(second, "v binary").toArrow()
    # In a fixed order, as sums of doubles depend on it.
    return sum(np.frombuffer(v) for v in sorted(found["v"].to_pylist()))


#: Tasks that add up sums; steps over all rows, and their rate at first.
SUMS, STEPS, STEP_RATE = 16, 12, 0.004


def refine(net: Network, rows: DataFrame, prior: float, steps: int = STEPS) -> tuple[Network, list[float]]:
    """Adam on the risk over all rows (trusted, x), each step one pass over their features; and the risks
    before each step."""
    shapes = [w.shape for w in (net.w1, net.b1, net.w2, net.b2)]
    weights = np.concatenate([w.ravel() for w in (net.w1, net.b1, net.w2, net.b2)])
    decays = np.concatenate([np.full(int(np.prod(s)), DECAY if k in (0, 2) else 0.0) for k, s in enumerate(shapes)])
    first, second, risks = np.zeros_like(weights), np.zeros_like(weights), []

    def made(flat: np.ndarray) -> Network:
        cut = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return Network(net.mean, net.scale, *(w.reshape(s) for w, s in zip(np.split(flat, cut), shapes, strict=True)))

    for step in range(1, steps + 1):
        now = made(weights)
        sums = _added(rows, lambda x, trusted, now=now: parts(now, x, trusted))
        risk, _, slope = risk_and_slope(sums, prior)
        risks.append(risk)
        slope = slope + decays * weights
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        rate = STEP_RATE * (1 - (step - 1) / steps)
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return made(weights), risks


def learn(docs: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Network, float]:
    """The fitted network and the estimated prior.

    Positives are documents that ``labels`` marks 1 and for which ``train`` holds (a column over the
    identifier), about ``sample`` of them, picked by a hash of the identifier at a rate from an exact
    count; unlabelled documents are all for which it holds. Whole texts are read once, and their features are
    written. The network starts from about ``sample`` of either, which the driver gets, and is then fitted to all rows, a
    pass over the features for each step. The prior is estimated from half of all rows by a
    classifier that was fitted to some of the other half.
    """
    good = labels.filter(train & (F.col(label_col) == 1)).select(F.col(id_col).alias("doc_id")).distinct()
    pool = docs.filter(train).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    n_good, n_pool = good.count(), pool.count()
    share = lambda salt: F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    trusted = good.filter(place < min(1.0, sample / max(1, n_good))).select("doc_id", F.lit(True).alias("trusted"))
    # At most about ``sample`` identifiers are trusted, so they may be broadcast.
    marked = pool.join(F.broadcast(trusted), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"), (share("unlabelled") < min(1.0, sample / max(1, n_pool))).alias("unlabelled"), (share("half") < 0.5).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t).astype(np.float32).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("trusted", "unlabelled", "held")), pa.array(own, pa.binary())], names=["trusted", "unlabelled", "held", "x"])

    ship(docs.sparkSession)
    rows = stored(marked.mapInArrow(run, "trusted boolean, unlabelled boolean, held boolean, x binary"), "features")
    got = rows.filter("trusted or unlabelled").toArrow()
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
    order = np.lexsort(x.T[::-1])  # the order in which tasks end must not matter
    x, of = x[order], {c: np.array(got[c].to_pylist(), bool)[order] for c in ("trusted", "unlabelled", "held")}
    shuffled = np.random.default_rng(1)
    pick = lambda mask: shuffled.permutation(x[mask])
    p, u = pick(of["trusted"]), pick(of["unlabelled"])
    halves = [pick(of["trusted"] & ~of["held"]), pick(of["unlabelled"] & ~of["held"]), pick(of["trusted"] & of["held"])]
    if len(p) < 4 or len(u) < 4 or not all(map(len, halves)):  # nothing to learn from: every text scores one half
        discard(rows)
        return Network(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)), 0.5
    telling, cut = _telling(*halves)
    counts = _added(rows.filter("held"), lambda x, _: np.append(_above(telling.raw(x), cut), len(x)))
    prior = _share(_above(telling.raw(halves[2]), cut), len(halves[2]), counts[:-1], counts[-1])
    network, _ = refine(_fit(p, u, prior), rows, prior)
    discard(rows)
    return network, prior


_NETWORKS: dict[str, Network] = {}


def _scorer(spark, network: Network):
    key, state = uuid.uuid4().hex, spark.sparkContext.broadcast(vars(network))  # a few thousand numbers

    def make():
        if key not in _NETWORKS:
            _NETWORKS.clear()
            _NETWORKS[key] = Network(**state.value)
        return lambda texts: [(float(s),) for s in _NETWORKS[key].score(np.array([features(t) for t in texts]))]

    return make


def score(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1; higher: good likelier) and predicted (1 from 0.5 on).

    Only the text counts. Null texts score as empty ones; null and repeated identifiers pass through.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = annotated(whole, "text", {"score": "double"}, _scorer(docs.sparkSession, network)).drop("text")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, network: Network, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least that."""
    found = annotated(docs, text_col, {"_quality_score": "double"}, _scorer(docs.sparkSession, network))
    return found.filter(F.col("_quality_score") >= least).drop("_quality_score")
