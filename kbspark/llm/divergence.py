"""Divergence of sources: how far the term frequencies of a (language, source) group are from those of
the language's other sources, and by which terms it stands out of its language.

For each pair of groups a sum runs over all terms of the language, also those that neither has. It is
split by how many groups have a term. Heavy terms, which many groups have, are put into dense tiles
(a block of terms by a block of groups), and all pairs of a tile are summed by numpy. Of light terms,
most groups have none, and a term's share of a group depends on its count alone. So their sum is first
taken as if no two groups had a term in common, from how many light terms a group has at each count;
then each term's posting list corrects the few pairs that do share it. All arithmetic is on integers, so
the parts add up exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ship, slices, small_side, stored
from .words import encoded, found, letters

SCALE = 1_000_000_000
#: A term is kept if so many documents of the language have it.
LEAST_DOCS = 3
#: Groups that a light term has at most; terms and groups of a tile (about); ranks of terms.
LIGHT, TILE_TERMS, TILE_GROUPS, TOP = 4, 512, 256, 200
#: Entries that a task adds up before it passes them on.
FLUSH = 300_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, added up as far as a task's memory allows."""
    of, held = letters(digits=False), {}

    def out():
        for (lang, source), counts in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(counts)), pa.array([source] * len(counts)), pa.array(list(counts), pa.binary()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        held.clear()

    for batch in batches:
        for part in slices(batch, "text"):
            keys = list(zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True))
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            data, first, start, stop = found(part.column("text"), of)
            if not len(start):
                continue
            at, words = encoded(data, start, stop)
            row = np.searchsorted(first, start, "right") - 1
            each, n = np.unique(row * len(words) + at, return_counts=True)  # a document and a term
            group = np.array([number[k] for k in keys])[each // len(words)] * len(words) + each % len(words)
            both, place = np.unique(group, return_inverse=True)
            total, docs = np.bincount(place, weights=n).astype(np.int64), np.bincount(place)
            names = list(number)
            for g in range(len(names)):
                a, b = np.searchsorted(both, [g * len(words), (g + 1) * len(words)])
                counts = held.setdefault(names[g], {})
                for w, x, y in zip((both[a:b] % len(words)).tolist(), total[a:b].tolist(), docs[a:b].tolist(), strict=True):
                    old = counts.get(words[w])
                    counts[words[w]] = (x, y) if old is None else (old[0] + x, old[1] + y)
            if sum(map(len, held.values())) > FLUSH:
                yield from out()
    yield from out()


def share(n, total, distinct):
    """p of a count n in a group of ``total`` occurrences, of ``distinct`` terms; for numpy arrays and numbers."""
    return 1 + SCALE * (n + 1) // (total + distinct)


def apart(p, q):
    """(p - q)^2 / q, rounded down."""
    return (p - q) * (p - q) // q


def _tile(_, rows):
    """Sums over a block of terms for all pairs of a group of one block and one of another."""
    lang, distinct = rows["lang"][0].as_py(), rows["v"][0].as_py()
    left, kind, source, item, n, total = (rows[c].to_numpy(zero_copy_only=False) for c in ("left", "kind", "source", "item", "n", "total"))

    def side(own: np.ndarray):
        names, first = np.unique(source[own & (kind == "group")].astype(str), return_index=True)
        sums = total[own & (kind == "group")][first]
        entry = own & (kind != "group")
        return names, sums, np.searchsorted(names, source[entry].astype(str)), entry

    (a, sum_a, at_a, in_a), (b, sum_b, at_b, in_b) = side(left), side(~left)
    base_a, base_b = share(0, sum_a, distinct), share(0, sum_b, distinct)
    out = np.zeros((len(a), len(b)), np.int64)
    if rows["part"][0].as_py() >= 0:
        terms, place = np.unique(np.concatenate([item[in_a], item[in_b]]), return_inverse=True)
        p, q = np.repeat(base_a[:, None], len(terms), 1), np.repeat(base_b[:, None], len(terms), 1)
        p[at_a, place[: len(at_a)]] = share(n[in_a], sum_a[at_a], distinct)
        q[at_b, place[len(at_a) :]] = share(n[in_b], sum_b[at_b], distinct)
        for i in range(len(a)):
            for j in range(0, len(b), 32):
                out[i, j : j + 32] = apart(p[i], q[j : j + 32]).sum(axis=1)
    else:  # light terms as if no two groups shared one; item is how many terms a group has at count n
        none = apart(base_a[:, None], base_b[None, :])
        out += int(rows["light"][0].as_py()) * none
        many_a, many_b = item[in_a].astype(np.int64), item[in_b].astype(np.int64)
        mine, theirs = share(n[in_a], sum_a[at_a], distinct), share(n[in_b], sum_b[at_b], distinct)
        for i in range(len(a)):
            own = at_a == i
            if own.any():
                out[i] += (many_a[own, None] * (apart(mine[own, None], base_b[None, :]) - none[i])).sum(axis=0)
        for j in range(len(b)):
            own = at_b == j
            if own.any():
                out[:, j] += (many_b[own, None] * (apart(base_a[None, :], theirs[own, None]) - none[:, j])).sum(axis=0)
    i, j = np.nonzero(a[:, None] != b[None, :])
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": pa.array(a[i].tolist(), pa.string()), "other": pa.array(b[j].tolist(), pa.string()), "value": pa.array(out[i, j], pa.int64())})


def _corrections(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of light postings, those of a term one after the other, ``most`` of a term at most: for each pair of groups that shares terms, by
    how much the sum that took them for unshared is wrong."""
    sums: dict[tuple, int] = {}
    names = ["lang", "term", "source", "n", "total", "v"]

    def add(own: pa.Table) -> None:
        lang, term, source = (own[c].combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        n, total, v = (own[c].to_numpy() for c in ("n", "total", "v"))
        run = np.cumsum(np.concatenate([[0], (np.diff(lang.indices.to_numpy()) != 0) | (np.diff(term.indices.to_numpy()) != 0)]))
        p, base = share(n, total, v), share(0, total, v)
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        group = lang.indices.to_numpy().astype(np.int64) * len(sources) + source.indices.to_numpy()
        for d in range(1, most):
            i = np.flatnonzero(run[d:] == run[:-d]) if len(run) > d else np.zeros(0, np.int64)
            for x, y in ((i, i + d), (i + d, i)):
                value = apart(p[x], p[y]) - apart(p[x], base[y]) - apart(base[x], p[y]) + apart(base[x], base[y])
                keys, place = np.unique(np.stack([group[x], group[y]]), axis=1, return_inverse=True)
                total_ = np.zeros(keys.shape[1], np.int64)
                np.add.at(total_, place.ravel(), value)
                for (g, h), s in zip(keys.T.tolist(), total_.tolist(), strict=True):
                    k = (langs[g // len(sources)], sources[g % len(sources)], sources[h % len(sources)])
                    sums[k] = sums.get(k, 0) + s

    def out() -> pa.RecordBatch:
        rows = [(*k, s) for k, s in sums.items()]
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64() if c == 3 else pa.string()) for c in range(4)], names=["lang", "source", "other", "value"])

    rest = None
    for batch in batches:
        own = pa.Table.from_batches([batch.select(names)])
        own = own if rest is None else pa.concat_tables([rest, own])
        # The last term may go on in the next batch.
        cut = len(own) - 1
        while cut and own["term"][cut - 1] == own["term"][-1] and own["lang"][cut - 1] == own["lang"][-1]:
            cut -= 1
        rest = own.slice(cut)
        if cut:
            add(own.slice(0, cut))
        if len(sums) > FLUSH:
            yield out()
    if rest is not None and len(rest):
        add(rest)
    if sums:
        yield out()


def audit(docs: DataFrame, top: int = TOP, light: int = LIGHT, tile_terms: int = TILE_TERMS, tile_groups: int = TILE_GROUPS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per group and other source of its language (part ``pair``), and per group and term that it has more often
    than its language (part ``term``, the ``top`` greatest): lang, source, part, item, value, rank.

    Null texts, languages and sources count as empty ones. A group without terms has the share of count 0 for
    each kept term; where no term is kept, pairs have the value 0. A language with one source has no pairs. An
    empty table has no rows. The result has a row for each pair of sources of a language, as it must; apart from
    that nothing is emitted for pairs but sums of blocks.
    """
    ship(docs.sparkSession)
    whole = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    counts = whole.mapInArrow(_count, "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    seen = counts.withColumns({"in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "groups": F.count("*").over(term), "first": F.min("source").over(term)}).filter(F.col("in_docs") >= LEAST_DOCS)
    kept = stored(seen.select("lang", "source", "term", "n", "lang_n", "groups", (F.col("source") == F.col("first")).alias("first")), "terms")
    new = F.when(F.col("first"), 1)
    langs = kept.groupBy("lang").agg(F.count(new).alias("v"), F.sum("n").alias("lang_total"), F.count(F.when(F.col("first") & (F.col("groups") <= light), 1)).alias("light"), F.count(F.when(F.col("first") & (F.col("groups") > light), 1)).alias("heavy"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = whole.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.na.fill(0, ["total", "v", "light", "heavy", "lang_total"]), "groups")
    full = kept.join(small_side(groups), ["lang", "source"])

    p, q = _share("n", "total"), _share("lang_n", "lang_total")
    term_rows = full.select("lang", "source", F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q")).filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div q")).drop("p", "q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = term_rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).withColumn("part", F.lit("term"))

    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    n_blocks = max(1, -(-most // tile_groups))
    block = F.pmod(F.xxhash64("source"), F.lit(n_blocks)).cast("int")
    n_parts = F.ceil(F.col("heavy") / tile_terms)
    fields = ["lang", "source", "v", "light", "total", "kind", "item", "n", "part"]
    is_group = groups.withColumns({"kind": F.lit("group"), "item": F.lit(b""), "n": F.lit(0).cast("long"), "part": F.explode(F.sequence(F.lit(-1).cast("long"), F.greatest(F.lit(0), n_parts).cast("long") - 1))})
    heavy = full.filter(F.col("groups") > light).withColumns({"kind": F.lit("entry"), "item": F.col("term"), "part": F.pmod(F.xxhash64("term"), n_parts.cast("long"))})
    at_count = full.filter(F.col("groups") <= light).groupBy("lang", "source", "n", "v", "light", "total").agg(F.count("*").alias("many"))
    at_count = at_count.withColumns({"kind": F.lit("entry"), "item": F.col("many").cast("string").cast("binary"), "part": F.lit(-1).cast("long")})
    entries = is_group.select(fields).unionByName(heavy.select(fields)).unionByName(at_count.select(fields)).withColumn("own", block)
    sides = entries.withColumn("left", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("against", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    sides = sides.withColumns({"a": F.when(F.col("left"), F.col("own")).otherwise(F.col("against")), "b": F.when(F.col("left"), F.col("against")).otherwise(F.col("own"))})
    tiles = sides.groupBy("lang", "part", "a", "b").applyInArrow(_tile, "lang string, source string, other string, value long")
    shared = full.filter((F.col("groups") <= light) & (F.col("groups") > 1)).select("lang", "term", "source", "n", "total", "v")
    corrected = shared.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(lambda batches: _corrections(batches, light), "lang string, source string, other string, value long")
    pairs = tiles.unionByName(corrected).groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pairs.withColumns({"rank": F.row_number().over(best), "part": F.lit("pair")})
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(names).unionByName(terms.select(names))


def _share(n: str, total: str):
    return F.expr(f"1 + {SCALE}L * ({n} + 1) div ({total} + v)")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS raw FROM documents),
w AS (SELECT r, lang, source, translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM (SELECT r, lang, source, unnest(raw) AS u FROM d)),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
tl AS (SELECT lang, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000 * (coalesce(c.n, 0) + 1)::BIGINT // (coalesce(t.total, 0) + v.v)::BIGINT)::BIGINT AS p
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT cl.lang, cl.term, (1 + 1000000000 * (cl.n + 1)::BIGINT // (tl.total + v.v)::BIGINT)::BIGINT AS q FROM cl JOIN tl ON tl.lang = cl.lang JOIN v ON v.lang = cl.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
