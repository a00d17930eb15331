"""Exact pairs of near vectors by a dual traversal of cover trees.

On unit vectors, cosine >= t means distance <= sqrt(2 - 2t). The upper level of the tree is a net of
centres, to the nearest of which every vector is assigned; each cell's covering radius is taken
over all its vectors. Cells are cut into blocks of bounded size, and each block gets a cover tree
of its own: nested levels with halving radii, written with the block. Pairs of cells whose centres
are further apart than their radii and the threshold allow are pruned; for the rest, pairs of
blocks are traversed together: a pair of nodes is pruned, or linked as a whole where even its
furthest vectors are near, or both nodes are opened.

Vectors without any structure (all far apart) cannot be pruned by any metric bound; then every
pair of blocks is opened once, which is a blocked matrix product.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, ship, stored
from .elias_fano import dump, load
from .graphs import components

#: Distinct vectors in a block, about; centres of the upper level at most; vectors they are picked from.
BLOCK, CENTRES, SAMPLE = 2048, 1024, 8192
#: Bounds hold up to rounding; pairs this close to the threshold are decided by their exact cosine.
SLACK = 1e-6
#: Products that are compared at a time: about what a core's cache holds.
PART = 1 << 18
#: Vectors up to which a node is opened to its vectors at once.
SMALL = 16


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length one; by the largest component first, so that nothing overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def centres_of(sample: np.ndarray, n: int) -> np.ndarray:
    """A net: each further centre is the vector furthest from those before."""
    if not len(sample):
        return sample
    picked, away = [0], distances(sample, sample[:1])[:, 0]
    while len(picked) < min(n, len(sample)) and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, distances(sample, sample[picked[-1:]])[:, 0])
    return sample[picked]


class CoverTree:
    """Nodes in order of levels; the children of a node, and the vectors under it, are contiguous.

    order: places of the vectors in tree order; arrays by node: centre (row in tree order), radius
    (the furthest vector under it), first and stop of its vectors, child and last of its children.
    """

    def __init__(self, points: np.ndarray, **arrays: np.ndarray):
        self.points = points
        self.single = points.astype(np.float32)
        self.opened: dict[int, list[np.ndarray]] = {}
        self.arrays = arrays
        self.centre, self.radius, self.first, self.stop, self.child, self.last = (arrays[k] for k in ("centre", "radius", "first", "stop", "child", "last"))
        own = np.flatnonzero(self.stop - self.first == 1)
        self.leaf = np.zeros(len(points), np.int64)  # the node of each vector on its own
        self.leaf[self.first[own]] = own

    @classmethod
    def build(cls, vectors: np.ndarray) -> tuple[CoverTree, np.ndarray]:
        n = len(vectors)
        # A node under construction: its vectors (centre first), the scale that they are within.
        level, order, nodes = [(np.arange(n), 2.0)] if n else [], np.arange(n), []
        spans = [0] * len(level)
        while level:
            below, below_spans = [], []
            for (own, scale), at in zip(level, spans, strict=True):
                away = distances(vectors[own], vectors[own[:1]])[:, 0]
                radius = float(away.max()) if len(own) > 1 else 0.0
                order[at : at + len(own)] = own
                nodes.append([at, radius, at, at + len(own), 0, 0])
                if len(own) == 1:
                    continue
                while scale / 2 >= radius and scale > 1e-9:
                    scale /= 2
                half, rest, groups = scale / 2, own, []
                while len(rest):
                    near = distances(vectors[rest], vectors[rest[:1]])[:, 0] <= half
                    near[0] = True
                    groups.append(rest[near])
                    rest = rest[~near]
                if len(groups) == 1:  # closer than halving can tell apart
                    groups = [own[i : i + 1] for i in range(len(own))]
                nodes[-1][4] = len(groups)
                for group in groups:
                    below.append((group, half))
                    below_spans.append(at)
                    at += len(group)
            level, spans = below, below_spans
        table = np.array(nodes, float).reshape(-1, 6)
        counts = table[:, 4].astype(np.int64)
        child = 1 + np.cumsum(counts) - counts
        whole = {k: table[:, i].astype(np.int64) for k, i in (("centre", 0), ("first", 2), ("stop", 3))}
        # A node's centre is its first vector: a vector's place changes only within its nodes.
        tree = cls(vectors[order], radius=table[:, 1].copy(), child=child, last=child + counts, **whole)
        return tree, order


def _kids(tree: CoverTree, node: int) -> list[np.ndarray]:
    """A node's children: single vectors, those of small children included, then wider nodes. So a few
    wide ones among many do not widen the bounds of all, and small ones are not opened one by one."""
    found = tree.opened.get(int(node))
    if found is None:
        kids = np.arange(tree.child[node], tree.last[node])
        size = tree.stop[kids] - tree.first[kids]
        small = kids[size <= SMALL]
        n = tree.stop[small] - tree.first[small]
        places = np.repeat(tree.first[small] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        found = tree.opened[int(node)] = [k for k in (tree.leaf[places], kids[size > SMALL]) if len(k)]
    return found


def _near(a: CoverTree, b: CoverTree, left: np.ndarray, right: np.ndarray, widest: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of nodes (places in left and right) whose centres are within ``widest``, and how far apart
    they are. Products are taken in parts that stay in the cache; in single precision first, with
    a margin for its error, where that leaves few candidates for double precision."""
    least = 1 - widest * widest / 2
    x, y = a.centre[left], b.centre[right]
    coarse = least > 0.3
    margin = max(2e-5, a.points.shape[1] * 4e-7) if coarse else 1e-12
    one, other = (a.single[x], b.single[y].T) if coarse else (a.points[x], b.points[y].T)
    step = max(1, PART // max(1, len(y)))
    found = []
    for first in range(0, len(x), step):
        dots = one[first : first + step] @ other
        i, j = np.divmod(np.flatnonzero(dots.ravel() >= least - margin), len(y))
        exact = np.einsum("ij,ij->i", a.points[x[first + i]], b.points[y[j]]) if coarse else dots[i, j]
        found.append((first + i, j, np.sqrt(np.maximum(2 - 2 * exact, 0))))
    rows, columns, away = (np.concatenate(part) for part in zip(*found, strict=True))
    return rows, columns, away


def dual(a: CoverTree, b: CoverTree, eps: float, same: bool) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of vectors (first and stop in a, first and stop in b) all of whose pairs are near beyond
    doubt, or single pairs that may be; where both are the same tree, each pair of vectors comes once,
    and a range with itself stands for all pairs within."""
    if not len(a.centre) or not len(b.centre):
        return
    todo = [(np.array([0]), np.array([0]), same)]
    while todo:
        left, right, own = todo.pop()
        widest = min(2.0, float(a.radius[left].max() + b.radius[right].max()) + eps + SLACK)
        rows, columns, away = _near(a, b, left, right, widest)
        if own:
            ahead = rows <= columns
            rows, columns, away = rows[ahead], columns[ahead], away[ahead]
        reach = a.radius[left][rows] + b.radius[right][columns]
        x, y = left[rows], right[columns]
        itself = (rows == columns) if own else np.zeros(len(rows), bool)
        alive = (away <= reach + (eps + SLACK)) & ~(itself & (a.stop[x] - a.first[x] == 1))
        # The furthest vectors of a node are up to twice its radius apart.
        one = (a.stop[x] - a.first[x] == 1) & (b.stop[y] - b.first[y] == 1)
        whole = alive & ((np.where(itself, reach, away + reach) <= eps - SLACK) | one)
        yield from zip(a.first[x[whole]].tolist(), a.stop[x[whole]].tolist(), b.first[y[whole]].tolist(), b.stop[y[whole]].tolist(), strict=True)
        open_ = alive & ~whole
        for node in x[open_ & itself]:
            kids = _kids(a, node)
            todo += [(one, other, m == k) for m, one in enumerate(kids) for k, other in enumerate(kids) if m <= k]
        # Of two nodes the wider one is opened, against all nodes that are left for it at once.
        # Of two that are equally wide, vectors of one direction for instance, it is the fuller one.
        fuller = a.stop[x] - a.first[x] >= b.stop[y] - b.first[y]
        wider = open_ & ~itself & ((a.radius[x] > b.radius[y]) | ((a.radius[x] == b.radius[y]) & fuller))
        for row in np.unique(rows[wider]):
            todo += [(kids, y[wider & (rows == row)], False) for kids in _kids(a, left[row])]
        wider = open_ & ~itself & ~wider
        for column in np.unique(columns[wider]):
            todo += [(x[wider & (columns == column)], kids, False) for kids in _kids(b, right[column])]


def links_between(a: CoverTree, b: CoverTree, raw_a, raw_b, weight_a, weight_b, threshold: float, same: bool):
    """Linked weight of each vector of a and of b by pairs between them, and pairs of places (i, j)
    that connect what these links connect."""
    eps = math.sqrt(2 - 2 * threshold)
    n_a, n_b = np.zeros(len(a.points), np.int64), np.zeros(len(b.points), np.int64)
    shift = 0 if same else len(a.points)
    root, edges = list(range(shift + len(b.points))), []

    def join(i: int, j: int) -> None:
        ends = []
        for k in (i, j + shift):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            ends.append(k)
        if ends[0] != ends[1]:
            root[ends[0]] = ends[1]
            edges.append((i, j))

    for f, s, g, t in dual(a, b, eps, same):
        if s - f == 1 and t - g == 1:
            away = float(distances(a.points[f : f + 1], b.points[g : g + 1])[0, 0])
            if away > eps + SLACK or (away > eps - SLACK and cosine(raw_a[f], raw_b[g]) < threshold):
                continue
        if same and (f, s) == (g, t):
            n_a[f:s] += weight_a[f:s].sum() - weight_a[f:s]
            for i in range(f + 1, s):
                join(f, i)
            continue
        n_a[f:s] += weight_b[g:t].sum()
        if same:
            n_a[g:t] += weight_a[f:s].sum()
        else:
            n_b[g:t] += weight_a[f:s].sum()
        for j in range(g, t):
            join(f, j)
        for i in range(f + 1, s):
            join(i, g)
    return n_a, n_b, edges


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    x, y = (v / np.abs(v).max() for v in (np.asarray(x, float), np.asarray(y, float)))
    return math.fsum(x * y) / math.sqrt(math.fsum(x * x) * math.fsum(y * y))


def _write(folder: str, data: bytes) -> str:
    store, inner = fs.FileSystem.from_uri(folder)
    store.create_dir(inner, recursive=True)
    name = uuid.uuid4().hex
    with store.open_output_stream(f"{inner}/_{name}") as out:
        out.write(data)
    store.move(f"{inner}/_{name}", f"{inner}/{name}.block")
    return f"{folder}/{name}.block"


class _Block:
    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as source:
            _, arrays, meta = load(np.frombuffer(source.read(), np.uint8))
        self.ids, self.weight = arrays["ids"], arrays["weight"]
        self.raw = arrays["raw"].reshape(len(self.ids), meta["dim"])
        self.tree = CoverTree(unit(self.raw) if len(self.raw) else self.raw, **{k: arrays[k] for k in ("centre", "radius", "first", "stop", "child", "last")})


def neighbours(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Per row: vec_id, n_links, component_id (smallest vec_id that links reach) and kept.

    All rows are compared by cosine in double precision; pairs at or above the threshold link. Rows
    whose vector is null, empty, zero, or holds null or non-finite components link with nothing, and
    neither do vectors of different lengths; such a row, like any without links, is its own
    component. Repeated rows and exact copies are linked rows like others. Rows with a null
    identifier take part; they name a component only if all of it is null. Exact copies
    are merged first, so a group of them costs one vector. The sample for the centres steers speed
    only. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists("v", lambda x: x != 0)
    rows = stored(rows.withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    merged = rows.filter("good").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(merged.withColumn("cid", F.monotonically_increasing_id()), "classes")
    dims = [r.d for r in classes.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]  # one number for each length
    found = [_links(classes.filter(F.size("v") == d), d, threshold, block) for d in dims]
    counts = [c for c, _ in found] or [spark.createDataFrame([], "cid long, links long")]
    edges = [e for _, e in found] or [spark.createDataFrame([], "a long, b long")]
    for more in range(1, len(found)):
        counts[0], edges[0] = counts[0].unionByName(counts[more]), edges[0].unionByName(edges[more])
    total = counts[0].groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(edges[0]).withColumnRenamed("node", "cid")
    named = stored(classes.join(total, "cid", "left").join(roots, "cid", "left").select("v", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")), "named")
    names = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    whole = stored(named.join(names, "root").select("v", "n", "links", "component_id"), "linked")
    linked = rows.filter("good").join(whole, "v").select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    alone = rows.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, dim: int, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Linked weights (cid, links) and connecting pairs (a, b) among distinct vectors of one length."""
    spark, eps = classes.sparkSession, math.sqrt(2 - 2 * threshold)
    n = classes.count()
    sample = classes.select("cid", "v").orderBy(F.xxhash64("cid")).limit(SAMPLE).select("v").toArrow()["v"]
    sample = unit(np.array(sample.combine_chunks().flatten(), float).reshape(-1, dim))
    centres = centres_of(sample, min(CENTRES, -(-n // block)))
    sent = spark.sparkContext.broadcast(centres)  # at most CENTRES vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = unit(np.array(batch.column("v").flatten(), float).reshape(-1, dim)) if batch.num_rows else np.zeros((0, dim))
            away = distances(own, sent.value)
            cell = away.argmin(axis=1) if len(own) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("n"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(own)), cell])], names=["cid", "n", "v", "cell", "away"])

    placed = stored(classes.select("cid", "n", "v").mapInArrow(assign, "cid long, n long, v array<double>, cell int, away double"), "cells")
    cells = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("size")).orderBy("cell").collect()  # at most CENTRES rows
    chunks = {c.cell: -(-c.size // block) for c in cells}
    many = F.element_at(F.create_map(*(F.lit(x) for c, k in chunks.items() for x in (c, k))), F.col("cell"))
    keyed = placed.withColumn("chunk", F.pmod(F.xxhash64("cid"), many).cast("int"))
    folder = new_folder(spark, "blocks")
    n_blocks = sum(chunks.values())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out() -> pa.RecordBatch:
            raw = np.array([x[2] for x in held], float).reshape(-1, dim)
            tree, order = CoverTree.build(unit(raw))
            arrays = tree.arrays | {"raw": raw[order].ravel(), "ids": np.array([held[i][0] for i in order]), "weight": np.array([held[i][1] for i in order])}
            path = _write(folder, dump({}, arrays, {"dim": dim}))
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([path])], names=["cell", "chunk", "path"])

        for batch in batches:
            for cid, weight, v, cell, chunk in zip(*(batch.column(c).to_pylist() for c in ("cid", "n", "v", "cell", "chunk")), strict=True):
                if (cell, chunk) != now:
                    if held:
                        yield out()
                    now, held = (cell, chunk), []
                held.append((cid, weight, v))
        if held:
            yield out()

    dealt = keyed.select("cid", "n", "v", "cell", "chunk").repartition(max(1, n_blocks), "cell", "chunk").sortWithinPartitions("cell", "chunk", "cid")
    blocks = stored(dealt.mapInArrow(write, "cell int, chunk int, path string"), "block-paths")
    # The upper level of the dual traversal: pairs of cells that may hold a near pair.
    radius = np.array([c.radius for c in cells])
    apart = distances(centres[[c.cell for c in cells]], centres[[c.cell for c in cells]])
    i, j = np.nonzero(np.triu(apart <= radius[:, None] + radius[None, :] + eps + SLACK))
    ids = np.array([c.cell for c in cells])
    pairs = spark.createDataFrame(pa.table({"cell": pa.array(ids[i], pa.int32()), "other": pa.array(ids[j], pa.int32())}))
    left = blocks.select("cell", F.col("chunk").alias("k"), F.col("path").alias("left"))
    right = blocks.select(F.col("cell").alias("other"), F.col("chunk").alias("l"), F.col("path").alias("right"))
    met = pairs.join(left, "cell").join(right, "other").filter("cell < other or k <= l").select("left", "right")
    met = stored(met, "block-pairs")
    work = met.repartitionByRange(max(1, min(10_000, -(-met.count() // 8))), "left", "right").sortWithinPartitions("left", "right")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Block] = {}

        def take(path: str) -> _Block:
            if path not in open_:
                if len(open_) >= 16:
                    open_.pop(next(iter(open_)))
                open_[path] = _Block(path)
            return open_[path]

        for batch in batches:
            for a_path, b_path in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist(), strict=True):
                a, b = take(a_path), take(b_path)
                n_a, n_b, edges = links_between(a.tree, b.tree, a.raw, b.raw, a.weight, b.weight, threshold, a_path == b_path)
                ids = np.concatenate([a.ids[n_a > 0], b.ids[n_b > 0]])
                links = np.concatenate([n_a[n_a > 0], n_b[n_b > 0]])
                pad = [None] * len(ids)
                columns = [
                    pa.array([*ids.tolist(), *[None] * len(edges)], pa.int64()),
                    pa.array([*links.tolist(), *[None] * len(edges)], pa.int64()),
                    pa.array(pad + [int(a.ids[x]) for x, _ in edges], pa.int64()),
                    pa.array(pad + [int(b.ids[y]) for _, y in edges], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["cid", "links", "a", "b"])

    out = stored(work.mapInArrow(compare, "cid long, links long, a long, b long"), "links")
    return out.filter("cid is not null").select("cid", "links"), out.filter("a is not null").select("a", "b")


#: Every pair in double precision, and what links reach by a recursive query.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id = c.c AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
