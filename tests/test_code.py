"""Code graph, version control, paged service and store: brute force on small inputs, and edges."""

import random
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kbspark.operators import components, extract, flows, graph, incremental
from kbspark.sources import paged, store, versioned


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string")


# -- flows

def kept_flows(rows, entries=None):
    """The same frontier, by plain loops."""
    steps = {}
    for a, b in rows:
        if a is not None and b is not None and a != b:
            steps.setdefault(a, set()).add(b)
    entries = sorted(set(steps) - {b for v in steps.values() for b in v}) if entries is None else entries
    best = {}
    for e in entries:
        frontier = {e: [e]}
        while frontier:
            grown = {}
            for at, path in frontier.items():
                more = [b for b in steps.get(at, ()) if b not in path]
                if not more and len(path) > 1:
                    best[e, at] = path  # longer ones come later
                for b in more:
                    grown[b] = min(grown.get(b, [*path, b]), [*path, b])
            frontier = grown
    return best


def test_flows(spark):
    rng = random.Random(5)
    for rows in ([(f"v{rng.randrange(9)}", f"v{rng.randrange(9)}") for _ in range(14)] + [("a", "v1"), ("b", "v2"), ("b", "v2"), (None, "x"), ("c", None)], [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("c", "b"), ("b", "d")]):
        got = {(r.entry, r.end): r.path for r in flows.flows(edges_of(spark, rows)).collect()}
        assert got == kept_flows(rows)
    assert flows.flows(edges_of(spark, [("a", "b"), ("b", "a")])).count() == 0  # a plain ring has no entry point
    ring = flows.flows(edges_of(spark, [("a", "b"), ("b", "c"), ("c", "a")]), spark.createDataFrame([("a",), (None,)], "symbol string"))
    assert [(r.flow, r.path) for r in ring.collect()] == [("a > c", ["a", "b", "c"])]
    assert [r.path for r in flows.flows(edges_of(spark, [("a", "b"), ("b", "c")]), depth=1).collect()] == [["a", "b"]]
    assert flows.flows(edges_of(spark, []), None).count() == 0
    steps = flows.flow_steps(flows.flows(edges_of(spark, [("a", "b"), ("b", "c")])))
    assert [tuple(r) for r in steps.orderBy("place").collect()] == [("a > c", 0, "a"), ("a > c", 1, "b"), ("a > c", 2, "c")]


def test_flows_from_ends(spark, monkeypatch):
    """Without a cycle, chains are found from the fewer ends; with one, or with as many ends, from the entry points."""
    rng = random.Random(7)
    layers = [("e", "a", 12, 4), ("a", "b", 4, 4), ("b", "z", 4, 2), ("e", "z", 12, 2), ("a", "z", 4, 2)]
    rows = [(f"{p}{rng.randrange(n)}", f"{q}{rng.randrange(m)}") for p, q, n, m in layers for _ in range(9)] + [(f"e{i}", "a0") for i in range(12)]
    ways, own = [], flows._from_ends
    monkeypatch.setattr(flows, "_from_ends", lambda steps: ways.append(out := own(steps)) or out)
    for more in ([], [("b0", "a0"), ("a0", "b0")], [("a1", "r1"), ("r1", "r2"), ("r2", "r1")]):
        got = {(r.entry, r.end): r.path for r in flows.flows(edges_of(spark, rows + more)).collect()}
        assert got == kept_flows(rows + more)
    assert [w is not None for w in ways] == [True, False, False]


# -- components

def reached(rows):
    steps = {}
    for a, b in rows:
        if a is not None and b is not None and a != b:
            steps.setdefault(a, set()).add(b)
            steps.setdefault(b, set())
    out = {}
    for a in steps:
        seen, todo = set(), [a]
        while todo:
            for y in steps[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[a] = seen
    return out


def test_components_and_cycles(spark):
    rng = random.Random(4)
    rows = [(f"v{rng.randrange(14):02d}", f"v{rng.randrange(14):02d}") for _ in range(18)]
    rows += [("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("p", "q"), ("q", "p"), ("q", "s"), ("s", "t"), ("t", "q"), ("x", "x"), (None, "x"), ("p", "r1"), ("h1", "h2"), ("h2", "h1")]
    far = reached(rows)
    want = {a: min(b for b in far if b in far[a] and a in far[b]) for a in far if a in far[a]}
    assert {r.symbol: r.component for r in components.strong_components(edges_of(spark, rows)).collect()} == want
    lengths = {r.module: r.length for r in graph.module_cycles(edges_of(spark, rows)).collect()}
    assert set(lengths) == set(want) and lengths["r1"] == 3 and lengths["p"] == 2 and lengths["s"] == 3
    assert {r.module for r in graph.module_cycles(edges_of(spark, rows), depth=2).collect()} == {m for m, n in lengths.items() if n == 2}
    assert components.strong_components(edges_of(spark, [])).count() == 0


def test_a_long_chain_is_bypassed(spark):
    chain = spark.range(100_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert components.strong_components(chain).isEmpty()


# -- version control

DIFF = """From: someone
diff --git a/src/A.java b/src/A.java
index 1..2 100644
--- a/src/A.java
+++ b/src/A.java
@@ -1,4 +1,5 @@ class A
 a
--- looks like a header
+++ me too
+new
 b

@@ -10 +11,0 @@
-gone
\\ No newline at end of file
diff --git a/old name.txt b/new name.txt
similarity index 100%
rename from old name.txt
rename to new name.txt
diff --git "a/\\303\\244.txt" "b/\\303\\244.txt"
new file mode 100644
--- /dev/null
+++ "b/\\303\\244.txt"
@@ -0,0 +1,2 @@
+x
+y
diff --git a/z.bin b/z.bin
Binary files a/z.bin and b/z.bin differ
diff --git a/gone b.txt b/gone b.txt
deleted file mode 100644
--- a/gone b.txt
+++ /dev/null
@@ -1 +0,0 @@
-bye
--- a/plain.c\t2024
+++ b/plain.c\t2024
@@ -3 +3 @@
-1
+2
"""


def test_diff(spark):
    texts = spark.createDataFrame([(1, DIFF), (2, None), (3, ""), (4, "no diff\n@@ nor this")], "commit_no int, content string")
    files = {(r.path, r.old_path, r.status) for r in versioned.changed_files(texts).collect()}
    assert files == {("src/A.java", "src/A.java", "modified"), ("new name.txt", "old name.txt", "renamed"), ("ä.txt", None, "added"), ("z.bin", "z.bin", "binary"), ("gone b.txt", "gone b.txt", "deleted"), ("plain.c", "plain.c", "modified")}
    new = sorted((r.path, r.line) for r in versioned.changes(texts).collect())
    assert new == [("plain.c", 3), ("src/A.java", 2), ("src/A.java", 3), ("ä.txt", 1), ("ä.txt", 2)]
    old = sorted((r.path, r.line) for r in versioned.changes(texts, side="old").collect())
    assert old == [("gone b.txt", 1), ("plain.c", 3), ("src/A.java", 2), ("src/A.java", 10)]
    kept = [(r.old_line, r.new_line, r.text) for r in versioned.diff_lines(texts).filter("kind = ' '").collect()]
    assert kept == [(1, 1, "a"), (3, 4, "b"), (4, 5, "")]
    with pytest.raises(ValueError):
        versioned.diff_lines(texts.withColumn("Path", F.lit(1)))


def test_diff_reads_what_is_asked(spark):
    texts = spark.createDataFrame([(1, DIFF), (2, "diff --git \n"), (3, None)], "commit_no int, content string")
    both = sorted((r.path, r.side, r.line) for r in versioned.changes(texts, side="both").collect())
    each = sorted((r.path, s, r.line) for s in ("new", "old") for r in versioned.changes(texts, side=s).collect())
    assert both == each and len(both) == 9
    wanted = [x for x in versioned.read_diff(DIFF) if x[4] in "+-"]
    assert sorted(versioned.read_changes(DIFF)) == sorted((x[2], "new", x[6]) if x[4] == "+" else (x[1], "old", x[5]) for x in wanted)


def test_short_diffs_share_record_batches(spark, monkeypatch):
    import pyarrow as pa

    taken = {}
    texts = spark.createDataFrame([(i, DIFF) for i in range(3)], "commit_no int, content string")
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, run, schema: taken.setdefault("run", run))
    versioned.diff_lines(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array([DIFF] * 500)], names=["commit_no", "content"])
    made = list(taken["run"](iter([batch])))
    assert len(made) == 1 and made[0].num_rows == 500 * len(list(versioned.read_diff(DIFF)))
    monkeypatch.setattr(versioned, "BATCH", 1000)
    small = list(taken["run"](iter([batch])))
    assert max(x.num_rows for x in small) == 1000 and pa.Table.from_batches(small).equals(pa.Table.from_batches(made).combine_chunks())


def test_diff_takes_time_in_proportion():
    took = []
    for n in (25_000, 100_000):
        text = f"--- a/f\n+++ b/f\n@@ -1,{n} +1,{n} @@\n" + "-a\n+b\n" * n
        began = time.process_time()
        assert sum(1 for r in versioned.read_diff(text) if r[4] == "+") == n
        took.append(time.process_time() - began)
    assert took[1] < 10 * max(took[0], 0.02)


def test_blame(spark):
    a, b = "a" * 40, "b" * 40
    text = f"{a} 1 1 2\nauthor Ann Lee\nauthor-mail <a@x>\nauthor-time 12\nsummary {b} 1 1\nboundary\nfilename f.c\n\tauthor Not This\n{a} 2 2\n\t\n{b} 7 3 1\nauthor Bob\nauthor-time x\n\tlast\n"
    rows = versioned.blame_lines(spark.createDataFrame([("f.c", text), ("g.c", None), ("h.c", "fatal: no such path")], "path string, content string")).collect()
    assert [(r.path, r.line, r.source_line, r.author, r.author_time, r.text) for r in rows] == [("f.c", 1, 1, "Ann Lee", 12, "author Not This"), ("f.c", 2, 2, "Ann Lee", 12, ""), ("f.c", 3, 7, "Bob", None, "last")]


def test_changed_symbols_by_bins(spark):
    rng = random.Random(6)
    changes = [("f" if i % 3 else None, rng.randrange(1, 400) if i % 7 else None) for i in range(300)]
    spans = [("f", f"m{i}", (lo := rng.randrange(1, 380)), lo + rng.choice([0, 3, 63, 64, 300])) for i in range(40)] + [("f", "none", None, 3), (None, "x", 1, 400)]
    got = graph.changed_symbols(spark.createDataFrame(changes, "path string, line int"), spark.createDataFrame(spans, "path string, symbol string, line_start int, line_end int"))
    want = {s: n for p, s, lo, hi in spans if p and lo and (n := sum(q == p and line is not None and lo <= line <= hi for q, line in changes))}
    assert {r.symbol: r.changed_lines for r in got.collect()} == want
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()  # no side is sent whole, however small it seems


# -- a paged service

def service(folder, fail=(), grow=0, short=0):
    """Rows 0 to 129 and ``grow`` that arrive after the count; pages in ``fail`` fail once; no answer has more
    than ``short`` rows, if given."""
    root = Path(str(folder))

    def count():
        return 130

    def fetch(skip, limit):
        with (root / "asked").open("a") as out:
            out.write(f"{skip} {limit}\n")
        if skip in fail and not (root / f"failed-{skip}").exists():
            (root / f"failed-{skip}").touch()
            raise OSError("no answer")
        return [(str(i), "/r", "GET", "f", "") for i in range(skip, min(skip + limit, 130 + grow))][: short or None]

    return paged.paged_source(f"s{abs(hash(str(folder)))}", paged.ROUTES, count, fetch, wait=0.01)


@pytest.mark.parametrize("how", [{}, {"fail": (50,)}, {"grow": 75}, {"short": 20}, {"fail": (0, 100), "grow": 3, "short": 7}])
def test_pages(spark, tmp_path, how):
    found = paged.paged(spark, service(tmp_path, **how))
    assert found.rdd.getNumPartitions() == 3
    assert sorted(int(r.id) for r in found.collect()) == list(range(130 + how.get("grow", 0)))
    for skip in how.get("fail", ()):
        assert (tmp_path / f"failed-{skip}").exists()
    if how == {"fail": (50,)}:  # only that page was asked for twice
        asked = [x.split()[0] for x in (tmp_path / "asked").read_text().splitlines()]
        assert asked.count("50") == 2 and asked.count("0") == 1


def test_pages_that_never_come(spark, tmp_path):
    source = paged.paged_source("gone", paged.ROUTES, lambda: 10, lambda skip, limit: 1 / 0, attempts=2, wait=0.01)
    with pytest.raises(Exception, match="division"):
        paged.paged(spark, source).collect()
    empty = paged.paged_source("empty", paged.ROUTES, lambda: 0, lambda skip, limit: [])
    assert paged.paged(spark, empty).count() == 0
    assert paged.paged(spark, paged.route_source("none", lambda text: None)).count() == 0
    with pytest.raises(ValueError):
        paged.paged_source("x", paged.ROUTES, int, list, page=0)


# -- the store

SCHEMA = "path string, n int, text string"


def test_store_filters(spark, tmp_path):
    """Each file's filter holds its keys and few others, and no lambda copies a filter to each key that meets it."""
    own = store.Store(spark, f"file://{tmp_path}/s", "path long, content string", buckets=2)
    own.upsert(spark.range(3000).select(F.col("id").alias("path"), F.lit("x").alias("content")))
    pairs = spark.range(6000).select(F.concat(F.lit("="), "id").alias("k"), "id").crossJoin(own.manifest().select("file", "bits"))
    met = pairs.filter(store._has(F.col("bits"), F.col("k")))
    assert "lambda" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert met.filter("id < 3000").select("id").distinct().count() == 3000 and met.filter("id >= 3000").count() < 300


def test_store_rewrites_only_what_holds_the_keys(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/t", SCHEMA, buckets=8, file_rows=40)
    rows = spark.range(1200).select(F.concat(F.lit("f"), "id").alias("path"), F.col("id").cast("int").alias("n"), F.lit("x").alias("text"))
    own.upsert(rows)
    files = own.manifest().count()
    assert files >= 30 and own.read().count() == 1200
    made = own.upsert(spark.createDataFrame([("f7", 1, "new"), ("f9", 1, "a"), ("f9", 2, "b"), (None, 0, "null")], SCHEMA), spark.createDataFrame([("f11",), ("absent",)], "path string"))
    assert made["rewritten"] <= 4 and made["written"] <= 4 * 40 + 4
    got = {(r.path, r.n, r.text) for r in own.read().filter("text != 'x'").collect()}
    assert got == {("f7", 1, "new"), ("f9", 1, "a"), ("f9", 2, "b"), (None, 0, "null")}
    assert own.read().filter("path in ('f7', 'f9', 'f11')").count() == 3 and own.read().count() == 1201
    own.upsert(spark.createDataFrame([(None, 1, "again")], SCHEMA))
    assert [r.text for r in own.read().filter("path is null").collect()] == ["again"]
    for n in range(2):
        own.upsert(spark.range(40).select(F.concat(F.lit(f"more{n}-"), "id").alias("path"), F.lit(n).alias("n"), F.lit("x").alias("text")))
    files = own.manifest().count()
    made = own.compact()
    assert own.read().count() == 1281 and made["rewritten"] > 1 and own.manifest().count() < files
    assert own.manifest().filter("rows < 20").groupBy("bucket").count().filter("count > 1").count() == 0
    (tmp_path / "t" / "data-unfinished").mkdir()  # a writer that died
    assert own.read().count() == 1281
    own.vacuum()
    assert own.read().count() == 1281 and not (tmp_path / "t" / "data-unfinished").exists()
    own.upsert(spark.createDataFrame([], SCHEMA))
    assert own.read().count() == 1281
    own.rewrite(lambda df: df.filter("n < 0"))
    assert own.read().count() == 0 and own.read().columns == ["path", "n", "text"]


def test_two_writers_both_survive(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    states = [incremental.State(spark, folder) for _ in range(3)]
    threads = [threading.Thread(target=s.add_module, args=(f"m{i}", f"kb/m{i}")) for i, s in enumerate(states)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.module for r in states[0].read().collect()) == ["m0", "m1", "m2"]


def test_a_number_is_given_once(spark, tmp_path):
    own = store.Store(spark, f"file://{tmp_path}/t", SCHEMA)
    assert own._commit(1, own.manifest()) and not own._commit(1, own.manifest())
    assert not list((tmp_path / "t" / "manifest").glob("_*"))


def test_controller_methods_sort_bodies_once(spark):
    files = spark.createDataFrame([("A.java", 'public class A {\n  @GetMapping("/a")\n  public R load(int a) {\n    return 1;\n  }\n  private R load(int b) {\n    return 2;\n  }\n  @GetMapping("/c")\n  @PostMapping("/d")\n  public R load(int c) {\n    return 3;\n  }\n}\n')], "path string, content string")
    found = extract.controller_methods(files)
    assert sorted((r.endpoint, "return 1" in r.body, "return 3" in r.body) for r in found.collect()) == [("/a", True, False), ("/d", False, True)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" +-:").startswith("Window") for line in plan.splitlines()) == 1
