"""Names in texts, scopes, best matches, hierarchies, configuration and requirements: brute force and edges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from kbspark.operators import evaluate, extract, graph, hierarchy, merge, names, render, requirements, scopes
from kbspark.sources import indented


# -- names in texts

@pytest.mark.parametrize("shard_bytes", [1 << 20, 200])
def test_names_in_texts(spark, shard_bytes):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé") for _ in range(rng.randrange(n)))
    own = [(rng.choice([1, 2, None]), rng.choice([word(4), word(4), None])) for _ in range(80)] + [(1, "aba"), (1, "aba"), (2, "bab")]
    texts = [(rng.choice([1, 2, 3, None]), rng.choice([word(30), None])) for _ in range(40)]
    n, t = spark.createDataFrame(own, "module int, name string"), spark.createDataFrame(texts, "module int, text string")
    want = {(m, x) for m, x in own for k, y in texts if None not in (m, x, k, y) and m == k and x in y}
    assert sorted(map(tuple, names.contained(n, t, shard_bytes).collect())) == sorted(want)
    held = {(k, y) for k, y in texts for m, x in own if None not in (m, x, k, y) and m == k and x in y}
    assert sorted(map(tuple, names.holding(t, n, shard_bytes).collect())) == sorted(held)
    assert names.contained(n.limit(0), t).count() == 0 and names.contained(n, t.limit(0)).count() == 0
    titles = [(m, x) for m, x in own[:30] if m and x]
    lost = evaluate.undocumented(n.filter("module is not null and name is not null"), spark.createDataFrame(titles, "module int, title string"))
    plain = {(m, x) for m, x in own if m and x is not None and not any(k == m and (x in y or y in x) for k, y in titles)}
    assert {tuple(r) for r in lost.collect()} == plain


# -- scopes

def plain_end(lines, start):
    """Line after line, from ``start`` on."""
    depth, opened = 0, False
    for at in range(start, len(lines) + 1):
        line = lines[at - 1]
        depth += line.count("{") - line.count("}")
        opened |= "{" in line
        if (opened and depth == 0) or (not opened and ";" in line):
            return at
    return start


def test_scope_ends(spark):
    assert scopes.ends_of("f() {\n  if (a) { b(); }\n}\nx")[0] == 3
    assert scopes.ends_of("abstract int f();\n}")[0] == 1 and scopes.ends_of("f() {\n  never closed")[0] == 1
    assert scopes.ends_of('a\nf() { s = "}"; }\nb')[1] == 2 and scopes.ends_of("") == [1]
    rng = random.Random(2)
    for _ in range(300):
        lines = ["".join(rng.choice("{};x ") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 25))]
        assert scopes.ends_of("\n".join(lines)) == [plain_end(lines, i + 1) for i in range(len(lines))]
    quiet = 'f() {\n  s = "}"; // }\n  /* }\n } */ c = \'}\';\n}\n'
    assert scopes.ends_of(quiet, quiet=True)[0] == 5 and scopes.ends_of(quiet)[0] == 1
    got = spark.createDataFrame([("a {\n}",), (None,)], "t string").select(scopes.scope_ends(F.col("t")).alias("e")).collect()
    assert [r.e for r in got] == [[2, 2], None]


def test_overloads_without_a_mapping(spark):
    text = '@RequestMapping("/s")\npublic class A {\n  @GetMapping("/one")\n  @PostMapping("/two")\n  public R load(Long a) {\n    return x;\n  }\n  private String load(Long a, boolean b) {\n  }\n  public R bare() { return y; }\n  @PutMapping("/last")\n  public R save(int a) { return z; }\n}'
    got = extract.controller_methods(spark.createDataFrame([("A.java", text), ("B.java", "")], "path string, content string")).collect()
    assert sorted((r.method_name, r.http_method, r.endpoint, r.line) for r in got) == [("load", "POST", "/s/two", 4), ("save", "PUT", "/s/last", 11)]
    assert {r.method_name: r.body.count("\n") for r in got} == {"load": 2, "save": 0}


# -- best match

def test_parts(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(60)] + [None]
    a, b = words[:30], words[25:]
    got = merge.parts(*(spark.createDataFrame([(w,) for w in x], "text string") for x in (a, b)))
    assert {tuple(r) for r in got.collect()} == {(x, y) for x in a for y in b if x and y and x in y}


def test_best_match(spark):
    rng = random.Random(4)
    some = lambda: rng.choice(["ab", "abc", "bcd", "cd", "order", "orders", "api", "x"])
    functions = [("get" + "".join(some().capitalize() for _ in range(rng.randrange(4))), rng.choice(["GET", "POST", None])) for _ in range(25)]
    flows = [("/" + "/".join(["api", *(some() for _ in range(rng.randrange(4)))]), rng.choice(["GET", "POST"]), i) for i in range(40)]
    for least in (1, 2, 3):
        want = {}
        for name, verb in functions:
            words = [w.lower() for w in "".join(f"/{c}" if c.isupper() else c for c in name[3:]).split("/") if w]
            best = None
            for path, kind, place in flows:
                ends = [p for p in path.split("/") if p]
                n = sum(any(w in p or p in w for p in ends) for w in words)
                if kind == verb and n >= least and (best is None or n > best[1]):
                    best = (path, n)
            if best:
                want[name, verb] = best
        got = merge.best_match(spark.createDataFrame(functions, "function_name string, http_method string"), spark.createDataFrame(flows, "flow_path string, http_method string, place int"), least)
        assert {(r.function_name, r.http_method): (r.flow_path, r.matched) for r in got.collect()} == want


# -- hierarchies

def test_hierarchy(spark):
    files = [
        ("A.java", "package a;\n// class Not extends This {\npublic interface Order<T extends Comparable<T>> extends Base, other.Root {\n}\ninterface Root {}\n"),
        ("B.java", "abstract class AbstractOrder<A, B> implements Order<Map<A, List<B>>> {\n  class Inner extends AbstractOrder<X, Y> {\n  }\n}"),
        ("C.java", "public final class Zed extends AbstractOrder<C, D>\n    implements java.io.Serializable, Marker {\n}"),
        ("D.java", "class OrderImpl extends Zed { }\nclass Loop extends Pool {}\nclass Pool extends Loop {}\nenum E implements Marker { ONE }\nrecord P(int a) implements Marker { }"),
        ("E.java", None), ("F.java", "class Alone {}"),
    ]
    found = hierarchy.types(spark.createDataFrame(files, "path string, content string"))
    assert {r.name: (r.kind, r.abstract, r.parents) for r in found.collect()} == {
        "Order": ("interface", False, ["Base", "Root"]), "Root": ("interface", False, []), "AbstractOrder": ("class", True, ["Order"]), "Inner": ("class", False, ["AbstractOrder"]),
        "Zed": ("class", False, ["AbstractOrder", "Serializable", "Marker"]), "OrderImpl": ("class", False, ["Zed"]), "Loop": ("class", False, ["Pool"]), "Pool": ("class", False, ["Loop"]),
        "E": ("enum", False, ["Marker"]), "P": ("record", False, ["Marker"]), "Alone": ("class", False, []),
    }
    below = hierarchy.implementations(found)
    got = {(r.interface, r.class_name): r.distance for r in below.collect()}
    assert got == {("Order", "Inner"): 2, ("Order", "Zed"): 2, ("Order", "OrderImpl"): 3, ("Base", "Inner"): 3, ("Base", "Zed"): 3, ("Base", "OrderImpl"): 4, ("Root", "Inner"): 3, ("Root", "Zed"): 3, ("Root", "OrderImpl"): 4, ("Serializable", "Zed"): 1, ("Serializable", "OrderImpl"): 2, ("Marker", "Zed"): 1, ("Marker", "OrderImpl"): 2, ("Marker", "E"): 1, ("Marker", "P"): 1}
    first = {r.interface: r.class_name for r in hierarchy.ranked(below).filter("place = 0").collect()}
    assert first["Order"] == "OrderImpl" and first["Base"] == "Inner" and first["Marker"] == "E"
    calls = spark.createDataFrame([("Api", "run", "Order", "load", True), ("OrderImpl", "load", "Store", "find", False)], "class_name string, method_name string, service string, callee string, is_entry boolean")
    assert {(r.depth, r.callee) for r in graph.call_graph(calls, hierarchy.ranked(below)).collect()} == {(1, "load"), (2, "find")}
    assert hierarchy.implementations(found, depth=1).filter("distance > 1").count() == 0


# -- configuration

@pytest.mark.parametrize(("text", "value"), [
    ('a: 1\nb:\n  c: x # no\n  d: "q: #1"\ne:\n- 1\n- two: 2\n  three: 3\n-\n  four: 4\n- - 5\n  - 6\n-\nf: [1, "a, b", {k: v, w: [x]}]\n', {"a": 1, "b": {"c": "x", "d": "q: #1"}, "e": [1, {"two": 2, "three": 3}, {"four": 4}, [5, 6], None], "f": [1, "a, b", {"k": "v", "w": ["x"]}]}),
    ("k: |\n  a\n   b\n\n  c\nz: >-\n  one\n  two\n\n  three\n", {"k": "a\n b\n\nc\n", "z": "one two\nthree"}),
    ("url: http://x:80/y#z\ntime: a:b\n\"q k\": 1\nneg: -3\nf: 1.5e3\nn: ~\nempty:\nlast: it's", {"url": "http://x:80/y#z", "time": "a:b", "q k": 1, "neg": -3, "f": 1500.0, "n": None, "empty": None, "last": "it's"}),
    ("x:\n  - name: p\n    modules:\n      - m1\n      - m2\n    apps: []\n  - name: q\ny: {}\n", {"x": [{"name": "p", "modules": ["m1", "m2"], "apps": []}, {"name": "q"}], "y": {}}),
    ("a:\n  b:\n    c: 1\n  d: 2\ne: 3", {"a": {"b": {"c": 1}, "d": 2}, "e": 3}), ("---\n- 'it''s'\n- \"\\u00e9\\n\"", ["it's", "é\n"]), ("", None), ("# only\n", None), ("true", True),
])
def test_indented(text, value):
    assert indented.parse(text) == value


@pytest.mark.parametrize("text", ["a: &x 1", "a: 1\n   b: 2\n", "a: [1", 'a: "x" y', "a: 1\n---\nb: 2"])
def test_indented_says_what_it_does_not_read(text):
    with pytest.raises(indented.Malformed, match="line"):
        indented.parse(text)


def test_golden_sets(spark):
    listed = '- query: "a"\n  expected_hits: [x, y]\n  verify_provenance: true\n- query: b\n  expected_graph_symbols:\n    - symbol: s\n'
    got = indented.golden_sets(spark.createDataFrame([("l", listed), ("m", "queries:\n  - query: c\n"), ("n", None), ("o", "")], "path string, content string")).collect()
    assert sorted((r.path, r.query_id, r.query, tuple(r.expected_hits), len(r.expected_graph_symbols), r.verify_provenance) for r in got) == [("l", 0, "a", ("x", "y"), 0, True), ("l", 1, "b", (), 1, False), ("m", 0, "c", (), 0, False)]
    assert json.loads(spark.range(1).select(indented.as_json(F.lit("a: [1]")).alias("j")).first().j) == {"a": [1]}


# -- requirements

def test_requirements(spark):
    calls = spark.createDataFrame([("e", "a"), ("a", "b"), ("b", "a"), ("x", "y"), (None, "b")], "src string, dst string")
    sets = spark.createDataFrame([("b", "DONE"), ("y", "OPEN"), ("e", "NEW"), (None, "Q")], "symbol string, to_status string")
    claimed = spark.createDataFrame([("f", "e", s) for s in ("DONE", "OPEN", "NEW", "DONE")], "flow string, entry string, to_status string")
    assert {(r.to_status, r.in_code) for r in requirements.transitions_in_code(claimed, calls, sets).collect()} == {("DONE", True), ("OPEN", False), ("NEW", True)}
    recalled = spark.createDataFrame([(m, f"{m}{k}", "r", k) for m in "ab" for k in range(1, 6)], "method string, section string, file string, rank int")
    mapping = spark.createDataFrame([("a", "z", "m"), ("a", "y", "m"), ("a", "y", "m"), ("c", "q", "m"), (None, "q", "m")], "method string, section string, file string")
    got = sorted((r.method, r.rank, r.section, r.origin) for r in requirements.paired(recalled, mapping).collect())
    assert got == [("a", 1, "y", "mapping"), ("a", 2, "z", "mapping"), ("b", 1, "b1", "recall"), ("b", 2, "b2", "recall"), ("b", 3, "b3", "recall"), ("c", 1, "q", "mapping")]


def test_report_lines(spark):
    each = spark.createDataFrame([("a|b", 0.5, 0.25, 1.0, None, False), ("c", 1.0, 1.0, 0.0, 0.5, True)], "query string, hit_rate double, mrr double, graph_recall double, provenance double, stale boolean")
    shown = spark.createDataFrame([("c", "S", "f.md", False), ("c", "T", None, True)], "query string, symbol string, from_file string, ok boolean")
    stale = spark.createDataFrame([("c", "g.md")], "query string, file_path string")
    lines = [r.line for r in render.eval_lines(evaluate.summary(each), each, shown, stale).orderBy("section", "place").collect()]
    assert lines == ["| Hit Rate | 75.0% |", "| MRR | 62.5% |", "| Graph Recall | 50.0% |", "| Provenance Accuracy | 50.0% |", "| Total Queries | 2 |", "| Stale Queries | 1 |", "| a\\|b | 50% | 100% | hits |", "| c | 100% | 0% | graph |", "- **S** expected under `f.md` — not found: c", "| c | `g.md` |"]


def test_transitions(spark):
    rng = random.Random(7)
    some = ["public void setStatus(A a) {\n", "private X go (int b) {\n", " x.setStatus (S.ONE);\n", " setStatus(S.TWO, List.of(S.A, S.B));\n", " S.THREE\n", "y" * 300 + "\n", " setStatus(other)\n", "protected R setStatus("]
    import re

    for _ in range(3):
        text = "".join(rng.choice(some) for _ in range(40))
        pieces = re.split(r"setStatus\s*\(", text)
        want = []
        for k in range(1, len(pieces)):
            ahead = "setStatus(".join(pieces[:k])
            window = ahead[-500:] + "setStatus(" + pieces[k][:300]
            to = re.search(r"S\.(\w+)", window)
            listed = re.search(r"List\.of\(([^)]*)\)", window)
            origin = " | ".join(re.findall(r"S\.(\w+)", listed[1])) if listed else ""
            heads = re.findall(r"(?:public|private|protected)\s+\S+\s+(\w+)\s*\(", ahead)
            want.append((to and to[1], origin or "any", heads[-1] if heads else "", ahead.count("\n") + 1))
        got = extract.transitions(spark.createDataFrame([("a", text), ("b", text), ("c", "none"), ("d", None)], "path string, content string"), "S", "setStatus").collect()
        key = lambda x: tuple(map(str, x))
        assert sorted(((r.to_status, r.from_status, r.method_name, r.line) for r in got if r.path == "b"), key=key) == sorted(want, key=key)
        assert {r.path for r in got} <= {"a", "b"}


def test_search_with_many_blocks(spark, monkeypatch):
    from kbspark.operators import vector

    rng = random.Random(8)
    rows = [(i, rng.choice(["x", "y"]), [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "vec_id int, lang string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(23)] + [(99, None)], "query_id int, query array<double>")
    whole = {tuple(r[:3]) for r in vector.top_k_batch(chunks, asked, 3, None, ["lang"]).select("query_id", "vec_id", "rank").collect()}
    monkeypatch.setattr(vector, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vector, "GATHERED", 200)
    assert {tuple(r[:3]) for r in vector.top_k_batch(chunks, asked, 3, None, ["lang"]).select("query_id", "vec_id", "rank").collect()} == whole and len(whole) == 23 * 6
    assert vector.top_k_batch(chunks, asked.limit(0)).count() == 0
