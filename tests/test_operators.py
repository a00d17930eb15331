"""Edge cases that the tables do not hold."""

import math
import os
import random
import subprocess
import sys
import time

from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.operators import chunk, evaluate, extract, graph, hybrid, incremental, merge, render, route, vector
from kbspark.plans import indexing
from kbspark.sources import files, frontmatter, store, tables
from kbspark.streaming import upserts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cjk_ratios(spark):
    for text, want in (("", 4.0), ("a" * 10, 4.0), ("一" + "a" * 9, 4.0), ("一" * 2 + "a" * 8, 3.5), ("一" * 3 + "a" * 7, 4 * 0.7 + 1.5 * 0.3), ("一" * 4 + "a" * 6, 1.5), ("一", 1.5)):
        assert abs(one(spark, tx.chars_per_token(F.lit(text))) - want) < 1e-9, text


def test_names_and_paths(spark):
    assert one(spark, tx.camel_to_snake(F.lit("OrderItemId"))) == "order_item_id"
    assert one(spark, tx.camel_to_kebab(F.lit("PayTypeEnum"), "Enum")) == "pay-type"
    assert one(spark, tx.kebab_to_camel(F.lit("pay-type"))) == "PayType"
    assert one(spark, tx.normal_path(F.lit("a/./b/../c"))) == "a/c"
    assert one(spark, tx.normal_path(F.lit("../a"))) == "a"
    assert one(spark, tx.extension(F.lit("x/y.test.ts"))) == ".ts"
    assert one(spark, tx.class_of_path(F.lit("a/Foo.java"))) == "Foo"
    assert one(spark, tx.class_of_path(F.lit("a/foo.ts"))) is None
    assert one(spark, tx.handler_method(F.lit("A.get#2"))) == "get"
    assert one(spark, tx.ellipsis(F.lit("x" * 41))) == "x" * 37 + "..."
    assert one(spark, tx.round_half_up(F.lit(-0.5), 0)) == 0


def plain_spans(text, as_reference):
    """The overlap split, line by line."""
    lines, limit, back = text.split("\n"), 4000, 10
    if len(text) <= limit:
        return [(1, len(lines))]
    out, first, held, count = [], 1, [], 0
    for line in lines:
        held.append(line)
        count += len(line) + 1
        if count >= limit:
            out.append((first, first + len(held) - 1))
            step = min(back, len(held) if as_reference else len(held) - 1)
            first += len(held) - step
            held = held[len(held) - step :]
            count = len("\n".join(held))
    if held:
        out.append((first, len(lines)))
    return out


def test_overlap_spans(spark):
    rng = random.Random(3)
    texts = ["", "a", "x" * 9000, "\n".join("y" * rng.randint(0, 700) for _ in range(60)), "\n".join("z" * 30 for _ in range(900)), "\n" * 5000, "\n".join("w" * 1500 for _ in range(20))]
    for as_reference in (True, False):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunk.overlap_spans(F.col("t"), as_reference).alias("s")).collect()
        for row in rows:
            assert [(s["first"], s["last"]) for s in row.s] == plain_spans(texts[row.i], as_reference), (row.i, as_reference)


def test_method_parts_and_file_chunks(spark):
    code = "package a;\nclass A {\n  public void one() {\n  }\n  private int two(int x) {\n    return f(x);\n  }\n}"
    rows = spark.createDataFrame([("A.java", code), ("b.py", "def f():\n  pass"), ("n.java", None)], "path string, content string")
    got = [tuple(r) for r in chunk.method_parts(rows, strict=True).orderBy("path", "line_start").select("path", "line_start", "line_end", "method_name").collect()]
    assert got == [("A.java", 1, 2, None), ("A.java", 3, 4, "one"), ("A.java", 5, 8, "two"), ("b.py", 1, 2, None)]
    loose = chunk.method_parts(rows).filter("path = 'A.java'").count()
    assert loose == 4  # return f( looks like a header
    short = chunk.file_chunks(rows).orderBy("path").collect()
    assert [(r.path, r.line_end, r.class_name, r.language) for r in short] == [("A.java", 8, "A", "java"), ("b.py", 2, None, "python")]
    long = chunk.file_chunks(spark.createDataFrame([("B.java", "\n".join(f"  public void m{i}() {{\n" + "x();\n" * 40 + "  }" for i in range(40)))], "path string, content string"))
    lines = {line for r in long.collect() for line in range(r.line_start, r.line_end + 1)}
    assert lines == set(range(1, max(lines) + 1)) and long.filter("method_name = 'm39'").count() == 1


def test_sections_and_fences(spark):
    rows = spark.createDataFrame([("a", "no heading\n## B c\nx\n#### d\n# E"), ("b", ""), ("c", None)], "path string, body string")
    got = {(r.path, r.heading, r.start_line, r.section) for r in chunk.sections(rows).collect()}
    assert got == {("a", "", 1, "no heading"), ("a", "B c", 2, "## B c\nx\n#### d"), ("a", "E", 5, "# E"), ("b", "", 1, "")}
    assert one(spark, chunk.numbered(F.lit("a\n```\nb\n```\nc"), F.lit(7))) == "a\n```\n9| b\n```\nc"


def test_route(spark):
    cases = {"a/tests/x.java": "skip", "a/FooConfig.java": "index-only", "a/service/Foo.java": "lm-judge", "a/dao/Foo.java": "generate", "a/none.txt": "index-only", "A\\ENTITY\\x.java": "generate"}
    for path, action in cases.items():
        assert one(spark, route.route(F.lit(path))["action"]) == action, path


def test_front_matter(spark):
    text = '---\nkb_layer: domain\nsummary: "say \\"hi\\" \\\\ there"\nsources:\n  - a.java\n  - b.java\nlast_scan_commits:\n  - {file: a.java, commit: c1, body_hash: h1}\nstale: true\nhuman_edited: true\n---\nbody\r\ntext'
    rows = frontmatter.parse(spark.createDataFrame([(text,), ("plain",), ("---\nkb_layer: x\nsummary:\nsources:\n---\nb",)], "content string")).collect()
    assert rows[0].summary == 'say "hi" \\ there' and rows[0].sources == ["a.java", "b.java"] and rows[0].stale and rows[0].human_edited and rows[0].body == "body\r\ntext"
    assert rows[0].last_scan_commits[0].commit == "c1"
    assert rows[1].body == "plain" and rows[1].kb_layer is None and rows[1].sources == []
    assert rows[2].summary is None and rows[2].sources == [] and rows[2].body == "b"


def test_extract_small(spark):
    docs = spark.createDataFrame([("A.java", "x\nclass A {\n  @Autowired\n  private B b;\n  public void go() {\n    b.run(1); log.info(2);\n  }\n}")], "path string, content string")
    calls = extract.service_calls(extract.method_bodies(docs), extract.injected_fields(docs)).collect()
    assert [(c.class_name, c.method_name, c.service, c.callee, c.is_external) for c in calls] == [("A", "go", "B", "run", False)]
    assert one(spark, extract.unfenced(F.lit("```markdown\n# a\n```"))) == "# a"
    assert one(spark, extract.unfenced(F.lit("# a"))) == "# a"
    assert one(spark, extract.graph_stats(F.lit("86,012 nodes, 213,004 edges"))["nodes"]) == 86012
    assert one(spark, extract.graph_stats(F.lit("nothing"))["edges"]) is None
    impl = extract.implemented(spark.createDataFrame([("X.java", "public class X extends Y implements A, B<C> {")], "path string, content string")).collect()
    assert [(r.class_name, r.interface, r.place) for r in impl] == [("X", "A", 0), ("X", "B", 1)]


def test_merge_sides(spark):
    left = spark.createDataFrame([("A", "get", "/x", "gx")], "class_name string, http_method string, endpoint string, method_name string")
    right = spark.createDataFrame([("A", "GET", "/x", "rx", "T", "p", "", 3), ("A", "GET", "/x", "ry", "U", "", "", 9), ("A", "POST", "/y", "y", "", "", "", 1)], "class_name string, http_method string, endpoint string, method_name string, return_type string, params string, comment string, line int")
    got = {(r.http_method, r.endpoint, r.method_name, r.return_type, r.line, r.in_graph) for r in merge.endpoints(left, right).collect()}
    assert got == {("GET", "/x", "gx", "U", 9, True), ("POST", "/y", "y", "", 1, False)}
    assert merge.endpoints(left.limit(0), right.limit(0)).count() == 0
    routes = spark.createDataFrame([("f", 0, "/api/users/{id}"), ("f", 1, "/api/users"), ("g", 0, "/a"), ("g", 1, "/b")], "group_id string, place int, route string")
    assert {(r.group_id, r.base_path) for r in merge.common_base(routes).collect()} == {("f", "/api/users"), ("g", "")}


def test_graph_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("a", "b")], "src string, dst string").withColumn("edge_type", F.lit("calls"))
    got = {(r.symbol, r.distance) for r in graph.impact(edges, spark.createDataFrame([("c",)], "symbol string"), 5).collect()}
    assert got == {("c", 0), ("b", 1), ("d", 1), ("a", 2)}
    assert graph.trace(edges, "a", "c").first().path == ["a", "b", "c"]
    assert graph.trace(edges, "a", "zz").count() == 0
    assert graph.trace(edges, "a", "a").first().path == ["a"]
    assert {(r.module, r.length) for r in graph.module_cycles(edges).collect()} == {("a", 3), ("b", 3), ("c", 3), ("d", 3)}
    node = "array<struct<uid:string,name:string>>"
    nested = spark.createDataFrame([("s", {"calls": [("u", "n")]}, None)], f"symbol string, outgoing map<string,{node}>, incoming map<string,{node}>")
    assert [tuple(r) for r in graph.normalised(nested).collect()] == [("s", "out", "calls", "u", "n")]


def test_evaluation(spark):
    empty, ab = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    assert one(spark, evaluate.hit_rate(empty, ab)) == 1 and one(spark, evaluate.hit_rate(ab, empty)) == 0
    assert one(spark, evaluate.reciprocal_rank(ab, F.array(F.lit("b"), F.lit("a")))) == 0.75
    assert one(spark, evaluate.graph_recall(ab, F.array(F.lit("a")))) == 0.5
    assert one(spark, evaluate.percent(F.lit(0), F.lit(0))) == 100
    per = spark.createDataFrame([(1.0, 1.0, 1.0, None, False)], "hit_rate double, mrr double, graph_recall double, provenance double, stale boolean")
    got = evaluate.summary(per).first()
    assert (got.provenance, got.total_queries, got.stale_queries) == (1.0, 1, 0)
    assert evaluate.regressions(per).count() == 0 and render.eval_report(per).count() == 0


def test_vector_edges(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0, 1.0]), (5, [1.0]), (6, [2.0, 0.0]), (7, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in vector.top_k(rows, [1.0, 0.0], 10, None).collect()]
    assert got == [(1, 1.0), (6, 1.0), (4, 0.0), (7, -1.0)]
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query array<float>")
    assert [r.vec_id for r in vector.top_k_batch(rows, asked, 1).collect()] == [1]
    assert vector.choose_collections(["kb", "code"]) == ["kb"] and vector.choose_collections(["x"]) == ["x"] and vector.choose_collections(["kb", "code"], "code") == ["code"]
    assert vector.needs_rebuild({"embedding_model": "m", "dimensions": 2}, "m", 3, [], [])


def test_upsert_and_reindex(spark, tmp_path):
    docs = spark.createDataFrame([("flows/a.md", "# A\n" + "long text " * 5), ("b.md", "# B\n" + "more text " * 5)], "path string, content string")
    index, manifest = indexing.reindex(indexing.kb_chunks(docs.limit(0)), spark.createDataFrame([], "path string, hash string"), docs)
    assert {(r.path, r.heading, r.source_type) for r in index.collect()} == {("flows/a.md", "A", "flow"), ("b.md", "B", "doc")}
    later = docs.filter("path = 'b.md'").withColumn("content", F.concat("content", F.lit(" changed")))
    again, now = indexing.reindex(index, manifest, later)
    whole = indexing.kb_chunks(later)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, whole.collect()))  # the deleted document's chunks are gone
    twice, _ = indexing.reindex(again, now, later)
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, whole.collect()))
    folder = f"file://{tmp_path}/index"
    for df in (index, again):
        incremental.publish(df, folder)
    assert incremental.published(spark, folder).count() == 1 and incremental.published(spark, folder + "2") is None


def test_publish_survives_a_dying_writer(spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    incremental.publish(spark.range(3), folder)
    old = incremental.published(spark, folder)
    spark.range(9).write.parquet(f"{folder}/v-unfinished")  # written, but never named
    assert incremental.published(spark, folder).count() == 3
    incremental.publish(spark.range(5), folder)
    assert incremental.published(spark, folder).count() == 5 and old.count() == 3
    assert len(list((tmp_path / "t").glob("v-*"))) == 2


def test_deleted_documents_stay_deleted(spark, tmp_path):
    schema = "path string, version int, hash string, deleted boolean, content string"
    docs = store.Store(spark, f"file://{tmp_path}/docs", schema, version="version", buckets=2)
    for batch in ([("a", 1, "x", False, "one"), ("b", 1, "x", False, "b")], [("a", 3, "x", True, "one")], [("a", 2, "x", False, "two")], [("b", 1, "x", False, "late")]):
        upserts.apply_batch(docs, spark.createDataFrame(batch, schema))
    assert [(r.path, r.content) for r in upserts.living(docs.read()).collect()] == [("b", "b")]
    docs.rewrite(upserts.living)
    assert docs.read().count() == 1


def test_endpoint_without_a_path_meets_on_both_sides(spark):
    kind = "class_name string, http_method string, endpoint string, method_name string, return_type string, params string, comment string, line int"
    one = spark.createDataFrame([("C", None, None, "m", "R", "", "", 4)], kind)
    assert merge.endpoints(one, one).count() == 1


def test_overlap_spans_take_time_in_proportion(spark):
    took = []
    for n in (4000, 16000):
        df = spark.createDataFrame([("\n".join(["some words on a line of text"] * n),)], "t string")
        df.select(chunk.overlap_spans(F.col("t")).alias("s")).collect()
        began = time.time()
        df.select(F.size(chunk.overlap_spans(F.col("t"))).alias("s")).collect()
        took.append(time.time() - began)
    assert took[1] < 10 * max(took[0], 0.3)


def test_batch_search_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 8)).round(1)
    v[50:60] = v[7]
    rows = [(i, x.tolist(), "g" if i % 3 else None) for i, x in enumerate(v)] + [(900, None, "g"), (901, [0.0] * 8, "g"), (902, [1.0], "g"), (903, [None] + [1.0] * 7, "g"), (904, [float("nan")] * 8, "g")]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind string").repartition(5)
    asked = spark.createDataFrame([(i, v[i].tolist(), "x") for i in range(0, 300, 7)] + [(1000, None, "x"), (1001, [0.0] * 8, "x")], "query_id long, query array<double>, more string")
    for by in (None, ["kind"]):
        got = {(r.query_id, r.kind if by else "", r["rank"]): r.vec_id for r in vector.top_k_batch(chunks, asked, 4, None, by).collect()}
        want = {}
        for i in range(0, 300, 7):
            cos = [math.fsum(a * v[i]) / math.sqrt(math.fsum(a * a) * math.fsum(v[i] * v[i])) for a in v]
            for kind in ("g", None) if by else ("",):
                own = sorted((-math.floor(cos[j] * 100 + 0.5), -round(cos[j], 12), j) for j in range(300) if not by or rows[j][2] == kind)
                want.update({(i, kind, k + 1): own[k][2] for k in range(4)})
        assert got == want


def test_guard_and_state(spark, tmp_path):
    old = spark.createDataFrame([("a", True), ("b", False)], "path string, human_edited boolean")
    new = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v int")
    assert {r.path for r in incremental.guarded(old, new).collect()} == {"b", "c"}
    assert incremental.guarded(old, new, force=True).count() == 3
    state = incremental.State(spark, f"file://{tmp_path}/state")
    assert state.read().count() == 0
    state.add_module("m", "kb/m", ["src"])
    state.add_module("m", "kb/m2")
    state.checked("2024-01-01 00:00:00")
    assert [(r.module, r.kb_path) for r in state.read().collect()] == [("m", "kb/m2")] and not state.is_old()


def test_hybrid_merge(spark):
    hits = spark.createDataFrame([(1, 1, "f", "h", 0.9), (1, 2, "g", "", 0.5), (2, 1, "f", "h", 0.4)], "query_id int, rank int, file_path string, heading string, score double")
    context = spark.createDataFrame([(1, "f", "S", "calls", "T")], "query_id int, file_path string, symbol string, edge_type string, neighbour string")
    got = {r.query_id: r for r in hybrid.merged(hits, context).collect()}
    assert [h.file_path for h in got[1].hits] == ["f", "g"] and len(got[1].graph_context) == 1 and got[2].graph_context == []
    assert hybrid.cleaned(hits).filter("query_id = 1 and rank = 2").first().heading is None


def test_files(spark, tmp_path):
    for path, text in {"src/A.java": "class A {}", "node_modules/B.java": "x", "test/C.java": "x", "docs/d.md": "# d", "apps/one/x.ts": "1"}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    folder = str(tmp_path)
    assert {r.path for r in files.scan_java(spark, folder).collect()} == {"src/A.java"}
    assert {r.path for r in files.scan_markdown(spark, folder).collect()} == {"docs/d.md"}
    every = files.scan(spark, folder, [".java", ".ts"])
    assert [r.app for r in files.apps(every).collect()] == ["one"]
    assert files.by_name(every, "A.java").first().path == "src/A.java"
    assert files.directory(every, ["one"]).first().path == "apps/one"
    assert [tuple(r) for r in tables.markdown_table(spark, "| a | b |\n|---|---|\n| 1 | 2 |").collect()] == [("1", "2")]


def test_stream_upserts(spark, tmp_path):
    schema = "path string, version long, hash string, deleted boolean, content string"
    source = f"{tmp_path}/in"
    docs = store.Store(spark, f"file://{tmp_path}/docs", schema, version="version", buckets=2)
    docs.upsert(spark.createDataFrame([("a", 1, "h", False, "old"), ("b", 1, "h", False, "old")], schema))
    spark.createDataFrame([("a", 3, "h", False, "new"), ("a", 2, "h", False, "late"), ("b", 2, "h", True, None), ("c", 1, "h", False, "c"), ("c", 1, "h", False, "c")], schema).write.parquet(source)
    for run in range(2):  # the second run brings the same batch again
        stream = spark.readStream.schema(schema).parquet(source)
        upserts.maintain(stream, docs, f"{tmp_path}/cp{run}").awaitTermination()
        assert {(r.path, r.content) for r in upserts.living(docs.read()).collect()} == {("a", "new"), ("c", "c")}


def test_frontend_records(spark):
    text = "const hiddenFields = useMemo(() => {\n  if (a.b) { return ['x', 'y'] }\n}, [a])\ndisabledFields: ['z']\nrequiredFieldMap.p requiredFieldMap.p"
    rows = spark.createDataFrame([("src/form/index.tsx", text), ("src/store/user.ts", "export default create<State>()"), ("src/components/Box/a.tsx", "")], "path string, content string")
    got = {(r.component, r.kind, r.condition, tuple(r.fields)) for r in extract.linkage_rules(rows).collect()}
    assert got == {("form", "hidden", "a.b", ("x", "y")), ("form", "disabled", "editType", ("z",)), ("form", "dynamic-required", "requiredFieldList", ("p",))}
    assert [(r.path, r.store) for r in extract.stores(rows).collect()] == [("src/store/user.ts", "user")]
    assert [r.component for r in extract.components(rows).collect()] == ["Box"]
    types = "/** a\n * 接口路径：/x/key/one\n */\nexport namespace One {\n  export interface Req {\n    id?: number;\n    name: string;\n  }\n}\nexport namespace Two {}"
    got = [(r.api, r.api_path, r.field, r.type) for r in extract.api_types(spark.createDataFrame([("t.ts", types)], "path string, content string"), "key").collect()]
    assert got == [("One", "/x/key/one", "id", "number"), ("One", "/x/key/one", "name", "string")]
    buttons = extract.buttons(spark.createDataFrame([("b.ts", "SAVE = 's'\nEND\nDROP = 'd'")], "path string, content string"), "END")
    assert [(r.name, r.code) for r in buttons.collect()] == [("SAVE", "s")]


def test_services(spark, tmp_path):
    import json

    from kbspark.plans import enrich
    from kbspark.sources import config

    rows = spark.createDataFrame([(i, f"t{i}") for i in range(45)], "id int, text string").coalesce(1)
    got = enrich.embedded(rows, lambda texts: [[float(len(texts)), float(t[1:])] for t in texts], batch=20).orderBy("id").collect()
    assert [r.vector for r in got] == [[20.0 if i < 40 else 5.0, float(i)] for i in range(45)]
    flows = spark.createDataFrame([("a", "**调用服务数：** 4", "p"), ("b", "**调用服务数：** 2", "boom"), ("c", "**调用服务数：** 1", "p")], "path string, body string, prompt string")

    def ask(tier, prompt):
        if prompt == "boom":
            raise OSError("no answer")
        return f"```markdown\n{tier}\n```"

    got = {r.path: (r.status, r.answer) for r in enrich.described(flows, ask).collect()}
    assert got == {"a": ("generated", "high"), "b": ("failed", None)}
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"output_dir": "o", "projects": [{"name": "g", "type": "gateway"}, {"name": "b"}], "queries": [{"query": "q", "expected_hits": ["x"]}]}))
    loaded = config.Config.of(config.load(str(path)))
    assert loaded.default_project().name == "b" and [p.name for p in loaded.chosen("g")] == ["g"]
    assert config.golden_queries(spark, str(path)).first().expected_hits == ["x"]


def test_graph_goes_as_far_as_it_reaches(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(13)]
    edges = spark.createDataFrame([*chain, ("n13", "n00"), ("x", "n00")], "src string, dst string")
    assert graph.trace(edges, "n00", "n12").first().path == [f"n{i:02}" for i in range(13)]
    assert graph.trace(edges, "n00", "n12", depth=11).count() == 0 and graph.trace(edges, "n00", "x").count() == 0
    assert {(r.module, r.length) for r in graph.module_cycles(edges).collect()} == {(f"n{i:02}", 14) for i in range(14)}
    assert graph.module_cycles(edges, depth=13).count() == 0


def test_freshness_counts_parts_of_a_second(spark):
    rows = spark.sql("SELECT ts AS last_check, true AS has_state, 's' AS source, 'main' AS branch, true AS fetch_ok, 'a' AS head, 'b' AS remote FROM VALUES (TIMESTAMP '2024-01-14 12:00:00.000001'), (TIMESTAMP '2024-01-14 12:00:00'), (TIMESTAMP '2024-01-14 11:59:59.999999') t(ts)")
    found = incremental.freshness(rows, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).orderBy("last_check").select("state").collect()
    assert [r.state for r in found] == ["behind", "behind", "within-threshold"]


MANY_QUERIES = """
import resource

import numpy as np
import pyarrow as pa

from kbspark.operators import vector

v = np.random.default_rng(9).normal(size=(12000, 4)).round(2)
v[(v == 0).all(axis=1)] = 1
lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 4, dtype=np.int32)), pa.array(v.ravel()))
rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), lists], ["vec_id", "embedding"])
asked = pa.table({"query_id": np.arange(len(v)), "query": lists})
start, found, most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, {}, 0
for out in vector._nearest(asked, 5, [], "vec_id", "embedding")(iter([rows])):
    most = max(most, out.nbytes)
    for q, i in zip(out.column("query_id").to_numpy(), out.column("vec_id").to_numpy()):
        if q % 1000 == 0:
            found.setdefault(int(q), []).append(int(i))
held = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start
unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
for q in range(0, len(v), 1000):
    near = unit @ unit[q]
    assert len(found[q]) == 5 and near[found[q]].min() >= np.sort(near)[-5] - 1e-9
assert most < 1 << 20 and held < 150 << 10, (most, held)
print("RIGHT", most, held)
"""


def test_batch_search_holds_no_more_for_more_queries():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", MANY_QUERIES], env=os.environ | {"PYTHONPATH": root, "OMP_NUM_THREADS": "1"}, capture_output=True, text=True, timeout=170)
    assert "RIGHT" in done.stdout, done.stderr[-2000:]


def test_batch_search_among_copies(spark):
    rows = spark.createDataFrame([(i, [float(i % 3 == 0), 1.0], i % 2) for i in range(600)], "vec_id long, embedding array<float>, half int").repartition(3)
    asked = rows.filter("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for by in (None, ["half"]):
        for k in (2, 250, 900):
            got = {(r.query_id, r.half if by else 0, r["rank"]): r.vec_id for r in vector.top_k_batch(rows, asked, k, None, by).collect()}
            want = {}
            for q in range(4):
                for half in (0, 1) if by else (0,):
                    order = sorted((i for i in range(600) if not by or i % 2 == half), key=lambda i: ((i % 3 == 0) != (q % 3 == 0), i))
                    want.update({(q, half, n + 1): i for n, i in enumerate(order[:k])})
            assert got == want


def test_batch_search_beside_huge_vectors(spark):
    rows = spark.createDataFrame([(i, [1e200, 1e200] if i % 2 else [-1.0, 0.0]) for i in range(40)], "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(9, [1e150, 1.0])], "query_id long, query array<double>")
    assert [r.vec_id for r in vector.top_k_batch(rows, asked, 3, None).orderBy("rank").collect()] == [0, 2, 4]
