"""Further registered queries and their SQL: operators that ``catalog`` does not bind. Texts are written from
the rows of tables that grow with the scale, and read back by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunk, evaluate, extract, flows, graph, hybrid, incremental, merge, render, route, vector
from ..sources import frontmatter
from ..sources.tables import table
from . import indexing, update
from .catalog import _EDGES, _fk_edges, query

# -- extraction


@query("""SELECT o_orderkey, 'id' || o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN '' ELSE '/o/' || o_orderkey END AS route, CASE WHEN o_orderstatus = 'O' THEN 'GET' ELSE 'POST' END AS http_method, 'a/' || o_custkey || '.java' AS file_path, '' AS handler FROM orders""")
def extract_route_nodes(spark, sf):
    text = F.concat(F.lit('{"id":"id'), F.col("o_orderkey"), F.lit('","filePath":"a/'), F.col("o_custkey"), F.lit('.java"'), F.when(F.col("o_orderstatus") != "F", F.concat(F.lit(',"name":"/o/'), F.col("o_orderkey"), F.lit('"'))).otherwise(""), F.when(F.col("o_orderstatus") != "O", ',"method":"POST"').otherwise(',"method":null'), F.lit("}"))
    return extract.route_nodes(table(spark, sf, "orders").select("o_orderkey", text.alias("json")))


@query("SELECT 'P' || p_partkey || 'Status' AS class_name, 'V' || p_size AS code_name, p_size::VARCHAR AS code, p_brand AS description FROM part UNION ALL SELECT 'P' || p_partkey || 'Status', 'LAST', 'x', 'x' FROM part")
def extract_status_values(spark, sf):
    body = F.concat(F.lit("public enum P"), F.col("p_partkey"), F.lit('Status {\n  V'), F.col("p_size"), F.lit('("'), F.col("p_size"), F.lit('", "'), F.col("p_brand"), F.lit('"),\n  LAST("x");\n  private String of = call("no");\n}\n'))
    files = table(spark, sf, "part").select(F.concat(F.lit("src/P"), F.col("p_partkey"), F.lit("Status.java")).alias("path"), body.alias("content"))
    return extract.status_values(files.unionByName(files.select(F.lit("src/Other.java").alias("path"), F.lit('public enum Other { A("b"); private int x; }').alias("content")).limit(1)))


@query("""SELECT 'C' || s_suppkey AS class_name, 'load' || s_suppkey AS method_name, 'GET' AS http_method, '/api/s' || s_suppkey AS endpoint, 'about ' || s_name AS comment, 8 AS line,
'  public String load' || s_suppkey || '(Long id) {' || chr(10) || '    return id;' || chr(10) || '  }' AS body FROM supplier""")
def extract_controller_methods(spark, sf):
    key = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit('@RestController\n@RequestMapping("/api")\n\npublic class C'), key, F.lit(" {\n  /**\n   * about "), F.col("s_name"), F.lit('\n   */\n  @GetMapping("/s'), key, F.lit('")\n  public String load'), key, F.lit("(Long id) {\n    return id;\n  }\n}\n"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("src/C"), key, F.lit(".java")).alias("path"), body.alias("content"))
    return extract.controller_methods(files).drop("path")


@query("SELECT p_brand AS class_name, count(*) AS n, max(p_size) AS most FROM part GROUP BY p_brand")
def rules_by_class(spark, sf):
    return extract.candidates_by_class(table(spark, sf, "part").select(F.col("p_brand").alias("class_name"), F.col("p_size").alias("decision_points")))


@query("SELECT o_orderstatus AS kind, count(*) AS n, count(DISTINCT o_custkey) AS components FROM orders GROUP BY o_orderstatus")
def linkage_by_kind(spark, sf):
    return extract.linkage_by_kind(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("kind"), F.col("o_custkey").alias("component")))


@query("SELECT DISTINCT c_mktsegment AS component FROM customer")
def extract_components(spark, sf):
    return extract.components(table(spark, sf, "customer").select(F.concat(F.lit("src/components/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit(".tsx")).alias("path")))


@query("SELECT 'src/store/s' || s_suppkey || '.ts' AS path, 's' || s_suppkey AS store FROM supplier WHERE s_acctbal > 0")
def extract_stores(spark, sf):
    text = F.when(F.col("s_acctbal") > 0, "export default defineStore({})").otherwise("export const x = 1")
    return extract.stores(table(spark, sf, "supplier").select(F.concat(F.lit("src/store/s"), F.col("s_suppkey"), F.lit(".ts")).alias("path"), text.alias("content")))


# -- routing and merging

@query("SELECT c_custkey AS entry, count(DISTINCT l_suppkey) AS services, bool_or(l_returnflag = 'R') AS changes_status FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(DISTINCT l_suppkey) >= 2 OR bool_or(l_returnflag = 'R')")
def flow_triggers(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return route.triggers_flow(rows.select(F.col("c_custkey").alias("entry"), F.col("l_suppkey").alias("service"), (F.col("l_returnflag") == "R").alias("changes_status")))


@query("""WITH r AS (SELECT o_orderkey AS place, 'c' || o_custkey AS app, 'f' || o_custkey AS frontend, o_orderpriority AS backend FROM orders), n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'c' ELSE 'f' END || c_custkey AS name FROM customer)
SELECT name, arg_min(place, place) AS place, arg_min(app, place) AS app, arg_min(frontend, place) AS frontend, arg_min(backend, place) AS backend FROM n LEFT JOIN r ON name = app OR name = frontend GROUP BY name""")
def app_relations(spark, sf):
    key = F.col("o_custkey").cast("string")
    relations = table(spark, sf, "orders").select(F.col("o_orderkey").alias("place"), F.concat(F.lit("c"), key).alias("app"), F.concat(F.lit("f"), key).alias("frontend"), F.col("o_orderpriority").alias("backend"))
    apps = table(spark, sf, "customer").select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "c").otherwise("f"), F.col("c_custkey").cast("string")).alias("name"))
    return merge.app_relations(apps, relations)


@query("SELECT 's' || s_suppkey AS path, r_name AS module, n_name AS repo FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 3 = 0")
def module_lookup(spark, sf):
    sources = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))).alias("sources"))
    repos = table(spark, sf, "nation").join(sources, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("repo"), "sources")).alias("repos"))
    modules = table(spark, sf, "region").join(repos, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("module"), "repos")
    paths = table(spark, sf, "supplier").filter("s_suppkey % 3 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"))
    return merge.sources_of(paths, modules)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_name COLLATE \"binary\", p_partkey) AS place FROM part")
def rules_in_order(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_size", "p_name")
    return merge.ranked(rows, [F.desc("p_size"), F.asc("p_name"), F.asc("p_partkey")]).select("p_partkey", "place")


@query("SELECT s_nationkey AS module, s_name AS class_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name)::INTEGER AS place FROM supplier")
def classes_in_order(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("module"), F.col("s_name").alias("class_name"))
    return merge.ranked(rows, [F.asc("class_name")], ["module"])


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def routes_page(spark, sf):
    return merge.page(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 100, 50)


@query("""SELECT coalesce(a.k, b.k) AS field, 'p' AS owner, CASE WHEN a.k IS NULL THEN 'model only' WHEN b.k IS NULL THEN 'request only' WHEN b.n AND a.r THEN 'stricter request' WHEN NOT b.n AND NOT a.r THEN 'looser request' ELSE 'same' END AS verdict
FROM (SELECT p_partkey AS k, p_size > 25 AS r FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT p_partkey AS k, p_retailprice > 1000 AS n FROM part WHERE p_partkey % 4 <> 0) b ON a.k = b.k""")
def field_consistency(spark, sf):
    rows = table(spark, sf, "part").withColumns({"owner": F.lit("p"), "field": F.col("p_partkey")})
    return merge.field_consistency(rows.filter("p_partkey % 3 <> 0").select("owner", "field", (F.col("p_size") > 25).alias("required")), rows.filter("p_partkey % 4 <> 0").select("owner", "field", (F.col("p_retailprice") > 1000).alias("nullable")))


@query("SELECT o_custkey AS k, o_orderkey AS v FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_per_key(spark, sf):
    return merge.first_per(table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), ["k"], "v")


# -- graph

def _records(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    own = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("a/"), own).alias("path"), own.alias("class_name"), F.lit("run").alias("method_name"), F.lit(3).alias("line_start"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("service"))
    calls = rows.select("class_name", "method_name", "service", F.lit("load").alias("callee"))
    return rows.drop("service"), rows.select("class_name", F.col("service").alias("type")), calls, rows.select("class_name", F.lit("Runs").alias("interface"))


@query("SELECT 'S' || s_suppkey AS uid, 'S' || s_suppkey AS name, 'class' AS kind, 'a/S' || s_suppkey AS path, 1 AS line FROM supplier UNION ALL SELECT 'S' || s_suppkey || '.run', 'run', 'method', 'a/S' || s_suppkey, 3 FROM supplier")
def graph_nodes(spark, sf):
    return graph.build(*_records(spark, sf))[0]


@query("""SELECT 'S' || s_suppkey AS src, 'S' || s_suppkey || '.run' AS dst, 'has_method' AS edge_type FROM supplier UNION ALL SELECT 'S' || s_suppkey, 'Runs', 'implements' FROM supplier
UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'injects' FROM supplier UNION ALL SELECT 'S' || s_suppkey || '.run', 'N' || s_nationkey || '.load', 'calls' FROM supplier""")
def graph_edges(spark, sf):
    return graph.build(*_records(spark, sf))[1]


@query("""WITH m AS (SELECT 'c' || c_custkey AS symbol, n_regionkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, r_regionkey FROM region)
SELECT symbol, min(symbol) OVER (PARTITION BY k) AS cluster FROM m""")
def graph_clusters(spark, sf):
    return graph.clusters(_fk_edges(spark, sf).filter("edge_type <> 'placed'"))


@query("SELECT n_name AS name, 's' || s_suppkey AS uid, 'supplier' AS kind, 'a' AS path, count(*) OVER (PARTITION BY n_name) > 1 AS ambiguous FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def graph_candidates(spark, sf):
    nation = table(spark, sf, "nation")
    nodes = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("uid"), F.lit("supplier").alias("kind"), F.lit("a").alias("path"))
    return graph.candidates(nodes, nation.filter("n_regionkey = 1").select(F.col("n_name").alias("name")))


def _call_edges(spark, sf) -> DataFrame:
    """Orders call customers and suppliers, these nations, these regions: two ways from an order to a region."""
    lines = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    suppliers = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst"))
    return _fk_edges(spark, sf).select("src", "dst").unionByName(lines).unionByName(suppliers)


_CALLS = f"SELECT src, dst FROM ({_EDGES}) UNION SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier"
_FLOWS = f"""e AS MATERIALIZED ({_CALLS}), w AS (
SELECT src AS entry, src AS node, [src] AS path FROM (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e))
UNION ALL SELECT entry, node, path FROM (SELECT w.entry, e.dst AS node, list_append(w.path, e.dst) AS path, row_number() OVER (PARTITION BY w.entry, e.dst ORDER BY list_append(w.path, e.dst)) AS k FROM w JOIN e ON e.src = w.node) WHERE k = 1),
f AS (SELECT entry, node AS last, arg_max(path, len(path)) AS path FROM w WHERE node NOT IN (SELECT src FROM e) AND len(path) > 1 GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_FLOWS} SELECT entry || ' > ' || last AS flow, array_to_string(path, ' > ') AS path, len(path)::INTEGER AS steps FROM f")
def graph_flows(spark, sf):
    return flows.flows(_call_edges(spark, sf)).select("flow", F.array_join("path", " > ").alias("path"), F.size("path").alias("steps"))


@query(f"""WITH RECURSIVE {_FLOWS}, r AS (SELECT 'n3' AS symbol UNION SELECT src FROM e WHERE dst = 'n3'),
s AS (SELECT entry || ' > ' || last AS flow, unnest(path) AS symbol, unnest(range(len(path)))::INTEGER AS place FROM f)
SELECT flow, count(*) AS hit, min(place)::INTEGER AS first FROM s WHERE symbol IN (SELECT symbol FROM r) GROUP BY flow""")
def graph_affected_flows(spark, sf):
    calls = _call_edges(spark, sf)
    reached = graph.impact(calls, spark.createDataFrame([("n3",)], "symbol string"), 1)
    return graph.affected_flows(reached, flows.flow_steps(flows.flows(calls)))


@query("SELECT 'c' || c_custkey AS symbol, 'out' AS direction, 'lives' AS edge_type, 'n' || c_nationkey AS uid FROM customer WHERE c_acctbal > 0")
def graph_normalised(spark, sf):
    nodes = F.array(F.struct(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("uid")))
    none = F.lit(None).cast("map<string,array<struct<uid:string>>>")
    rows = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("symbol"), F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("lives"), nodes)).alias("outgoing"), none.alias("incoming"))
    return graph.normalised(rows)


@query("SELECT 'n' || n_nationkey AS uid, n_name AS name FROM nation WHERE contains(lower(n_name), 'an')")
def graph_search(spark, sf):
    return graph.search(table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uid"), F.col("n_name").alias("name")), "AN")


# -- verification

@query("SELECT DISTINCT d.lang AS module, b.item_id::VARCHAR AS name FROM documents d JOIN benchmark b ON contains(d.text, b.item_id::VARCHAR)")
def verify_by_text(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("module"), "text")
    names = docs.select("module").distinct().join(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("name")))
    return evaluate.covered_by_text(names, docs)


@query("""WITH t AS (SELECT n_regionkey AS module, n_name AS title FROM nation), n AS (SELECT c_nationkey % 5 AS module, CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN left(n_name, 3) ELSE 'q' || c_custkey END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT module, name FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.module = n.module AND (title = name OR contains(title, name) OR contains(name, title)))""")
def verify_undocumented(spark, sf):
    nation = table(spark, sf, "nation")
    rows = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("n_name")).when(F.col("c_custkey") % 3 == 1, F.left("n_name", F.lit(3))).otherwise(F.concat(F.lit("q"), F.col("c_custkey").cast("string")))
    return evaluate.undocumented(rows.select((F.col("c_nationkey") % 5).alias("module"), name.alias("name")), nation.select(F.col("n_regionkey").alias("module"), F.col("n_name").alias("title")))


@query("SELECT o_custkey AS class_name, sum(o_custkey % 7)::BIGINT AS expected, count(*) AS covered, CASE WHEN sum(o_custkey % 7) = 0 THEN 100.0 ELSE least(floor(100.0 * count(*) / sum(o_custkey % 7) + 0.5), 100) END::DOUBLE AS coverage, CASE WHEN sum(o_custkey % 7) = 0 THEN false ELSE least(floor(100.0 * count(*) / sum(o_custkey % 7) + 0.5), 100) < 90 END AS gap FROM orders GROUP BY o_custkey")
def verify_method_index(spark, sf):
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("class_name")).agg(F.sum(F.col("o_custkey") % 7).alias("expected"), F.count("*").alias("covered"))
    return evaluate.method_coverage(sums)


@query("SELECT o_custkey AS query_id, count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('F', 'O')) / 2.0::DOUBLE AS recall FROM orders GROUP BY o_custkey")
def eval_graph_recall(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("query_id")).agg(F.collect_set("o_orderstatus").alias("shown"))
    return rows.select("query_id", evaluate.graph_recall(F.array(F.lit("F"), F.lit("O")), F.col("shown")).alias("recall"))


@query("SELECT c_custkey AS query_id, (c_acctbal > 0) AS hits_ok FROM customer WHERE c_acctbal <= 0 OR c_nationkey > 12")
def eval_regressions(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_acctbal") > 0, 1.0).otherwise(0.5).alias("hit_rate"), F.when(F.col("c_nationkey") > 12, 0.0).otherwise(1.0).alias("graph_recall"))
    return evaluate.regressions(rows).select("query_id", (F.col("hit_rate") == 1).alias("hits_ok"))


@query("SELECT doc_id AS path, unnest(['missing summary', 'unknown layer']) AS problem FROM documents WHERE source = 'src1'")
def frontmatter_problems(spark, sf):
    bad = F.col("source") == "src1"
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.when(bad, "nowhere").otherwise("domain").alias("kb_layer"), F.when(~bad, "s").alias("summary"), F.array(F.lit("a")).alias("sources"), F.array(F.lit("a")).alias("last_scan_commits"), F.lit(False).alias("stale"))
    return frontmatter.problems(rows)


# -- incremental

@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'before' ELSE 'now' END AS stale_reason, true AS stale FROM documents")
def mark_stale(spark, sf):
    english = F.col("lang") == "en"
    rows = table(spark, sf, "documents").select("doc_id", english.alias("stale"), F.when(english, "before").alias("stale_reason"))
    return incremental.mark_stale(rows, "now")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def tally(spark, sf):
    return incremental.tally(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status")))


@query("SELECT user_id AS path, arg_max(event_type, event_id) AS kind, max(event_id) AS version FROM events GROUP BY user_id")
def latest_versions(spark, sf):
    return incremental.latest(table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("kind"), F.col("event_id").alias("version")))


@query("SELECT n_name AS project, s.step, s.place::INTEGER AS place, CASE WHEN n_nationkey % 5 <> 0 OR s.place < 3 THEN 'done' WHEN s.place = 3 THEN 'failed' ELSE 'skipped' END AS status FROM nation, (SELECT unnest(['pull', 'scan', 'level2', 'vectors', 'graph']) AS step, unnest([1, 2, 3, 4, 5]) AS place) s")
def update_run(spark, sf):
    keys = {r.n_name: r.n_nationkey for r in table(spark, sf, "nation").collect()}

    def third(project: str) -> None:
        if keys[project] % 5 == 0:
            raise RuntimeError("no")

    steps = {name: third if name == "level2" else (lambda project: None) for name in update.STEPS}
    return update.run(spark, sorted(keys), steps).drop("error")


# -- index and search

@query("SELECT unnest(['code', 'business']) AS collection, item_id, 1 AS line_start, len(string_split(text, chr(10)))::INTEGER AS line_end FROM benchmark")
def index_code_and_business(spark, sf):
    rows = table(spark, sf, "benchmark")
    sides = [rows.select(F.concat(F.lit(f"{folder}/"), F.col("item_id").cast("string"), F.lit(end)).alias("path"), F.col("text").alias("content")) for folder, end in (("src", ".java"), ("docs", ".md"))]
    found = indexing.code_and_business(*sides)
    return found.select("collection", F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("item_id"), "line_start", "line_end")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'someone' || o_custkey % 3 END AS author FROM orders")
def hits_with_authors(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("file_path"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("行号：**"), F.lit(""))).otherwise("").alias("_x"), F.concat(F.when(F.col("o_orderstatus") == "F", "行号：").otherwise("line "), (F.col("o_custkey") % 3 + 1).cast("string")).alias("snippet")).drop("_x")
    sources = rows.select("file_path", F.lit("a.java").alias("source"))
    blame = spark.createDataFrame([("a.java", i + 1, f"someone{i}") for i in range(3)], "path string, line int, author string")
    return vector.with_authors(rows, sources, blame).select("o_orderkey", "author")


@query("SELECT o_custkey AS query_id, list(o_orderkey ORDER BY o_orderkey)[1] AS first_hit, count(*)::INTEGER AS hits, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END AS groups FROM orders GROUP BY o_custkey")
def hybrid_merged(spark, sf):
    hits = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rank"), F.col("o_orderkey").cast("string").alias("file_path"), F.lit("h").alias("heading"), F.lit(0.5).alias("score"))
    context = hits.filter("query_id % 2 = 0").select("query_id", F.lit("f").alias("file_path"), F.lit("S").alias("symbol"), F.lit("calls").alias("edge_type"), F.lit("T").alias("neighbour")).distinct()
    merged = hybrid.merged(hits, context)
    return merged.select("query_id", F.col("hits")[0]["rank"].alias("first_hit"), F.size("hits").alias("hits"), F.size("graph_context").alias("groups"))


@query("SELECT doc_id, nullif(lang, 'en') AS heading, 0.5::DOUBLE AS score FROM documents")
def hybrid_cleaned(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.lit(0.5).alias("score"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("heading"), F.lit("x").alias("more"))
    return hybrid.cleaned(rows).withColumnRenamed("query_id", "doc_id")


# -- rendering

_NL = "chr(10)"


def _page_sql(title: str, head: list[str], line: str, order: str, rows: str, group: str, key: str) -> str:
    top = f"'| {' | '.join(head)} |' || {_NL} || '|{'---|' * len(head)}' || {_NL}"
    return f"SELECT {group} AS {key}, '# ' || {title} || {_NL} || {_NL} || {top} || string_agg({line}, {_NL} ORDER BY {order}) || {_NL} AS body FROM {rows} GROUP BY {group}"


@query(_page_sql("p_brand", ["method", "decisions"], "'| ' || m || ' | ' || p_size || ' |'", "p_size DESC, m COLLATE \"binary\"", "(SELECT p_brand, 'm' || p_partkey AS m, p_size FROM part)", "p_brand", "class_name"))
def render_rules(spark, sf):
    return render.rules(table(spark, sf, "part").select(F.col("p_brand").alias("class_name"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("method_name"), F.col("p_size").alias("decision_points")))


@query(f"""WITH c AS (SELECT d.lang AS k, count(*) AS e, count(l.doc_id) AS v, string_agg(CASE WHEN l.doc_id IS NULL THEN '- d' || d.doc_id END, {_NL} ORDER BY ('d' || d.doc_id) COLLATE "binary") AS gone FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.lang)
SELECT k AS "check", '# ' || k || {_NL} || {_NL} || 'covered ' || v || ' of ' || e || ' (' || floor(100.0 * v / e + 0.5)::INTEGER || ' %)' || coalesce({_NL} || {_NL} || gone, '') AS body FROM c""")
def render_verify_report(spark, sf):
    docs, labels = table(spark, sf, "documents").select(F.col("lang").alias("check"), "doc_id"), table(spark, sf, "labels")
    missing = evaluate.gaps(docs, labels, ["doc_id"]).select("check", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"))
    return render.verify_report(evaluate.coverage(docs, labels, ["doc_id"]), missing)


def _by_nation(spark, sf, **columns) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    shown = {"number": key, "name": F.col("s_name"), "file": F.concat(F.lit("a/"), key)}
    return table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("module"), *(shown[v].alias(k) for k, v in columns.items()))


_SUPPLIERS = "(SELECT s_nationkey::VARCHAR AS module, s_suppkey::VARCHAR AS number, s_name AS name, 'a/' || s_suppkey AS file FROM supplier)"


@query(_page_sql("module", ["route", "file"], "'| ' || name || ' | ' || file || ' |'", 'name COLLATE "binary", file COLLATE "binary"', _SUPPLIERS, "module", "module"))
def render_routes(spark, sf):
    return render.routes(_by_nation(spark, sf, route="name", path="file"))


@query(_page_sql("module", ["address", "file"], "'| ' || name || ' | ' || file || ' |'", 'name COLLATE "binary", file COLLATE "binary"', _SUPPLIERS, "module", "module"))
def render_api_calls(spark, sf):
    return render.api_calls(_by_nation(spark, sf, url="name", path="file"))


@query(_page_sql("module", ["page", "files"], "'| ' || name || ' | ' || number || ' |'", 'name COLLATE "binary"', _SUPPLIERS, "module", "module"))
def render_pages(spark, sf):
    return render.pages(_by_nation(spark, sf, page="name", file_count="number"))


@query(_page_sql("module", ["store", "file"], "'| ' || name || ' | ' || file || ' |'", 'name COLLATE "binary", file COLLATE "binary"', _SUPPLIERS, "module", "module"))
def render_stores(spark, sf):
    return render.stores(_by_nation(spark, sf, store="name", path="file"))


@query(_page_sql("r_name", ["target", "mode", "via"], "'| ' || n_name || ' | direct |  |'", 'n_name COLLATE "binary"', "nation JOIN region ON n_regionkey = r_regionkey", "r_name", "source"))
def render_topology(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = graph.topology(rows.select(F.lit(None).cast("string").alias("app"), F.col("r_name").alias("frontend"), F.col("n_name").alias("backend"), F.lit(None).cast("string").alias("gateway"), F.lit(None).cast("string").alias("mode")))
    return render.topology(edges.withColumn("via", F.coalesce("via", F.lit(""))))


@query(_page_sql("'GET'", ["function", "flow", "words"], "'| get' || s_suppkey || ' | /' || s_name || ' | 2 |'", "('get' || s_suppkey) COLLATE \"binary\"", "(SELECT s_suppkey, s_name, 'GET' AS verb FROM supplier)", "verb", "http_method"))
def render_backend_map(spark, sf):
    return render.backend_map(table(spark, sf, "supplier").select(F.lit("GET").alias("http_method"), F.concat(F.lit("get"), F.col("s_suppkey").cast("string")).alias("function_name"), F.concat(F.lit("/"), F.col("s_name")).alias("flow_path"), F.lit(2).alias("matched")))


@query("SELECT c_custkey, 'flow ' || c_name || ': ' || c_nationkey AS summary FROM customer")
def render_summary(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", render.summary("flow", F.col("c_name"), F.col("c_nationkey")).alias("summary"))


@query(f"""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), f AS (SELECT source, min(lang) AS name FROM documents WHERE source <> 'src1' GROUP BY source)
SELECT source AS module, '# ' || source || {_NL} || {_NL} || '| layer | documents |' || {_NL} || '|---|---|' || {_NL} || string_agg('| ' || lang || ' | ' || n || ' |', {_NL} ORDER BY lang) || {_NL} || coalesce({_NL} || 'main flow: ' || any_value(name), '') AS body FROM n LEFT JOIN f USING (source) GROUP BY source""")
def render_entry_document(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("module"), F.col("lang").alias("kb_layer"))
    main = docs.filter("module <> 'src1'").groupBy("module").agg(F.min("kb_layer").alias("name"))
    return render.entry_document(docs, main)


@query("SELECT source AS module, '- [' || source || '](' || source || '/index.md): ' || count(*) || ' documents in ' || count(DISTINCT lang) || ' layers' AS entry FROM documents GROUP BY source")
def render_global_index(spark, sf):
    return render.global_index(table(spark, sf, "documents").select(F.col("source").alias("module"), F.col("lang").alias("kb_layer")))


@query("SELECT '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS json FROM customer")
def rows_as_json(spark, sf):
    return render.as_json(table(spark, sf, "customer"), ["c_custkey", "c_name"])


@query("SELECT 1::BIGINT AS n, chr(10) || 'stateDiagram' AS part")
def render_state_machine(spark, sf):
    rows = table(spark, sf, "orders").select(F.lit("any").alias("from_status"), F.col("o_orderstatus").alias("to_status"), F.lit("go").alias("method_name")).filter("to_status = 'F'")
    page = render.state_machine(rows, "orders")
    return page.select("n", F.when(F.contains("body", F.lit("any --> F: go")) & F.contains("body", F.lit("| any | F | go |")), F.regexp_extract("body", r"(\nstateDiagram)", 1)).alias("part"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS lines FROM documents")
def method_parts_of_plain_text(spark, sf):
    """Text in a language without headers is one part, whatever its length."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    parts = chunk.method_parts(rows, text_col="text")
    return parts.select(F.col("path").cast("long").alias("doc_id"), (F.col("line_end") - F.col("line_start") + 1).alias("lines"))


@query("SELECT doc_id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))::INTEGER AS n FROM documents")
def text_stripped(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(tx.strip(F.col("text"))).alias("n"))
