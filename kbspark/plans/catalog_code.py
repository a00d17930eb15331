"""Further registered queries: what version control and a paged service tell, the incremental store, names in
texts, scopes, and what a configuration says."""

from __future__ import annotations

import glob

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluate, extract, graph, hierarchy, render, requirements, vector
from ..sources import indented, paged, versioned
from ..sources.store import Store
from ..sources.tables import settled, table, working_folder
from .catalog import _EVAL, _RANKED, _asked, _eval_rows, _fk_edges, query

# -- version control

def _diffs(spark, sf) -> DataFrame:
    """A commit for each order: a diff of one file, with a hunk for each of its lines of goods. Line n of an order takes away
    one line at 100 n and brings as many as its quantity's last digit, after three lines of context."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.pmod(F.col("l_quantity").cast("int"), F.lit(10)).alias("q"))
    before = F.coalesce(F.sum(F.col("q") - 1).over(Window.partitionBy("l_orderkey").orderBy("n", "q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", (F.col("n") * 100 + before).cast("string"))
    hunk = F.concat(F.lit("@@ -"), (F.col("n") * 100).cast("string"), F.lit(",4 +"), F.col("start"), F.lit(","), (F.col("q") + 3).cast("string"), F.lit(" @@\n one\n two\n three\n--- gone\n"), F.repeat(F.lit("++ new\n"), F.col("q")))
    each = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "q", hunk.alias("h")))), lambda x: x["h"]), "").alias("h"))
    name = F.concat(F.lit("src/O"), F.col("l_orderkey").cast("string"), F.lit(".java"))
    return each.select(F.col("l_orderkey").alias("commit_no"), F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name, F.lit("\nindex 1..2 100644\n--- a/"), name, F.lit("\n+++ b/"), name, F.lit("\n"), F.col("h")).alias("content"))


_ADDED = """SELECT 'src/O' || l_orderkey || '.java' AS path, l_linenumber AS n, (l_quantity::INTEGER % 10) AS q, l_linenumber * 100 + coalesce(sum(l_quantity::INTEGER % 10 - 1) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::INTEGER % 10 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lineitem"""


@query(f"SELECT path, 'new' AS side, (start + 3 + i)::INTEGER AS line FROM (SELECT *, unnest(range(q)) AS i FROM ({_ADDED})) UNION ALL SELECT path, 'old', (n * 100 + 3)::INTEGER FROM ({_ADDED})")
def diff_changed_lines(spark, sf):
    return versioned.changes(_diffs(spark, sf).select("content"), side="both")


@query("SELECT DISTINCT l_orderkey AS commit_no, 'src/O' || l_orderkey || '.java' AS path, 'modified' AS status FROM lineitem")
def diff_files(spark, sf):
    return versioned.changed_files(_diffs(spark, sf)).drop("old_path")


@query(f"""WITH a AS (SELECT path, (start + 3 + unnest(range(q)))::INTEGER AS line FROM ({_ADDED})),
m AS (SELECT DISTINCT path, 'm' || k AS symbol, 150 * k - 149 AS lo, CASE WHEN k % 2 = 0 THEN 150 * k ELSE 150 * k + 200 END AS hi FROM ({_ADDED}), range(1, 6) t(k))
SELECT a.path, symbol, count(*) AS changed_lines FROM a JOIN m ON m.path = a.path AND line BETWEEN lo AND hi GROUP BY ALL""")
def diff_symbols(spark, sf):
    """Diff text in, affected methods out; methods overlap, as inner classes' do."""
    diffs = _diffs(spark, sf)
    k = F.explode(F.sequence(F.lit(1), F.lit(5)))
    methods = table(spark, sf, "lineitem").select(F.concat(F.lit("src/O"), F.col("l_orderkey").cast("string"), F.lit(".java")).alias("path")).distinct().withColumn("k", k)
    methods = methods.select("path", F.concat(F.lit("m"), F.col("k").cast("string")).alias("symbol"), (F.col("k") * 150 - 149).alias("line_start"), F.when(F.col("k") % 2 == 0, F.col("k") * 150).otherwise(F.col("k") * 150 + 200).alias("line_end"))
    return graph.changed_symbols(versioned.changes(diffs.select("content")), methods)


def _blames(spark, sf) -> DataFrame:
    """A porcelain blame for each supplier: a line for each part that it delivers, in order; the commit is the part's brand, and
    of a commit that was there before only the header comes again."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    place = Window.partitionBy("l_suppkey").orderBy("l_partkey")
    rows = rows.withColumns({"n": F.row_number().over(place), "seen": F.row_number().over(Window.partitionBy("l_suppkey", "p_brand").orderBy("l_partkey"))})
    number = F.concat(F.col("l_partkey").cast("string"), F.lit(" "), F.col("n").cast("string"))
    told = F.concat(F.lit("author "), F.col("p_brand"), F.lit("\nauthor-mail <x@y>\nauthor-time 17\nsummary author of nothing\nfilename f.java\n"))
    entry = F.concat(F.sha1(F.col("p_brand").cast("binary")), F.lit(" "), number, F.lit(" 1\n"), F.when(F.col("seen") == 1, told).otherwise(F.lit("")), F.lit("\tauthor Nobody\n"))
    each = rows.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))), lambda x: x["e"]), "").alias("content"))
    return each.select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("path"), "content")


@query("SELECT 'S' || l_suppkey AS path, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey)::INTEGER AS line, l_partkey::INTEGER AS source_line, p_brand AS author, 17::BIGINT AS author_time FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey")
def blame_authors(spark, sf):
    return versioned.blame_lines(_blames(spark, sf)).select("path", "line", "source_line", "author", "author_time")


# -- a paged service

@query("SELECT 'Route:' || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'POST' END || ' /s/' || s_suppkey AS id, '/s/' || s_suppkey AS route, CASE WHEN s_suppkey % 3 = 0 THEN 'GET' ELSE 'POST' END AS http_method, 'N' || s_nationkey AS file_path, '' AS handler FROM supplier")
def paged_routes(spark, sf):
    """A graph service's routes by pages. The double answers from a file that holds a table's rows in order, as a service
    would from its own store."""
    folder = working_folder(spark)
    row = F.concat_ws("|", F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, "").otherwise("POST"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")))
    table(spark, sf, "supplier").orderBy("s_suppkey").select(row.alias("value")).coalesce(1).write.text(folder)
    place = folder.removeprefix("file:")

    def run(text: str) -> str:
        with open(glob.glob(f"{place}/part-*")[0]) as file:
            rows = file.read().splitlines()
        if "count(" in text:
            return f"| count |\n| --- |\n| {len(rows)} |"
        skip, limit = (int(text.split(f"{word} ")[1].split()[0]) for word in ("SKIP", "LIMIT"))
        own = "\n".join("| /s/{} | {} | {} |  |".format(*r.split("|")) for r in rows[skip : skip + limit])
        return f"| name | method | file | handler |\n| --- | --- | --- | --- |\n{own}"

    return paged.paged(spark, paged.route_source("kb_routes", run))


# -- the incremental store

@query("SELECT o_orderkey AS path, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderstatus END AS content FROM orders WHERE o_orderkey % 11 <> 0")
def store_batches(spark, sf):
    """All orders, then newer versions of some, then older ones, which change nothing, and some keys taken out."""
    store = Store(spark, working_folder(spark), "path long, version long, content string", version="version", buckets=8)
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.lit(1).cast("long").alias("version"), F.col("o_orderstatus").alias("content"))
    some = rows.filter("path % 7 = 0")
    store.upsert(rows)
    store.upsert(some.withColumns({"version": F.lit(2).cast("long"), "content": F.lit("new")}))
    store.upsert(some.withColumn("content", F.lit("late")))
    store.upsert(rows.limit(0), rows.filter("path % 11 = 0").select("path"))
    return store.read()


# -- scopes and overloads

_LINES = "SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) > 25 AS mapped FROM lineitem GROUP BY ALL"


@query(f"SELECT 'O' || k || '.java' AS path, 'O' || k AS class_name, 'load' AS method_name, 'GET' AS http_method, '/o' || k || '/l' || n AS endpoint, n::VARCHAR AS body FROM ({_LINES}) WHERE mapped")
def extract_controller_overloads(spark, sf):
    """A controller for each order; its lines are overloads of one method, some without a mapping or private."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("k"), F.col("l_linenumber").alias("n")).agg((F.max("l_quantity") > 25).alias("mapped"))
    n = F.col("n").cast("string")
    mark = F.when(F.col("mapped"), F.concat(F.lit('  @GetMapping("/l'), n, F.lit('")\n  public'))).otherwise(F.lit("  private"))
    method = F.concat(mark, F.lit(" R load(int a"), n, F.lit(") {\n    if (a > 0) { call(); }\n    return "), n, F.lit(";\n  }\n"))
    each = rows.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", method.alias("m")))), lambda x: x["m"]), "\n").alias("m"))
    files = each.select(F.concat(F.lit("O"), "k", F.lit(".java")).alias("path"), F.concat(F.lit('@RequestMapping("/o'), "k", F.lit('")\npublic class O'), "k", F.lit(" {\n"), "m", F.lit("}\n")).alias("content"))
    found = extract.controller_methods(files)
    return found.select("path", "class_name", "method_name", "http_method", "endpoint", F.regexp_extract("body", r"return (\d+)", 1).alias("body"))


# -- hierarchies

def _types(spark, sf):
    """Regions are interfaces, nations are interfaces below them with an abstract base, suppliers are classes; the even
    nations also have a class of the usual name, which the base's own class extends."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_regionkey").cast("string").alias("r"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    line = lambda *parts: F.concat(*(F.lit(p) if i % 2 == 0 else F.col(p) for i, p in enumerate(parts)))
    own = nation.select(line("N", "n", ".java").alias("path"), F.concat(line("package a;\npublic interface N", "n", "<T extends List<T>>\n    extends Marker, R", "r", " {\n}\n"), line("abstract class BaseN", "n", " implements N", "n", "<Map<String, Long>> { // class no extends X {\n}\n"), F.when(F.col("even"), line("final class N", "n", "Impl extends a.BaseN", "n", " { }\n")).otherwise("")).alias("content"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("s"), F.col("s_nationkey").cast("string").alias("n"))
    return own.unionByName(suppliers.select(line("S", "s", ".java").alias("path"), line("public class S", "s", " extends BaseN", "n", "\n  implements java.io.Serializable {\n}").alias("content")))


_BELOW = """SELECT 'N' || n_nationkey AS interface, 'S' || s_suppkey AS class_name, 2 AS distance FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 'R' || n_regionkey, 'S' || s_suppkey, 3 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'Marker', 'S' || s_suppkey, 3 FROM supplier UNION ALL SELECT 'Serializable', 'S' || s_suppkey, 1 FROM supplier
UNION ALL SELECT 'N' || n_nationkey, 'N' || n_nationkey || 'Impl', 2 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey || 'Impl', 3 FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'Marker', 'N' || n_nationkey || 'Impl', 3 FROM nation WHERE n_nationkey % 2 = 0"""


@query(_BELOW)
def implementations_below(spark, sf):
    return hierarchy.implementations(hierarchy.types(_types(spark, sf)))


@query(f"SELECT interface, class_name FROM ({_BELOW}) QUALIFY row_number() OVER (PARTITION BY interface ORDER BY (class_name = interface || 'Impl') DESC, distance, class_name) = 1")
def implementation_chosen(spark, sf):
    return hierarchy.ranked(hierarchy.implementations(hierarchy.types(_types(spark, sf)))).filter("place = 0").select("interface", "class_name")


# -- configuration

@query("SELECT 'q' || o_orderkey AS path, 0 AS query_id, 'order \"' || o_orderkey || '\": all' AS query, ['c' || o_custkey, o_orderstatus] AS expected_hits, 's # ' || o_orderkey AS symbol, o_orderkey % 2 = 0 AS verify_provenance FROM orders UNION ALL SELECT 'q' || o_orderkey, 1, 'plain', [], NULL, false FROM orders")
def golden_sets(spark, sf):
    """A golden set for each order, in the shape that the evaluation reads: quoted and plain scalars, lists and maps in lists."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.concat(F.lit('# a set\n\n- query: "order \\"'), k, F.lit('\\": all"\n  last_verified_commit: "fc2c267"   # checked\n  expected_hits:\n    - "c'), c, F.lit('"\n    - '), F.col("o_orderstatus"), F.lit("\n  expected_graph_symbols:\n    - symbol: 's # "), k, F.lit("'\n      from_file: a/b.md\n  verify_provenance: "), F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false"), F.lit("\n\n- query: plain\n  expected_hits: []\n"))
    found = indented.golden_sets(table(spark, sf, "orders").select(F.concat(F.lit("q"), k).alias("path"), text.alias("content")))
    return found.select("path", "query_id", "query", "expected_hits", F.get("expected_graph_symbols", F.lit(0))["symbol"].alias("symbol"), "verify_provenance")


# -- requirements

@query("""SELECT 'f' || o_orderkey AS flow, 'o' || o_orderkey AS entry, 'S' || (o_orderkey % 4) AS to_status, o_orderkey % 4 = c_nationkey % 4 AS in_code FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'f' || o_orderkey, 'o' || o_orderkey, 'LOW', c_acctbal < 0 FROM orders JOIN customer ON o_custkey = c_custkey""")
def transitions_in_code(spark, sf):
    """Orders are flows that reach a customer, which may set LOW, and its nation, which sets one of four."""
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    entry = F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))
    claimed = orders.select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("flow"), entry.alias("entry"), F.explode(F.array(F.concat(F.lit("S"), (F.col("o_orderkey") % 4).cast("string")), F.lit("LOW"))).alias("to_status"))
    sets = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("symbol"), F.concat(F.lit("S"), (F.col("n_nationkey") % 4).cast("string")).alias("to_status"))
    sets = sets.unionByName(customer.filter("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("symbol"), F.lit("LOW").alias("to_status")))
    return requirements.transitions_in_code(claimed, _fk_edges(spark, sf), sets)


@query(f"""SELECT query_id AS method, 'v' || vec_id AS section, 'recall.md' AS file, rank::INTEGER AS rank, 'recall' AS origin FROM ({_RANKED}) WHERE rank <= 3 AND score >= 0.35 AND query_id % 60 <> 0
UNION ALL SELECT vec_id, 'l' || label, 'map.md', 1, 'mapping' FROM embeddings WHERE vec_id % 60 = 0 UNION ALL SELECT vec_id, 'x', 'map.md', 2, 'mapping' FROM embeddings WHERE vec_id % 60 = 0""")
def requirements_paired(spark, sf):
    """The three nearest vectors of each asked one, but for those that a mapping names."""
    vectors = table(spark, sf, "embeddings")
    hits = vector.top_k_batch(vectors, _asked(spark, sf))
    recalled = hits.select(F.col("query_id").alias("method"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("section"), F.lit("recall.md").alias("file"), "rank")
    named = vectors.filter("vec_id % 60 = 0").select(F.col("vec_id").alias("method"), F.explode(F.array(F.concat(F.lit("l"), F.col("label").cast("string")), F.lit("x"))).alias("section"), F.lit("map.md").alias("file"))
    return requirements.paired(recalled, named)


@query(f"""WITH {_EVAL}, r AS (SELECT query_id::VARCHAR AS query, hit_rate::DOUBLE AS hit_rate, mrr FROM m),
t AS (SELECT round(100 * floor(avg(hit_rate) * 1000 + 0.5) / 1000, 1) AS h, round(100 * floor(avg(mrr) * 1000 + 0.5) / 1000, 1) AS m, count(*) AS n, count(*) FILTER (WHERE query::BIGINT % 40 = 0) AS s FROM r)
SELECT 1 AS section, unnest(['| Hit Rate | ' || printf('%.1f', h) || '% |', '| MRR | ' || printf('%.1f', m) || '% |', '| Graph Recall | 100.0% |', '| Provenance Accuracy | 100.0% |', '| Total Queries | ' || n || ' |', '| Stale Queries | ' || s || ' |']) AS line FROM t
UNION ALL SELECT 2, '| ' || query || ' | ' || printf('%.0f', hit_rate * 100) || '% | 100% | hits |' FROM r WHERE hit_rate < 1
UNION ALL SELECT 3, '- **S** expected under `f.md` — not found: ' || query FROM r WHERE query::BIGINT % 100 = 0 UNION ALL SELECT 4, '| ' || query || ' | `gone.md` |' FROM r WHERE query::BIGINT % 40 = 0""")
def eval_report_lines(spark, sf):
    """The rows are written once: each section would search again."""
    each = _eval_rows(spark, sf).select("query_id", F.col("query_id").cast("string").alias("query"), evaluate.hit_rate(F.col("expected"), F.col("actual")).alias("hit_rate"), evaluate.reciprocal_rank(F.col("expected"), F.col("actual")).alias("mrr"), F.lit(1.0).alias("graph_recall"), F.lit(None).cast("double").alias("provenance"), (F.col("query_id") % 40 == 0).alias("stale"))
    each = settled(each)
    shown = each.filter("query_id % 100 = 0").select("query", F.lit("S").alias("symbol"), F.lit("f.md").alias("from_file"), F.lit(False).alias("ok"))
    gone = each.filter("stale").select("query", F.lit("gone.md").alias("file_path"))
    return render.eval_lines(evaluate.summary(each), each, shown, gone).select("section", "line")
