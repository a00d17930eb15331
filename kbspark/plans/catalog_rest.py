"""Queries for renderers, extractors and text functions that no other query reaches; their texts are written from tables
that grow, and their SQL reads the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import chunk, extract, graph, render
from ..sources.tables import table
from .catalog import query


def _joined(*parts: str) -> Column:
    """Literals and columns in turn."""
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.col(p).cast("string") for i, p in enumerate(parts)))


def _page(title: str, columns: list[str], line: str, order: str, source: str, before: str = "''") -> str:
    """SQL of a page with a table: a line for each row of a group."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return f"SELECT t AS class_name, '# ' || t || chr(10) || chr(10) || {before} || '{head}' || string_agg({line}, chr(10) ORDER BY {order}) || chr(10) AS body FROM (SELECT *, {title} AS t FROM {source}) GROUP BY t"


@query(_page("p_brand", ["field", "column", "type", "comment"], "'| f' || p_partkey || ' | c' || p_size || ' | ' || p_type || ' | a \\| b |'", "'f' || p_partkey", "part", "'table: t' || t || chr(10) || chr(10)"))
def render_entities(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("class_name"), _joined("t", "p_brand").alias("table_name"), _joined("f", "p_partkey").alias("field"), _joined("c", "p_size").alias("column_name"), F.col("p_type").alias("type"), F.lit("a | b").alias("comment"))
    return render.entities(rows)


@query(_page("'C' || s_nationkey", ["method", "path", "name", "returns", "parameters", "comment"], "'| GET | /s/' || s_suppkey || ' | m' || s_suppkey || ' | R | int a |  |'", "'/s/' || s_suppkey", "supplier"))
def render_contracts(spark, sf):
    rows = table(spark, sf, "supplier").select(_joined("C", "s_nationkey").alias("class_name"), F.lit("GET").alias("http_method"), _joined("/s/", "s_suppkey").alias("endpoint"), _joined("m", "s_suppkey").alias("method_name"), F.lit("R").alias("return_type"), F.lit("int a").alias("params"), F.lit(None).cast("string").alias("comment"))
    return render.contracts(rows)


@query(_page("'o' || l_orderkey", ["depth", "service", "method", "via"], "'| ' || d || ' | S' || s || ' | m' || n || ' |  |'", "d, 'S' || s, 'm' || n", "(SELECT DISTINCT l_orderkey, l_linenumber % 2 + 1 AS d, l_suppkey AS s, l_linenumber AS n FROM lineitem)").replace("AS class_name", "AS entry"))
def render_flows(spark, sf):
    rows = table(spark, sf, "lineitem").select(_joined("o", "l_orderkey").alias("entry"), (F.col("l_linenumber") % 2 + 1).alias("depth"), _joined("S", "l_suppkey").alias("service"), _joined("m", "l_linenumber").alias("callee"), F.lit(None).cast("string").alias("via")).distinct()
    return render.flows(rows)


@query("""WITH p AS (SELECT 'C' || s_nationkey AS c, '| m' || s_suppkey || ' | R |  | 3 |' AS l, s_suppkey AS k FROM supplier), s AS (SELECT c, '## ' || c || chr(10) || chr(10) || '| method | returns | parameters | lines |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg(l, chr(10) ORDER BY k) || chr(10) AS s, count(*) AS n FROM p GROUP BY c)
SELECT '# m methods' || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY c) AS body, sum(n)::BIGINT AS n FROM s""")
def render_method_index(spark, sf):
    rows = table(spark, sf, "supplier").select(_joined("C", "s_nationkey").alias("class_name"), _joined("m", "s_suppkey").alias("method_name"), F.lit("R").alias("return_type"), F.lit("").alias("params"), F.lit(3).alias("body_lines"), F.col("s_suppkey").alias("line_start"))
    return render.method_index(rows, "m")


@query("""WITH s AS (SELECT 'o' || l_orderkey AS entry, string_agg('part ' || l_partkey, chr(10) ORDER BY 'part ' || l_partkey) AS s FROM lineitem GROUP BY 1)
SELECT 'o' || o_orderkey AS entry, 'body ' || o_orderkey || chr(10) || chr(10) || substr(coalesce(s || '', ''), 1, 3000) || CASE WHEN s IS NULL THEN '' ELSE chr(10) || chr(10) END || 'enums' || chr(10) || chr(10) || repeat('e', 1500) AS prompt FROM orders LEFT JOIN s ON s.entry = 'o' || o_orderkey""")
def render_prompts(spark, sf):
    bodies = table(spark, sf, "orders").select(_joined("o", "o_orderkey").alias("entry"), _joined("body ", "o_orderkey").alias("body"))
    services = table(spark, sf, "lineitem").select(_joined("o", "l_orderkey").alias("entry"), _joined("part ", "l_partkey").alias("text"))
    one = table(spark, sf, "region").limit(1)
    return render.prompts(bodies, services, one.select(F.lit("enums").alias("text")), one.select(F.lit("e" * 2000).alias("text")))


# -- extractors

@query("SELECT 'b' || o_orderkey || '.ts' AS path, unnest(['SAVE', 'OLD_' || o_custkey]) AS name, unnest(['s' || o_orderkey, 'old']) AS code FROM orders")
def extract_buttons(spark, sf):
    text = _joined("export const SAVE = 's", "o_orderkey", "'\nOLD_", "o_custkey", " = 'old'\n// MARKER\nDROP = 'd'")
    return extract.buttons(table(spark, sf, "orders").select(_joined("b", "o_orderkey", ".ts").alias("path"), text.alias("content")), "// MARKER")


@query("""SELECT 'o' || l_orderkey || '.ts' AS path, 'Api' || l_linenumber AS api, '/x/key/' || l_linenumber AS api_path, unnest([0, 1])::INTEGER AS place, unnest(['id', 'f' || l_linenumber]) AS field, unnest(['number', 'string[]']) AS type
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nth FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE nth % 2 = 1 AND l_linenumber % 3 <> 0""")
def extract_api_types(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().withColumn("word", F.when(F.col("l_linenumber") % 3 == 0, "other").otherwise("key"))
    one = _joined("/** what\n * 接口路径：/x/", "word", "/", "l_linenumber", "\n */\nexport namespace Api", "l_linenumber", " {\n  export interface Req {\n    id?: number;\n    f", "l_linenumber", ": string[];\n  }\n}\n")
    files = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    return extract.api_types(files.select(_joined("o", "l_orderkey", ".ts").alias("path"), "content"), "key")


@query("""SELECT 'form' || o_orderkey AS component, 'hidden' AS kind, 'a.b > ' || o_custkey AS condition, ['x' || o_orderkey, 'y'] AS fields FROM orders UNION ALL SELECT 'form' || o_orderkey, 'disabled', 'editType', ['z' || o_custkey] FROM orders
UNION ALL SELECT 'form' || o_orderkey, 'dynamic-required', 'requiredFieldList', ['r' || o_orderkey] FROM orders""")
def extract_linkage_rules(spark, sf):
    text = _joined("const hiddenFields = useMemo(() => {\n  if (a.b > ", "o_custkey", ") { return ['x", "o_orderkey", "', 'y'] }\n}, [a])\ndisabledFields: ['z", "o_custkey", "']\nrequiredFieldMap.r", "o_orderkey", " requiredFieldMap.r", "o_orderkey", "")
    return extract.linkage_rules(table(spark, sf, "orders").select(_joined("src/form", "o_orderkey", "/index.tsx").alias("path"), text.alias("content")))


@query("""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))
SELECT 'O' || k || '.java' AS path, (3 * p - 1)::INTEGER AS line_start, (3 * p + 1)::INTEGER AS line_end, 'm' || n AS method_name FROM l UNION ALL SELECT DISTINCT 'O' || k || '.java', 1, 1, NULL FROM l""")
def method_parts_at_headers(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    one = _joined("  public R m", "l_linenumber", "(int a) {\n    x = ", "l_linenumber", ";\n  }")
    files = rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", one.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    return chunk.method_parts(files.select(_joined("O", "l_orderkey", ".java").alias("path"), _joined("class O", "l_orderkey", " {\n", "t").alias("content"))).drop("text")


@query("""WITH f AS (SELECT s_nationkey::VARCHAR AS module, 'get' || l_suppkey AS caller, count(DISTINCT l_partkey) AS fan_out FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 5)
SELECT module, caller, fan_out, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY fan_out DESC, caller) AS rank FROM f) WHERE rank <= 2""")
def graph_high_fanout_any_name(spark, sf):
    """Accessors, too, as pages and components have them."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.high_fan_out(rows.select(F.col("s_nationkey").cast("string").alias("module"), _joined("get", "l_suppkey").alias("caller"), F.col("l_partkey").alias("callee")), skip=None)


# -- text functions

@query("""WITH w AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT k, a || '_' || b AS snake, a || '-' || b AS kebab, upper(substr(a, 1, 1)) || substr(a, 2) || upper(substr(b, 1, 1)) || substr(b, 2) AS camel, a || '/' || b || '.md' AS path, b || '.md' AS base, '.md' AS ext, upper(substr(b, 1, 1)) || substr(b, 2) AS class_name, 'load' || k AS handler, CASE WHEN length(a || b) > 10 THEN substr(a || b, 1, 7) || '...' ELSE a || b END AS short FROM w""")
def text_names(spark, sf):
    words = F.split("p_name", " ")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), words[0].alias("a"), words[1].alias("b"))
    camel = F.concat(F.initcap("a"), F.initcap("b"))
    path = tx.normal_path(_joined("./x/../", "a", "//", "b", ".md"))
    return rows.select("k", tx.camel_to_snake(camel).alias("snake"), tx.camel_to_kebab(F.concat(camel, F.lit("Enum")), "Enum").alias("kebab"), tx.kebab_to_camel(_joined("", "a", "-", "b")).alias("camel"), path.alias("path"), tx.basename(path).alias("base"), tx.extension(path).alias("ext"), tx.class_of_path(F.concat(F.lit("s/"), F.initcap("b"), F.lit(".java"))).alias("class_name"), tx.handler_method(_joined("A.load", "k", "#3")).alias("handler"), tx.ellipsis(F.concat("a", "b"), 10).alias("short"))


@query("SELECT o_orderkey AS k, 'text ' || o_orderkey AS body, o_orderkey AS nodes, 1000000 + o_custkey AS edges FROM orders")
def service_answers(spark, sf):
    """Answers without their fence, and counts with separators for thousands."""
    rows = table(spark, sf, "orders")
    stats = extract.graph_stats(F.concat(F.format_number("o_orderkey", 0), F.lit(" nodes, "), F.format_number(F.col("o_custkey") + 1000000, 0), F.lit(" edges")))
    return rows.select(F.col("o_orderkey").alias("k"), extract.unfenced(_joined("\n```markdown\ntext ", "o_orderkey", "\n```\n")).alias("body"), stats["nodes"].alias("nodes"), stats["edges"].alias("edges"))


@query("""WITH e AS (SELECT DISTINCT prev AS a, event_type AS b, 'on' || (user_id % 3) AS m FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL),
w AS (SELECT '    ' || a || ' --> ' || b || ': ' || m AS x, '| ' || a || ' | ' || b || ' | ' || m || ' |' AS y FROM e)
SELECT '# events' || chr(10) || chr(10) || '```mermaid' || chr(10) || 'stateDiagram-v2' || chr(10) || string_agg(x, chr(10) ORDER BY x) || chr(10) || '```' || chr(10) || chr(10) || '| from | to | method |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(y, chr(10) ORDER BY y) || chr(10) AS body, count(*) AS n FROM w""")
def render_event_machine(spark, sf):
    """The machine that the events' types are the states of."""
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").select(before.alias("from_status"), F.col("event_type").alias("to_status"), F.concat(F.lit("on"), (F.col("user_id") % 3).cast("string")).alias("method_name"))
    return render.state_machine(rows.filter("from_status is not null"), "events")
