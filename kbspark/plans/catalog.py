"""The registered queries of the library's operators, bound to the test tables, and their SQL.

Where the tables hold no source code, the text is written from table rows first and then read back by
the operator; its SQL reads the table, never the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.vectors import cosine, score
from ..operators import chunk, evaluate, extract, graph, hybrid, incremental, merge, render, route, vector
from ..sources import frontmatter
from ..sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


def _score(x: str) -> str:
    return f"floor(({x}) * 100 + 0.5) / 100"


#: The stated query set of batch searches.
ASKED = "vec_id % 20 = 0"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter(ASKED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


# -- vectors

def _one(spark: SparkSession, sf: str) -> list[float]:
    return table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_ONE_SQL = f"SELECT e.vec_id, e.label, {_cos('e.embedding', 'q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


@query(f"SELECT vec_id, label, {_score('similarity')} AS score FROM (SELECT * FROM ({_ONE_SQL}) ORDER BY {_score('similarity')} DESC, similarity DESC, vec_id LIMIT 5) WHERE {_score('similarity')} >= 0.35")
def vec_topk_single(spark, sf):
    return vector.top_k(table(spark, sf, "embeddings"), _one(spark, sf)).select("vec_id", "label", "score")


@query(f"SELECT vec_id, {_score('similarity')} AS score FROM ({_ONE_SQL}) WHERE {_score('similarity')} >= 0.35")
def vec_threshold(spark, sf):
    asked = F.array(*(F.lit(float(x)) for x in _one(spark, sf)))
    rows = table(spark, sf, "embeddings").withColumn("score", score(cosine(F.col("embedding"), asked)))
    return rows.filter(F.col("score") >= vector.THRESHOLD).select("vec_id", "score")


_PAIRS = f"SELECT q.vec_id AS query_id, e.vec_id, e.label, {_cos('e.embedding', 'q.embedding')} AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0"
_RANKED = f"SELECT *, {_score('similarity')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_score('similarity')} DESC, similarity DESC, vec_id) AS rank FROM ({_PAIRS})"


@query(f"SELECT query_id, vec_id, rank::INTEGER AS rank, score FROM ({_RANKED}) WHERE rank <= 5 AND score >= 0.35")
def vec_topk_batch(spark, sf):
    return vector.top_k_batch(table(spark, sf, "embeddings"), _asked(spark, sf)).select("query_id", "vec_id", "rank", "score")


@query(f"""WITH c AS (SELECT *, {_score('similarity')} AS score FROM ({_PAIRS}) QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY {_score('similarity')} DESC, similarity DESC, vec_id) <= 5)
SELECT query_id, label, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, similarity DESC, vec_id)::INTEGER AS rank FROM c WHERE score >= 0.35 QUALIFY rank <= 5""")
def vec_topk_by_collection(spark, sf):
    hits = vector.top_k_batch(table(spark, sf, "embeddings"), _asked(spark, sf), by=["label"])
    return vector.merge_collections(hits).select("query_id", "label", "vec_id", "score", "rank")


@query(f"""WITH a AS ({_ONE_SQL}), b AS (SELECT *, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS project, {_score('similarity')} AS score FROM a),
t AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY project ORDER BY score DESC, similarity DESC, vec_id) <= 10)
SELECT vec_id, project, score FROM t ORDER BY score DESC, similarity DESC, vec_id, project LIMIT 10""")
def vec_merge_projects(spark, sf):
    rows, asked = table(spark, sf, "embeddings"), _one(spark, sf)
    sides = {"a": "label < 5", "b": "label >= 5"}
    return vector.merge_projects({p: vector.top_k(rows.filter(w), asked, 10, None) for p, w in sides.items()}).select("vec_id", "project", "score")


@query()
def vec_hashed_embedding(spark, sf):
    """A deterministic stand-in for a model; tests hold it against a plain computation."""
    return table(spark, sf, "benchmark").select("item_id", vector.hashed_embedding(F.col("text")).alias("vector"))


# -- chunks

_CPT = "CASE WHEN z / n > 0.3 THEN 1.5 WHEN z / n > 0.1 THEN 4 * (1 - z / n) + 1.5 * (z / n) ELSE 4 END"
_CHARS = "SELECT doc_id, text, length(text)::DOUBLE AS n, len(regexp_extract_all(text, '[一-鿿㐀-䶿]')) AS z FROM documents"


@query(f"SELECT doc_id, ({_CPT})::DOUBLE AS chars_per_token, ceil(n / ({_CPT}))::BIGINT AS tokens FROM ({_CHARS})")
def chunk_token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.chars_per_token(F.col("text")).alias("chars_per_token"), tx.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS line_end FROM ({_CHARS}) WHERE ceil(n / ({_CPT})) <= 800")
def chunk_short_files(spark, sf):
    rows = table(spark, sf, "documents").filter(chunk.is_short(F.col("text")))
    return rows.select("doc_id", F.size(F.split("text", "\n", -1)).alias("line_end"))


@query(f"""WITH RECURSIVE d AS (SELECT doc_id, n, ({_CPT}) AS cpt, string_split(text, chr(10)) AS ls FROM ({_CHARS})),
l AS (SELECT doc_id, list_transform(ls, lambda x: length(x)) AS ss, len(ls) AS m, 1000 * cpt AS cap, ceil(200 * cpt / 80)::INTEGER AS back, n FROM d),
r(doc_id, line, first, chars, ef, el) AS (SELECT doc_id, 0, 1, 0::HUGEINT, NULL::INTEGER, NULL::INTEGER FROM l WHERE n > cap
  UNION ALL SELECT doc_id, line + 1, CASE WHEN c >= cap THEN line + 2 - least(back, line + 2 - first) ELSE first END,
    CASE WHEN c >= cap THEN coalesce(list_sum(ss[line + 2 - least(back, line + 2 - first):line + 1]), 0) + least(back, line + 2 - first) - 1 ELSE c END,
    CASE WHEN c >= cap THEN first END, CASE WHEN c >= cap THEN line + 1 END
  FROM (SELECT r.doc_id, line, first, chars + ss[line + 1] + 1 AS c, cap, back, ss FROM r JOIN l ON r.doc_id = l.doc_id WHERE line < m))
SELECT doc_id, ef AS first, el AS last FROM r WHERE ef IS NOT NULL
UNION ALL SELECT r.doc_id, first, m::INTEGER FROM r JOIN l ON r.doc_id = l.doc_id AND line = m WHERE first <= m
UNION ALL SELECT doc_id, 1, m::INTEGER FROM l WHERE n <= cap""")
def chunk_overlap_spans(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.explode(chunk.overlap_spans(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.first", "s.last")


def _markdown(spark, sf) -> DataFrame:
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    parts = F.array_join(F.transform("ns", lambda x: F.concat(F.lit("## "), x["n_name"], F.lit("\nits key is number "), x["n_nationkey"].cast("string"), F.lit("\n"))), "")
    rows = table(spark, sf, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select(F.col("r_name").alias("path"), F.concat(F.lit("preface\n# "), F.col("r_name"), F.lit("\nthe region\n"), parts).alias("body"))


@query("""WITH n AS (SELECT r_name AS path, n_name, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY r_regionkey) AS c FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT path, n_name AS heading, (2 + 2 * k)::INTEGER AS start_line, '## ' || n_name || chr(10) || 'its key is number ' || n_nationkey || CASE WHEN k = c THEN chr(10) ELSE '' END AS section FROM n
UNION ALL SELECT DISTINCT path, path, 2, '# ' || path || chr(10) || 'the region' FROM n""")
def chunk_sections(spark, sf):
    return chunk.long_enough(chunk.sections(_markdown(spark, sf))).unionByName(chunk.sections(_markdown(spark, sf)).filter((F.col("start_line") == 2) & (F.length(tx.strip(F.col("section"))) < chunk.MIN_SECTION_CHARS)))


@query("SELECT n_nationkey, 'a' || chr(10) || '```' || chr(10) || (n_nationkey + 2) || '| key' || chr(10) || (n_nationkey + 3) || '| ' || n_name || chr(10) || '```' || chr(10) || 'end' AS numbered FROM nation")
def chunk_fence_lines(spark, sf):
    text = F.concat(F.lit("a\n```\nkey\n"), F.col("n_name"), F.lit("\n```\nend"))
    return table(spark, sf, "nation").select("n_nationkey", chunk.numbered(text, F.col("n_nationkey")).alias("numbered"))


@query("SELECT doc_id, substr(sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')), 1, 16) AS body_hash, substr(md5(text), 1, 12) AS file_hash FROM documents")
def doc_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.body_hash(F.col("text")).alias("body_hash"), tx.file_hash(F.col("text")).alias("file_hash"))


# -- routing

# Paths, and what each must come to: action, layer, source type.
PATHS = [
    ("src/main/java/a/entity/Order.java", "generate", "domain", "doc"), ("src/main/java/a/enums/Status.java", "generate", "domain", "doc"),
    ("src/main/java/a/controller/OrderController.java", "generate", "contracts", "doc"), ("src/main/java/a/service/OrderService.java", "lm-judge", None, "doc"),
    ("src/main/java/a/mapper/OrderMapper.java", "generate", "code", "doc"), ("src/test/java/a/test/OrderTest.java", "skip", None, "doc"),
    ("src/main/java/a/StringUtils.java", "index-only", None, "doc"), ("domain/entities/order.md", "index-only", None, "domain"),
    ("flows/order-flow.md", "index-only", None, "flow"), ("db/migration/V1.sql", "generate", "domain", "doc"), ("a/remote/PayClient.java", "generate", "contracts", "doc"),
    ("src/router/index.ts", "index-only", None, "doc"),
]
_PATH_VALUES = ", ".join(f"({i}, '{p}', '{a}', {'NULL' if l is None else repr(l)}, '{s}')" for i, (p, a, l, s) in enumerate(PATHS))
_PATH_SQL = f"(SELECT p_partkey, v.* FROM part JOIN (VALUES {_PATH_VALUES}) v(k, path, action, layer, source_type) ON p_partkey % {len(PATHS)} = v.k)"


def _paths(spark, sf) -> DataFrame:
    every = F.array(*(F.lit(p[0]) for p in PATHS))
    return table(spark, sf, "part").select("p_partkey", F.get(every, (F.col("p_partkey") % len(PATHS)).cast("int")).alias("path"))


@query(f"SELECT p_partkey, path, action, layer FROM {_PATH_SQL}")
def route_files(spark, sf):
    return _paths(spark, sf).withColumn("r", route.route(F.col("path"))).select("p_partkey", "path", "r.action", "r.layer")


@query(f"SELECT action, count(*) AS n FROM {_PATH_SQL} GROUP BY action")
def route_partitions(spark, sf):
    return route.route_counts(_paths(spark, sf))


@query(f"SELECT p_partkey, source_type FROM {_PATH_SQL}")
def classify_source_type(spark, sf):
    return _paths(spark, sf).select("p_partkey", route.source_type(F.col("path")).alias("source_type"))


@query("SELECT unnest(['11', '3', '5', '6', '7']) AS phase")
def affected_phases(spark, sf):
    return route.affected_phases(_paths(spark, sf).withColumn("added", F.lit(True)))


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'flow-level1' WHEN source = 'src1' THEN 'entity' WHEN source = 'src2' THEN 'contract' ELSE 'unknown' END AS type, false AS needs_lm FROM documents")
def classify_stale(spark, sf):
    folder = F.when(F.col("source") == "src0", "flows/").when(F.col("source") == "src1", "domain/entities/").when(F.col("source") == "src2", "contracts/").otherwise("x/")
    rows = table(spark, sf, "documents").withColumn("t", route.stale_type(F.concat(F.lit("a/kb/"), folder, F.lit("d.md")), F.col("text")))
    return rows.select("doc_id", "t.type", "t.needs_lm")


@query("SELECT c_custkey, CASE WHEN c_nationkey >= 4 OR (c_nationkey >= 3 AND c_acctbal > 0) OR (c_acctbal > 0 AND c_mktsegment = 'BUILDING') THEN 'high' ELSE 'normal' END AS complexity FROM customer")
def flow_complexity(spark, sf):
    text = F.concat(F.lit("**调用服务数：** "), F.col("c_nationkey").cast("string"), F.when(F.col("c_acctbal") > 0, "\n**触发状态变更：** 是").otherwise("\n**触发状态变更：** 否"), F.when(F.col("c_mktsegment") == "BUILDING", "\n@Transactional").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", route.complexity(text).alias("complexity"))


# -- front matter

@query("SELECT doc_id, 'say \"' || source || '\"' AS summary, lang AS first_source, substr(sha256(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')), 1, 16) AS body_hash, false AS edited FROM documents")
def frontmatter_round_trip(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.lit("domain").alias("kb_layer"), F.concat(F.lit('say "'), F.col("source"), F.lit('"')).alias("summary"), F.array("lang", F.lit("b.java")).alias("sources"), F.lit("c0ffee").alias("commit"), F.col("text").alias("body"))
    written = frontmatter.created(rows).withColumn("content", frontmatter.serialize(None)).select("doc_id", "content")
    back = frontmatter.parse(written)
    return back.select("doc_id", "summary", F.col("sources")[0].alias("first_source"), F.col("last_scan_commits")[1]["body_hash"].alias("body_hash"), frontmatter.edited(back).alias("edited"))


# -- extraction

def _by_region(spark, sf, line: Callable[[Column, Column], Column], head: str, tail: str, extra: Column | None = None) -> DataFrame:
    """One text for each region: a head with its name, a part for each nation in order, a tail."""
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    rows = table(spark, sf, "region").withColumn("r_name", F.translate("r_name", " ", "_")).join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    body = F.array_join(F.transform("ns", lambda x: line(x["n_nationkey"].cast("string"), x["n_name"])), "")
    text = F.concat(F.lit(head.split("@@")[0]), F.col("r_name"), F.lit(head.split("@@")[1]), body, F.lit(tail))
    return rows.select(F.concat(F.lit("src/"), F.col("r_name"), F.lit(".java")).alias("path"), text.alias("content"))


_REGION = "(SELECT r_regionkey, replace(r_name, ' ', '_') AS r_name FROM region)"
_NR = f"(SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation JOIN {_REGION} ON n_regionkey = r_regionkey)"


@query(f"SELECT r_name AS class_name, n_name AS code_name, n_nationkey::VARCHAR AS code, CASE WHEN n_nationkey < 10 THEN n_nationkey::VARCHAR ELSE 'about ' || n_name END AS description FROM nation JOIN {_REGION} ON n_regionkey = r_regionkey")
def extract_enum(spark, sf):
    def line(k, n):
        return F.concat(F.lit("  "), n, F.lit('("'), k, F.when(k.cast("int") < 10, '"').otherwise(F.concat(F.lit('", "about '), n, F.lit('"'))), F.lit("),\n"))

    files = _by_region(spark, sf, line, "public enum @@ {\n", "  ;\n  private String code;\n}\n")
    return extract.enum_values(files).drop("path")


@query(f"SELECT r_name AS class_name, 't_' || r_name AS table_name, CASE WHEN n_nationkey < 10 THEN 'nationKey' ELSE 'f' END || n_nationkey AS field, CASE WHEN n_nationkey < 10 THEN 'nation_key' || n_nationkey ELSE 'col_' || n_nationkey END AS column_name, 'about ' || n_name AS comment, n_nationkey = 12 AS is_key FROM nation JOIN {_REGION} ON n_regionkey = r_regionkey")
def extract_entity_fields(spark, sf):
    def line(k, n):
        mark = F.when(k == "12", F.concat(F.lit('  @TableId(value = "col_'), k, F.lit('")\n'))).when(k.cast("int") >= 10, F.concat(F.lit('  @TableField("col_'), k, F.lit('")\n'))).otherwise("")
        return F.concat(F.lit("  /**\n   * about "), n, F.lit("\n   */\n"), mark, F.lit("  private String "), F.when(k.cast("int") < 10, "nationKey").otherwise("f"), k, F.lit(";\n\n"))

    files = _by_region(spark, sf, line, "public class @@ {\n", "}\n")
    name = F.regexp_extract("content", r"class (\w+)", 1)
    files = files.withColumn("content", F.concat(F.lit('@TableName("t_'), name, F.lit('")\n'), F.col("content")))
    return extract.entity_fields(files).drop("path", "type")


@query(f"SELECT r_name AS table_name, 'col_' || n_nationkey AS column_name, 'decimal(10,2)' AS col_type, n_nationkey < 10 AS not_null, CASE WHEN n_nationkey < 10 THEN '0' END AS default_value, n_name AS comment FROM nation JOIN {_REGION} ON n_regionkey = r_regionkey")
def extract_ddl(spark, sf):
    def line(k, n):
        return F.concat(F.lit("  `col_"), k, F.lit("` decimal(10,2)"), F.when(k.cast("int") < 10, " NOT NULL DEFAULT '0'").otherwise(""), F.lit(" COMMENT '"), n, F.lit("',\n"))

    files = _by_region(spark, sf, line, "CREATE TABLE `@@` (\n", "  PRIMARY KEY (`a`, `b`),\n  UNIQUE KEY `u_a` (`a`)\n) COMMENT='x';")
    return extract.ddl_columns(files.select(F.regexp_extract("path", r"src/(.*)\.java", 1).alias("table_name"), F.col("content").alias("ddl")))


@query("SELECT r_name AS table_name, unnest(['PRIMARY', 'u_a']) AS index_name, unnest(['PRIMARY', 'UNIQUE']) AS kind, unnest(['a,b', 'a']) AS columns FROM region")
def extract_ddl_indexes(spark, sf):
    rows = table(spark, sf, "region").select(F.col("r_name").alias("table_name"), F.lit("x\n PRIMARY KEY (`a`, `b`),\n UNIQUE KEY `u_a` (`a`)\n)").alias("ddl"))
    return extract.ddl_indexes(rows).withColumn("columns", F.array_join("columns", ","))


VERBS = ["Get", "Post", "Put", "Delete", "Patch"]


@query(f"SELECT r_name AS class_name, list_extract({[v.upper() for v in VERBS]}, (n_nationkey % 5 + 1)::INTEGER) AS http_method, '/api/' || n_name AS endpoint, 'm' || n_nationkey AS method_name, 'Long id' AS params, 'about ' || n_name AS comment, (8 + 6 * i)::INTEGER AS line FROM {_NR}")
def extract_endpoints(spark, sf):
    def line(k, n):
        verb = F.get(F.array(*map(F.lit, VERBS)), (k.cast("int") % 5))
        return F.concat(F.lit("  /**\n   * about "), n, F.lit("\n   */\n  @"), verb, F.lit('Mapping("/'), n, F.lit('")\n  public String m'), k, F.lit("(@RequestParam Long id) {}\n\n"))

    files = _by_region(spark, sf, line, '@RestController\n@RequestMapping("/api")\n\npublic class @@ {\n', "}\n")
    return extract.endpoints(files).drop("path", "return_type")


@query(f"SELECT r_name AS class_name, 'demo.x' AS package_name, 'load' || n_nationkey AS method_name, 'String' AS return_type, 'String a, int b' AS params, (4 + 6 * i)::INTEGER AS line_start, (7 + 6 * i)::INTEGER AS line_end, 4 AS body_lines, '@Cached(\"' || n_name || '\")' AS annotations FROM {_NR}")
def extract_methods(spark, sf):
    def line(k, n):
        return F.concat(F.lit('  @Cached("'), n, F.lit('")\n  public String load'), k, F.lit("(final String a, int b) {\n    if (a) { b(); }\n    return a;\n  }\n\n"))

    files = _by_region(spark, sf, line, "package demo.x;\npublic class @@ {\n", "}\n")
    return extract.methods(files).drop("path", "visibility").withColumn("annotations", F.array_join("annotations", ","))


@query(f"SELECT r_name AS class_name, 'v' || n_nationkey AS variable, n_name || 'Service' AS type FROM nation JOIN {_REGION} ON n_regionkey = r_regionkey")
def extract_injected(spark, sf):
    def line(k, n):
        return F.concat(F.when(k.cast("int") < 10, "  @Resource\n").otherwise("  @Autowired\n"), F.lit("  private "), n, F.lit("Service v"), k, F.lit(";\n"))

    return extract.injected_fields(_by_region(spark, sf, line, "public class @@ {\n", "}\n")).drop("path")


@query(f"SELECT r_name AS class_name, 'run' AS method_name, 'v' || n_nationkey AS variable, 'go' || n_nationkey AS callee, n_name || 'Client' AS service, true AS is_external FROM nation JOIN {_REGION} ON n_regionkey = r_regionkey")
def extract_service_calls(spark, sf):
    def fields(k, n):
        return F.concat(F.lit("  @Resource\n  private "), n, F.lit("Client v"), k, F.lit(";\n"))

    def calls(k, n):
        return F.concat(F.lit("    v"), k, F.lit(".go"), k, F.lit("(1); log.info(x); other.call(y);\n"))

    files = _by_region(spark, sf, fields, "public class @@ {\n", "")
    more = _by_region(spark, sf, calls, "  public void run() {\n//@@\n", "  }\n}\n").withColumnRenamed("content", "rest")
    files = files.join(more, "path").select("path", F.concat("content", "rest").alias("content"))
    return extract.service_calls(extract.method_bodies(files), extract.injected_fields(files)).drop("place")


@query("SELECT n_name AS error_code, (1000 + n_nationkey)::VARCHAR AS number, 'no ' || n_name AS message FROM nation")
def extract_error_codes(spark, sf):
    def line(k, n):
        return F.concat(F.lit("  "), n, F.lit("("), (k.cast("int") + 1000).cast("string"), F.lit(', "no '), n, F.lit('"),\n'))

    return extract.error_codes(_by_region(spark, sf, line, "enum @@ {\n", ";}\n")).drop("path")


@query(f"SELECT n_name AS error_code, (i + 2)::INTEGER AS line, 'x > ' || n_nationkey AS condition FROM {_NR}")
def extract_throw_sites(spark, sf):
    def line(k, n):
        return F.concat(F.lit("  Asserts.checkTrue(x > "), k, F.lit(", E."), n, F.lit(");\n"))

    return extract.throw_sites(_by_region(spark, sf, line, "class @@ {\n", "}\n")).drop("path")


@query(f"SELECT 'S' || n_nationkey AS to_status, CASE WHEN n_nationkey < 10 THEN 'A | B' ELSE 'any' END AS from_status, 'to' || n_nationkey AS method_name, (3 + 3 * i)::INTEGER AS line FROM {_NR}")
def extract_transitions(spark, sf):
    def line(k, n):
        listed = F.when(k.cast("int") < 10, ", List.of(Status.A, Status.B)").otherwise("")
        return F.concat(F.lit("  public void to"), k, F.lit("() {\n    setStatus(Status.S"), k, listed, F.lit(");\n  }\n"))

    return extract.transitions(_by_region(spark, sf, line, "class @@ {\n", "}\n"), "Status", "setStatus", before=0, after=60).drop("path")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def extract_links(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(extract.every(F.col("html"), 'href="([^"]+)"', 1)).alias("link"))


@query(f"SELECT r_name AS path, '/p/' || n_name AS route FROM nation JOIN {_REGION} ON n_regionkey = r_regionkey")
def extract_routes(spark, sf):
    files = _by_region(spark, sf, lambda k, n: F.concat(F.lit("  { path: '/p/"), n, F.lit("', element: <A /> },\n")), "// @@\nexport default [\n", "]\n")
    return extract.routes(files).withColumn("path", F.regexp_extract("path", r"src/(.*)\.java", 1))


@query("SELECT '/api/' || n_name AS url FROM nation UNION ALL SELECT 'https://h/' || n_name FROM nation")
def extract_api_urls(spark, sf):
    files = _by_region(spark, sf, lambda k, n: F.concat(F.lit("client.get('/api/"), n, F.lit("'); x = { url: 'https://h/"), n, F.lit("' }; fetch('no');\n")), "// @@\n", "")
    return extract.api_urls(files).drop("path")


@query("SELECT CASE WHEN n_nationkey < 10 THEN 'post' ELSE 'get' END || 'N' || n_nationkey AS function_name, CASE WHEN n_nationkey < 10 THEN 'POST' ELSE 'GET' END AS http_method FROM nation")
def extract_api_functions(spark, sf):
    files = _by_region(spark, sf, lambda k, n: F.concat(F.lit("export const "), F.when(k.cast("int") < 10, "post").otherwise("get"), F.lit("N"), k, F.lit(" = 1;\nexport const zz = 2;\n")), "// @@\n", "")
    return extract.api_functions(files).drop("path")


@query("SELECT c_mktsegment AS page, count(*) AS file_count FROM customer GROUP BY c_mktsegment")
def extract_pages(spark, sf):
    paths = table(spark, sf, "customer").select(F.concat(F.lit("src/pages/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit(".tsx")).alias("path"))
    return extract.pages(paths).drop("files")


@query("SELECT n_name AS target, 'go' || n_nationkey AS name, 'GET' AS http_method FROM nation")
def extract_forwards(spark, sf):
    files = _by_region(spark, sf, lambda k, n: F.concat(F.lit('  @GET("'), n, F.lit('")\n  Call<String> go'), k, F.lit("(int a);\n")), "interface @@ {\n", "}\n")
    return extract.forwards(files).drop("path")


@query(f"SELECT r_name AS dictionary, 'k' || n_nationkey AS key, n_name AS value FROM nation JOIN {_REGION} ON n_regionkey = r_regionkey")
def extract_dictionaries(spark, sf):
    files = _by_region(spark, sf, lambda k, n: F.concat(F.lit("  'k"), k, F.lit("': '"), n, F.lit("',\n")), "/** said */\nexport const @@ = {\n", "}\n")
    return extract.dictionaries(files).drop("path", "comment")


_WORDS = "(length(text) - length(replace(text, ' the ', '')))"


@query("""WITH f AS (SELECT doc_id, text, regexp_matches(text, '\\bthe\\b') AS a, regexp_matches(text, '\\bder\\b') AS b, regexp_matches(text, '\\band\\b') AS c FROM documents)
SELECT doc_id, (a::INTEGER + b::INTEGER + c::INTEGER) AS n_indicators, len(regexp_extract_all(text, '\\bif\\s*\\(')) + len(regexp_extract_all(text, '\\?.*:'))::INTEGER AS decision_points FROM f
WHERE a::INTEGER + b::INTEGER + c::INTEGER >= 2 OR (a::INTEGER + b::INTEGER + c::INTEGER = 1 AND len(regexp_extract_all(text, '\\bif\\s*\\(')) + len(regexp_extract_all(text, '\\?.*:')) >= 2)""")
def rule_candidates(spark, sf):
    bodies = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    found = extract.rule_candidates(bodies, [r"\bthe\b", r"\bder\b", r"\band\b"])
    return found.select("doc_id", F.size("indicators").alias("n_indicators"), "decision_points")


@query("SELECT prev AS from_type, event_type AS to_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL GROUP BY ALL")
def state_transitions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").select(F.lag("event_type").over(w).alias("from_type"), F.col("event_type").alias("to_type"))
    return rows.filter("from_type is not null").groupBy("from_type", "to_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN source = 'src0' THEN 'Order' WHEN source = 'src1' THEN 'OrderItem' END AS symbol FROM documents WHERE source IN ('src0', 'src1')")
def doc_symbols(spark, sf):
    sources = F.when(F.col("source") == "src0", F.array(F.lit("a/Order.java"), F.lit("b/Order.java"))).otherwise(F.array().cast("array<string>"))
    body = F.when(F.col("source") == "src1", "# OrderItem\n").otherwise("# plain heading\n")
    return extract.symbols(table(spark, sf, "documents").select(F.col("doc_id").alias("path"), sources.alias("sources"), body.alias("body"))).select(F.col("path").alias("doc_id"), "symbol")


# -- merging

@query("""SELECT coalesce(a.k, b.k) AS class_name, coalesce(a.c_mktsegment, b.c_mktsegment) AS base_path, coalesce(a.c, b.c) AS comment, CASE WHEN a.k IS NULL THEN 'regex' WHEN b.k IS NULL THEN 'graph' ELSE 'both' END AS source
FROM (SELECT c_name AS k, c_mktsegment, 'graph' AS c FROM customer WHERE c_acctbal > 1000) a FULL JOIN (SELECT c_name AS k, c_mktsegment, 'regex' AS c FROM customer WHERE c_mktsegment <> 'BUILDING') b ON a.k = b.k""")
def controllers_full_merge(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_name").alias("class_name"), F.col("c_mktsegment").alias("base_path"), "c_acctbal")
    return merge.controllers(rows.filter("c_acctbal > 1000").withColumn("comment", F.lit("graph")), rows.filter("base_path <> 'BUILDING'").withColumn("comment", F.lit("regex")))


@query("""SELECT coalesce(a.p, b.p) AS class_name, 'GET' AS http_method, coalesce(a.e, b.e) AS endpoint, coalesce('graph' || a.e, 'regex' || b.e) AS method_name, coalesce(b.o_orderstatus, '') AS return_type, coalesce(b.line, 0)::INTEGER AS line, a.e IS NOT NULL AS in_graph
FROM (SELECT o_orderpriority AS p, o_orderkey::VARCHAR AS e FROM orders WHERE o_totalprice > 100000) a FULL JOIN (SELECT o_orderpriority AS p, o_orderkey::VARCHAR AS e, o_orderstatus, o_custkey AS line FROM orders WHERE o_orderstatus <> 'O') b ON a.p = b.p AND a.e = b.e""")
def endpoints_full_merge(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("class_name"), F.lit("get").alias("http_method"), F.col("o_orderkey").cast("string").alias("endpoint"), F.col("o_orderstatus").alias("return_type"), F.col("o_custkey").cast("int").alias("line"), "o_totalprice", F.lit("").alias("params"), F.lit("").alias("comment"))
    left = rows.filter("o_totalprice > 100000").withColumn("method_name", F.concat(F.lit("graph"), F.col("endpoint")))
    right = rows.filter("return_type <> 'O'").withColumn("method_name", F.concat(F.lit("regex"), F.col("endpoint")))
    return merge.endpoints(left, right).drop("params", "comment")


@query("""WITH f AS (SELECT DISTINCT p_brand AS table_name, p_type AS column_name, p_type AS field FROM part WHERE p_size < 10), c AS (SELECT p_brand AS table_name, p_type AS column_name, max(p_size) AS width FROM part WHERE p_retailprice > 950 GROUP BY ALL)
SELECT f.table_name, f.column_name, field, width FROM f LEFT JOIN c USING (table_name, column_name) UNION ALL SELECT table_name, column_name, NULL, width FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.table_name = c.table_name AND f.column_name = c.column_name)""")
def ddl_left_plus_anti(spark, sf):
    part = table(spark, sf, "part")
    fields = part.filter("p_size < 10").select(F.col("p_brand").alias("table_name"), F.col("p_type").alias("column_name"), F.col("p_type").alias("field")).distinct()
    columns = part.filter("p_retailprice > 950").groupBy(F.col("p_brand").alias("table_name"), F.col("p_type").alias("column_name")).agg(F.max("p_size").alias("width"))
    return merge.fields_with_columns(fields, columns).select("table_name", "column_name", "field", "width")


@query("""WITH f AS (SELECT DISTINCT 'get' || upper(substr(split_part(p_name, ' ', 1), 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS function_name, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS ws FROM part),
p AS (SELECT '/' || split_part(p_name, ' ', 2) || '/' || lower(p_type) || '/' || split_part(p_name, ' ', 1) AS flow_path, min(p_partkey) AS place FROM part GROUP BY ALL),
m AS (SELECT function_name, flow_path, place, len(list_filter(ws, lambda w: len(list_filter(string_split(substr(flow_path, 2), '/'), lambda s: contains(s, w) OR contains(w, s))) > 0))::INTEGER AS matched FROM f, p)
SELECT function_name, 'GET' AS http_method, flow_path, matched FROM m WHERE matched >= 2 QUALIFY row_number() OVER (PARTITION BY function_name ORDER BY matched DESC, place) = 1""")
def best_match_mapping(spark, sf):
    words = F.split("p_name", " ")
    part = table(spark, sf, "part")
    functions = part.select(F.concat(F.lit("get"), F.initcap(words[0]), F.initcap(words[1])).alias("function_name"), F.lit("GET").alias("http_method")).distinct()
    flows = part.groupBy(F.concat(F.lit("/"), words[1], F.lit("/"), F.lower("p_type"), F.lit("/"), words[0]).alias("flow_path")).agg(F.min("p_partkey").alias("place")).withColumn("http_method", F.lit("GET"))
    return merge.best_match(functions, flows)


@query("""WITH s AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id, list_filter(string_split(regexp_replace(url, '^https?://[^/]+', ''), '/'), lambda x: x <> '') AS s FROM pages),
l AS (SELECT host, arg_min(s, page_id) AS lead FROM s GROUP BY host),
n AS (SELECT host, lead, min(coalesce(list_min(list_filter(range(1, len(lead) + 1), lambda i: s[i] IS DISTINCT FROM lead[i])) - 1, len(lead))) AS n FROM s JOIN l USING (host) GROUP BY ALL)
SELECT host AS group_id, CASE WHEN least(n, greatest(len(lead) - 1, 0)) > 0 THEN '/' || array_to_string(lead[1:least(n, len(lead) - 1)], '/') ELSE '' END AS base_path FROM n""")
def common_base_path(spark, sf):
    rows = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("group_id"), F.col("page_id").alias("place"), F.regexp_replace("url", "^https?://[^/]+", "").alias("route"))
    return merge.common_base(rows)


# -- graph

def _fk_edges(spark, sf) -> DataFrame:
    def edge(df, a, ka, b, kb, kind):
        return df.select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("src"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("dst"), F.lit(kind).alias("edge_type"))

    orders, customers, nations = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return edge(orders, "o", "o_orderkey", "c", "o_custkey", "placed").unionByName(edge(customers, "c", "c_custkey", "n", "c_nationkey", "lives")).unionByName(edge(nations, "n", "n_nationkey", "r", "n_regionkey", "lies"))


_EDGES = "SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'placed' AS edge_type FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives' FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'lies' FROM nation"


@query(f"WITH e AS ({_EDGES}) SELECT src AS symbol, 'out' AS direction, edge_type, dst AS neighbour FROM e WHERE src IN (SELECT 'n' || n_nationkey FROM nation) UNION ALL SELECT dst, 'in', edge_type, src FROM e WHERE dst IN (SELECT 'n' || n_nationkey FROM nation)")
def graph_context(spark, sf):
    symbols = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("symbol"))
    return graph.context(_fk_edges(spark, sf), symbols)


@query("SELECT 'n' || c_nationkey AS symbol, 'has_method' AS edge_type, 'c' || c_custkey AS neighbour FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 8 UNION ALL SELECT 'n' || n_nationkey, 'implements', 'r' || n_regionkey FROM nation")
def graph_fanout_cap(spark, sf):
    own = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("symbol"), F.lit("has_method").alias("edge_type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("neighbour"), F.col("c_custkey").alias("place"))
    more = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("symbol"), F.lit("implements").alias("edge_type"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("neighbour"), F.col("n_regionkey").cast("long").alias("place"))
    return graph.cap(own.unionByName(more)).drop("place")


@query("""SELECT s_nationkey::VARCHAR AS module, 'fn' || l_suppkey AS caller, count(DISTINCT l_partkey) AS fan_out, row_number() OVER (PARTITION BY s_nationkey ORDER BY count(DISTINCT l_partkey) DESC, 'fn' || l_suppkey)::INTEGER AS rank
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_suppkey HAVING count(DISTINCT l_partkey) >= 5 QUALIFY rank <= 2""")
def graph_high_fanout_top2(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.high_fan_out(rows.select(F.col("s_nationkey").cast("string").alias("module"), F.concat(F.lit("fn"), F.col("l_suppkey").cast("string")).alias("caller"), F.col("l_partkey").alias("callee")))


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r(symbol, distance) AS (SELECT 'r0', 0 UNION SELECT e.src, r.distance + 1 FROM r JOIN e ON e.dst = r.symbol WHERE r.distance < 3)
SELECT symbol, min(distance)::INTEGER AS distance FROM r GROUP BY symbol""")
def graph_impact_depth3(spark, sf):
    return graph.impact(_fk_edges(spark, sf), spark.createDataFrame([("r0",)], "symbol string"), 3)


@query(f"""WITH RECURSIVE e AS ({_EDGES}), r(symbol, distance) AS (SELECT 'r0', 0 UNION SELECT e.src, r.distance + 1 FROM r JOIN e ON e.dst = r.symbol WHERE r.distance < 3),
s AS (SELECT count(DISTINCT symbol) FILTER (distance = 1) AS direct, count(DISTINCT symbol) AS total, count(DISTINCT left(symbol, 1)) AS modules FROM r WHERE distance > 0)
SELECT *, CASE WHEN total >= 20 OR modules >= 3 THEN 'high' WHEN total >= 5 OR modules >= 2 THEN 'medium' ELSE 'low' END AS risk FROM s""")
def graph_impact_summary(spark, sf):
    edges = _fk_edges(spark, sf)
    owners = edges.select(F.col("src").alias("symbol"), F.left("src", F.lit(1)).alias("module")).distinct()
    return graph.impact_summary(graph.impact(edges, spark.createDataFrame([("r0",)], "symbol string"), 3), owners)


@query("SELECT 'o1 > c' || o_custkey || ' > n' || c_nationkey || ' > r' || n_regionkey AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT 'r' || n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey = 1) x ON true WHERE o_orderkey = 1")
def graph_trace(spark, sf):
    edges = _fk_edges(spark, sf)
    region = table(spark, sf, "orders").filter("o_orderkey = 1").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey").first()[0]
    return graph.trace(edges, "o1", f"r{region}").select(F.array_join("path", " > ").alias("path"))


@query("""SELECT l_orderkey::VARCHAR AS path, CASE WHEN l_linenumber <= 3 THEN 'a' ELSE 'b' END AS symbol, count(*) AS changed_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 30 AND l_linenumber <= 7 GROUP BY ALL""")
def detect_changes_range_join(spark, sf):
    changes = table(spark, sf, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").cast("string").alias("path"), F.col("l_linenumber").alias("line"))
    spans = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.inline(F.array(F.struct(F.lit("a").alias("symbol"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end")), F.struct(F.lit("b").alias("symbol"), F.lit(4).alias("line_start"), F.lit(7).alias("line_end")))))
    return graph.changed_symbols(changes, spans)


@query("""WITH a AS (SELECT DISTINCT 'Seg' || c_mktsegment || '.c' || c_nationkey AS entry, c_nationkey AS k FROM customer)
SELECT entry, 'Nation' || k AS service, 'load' AS callee, 1 AS depth, NULL AS via FROM a
UNION ALL SELECT DISTINCT entry, 'Supplier' || s_nationkey, 'find' || s_suppkey, 2, 'Nation' || k || '.load' FROM a JOIN supplier ON s_nationkey = k""")
def call_graph_depth2(spark, sf):
    entries = table(spark, sf, "customer").select(F.concat(F.lit("Seg"), F.col("c_mktsegment")).alias("class_name"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("method_name"), F.concat(F.lit("Nation"), F.col("c_nationkey").cast("string")).alias("service"), F.lit("load").alias("callee"), F.lit(True).alias("is_entry"))
    nation = F.concat(F.lit("Nation"), F.col("s_nationkey").cast("string"))
    inner = table(spark, sf, "supplier").select(F.concat(nation, F.lit("Impl")).alias("class_name"), F.lit("load").alias("method_name"), F.concat(F.lit("Supplier"), F.col("s_nationkey").cast("string")).alias("service"), F.concat(F.lit("find"), F.col("s_suppkey").cast("string")).alias("callee"), F.lit(False).alias("is_entry"))
    impls = table(spark, sf, "supplier").select(nation.alias("interface"), F.concat(nation, F.lit("Impl")).alias("class_name"), F.lit(0).alias("place")).distinct()
    return graph.call_graph(entries.unionByName(inner), impls)


@query("SELECT n_name AS source, CASE WHEN n_nationkey < 5 THEN 'gate' END AS via, r_name AS target, CASE WHEN n_nationkey < 5 THEN 'gateway' ELSE 'direct' END AS mode FROM nation JOIN region ON n_regionkey = r_regionkey")
def topology_edges(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = F.col("n_nationkey") < 5
    return graph.topology(rows.select(F.when(first, F.col("n_name")).alias("app"), F.col("n_name").alias("frontend"), F.col("r_name").alias("backend"), F.when(first, "gate").alias("gateway"), F.when(first, "gateway").alias("mode")))


@query("SELECT s_nationkey AS callee_module, c_nationkey AS caller_module, count(*) AS calls, count(DISTINCT l_partkey) AS methods FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL")
def inbound_contracts(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return graph.inbound_contracts(rows.select(F.col("s_nationkey").alias("callee_module"), F.col("c_nationkey").alias("caller_module"), F.col("l_partkey").alias("callee")))


@query("""WITH e AS (SELECT DISTINCT prev AS src, event_type AS dst FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL AND prev <> event_type)
SELECT DISTINCT a.src AS module, 2 AS length FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src""")
def module_cycles(spark, sf):
    rows = state_transitions(spark, sf).select(F.col("from_type").alias("src"), F.col("to_type").alias("dst"))
    return graph.module_cycles(rows)


@query(f"""WITH h AS (SELECT * FROM ({_RANKED}) WHERE rank <= 5 AND score >= 0.35),
s AS (SELECT vec_id, 'n' || label AS symbol FROM embeddings),
e AS (SELECT 'n' || c_nationkey AS symbol, 'has_method' AS edge_type, 'c' || c_custkey AS neighbour FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) <= 8 UNION ALL SELECT 'n' || n_nationkey, 'implements', 'r' || n_regionkey FROM nation)
SELECT query_id, h.vec_id::VARCHAR AS file_path, symbol, edge_type, neighbour FROM h JOIN s USING (vec_id) JOIN e USING (symbol)""")
def hybrid_search(spark, sf):
    hits = vector.top_k_batch(table(spark, sf, "embeddings"), _asked(spark, sf)).select("query_id", F.col("vec_id").cast("string").alias("file_path"))
    symbols = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("file_path"), F.concat(F.lit("n"), F.col("label").cast("string")).alias("symbol"))
    own = table(spark, sf, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.lit("has_method").alias("edge_type"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("dst"), F.col("c_custkey").alias("place"))
    more = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("src"), F.lit("implements").alias("edge_type"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), F.col("n_regionkey").cast("long").alias("place"))
    return hybrid.expand(hits, symbols, own.unionByName(more))


# -- incremental maintenance

_NEW = "SELECT doc_id::VARCHAR AS path, CASE WHEN lang = 'fr' THEN text || '!' ELSE text END AS text FROM documents WHERE source <> 'src3' UNION ALL SELECT 'b' || item_id, text FROM benchmark"


def _versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents")
    old = docs.select(F.col("doc_id").cast("string").alias("path"), "text")
    new = docs.filter("source <> 'src3'").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("lang") == "fr", F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    more = table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("path"), "text")
    return old, new.unionByName(more)


def _status(old: DataFrame, new: DataFrame) -> DataFrame:
    return incremental.changes(*(d.select("path", tx.file_hash(F.col("text")).alias("hash")) for d in (old, new)))


@query(f"SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.text = n.text THEN 'same' ELSE 'changed' END AS status FROM (SELECT doc_id::VARCHAR AS path, text FROM documents) o FULL JOIN ({_NEW}) n ON o.path = n.path")
def hash_diff(spark, sf):
    return _status(*_versions(spark, sf))


@query(f"SELECT path, md5(text) AS mark FROM ({_NEW})")
def upsert_chunks(spark, sf):
    old, new = _versions(spark, sf)
    return incremental.upsert(old, new, _status(old, new)).select("path", F.md5("text").alias("mark"))


@query("SELECT doc_id AS path, CASE WHEN lang IN ('fr', 'de') THEN lang ELSE source END AS reason FROM documents WHERE (lang IN ('fr', 'de') OR source = 'src5') AND source <> 'src7'")
def stale_docs(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.array("lang", "source").alias("sources"), (F.col("source") == "src7").alias("human_edited"))
    return incremental.stale_documents(docs, spark.createDataFrame([("fr",), ("de",), ("src5",)], "source string"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'no-state' WHEN ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 12 HOUR THEN 'within-threshold' WHEN event_type = 'click' THEN 'no-source'
WHEN user_id < 20 THEN 'feature-branch' WHEN value < 2 THEN 'fetch-failed' WHEN value < 10 THEN 'up-to-date' ELSE 'behind' END AS state FROM events""")
def freshness_states(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("last_check"), (F.col("event_type") != "view").alias("has_state"), F.when(F.col("event_type") != "click", "s").alias("source"), F.when(F.col("user_id") < 20, "feature/x").otherwise("main").alias("branch"), (F.col("value") >= 2).alias("fetch_ok"), F.lit("a").alias("head"), F.when(F.col("value") < 10, "a").otherwise("b").alias("remote"))
    return incremental.freshness(rows, F.to_timestamp(F.lit("2024-01-15 00:00:00"))).select("event_id", "state")


@query("SELECT o_orderkey, CASE WHEN NOT (o_totalprice > 100000) AND NOT (o_orderpriority = '1-URGENT') THEN 'keep' WHEN o_orderstatus = 'F' AND NOT (o_orderpriority = '1-URGENT') THEN 'mark-stale' ELSE 'regenerate' END AS action FROM orders")
def edit_matrix(spark, sf):
    action = incremental.edit_action(F.col("o_totalprice") > 100000, F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf, "orders").select("o_orderkey", action.alias("action"))


@query("SELECT o_custkey AS project, 'prod' AS env, sum((since IS NULL OR t0 > since)::INTEGER)::BIGINT AS behind FROM (SELECT o_custkey, epoch(o_orderdate) AS t0, min(CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate) END) OVER (PARTITION BY o_custkey) AS since FROM orders) GROUP BY o_custkey")
def commits_behind(spark, sf):
    commits = table(spark, sf, "orders").select(F.col("o_custkey").alias("project"), F.lit("prod").alias("env"), F.col("o_orderkey").alias("commit"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("at"), "o_orderstatus")
    first = commits.filter("o_orderstatus = 'F'").groupBy("project", "env").agg(F.min_by("commit", F.struct("at", "commit")).alias("commit"))
    return incremental.commits_behind(commits.drop("o_orderstatus"), first)


# -- verification and evaluation

@query("SELECT d.lang AS \"check\", count(*) AS expected, count(l.doc_id) AS covered, floor(100.0 * count(l.doc_id) / count(*) + 0.5)::DOUBLE AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.lang")
def verify_coverage(spark, sf):
    return evaluate.coverage(table(spark, sf, "documents").select(F.col("lang").alias("check"), "doc_id"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT count(*) AS expected, count(l.doc_id) AS covered, floor(100.0 * count(l.doc_id) / count(*) + 0.5)::DOUBLE AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def verify_total(spark, sf):
    return evaluate.total(verify_coverage(spark, sf))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def verify_gaps(spark, sf):
    return evaluate.gaps(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), ["doc_id"])


def _eval_rows(spark, sf) -> DataFrame:
    """query_id, expected (the five smallest identifiers with the query's label), actual (its hits)."""
    hits = vector.top_k_batch(table(spark, sf, "embeddings"), _asked(spark, sf), threshold=None)
    actual = hits.groupBy("query_id", "query_label").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias("actual"))
    first = table(spark, sf, "embeddings").withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter("place <= 5")
    same = first.groupBy(F.col("label").alias("query_label")).agg(F.sort_array(F.collect_list("vec_id")).alias("expected"))
    return actual.join(same, "query_label")


_EVAL = f"""a AS (SELECT query_id, list(vec_id ORDER BY rank) AS actual FROM ({_RANKED}) WHERE rank <= 5 GROUP BY query_id),
x AS (SELECT label, list(vec_id ORDER BY vec_id)[1:5] AS expected FROM embeddings GROUP BY label),
q AS (SELECT a.query_id, actual, expected FROM a JOIN embeddings e ON e.vec_id = a.query_id JOIN x ON x.label = e.label),
m AS (SELECT query_id, len(list_intersect(expected, actual)) / len(expected) AS hit_rate, list_sum(list_transform(expected, lambda y: coalesce(1.0::DOUBLE / nullif(list_position(actual, y), 0), 0))) / len(expected) AS mrr FROM q)"""


@query(f"WITH {_EVAL} SELECT query_id, hit_rate::DOUBLE AS hit_rate, floor(mrr * 1000000 + 0.5) / 1000000 AS mrr FROM m")
def eval_hits_and_mrr(spark, sf):
    rows = _eval_rows(spark, sf)
    return rows.select("query_id", evaluate.hit_rate(F.col("expected"), F.col("actual")).alias("hit_rate"), tx.round_half_up(evaluate.reciprocal_rank(F.col("expected"), F.col("actual")), 6).alias("mrr"))


@query(f"WITH {_EVAL} SELECT floor(avg(hit_rate) * 1000 + 0.5) / 1000 AS hit_rate, floor(avg(mrr) * 1000 + 0.5) / 1000 AS mrr, count(*) AS total_queries FROM m")
def eval_summary(spark, sf):
    rows = _eval_rows(spark, sf)
    each = rows.select("query_id", evaluate.hit_rate(F.col("expected"), F.col("actual")).alias("hit_rate"), evaluate.reciprocal_rank(F.col("expected"), F.col("actual")).alias("mrr"), F.lit(1.0).alias("graph_recall"), F.lit(None).cast("double").alias("provenance"), F.lit(False).alias("stale"))
    return evaluate.summary(each).select("hit_rate", "mrr", "total_queries")


@query("SELECT c_custkey AS query_id, sum((n_regionkey = 0)::INTEGER)::BIGINT AS \"right\", count(*) AS asked FROM (SELECT DISTINCT c_custkey, c_nationkey FROM customer) JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey")
def eval_provenance(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    expected = rows.select(F.col("c_custkey").alias("query_id"), F.col("n_name").alias("symbol"), F.lit("0").alias("from_file"))
    shown = rows.select(F.col("c_custkey").alias("query_id"), F.col("n_name").alias("symbol"), F.col("n_regionkey").cast("string").alias("from_file"))
    return evaluate.provenance(expected, shown)


@query("SELECT doc_id AS file_path, quality AS query_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def eval_stale(spark, sf):
    return evaluate.stale_expectations(table(spark, sf, "labels").select(F.col("quality").alias("query_id"), F.col("doc_id").alias("file_path")), table(spark, sf, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("file_path")))


# -- rendering

@query("SELECT r_name AS class_name, '# ' || r_name || chr(10) || chr(10) || '| name | code | description |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' | a\\|b |', chr(10) ORDER BY n_name COLLATE \"binary\") || chr(10) AS body FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name".replace(' COLLATE "binary"', ""))
def render_enums(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return render.enums(rows.select(F.col("r_name").alias("class_name"), F.col("n_name").alias("code_name"), F.col("n_nationkey").alias("code"), F.lit("a|b").alias("description")))


@query("SELECT o_orderpriority AS module, 'f' || o_orderkey AS name, steps FROM (SELECT *, o_custkey + CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END AS w, o_custkey AS steps FROM orders) QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY w DESC, CASE WHEN o_orderstatus = 'F' THEN 'submit' ELSE '' END || 'f' || o_orderkey) = 1")
def entry_flows(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("module"), F.concat(F.when(F.col("o_orderstatus") == "F", "submit").otherwise(""), F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_custkey").alias("steps"))
    return render.entry_flows(rows).select("module", F.regexp_replace("name", "^submit", "").alias("name"), "steps")


@query("SELECT source AS module, lang AS kb_layer, count(*) AS n FROM documents GROUP BY ALL")
def navigation_counts(spark, sf):
    return render.index(table(spark, sf, "documents").select(F.col("source").alias("module"), F.col("lang").alias("kb_layer")))


# -- plain SQL, passed through

def _sql(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        from ..sources.tables import register

        register(spark, sf)
        return spark.sql(spark_sql)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, duck_sql or spark_sql


_sql("passthrough_pricing", "SELECT l_returnflag, l_linestatus, count(*) AS n, min(l_quantity) AS least, max(l_extendedprice) AS most, cast(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_shipdate <= DATE '2001-09-02' GROUP BY l_returnflag, l_linestatus")
_sql("passthrough_join", "SELECT n_name, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("passthrough_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_sql("passthrough_semi", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
_sql("passthrough_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("passthrough_rank", "SELECT * FROM (SELECT o_custkey, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders) t WHERE r <= 3")
_sql("passthrough_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("passthrough_sets", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
_sql("passthrough_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
_sql("passthrough_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
