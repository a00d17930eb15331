"""Documents out of records: markdown tables and pages, one row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cell(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\|", r"\\|")


def table_body(rows: DataFrame, keys: list[str], columns: dict[str, str], order: list[str]) -> DataFrame:
    """keys, body, n: a markdown table of each group. columns: heading to column; order: of rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c)) for c in columns.values())), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    lines = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    body = F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["_line"]), "\n"), F.lit("\n"))
    return rows.groupBy(*keys).agg(body.alias("body"), F.count("*").alias("n"))


def page(title: Column, parts: list[Column]) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), *parts)


def entities(fields: DataFrame) -> DataFrame:
    """class_name, body: one page for each entity."""
    rows = table_body(fields, ["class_name", "table_name"], {"field": "field", "column": "column_name", "type": "type", "comment": "comment"}, ["field"])
    return rows.select("class_name", page(F.col("class_name"), [F.concat(F.lit("table: "), F.col("table_name")), F.col("body")]).alias("body"))


def enums(values: DataFrame) -> DataFrame:
    rows = table_body(values, ["class_name"], {"name": "code_name", "code": "code", "description": "description"}, ["code_name"])
    return rows.select("class_name", page(F.col("class_name"), [F.col("body")]).alias("body"))


def contracts(endpoints: DataFrame) -> DataFrame:
    rows = table_body(endpoints, ["class_name"], {"method": "http_method", "path": "endpoint", "name": "method_name", "returns": "return_type", "parameters": "params", "comment": "comment"}, ["endpoint", "http_method"])
    return rows.select("class_name", page(F.col("class_name"), [F.col("body")]).alias("body"))


def method_index(methods: DataFrame, module: str) -> DataFrame:
    """One page with a section for each class."""
    rows = table_body(methods, ["class_name"], {"method": "method_name", "returns": "return_type", "parameters": "params", "lines": "body_lines"}, ["line_start"])
    section = F.concat(F.lit("## "), F.col("class_name"), F.lit("\n\n"), F.col("body"))
    return rows.agg(F.concat(F.lit(f"# {module} methods\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("class_name", section.alias("s")))), lambda x: x["s"]), "\n")).alias("body"), F.sum("n").alias("n"))


def state_machine(transitions: DataFrame, name: str) -> DataFrame:
    """A page with a diagram of the transitions and their table: one row for each distinct one, so the page
    grows with the states of a machine, not with the code."""
    transitions = transitions.select("from_status", "to_status", "method_name").distinct()
    arrow = F.concat(F.lit("    "), F.col("from_status"), F.lit(" --> "), F.col("to_status"), F.lit(": "), F.col("method_name"))
    diagram = F.concat(F.lit("```mermaid\nstateDiagram-v2\n"), F.array_join(F.sort_array(F.collect_set(arrow)), "\n"), F.lit("\n```"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.col(c)) for c in ("from_status", "to_status", "method_name"))), F.lit(" |"))
    listed = F.concat(F.lit("| from | to | method |\n|---|---|---|\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\n"))
    return transitions.agg(F.concat(F.lit(f"# {name}\n\n"), diagram, F.lit("\n\n"), listed).alias("body"), F.count("*").alias("n"))


def flows(calls: DataFrame) -> DataFrame:
    """entry, body: the calls of each entry method in order of depth."""
    rows = table_body(calls, ["entry"], {"depth": "depth", "service": "service", "method": "callee", "via": "via"}, ["depth", "service", "callee"])
    return rows.select("entry", page(F.col("entry"), [F.col("body")]).alias("body"))


def entry_flows(flows: DataFrame) -> DataFrame:
    """The main flow of each module: most steps, with 100 more for names that submit, confirm or save;
    the first in order wins ties. flows: module, name, steps."""
    weight = F.col("steps") + F.when(F.col("name").rlike("(?i)submit|confirm|save"), 100).otherwise(0)
    order = Window.partitionBy("module").orderBy(F.desc("weight"), "name")
    return flows.withColumn("weight", weight).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def index(docs: DataFrame) -> DataFrame:
    """module, kb_layer, n: how many documents each module and layer has."""
    return docs.groupBy("module", "kb_layer").agg(F.count("*").alias("n"))


def eval_report(per_query: DataFrame) -> DataFrame:
    """One row for each query that went worse than perfect, with what went wrong."""
    worse = F.filter(F.array(F.when(F.col("hit_rate") < 1, F.lit("hits")), F.when(F.col("graph_recall") < 1, F.lit("graph")), F.when(F.col("provenance") < 1, F.lit("provenance")), F.when(F.col("stale"), F.lit("stale"))), lambda x: x.isNotNull())
    return per_query.withColumn("problems", worse).filter(F.size("problems") > 0)


def eval_lines(summary: DataFrame, per_query: DataFrame, provenance: DataFrame, stale: DataFrame) -> DataFrame:
    """section, place, line: the lines of an evaluation report, to be written in the order of section and place: totals (1), queries
    that went worse (2), symbols not found where they were expected (3), expected files that are gone (4). A section
    without rows has no lines. summary: one row of ``evaluate.summary``; per_query: query, hit_rate, graph_recall; provenance: query, symbol,
    from_file, ok; stale: query, file_path."""
    share = lambda c, digits: F.concat(F.format_number(F.col(c) * 100, digits), F.lit("%"))
    totals = {"Hit Rate": share("hit_rate", 1), "MRR": share("mrr", 1), "Graph Recall": share("graph_recall", 1), "Provenance Accuracy": share("provenance", 1), "Total Queries": F.col("total_queries").cast("string"), "Stale Queries": F.col("stale_queries").cast("string")}
    first = summary.select(F.posexplode(F.array(*(F.concat(F.lit(f"| {k} | "), v, F.lit(" |")) for k, v in totals.items()))).alias("place", "line"))
    missing = F.concat_ws(", ", F.when(F.col("hit_rate") < 1, "hits"), F.when(F.col("graph_recall") < 1, "graph"))
    worse = per_query.filter((F.col("hit_rate") < 1) | (F.col("graph_recall") < 1)).select("query", F.concat(F.lit("| "), cell(F.col("query")), F.lit(" | "), share("hit_rate", 0), F.lit(" | "), share("graph_recall", 0), F.lit(" | "), missing, F.lit(" |")).alias("line"))
    wrong = provenance.filter("not ok").select("query", F.concat(F.lit("- **"), F.col("symbol"), F.lit("** expected under `"), F.coalesce("from_file", F.lit("")), F.lit("` \u2014 not found: "), F.col("query")).alias("line"))
    gone = stale.select("query", F.concat(F.lit("| "), cell(F.col("query")), F.lit(" | `"), F.col("file_path"), F.lit("` |")).alias("line"))
    out = first.select(F.lit(1).alias("section"), F.col("place").cast("long").alias("place"), "line")
    for section, rows in ((2, worse), (3, wrong), (4, gone)):
        # A line's place is the number of lines that come before it in its own range.
        ordered = rows.orderBy("query", "line").withColumn("place", F.monotonically_increasing_id())
        out = out.unionByName(ordered.select(F.lit(section).alias("section"), "place", "line"))
    return out


def prompts(bodies: DataFrame, services: DataFrame, enums: DataFrame, errors: DataFrame) -> DataFrame:
    """entry, prompt: what a language model gets to describe a flow: the entry's body, its services'
    bodies (3000 characters), enums (1000) and errors (1500). bodies: entry, body; services: entry,
    text; enums and errors: module-wide single rows of text."""
    told = services.groupBy("entry").agg(F.array_join(F.sort_array(F.collect_list("text")), "\n").alias("s"))
    rows = bodies.join(told, "entry", "left").join(F.broadcast(enums.limit(1).select(F.col("text").alias("e")))).join(F.broadcast(errors.limit(1).select(F.col("text").alias("x"))))
    return rows.select("entry", F.concat_ws("\n\n", "body", F.substring("s", 1, 3000), F.substring("e", 1, 1000), F.substring("x", 1, 1500)).alias("prompt"))


def rules(found: DataFrame) -> DataFrame:
    """class_name, body: the rule candidates of a class, those with most decision points first."""
    rows = table_body(found.withColumn("_most", -F.col("decision_points")), ["class_name"], {"method": "method_name", "decisions": "decision_points"}, ["_most", "method_name"])
    return rows.select("class_name", page(F.col("class_name"), [F.col("body")]).alias("body"))


def verify_report(checks: DataFrame, missing: DataFrame) -> DataFrame:
    """check, body: what was expected and covered, and the names that are missing, in order. checks: check,
    expected, covered, coverage; missing: check, name."""
    names = missing.groupBy("check").agg(F.array_join(F.transform(F.sort_array(F.collect_list("name")), lambda x: F.concat(F.lit("- "), x)), "\n").alias("gone"))
    told = F.concat(F.lit("covered "), F.col("covered"), F.lit(" of "), F.col("expected"), F.lit(" ("), F.col("coverage").cast("int"), F.lit(" %)"))
    return checks.join(names, "check", "left").select("check", page(F.col("check"), [told, F.col("gone")]).alias("body"))


def listing(rows: DataFrame, key: str, columns: dict[str, str], order: list[str]) -> DataFrame:
    """key, body: a page with a table for each key."""
    return table_body(rows, [key], columns, order).select(key, page(F.col(key), [F.col("body")]).alias("body"))


def routes(found: DataFrame) -> DataFrame:
    """module, body: the routes of a front end. found: module, route, path."""
    return listing(found, "module", {"route": "route", "file": "path"}, ["route", "path"])


def api_calls(found: DataFrame) -> DataFrame:
    """module, body: the addresses that a front end calls. found: module, url, path."""
    return listing(found, "module", {"address": "url", "file": "path"}, ["url", "path"])


def pages(found: DataFrame) -> DataFrame:
    """module, body: page folders and their files. found: module, page, file_count."""
    return listing(found, "module", {"page": "page", "files": "file_count"}, ["page"])


def stores(found: DataFrame) -> DataFrame:
    """module, body. found: module, store, path."""
    return listing(found, "module", {"store": "store", "file": "path"}, ["store", "path"])


def topology(edges: DataFrame) -> DataFrame:
    """source, body: where a front end's calls go. edges: source, via, target, mode."""
    return listing(edges, "source", {"target": "target", "mode": "mode", "via": "via"}, ["target", "mode", "via"])


def backend_map(matches: DataFrame) -> DataFrame:
    """http_method, body: which flow serves a front end's function. matches: http_method,
    function_name, flow_path, matched."""
    return listing(matches, "http_method", {"function": "function_name", "flow": "flow_path", "words": "matched"}, ["function_name", "flow_path"])


def summary(kind: str, name: Column, n: Column) -> Column:
    """The line of a document's head that says what it holds."""
    return F.format_string(f"{kind} %s: %d", name, n)


def entry_document(docs: DataFrame, main: DataFrame) -> DataFrame:
    """module, body: the documents of each layer, counted, and the main flow of a module. docs: module,
    kb_layer; main: module, name."""
    counted = listing(index(docs), "module", {"layer": "kb_layer", "documents": "n"}, ["kb_layer"])
    flow = F.when(F.col("name").isNotNull(), F.concat(F.lit("main flow: "), F.col("name")))
    return counted.join(main.select("module", "name"), "module", "left").select("module", F.concat_ws("\n", "body", flow).alias("body"))


def global_index(docs: DataFrame) -> DataFrame:
    """module, entry: a line of the global index for each module."""
    return docs.groupBy("module").agg(F.count("*").alias("n"), F.countDistinct("kb_layer").alias("layers")).select("module", F.format_string("- [%s](%s/index.md): %d documents in %d layers", "module", "module", "n", "layers").alias("entry"))


def as_json(rows: DataFrame, columns: list[str]) -> DataFrame:
    """json: one object a row, fields in the order given."""
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def append_log(lines: DataFrame, folder: str) -> None:
    """Adds lines (columns at, text) to a log that is a folder of text files."""
    lines.select(F.concat_ws(" ", F.col("at").cast("string"), "text")).write.mode("append").text(folder)
