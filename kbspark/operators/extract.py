"""Typed records out of source texts, by regular expressions over whole texts or their lines.

Each extractor takes a table of files (path, content) and returns rows; nothing but the explicit
groupings by file is shuffled. ``lines_of`` gives the array of a text's lines, over which
look-back, look-ahead and brace matching are slices and folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import basename, camel_to_snake, strip
from .scopes import scope_ends

# Names that an extractor passes over, and what counts as a business rule.
PLAIN_METHODS = ["equals", "hashCode", "toString", "pkVal"]
NOISE_VARIABLES = ["log", "JSONObject", "JSON"]
NOISE_METHODS = ["info", "error", "warn", "debug", "toJSONString", "success", "fail"]
VERBS = ["Get", "Post", "Put", "Delete", "Patch"]
API_NAMES = "(?i)api|fetch|get|post|query|submit|save|delete|update"
RULE_INDICATORS = [
    "差异|阈值|threshold|自动匹配|自动确认|autoMatch|autoConfirm",
    "判断.*是否|校验.*金额|check.*amount|compare",
    "isDifferenceRatio|differenceRatio",
    "规则|rule.*type|RuleType",
    "needCreate|needCollaboration|needSync",
    "isFinish|isDoing|isAllowed|canSubmit|canConfirm",
]
METHOD = r"^\s*(public|protected)\s+(?:static\s+)?(?:abstract\s+)?(?:synchronized\s+)?(?:<[^>]+>\s+)?(\S+)\s+(\w+)\s*\(([^)]*)\)"
ANY_METHOD = r"^\s*(public|private|protected)\s+(?:static\s+)?(?:abstract\s+)?(?:synchronized\s+)?(?:<[^>]+>\s+)?(\S+)\s+(\w+)\s*\("


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def class_name(text: Column, path: Column) -> Column:
    found = first(text, r"(?:public\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)")
    return F.coalesce(found, F.regexp_replace(basename(path), r"\.java$", ""))


def base_path(text: Column) -> Column:
    return F.coalesce(first(text, r'@RequestMapping\("([^"]+)"\)'), F.lit(""))


def matching(lines: Column, pattern: str) -> Column:
    """Places (from 0) of the lines that match: what a file's places are joined with stays small, whatever its length."""
    return F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(pattern), i)), lambda i: i.isNotNull())


def around(lines: Column, i: Column, before: int, after: int) -> tuple[Column, Column]:
    """The lines above a place (from 0), ``before`` of them at most, and those below it, ``after`` of them at most."""
    low = F.greatest(i - before + 1, F.lit(1))
    return F.slice(lines, low, i - low + 1), F.slice(lines, i + 2, after)


def enum_values(files: DataFrame) -> DataFrame:
    """path, class_name, code_name, code, description (the code where none is given). Values are read
    up to ``private``, else the first semicolon; enums without values have no row."""
    upto = F.when(F.col("content").rlike(r"(?s)\{.*\bprivate\b"), F.regexp_extract("content", r"(?s)\{(.*?)\bprivate\b", 1)).otherwise(F.regexp_extract("content", r"(?s)\{([^;]*)", 1))
    values = every(upto, r'\w+\s*\(\s*"[^"]*"(?:\s*,\s*"[^"]*")?\s*\)')
    rows = files.select("path", first(F.col("content"), r"enum\s+(\w+)").alias("class_name"), F.explode(values).alias("v"))
    code = F.regexp_extract("v", r'\(\s*"([^"]*)"', 1)
    return rows.select("path", "class_name", F.regexp_extract("v", r"^(\w+)", 1).alias("code_name"), code.alias("code"), F.coalesce(first(F.col("v"), r',\s*"([^"]*)"'), code).alias("description"))


def entity_fields(files: DataFrame) -> DataFrame:
    """path, class_name, table_name, field, column_name, type, comment, is_key: private fields after a
    comment block and annotations."""
    body = F.regexp_extract("content", r"(?s)public\s+class\s+\w+[^{]*\{(.*)$", 1)
    block = r"/\*\*\s*\n((?:(?!\*/)[\s\S])*)\*/\s*\n((?:\s*@\w+[^\n]*\n)*)\s*private\s+(\w+(?:<[^>]+>)?)\s+(\w+)\s*;"
    rows = files.select("path", first(F.col("content"), r"public\s+class\s+(\w+)").alias("class_name"), first(F.col("content"), r'@TableName\("([^"]+)"\)').alias("table_name"), F.explode(every(body, block)).alias("f"))
    part = {k: F.regexp_extract("f", block, i) for i, k in enumerate(("comment", "marks", "type", "field"), 1)}
    said = F.filter(F.transform(lines_of(part["comment"]), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*\s?", ""))), lambda x: (x != "") & ~x.rlike("^(@see|</?p>)"))
    column = F.coalesce(first(part["marks"], r'@TableField\("([^"]+)"\)'), first(part["marks"], r'@TableId\(value\s*=\s*"([^"]+)"'), camel_to_snake(part["field"]))
    return rows.select("path", "class_name", "table_name", part["field"].alias("field"), column.alias("column_name"), part["type"].alias("type"), F.array_join(said, " ").alias("comment"), part["marks"].rlike("@TableId").alias("is_key"))


def ddl_columns(tables: DataFrame) -> DataFrame:
    """table_name, column_name, col_type (with all its arguments), not_null, default_value, comment."""
    rows = tables.select("table_name", F.explode(F.transform(lines_of(F.col("ddl")), lambda x: strip(x))).alias("l"))
    pattern = r"^`(\w+)`\s+(\w+(?:\([^)]*\))?(?:\s+unsigned)?)\s*(.*?)(?:,\s*)?$"
    rest = F.regexp_extract("l", pattern, 3)
    given = F.coalesce(first(rest, r"(?i)DEFAULT\s+'([^']*)'"), first(rest, r"(?i)DEFAULT\s+(\w+\([^)]*\))"), first(rest, r"(?i)DEFAULT\s+([^\s',]+)"))
    return rows.filter(F.col("l").rlike(r"^`\w+`\s")).select("table_name", F.regexp_extract("l", pattern, 1).alias("column_name"), F.regexp_extract("l", pattern, 2).alias("col_type"), rest.rlike("(?i)NOT NULL").alias("not_null"), given.alias("default_value"), F.regexp_extract(rest, r"(?i)COMMENT\s+'([^']*)'", 1).alias("comment"))


def ddl_indexes(tables: DataFrame) -> DataFrame:
    """table_name, index_name, kind (PRIMARY, UNIQUE, INDEX), columns in order."""
    rows = tables.select("table_name", F.explode(F.transform(lines_of(F.col("ddl")), lambda x: strip(x))).alias("l")).filter(F.col("l").rlike(r"(?i)^(PRIMARY|UNIQUE)?\s*KEY\b"))
    kind = F.when(F.col("l").rlike("(?i)^PRIMARY"), "PRIMARY").when(F.col("l").rlike("(?i)^UNIQUE"), "UNIQUE").otherwise("INDEX")
    names = F.transform(F.split(F.regexp_replace(F.regexp_extract("l", r"\(([^)]*)\)", 1), "`", ""), ","), lambda x: F.trim(x))
    return rows.select("table_name", F.when(kind == "PRIMARY", "PRIMARY").otherwise(F.regexp_extract("l", r"KEY\s+`(\w+)`", 1)).alias("index_name"), kind.alias("kind"), names.alias("columns"))


def endpoints(files: DataFrame) -> DataFrame:
    """path, class_name, http_method, endpoint (base and own path), method_name, return_type, params,
    comment, line: one row for each mapping annotation; the comment block starts up to ten lines
    above, the signature stands up to four lines below."""
    text = F.col("content")
    mark = r'@(Get|Post|Put|Delete|Patch)Mapping\("([^"]+)"\)'
    rows = files.select("path", first(text, r"public\s+class\s+(\w+)").alias("class_name"), base_path(text).alias("base"), lines_of(text).alias("ls"))
    rows = rows.withColumn("at", matching(F.col("ls"), mark))

    def place(i: Column) -> Column:
        above, below = around(F.col("ls"), i, 10, 4)
        return F.struct(i.alias("i"), F.get("ls", i).alias("l"), above.alias("above"), below.alias("below"))

    rows = rows.select("path", "class_name", "base", F.inline(F.transform("at", place)))
    below = F.filter("below", lambda x: x.rlike(r"public\s+\S+\s+\w+\s*\([^)]*\)"))
    signature = F.when(F.size(below) > 0, below[0]).otherwise("")
    shape = r"public\s+(\S+)\s+(\w+)\s*\(([^)]*)\)"
    arguments = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(signature, shape, 3), r"@\w+\s*", ""), r"\s+", " "))
    starts = F.filter(F.transform("above", lambda x, k: F.when(F.trim(x).startswith("/**"), k)), lambda k: k.isNotNull())
    block = F.when(F.size(starts) > 0, F.slice("above", F.element_at(starts, -1) + 1, 20)).otherwise(F.array().cast("array<string>"))
    said = F.filter(F.transform(block, lambda x: F.trim(F.regexp_replace(x, r"^\s*\*\s?", ""))), lambda x: (x != "") & ~x.rlike("^[@/<]"))
    return rows.select("path", "class_name", F.upper(F.regexp_extract("l", mark, 1)).alias("http_method"), F.concat("base", F.regexp_extract("l", mark, 2)).alias("endpoint"), F.regexp_extract(signature, shape, 2).alias("method_name"), F.regexp_extract(signature, shape, 1).alias("return_type"), arguments.alias("params"), F.array_join(said, " ").alias("comment"), (F.col("i") + 1).alias("line"))


def methods(files: DataFrame, pattern: str = METHOD, with_body: bool = False) -> DataFrame:
    """path, class_name, package_name, visibility, return_type, method_name, params (type and name of
    each), line_start, line_end, body_lines, annotations, [body]. Constructors and plain object methods go. A
    file's scopes are found in one pass, so time follows its lines; nested methods' bodies are held in each."""
    text = F.col("content")
    package = F.coalesce(first(text, r"(?m)^package\s+([\w.]+);"), F.lit(""))
    rows = files.select("path", class_name(text, F.col("path")).alias("class_name"), package.alias("package_name"), lines_of(text).alias("ls"), scope_ends(text).alias("ends"))
    rows = rows.withColumn("at", matching(F.col("ls"), pattern))

    def place(i: Column) -> Column:
        end = F.get("ends", i)
        parts = [i.alias("i"), F.get("ls", i).alias("l"), around(F.col("ls"), i, 10, 0)[0].alias("above"), end.alias("line_end")]
        return F.struct(*parts, *([F.array_join(F.slice("ls", i + 1, end - i), "\n").alias("body")] if with_body else []))

    rows = rows.select("path", "class_name", "package_name", F.inline(F.transform("at", place)))
    rows = rows.withColumn("method_name", F.regexp_extract("l", pattern, 3)).filter((F.col("method_name") != F.col("class_name")) & ~F.col("method_name").isin(PLAIN_METHODS))
    params = F.transform(F.split(F.trim(F.regexp_extract("l", r"\(([^)]*)\)", 1)), ","), lambda p: F.array_join(F.slice(F.split(F.trim(p), r"\s+"), F.greatest(F.size(F.split(F.trim(p), r"\s+")) - 1, F.lit(1)), 2), " "))
    above = F.reverse("above")
    state = F.struct(F.lit(False).alias("done"), F.array().cast("array<string>").alias("out"))
    mark = r"^@\w+(?:\([^)]*\))?"

    def look(s: Column, x: Column) -> Column:
        own = F.trim(x)
        stop = s["done"] | (own == "") | own.startswith("*/")
        return F.struct(stop.alias("done"), F.when(~stop & own.rlike(mark), F.concat(s["out"], F.array(F.regexp_extract(own, mark, 0)))).otherwise(s["out"]).alias("out"))

    rows = rows.withColumn("line_start", F.col("i") + 1)
    return rows.select("path", "class_name", "package_name", F.regexp_extract("l", pattern, 1).alias("visibility"), F.regexp_extract("l", pattern, 2).alias("return_type"), "method_name", F.array_join(params, ", ").alias("params"), "line_start", "line_end", (F.col("line_end") - F.col("line_start") + 1).alias("body_lines"), F.aggregate(above, state, look, lambda s: s["out"]).alias("annotations"), *(["body"] if with_body else []))


def method_bodies(files: DataFrame) -> DataFrame:
    """path, class_name, method_name, line_start, line_end, body of methods of any visibility."""
    return methods(files, ANY_METHOD, with_body=True).select("path", "class_name", "method_name", "line_start", "line_end", "body")


def injected_fields(files: DataFrame) -> DataFrame:
    """path, class_name, variable, type of fields that a container fills in."""
    found = every(F.col("content"), r"@(?:Resource|Autowired)\s*\n\s*private\s+\w+\s+\w+\s*;")
    rows = files.select("path", class_name(F.col("content"), F.col("path")).alias("class_name"), F.explode(found).alias("f"))
    shape = r"private\s+(\w+)\s+(\w+)\s*;"
    return rows.select("path", "class_name", F.regexp_extract("f", shape, 2).alias("variable"), F.regexp_extract("f", shape, 1).alias("type"))


def implemented(files: DataFrame) -> DataFrame:
    """class_name, interface, place of each interface that a class implements."""
    names = F.split(F.regexp_extract("content", r"class\s+\w+[^{]*?\bimplements\s+([\w,\s<>]+?)\s*\{", 1), r"\s*,\s*")
    rows = files.select(class_name(F.col("content"), F.col("path")).alias("class_name"), F.posexplode(names).alias("place", "interface"))
    return rows.filter(F.col("interface") != "").select("class_name", F.regexp_replace("interface", "<.*$", "").alias("interface"), "place")


def service_calls(bodies: DataFrame, injected: DataFrame) -> DataFrame:
    """class_name, method_name, place, variable, callee, service, is_external: calls on injected fields
    of the same class. The join is on class and variable, so it hashes."""
    found = F.posexplode(every(F.col("body"), r"\w+\.\w+\s*\("))
    rows = bodies.select("class_name", "method_name", found.alias("place", "c"))
    rows = rows.withColumn("variable", F.regexp_extract("c", r"^(\w+)\.", 1)).withColumn("callee", F.regexp_extract("c", r"\.(\w+)", 1))
    rows = rows.filter(~F.col("variable").isin(NOISE_VARIABLES) & ~F.col("callee").isin(NOISE_METHODS)).drop("c")
    met = rows.join(injected.select("class_name", "variable", F.col("type").alias("service")), ["class_name", "variable"])
    return met.withColumn("is_external", F.col("service").rlike("Client|Http"))


def rule_candidates(bodies: DataFrame, indicators: list[str] = RULE_INDICATORS) -> DataFrame:
    """Methods that look like business rules: an indicator, and two decision points or two indicators."""
    hits = F.filter(F.array(*(F.when(F.col("body").rlike(p), F.lit(p[:30])) for p in indicators)), lambda x: x.isNotNull())
    points = F.regexp_count("body", F.lit(r"\bif\s*\(")) + F.regexp_count("body", F.lit(r"\?.*:"))
    rows = bodies.withColumn("indicators", hits).withColumn("decision_points", points)
    kept = rows.filter((F.size("indicators") >= 1) & ((F.col("decision_points") >= 2) | (F.size("indicators") >= 2)))
    return kept.withColumn("snippet", F.substring("body", 1, 800)).drop("body")


def error_codes(files: DataFrame) -> DataFrame:
    """path, error_code, number, message."""
    shape = r'(\w+)\s*\(\s*(\d+)\s*,\s*"([^"]+)"\s*\)'
    rows = files.select("path", F.explode(every(F.col("content"), shape)).alias("e"))
    return rows.select("path", *(F.regexp_extract("e", shape, i).alias(n) for i, n in ((1, "error_code"), (2, "number"), (3, "message"))))


def throw_sites(files: DataFrame) -> DataFrame:
    """path, error_code, line, condition (80 characters at most)."""
    shape = r"Asserts\.check\w*\(\s*([^,]+),\s*(\w+)\.(\w+)\)"
    rows = files.select("path", F.posexplode(lines_of(F.col("content"))).alias("i", "l")).filter(F.col("l").rlike(shape))
    return rows.select("path", F.regexp_extract("l", shape, 3).alias("error_code"), (F.col("i") + 1).alias("line"), F.substring(F.trim(F.regexp_extract("l", shape, 1)), 1, 80).alias("condition"))


def transitions(files: DataFrame, enum: str, call: str, before: int = 500, after: int = 300) -> DataFrame:
    """path, to_status, from_status, method_name, line: each call of ``call`` with the first value of
    ``enum`` in the characters around it, the values listed there with ``List.of`` as origin (else
    ``any``), and the last method header before it.

    A file is cut at its calls; what the pieces before a call say (lines, the last header, the characters just before)
    is carried from piece to piece, so time follows the text.
    """
    shape = r"(?:public|private|protected)\s+\S+\s+(\w+)\s*\("
    pieces = F.split("content", rf"{call}\s*\(", -1)
    numbered = files.withColumn("_file", F.monotonically_increasing_id())  # of each file, before it is cut
    rows = numbered.select("path", "_file", F.posexplode(pieces).alias("k", "piece"))
    # A piece with its call behind it is what the text ahead of later calls is made of.
    headers = lambda text: F.element_at(F.concat(F.array(F.lit(None).cast("string")), every(text, shape, 1)), -1)
    whole = F.concat("piece", F.lit(f"{call}("))
    so_far = Window.partitionBy("_file").orderBy("k")
    past, until = so_far.rowsBetween(Window.unboundedPreceding, -2), so_far.rowsBetween(Window.unboundedPreceding, -1)
    near = so_far.rowsBetween(-1 - before // (len(call) + 1), -1)
    rows = rows.withColumns({"_closed": headers(whole), "_open": headers(F.col("piece")), "_lines": F.size(lines_of(F.col("piece"))) - 1, "_tail": F.right(whole, F.lit(before + len(call) + 1))})
    rows = rows.withColumns({
        "method_name": F.coalesce(F.lag("_open").over(so_far), F.last("_closed", ignorenulls=True).over(past), F.lit("")),
        "line": (F.sum("_lines").over(until) + 1).cast("int"),
        "_ahead": F.array_join(F.collect_list("_tail").over(near), ""),
    }).filter("k > 0")
    ahead = F.right(F.left("_ahead", F.greatest(F.length("_ahead") - (len(call) + 1), F.lit(0))), F.lit(before))
    window = F.concat(ahead, F.lit(f"{call}("), F.substring("piece", 1, after))
    rows = rows.withColumn("_window", window)
    listed = F.array_join(every(F.regexp_extract("_window", r"List\.of\(([^)]*)\)", 1), rf"{enum}\.(\w+)", 1), " | ")
    return rows.select("path", first(F.col("_window"), rf"{enum}\.(\w+)").alias("to_status"), F.coalesce(F.nullif(listed, F.lit("")), F.lit("any")).alias("from_status"), "method_name", "line")


def routes(files: DataFrame) -> DataFrame:
    """path, route of each route table entry."""
    return files.select("path", F.explode(every(F.col("content"), r"""path:\s*['"`]([^'"`]+)['"`]""", 1)).alias("route"))


def api_urls(files: DataFrame) -> DataFrame:
    """path, url of calls whose address is absolute or starts at the root; repeats by different
    patterns stay, as each is a use."""
    shapes = [r"(?i)(?:get|post|put|delete|patch)\s*[<(]\s*['\"`]([^'\"`]+)['\"`]", r"url:\s*['\"`]([^'\"`]+)['\"`]", r"request\s*\(\s*['\"`]([^'\"`]+)['\"`]", r"fetch\s*\(\s*['\"`]([^'\"`]+)['\"`]"]
    found = F.flatten(F.array(*(every(F.col("content"), s, 1) for s in shapes)))
    return files.select("path", F.explode(found).alias("url")).filter(F.col("url").rlike("^(/|http)"))


def api_functions(files: DataFrame) -> DataFrame:
    """path, function_name, http_method (by the name's start, else GET) of exported functions."""
    rows = files.select("path", F.explode(every(F.col("content"), r"export\s+(?:const|function)\s+(\w+)", 1)).alias("function_name")).filter(F.col("function_name").rlike(API_NAMES))
    verb = F.when(F.col("function_name").startswith("post"), "POST").when(F.col("function_name").startswith("put"), "PUT").when(F.col("function_name").startswith("delete"), "DELETE")
    return rows.withColumn("http_method", verb.otherwise("GET"))


def pages(paths: DataFrame) -> DataFrame:
    """Directories right under ``pages/`` with the number of their files and these in order."""
    rows = paths.withColumn("page", first(F.col("path"), r"(?:^|/)pages/([^/]+)/")).filter("page is not null")
    return rows.groupBy("page").agg(F.count("*").alias("file_count"), F.sort_array(F.collect_list("path")).alias("files"))


def components(paths: DataFrame) -> DataFrame:
    """Directories right under ``components/``."""
    return paths.select(first(F.col("path"), r"(?:^|/)components/([^/]+)/").alias("component")).filter("component is not null").distinct()


def stores(files: DataFrame) -> DataFrame:
    """path, store of files under ``store/`` that define one."""
    rows = files.filter(F.col("path").rlike("(^|/)store/") & F.col("content").rlike(r"create\s*[<(]|useStore|defineStore"))
    return rows.select("path", F.regexp_replace(basename(F.col("path")), r"\.[^.]+$", "").alias("store"))


def api_types(files: DataFrame, keyword: str, most_apis: int = 50, most_fields: int = 15) -> DataFrame:
    """path, api, api_path, place, field, type: fields of the request types of documented namespaces
    whose path holds the keyword; so many of each file and of each type are shown. A namespace reaches to the next one, over
    that one's comment, so of namespaces that follow each other every second is found: results are to be the same."""
    shape = r"接口路径：([^\n]+)(?:(?!\*/)[\s\S])*\*/\s*\nexport namespace (\w+)\s*\{((?:(?!\nexport namespace)[\s\S])*)"
    rows = files.select("path", every(F.col("content"), shape).alias("all"))
    told = F.filter(F.transform("all", lambda x: F.struct(F.regexp_extract(x, shape, 2).alias("api"), F.trim(F.regexp_extract(x, shape, 1)).alias("api_path"), every(F.regexp_extract(x, r"export interface Req\s*\{([\s\S]*?)\n\s*\}", 1), r"(?m)^\s*\w+\??:\s*[^;]+;").alias("fields"))), lambda a: F.contains(a["api_path"], F.lit(keyword)) & (F.size(a["fields"]) > 0))
    rows = rows.select("path", F.inline(F.slice(told, 1, most_apis))).select("path", "api", "api_path", F.posexplode(F.slice("fields", 1, most_fields)).alias("place", "f"))
    return rows.select("path", "api", "api_path", "place", F.regexp_extract("f", r"(\w+)\??:", 1).alias("field"), F.trim(F.regexp_extract("f", r":\s*([^;]+);", 1)).alias("type"))


def linkage_rules(files: DataFrame) -> DataFrame:
    """component, kind (hidden, disabled, dynamic-required), condition, fields of forms."""
    text, component = F.col("content"), F.element_at(F.concat(F.array(F.lit("")), F.split("path", "/")), -2).alias("component")
    names = lambda x: every(x, "'([^']+)'", 1)
    block = F.regexp_extract(text, r"hiddenFields\s*=\s*useMemo\(\(\)\s*=>\s*\{([\s\S]*?)\n\s*\},\s*\[", 1)
    condition = r"if\s*\(([^)]+)\)\s*\{([^}]+)\}"
    hidden = F.transform(every(block, condition), lambda x: F.struct(F.lit("hidden").alias("kind"), F.substring(F.trim(F.regexp_extract(x, condition, 1)), 1, 80).alias("condition"), names(x).alias("fields")))
    disabled = F.transform(every(text, r"disabledFields\s*[:=]\s*\[[^\]]+\]"), lambda x: F.struct(F.lit("disabled").alias("kind"), F.lit("editType").alias("condition"), names(x).alias("fields")))
    required = F.array(F.struct(F.lit("dynamic-required").alias("kind"), F.lit("requiredFieldList").alias("condition"), F.array_distinct(every(text, r"requiredFieldMap\.(\w+)", 1)).alias("fields")))
    rows = files.select(component, F.explode(F.concat(hidden, disabled, required)).alias("r"))
    return rows.select("component", "r.kind", "r.condition", "r.fields").filter(F.size("fields") > 0)


def forwards(files: DataFrame) -> DataFrame:
    """path, http_method, target, name of client interfaces: an annotation with an address and a name
    before a bracket on one of the next two lines."""
    mark = r'@(GET|POST|PUT|DELETE|PATCH)\("([^"]+)"\)'
    rows = files.select("path", lines_of(F.col("content")).alias("ls"))
    rows = rows.withColumn("at", matching(F.col("ls"), mark))
    rows = rows.select("path", F.inline(F.transform("at", lambda i: F.struct(F.get("ls", i).alias("l"), around(F.col("ls"), i, 0, 2)[1].alias("below")))))
    named = F.filter(F.transform("below", lambda x: first(x, r"(\w+)\s*\(")), lambda x: x.isNotNull())
    return rows.select("path", F.regexp_extract("l", mark, 1).alias("http_method"), F.regexp_extract("l", mark, 2).alias("target"), F.when(F.size(named) > 0, named[0]).alias("name"))


def dictionaries(files: DataFrame) -> DataFrame:
    """path, dictionary, comment, key, value of exported constant objects."""
    shape = r"/\*\*\s*(.*?)\s*\*/\s*export\s+const\s+(\w+)[^{]*\{([^}]*)\}"
    rows = files.select("path", F.explode(every(F.col("content"), shape)).alias("d"))
    pairs = F.explode(every(F.regexp_extract("d", shape, 3), r"""['"]?\w+['"]?\s*:\s*['"][^'"]*['"]"""))
    rows = rows.select("path", F.regexp_extract("d", shape, 2).alias("dictionary"), F.regexp_extract("d", shape, 1).alias("comment"), pairs.alias("p"))
    return rows.select("path", "dictionary", "comment", F.regexp_extract("p", r"(\w+)", 1).alias("key"), F.regexp_extract("p", r""":\s*['"]([^'"]*)""", 1).alias("value"))


def buttons(files: DataFrame, marker: str) -> DataFrame:
    """path, name, code of ``NAME = 'code'`` before a marker (everywhere where it is missing)."""
    ahead = F.split("content", marker, 2)[0]
    shape = r"([A-Z][A-Z_0-9]*)\s*=\s*'([^']+)'"
    rows = files.select("path", F.explode(every(ahead, shape)).alias("b"))
    return rows.select("path", F.regexp_extract("b", shape, 1).alias("name"), F.regexp_extract("b", shape, 2).alias("code"))


def symbols(docs: DataFrame) -> DataFrame:
    """path, symbol, place: classes of a document's sources in order, else its first heading if that
    reads like a class. docs: path, sources (array), body."""
    named = F.filter(F.transform("sources", lambda s: first(s, r"([A-Z]\w+)\.java$")), lambda s: s.isNotNull())
    head = first(F.col("body"), r"(?m)^#\s+([A-Z]\w*[a-z]\w*[A-Z]\w*)\s*$")
    found = F.when(F.size(F.coalesce(named, F.array().cast("array<string>"))) > 0, F.array_distinct(named)).when(head.isNotNull(), F.array(head))
    return docs.select("path", F.posexplode(found).alias("place", "symbol"))


def unfenced(text: Column) -> Column:
    """A response without the code fence around it."""
    return F.coalesce(first(text, r"(?s)^\s*```(?:markdown)?\s*\n(.*?)\n```\s*$"), text)


def graph_stats(text: Column) -> Column:
    """struct(nodes, edges) out of a summary line with separators for thousands."""
    def number(kind: str) -> Column:
        return F.regexp_replace(F.regexp_extract(text, rf"([\d,]+)\s+{kind}", 1), ",", "").try_cast("long")

    return F.struct(number("nodes").alias("nodes"), number("edges").alias("edges"))


#: Route nodes as a graph service gives them.
ROUTE_NODE = "struct<id:string,name:string,method:string,filePath:string,handlerSymbolId:string>"


def route_nodes(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """All columns and id, route, http_method, file_path, handler of route nodes that came as JSON. What is
    missing is empty, a missing verb is GET; text that is no JSON gives a node of defaults."""
    node = F.from_json(json_col, ROUTE_NODE)
    fields = {"id": ("id", ""), "route": ("name", ""), "http_method": ("method", "GET"), "file_path": ("filePath", ""), "handler": ("handlerSymbolId", "")}
    return rows.withColumn("_node", node).withColumns({k: F.coalesce(F.col(f"_node.{f}"), F.lit(d)) for k, (f, d) in fields.items()}).drop("_node", json_col)


def status_values(files: DataFrame, kind: str = "(Status|State)$") -> DataFrame:
    """class_name, code_name, code, description of the values of enums whose name matches: the
    states of a machine. Only what stands before the first private member is a value."""
    rows = enum_values(files).filter(F.col("class_name").rlike(kind))
    return rows.select("class_name", "code_name", "code", "description")


def controller_methods(files: DataFrame) -> DataFrame:
    """path, class_name, method_name, http_method, endpoint, comment, line, body: each mapped method with its text. A
    mapping belongs to the first method below it, of any visibility, if that has the name of the signature that follows the
    mapping; of several mappings above a method the last one counts. Overloads without a mapping have no row."""
    bodies = method_bodies(files).select("path", "method_name", "line_start", "body")
    near = endpoints(files).select("path", "class_name", F.col("method_name").alias("named"), "http_method", "endpoint", "comment", "line")
    # Methods and mappings of a file in the order of their lines: each method takes the last mapping since the one before it.
    marks = near.select("path", F.col("line").alias("at"), F.lit(0).alias("kind"), F.struct(*near.columns[1:]).alias("m"), F.lit(None).cast("struct<method_name:string,body:string>").alias("b"))
    own = bodies.select("path", F.col("line_start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["m"].dataType).alias("m"), F.struct("method_name", "body").alias("b"))
    # One window, so one sorted copy of the bodies in a task: the last mapping counts if it stands below the method before.
    before = Window.partitionBy("path").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = marks.unionByName(own).withColumns({"m": F.last("m", ignorenulls=True).over(before), "prior": F.last(F.when(F.col("kind") == 1, F.col("at")), ignorenulls=True).over(before)})
    met = rows.filter((F.col("kind") == 1) & F.col("m").isNotNull() & (F.col("prior").isNull() | (F.col("m.line") > F.col("prior"))))
    return met.filter(F.col("m.named") == F.col("b.method_name")).select("path", "m.class_name", "b.method_name", "m.http_method", "m.endpoint", "m.comment", "m.line", "b.body")


def candidates_by_class(candidates: DataFrame) -> DataFrame:
    """class_name, n, most: rule candidates of each class, and the decision points of the fullest."""
    return candidates.groupBy("class_name").agg(F.count("*").alias("n"), F.max("decision_points").alias("most"))


def linkage_by_kind(rules: DataFrame) -> DataFrame:
    """kind, n, components: linkage rules of each kind."""
    return rules.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("component").alias("components"))
