"""Joins of records that describe the same thing from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def controllers(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge by class: what the first side has wins; source says which sides have it."""
    a = left.select("class_name", F.col("base_path").alias("a_base"), F.col("comment").alias("a_comment"), F.lit(True).alias("a"))
    b = right.select("class_name", F.col("base_path").alias("b_base"), F.col("comment").alias("b_comment"), F.lit(True).alias("b"))
    whole = a.join(b, "class_name", "full")
    source = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "graph").otherwise("regex")
    return whole.select("class_name", F.coalesce("a_base", "b_base").alias("base_path"), F.coalesce("a_comment", "b_comment").alias("comment"), source.alias("source"))


def endpoints(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge of endpoints by verb and path: the first side gives identity and order, the
    second one return type, parameters, comment and line (even empty ones). Of repeats on the second
    side the last line counts."""
    key = ["class_name", "http_method", "endpoint"]
    a = left.select("class_name", F.upper(F.coalesce("http_method", F.lit("GET"))).alias("http_method"), F.coalesce("endpoint", F.lit("")).alias("endpoint"), F.col("method_name").alias("a_name"), F.lit(True).alias("a"))
    last = right.withColumns({"http_method": F.upper(F.coalesce("http_method", F.lit("GET"))), "endpoint": F.coalesce("endpoint", F.lit(""))}).groupBy(*key).agg(F.max_by(F.struct("method_name", "return_type", "params", "comment", "line"), "line").alias("r"))
    whole = a.join(last, key, "full")
    return whole.select(*key, F.coalesce("a_name", "r.method_name").alias("method_name"), *(F.coalesce(f"r.{c}", F.lit("")).alias(c) for c in ("return_type", "params", "comment")), F.coalesce("r.line", F.lit(0)).alias("line"), F.coalesce("a", F.lit(False)).alias("in_graph"))


def fields_with_columns(fields: DataFrame, columns: DataFrame) -> DataFrame:
    """Entity fields with their table's columns, and the columns that no field maps (field null)."""
    key = ["table_name", "column_name"]
    mapped = fields.join(columns, key, "left")
    extra = columns.join(fields.select(*key).distinct(), key, "left_anti")
    return mapped.unionByName(extra, allowMissingColumns=True)


def segments(name: Column) -> Column:
    """Words of a function name without its verb, in lower case."""
    bare = F.regexp_replace(name, "^(get|post|put|delete)", "")
    return F.filter(F.split(F.lower(F.regexp_replace(bare, "([A-Z])", "/$1")), "/"), lambda x: x != "")


#: Letters of the n-grams that texts are indexed by.
GRAM = 3


def _grams(text: Column, sizes: list[int]) -> Column:
    """The distinct n-grams of a text, of each size that it is long enough for."""
    cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(cut(n) for n in sizes)))


def parts(short: DataFrame, long: DataFrame) -> DataFrame:
    """short, long: pairs of texts (column text of either side) of which the first is part of the second.

    The longer texts are indexed by their n-grams. All grams of a text stand in whatever holds it, so it is enough to look one up:
    the rarest, which no common gram can make hot. What meets there is checked exactly. Texts shorter than a gram are grams
    themselves. Empty and null texts meet nothing.
    """
    index = long.select(F.col("text").alias("long")).filter("long != ''").distinct().select("long", F.explode(_grams(F.col("long"), list(range(1, GRAM + 1)))).alias("gram"))
    often = index.groupBy("gram").count()
    own = short.select(F.col("text").alias("short")).filter("short != ''").distinct()
    keys = own.select("short", F.explode(F.when(F.length("short") < GRAM, F.array("short")).otherwise(_grams(F.col("short"), [GRAM]))).alias("gram"))
    counted = keys.join(often, "gram", "left")  # a gram that is nowhere rules its text out
    rarest = counted.groupBy("short").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "gram")).alias("g")).filter("g.n > 0").select("short", "g.gram")
    return rarest.join(index, "gram").filter(F.contains("long", F.col("short"))).select("short", "long")


def best_match(functions: DataFrame, flows: DataFrame, least: int = 2) -> DataFrame:
    """For each function (function_name, http_method) the flow (flow_path, place) of the same verb
    with the most words in common, either way a part of the other; ``least`` words at least, the
    first place wins ties.

    Words find the segments that hold them, or that they hold, in an index, and these the flows. A flow that shares ``least`` words with
    a function shares one of any that are left when ``least`` - 1 are taken away, so the commonest words of a
    function find nothing. The flows that the others find are then counted exactly.
    """
    asked = functions.select("function_name", "http_method", segments(F.col("function_name")).alias("ws")).distinct()
    given = flows.select("http_method", "flow_path", "place", F.filter(F.split("flow_path", "/"), lambda x: x != "").alias("ps")).distinct()
    words = asked.select("function_name", "http_method", F.posexplode("ws").alias("at", "w"))
    ends = given.select("http_method", "flow_path", "place", F.explode(F.array_distinct("ps")).alias("p"))
    w, p = words.select(F.col("w").alias("text")), ends.select(F.col("p").alias("text"))
    near = parts(w, p).toDF("w", "p").unionByName(parts(p, w).toDF("p", "w")).distinct()
    known = near.join(ends.groupBy("http_method", "p").count(), "p").groupBy("http_method", "w").agg(F.sum("count").alias("flows"))
    order = Window.partitionBy("function_name", "http_method").orderBy(F.desc("flows"), "at")
    rare = words.join(known, ["http_method", "w"]).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") >= least)
    found = rare.select("function_name", "http_method", "w").distinct().join(near, "w").join(ends, ["http_method", "p"]).select("function_name", "http_method", "flow_path", "place").distinct()
    met = found.join(asked, ["function_name", "http_method"]).join(given, ["http_method", "flow_path", "place"])
    met = met.withColumn("matched", F.size(F.filter("ws", lambda w: F.exists("ps", lambda p: F.contains(p, w) | F.contains(w, p)))))
    kept = met.filter(F.col("matched") >= least).groupBy("function_name", "http_method").agg(F.max_by(F.struct("flow_path", "matched"), F.struct("matched", -F.col("place"))).alias("b"))
    return kept.select("function_name", "http_method", "b.flow_path", "b.matched")


def common_base(routes: DataFrame) -> DataFrame:
    """group_id, base_path: the longest run of leading segments that all routes of a group share, but
    never the last segment of the first route. routes: group_id, place, route."""
    rows = routes.withColumn("s", F.filter(F.split("route", "/"), lambda x: x != ""))
    lead = rows.groupBy("group_id").agg(F.min_by("s", "place").alias("lead"))
    # Each route says how many leading segments it shares; the least of them holds for the group.
    shared = rows.join(lead, "group_id").select("group_id", "lead", F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("lead"), F.lit(1))), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get("s", i - 1) == F.get("lead", i - 1)), i).otherwise(n)).alias("n"))
    least = shared.groupBy("group_id").agg(F.min("n").alias("n"), F.first("lead").alias("lead"))
    n = F.least("n", F.greatest(F.size("lead") - 1, F.lit(0)))
    return least.select("group_id", F.when(n > 0, F.concat(F.lit("/"), F.array_join(F.slice("lead", 1, n), "/"))).otherwise("").alias("base_path"))


def first_per(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by an order, ties broken by nothing: the order must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def field_consistency(request: DataFrame, model: DataFrame) -> DataFrame:
    """owner, field, verdict: fields that both sides have, or only one. Columns owner, field, required
    of the request and nullable of the model."""
    whole = request.join(model, ["owner", "field"], "full")
    verdict = F.when(F.col("required").isNull(), "model only").when(F.col("nullable").isNull(), "request only").when(F.col("nullable") & F.col("required"), "stricter request").when(~F.col("nullable") & ~F.col("required"), "looser request").otherwise("same")
    return whole.select("owner", "field", verdict.alias("verdict"))


def app_relations(apps: DataFrame, relations: DataFrame) -> DataFrame:
    """name and the fields of the first relation (by place) whose app or frontend the name is; names
    without one keep nulls. Each side of the or is a join of its own on equality. relations: place,
    app, frontend, backend."""
    fields = [c for c in relations.columns]
    sides = [apps.join(relations, F.col("name") == F.col(c)).select("name", F.struct(*fields).alias("r")) for c in ("app", "frontend")]
    first = sides[0].unionByName(sides[1]).groupBy("name").agg(F.min_by("r", "r.place").alias("r"))
    return apps.join(first, "name", "left").select("name", *(F.col(f"r.{c}").alias(c) for c in fields))


def module_sources(modules: DataFrame) -> DataFrame:
    """module, repo, source: one row for each source of each repository of each module. modules: module,
    repos (array of struct of repo and an array sources); empty and null lists give no row."""
    repos = modules.select("module", F.explode("repos").alias("r"))
    return repos.select("module", F.col("r.repo").alias("repo"), F.explode("r.sources").alias("source"))


def sources_of(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """path, module, repo of paths that are a source: an equality on the source."""
    return paths.join(module_sources(modules), F.col("path") == F.col("source")).select("path", "module", "repo")


def ranked(rows: DataFrame, order: list, keys: list[str] | None = None) -> DataFrame:
    """All columns and place (from 1) in a stated order, of each group if keys are given. Without keys the
    rows meet in one sorted sequence: places are counted by range partition, not in one task."""
    if keys:
        return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    from ..sources.tables import settled

    sorted_rows = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    sizes = sorted_rows.groupBy("_part").agg(F.count("*").alias("n"), F.min("_row").alias("low"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return sorted_rows.join(F.broadcast(before), "_part").withColumn("place", (F.col("before") + F.col("_row") - F.col("low") + 1).cast("long")).drop("_part", "_row", "n", "low", "before")


def page(rows: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    """One page of rows in a stated order: so many after so many."""
    return rows.orderBy(*order).offset(skip).limit(limit)
