"""Queries over a code graph kept as two tables: nodes (uid, name, kind, path, line) and edges (src,
dst, edge_type). Traversals advance by joins of a frontier; what was seen is anti-joined, so cycles
end. Every round is written to the reliable checkpoint folder, which cuts the lineage."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import settled
from .components import shortest_cycles

METHOD_CAP = 8
FAN_OUT = 5
TOP_PER_MODULE = 2
# Names of plain accessors, which are no core methods.
ACCESSORS = "(?i)get|query|list|count"


def context(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """One hop around each symbol (column symbol): symbol, direction, edge_type, neighbour."""
    out = edges.join(symbols.select(F.col("symbol").alias("src")).distinct(), "src").select(F.col("src").alias("symbol"), F.lit("out").alias("direction"), "edge_type", F.col("dst").alias("neighbour"))
    into = edges.join(symbols.select(F.col("symbol").alias("dst")).distinct(), "dst").select(F.col("dst").alias("symbol"), F.lit("in").alias("direction"), "edge_type", F.col("src").alias("neighbour"))
    return out.unionByName(into)


def normalised(contexts: DataFrame) -> DataFrame:
    """Rows out of nested contexts: symbol, direction, edge_type, and the neighbour's fields. contexts:
    symbol, outgoing and incoming (maps of an edge type to an array of nodes); null ones are empty."""
    parts = [contexts.select("symbol", F.lit(d).alias("direction"), F.explode(c).alias("edge_type", "nodes")) for c, d in (("outgoing", "out"), ("incoming", "in"))]
    return parts[0].unionByName(parts[1]).select("symbol", "direction", "edge_type", F.inline("nodes"))


def cap(rows: DataFrame, n: int = METHOD_CAP, order: str = "place") -> DataFrame:
    """At most n ``has_method`` neighbours of each symbol, first ones first; others stay."""
    place = F.row_number().over(Window.partitionBy("symbol", "edge_type").orderBy(order))
    return rows.withColumn("_n", place).filter((F.col("edge_type") != "has_method") | (F.col("_n") <= n)).drop("_n")


def impact(edges: DataFrame, targets: DataFrame, depth: int = 1, upstream: bool = True) -> DataFrame:
    """symbol, distance of everything that reaches a target (or that it reaches) in at most ``depth``
    steps, the targets included at distance 0. Each symbol has its least distance."""
    near, far = ("dst", "src") if upstream else ("src", "dst")
    steps = edges.select(F.col(near).alias("symbol"), F.col(far).alias("next")).distinct()
    seen = settled(targets.select("symbol").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.join(steps, "symbol").select(F.col("next").alias("symbol")).distinct()
        frontier = settled(found.join(seen, "symbol", "left_anti").withColumn("distance", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def impact_summary(reached: DataFrame, owners: DataFrame) -> DataFrame:
    """direct, total, modules, risk of one impact. The risk is ours: high from 20 symbols or 3 modules,
    medium from 5 symbols or 2 modules, else low. owners: symbol, module."""
    others = reached.filter("distance > 0").join(owners, "symbol", "left")
    sums = others.agg(F.countDistinct(F.when(F.col("distance") == 1, F.col("symbol"))).alias("direct"), F.countDistinct("symbol").alias("total"), F.countDistinct("module").alias("modules"))
    risk = F.when((F.col("total") >= 20) | (F.col("modules") >= 3), "high").when((F.col("total") >= 5) | (F.col("modules") >= 2), "medium").otherwise("low")
    return sums.withColumn("risk", risk)


def trace(edges: DataFrame, start: str, end: str, depth: int | None = None) -> DataFrame:
    """path (array): the shortest way from start to end, the first in lexical order of those; no row
    where there is none, or none of at most ``depth`` steps if that is given. One way per symbol and round is kept, so the frontier is no larger than the
    graph."""
    steps = edges.select("src", "dst").distinct()
    frontier = edges.sparkSession.range(1).select(F.lit(start).alias("src"), F.array(F.lit(start)).alias("path"))
    seen = frontier.select("src")
    for _ in count() if depth is None else range(depth):
        if not (hit := frontier.filter(F.col("src") == end)).isEmpty():
            return hit.select("path")
        found = frontier.join(steps, "src").select(F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"))
        frontier = settled(found.join(seen, "src", "left_anti").groupBy("src").agg(F.min("path").alias("path")))
        if frontier.isEmpty():
            break
        seen = settled(seen.unionByName(frontier.select("src")))
    return frontier.filter(F.col("src") == end).select("path")


def search(nodes: DataFrame, text: str) -> DataFrame:
    return nodes.filter(F.contains(F.lower("name"), F.lit(text.lower())))


#: Lines of a bin of the join of lines with ranges of lines.
BIN = 64


def changed_symbols(changes: DataFrame, methods: DataFrame, width: int = BIN) -> DataFrame:
    """Methods on whose lines a change falls: path, symbol, changed_lines.

    Both sides are dealt by path and by bins of ``width`` lines, a method into every bin that it touches; a
    line is in one bin, so no pair meets twice, and a line is compared only with methods near it, however
    long the file is. changes: path, line; methods: path, symbol, line_start, line_end. Null paths and lines meet nothing.
    """
    bins = F.explode(F.sequence(F.floor(F.col("line_start") / width), F.floor(F.greatest("line_start", "line_end") / width)))
    spans = methods.select("path", "symbol", "line_start", "line_end").filter("line_start is not null and line_end is not null").withColumn("_bin", bins)
    lines = changes.select("path", "line").withColumn("_bin", F.floor(F.col("line") / width))
    # Neither side's size can be told before it is there (texts read, ranges dealt), so neither is sent whole.
    met = lines.join(spans.hint("merge"), ["path", "_bin"]).filter("line between line_start and line_end")
    return met.groupBy("path", "symbol").agg(F.count("*").alias("changed_lines"))


def high_fan_out(calls: DataFrame, least: int = FAN_OUT, top: int = TOP_PER_MODULE, skip: str | None = ACCESSORS) -> DataFrame:
    """The callers of each module with the most distinct callees. calls: module, caller, callee."""
    rows = calls.filter(~F.col("caller").rlike(skip)) if skip else calls
    fan = rows.groupBy("module", "caller").agg(F.countDistinct("callee").alias("fan_out")).filter(F.col("fan_out") >= least)
    order = Window.partitionBy("module").orderBy(F.desc("fan_out"), "caller")
    return fan.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def call_graph(calls: DataFrame, implemented: DataFrame) -> DataFrame:
    """Calls of entry methods to the second level: entry, service, callee, depth, via. The target is the
    service itself where it has methods, else its first implementation. calls: class_name,
    method_name, service, callee, is_entry; implemented: interface, class_name, place."""
    first_impl = implemented.groupBy("interface").agg(F.min_by("class_name", F.struct("place", "class_name")).alias("impl"))
    own = calls.select("class_name").distinct().withColumn("direct", F.col("class_name"))
    entry = F.concat_ws(".", "class_name", "method_name")
    level1 = calls.filter("is_entry").select(entry.alias("entry"), "service", "callee", F.lit(1).alias("depth"), F.lit(None).cast("string").alias("via"))
    target = level1.join(own.select(F.col("class_name").alias("service"), "direct"), "service", "left").join(first_impl.select(F.col("interface").alias("service"), "impl"), "service", "left")
    target = target.select("entry", "service", F.col("callee").alias("method_name"), F.coalesce("direct", "impl").alias("class_name")).distinct()
    second = calls.select("class_name", "method_name", F.col("service").alias("to"), "callee")
    level2 = target.join(second, ["class_name", "method_name"]).select("entry", F.col("to").alias("service"), "callee", F.lit(2).alias("depth"), F.concat_ws(".", "service", "method_name").alias("via"))
    return level1.unionByName(level2).distinct()


def module_cycles(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Modules that reach themselves over other modules: module, length of the shortest way back; of
    at most ``depth`` steps if that is given."""
    return shortest_cycles(edges, depth)


def inbound_contracts(calls: DataFrame) -> DataFrame:
    """callee_module, caller_module, calls and methods: one row for each pair of modules."""
    return calls.filter("callee_module != caller_module").groupBy("callee_module", "caller_module").agg(F.count("*").alias("calls"), F.countDistinct("callee").alias("methods"))


def topology(relations: DataFrame) -> DataFrame:
    """source, via, target, mode of project relations; a missing mode is direct."""
    return relations.select(F.coalesce("app", "frontend").alias("source"), F.col("gateway").alias("via"), F.col("backend").alias("target"), F.coalesce("mode", F.lit("direct")).alias("mode"))


def build(methods: DataFrame, injected: DataFrame, calls: DataFrame, implements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (uid, name, kind, path, line) and edges (src, dst, edge_type) out of extracted records: classes
    and their methods; has_method, implements, injects and calls. methods: path, class_name,
    method_name, line_start; injected: class_name, type; calls: class_name, method_name, service,
    callee; implements: class_name, interface."""
    method = F.concat_ws(".", "class_name", "method_name")
    classes = methods.groupBy("class_name").agg(F.min("path").alias("path")).select(F.col("class_name").alias("uid"), F.col("class_name").alias("name"), F.lit("class").alias("kind"), "path", F.lit(1).alias("line"))
    own = methods.groupBy(method.alias("uid"), F.col("method_name").alias("name")).agg(F.min_by("path", "line_start").alias("path"), F.min("line_start").alias("line"))
    nodes = classes.unionByName(own.select("uid", "name", F.lit("method").alias("kind"), "path", "line"))
    parts = [
        methods.select(F.col("class_name").alias("src"), method.alias("dst"), F.lit("has_method").alias("edge_type")),
        implements.select(F.col("class_name").alias("src"), F.col("interface").alias("dst"), F.lit("implements").alias("edge_type")),
        injected.select(F.col("class_name").alias("src"), F.col("type").alias("dst"), F.lit("injects").alias("edge_type")),
        calls.select(method.alias("src"), F.concat_ws(".", "service", "callee").alias("dst"), F.lit("calls").alias("edge_type")),
    ]
    edges = parts[0]
    for more in parts[1:]:
        edges = edges.unionByName(more)
    return nodes, edges.distinct()


def clusters(edges: DataFrame) -> DataFrame:
    """symbol, cluster: the smallest symbol that edges reach, whatever their direction. Labels are passed
    on and then shortened to the label's own label, so rounds grow with the logarithm of a path."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).filter("src != dst").distinct()
    steps = settled(both)
    label = settled(steps.groupBy(F.col("src").alias("symbol")).agg(F.least(F.min("src"), F.min("dst")).alias("cluster")))
    while True:
        near = steps.join(label.select(F.col("symbol").alias("dst"), F.col("cluster").alias("c")), "dst").groupBy(F.col("src").alias("symbol")).agg(F.min("c").alias("c"))
        passed = label.join(near, "symbol").select("symbol", F.least("cluster", "c").alias("cluster"))
        above = passed.select(F.col("symbol").alias("cluster"), F.col("cluster").alias("up"))
        now = settled(passed.join(above, "cluster", "left").select("symbol", F.least("cluster", F.coalesce("up", "cluster")).alias("cluster")))
        moved = now.join(label.withColumnRenamed("cluster", "old"), "symbol").filter("cluster != old")
        if moved.isEmpty():
            return now
        label = now


def candidates(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """name, uid, kind, path, ambiguous: the nodes that a name may mean; a name of several is ambiguous and
    the caller has to choose."""
    met = names.select("name").distinct().join(nodes.select("name", "uid", "kind", "path"), "name")
    return met.withColumn("ambiguous", F.count("*").over(Window.partitionBy("name")) > 1)


def affected_flows(reached: DataFrame, steps: DataFrame) -> DataFrame:
    """flow, hit, first: flows with a step that an impact reaches, how many steps, and the first of them.
    steps: flow, place, symbol."""
    met = steps.join(reached.select("symbol").distinct(), "symbol", "left_semi")
    return met.groupBy("flow").agg(F.count("*").alias("hit"), F.min("place").alias("first"))
