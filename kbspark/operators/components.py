"""Strongly connected components of a large directed graph, and cycles inside them.

Three steps take turns until no edge is left. Chains, runs of nodes with one edge in and one out, are
bypassed by pointer doubling, so a long chain costs a logarithm of its length in rounds. Nodes without an edge
in or out are trimmed, as no cycle holds them. What is left is coloured: the largest name that reaches a
node, going forward, is its colour; the nodes that reach their colour's own node, going backward inside the
colour, are that node's component. No step makes a table of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled, unsettle


def _degrees(steps: DataFrame) -> DataFrame:
    """symbol, ins, outs, before, after: degrees, and any neighbour on either side."""
    none = F.lit(None).cast(steps.schema["src"].dataType)
    ends = steps.select(F.col("src").alias("symbol"), F.lit(0).alias("i"), F.lit(1).alias("o"), none.alias("before"), F.col("dst").alias("after"))
    ends = ends.unionByName(steps.select(F.col("dst").alias("symbol"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("before"), none.alias("after")))
    return ends.groupBy("symbol").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"), F.max("before").alias("before"), F.max("after").alias("after"))


def _last(links: DataFrame) -> DataFrame:
    """symbol, last, least: where each node's chain of links (symbol, to) ends, by doubling, and the least name on
    the way; last is null on a ring."""
    n, rounds = links.count(), 0
    now = settled(links.select("symbol", "to", F.least("symbol", "to").alias("least")))
    while True:
        ahead = now.select(F.col("symbol").alias("to"), F.col("to").alias("next"), F.col("least").alias("other"))
        then = settled(now.join(ahead, "to", "left").select("symbol", F.coalesce("next", "to").alias("to"), F.least("least", F.coalesce("other", "least")).alias("least"), F.col("next").isNotNull().alias("more")))
        unsettle(now)
        moves, rounds, now = then.filter("more").count(), rounds + 1, then.drop("more")
        now.settled_path = then.settled_path
        if not moves or 2 ** (rounds - 1) > n:  # a chain had come to its end a round ago, so only rings go on
            return then.select("symbol", F.when(~F.col("more"), F.col("to")).alias("last"), "least")


def _compress(steps: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Edges without chains; for each bypassed node the ends of its chain; and the nodes of plain rings."""
    inner = settled(_degrees(steps).filter("ins = 1 and outs = 1 and before != symbol"))
    if inner.isEmpty():
        unsettle(inner)
        return steps, None, None
    ahead, back = (_last(inner.select("symbol", F.col(c).alias("to"))) for c in ("after", "before"))
    ends = settled(ahead.withColumnRenamed("last", "after").join(back.select("symbol", F.col("last").alias("before")), "symbol"))
    rings = ends.filter("after is null").select("symbol", F.col("least").alias("component"))
    bypassed = ends.filter("after is not null").select("symbol", "before", "after")
    kept = steps.join(ends.select(F.col("symbol").alias("src")), "src", "left_anti").join(ends.select(F.col("symbol").alias("dst")), "dst", "left_anti").select("src", "dst")
    short = bypassed.select(F.col("before").alias("src"), F.col("after").alias("dst")).distinct()
    out = settled(kept.unionByName(short).distinct())
    unsettle(inner)
    return out, bypassed, rings


def _trim(steps: DataFrame) -> DataFrame:
    """Edges between nodes that have both an edge in and one out, itself not counted."""
    real = steps.filter("src != dst")
    both = real.select("src").distinct().join(real.select(F.col("dst").alias("src")).distinct(), "src")
    return settled(real.join(both, "src", "left_semi").join(both.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst"))


def _colour(steps: DataFrame) -> DataFrame:
    """symbol, colour: the greatest name that reaches each node."""
    now = settled(steps.select("src").union(steps.select("dst")).distinct().select(F.col("src").alias("symbol"), F.col("src").alias("colour")))
    while True:
        sent = steps.join(now.select(F.col("symbol").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("symbol")).agg(F.max("colour").alias("sent"))
        then = settled(now.join(sent, "symbol", "left").select("symbol", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") > F.col("colour")).alias("moved")))
        moved = not then.filter("moved").isEmpty()
        unsettle(now)
        path = then.settled_path
        now = then.drop("moved")
        now.settled_path = path
        if not moved:
            return now


def _backward(steps: DataFrame, colours: DataFrame) -> DataFrame:
    """symbol, component: nodes that reach the node their colour is named after, inside the colour."""
    own = steps.join(colours.select(F.col("symbol").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("symbol").alias("dst"), F.col("colour").alias("b")), "dst")
    inside = settled(own.filter("a = b").select("src", "dst"))
    frontier = seen = settled(colours.filter("symbol = colour").select("symbol", F.col("colour").alias("component")))
    while True:
        found = inside.join(frontier.select(F.col("symbol").alias("dst"), "component"), "dst").select(F.col("src").alias("symbol"), "component").distinct()
        frontier = settled(found.join(seen, "symbol", "left_anti"))
        if frontier.isEmpty():
            unsettle(inside)
            return seen
        seen = settled(seen.unionByName(frontier))


def strong_components(edges: DataFrame) -> DataFrame:
    """symbol, component: for each node of a cycle of two nodes or more, its component, named after its least
    member. Nodes on no such cycle have no row. edges: src, dst; equal edges, edges of a node to itself
    and edges with a null end count for nothing."""
    steps = settled(edges.select("src", "dst").filter("src != dst").distinct())
    levels, known = [], None
    found = lambda more: more if known is None else known.unionByName(more)
    while not steps.isEmpty():
        while True:
            before = steps.count()
            steps, bypassed, rings = _compress(steps)
            if bypassed is not None:
                levels.append(bypassed)
                known = found(rings)
            steps = _trim(steps)
            if steps.count() == before:
                break
        if steps.isEmpty():
            break
        colours = _colour(steps)
        members = _backward(steps, colours)
        real = members.join(members.groupBy("component").count().filter("count > 1").select("component"), "component").select("symbol", "component")
        known = found(real)
        # An edge between colours is on no cycle, nor is one that touches a component from outside.
        own = steps.join(colours.select(F.col("symbol").alias("src"), F.col("colour").alias("a")), "src").join(colours.select(F.col("symbol").alias("dst"), F.col("colour").alias("b")), "dst").filter("a = b")
        steps = settled(own.join(members.select(F.col("symbol").alias("src")), "src", "left_anti").join(members.select(F.col("symbol").alias("dst")), "dst", "left_anti").select("src", "dst"))
    kind = edges.schema["src"].dataType.simpleString()
    known = settled(known) if known is not None else edges.sparkSession.createDataFrame([], f"symbol {kind}, component {kind}")
    for bypassed in reversed(levels):
        # A chain from a node back to itself is a cycle, and so is one whose ends are in one component.
        loops = bypassed.filter("before = after").select(F.col("before").alias("symbol")).distinct().join(known, "symbol", "left_anti")
        known = settled(known.unionByName(loops.select("symbol", F.col("symbol").alias("component"))))
        ends = bypassed.join(known.select(F.col("symbol").alias("before"), F.col("component").alias("a")), "before").join(known.select(F.col("symbol").alias("after"), F.col("component").alias("b")), "after")
        known = settled(known.unionByName(ends.filter("a = b").select("symbol", F.col("a").alias("component"))))
    named = known.groupBy("component").agg(F.min("symbol").alias("least"))
    return known.join(named, "component").select("symbol", F.col("least").alias("component"))


def shortest_cycles(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """module, length: for each node of a component the length of its shortest way back to itself; of at most ``depth`` steps
    if that is given. Only edges inside components are walked, and a node's search stops when it is back."""
    members = settled(strong_components(edges))
    a, b = (members.select(F.col("symbol").alias(c), F.col("component").alias(f"{c}_in")) for c in ("src", "dst"))
    inner = settled(edges.select("src", "dst").filter("src != dst").distinct().join(a, "src").join(b, "dst").filter("src_in = dst_in").select("src", "dst"))
    unsettle(members)
    frontier = inner.select(F.col("src").alias("module"), F.col("dst").alias("at"))
    seen, done, n = frontier, None, 1
    while True:
        n += 1
        if depth is not None and n > depth:
            break
        met = settled(frontier.join(inner, F.col("at") == F.col("src")).select("module", F.col("dst").alias("at")).distinct())
        back = met.filter("module = at").select("module", F.lit(n).alias("length"))
        done = back if done is None else done.unionByName(back)
        frontier = settled(met.join(seen, ["module", "at"], "left_anti").join(back, "module", "left_anti"))
        if frontier.isEmpty():
            break
        seen = settled(seen.unionByName(frontier))
    kind = edges.schema["src"].dataType.simpleString()
    return done if done is not None else edges.sparkSession.createDataFrame([], f"module {kind}, length int")
