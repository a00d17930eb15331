"""Flows of a code graph: maximal chains of calls from its entry points.

A frontier of paths grows by one call a round. Of the paths from one entry point to one symbol only one
goes on: a longer path takes the place of a shorter one, and of equally long ones the first in lexical order
stays, so the frontier holds a path for each entry point and symbol at most, however many ways there are.

Where calls form no cycle, the same chains are found from their ends: a frontier of chains grows to the callers, and holds
a path for each symbol and end at most, so the many entry points come in once, in the last round, and not in each.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled, unsettle


def entry_points(calls: DataFrame) -> DataFrame:
    """symbol: callers that nothing else calls. A symbol that only calls itself around is one, too."""
    steps = calls.filter("src != dst")
    return calls.select(F.col("src").alias("symbol")).distinct().join(steps.select(F.col("dst").alias("symbol")), "symbol", "left_anti")


def _from_ends(steps: DataFrame) -> DataFrame | None:
    """entry, end, path as ``flows`` tells them, found from the symbols that call nothing; None where that does not pay (no
    fewer ends than entry points) or where a cycle makes what a chain may hold depend on its way.

    Of the chains of one length from a symbol to an end the first in lexical order is its own name before the first chain of one of
    its callees, so one chain for each symbol, end and length is enough."""
    called = settled(steps.select(F.col("dst").alias("symbol")).distinct())
    # Equal calls meet in the shuffle of this join.
    marked = settled(steps.join(called.withColumn("inner", F.lit(True)).hint("merge"), F.col("src") == F.col("symbol"), "left").select("src", "dst", F.coalesce("inner", F.lit(False)).alias("inner")).dropDuplicates(["src", "dst"]))
    inner = settled(marked.filter("inner").select("src", "dst"))
    last = settled(called.join(inner.select(F.col("src").alias("symbol")).distinct(), "symbol", "left_anti"))
    old = [called, marked, inner, last]
    if last.count() >= marked.filter("not inner").select("src").distinct().count():
        unsettle(*old)
        return None
    chains = frontier = last.select(F.col("symbol").alias("at"), F.col("symbol").alias("end"), F.array("symbol").alias("path"))
    while True:
        longer = inner.join(frontier, F.col("dst") == F.col("at")).select(F.col("src").alias("at"), "end", "path", F.array_contains("path", F.col("src")).alias("again"))
        grown = settled(longer.groupBy("at", "end").agg(F.min("path").alias("path"), F.bool_or("again").alias("again")).select("at", "end", F.concat(F.array("at"), "path").alias("path"), "again"))
        old.append(grown)
        if ring := not grown.filter("again").isEmpty():
            break
        if grown.isEmpty():
            break
        frontier = grown.drop("again")
        chains = chains.unionByName(frontier)
    # A caller that no chain from an end meets goes round for ever.
    if ring or not inner.join(chains.select(F.col("at").alias("src")).distinct(), "src", "left_anti").isEmpty():
        unsettle(*old)
        return None
    longest = F.min(F.struct((-F.size("path")).alias("n"), "path"))["path"]  # of the longest the first
    best = settled(chains.groupBy("at", "end").agg(longest.alias("path")))
    entered = marked.filter("not inner").join(best.hint("merge"), F.col("dst") == F.col("at")).groupBy(F.col("src").alias("entry"), "end").agg(longest.alias("path"))
    out = settled(entered.select("entry", "end", F.concat(F.array("entry"), "path").alias("path")))
    unsettle(*old, best)
    return out


def flows(calls: DataFrame, entries: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """flow, entry, end, path (array of symbols): for each entry point and each symbol at which its calls
    end, the longest chain between the two that the frontier kept.

    calls: src, dst; entries: symbol, by default ``entry_points``. A chain ends where a symbol calls
    nothing, or nothing that is not on the chain already, which cuts cycles; with ``depth``, also after so many
    calls. An entry point that calls nothing is no flow. Rows with a null end of a call are left out.
    Equal calls count once.
    """
    steps = calls.select("src", "dst").filter("src is not null and dst is not null and src != dst")
    if entries is None and depth is None and (best := _from_ends(steps)) is not None:
        return best.select(F.concat_ws(" > ", "entry", "end").alias("flow"), "entry", "end", "path")
    steps = settled(steps.distinct())
    start = entry_points(steps) if entries is None else entries.select("symbol").filter("symbol is not null").distinct()
    frontier = settled(start.select(F.col("symbol").alias("entry"), F.col("symbol").alias("at"), F.array("symbol").alias("path")))
    ends, old = None, []
    for n in count(1):
        further = frontier.join(steps, F.col("at") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select("entry", F.col("at").alias("from"), F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        if depth is not None and n > depth:
            further = further.limit(0)
        further = settled(further)
        done = frontier.join(further.select("entry", F.col("from").alias("at")).distinct(), ["entry", "at"], "left_anti").filter(F.size("path") > 1)
        done = settled(done)
        ends = done if ends is None else ends.unionByName(done)
        grown = settled(further.groupBy("entry", "at").agg(F.min("path").alias("path")))
        unsettle(frontier, further)
        old.append(done)
        if grown.isEmpty():
            break
        frontier = grown
    best = settled(ends.groupBy("entry", F.col("at").alias("end")).agg(F.max_by("path", F.struct(F.size("path"))).alias("path")))
    unsettle(steps, grown, *old)
    return best.select(F.concat_ws(" > ", "entry", "end").alias("flow"), "entry", "end", "path")


def flow_steps(found: DataFrame) -> DataFrame:
    """flow, place (from 0), symbol of each step of ``flows``."""
    return found.select("flow", F.posexplode("path").alias("place", "symbol"))
