"""What a knowledge base claims, held against the code: transitions of flows, and the requirement sections that a method
belongs to."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import settled, unsettle

#: Sections that are recalled for a method where nobody has said which it is.
RECALLED = 3


def reachable_statuses(calls: DataFrame, status_calls: DataFrame) -> DataFrame:
    """symbol, to_status: the statuses that a symbol sets, itself or over what it calls, however deep. Statuses are
    passed up from the symbols that set them, so no table of all reachable pairs is made; cycles end. calls: src, dst;
    status_calls: symbol, to_status. Rows with nulls count for nothing."""
    steps = settled(calls.select("src", "dst").filter("src is not null and dst is not null").distinct())
    frontier = settled(status_calls.select("symbol", "to_status").filter("symbol is not null and to_status is not null").distinct())
    seen = frontier
    for _ in count():
        above = frontier.join(steps, F.col("symbol") == F.col("dst")).select(F.col("src").alias("symbol"), "to_status").distinct()
        frontier = settled(above.join(seen, ["symbol", "to_status"], "left_anti"))
        if frontier.isEmpty():
            unsettle(steps)
            return seen
        seen = seen.unionByName(frontier)


def transitions_in_code(claimed: DataFrame, calls: DataFrame, status_calls: DataFrame) -> DataFrame:
    """flow, entry, to_status, in_code: whether the code that a flow's entry reaches sets the status that the flow claims.
    claimed: flow, entry, to_status; what is not in code is a warning, not an error."""
    sets = reachable_statuses(calls, status_calls).withColumnRenamed("symbol", "entry").withColumn("in_code", F.lit(True))
    return claimed.select("flow", "entry", "to_status").distinct().join(sets, ["entry", "to_status"], "left").select("flow", "entry", "to_status", F.coalesce("in_code", F.lit(False)).alias("in_code"))


def paired(recalled: DataFrame, mapping: DataFrame, top: int = RECALLED) -> DataFrame:
    """method, section, file, rank, origin: the requirement sections of each method. A method that the mapping names has
    the mapped ones and no others (origin ``mapping``); any other has its ``top`` recalled ones (origin ``recall``).

    recalled: method, section, file, rank (from 1); mapping: method, section, file, in any order, each once. Methods
    of the mapping that recall does not know have rows, too.
    """
    said = mapping.select("method", "section", "file").filter("method is not null and section is not null").distinct()
    order = Window.partitionBy("method").orderBy("section", "file")
    mapped = said.withColumns({"rank": F.row_number().over(order), "origin": F.lit("mapping")})
    rest = recalled.filter(F.col("rank") <= top).join(said.select("method").distinct(), "method", "left_anti")
    return rest.select("method", "section", "file", F.col("rank").cast("int").alias("rank"), F.lit("recall").alias("origin")).unionByName(mapped)
