"""Types and what they extend or implement: which classes stand for an interface, however far below it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import settled, unsettle

#: What is added to an interface's name to name its implementation.
SUFFIX = "Impl"
_TYPE = r"(?m)^[ \t]*((?:public|protected|private|static|final|abstract|sealed|non-sealed)[ \t]+)*(class|interface|enum|record)[ \t]+(\w+)[^;{]*\{"


def types(files: DataFrame) -> DataFrame:
    """path, name, kind (class, interface, enum, record), abstract, parents (array of names): each type that a file
    declares at the start of a line. Type arguments are left out of names; a file without types has no row."""
    bare = F.col("content")
    for _ in range(4):  # type arguments inside type arguments
        bare = F.regexp_replace(bare, r"<[^<>;{}()]*>", "")
    rows = files.select("path", F.explode(F.regexp_extract_all(bare, F.lit(_TYPE), F.lit(0))).alias("h"))
    head = F.regexp_replace("h", r"\s+", " ")
    after = lambda word: F.regexp_extract(head, rf"\b{word} ([\w., ]+?) ?(?:extends|implements|permits|\{{)", 1)
    named = F.concat(*(F.split(after(w), " ?, ?") for w in ("extends", "implements")))
    parents = F.transform(F.filter(named, lambda x: F.trim(x) != ""), lambda x: F.element_at(F.split(F.trim(x), r"\."), -1))
    return rows.select("path", F.regexp_extract(head, _TYPE, 3).alias("name"), F.regexp_extract(head, _TYPE, 2).alias("kind"), head.rlike(r"\babstract\b.*\b(class|record)\b").alias("abstract"), F.array_distinct(parents).alias("parents"))


def implementations(found: DataFrame, depth: int | None = None) -> DataFrame:
    """interface, class_name, distance: each interface and each concrete class below it, by the fewest steps of extending
    and implementing; of at most ``depth`` steps if that is given. found: name, kind, abstract, parents. Types that a name stands for
    in several files count as one; cycles end; an interface that is only named, not declared, counts too if
    something implements it."""
    classes = found.filter("kind = 'class'").select(F.col("name").alias("parent")).distinct()
    up = found.select(F.col("name").alias("child"), F.explode("parents").alias("parent")).filter("child != parent").distinct()
    steps = settled(up)
    concrete = found.filter("kind in ('class', 'record', 'enum') and not abstract").select("name").distinct()
    frontier = settled(concrete.join(steps, F.col("name") == F.col("child")).select(F.col("name").alias("class_name"), F.col("parent").alias("interface"), F.lit(1).alias("distance")))
    seen, parts = frontier, [frontier]
    for n in count(2) if depth is None else range(2, depth + 1):
        further = frontier.join(steps, F.col("interface") == F.col("child")).select("class_name", F.col("parent").alias("interface")).distinct()
        frontier = settled(further.join(seen.select("class_name", "interface"), ["class_name", "interface"], "left_anti").withColumn("distance", F.lit(n)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = seen.unionByName(frontier)
    unsettle(steps)
    return seen.join(classes.withColumnRenamed("parent", "interface"), "interface", "left_anti").filter("class_name != interface").select("interface", "class_name", "distance")


def ranked(below: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """interface, class_name, place: implementations in the order in which they are taken: the one named after the
    interface, then the nearest, then the first by name. ``place`` counts from 0, as ``graph.call_graph`` wants it."""
    named = F.col("class_name") == F.concat("interface", F.lit(suffix))
    order = Window.partitionBy("interface").orderBy(F.desc(named), "distance", "class_name")
    return below.select("interface", "class_name", (F.row_number().over(order) - 1).alias("place"))
