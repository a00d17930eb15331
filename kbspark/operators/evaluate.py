"""Coverage of what was extracted, and quality of what is found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up
from .names import contained, holding


def percent(covered: Column, expected: Column) -> Column:
    return F.when(expected == 0, 100.0).otherwise(round_half_up(100.0 * covered / F.nullif(expected, F.lit(0)), 0))


def coverage(expected: DataFrame, found: DataFrame, on: list[str], check: str = "check") -> DataFrame:
    """check, expected, covered, coverage by an equality of keys: a left join with flags, one shuffle."""
    hit = expected.join(found.select(*on).distinct().withColumn("_hit", F.lit(1)), on, "left")
    sums = hit.groupBy(check).agg(F.count("*").alias("expected"), F.sum(F.coalesce("_hit", F.lit(0))).alias("covered"))
    return sums.withColumn("coverage", percent(F.col("covered"), F.col("expected")))


def gaps(expected: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(found.select(*on).distinct(), on, "left_anti")


def total(checks: DataFrame) -> DataFrame:
    """expected, covered, coverage over all checks; no check covers more than it expects."""
    sums = checks.agg(F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.coalesce(F.sum(F.least("covered", "expected")), F.lit(0)).alias("covered"))
    return sums.withColumn("coverage", percent(F.col("covered"), F.col("expected")))


def covered_by_text(names: DataFrame, texts: DataFrame, module: str = "module") -> DataFrame:
    """Names that some text of the same module holds, as whole words or parts. names: module, name; texts: module,
    text. Each text is read once for all names (of a bounded shard)."""
    found = contained(names.select(F.col(module).alias("module"), "name"), texts.select(F.col(module).alias("module"), "text"))
    return found.withColumnRenamed("module", module)


def hit_rate(expected: Column, actual: Column) -> Column:
    """Share of the expected items that were found; 1 where nothing is expected."""
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.size(F.array_intersect(expected, actual)) / F.size(expected))


def reciprocal_rank(expected: Column, actual: Column) -> Column:
    """Mean over expected items of one over the place of the first find; 1 where nothing is expected."""
    ranks = F.transform(expected, lambda e: F.when(F.array_position(actual, e) > 0, 1.0 / F.array_position(actual, e)).otherwise(0.0))
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.aggregate(ranks, F.lit(0.0), lambda s, x: s + x) / F.size(expected))


def graph_recall(expected: Column, shown: Column) -> Column:
    """Share of expected symbols among those shown; 1 where none is expected."""
    return hit_rate(expected, shown)


def provenance(expected: DataFrame, shown: DataFrame) -> DataFrame:
    """query_id, right, asked: expected symbols that come from the expected file. expected and shown:
    query_id, symbol, from_file; an expected file of null accepts any."""
    pairs = shown.select("query_id", "symbol", F.col("from_file").alias("_from")).distinct()
    met = expected.join(pairs, ["query_id", "symbol"], "left")
    ok = F.max((F.col("_from").isNotNull() & (F.col("from_file").isNull() | (F.col("from_file") == F.col("_from")))).cast("int"))
    each = met.groupBy("query_id", "symbol", "from_file").agg(F.coalesce(ok, F.lit(0)).alias("ok"))
    return each.groupBy("query_id").agg(F.sum("ok").alias("right"), F.count("*").alias("asked"))


def stale_expectations(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """Expected files that are no longer there. expected: query_id, file_path; documents: file_path."""
    return expected.join(documents.select("file_path").distinct(), "file_path", "left_anti")


def summary(per_query: DataFrame) -> DataFrame:
    """Means to three places over all queries; provenance over those that verify it, 1 if none does.
    per_query: hit_rate, mrr, graph_recall, provenance (null where not verified), stale."""
    def mean(c: str) -> Column:
        return round_half_up(F.coalesce(F.avg(c), F.lit(1.0)), 3).alias(c)

    return per_query.agg(mean("hit_rate"), mean("mrr"), mean("graph_recall"), mean("provenance"), F.count("*").alias("total_queries"), F.coalesce(F.sum(F.col("stale").cast("long")), F.lit(0)).alias("stale_queries"))


def regressions(per_query: DataFrame) -> DataFrame:
    return per_query.filter((F.col("hit_rate") < 1) | (F.col("graph_recall") < 1))


#: Percent of a class's methods from which on the index has no gap.
ENOUGH = 90


def method_coverage(found: DataFrame) -> DataFrame:
    """Adds coverage (percent, 100 at most) and gap (under 90 percent). found: columns expected and
    covered."""
    share = F.least(percent(F.col("covered"), F.col("expected")), F.lit(100.0))
    return found.withColumn("coverage", share).withColumn("gap", share < ENOUGH)


def undocumented(names: DataFrame, titles: DataFrame) -> DataFrame:
    """module, name of names that no title of their module equals, or holds, or is part of. Equal ones go by a hash join;
    the rest is looked up in the titles, and the titles in it, by automata. names: module, name; titles: module, title."""
    rest = names.join(titles.select("module", F.col("title").alias("name")).distinct(), ["module", "name"], "left_anti")
    held = contained(rest, titles.select("module", F.col("title").alias("text")))
    holds = holding(rest.select("module", F.col("name").alias("text")), titles.select("module", F.col("title").alias("name")))
    return rest.join(held, ["module", "name"], "left_anti").join(holds.withColumnRenamed("text", "name"), ["module", "name"], "left_anti")
