"""Keeping derived tables current: what changed, what is stale, and replacing just that."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.store import Store

FRESH_HOURS = 12


def changes(old: DataFrame, new: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """key, status (added, changed, deleted, same): one full join on the key; no row moves twice."""
    a, b = old.select(key, F.col(mark).alias("_old")), new.select(key, F.col(mark).alias("_new"))
    whole = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "same").otherwise("changed")
    return whole.select(key, status.alias("status"))


def upsert(chunks: DataFrame, fresh: DataFrame, status: DataFrame, key: str = "path") -> DataFrame:
    """Chunks of changed and deleted documents go, fresh ones of changed and added documents come."""
    gone = status.filter(F.col("status").isin("changed", "deleted", "added")).select(key)
    come = status.filter(F.col("status").isin("changed", "added")).select(key)
    kept = chunks.join(gone, key, "left_anti")
    return kept.unionByName(fresh.join(come, key, "left_semi"), allowMissingColumns=True)


POINTER = "_current"


def publish(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> None:
    """Replaces the rows of a table folder as a whole. Each version is a Parquet folder of its own; a small
    file names the one that counts and is replaced by one rename, so readers (``published``) see the old
    rows or the new ones, whenever the writer dies. The version before stays for those that still
    read it; older ones are deleted."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    before = _named(spark, folder)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{folder}/{name}")
    out = files.create(hadoop.Path(f"{folder}/_{name}"), True)
    out.write(bytearray(name, "ascii"))
    out.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(hadoop.Path(f"{folder}/_{name}"), hadoop.Path(f"{folder}/{POINTER}"), options)
    for entry in files.listStatus(hadoop.Path(folder)):
        old = entry.getPath().getName()
        if old.startswith("v-") and old not in (name, before):
            files.delete(entry.getPath(), True)


def _named(spark: SparkSession, folder: str) -> str | None:
    """The version that counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{POINTER}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    source = files.open(path)
    try:
        return bytes(source.readAllBytes()).decode("ascii")
    finally:
        source.close()


def published(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame | None:
    """The rows of a table folder; none if nothing was published."""
    name = _named(spark, folder)
    if name is None:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}")


def guarded(existing: DataFrame, fresh: DataFrame, force: bool = False, key: str = "path") -> DataFrame:
    """Fresh documents that may be written: those edited by hand stay unless forced."""
    return fresh if force else fresh.join(existing.filter("human_edited").select(key), key, "left_anti")


def stale_documents(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """path, reason of documents with a changed source, the first of them in their own order. Documents
    edited by hand or without sources are left alone. docs: path, sources, human_edited;
    changed: source."""
    rows = docs.filter("not human_edited").select("path", F.posexplode("sources").alias("place", "source"))
    hit = rows.join(changed.select("source").distinct(), "source")
    return hit.groupBy("path").agg(F.min_by("source", "place").alias("reason"))


def edit_action(sources_changed: Column, edited: Column, force: Column) -> Column:
    """What to do with a document: regenerate, keep, or mark it as stale because a person edited it."""
    return F.when(~sources_changed & ~force, "keep").when(edited & ~force, "mark-stale").otherwise("regenerate")


def freshness(rows: DataFrame, now: Column) -> DataFrame:
    """Adds state: first of no-state, within-threshold, no-source, feature-branch, fetch-failed,
    up-to-date, behind. rows: last_check (timestamp), has_state, source, branch, fetch_ok, head,
    remote."""
    from .route import on_main_branch

    elapsed = F.unix_micros(now) - F.unix_micros("last_check")
    state = (
        F.when(~F.col("has_state"), "no-state")
        .when(elapsed < FRESH_HOURS * 3_600_000_000, "within-threshold")
        .when(F.col("source").isNull(), "no-source")
        .when(~on_main_branch(F.col("branch")), "feature-branch")
        .when(~F.col("fetch_ok"), "fetch-failed")
        .when(F.col("head") == F.col("remote"), "up-to-date")
        .otherwise("behind")
    )
    return rows.withColumn("state", state)


def mark_stale(docs: DataFrame, reason: str) -> DataFrame:
    fresh = ~F.coalesce(F.col("stale"), F.lit(False))
    return docs.withColumns({"stale_reason": F.when(fresh, F.lit(reason)).otherwise(F.col("stale_reason")), "stale": F.lit(True)})


def commits_behind(commits: DataFrame, indexed: DataFrame) -> DataFrame:
    """project, env, behind: commits after the indexed one. commits: project, env, commit, at;
    indexed: project, env, commit."""
    at = commits.join(indexed, ["project", "env", "commit"]).select("project", "env", F.col("at").alias("since"))
    return commits.join(at, ["project", "env"], "left").groupBy("project", "env").agg(F.sum((F.col("since").isNull() | (F.col("at") > F.col("since"))).cast("long")).alias("behind"))


def latest(versions: DataFrame, key: str = "path", version: str = "version") -> DataFrame:
    """The last version of each key: partial aggregation first, so repeats of one key meet few rows."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(key, "_r.*")


def regenerate(stale: DataFrame, generators: dict) -> DataFrame:
    """Documents anew: each type's generator gets the stale rows of its type; types without one are
    left out, and so is the second level of flows unless a generator is given for it."""
    out = None
    for kind, make in generators.items():
        made = make(stale.filter(F.col("type") == kind))
        out = made if out is None else out.unionByName(made)
    return out if out is not None else stale.limit(0)


def tally(results: DataFrame) -> DataFrame:
    """status, n of items that were made or failed."""
    return results.groupBy("status").agg(F.count("*").alias("n"))


class State:
    """Scan state: a row for each module. A change starts again on what another driver has written meanwhile,
    so of two drivers none loses."""

    VERSION = 2
    SCHEMA = "version int, module string, kb_path string, sources array<string>, last_scan timestamp, last_freshness_check timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder, self.SCHEMA, key="module", buckets=1)

    def read(self) -> DataFrame:
        return self.store.read()

    def is_old(self) -> bool:
        return not self.read().filter(F.coalesce("version", F.lit(1)) < self.VERSION).isEmpty()

    def add_module(self, module: str, kb_path: str, sources: list[str] = (), last_scan=None) -> None:
        self.store.upsert(self.spark.createDataFrame([(self.VERSION, module, kb_path, list(sources), last_scan, None)], self.SCHEMA))

    def checked(self, now) -> None:
        self.store.rewrite(lambda rows: rows.withColumn("last_freshness_check", F.lit(now).cast("timestamp")))
