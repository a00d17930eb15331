"""Files as rows. Paths may be in any store that Spark reads; pruning is a filter on the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories that no scan enters, and more that scans of Java sources leave out.
PRUNE = [".git", "node_modules", "target", "build", "dist", ".vector-store"]
PRUNE_JAVA = {"default": ["test", "target", "build"], "methods": ["test", "tests", "target", "build"], "rules": ["entity", "dto", "vo", "enums", "test"], "states": ["test", "target", "build", "config"]}


def outside(path: Column, directories: list[str]) -> Column:
    return ~path.rlike("(^|/)(" + "|".join(d.replace(".", r"\.") for d in directories) + ")(/|$)")


def scan(spark: SparkSession, folder: str, extensions: list[str], prune: list[str] = PRUNE) -> DataFrame:
    """path (relative to the folder), content of the files with one of the extensions (``.java``).

    Only matching names are listed and read; each file is one row, and a folder of small files is
    packed into few tasks by the reader.
    """
    names = "*{" + ",".join(extensions) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(folder)
    path = F.regexp_replace("path", "^.*" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    return files.select(path.alias("path"), F.col("content").cast("string").alias("content")).filter(outside(F.col("path"), prune))


def scan_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, [".md"])


def scan_java(spark: SparkSession, folder: str, purpose: str = "default") -> DataFrame:
    return scan(spark, folder, [".java"], [*PRUNE, *PRUNE_JAVA[purpose]])


def scan_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, [".ts", ".tsx"])


def by_pattern(files: DataFrame, pattern: str) -> DataFrame:
    return files.filter(F.element_at(F.split("path", "/"), -1).rlike(pattern))


def by_name(files: DataFrame, name: str, below: str = "") -> DataFrame:
    """The first path in order with that name."""
    found = files.filter((F.element_at(F.split("path", "/"), -1) == name) & F.contains("path", F.lit(below)))
    return found.orderBy("path").limit(1)


def directory(files: DataFrame, names: list[str], depth: int = 6) -> DataFrame:
    """The first directory in order with one of the names, at most so deep."""
    parts = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    rows = files.select(parts.alias("p")).select("p", F.posexplode("p").alias("i", "name")).filter(F.col("name").isin(names) & (F.col("i") < depth))
    return rows.select(F.array_join(F.slice("p", 1, F.col("i") + 1), "/").alias("path")).distinct().orderBy("path").limit(1)


def modules(files: DataFrame) -> DataFrame:
    """Modules that a settings file of the build includes."""
    names = F.regexp_extract_all("content", F.lit(r"['\"]:?([\w:.-]+)['\"]"), F.lit(1))
    return files.filter(F.col("path").rlike(r"settings\.gradle(\.kts)?$")).select(F.explode(names).alias("module")).distinct()


def apps(files: DataFrame) -> DataFrame:
    """Frontend apps: directories under apps/, else under packages/, else the whole project."""
    def under(top: str) -> DataFrame:
        return files.select(F.nullif(F.regexp_extract("path", rf"^{top}/([^/]+)/", 1), F.lit("")).alias("app")).filter("app is not null").distinct()

    # One pass decides which of the three holds.
    has = files.agg(F.bool_or(F.col("path").rlike("^apps/[^/]+/")).alias("a"), F.bool_or(F.col("path").rlike("^packages/[^/]+/")).alias("p"), F.count("*").alias("n"))
    both = under("apps").withColumn("from_apps", F.lit(True)).unionByName(under("packages").withColumn("from_apps", F.lit(False)))
    found = both.join(F.broadcast(has)).filter((F.col("a") & F.col("from_apps")) | (~F.col("a") & F.col("p") & ~F.col("from_apps"))).select("app")
    return found.unionByName(has.filter("n > 0 and not a and not p").select(F.lit(".").alias("app")))


def versions(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """path, commit, committed_at: what a version-control client on the driver has told."""
    return spark.createDataFrame(rows, "path string, commit string, committed_at string").withColumn("committed_at", F.to_timestamp("committed_at"))
