"""Tables by name, and results that later steps may rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of the test schema, one Parquet each.
NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] = NAMES) -> None:
    """Temporary views for plain SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def _shared(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if context.master != "local" and not context.master.startswith(("local[", "local-cluster")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="kbspark-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def working_folder(spark: SparkSession) -> str:
    """A folder of its own in the one that driver and executors share, deleted when the driver ends."""
    path = f"{_shared(spark)}/settled-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """Written once to the checkpoint folder, which all executors share: lineage is
    cut, and a lost executor loses nothing."""
    path = working_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_path = path
    return out


def unsettle(*frames: DataFrame) -> None:
    """Deletes what ``settled`` wrote, once nothing reads it any more; a loop calls it so that a long
    session does not fill the disk."""
    for df in frames:
        _delete(df.sparkSession, df.settled_path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The rows of any SQL that a database answers."""
    return spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()


def ddl(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """table_name, ddl: what a MySQL database says created a table."""
    if not name.replace("_", "").isalnum():
        raise ValueError("the name of a table has letters, digits and underscores")
    info = spark._jvm.java.util.Properties()
    for key, value in options.items():
        info.setProperty(key, value)
    connection = spark._jvm.java.sql.DriverManager.getConnection(url, info)  # one row, so no job
    try:
        found = connection.createStatement().executeQuery(f"SHOW CREATE TABLE `{name}`")
        rows = [(found.getString(1), found.getString(2))] if found.next() else []
    finally:
        connection.close()
    return spark.createDataFrame(rows, "table_name string, ddl string")


def markdown_table(spark: SparkSession, text: str) -> DataFrame:
    """Rows of a small markdown table that a graph service returned, as strings."""
    cells = [[c.strip() for c in line.strip().strip("|").split("|")] for line in text.splitlines() if line.strip().startswith("|")]
    if len(cells) < 2:
        return spark.createDataFrame([], "value string")
    names = cells[0]
    rows = [dict(zip(names, r, strict=False)) for r in cells[1:] if not all(set(c) <= set("-: ") for c in r)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
