"""What the training-data operators share: tables, hold-out folds, the shared folder, batches."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words: runs of anything but the ASCII white space (space, and 0x09 to 0x0D).
WORD = r"[^\x20\x09-\x0D]+"

#: Text bytes that one Python step holds as lists of words at a time.
SLICE_BYTES = 4 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that they can import it
    wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="kbspark-")) / "kbspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    # Rows are whole texts, and a batch is held on both sides of the pipe.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo ``modulus``; null for a null identifier."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Whether a row belongs to the held-out fold; false for a null identifier."""
    return F.coalesce(fold(id_col, modulus) == remainder, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one
    that is set here when the session names none, as in tests on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_already.isDefined():
            return set_already.get()
        if not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kbspark-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/kbspark-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage is cut, the
    work is done once, and a lost executor loses nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more, and lets Spark drop the shuffle
    files of finished steps, which it does when the driver's garbage is collected."""
    for df in frames:
        _delete(df.sparkSession, df.stored_path)
    frames[0].sparkSession._jvm.System.gc()


#: Rows of a few numbers that a join broadcasts at most; larger sides are shuffled.
SMALL_SIDE = 2_000_000


def small_side(df: DataFrame) -> DataFrame:
    """A stored side of a join (few narrow columns), broadcast if its rows, which are counted, allow it."""
    return F.broadcast(df) if df.count() <= SMALL_SIDE else df


def release() -> None:
    """Gives memory that a Python worker has freed back to the system: workers outlive their tasks, and an
    executor's memory holds them all."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cuts a record batch into runs of rows that hold about ``limit`` bytes of ``column``; a row
    of its own may hold more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(first, row - first)
            first, held = row, 0
        held += int(size)
    if first < batch.num_rows:
        yield batch.slice(first)
    release()


def check_names(docs: DataFrame, names) -> None:
    """Names that an operator adds must not be there already, however they are written."""
    taken = {c.lower() for c in docs.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")


def annotated(docs: DataFrame, text_col: str, names: dict[str, str], make) -> DataFrame:
    """All columns of ``docs`` and new ones (name: type), which ``make()`` computes on the executors:
    it returns a function from a list of texts to one tuple of values for each. Names that
    ``docs`` has already are an error."""
    check_names(docs, names)
    ship(docs.sparkSession)

    def run(batches):
        compute = make()
        for batch in batches:
            for part in slices(batch, text_col):
                new = list(zip(*compute(part.column(text_col).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, new)], names=[*part.schema.names, *names])

    schema = StructType(list(docs.schema.fields))
    for name, kind in names.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
