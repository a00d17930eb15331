"""A keyed table whose batches rewrite only the data files that hold their keys.

A version is a manifest: a row for each data file, with its bucket, its range of keys and a Bloom filter of
them. A batch is matched with the manifest (bucket, range, filter), the files that may hold its keys are read and written anew
without these, its own rows go into new files, and the next manifest names what counts from then on. Data
files never change, so readers keep what they have, and a writer that dies leaves nothing that counts.

Manifests are numbered, and one gets its number by a rename that fails where the number is taken: of two
writers one wins, and the other starts its batch again on what the first has written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "file string, bucket int, rows long, lowest string, highest string, bits array<long>"
#: Buckets of keys, rows of a data file at most, words of a Bloom filter at most (64 bits each) and its hashes.
BUCKETS, FILE_ROWS, WORDS, HASHES = 64, 200_000, 32_768, 6
#: How often a batch that others overtake is started again.
ATTEMPTS = 20
#: Versions that ``vacuum`` leaves for readers.
KEPT = 2


def _positions(key: Column, words: Column) -> list[Column]:
    """The bits of a key in a filter of so many words, by double hashing."""
    a, b = F.hash(key).cast("long"), F.hash(key, F.lit(1)).cast("long").bitwiseOR(F.lit(1))  # in long numbers, so nothing overflows
    return [F.pmod(a + b * F.lit(i), words.cast("long") * 64) for i in range(HASHES)]


def _has(bits: Column, key: Column) -> Column:
    """Whether a filter has all bits of a key; one without words may hold anything."""
    held = F.lit(True)
    for p in _positions(key, F.greatest(F.size(bits), F.lit(1))):  # no lambda, for which a filter would be copied to each key that meets it
        held = held & (F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
    return (F.size(bits) == 0) | held


class Store:
    """Rows under keys, several rows to a key if there are. ``key`` is the name of the key column, compared as
    text; null keys are one key. A ``version`` column, if named, makes writes idempotent: rows of a key that
    are not newer than its stored ones change nothing."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, key: str = "path", version: str | None = None, buckets: int = BUCKETS, file_rows: int = FILE_ROWS):
        self.spark, self.folder, self.key, self.version = spark, folder.rstrip("/"), key, version
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.buckets, self.file_rows = buckets, file_rows
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.folder}/{name}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("manifest"))

    def _numbers(self) -> list[int]:
        return sorted(int(n) for x in self._fs.listStatus(self._path("manifest")) if (n := x.getPath().getName()).isdigit())

    def manifest(self, number: int | None = None) -> DataFrame:
        """A row for each data file of a version, the newest by default; its paths are inside the folder."""
        if number is None:
            number = max(self._numbers(), default=0)
        if not number:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/{number:020d}")

    def _read(self, files: list[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{f}" for f in files))

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        return self._read([r.file for r in self.manifest().select("file").collect()])  # a path for each file

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self._text()), F.lit(self.buckets)).cast("int")

    def _text(self) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(self.key).cast("string")), F.lit("-"))

    def _holding(self, manifest: DataFrame, keys: DataFrame) -> list[str]:
        """Files that may hold some of the keys (columns _bucket, _key): an equality of buckets, then range and filter."""
        met = keys.withColumnRenamed("_bucket", "bucket").join(manifest.select("file", "bucket", "lowest", "highest", "bits"), "bucket").filter((F.col("_key") >= F.col("lowest")) & (F.col("_key") <= F.col("highest")))
        return [r.file for r in met.filter(_has(F.col("bits"), F.col("_key"))).select("file").distinct().collect()]

    def _written(self, rows: DataFrame) -> tuple[str, DataFrame | None]:
        """Writes rows as data files, those of a bucket sorted by key; their manifest rows."""
        name = f"data-{uuid.uuid4().hex}"
        own = rows.select(*self.schema.names).withColumns({"_bucket": self._bucket(), "_text": self._text()})
        dealt = own.repartition("_bucket").sortWithinPartitions("_bucket", "_text").drop("_text")
        dealt.write.option("maxRecordsPerFile", self.file_rows).partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        if not any(x.getPath().getName().startswith("_bucket=") for x in self._fs.listStatus(self._path(name))):
            return name, None
        path = F.regexp_extract(F.col("_metadata.file_path"), rf"({name}/.*)$", 1)
        read = self.spark.read.schema(StructType([self.schema[self.key]])).parquet(*[f"{self.folder}/{name}/{x.getPath().getName()}" for x in self._fs.listStatus(self._path(name)) if x.getPath().getName().startswith("_bucket=")])
        keyed = read.select(path.alias("file"), self._text().alias("_key"), self._bucket().alias("bucket"))
        sums = keyed.groupBy("file", "bucket").agg(F.count("*").alias("rows"), F.min("_key").alias("lowest"), F.max("_key").alias("highest"), F.approx_count_distinct("_key").alias("keys"))
        # Ten bits for each key; the count is rounded up to a power of two, so that sizes vary little.
        sums = sums.withColumn("words", F.least(F.lit(WORDS), F.greatest(F.lit(2), F.pow(2.0, F.ceil(F.log2(F.col("keys") * 12 / 64.0 + 1)))).cast("int")))
        places = F.explode(F.array(*_positions(F.col("_key"), F.col("words"))))
        bits = keyed.join(F.broadcast(sums.select("file", "words")), "file").select("file", places.alias("p"))  # a row for each file
        word = bits.select("file", F.shiftright("p", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("v"))
        none = sums.select("file", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("w"), F.lit(0).cast("long").alias("v"))
        each = word.unionByName(none).groupBy("file", "w").agg(F.bit_or("v").alias("v"))
        filters = each.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("w", "v")))["v"].alias("bits"))
        return name, sums.join(filters, "file").select("file", "bucket", "rows", "lowest", "highest", "bits")

    def _commit(self, number: int, manifest: DataFrame) -> bool:
        """Publishes a version under its number; says whether the number was free."""
        aside = f"manifest/_{uuid.uuid4().hex}"
        manifest.write.parquet(f"{self.folder}/{aside}")
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(aside), self._path(f"manifest/{number:020d}"), options)
            return True
        except Py4JJavaError:
            self._fs.delete(self._path(aside), True)
            if not self._fs.exists(self._path(f"manifest/{number:020d}")):
                raise
            return False

    def _change(self, make: Callable[[int, DataFrame], tuple[list[str], DataFrame] | None]) -> dict:
        """Runs ``make`` (files that go, rows that come) on the newest version until its result is the next one."""
        for _ in range(ATTEMPTS):
            number = max(self._numbers(), default=0)
            manifest = self.manifest(number)
            made = make(number, manifest)
            if made is None:
                return {"version": number, "rewritten": 0, "written": 0}
            gone, rows = made
            name, fresh = self._written(rows)
            kept = manifest.filter(~F.col("file").isin(gone)) if gone else manifest
            if self._commit(number + 1, kept if fresh is None else kept.unionByName(fresh)):
                written = 0 if fresh is None else self.manifest(number + 1).filter(F.col("file").startswith(name)).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
                return {"version": number + 1, "rewritten": len(gone), "written": written}
            self._fs.delete(self._path(name), True)
        raise RuntimeError(f"other writers were faster {ATTEMPTS} times")

    def upsert(self, fresh: DataFrame, gone: DataFrame | None = None) -> dict:
        """Replaces all rows of the keys of ``fresh`` by its rows, and takes the keys of ``gone`` out. Returns the
        version, how many files were rewritten and how many rows were written."""
        def make(_, manifest):
            rows = fresh.select(*self.schema.names).withColumns({"_bucket": self._bucket(), "_key": self._text()})
            keys = rows.select("_bucket", "_key")
            if gone is not None:
                keys = keys.unionByName(gone.select(self.key).select(self._bucket().alias("_bucket"), self._text().alias("_key")))
            keys = keys.distinct()
            files = self._holding(manifest, keys)
            if self.version is not None:
                stored = self._read(files).groupBy(self._text().alias("_key")).agg(F.max(self.version).alias("_stored"))
                rows = rows.join(stored.hint("merge"), "_key", "left").filter(F.col("_stored").isNull() | (F.col(self.version) > F.col("_stored"))).drop("_stored")
                keys = rows.select("_bucket", "_key").distinct() if gone is None else keys
                if gone is None:
                    if keys.isEmpty():
                        return None
                    files = self._holding(manifest, keys)
            elif not files and keys.isEmpty():
                return None
            old = self._read(files).withColumn("_key", self._text())
            kept = old.join(keys.select("_key").hint("merge"), "_key", "left_anti").select(*self.schema.names)
            return files, kept.unionByName(rows.select(*self.schema.names))

        return self._change(make)

    def rewrite(self, make: Callable[[DataFrame], DataFrame]) -> dict:
        """Replaces all rows by what ``make`` makes of them."""
        def all_of(_, manifest):
            files = [r.file for r in manifest.select("file").collect()]
            return files, make(self._read(files))

        return self._change(all_of)

    def compact(self) -> dict:
        """Puts the small files of each bucket (under half of a file's rows) together, where it has several."""
        def make(_, manifest):
            small = manifest.filter(F.col("rows") * 2 < self.file_rows)
            several = small.groupBy("bucket").count().filter("count > 1").select("bucket")
            files = [r.file for r in small.join(several, "bucket").select("file").collect()]
            return (files, self._read(files)) if files else None

        return self._change(make)

    def vacuum(self, kept: int = KEPT) -> None:
        """Deletes versions before the last ``kept``, and data that none of these names. Not to be called while a
        batch is written, as its files are in no version yet."""
        numbers = self._numbers()
        live = set()
        for n in numbers[-kept:]:
            live |= {r.d for r in self.manifest(n).select(F.substring_index("file", "/", 1).alias("d")).distinct().collect()}
        for x in self._fs.listStatus(self._path("")):
            if (name := x.getPath().getName()).startswith("data-") and name not in live:
                self._fs.delete(x.getPath(), True)
        for n in numbers[:-kept]:
            self._fs.delete(self._path(f"manifest/{n:020d}"), True)
