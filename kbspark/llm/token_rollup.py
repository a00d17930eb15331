"""Token counts by source, language and tokenizer version, maintained by signed batches.

A batch of changes is reduced to additive amounts (documents and tokens, signed) for each source,
language and tokenizer version, and committed as one folder whose name is the batch's: the
folder is written aside and renamed, so a batch is there as a whole or not at all, and a batch that
is there already is not applied again. The totals are the sums over the committed batches;
compaction replaces batches by their sum and remembers their names. Versions are expressions, which
SQL can check, or public tokenizer files.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, annotated, new_folder, ship, stored
from .encoding import encoder

KEY = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint, batch string"
#: Tokenizer versions that need no vocabulary, as expressions of the text: words between white space;
#: runs of letters and digits, and each other character but white space on its own.
PIECE = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[^\x20\x09-\x0D]"
TOKENIZERS = {"words-1": WORD, "words-2": PIECE}


def count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under a version; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def insert(rows: DataFrame) -> DataFrame:
    """Changes that add rows with columns source, lang, tokenizer and tokens (null tokens: 0)."""
    return rows.select(*KEY, F.lit(1).cast("long").alias("docs"), F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"))


def delete(rows: DataFrame) -> DataFrame:
    """Changes that take rows back, with what they had added."""
    return insert(rows).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})


def revise(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that put new counts, sources, languages or versions in the place of old ones."""
    return delete(old).unionByName(insert(new))


class Rollup:
    """Totals in a folder that driver and executors share.

    ``batch=NAME`` is a committed batch. ``sum=NUMBER`` replaces the batches that it names, and whatever
    an older sum replaced: only the sum with the largest number counts, and of the batches only those
    that it does not name. So folders that a driver left behind when it died change nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        ship(spark)
        self.spark, self.folder = spark, (folder or new_folder(spark, "rollup")).rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda name: path(f"{self.folder}/{name}")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(""))

    def _state(self) -> tuple[str | None, list[str]]:
        """The newest sum, and the batches that it does not hold."""
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(""))]
        newest = max((n for n in names if n.startswith("sum=")), default=None)
        return newest, self._outside(newest, [n.removeprefix("batch=") for n in names if n.startswith("batch=")])

    def _members(self, total: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{total}").filter("batch is not null").select("batch")

    def _outside(self, total: str | None, batches: list[str]) -> list[str]:
        """The batches (those that have a folder, or one that is to come) that a sum does not name."""
        if total is None or not batches:
            return sorted(batches)
        inside = {r.batch for r in self._members(total).filter(F.col("batch").isin(batches)).collect()}
        return sorted(set(batches) - inside)

    def batches(self) -> DataFrame:
        """Names of the committed batches, those in the sum included."""
        newest, rest = self._state()
        own = self.spark.createDataFrame([(b,) for b in rest], "batch string")
        return own if newest is None else own.unionByName(self._members(newest))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch unless it is there; says whether it did. Changes with null keys count
        under a null key. Equal keys meet by partial sums before any shuffle."""
        if "/" in batch:
            raise ValueError("a batch's name is the name of a folder")
        newest, _ = self._state()
        if self._fs.exists(self._path(f"batch={batch}")) or not self._outside(newest, [batch]):
            return False
        sums = changes.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return self._publish(sums.withColumn("batch", F.lit(None).cast("string")), f"batch={batch}")

    def _publish(self, rows: DataFrame, name: str) -> bool:
        """Writes aside and renames, which fails where the name is taken: of two drivers one wins."""
        jvm, aside = self.spark._jvm, f"_{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{aside}")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(aside), self._path(name), options)
        except Py4JJavaError:
            self._fs.delete(self._path(aside), True)
            if not self._fs.exists(self._path(name)):
                raise
            return False
        return True

    def _sums(self, newest: str | None, rest: list[str]) -> DataFrame:
        names = [*([newest] if newest else []), *(f"batch={b}" for b in rest)]
        if not names:
            return self.spark.createDataFrame([], SCHEMA).select(*KEY, "docs", "tokens")
        rows = self.spark.read.schema(SCHEMA).parquet(*(f"{self.folder}/{n}" for n in names)).filter("batch is null")
        return rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of keys that hold documents or tokens."""
        kept = self._sums(*self._state()).filter("docs != 0 or tokens != 0")
        return kept.select(*KEY, F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Replaces all batches by one sum. A driver that dies before the old folders are gone leaves
        some, which no total counts and which the next compaction deletes."""
        newest, rest = self._state()
        number = int(newest.removeprefix("sum=")) + 1 if newest else 1
        rows = self._sums(newest, rest).withColumn("batch", F.lit(None).cast("string"))
        named = self.batches().select(*(F.lit(None).cast("string").alias(k) for k in KEY), F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("tokens"), "batch")
        if self._publish(rows.unionByName(named), f"sum={number:012d}"):
            self._clear()

    def _clear(self) -> None:
        newest, rest = self._state()
        for name in [x.getPath().getName() for x in self._fs.listStatus(self._path(""))]:
            old = name.startswith("sum=") and name < newest
            if old or (name.startswith("batch=") and name.removeprefix("batch=") not in rest):
                self._fs.delete(self._path(name), True)


def counted(docs: DataFrame, tokenizer_path: str, version: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with tokenizer (the version's name) and tokens: how many a public
    tokenizer file makes of each whole text; 0 for a null one."""
    def make():
        own = encoder(tokenizer_path)
        return lambda texts: [(version, len(own.encode(t or "")) // 4) for t in texts]

    return annotated(docs, text_col, {"tokenizer": "string", "tokens": "long"}, make)


def by_tokenizer(docs: DataFrame, paths: dict[str, str]) -> DataFrame:
    """Totals by source, language and version of tokenizer files: one batch inserts the documents as
    the first version counts them, and each further one revises them to the next."""
    rollup, before = Rollup(docs.sparkSession), None
    for version, path in paths.items():
        now = stored(counted(docs.select("source", "lang", "text"), path, version).drop("text"), f"counts-{version}")
        rollup.commit(version, insert(now) if before is None else revise(before, now))
        before = now
    rollup.compact()
    return rollup.totals()


def maintained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Totals after three batches over a whole table: all documents are inserted, counted as words-1;
    exact copies of a text but the one with the smallest identifier are deleted; documents that
    words-2 counts otherwise are revised to it. Each batch is committed twice, which changes nothing.

    Null texts are one group of equal texts with 0 tokens. Null sources and languages are keys of
    their own. Of rows that share both text and identifier, all stay. A null identifier counts
    as larger than any other.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("source"), F.col("lang"), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("same"), text.isNull().alias("none"), count(text, "words-1").alias("first"), count(text, "words-2").alias("second"))
    rows = stored(rows.withColumn("id", F.struct(F.col("id").isNull().alias("last"), "id")), "counted")
    least = stored(rows.groupBy("same", "none").agg(F.min("id").alias("least")), "first-copies")
    marked = stored(rows.join(least, ["same", "none"]).withColumn("copy", F.col("id") > F.col("least")), "marked")
    first = lambda df: df.withColumns({"tokenizer": F.lit("words-1"), "tokens": F.col("first")})
    second = lambda df: df.withColumns({"tokenizer": F.lit("words-2"), "tokens": F.col("second")})
    changed = marked.filter("not copy and first != second")
    rollup = Rollup(spark)
    for batch, changes in (("1-insert", insert(first(rows))), ("2-delete", delete(first(marked.filter("copy")))), ("3-revise", revise(first(changed), second(changed)))):
        for _ in range(2):
            rollup.commit(batch, changes)
    return rollup.totals()


ORACLE = r"""
WITH c AS (SELECT source, lang, doc_id, text,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS first,
  coalesce(len(regexp_extract_all(text, '[0-9A-Za-z_\x{80}-\x{10FFFF}]+|[^\x20\x09-\x0D]')), 0) AS second,
  min(doc_id) OVER (PARTITION BY text) AS least FROM documents),
k AS (SELECT *, CASE WHEN first = second THEN 'words-1' ELSE 'words-2' END AS tokenizer FROM c WHERE doc_id IS NOT DISTINCT FROM least)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(second)::BIGINT AS n_tokens FROM k GROUP BY ALL
"""
