"""Many names in many texts: Aho-Corasick automata over bounded shards of the names, so that a text is read once for
each shard and the work follows the text and the hits, not the product of names and texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of names that one automaton holds at most (about); a worker holds one at a time.
SHARD_BYTES = 16 << 20
#: Hits that a task remembers before it passes them on.
FLUSH = 200_000

_OPEN: dict[str, tuple] = {}


def _automaton(key: str, rows: list[tuple]):
    """Names with the modules they stand for, and the modules that the empty name stands for."""
    if key not in _OPEN:
        import ahocorasick

        modules: dict[str, set] = {}
        for module, name in rows:
            modules.setdefault(name, set()).add(module)
        everywhere = modules.pop("", set())
        found = ahocorasick.Automaton()
        for name, own in modules.items():
            found.add_word(name, (name, own))
        if modules:
            found.make_automaton()
        _OPEN.clear()
        _OPEN[key] = (found if modules else None, everywhere)
    return _OPEN[key]


def _shards(names: DataFrame, shard_bytes: int) -> Iterator[list[tuple]]:
    """The distinct names, a bounded shard of them at a time."""
    rows = names.filter("module is not null and name is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("name") + 16), F.lit(0))).first()[0]
    n = max(1, -(-size // shard_bytes))
    for i in range(n if size else 0):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == i).collect()]


def _hits(own: tuple, module, text: str) -> Iterator[str]:
    """Names of a module that a text holds, each as often as it does."""
    found, everywhere = own
    if module in everywhere:
        yield ""
    if found is not None and text:
        for _, (name, modules) in found.iter(text):
            if module in modules:
                yield name


def contained(names: DataFrame, texts: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """module, name: names that some text of their module holds, as a part of it or the whole; each once. names:
    module, name; texts: module, text. Nulls meet nothing; the empty name is in every text; letters must be equal."""
    kind = names.schema["module"].dataType
    schema, out = StructType([StructField("module", kind), StructField("name", names.schema["name"].dataType)]), None
    for rows in _shards(names.select("module", "name"), shard_bytes):
        key, sent = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(rows)  # a bounded shard

        def run(batches: Iterator[pa.RecordBatch], key=key, sent=sent) -> Iterator[pa.RecordBatch]:
            own, met = _automaton(key, sent.value), set()
            for batch in batches:
                before = len(met)
                fresh = []
                for module, text in zip(batch.column("module").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for name in _hits(own, module, text):
                        if (module, name) not in met:
                            met.add((module, name))
                            fresh.append((module, name))
                if len(met) > before:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in fresh], batch.schema.field("module").type), pa.array([r[1] for r in fresh], pa.string())], names=["module", "name"])
                if len(met) > FLUSH:
                    met.clear()

        found = texts.select("module", "text").filter("module is not null and text is not null").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out.distinct()


def holding(texts: DataFrame, names: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """module, text: distinct texts that hold some name of their module, the other way round."""
    schema, out = texts.select("module", "text").schema, None
    for rows in _shards(names.select("module", "name"), shard_bytes):
        key, sent = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], key=key, sent=sent) -> Iterator[pa.RecordBatch]:
            own = _automaton(key, sent.value)
            for batch in batches:
                pairs = zip(batch.column("module").to_pylist(), batch.column("text").to_pylist(), strict=True)
                yield batch.filter(pa.array([next(_hits(own, m, t), None) is not None for m, t in pairs], pa.bool_()))

        found = texts.select("module", "text").filter("module is not null and text is not null").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out.distinct()
