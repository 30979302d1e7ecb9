"""Helpers shared by the document operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daygrid.sources.store import folder

#: Bytes of text that a Python step holds at once; a longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 2000
#: The blanks of the word pattern [^\x20\x09-\x0D]+; bytes.split() cuts at exactly these.
BLANKS = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def prepare(spark: SparkSession) -> None:
    """Let the session send at most BATCH_ROWS rows at once to Python, so that batches of long texts fit beside the heap,
    and hand this package to its Python workers, once for each context."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    context = spark.sparkContext
    if not getattr(context, "_daygrid_sent", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        to = os.path.realpath(tempfile.mkdtemp(prefix="daygrid-code-"))  # the driver's own; Spark serves the archive to the workers
        atexit.register(shutil.rmtree, to, ignore_errors=True)
        context.addPyFile(shutil.make_archive(f"{to}/daygrid-code", "zip", root, "daygrid"))
        context._daygrid_sent = True


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text, under fixed names; a null text is empty. Other columns, whatever their names, are never read."""
    prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def crc_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that a lost executor repeats nothing before it."""
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict = {}


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: one thing at a time, so that operators that follow each other in
    the same workers don't add up their tables."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def alone() -> None:
    """For operators that keep nothing: leave the memory to this task."""
    _KEPT.clear()


def chunks(batches: Iterable[pa.RecordBatch], column: str | int = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `size` bytes in the column; rows stay whole."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff((np.cumsum(lengths) - 1) // size)) + 1 if len(lengths) else []
        edges = [0, *cut, len(lengths)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def keep_rows(docs: DataFrame, text_col: str, passes: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows whose text passes (a null one counts as empty), with all their columns as they are."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone()
        for part in chunks(batches, at):
            yield part.filter(pa.array(passes([t or "" for t in part.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ddl(schema: pa.Schema) -> str:
    """The schema as Spark's DDL, for mapInArrow."""
    names = {"int64": "long", "int32": "int", "double": "double", "float": "float", "string": "string", "binary": "binary", "bool": "boolean"}
    kind = lambda t: f"array<{kind(t.value_type)}>" if pa.types.is_list(t) else names[str(t)]
    return ", ".join(f"`{f.name}` {kind(f.type)}" for f in schema)


def fields(**types: pa.DataType) -> pa.Schema:
    return pa.schema(list(types.items()))


def flat_words(values: list[str]) -> tuple[list[bytes], np.ndarray]:
    """All words of several texts in one list, and where each text's words begin (one more entry for the end)."""
    split = [v.encode().split() for v in values]
    starts = np.zeros(len(split) + 1, np.int64)
    np.cumsum([len(s) for s in split], out=starts[1:])
    return [w for s in split for w in s], starts
