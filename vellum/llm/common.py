"""Shared pieces: reading tables, Arrow batch maps, tables in the shared folder, and the definition of a word."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes in one Arrow batch. Texts may be long, so that a batch of the default 10,000 rows could fill a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

_DROP = regex.compile(r"[\p{P}\p{S}‌]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data; also bounds the session's Arrow batches by BATCH_ROWS and BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Cleaned(dict):
    """Word of each blank-separated token met, '' where only punctuation stands."""

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
        word = self[token] = _DROP.sub("", token.lower())
        return word


_CLEANED = _Cleaned()


def words(text: str) -> list[str]:
    """Lower-cased words: punctuation, symbols and U+200C dropped, split at blanks."""
    return [w for w in map(_CLEANED.__getitem__, text.split()) if w]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors reach. Only where all threads are on one machine a temporary one will do."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if re.fullmatch(r"local(\[[^\]]*\])?", sc.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch. fn gets the columns as Python lists and returns columns of the new schema, of any length."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)
