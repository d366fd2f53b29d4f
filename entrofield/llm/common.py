"""Helpers shared by the corpus operators: shared folders, stored tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..sources.files import filesystem, shared_dir

__all__ = ["bounded_batches", "filesystem", "key_hash", "map_whole", "shared_dir", "slices", "stored", "table", "word_count"]

#: Words are maximal runs of anything but ASCII blanks; bytes.split() cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back: cuts the lineage at files that outlive executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_whole(df: DataFrame, f) -> DataFrame:
    """df.mapInArrow over all columns with the same schema, whatever the columns' names."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(f, plain.schema).toDF(*df.columns)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that Python objects of few rows, and of few bytes unless one row has more, exist at a time."""
    for b in batches:
        todo = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def bounded_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches that go to Python to BATCH_BYTES, unless the session has a limit of its own: the default would let one batch of long texts take 64 MB in the JVM and again in
    each worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(key)).rstrip("bB") == str(64 << 20):
        spark.conf.set(key, str(BATCH_BYTES))


def word_count(text: Column) -> Column:
    """Number of words as a long; null and empty texts have none.

    Counts word starts: a non-blank character at the beginning or after a blank.
    """
    blank = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(blank, " "), "")), F.lit(0)).cast("long")


def key_hash(*cols: Column | str, seed: int = 0) -> Column:
    """Keyed 64-bit hash used for every pseudo-random decision, so that reruns agree."""
    return F.xxhash64(F.lit(seed), *[F.col(c) if isinstance(c, str) else c for c in cols])
