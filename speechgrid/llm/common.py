"""What the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under fixed names: other columns can neither clash nor be read."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def by_batch(build: Callable[..., Callable[[pa.RecordBatch], pa.RecordBatch]], *args):
    """A mapInArrow function: ``build(*args)`` runs once a task and gives the function for a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = build(*args)
        for b in batches:
            if b.num_rows:
                yield each(b)
    return run


def by_slices(build: Callable[..., Callable[[pa.RecordBatch], pa.RecordBatch]], *args, rows: int = 512):
    """``by_batch`` on some rows at a time, so that what a function makes of long texts is never as large as a whole batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = build(*args)
        for b in batches:
            for k in range(0, b.num_rows, rows):
                yield each(b.slice(k, rows))
    return run


def parts_for(spark: SparkSession, rows: int, rows_a_part: int) -> int:
    """A number of partitions that follows the input: never fewer than the session's, nor so few that one holds more than
    ``rows_a_part`` rows on average."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_a_part))


def tokenizer_path(name: str, path: str | None = None) -> str:
    """The given path, or where the installed vocabularies have the file."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
