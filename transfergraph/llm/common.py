"""What the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII controls; bytes.split() has the same rule on UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: Column | str = "text") -> Column:
    """With doc_id it names a row, so that rows that share a doc_id (or have none) are told apart by their text."""
    return F.xxhash64(text)


def map_rows(df: DataFrame, columns: list[Column], of_row: Callable[..., tuple], schema: str) -> DataFrame:
    """Apply of_row to the given columns of each row, Arrow batch by batch.

    of_row gets one positional value per column and returns a tuple in the order of schema.
    """
    fields = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [of_row(*row) for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)]
                out = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(out, fields, strict=True)], schema=fields)

    return df.select(*columns).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows, so that few texts are Python objects at a time."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def pa_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
