"""Helpers that the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from redebit.session import shared_folder

#: The characters that part words: space and the five ASCII controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, overwrite_at: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts lineage like ``checkpoint()`` but stays columnar and compressed, so a lost
    executor costs a reread and later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = overwrite_at or f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_texts(
    docs: DataFrame, keep: Sequence[str], measure: Callable[[Iterator[str]], dict[str, Any]], fields: str
) -> DataFrame:
    """One output row per row of ``docs``: columns ``keep`` and what ``measure`` gives of the texts.

    ``measure`` takes the texts of an Arrow batch (null comes as "") and returns a list per
    name in ``fields`` (DDL). Only ``keep`` and ``text`` are read, so other columns of any
    name do not matter.
    """
    made = StructType.fromDDL(fields)
    schema = StructType([docs.schema[k] for k in keep] + made.fields)
    arrow = to_arrow_schema(schema)
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measure(x.as_py() for x in batch.column(width))
            new = [pa.array(got[f.name], type=arrow.field(f.name).type) for f in made.fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], schema=arrow)

    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("__measured")).mapInArrow(run, schema)


def in_fold(doc_id: str, divisor: int, remainder: int):
    """True where crc32 of the id as text leaves ``remainder``; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == remainder, F.lit(False))
