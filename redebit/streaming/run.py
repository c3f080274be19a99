"""Run a stream over everything available and read back what it wrote."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redebit.session import shared_folder


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{shared_folder(spark)}/redebit-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str, writer: Callable[[DataFrame, int], None] | None = None) -> tuple[DataFrame, str]:
    """Process all available input once; rows land as Parquet with their batch number.

    Returns the written rows and the folder. In update mode a key may appear in several
    batches; ``latest`` keeps the newest.
    """
    spark = stream.sparkSession
    root = scratch(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(writer or write)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if writer is not None:
        return stream.sparkSession.createDataFrame([], "batch_id int"), root
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/rows"), root


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return newest.select(*keys, "_row.*")
