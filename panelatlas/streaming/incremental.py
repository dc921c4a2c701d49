"""Keep a sharded table up to date from arriving files: rows of an election replace those that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def replace_by_key(old: DataFrame, new: DataFrame, key: str = "election_key") -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "election_key") -> StreamingQuery:
    """Read Parquet files as they come and overwrite the partitions of the keys that they hold; others stay."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
