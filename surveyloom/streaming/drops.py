"""An extension: files that are dropped into a folder, loaded as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.store import Store


def load_drops(spark: SparkSession, folder: str, schema: str, store: Store, version_of: Callable[[DataFrame], str], checkpoint: str):
    """A streaming query that loads each micro-batch as one version.

    Loading a version again replaces it, so a batch that is run twice after a
    failure does no harm.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            store.load(version_of(df), df, refresh=True)

    stream = spark.readStream.schema(schema).option("header", True).csv(folder)
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
