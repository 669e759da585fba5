"""Landing a stream of bars: every micro-batch is merged into the partitioned store, the last row of a key staying."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources import store


def land(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Starts the stream over what is there now and ends with it. A batch only touches the partitions of its own rows.

    The merge is idempotent by key, so a batch that is replayed after a failure leaves the same store.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("year", store.F.year("date"))
        try:
            parts = batch.select("market", "year").distinct()
            old = spark.read.parquet(path).join(parts, ["market", "year"], "left_semi")
            merged = store.keep_last(old, batch, keys)
        except Exception as e:  # the store does not exist yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            merged = store.keep_last(batch.limit(0), batch, keys)
        merged = merged.checkpoint(eager=True)  # it is read from the folder that it replaces
        store.write(merged, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
