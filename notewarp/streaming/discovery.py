"""Discovery as a stream: landed feed files become queue states, exactly once per version of the state.

Each micro-batch is merged into the queue and committed together with its number, so a batch that is replayed after a failure changes
nothing. The stream's own checkpoint keeps the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewarp.operators.snapshot import Snapshot
from notewarp.session import cut
from notewarp.streaming.queue import QUEUE, advance, discover

SYNC_STATE = "source_key string, watermark timestamp, last_started_at timestamp, last_completed_at timestamp, last_error string"


def feed_stream(spark: SparkSession, folder: str, schema, *, files_per_batch: int = 100) -> DataFrame:
    """The landed feed as a stream of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def apply_batch(store: Snapshot, batch: DataFrame, number: int, *, source: str = "notes") -> None:
    """Merge one micro-batch; a number that has been committed is left out."""
    spark = batch.sparkSession
    if store.has("batches") and not store.table("batches").filter(F.col("number") >= number).isEmpty():
        return
    queue = store.table("queue") if store.has("queue") else spark.createDataFrame([], QUEUE)
    state = store.table("sync_state") if store.has("sync_state") else spark.createDataFrame([], SYNC_STATE)
    batch = cut(batch.select("id", F.col("updated_at").cast("timestamp").alias("updated_at")))
    store.commit({"queue": discover(queue, batch), "sync_state": advance(state, source, batch), "batches": spark.createDataFrame([(number,)], "number long")})


def run(stream: DataFrame, store: Snapshot, checkpoint: str, *, source: str = "notes"):
    """Process what is there and stop; returns the finished query."""
    query = stream.writeStream.foreachBatch(lambda batch, number: apply_batch(store, batch, number, source=source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
