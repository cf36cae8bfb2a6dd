"""Incidents as a stream: each micro-batch is answered like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netresil.plans.impact import impact_on, prepare

INCIDENT = "incident_id BIGINT, x DOUBLE, y DOUBLE, radius_m DOUBLE, at TIMESTAMP"


def incident_stream(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Incidents arriving as Parquet files; repeats within the watermark are dropped."""
    return (
        spark.readStream.schema(INCIDENT).parquet(path)
        .withWatermark("at", late)
        .dropDuplicatesWithinWatermark(["incident_id"])
    )


def start_impact(stream: DataFrame, nodes: DataFrame, edges: DataFrame, out: str, checkpoint: str, once: bool = False):
    """Write the key figures of each batch under ``out/batch=<id>``.

    A batch that is run again after a failure overwrites its own folder, so
    results appear once. The network and its state before any failure are
    worked out once, when the stream starts.
    """
    network = prepare(nodes, edges)

    def answer(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            impact_on(network, batch.drop("at")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def impact_of_available(spark: SparkSession, path: str, out: str, checkpoint: str, nodes: DataFrame, edges: DataFrame) -> None:
    """Answer everything that has arrived, then stop."""
    start_impact(incident_stream(spark, path), nodes, edges, out, checkpoint, once=True).awaitTermination()
