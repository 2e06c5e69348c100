"""Run a stream over everything available now into a folder and read the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cuelattice.session import ensure_checkpoint_dir


def drain(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Results and progress go to the shared checkpoint folder, so the run survives lost executors."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    job = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
