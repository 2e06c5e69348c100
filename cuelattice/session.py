"""Session helpers: a local session for tests and bench, and the checkpoint folder rule."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cuelattice") -> SparkSession:
    """Session for tests and local benches. Cluster jobs bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; invent one only for a local master.

    Spark gives each application a subfolder of its own there; it goes when the process ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local") and "cluster" not in context.master:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="cuelattice-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    atexit.register(drop_intermediate, spark)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete the application's intermediate tables. Results that still read them must be written before."""
    context = spark.sparkContext
    if getattr(context, "_jsc", None) is None or context.getCheckpointDir() is None:
        return
    try:
        path = context._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JError, OSError):
        # The JVM went first.
        return


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from there.

    A written table survives lost executors, keeps column pruning for its readers and
    has a known size, so later joins can be planned on it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
