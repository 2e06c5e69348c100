"""Make the package importable in Python workers, from whatever folder a job is started."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package to the executors once per application, as a zip served by the driver."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, f"{root.name}/{source.relative_to(root).as_posix()}")
    folder = tempfile.mkdtemp(prefix="cuelattice-ship-")
    archive = os.path.join(folder, "cuelattice_package.zip")
    Path(archive).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
