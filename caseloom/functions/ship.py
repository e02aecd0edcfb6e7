"""Make the package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application.

    The archive is served by the driver (``addPyFile``), so the working directory and
    the path of a worker do not matter.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    out = os.path.join(tempfile.mkdtemp(prefix="spark-"), "caseloom_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
