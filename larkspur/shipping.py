"""Getting the package to the executors' Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers once per application, so that they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("larkspur", os.path.relpath(path, here)))
    # Only the driver reads this file; Spark's own file server takes it to the executors.
    path = os.path.join(tempfile.mkdtemp(prefix="larkspur-"), "larkspur.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
