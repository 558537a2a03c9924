"""Makes the package importable in Python workers."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import phasegrid

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(phasegrid.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="phasegrid-"), "phasegrid.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("phasegrid", os.path.relpath(path, top)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
