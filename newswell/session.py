"""How Python workers get this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send this package to the Python workers of the session's executors, once an application; Spark keeps the copy for those that start later."""
    spark = spark or SparkSession.getActiveSession()
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    _SENT.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="newswell-"), "newswell.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("newswell", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
