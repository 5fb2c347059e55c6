"""Sends the library to the executors, whose working folder need not hold it."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import plumbline

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add a zip of the package to the application, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.abspath(plumbline.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _SENT.add(context.applicationId)
