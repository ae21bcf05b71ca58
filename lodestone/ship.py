"""Sends this package to executors that can't import it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()
#: Bytes of a batch that goes to a Python worker. Spark's own bound of 10,000 rows alone lets a batch of long texts grow without limit.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package as a zip file to the session's executors, once for each application.

    Functions that run in Python workers are looked up in this package by name; the driver may have it
    on a path of its own only. Spark serves the file from the driver. Unless the session has set a bound on the
    bytes of Arrow batches, this sets one.
    """
    if spark.conf.get(_BATCH, None) in (None, "67108864b"):  # the latter is Spark's default
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        context = spark.sparkContext
    except Exception:  # a remote session has no context; its server has to hold the package
        return spark
    if context.applicationId not in _SENT:
        _SENT.add(context.applicationId)
        home = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="lodestone-"), "lodestone.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(home):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("lodestone", os.path.relpath(full, home)))
        context.addPyFile(path)
    return spark
