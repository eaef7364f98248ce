"""Getting the package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED = "lintel.shipped"
#: Bytes of rows that go to a Python worker at once, and Spark's own setting, which takes several times that of an executor's
#: memory for each task where texts are long.
BATCH_SETTING, BATCH_BYTES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "8m", "67108864b"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that they needn't have it installed, and bounds
    the batches that their Python workers get, unless the session has a bound of its own."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    if getattr(context, _SHIPPED, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lintel-"), "lintel.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("lintel", os.path.relpath(full, root)))
    context.addPyFile(path)
    setattr(context, _SHIPPED, True)
