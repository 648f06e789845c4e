"""Make the package importable in Python workers wherever they run.

Python functions that a plan ships are pickled by reference, so each worker
imports ``armature``.  ``ship`` adds the package as a zip to the Spark
application once; Spark's file server hands it to every executor.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the application's Python files (idempotent)."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server's environment holds the package
        return
    if sc.applicationId in _done:
        return
    root = os.path.dirname(_PACKAGE)
    path = os.path.join(tempfile.mkdtemp(prefix="armature-zip-"), "armature_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _done.add(sc.applicationId)
