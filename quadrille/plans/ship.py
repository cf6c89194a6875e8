"""The package itself, sent to workers that do not have it installed."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def archive(folder: str) -> str:
    """A zip file of this package's modules."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(folder, "quadrille-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    out.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(package)))
    return path


def ship(spark: SparkSession) -> None:
    """Puts this package on the Python path of all workers, those of executors to come included. Not needed where it is
    installed on all machines; what it depends on must be. The driver serves the file to executors, so it stays until the driver
    ends."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="quadrille-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(archive(folder))
    _SHIPPED.add(sc.applicationId)
