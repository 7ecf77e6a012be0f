"""Gives the executors this package, where they have not been given it otherwise."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> SparkSession:
    """Adds the package to the application's Python files, once; a package that came as such a file is there already."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED and root.is_dir():
        path = Path(tempfile.mkdtemp(prefix="ravelin-")) / "ravelin-package.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(path))
        _SHIPPED.add(app)
    return spark
