"""Makes the library importable in Python workers that don't find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context, unless the working folder or PYTHONPATH already holds it."""
    root = Path(__file__).resolve().parent.parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _SENT or any(p and Path(p).resolve() == root for p in known):
        return
    path = Path(tempfile.mkdtemp(prefix="blockloom-")) / "blockloom.zip"  # the driver serves it from here
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "blockloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)
