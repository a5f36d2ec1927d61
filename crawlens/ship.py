"""Makes this package importable for Python workers that don't start where it lies."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's source to the application, once, unless PYTHONPATH or the session has it already."""
    sc = spark.sparkContext
    if sc.applicationId in _done or str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _done.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="crawlens-src-")
    atexit.register(shutil.rmtree, folder, True)
    path = f"{folder}/crawlens_src.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in [*sorted(ROOT.glob("crawlens/**/*.py")), *ROOT.glob("corpus_pipeline.py")]:
            z.write(f, f.relative_to(ROOT))
    sc.addPyFile(path)
