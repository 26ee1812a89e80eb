"""Makes this package importable in Python workers that don't have it installed."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Add the package's source to the context, once; Spark hands it to executors through the driver's file server."""
    sc = spark.sparkContext
    if getattr(sc, "_arborseq_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    path = os.path.join(tempfile.mkdtemp(prefix="arborseq-"), f"arborseq-{uuid.uuid4().hex[:8]}.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
    sc._arborseq_shipped = True
