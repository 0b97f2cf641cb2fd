"""Sessions, and shipping this package to their executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("rowstrata")
    settings = {
        "spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": True, "spark.driver.memory": memory, "spark.ui.enabled": False,
        "spark.ui.showConsoleProgress": False, "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": True,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their path need not hold it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="rowstrata-"), "rowstrata.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
