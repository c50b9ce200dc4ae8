"""Sessions, and the package's code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings that this package is tested with."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
    for k, v in ({"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true"} | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_arborlane", None) is None:
        target = Path(tempfile.mkdtemp(prefix="arborlane-")) / "arborlane.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, Path(ROOT.name) / p.relative_to(ROOT))
        sc.addPyFile(str(target))
        sc._arborlane = str(target)
    return spark
