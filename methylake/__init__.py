"""methylake: DNA-methylation cohort analytics and training-data operators on Spark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Sends this package to the executors, once per application, for those that don't have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_methylake_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="methylake-")) / "methylake.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(target))
    sc._methylake_shipped = True
