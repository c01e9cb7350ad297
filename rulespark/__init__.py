"""A PySpark-native engine for tables of rules and for training data."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile


def ship(spark) -> None:
    """Give the session's Python workers this package, where it is not installed on the executors."""
    here = pathlib.Path(__file__).parent
    path = f"{tempfile.mkdtemp(prefix='rulespark-')}/rulespark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)
