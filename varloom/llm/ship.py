"""Make this package importable on executors that have no copy of it."""

from __future__ import annotations

import atexit
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import varloom

_sent: set[str] = set()


def ship(spark) -> None:
    """Send the package's sources to the executors, once for each application; Spark's file server hands them out."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(varloom.__file__).parent
    handle, path = tempfile.mkstemp(prefix="varloom-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path("varloom") / f.relative_to(root))
    # Executors may ask for the file at any time, so it stays until the driver ends.
    atexit.register(lambda: Path(path).unlink(missing_ok=True))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def shipped(f: Callable) -> Callable:
    """f(spark, ...) after ship(spark)."""

    @functools.wraps(f)
    def run(spark, *rest):
        ship(spark)
        return f(spark, *rest)

    return run
