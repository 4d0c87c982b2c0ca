"""The package goes to the executors with the session, unless they find it on their own path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from pathlib import Path

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark) -> None:
    """Adds the package to the session's files once, if neither PYTHONPATH nor the working directory has it."""
    root = str(PACKAGE.parent)
    sc = spark.sparkContext
    if getattr(sc, "_arborframe_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(":") or (sc.master.startswith("local[") and os.getcwd() == root):
        return
    at = Path(tempfile.mkdtemp(prefix="arborframe-")) / "arborframe.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(at))
    sc._arborframe_shipped = True


def shipped(f):
    @functools.wraps(f)
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run
