"""What functions that run on workers need there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that functions
    pickled by reference can be imported there whatever their path is."""
    sc = spark.sparkContext
    if getattr(sc, "_lexspark_sent", False):
        return
    fd, name = tempfile.mkstemp(prefix="lexspark", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in _PACKAGE.rglob("*.py"):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(name)
    sc._lexspark_sent = True


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Where that is
    unset, the context's checkpoint folder; without one, a temporary folder if all runs
    on this machine, else an error: a machine's own folder is none of the others'."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or getattr(sc, "_lexspark_shared", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc._lexspark_shared = f"file://{tempfile.mkdtemp(prefix='lexspark-shared')}"
    return sc._lexspark_shared
