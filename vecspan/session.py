"""Session helpers."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed.

    Adds the package's folder to the workers' PYTHONPATH; a cluster whose nodes lack the folder
    gets the package by ``--py-files`` as usual.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, _ROOT])
    return spark


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the session's checkpoint folder, which all executors share.

    Only where the session names none and runs on one machine is a temporary one set; on a
    cluster that is an error, as a machine's own folder isn't seen by the others.
    """
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; see ``work_dir``."""
    import tempfile

    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vecspan-"))
    return sc._jsc.sc().getCheckpointDir().get()
