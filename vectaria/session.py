"""Where an engine session keeps tables that outlive a plan."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ARROW_BYTES = 16 << 20


def share_code(spark: SparkSession) -> None:
    """Python workers learn where this package is, and get Arrow batches of bounded size; a smaller bound of
    the caller's is kept."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared folder of `spark.checkpoint.dir`; only where that is unset
    (tests) under a temporary one."""
    share_code(spark)
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"
