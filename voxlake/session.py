"""Session settings shared by the tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship_by_value() -> None:
    """Send the package's Python functions inside the tasks, so workers need no copy of it."""
    import voxlake

    cloudpickle.register_pickle_by_value(voxlake)


def build_session(app: str = "voxlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on; on a cluster pass master=None to use spark-submit's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    return build_session(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("VOXLAKE_DRIVER_MEMORY", "8g"),
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
            "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
            **conf,
        },
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder in spark.checkpoint.dir. A local session without one gets a temporary
    folder; a cluster whose machines share no such folder can't work and is told so."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured
