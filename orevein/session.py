"""What a session needs before queries run."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all machines see. Only on one machine, where none is named, a temporary one is made."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors see")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def prepare(spark: SparkSession) -> None:
    """See that there is a folder for checkpoints."""
    shared(spark)
