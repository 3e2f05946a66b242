"""Tables that a plan reads several times and therefore keeps, and their release."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """``df`` persisted until ``release`` is called."""
    _kept.append(df.persist())
    return _kept[-1]


def release() -> None:
    """Drops all kept tables; results that still read them are computed anew from their sources."""
    while _kept:
        df = _kept.pop()
        if df.sparkSession.sparkContext._jsc is not None:
            df.unpersist()


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, so that plans of loops do not grow. The folder is spark.checkpoint.dir; only a session on this machine alone may do without."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = context.getConf().get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="rimward-"))
    return df.checkpoint()
