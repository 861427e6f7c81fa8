"""Long plans in parts: rows read back from the shared checkpoint folder, and small tables sent to all tasks."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from the shared checkpoint folder, spark.checkpoint.dir: a folder of this machine only where all tasks run here.

    The driver's garbage goes first, as Spark removes shuffle files and broadcasts when nothing names them any more.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints")
        sc.setCheckpointDir(folder)
    gc.collect()
    sc._jvm.System.gc()
    return df.checkpoint(eager=True)


def few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` to be joined by a broadcast if they are at most ``most``. They are counted for that, so they should be cut."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
