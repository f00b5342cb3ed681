"""Cutting plans: what many later steps read is worked out once and read from there."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pinned(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that the session names in ``spark.checkpoint.dir``, which a lost executor doesn't take with it.

    Steps that read a table several times, round after round, would else repeat its whole plan in each. A local session without the
    setting takes a folder of its own; a cluster's is refused, as its executors share no such folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(path)
    return df.checkpoint()


#: Rows up to which a table that every row meets is sent to all tasks.
FEW = 10_000


def few(df: DataFrame, limit: int = FEW) -> DataFrame:
    """``df``, counted to hold at most ``limit`` rows, to be broadcast; raises if it holds more, as every row is to meet all of it."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"a table that every row meets holds more than {limit} rows")
    return F.broadcast(df)


def tasks(df: DataFrame, rows: int) -> int:
    """As many tasks as give each ``rows`` rows of ``df`` or fewer, but no fewer than the session's partitions: for steps that keep their rows in memory."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
