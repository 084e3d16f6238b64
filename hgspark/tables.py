"""Cutting lineage in the shared checkpoint folder, and broadcasts of a checked size."""

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import BROADCAST_ROWS


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only a session on one machine gets a temporary one where none is
    named; on a cluster that is an error, as executors don't share a machine's disk."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = sc._jsc.sc().getCheckpointDir()
    if not named and not held.isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    elif not held.isDefined():
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, where a lost executor doesn't lose them."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a (cut, so cheaply counted) table for broadcast while it has at most `most` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
