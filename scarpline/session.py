"""Session settings and the two cluster-facing helpers: lineage cuts and checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be broadcast only after it was counted and found at most this long.
BROADCAST_MAX_ROWS = 50_000
BROADCAST_MAX_BYTES = 8 << 20


def session(app_name: str = "scarpline", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution, skew-join splitting, UTC and ANSI mode."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    One of our own is set only where none is named and all run on one machine, as in tests.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None:
            if not re.match(r"local(\[|$)", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            named = tempfile.mkdtemp(prefix="scarpline-checkpoint-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Evaluate ``df`` once and hint a broadcast when it is short and small enough.

    The driver never receives more than ``max_rows + 1`` rows. A larger table comes back as it was,
    unhinted, so the same join runs as a shuffle join under AQE.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows or head.nbytes > max_bytes:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema))
