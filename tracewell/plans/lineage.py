"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of the session (spark.checkpoint.dir); eager and reliable.

    Only where no folder is set, as in local tests, a temporary one is made.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        folder = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
