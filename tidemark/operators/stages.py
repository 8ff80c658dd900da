"""Cutting a plan into stages whose rows are written where all executors can read them."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, written to the folder of spark.checkpoint.dir and read back, so a lost executor recomputes none of it.

    Only a session in one process may lack that folder, and gets one of its own.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-stages-"))
    return df.checkpoint(eager=True)
