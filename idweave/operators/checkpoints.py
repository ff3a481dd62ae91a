"""Tables of a round, written where every executor finds them, so that no lineage grows and a lost executor costs one round."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in the folder of ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        own = context.getConf().get("spark.checkpoint.dir")
        if not own and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="idweave-"))
    return df.checkpoint()
