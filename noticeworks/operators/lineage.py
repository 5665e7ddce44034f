"""Tables in the folder that the cluster shares, which cut the lineage of what is read from them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again: computed once, and not again if an executor is lost.

    Only where that is unset and all runs on one machine (a laptop, tests) a temporary folder takes its place.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='noticeworks-')}"
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{re.sub(r'^file:/(?!/)', 'file:///', folder).rstrip('/')}/noticeworks/lineage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
