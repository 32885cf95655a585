"""Tables in the folder that all executors share: they cut a long lineage, and survive lost executors."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table under spark.checkpoint.dir, read back.

    Where the setting is missing, local mode uses a folder of its own; on a cluster this fails, for no folder is shared.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{folder or f'/tmp/checkpoints/{os.getpid()}'}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
