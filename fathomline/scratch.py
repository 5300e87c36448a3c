"""Tables that a job writes for itself in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder in ``spark.checkpoint.dir`` and read back, so that what uses it several times neither
    computes it again nor loses it with an executor. Without such a folder it stays as it is and is computed where it is used."""
    spark = df.sparkSession
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        return df
    path = f"{root.rstrip('/')}/fathomline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
