"""Tables between steps, in the folder that all machines share: what follows neither repeats the steps before nor depends on the executors that made them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode, where one machine is all."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="steps-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """The frame, written once (in folders by the columns `by`) and read back. The table stays until the folder is emptied."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/trialforge/steps/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
