"""Stage tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from functools import lru_cache
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=8)
def _own_folder(application: str) -> str:
    return mkdtemp(prefix=f"llm-stages-{application}-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir if the session names one; where it is unset (tests on one machine), a fresh folder is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = _own_folder(spark.sparkContext.applicationId)
    return named.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once and read it back: cuts the lineage, survives lost executors, and gives joins its true size."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
