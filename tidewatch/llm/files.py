"""Places that the driver and all executors share."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewatch.operators.ranks import ensure_checkpoint_dir


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir (a checkpoint folder set by the caller counts as well)."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder, and read from there: later steps do not
    compute them again, and a lost executor costs only its own tasks."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def publish(spark: SparkSession, name: str, content: bytes) -> str:
    """Write one file in the shared folder and have Spark hand it to every executor, a later one
    too. Returns the name for SparkFiles.get."""
    name = f"{name}-{hashlib.sha256(content).hexdigest()[:16]}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path)
        for i in range(0, len(content), 1 << 22):
            out.write(bytearray(content[i : i + (1 << 22)]))
        out.close()
    spark.sparkContext.addFile(str(path))
    return name


def with_fields(schema: T.StructType, added: str) -> T.StructType:
    """A schema and more fields, given as DDL."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(added).fields])
