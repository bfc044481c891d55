"""Session helpers shared by tests, the bench and library callers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType


def local_session(cores: str = "8", name: str = "partwise") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PARTWISE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="partwise-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            shared = tempfile.mkdtemp(prefix="partwise-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, where all executors see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="partwise-shared-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """The table written as compressed files below spark.checkpoint.dir and read back; cuts lineage like ``cut``, takes less
    disk, and reads single columns. Large values need ``block_bytes``, what a writer or reader of them holds at once."""
    path = shared_folder(df.sparkSession)
    large = {"parquet.block.size": block_bytes, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1,
             "parquet.enable.dictionary": "false"}      # otherwise sizes are first looked at after 100 values
    df.write.options(compression="zstd", **(large if block_bytes else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_scan(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores to all cores.

    Matters for a table stored as a single row group; a scan of many files is left as it is.
    Meant for a plain scan: counting the splits of a join would start its stages.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


BROADCAST_BYTES = 64 << 20


def value_bytes(value: Column, kind) -> Column:
    """About how many bytes a value takes, with everything nested in it."""
    if isinstance(kind, ArrayType):
        inner = kind.elementType
        if isinstance(inner, (ArrayType, StructType, MapType, StringType, BinaryType)):
            total = F.aggregate(value, F.lit(0).cast("bigint"), lambda a, v: a + value_bytes(v, inner))
        else:
            total = F.size(value) * 8
    elif isinstance(kind, StructType):
        total = sum((value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(0))
    elif isinstance(kind, MapType):
        total = value_bytes(F.map_keys(value), ArrayType(kind.keyType)) + value_bytes(F.map_values(value), ArrayType(kind.valueType))
    elif isinstance(kind, (StringType, BinaryType)):
        total = F.octet_length(value)
    else:
        total = F.lit(0)
    return F.coalesce(total, F.lit(0)).cast("bigint") + 16


def small(state: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A fitted state table for the small side of a join: materialised, measured, and marked
    for broadcast if it is within ``limit``. Beyond it Spark joins by shuffle and splits skewed keys.
    """
    state = cut(state)
    row = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in state.schema.fields), F.lit(0))
    total = state.agg(F.sum(row)).first()[0] or 0
    return F.broadcast(state) if total <= limit else state
