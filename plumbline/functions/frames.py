"""Helpers for whole DataFrames: durable cuts of lineage and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows and bytes of a join side up to which it is broadcast; more take a shuffle join.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64_000_000
#: Rows of a part from which on more rows make more parts rather than larger ones.
ROWS_A_PART = 250_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in spark.checkpoint.dir; in local mode alone, where none is set, a folder of our own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if shared is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that a lost executor costs a reread and not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As durable(), but as a Parquet table in the checkpoint folder: for long tables, of which it takes a fraction of the space."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def more_parts(spark: SparkSession, rows: int) -> int | None:
    """How many parts hold so many rows by ROWS_A_PART; None where those of spark.sql.shuffle.partitions do."""
    n = -(-rows // ROWS_A_PART)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: rows that are few and small but dear would else end up in one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory: 16 a column, the length of texts, and of arrays and maps their members' own sizes."""

    def size(x: Column, t: DataType) -> Column:
        if isinstance(t, (StringType, BinaryType)):
            return F.coalesce(F.octet_length(x), F.lit(0)) + 16
        if isinstance(t, StructType):
            return sum((size(x[f.name], f.dataType) for f in t.fields), F.lit(16))
        if isinstance(t, ArrayType):
            if isinstance(t.elementType, (StringType, BinaryType, StructType, ArrayType, MapType)):
                return F.coalesce(F.aggregate(x, F.lit(16).cast("long"), lambda a, e: a + size(e, t.elementType)), F.lit(16))
            return F.greatest(F.size(x), F.lit(0)) * 8 + 16
        if isinstance(t, MapType):
            return size(F.map_keys(x), ArrayType(t.keyType)) + size(F.map_values(x), ArrayType(t.valueType))
        return F.lit(16)

    return sum((size(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0)).cast("long")


def sized_join(left: DataFrame, right: DataFrame, on, how: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a side that is measured first: broadcast up to max_rows rows and max_bytes bytes, a shuffle join (AQE splits skew) beyond.

    ``right`` must be cheap to read again (a checkpoint or a file scan): its rows are counted and their sizes summed here.
    """
    rows, size = right.agg(F.count("*"), F.sum(row_bytes(right))).first()
    if rows <= max_rows and (size or 0) <= max_bytes:
        right = F.broadcast(right)
    return left.join(right, on, how)


def numbered(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """df with its rows numbered from 0 in the order of the columns, which have to tell rows apart.

    Rows are dealt by range, written once and numbered within their part; what comes before a part is summed from one
    count a part, so no task sees all rows.
    """
    spark = df.sparkSession
    parts = written(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before, so_far = [], 0
    for part in sorted(counts):
        before.append((part, so_far))
        so_far += counts[part]
    offset = spark.createDataFrame(before, "_part int, _before long")
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(offset), "_part").withColumn(name, F.col("_before") + inner).drop("_part", "_before")
