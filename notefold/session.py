"""Session helpers: the shared folder for cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

CHECKPOINT_KEY = "spark.checkpoint.dir"

#: Bytes up to which a side of a join is broadcast, and bytes of an Arrow batch.
BROADCAST_BYTES, BATCH_BYTES = 32_000_000, 8_000_000

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none, as in local tests, a folder of this machine is taken.
    """
    conf = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="notefold-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table ends the lineage, so a lost executor costs only a re-read, and rows that hold a random or
    order-dependent choice can't change between two uses.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete the tables this process has written to the shared folder, once no result that reads them is needed any more."""
    done = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


def _width(column, kind) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 24
    if isinstance(kind, (ArrayType, MapType, StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)) + 24
    return F.lit(8)


def small(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else as it is, for a shuffled join.

    Counting and measuring stop after ``rows + 1`` rows, so the check itself stays cheap whatever the table's size.
    """
    wide = reduce(lambda a, b: a + b, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema], F.lit(0))
    n, measured = df.limit(rows + 1).agg(F.count("*"), F.sum(wide.cast("bigint"))).first()
    return F.broadcast(df) if n <= rows and (measured or 0) <= size else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scan of fewer partitions than there are cores, spread over them before costly work by row; others stay as they are.

    Only small inputs are ever shuffled by this: a large one has more splits than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes, for operators over whole texts, whose rows may be long.

    All operators ask for the same bound, so a plan built earlier and run later is not changed by it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
