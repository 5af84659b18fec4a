"""Session set-up, shipping of the package to executors, and lineage cuts in shared storage."""

from __future__ import annotations

import gc
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOT = Path(__file__).resolve().parents[1]
_SHIPPED = "spanloom.shipped"

#: Bytes of a side's values up to which it is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Bytes for each core below which an input is spread over the cores by a shuffle.
SPREAD_BYTES = 8 << 20
#: Bytes of a batch of rows that a Python worker gets at a time; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def get_spark(app: str = "spanloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session at hand."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _bound_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python by their bytes: ten thousand rows, the usual number, may be texts of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    m = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get(key).lower())
    # anything else, such as -1, is no bound
    if not m or int(m.group(1)) << 10 * " kmgtp".index(m.group(2) or " ") > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever they were started from.

    The code travels by the shared folder, so an executor that joins later finds it as well.
    """
    _bound_batches(spark)
    sc = spark.sparkContext
    if sc._conf.get(_SHIPPED) == sc.applicationId:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, str(Path(_ROOT.name, p.relative_to(_ROOT))))
    path = f"{scratch_path(spark, 'code')}/{_ROOT.name}_pkg.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(path)
    sc._conf.set(_SHIPPED, sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/spanloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in shared storage and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a materialized table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    seen = set()
    for f in df.inputFiles():
        folder = f.rsplit("/", 1)[0]
        if folder in seen or "/spanloom/" not in folder:
            continue
        seen.add(folder)
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of shuffle files whose plans no one holds any more.

    Spark deletes them when the driver collects its garbage, which on a large heap may be
    hours after a materialized step has ended; between steps that shuffle much, ask for it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back(spark: SparkSession) -> None:
    """Shrink the executors' heaps to what is still in use.

    A heap keeps what it once grew to, beside the Python workers and buffers that the next step
    needs, so between steps of other kinds ask for it. A task for each core finds all executors
    when no other job runs; one that it misses only keeps its heap as it is.
    """
    cores = max(1, spark.sparkContext.defaultParallelism)
    # no constant: the function is not deterministic, so each task calls it
    spark.range(0, cores, 1, cores).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).collect()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it is so small that it may be one row group, which one task reads.

    By the plan's own estimate of its bytes; a larger input has row groups for every core and
    is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if cores > 1 and size < cores * SPREAD_BYTES else df


def _value_bytes(c: Column, kind: T.DataType) -> Column | int:
    """Bytes of a value, a number where they don't depend on it."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_value_bytes(c[f.name], f.dataType) for f in kind.fields), 0)
    if isinstance(kind, T.ArrayType):
        one = _value_bytes(F.lit(None), kind.elementType) if not isinstance(kind.elementType, T.StructType) else 8 * len(kind.elementType.fields)
        if isinstance(one, int):
            return F.coalesce(F.size(c), F.lit(0)) * one + 8
        return F.coalesce(F.aggregate(c, F.lit(8).cast("long"), lambda n, x: n + _value_bytes(x, kind.elementType)), F.lit(0))
    if isinstance(kind, T.MapType):
        return _value_bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + _value_bytes(F.map_values(c), T.ArrayType(kind.valueType))
    return 8


def data_bytes(df: DataFrame) -> int:
    """Bytes of df's values, eight a row included: what a broadcast of it would send, less its index."""
    per_row = sum((_value_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields), 8)
    if isinstance(per_row, int):
        return per_row * df.count()
    return df.agg(F.sum(per_row.cast("long"))).first()[0] or 0


def small_or_plain(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for df only when its bytes were measured to be few; else leave the join to shuffle.

    df should be cheap to read: a materialized table or a projection of one.
    """
    return F.broadcast(df) if data_bytes(df) <= limit else df
