"""Session helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir.

    Only a local session without that setting (a test) gets a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="blockrank-")
    spark.sparkContext.setCheckpointDir(own)
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


def give_back() -> None:
    """Return the memory that this process has freed, for Python workers that later tasks and stages use again."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


_written: dict[str, set[str]] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once under the shared folder and read it back.

    Cuts the lineage: later stages survive the loss of executors without running the work above again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    ship_package(spark)
    _written.setdefault(spark.sparkContext.applicationId, set()).add(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.get(spark.sparkContext.applicationId, set()).discard(path)


def forget(*tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads."""
    for df in tables:
        _delete(df.sparkSession, df._written_at)


def written(spark: SparkSession) -> frozenset[str]:
    """The tables that this session has materialised and not deleted."""
    return frozenset(_written.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, keep: tuple[DataFrame, ...] = (), older: frozenset[str] = frozenset()) -> int:
    """Delete what this session has materialised, but for the tables to keep and those of an older state (`written`): for
    use once all results that were built on it are read or written. Returns how many tables went."""
    gone = written(spark) - older - {df._written_at for df in keep}
    for path in gone:
        _delete(spark, path)
    return len(gone)


BITMAP_BITS = 24


def key_bitmap(keys: DataFrame, key: str = "key") -> np.ndarray:
    """A bitmap of 2**BITMAP_BITS bits of 64-bit hashes, of one size for any number of keys.

    It only spares rows ahead of an exact join: a false hit costs a row, nothing is missed."""
    slot = F.shiftrightunsigned(key, 64 - BITMAP_BITS)
    rows = keys.select(F.shiftright(slot, 5).cast("int").alias("w"), slot.bitwiseAND(F.lit(31).cast("long")).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    words = np.zeros(1 << (BITMAP_BITS - 5), dtype="<u4")
    words[rows["w"].to_numpy()] = rows["bits"].to_numpy().astype("<u4")
    return words.view(np.uint8)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def least_by_hash(rows: DataFrame, n: int, *by: str) -> DataFrame:
    """n rows of least hash of the columns `by` (or all there are), for a bounded sample.

    A rate that leaves about four times as many goes first, so no task offers many rows to the driver. Where a
    filter or repeats make them fewer than n, what passes the rate is the sample."""
    total = rows.count()
    if total > 4 * n:
        upto = int(4 * n / total * (1 << 40))
        rows = rows.filter(F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < upto)
    return rows.withColumn("__h", F.pmod(F.xxhash64(*by), F.lit(1 << 40))).orderBy("__h", *by).limit(n).drop("__h")


def text_digest(text):
    """128 bits of the text's bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def pipeline_stage(function):
    """Marks a stage (spark, docs, sf_dir) of the pipeline: the executors get the package first."""

    @functools.wraps(function)
    def run(spark, docs, sf_dir):
        ship_package(spark)
        return function(spark, docs, sf_dir)

    return run
