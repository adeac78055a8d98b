"""Shared plumbing: cutting lineage on shared storage, size-checked broadcasts, batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that may be broadcast; a larger side is joined through a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text handled at once inside a Python task; a single longer text is handled alone.
SLICE_BYTES = 2 << 20
#: `[^\x20\x09-\x0D]+`, the words of every contract.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where the session names none and has no other machines (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors see")
        own = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows of an Arrow batch, where the session has Spark's own 10,000: texts are wide.
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(ARROW_ROWS))


class Shared:
    """A broadcast whose classes travel by value, as functions do; the driver proves the size of what it sends."""

    def __init__(self, spark: SparkSession, value) -> None:
        small_batches(spark)
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        found = cloudpickle.loads(self.sent.value)
        self.sent.__dict__.pop("_value", None)  # the pickled form; it lies in a file and is read again if need be
        return found


#: Spark's switch by which the shuffle files of a query go as soon as it is done, not when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def materialise(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Writes a table into the shared folder and reads it back: lineage ends at replicated storage. The table goes
    when the application ends; drop_shuffles: the shuffle files that made it go at once."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark) if drop_shuffles else contextlib.nullcontext():
        df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, cells=None) -> DataFrame:
    """Marks a materialised table for broadcast if it was counted to be small, else leaves the join to shuffle.

    Rows are of fixed width, or `cells` tells how many values each row holds, and the limit is on those."""
    if cells is None:
        return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
    held = df.agg(F.sum(cells)).first()[0] or 0
    return F.broadcast(df) if held <= limit else df


#: Most bits of a sieve: 64 MB, sent as rows of 4 KB.
SIEVE_BITS, SIEVE_ROW = 1 << 29, 1 << 15


def sieved(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """df with a boolean column name: false for rows whose key (a 64-bit hash) surely is none of column key of
    keys, a materialised table. A Bloom filter of one hash and bounded size; true may be wrong, false is never."""
    wanted = 32 * max(keys.count(), 1)
    bits = min(max(SIEVE_ROW, 1 << wanted.bit_length()), SIEVE_BITS)
    spot = F.pmod(keys["key"], F.lit(bits))
    maps = keys.select(F.floor(spot / SIEVE_ROW).alias(f"{name}_row"), (spot % SIEVE_ROW).alias("bit"))
    maps = maps.groupBy(f"{name}_row").agg(F.bitmap_construct_agg("bit").alias(f"{name}_map"))
    at = F.pmod(key, F.lit(bits))
    df = df.withColumn(name, at)
    df = df.join(F.broadcast(maps), F.floor(df[name] / SIEVE_ROW) == F.col(f"{name}_row"), "left").drop(f"{name}_row")
    bit = df[name] % SIEVE_ROW
    byte = F.conv(F.hex(F.substring(F.col(f"{name}_map"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return df.withColumn(name, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop(f"{name}_map")


def matching(df: DataFrame, keys: DataFrame, on: list[str], limit: int | None = None, cells: Column | None = None) -> DataFrame:
    """df joined with keys, a materialised table, on columns without nulls. Many keys: only rows that pass a sieve are
    shuffled. cells: values of 8 bytes that each row of keys holds, if rows are not of fixed width."""
    limit = BROADCAST_ROWS if limit is None else limit
    if (keys.limit(limit + 1).count() if cells is None else keys.agg(F.coalesce(F.sum(cells), F.lit(0))).first()[0]) <= limit:
        return df.join(F.broadcast(keys), on)
    name = f"sieve-{uuid.uuid4().hex}"
    kept = sieved(df, F.xxhash64(*on), keys.select(F.xxhash64(*on).alias("key")), name)
    return kept.where(F.col(f"`{name}`")).drop(name).join(keys, on)


def release() -> None:
    """Gives memory that is free back to the system: workers stay for later tasks, beside other workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about SLICE_BYTES of text, or one row; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        lengths = pc.cumulative_sum(pc.cast(pc.fill_null(pc.binary_length(batch.column(at)), 0), pa.int64())).to_numpy()
        begin = 0
        while begin < batch.num_rows:
            base = int(lengths[begin - 1]) if begin else 0
            end = max(begin + 1, int(lengths.searchsorted(base + SLICE_BYTES, "right")))
            part = batch.slice(begin, end - begin)
            yield part.set_column(at, text, pc.fill_null(part.column(at).cast(pa.large_string()), ""))
            begin = end
    release()
