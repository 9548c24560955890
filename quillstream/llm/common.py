"""What several operators share: reading tables, the shared folder, holding a result, key-safe selection."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a Parquet row group of our own tables; a writer holds one in memory.
ROW_GROUP = 16 << 20
#: The least time between two releases of a worker's memory.
RELEASE_SECONDS = 3
_released = 0.0
#: The least time between two releases of the driver's memory; one takes about 0.2 s.
DRIVER_SECONDS = 8
_driver_released = 0.0
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of this remainder are held out from every fit.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only on a single machine, where none is set, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows go to Python a thousand at a time: batches are held several times over, off the heap and in the worker.

    It stays so for the session, as plans run later than they are made; all operators that return such plans agree.
    """
    spark.conf.set(BATCH_ROWS, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Fewer rows at a time for what runs inside."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def frugal(run: Callable[[Iterator], Iterator], tidy: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, whose worker gives back what it no longer needs when a task ends: workers wait for the next
    one and, with the executor's other processes, share its memory. tidy drops what the worker remembers."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            if tidy:
                tidy()
            release()

    return wrapped


def release() -> None:
    """Freed memory back to the system, where the C library can do that; every few seconds at most, for short tasks."""
    global _released
    if time.monotonic() < _released + RELEASE_SECONDS:
        return
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
    _released = time.monotonic()


def release_driver(spark: SparkSession) -> None:
    """What the driver no longer needs back to the system: planning leaves much garbage, for which its heap grows up to
    its limit, and freed native memory stays with the C library of its JVM. Every DRIVER_SECONDS at most."""
    global _driver_released
    if time.monotonic() < _driver_released + DRIVER_SECONDS:
        return
    release()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    try:  # System.trim_native_heap; by reflection, as the server's own class is closed. Not every JVM has it
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, given)
    except Py4JError:
        pass
    _driver_released = time.monotonic()


def release_executors(spark: SparkSession) -> None:
    """What the executors' heaps no longer need back to the system: a heap that a step has filled with garbage stays as
    large as its limit in the steps after it, and their Python workers need memory beside it.

    A small task for each core asks its JVM for a collection; JVMs make one of several requests that wait together.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


class Workspace:
    """Tables written in the shared folder: they cut lineage, survive lost executors and can be dropped again."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def few(self, df: DataFrame, each: int = 2) -> DataFrame:
        """df in ``each`` files for each core at most: a shuffle may leave many small partitions, and a file is dear.

        Executors may come later than this is asked, so a share of the shuffle partitions counts as cores too.
        """
        cores = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 16)
        return df.coalesce(each * cores)

    def hold(self, df: DataFrame, name: str, each: int | None = 2) -> DataFrame:
        """Write df and return what was written.

        each: files for each core at most, for tables that stay small; None for one of each partition, so that what goes
        into a task is what adaptive execution puts there, however large the table.
        """
        if each:
            df = self.few(df, each)
        df.write.mode("overwrite").options(compression="zstd", **{"parquet.block.size": ROW_GROUP}).parquet(self.path(name))
        release_driver(self.spark)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def drop(self, name: str) -> None:
        files, where = self._files(self.path(name))
        files.delete(where, True)

    def keep(self, *names: str) -> None:
        """Drops every table but these."""
        files, root = self._files(self.root)
        for found in files.listStatus(root):
            if found.getPath().getName() not in names:
                files.delete(found.getPath(), True)


def held_out(doc_id: Column) -> Column:
    """True for rows that no fit may see; false where the id is null, as crc32 of null is null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def row_key(doc_id: Column, text: Column) -> Column:
    """64 bits of a row's id and of its text's hash and length: the same for rows equal in both. A null id is an id."""
    return F.xxhash64(doc_id.cast("long"), F.xxhash64(text), F.octet_length(text))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that where every character has one byte, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def split_words(text: Column, separators: str, trim: str) -> Column:
    """Words between runs of separators (a regex class), as an array; trim has the same characters as text."""
    inner = F.btrim(text, F.lit(trim))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{separators}+"))


def let(value: Column, body) -> Column:
    """Bind value once for body, where a plain reference inside a lambda would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digest_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """The rows with the smallest digests of their id, ``rows`` of them, and their digest as _digest.

    Where there are many more, all but about twice as many are left out by a bound on the digest first, so that tasks do
    not each send a whole sample to the driver.
    """
    df = df.withColumn("_digest", F.md5(F.col(id_col).cast("string")))
    total = df.count()
    if total > 4 * rows:
        df = df.where(F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long") < F.lit((2 * rows << 32) // total))
    return df.orderBy("_digest", id_col).limit(rows)
