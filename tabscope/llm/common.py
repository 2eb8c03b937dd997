"""What the operators of this subpackage share: lower-casing, words, hot keys and Arrow slices."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows, and bytes of their values as text, up to which a counted side of a join is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 16 << 20

#: A key is heavy if it holds more than one in so many rows: at most so many keys can.
HEAVY_SHARE = 1_000

#: Bytes of text that a Python worker turns into objects at a time.
SLICE_BYTES = 4 << 20


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(text: str) -> str:
    """SQL: A-Z in lower case, all other characters as they are. Null stays null.

    Text of one byte per character takes the fast built-in function, which does the same there.
    """
    return (f"CASE WHEN octet_length({text}) = char_length({text}) THEN lower({text}) "
            f"ELSE translate({text}, '{UPPER}', '{LOWER}') END")


def by_value(module: str) -> None:
    """Ship this module's functions with the tasks, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def written(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder: read again from there, also after lost executors."""
    shared_folder(df.sparkSession)
    rows = df.checkpoint(eager=True)
    give_back_jvm(df.sparkSession)
    return rows


def sized(df: DataFrame) -> DataFrame:
    """Broadcast rows that are counted to be few and short; leave the join to shuffle beyond that. Takes written rows."""
    size = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes")).head()
    return F.broadcast(df) if size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES else df


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int) -> DataFrame:
    """Join rows to the one row of their group, whatever share of the rows a group has.

    ``groups`` has the columns ``key`` and ``size`` (rows of the group). At most HEAVY_SHARE groups can
    have more than a HEAVY_SHARE-th of the rows: these are broadcast, so that their rows stay where they
    are; the others meet by a shuffle in which no key is hot.
    """
    heavy = F.col(size) * HEAVY_SHARE > n_rows
    hot = F.broadcast(groups.where(heavy))
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(groups.where(~heavy), key))


class Remembered:
    """A cache in two generations: bounded to twice ``most`` entries, and what is used stays.

    When the younger generation is full it becomes the older one; entries found there move to the younger again.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value


def give_back() -> None:
    """Return memory that is free in this process to the system: a Python worker, and the driver, outlive what filled it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so by themselves
        ctypes.CDLL(None).malloc_trim(0)


def give_back_jvm(spark: SparkSession) -> bool:
    """The same for the driver's JVM: what ``jcmd <pid> System.trim_native_heap`` does. False where its JVM has no such command.

    Planning and compiling many short jobs on many threads leaves free memory in the C library's pools, outside the heap.
    """
    try:
        java, new_array = spark._jvm.java, spark.sparkContext._gateway.new_array
        kinds = new_array(java.lang.Class, 4)  # the server's own class is not open to callers, its public interface is
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = java.lang.Class.forName(kind)
        given = new_array(java.lang.Object, 4)  # the command takes no arguments
        given[0], given[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        invoke.invoke(java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except (Py4JError, AttributeError):  # another JVM, or a session without one at hand
        return False
    return True


def slices(batches: Iterator[pa.RecordBatch], column: int = 0, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of about ``most`` bytes of text; one longer text makes a run of its own."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        if start < batch.num_rows:
            yield batch.slice(start)


by_value(__name__)
