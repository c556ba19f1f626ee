"""Shared helpers: staged tables, blocks of documents, fast sorting, word splitting.

Lineage is cut only through tables in the folder named by
``spark.checkpoint.dir``, which the driver and all executors share, so a lost
executor never loses a stage that has been written. All tables of one
application lie in one folder below it; ``drop_staged`` deletes that folder when
no result that reads them is needed any more.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII characters. ``bytes.split()``
#: splits at exactly the same set.
WORD_RE = r"[^\x20\x09-\x0D]+"
WORD_SPACE = b" \t\n\r\x0b\f"
#: Only where spark.checkpoint.dir is unset and driver and executors are one process, as in tests.
LOCAL_DIR = "/tmp/checkpoints"
#: Bytes that a row of a block counts besides its text, so that empty texts fill blocks too.
ROW_BYTES = 64
#: Spark's own bound on the buckets of a table; beyond it a bucket holds several blocks.
MOST_BUCKETS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application that every node can read and write."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_DIR
    return f"{found.rstrip('/')}/seriesloom-{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Delete all staged tables of this application; results that read them are lost."""
    for t in spark.catalog.listTables():
        if t.name.startswith("seriesloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def blocked(df: DataFrame, name: str, total: int, col: str, block_bytes: int, change: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """``df`` written as a table bucketed by ``b``, the block of each row; ``i`` is unique within it.

    A block takes consecutive rows of one task until they hold ``block_bytes``
    of ``col`` (nulls become empty), so the texts are not shuffled, copies and
    null ids are spread like any other row, and only a single text can make a
    block larger. Joins and cogroups by ``b`` move the other side alone. Blocks
    are numbered so that they spread evenly over the buckets (``block_number``).
    ``change`` turns each text into other bytes before it is written.
    """
    spark, names = df.sparkSession, df.columns
    buckets = min(MOST_BUCKETS, max(math.ceil(total / block_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kinds = ", ".join(f"`{f.name}` {'binary' if change and f.name == col else f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, row, numbers = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            columns = {n: batch[n] for n in names}
            if change:
                raw = pc.fill_null(columns[col], "")
                columns[col] = pa.array([change(t.as_py()) for t in raw.cast(pa.large_binary() if pa.types.is_large_string(raw.type) else pa.binary())], pa.binary())
            else:
                columns[col] = pc.fill_null(columns[col], "")
            size = pc.binary_length(columns[col]).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
            start = held + np.cumsum(size) - size
            held, row = held + int(size.sum()), row + len(size)
            place = start // block_bytes
            while len(place) and len(numbers) <= place[-1]:
                numbers.append(block_number(part, len(numbers), numbers[-1] + 1 if numbers else part << 32, buckets))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(numbers, np.int64)[place]), pa.array(np.arange(row - len(size), row)), *columns.values()], ["b", "i", *names])

    key = f"{name}-{uuid.uuid4().hex}"
    at, as_table = f"{shared_dir(spark)}/{key}", f"seriesloom_{key.replace('-', '_')}"
    df.mapInArrow(run, f"b long, i long, {kinds}").write.bucketBy(buckets, "b").option("path", at).option("compression", "zstd").saveAsTable(as_table, format="parquet")
    return spark.table(as_table)


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur3, seed 42) of long values, by which it picks buckets and partitions."""
    u32, rest = np.uint32, np.ascontiguousarray(x, np.int64).view(np.uint64)
    turn = lambda v, n: (v << u32(n)) | (v >> u32(32 - n))
    h = np.full(len(x), 42, u32)
    for k in ((rest & np.uint64(0xFFFFFFFF)).astype(u32), (rest >> np.uint64(32)).astype(u32)):
        h = turn(h ^ (turn(k * u32(0xCC9E2D51), 15) * u32(0x1B873593)), 13) * u32(5) + u32(0xE6546B64)
    h ^= u32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> u32(shift))) * u32(by)
    return h.view(np.int32)


def block_number(part: int, nth: int, least: int, buckets: int) -> int:
    """The first number from ``least`` on that Spark puts where the ``nth`` block of a task should go.

    Blocks step through the buckets by two irrational shares, so few buckets get
    more than two blocks; by chance alone some would get five or more.
    """
    want = int((part * 0.6180339887498949 + nth * 0.7548776662466927) % 1 * buckets)
    for at in range(least, least + 64 * buckets, 4 * buckets):
        hit = np.flatnonzero(spark_hash(np.arange(at, at + 4 * buckets)) % buckets == want)
        if len(hit):
            return at + int(hit[0])
    return least


def stable_order(keys: np.ndarray) -> np.ndarray:
    """np.argsort(keys, kind="stable") for whole numbers from 0 to 2**32 - 1, by one fast sort."""
    n = np.uint64(32)
    return (np.sort((keys.astype(np.uint64) << n) | np.arange(len(keys), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def distinct(s: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which is many times faster than by a hash table."""
    s = np.sort(s)
    return s[run_starts(s)]


def run_starts(s: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``first`` and have ``size`` places."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(col: str = "text") -> Column:
    """Number of words of a text (null: 0), without Python."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD_RE)), F.lit(0)).cast("long")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, other letters untouched."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(col).cast("string"))).alias("b")).first()["b"] or 0


def crc_mod(col: str, m: int) -> Column:
    """crc32 of a number's decimal text, modulo ``m``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(m)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def sortable(df: DataFrame) -> list[str]:
    """The columns of ``df`` that have an order (all but maps and variants, also nested)."""
    return [f"`{f.name}`" for f in df.schema if not re.search(r"map<|variant", f.dataType.simpleString())]
