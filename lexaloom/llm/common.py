"""Helpers shared by the operators of this subpackage.

The working folder is the one the session names in ``spark.checkpoint.dir``;
only a local session that names none gets a temporary one.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Written tables that still exist.
_TABLES: set[str] = set()
#: While a table is written: shuffle files are removed when the query that wrote them
#: ends, not when the driver happens to collect its garbage; and a stage's code that
#: would be too long for the JVM's compiler (8000 bytes of bytecode) isn't fused.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}
#: Bytes of text that a vectorised step holds at once; arrays over them are some dozens of times larger.
CHUNK_BYTES = 2_000_000


def workspace(spark: SparkSession) -> str:
    """The folder shared by driver and executors for written intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    made = tempfile.mkdtemp(prefix="lexaloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def _trim(spark: SparkSession) -> None:
    """Memory that the driver's JVM has freed goes back to the machine. Each exchange starts threads and each plan
    is compiled; what they freed otherwise stays with the C library, for each of its arenas, and adds up over a long run."""
    try:
        jvm = spark.sparkContext._jvm
        # by the interface's method, since the server's own class isn't open to others
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Exception:  # noqa: BLE001  only some JVMs can
        pass


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the table that was
    written: cuts lineage, survives lost executors, keeps column pruning.

    The write's shuffle files go as soon as it has ended; the table stays until
    ``release`` or the end of the process."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            spark.conf.set(key, value)
        df.write.options(**options).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    _trim(spark)
    _TABLES.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote. Nothing that still is to be computed may read them."""
    for table in tables:
        if table.written_to in _TABLES:
            _TABLES.remove(table.written_to)
            _remove(table.sparkSession, table.written_to)


@atexit.register
def _release_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in _TABLES if spark else ():
        _remove(spark, path)


#: The row_key column in the schema that an Arrow function returns.
KEY_TYPE = ", key struct<k1: long, k2: long>"


def row_key(id_: Column, text: Column) -> Column:
    """128 bits of a row's id and text, either of which may be null."""
    parts = (id_.isNull(), id_, text.isNull(), text)
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2"))


def only_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose row_key is in column ``key`` of ``keys``."""
    key = row_key(F.col(id_col), F.col(text_col))
    good = keys.select(F.col("key.k1").alias("good_1"), F.col("key.k2").alias("good_2")).distinct()
    return docs.join(good, (key["k1"] == F.col("good_1")) & (key["k2"] == F.col("good_2")), "left_semi")


#: Longs of 64 bits of a filter over keys that keeps other rows out of shuffles.
FILTER_LONGS = 1 << 16
_CELL = f"cast(shiftrightunsigned(xxhash64(k), 6) & {FILTER_LONGS - 1} as int)"
_PLACE = "cast(xxhash64(k) & 63 as int)"


def key_filter(keys: DataFrame) -> DataFrame:
    """One row: a bitmap of the hashes of column ``k``, of fixed size."""
    words = keys.select(F.expr(_CELL).alias("at"), F.expr(f"shiftleft(1L, {_PLACE})").alias("bit"))
    filled = words.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(FILTER_LONGS).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("cells")).select(F.transform("cells", lambda c: c["bits"]).alias("bits"))


def maybe_in(table: DataFrame) -> Column:
    """Whether column ``k`` may be one of the keys of a filter; never false for one of them."""
    bits = table.select("bits").scalar()
    return F.call_function("shiftrightunsigned", F.get(bits, F.expr(_CELL)), F.expr(_PLACE)).bitwiseAND(F.lit(1).cast("long")) == 1


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for rows that no model may learn from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What empties the caches that a worker process keeps between tasks.
_FORGET: list[Callable[[], None]] = []


def kept_between_tasks(forget: Callable[[], None]) -> None:
    """Names what empties a cache of this process when tasks start that don't use it."""
    _FORGET.append(forget)


def lighten() -> None:
    """Empties the caches that tasks of other operators have left in this worker process: workers are used again, and what
    they keep adds to what later tasks need."""
    for forget in _FORGET:
        forget()
    pa.default_memory_pool().release_unused()


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``most`` bytes together; a single longer row is a slice of its own."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... lengths[0] of them, then those of the next."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_split(df: DataFrame, key: str, parts: int, descending: bool = False) -> Column:
    """A column 0 .. parts-1 that deals rows by ranges of a numeric ``key``.

    Only the key is read, and only ``parts - 1`` numbers come to the driver."""
    if parts < 2:
        return F.lit(0)
    at = [i / parts for i in range(1, parts)]
    row = df.select(F.percentile_approx(F.col(key), at, max(10_000, 20 * parts)).alias("cuts")).first()
    cuts = sorted(set(row["cuts"] or []))
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.lit(x) for x in cuts])
    found = F.size(F.filter(table, lambda x: x < F.col(key)))
    found = F.coalesce(found, F.lit(0))
    return (F.lit(len(cuts)) - found if descending else found).cast("int")
