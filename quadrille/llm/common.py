"""What the operators share: the shared working folder, tables that cut lineage, and views of Arrow text columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to Python.
BATCH = 8 << 20
#: Bits of a sieve, which is what is broadcast of a set of ids of any size.
SIEVE = 1 << 25


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or the checkpoint folder already set, or (only where
    neither is set and all runs on this machine, as in tests) a new temporary folder."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if not (at := sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadrille-"))
        at = sc.getCheckpointDir()
    return at.rstrip("/")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as it takes for df not to have it (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns a DataFrame that reads it: lineage ends there, and a lost
    executor costs only the tasks that it had not finished."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadrille-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    lean(spark)
    return spark.read.schema(df.schema).parquet(path)


def bounded(spark: SparkSession) -> SparkSession:
    """spark, set to hand Python no more than BATCH bytes of rows at a time (a longer row comes alone), where its setting is higher:
    the default of 64 MB takes several times that of each worker, and of the executor outside its heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).lower())
    if not now or not 0 < int(now[1]) << 10 * " kmgt".index(now[2] or " ") <= BATCH:
        spark.conf.set(name, str(BATCH))
    return spark


def _libc(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError):  # another C library
        pass


def give_back() -> None:
    """Returns to the system what this process has freed: workers live on from task to task, and from query to query, and
    what their allocators keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim", 0)


#: MB of heap up to which lean() leaves the driver's JVM alone.
LEAN = 320


def lean(spark: SparkSession) -> None:
    """Where the driver's JVM has taken more than LEAN of heap, has it collect its garbage, keep little free heap beside what lives, and
    return the rest: it holds the state of many plans and tasks, and grows to its limit otherwise, however little of that lives. Its
    settings stay."""
    jvm = spark._jvm
    if jvm.java.lang.Runtime.getRuntime().totalMemory() >> 20 <= LEAN:
        return
    try:
        kind = jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean")
        flags = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(kind)
        for name, percent in (("MinHeapFreeRatio", "10"), ("MaxHeapFreeRatio", "25")):
            flags.setVMOption(name, percent)
    except Exception:  # another kind of JVM, or limits of its own
        pass
    jvm.java.lang.System.gc()


def slim(spark: SparkSession) -> None:
    """Leans the driver, and has each executor's JVM collect its garbage, whereupon it returns the heap that it does not use: what shuffles and sorts of one
    stage made it take otherwise stays beside the next one's Python workers. As many tasks as there are cores, so that each
    executor has some."""
    give_back()
    lean(spark)
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def thrifty(each):
    """An iterator function's batches. Within a task freed memory up to 32 MB is kept for the next array, as getting it anew costs as
    much time as filling it; at the end of the task it goes back."""

    def run(batches):
        _libc("mallopt", -3, 32 << 20)  # M_MMAP_THRESHOLD
        _libc("mallopt", -1, 256 << 20)  # M_TRIM_THRESHOLD
        try:
            yield from each(batches)
        finally:
            give_back()

    return run


def sieve(ids: DataFrame, column: str) -> DataFrame:
    """A table of SIEVE bits, 4 KB a row, in which that of each id's hash is set. Broadcast, it tells most rows whose id is not
    among any number of ids without moving them; where ids are so many that most bits are set, it lets all pass."""
    at = F.pmod(F.xxhash64(F.lit(11), F.col(column)), F.lit(SIEVE)) + 1
    bits = ids.select(F.bitmap_bucket_number(at).alias("part"), F.bitmap_bit_position(at).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return materialize(bits, "sieve")


def sifted(rows: DataFrame, column: str, bits: DataFrame, passes: bool = True) -> DataFrame:
    """The rows that a sieve lets pass (all whose id is in it, and few others), or those that it holds back."""
    part, held = free_names(rows, "part", "bits")
    at = F.pmod(F.xxhash64(F.lit(11), F.col(column)), F.lit(SIEVE)) + 1
    met = rows.join(F.broadcast(bits.select(F.col("part").alias(part), F.col("bits").alias(held))), F.bitmap_bucket_number(at) == F.col(part), "inner" if passes else "left")
    byte = F.conv(F.hex(F.substring(F.col(held), (F.bitmap_bit_position(at) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.getbit(byte, (F.bitmap_bit_position(at) % 8).cast("int")) == 1
    return met.where(on if passes else ~F.coalesce(on, F.lit(False))).select(*[F.col(f"`{c}`") for c in rows.columns])


def arrow_column(f, kind: str):
    """A user-defined function of one column from f, which maps an Arrow array to one as long, with give_back() at the end of a
    task."""

    def column(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from thrifty(lambda some: map(f, some))(arrays)

    return F.arrow_udf(column, kind)


def crc_mod(id_col: str, n: int):
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def unit_hash(seed: int, *cols):
    """A repeatable number in [0, 1) of the given columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)).cast("double") / F.lit(float(1 << 53))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array without nulls; no copy."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def runs(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes; a longer row is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[0] .. starts[0]+lengths[0]-1, starts[1] .., one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def star(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and the links a-b: the smallest node that each can reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label
