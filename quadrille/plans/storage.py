"""Working tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Working folders of the run() that is going on, if any.
_RUNNING: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder already set; only where neither is and all runs on this machine, a new
    temporary folder."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadrille-"))
    return sc.getCheckpointDir().rstrip("/")


def working_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at the end of working() if that goes on."""
    path = f"{shared_dir(spark)}/quads-{name}-{uuid.uuid4().hex}"
    if _RUNNING:
        _RUNNING[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df into the shared folder and returns a DataFrame that reads it, so that lineage ends there. Whoever gets DataFrames
    that read it clears the folder; within working() it goes by itself."""
    path = working_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    forget(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Has the driver notice that the shuffles of a finished write are no longer needed, so that executors remove their files; otherwise
    these stay until its heap happens to fill."""
    spark._jvm.System.gc()


def repeatable(df: DataFrame, name: str) -> DataFrame:
    """df if its rows come in the same partitions and order whenever it is read, as those of files through narrow expressions do; or else a
    table of it."""
    todo, narrow = [df._jdf.queryExecution().optimizedPlan()], {"Project", "Filter", "Generate", "Union", "LogicalRelation"}
    while todo:
        node = todo.pop()
        if node.nodeName() not in narrow and not node.nodeName().startswith("Relation") or not node.deterministic():
            return materialize(df, name)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return df


#: Rows that go through exchanges at once in sliced(), and slices at most.
SLICE, SLICES = 100_000_000, 16


def sliced(rows: DataFrame, key: str, make) -> DataFrame:
    """make(rows), which groups by key and perhaps more. Where rows are many, slices of their keys take turns, so that the
    exchanges of only one are on disk; each slice reads rows again."""
    n = min(SLICES, -(-rows.count() // SLICE))
    if n <= 1:
        return make(rows)
    at = F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(n))
    return reduce(DataFrame.unionByName, [materialize(make(rows.where(at == i)), "slice", compression="zstd") for i in range(n)])


def parts_for(rows: int, spark: SparkSession) -> int:
    """Into how many parts to deal what meets a table of so many rows."""
    return min(512, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 65_536)))


def dealt(df: DataFrame, name: str, parts: int, key: str) -> DataFrame:
    """Like materialize(), with the rows of a key in one part, which a join or an aggregate by key needs no exchange for. As columns,
    compressed, rows take a fraction of what they take in an exchange."""
    spark, table, most = df.sparkSession, f"quads_{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(most)
    try:
        spark.conf.set(most, str(max(parts, int(before))))  # as many open files, instead of a sort that spills
        df.write.bucketBy(parts, key).options(path=working_path(spark, name), compression="zstd").saveAsTable(table)
        return spark.table(table)
    finally:
        spark.conf.set(most, before)
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the files stay
        forget(spark)


#: Bits of a sieve at most.
SIEVE = 1 << 26


def sieve(rows: DataFrame, column: str):
    """A function of a column that holds for all values that rows have in the given one, and for few others (or for most, where there
    are many more values than SIEVE bits). Null gives null."""
    spark = rows.sparkSession
    size = 1 << min(SIEVE.bit_length() - 1, max(10, (8 * rows.count()).bit_length()))

    def at(value: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), value), F.lit(size)) for i in (11, 12)]

    bits = rows.select(F.explode(F.array(*at(F.col(column)))).alias("at"))
    bits = bits.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    one = spark.createDataFrame(pa.table({"words": pa.array([words], pa.list_(pa.int64()))}))

    def passes(value: Column) -> Column:
        set_ = [F.getbit(F.get(one.scalar(), F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1 for bit in at(value)]
        return F.when(value.isNotNull(), set_[0] & set_[1])

    return passes


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Working tables made inside are removed at the end, if all went well: what a failed run leaves shows where it was."""
    _RUNNING.append([])
    try:
        yield
        for path in _RUNNING[-1]:
            remove(spark, path)
    finally:
        _RUNNING.pop()
