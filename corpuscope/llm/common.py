"""Helpers shared by the training-data operators: scratch tables, word splitting, connected components."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that reach a Python worker in one Arrow batch; texts are a few kB on average and at most some MB.
BATCH_ROWS = 256

#: Lower-cases A-Z and leaves every other byte alone.
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Lower-cases A-Z and turns the bytes outside [0-9a-z] and below 0x80 into spaces.
ALNUM_ONLY = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches by rows and, where Spark knows the setting, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where it is unset and the master local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is None:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpuscope-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: list[tuple[object, str]] = []


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInArrow, which at a task's end gives the worker's free memory back: workers are reused."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root; it is removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _remove_scratch() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may have ended before
            return


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Cut the lineage: write df below the shared root as Parquet and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = (out, path)
    return out


_tables: dict[int, tuple[DataFrame, str]] = {}


def forget(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing will read again."""
    for t in tables:
        _, path = _tables.pop(id(t))
        drop_path(t.sparkSession, path)
        _made.remove((t.sparkSession, path))


def crc_mod(key: Column, n: int) -> Column:
    """crc32(key as text) mod n."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns of df, whatever else it has."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b), root the smallest node that it reaches.

    Alternating star contraction: every node keeps its smallest smaller neighbour as parent, hands its other
    parents to that one, and its children jump to its parent. Each round is a pre-aggregated minimum by child and a
    join that adaptive execution may split, so a node with very many neighbours does not meet in one task.
    Empty edges give an empty table; loops (a = b) and repeated edges change nothing.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).where("v != p").distinct()
    e = written(e, name)
    while True:
        low = written(e.groupBy("v").agg(F.min("p").alias("m"), F.count("*").alias("n")), name + "-min")
        up = low.select(F.col("v").alias("p"), F.col("m").alias("g"))
        # parents handed to the smallest parent, then every child one step up where its parent has a parent
        hooked = e.join(low.where("n > 1").select("v", "m"), "v").where("p != m").select(F.col("p").alias("v"), F.col("m").alias("p"))
        flat = low.select("v", F.col("m").alias("p")).unionByName(hooked)
        jumped = flat.join(up, "p", "left").select("v", F.coalesce("g", "p").alias("p"))
        nxt = written(jumped.where("v != p").distinct(), name)
        state = nxt.groupBy("v").agg(F.min("p").alias("m"), F.count("*").alias("n"))
        deep = nxt.select(F.col("p").alias("v")).distinct().join(nxt.select("v").distinct(), "v", "left_semi")
        e = nxt
        if not state.where("n > 1").limit(1).count() and not deep.limit(1).count():
            return e.select(F.col("v").alias("node"), F.col("p").alias("root")).unionByName(e.select(F.col("p").alias("node"), F.col("p").alias("root")).distinct())
