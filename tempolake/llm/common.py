"""Shared pieces of the training-data operators: scratch tables, batching, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where a local session names no checkpoint folder (tests, a single machine).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Bytes of an Arrow batch at most (but for a longer row), so that what a task makes of one stays within tens of MB.
BATCH_BYTES = 256 << 10
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Scratch tables that are still there, with their sessions.
_left: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session may do without it."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        os.makedirs(LOCAL_CHECKPOINTS, exist_ok=True)
        there = LOCAL_CHECKPOINTS
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(there)
    return there


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the checkpoint folder where there is none, and a bound in bytes on Arrow batches where there is a wider one.

    The bound has to hold when the caller runs the plan, so it stays set. Batches of short rows keep their size in rows.
    """
    shared_dir(spark)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BYTES))
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    return spark


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    was = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, was) if was is not None else spark.conf.unset(key)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: its lineage ends there.

    The shuffle files behind it go as soon as it is written. ``drop`` removes the table; what is left goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    with _setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    _left[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``stored`` made and nothing will read again."""
    for t in tables:
        _remove(t._scratch, _left.pop(t._scratch))


def _remove(path: str, spark: SparkSession) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


@atexit.register
def _drop_left() -> None:
    for path, spark in _left.items():
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone already
                _remove(path, spark)


def fresh(name: str, columns: list[str]) -> str:
    """``name`` with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_key(*columns: Column | str) -> Column:
    """16 bytes of a SHA-256 that tell values of the columns apart; null and empty are one where there is a single column."""
    values = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    if len(values) == 1:
        whole = F.coalesce(values[0], F.lit(""))
    else:
        # lengths go first, so that no two lists of values make one string
        whole = F.concat(*(F.concat(F.coalesce(F.length(v).cast("string"), F.lit("null")), F.lit(" ")) for v in values), *(F.coalesce(v, F.lit("")) for v in values))
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def packed(docs: DataFrame, text: str = "text", name: str = "packed") -> DataFrame:
    """``docs`` with ``name``, the UTF-8 of column ``text`` under zstd, in its place: texts move at under half their size."""
    keys = [c for c in docs.columns if c != text]
    schema = T.StructType([docs.schema[c] for c in keys] + [T.StructField(name, T.BinaryType())])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            zipped = [None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(zipped, pa.binary())], names=[*keys, name])

    return docs.select(*keys, text).mapInArrow(released(run), schema)


def released(run):
    """``run`` for mapInArrow that gives free memory back to the system at its end: workers live on and serve later stages."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return task


def connected_components(edges: DataFrame) -> DataFrame:
    """Roots of the graph with edges (u long, v long): one row (node, root) for each node of an edge that is no loop.

    Randomised contraction: in each round every node moves to the neighbour (or itself) of lowest hash, edges are
    renamed, loops and repeats go. The expected number of rounds is logarithmic, whatever the shape of the graph, and
    a hub's edges are reduced by map-side minimums, so no node's edges meet in one task. Nothing comes to the driver
    but whether edges are left. The root is some node of the component, the same for all of them. Each table is written
    and read again: a checkpoint keeps the planner's estimate, which of joins is a product and has three times the digits
    after each round.
    """
    edges = stored(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        turn = len(rounds) + 1
        low = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        ends = edges.select(F.col("u").alias("node"), low("v").alias("low")).union(edges.select(F.col("v").alias("node"), low("u").alias("low")))
        moved = ends.groupBy("node").agg(F.min("low").alias("low"))
        moved = stored(moved.select("node", F.least(F.col("low"), low("node")).getField("to").alias("root")), "moved")
        rounds.append(moved)
        a = moved.select(F.col("node").alias("u"), F.col("root").alias("a"))
        b = moved.select(F.col("node").alias("v"), F.col("root").alias("b"))
        renamed = edges.join(a, "u").join(b, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        edges, old = stored(renamed, "edges"), edges
        drop(old)
    drop(edges)
    if not rounds:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    roots = rounds.pop()
    while rounds:  # from the last round back, a join of two tables each
        moved = rounds.pop()
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("end"))
        old, roots = roots, stored(moved.join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "roots")
        drop(moved, old)
    return roots
