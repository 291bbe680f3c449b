"""Reading, shared intermediate tables and Arrow helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: whole texts go through Python, so batches stay small.
BATCH_ROWS = 1000

#: Where the tables that are written now are noted down, so that who asked for them can delete them.
_noted: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("noted", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches small enough for whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one in local mode; elsewhere that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        set_dir = spark.sparkContext.getCheckpointDir()
        if not set_dir:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
            set_dir = spark.sparkContext.getCheckpointDir()
        path = set_dir
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    if (noted := _noted.get()) is not None:
        noted.append((spark, path))
    return path


@contextlib.contextmanager
def noting() -> Iterator[list[tuple[SparkSession, str]]]:
    """The list of the tables that are written within; drop() them when what was built on them has been written itself."""
    tables: list[tuple[SparkSession, str]] = []
    token = _noted.set(tables)
    try:
        yield tables
    finally:
        _noted.reset(token)


def drop(tables: list[tuple[SparkSession, str]]) -> None:
    """Deletes tables from the shared folder."""
    while tables:
        spark, path = tables.pop()
        jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder, with the writer's options, and reads it again: lineage ends there.

    Shuffle files of what came before become garbage, and are collected at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def batches(arrow: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds at most so many rows, and about so many bytes or one row."""
    for b in arrow:
        i = 0
        while i < b.num_rows:
            n = min(rows, b.num_rows - i)
            while n > 1 and b.slice(i, n).nbytes > size:
                n //= 2
            yield b.slice(i, n)
            i += n


def whole_groups(arrow: Iterable[pa.RecordBatch], keys: int, rows: int = 2048, size: int = 16 << 20) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by their first `keys` columns, of whole numbers: tables that hold whole groups, and where each starts.

    A table holds about so many rows or bytes, or one group.
    """
    held: list[pa.RecordBatch] = []
    n = nbytes = 0

    def out() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        k = np.stack([t.column(i).to_numpy() for i in range(keys)])
        return t, np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1])

    for b in arrow:
        if not b.num_rows:
            continue
        k = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        first = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        if held and any(held[-1].column(i)[-1].as_py() != b.column(i)[0].as_py() for i in range(keys)):
            first = np.concatenate([[0], first])
        at = 0
        for c in first.tolist():
            # Cut at the last group's end at which the table is not yet too large, or at the first after that.
            if n + c - at >= rows or nbytes + (b.slice(at, c - at).nbytes if c > at else 0) >= size:
                held.append(b.slice(at, c - at))
                if n + c - at:
                    yield out()
                held, n, nbytes, at = [], 0, 0, c
        if at < b.num_rows:
            rest = b.slice(at)
            held.append(rest)
            n, nbytes = n + rest.num_rows, nbytes + rest.nbytes
    if n:
        yield out()


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a string or binary array in one byte array, and n + 1 offsets; null is empty."""
    column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else column.cast(pa.binary())
    column = column.fill_null(b"") if column.null_count else column
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def connected(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Components of edges (a, b) as (id, component): the smallest id reachable, for every id in an edge.

    Alternates large-star and small-star rounds on the edges; each round groups only on ids, keeps the number of edges,
    and is written to the shared folder. A hub's edges are met by a join on the hub's smallest neighbour, so no group is
    ever collected. Edges that are null at an end, or join an id to itself, are left out.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialize(both, name)
    last = None
    for _ in range(max_rounds):
        # Large star: every neighbour above u goes to u's smallest neighbour (or u).
        und = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = und.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = und.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u's neighbours below it, and u itself, go to the smallest of them.
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = materialize(small, name)
        now = e.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    low = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return low.unionByName(roots)
