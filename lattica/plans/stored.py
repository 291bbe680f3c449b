"""Tables between rounds of iterative plans, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a temporary one in local mode; elsewhere that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="lattica-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lattica-{name}-{uuid.uuid4().hex}"


def opened(path: str):
    """The file system of a path or URI, and the path in it; whatever pyarrow reaches."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def table(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again, so that it is computed once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df, with its lineage cut by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, keys: list[str], max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(keys, src, dst): (keys, v, root), where root is the least vertex reachable.

    Rounds of large and small stars; each joins on a vertex's least neighbour and collects no group.
    """
    e = cut(edges.select(*keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("v")).distinct()
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x")
        e = cut(large.join(low, [*keys, "u"]).select(*keys, pair).select(*keys, "x.u", "x.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return ends.join(e.select(*keys, F.col("u").alias("v"), F.col("v").alias("root")), [*keys, "v"], "left").withColumn("root", F.coalesce("root", "v"))
        last = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
