"""op5 writes few files however many shuffle partitions there are: an executor starts processes for each."""

import os

from lattica.llm import linedup
from lattica.llm.common import shared_dir


def test_op5_writes_few_files(spark, tmp_path):
    # 400 leaves that recur, so that each of many partitions holds some of every table.
    text = lambda i: "\n".join(f"w{k % 20:x} t{'x' * (k // 20)} z end {k} {i}" if k % 2 else f"{'ab' * (k % 20)} {'c' * (k // 20 + 1)} q" for k in range(400)) + f"\nown line {'x' * i}"
    spark.createDataFrame([(i, text(i)) for i in range(60)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    shared = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(shared))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "211")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = linedup.op5_linedup(spark, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    tables = {d: sum(f.endswith(".parquet") for f in os.listdir(f"{shared}/{d}")) for d in set(os.listdir(shared)) - before} | {"out": len([f for f in os.listdir(f"{tmp_path}/out") if f.endswith(".parquet")])}
    assert len(tables) == 8 and max(tables.values()) <= 26, tables
    assert spark.read.parquet(f"{tmp_path}/out").count() == 60
