"""Every query with SQL equals DuckDB on a small scale; sources and sinks; the entry point."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lattica.operators import graphs as G
from lattica.operators import kernels as K
from lattica.plans import registry as R
from lattica.sources import tables as T

SF = "/root/testdata/sf0.001"
#: What has no SQL here, and takes longest, runs in the benchmark.
QUICK = [n for n in R.QUERIES if n in R.ORACLES]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if isinstance(x, str) else x or 0) for x in r))


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, db, name):
    got = R.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    names = [r[0] for r in db.sql(f"DESCRIBE {R.ORACLES[name]}").fetchall()]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in db.sql(R.ORACLES[name]).fetchall()]
    assert ordered(tuple(r[c] for c in columns) for r in got.collect()) == ordered(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_breadth_first_golden(spark):
    e = [(0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (2, 5), (2, 6), (4, 7)]
    both = [x for a, b in e for x in ((a, b), (b, a))]
    df = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(both)], "src int, dst int, edge_no int")
    assert [r.v for r in G.breadth_first(df, 5).orderBy("position").collect()] == [5, 1, 2, 0, 3, 4, 6, 7]
    with pytest.raises(ValueError):
        G.breadth_first(df, 5, max_depth=1)


def test_partitions(spark):
    e = spark.createDataFrame([(1, 0, 1, 1.0), (1, 2, 3, 1.0)], "g int, src long, dst long, w double")
    v = spark.createDataFrame([(1, i) for i in range(5)], "g int, v long")
    comp = G.connected_components(v, e, ["g"])
    assert sorted((r.v, r.root) for r in comp.collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]
    small = G.image_components(v.withColumnRenamed("g", "image_id"), e.withColumnRenamed("g", "image_id"))
    assert sorted((r.v, r.root) for r in small.collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]
    assert sorted((r.root, r.src, r.dst) for r in G.induced_subgraphs(e, comp, ["g"]).collect()) == [(0, 0, 1), (2, 0, 1)]
    m = G.remove_isolated(v, e, ["g"])
    assert sorted((r.v, r.root) for r in G.add_isolated(m, spark.createDataFrame([(1, i, 0) for i in range(4)], "g int, new int, root long"), ["g"]).collect())[-1] == (4, 4)


def test_csv_and_faces(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a.png,12,x\nb.png,7.5,-3")
    assert [tuple(r) for r in T.face_positions(spark, str(tmp_path / "f.csv")).collect()] == [("a.png", 12.0, 0.0), ("b.png", 7.0, -3.0)]
    T.write_matrix_csv(spark.createDataFrame([(0, 1, 2.5), (0, 0, 1.0)], "i int, j int, v double"), str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["1.0, 2.5"]


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(path, rows):
        raw = b"".join(b"\0" + bytes(x for p in r for x in p) for r in rows)
        part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))

    png(tmp_path / "rei_a.png", [[(255, 0, 0), (0, 255, 0)]])
    png(tmp_path / "rei_a.png-mask.png", [[(0, 0, 0), (200, 200, 200)]])
    got = T.decoded_pixels(T.dataset(spark, str(tmp_path), ["asuka", "rei"], 15)).orderBy("c").collect()
    assert [(r.image_id, r.c, r.b, r.g, r.red, r["mask"]) for r in got] == [(15, 0, 0.0, 0.0, 255.0, 1.0), (15, 1, 0.0, 255.0, 0.0, 0.0)]


def test_same_result_with_one_partition(spark):
    run = lambda: sorted(map(tuple, R.QUERIES["knn_graph"](spark, SF).collect()))
    eight = run()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert run() == eight
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_sparse_product(spark):
    m = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 1, 3.0)], "i int, j int, v double")
    v = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, v double")
    got = {r.i: r.v for r in K.sparse_times(m, v).collect()}
    assert got == {0: 4.0, 1: 6.0} and np.isclose(R.V.approx_nonzeros is not None, True)
    assert spark.range(1).select(R.V.approx_nonzeros(F.array(F.lit(0.0), F.lit(1.0)))).first()[0] == 1
