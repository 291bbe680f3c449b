"""Exact top-k inner products by block-at-a-time pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import materialize, read

RESULT = "query_id long, rank int, vec_id long, score long"
PACKED = "part int, nth int, ids binary, dims int, terms binary, high binary, low binary"
#: Leading terms that order the rows; rows that every query is scored against first, for a bound of its kth score; and
#: pieces whose summaries travel together.
LEADING, FIRST_ROWS, BUNDLE = 3, 2048, 256


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, terms): floor(scale * x) of each component x, as doubles; rows that hold null or non-finite parts go.

    An empty vector has no terms, and scores 0 with every query. Other columns go.
    """
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(good).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("terms"))


def leading(terms: Column) -> Column:
    """A number that rows share whose largest terms are the same ones, in the same order, with the same signs."""
    big = F.slice(F.sort_array(F.transform(terms, lambda x, i: F.struct(F.abs(x).alias("size"), (-i).alias("minus"), (x < 0).cast("int").alias("sign"))), False), 1, LEADING)
    return F.aggregate(big, F.lit(0).cast("long"), lambda a, t: a * 100_003 + 1 - 2 * t["minus"] + t["sign"])


def packed(terms: DataFrame, rows: int) -> DataFrame:
    """Runs of up to so many rows in the order of their leading terms, as forward indexes (PACKED).

    A piece holds ids and a matrix of 64-bit terms, and the greatest and least value of each term.
    """

    def pack(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0

        def out(p: pd.DataFrame) -> pd.DataFrame:
            dims = max(map(len, p.terms))
            m = np.zeros((len(p), dims), np.int64)
            for i, x in enumerate(p.terms):
                m[i, : len(x)] = x
            return pd.DataFrame({"part": [part], "nth": [nth], "ids": [p.vec_id.to_numpy(np.int64).tobytes()], "dims": [dims], "terms": [m.tobytes()], "high": [m.max(axis=0).tobytes()], "low": [m.min(axis=0).tobytes()]})

        held: list[pd.DataFrame] = []
        n = 0
        for p in it:
            while len(p):
                some, p = p.iloc[: rows - n], p.iloc[rows - n :]
                held.append(some)
                n += len(some)
                if n == rows:
                    yield out(pd.concat(held))
                    held, n, nth = [], 0, nth + 1
        if n:
            yield out(pd.concat(held))

    ranged = terms.withColumn("lead", leading(F.col("terms"))).repartitionByRange("lead", "vec_id").sortWithinPartitions("lead", "vec_id")
    return ranged.select("vec_id", "terms").mapInPandas(pack, PACKED)


def numbered(pieces: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The stored pieces with numbers from 0 on, in their order, and how many there are."""
    stored = materialize(pieces, name)
    # One row for thousands of vectors, without their terms.
    numbers = stored.select("part", "nth", (F.row_number().over(Window.orderBy("part", "nth")) - 1).alias("piece"))
    out = materialize(stored.join(numbers, ["part", "nth"]).drop("part", "nth"), f"{name}-numbered")
    return out, out.select("piece").count()


def unpack(ids: bytes, dims: int, terms: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.frombuffer(terms, np.int64).reshape(-1, dims) if dims else np.zeros((len(ids) // 8, 0), np.int64)
    return np.frombuffer(ids, np.int64), np.pad(m, ((0, 0), (0, width - dims)))


def exact_product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q @ m.T of 64-bit integers, through doubles where no partial sum can leave their exact range."""
    if q.size and m.size and float(np.abs(q).max()) * float(np.abs(m).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    return q @ m.T


def upper_bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For every query and block no less than any score in the block, from its greatest and least value of each term."""
    pos, neg = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    bounds = pos @ high.T.astype(np.float64) + neg @ low.T.astype(np.float64)
    return bounds + np.abs(bounds) * 1e-12  # a bound may round, but not down


LOWEST = np.iinfo(np.int64).min


def top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, block: int = 64, kth: np.ndarray | None = None, looked_at: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query, row, score) triples of each query over rows in blocks; ties go to smaller ids.

    Each block of rows has the greatest and least value of each term; their products with a query sum to a bound of any
    score in the block. A query takes blocks in order of falling bounds, scores each whole through its forward index, and
    stops at the first bound below its kth score. kth: scores that each query's kth best is known to reach at least; rows
    below it are left out. looked_at: gets the number of rows scored, summed over the queries.
    """
    starts = np.arange(0, len(ids), block)
    bounds = upper_bounds(q, np.maximum.reduceat(m, starts), np.minimum.reduceat(m, starts))
    order = np.argsort(-bounds, axis=1, kind="stable")
    floor = np.full(len(q), LOWEST) if kth is None else kth
    best, best_id = np.full((len(q), k), LOWEST), np.full((len(q), k), np.iinfo(np.int64).max)
    alive, scored = np.arange(len(q)), 0
    for r in range(len(starts)):
        alive = alive[bounds[alive, order[alive, r]] >= np.maximum(best[alive, k - 1], floor[alive])]
        if not len(alive):
            break
        mine = order[alive, r]
        for b in np.unique(mine):
            who = alive[mine == b]
            at = slice(starts[b], starts[b] + block)
            s = exact_product(q[who], m[at])
            scored += s.size
            s = np.where((ids[at][None, :] == q_ids[who][:, None]) | (s < floor[who][:, None]), LOWEST, s)
            better = s.max(axis=1) >= np.maximum(best[who, k - 1], LOWEST + 1)
            who, s = who[better], s[better]
            if len(who):
                both = np.concatenate([best[who], s], axis=1)
                both_id = np.concatenate([best_id[who], np.where(s == LOWEST, np.iinfo(np.int64).max, ids[at][None, :])], axis=1)
                by_id = np.argsort(both_id, axis=1, kind="stable")
                both, both_id = np.take_along_axis(both, by_id, 1), np.take_along_axis(both_id, by_id, 1)
                first = np.argsort(~both, axis=1, kind="stable")  # falling, and without overflow
                best[who], best_id[who] = np.take_along_axis(both, first[:, :k], 1), np.take_along_axis(both_id, first[:, :k], 1)
    if looked_at is not None:
        looked_at.append(scored)
    found = best_id != np.iinfo(np.int64).max
    i, j = np.nonzero(found)
    return q_ids[i], best_id[i, j], best[i, j]


def kth_scores(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """Each query's kth best score among these rows, without its own; the lowest number where there are fewer."""
    s = exact_product(q, m)
    s = np.where(ids[None, :] == q_ids[:, None], LOWEST, s)
    return np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), LOWEST)


def top_k_search(queries: DataFrame, vectors: DataFrame, k: int = 20, *, rows: int = 4096, query_rows: int = 2048, stats: bool = False) -> DataFrame:
    """The k rows of greatest inner product for each query, both as quantized(): (query_id, rank, vec_id, score).

    1. Rows are sorted by their leading terms, so that those of a block are alike, and packed in pieces of bounded size.
    2. Queries are scored against a few rows (FIRST_ROWS, the least by a hash of the id), which bounds their kth score
       from below: that bound holds in every piece.
    3. Of each piece only the greatest and least value of each term meet the queries; pieces that no query of a query piece
       can need are left out. Those that are left are searched block by block, and their k best per query are merged.

    A query's own row (equal vec_id) is no answer; repeated vec_ids each count as a row of their own. Vectors of unequal
    length are padded with zeros. No queries or no rows: an empty result. stats: (q, m, pairs, scored) instead, the pairs of
    query and row in each pair of pieces that was searched, and those that were scored.
    """
    spark = vectors.sparkSession
    m, m_n = numbered(packed(vectors, rows), "vectors")
    q, q_n = numbered(packed(queries, query_rows), "queries")
    if not m_n or not q_n:
        return spark.createDataFrame([], "q int, m int, pairs long, scored long" if stats else RESULT)
    some = vectors.select("vec_id", "terms", F.xxhash64("vec_id").alias("o")).orderBy("o", "vec_id").limit(FIRST_ROWS).collect()
    some_dims = max(len(r.terms) for r in some)
    given = spark.sparkContext.broadcast((np.array([r.vec_id for r in some], np.int64), np.array([r.terms + [0] * (some_dims - len(r.terms)) for r in some], np.int64).reshape(len(some), some_dims)))

    def bounded(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, some_rows = given.value
        for p in it:
            kth = []
            for x in p.itertuples():
                width = max(int(x.dims), some_rows.shape[1])
                q_ids, q_rows = unpack(x.ids, int(x.dims), x.terms, width)
                kth.append(kth_scores(q_ids, q_rows, ids, np.pad(some_rows, ((0, 0), (0, width - some_rows.shape[1]))), k).tobytes())
            yield p.assign(kth=kth)

    q = materialize(q.select("piece", "ids", "dims", "terms").mapInPandas(bounded, "piece int, ids binary, dims int, terms binary, kth binary"), "queries-bounded")
    bundles = m.groupBy(F.floor(F.col("piece") / BUNDLE).cast("int").alias("bundle")).agg(F.collect_list(F.struct("piece", "dims", "high", "low")).alias("all"))  # BUNDLE summaries
    left = bundles.select("bundle", F.explode(F.sequence(F.lit(0), F.lit(q_n - 1))).alias("q"), "all")
    right = q.select(F.explode(F.sequence(F.lit(0), F.lit((m_n - 1) // BUNDLE))).alias("bundle"), F.col("piece").alias("q"), "ids", "dims", "terms", "kth")

    def needed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        if len(a) and len(b):
            x = b.iloc[0]
            of = a.iloc[0]["all"]
            width = max([int(x.dims), *(int(p["dims"]) for p in of)])
            _, q_rows = unpack(x.ids, int(x.dims), x.terms, width)
            kth = np.frombuffer(x.kth, np.int64)
            ends = [np.stack([np.pad(np.frombuffer(p[c], np.int64), (0, width - int(p["dims"]))) for p in of]) for c in ("high", "low")]
            open_ = (upper_bounds(q_rows, *ends) >= kth[:, None]).any(axis=0)
            out = [(int(x.q), int(p["piece"])) for p, o in zip(of, open_, strict=True) if o]
        return pd.DataFrame(out, columns=["q", "m"]).astype("int32")

    pairs = materialize(left.groupBy("bundle", "q").cogroup(right.groupBy("bundle", "q")).applyInPandas(needed, "q int, m int"), "pairs")
    left = m.withColumnRenamed("piece", "m").join(pairs, "m").select("m", "q", "ids", "dims", "terms")
    right = q.withColumnRenamed("piece", "q").join(pairs.toDF("q", "m"), "q").select("m", "q", "ids", "dims", "terms", "kth")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.iloc[0], b.iloc[0]
        width = max(int(a.dims), int(b.dims))
        ids, rows_ = unpack(a.ids, int(a.dims), a.terms, width)
        q_ids, q_rows = unpack(b.ids, int(b.dims), b.terms, width)
        seen: list[int] = []
        i, j, s = top_k(q_ids, q_rows, ids, rows_, k, kth=np.frombuffer(b.kth, np.int64), looked_at=seen)
        if stats:
            return pd.DataFrame({"q": [b.q], "m": [a.m], "pairs": [len(q_ids) * len(ids)], "scored": seen})
        return pd.DataFrame({"query_id": i, "vec_id": j, "score": s})

    cells = left.groupBy("m", "q").cogroup(right.groupBy("m", "q"))
    if stats:
        return cells.applyInPandas(search, "q int, m int, pairs long, scored long")
    found = cells.applyInPandas(search, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of each vector whose id is divisible by 20, over all rows of embeddings.

    Null ids and vectors, and those that hold null or non-finite components, take no part; ties go to smaller ids.
    """
    v = quantized(read(spark, sf_dir, "embeddings"))
    return top_k_search(v.where(F.col("vec_id") % 20 == 0), v, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.t, v.t), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
