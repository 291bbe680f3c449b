"""The library's queries over the driver's tables, and the SQL that each must equal.

Vectors of the embeddings table serve as samples and, read as 8 x 8 images, as pixels; a coarse colour segmentation gives
segments. Doubles are rounded on both sides. Queries without SQL are held against numpy or brute force by tests.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import color, fuzzy
from lattica.functions import vectors as V
from lattica.operators import classify as C
from lattica.operators import graphs as G
from lattica.operators import kernels as K
from lattica.operators import neighbours as N
from lattica.operators import pixels as P
from lattica.operators import segments as S
from lattica.plans.stored import shared_folder
from lattica.sources.tables import face_positions as read_face_positions
from lattica.sources.tables import vector_images, vectors, write_face_positions

BGR = ["b", "g", "red"]
UNIT = ((0.0, 1.0),) * 3
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    # Adding 0 turns a negative zero into zero.
    return df.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def _near(spark: SparkSession, d: str, k: int) -> DataFrame:
    return N.nearest_similarities(vectors(spark, d), k)


def _segments(px: DataFrame) -> DataFrame:
    root = F.min("pix").over(Window.partitionBy("image_id", F.floor(F.col("v") * 8)))
    return S.root_index(px.select("image_id", "pix", root.alias("root")))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_S = "s AS (SELECT vec_id AS id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, label FROM embeddings)"
_P = "p AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d, a.label AS li, b.label AS lj FROM s a, s b WHERE a.id <> b.id)"
_SIM = f"{_S}, {_P}, sim AS (SELECT i, j, exp(-d * d) AS s FROM p)"
_TOP = f"{_SIM}, top AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS n FROM sim)"
_NN = f"{_S}, {_P}, nn AS (SELECT i AS id, li AS label, lj AS predicted, j AS neighbour FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1)"
_PX = f"""{_S}, cells AS (SELECT id AS image_id, label, x, unnest(range(64)) AS pix FROM s),
px AS (SELECT image_id, label, pix, pix // 8 AS r, pix % 8 AS c, x[pix + 1] AS v, (x[pix + 1] + 1) / 2 AS b, (x[(pix + 1) % 64 + 1] + 1) / 2 AS g,
  (x[(pix + 2) % 64 + 1] + 1) / 2 AS red, CASE WHEN x[pix + 1] >= 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM cells)"""
_IDX = f"""{_PX}, seg0 AS (SELECT *, min(pix) OVER (PARTITION BY image_id, floor(v * 8)) AS root FROM px),
seg AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS seg_idx FROM seg0)"""


def _grid_sql(n: int) -> str:
    o = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(G.OFFSETS[n]))
    return f"""g{n} AS (SELECT a.image_id, a.pix * {len(G.OFFSETS[n])} + o.k AS edge_no, a.pix AS src, b.pix AS dst, abs(a.v - b.v) AS w
  FROM px a, (VALUES {o}) o(k, dr, dc), px b WHERE a.mask >= 0.5 AND b.mask >= 0.5 AND b.image_id = a.image_id AND b.r = a.r + o.dr AND b.c = a.c + o.dc)"""


_G4 = f"{_PX}, {_grid_sql(4)}"
_M4 = f"{_G4}, m AS (SELECT image_id, src, dst, w FROM g4 UNION ALL SELECT image_id, dst, src, w FROM g4), deg AS (SELECT image_id, src AS v, sum(w) AS degree FROM m GROUP BY ALL)"
_CC = f"""{_G4}, m AS (SELECT image_id, src, dst FROM g4 UNION ALL SELECT image_id, dst, src FROM g4),
reach(image_id, v, t) AS (SELECT image_id, pix, pix FROM px WHERE mask >= 0.5 UNION SELECT r.image_id, r.v, m.dst FROM reach r JOIN m ON m.image_id = r.image_id AND m.src = r.t),
cc AS (SELECT image_id, v, min(t) AS root FROM reach GROUP BY ALL)"""
_RAG = f"""{_IDX}, g AS (SELECT a.image_id, least(a.seg_idx, b.seg_idx) AS src, greatest(a.seg_idx, b.seg_idx) AS dst
  FROM seg a, (VALUES (1, 0), (0, 1)) o(dr, dc), seg b WHERE b.image_id = a.image_id AND b.r = a.r + o.dr AND b.c = a.c + o.dc
  AND a.mask >= 0.5 AND b.mask >= 0.5 AND a.seg_idx <> b.seg_idx)"""


# --- recognition ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_NN} SELECT * FROM nn")
def loocv_1nn(spark, d):
    return C.leave_one_out(vectors(spark, d))


@query(f"WITH {_NN} SELECT count(*) AS n, round(avg(CAST(predicted = label AS DOUBLE)), 6) AS rate FROM nn")
def recognition_rate(spark, d):
    return rounded(C.recognition_rate(C.leave_one_out(vectors(spark, d))), "rate")


@query(f"""WITH {_NN}, l AS (SELECT label AS x FROM nn UNION SELECT predicted FROM nn)
SELECT a.x AS expected, b.x AS actual, count(nn.id) AS n FROM l a CROSS JOIN l b LEFT JOIN nn ON nn.label = a.x AND nn.predicted = b.x GROUP BY ALL""")
def confusion_matrix(spark, d):
    return C.confusion_matrix(C.leave_one_out(vectors(spark, d)))


@query(f"WITH {_NN} SELECT id, label, predicted, neighbour FROM nn WHERE label <> predicted")
def misclassified(spark, d):
    return C.misclassified(C.leave_one_out(vectors(spark, d)))


@query(f"""WITH {_S}, {_P}, t AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS n FROM p QUALIFY n <= 5),
v AS (SELECT i, li, lj, count(*) AS c FROM t GROUP BY ALL), w AS (SELECT i, li, lj FROM v QUALIFY row_number() OVER (PARTITION BY i ORDER BY c DESC, lj) = 1)
SELECT w.i AS id, w.li AS label, w.lj AS predicted, t.j AS neighbour FROM w JOIN t ON t.i = w.i AND t.n = 1""")
def knn_classifier(spark, d):
    return C.knn_predict(vectors(spark, d), vectors(spark, d), 5, leave_one_out=True)


# --- graphs over samples -------------------------------------------------------------------------------------------------


@query(f"WITH {_TOP} SELECT least(i, j) AS src, greatest(i, j) AS dst, round(max(s), 6) AS w FROM top WHERE n <= 5 GROUP BY ALL")
def knn_graph(spark, d):
    return rounded(G.knn_graph(_near(spark, d, 5), 5), "w")


@query(f"WITH {_TOP} SELECT a.i AS src, a.j AS dst, round(a.s, 6) AS w FROM top a JOIN top b ON a.i = b.j AND a.j = b.i WHERE a.n <= 5 AND b.n <= 5 AND a.i < a.j")
def mutual_knn_graph(spark, d):
    return rounded(G.mutual_knn_graph(_near(spark, d, 5), 5), "w")


@query(f"WITH {_TOP} SELECT i, array_to_string(list(j ORDER BY n), ',') AS neighbours FROM top WHERE n <= 5 GROUP BY i")
def knn_lists(spark, d):
    return G.knn_lists(_near(spark, d, 5), 5).withColumn("neighbours", F.array_join("neighbours", ","))


@query(f"WITH {_S}, {_P} SELECT i AS src, j AS dst, 1.0::DOUBLE AS w FROM p WHERE i < j AND d <= 1.1")
def eps_graph(spark, d):
    return G.epsilon_graph(vectors(spark, d).select("id", "x"), 1.1)


@query(f"WITH {_S}, {_P} SELECT i AS src, j AS dst, round(d, 6) AS w FROM p WHERE i < j")
def complete_graph(spark, d):
    return G.complete_graph(vectors(spark, d).select("id", "x"), np.sqrt, digits=6)


@query(f"""WITH {_S}, {_P}, t AS (SELECT i, j, exp(-d * d) AS s, row_number() OVER (PARTITION BY i ORDER BY exp(-d * d) DESC, j) AS n FROM p WHERE li < 5 AND lj < 5)
SELECT least(i, j) AS src, greatest(i, j) AS dst, round(max(s), 6) AS w FROM t WHERE n <= 5 GROUP BY ALL""")
def masked_knn_graph(spark, d):
    v = vectors(spark, d)
    m = G.masked(v, v.where("label < 5")).select("id", "x")
    return rounded(G.knn_graph(N.nearest_similarities(m, 5), 5), "w")


@query(f"WITH {_SIM} SELECT i, j, round(s, 6) AS s FROM sim WHERE i < j")
def gaussian_similarity(spark, d):
    return C.gaussian_similarity(vectors(spark, d).select("id", "x"), 1.0, digits=6)


@query(f"WITH {_S}, {_P} SELECT i, j, round(exp(-d * d) * CASE WHEN li = lj THEN 10 ELSE 0.1 END, 6) AS s FROM p WHERE i < j")
def modulated_similarity(spark, d):
    return N.modulated_gaussian(vectors(spark, d), 1.0, digits=6)


@query(f"WITH {_S}, {_P} SELECT round(avg(d * d) - avg(d) * avg(d), 6) AS variance, count(*) AS n FROM p WHERE i < j")
def distance_variance(spark, d):
    return rounded(C.distance_variance(vectors(spark, d).select("id", "x")), "variance")


@query(f"WITH {_SIM} SELECT i, j, round(CASE WHEN sum(s) OVER (PARTITION BY i) < 1e-4 THEN 0 ELSE s / sum(s) OVER (PARTITION BY i) END, 6) AS s FROM sim")
def row_normalized_similarity(spark, d):
    return N.row_normalized_gaussian(vectors(spark, d), 1.0, digits=6)


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey % 50 AS s FROM lineitem), e AS (SELECT a.s AS src, b.s AS dst, count(*)::DOUBLE AS w FROM l a JOIN l b ON a.o = b.o AND a.s < b.s GROUP BY ALL),
m AS (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e) SELECT src AS v, sum(w) AS degree FROM m GROUP BY src""")
def copurchase_degree(spark, d):
    """Degrees of a graph of supplier classes that share orders."""
    li = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_suppkey") % 50).alias("s")).distinct()
    e = li.select("o", F.col("s").alias("src")).join(li.select("o", F.col("s").alias("dst")), "o").where("src < dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    return G.degrees(e)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 1000000 + o_orderkey % 700 AS b FROM orders), m AS (SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e),
cc(v, root) USING KEY (v) AS (SELECT src, min(src) FROM m GROUP BY src UNION
  SELECT m.dst, min(c.root) FROM cc c JOIN m ON m.src = c.v JOIN recurring.cc r ON r.v = m.dst WHERE c.root < r.root GROUP BY m.dst) SELECT v, root FROM cc""")
def order_components(spark, d):
    """One graph over all customers and classes of their orders, by rounds of joins."""
    from lattica.plans.stored import components

    o = _table(spark, d, "orders")
    e = o.select(F.lit(0).alias("graph"), F.col("o_custkey").alias("src"), (1_000_000 + F.col("o_orderkey") % 700).alias("dst")).distinct()
    return components(e, ["graph"]).select("v", "root")


@query("""WITH RECURSIVE n AS (SELECT DISTINCT n_regionkey + 100 AS a, n_nationkey AS b FROM nation), e AS (SELECT a AS src, b AS dst FROM n UNION ALL SELECT b, a FROM n),
r(v, depth) AS (SELECT 0, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.v WHERE r.depth < 6) SELECT v, min(depth) AS depth, row_number() OVER (ORDER BY min(depth), v) - 1 AS position FROM r GROUP BY v""")
def bfs_order(spark, d):
    """Nations and regions from nation 0 on; one parent has all of a level, and its edges are in order of the other end."""
    n = _table(spark, d, "nation").select((F.col("n_regionkey") + 100).alias("src"), F.col("n_nationkey").alias("dst"))
    e = G.mirrored(n).withColumn("edge_no", F.col("src") * 1000 + F.col("dst"))
    return G.breadth_first(e, 0).select(F.col("v").cast("int").alias("v"), "depth", "position")


# --- images ----------------------------------------------------------------------------------------------------------------


def _weight(a, b):
    return V.absolute_difference(a[0], b[0])


@query(f"WITH {_G4} SELECT image_id, edge_no, src, dst, round(w, 6) AS w FROM g4")
def grid_graph_4(spark, d):
    return rounded(G.grid_graph(vector_images(spark, d), 4, _weight), "w")


@query(f"WITH {_PX}, {_grid_sql(8)} SELECT image_id, edge_no, src, dst, round(w, 6) AS w FROM g8")
def grid_graph_8(spark, d):
    return rounded(G.grid_graph(vector_images(spark, d), 8, _weight), "w")


@query(f"WITH {_M4} SELECT image_id, v, round(degree, 6) AS degree FROM deg")
def degree(spark, d):
    return rounded(G.degrees(G.grid_graph(vector_images(spark, d), 4, _weight), ["image_id"]), "degree")


@query(f"WITH {_M4} SELECT image_id, src AS i, dst AS j, round(-w, 6) + 0.0 AS v FROM m UNION ALL SELECT image_id, v, v, round(degree, 6) FROM deg")
def laplacian_coo(spark, d):
    return rounded(G.laplacian(G.grid_graph(vector_images(spark, d), 4, _weight), ["image_id"]), "v")


@query(f"""WITH {_M4} SELECT m.image_id, src AS i, dst AS j, round(-w / sqrt(a.degree * b.degree), 6) + 0.0 AS v FROM m
JOIN deg a ON a.image_id = m.image_id AND a.v = src JOIN deg b ON b.image_id = m.image_id AND b.v = dst UNION ALL SELECT image_id, v, v, 1.0 FROM deg""")
def normalized_laplacian_coo(spark, d):
    return rounded(G.normalized_laplacian(G.grid_graph(vector_images(spark, d), 4, _weight), ["image_id"]), "v")


def _components(spark, d):
    px = vector_images(spark, d)
    return G.image_components(px.where("mask >= 0.5").select("image_id", F.col("pix").cast("long").alias("v")), G.grid_graph(px, 4))


@query(f"WITH RECURSIVE {_CC} SELECT image_id, v, root FROM cc")
def components(spark, d):
    return _components(spark, d)


@query(f"WITH RECURSIVE {_CC}, n AS (SELECT image_id, root, count(*) AS size FROM cc GROUP BY ALL) SELECT image_id, v, cc.root, size FROM cc JOIN n USING (image_id, root)")
def component_size(spark, d):
    return S.component_sizes(_components(spark, d))


@query(f"""WITH RECURSIVE {_CC}, k AS (SELECT image_id, root, count(*) AS size FROM cc GROUP BY ALL), n AS (SELECT image_id, root FROM k QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY size DESC, root) = 1)
SELECT px.image_id, px.r, px.c, CASE WHEN n.root IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS mask FROM px LEFT JOIN cc ON cc.image_id = px.image_id AND cc.v = px.pix LEFT JOIN n ON n.image_id = cc.image_id AND n.root = cc.root""")
def largest_component(spark, d):
    return P.largest_component(vector_images(spark, d)).select("image_id", "r", "c", "mask")


@query(f"WITH {_IDX} SELECT image_id, pix, root, seg_idx FROM seg")
def root_index(spark, d):
    return _segments(vector_images(spark, d)).select("image_id", "pix", "root", "seg_idx")


@query(f"WITH {_IDX} SELECT image_id, count(*) AS elements, count(DISTINCT root) AS components FROM seg GROUP BY image_id")
def partition_counts(spark, d):
    return S.partition_counts(_segments(vector_images(spark, d)))


@query(f"WITH {_IDX} SELECT image_id, seg_idx, '{{' || string_agg(pix, ', ' ORDER BY pix) || '}}' AS members FROM seg GROUP BY ALL")
def segment_lists(spark, d):
    return S.segment_lists(_segments(vector_images(spark, d)))


@query(f"WITH {_IDX}, n AS (SELECT count(DISTINCT seg_idx) AS n FROM seg GROUP BY image_id) SELECT min(n) AS least, max(n) AS most FROM n")
def segment_extremes(spark, d):
    return S.segment_extremes(_segments(vector_images(spark, d)))


_HUE = """(SELECT CASE WHEN dl = 0 THEN 0 WHEN mx = red THEN (60 * (g - b) / dl + CASE WHEN g < b THEN 360 ELSE 0 END) WHEN mx = g THEN 120 + 60 * (b - red) / dl ELSE 240 + 60 * (red - g) / dl END
  FROM (SELECT greatest(b, g, red) AS mx, greatest(b, g, red) - least(b, g, red) AS dl))"""
_ATT = f"""SELECT image_id, seg_idx, count(*) AS area, round(sum(b * mask) / count(*), 6) AS b, round(sum(g * mask) / count(*), 6) AS g, round(sum(red * mask) / count(*), 6) AS red,
  round(sum(r * mask) / count(*) / 8, 6) AS row_center, round(sum(c * mask) / count(*) / 8, 6) AS col_center, round(avg(r), 6) AS row_all, round(avg(c), 6) AS col_all, round(sum({_HUE} * mask) / count(*), 6) AS hue FROM seg GROUP BY ALL"""


@query(f"WITH {_IDX} {_ATT}")
def segment_attributes(spark, d):
    px = vector_images(spark, d)
    a = S.segment_attributes(px.drop("pix", "label"), _segments(px), BGR)
    names = {"b": "color[0]", "g": "color[1]", "red": "color[2]", "row_center": "center[0]", "col_center": "center[1]", "row_all": "center_all[0]", "col_all": "center_all[1]", "hue": "hue"}
    return a.select("image_id", "seg_idx", "area", *(F.round(F.expr(e), 6).alias(n) for n, e in names.items()))


@query(f"""WITH {_IDX}, k AS (SELECT image_id, seg_idx, count(*) AS n, sum(r) AS sr, sum(c) AS sc, sum(r * r) AS srr, sum(c * c) AS scc, sum(r * c) AS src FROM seg GROUP BY ALL),
t AS (SELECT image_id, seg_idx, (n * srr - sr * sr) / n AS rr, (n * scc - sc * sc) / n AS cc, (n * src - sr * sc) / n AS rc FROM k),
u AS (SELECT *, (rr + cc) / 2 AS m, sqrt(((rr - cc) / 2) ** 2 + rc ** 2) AS h FROM t)
SELECT image_id, seg_idx, round(2 * sqrt(greatest(0, m + h)) / sqrt(128), 4) AS major, round(2 * sqrt(greatest(0, m - h)) / sqrt(128), 4) AS minor, round(abs(atan2(2 * rc, rr - cc) / 2), 4) AS angle FROM u""")
def segment_ellipse(spark, d):
    px = vector_images(spark, d)
    return rounded(S.segment_ellipses(px.drop("pix"), _segments(px)), "major", "minor", "angle", digits=4)


@query(f"WITH {_RAG} SELECT DISTINCT image_id, src, dst, 1.0::DOUBLE AS w FROM g")
def region_adjacency(spark, d):
    px = vector_images(spark, d)
    return G.region_adjacency(G.grid_graph(px, 4), _segments(px))


@query(f"WITH {_RAG}, n AS (SELECT image_id, src, dst, count(*) AS n FROM g GROUP BY ALL) SELECT * FROM n UNION ALL SELECT image_id, dst, src, n FROM n")
def border_length(spark, d):
    px = vector_images(spark, d)
    return G.border_lengths(G.grid_graph(px, 4), _segments(px))


@query(f"""WITH {_RAG}, v AS (SELECT DISTINCT image_id, seg_idx AS v FROM seg) SELECT DISTINCT image_id, src, dst, 1.0::DOUBLE AS w FROM g
UNION ALL SELECT image_id, v, max(v) OVER (PARTITION BY image_id) + 1, 1.0 FROM v""")
def ground_graph(spark, d):
    px = vector_images(spark, d)
    seg = _segments(px)
    return G.ground(G.region_adjacency(G.grid_graph(px, 4), seg), seg.select("image_id", F.col("seg_idx").alias("v")).distinct())


@query(f"""WITH {_G4}, t AS (SELECT image_id, src AS v FROM g4 UNION SELECT image_id, dst FROM g4), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS new FROM t)
SELECT px.image_id, px.pix AS v, n.new FROM px LEFT JOIN n ON n.image_id = px.image_id AND n.v = px.pix""")
def remove_isolated(spark, d):
    px = vector_images(spark, d)
    return G.remove_isolated(px.select("image_id", F.col("pix").alias("v")), G.grid_graph(px, 4), ["image_id"])


@query(f"""WITH RECURSIVE {_IDX}, s2 AS (SELECT image_id, pix, r, c, root, min(pix) OVER (PARTITION BY image_id, floor(g * 4)) AS root2 FROM seg),
e AS (SELECT a.image_id, a.pix AS src, b.pix AS dst FROM s2 a JOIN s2 b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.root = b.root AND a.root2 = b.root2),
reach(image_id, v, t) AS (SELECT image_id, pix, pix FROM px UNION SELECT r.image_id, r.v, e.dst FROM reach r JOIN e ON e.image_id = r.image_id AND e.src = r.t)
SELECT image_id, v, min(t) AS root FROM reach GROUP BY ALL""")
def combine_segmentations(spark, d):
    px = vector_images(spark, d)
    one = _segments(px).select("image_id", F.col("pix").alias("v"), "root")
    two = px.select("image_id", F.col("pix").alias("v"), F.min("pix").over(Window.partitionBy("image_id", F.floor(F.col("g") * 4))).alias("root"))
    return G.combine_segmentations(G.grid_graph(px.withColumn("mask", F.lit(1.0)), 4), [one, two])


@query(f"""WITH {_PX}, q AS (SELECT *, floor(v * 4) AS k FROM px)
SELECT image_id, pix, CASE WHEN mask > 0 THEN min(pix) OVER (PARTITION BY image_id, mask > 0, k) ELSE 64 END AS root FROM q""")
def color_segmentation(spark, d):
    return S.color_segmentation(vector_images(spark, d).drop("pix").withColumn("k", F.floor(F.col("v") * 4)), ["k"])


@query(f"""WITH RECURSIVE {_IDX}, a AS ({_ATT}), h AS (SELECT image_id, seg_idx, hue FROM a WHERE seg_idx > 0),
p AS (SELECT x.image_id, x.seg_idx AS src, y.seg_idx AS dst, row_number() OVER (PARTITION BY x.image_id ORDER BY round(abs(x.hue - y.hue), 5), x.seg_idx, y.seg_idx) AS k, count(*) OVER (PARTITION BY x.image_id) AS n
  FROM h x JOIN h y ON x.image_id = y.image_id AND x.seg_idx < y.seg_idx),
e0 AS (SELECT image_id, src, dst FROM p WHERE k <= n // 10), e AS (SELECT * FROM e0 UNION ALL SELECT image_id, dst, src FROM e0),
reach(image_id, v, t) AS (SELECT DISTINCT image_id, seg_idx, seg_idx FROM seg UNION SELECT r.image_id, r.v, e.dst FROM reach r JOIN e ON e.image_id = r.image_id AND e.src = r.t)
SELECT image_id, v AS seg_idx, min(t) AS root FROM reach GROUP BY ALL""")
def fuse_by_hue(spark, d):
    px = vector_images(spark, d)
    seg = _segments(px)
    a = S.segment_attributes(px.drop("pix", "label"), seg, BGR).select("image_id", "seg_idx", F.round("hue", 6).alias("hue"))
    return S.fuse_by_hue(seg, a)


# --- pixels ------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_PX}, o AS (SELECT q, dr, dc FROM (VALUES (0, -2, 0, -2, 0), (1, 0, 2, -2, 0), (2, -2, 0, 0, 2), (3, 0, 2, 0, 2)) k(q, r0, r1, c0, c1), range(-2, 2) a(dr), range(-2, 2) b(dc) WHERE dr >= r0 AND dr < r1 AND dc >= c0 AND dc < c1),
n AS (SELECT p.image_id, p.r, p.c, o.q, w.b, w.g, w.red FROM px p, o, px w WHERE w.image_id = p.image_id AND w.r = p.r + o.dr AND w.c = p.c + o.dc
  AND CASE WHEN q % 2 = 0 THEN p.r >= 2 ELSE p.r + 2 < 8 END AND CASE WHEN q // 2 = 0 THEN p.c >= 2 ELSE p.c + 2 < 8 END),
m AS (SELECT image_id, r, c, q, avg(b) AS mb, avg(g) AS mg, avg(red) AS mr FROM n GROUP BY ALL),
t AS (SELECT m.*, avg(sqrt((b - mb) ** 2 + (g - mg) ** 2 + (red - mr) ** 2)) AS dev FROM n JOIN m USING (image_id, r, c, q) GROUP BY ALL),
k AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY image_id, r, c ORDER BY round(dev, 9), q) = 1)
SELECT px.image_id, px.r, px.c, round(coalesce(mb, b), 6) AS b, round(coalesce(mg, g), 6) AS g, round(coalesce(mr, red), 6) AS red FROM px LEFT JOIN k USING (image_id, r, c)""")
def kuwahara(spark, d):
    return rounded(P.kuwahara(vector_images(spark, d), 2).select("image_id", "r", "c", *BGR), *BGR)


_LIN = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
_LAB = f"""{_PX}, lin AS (SELECT *, {_LIN.format("red")} AS lr, {_LIN.format("g")} AS lg, {_LIN.format("b")} AS lb FROM px),
xyz AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456 AS x, 0.212671 * lr + 0.715160 * lg + 0.072169 * lb AS y, (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754 AS z FROM lin),
f AS (SELECT *, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16 / 116 END AS fx, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16 / 116 END AS fy, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16 / 116 END AS fz FROM xyz),
lab AS (SELECT *, CASE WHEN y > 0.008856 THEN 116 * cbrt(y) - 16 ELSE 903.3 * y END AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM f)"""


@query(f"WITH {_LAB} SELECT image_id, pix, round(l, 5) + 0.0 AS l, round(a, 5) + 0.0 AS a, round(bb, 5) + 0.0 AS bb FROM lab")
def rgb_to_lab(spark, d):
    return rounded(P.to_lab(vector_images(spark, d), 1.0).select("image_id", "pix", "l", "a", "bb"), "l", "a", "bb", digits=5)


@query(f"WITH {_PX} SELECT image_id, pix, round({_HUE}, 5) AS h, round(CASE WHEN greatest(b, g, red) = 0 THEN 0 ELSE (greatest(b, g, red) - least(b, g, red)) / greatest(b, g, red) END, 5) AS s, round(greatest(b, g, red), 5) AS v FROM px")
def rgb_to_hsv(spark, d):
    h = color.rgb_to_hsv(F.col("red"), F.col("g"), F.col("b"))
    return rounded(vector_images(spark, d).select("image_id", "pix", *(x.alias(n) for x, n in zip(h, "hsv", strict=True))), "h", "s", "v", digits=5)


@query(f"WITH {_PX} SELECT image_id, count(*) AS n, true AS same FROM px GROUP BY image_id")
def lab_round_trip(spark, d):
    """Channels to Lab and back are the channels, to a thousandth, for every pixel of every image."""
    lab = P.to_lab(vector_images(spark, d), 1.0)
    back = color.lab_to_rgb(F.col("l"), F.col("a"), F.col("bb"))
    gap = F.greatest(*(F.abs(x - F.col(n)) for x, n in zip(back, ("red", "g", "b"), strict=True)))
    return lab.groupBy("image_id").agg(F.count("*").alias("n"), (F.max(gap) < 0.001).alias("same"))


_BIN = "least(4, floor({0} * 5))::INTEGER"
_HIST = f"{_PX}, h AS (SELECT image_id, {_BIN.format('b')} AS b0, {_BIN.format('g')} AS b1, {_BIN.format('red')} AS b2, count(*) AS n FROM px WHERE mask > 0 GROUP BY ALL)"


@query(f"WITH {_HIST}, e AS (SELECT image_id, (k // 25)::INTEGER AS b0, (k // 5 % 5)::INTEGER AS b1, (k % 5)::INTEGER AS b2 FROM (SELECT DISTINCT image_id FROM h), range(125) r(k)) SELECT e.*, coalesce(h.n, 0) AS n FROM e LEFT JOIN h USING (image_id, b0, b1, b2)")
def color_histogram(spark, d):
    return S.full_histogram(S.color_histogram(vector_images(spark, d), BGR, 5, UNIT), 5)


@query(f"WITH {_HIST} SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY n, b0, b1, b2) - 1 AS place, n, round(b0 / 5, 6) AS p0, round(b1 / 5, 6) AS p1, round(b2 / 5, 6) AS p2 FROM h")
def palette(spark, d):
    return rounded(S.palette(S.color_histogram(vector_images(spark, d), BGR, 5, UNIT), 5, UNIT), "p0", "p1", "p2")


@query(f"WITH {_PX} SELECT image_id, pix, round(CASE WHEN mask > 0 THEN {_BIN.format('b')} / 10 ELSE b END, 6) AS b, round(CASE WHEN mask > 0 THEN {_BIN.format('g')} / 10 ELSE g END, 6) AS g, round(CASE WHEN mask > 0 THEN {_BIN.format('red')} / 10 ELSE red END, 6) AS red FROM px")
def palette_rewrite(spark, d):
    k = spark.range(125)
    colors = k.select(F.floor(F.col("id") / 25).cast("int").alias("b0"), F.floor(F.col("id") / 5 % 5).cast("int").alias("b1"), (F.col("id") % 5).cast("int").alias("b2"))
    colors = colors.select("*", *((F.col(f"b{i}") / 10).alias(f"c{i}") for i in range(3)))
    return rounded(S.palette_rewrite(vector_images(spark, d), BGR, colors, 5, UNIT).select("image_id", "pix", *BGR), *BGR)


@query(f"WITH {_PX}, c AS (SELECT image_id, unnest(['b', 'g', 'red']) AS channel, unnest([b, g, red]) AS x FROM px WHERE mask > 0) SELECT image_id, channel, least(9, floor(x * 10))::INTEGER AS bin, count(*) AS n FROM c GROUP BY ALL")
def channel_histogram(spark, d):
    return P.channel_histograms(vector_images(spark, d), 10)


@query(f"WITH {_PX}, k AS (SELECT *, min(r) FILTER (WHERE mask > 0) OVER w AS r0, max(r) FILTER (WHERE mask > 0) OVER w AS r1, min(c) FILTER (WHERE mask > 0) OVER w AS c0, max(c) FILTER (WHERE mask > 0) OVER w AS c1 FROM px WINDOW w AS (PARTITION BY image_id)) SELECT image_id, r - r0 AS r, c - c0 AS c, r1 - r0 + 1 AS height, c1 - c0 + 1 AS width FROM k WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
def crop(spark, d):
    return P.crop(vector_images(spark, d)).select("image_id", "r", "c", "height", "width")


@query(f"WITH {_PX} SELECT image_id, pix, round(CASE WHEN mask > 0 THEN cume_dist() OVER (PARTITION BY image_id, mask > 0 ORDER BY v) ELSE v END, 6) AS v FROM px")
def equalize(spark, d):
    return rounded(P.equalize(vector_images(spark, d), "v", 0.0, 1.0).select("image_id", "pix", "v"), "v")


@query(f"WITH {_PX} SELECT image_id, sum(mask)::BIGINT AS n FROM px GROUP BY image_id")
def foreground_count(spark, d):
    return P.foreground_count(vector_images(spark, d))


@query(f"WITH {_PX} SELECT image_id, pix, round(c / 8, 6) AS x, round(r / 8, 6) AS y, round(b / 500, 6) AS h FROM px WHERE mask > 0")
def pixel_features(spark, d):
    return G.pixel_features(vector_images(spark, d)).select("image_id", "pix", *(F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate("xyh")))


@query(f"WITH {_PX} SELECT image_id, pix, pix AS row_major, c * 8 + r AS column_major, (greatest(r, c) * (greatest(r, c) + 1)) // 2 + least(r, c) AS packed FROM px")
def addresses(spark, d):
    r, c = F.col("r"), F.col("c")
    return vector_images(spark, d).select("image_id", "pix", V.row_major(F.col("width"), r, c).alias("row_major"), V.column_major(F.col("height"), r, c).alias("column_major"), V.upper_triangular_packed(F.least(r, c), F.greatest(r, c)).alias("packed"))


@query(f"WITH {_PX} SELECT image_id, r AS i, string_agg(CAST(pix AS VARCHAR), ', ' ORDER BY c) AS line FROM px GROUP BY ALL")
def matrix_lines(spark, d):
    from lattica.sources.tables import matrix_lines as lines

    px = vector_images(spark, d).select((F.col("image_id") * 8 + F.col("r")).alias("i"), F.col("c").alias("j"), F.col("pix").alias("v"))
    return lines(px).select(F.floor(F.col("i") / 8).alias("image_id"), (F.col("i") % 8).alias("i"), "line")


# --- rows in order ---------------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS x, round(min(value), 6) AS low, round(avg(value), 6) AS mean, round(max(value), 6) AS high, count(*) AS n FROM b GROUP BY user_id, run""")
def run_length_stats(spark, d):
    return rounded(S.run_length_stats(_table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "value"), "low", "mean", "high")


@query("SELECT event_id, event_id // 15 AS block FROM events")
def block_labels(spark, d):
    return S.block_labels(_table(spark, d, "events"), "event_id", 15).select("event_id", "block")


# --- more of images and graphs ---------------------------------------------------------------------------------------------


@query(f"""WITH {_PX}, n AS (SELECT image_id, least(1, sqrt(20.0::DOUBLE / greatest(sum(mask), 1))) AS s FROM px GROUP BY image_id),
q AS (SELECT image_id, floor(r * s)::INTEGER AS r, floor(c * s)::INTEGER AS c, max(ceil(height * s))::INTEGER AS height, max(ceil(width * s))::INTEGER AS width, avg(b) AS b, avg(g) AS g, avg(red) AS red, avg(mask) AS m
  FROM (SELECT *, 8 AS height, 8 AS width FROM px) JOIN n USING (image_id) GROUP BY ALL)
SELECT image_id, r, c, max(height) AS height, max(width) AS width, round(avg(b), 6) AS b, round(avg(g), 6) AS g, round(avg(red), 6) AS red, CASE WHEN avg(m) >= 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS mask FROM q GROUP BY image_id, r, c""")
def resize(spark, d):
    return rounded(P.resize(vector_images(spark, d), 20).select("image_id", "r", "c", "height", "width", *BGR, "mask"), *BGR)


@query()
def preprocess(spark, d):
    """Images of at most 20 kept pixels, their largest parts, smoothed, in Lab."""
    px = vector_images(spark, d)
    return P.preprocess(px.drop("pix", "v", "label"), 2, 20, 1.0)


@query(f"WITH {_PX}, m AS (SELECT *, floor(b * 255) AS m FROM px) SELECT image_id, pix, CASE WHEN m > 128 THEN 0.0 ELSE 1.0 END::DOUBLE AS hard, round(1 - m / 255, 9) AS soft, (255 - m)::BIGINT AS alpha FROM m")
def masks(spark, d):
    m = F.floor(F.col("b") * 255)
    return vector_images(spark, d).select("image_id", "pix", V.hard_mask(m).alias("hard"), F.round(V.soft_mask(m), 9).alias("soft"), V.alpha_mask(m).cast("long").alias("alpha"))


@query(f"WITH {_PX} SELECT image_id, pix, pix // 8 AS r, pix % 8 AS c FROM px")
def places(spark, d):
    at = V.from_row_major(F.col("width"), F.col("pix"))
    return vector_images(spark, d).select("image_id", "pix", at["r"].alias("r"), at["c"].alias("c"))


@query(f"""WITH {_PX} SELECT image_id, {", ".join(f"count(*) FILTER (WHERE b {sign}) AS {name}" for name, sign in (("at_least_half", ">= 0.5"), ("above_zero", "> 0"), ("above_half", "> 0.5"), ("not_above_zero", "<= 0"), ("below_half", "< 0.5"), ("not_zero", "<> 0")))} FROM px GROUP BY image_id""")
def mask_predicates(spark, d):
    return vector_images(spark, d).groupBy("image_id").agg(*(F.count_if(P.kept(F.col("b"), n)).alias(n) for n in P.PREDICATES))


@query(f"WITH {_PX}, w AS (SELECT *, min(b) OVER w AS b0, max(b) OVER w AS b1, min(g) OVER w AS g0, max(g) OVER w AS g1, min(red) OVER w AS r0, max(red) OVER w AS r1 FROM px WINDOW w AS (PARTITION BY image_id)) SELECT image_id, pix, round((b - b0) / (b1 - b0), 6) AS b, round((g - g0) / (g1 - g0), 6) AS g, round((red - r0) / (r1 - r0), 6) AS red FROM w")
def rescale_channels(spark, d):
    return rounded(P.rescale_channels(vector_images(spark, d)).select("image_id", "pix", *BGR), *BGR)


@query(f"WITH {_PX}, h AS (SELECT *, {_HUE} AS hue FROM px) SELECT image_id, pix, round(CASE WHEN mask > 0 THEN 360 * cume_dist() OVER (PARTITION BY image_id, mask > 0 ORDER BY hue) ELSE hue END, 5) AS hue FROM h")
def equalize_hue(spark, d):
    return rounded(P.equalize_hue(vector_images(spark, d)).select("image_id", "pix", "hue"), "hue", digits=5)


@query("SELECT max(label) AS max_label FROM embeddings")
def max_label(spark, d):
    return C.max_label(vectors(spark, d))


@query(f"WITH {_PX} SELECT image_id, r AS i, c AS j, round(b, 6) AS v FROM px UNION ALL SELECT image_id, r + 8, c, round(g, 6) FROM px")
def stacked_matrices(spark, d):
    px = vector_images(spark, d)
    one, two = (px.select("image_id", F.col("r").alias("i"), F.col("c").alias("j"), F.round(c, 6).alias("v")) for c in ("b", "g"))
    return P.stacked(one, two, ["image_id"])


@query(f"""WITH {_PX}, f AS (SELECT image_id, pix, c / 8 AS x, r / 8 AS y, b / 500 AS h FROM px WHERE mask > 0),
p AS (SELECT a.image_id, a.pix AS i, b.pix AS j, exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.h - b.h) ** 2)) AS s FROM f a JOIN f b ON a.image_id = b.image_id AND a.pix <> b.pix),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image_id, i ORDER BY s DESC, j) <= 4)
SELECT image_id, least(i, j) AS src, greatest(i, j) AS dst, round(max(s), 6) AS w FROM t GROUP BY ALL""")
def pixel_knn_graph(spark, d):
    return rounded(G.pixel_knn_graph(vector_images(spark, d), 4), "w")


_COLOR = "SELECT image_id, seg_idx, sum(mask) AS kept, sum(b * mask) / count(*) AS b, sum(g * mask) / count(*) AS g, sum(red * mask) / count(*) AS red FROM seg GROUP BY ALL"


@query(f"""WITH {_IDX}, a AS ({_COLOR}), f AS (SELECT * FROM a WHERE kept > 0),
p AS (SELECT x.image_id, x.seg_idx AS i, y.seg_idx AS j, exp(-((x.b - y.b) ** 2 + (x.g - y.g) ** 2 + (x.red - y.red) ** 2)) AS s FROM f x JOIN f y ON x.image_id = y.image_id AND x.seg_idx <> y.seg_idx),
t AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY image_id, i ORDER BY s DESC, j) <= 20)
SELECT image_id, least(i, j) AS src, greatest(i, j) AS dst, round(max(s), 6) AS w FROM t GROUP BY ALL""")
def feature_graph(spark, d):
    px = vector_images(spark, d)
    return rounded(G.feature_graph(S.segment_attributes(px.drop("pix", "label"), _segments(px), BGR), "color", 1.0), "w")


@query(f"WITH {_M4} SELECT image_id, src, string_agg(dst || ':' || round(w * 1000)::BIGINT, ' ' ORDER BY dst) AS neighbours FROM m GROUP BY ALL")
def adjacency_lists(spark, d):
    a = G.adjacency(G.grid_graph(vector_images(spark, d), 4, _weight), ["image_id"])
    return a.select("image_id", "src", F.array_join(F.transform("neighbours", lambda x: F.concat_ws(":", x["dst"].cast("string"), F.round(x["w"] * 1000).cast("long").cast("string"))), " ").alias("neighbours"))


@query(f"""WITH RECURSIVE {_CC}, l AS (SELECT *, row_number() OVER (PARTITION BY image_id, root ORDER BY v) - 1 AS n FROM cc)
SELECT g4.image_id, a.root, a.n AS src, b.n AS dst, round(w, 6) AS w FROM g4 JOIN l a ON a.image_id = g4.image_id AND a.v = src JOIN l b ON b.image_id = g4.image_id AND b.v = dst""")
def induced_subgraphs(spark, d):
    px = vector_images(spark, d)
    return rounded(G.induced_subgraphs(G.grid_graph(px, 4, _weight), _components(spark, d), ["image_id"]), "w")


@query("SELECT 1000 - n_regionkey - 100 AS src, 1000 - n_nationkey AS dst, 1.0::DOUBLE AS w FROM nation")
def permute_vertices(spark, d):
    n = _table(spark, d, "nation").select((F.col("n_regionkey") + 100).alias("src"), F.col("n_nationkey").alias("dst"), F.lit(1.0).alias("w"))
    order = n.select(F.explode(F.array("src", "dst")).alias("old")).distinct().select("old", (1000 - F.col("old")).alias("new"))
    return G.permute_vertices(n, order)


@query("SELECT n_regionkey + 100 AS src, n_nationkey AS dst, r_name AS src_label, n_name AS dst_label FROM nation JOIN region ON r_regionkey = n_regionkey")
def labelled_edges(spark, d):
    n, r = _table(spark, d, "nation"), _table(spark, d, "region")
    e = n.select((F.col("n_regionkey") + 100).alias("src"), F.col("n_nationkey").alias("dst"))
    labels = n.select(F.col("n_nationkey").alias("v"), F.col("n_name").alias("label")).unionByName(r.select((F.col("r_regionkey") + 100).alias("v"), F.col("r_name").alias("label")))
    return G.relabel(e, labels).select("src", "dst", "src_label", "dst_label")


@query(f"""WITH {_G4}, t AS (SELECT image_id, src AS v FROM g4 UNION SELECT image_id, dst FROM g4), n AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v) - 1 AS new FROM t),
k AS (SELECT px.image_id, px.pix AS v, n.new FROM px LEFT JOIN n ON n.image_id = px.image_id AND n.v = px.pix)
SELECT image_id, v, CASE WHEN new IS NULL THEN min(v) FILTER (WHERE new IS NULL) OVER (PARTITION BY image_id) ELSE 1000 + new // 2 END AS root FROM k""")
def add_isolated(spark, d):
    px = vector_images(spark, d)
    m = G.remove_isolated(px.select("image_id", F.col("pix").alias("v")), G.grid_graph(px, 4), ["image_id"])
    parts = m.where("new IS NOT NULL").select("image_id", "new", (1000 + F.floor(F.col("new") / 2)).alias("root"))
    return G.add_isolated(m, parts, ["image_id"])


_JOINED = f"""{_IDX}, s2 AS (SELECT image_id, pix, r, c, root, min(pix) OVER (PARTITION BY image_id, floor(g * 4)) AS root2 FROM seg),
e AS (SELECT a.image_id, a.pix AS src, b.pix AS dst FROM s2 a JOIN s2 b ON a.image_id = b.image_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND a.root = b.root AND a.root2 = b.root2),
reach(image_id, v, t) AS (SELECT image_id, pix, pix FROM px UNION SELECT r.image_id, r.v, e.dst FROM reach r JOIN e ON e.image_id = r.image_id AND e.src = r.t)"""


@query(f"WITH RECURSIVE {_JOINED} SELECT image_id, v, min(t) AS root FROM reach GROUP BY ALL")
def fuse_partitions(spark, d):
    px = vector_images(spark, d).withColumn("mask", F.lit(1.0))
    sub = _segments(px).select("image_id", F.col("pix").alias("v"), F.col("root").alias("sub"))
    parts = px.select("image_id", F.col("pix").alias("v"), F.floor(F.col("g") * 4).alias("part"))
    return G.fuse_partitions(G.grid_graph(px, 4), sub, parts, ["image_id"])


@query(f"WITH {_PX}, {_grid_sql(8)}, m AS (SELECT image_id, count(*) AS m FROM g8 GROUP BY ALL) SELECT px.image_id, count(*) < 3 OR coalesce(max(m), 0) <= 3 * count(*) - 6 AS maybe_planar FROM px LEFT JOIN m USING (image_id) WHERE mask >= 0.5 GROUP BY px.image_id")
def maybe_planar(spark, d):
    px = vector_images(spark, d)
    return G.is_maybe_planar(px.where("mask >= 0.5").select("image_id", "pix"), G.grid_graph(px, 8), ["image_id"])


@query(f"WITH {_PX} SELECT image_id, pix, pix AS root FROM px")
def singletons(spark, d):
    return S.singletons(vector_images(spark, d))


@query("""WITH RECURSIVE s AS (SELECT s_nationkey AS k, s_suppkey AS v FROM supplier), u AS (SELECT a.k, a.v AS src, b.v AS dst FROM s a JOIN s b ON a.k = b.k AND b.v % 7 = a.v % 7 AND a.v < b.v),
m AS (SELECT k, src, dst FROM u UNION ALL SELECT k, dst, src FROM u), reach(k, v, t) AS (SELECT k, v, v FROM s UNION SELECT r.k, r.v, m.dst FROM reach r JOIN m ON m.k = r.k AND m.src = r.t)
SELECT k, v, min(t) AS root FROM reach GROUP BY ALL""")
def union_pairs(spark, d):
    """Suppliers of a nation, joined where their keys are equal modulo 7."""
    s = _table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("v"))
    a, b = s.select("k", F.col("v").alias("src"), (F.col("v") % 7).alias("m")), s.select("k", F.col("v").alias("dst"), (F.col("v") % 7).alias("m"))
    return S.union_pairs(s, a.join(b, ["k", "m"]).where("src < dst").select("k", "src", "dst"), ["k"])


@query(f"""WITH RECURSIVE {_RAG}, a AS ({_COLOR}), e0 AS (SELECT DISTINCT g.image_id, src, dst FROM g JOIN a x ON x.image_id = g.image_id AND x.seg_idx = src JOIN a y ON y.image_id = g.image_id AND y.seg_idx = dst
  WHERE sqrt((x.b - y.b) ** 2 + (x.g - y.g) ** 2 + (x.red - y.red) ** 2) <= 0.3), e AS (SELECT * FROM e0 UNION ALL SELECT image_id, dst, src FROM e0),
reach(image_id, v, t) AS (SELECT DISTINCT image_id, seg_idx, seg_idx FROM seg UNION SELECT r.image_id, r.v, e.dst FROM reach r JOIN e ON e.image_id = r.image_id AND e.src = r.t)
SELECT image_id, v, min(t) AS root FROM reach GROUP BY ALL""")
def fuse_close(spark, d):
    px = vector_images(spark, d)
    seg = _segments(px)
    labels = S.segment_attributes(px.drop("pix", "label"), seg, BGR).select("image_id", "seg_idx", F.col("color").alias("x"))
    return S.fuse_close(seg, G.region_adjacency(G.grid_graph(px, 4), seg), labels, 0.3)


_BYTES = ", ".join(f"CASE WHEN {{0}} IS NULL THEN 0 ELSE (({{0}} + 1) * 2654435761 // {1 << k}) % 256 END::INTEGER AS {n}" for n, k in (("b", 8), ("g", 16), ("red", 24)))


@query(f"WITH {_IDX} SELECT image_id, pix, {_BYTES.format('seg_idx')} FROM seg")
def region_image(spark, d):
    return S.region_image(_segments(vector_images(spark, d)))


@query(f"WITH {_IDX} SELECT image_id, pix, (seg_idx * 3)::INTEGER AS b, (seg_idx * 5)::INTEGER AS g, (255 - seg_idx)::INTEGER AS red FROM seg")
def palette_image(spark, d):
    colors = spark.range(64).select(F.col("id").cast("int").alias("seg_idx"), (F.col("id") * 3).cast("int").alias("b"), (F.col("id") * 5).cast("int").alias("g"), (255 - F.col("id")).cast("int").alias("red"))
    return S.region_image(_segments(vector_images(spark, d)), colors)


@query(f"WITH {_IDX}, k AS (SELECT image_id, pix, CASE WHEN seg_idx % 2 = 0 THEN seg_idx // 2 END AS match FROM seg) SELECT image_id, pix, {_BYTES.format('match')} FROM k")
def matching_image(spark, d):
    seg = _segments(vector_images(spark, d))
    m = seg.where("seg_idx % 2 = 0").select("image_id", "seg_idx", F.floor(F.col("seg_idx") / 2).alias("match")).distinct()
    return S.matching_image(seg, m)


@query("SELECT c_name || '.png' AS image_name, c_custkey::DOUBLE AS x, trunc(c_acctbal)::DOUBLE AS y FROM customer")
def face_positions(spark, d):
    """Positions written as lines of a file in the shared folder, and read back."""
    import uuid

    path = f"{shared_folder(spark)}/lattica-faces-{uuid.uuid4().hex}"
    write_face_positions(_table(spark, d, "customer").select(F.concat("c_name", F.lit(".png")).alias("image_name"), F.col("c_custkey").alias("x"), F.col("c_acctbal").alias("y")), path)
    return read_face_positions(spark, path)


@query()
def segment_images(spark, d):
    """Every image segmented: grid graph, Felzenszwalb by volume, fusing by hue."""
    return S.segment(vector_images(spark, d), BGR, 0.5, 16)


@query()
def segment_recognition(spark, d):
    """The flagship: images segmented, described, and recognised by matching segments with those of all others."""
    px = vector_images(spark, d)
    seg = S.segment(px, BGR, 0.5, 16).select("image_id", "pix", "seg_idx")
    return C.matching_classifier(S.segment_attributes(px.drop("pix", "label"), seg, BGR), vectors(spark, d).select("id", "label"))


@query()
def manual_segmentation(spark, d):
    return S.manual_segmentation(vector_images(spark, d).drop("pix").withColumn("k", F.floor(F.col("v") * 4)), ["k"], 5)


@query("WITH s AS (SELECT s_suppkey AS i, s_nationkey AS j, s_acctbal AS v FROM supplier) SELECT i, round(sum(v * (j + 1)), 4) AS v FROM s GROUP BY i")
def sparse_product(spark, d):
    m = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").alias("j"), F.col("s_acctbal").alias("v"))
    x = _table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), (F.col("n_nationkey") + 1).alias("v"))
    return rounded(K.sparse_times(m, x), "v", digits=4)


_LAP = f"{_M4}, lap AS (SELECT image_id, src AS i, dst AS j, -w AS v FROM m UNION ALL SELECT image_id, v, v, degree FROM deg)"


@query(f"WITH {_LAP} SELECT image_id, true AS symmetric FROM lap GROUP BY image_id")
def symmetric_matrices(spark, d):
    return G.is_symmetric(G.laplacian(G.grid_graph(vector_images(spark, d), 4, _weight), ["image_id"]), ["image_id"])


@query(f"WITH {_LAP} SELECT image_id, CASE WHEN i > 20 THEN i - 1 ELSE i END AS i, CASE WHEN j > 20 THEN j - 1 ELSE j END AS j, round(v, 6) + 0.0 AS v FROM lap WHERE i <> 20 AND j <> 20")
def matrix_without_line(spark, d):
    return rounded(G.without_line(G.laplacian(G.grid_graph(vector_images(spark, d), 4, _weight), ["image_id"]), F.lit(20)), "v")


@query(f"WITH {_S}, {_P}, z AS (SELECT i, d FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 7) SELECT p.i, p.j, round(exp(-p.d * p.d / (a.d * b.d)), 6) AS s FROM p JOIN z a ON a.i = p.i JOIN z b ON b.i = p.j WHERE p.i < p.j")
def self_tuning_similarity(spark, d):
    return N.self_tuning_similarity(vectors(spark, d), digits=6)


# --- expressions -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_S} SELECT id, " + ", ".join(f"round(list_sum(list_transform(x, lambda v: v ** {k})), 8) + 0.0 AS p{k}" for k in range(1, 9)) + " FROM s")
def power_sums(spark, d):
    p = vectors(spark, d).select("id", V.power_sums(F.col("x")).alias("p"))
    return rounded(p.select("id", *(F.col("p")[k - 1].alias(f"p{k}") for k in range(1, 9))), *(f"p{k}" for k in range(1, 9)), digits=8)


@query(f"""WITH {_S}, v AS (SELECT id, list_sum(x) AS p1, {", ".join(f"list_sum(list_transform(x, lambda v: v ** {k})) AS p{k}" for k in (2, 3, 4))} FROM s),
e AS (SELECT *, (p1 * p1 - p2) / 2 AS a2 FROM v), f AS (SELECT *, (a2 * p1 - p1 * p2 + p3) / 3 AS a3 FROM e)
SELECT id, round(p1, 8) + 0.0 AS e1, round(a2, 8) + 0.0 AS e2, round(a3, 8) + 0.0 AS e3, round((a3 * p1 - a2 * p2 + p1 * p3 - p4) / 4, 8) + 0.0 AS e4 FROM f""")
def elementary_polynomials(spark, d):
    e = vectors(spark, d).select("id", V.elementary_symmetric(F.col("x")).alias("e"))
    return rounded(e.select("id", *(F.col("e")[k].alias(f"e{k + 1}") for k in range(4))), "e1", "e2", "e3", "e4", digits=8)


@query(f"WITH {_S}, v AS (SELECT id, list_transform(x, lambda y: y * y) AS x FROM s) SELECT a.id, round(list_sum(list_transform(list_zip(a.x, b.x), lambda z: CASE WHEN z[1] + z[2] = 0 THEN 0 ELSE (z[1] - z[2]) ** 2 / (z[1] + z[2]) END)), 6) AS k FROM v a JOIN v b ON b.id = a.id + 1")
def chi_squared(spark, d):
    v = vectors(spark, d).select("id", F.transform("x", lambda y: y * y).alias("x"))
    b = v.select((F.col("id") - 1).alias("id"), F.col("x").alias("y"))
    return v.join(b, "id").select("id", F.round(V.chi_squared(F.col("x"), F.col("y")), 6).alias("k"))


_SUP = "t AS (SELECT s_suppkey AS id, (s_acctbal + 1000) / 11000 AS x, (s_suppkey % 11) / 10.0::DOUBLE AS y FROM supplier)"


def _supplier(spark, d):
    return _table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), ((F.col("s_acctbal") + 1000) / 11000).alias("x"), ((F.col("s_suppkey") % 11) / F.lit(10.0)).alias("y"))


@query(f"""WITH {_SUP} SELECT id, round(CASE WHEN x < 0.2 OR x > 0.9 THEN 0 WHEN x < 0.5 THEN (x - 0.2) / 0.3 ELSE (0.9 - x) / 0.4 END, 9) AS triangle,
round(greatest(0, least(1, (x - 0.1) / 0.2, (0.9 - x) / 0.2)), 9) AS trapezoid, CASE WHEN x BETWEEN 0.3 AND 0.6 THEN 1.0 ELSE 0.0 END::DOUBLE AS rectangle, round(greatest(0, least(1, (x - 0.2) / 0.6)), 9) AS ramp,
round(exp(-((x - 0.5) ** 2) / (2 * 0.2 ** 2)), 9) AS gaussian, round(1 / (1 + pow(abs((x - 0.5) / 0.2), 6)), 9) AS bell, round(1 / (1 + exp(-8 * (x - 0.5))), 9) AS sigmoid,
round(CASE WHEN x <= 0.2 THEN 0 WHEN x <= 0.5 THEN 2 * ((x - 0.2) / 0.6) ** 2 WHEN x < 0.8 THEN 1 - 2 * ((x - 0.8) / 0.6) ** 2 ELSE 1 END, 9) AS s_shape,
round(CASE WHEN x <= 0 THEN 0 WHEN x <= 0.5 THEN 2 * x WHEN x <= 1 THEN 1.5 - x ELSE 0.5 END, 9) AS discrete FROM t""")
def fuzzy_terms(spark, d):
    x = F.col("x")
    terms = {"triangle": fuzzy.triangle(0.2, 0.5, 0.9), "trapezoid": fuzzy.trapezoid(0.1, 0.3, 0.7, 0.9), "rectangle": fuzzy.rectangle(0.3, 0.6), "ramp": fuzzy.ramp(0.2, 0.8), "gaussian": fuzzy.gaussian(0.5, 0.2), "bell": fuzzy.bell(0.5, 0.2, 3), "sigmoid": fuzzy.sigmoid(0.5, 8), "s_shape": fuzzy.s_shape(0.2, 0.8), "discrete": fuzzy.discrete([(0, 0), (0.5, 1), (1, 0.5)])}
    return _supplier(spark, d).select("id", *(F.round(t(x), 9).alias(n) for n, t in terms.items()))


_SIG = "1 / (1 + exp(-({1}) * ({0} - {2})))"
_SH = "CASE WHEN {0} <= {1} THEN 0 WHEN {0} <= ({1} + {2}) / 2.0 THEN 2 * (({0} - {1}) / ({2} - {1})) ** 2 WHEN {0} < {2} THEN 1 - 2 * (({0} - {2}) / ({2} - {1})) ** 2 ELSE 1 END"


@query(f"""WITH {_SUP}, u AS (SELECT *, {_SH.format("x", 0.1, 0.4)} AS s1, {_SH.format("x", 0.6, 0.9)} AS s2, {_SIG.format("x", 9.0, 0.3)} AS g1, {_SIG.format("x", 7.0, 0.7)} AS g2, {_SIG.format("x", -7.0, 0.7)} AS g3,
  greatest(0, least(1, (x - 0.8) / -0.6)) AS falling FROM t)
SELECT id, round(1 - s1, 9) AS z_shape, round(s1 * (1 - s2), 9) AS pi_shape, round(abs(g1 - g2), 9) AS sigmoid_difference, round(g1 * g3, 9) AS sigmoid_product, round(falling, 9) AS falling,
round(CASE WHEN x < 0.4 THEN exp(-((x - 0.4) ** 2) / (2 * 0.1 ** 2)) ELSE 1 END * CASE WHEN x > 0.6 THEN exp(-((x - 0.6) ** 2) / (2 * 0.2 ** 2)) ELSE 1 END, 9) AS gaussian_product,
round(least(falling, y), 9) AS thresholded, round(falling * y, 9) AS scaled, round(greatest(least(falling, y), s1), 9) AS accumulated FROM u""")
def fuzzy_more_terms(spark, d):
    x, y = F.col("x"), F.col("y")
    cut = fuzzy.thresholded(fuzzy.ramp(0.8, 0.2), y)
    terms = {"z_shape": fuzzy.z_shape(0.1, 0.4), "pi_shape": fuzzy.pi_shape(0.1, 0.4, 0.6, 0.9), "sigmoid_difference": fuzzy.sigmoid_difference(0.3, 9.0, 7.0, 0.7), "sigmoid_product": fuzzy.sigmoid_product(0.3, 9.0, -7.0, 0.7), "falling": fuzzy.ramp(0.8, 0.2), "gaussian_product": fuzzy.gaussian_product(0.4, 0.1, 0.6, 0.2), "thresholded": cut, "scaled": fuzzy.thresholded(fuzzy.ramp(0.8, 0.2), y, fuzzy.T_NORMS["algebraic_product"]), "accumulated": fuzzy.accumulated([cut, fuzzy.s_shape(0.1, 0.4)])}
    return _supplier(spark, d).select("id", *(F.round(t(x), 9).alias(n) for n, t in terms.items()))


@query(f"""WITH {_SUP} SELECT id, round(least(x, y), 6) AS minimum, round(x * y, 6) AS algebraic_product, round(greatest(0, x + y - 1), 6) AS bounded_difference, round(CASE WHEN greatest(x, y) = 1 THEN least(x, y) ELSE 0 END, 6) AS drastic_product,
round(x * y / (2 - (x + y - x * y)), 6) AS einstein_product, round(CASE WHEN x + y - x * y = 0 THEN 0 ELSE x * y / (x + y - x * y) END, 6) AS hamacher_product, round(greatest(x, y), 6) AS maximum, round(x + y - x * y, 6) AS algebraic_sum,
round(least(1, x + y), 6) AS bounded_sum, round((x + y) / greatest(1, x + y), 6) AS normalized_sum, round(CASE WHEN least(x, y) = 0 THEN greatest(x, y) ELSE 1 END, 6) AS drastic_sum, round((x + y) / (1 + x * y), 6) AS einstein_sum,
round(CASE WHEN x * y = 1 THEN 1 ELSE (x + y - 2 * x * y) / (1 - x * y) END, 6) AS hamacher_sum FROM t""")
def fuzzy_norms(spark, d):
    return _supplier(spark, d).select("id", *(F.round(f(F.col("x"), F.col("y")), 6).alias(n) for n, f in (fuzzy.T_NORMS | fuzzy.S_NORMS).items()))


@query(f"""WITH {_SUP} SELECT id, round(1 - x, 6) AS h_not, round(x * x, 6) AS h_very, round(sqrt(x), 6) AS h_somewhat, round(CASE WHEN x <= 0.5 THEN sqrt(x / 2) ELSE 1 - sqrt((1 - x) / 2) END, 6) AS h_seldom,
round(CASE WHEN x <= 0.5 THEN 2 * x * x ELSE 1 - 2 * (1 - x) ** 2 END, 6) AS h_extremely, 1.0::DOUBLE AS h_any FROM t""")
def fuzzy_hedges(spark, d):
    return _supplier(spark, d).select("id", *(F.round(f(F.col("x")), 6).alias(f"h_{n}") for n, f in fuzzy.HEDGES.items()))


_FAR = _SH.format("{0}", 0.3, 1.0)
_NEARBY = "1 - (" + _SH.format("{0}", 0.0, 0.6) + ")"


@query(f"""WITH {_SUP}, u AS (SELECT id, x, y, abs(x - y) AS z FROM t),
l AS (SELECT id, y, least({_NEARBY.format("x")}, {_NEARBY.format("y")}, {_NEARBY.format("z")}) AS high, greatest({_FAR.format("x")}, {_FAR.format("y")}) AS low1, 0.5 * ({_FAR.format("z")}) ** 2 AS low2 FROM u),
v AS (SELECT id, y, (k + 0.5) / 20 AS v, greatest(least(greatest(0, least(1, ((k + 0.5) / 20 - 0.4) / 0.6)), high), least(greatest(0, least(1, ((k + 0.5) / 20 - 0.6) / -0.6)), low1), least(greatest(0, least(1, ((k + 0.5) / 20 - 0.6) / -0.6)), low2)) AS m FROM l, range(20) r(k)),
c AS (SELECT id, any_value(y) AS y, CASE WHEN sum(m) > 0 THEN sum(v * m) / sum(m) ELSE 0 END AS match FROM v GROUP BY id),
w AS (SELECT id, match, (k + 0.5) / 100 AS v, least(CASE WHEN (k + 0.5) / 100 = 0.5 THEN 1 WHEN (k + 0.5) / 100 < 0.5 THEN (k + 0.5) / 50 ELSE (1 - (k + 0.5) / 100) / 0.5 END, y) AS m FROM c, range(100) r(k)),
g AS (SELECT id, match, v, m, max(m) OVER (PARTITION BY id) AS most FROM w)
SELECT id, round(any_value(match), 6) AS match, round((min(v) + max(v)) / 2, 6) AS middle FROM g WHERE m >= most - 1e-12 GROUP BY id""")
def fuzzy_engine(spark, d):
    t = _supplier(spark, d)
    e = t.select("id", C.segment_similarity(F.col("x"), F.col("y"), F.abs(F.col("x") - F.col("y"))).alias("match"), fuzzy.of_maximum(lambda v: F.least(fuzzy.triangle(0, 0.5, 1)(v), F.col("y")), 0, 1).alias("middle"))
    return rounded(e, "match", "middle")


# --- kernels: held against numpy in tests ------------------------------------------------------------------------------------


@query()
def felzenszwalb(spark, d):
    px = vector_images(spark, d)
    return K.felzenszwalb(px, G.grid_graph(px, 4, V.euclidean, BGR), 0.5, 16)


@query()
def fuse_small(spark, d):
    px = vector_images(spark, d)
    return K.fuse_small(_segments(px).select("image_id", "pix", "root"), G.grid_graph(px, 4), px, 3)


def _label_graphs(spark, d):
    """One nearest-neighbour graph for each label, of all samples of that label."""
    v = vectors(spark, d).select(F.col("label").cast("long").alias("graph"), "id", "x")
    return G.knn_graph(N.nearest_similarities(v, 6, group="graph"), 6, ["graph"])


@query()
def spectral_embedding(spark, d):
    return K.spectral_embedding(_label_graphs(spark, d), 3)


@query()
def spectral_clusters(spark, d):
    return K.spectral_clusters(_label_graphs(spark, d), 3)


@query()
def power_iteration_clusters(spark, d):
    return K.power_iteration_clusters(G.knn_graph(_near(spark, d, 6), 6), 4)


@query()
def lle(spark, d):
    return K.lle_embedding(vectors(spark, d).select(F.col("label").cast("long").alias("grp"), "id", "x"), 8, 2)


@query()
def pattern_vectors(spark, d):
    return K.pattern_vectors(_label_graphs(spark, d), 3, 64)


@query()
def normalized_cuts(spark, d):
    return K.graph_partition(_label_graphs(spark, d), "normalized_cuts", 0.4)


@query()
def isoperimetric_partition(spark, d):
    return K.graph_partition(_label_graphs(spark, d), "isoperimetric", 0.4)


def _matrix_pairs(spark, d):
    """Each vector as a matrix of 16 rows and 4 columns, with that of the next vector; the last has the first."""
    v = vectors(spark, d).withColumn("m", F.array(*(F.slice("x", 1 + 4 * i, 4) for i in range(16))))
    n = v.select("id").withColumn("n", F.row_number().over(Window.orderBy("id")) - 1)
    v, count = v.join(n, "id"), n.agg(F.count("*").alias("count"))
    a, b = v.select("n", "id", F.col("m").alias("a")), v.select("n", F.col("m").alias("b"))
    return a.join(F.broadcast(count)).select("id", "a", ((F.col("n") + 1) % F.col("count")).alias("n")).join(b, "n").select(F.col("id").cast("string").alias("name"), "a", "b")


@query()
def canonical_angles(spark, d):
    return K.matrix_pairs(_matrix_pairs(spark, d), "cosines")


@query()
def procrustes_rotation(spark, d):
    return K.matrix_pairs(_matrix_pairs(spark, d), "procrustes")


@query()
def subspace_distance(spark, d):
    return K.matrix_pairs(_matrix_pairs(spark, d), "distance")


@query(f"WITH {_S} SELECT CAST(id AS VARCHAR) AS name, 4::BIGINT AS shared FROM s")
def subspace_intersection(spark, d):
    """A column space and one that holds it have as many directions in common as the smaller has."""
    m = _matrix_pairs(spark, d).select("name", "a", F.zip_with("a", "b", lambda x, y: F.concat(x, F.slice(y, 1, 2))).alias("b"))
    return K.matrix_pairs(m, "intersection").select("name", (F.size("value") / 16).cast("long").alias("shared"))


@query(f"WITH {_S} SELECT CAST(id AS VARCHAR) AS name, 60::BIGINT AS free FROM s")
def null_space(spark, d):
    """What two matrices of 2 rows and 64 columns both map to 0."""
    m = _matrix_pairs(spark, d)
    rows = lambda c: F.array(F.flatten(c), F.transform(F.flatten(c), lambda x, i: x * (1 + i % 3)))
    return K.matrix_pairs(m.select("name", rows("a").alias("a"), rows("b").alias("b")), "null_space").select("name", (F.size("value") / 64).cast("long").alias("free"))


@query(f"WITH {_S} SELECT id, len(list_filter(x, lambda v: abs(v) > 0.05)) AS n FROM s")
def nonzeros(spark, d):
    return vectors(spark, d).select("id", V.approx_nonzeros(F.col("x"), 0.05).cast("long").alias("n"))


@query()
def matching_classifier(spark, d):
    """The class of the most similar of all other images, by segment matching."""
    px = vector_images(spark, d)
    seg = S.segment_attributes(px.drop("pix", "label"), _segments(px), BGR)
    return C.matching_classifier(seg, vectors(spark, d).select("id", "label"))


@query()
def pattern_classifier(spark, d):
    px = vector_images(spark, d).withColumn("mask", F.lit(1.0))
    g = [G.grid_graph(px, 4, lambda a, b: F.exp(-V.squared_distance(a, b)), [f]).withColumnRenamed("image_id", "graph") for f in ("b", "g")]
    return C.pattern_classifier([K.pattern_vectors(x, 2, 64) for x in g], vectors(spark, d).select("id", "label"))


_NB = """c AS (SELECT id, label, unnest(range(64)) AS k, unnest(x) AS v FROM s), {folds}
m AS (SELECT f, c.label, k, avg(v) AS mu, avg(v * v) - avg(v) * avg(v) AS var FROM c JOIN f ON {inside} GROUP BY ALL),
n0 AS (SELECT f, label, count(*) AS n FROM s JOIN f ON {inside_s} GROUP BY ALL), n AS (SELECT *, sum(n) OVER (PARTITION BY f) AS total FROM n0),
a AS (SELECT f, k, avg(v * v) - avg(v) * avg(v) AS var FROM c JOIN f ON {inside} GROUP BY ALL), e AS (SELECT f, 1e-9 * max(var) AS eps FROM a GROUP BY f),
l0 AS (SELECT c.id, c.label, m.label AS predicted, m.f, ln(2 * pi() * (var + eps)) + (v - mu) ** 2 / (var + eps) AS t FROM c JOIN m ON {outside} AND m.k = c.k JOIN e ON e.f = m.f),
l AS (SELECT id, label, predicted, f, -0.5 * sum(t) AS s FROM l0 GROUP BY ALL),
q AS (SELECT l.*, l.s + ln(n.n / n.total) AS score FROM l JOIN n ON n.f = l.f AND n.label = l.predicted)
SELECT id, label, predicted FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, predicted) = 1"""


@query(f"WITH {_S}, " + _NB.format(folds="f AS (SELECT 0 AS f),", inside="true", inside_s="true", outside="true"))
def naive_bayes(spark, d):
    v = vectors(spark, d)
    return C.Model("bayes").train(v).predict(v)


@query(f"WITH {_S}, " + _NB.format(folds="f AS (SELECT unnest(range(4)) AS f),", inside="c.id % 4 <> f", inside_s="s.id % 4 <> f", outside="c.id % 4 = m.f"))
def cross_validated_bayes(spark, d):
    """Every sample, by the classes of the three quarters that it is not in."""
    return C.cross_validated(C.Model("bayes"), vectors(spark, d), 4)


@query()
def normal_bayes(spark, d):
    """The same with full covariances."""
    return C.cross_validated(C.Model("normal_bayes"), vectors(spark, d), 4)


@query()
def linear_svm(spark, d):
    return C.cross_validated(C.Model("svm"), vectors(spark, d), 2)


@query()
def gaussian_svm(spark, d):
    return C.cross_validated(C.Model("svm", gamma=0.5), vectors(spark, d), 2)


@query()
def perceptron(spark, d):
    return C.cross_validated(C.Model("mlp"), vectors(spark, d), 2)
