"""Order-dependent and matrix-algebraic operators: numpy on one image, graph or pair at a time.

Each group is an image (bounded by preprocessing) or a small graph, so it fits a task; groups are dealt out by key.
Bodies follow the published methods.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.neighbours import exactly, slack, squared

TOLERANCE = 1e-7
#: Vertices up to which a graph's eigenvectors are taken from a dense matrix.
DENSE = 1024


# --- union-find and segmentation ---------------------------------------------------------------------------------------


class Forest:
    """Disjoint sets with sizes; the first root stays where ranks are equal."""

    def __init__(self, n: int) -> None:
        self.parent, self.rank, self.size, self.sets = list(range(n)), [0] * n, [1] * n, n

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> int:
        a, b = self.find(i), self.find(j)
        if a == b:
            return a
        if self.rank[a] < self.rank[b]:
            a, b = b, a
        self.rank[a] += self.rank[a] == self.rank[b]
        self.parent[b] = a
        self.size[a] += self.size[b]
        self.sets -= 1
        return a


def fuse_small_sets(forest: Forest, edges: list[tuple[int, int]], least: int, mask: np.ndarray) -> None:
    """One pass in edge order: sets with kept roots are joined where either is too small."""
    for a, b in edges:
        i, j = forest.find(a), forest.find(b)
        if i != j and mask[i] > 0 and mask[j] > 0 and min(forest.size[i], forest.size[j]) < least:
            forest.union(i, j)


def felzenszwalb_sets(n: int, edges: list[tuple[int, int, float]], k: float, least: int, mask: np.ndarray, scale: str = "volume") -> Forest:
    """Graph-based segmentation: edges by rising weight join two parts where the weight is within both inner variations.

    scale: the size that k is divided by, 'cardinality' or 'volume' (sum of degrees). Afterwards all pixels left out by
    the mask are one part, and small parts are fused.
    """
    if scale not in ("cardinality", "volume"):
        raise ValueError(scale)
    f = Forest(n)
    inner, volume = [0.0] * n, [0.0] * n
    for a, b, w in edges:
        volume[a] += w
        volume[b] += w
    bound = lambda i: inner[i] + (k / s if (s := f.size[i] if scale == "cardinality" else volume[i]) else np.inf)
    for i in sorted(range(len(edges)), key=lambda i: (edges[i][2], i)):
        a, b, w = edges[i]
        a, b = f.find(a), f.find(b)
        if a != b and w <= min(bound(a), bound(b)):
            both = volume[a] + volume[b]
            r = f.union(a, b)
            inner[r], volume[r] = w, both
    out = np.flatnonzero(mask <= 0)
    for p in out[1:].tolist():
        f.union(int(out[0]), p)
    fuse_small_sets(f, [(a, b) for a, b, _ in edges], least, mask)
    return f


def felzenszwalb(pixels: DataFrame, edges: DataFrame, k: float = 1000.0, parts: int = 500, scale: str = "volume") -> DataFrame:
    """components(image_id, pix, root) of each image; least size is kept pixels over `parts`. root is the least pixel."""

    def run(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"image_id": [], "pix": [], "root": []}).astype("int64")
        n = int(p["n"].iloc[0])
        mask = np.zeros(n)
        mask[p["pix"].to_numpy()] = p["mask"].to_numpy()
        e = e.sort_values("edge_no")
        f = felzenszwalb_sets(n, list(zip(e["src"], e["dst"], e["w"], strict=True)), k, int((mask != 0).sum()) // parts, mask, scale)
        roots = pd.Series([f.find(i) for i in range(n)])
        pix = np.arange(n)
        first = pd.Series(pix).groupby(roots).transform("min")
        return pd.DataFrame({"image_id": int(p["image_id"].iloc[0]), "pix": pix, "root": first})

    p = pixels.select("image_id", (F.col("r") * F.col("width") + F.col("c")).cast("long").alias("pix"), (F.col("height") * F.col("width")).alias("n"), "mask")
    return p.groupBy("image_id").cogroup(edges.select("image_id", "edge_no", "src", "dst", "w").toDF("image_id", "edge_no", "src", "dst", "w").groupBy("image_id")).applyInPandas(run, "image_id long, pix long, root long")


def fuse_small(components: DataFrame, edges: DataFrame, mask: DataFrame, least: int) -> DataFrame:
    """components after one pass over the edges that joins parts smaller than `least`; mask(image_id, pix, mask)."""

    def run(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"image_id": [], "pix": [], "root": []}).astype("int64")
        n = int(max(p["pix"].max(), p["root"].max())) + 1
        f, m = Forest(n), np.zeros(n)
        m[p["pix"].to_numpy()] = p["mask"].to_numpy()
        for a, b in zip(p["root"], p["pix"], strict=True):
            f.union(int(a), int(b))
        fuse_small_sets(f, list(zip(*(e.sort_values("edge_no")[c] for c in ("src", "dst")), strict=True)), least, m)
        roots = pd.Series([f.find(int(i)) for i in p["pix"]])
        first = p["pix"].reset_index(drop=True).groupby(roots).transform("min")
        return pd.DataFrame({"image_id": p["image_id"].to_numpy(), "pix": p["pix"].to_numpy(), "root": first})

    p = components.join(mask.select("image_id", "pix", "mask"), ["image_id", "pix"])
    return p.groupBy("image_id").cogroup(edges.toDF(*edges.columns).groupBy("image_id")).applyInPandas(run, "image_id long, pix long, root long")


def fuse_down_to(n: int, forest: Forest, edges: list[tuple[int, int, float]]) -> None:
    """Joins the two parts with the least mean weight between them, again and again, until at most n are left.

    A heap holds the borders; joining two parts adds up their borders to others, and what the heap has of the old ones is
    passed over when it comes up. Parts without a border between them are never joined.
    """
    border: dict[int, dict[int, tuple[float, int]]] = {}

    def add(a: int, b: int, w: float, k: int) -> None:
        for x, y in ((a, b), (b, a)):
            s, c = border.setdefault(x, {}).get(y, (0.0, 0))
            border[x][y] = s + w, c + k

    for a, b, w in edges:
        if (i := forest.find(a)) != (j := forest.find(b)):
            add(i, j, w, 1)
    heap = [(s / c, a, b) for a, others in border.items() for b, (s, c) in others.items() if a < b]
    heapq.heapify(heap)
    while heap and forest.sets > n:
        w, a, b = heapq.heappop(heap)
        if b not in border.get(a, {}) or border[a][b][0] / border[a][b][1] != w:
            continue
        r = forest.union(a, b)
        gone = b if r == a else a
        border[r].pop(gone)
        for x, (s, c) in border.pop(gone).items():
            if x != r:
                border[x].pop(gone)
                add(r, x, s, c)
        for x, (s, c) in border[r].items():
            heapq.heappush(heap, (s / c, min(r, x), max(r, x)))


# --- spectra -----------------------------------------------------------------------------------------------------------


def dense_laplacian(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, *, normalized: bool = False) -> np.ndarray:
    m = np.zeros((n, n))
    np.add.at(m, (src, dst), w)
    np.add.at(m, (dst, src), w)
    d = m.sum(axis=1)
    out = np.diag(d) - m
    if normalized:
        s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
        out = out * s[:, None] * s[None, :]
    return out


def is_symmetric(m: np.ndarray) -> bool:
    return bool(np.allclose(m, m.T, atol=TOLERANCE))


def is_positive_definite(m: np.ndarray) -> bool:
    try:
        np.linalg.cholesky(m)
    except np.linalg.LinAlgError:
        return False
    return True


def without_line(m: np.ndarray, i: int) -> np.ndarray:
    return np.delete(np.delete(m, i, 0), i, 1)


def signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of greatest magnitude (the first of equal ones) is positive."""
    at = np.abs(np.round(v, 9)).argmax(axis=0)
    s = np.sign(v[at, np.arange(v.shape[1])])
    return v * np.where(s == 0, 1, s)


def symmetric_eigen(m: np.ndarray, k: int, which: str = "SA") -> tuple[np.ndarray, np.ndarray]:
    """k eigenpairs: SA smallest, SM of least magnitude, LA largest; vectors' signs are fixed."""
    values, vectors = np.linalg.eigh(m)
    order = {"SA": np.argsort(values), "LA": np.argsort(-values), "SM": np.argsort(np.abs(values))}[which][:k]
    return values[order], signed(vectors[:, order])


def nonsymmetric_eigen(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k eigenpairs of least magnitude, real parts."""
    values, vectors = np.linalg.eig(m)
    order = np.argsort(np.abs(values), kind="stable")[:k]
    return values[order].real, signed(vectors[:, order].real)


def matrix_free_eigen(times: Callable[[np.ndarray], np.ndarray], n: int, k: int, tolerance: float = 1e-9, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenpairs of a symmetric operator given by its product with a vector; no matrix of n rows is made.

    Block Lanczos with full orthogonalisation, k vectors at a time, so that values which occur up to k times are all found;
    it ends when the residuals are below the tolerance (of the largest value) or the whole space has been seen. A product
    has a part along its own block and the one before only, so that all others are gone through once, for what rounding adds.
    """
    rng = np.random.default_rng(seed)
    k = min(k, n)
    room = min(n, 32 * k)
    basis, h = np.zeros((n, room), order="F"), np.zeros((room, room))
    each = lambda b: np.stack([times(v) for v in b.T], axis=1)
    block, m, due, near = np.linalg.qr(rng.standard_normal((n, k)))[0], 0, 0, 0
    while True:
        new = slice(m, m + block.shape[1])
        if new.stop > room:
            room = min(n, 2 * new.stop)
            basis, h = np.asfortranarray(np.pad(basis, ((0, 0), (0, room - basis.shape[1])))), np.pad(h, (0, room - len(h)))
        basis[:, new], m = block, new.stop
        block = each(block)
        last, near = slice(near, m), new.start
        h[last, new] = basis[:, last].T @ block
        h[new, last] = h[last, new].T
        if m == n or m > 2 * k and m >= due:
            due = 1.25 * m  # the small problem is solved again when it has grown
            values, y = np.linalg.eigh(h[:m, :m])
            vectors = basis[:, :m] @ y[:, :k]
            gap = np.linalg.norm(each(vectors) - vectors * values[:k], axis=0)
            if m == n or (gap <= tolerance * max(1.0, float(np.abs(values).max()))).all():
                return values[:k], signed(vectors)
        size = np.linalg.norm(block, axis=0)
        block = (block - basis[:, last] @ h[last, new])[:, : n - m]
        # What the basis holds already gives way to something new.
        lost = np.linalg.norm(block, axis=0) <= 1e-10 * np.maximum(size[: block.shape[1]], 1e-300)
        block[:, lost] = rng.standard_normal((n, int(lost.sum())))
        again = True
        while again:
            had = np.linalg.norm(block, axis=0)
            block = block - basis[:, :m] @ (basis[:, :m].T @ block)
            again = bool((np.linalg.norm(block, axis=0) < 0.5 * had).any())  # what is left may be rounding for the most part
            block, r = np.linalg.qr(block)
            again |= bool((np.abs(np.diag(r)) < 1e-3 * had).any())


def sparse_laplacian(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, *, normalized: bool = False) -> Callable[[np.ndarray], np.ndarray]:
    """The product of dense_laplacian() with a vector, from the edges."""
    ends, weights = np.concatenate([src, dst]), np.concatenate([w, w])
    others = np.concatenate([dst, src])
    d = np.bincount(ends, weights, n)
    s = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0) if normalized else np.ones(n)
    return lambda x: s * (d * s * x - np.bincount(ends, weights * (s * x)[others], n))


def spectral_embedding(edges: DataFrame, k: int, keys: str = "graph", *, normalized: bool = True, unit_rows: bool = False) -> DataFrame:
    """(graph, v, e): each vertex's coordinates in the k eigenvectors after the first of its graph's Laplacian."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([d["src"], d["dst"]]), return_inverse=True)
        given = len(names), at[: len(d)], at[len(d) :], d["w"].to_numpy(float)
        if len(names) <= DENSE:
            _, v = symmetric_eigen(dense_laplacian(*given, normalized=normalized), k + 1)
        else:
            _, v = matrix_free_eigen(sparse_laplacian(*given, normalized=normalized), len(names), k + 1)
        v = v[:, 1:]
        if unit_rows:
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({keys: d[keys].iloc[0], "v": names, "e": list(v)})

    return edges.groupBy(keys).applyInPandas(run, f"{keys} long, v long, e array<double>")


def k_means(x: np.ndarray, k: int, seed: int = 1, rounds: int = 100) -> np.ndarray:
    """Lloyd's rounds from k-means++ centres; an empty cluster keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = x[[int(rng.integers(len(x)))]]
    while len(centres) < k:
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        if d.sum() <= 0:  # fewer distinct rows than clusters
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum())]])
    own = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == own).all():
            break
        own = new
        centres = np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return own


def spectral_clusters(edges: DataFrame, k: int, keys: str = "graph", seed: int = 1) -> DataFrame:
    """(graph, v, cluster): k-means over each graph's spectral embedding."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("v")
        return pd.DataFrame({keys: d[keys].to_numpy(), "v": d["v"].to_numpy(), "cluster": k_means(np.stack(d["e"].to_numpy()), k, seed)})

    return spectral_embedding(edges, k, keys, unit_rows=True).groupBy(keys).applyInPandas(run, f"{keys} long, v long, cluster int")


def power_iteration_clusters(edges: DataFrame, k: int, rounds: int = 20) -> DataFrame:
    """(v, cluster) of one large graph, without a dense matrix."""
    from pyspark.ml.clustering import PowerIterationClustering

    m = PowerIterationClustering(k=k, maxIter=rounds, srcCol="src", dstCol="dst", weightCol="w", initMode="degree")
    return m.assignClusters(edges).select(F.col("id").alias("v"), "cluster")


def nearest_rows(x: np.ndarray, k: int, step: int = 256) -> np.ndarray:
    """The k nearest other rows of each row, nearest first, ties by their place; no matrix of all pairs is made."""
    n, out = len(x), np.zeros((len(x), k), int)
    for at in range(0, n if k else 0, step):
        own = np.arange(at, min(n, at + step))
        d2 = squared(x[own], x)
        d2[own - at, own] = np.inf
        most = np.partition(d2, k - 1, axis=1)[:, k - 1] + 2 * slack(x, x)
        i, j = np.nonzero(d2 <= np.minimum(most, np.finfo(float).max)[:, None])
        order = np.lexsort([j, exactly(x[own], x, i, j), i])
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        out[own[i[place < k]], place[place < k]] = j[place < k]
    return out


def lle(x: np.ndarray, k: int, d: int, regularization: float = 1e-3) -> np.ndarray:
    """Locally linear embedding, textbook form: weights that rebuild each row from its k neighbours, then the d
    eigenvectors after the constant one, times sqrt(rows)."""
    n = len(x)
    k = min(k, n - 1)
    near, w = nearest_rows(x, k), np.zeros((n, k))
    for at in range(0, n if k else 0, 512):
        z = x[near[at : at + 512]] - x[at : at + 512, None]
        g = z @ z.transpose(0, 2, 1)
        trace = np.trace(g, axis1=1, axis2=2)
        # Singular where there are more neighbours than dimensions, or some that equal the row or each other.
        singular = np.full(len(g), True) if k > x.shape[1] else np.linalg.eigvalsh(g)[:, 0] <= 1e-12 * trace
        g = g + np.eye(k) * np.where(singular, np.where(trace > 0, regularization * trace, 1.0), 0.0)[:, None, None]
        u = np.linalg.solve(g, np.ones((len(g), k, 1)))[:, :, 0]
        w[at : at + 512] = u / u.sum(axis=1, keepdims=True)
    if n <= DENSE:
        m = np.eye(n)
        np.subtract.at(m, (np.arange(n)[:, None], near), w)
        _, v = symmetric_eigen(m.T @ m, d + 1)
    else:

        def times(v: np.ndarray) -> np.ndarray:
            r = v - (w * v[near]).sum(axis=1)
            return r - np.bincount(near.ravel(), (w * r[:, None]).ravel(), n)

        _, v = matrix_free_eigen(times, n, d + 1)
    return v[:, 1:] * np.sqrt(n)


def lle_embedding(samples: DataFrame, k: int = 8, d: int = 2, group: str = "grp") -> DataFrame:
    """(grp, id, e) for samples(grp, id, x): an embedding for every group, whose vectors fit a task; no matrix of a large group is made."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        return pd.DataFrame({group: p[group].iloc[0], "id": p["id"].to_numpy(), "e": list(lle(np.stack(p["x"].to_numpy()), k, d))})

    return samples.groupBy(group).applyInPandas(run, f"{group} long, id long, e array<double>")


def elementary(x: np.ndarray) -> np.ndarray:
    """e1 to en: coefficients of the product of (1 + x t), a factor at a time (Newton's identities lose digits as n grows)."""
    e = np.zeros(len(x) + 1)
    e[0] = 1.0
    for k, v in enumerate(x):
        e[1 : k + 2] += v * e[: k + 1].copy()
    return e[1:]


def pattern_of(values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Polynomials of eigenvectors scaled by their values' roots, as sign times ln(1 + |s|); of one graph, or of each of many."""
    phi = np.sqrt(np.maximum(values, 0))[..., None, :] * vectors
    e = np.zeros((*phi.shape[:-2], phi.shape[-2] + 1, phi.shape[-1]))
    e[..., 0, :] = 1.0
    for j in range(phi.shape[-2]):  # as elementary()
        e[..., 1 : j + 2, :] += phi[..., j, None, :] * e[..., : j + 1, :].copy()
    s = e[..., 1:, :]
    return (np.sign(s) * np.log1p(np.abs(s))).reshape(*phi.shape[:-2], -1)


def small_patterns(laps: np.ndarray, k: int, size: int) -> np.ndarray:
    """pattern_vector() of each of many graphs with as many vertices."""
    n = laps.shape[1]
    if n - 1 < k:
        raise ValueError("a graph has fewer vertices than the pattern needs")
    m = np.zeros((len(laps), size, size))
    m[:, :n, :n] = laps
    values, vectors = np.linalg.eigh(m)
    at = slice(size - n + 1, size - n + 1 + k)
    order = np.argsort(values, axis=1)[:, at]
    values, vectors = np.take_along_axis(values, order, 1), np.take_along_axis(vectors, order[:, None, :], 2)
    top = np.take_along_axis(vectors, np.abs(np.round(vectors, 9)).argmax(axis=1)[:, None, :], 1)
    return pattern_of(values, vectors * np.where(top == 0, 1, np.sign(top)))


def pattern_vector(lap: np.ndarray, k: int, size: int) -> np.ndarray:
    """A graph's pattern: of k eigenpairs after the padding's zero ones and the constant one, polynomials of the scaled
    vectors, as sign times ln(1 + |s|)."""
    return small_patterns(lap[None], k, size)[0]


def patterns_of(d: pd.DataFrame, k: int, size: int, keys: str) -> pd.DataFrame:
    """The patterns of whole graphs, whose edges stand together; small graphs are worked on many at a time."""
    graphs, n = d[keys].to_numpy(), len(d)
    first = np.flatnonzero(np.r_[True, graphs[1:] != graphs[:-1]])
    own = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    # Vertices are numbered in rising order within their graph.
    at, v = np.concatenate([own, own]), np.concatenate([d["src"], d["dst"]])
    order = np.lexsort([v, at])
    new = np.r_[True, (at[order][1:] != at[order][:-1]) | (v[order][1:] != v[order][:-1])]
    start = np.r_[True, at[order][1:] != at[order][:-1]]
    number = np.cumsum(new) - 1
    place = np.empty(2 * n, int)
    place[order] = number - np.repeat(number[start], np.diff(np.r_[np.flatnonzero(start), 2 * n]))
    src, dst, w = place[:n], place[n:], d["w"].to_numpy(float)
    vertices, out = np.bincount(at[order][new], minlength=len(first)), [None] * len(first)
    for m in np.unique(vertices).tolist():
        alike, most = np.flatnonzero(vertices == m), max(size, m)
        if m > max(size, DENSE):  # no padding, and only the eigenpairs that count
            for g in alike.tolist():
                e = own == g
                values, vectors = matrix_free_eigen(sparse_laplacian(m, src[e], dst[e], w[e]), m, k + 1)
                out[g] = pattern_of(values[1:], vectors[:, 1:])
            continue
        step = max(1, (1 << 20) // most**2)
        for some in (alike[i : i + step] for i in range(0, len(alike), step)):
            which = np.full(len(first), -1)
            which[some] = np.arange(len(some))
            e = which[own] >= 0
            a = np.zeros((len(some), m, m))
            np.add.at(a, (which[own[e]], src[e], dst[e]), w[e])
            np.add.at(a, (which[own[e]], dst[e], src[e]), w[e])
            lap = -a
            lap[:, np.arange(m), np.arange(m)] += a.sum(axis=2)
            for g, pattern in zip(some.tolist(), small_patterns(lap, k, most), strict=True):
                out[g] = pattern
    return pd.DataFrame({keys: graphs[first], "pattern": out})


def pattern_vectors(edges: DataFrame, k: int, size: int, keys: str = "graph") -> DataFrame:
    """(graph, pattern) of each graph; element i * k + j is polynomial i of eigenvector j."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the edges of the last graph, which may go on
        for d in it:
            if not len(d):
                continue
            whole = int((d[keys] != d[keys].iloc[-1]).sum())
            if held and (whole or held[-1][keys].iloc[-1] != d[keys].iloc[0]):
                done = pd.concat([*held, d.iloc[:whole]], ignore_index=True)
                held = []
                yield patterns_of(done, k, size, keys)
            elif whole:
                yield patterns_of(d.iloc[:whole].reset_index(drop=True), k, size, keys)
            held.append(d.iloc[whole:])
        if held:
            yield patterns_of(pd.concat(held, ignore_index=True), k, size, keys)

    dealt = edges.select(keys, "src", "dst", F.col("w").cast("double").alias("w")).repartition(keys).sortWithinPartitions(keys)
    return dealt.mapInPandas(run, f"{keys} long, pattern array<double>")


def _within(part: np.ndarray, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges inside a part, by places in it."""
    place = np.full(n, -1)
    place[part] = np.arange(len(part))
    keep = (place[src] >= 0) & (place[dst] >= 0)
    return place[src[keep]], place[dst[keep]], w[keep]


def _sweep(order: np.ndarray, n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight between the first c vertices of an order and the others, for c from 1 to n - 1; edges are there both ways."""
    place = np.empty(n, int)
    place[order] = np.arange(n)
    a, b = place[src], place[dst]
    once = a < b
    return np.cumsum(np.bincount(a[once], w[once], n) - np.bincount(b[once], w[once], n))[: n - 1]


def _edges_of(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    src, dst = np.nonzero(w)
    return len(w), src, dst, w[src, dst]


def ncut_sets(w: np.ndarray, stop: float, least: int = 2) -> np.ndarray:
    """ncut_parts() of a symmetric matrix of weights."""
    return ncut_parts(*_edges_of(w), stop, least)


def ncut_parts(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, stop: float, least: int = 2) -> np.ndarray:
    """Normalised cuts: parts are split at the second generalised eigenvector while the cut's value is below stop. Edges are
    there both ways; a part's are taken from those of the part that it was split from."""
    out, todo, label = np.zeros(n, int), [(np.arange(n), src, dst, w)], 0
    while todo:
        part, a, b, v = todo.pop()
        m, side = len(part), None
        if m >= 2 * least:
            d = np.maximum(np.bincount(a, v, m), 1e-12)
            s = 1 / np.sqrt(d)
            if m <= DENSE:
                lap = np.diag(d)
                np.subtract.at(lap, (a, b), v)
                e = symmetric_eigen(lap * s[:, None] * s[None, :], 2)[1][:, 1]
            else:
                e = matrix_free_eigen(lambda x: x - s * np.bincount(a, v * (s * x)[b], m), m, 2)[1][:, 1]  # noqa: B023
            order = np.argsort(e * s, kind="stable")
            across, volume = _sweep(order, m, a, b, v), np.cumsum(d[order])[:-1]
            value = (across / volume + across / (d.sum() - volume))[least - 1 : m - least]
            c = int(np.argmin(value))
            if value[c] < stop:
                side = np.zeros(m, bool)
                side[order[: c + least]] = True
        if side is None:
            out[part] = label
            label += 1
        else:
            for x in (np.flatnonzero(~side), np.flatnonzero(side)):
                todo.append((part[x], *_within(x, m, a, b, v)))
    return out


def conjugate_gradient(a: np.ndarray | Callable[[np.ndarray], np.ndarray], b: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """x of a x = b for a symmetric positive definite a, or its product with a vector, to the tolerance times b's length; ValueError where it is not reached."""
    tolerance *= max(1.0, float(np.linalg.norm(b)))
    x, r = np.zeros_like(b, dtype=float), np.asarray(b, float).copy()
    times = a if callable(a) else a.__matmul__
    p, rs = r.copy(), float(r @ r)
    for _ in range(10 * len(b)):
        if rs <= tolerance**2:
            break
        ap = times(p)
        if (bent := float(p @ ap)) <= 0:
            raise ValueError("the matrix is not positive definite")
        alpha = rs / bent
        x, r = x + alpha * p, r - alpha * ap
        new = float(r @ r)
        p, rs = r + new / rs * p, new
    if rs > tolerance**2:
        raise ValueError("the conjugate gradients did not converge")
    return x


def isoperimetric_sets(w: np.ndarray, stop: float, depth: int = 10) -> np.ndarray:
    """isoperimetric_parts() of a symmetric matrix of weights."""
    return isoperimetric_parts(*_edges_of(w), stop, depth)


def connected_parts(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The least vertex that each vertex reaches; edges are there both ways."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, root[src], root[dst])
        new = np.minimum(new, new[root])
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def isoperimetric_parts(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, stop: float, depth: int = 10) -> np.ndarray:
    """Isoperimetric partitioning: the vertex of greatest degree is grounded, L0 x = d0 solved, and x cut where boundary
    over volume is least; parts are split while that ratio is below stop. Unconnected parts are split first."""
    out, label = np.zeros(n, int), 0
    todo = [(np.arange(n), src, dst, w, 0)]
    while todo:
        part, a, b, v, level = todo.pop()
        m = len(part)
        root = connected_parts(m, a[v > 0], b[v > 0])
        if root.any():
            order = np.argsort(root, kind="stable")
            for x in np.split(order, np.flatnonzero(np.diff(root[order])) + 1)[::-1]:
                todo.append((part[x], *_within(x, m, a, b, v), level))
            continue
        side = None
        if m > 2 and level < depth:
            d = np.bincount(a, v, m)
            free = np.arange(m) != int(d.argmax())

            def grounded(x: np.ndarray) -> np.ndarray:
                y = np.zeros(m)  # noqa: B023
                y[free] = x  # noqa: B023
                return (d * y - np.bincount(a, v * y[b], m))[free]  # noqa: B023

            x = np.zeros(m)
            x[free] = conjugate_gradient(grounded, d[free])
            order = np.argsort(x, kind="stable")
            across, volume = _sweep(order, m, a, b, v), np.cumsum(d[order])[:-1]
            volume = np.minimum(volume, d.sum() - volume)
            ratio = np.divide(across, volume, out=np.full(m - 1, np.inf), where=volume > 0)
            c = int(np.argmin(ratio))
            if ratio[c] < stop:
                side = np.zeros(m, bool)
                side[order[: c + 1]] = True
        if side is None:
            out[part] = label
            label += 1
        else:
            for x in (np.flatnonzero(~side), np.flatnonzero(side)):
                todo.append((part[x], *_within(x, m, a, b, v), level + 1))
    return out


def graph_partition(edges: DataFrame, method: str, stop: float, keys: str = "graph") -> DataFrame:
    """(graph, v, part) by 'normalized_cuts' or 'isoperimetric'."""
    sets = {"normalized_cuts": ncut_parts, "isoperimetric": isoperimetric_parts}[method]

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.concatenate([d["src"], d["dst"]]), return_inverse=True)
        w = d["w"].to_numpy(float)
        both = np.concatenate([at[: len(d)], at[len(d) :]]), np.concatenate([at[len(d) :], at[: len(d)]]), np.concatenate([w, w])
        return pd.DataFrame({keys: d[keys].iloc[0], "v": names, "part": sets(len(names), *both, stop)})

    return edges.groupBy(keys).applyInPandas(run, f"{keys} long, v long, part int")


# --- small matrices ----------------------------------------------------------------------------------------------------


def procrustes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation that best turns B into A: U V' of B'A."""
    u, _, vt = np.linalg.svd(b.T @ a)
    return u @ vt


def null_space_intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what both map to 0; no columns if nothing but 0."""
    m = np.vstack([a, b])
    _, s, vt = np.linalg.svd(m)
    return vt[int((s > TOLERANCE).sum()) :].T


def canonical_angles(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Principal vectors of both column spaces and the angles' cosines, falling; the space of more columns comes first."""
    if a.shape[1] < b.shape[1]:
        v, u, c = canonical_angles(b, a)
        return u, v, c
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    y, c, zt = np.linalg.svd(qa.T @ qb)
    return qa @ y[:, : b.shape[1]], qb @ zt.T, np.clip(c, 0, 1)


def subspace_intersection(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    u, _, c = canonical_angles(a, b)
    return u[:, : int((c >= 1 - TOLERANCE).sum())]


def subspace_distance(a: np.ndarray, b: np.ndarray) -> float:
    """sqrt(1 - c^2) of the least cosine."""
    return float(np.sqrt(max(0.0, 1 - canonical_angles(a, b)[2].min() ** 2)))


def generalized_eigen(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k smallest pairs of A v = t B v for a positive definite B."""
    c = np.linalg.inv(np.linalg.cholesky(b))
    values, v = np.linalg.eigh(c @ a @ c.T)
    return values[:k], signed(c.T @ v[:, :k])


def palette_projection(p: np.ndarray, s: np.ndarray, k: int, ridge: float = 1e-3) -> np.ndarray:
    """Columns v of P S P' v = t (P D P' + ridge I) v with D the row sums of S; palettes are P's columns."""
    d = np.diag(s.sum(axis=1))
    return generalized_eigen(p @ s @ p.T, p @ d @ p.T + ridge * np.eye(len(p)), len(p))[1][:, ::-1][:, :k]


def matrix_pairs(pairs: DataFrame, what: str) -> DataFrame:
    """(name, value) for rows (name, a, b) of matrices as arrays of rows.

    what: 'procrustes', 'null_space', 'cosines', 'intersection' or 'distance'; matrices come back as rows, flattened.
    """
    kinds = {"procrustes": procrustes, "null_space": null_space_intersection, "cosines": lambda a, b: canonical_angles(a, b)[2], "intersection": subspace_intersection, "distance": subspace_distance}
    f = kinds[what]

    def run(it):
        for d in it:
            mats = [[np.array([list(r) for r in x], float) for x in d[c]] for c in ("a", "b")]
            yield pd.DataFrame({"name": d["name"], "value": [np.ravel(f(x, y)) for x, y in zip(*mats, strict=True)]})

    return pairs.mapInPandas(run, "name string, value array<double>")


def sparse_times(m: DataFrame, v: DataFrame) -> DataFrame:
    """(i, v) of a COO matrix (i, j, v) times a vector (i, v): a join and a sum."""
    x = v.select(F.col("i").alias("j"), F.col("v").alias("x"))
    return m.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


# --- kernels between labelled graphs -------------------------------------------------------------------------------------


def kronecker_kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 where two labels (rows) are equal, else 0."""
    return (x[:, None] == y[None, :]).all(axis=2).astype(float)


def chi_squared_kernel(x: np.ndarray, y: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """exp(-gamma * sum of (a - b)^2 / (a + b)) of labels (rows) that are histograms."""
    both = x[:, None] + y[None, :]
    gap = (x[:, None] - y[None, :]) ** 2
    return np.exp(-gamma * np.divide(gap, both, out=np.zeros_like(gap), where=both > 0).sum(axis=2))


def tree_walk_kernel(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, depth: int, arity: int, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray] = kronecker_kernel) -> float:
    """Tree-walk kernel of two labelled graphs (adjacency a with labels x, b with y): the published recursion.

    A pair of vertices counts its labels' kernel times, at each level, one and the sum over pairs of equally many
    neighbours, from 1 to `arity` of them, of the products of their values one level below; sets of neighbours are matched
    in every order.
    """
    base = kernel(x, y)
    value = base.copy()
    near = [np.flatnonzero(r) for r in a], [np.flatnonzero(r) for r in b]
    for _ in range(depth - 1):
        new = np.zeros_like(value)
        for i, p in enumerate(near[0]):
            for j, q in enumerate(near[1]):
                # Sums over matchings of t neighbours with t: the coefficients of a rook polynomial, row by row.
                rook = {(): 1.0}
                for u in p.tolist():
                    more = dict(rook)
                    for used, s in rook.items():
                        if len(used) < arity:
                            for k, v in enumerate(q.tolist()):
                                if k not in used and value[u, v]:
                                    key = tuple(sorted((*used, k)))
                                    more[key] = more.get(key, 0.0) + s * value[u, v]
                    rook = more
                new[i, j] = base[i, j] * sum(rook.values())
        value = new
    return float(value.sum())
