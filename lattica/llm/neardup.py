"""Near-duplicate documents: an LSH forest of minhash signatures proposes, full shingle sets decide."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import batches, connected, joined_bytes, materialize, read, tuned, whole_groups
from lattica.llm.rolling import Hashes, mix

SHINGLE = 5
#: Trees of the forest, values in a tree's label, and the shortest prefix that two labels must share. Two sets whose
#: similarity is 0.75 share no such prefix in any tree with a probability of 5 in a million.
TREES, DEPTH, ENTER = 32, 8, 4
#: Neighbours in a sorted order that are compared in one task, and rows in each of the two parts of a region that are.
CHUNK, BLOCK = 256, 512
#: How far below the threshold the share of equal signature values may be: 4 standard deviations of 256 values.
MARGIN = 0.11

_rng = np.random.default_rng(77)
FACTORS = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct 5-word shingles; of its whole sequence, if it has fewer words."""
    data, at = joined_bytes(texts)
    n_docs = len(at) - 1
    if not len(data):
        return [np.zeros(0, np.uint64)] * n_docs
    data = LOWER[data]
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True  # a text ends where the next begins
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after[-1], after[:-1] = True, space[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    first = np.searchsorted(start, at)
    if not len(start):
        return [np.zeros(0, np.uint64)] * n_docs
    words = Hashes(data).of(start, end)
    n = len(words) - SHINGLE + 1
    grams = mix(sum(words[j : n + j] * PLACES[j] for j in range(SHINGLE))) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            short = int(b - a)
            out.append(mix(np.array([sum(int(w) * int(p) for w, p in zip(words[a:b], PLACES[1:], strict=False)) + short & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For every set that is not empty the least value of each of the forest's hash functions, in 32 bits."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(sets), TREES * DEPTH), np.uint32)
    if full:
        rows = np.flatnonzero([len(s) > 0 for s in sets])
        sizes = np.array([len(s) for s in full])
        # Parts that stay in a processor's cache.
        i = 0
        while i < len(full):
            j = max(i + 1, int(np.searchsorted(np.cumsum(sizes[i:]), 16384, side="right")) + i)
            tokens = np.concatenate(full[i:j])
            starts = np.concatenate([[0], np.cumsum(sizes[i:j])[:-1]])
            for k, f in enumerate(FACTORS):
                out[rows[i:j], k] = np.minimum.reduceat(((tokens * f) >> np.uint64(32)).astype(np.uint32), starts)
            i = j
    return out


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, a, b, labels) of every row: size and two 64-bit sums that name the set, and its labels.

    labels: a hash of 16 bits of each signature value, tree after tree.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("labels", pa.binary())])

    def run(it) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows=400, size=1 << 20):
            sets = shingle_sets(b.column(1))
            short = ((signatures(sets) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
            sizes = np.array([len(s) for s in sets], np.int64)
            names = np.array([[s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)] if len(s) else [0, 0] for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(np.ascontiguousarray(names[:, 0])), pa.array(np.ascontiguousarray(names[:, 1])), pa.array([x.tobytes() for x in short], pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, a long, b long, labels binary")


#: Rows of a forest's table: neighbours a and b, met in a chunk (key); members (a) of a region (key) of a tree; and the
#: first and last row of a part of the order, with its set's size (b) and label.
NEIGHBOURS, MEMBER, FIRST, LAST = range(4)
FOREST = "kind int, part int, tree int, a long, b long, key long, label binary"
_FOREST = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("tree", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("label", pa.binary())])


def similar_size(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of these sizes can have the similarity of the threshold."""
    return 100 * np.minimum(x, y) >= threshold * np.maximum(x, y)


def walked(it, part: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """One part of the sorted orders, rows (tree, label, rep, size): what FOREST lists.

    Neighbours are two rows next to each other in a tree's order whose labels share a prefix of ENTER values or more: how
    deep they meet is for the density about them to say. A region is a longest run of rows that share ENTER values.
    """
    before, before_common, pairs, first = None, 0, 0, True
    for b in it:
        if not b.num_rows:
            continue
        label = np.frombuffer(joined_bytes(b.column(1))[0].tobytes(), np.uint8).reshape(b.num_rows, -1)
        tree, rep, size = (b.column(i).to_numpy().astype(np.int64) for i in (0, 2, 3))
        fresh = before is None
        if not fresh:
            tree, rep, size = (np.concatenate([[x], y]) for x, y in zip(before[1:], (tree, rep, size), strict=True))
            label = np.concatenate([before[0][None], label])
        value = label.view(np.uint16)
        equal = value[1:] == value[:-1]
        common = np.where(equal.all(axis=1), value.shape[1], equal.argmin(axis=1)) * (tree[1:] == tree[:-1])
        meet = np.concatenate([[before_common >= ENTER], common >= ENTER])
        # Of the last row it is not known yet whether the next one is near.
        member = meet[:-1] | meet[1:]
        if first and len(member):
            member[0], first = True, False  # the part before may end in its region
        near = np.flatnonzero((common >= ENTER) & similar_size(size[1:], size[:-1], threshold) & (rep[1:] != rep[:-1]))
        key = mix(value[:, :ENTER].copy().view(np.uint64)[:, 0] * np.uint64(2 * TREES + 1) + tree.astype(np.uint64)).view(np.int64)
        m, n = np.flatnonzero(member), len(near)
        low, high = np.minimum(rep[near], rep[near + 1]), np.maximum(rep[near], rep[near + 1])
        chunk = (np.int64(part) << 32) | ((pairs + np.arange(n)) // CHUNK)
        pairs += n
        none, k = pa.nulls(n + len(m), pa.binary()), n + len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([NEIGHBOURS, MEMBER], np.int32), [n, len(m)])), pa.array(np.full(k, part, np.int32)), pa.array(np.concatenate([tree[near], tree[m]]).astype(np.int32)), pa.array(np.concatenate([low, rep[m]])), pa.array(np.concatenate([high, size[m]])), pa.array(np.concatenate([chunk, key[m]])), none], schema=_FOREST)
        edge = lambda i, kind: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((kind, part, int(tree[i]), int(rep[i]), int(size[i]), int(key[i]), label[i].tobytes()), _FOREST, strict=True)], schema=_FOREST)  # noqa: B023, E731
        if fresh:
            yield edge(0, FIRST)
        before, before_common, last = (label[-1], tree[-1], rep[-1], size[-1]), int(common[-1]) if len(common) else before_common, edge(-1, LAST)
    if before is not None:
        yield last


def forest(classes: DataFrame, threshold: int) -> DataFrame:
    """The table of FOREST for classes(rep, n_shingles, labels).

    Every tree's labels are sorted; the orders of all trees are one order, dealt out by range, so that a region of any size
    lies in as many parts as it fills. Rows next to each other across two parts are joined afterwards: two rows of a part.
    """
    cut = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("labels", 2 * DEPTH * t + 1, F.lit(2 * DEPTH)))
    rows = classes.select(F.posexplode(cut).alias("tree", "label"), "rep", "n_shingles")
    n = max(8, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = rows.repartitionByRange(n, "tree", "label", "rep").sortWithinPartitions("tree", "label", "rep")

    def walk(it) -> Iterator[pa.RecordBatch]:
        yield from walked(it, TaskContext.get().partitionId(), threshold)

    found = materialize(order.mapInArrow(walk, FOREST), "forest")

    def stitch(it) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in it for r in b.to_pylist()), key=lambda r: (r["part"], r["kind"]))
        out = []
        for x, y in zip(rows[1::2], rows[2::2], strict=False):
            part = pa.RecordBatch.from_arrays([pa.array([r[c] for r in (x, y)], t) for c, t in (("tree", pa.int32()), ("label", pa.binary()), ("a", pa.int64()), ("b", pa.int64()))], names=list("abcd"))
            out += [b.filter(pa.compute.equal(b.column(0), NEIGHBOURS)) for b in walked([part], -1 - x["part"], threshold) if b.num_rows]
        # The last row of a part may be in a region.
        last = [r | {"kind": MEMBER, "label": None} for r in rows if r["kind"] == LAST]
        yield pa.RecordBatch.from_pylist(last, schema=_FOREST)
        yield from out

    return found.unionByName(found.where(F.col("kind") >= FIRST).repartition(1).mapInArrow(stitch, FOREST))


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the rows of docs whose doc_id is in ids(id); sets are made once more from the texts.

    Ids grow with the corpus, so both sides are sorted towards each other at every size.
    """
    schema = pa.schema([("id", pa.int64()), ("set", pa.binary())])

    def describe(it) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows=400, size=1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in shingle_sets(b.column(1))], pa.binary())], schema=schema)

    wanted = ids.select(F.col("id").alias("doc_id")).distinct()
    return docs.hint("merge").join(wanted, "doc_id", "left_semi").mapInArrow(describe, "id long, set binary")


def by_id(ids: list[int], sets: list[bytes]) -> dict[int, list[np.ndarray]]:
    """Sets of each id: of all rows that share it, repeated ones once."""
    known: dict[int, list[np.ndarray]] = {}
    for d, s in zip(ids, sets, strict=True):
        if all(r.tobytes() != s for r in known.setdefault(d, [])):
            known[d].append(np.frombuffer(s, np.uint64))
    return known


def verified(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Stars (a, b) of ids that linked pairs(tile, a, b) join: 100 * shared shingles >= threshold * united shingles.

    A tile's sets are sent to it once; pairs that are joined already are skipped, so what returns joins all that is linked.
    Where rows share an id, any of their texts may be linked.
    """
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select("tile", F.explode(F.array("a", "b")).alias("id")).distinct()
    none = F.lit(None)
    rows = wanted.hint("merge").join(sets_of(docs, wanted), "id").select("tile", F.lit(0).alias("kind"), F.col("id").alias("a"), none.cast("long").alias("b"), "set")
    rows = rows.unionByName(pairs.select("tile", F.lit(1).alias("kind"), "a", "b", none.cast("binary").alias("set")))

    def decide(it) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(it, 1):
            kind = t.column(1).to_numpy()
            out: list[tuple[int, int]] = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                k = i + int((kind[i:j] == 0).sum())
                known = by_id(t.column(2).slice(i, k - i).to_pylist(), t.column(4).slice(i, k - i).to_pylist())
                two = [t.column(c).slice(k, j - k).to_pylist() for c in (2, 3)]
                out += linked(zip(*two, *two, strict=True), known, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], names=["a", "b"])

    return rows.repartition("tile").sortWithinPartitions("tile", "kind").mapInArrow(decide, "a long, b long")


def linked(pairs: Iterable[tuple[int, int, int, int]], sets: dict[int, list[np.ndarray]], threshold: int) -> list[tuple[int, int]]:
    """Stars of the nodes that linked pairs of ids (a, b) in nodes (x, y) join: each node with the smallest of its group."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.setdefault(i, i)) != i:
            parent[i] = parent[p]
            i = p
        return i

    for a, b, x, y in pairs:
        x, y = root(x), root(y)
        if x != y:
            for s in sets.get(a, ()):
                for r in sets.get(b, ()):
                    if 100 * min(len(s), len(r)) >= threshold * max(len(s), len(r)):
                        shared = len(np.intersect1d(s, r, assume_unique=True))
                        if 100 * shared >= threshold * (len(s) + len(r) - shared):
                            parent[max(root(x), root(y))] = min(root(x), root(y))
    return [(i, root(i)) for i in parent if root(i) != i]


TILE = "tile long, tree int, rep long, size long, node long, block int, main int, own int, labels binary"


def crossing(t: pa.Table, i: int, j: int, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a tile, rows i to j of a table of TILE: rows, and those that they may be linked with; each pair comes once.

    A tile has two blocks, of which only pairs across count, or one block against its own rows. A pair: rows of different
    nodes, not both of the region's main node, whose labels agree in about as many values as linked ones do, and that share
    a region in no tree before this one.
    """
    tree, rep, size, node, block, main, own = (t.column(c).slice(i, j - i).to_numpy() for c in range(1, 8))
    value = np.frombuffer(joined_bytes(t.column(8).slice(i, j - i).combine_chunks())[0].tobytes(), np.uint16).reshape(j - i, TREES * DEPTH)
    enter = value.reshape(-1, TREES, DEPTH)[:, :, :ENTER].copy().view(np.uint64)[:, :, 0]
    every = np.arange(j - i)
    for s in np.flatnonzero(main == 0).tolist():
        o = every[s + 1 :] if own[s] else every[(main == 1) | (block < block[s])]
        o = o[(node[o] != node[s]) & similar_size(size[o], size[s], threshold) & (rep[o] != rep[s])]
        o = o[(enter[o] == enter[s]).argmax(axis=1) == tree[s]] if len(o) else o
        o = o[(value[o] == value[s]).mean(axis=1) >= threshold / 100 - MARGIN] if len(o) else o
        if len(o):
            yield s, o


def late_links(members: DataFrame, nodes: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Stars (a, b) of nodes that are linked beyond nodes(id, component): of members(tree, key, rep) of regions.

    Regions that are all one node are done. In the others, the main node's rows are only set against the rest, and the rest
    against each other, in pairs of blocks, so that a region of any size meets many tasks. Labels alone say which rows may
    be linked with any; only those rows' sets are sent to their tiles, where the pairs are made and decided at once.
    """
    placed = members.join(nodes.select(F.col("id").alias("rep"), "component"), "rep", "left").select("tree", "key", "rep", F.coalesce("component", "rep").alias("node"))
    placed = materialize(placed.distinct(), "placed")
    sizes = placed.groupBy("tree", "key", "node").agg(F.count("*").alias("c")).groupBy("tree", "key").agg(F.max(F.struct("c", "node")).alias("m"), F.sum("c").alias("n"))
    left = materialize(sizes.where("n > m.c").select("tree", "key", F.col("m.node").alias("most"), F.ceil(F.col("m.c") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("n") - F.col("m.c")) / BLOCK).cast("int").alias("others")), "open-regions")
    r = placed.join(left, ["tree", "key"]).withColumn("main", (F.col("node") == F.col("most")).cast("int"))
    block = F.when(F.col("main") == 1, F.pmod(F.xxhash64("rep"), "mains")).otherwise(F.col("mains") + F.pmod(F.xxhash64("rep"), "others")).cast("int")
    against = F.explode(F.when(F.col("main") == 1, F.sequence("mains", F.col("mains") + F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1)))
    r = r.withColumn("block", block).withColumn("against", against)
    r = r.select(F.xxhash64("tree", "key", F.least("block", "against"), F.greatest("block", "against")).alias("tile"), "tree", "rep", "node", "block", "main", (F.col("block") == F.col("against")).cast("int").alias("own"))
    r = r.join(classes.select("rep", F.col("n_shingles").alias("size"), "labels"), "rep").select(*[f.split()[0] for f in TILE.split(", ")])

    def hopeful(it) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(it, 1):
            keep = np.zeros(t.num_rows, bool)
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                for s, o in crossing(t, i, j, threshold):
                    keep[i + s] = keep[i + o] = True
            yield from t.filter(pa.array(keep)).to_batches()

    hope = materialize(r.repartition("tile").sortWithinPartitions("tile").mapInArrow(hopeful, TILE), "hopeful")
    rows = hope.hint("merge").join(sets_of(docs, hope.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep"), "rep")

    def decide(it) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(it, 1):
            out: list[tuple[int, int]] = []
            for i, j in zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows], strict=True):
                rep, node = t.column(2).slice(i, j - i).to_pylist(), t.column(4).slice(i, j - i).to_pylist()
                known = by_id(rep, t.column(9).slice(i, j - i).to_pylist())
                out += linked(((rep[s], rep[k], node[s], node[k]) for s, o in crossing(t, i, j, threshold) for k in o.tolist()), known, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], []))], names=["a", "b"])

    rows = rows.select(*[f.split()[0] for f in TILE.split(", ")], "set")
    return rows.repartition("tile").sortWithinPartitions("tile", "rep").mapInArrow(decide, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text).

    1. One scan describes each set; rows with equal sets are one class, whose least doc_id stands for it.
    2. A forest of sorted signature orders: each class is a row in every tree, and neighbours with a common prefix are the
       candidates, at whatever depth they meet; a row has two in a tree at most. They are verified on full sets, and
       links give nodes.
    3. Regions, runs of rows with a common prefix of the least depth, that are one node by now are done. In those that are
       not, rows of different nodes are set against each other in blocks by their signatures, and what may be linked is
       verified, so that nothing rests on who stands next to whom.

    Texts without words are linked with nothing. Null doc_ids are linked with nothing and have no component, and are kept.
    Rows that share a doc_id are one node of the graph; repeated rows are one class. An empty table gives an empty result.
    Other columns are ignored.
    """
    own = docs.select("doc_id", "text")
    all_rows = materialize(described(own), "signatures")
    real = all_rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = materialize(real.groupBy("n_shingles", "a", "b").agg(F.min("doc_id").alias("rep"), F.any_value("labels").alias("labels")), "classes")
    rows = forest(classes, threshold)
    near = rows.where(F.col("kind") == NEIGHBOURS).groupBy("a", "b").agg(F.min("key").alias("tile")).select("tile", "a", "b")
    named = materialize(real.join(classes.select("n_shingles", "a", "b", "rep"), ["n_shingles", "a", "b"]).select("doc_id", "n_shingles", "rep"), "named")
    # Texts that share an id are one node.
    twice = named.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    same = named.join(twice, "doc_id").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    nodes = materialize(connected(verified(near, own, threshold).unionByName(same), "nodes"), "nodes")
    members = rows.where(F.col("kind") == MEMBER).select("tree", "key", F.col("a").alias("rep"))
    late = connected(late_links(members, nodes, classes, own, threshold), "late")
    late = materialize(late.select(F.col("id").alias("component"), F.col("component").alias("last")), "late")
    groups = nodes.join(late, "component", "left").select("id", F.coalesce("last", "component").alias("component"))
    alone = late.join(nodes.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("last").alias("component"))
    groups = materialize(groups.unionByName(alone), "groups")
    out = named.join(groups, F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = out.unionByName(all_rows.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all whole texts: a row for each row of documents; texts without words are alone."""
    tuned(spark)
    return near_duplicates(read(spark, sf_dir, "documents"))
