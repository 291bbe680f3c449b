"""Repeated passages of a corpus: prefix-free parsing, with suffix arrays of dictionary and parse cut at the passage length.

Triggers are places where a rolling hash over half a passage is the least of its neighbours, so that every string of the
passage length has one trigger that depends on nothing but the string. The text about a trigger is a phrase: its head, from
the first string that has the trigger to the trigger's end, is a word of the dictionary; its tail, what follows in the parse
as far as a string reaches. A string is a suffix of a head and a prefix of a tail. Dictionary suffixes are ranked by a suffix
array, tails by their order with common lengths, and both together put all strings in the order of the corpus, where equal
ones are neighbours. Equal strings have equal triggers, so the arrays are built for whole triggers at a time, in many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import batches, joined_bytes, materialize, read, tuned, whole_groups
from lattica.llm.rolling import Hashes, mix

LENGTH = 200
PHRASES = "key long, copy long, trigger long, phrase long, again long, low long, at long, high long, n long"
#: Distinct phrases of a trigger whose strings are ordered in one task; of a busier trigger, by BANDS of the strings' places,
#: each with the bytes that the band's strings share in its name.
HOT, BANDS = 1024, 10
#: Bits for a place within a segment of a text's hashes.
PLACE_BITS = 25


#: Names of the columns that removed() works with and adds, which clash with no other.
KEY, COPY, FIRST, LAST = "_repeats_key", "_repeats_copy", "_repeats_first", "_repeats_last"


def keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of id and text: equal rows share it, and have the same repeats."""
    return docs.withColumn(KEY, F.xxhash64(F.lit(1), "doc_id", "text")).withColumn(COPY, F.xxhash64(F.lit(2), "text", "doc_id"))


def least_places(h: np.ndarray, window: int, segment: int = 1 << PLACE_BITS) -> np.ndarray:
    """For each window of h the place of its least value but for the low bits, leftmost where equal.

    Low bits say where a value stands in a segment of h; segments overlap by a window, so h may have any length.
    """
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    n, step = len(h) - window + 1, segment - window + 1
    place = np.empty(n, np.int64)
    for s in range(0, n, step):
        part = h[s : s + segment]
        v = (part & ~low_bits) | np.arange(len(part), dtype=np.uint64)
        rows = -(-len(v) // window)
        full = np.full(rows * window, np.iinfo(np.uint64).max, np.uint64)
        full[: len(v)] = v
        full = full.reshape(rows, window)
        ahead = np.minimum.accumulate(full, axis=1).ravel()
        behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(part) - window + 1
        place[s : s + m] = (np.minimum(behind[:m], ahead[window - 1 : window - 1 + m]) & low_bits).astype(np.int64) + s
    return place


def triggers(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Phrases of the joined texts: text number, first and last string start, trigger's place, and hashes of trigger and phrase.

    Places are in the joined bytes. A phrase's strings start at low to high, all with the trigger at one place.
    """
    half = length // 2
    window = length - half + 1
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    if len(data) < length:
        return empty
    hashes = Hashes(data)
    h = hashes.every(half)
    n = len(data) - length + 1
    place = least_places(h, window)
    # Strings that lie within one text; runs of them with one trigger are phrases.
    inside = np.zeros(n + 1, np.int8)
    sizes = np.diff(at)
    good = sizes >= length
    np.add.at(inside, at[:-1][good], 1)
    np.add.at(inside, (at[1:] - length + 1)[good], -1)
    inside = np.cumsum(inside[:n]).astype(bool)
    first = np.zeros(n, bool)
    first[at[:-1][good]] = True
    first[1:] |= place[1:] != place[:-1]
    start = np.flatnonzero(first & inside)
    last = np.zeros(n, bool)
    last[(at[1:] - length)[good]] = True
    last[:-1] |= place[1:] != place[:-1]
    end = np.flatnonzero(last & inside)
    trigger = place[start]
    # With the trigger's place in it, a phrase's name tells the strings it has.
    phrase = mix(hashes.of(start, end + length) + (trigger - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.searchsorted(at, start, side="right") - 1, start, end, trigger, h[trigger], phrase


def merged(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of each text, sorted by text and first byte, with those joined that touch or overlap."""
    if not len(text):
        return text, first, last
    reach = np.maximum.accumulate(last + text * (np.int64(1) << 40)) - text * (np.int64(1) << 40)
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (first[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    return text[at], first[at], np.maximum.reduceat(last, at)


def phrases(docs: DataFrame, length: int) -> DataFrame:
    """The distinct phrases of every text: hashes of trigger and phrase (two of them), places of its strings and trigger, and
    n, 1 or 2 for once or more often in the text. Also the runs (low to high, without a trigger) of phrases that stand in
    their text more than once, so that text of much repetition has few rows.
    """
    schema = pa.schema([(f.split()[0], pa.int64()) for f in PHRASES.split(", ")])

    def run(it) -> Iterator[pa.RecordBatch]:
        for b in batches(it, size=1 << 20):
            data, at = joined_bytes(b.column(2))
            text, start, end, trigger, h, p = triggers(data, at, length)
            if not len(text):
                continue
            raw = memoryview(data.tobytes())
            again = np.array([xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(start.tolist(), (end + length).tolist(), strict=True)], np.uint64)
            name = mix(p + again * np.uint64(0x9E3779B97F4A7C15)) ^ mix(h) ^ mix(text.astype(np.uint64))
            _, first, back, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
            off = at[text]
            sure = np.flatnonzero(count[back] > 1)
            t, low, high = merged(text[sure], (start - off)[sure], (end - off)[sure] + length)
            keys = [b.column(i).to_numpy() for i in range(2)]
            none = np.zeros(len(t), np.int64)
            both = lambda x, y: np.concatenate([x, y])
            where = text[first]
            # Runs have no trigger; their text's key stands there, so that they are dealt out.
            columns = [both(keys[0][where], keys[0][t]), both(keys[1][where], keys[1][t]), both(h[first].view(np.int64), keys[0][t]), both(p[first].view(np.int64), none), both(again[first].view(np.int64), none), both((start - off)[first], low), both((trigger - off)[first], none), both((end - off)[first], high), both(np.minimum(count, 2), none)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return docs.select("key", "copy", "text").mapInArrow(run, PHRASES)


def suffix_ranks(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all suffixes of the words, put one after the other: ranks in lexicographic order, equal for equal suffixes only, and
    where each word starts.

    Prefix doubling: a rank of so many symbols and that of the symbols after them make one of twice as many; a word's end is
    a symbol below all bytes.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.zeros(int((sizes + 1).sum()), np.uint64)
    inside = np.ones(len(symbols), bool)
    inside[starts + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    left = np.repeat(starts + sizes, sizes + 1) - np.arange(len(symbols))  # symbols to the word's end
    key, width = np.zeros(len(symbols), np.uint64), 7
    for j in range(width):  # seven symbols of nine bits
        here = np.concatenate([symbols[j:], np.zeros(j, np.uint64)])
        key = (key << np.uint64(9)) | np.where(left >= j, here, np.uint64(0))
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while width <= int(sizes.max(initial=0)):
        after = np.where(left >= width, np.concatenate([rank[width:], np.zeros(width, np.uint64)]) + np.uint64(1), np.uint64(0))
        rank = np.unique((rank << np.uint64(32)) | after, return_inverse=True)[1].astype(np.uint64)
        width *= 2
    return rank.astype(np.int64), starts


def prefix_order(words: list[bytes], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each word's place in lexicographic order, and tables of the least common length of 2**k neighbours in it from a place on."""
    m = np.zeros((len(words), -(-width // 8) * 8), np.uint8)
    sizes = np.array([len(w) for w in words])
    m[np.arange(m.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    value = m.view(">u8").astype(np.uint64)
    order = np.lexsort(value.T[::-1])
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    s = m[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    tables = [common]  # common[i]: of places i and i + 1
    while (step := 1 << (len(tables) - 1)) * 2 <= len(common):
        tables.append(np.minimum(tables[-1][: len(tables[-1]) - step], tables[-1][step:]))
    return place, tables


def common_length(tables: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The common length of the words at two places of the order, low below high."""
    k = np.frexp((high - low).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int64)
    for j in np.unique(k):
        w = k == j
        out[w] = np.minimum(tables[j][low[w]], tables[j][high[w] - (1 << int(j))])
    return out


def equal_strings(texts: list[bytes], front: np.ndarray, back: np.ndarray, length: int) -> np.ndarray:
    """Which strings of distinct phrases are also strings of another, for one phrase after the other, from its first string on.

    texts: the bytes of a phrase's strings; front, back: how far before the trigger the first and the last string start.
    """
    half = length // 2
    heads, tails = {}, {}
    head = np.array([heads.setdefault(t[: f + half], len(heads)) for t, f in zip(texts, front.tolist(), strict=True)])
    tail = np.array([tails.setdefault(t[f + half :], len(tails)) for t, f in zip(texts, front.tolist(), strict=True)])
    rank, starts = suffix_ranks(list(heads))
    place, tables = prefix_order(list(tails), length - half)
    count = front - back + 1
    row = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    # The order of the corpus: by the dictionary's suffix, then by the parse after it.
    suffix, after = rank[starts[head[row]] + nth], place[tail[row]]
    order = np.argsort(suffix * len(tails) + after, kind="stable")
    x, y = order[:-1], order[1:]
    near = np.flatnonzero(suffix[x] == suffix[y])
    x, y = x[near], y[near]
    shared = np.full(len(x), length, np.int64)
    other = after[x] != after[y]
    shared[other] = common_length(tables, after[x][other], after[y][other])
    twice = shared >= length - half - (front[row[x]] - nth[x])
    out = np.zeros(len(row), bool)
    out[x[twice]] = out[y[twice]] = True
    return out


CONTEXT = "shard long, trigger long, phrase long, again long, base int, front int, back int, bytes binary"
_CONTEXT = pa.schema([("shard", pa.int64()), ("trigger", pa.int64()), ("phrase", pa.int64()), ("again", pa.int64()), ("base", pa.int32()), ("front", pa.int32()), ("back", pa.int32()), ("bytes", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """For each wanted phrase the bytes of its strings (CONTEXT); its trigger is its shard."""
    lists = wanted.groupBy("key", "copy").agg(F.collect_list(F.struct("trigger", "phrase", "again", "low", "at", "high")).alias("all"))  # no more than a text has

    def run(it) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows=200, size=2 << 20):
            out = []
            for t, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = t.encode()
                for x in w:
                    out.append((x["trigger"], x["trigger"], x["phrase"], x["again"], 0, x["at"] - x["low"], x["at"] - x["high"], t[x["low"] : x["high"] + length]))
                    if len(out) == 4096:
                        yield _batch(out, _CONTEXT)
                        out = []
            yield _batch(out, _CONTEXT)

    return docs.select("key", "copy", "text").join(lists, ["key", "copy"]).select("text", "all").mapInArrow(run, CONTEXT)


def _banded(contexts: DataFrame, length: int) -> DataFrame:
    """The strings of each phrase in bands of their distance to the trigger, as contexts of their own.

    A band's shard is named by all bytes that its strings have in common, so equal strings stay together, and a busy
    trigger's are spread.
    """
    half = length // 2
    step = -(-(length - half + 1) // BANDS)

    def run(it) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows=400):
            out = []
            for _, trigger, phrase, again, base, front, back, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for d in range(back // step * step, front + 1, step):
                    far, near = min(front, d + step - 1), max(back, d)
                    shared = t[front - d : front + length - (d + step - 1)]
                    shard = xxhash.xxh3_64_intdigest(shared, seed=d + 1) - (1 << 63)
                    out.append((shard, trigger, phrase, again, base + front - far, far, near, t[front - far : front - near + length]))
            yield _batch(out, _CONTEXT)

    return contexts.mapInArrow(run, CONTEXT)


RUNS = "trigger long, phrase long, again long, start long, stop long"
_RUNS = pa.schema([(f.split()[0], pa.int64()) for f in RUNS.split(", ")])


def _ordered(contexts: DataFrame, length: int) -> DataFrame:
    """RUNS: runs of strings, counted from the phrase's first, that another phrase of the shard has too."""

    def run(it) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(it, 1, rows=4096, size=4 << 20):
            names = [t.column(i).to_numpy() for i in (1, 2, 3)]
            base, front, back = (t.column(i).to_numpy().astype(np.int64) for i in (4, 5, 6))
            equal = equal_strings(t.column(7).to_pylist(), front, back, length)
            count = front - back + 1
            row = np.repeat(np.arange(len(count)), count)
            first = np.cumsum(count) - count
            edge = np.concatenate([[True], row[1:] != row[:-1]])
            start = np.flatnonzero(equal & (edge | ~np.concatenate([[False], equal[:-1]])))
            stop = np.flatnonzero(equal & np.concatenate([edge[1:] | ~equal[1:], [True]])) + 1
            r = row[start]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*(n[r] for n in names), start - first[r] + base[r], stop - first[r] + base[r])], schema=_RUNS)

    return contexts.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, RUNS)


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """RUNS of shards that stay large when banded: bands of one string each, named by all its bytes, which need only be counted."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *_RUNS])

    def run(it) -> Iterator[pa.RecordBatch]:
        for b in batches(it, rows=400, size=1 << 20):
            out = []
            for _, trigger, phrase, again, base, front, back, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for i in range(front - back + 1):
                    name = xxhash.xxh3_128_intdigest(t[i : i + length])
                    out.append(((name >> 64) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63), trigger, phrase, again, base + i, base + i + 1))
            yield _batch(out, schema)

    strings = contexts.mapInArrow(run, f"a long, b long, {RUNS}")
    twice = materialize(strings.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "twice")
    return strings.join(twice, ["a", "b"]).select(*[f.name for f in _RUNS])


def _split(contexts: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Contexts of shards that have at most so many, and of the others."""
    busy = contexts.groupBy("shard").agg(F.count("*").alias("c")).where(F.col("c") > most).select("shard")
    busy = materialize(busy, "busy")
    return contexts.join(busy, "shard", "left_anti"), contexts.join(busy, "shard", "left_semi")


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, copy, first, last) for docs(key, copy, text): runs of bytes first to last (exclusive) of strings that start elsewhere too.

    Runs may touch or overlap. Null texts, and those shorter than a passage, have none. A trigger that occurs once settles
    its phrase, as does one whose phrase is always the same (by two hashes of 64 bits), whatever the number of its places.
    """
    if length < 16:
        raise ValueError("passages are of at least 16 bytes")
    rows = phrases(docs, length)
    all_ = rows.where("n > 0")
    ends = [f(c).alias(f"{n}_{c}") for c in ("phrase", "again") for n, f in (("low", F.min), ("high", F.max))]
    alive = all_.groupBy("trigger").agg(F.sum("n").alias("c"), *ends).where("c > 1")
    alive = materialize(alive.select("trigger", ((F.col("low_phrase") != F.col("high_phrase")) | (F.col("low_again") != F.col("high_again"))).alias("many")), "alive")
    live = materialize(rows.join(alive, "trigger", "left").where("n = 0 OR many IS NOT NULL"), "live")
    sure = live.where("n = 0").select("key", "copy", F.col("low").alias("first"), F.col("high").alias("last"))
    same = live.where((F.col("n") > 0) & ~F.col("many")).select("key", "copy", F.col("low").alias("first"), (F.col("high") + length).alias("last"))
    mixed = live.where("n > 0 AND many")
    # One of each phrase is compared; a phrase that occurs twice has all its strings twice.
    by = ["trigger", "phrase", "again"]
    each = materialize(mixed.groupBy(*by).agg(F.sum("n").alias("c"), F.min(F.struct("key", "copy", "low", "at", "high")).alias("x")).select(*by, "c", "x.*"), "each")
    few, busy = _split(materialize(_contexts(docs, each, length), "contexts"), HOT)
    banded, crowded = _split(materialize(_banded(busy, length), "banded"), HOT)
    runs = _ordered(few, length).unionByName(_ordered(banded, length)).unionByName(_counted(crowded, length))
    whole = each.where("c > 1").select(*by, F.lit(0).cast("long").alias("start"), (F.col("high") - F.col("low") + 1).alias("stop"))
    found = materialize(runs.unionByName(whole), "runs")
    part = mixed.join(found, by).select("key", "copy", (F.col("low") + F.col("start")).alias("first"), (F.col("low") + F.col("stop") - 1 + length).alias("last"))
    return sure.unionByName(same).unionByName(part)


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text and any other columns) with FIRST and LAST: sorted arrays of the maximal runs to remove, or null.

    All rows stay. Repeated rows are texts of their own, and repeat each other; null and empty texts have no runs.
    """
    d = keyed(docs)
    s = materialize(spans(d.select(F.col(KEY).alias("key"), F.col(COPY).alias("copy"), "text"), length), "spans")

    kind = pa.list_(pa.int64())
    schema = pa.schema([("key", pa.int64()), ("copy", pa.int64()), ("first", kind), ("last", kind)])

    def merge(it) -> Iterator[pa.RecordBatch]:
        for b in it:
            firsts, lasts = [], []
            for x in b.column(2).to_pylist():
                f, e = [], []
                for p in sorted((r["first"], r["last"]) for r in x):
                    if f and p[0] <= e[-1]:
                        e[-1] = max(e[-1], p[1])
                    else:
                        f.append(p[0])
                        e.append(p[1])
                firsts.append(f)
                lasts.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(firsts, kind), pa.array(lasts, kind)], schema=schema)

    # A text has fewer runs than triggers; equal rows share a key, so their runs are made distinct first.
    lists = s.distinct().groupBy("key", "copy").agg(F.collect_list(F.struct("first", "last")).alias("x")).mapInArrow(merge, "key long, copy long, first array<long>, last array<long>")
    lists = materialize(lists, "lists").toDF(KEY, COPY, FIRST, LAST)
    return d.join(lists, [KEY, COPY], "left").drop(KEY, COPY)


def _kept(text: bytes, first: list[int] | None, last: list[int] | None) -> bytes:
    if not first:
        return text
    return b"".join(text[i:j] for i, j in zip([0, *last], [*first, len(text)], strict=True))


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages cut out of text (bytes that are then no whole characters are dropped); same rows and columns.

    A passage is cut everywhere, its first place included. Null texts stay null, empty ones empty; an empty table stays so.
    """
    names = docs.columns
    d = removed(docs.select(*names), length)

    @F.pandas_udf("string")
    def cut(text, first, last):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([None if t is None else _kept(t.encode(), list(f), list(e)).decode("utf-8", "ignore") if f is not None else t for t, f, e in zip(text, first, last, strict=True)], dtype=object)

    text = F.when(F.col(FIRST).isNull(), F.col("text")).otherwise(cut("text", FIRST, LAST))
    return d.withColumn("text", text).select(*names)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each whole text is left without passages of 200 bytes that occur twice in the corpus.

    A row for each row of documents, in any order; null texts are empty, and repeated rows repeat each other.
    """
    tuned(spark)
    d = removed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [f.split()[0] for f in RESULT.split(", ")]

    def run(it) -> Iterator[pa.RecordBatch]:
        for b in batches(it, size=4 << 20):
            rows = []
            for i, t, f, e in zip(*(b.column(j).to_pylist() for j in range(4)), strict=True):
                t = (t or "").encode()
                k = _kept(t, f, e)
                rows.append((i, len(t), len(t) - len(k), len(f or ()), hashlib.sha256(k).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return d.select("doc_id", "text", FIRST, LAST).mapInArrow(run, RESULT)
