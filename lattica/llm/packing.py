"""Documents packed into sequences of bounded length: large items matched, small ones into the best-fitting gaps."""

from __future__ import annotations

import gc
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import batches, materialize, read, tuned

CAPACITY = 4096
END_ID = 1
REMEMBERED = 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Unicode White_Space, which the tokenizer's pattern takes as space (fixed values).
SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


#: Letters that stay one character each when normalized; and a word of them with marks that the pattern takes by themselves.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
ALONE = re.compile(f"[{LETTERS}]+").fullmatch
MARKED = re.compile(f"([{LETTERS}]++)([!\"#$%&()*+,./:;=?@^_`{{}}~\\[\\]\\\\-]+)").fullmatch


class Known(dict):
    """Chunks' ids. One that is not known, nor was in the generation before, is noted as missing, with a place for its ids."""

    def __init__(self, old: dict[str, bytes]) -> None:
        self.old, self.missing = old, {}

    def __missing__(self, chunk: str) -> bytes | bytearray:
        if (known := self.missing.get(chunk)) is None:
            if (known := self.old.get(chunk)) is None:
                known = self.missing[chunk] = bytearray()
            else:
                self[chunk] = known
        return known


class Words:
    """A tokenizer whose pattern never crosses white space: texts are cut there, and chunks are encoded once.

    Chunks go to the tokenizer as they are, so that normalizing and matching added tokens are its own work. Only runs of
    letters up to U+00FF, which nothing but lower-casing changes, are put together in one text, or split from ASCII marks
    after them (but for those that an added token or a contraction may begin or end with).
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(SPACES).split
        # A text may be cut at white space unless an added token holds some, or takes what is beside it.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(self.split(t) != [t] for t in self.added) or any(t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that touch white space")
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young = Known({})
        # Whether the tokenizer itself lower-cases the letters that are put together, one by one.
        capitals = [chr(c) for c in range(256) if ALONE(chr(c)) and chr(c) != chr(c).lower()]
        encode = lambda texts: [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.folds = encode([f"a{c}{c}a {c}" for c in capitals]) == encode([f"a{c}{c}a {c}".lower() for c in capitals])

    def learn(self, alone: list[str]) -> None:
        """Words of LETTERS alone are one word to the pattern, and only its last id ends a word: many go through in one text."""
        for i in range(0, len(alone), 400):
            part = alone[i : i + 400]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                self._one_by_one(part)
                continue
            raw, at = ids.tobytes(), 0
            for c, e in zip(part, (4 * ends).tolist(), strict=True):
                self.young[c] = raw[at:e]
                at = e

    def _one_by_one(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), 2000):
            part = chunks[i : i + 2000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = e.ids
                self.young[c] = struct.pack(f"<{len(ids)}I", *ids)

    def chunks(self, text: str) -> list[str]:
        # str.split() knows the same separators as the pattern but for U+001C to U+001F, which it takes as well.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.split(text) if c]
        return text.split()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers. The garbage collector, which would go through all that is
        known again and again, rests meanwhile: no cycles are made."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._ids(texts)
        finally:
            if collects:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > REMEMBERED:
            self.young.old = {}
            self.young = Known(self.young)
        young = self.young
        young.missing = missing = {}
        # One look-up a chunk: what is missing has its place in the texts before its ids are learnt.
        found = [list(map(young.__getitem__, self.chunks(t))) for t in texts]
        # A word with marks after it is the word in small letters and the marks, each known or learnt by itself.
        alone, rest, marked = set(), set(), []
        fold = str.lower if self.folds else str
        for c in missing:
            if c.isalpha():
                if not (c.isascii() or ALONE(c)):
                    rest.add(c)
                elif (word := fold(c)) == c:
                    alone.add(c)
                else:
                    marked.append((c, word, ""))
            elif parts := MARKED(c):
                word, marks = parts.groups()
                marked.append((c, fold(word), marks))
            else:
                rest.add(c)
        for _, word, marks in marked:
            if word not in young and young.old.get(word) is None:
                alone.add(word)
            if marks not in young and young.old.get(marks) is None:
                rest.add(marks)
        self.learn(list(alone))
        self._one_by_one(list(rest))
        for c, word, marks in marked:
            young[c] = young[word] + young[marks]
        for c, place in missing.items():
            place += young[c]
        return [b"".join(f) for f in found]


_words: dict[str, Words] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, *, with_ids: bool = False) -> DataFrame:
    """Every text's ids and the end id, cut into pieces of the capacity: one row for each piece.

    Null texts are empty: one piece that holds only the end id. Repeated rows give repeated pieces; other columns go.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
    end = struct.pack("<I", END_ID)

    def run(it) -> Iterator[pa.RecordBatch]:
        if path not in _words:
            _words[path] = Words(path)
        w = _words[path]
        for b in batches(it, rows=250, size=2 << 20):
            rows = []
            for i, ids in zip(b.column(0).to_pylist(), w.ids([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)) + (part,) * with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where pieces go, from the number of pieces of each length: runs (length, first rank, count, sequence, offset).

    Pieces first to last of a run take consecutive sequences, each at the offset. Bins of equal content are one class
    with a count, so the work depends on the number of lengths, not of pieces. Lengths above a third of the capacity come
    first: in falling order each takes the largest partner above a third that still fits, at most two in a bin. Then the
    smaller lengths, in falling order, go to the bins with the smallest gap that holds them; new bins open only when no
    gap does. Returns the runs and the number of sequences.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be between 1 and the capacity")
    next_bin = 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of bins (first, count)
    order: list[int] = []  # gaps in use, sorted

    def put(n: int, first: int, count: int, offset: int) -> None:
        runs.append((n, used[n], count, first, offset))
        used[n] += count
        left[n] -= count

    def leave(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
    while large:
        n = large[-1]
        fit = capacity - n
        i = bisect_left(large, fit + 1) - 1
        while i >= 0 and not left[large[i]]:
            large.pop(i)
            i -= 1
        partner = large[i] if i >= 0 else None
        if partner is None:
            c = left[n]
            put(n, next_bin, c, 0)
            leave(capacity - n, next_bin, c)
        elif partner == n:
            c = left[n] // 2
            if c:
                put(n, next_bin, c, 0)
                put(n, next_bin, c, n)
                leave(capacity - 2 * n, next_bin, c)
            else:  # one is left: its partner must be a shorter one
                other = next((m for m in reversed(large[:i]) if left[m]), None)
                c = 1
                put(n, next_bin, 1, 0)
                if other is not None:
                    put(other, next_bin, 1, n)
                leave(capacity - n - (other or 0), next_bin, 1)
        else:
            c = min(left[n], left[partner])
            put(n, next_bin, c, 0)
            put(partner, next_bin, c, n)
            leave(capacity - n - partner, next_bin, c)
        next_bin += c
        while large and not left[large[-1]]:
            large.pop()
    for n in small:
        while left[n]:
            i = bisect_left(order, n)
            if i == len(order):  # no gap holds it: new bins, each filled with as many as fit
                each = capacity // n
                c = left[n] // each
                if c:
                    for j in range(each):
                        put(n, next_bin, c, j * n)
                    leave(capacity - each * n, next_bin, c)
                else:
                    c, each = 1, left[n]
                    for j in range(each):
                        put(n, next_bin, 1, j * n)
                    leave(capacity - each * n, next_bin, 1)
                next_bin += c
                continue
            gap = order[i]
            first, count = gaps[gap].pop()
            c = min(count, left[n])
            if c < count:
                gaps[gap].append((first + c, count - c))
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            put(n, first, c, capacity - gap)
            leave(gap - n, first, c)
    return runs, next_bin


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with (sequence_id, offset): cut has doc_id, piece and length.

    Only the number of pieces of each length (at most `capacity` rows) and the plan's runs leave the executors; a piece
    finds its place by its rank among those of its length. Ranks are counted in shards, so that a length that a third of
    all pieces share is spread. The input is read several times: give it as a stored table.
    """
    spark = cut.sparkSession
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * n)).cast("int")
    p = cut.withColumn("shard", shard)
    by_shard = p.groupBy("length", "shard").agg(F.count("*").alias("in_shard"))
    counts = {int(r[0]): int(r[1]) for r in by_shard.groupBy("length").agg(F.sum("in_shard")).collect()}
    runs, _ = plan(counts, capacity)
    w = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_shard.withColumn("before", F.coalesce(F.sum("in_shard").over(w), F.lit(0))).drop("in_shard")
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece")
    ranked = p.withColumn("own", F.row_number().over(inside) - 1).join(firsts, ["length", "shard"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "shard")

    # The runs: a few for each length, whatever the number of pieces. Sorted by length and rank.
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast(runs)

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = table.value
        lengths, start = np.unique(r[:, 0], return_index=True)
        stop = np.append(start[1:], len(r))
        for d in it:
            n_, k = d["length"].to_numpy(np.int64), d["rank"].to_numpy(np.int64)
            at = np.empty(len(d), np.int64)
            which = np.searchsorted(lengths, n_)
            for u in np.unique(which):
                mine = which == u
                at[mine] = start[u] + np.searchsorted(r[start[u] : stop[u], 1], k[mine], side="right") - 1
            yield d.drop(columns="rank").assign(sequence_id=r[at, 3] + k - r[at, 1], offset=r[at, 4])

    names = [f.name for f in cut.schema]
    out = ranked.select(*names, "rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return out.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """pieces() of docs(doc_id, text), packed by pack(); an empty table gives an empty one. Other columns go."""
    return pack(materialize(pieces(docs, path, capacity), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids; a null or empty text is its end id, and repeated rows are packed each."""
    tuned(spark)
    return pack_documents(read(spark, sf_dir, "documents"), default_tokenizer())
