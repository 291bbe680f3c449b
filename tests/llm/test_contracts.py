"""Queries as the contract has them, on driver tables and small ones, against libraries and brute force."""

import collections
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import flac, neardup, packing, toxicity

SF = "/root/testdata/sf0.001"


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")


ODD = ["İ.", "Türk DİLİ, İ;", "<|STARTOFTEXT|>", "a<|endoftext|>.b <|EndOfText|>", "x\u0307. i\u0307,", "Å Å ﬁ ŉ", "don't.. \x1cq", "\u2003a\u0301.", "", None, "word. " * 3000]


def test_op4_rows(spark, tmp_path):
    """Ids, by their checksum, pieces and starts are the tokenizer's; sequences are gapless."""
    texts = ODD + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    table(spark, tmp_path, "documents", [(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = packing.op4_packing(spark, str(tmp_path)).collect()
    t, want = packing.Words(packing.default_tokenizer()).tokenizer, set()
    for i, x in enumerate(texts):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.add((i, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for b in by.values():
        ends = [0]
        for o, n in sorted(b):
            assert o == ends[-1]
            ends.append(o + n)
        assert ends[-1] <= 4096


def test_tokenizer_on_random_texts():
    rng = np.random.default_rng(9)
    alphabet = ["İ", "i", "\u0307", "\u0301", "a", "Z", "'s", "'", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", ".", ",", ";", ":", "1", "ß", "é", "\x1c", "\x85", "\xa0", "\x00", " ", "\n", "日", "한", "ŉ", "Σ", "ﬁ", "word", "DİLİ", "'re", "\u200b", "😀", "½"]
    w = packing.Words(packing.default_tokenizer())
    for n in rng.integers(1, 14, 4000):
        text = "".join(rng.choice(alphabet, n))
        ids = w.tokenizer.encode(text, add_special_tokens=False).ids
        assert w.ids([text])[0] == struct.pack(f"<{len(ids)}I", *ids), text


def test_op7_recall_on_a_driver_table(spark):
    """All links of the table, found by comparing every pair that shares a rare shingle, are within components."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    comp = {r.doc_id: r.component_id for r in neardup.op7_neardup(spark, "/root/testdata/sf0.01").collect()}
    import pyarrow as pa

    rows = docs.orderBy("doc_id").collect()
    sets = dict(zip([r.doc_id for r in rows], neardup.shingle_sets(pa.array([r.text for r in rows], pa.string())), strict=True))
    holds = collections.defaultdict(list)
    for i, s in sets.items():
        for v in np.sort(neardup.mix(s))[: len(s) - -(-3 * len(s) // 4) + 1].tolist():  # linked sets share one of so many
            holds[v].append(i)
    pairs = {(a, b) for h in holds.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    linked = 0
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        shared = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
            linked += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert linked and comp == {i: find(i) for i in sets}


def test_op2_leaves_held_out_rows_alone(spark, tmp_path):
    """The sample has no held-out row, whatever its label; other labels of these change no score."""
    rng = np.random.default_rng(1)
    words = ["calm", "river", "stone", "light", "paper"]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" nitwit" if i % 3 == 0 else ""), "en", "s") for i in range(90)]
    docs = spark.createDataFrame([*rows, (None, "x", "en", "s"), (1000, None, "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    held = {i for i in range(90) if zlib.crc32(str(i).encode()) % 5 == 0}
    taken = toxicity.sample(docs, labels).collect()
    assert {r.doc_id for r in taken} == set(range(90)) - held
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.scored(docs, toxicity.train(docs, x)).select("doc_id", "score").collect() for x in (labels, turned))
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str) and len(one) == 92


def test_flac_linear_prediction():
    """Frames that the encoder does not write: linear prediction, partitions, escapes, constants, wide Rice parameters."""

    class Out:
        def __init__(self):
            self.bits = ""

        def put(self, value, width):
            self.bits += format(value & ((1 << width) - 1), f"0{width}b") if width else ""

        def rice(self, r, k):
            z = 2 * r if r >= 0 else -2 * r - 1
            self.bits += "0" * (z >> k) + "1"
            self.put(z, k)

    def stream(x, subframe):
        head = bytes([0xFF, 0xF8, 0x70, 0x02, 0]) + struct.pack(">H", len(x) - 1)
        body = head + bytes([flac.crc8(head)])
        bits = subframe + "0" * (-len(subframe) % 8)
        body += int(bits, 2).to_bytes(len(bits) // 8, "big")
        data = np.frombuffer(body, np.uint8)
        body += int(flac.crc16(data, np.array([0]), np.array([len(data)]))[0]).to_bytes(2, "big")
        import hashlib

        info = struct.pack(">HH", 1024, 1024) + (0).to_bytes(6, "big") + ((flac.RATE << 44) | (7 << 36) | len(x)).to_bytes(8, "big") + hashlib.md5(x.astype(np.int8).tobytes()).digest()
        return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + body

    rng = np.random.default_rng(3)
    x = np.clip(np.round(60 * np.sin(np.arange(256) / 9) + rng.normal(0, 4, 256)), -128, 127).astype(int)
    weights, shift, order = [60, -28], 5, 2
    guess = lambda i: sum(w * int(x[i - 1 - j]) for j, w in enumerate(weights)) >> shift
    r = [int(x[i]) - guess(i) for i in range(order, 256)]
    for method, parts in ((0, 0), (0, 2), (1, 3)):
        o = Out()
        o.put((32 + order - 1) << 1, 8)
        for i in range(order):
            o.put(int(x[i]), 8)
        o.put(7 - 1, 4)
        o.put(shift, 5)
        for w in weights:
            o.put(w, 7)
        o.put(method, 2)
        o.put(parts, 4)
        wide, n, at = 4 + method, 256 >> parts, 0
        for p in range(1 << parts):
            own = r[at : at + n - (order if p == 0 else 0)]
            at += len(own)
            if p == 1:  # raw residuals
                o.put((1 << wide) - 1, wide)
                o.put(9, 5)
                for v in own:
                    o.put(v, 9)
            else:
                k = 20 if method and p == 2 else 3
                o.put(k, wide)
                for v in own:
                    o.rice(v, k)
        assert flac.decode([stream(x, o.bits)]) == [(x + 128).astype(np.uint8).tobytes()]
    o = Out()
    o.put(0, 8)
    o.put(-5, 8)
    assert flac.decode([stream(np.full(100, -5), o.bits)]) == [bytes([123] * 100)]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A table with columns whose names the operators use inside, and rows of every odd kind."""
    d = str(tmp_path_factory.mktemp("small"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 80").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame([(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "one two", "en", "s", 7), (902, "one two", "en", "s", 7), (None, "lost", "en", "s", 4)], docs.schema)
    docs = docs.unionByName(more)
    for name in ("score", "predicted", "n_lines", "n_dropped", "kept", "component_id", "key", "copy", "first", "last", "shard", "tile"):
        docs = docs.withColumn(name, F.concat(F.lit(name), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs.coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


def test_pipeline_stages_keep_columns(spark, small):
    """Each stage but the last keeps all columns with their values, and drops only what its operator drops."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, small)
        assert out.columns == names
        out.write.parquet(f"{small}/out-{k}")
        before, docs = docs, spark.read.parquet(f"{small}/out-{k}")
        for r in docs.collect():
            i = "none" if r.doc_id is None else r.doc_id
            assert all(r[c] == f"{c}-{i}" for c in names[5:])
            assert name not in ("line_dedup", "passage_dedup") or r.n_chars == (None if r.text is None else len(r.text))
        if name in ("line_dedup", "passage_dedup"):
            assert docs.count() == before.count()
        if name == "near_dedup":
            groups = {r.doc_id: r.kept for r in neardup.near_duplicates(before).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, kept in groups.items() if kept}
    packed = P.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_pipeline_of_nothing(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet").where("false")
    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs, small).count() == 0
