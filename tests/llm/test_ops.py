"""Operators against brute force, libraries and round trips; and on nulls, empty texts, ties, repeats and empty tables."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.llm import flac, licenses, linedup, neardup, packing, pieces, repeats, topk, toxicity, warc

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def edge_texts():
    long, near = prose(1, 5000), prose(2, 120).split()
    other = [*near[:60], "changed", *near[61:]]
    shared = prose(3, 60)
    return [None, "", " ", "a", "ß É 日本語 😀", long, long, " ".join(near), " ".join(other), " ".join(near).upper(), prose(4, 80) + "\n" + shared, prose(5, 80) + "\n" + shared, "Released under the MIT License.\nx", "x\x00y\x1cz", "one two three four", "one  two\tthree four"]


@pytest.fixture(scope="module")
def docs(spark):
    t = edge_texts()
    rows = [(i, x) for i, x in enumerate(t)] + [(5, t[5]), (None, t[7]), (None, None)]
    # Extra columns with names that operators use inside.
    return spark.createDataFrame([(i, x, 1.5, "k", [1]) for i, x in rows], "doc_id long, text string, score double, key string, keys array<int>").cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_loser_tree():
    for k in (1, 2, 9, 16):
        runs = [sorted(np.random.default_rng(i).integers(0, 50, i % 4 * 7).tolist()) for i in range(k)]
        assert list(warc.loser_tree_merge([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))
    assert list(warc.loser_tree_merge([], lambda x: x)) == []


@pytest.mark.parametrize("fan_in", [2, 1024])
def test_warc(spark, tmp_path, fan_in):
    big = "<p>" + "x" * 200 + "\r\n\r\n"
    rows = [(3, "http://b.org/x?y=1", big), (1, "http://www.a.org/", big), (2, None, None), (4, "bad url\n", "é"), (5, "http://a.org/", ""), (None, "http://a.org/", big), (1, "http://www.a.org/", big), (6, "http://a.org/", "é"), (7, "http://c.org/", "y" * 300_000)]
    rows += [(i, "http://hot.org/", f"page {i % 50}" * 20) for i in range(10, 700)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    archives = warc.write_archives(pages, f"file://{tmp_path}/w", records_per_file=100, file_bytes=5000)
    assert archives.where("records > 100").count() == 0 and archives.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.merge_indexes(warc.index_archives(archives, f"file://{tmp_path}/r"), f"file://{tmp_path}/r", fan_in).collect()
    keys = [warc._sort_key(tuple(r)) for r in got]
    assert len(got) == len(rows) and keys == sorted(keys)
    by = {r.page_id: r for r in got}
    assert by[3].record_type == "revisit" and by[3].refers_to == 1 and by[3].payload_digest == hashlib.sha256(big.encode()).hexdigest()
    assert by[1].record_type == by[6].record_type == by[2].record_type == "response" and by[2].payload_bytes == 0 and by[4].payload_bytes == 2
    assert by[65].refers_to == 15 and by[7].payload_bytes == 300_000
    for i in (1, 7, 65, 699):  # a record is read from its offset, and nothing else
        headers, block = warc.read_record(by[i].archive, by[i].record_offset, by[i].record_length)
        assert headers["warc-record-id"] == f"<urn:page:{i}>" and headers["warc-type"] == by[i].record_type
        assert i != 7 or block.endswith(b"\r\n\r\n" + b"y" * 300_000)
    none = warc.write_archives(pages.where("false"), f"file://{tmp_path}/e")
    assert warc.merge_indexes(warc.index_archives(none, f"file://{tmp_path}/f"), f"file://{tmp_path}/f").count() == 0
    name = by[1].archive.removeprefix("file://")
    content = open(name, "rb").read()
    with open(name, "wb") as f:
        f.write(content[:-6])
    with pytest.raises(Exception, match="does not end"):
        warc.index_archives(archives, f"file://{tmp_path}/g")


def test_top_k(spark):
    rng = np.random.default_rng(0)
    m = rng.integers(-3, 4, (300, 5))
    ids = np.arange(300)
    q, v, s = topk.top_k(ids[::20], m[::20], ids, m, 7, block=16)
    for i in ids[::20]:
        want = sorted((-int(m[i] @ m[j]), j) for j in ids if j != i)[:7]
        assert list(zip((-s[q == i]).tolist(), v[q == i].tolist(), strict=True)) == want
    rows = [(0, [1.0, 0.5]), (20, None), (1, [float("nan"), 1.0]), (2, [1.0, None]), (3, [1.0]), (4, []), (None, [1.0])]
    d = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k_search(d.where("vec_id % 20 = 0"), d).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 3, 4096), (0, 2, 4, 0)]
    assert topk.top_k_search(d.where("false"), d).count() == 0


def test_top_k_ties_and_pruning(spark):
    """Equal scores go to smaller ids, repeated ids count each; on clustered rows most are not scored."""
    same = spark.createDataFrame([(i // 2, [1.0, 1.0]) for i in range(50)], "vec_id long, embedding array<float>").withColumn("lead", F.lit("x"))
    d = topk.quantized(same)
    got = topk.top_k_search(d.where("vec_id % 20 = 0").distinct(), d, 5, rows=8, query_rows=4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(q, i + 1, v, 8192) for q in (0, 20) for i, v in enumerate([1, 1, 2, 2, 3] if q == 0 else [0, 0, 1, 1, 2])]
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 32))
    x = centres[rng.integers(0, 20, 1500)] + 0.1 * rng.standard_normal((1500, 32))
    d = topk.quantized(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")).cache()
    q = d.where("vec_id % 20 = 0")
    pairs, scored = topk.top_k_search(q, d, 5, rows=100, query_rows=30, stats=True).agg(F.sum("pairs"), F.sum("scored")).first()
    assert scored < 0.5 * 75 * 1500 and scored <= pairs
    m = np.floor(64 * x).astype(int)
    want = {(i, r + 1, j, int(m[i] @ m[j])) for i in range(0, 1500, 20) for r, j in enumerate(sorted((j for j in range(1500) if j != i), key=lambda j: (-int(m[i] @ m[j]), j))[:5])}  # noqa: B023
    assert {tuple(r) for r in topk.top_k_search(q, d, 5, rows=100, query_rows=30).collect()} == want


def test_flac(spark, docs, empty):
    data = [b"", b"a", b"hello " * 900, bytes(5000), np.random.default_rng(0).integers(0, 256, 3000).astype(np.uint8).tobytes(), (b"\0" * 900 + b"\xff" * 100) * 4]
    coded = flac.encode(data)
    assert flac.decode(coded) == data
    broken = bytearray(coded[2])
    broken[-20] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(broken)])
    head, seek = coded[2].index(b"\x83"), 0
    seek = 4 + int.from_bytes(coded[2][head + 1 : head + 4], "big")
    bare = bytearray(coded[2][:head] + coded[2][head + seek :])
    bare[4] |= 0x80  # without seek points frames are found by their checksums
    assert flac.decode([bytes(bare)]) == [data[2]]
    got = {r.doc_id: r for r in flac.features(flac.media(docs)).where("doc_id IS NOT NULL").collect()}
    for i, t in enumerate(edge_texts()):
        p = flac.padded((t or "").encode())
        assert got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].tail_crc32 == zlib.crc32(p[-64:]) and got[i].n_bytes == len((t or "").encode())
    blocks = flac.pcm_blocks(flac.media(docs.where("doc_id = 5").limit(1)), 1000).orderBy("first_sample").collect()
    assert [b.first_sample for b in blocks] == list(range(0, len(blocks) * 1000, 1000)) and b"".join(b.pcm for b in blocks) == flac.padded(edge_texts()[5].encode())
    assert flac.features(flac.media(empty)).count() == 0


ODD = ["", " ", "  a  b ", "x\x1cy z", "İ Σας ΟΔΟΣ", "it's they'll 123 4.5,6 !?.. a.,", "a　b c​d", "▁a▁▁b", "日本語 😀", "\n\n tab\t", "a\x00b", "<s> </s><unk> <0x0A>", "é ﬁ", "don't.. end. END, x;y: '", "a.́ b", "ß, SS. µ.", "\xa0x\x85y"]


def test_sentencepiece(docs, empty):
    m = pieces.model(pieces.default_model())
    rng = np.random.default_rng(6)
    alphabet = [*ODD, "▁", " ", "  ", "\n", ".", ",", "é", "ing", "the", "<0x41>", "\u0301", "\ufffd", "\ud7ff", "\U0001f600", "1", "tion"]
    mixed = ["".join(rng.choice(alphabet, int(n))) for n in rng.integers(1, 12, 400)]
    for t in [*ODD, *(x or "" for x in edge_texts()), *mixed]:
        assert m.encode(t) == m.library.encode(t)
        assert all(m.merged_short(c) == m.merged_long(c) for c in m.chunks(m.normalized(t)))
    got = {r.doc_id: r for r in pieces.encoded(docs, pieces.default_model()).where("doc_id IS NOT NULL").collect()}
    ids = m.library.encode(edge_texts()[5])
    assert got[5].n_tokens == len(ids) and got[5].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got[0].n_tokens == 0
    for i, t in enumerate(edge_texts()):
        assert got[i].decoded_sha256 == hashlib.sha256(m.library.decode(m.library.encode(t or "")).encode()).hexdigest()
    assert pieces.encoded(empty, pieces.default_model()).count() == 0


def test_tokenizer_words():
    w = packing.Words(packing.default_tokenizer())
    for t in [*ODD, *(x or "" for x in edge_texts())]:
        ids = w.tokenizer.encode(t, add_special_tokens=False).ids
        assert w.ids([t])[0] == struct.pack(f"<{len(ids)}I", *ids)


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = 60
    counts = {int(n): int(rng.integers(1, 30)) for n in rng.integers(1, capacity + 1, int(rng.integers(1, 40)))}
    runs, bins = packing.plan(counts, capacity)
    fill = collections.defaultdict(list)
    for n, _, count, first, offset in runs:
        for i in range(count):
            fill[first + i].append((offset, n))
    assert collections.Counter(n for b in fill.values() for _, n in b) == counts and len(fill) == bins
    for b in fill.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    total = -(-sum(n * c for n, c in counts.items()) // capacity)
    assert bins <= max(total, sum(c for n, c in counts.items() if 2 * n > capacity)) * 1.25 + 2


def test_packing(docs, empty):
    got = packing.pack_documents(docs, packing.default_tokenizer(), 64).collect()
    w = packing.Words(packing.default_tokenizer())
    want = sorted((-1 if i is None else i, len(w.ids([t or ""])[0]) // 4 + 1) for i, t in [(r.doc_id, r.text) for r in docs.collect()])
    have = collections.Counter()
    for r in got:
        have[-1 if r.doc_id is None else r.doc_id] += r.length
    merged = collections.Counter()
    for i, n in want:
        merged[i] += n
    assert have == merged
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for b in by.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack_documents(empty, packing.default_tokenizer()).count() == 0


def test_near_duplicates(docs, empty):
    got = neardup.near_duplicates(docs).collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == docs.count() and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    sets = {}
    for i, t in enumerate(edge_texts()):
        w = re.findall(r"[^ \t\n\x0b\x0c\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: r.component_id for i, r in by.items()} == root and {i: r.n_shingles for i, r in by.items()} == {i: len(s) for i, s in sets.items()}
    assert neardup.near_duplicates(empty).count() == 0


def test_tiles_meet_each_pair_once():
    """A region of near sets, dealt out in blocks, gives each pair of different nodes once, but for those of the main node."""
    n = 40
    sets = [np.sort(neardup.mix(np.arange(i + 1, i + 101, dtype=np.uint64))) for i in range(n)]
    short = ((neardup.signatures(sets) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    enter = short.reshape(n, neardup.TREES, neardup.DEPTH)[:, :, : neardup.ENTER]
    main = np.array([i % 3 == 0 for i in range(n)])
    block = np.where(main, 0, 1 + np.arange(n) % 2)
    seen = collections.Counter()
    schema = pa.schema([("tile", pa.int64()), ("tree", pa.int32()), ("rep", pa.int64()), ("size", pa.int64()), ("node", pa.int64()), ("block", pa.int32()), ("main", pa.int32()), ("own", pa.int32()), ("labels", pa.binary())])
    rows, tile = [], 0
    for tree in range(neardup.TREES):
        regions = collections.defaultdict(list)
        for i in range(n):
            regions[enter[i, tree].tobytes()].append(i)
        for members in regions.values():
            for x, y in ((0, 1), (0, 2), (1, 1), (1, 2), (2, 2)):
                tile += 1
                rows += [(tile, tree, i, 100, 0 if main[i] else i + 1, int(block[i]), int(main[i]), int(x == y), short[i].tobytes()) for i in members if block[i] in (x, y)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    ids, cuts = batch.column(2).to_pylist(), [0, *(k for k in range(1, len(rows)) if rows[k][0] != rows[k - 1][0]), len(rows)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        for x, o in neardup.crossing(pa.Table.from_batches([batch]), i, j, 75):
            for y in o.tolist():
                seen[min(ids[i + x], ids[i + y]), max(ids[i + x], ids[i + y])] += 1
    assert set(seen.values()) == {1} and all(not (main[i] and main[j]) for i, j in seen)
    assert {(i, j) for i in range(n) for j in range(i + 1, min(n, i + 9)) if not (main[i] and main[j])} <= set(seen)


def test_parts_of_a_sorted_order():
    """However an order is dealt out, neighbours within parts and across their ends are those of the whole."""
    rng = np.random.default_rng(4)
    rows = sorted((int(t), rng.integers(0, 2, 8).astype(np.uint16).tobytes(), int(i), 10) for i, t in enumerate(rng.integers(0, 3, 200)))

    def walk(part, p):
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=list("abcd"))
        return [r for b in neardup.walked([batch.slice(0, 3), batch.slice(3)], p, 75) for r in b.to_pylist()]

    whole = walk(rows, 0)
    near = lambda rs: {(r["a"], r["b"]) for r in rs if r["kind"] == neardup.NEIGHBOURS}
    assert near(whole) == {(min(x[2], y[2]), max(x[2], y[2])) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and x[1][:8] == y[1][:8]}
    cuts = [0, 1, 2, 40, 41, 130, 200]
    parts = [walk(rows[i:j], p) for p, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]
    across = {(min(rows[c - 1][2], rows[c][2]), max(rows[c - 1][2], rows[c][2])) for c in cuts[1:-1]}
    assert near(whole) - across == set().union(*map(near, parts))
    edges = [r for p in parts for r in p if r["kind"] >= neardup.FIRST]
    assert [r["a"] for r in sorted(edges, key=lambda r: (r["part"], r["kind"]))] == [rows[i][2] for x, y in zip(cuts, cuts[1:], strict=False) for i in (x, y - 1)]
    member = lambda rs: {(r["a"], r["tree"]) for r in rs if r["kind"] in (neardup.MEMBER, neardup.LAST)}
    assert member(whole) <= set().union(*map(member, parts))


def repeats_by_force(rows):
    """(doc_id or -1, bytes, removed, runs, what is left) of every text."""
    count = collections.Counter(t[j : j + 200] for _, t in rows for j in range(len(t) - 199))
    want = []
    for i, t in rows:
        m = np.zeros(len(t) + 2, np.int8)
        for j in range(len(t) - 199):
            if count[t[j : j + 200]] > 1:
                m[j + 1 : j + 201] = 1
        want.append((-1 if i is None else i, len(t), int(m.sum()), int((np.diff(m) == 1).sum()), bytes(np.frombuffer(t, np.uint8)[m[1:-1] == 0])))
    return sorted(want)


@pytest.mark.parametrize("hot", [0, 3, 1024])
def test_repeats(spark, docs, empty, monkeypatch, tmp_path, hot):
    """The query's columns against brute force; hot: 0 makes all shards banded and then counted string by string."""
    monkeypatch.setattr(repeats, "HOT", hot)
    rng = np.random.default_rng(7)
    base = prose(21, 300)
    near = [base[:k] + "#" + base[k + 1 :] for k in rng.integers(0, len(base), 12).tolist()]
    periods = ["a" * 900, "ab" * 500, "abc " * 300, ("x" * 150 + "y" * 77) * 5, prose(22, 40) * 6]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + i, t) for i, t in enumerate(near + periods)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = repeats_by_force([(i, (t or "").encode()) for i, t in rows])
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op10_repeats(spark, str(tmp_path)).collect())
    assert got == sorted((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want)
    if hot > 3:
        cut = {r.doc_id: r.text for r in repeats.cleaned(docs).where("doc_id > 5").collect()}
        own = repeats_by_force([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
        assert cut[10] == next(w[4] for w in own if w[0] == 10).decode() and repeats.cleaned(docs).columns == docs.columns
        assert repeats.cleaned(empty.select("doc_id", "text")).count() == 0


def test_suffix_ranks():
    """Ranks of dictionary suffixes are those of sorting them."""
    rng = np.random.default_rng(2)
    words = [bytes(rng.integers(0, 3, int(n)).astype(np.uint8)) for n in rng.integers(0, 60, 40)] + [b"", b"\x00" * 30, b"\xff" * 9]
    rank, starts = repeats.suffix_ranks(words)
    all_ = [(w[i:], int(rank[s + i])) for w, s in zip(words, starts.tolist(), strict=True) for i in range(len(w) + 1)]
    order = {w: i for i, w in enumerate(sorted({w for w, _ in all_}))}
    assert sorted({order[w]: r for w, r in all_}.items()) == sorted({(order[w], r) for w, r in all_})
    by = sorted((order[w], r) for w, r in all_)
    assert all((x[0] < y[0]) == (x[1] < y[1]) for x, y in zip(by, by[1:], strict=False))


def test_line_dedup(spark, empty):
    rows = [(i, f"{prose(i, 9)}\nUser {i} came in at {i}:00 today\nAll rights reserved.\n") for i in range(12)] + [(12, None), (13, ""), (0, f"{prose(0, 9)}\nUser 0 came in at 0:00 today\nAll rights reserved.\n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x"))
    got = linedup.drop_recurring_lines(d).collect()
    assert all(r.key == "x" and r.text == f"{prose(r.doc_id, 9)}\n" and r.n_dropped == 2 for r in got if r.doc_id < 12) and len(got) == 15
    assert {(r.doc_id, r.text, r.n_lines) for r in got if r.doc_id > 11} == {(12, None, 0), (13, "", 1)}
    kept = linedup.drop_recurring_lines(d, keep_first=True).where("doc_id = 3").first()
    assert kept.n_dropped == 2
    assert linedup.drop_recurring_lines(empty.select("doc_id", "text")).count() == 0


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert got[12].licenses == "MIT" and got[12].best_permille == 1000 and got[0].licenses == "" and got[5].n_matches == 0
    assert licenses.scan(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(600):
        w = list(rng.choice(WORDS, int(rng.integers(3, 120))))
        bad = i % 3 == 0
        if bad:
            w[int(rng.integers(len(w)))] = f"grobst{rng.integers(10_000)}" if i % 2 else "nitwit"
        texts.append(" ".join(w))
        labels.append(int(bad))
    net = toxicity.fit(texts[:450], labels[:450])
    score = net.scores(pa.array(texts[450:]))
    assert ((score >= 0.5) == np.array(labels[450:])).mean() > 0.95
    got = toxicity.scored(docs, net)
    assert got.columns.count("score") == 1 and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert toxicity.scored(empty, net).count() == 0 and 0 < toxicity.fit([], []).scores(pa.array([""]))[0] < 0.5
    held = spark.range(40).select(F.col("id").alias("doc_id")).withColumn("h", toxicity.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)


def test_pipeline(spark):
    """Stages keep columns, and what each drops is what its operator says."""
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "passage_dedup", "packing"]
    out = P.run(spark, sf).collect()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert out and {r.doc_id for r in out} <= ids and all(r.offset + r.length <= 4096 for r in out)
