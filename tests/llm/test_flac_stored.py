"""op9 reads back what it has stored, block by block."""

import hashlib
import zlib

import numpy as np

from lattica.llm import flac


def test_op9_reads_a_stored_table(spark, tmp_path):
    texts = [(1, "a b c " * 50), (1, "a b c " * 50), (2, ""), (3, None), (None, "x" * 64), (4, "Größe\n" * 400)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = flac.op9_flac(spark, str(tmp_path))
    files = got.inputFiles()
    assert files and all("lattica-media-" in f for f in files)
    rows = sorted(map(tuple, got.collect()), key=str)

    def want(i, t):
        raw = (t or "").encode()
        p = flac.padded(raw)
        m = flac.encode([p])[0]
        x = np.frombuffer(p, np.uint8).astype(int) - 128
        about = f"samples={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={np.abs(x).max()}"
        return i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), about

    assert rows == sorted((want(*t) for t in texts), key=str)
    stored = flac.media(spark.createDataFrame(texts, "doc_id long, text string"))
    for block in (1, 50, 64, 1000):
        assert sorted(map(tuple, flac.features(stored, block).collect()), key=str) == rows
