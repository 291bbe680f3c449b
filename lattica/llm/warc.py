"""Web archives: write page records, read them back, and merge their indexes into capture histories."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import materialize, new_path, read, tuned

END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "urlkey string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, archive string, record_offset long, record_length long"
INDEX_ARROW = pa.schema([("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()), ("archive", pa.string()), ("record_offset", pa.int64()), ("record_length", pa.int64())])
#: Bounds of an archive file; rows of a run that a merge holds at once; and runs that are merged at once.
FILE_RECORDS, FILE_BYTES, BUFFER, FAN_IN = 4000, 64 << 20, 256, 1024
#: Keys of a run that help to choose the ranges of a merge, and such keys that are looked at.
RUN_KEYS, ALL_KEYS = 32, 65536


def opened(path: str):
    """The file system of a path or URI, and the path in it; whatever pyarrow reaches."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def url_key(url: str) -> str:
    """Sort-friendly key of a URL: host labels reversed, then path and query, in lower case.

    No URL gives the empty key; what cannot be parsed is its own key.
    """
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){u.path or '/'}{'?' + u.query if u.query else ''}".lower()


def write_archives(pages: DataFrame, path: str, *, min_revisit_bytes: int = 100, records_per_file: int = FILE_RECORDS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one WARC record per row of pages(page_id, url, html) to files below path: (archive, records, bytes) of each.

    Of records with equal payloads of min_revisit_bytes or more, that with the smallest page_id is the response and the
    others are revisits, which carry the digest and no payload. Null html is an empty payload, a null url is left out of
    the record, repeated page_ids are ties (all response or all revisit); a null page_id is never referred to. No pages
    make no files. Other columns are ignored.

    Each record is a gzip member of its own, so that it can be read from its offset. A file ends at the bound of records or
    bytes, whichever comes first. What a failed task has left behind is not listed, and so not read.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", body.alias("body"), F.octet_length(body).cast("long").alias("n"), F.sha2(body.cast("binary"), 256).alias("digest"))
    slim = p.where(F.col("n") >= min_revisit_bytes).select("page_id", "digest")
    first = slim.where("page_id IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id")).where("first_id < last_id")
    revisits = slim.join(first, "digest").where("page_id > first_id").select("page_id", "digest", "first_id").distinct()
    # Rows with the html move once, by page_id: a payload that a third of the pages share heats no task.
    p = p.join(revisits, ["page_id", "digest"], "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(F.col("first_id").isNull(), F.concat(http, F.col("body"))).otherwise(http)
    uri = F.when(F.col("url").isNull(), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.lit("\r\n")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    # Pages carry no capture time: seconds from a fixed start, by page_id, stand in for it.
    when = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("first_id").isNull(), "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\n"), uri, F.lit("WARC-Date: "), when,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        F.when(F.col("first_id").isNull(), "").otherwise(F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">\r\n"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block, F.lit(END),
    )

    def write(it) -> Iterator[pa.RecordBatch]:
        files, top = opened(path)
        files.create_dir(top, recursive=True)
        out, name, n, size, done = None, "", 0, 0, []
        for b in it:
            for r in b.column(0):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(f"{top}/{name}", compression=None)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = z.compress(r.as_buffer()) + z.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if n >= records_per_file or size >= file_bytes:
                    out.close()
                    out = None
                    done.append((f"{path}/{name}", n, size))
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", n, size))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "records", "bytes"])

    return materialize(p.select(record.alias("value")).mapInArrow(write, "archive string, records long, bytes long"), "archives")


def members(f, chunk: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an open file; one member is held at a time."""
    at, rest = 0, b""
    while True:
        d, out, used = zlib.decompressobj(31), [], 0
        while not d.eof:
            if not rest and not (rest := f.read(chunk)):
                if used:
                    raise ValueError(f"the gzip member at {at} does not end")
                return
            out.append(d.decompress(rest))
            used += len(rest) - len(d.unused_data)
            rest = d.unused_data
        yield at, used, b"".join(out)
        at += used


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head = record.find(b"\r\n\r\n")
    version, *lines = record[: max(head, 0)].decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    end = head + 4 + int(headers["content-length"])
    if record[end:] != b"\r\n\r\n":
        raise ValueError("a member must hold one record, of the length that it states")
    return headers, record[head + 4 : end]


def records(f) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record of an open WARC file whose records are gzip members."""
    for at, n, content in members(f):
        yield at, n, *parsed(content)


def read_record(archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record at an offset, of which an index tells; nothing else of the file is read."""
    files, path = opened(archive)
    with files.open_input_file(path) as f:
        return parsed(zlib.decompress(f.read_at(length, offset), 31))


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _capture(path: str, at: int, length: int, h: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = h["warc-payload-digest"].removeprefix("sha256:")
    if h["warc-type"] == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{path}: payload at {at} does not match its digest")
    url = h.get("warc-target-uri")
    return url_key(url or ""), re.sub(r"\D", "", h["warc-date"]), _page(h["warc-record-id"]), h["warc-type"], _page(h.get("warc-refers-to")), n, digest, url, path, at, length


def _sort_key(r: tuple) -> tuple:
    return r[0], r[1], r[2] is not None, r[2] or 0, r[8], r[9]


def _rows(columns: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*columns, strict=True) if columns else [()] * len(INDEX_ARROW), INDEX_ARROW, strict=True)], schema=INDEX_ARROW)


RUN = "file string, rows long, keys array<struct<urlkey string, captured string, page_id long, archive string, record_offset long>>"
_KEY = pa.struct([("urlkey", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("record_offset", pa.int64())])


def write_run(rows: Iterator[tuple], path: str, n: int) -> pa.RecordBatch:
    """Sorted index rows, about n, as a file below path, in groups of BUFFER rows: a row of RUN."""
    files, top = opened(path)
    files.create_dir(top, recursive=True)
    name, held, keys, done = f"{uuid.uuid4().hex}.parquet", [], [], 0
    with files.open_output_stream(f"{top}/{name}", compression=None) as out, pq.ParquetWriter(out, INDEX_ARROW, compression="zstd") as w:
        for r in rows:
            if done % max(1, n // RUN_KEYS) == 0:
                keys.append({"urlkey": r[0], "captured": r[1], "page_id": r[2], "archive": r[8], "record_offset": r[9]})
            held.append(r)
            done += 1
            if len(held) == BUFFER:
                w.write_batch(_rows(held), row_group_size=BUFFER)
                held = []
        if held:
            w.write_batch(_rows(held))
    return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([done], pa.int64()), pa.array([keys], pa.list_(_KEY))], names=["file", "rows", "keys"])


def index_archives(archives: DataFrame, path: str) -> DataFrame:
    """A run (RUN) of each archive of archives(archive, ...): its index rows, sorted by URL key and time, in a file below path.

    Payload digests are computed again and must match; a broken file raises ValueError. One record is held at a time, and
    the index rows of one archive, whose number is bounded.
    """

    def parse(it) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name in b.column(0).to_pylist():
                files, inside = opened(name)
                with files.open_input_stream(inside, compression=None) as f:
                    rows = sorted((_capture(name, *r) for r in records(f)), key=_sort_key)
                yield write_run(iter(rows), path, len(rows))

    n = max(8, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return materialize(archives.select("archive").repartition(n).mapInArrow(parse, RUN), "runs")


def run_rows(file: str, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """A run's rows from a key on and below another, a buffer at a time; groups of rows before the range are not read."""
    files, inside = opened(file)
    with files.open_input_file(inside) as f:
        p = pq.ParquetFile(f)
        for g in range(p.num_row_groups):
            column = p.metadata.row_group(g).column(0).statistics
            if low and column and column.has_min_max and column.max < low[0]:
                continue
            for r in zip(*(c.to_pylist() for c in p.read_row_group(g).columns), strict=True):
                key = _sort_key(r)
                if high and key >= high:
                    return
                if not low or key >= low:
                    yield r


def loser_tree_merge(runs: list[Iterator], key: Callable) -> Iterator:
    """Merges sorted runs with a tree of losers: one path of log2(k) comparisons for each item, one item of each run held."""
    k = len(runs)
    if not k:
        return
    runs = [iter(r) for r in runs]
    done = object()
    items: list = [next(r, done) for r in runs]
    heads = [done if x is done else key(x) for x in items]

    def less(i: int, j: int) -> bool:
        if i < 0 or j < 0:  # the -1 of the start wins everything
            return i < 0
        if heads[i] is done or heads[j] is done:
            return heads[j] is done and heads[i] is not done
        return (heads[i], i) < (heads[j], j)

    tree = [-1] * k  # tree[0]: the winner; the others: the loser of each match

    def play(w: int) -> None:
        node = (w + k) // 2
        while node:
            if less(tree[node], w):
                w, tree[node] = tree[node], w
            node //= 2
        tree[0] = w

    for i in reversed(range(k)):
        play(i)
    while heads[w := tree[0]] is not done:
        yield items[w]
        items[w] = next(runs[w], done)
        heads[w] = done if items[w] is done else key(items[w])
        play(w)


def merge_indexes(runs: DataFrame, path: str, fan_in: int = FAN_IN) -> DataFrame:
    """All index rows of runs(RUN) in one global order of URL key, time and page: partition i comes before partition i + 1.

    An external merge. While there are more runs than fan_in, so many at a time become one longer run, in a file below path.
    Of the runs that are left, every task merges one range of the order by a tree of losers, from a buffer of each run.
    Ranges are chosen by keys of the runs, and end within a URL where it has many captures, so a hot host or URL is spread.
    Every row stays; order of equal keys is by archive and offset. No runs: no rows.
    """
    spark = runs.sparkSession
    while (n := runs.count()) > fan_in:
        numbers = runs.select("file", "rows", F.floor((F.row_number().over(Window.orderBy("file")) - 1) / fan_in).alias("group"))
        groups = numbers.groupBy("group").agg(F.collect_list("file").alias("files"), F.sum("rows").alias("rows"))  # fan_in names

        def longer(it) -> Iterator[pa.RecordBatch]:
            for b in it:
                for files, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield write_run(loser_tree_merge([run_rows(f, None, None) for f in files], _sort_key), path, rows)

        runs = materialize(groups.select("files", "rows").repartition(-(-n // fan_in)).mapInArrow(longer, RUN), "longer-runs")
    files = sorted(r[0] for r in runs.select("file").collect())  # fan_in names at most
    keys = runs.select(F.explode("keys").alias("k")).select("k.*").orderBy(F.xxhash64("archive", "record_offset")).limit(ALL_KEYS).collect()
    keys = sorted((r[0], r[1], r[2] is not None, r[2] or 0, r[3], r[4]) for r in keys)
    parts = max(1, min(len(keys), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ends = [None, *(keys[i * len(keys) // parts] for i in range(1, parts)), None]

    def merge(it) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in b.column(0).to_pylist():
                out = []
                for r in loser_tree_merge([run_rows(f, ends[i], ends[i + 1]) for f in files], _sort_key):
                    out.append(r)
                    if len(out) == 4000:
                        yield _rows(out)
                        out = []
                yield _rows(out)

    return spark.range(0, parts, 1, parts).mapInArrow(merge, INDEX)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page, repeated ones too, from archives written and read back, in the merged order of their indexes."""
    tuned(spark)
    archives = write_archives(read(spark, sf_dir, "pages"), new_path(spark, "warc"))
    path = new_path(spark, "runs")
    runs = index_archives(archives, path)
    return merge_indexes(runs, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS n, sha256(body) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM d)
SELECT f.page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first_id < f.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first_id < f.page_id THEN first_id END AS refers_to
FROM f
"""
