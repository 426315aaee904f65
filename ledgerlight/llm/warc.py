"""WARC archives written and read back, with an external merge of their capture indexes.

Records are written by Spark's own text writer with CRLF CRLF between them, which is the record end of
the format, as gzip files in the shared folder. Of records with equal payloads of at least
``min_bytes`` bytes the one with the largest page_id is a response and the others revisit it.

Each archive that is read back gives one capture run sorted by URL key and time. Runs are stored, cut
into ranges of (URL key, time, page_id), and every range merges its stretches of the runs by a loser
tree, so that ranges in order hold the whole capture history. A hot URL is split over ranges by time.

Defined cases: a null html is an empty payload; a null url has the empty URL key and no target header;
a null page_id is never the largest (payloads whose ids are all null stay responses) and is returned
as null; rows that repeat the largest page_id with the same payload are all responses; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored

RECORD_END = "\r\n\r\n"
#: Records of an archive at most, so that one archive fits in a task.
ARCHIVE_RECORDS = 5_000
CAPTURES = (
    "run string, url_key string, captured string, page_id long, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long, record_offset long"
)
EPOCH = 1_700_000_000


def marked(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, html with the payload's size and digest and the page that a revisit refers to."""
    html = F.coalesce(F.col("html"), F.lit(""))
    payload = F.encode(html, "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha1(payload).alias("digest"))
    copies = rows.filter(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    # Written first, so that its true size decides how it is joined.
    copies = stored(copies.filter("n > 1").drop("n"), "warc-copies")
    joined = rows.join(copies, ["digest", "size"], "left")
    return joined.withColumn("refers_to", F.when(F.col("keeper") > F.coalesce("page_id", F.lit(-(1 << 63))), F.col("keeper"))).drop("keeper")


def _record(captured: Column) -> Column:
    """The text of a WARC/1.1 record; a revisit has the payload's headers without the payload."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(RECORD_END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    # A target address is one header line: control characters and spaces are escaped.
    url = F.regexp_replace(F.regexp_replace("url", r"[\r\n\t ]", "%20"), r"[\x00-\x1f\x7f]", "%00")
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: "), captured,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END), block,
    )


def write_archives(pages: DataFrame, min_bytes: int = 1000, path: str | None = None) -> str:
    """Writes all records and returns the folder of the archives."""
    path = path or new_path(pages.sparkSession, "warc")
    # The table has no times: a page's capture time follows from its id.
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))
    captured = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = marked(pages, min_bytes).select(_record(captured).alias("value"))
    writer = rows.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS)
    writer.text(path)
    return path


def url_key(url: str) -> str:
    """Host labels reversed, then port, path and query, in lower case and without the fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.lower()
    labels = ",".join(reversed(host.removeprefix("www.").split(".")))
    port_text = f":{port}" if port and port not in (80, 443) else ""
    return f"{labels}{port_text}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record, framed by its Content-Length."""
    at, end = 0, RECORD_END.encode()
    while at < len(data):
        head = data.index(end, at)
        lines = data[at:head].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record starts at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start = head + len(end)
        stop = start + int(headers["Content-Length"])
        if data[stop : stop + len(end)] != end:
            raise ValueError(f"the record at byte {at} isn't closed")
        yield at, headers, data[start:stop]
        at = stop + len(end)


def _page(header: str | None) -> int | None:
    name = (header or "null>").rpartition(":")[2].rstrip(">")
    return None if name == "null" else int(name)


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha1

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows = []
            for at, head, block in parse_records(zlib.decompress(content.as_py(), 31)):
                http, _, payload = block.partition(RECORD_END.encode())
                size, digest = int(http.rpartition(b": ")[2]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and (len(payload) != size or sha1(payload).hexdigest() != digest):
                    raise ValueError(f"the payload of the record at byte {at} is damaged")
                rows.append((url_key(head.get("WARC-Target-URI", "")), head["WARC-Date"], _page(head["WARC-Record-ID"]), size, digest, head["WARC-Type"], _page(head.get("WARC-Refers-To")), at))
            if rows:
                rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
                keys, times, pages, sizes, digests, kinds, refers, ats = zip(*rows)
                yield pa.record_batch([
                    pa.array([path.as_py()] * len(rows)), pa.array(keys), pa.array(times), pa.array(pages, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(digests), pa.array(kinds), pa.array(refers, pa.int64()), pa.array(ats, pa.int64()),
                ], ["run", "url_key", "captured", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_offset"])


def capture_runs(spark, path: str) -> DataFrame:
    """The captures of all archives below ``path``: one sorted run for each archive."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return archives.mapInArrow(_captures, CAPTURES)


def merge_order(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, place) of the rows of sorted runs in merged order, by a loser tree; equal keys come by run."""
    k = len(runs)
    places = [0] * k
    done = (1,)  # after every (0, key, run)

    def head(run: int) -> tuple:
        return (0, runs[run][places[run]], run) if places[run] < len(runs[run]) else done

    # Leaves are nodes k to 2k - 1; node 0 holds the winner, node i the loser of the match played there.
    winners = [done] * k + [head(r) for r in range(k)]
    losers = [done] * k
    for i in range(k - 1, 0, -1):
        winners[i], losers[i] = sorted((winners[2 * i], winners[2 * i + 1]))
    winner = winners[1] if k > 1 else winners[k]
    while winner is not done and winner != done:
        run = winner[2]
        yield run, places[run]
        places[run] += 1
        winner, node = head(run), (k + run) // 2
        while node:
            if losers[node] < winner:
                winner, losers[node] = losers[node], winner
            node //= 2


def _merge_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)).combine_chunks()  # one range; its size is that of a partition
    if not len(table):
        return
    names = table["run"].to_pylist()
    keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), [(x is not None, x or 0) for x in table["page_id"].to_pylist()]))
    cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
    runs = [keys[a:b] for a, b in zip(cuts, cuts[1:])]
    order = np.array([cuts[r] + i for r, i in merge_order(runs)])
    yield from table.take(pa.array(order)).to_batches(max_chunksize=10_000)


def capture_history(spark, path: str) -> DataFrame:
    """All captures of the archives, partitions in order and each merged, so that the whole is ordered by (url_key, captured, page_id)."""
    runs = stored(capture_runs(spark, path), "warc-runs")
    ranged = runs.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("run", "url_key", "captured", "page_id")
    return ranged.mapInArrow(_merge_range, CAPTURES)


def archive_and_index(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Writes a record for each page, reads the archives back and returns the merged captures."""
    history = capture_history(pages.sparkSession, write_archives(pages, min_bytes))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "run", "record_offset")
