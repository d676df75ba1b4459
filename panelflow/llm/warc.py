"""WARC archives of pages, and their capture index by an external merge of sorted runs.

Writing: equal payloads are found by SHA-1; the row with the largest id becomes a response, the
others revisits that refer to it.  Each task writes gzip-per-record archives of about
``ARCHIVE_BYTES`` into the shared folder under names of its own attempt; the manifest lists those of
tasks that ended well, so files of lost attempts are never read.
Reading: an archive is parsed record by record and gives one run of captures sorted by
(URL key, timestamp, id).  Runs are dealt by key ranges (a hot URL is split by timestamp and id), and each range merges its
slices of all runs with a loser tree into the globally ordered capture history.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import parse_qsl, quote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelflow.operators.sized import new_folder, written

ARCHIVE_BYTES = 16 << 20
RANGE_ROWS = 200_000
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
CAPTURE = (
    "url_key string, timestamp string, page_id {kind}, payload_bytes long, payload_digest string, record_type string, "
    "refers_to {kind}, url string, archive string, offset long, length long"
)
COLUMNS = [c.split()[0] for c in CAPTURE.split(", ")]


def url_key(url: str) -> str:
    """Reversed host, then path and sorted query, lower case; scheme, www, port and fragment do not count."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f"!{url.lower()}"
    query = urlencode(sorted(parse_qsl(parts.query, keep_blank_values=True)))
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + query if query else ''}".lower()


def capture_time(page_id: int | None) -> str:
    """The tables hold no capture time: ids count minutes from the epoch of the crawl, wrapping after about 20 years."""
    return (EPOCH + timedelta(minutes=(page_id or 0) % 10_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP head alone."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~''')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(raw: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and contents of each gzip member of an archive."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        unzip, parts, pos = zlib.decompressobj(31), [], at
        while not unzip.eof:
            piece = view[pos : pos + 65536]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            parts.append(unzip.decompress(piece))
            pos += len(piece)
        end = pos - len(unzip.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(body: bytes) -> dict:
    """What a record says; a response's digest and length are those of the payload that was read."""
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http.rsplit(b": ", 1)[1])
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (found, len(payload)) != (digest, size):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "url_key": url_key(fields["WARC-Target-URI"]), "timestamp": fields["WARC-Date"], "page_id": number(fields["WARC-Record-ID"]),
        "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "url": fields["WARC-Target-URI"],
    }


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; the manifest: archive, records."""
    plain = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    plain = plain.withColumn("sha", F.unhex(F.sha1("payload")))
    repeated = plain.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("keep")).filter("n > 1").select("sha", "keep")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    rows = plain.join(written(repeated), "sha", "left").select(F.col("page_id").cast("string"), "url", "payload", "sha", refers.cast("string").alias("refers_to"))  # as text, or nulls would make them doubles

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(folder)
        out, name, done, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, sha, refers_to in batch.itertuples(index=False):
                if out is None:
                    name, done, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                page_id, refers_to = (None if pd.isna(x) else int(x) for x in (page_id, refers_to))
                digest = base64.b32encode(sha).decode()
                zipped = zlib.compress(record(page_id, url, payload, digest, refers_to), 3, 31)
                out.write(zipped)
                done, size = done + 1, size + len(zipped)
                if size >= archive_bytes:
                    out.close()
                    out = None
                    yield pd.DataFrame({"archive": [name], "records": [done]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [name], "records": [done]})

    typed = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # whole numbers beside nulls
    return written(typed.mapInPandas(write, "archive string, records long"))


def read_runs(manifest: DataFrame, folder: str, kind: str) -> DataFrame:
    """The captures of every archive of the manifest, one sorted run per archive."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").load(f"{folder}/*.warc.gz").select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, raw in batch.itertuples(index=False):
                run = [parse(body) | {"archive": archive, "offset": at, "length": n} for at, n, body in members(raw)]
                run.sort(key=order)
                yield pd.DataFrame(run, columns=COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})

    return files.join(manifest.select("archive"), "archive", "left_semi").mapInPandas(read, CAPTURE.format(kind=kind))


def order(capture: dict) -> tuple:
    page = capture["page_id"]
    return capture["url_key"], capture["timestamp"], page is not None, page or 0, capture["archive"], capture["offset"]


def loser_tree(runs: list[list], key) -> Iterator:
    """Merge sorted runs: inner nodes hold the loser of their match, one path is replayed per row."""
    k = len(runs)
    if not k:
        return
    heads = [iter(r) for r in runs]
    rows = [next(h, None) for h in heads]
    keys = [None if r is None else key(r) for r in rows]
    beats = lambda a, b: keys[a] is not None and (keys[b] is None or keys[a] <= keys[b])
    losers, winners = [0] * k, [0] * (2 * k)
    for leaf in range(k):
        winners[k + leaf] = leaf
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while keys[best] is not None:
        yield rows[best]
        rows[best] = next(heads[best], None)
        keys[best] = None if rows[best] is None else key(rows[best])
        node = (k + best) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def merge_runs(captures: DataFrame, kind: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures ordered by (url_key, timestamp, page_id) within and across partitions."""
    captures = written(captures)
    ranges = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // range_rows))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.astype(object).where(batch.notna(), None).to_dict("records"):
                runs.setdefault(row["archive"], []).append(row)
        for run in runs.values():
            run.sort(key=order)  # a slice arrives in order as a rule; then this is one look at it
        out = []
        for row in loser_tree(list(runs.values()), order):
            out.append(row)
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})
                out = []
        if out:
            yield pd.DataFrame(out, columns=COLUMNS).astype({"page_id": "Int64", "refers_to": "Int64"})

    dealt = captures.repartitionByRange(ranges, "url_key", "timestamp", "page_id")
    typed = dealt.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    whole = typed.mapInPandas(lambda batches: merge(_numbers(b) for b in batches), CAPTURE.format(kind=kind))
    return whole


def _numbers(batch: pd.DataFrame) -> pd.DataFrame:
    return batch.assign(**{c: pd.array([None if x is None else int(x) for x in batch[c]], "Int64") for c in ("page_id", "refers_to")})


def capture_history(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages, read them back, merge the index: one row per page, globally ordered.

    Columns: url_key, timestamp, page_id, payload_bytes, payload_digest, record_type, refers_to,
    url, archive, offset, length.  Null html counts as empty, a null url as the empty one.  Of equal payloads (empty ones too) the row
    with the largest id is the response; rows that repeat that id are responses as well; null ids
    are revisits unless no equal payload has an id.  Other columns of the input play no part.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    folder = new_folder(spark, "warc")
    from pyarrow.fs import FileSystem

    store, root = FileSystem.from_uri(folder)
    store.create_dir(root)
    manifest = write_archives(pages, folder, archive_bytes)
    if manifest.isEmpty():
        return spark.createDataFrame([], CAPTURE.format(kind=kind))
    return merge_runs(read_runs(manifest, folder, kind), kind)
