from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, strategies as st

from panelflow.llm.warc import capture_history, loser_tree, members, order, parse, record, url_key

import zlib


def test_awkward_pages(spark):
    rows = [(1, "http://a.b/c", "same"), (2, "https://www.A.b/c#x", "same"), (3, None, None), (4, "not a url\r\nX: y", ""), (5, "http://é.de/ü?b=2&a=1", "x" * 300_000),
            (6, "http://[bad", "line\r\n\r\nWARC/1.1\r\n"), (7, "http://a.b/c", "same"), (7, "http://a.b/c", "same"), (None, "http://z", "lone"), (None, "http://a", "same")]
    pages = spark.createDataFrame([(*r, "extra", 1) for r in rows], "page_id long, url string, html string, archive string, keep int").repartition(3)
    got = capture_history(pages, archive_bytes=2_000).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = Counter()
    for i, _, html in rows:
        equal = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        keep = max(equal) if equal else None
        want[(i, len((html or "").encode()), digest(html or ""), "response" if i == keep else "revisit", None if i == keep else keep)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    keys = [order(r.asDict()) for r in got]
    assert keys == sorted(keys)
    assert capture_history(pages.limit(0)).collect() == []


def test_history_is_ordered_and_whole(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = capture_history(pages, archive_bytes=20_000).collect()
    assert [order(r.asDict()) for r in got] == sorted(order(r.asDict()) for r in got)
    assert sorted(r["page_id"] for r in got) == sorted(r["page_id"] for r in pages.collect())
    assert len({r["archive"] for r in got}) > 2


@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    assert list(loser_tree([sorted(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_records_round_trip_and_damage_is_seen():
    rng = random.Random(1)
    payloads = [rng.randbytes(n) for n in (0, 1, 200_000)] + [b"\r\n\r\n"]
    archive = b"".join(zlib.compress(record(k, f"http://h/{k}", p, base64.b32encode(hashlib.sha1(p).digest()).decode(), None), 3, 31) for k, p in enumerate(payloads))
    read = list(members(archive))
    assert [parse(b)["payload_bytes"] for _, _, b in read] == [len(p) for p in payloads]
    assert sum(n for _, n, _ in read) == len(archive)
    body = bytearray(read[2][2])
    body[-100] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        parse(bytes(body))
    with pytest.raises(ValueError, match="ends within"):
        list(members(archive[:-9]))


def test_url_keys():
    assert url_key("https://www.Example.com/A?b=2&a=1#f") == url_key("http://example.com/a?a=1&b=2") == "com,example)/a?a=1&b=2"
    assert url_key("") == ")/"
