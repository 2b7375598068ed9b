import gzip
import hashlib
import io
import json
from pathlib import Path

import pytest

from cohortry.llm.registry import QUERIES
from cohortry.llm.warc import archive_pages, inflated, parse_record, record_bytes, records_of

SCHEMA = "page_id long, url string, html string, payload string, digest string"


def rows():
    long = "x" * 999 + "é"
    return [(1, "http://a", long, "p", "d"), (2, "http://b", long, "p", "d"), (3, None, "short", "p", "d"), (4, "http://c\r\nX: y", "short", "p", "d"),
            (5, "u", None, "p", "d"), (6, "u", "", "p", "d"), (2**60 + 1, "u", "y" * 2000 + "\r\n\r\nWARC/1.1\r\n\r\n", "p", "d"),
            (7, "u", "y" * 2000 + "\r\n\r\nWARC/1.1\r\n\r\n", "p", "d"), (8, "u", "z" * 3_000_000, "p", "d"), (8, "u", "z" * 3_000_000, "p", "d"),
            (None, "u", "only", "p", "d"), (9, "u", "a" * 999, "p", "d"), (10, "u", "a" * 999, "p", "d")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = archive_pages(df, folder=f"file://{tmp_path}/warc").collect()
    want = []
    for i, u, h, _, _ in rows():
        data = (h or "").encode()
        same = [j for j, _, g, _, _ in rows() if (g or "").encode() == data and j is not None]
        first = max(same, default=None)
        revisit = len(data) >= 1000 and first != i
        want.append((str(i), str(u).replace("\r\n", "%0D%0A"), None if revisit else data, len(data), hashlib.sha1(data).hexdigest(),
                     "revisit" if revisit else "response", str(first) if revisit else "None"))
    key = lambda x: (x[0], x[1], x[3])
    assert sorted(((str(r.page_id), str(r.url), None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest,
                    r.record_type, str(r.refers_to)) for r in got), key=key) == sorted(want, key=key)
    files = list(Path(tmp_path, "warc").glob("*.warc.gz"))
    assert files and not list(Path(tmp_path, "warc").glob("**/*.mono.warc.gz"))
    for f in files:      # any gzip reader reads the whole; each member stands at its offset
        data = f.read_bytes()
        index = [json.loads(x) for x in Path(f"{f}.idx").read_text().splitlines()]
        whole = list(records_of(iter([gzip.decompress(data)])))
        assert len(whole) == len(index)
        for entry, record in zip(index, whole):
            assert gzip.decompress(data[entry["offset"]:entry["offset"] + entry["length"]]) == record
            assert parse_record(record)[0]["warc-type"] == entry["record_type"]


def test_streams():
    records = [record_bytes(str(i), "u", b"a" * n, "0", None) for i, n in enumerate((0, 10, 700_000))]
    one, many = gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))
    for data in (one, many):
        assert list(records_of(inflated(io.BytesIO(data)))) == records
    with pytest.raises(ValueError):
        list(records_of(inflated(io.BytesIO(one[:-9]))))
    with pytest.raises(ValueError):
        list(records_of(iter([b"".join(records)[:-5]])))


def test_empty(spark, tmp_path):
    assert archive_pages(spark.createDataFrame([], SCHEMA), folder=f"file://{tmp_path}/w").count() == 0


def test_registered_query(spark):
    path = "/root/testdata/sf0.001"
    html = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["op5_warc"](spark, path).collect()}
    assert got.keys() == html.keys()
    for i, h in html.items():
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(h), hashlib.sha1(h).hexdigest())
