import base64
import glob
import hashlib
import io
import zipfile

import pytest

from tabstudy.llm import QUERIES, warc
from tabstudy.llm.common import scratch


def slow(rows, least=0):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        revisit = len(p) >= least and p in first and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[p] if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_whole_table(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(QUERIES["op7_warc_zip"](spark, folder)) == slow(rows)


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("least", [0, 5])
def test_edges_and_a_plain_unpacker(spark, zip64, least):
    rows = [(1, "http://a/ b\n", "x\r\n\r\ny"), (2, None, None), (3, "u", ""), (None, "u", "same text"), (9, "u", "same text"), (4, "ü", "same text"), (None, "n", "only null"), (5, "v", "PK\x05\x06 \n\n"), (5, "v", "PK\x05\x06 \n\n"), (6, "w", "é" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, size int, sha1 string")
    path = scratch(spark, "warc")
    warc.write_archives(pages, path, least_bytes=least, zip64=zip64)
    index = warc.index_table(spark, path)
    assert got(warc.read_records(index)) == slow(rows, least)
    kept = {(r.page_id, bytes(r.payload).decode()) for r in warc.read_records(index.where("page_id in (1, 6)"), payloads=True).collect()}
    assert kept == {(1, rows[0][2]), (6, rows[-1][2])}
    for name in glob.glob(f"{path}/part-*"):
        with zipfile.ZipFile(name) as z:
            assert z.testzip() is None and z.namelist() == [warc.RECORDS, warc.INDEX]
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_empty_table_and_damage(spark):
    path = scratch(spark, "warc")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(warc.index_table(spark, path)).count() == 0
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"nothing"), 7)
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", b"abc")
        z.comment = b"PK\x05\x06 in a comment"
    data = packed.getvalue()
    at, n = warc.members(io.BytesIO(data), len(data))["a.txt"]
    assert data[at:at + n] == b"abc"
