import hashlib
import struct

import zstandard
from pyspark.sql import functions as F

from docaudit.llm import warc
from docaudit.session import shared_dir


def pages(spark):
    big = "<p>" + "é paragraph " * 200
    rows = [(1, "u1", big), (2, "u2", big), (3, "u3", "short"), (4, "u4", "short"), (5, "u\r\nX: 5", None), (6, None, ""),
            (7, "u7", big), (7, "u7", big), (8, "u8", big + "!"), (9, "u9", "x" * 1000), (10, "u10", "x" * 1000), (None, "u", big)]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>{i} " + "common words of all pages " * 50 + str(i * i)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))


def test_what_is_written_is_read(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 100_000)
    rows, table = pages(spark)
    want = []
    for key, _, html in rows:
        body = (html or "").encode()
        last = max(k for k, _, h in rows if k is not None and (h or "") == (html or "")) if key is not None else None
        again = key is not None and len(body) >= 1000 and key != last
        want.append((str(key), len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", str(last if again else None)))
    got = warc.archive_pages(table).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert {r.target_uri for r in got} >= {"u1", "http://h/7", ""}
    assert warc.archive_pages(table.limit(0)).count() == 0


def test_archives_are_plain_zstandard(spark):
    _, table = pages(spark)
    folder = shared_dir(spark, "warc")
    listed = warc.write_archives(table, folder).collect()
    data = open(listed[0].path, "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert 0x184D2A50 <= magic <= 0x184D2A5F
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    assert raw[:4] == struct.pack("<I", 0xEC30A437)  # a trained dictionary
    records = list(warc.read_records(data))
    assert records[0][0]["WARC-Type"] == "warcinfo" and len(records) == listed[0].records
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    bodies = [warc.page_record(i, f"http://h/{i}", f"<html><body>{i} {'common words of all pages ' * 50}".encode(), None) for i in range(300)]
    assert len(warc.archive(bodies)) < sum(len(plain.compress(b)) for b in bodies)


def test_few_records_have_a_dictionary_too():
    for records in ([b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"], [warc.record("warcinfo", [], b"")] * 2):
        assert len(list(warc.read_records(warc.archive(records)))) == len(records)
