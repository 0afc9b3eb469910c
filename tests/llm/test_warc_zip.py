import base64
import gzip
import hashlib
import io
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import warc_zip
from shelfspark.llm.queries import op9_warc_zip
from tests.oracle import SMALL


def expected(rows):
    """(page_id, bytes, digest, type, refers_to) of rows (page_id, html), ids distinct."""
    first = {}
    for i, html in rows:
        body = (html or "").encode()
        first[body] = min(first.get(body, i), i)
    out = []
    for i, html in rows:
        body = (html or "").encode()
        sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), sha, "response" if first[body] == i else "revisit", None if first[body] == i else first[body]))
    return sorted(out)


def test_query_against_brute_force(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    assert sorted(tuple(r) for r in op9_warc_zip(spark, SMALL).collect()) == expected(pages)


@pytest.mark.parametrize("zip64", [True, False])
def test_packages_are_zip_files(zip64):
    """Against Python's own reader and writer."""
    out = io.BytesIO()
    rows = [dict(page_id=i, row_id=i, url=f"http://x/{i} y", payload=b"p%d" % i, revisit=False, refers_to=None, digest=warc_zip.digest(b"p%d" % i)) for i in range(20)]
    assert warc_zip.write_package(out, rows, zip64) == 20
    data = out.getvalue()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        names = [(i.filename, i.file_size, i.header_offset, i.CRC) for i in z.infolist()]
        assert gzip.decompress(z.read("archive/data-00000.warc.gz")).count(b"WARC/1.1\r\n") == 20
    members = warc_zip.directory(io.BytesIO(data), len(data))
    assert [(m.name, m.size, m.header, m.crc) for m in members] == names
    m = members[0]
    assert gzip.decompress(warc_zip.read_range(io.BytesIO(data), warc_zip.data_begin(io.BytesIO(data), m), m.size)).startswith(b"WARC/1.1")


def test_directories_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 is in this comment " * 3
        z.writestr("indexes/a", "x")
        with z.open(zipfile.ZipInfo("archive/b"), "w", force_zip64=True) as f:
            f.write(b"yy")
    data = out.getvalue()
    members = warc_zip.directory(io.BytesIO(data), len(data))
    assert [(m.name, m.size) for m in members] == [("indexes/a", 1), ("archive/b", 2)]
    assert [warc_zip.read_range(io.BytesIO(data), warc_zip.data_begin(io.BytesIO(data), m), m.size) for m in members] == [b"x", b"yy"]
    with pytest.raises(ValueError):
        warc_zip.directory(io.BytesIO(b"no zip at all, this"), 19)
    with pytest.raises(ValueError):
        warc_zip.read_range(io.BytesIO(b"abc"), 1, 5)


def test_damage_is_noticed():
    row = dict(page_id=1, row_id=1, url=None, payload=b"body", revisit=False, refers_to=None, digest=warc_zip.digest(b"body"))
    record = warc_zip.warc_record(row)
    assert warc_zip.parse_record(record)["payload"] == b"body"
    with pytest.raises(ValueError, match="digest"):
        warc_zip.parse_record(record.replace(b"body\r\n", b"bodY\r\n"))


def archive(ids):
    return b"".join(gzip.compress(warc_zip.warc_record(dict(page_id=i, row_id=i, url="u", payload=b"p%d" % i, revisit=False, refers_to=None, digest=warc_zip.digest(b"p%d" % i)))) for i in ids)


@pytest.mark.parametrize("index", ["deflated", "keyed", "none"])
def test_archives_of_other_writers(spark, tmp_path, index):
    """A compressed index, an index with keys before its objects, and an archive that no index names."""
    parts, lines, at = [archive([i]) for i in range(50)], [], 0
    for part in parts:
        line = '{"filename": "data.warc.gz", "offset": "%d", "length": "%d"}' % (at, len(part))
        lines.append(f"com,example)/ 20200101000000 {line}" if index == "keyed" else line)
        at += len(part)
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        z.writestr("archive/data.warc.gz", b"".join(parts))
        if index != "none":
            z.writestr("indexes/index.cdx", "\n".join(lines), zipfile.ZIP_DEFLATED if index == "deflated" else zipfile.ZIP_STORED)
    packages = spark.createDataFrame([(f"{tmp_path}/x.wacz",)], "path string")
    assert sorted((r["page_id"], r["payload"]) for r in warc_zip.read_archives(packages, str(tmp_path)).collect()) == [(i, b"p%d" % i) for i in range(50)]


def test_walking_an_archive_by_pieces():
    parts = [archive([i]) for i in range(9)]
    data = b"xx" + b"".join(parts)
    found = list(warc_zip.walked(io.BytesIO(data), 2, len(data) - 2, 7))
    assert [n for _, n in found] == [len(p) for p in parts] and [o for o, _ in found] == [sum(map(len, parts[:i])) for i in range(9)]
    with pytest.raises(ValueError, match="ends within"):
        list(warc_zip.walked(io.BytesIO(data), 2, len(data) - 5))


def test_revisits_name_the_record_that_has_the_payload():
    """Also where that record's page has no id."""
    row = dict(page_id=None, row_id=8, url="u", payload=b"x", revisit=True, refers_to=None, refers_row=3, digest=warc_zip.digest(b"x"))
    assert b"WARC-Refers-To: " + warc_zip.record_id(None, 3).encode() in warc_zip.warc_record(row)


def test_edges(spark, tmp_path):
    long = "<p>" + "x" * 3_000_000
    rows = [(5, "a", None), (3, "b", "same"), (9, "c", "same"), (4, "d e\r\nf", ""), (6, None, None), (7, "東", long), (8, "h", "\r\n\r\nWARC/1.1\r\n")]
    path = f"file://{tmp_path}/pages"
    make = lambda rs: spark.createDataFrame([(*r, "junk", "junk", "junk") for r in rs], "page_id long, url string, html string, payload string, row_id string, sha1 string")
    make(rows).repartition(2).write.parquet(path)
    found = warc_zip.archive_round_trip(spark.read.parquet(path))
    got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(tuple(r) for r in got) == expected([(i, h) for i, _, h in rows])
    assert {r["page_id"]: r["payload"] for r in found.select("page_id", "payload").collect()}[7] == long.encode()
    make([(1, "u", "x"), (1, "u", "x"), (None, "u", "x"), (None, "u", "y")]).coalesce(1).write.parquet(f"{path}2")
    again = warc_zip.archive_round_trip(spark.read.parquet(f"{path}2")).select("page_id", "record_type", "refers_to").collect()
    assert Counter(tuple(r) for r in again) == Counter([(1, "response", None), (1, "revisit", 1), (None, "revisit", 1), (None, "response", None)])
    make([]).write.parquet(f"{path}3")
    assert warc_zip.archive_round_trip(spark.read.parquet(f"{path}3")).count() == 0


def test_small_payloads_can_be_left_alone(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    spark.range(4).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") < 2, "ab").otherwise("abcdef").alias("html")).write.parquet(path)
    got = warc_zip.archive_round_trip(spark.read.parquet(path), least=4).select("page_id", "record_type").collect()
    assert {r["page_id"]: r["record_type"] for r in got} == {0: "response", 1: "response", 2: "response", 3: "revisit"}
