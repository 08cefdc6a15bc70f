"""Archives written and read back, against plain Python, and archives with faults."""

import hashlib
import struct

import pytest
import zstandard

from weftline.llm import warc
from weftline.llm.registry import ORACLE_SQL, QUERIES

LONG = "<p>one and the same page, long enough to be a revisit</p>" * 4
PAGES = [
    (5, "http://a.example/x y\r\nEvil: 1", LONG),
    (3, None, LONG),
    (3, "http://b.example/", LONG),
    (9, "http://é.example/?q=1&r=%20#f", LONG),
    (None, "http://c.example/", LONG),
    (7, "u", None),
    (8, "u", ""),
    (10, "u", "short"),
    (11, "u", "short"),
    (12, "u", "漢字 😀 \x00 \r\n\r\n" * 30),
    (13, "u", "x" * 3_000_000),
    (2, "u", "WARC/1.1\r\n\r\n" * 20),
    (14, "u", "é" * 50),
    (15, "u", "é" * 50),
    (16, "u", "é" * 49),
    (17, "u", "é" * 49),
]


def expected(pages):
    first, out = {}, []
    for i, _, html in pages:
        x = (html or "").encode()
        if len(x) >= 100 and i is not None:
            first[x] = min(first.get(x, i), i)
    for i, _, html in pages:
        x = (html or "").encode()
        again = x in first and i != first[x]
        out.append((i, len(x), hashlib.sha256(x).hexdigest(), "revisit" if again else "response", first[x] if again else None))
    return sorted(out, key=repr)


def back(df):
    rows = df.filter("record_type <> 'warcinfo'").collect()
    return sorted(((None if r["page"] is None else int(r["page"]), r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in rows), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, digest string, leader int")


@pytest.mark.parametrize("records", [3, 5, 4096])
def test_round_trip(spark, pages, tmp_path, records):
    warc.write(pages.repartition(3), f"file://{tmp_path}/a", records=records)
    read = warc.read(spark, f"file://{tmp_path}/a")
    assert back(read) == expected(PAGES)
    whole = {r["page"]: bytes(r["payload"]) for r in read.filter("record_type = 'response'").collect()}
    assert all(whole[str(i)] == (html or "").encode() for i, _, html in PAGES if str(i) in whole and html != LONG)
    urls = {r["page"]: r["url"] for r in read.filter("page is not null").collect()}
    assert urls["5"] == "http://a.example/x%20y%0D%0AEvil:%201" and urls["9"].endswith("/?q=1&r=%20#f")
    for f in (tmp_path / "a").glob("part-*"):
        frames = [m for m, *_ in warc.frames(memoryview(f.read_bytes())) if m == 0xFD2FB528]
        assert len(frames) <= records


def test_dictionary_leads_and_library_reads(spark, tmp_path):
    """The dictionary comes first, each frame holds one record, and a plain decoder with that dictionary reads it."""
    many = spark.createDataFrame([(k, f"http://x/{k}", f"<html><body><p>Page {k} of many pages that look alike, with number {k * 7919}</p></body></html>" * 3) for k in range(400)], "page_id long, url string, html string").repartition(2)
    warc.write(many, f"file://{tmp_path}/b")
    for f in (tmp_path / "b").glob("part-*"):
        data = f.read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic == 0x184D2A5D
        plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        for kind, start, end in warc.frames(memoryview(data)):
            if kind == 0xFD2FB528:
                record = plain.decompress(data[start:end])
                assert record.startswith(b"WARC/1.1\r\n") and record.count(b"WARC-Record-ID") == 1
                with pytest.raises(zstandard.ZstdError):
                    zstandard.ZstdDecompressor().decompress(data[start:end])
    assert warc.read(spark, f"file://{tmp_path}/b").filter("record_type = 'response'").count() == 400


def test_empty_table(spark, tmp_path):
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/c")
    assert back(warc.read(spark, f"file://{tmp_path}/c")) == []


def good():
    digest = hashlib.sha256(b"page").hexdigest()
    return warc.page_record("1", "http://x/", b"page", digest, None, "2020-01-01T00:00:00Z"), warc.page_record("2", None, b"page", digest, "1", "2020-01-01T00:00:00Z")


def packed(*records):
    return b"".join(zstandard.ZstdCompressor().compress(x) for x in records)


def test_faults():
    response, revisit = good()
    assert [r.get("problem") for r in warc.records_in("a", memoryview(packed(response, revisit)))] == [None, None]
    bad = {
        "Content-Length": response.replace(b"Content-Length: 82", b"Content-Length: 83"),
        "block's digest": response.replace(b"page\r\n\r\n", b"pagE\r\n\r\n"),
        "without warc-date": response.replace(b"WARC-Date: 2020-01-01T00:00:00Z\r\n", b""),
        "without warc-refers-to": revisit.replace(b"WARC-Refers-To: ", b"X-Refers: "),
        "of type": response.replace(b"response\r\nWARC-Rec", b"other\r\nWARC-Rec"),
        "no WARC": b"HTTP" + response,
        "no field": response.replace(b"WARC-Date:", b"WARC-Date"),
        "tells": response + response,
        "not of this kind": response.replace(b"<urn:x-page:", b"<urn:uuid:"),
    }
    for words, record in bad.items():
        assert record != response
        first, second = warc.records_in("a", memoryview(packed(record, response)))
        assert words in first["problem"] and "problem" not in second, words
    whole = packed(response, revisit)
    for broken in (whole[:-3], whole[:5], b"junk" * 9 + whole, whole[:-12] + b"\xff" * 12):
        *_, last = warc.records_in("a", memoryview(broken))
        assert last["problem"]
    with_dictionary = zstandard.train_dictionary(1024, [response + str(k).encode() * 9 for k in range(300)])
    lost = zstandard.ZstdCompressor(dict_data=with_dictionary).compress(response)
    assert [bool(r.get("problem")) for r in warc.records_in("a", memoryview(lost))] == [True]
    lead = struct.pack("<II", 0x184D2A5D, len(d := zstandard.ZstdCompressor().compress(with_dictionary.as_bytes()))) + d
    assert [r.get("problem") for r in warc.records_in("a", memoryview(lead + lost))] == [None]
    assert "no dictionary" in next(iter(warc.records_in("a", memoryview(struct.pack("<II", 0x184D2A5D, 4) + b"none" + lost))))["problem"]


def test_strict(spark, tmp_path):
    response, revisit = good()
    (tmp_path / "d").mkdir()
    (tmp_path / "d/part-0").write_bytes(packed(response, revisit[:-1]))
    with pytest.raises(Exception, match="Content-Length"):
        warc.read(spark, f"file://{tmp_path}/d").collect()
    assert [bool(r["problem"]) for r in warc.read(spark, f"file://{tmp_path}/d", strict=False).collect()] == [False, True]


def test_query(spark, folder):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op12_warc"](spark, folder).collect()), key=repr)
    assert got == expected(rows) and "op12_warc" in ORACLE_SQL
