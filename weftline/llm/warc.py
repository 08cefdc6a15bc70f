"""WARC archives compressed with Zstandard: a frame for each record, and a dictionary that all frames share.

An archive begins with a skippable frame that holds the dictionary, then one frame for
each record: a warcinfo record and the pages. Between them stand skippable frames of no
bytes, which every reader passes over. Spark's text sink writes the frames as its lines
and such an empty frame as its line separator, so archives go through Spark's own
committer to any store that Spark reaches, and a lost task leaves no half archive. An
archive has ARCHIVE_RECORDS frames at most; the names of the files are Spark's.

Of pages with equal payloads of at least LEAST_REVISIT bytes the one with the smallest
id is a response, the others are revisits: records without the payload that refer to the
response and carry the payload's digest and length. Smaller payloads are responses.
Leaders are found by an aggregate over digests; only (digest, id) rows are aggregated,
and Spark can split the join of a digest that has most of the pages.

The reader takes whole files, loads the dictionary from the leading skippable frame,
finds each frame's end by its block headers, decodes it alone, and checks: one record a
frame, the version line, the named fields that a type must have, that the block has the
length that Content-Length tells, both digests, and the payload's length in the HTTP
header. A record that fails has its fault in `problem`, or ends the job if strict.

A null payload is the empty one, a null url leaves its field out. Pages that share an id
are records each; a page equal to a response in id and payload is a response as well, and a page
without an id refers to the response of its payload if there is one. An empty table
makes an archive of no pages. Other columns of pages do not matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import sampled, table
from weftline.operators.storage import shared_dir
from weftline.shipping import ship

#: Frames in an archive at most, the warcinfo record and the dictionary's frame among them.
ARCHIVE_RECORDS = 4_096
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: The dictionary: its bytes, and the sample that it is trained on: pages, and characters of each.
DICTIONARY_BYTES, SAMPLE_PAGES, SAMPLE_CHARS = 64 << 10, 500, 8_192
LEVEL = 6

# Fixed values of the formats: magic numbers of a frame, of a dictionary, of the skippable frame with the dictionary, and of skippable frames in general.
_FRAME, _DICTIONARY, _WITH_DICTIONARY, _SKIPPABLE = 0xFD2FB528, 0xEC30A437, 0x184D2A5D, 0x184D2A50
#: A skippable frame of no bytes: what the sink writes after each of its lines.
EMPTY = struct.pack("<II", _SKIPPABLE, 0)
_NAME = re.compile(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_VERSION = "WARC/1.1"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Fields that a record must have, by type.
_NEEDED = {"warcinfo": (), "response": ("warc-payload-digest",), "revisit": ("warc-payload-digest", "warc-profile", "warc-refers-to")}


class Fault(ValueError):
    """What is wrong with an archive or a record."""


def trained(pages: DataFrame, payload: str = "html") -> bytes:
    """A dictionary from SAMPLE_PAGES different pages at most, picked by a hash; no bytes where the sample is too small to train one."""
    # about twice as many as are wanted, so that no task sends more than its part of them
    part = sampled(2 * SAMPLE_PAGES / max(1, pages.count()), payload)
    some = pages.filter(part).select(F.substring(F.coalesce(payload, F.lit("")), 1, SAMPLE_CHARS).alias("x"), F.xxhash64(payload).alias("h"))
    samples = [r[0].encode() for r in some.dropDuplicates(["h"]).orderBy("h").limit(SAMPLE_PAGES).select("x").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [x for x in samples if x]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _id(page: str | None, digest: str) -> str:
    """A record's name, by its page's id and payload; a page without an id has a name of its payload alone."""
    return f"<urn:x-page:{'' if page is None else quote(page, safe='')}:{digest}>"


def _page(name: str) -> str | None:
    """The page's id that a record's name tells."""
    if not name.startswith("<urn:x-page:") or name.count(":") != 3:
        raise Fault(f"a record's name is not of this kind: {name[:80]}")
    return unquote(name.split(":")[2]) or None


def record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {**fields, "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": len(block)}.items())
    return f"{_VERSION}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def page_record(page: str | None, url: str | None, payload: bytes, digest: str, leader: str | None, date: str) -> bytes:
    """A page as a response, or, with a leader, as a revisit to it."""
    fields = {"WARC-Type": "response" if leader is None else "revisit", "WARC-Record-ID": _id(page, digest), "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    fields |= {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    http = _HTTP.format(len(payload)).encode()
    if leader is None:
        return record(fields, http + payload)
    return record(fields | {"WARC-Profile": _REVISIT, "WARC-Refers-To": _id(leader, digest)}, http)


def frames(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame; a data frame's end is found by its block headers."""
    at = 0
    while at < len(data):
        if len(data) - at < 8:
            raise Fault(f"the archive ends within a frame at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & ~0xF == _SKIPPABLE:
            end = at + 8 + size
        elif magic == _FRAME:
            head = bytes(data[at : at + 18])
            try:
                end, last = at + zstandard.frame_header_size(head), 0
                while not last:
                    word = int.from_bytes(data[end : end + 3], "little")
                    last, kind, size = word & 1, word >> 1 & 3, word >> 3
                    if kind == 3 or end + 3 > len(data):
                        raise Fault(f"a damaged block in the frame at {at}")
                    end += 3 + (1 if kind == 1 else size)
                end += 4 * zstandard.get_frame_parameters(head).has_checksum
            except zstandard.ZstdError as e:
                raise Fault(f"a damaged frame at {at}: {e}") from None
        else:
            raise Fault(f"no frame at {at}")
        if end > len(data):
            raise Fault(f"the archive ends within a frame at {at}")
        yield magic, at, end
        at = end


def dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of the leading skippable frame, which may be compressed itself."""
    magic = int.from_bytes(content[:4], "little")
    if magic == _FRAME:
        content = zstandard.ZstdDecompressor().decompress(content)
        magic = int.from_bytes(content[:4], "little")
    if magic != _DICTIONARY:
        raise Fault("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)


def checked(data: bytes) -> dict:
    """A record's fields by lower-case name, with the payload at `payload` (None in revisits); raises Fault."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "replace").split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1") or not blank:
        raise Fault("no WARC record")
    fields: dict = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not _NAME.fullmatch(name):
            raise Fault(f"a line that is no field: {line[:80]}")
        fields[name.lower()] = value.strip()
    kind = fields.get("warc-type")
    if kind not in _NEEDED:
        raise Fault(f"a record of type {kind}")
    for name in ("warc-record-id", "warc-date", "content-length", *_NEEDED[kind]):
        if not fields.get(name):
            raise Fault(f"a {kind} without {name}")
    if not fields["content-length"].isdecimal() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Fault(f"the block has {len(rest) - 4} bytes, Content-Length tells {fields['content-length']}")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise Fault("the block's digest differs")
    if kind == "warcinfo":
        return fields
    http, blank, payload = block.partition(b"\r\n\r\n")
    told = [x[15:].strip() for x in http.split(b"\r\n")[1:] if x[:15].lower() == b"content-length:"]
    if not http.startswith(b"HTTP/") or not blank or len(told) != 1 or not told[0].isdigit():
        raise Fault("no HTTP response with one Content-Length")
    fields["payload_bytes"] = int(told[0])
    fields["payload_digest"] = fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "revisit":
        if payload:
            raise Fault("a revisit with a payload")
        return fields | {"payload": None}
    if len(payload) != fields["payload_bytes"]:
        raise Fault(f"the payload has {len(payload)} bytes, its header tells {fields['payload_bytes']}")
    if hashlib.sha256(payload).hexdigest() != fields["payload_digest"]:
        raise Fault("the payload's digest differs")
    return fields | {"payload": payload}


def archive_frames(records: Iterator[bytes], shared: bytes, most: int) -> Iterator[bytes]:
    """The frames of archives: the dictionary and a warcinfo record lead after every `most` frames; all archives but the last are full."""
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
    lead = [struct.pack("<II", _WITH_DICTIONARY, len(shared)) + shared] if shared else []
    written = 0
    for x in records:
        if written % most == 0:
            info = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}
            for head in (*lead, packer.compress(record(info, b"format: WARC File Format 1.1\r\n"))):
                yield head
                written += 1
        yield packer.compress(x)
        written += 1


def with_leaders(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """id, url, payload, digest of each page, and leader: the id of the response that it revisits, or null."""
    content = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), content.alias("payload"), F.sha2(content.cast("binary"), 256).alias("digest"))
    large = F.octet_length(content) >= LEAST_REVISIT
    seen = pages.filter(large).select(F.sha2(content.cast("binary"), 256).alias("digest"), F.col(key).alias("id"))
    leaders = seen.groupBy("digest").agg(F.min("id").alias("leader"), F.count("*").alias("n")).filter("n > 1 and leader is not null").drop("n")
    return rows.join(leaders, "digest", "left").withColumn("leader", F.when(~F.col("id").eqNullSafe(F.col("leader")), F.col("leader")))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z", records: int = ARCHIVE_RECORDS) -> None:
    """Archives of all pages in the folder `path`, which must not be there yet."""
    if records < 3:
        raise ValueError("an archive needs room for the dictionary, its warcinfo record and a page")
    ship(pages.sparkSession)
    shared = trained(pages, payload)
    rows = with_leaders(pages, key, url, payload).withColumns({"id": F.col("id").cast("string"), "leader": F.col("leader").cast("string")})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[bytes]:
            for batch in batches:
                for page, link, text, digest, leader in zip(*(batch.column(c) for c in ("id", "url", "payload", "digest", "leader"))):
                    yield page_record(page.as_py(), link.as_py(), text.as_buffer().to_pybytes(), digest.as_py(), leader.as_py(), date)

        held, size = [], 0
        for frame in archive_frames(each(), shared, records):
            held.append(frame)
            size += len(frame)
            if size > 1 << 20:
                yield pa.RecordBatch.from_pydict({"frame": pa.array(held, pa.binary())})
                held, size = [], 0
        yield pa.RecordBatch.from_pydict({"frame": pa.array(held, pa.binary())})

    packed = rows.select("id", "url", F.col("payload").cast("binary").alias("payload"), "digest", "leader").mapInArrow(pack, "frame binary")
    lines = packed.select(F.col("frame").cast("string"))
    lines.write.option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", records).text(path)


#: What the reader gives of each record.
RECORDS = "archive string, start long, record_type string, record_id string, page string, url string, date string, payload binary, payload_bytes long, payload_digest string, refers_to string, problem string"


def records_in(name: str, data: memoryview) -> Iterator[dict]:
    """Every record of an archive, or its fault; after a fault of the archive itself nothing more of it can be read."""
    shared = None
    try:
        for magic, start, end in frames(data):
            if magic != _FRAME:
                if start == 0 and magic == _WITH_DICTIONARY:
                    shared = dictionary(bytes(data[8:end]))
                continue
            row: dict = {"archive": name, "start": start}
            try:
                unpacked = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
                raw = unpacked.decompress(data[start:end])
                size = zstandard.get_frame_parameters(data[start : start + 18]).content_size
                if size not in (zstandard.CONTENTSIZE_UNKNOWN, len(raw)):
                    raise Fault(f"the frame holds {len(raw)} bytes, its header tells {size}")
                x = checked(raw)
                row |= {"record_type": x["warc-type"], "record_id": x["warc-record-id"], "url": x.get("warc-target-uri"), "date": x["warc-date"]}
                if row["record_type"] != "warcinfo":
                    row |= {"page": _page(row["record_id"]), **{c: x[c] for c in ("payload", "payload_bytes", "payload_digest")}}
                if row["record_type"] == "revisit":
                    row["refers_to"] = _page(x["warc-refers-to"])
            except (Fault, zstandard.ZstdError) as e:
                row["problem"] = str(e)
            yield row
    except (Fault, zstandard.ZstdError) as e:
        yield {"archive": name, "problem": str(e)}


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """RECORDS of all archives under `path`; strict ends the job at a fault."""
    ship(spark)
    schema = spark.createDataFrame([], RECORDS).schema
    kinds = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in schema])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                held, size = [], 0
                for row in records_in(name.as_py(), memoryview(content.as_buffer())):
                    if strict and row.get("problem"):
                        raise Fault(f"{name}: {row['problem']}")
                    held.append(row)
                    size += row.get("payload_bytes") or 0
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, kinds)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, schema)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    kind = pages.schema["page_id"].dataType
    back = read(spark, path).filter("record_type <> 'warcinfo'")
    return back.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
