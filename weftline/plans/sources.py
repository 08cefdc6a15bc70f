"""Queries of the sources, over files that Spark writes from the given tables into the shared folder."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from weftline.functions import text as T
from weftline.operators.storage import shared_dir
from weftline.shipping import arrow_udf, sliced
from weftline.sources import corpus
from weftline.sources.markup import book_reports, book_texts
from weftline.sources.tables import table
from weftline.sources.text import decoded

_LIBRARIES = ("psychology", "literature", "poetry")


def _lines(lines: DataFrame) -> str:
    """The lines (value) as text files in the shared folder."""
    spark = lines.sparkSession
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    lines.select("value").write.text(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def jsonl_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON lines, each after a remark and an empty line."""
    c = table(spark, sf_dir, "conversations")
    value = F.explode(F.array(F.lit("// a remark"), F.lit("  "), F.to_json(F.struct("conv_id", "turn", "text"))))
    o = corpus.objects(corpus.numbered_lines(spark, _lines(c.select(value.alias("value")))))
    get = lambda name, kind: F.try_variant_get("obj", f"$.{name}", kind).alias(name)
    return o.select(get("conv_id", "bigint"), get("turn", "bigint"), F.md5(get("text", "string")).alias("digest"), (F.col("line") % 3).alias("place"))


def corpus_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the chunks of three libraries, each in its own dialect."""
    p = table(spark, sf_dir, "part")
    title = F.concat(F.lit("《"), "p_brand", F.lit("》"))
    fields = {
        "psychology": [F.lit("d").alias("discipline"), F.col("p_type").alias("concept"), F.concat("p_brand", F.lit("·"), "p_type").alias("source"), F.lit("a").alias("author")],
        "literature": [title.alias("book"), F.lit("c").alias("character"), F.col("p_type").alias("imagery"), F.array("p_type").alias("emotion")],
        "poetry": [title.alias("poem_title"), F.lit("a").alias("author"), F.lit("d").alias("dynasty"), F.array("p_type", "p_brand").alias("imagery"), F.col("p_brand").alias("emotion")],
    }
    paths = {}
    for k, name in enumerate(_LIBRARIES):
        mine = p.filter(F.col("p_partkey") % 3 == k)
        row = F.struct(F.concat(F.lit(f"{name[:3]}:"), F.col("p_partkey").cast("string")).alias("chunk_id"), F.concat("p_name", F.lit(" in many words")).alias("text"), *fields[name])
        paths[name] = _lines(mine.select(F.to_json(row).alias("value")))
    c = corpus.load(spark, paths)
    return c.select("chunk_id", "library", "work", "text", F.array_join("imagery", ",").alias("imagery"), F.array_join("emotion", ",").alias("emotion"))


def corpus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as weighted edges, some of unknown types or without a weight."""
    s = table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 7 == 0, "Planet").otherwise("Imagery")
    row = F.struct(F.col("s_name").alias("source"), kind.alias("source_type"), F.col("s_nationkey").cast("string").alias("target"), F.lit("Emotion").alias("target_type"), F.lit("ASSOCIATED_WITH").alias("relation"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("weight"))
    e = corpus.edges(corpus.numbered_lines(spark, _lines(s.select(F.to_json(row).alias("value")))))
    return e.select("source", "target", "weight", F.col("error").isNotNull().alias("wrong"))


@arrow_udf(BinaryType())
@sliced
def _book(text: pa.Array) -> pa.Array:
    """A book with a cover, a list of contents, and a part for each line of the text."""
    out = []
    for t in text.to_pylist():
        lines = [x for x in (t or "").split("\n") if x.strip()]
        names = ["cover-image", "toc", *(f"coverage{k}" for k in range(len(lines)))]
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="b.opf"/></rootfiles></container>')
            items = "".join(f'<item id="i{k}" href="{n}.xhtml"/>' for k, n in enumerate(names))
            z.writestr("b.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref="i{k}"/>' for k in range(len(names)))}</spine></package>")
            for n, line in zip(names, ["cover", "contents", *lines]):
                z.writestr(f"{n}.xhtml", f"<html><head><title>t</title></head><body><p>{line.replace('&', '&amp;').replace('<', '&lt;')}</p></body></html>")
        out.append(sink.getvalue())
    return pa.array(out, pa.binary())


def book_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as books: their lines come back as parts in order, names that begin like a cover's included."""
    c = table(spark, sf_dir, "conversations")
    files = c.select(F.concat_ws("/", "conv_id", "turn").alias("path"), _book("text").alias("content"))
    return book_texts(files).select("path", "position", F.regexp_replace("text", r"\s+", "").alias("text"))


@arrow_udf(BinaryType())
@sliced
def _scarred(text: pa.Array) -> pa.Array:
    """A book of the text's lines with a part that is named like a cover in the list of contents, one that is not there, one without text and one that is damaged."""
    out = []
    for t in text.to_pylist():
        lines = [x for x in (t or "").split("\n") if x.strip()]
        items = [("cover-1", "a1.xhtml"), ("gone", "gone.xhtml"), ("picture", "picture.xhtml"), ("torn", "torn.xhtml"), *((f"x{k}", f"line%20{k}.xhtml#top") for k in range(len(lines)))]
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w") as z:
            z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>')
            manifest = "".join(f'<item id="{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in items)
            z.writestr("O/b.opf", f"<package><metadata><title> of {len(lines)} </title><creator/><creator>c</creator></metadata><manifest>{manifest}</manifest><spine>{''.join(f'<itemref idref="{i}"/>' for i, _ in items)}</spine></package>")
            for name in ("a1", "picture", "torn"):
                z.writestr(f"O/{name}.xhtml", "<body><img/></body>" if name == "picture" else "<p>TORN PART</p>")
            for k, line in enumerate(lines):
                z.writestr(f"O/line {k}.xhtml", f"<table><tr><td>{line.replace('&', '&amp;').replace('<', '&lt;')}</td><td>2</td></tr></table>")
        blob = sink.getvalue()
        torn = blob.rfind(b"TORN PART", 0, blob.find(b"PK\x01\x02"))
        out.append(blob[:torn] + b"torn" + blob[torn + 4 :])
    return pa.array(out, pa.binary())


def book_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as books with parts that can't be read: what each book's report tells."""
    c = table(spark, sf_dir, "conversations")
    files = c.select(F.concat_ws("/", "conv_id", "turn").alias("path"), _scarred("text").alias("content"))
    r = book_reports(files)
    return r.select("path", "title", "author", "parts", "empty", F.array_join("skipped", ",").alias("skipped"), F.col("problem").isNotNull().alias("failed"))


def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-8 bytes with and without a mark before them."""
    d = table(spark, sf_dir, "documents")
    raw = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(b"\xef\xbb\xbf"), raw)).otherwise(raw)
    return d.select("doc_id", F.md5(decoded(content)).alias("digest"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.safe_filename(F.when(F.col("page_id") % 5 != 0, F.regexp_replace("url", "/(?=[0-9])", r"\\"))).alias("name"))


def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    some = F.when(F.col("doc_id") % 3 == 0, "  ").when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "source"))
    return d.select("doc_id", F.md5(T.clean_text(F.concat(F.lit("  "), "text"), 200)).alias("digest"), T.string_or_null(some).alias("source"))


QUERIES = {f.__name__: f for f in (jsonl_objects, corpus_load, corpus_edges, book_parts, book_report, decoded_bytes, safe_names, cleaned_texts)}
ORACLE_SQL = {
    "jsonl_objects": "select conv_id, turn, md5(text) as digest, 0::bigint as place from conversations",
    "corpus_load": """select ['psy', 'lit', 'poe'][p_partkey % 3 + 1] || ':' || p_partkey as chunk_id, ['psychology', 'literature', 'poetry'][p_partkey % 3 + 1] as library, p_brand as work, p_name || ' in many words' as text,
      case p_partkey % 3 when 0 then '' when 1 then p_type else p_type || ',' || p_brand end as imagery, case p_partkey % 3 when 0 then '' when 1 then p_type else p_brand end as emotion from part""",
    "corpus_edges": "select s_name as source, s_nationkey::varchar as target, case when s_suppkey % 2 = 0 then s_acctbal else 1.0 end as weight, s_suppkey % 7 = 0 as wrong from supplier",
    "book_parts": """with l as (select conv_id || '/' || turn as path, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from conversations)
      select path, (unnest(generate_series(1, len(l))) - 1)::bigint as position, regexp_replace(unnest(l), '\\s+', '', 'g') as text from l""",
    "book_report": """with n as (select conv_id || '/' || turn as path, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '')) as n from conversations)
      select path, case when n > 0 then 'of ' || n end as title, case when n > 0 then 'c' end as author, case when n > 0 then n end as parts, case when n > 0 then 1 end as empty,
        coalesce(case when n > 0 then 'a1.xhtml,gone.xhtml (missing),torn.xhtml (damaged)' end) as skipped, n = 0 as failed from n""",
    "decoded_bytes": "select doc_id, md5(text) as digest from documents",
    "safe_names": """with n as (select page_id, case when page_id % 5 <> 0 then regexp_extract(url, '([^/]*)$', 1) else '' end as n from pages)
      select page_id, coalesce(nullif(left(trim(regexp_replace(n, '[\\x00-\\x1F<>:"|?*]', '', 'g')), 200), ''), 'upload.txt') as name from n""",
    "cleaned_texts": "select doc_id, md5(rtrim(left(trim(text, ' '), 200), ' ')) as digest, case when doc_id % 3 = 1 then source end as source from documents",
}
