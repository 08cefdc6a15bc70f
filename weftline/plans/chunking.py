"""Queries of chunking and of text out of markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import chunking as K
from weftline.sources.markup import page_text
from weftline.sources.tables import spread, table


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cut(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).select("doc_id", "piece", "paragraph", F.length("body").alias("length"), "hard")


def chunk_lossless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each document's pieces put together, without white space: that of the document."""
    bodies = _cut(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "body"))), lambda x: x["body"]), "").alias("t"))
    return bodies.select("doc_id", F.md5(F.regexp_replace("t", r"\s+", "")).alias("digest"))


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of pieces: a piece that a library has twice has one id."""
    p = _cut(spark, sf_dir).withColumn("id", K.chunk_ids(F.lit("psychology"), F.lit("《a b》"), F.col("body")))
    return p.agg(F.countDistinct("id").alias("ids"), F.countDistinct("body").alias("bodies"))


def delta_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each turn: where they end, and the digest of all together."""
    c = table(spark, sf_dir, "conversations").withColumn("d", K.streamed(F.col("text")))
    return c.select("conv_id", "turn", F.array_join(F.transform("d", lambda x: F.length(x).cast("string")), ",").alias("lengths"), F.md5(F.array_join("d", "")).alias("digest"))


def split_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, those of even ids with a Chinese sentence as often as they have letters, and what a user is told of their split; cuts are held against plain Python in the tests."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.repeat(F.lit("海上生明月。"), F.floor(F.length("text") / 4).cast("int")))).otherwise(F.col("text")).alias("text")))
    r = K.split_reports(d, "doc_id", "text")
    return r.select("doc_id", "n_chars", F.round("cjk", 6).alias("cjk"), F.array_join(F.array_remove("warnings", "cuts"), ",").alias("warnings"), "error")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", page_text(F.col("html")).alias("text")).select("page_id", F.length("text").alias("length"), F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (chunk_pieces, chunk_lossless, chunk_ids, delta_chunks, split_warnings, html_blocks)}
_BLOCK = "p|div|h1|h2|h3|h4|h5|h6|li|tr|td|th|blockquote|section|article|figcaption|dd|dt|pre|hr"
#: The references that the given pages hold; those of ampersands last. Each is one without its semicolon too.
_REFERENCES = (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&"))


def _blocks_sql() -> str:
    t = "coalesce(html, '')"
    for pattern, to in (
        (r"(?s)<!--.*?-->", ""), (r"(?is)<script\b[^>]*>.*?</script\b[^>]*>", ""), (r"(?is)<style\b[^>]*>.*?</style\b[^>]*>", ""), (r"(?is)<head\b[^>]*>.*?</head\b[^>]*>", ""),
        (r"(?is)<title\b[^>]*>.*?</title\b[^>]*>", ""), (r"(?i)<br\b[^>]*>", "\n"), (rf"(?i)</?(?:{_BLOCK})(?:\s[^>]*|/)?>", "\n\n"), (r"<[!?/a-zA-Z][^>]*(?:>|$)", ""),
    ):
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    for name, to in _REFERENCES:
        t = f"regexp_replace({t}, '&{name};?', '{to}', 'g')"
    lines = f"list_transform(string_split(regexp_replace({t}, '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x))"
    return rf"with t as (select page_id, regexp_replace(regexp_replace(array_to_string({lines}, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from pages) select page_id, length(text) as length, md5(text) as digest from t"


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{FEFF}]', '', 'g'), '[ \\t\\x{3000}]+', ' ', 'g'), '(?m)^ | $', '', 'g')"
ORACLE_SQL = {
    "split_warnings": f"""with a as (select doc_id, coalesce(text, '') || case when doc_id % 2 = 0 then repeat('海上生明月。', (length(text) // 4)::bigint) else '' end as t from documents),
      b as (select doc_id, regexp_replace(regexp_replace({_CLEAN}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as t from a),
      c as (select doc_id, length(t) as n, case when length(t) > 0 then length(regexp_replace(left(t, 4000), '[^\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}]', '', 'g')) / length(left(t, 4000)) else 0.0 end as r from b)
      select doc_id, n as n_chars, round(r::double, 6) as cjk, case when n < 8 then '' else concat_ws(',', case when r < 0.3 then 'foreign' end, case when n < 200 then 'short' end) end as warnings, case when n < 8 then 'empty' end as error from c""",
    "html_blocks": _blocks_sql(),
    "chunk_lossless": "select doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) as digest from documents where length(trim(text)) >= 8",
    "delta_chunks": f"""select conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '(?s).{{{K.DELTA_FLOOR - 1},{K.DELTA_SIZE - 1}}}?[{K.DELTA_END}]|.{{{K.DELTA_SIZE}}}|.+$'), lambda x: length(x)), ',') as lengths, md5(text) as digest from conversations""",
}
