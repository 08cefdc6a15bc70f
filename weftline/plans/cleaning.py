"""Queries of the cleaning operators, over documents as comments: n_chars are likes, doc_id is the position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import comments as C
from weftline.operators.storage import stored
from weftline.sources.tables import spread, table
from weftline.sources.text import split_items, split_warnings

_SPACE = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{85}\\x{B}]+"
_BODY = f"trim(regexp_replace(regexp_replace(coalesce(text, ''), '{T.ZERO_WIDTH}', '', 'g'), '{_SPACE}', ' ', 'g'))"
_RUNS = "|".join(f"[{a}]{{10}}" for a in [*(rf"\x{{{c:X}}}" for c in range(33, 127)), *(rf"\x{{{c:X}}}" for c in range(0xA1, 0x180))])
_STRONG = "(?i)" + T.STRONG.replace("(?![a-z])", "(?:[^a-z]|$)")
_KEY = f"md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?i){T.URL}', '', 'g'), '{T.MENTION}', '', 'g'), '{T.EMOJI}', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_WEAK = " + ".join(f"(body like '%{w}%')::int" for w in T.WEAK)
_FLAGGED = f"""
with b as (select doc_id, n_chars, {_BODY} as body from documents),
f as (select *, {_KEY} as dedup_key,
  case when not regexp_matches(regexp_replace(body, '{T.EMOJI}', '', 'g'), '[\\p{{L}}\\p{{N}}]') then 'empty'
       when regexp_matches(body, '(?i){T.URL}') or regexp_matches(body, '{_STRONG}')
         or (regexp_matches(body, '\\p{{Nd}}{{8,}}') and regexp_matches(body, '\\p{{L}}')) or ({_WEAK}) >= 2 then 'ad'
       when regexp_matches(body, '{_RUNS}') then 'spam' end as reason from b)"""
_MARKED = (
    _FLAGGED
    + """, m as (select *, reason is null and row_number() over (partition by dedup_key, reason is null order by n_chars desc, doc_id) > 1 as is_duplicate from f)"""
)


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.flagged(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.marked_duplicates(stored(_told(spark, sf_dir).withColumn("length", F.length("body")).drop("text", "body"), "flagged"), "n_chars", "doc_id")


def clean_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir).select("doc_id", "is_ad", "is_spam", F.col("filter_reason").alias("reason"), "dedup_key")


def mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).select("doc_id", "is_duplicate", F.col("filter_reason").alias("reason"))


def clean_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tally(_marked(spark, sf_dir))


def clean_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).filter("filter_reason is not null").groupBy(F.col("filter_reason").alias("reason")).agg(F.count("*").alias("n"))


def visible_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.visible_rows(_marked(spark, sf_dir)).filter("length > 0").select("doc_id", "length")


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "documents"), "doc_id", "text", "line", 100).select("doc_id", "item_id", F.col("body").alias("item"))


def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n \n").alias("text")), "conv_id", "text", "paragraph", 100).select("conv_id", "item_id", F.length("body").alias("length"))


def split_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what a split would keep, without the items."""
    parts = F.size(F.filter(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n"), lambda p: F.trim(p) != ""))
    counted = table(spark, sf_dir, "documents").select("doc_id", parts.cast("long").alias("total"))
    return counted.select("doc_id", "total", F.least("total", F.lit(10)).alias("kept"), F.greatest(F.col("total") - 10, F.lit(0)).alias("dropped"))


def text_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of each document as a pasted text of at most 10 lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.regexp_replace("text", r"\. ", ". ")).otherwise(F.regexp_replace("text", "\n", " ")).alias("text"))
    return split_warnings(d, "doc_id", "text", "line", 10).withColumn("warnings", F.array_join("warnings", ","))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.one_line(F.col("text"), 60).alias("snippet"), T.title(F.col("text")).alias("title"))


def cleaned_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's roles and first words as tags, against a closed set."""
    words = F.split("text", " ")
    tags = F.concat(F.array("role", F.concat(F.lit(" "), "role"), F.lit("")), words)
    kept = T.clean_tags(tags, limit=5, longest=8)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(kept, ",").alias("tags"))


def filtered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event types as ids, against a pool of two; kept in order and dropped ones."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("ids"))
    kept, dropped = T.filter_ids(F.col("ids"), F.array(F.lit("click"), F.lit("purchase")), 2)
    return e.select("user_id", F.array_join(kept, ",").alias("kept"), F.size(dropped).cast("long").alias("dropped"))


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and times out of the JSON of events; times as epoch seconds and as milliseconds."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(
        "event_id",
        T.to_long(k).alias("k"),
        F.unix_seconds(T.to_time(seconds.cast("string"))).alias("from_seconds"),
        F.unix_seconds(T.to_time((seconds * 1000).cast("string"))).alias("from_millis"),
        F.coalesce(F.get_json_object("props", "$.absent"), k).alias("first_present"),
    )


QUERIES = {f.__name__: f for f in (clean_flags, mark_duplicates, clean_tally, clean_reasons, visible_comments, split_lines, split_paragraphs, split_preview, text_warnings, snippets, cleaned_tags, filtered_ids, coerced)}

_PARTS = "list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda p: trim(p, ' ')), lambda p: trim(p, ' ') <> '')"
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
ORACLE_SQL = {
    "clean_flags": _FLAGGED + " select doc_id, coalesce(reason = 'ad', false) as is_ad, coalesce(reason in ('empty', 'spam'), false) as is_spam, reason, dedup_key from f",
    "mark_duplicates": _MARKED + " select doc_id, is_duplicate, case when is_duplicate then 'duplicate' else reason end as reason from m",
    "clean_tally": _MARKED
    + """ select count(*) as total, count(*) filter (not is_duplicate and reason is null) as kept, count(*) filter (reason = 'ad') as ads,
      count(*) filter (reason = 'spam') as spam, count(*) filter (is_duplicate) as duplicates, count(*) filter (reason = 'empty') as empty from m""",
    "clean_reasons": _MARKED + " select case when is_duplicate then 'duplicate' else reason end as reason, count(*) as n from m where is_duplicate or reason is not null group by 1",
    "visible_comments": _MARKED + " select doc_id, length(body)::bigint as length from m where not is_duplicate and reason is null and body <> ''",
    "split_lines": f"""with p as (select doc_id, unnest({_PARTS}) as item, generate_subscripts({_PARTS}, 1) as i from documents)
      select doc_id, format('txt-{{:04d}}', i) as item_id, left(item, 2000) as item from p where i <= 100""",
    "split_paragraphs": """with c as (select conv_id, string_agg(text, chr(10) || ' ' || chr(10) order by turn) as text from conversations group by 1),
      s as (select conv_id, list_filter(list_transform(string_split_regex(text, '\\n[ \\t]*\\n+'), lambda p: trim(p, ' ' || chr(10))), lambda p: p <> '') as l from c),
      p as (select conv_id, unnest(l) as item, generate_subscripts(l, 1) as i from s)
      select conv_id, format('txt-{:04d}', i) as item_id, least(length(item), 2000)::bigint as length from p where i <= 100""",
    "split_preview": f"with c as (select doc_id, len({_PARTS}) as total from documents) select doc_id, total, least(total, 10) as kept, greatest(total - 10, 0) as dropped from c",
    "text_warnings": f"""with t as (select doc_id, case when doc_id % 7 = 0 then replace(text, chr(10), ' ') else text end as text from documents), l as (select doc_id, {_PARTS} as p from t),
      n as (select doc_id, len(p) as total, least(len(p), 10) as kept, len(list_filter(p[1:10], lambda x: length(x) > 2000)) as cut from l)
      select doc_id, total, kept, total - kept as dropped, cut, concat_ws(',', case when kept = 0 then 'empty_text' end, case when total > kept then 'text_truncated' end, case when cut > 0 then 'text_item_truncated' end) as warnings from n""",
    "snippets": f"""select doc_id, case when length({_FLAT}) > 60 then left({_FLAT}, 60) || '…' else {_FLAT} end as snippet,
      case when length(trim(string_split(trim(text), chr(10))[1])) > 18 then left(trim(string_split(trim(text), chr(10))[1]), 18) || '…' else trim(string_split(trim(text), chr(10))[1]) end as title from documents""",
    "cleaned_tags": """with t as (select conv_id, turn, list_concat([role, ' ' || role, ''], string_split(text, ' ')) as l from conversations),
      k as (select conv_id, turn, list_filter(list_transform(l, lambda x: trim(x)), lambda x: x <> '' and length(x) <= 8 and not regexp_matches(x, '[\\x00-\\x1F<>\\[\\]{}|`]')) as l from t)
      select conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], ',') as tags from
      (select conv_id, turn, list_filter(l, lambda x, i: list_position(l, x) = i) as l from k)""",
    "filtered_ids": """with e as (select user_id, event_type, min(event_id) as first, count(*) as n from events group by 1, 2)
      select user_id, coalesce(string_agg(event_type, ',' order by first) filter (event_type in ('click', 'purchase')), '') as kept, coalesce(sum(n) filter (event_type not in ('click', 'purchase')), 0)::bigint as dropped from e group by 1""",
    "coerced": """select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, floor(epoch(ts))::bigint as from_seconds, floor(epoch(ts))::bigint as from_millis,
      json_extract_string(props, '$.k') as first_present from events""",
}
