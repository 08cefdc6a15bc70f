"""Queries of lexical features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import automaton as A
from weftline.functions import lexical as L
from weftline.functions.text import joined
from weftline.operators import keyphrases as K
from weftline.sources.tables import spread, table

#: Forms of each tag in the languages of the test data, and words of each label.
LEXICON = {"the": ["the ", "The "], "und": ["und ", "der "], "les": ["les ", "des "], "los": ["los ", "que "], "ing": ["ing"]}
WORDS = {"english": ["the", "tion", "and"], "german": ["der", "sch", "ung"], "french": ["eau", "eux", "oi"], "spanish": ["ción", "ll", "ñ"]}


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as comments of one id."""
    return spread(table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), "text"))


def ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.frequencies(_turns(spark, sf_dir), "item_id", "text").select("item_id", "gram", "n", F.round(L.gram_score(F.col("gram"), F.col("n")), 6).alias("score"))


def keyphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.keyphrases(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").select("doc_id", F.array_join("phrases", "|").alias("phrases"))


def keyphrases_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases that turns of one conversation share."""
    return K.keyphrases_across(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.array_join("phrases", "|").alias("phrases"))


def lexicon_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(L.lexicon_tags(F.col("text"), LEXICON, 3), ",").alias("tags"))


def lexicon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(L.lexicon_scores(F.col("text"), WORDS)).alias("rank", "s"))
    return d.select("doc_id", "rank", "s.label", "s.score")


def _forms(spark: SparkSession, sf_dir: str) -> list[str]:
    """The lexicon of the benchmark: its words of four letters and more, an answer of the size of a lexicon."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("form"))
    return [r["form"] for r in words.distinct().collect()]


def _lexicon(forms: list[str], letters: int) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for f in forms:
        out.setdefault(f[:letters], []).append(f)
    return out


def lexicon_tags_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents tagged by all words of the benchmark as forms, those that begin alike for one tag."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.array_join(A.tags(F.col("text"), _lexicon(_forms(spark, sf_dir), 2), 3), ",").alias("tags"))


def lexicon_score_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored by the same words, by their first letter."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    s = d.select("doc_id", F.posexplode(A.scores(F.col("text"), _lexicon(_forms(spark, sf_dir), 1))).alias("rank", "s"))
    return s.filter("rank < 5").select("doc_id", "rank", "s.label", "s.score")


def rank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user by frequency, equal ones by first appearance."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("n"), "first"))).drop("first")


def pair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pair of a user's ranked event types that a template table has, in either order."""
    r = rank_labels(spark, sf_dir)
    a, b = (r.select("user_id", F.col("event_type").alias(x), F.col("rank").alias(f"r{x}")) for x in "ab")
    pairs = a.join(b, "user_id").filter("ra < rb").withColumn("pair", F.concat_ws("-", F.least("a", "b"), F.greatest("a", "b")))
    templates = table(spark, sf_dir, "events").select("event_type").distinct()
    t1, t2 = templates.withColumnRenamed("event_type", "x"), templates.withColumnRenamed("event_type", "y")
    known = t1.join(t2, F.col("x") < F.col("y")).filter(F.substring("x", 1, 1) != "c").select(F.concat_ws("-", "x", "y").alias("pair"))
    hit = pairs.join(known, "pair").groupBy("user_id").agg(F.min_by("pair", F.struct("ra", "rb")).alias("pair"))
    return r.select("user_id").distinct().join(hit, "user_id", "left").withColumn("pair", F.coalesce("pair", F.lit("none")))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that cite their own and a later turn, one malformed: valid, total and coverage against the conversation's turns."""
    c = table(spark, sf_dir, "conversations")
    cited = F.concat("text", F.lit(" [[ev:"), "turn", F.lit("]] and [[ EV : "), F.col("turn") + 1, F.lit(" ]] and [[ev:no such]]"))
    pool = c.groupBy("conv_id").agg(F.collect_set(F.col("turn").cast("string")).alias("pool"))
    told = c.select("conv_id", "turn", cited.alias("cited")).join(pool, "conv_id")
    total, valid = F.size(L.attempts(F.col("cited"))), F.size(F.filter(L.attempts(F.col("cited")), lambda x: F.array_contains(F.col("pool"), x)))
    return told.select("conv_id", "turn", F.size(L.markers(F.col("cited"))).cast("long").alias("markers"), total.cast("long").alias("total"), valid.cast("long").alias("valid"), L.coverage(valid, total).alias("coverage"))


def cjk_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(L.cjk_share(F.concat("text", F.lit("。中文"))), 6).alias("share"))


def lossless_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(L.lossless(F.concat(F.lit("﻿ \t"), F.regexp_replace("text", r"\. ", " .  \r\n\r\n\r\n"), F.lit(" \n ")))).alias("cleaned"))


def query_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", joined(F.array("role"), F.split("text", " "), F.array(F.lit(" a  b "), "role")).alias("query"))


def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's text with its tags before it; absent parts are left out."""
    d = table(spark, sf_dir, "documents")
    concept = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("概念："), "source"))
    return d.select("doc_id", F.sha2(F.concat_ws("｜", concept, F.concat(F.lit("关键词："), "lang"), "text"), 256).alias("digest"))


QUERIES = {f.__name__: f for f in (ngram_df, keyphrases, keyphrases_across, lexicon_tags, lexicon_score, lexicon_tags_many, lexicon_score_many, rank_labels, pair_lookup, citations, cjk_ratio, lossless_clean, query_join, embedding_text)}

_GRAMS = f"""runs as (select item_id, unnest(list_filter(string_split_regex(text, '{L.RUN_BREAK}'), lambda r: length(r) >= 2)) as r from (select conv_id * 1000 + turn as item_id, text from conversations)),
  g as (select item_id, substr(r, i::int, n::int) as gram from runs, range(2, 5) t(n), lateral (select unnest(range(1, length(r) - n + 2)) as i) where n <= length(r)),
  f as (select item_id, gram, count(*) as n from g group by 1, 2)"""
_TAGS = ", ".join(f"(list_min(list_filter([{', '.join(f'''instr(text, '{f}')''' for f in forms)}], lambda p: p > 0)), '{t}')" for t, forms in LEXICON.items())
_LABELS = " union all ".join(f"select doc_id, '{label}' as label, {' + '.join(f'''(case when contains(text, '{w}') then {1 + 0.35 * len(w)} else 0 end)''' for w in ws)} as s from documents" for label, ws in WORDS.items())
_RANK = "r as (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, min(event_id)) as rank from events group by 1, 2)"
_FORMS = "f as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) as form from benchmark), m as (select doc_id, form, instr(text, form) as p from documents, f where contains(text, form))"
ORACLE_SQL = {
    "lexicon_tags_many": f"""with {_FORMS}, t as (select doc_id, left(form, 2) as tag, min(p) as p from m group by 1, 2), r as (select *, row_number() over (partition by doc_id order by p, tag) as n from t)
      select d.doc_id, coalesce(string_agg(tag, ',' order by n), '') as tags from documents d left join r on d.doc_id = r.doc_id and n <= 3 group by 1""",
    "lexicon_score_many": f"""with {_FORMS}, s as (select doc_id, left(form, 1) as label, round(sum(1 + 0.35 * length(form))::double, 6) as score from m group by 1, 2)
      select * from (select doc_id, (row_number() over (partition by doc_id order by score desc, label) - 1)::bigint as rank, label, score from s) where rank < 5""",
    "ngram_df": f"with {_GRAMS} select item_id, gram, n, round(ln(1 + n) * pow(length(gram), 1.2), 6) as score from f",
    "lexicon_tags": f"""with t as (select doc_id, unnest([{_TAGS}]) as x from documents), r as (select doc_id, x[2] as tag, row_number() over (partition by doc_id order by x[1], x[2]) as n from t where x[1] is not null)
      select d.doc_id, coalesce(string_agg(tag, ',' order by n), '') as tags from documents d left join r on d.doc_id = r.doc_id and n <= 3 group by 1""",
    "lexicon_score": f"select doc_id, (row_number() over (partition by doc_id order by s desc, label) - 1)::bigint as rank, label, round(s::double, 6) as score from ({_LABELS}) where s > 0",
    "rank_labels": f"with {_RANK} select user_id, event_type, n, rank from r",
    "pair_lookup": f"""with {_RANK}, k as (select distinct a.event_type || '-' || b.event_type as pair from events a, (select distinct event_type from events) b where a.event_type < b.event_type and a.event_type[1] <> 'c'),
      p as (select a.user_id, least(a.event_type, b.event_type) || '-' || greatest(a.event_type, b.event_type) as pair, a.rank as ra, b.rank as rb from r a join r b on a.user_id = b.user_id and a.rank < b.rank),
      h as (select user_id, arg_min(pair, (ra, rb)) as pair from p join k using (pair) group by 1)
      select u.user_id, coalesce(pair, 'none') as pair from (select distinct user_id from events) u left join h using (user_id)""",
    "citations": """with p as (select conv_id, list(turn) as pool from conversations group by 1)
      select conv_id, turn, 1::bigint as markers, 3::bigint as total, 1 + list_contains(pool, turn + 1)::bigint as valid, round_even(((1 + list_contains(pool, turn + 1)::int) / 3.0)::decimal(18, 9), 4)::double as coverage from conversations join p using (conv_id)""",
    "cjk_ratio": """with s as (select doc_id, left(text || '。中文', 4000) as t from documents) select doc_id, round(length(regexp_replace(t, '[^\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}]', '', 'g')) / length(t), 6) as share from s""",
    "lossless_clean": """with a as (select doc_id, chr(65279) || ' ' || chr(9) || regexp_replace(text, '\\. ', ' .  ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10), 'g') || ' ' || chr(10) || ' ' as t from documents),
      b as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '[\\x{200B}-\\x{200F}\\x{2028}\\x{2029}\\x{FEFF}]', '', 'g'), '[ \\t\\x{3000}]+', ' ', 'g') as t from a),
      c as (select doc_id, array_to_string(list_transform(string_split(t, chr(10)), lambda l: trim(l, ' ')), chr(10)) as t from b)
      select doc_id, md5(regexp_replace(regexp_replace(t, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as cleaned from c""",
    "query_join": """with w as (select conv_id, turn, list_filter(list_concat(list_transform(list_concat([role], string_split(text, ' ')), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), ['a b', role]), lambda x: length(x) >= 2) as l from conversations)
      select conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as query from w""",
    "embedding_text": "select doc_id, sha256(case when doc_id % 3 = 0 then '概念：' || source || '｜' else '' end || '关键词：' || lang || '｜' || text) as digest from documents",
}
