"""Queries of cited prose, reasoning steps, representative texts, drafts and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.lexical import lexicon_tags
from weftline.operators import reports as P
from weftline.operators.fusion import library_order
from weftline.plans.lexical import LEXICON
from weftline.sources.tables import table
from weftline.streaming.events import in_band


def cited_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that cite an even turn of their own; the odd ones, a malformed and an unclosed marker are dropped."""
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("A [[ev:"), "turn", F.lit("]] b [[ ev : x y ]] c [[ev:"), F.col("turn") * 2, F.lit("]] d [[ev:z"))
    pool = F.transform(F.sequence(F.lit(0), F.lit(50)), lambda x: (x * 2).cast("string"))
    told = c.select("conv_id", "turn", P.cited(text, pool).alias("r"))
    return told.select("conv_id", "turn", "r.clean", F.array_join("r.cited", ",").alias("cited"), "r.total", F.size("r.dropped").cast("long").alias("dropped"))


def reasoning_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its steps: parts and suppliers as evidence, one flag as no phenomenon."""
    l = table(spark, sf_dir, "lineitem")
    ids = F.array(F.col("l_partkey") % 10, F.col("l_suppkey") % 10, F.col("l_partkey") % 10)
    raw = l.select(F.col("l_orderkey").alias("run_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("pos"), F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_shipdate").cast("string")).alias("phenomenon"), ids.alias("evidence_ids"), F.reverse(ids).alias("allusion_ids"))
    pool, allusions = (F.array(*(F.lit(x).cast("bigint") for x in xs)) for xs in ((0, 2, 4, 5, 6, 8), (1, 2, 3, 5, 8)))
    s = P.steps(raw, ("run_id",), pool, allusions)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return s.select("run_id", "step_index", joined("evidence").alias("evidence"), joined("allusion").alias("allusion"), "lost")


def representative_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as clusters: ids of three turns and one that isn't there; every fourth has none that is."""
    c = table(spark, sf_dir, "conversations")
    clusters = c.groupBy("conv_id").agg(F.lit("c0").alias("cluster_key")).withColumn("ids", F.when(F.col("conv_id") % 4 == 0, F.array(F.lit(900))).otherwise(F.array(F.lit(901), F.lit(1), F.lit(0))).cast("array<bigint>")).withColumn("keywords", F.array(F.lit("k1"), F.lit("k2")))
    texts = c.select("conv_id", F.col("turn").alias("id"), "text")
    r = P.representatives(clusters, texts, ("conv_id",))
    return r.select("conv_id", F.array_join("texts", "|").alias("texts"))


def section_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 10) / 10).alias("a"), ((F.col("o_custkey") % 10) / 10).alias("b"))
    return o.select("o_orderkey", P.better_draft(F.col("a"), F.col("b")).alias("kept"))


def citation_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.col("l_linenumber") * 40).alias("evidence_id"), "l_orderkey", "l_linenumber")
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("evidence_id"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("author"), F.when(F.col("p_size") < 40, F.col("p_type")).alias("source"))
    return P.captions(l, e).groupBy("caption").agg(F.count("*").alias("n"))


def persist_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's later half of messages goes on after its earlier half's last seq."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    last = c.filter("turn < 3").groupBy("conv_id").agg((F.max("turn") * 10).alias("last_seq"))
    return P.continued(c.filter("turn >= 3"), last, "conv_id", "turn").select("conv_id", "turn", "seq")


def work_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("《"), "role", F.lit("》和《"), F.regexp_replace("text", "[《》]", ""), F.lit("》与《"), "role", F.lit("》"))
    return c.select("conv_id", "turn", F.array_join(P.names_of_works(text), ",").alias("names"))


def line_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", P.anchor(F.concat("role", F.lit("："), "text", F.lit("（笑）"))).alias("anchor"))


def progress_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = (F.col("user_id") % 7 * 14).cast("double")
    return e.select("event_id", in_band(start, start + 14, F.col("event_id") % 9 / 8).alias("progress"))


def poem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short passages with at least one tag of two lexicons, without white space."""
    first, second = dict(list(LEXICON.items())[:3]), dict(list(LEXICON.items())[3:])
    b = table(spark, sf_dir, "benchmark").withColumn("bare", F.regexp_replace("text", r"\s+", ""))
    told = b.withColumns({"imagery": lexicon_tags(F.col("text"), first, 3), "emotion": lexicon_tags(F.col("text"), second, 3)})
    kept = told.filter(F.length("bare").between(14, 160) & ~F.contains("bare", F.lit("□")) & (F.size("imagery") > 0) & (F.size("emotion") > 0))
    return kept.select("item_id", F.substring(F.sha1("bare"), 1, 12).alias("chunk_id"), F.array_join("imagery", ",").alias("imagery"), F.array_join("emotion", ",").alias("emotion"))


def chunk_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("source"))
    return d.select("doc_id", P.payload(d, "lang", "source").alias("payload"))


def evidence_by_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by library in the order of priority; unknown libraries come last."""
    d = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "en", "psychology").when(F.col("lang") == "fr", "poetry").otherwise(F.col("lang")).alias("library"))
    n = d.groupBy("library").agg(F.count("*").alias("n"))
    place = F.when(library_order(F.col("library")) > 0, library_order(F.col("library"))).otherwise(F.lit(9))
    return n.select("library", "n", place.alias("place"))


QUERIES = {f.__name__: f for f in (cited_prose, reasoning_steps, representative_texts, section_retry, citation_captions, persist_turn, work_names, line_anchor, progress_band, poem_rows, chunk_payload, evidence_by_library)}

_FIRST, _SECOND = list(LEXICON.items())[:3], list(LEXICON.items())[3:]


def _tags(items: list) -> str:
    found = ", ".join(f"(list_min(list_filter([{', '.join(f'''instr(text, '{f}')''' for f in forms)}], lambda p: p > 0)), '{t}')" for t, forms in items)
    return f"array_to_string(list_transform(list_sort(list_filter([{found}], lambda x: x[1] is not null))[1:3], lambda x: x[2]), ',')"


ORACLE_SQL = {
    "cited_prose": """select conv_id, turn, 'A ' || case when turn % 2 = 0 then '[^1]' else '' end || ' b  c ' || case when turn * 2 <= 100 then (case when turn % 2 = 0 then '[^2]' else '[^1]' end) else '' end || ' d ' as clean,
      case when turn % 2 = 0 then turn || ',' || (turn * 2) else (turn * 2)::varchar end as cited, 4::bigint as total, (case when turn % 2 = 0 then 2 else 3 end)::bigint as dropped from conversations""",
    "reasoning_steps": """with n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n, l_partkey % 10 as a, l_suppkey % 10 as b from lineitem),
      k as (select *, row_number() over (partition by l_orderkey order by n) as step_index, list_filter(case when a = b then [a] else [a, b] end, lambda x: list_contains([0, 2, 4, 5, 6, 8], x)) as e,
        list_filter(case when a = b then [a] else [a, b] end, lambda x: list_contains([1, 2, 3, 5, 8], x)) as l from n where n <= 5 and l_returnflag <> 'N')
      select l_orderkey as run_id, step_index, array_to_string(e, ',') as evidence, array_to_string(list_filter(l, lambda x: not list_contains(e, x)), ',') as allusion,
        (2 * (not list_contains([0, 2, 4, 5, 6, 8], a))::int + (not list_contains([0, 2, 4, 5, 6, 8], b))::int)::bigint as lost from k""",
    "representative_texts": """select conv_id, case when conv_id % 4 = 0 or max(case when turn in (0, 1) and text <> '' then 1 else 0 end) = 0 then 'k1|k2' else string_agg(left(text, 120), '|' order by turn desc) filter (turn in (0, 1) and text <> '') end as texts from conversations group by 1""",
    "section_retry": "select o_orderkey, (o_orderkey % 10 < 6 and o_custkey % 10 > o_orderkey % 10)::bigint as kept from orders",
    "citation_captions": """select nullif(concat_ws('·', case when p_size > 10 then p_brand end, case when p_size < 40 then p_type end), '') as caption, count(*) as n from lineitem left join part on p_partkey = l_partkey + l_linenumber * 40 group by 1""",
    "persist_turn": """with l as (select conv_id, max(turn) * 10 as s from conversations where turn < 3 group by 1)
      select conv_id, turn, coalesce(s, 0) + row_number() over (partition by conv_id order by turn) as seq from conversations left join l using (conv_id) where turn >= 3""",
    "work_names": "select conv_id, turn, case when regexp_replace(text, '[《》]', '', 'g') in (role, '') then role else role || ',' || regexp_replace(text, '[《》]', '', 'g') end as names from conversations",
    "line_anchor": """with c as (select conv_id, turn, list_filter(string_split_regex(text, '[，。！？；、,.!?;\\s]+'), lambda x: trim(x) <> '') as l, text from conversations)
      select conv_id, turn, right(regexp_replace(coalesce(l[len(l)], text), '[^\\p{L}\\p{N}]', '', 'g'), 4) as anchor from c""",
    "progress_band": "select event_id, round_even((user_id % 7 * 14 + 13.0 * (event_id % 9) / 8)::decimal(18, 6), 1)::double as progress from events",
    "poem_rows": f"""with b as (select *, regexp_replace(text, '\\s+', '', 'g') as bare from benchmark), t as (select item_id, bare, {_tags(_FIRST)} as imagery, {_tags(_SECOND)} as emotion from b)
      select item_id, left(sha1(bare), 12) as chunk_id, imagery, emotion from t where length(bare) between 14 and 160 and imagery <> '' and emotion <> ''""",
    "chunk_payload": """select doc_id, '{"lang":"' || lang || '"' || case when doc_id % 2 = 0 then ',"source":"' || source || '"' else '' end || '}' as payload from documents""",
    "evidence_by_library": """select case lang when 'en' then 'psychology' when 'fr' then 'poetry' else lang end as library, count(*) as n, (case lang when 'en' then 1 when 'fr' then 3 else 9 end)::bigint as place from documents group by lang""",
}
