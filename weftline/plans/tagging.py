"""Queries of tags, of answers of other services, and of the ingest chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import payload as J
from weftline.operators import graph as G
from weftline.operators import incremental as I
from weftline.operators import tagging as T
from weftline.operators import tagrounds as R
from weftline.plans.lexical import LEXICON
from weftline.plans.services import _C, _R, FILES, _chunks, _registry
from weftline.sources.tables import table

_FIRST, _SECOND = dict(list(LEXICON.items())[:3]), dict(list(LEXICON.items())[3:])
_BATCH = 8


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.first_sentence(F.translate("text", ".", "。")).alias("quote"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.floor(F.col("doc_id") / _BATCH).alias("batch"), F.col("doc_id").alias("i"), "text", "lang", "source")


def _returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model gives back: the text's beginning as a quote, for some the next text's, none for some rows, and tags right and wrong."""
    t = _texts(spark, sf_dir).select("batch", "i", F.substring("text", 1, 60).alias("text"))
    then = F.lead("text").over(W.partitionBy("batch").orderBy("i"))
    quote = F.when(F.col("i") % 50 == 3, F.substring(F.coalesce(then, F.lit("none")), 1, 60)).when(F.col("i") % 11 == 5, F.lit("in no text")).otherwise(F.substring("text", 1, 30))
    tags = F.array(F.concat(F.lit(" "), F.substring("text", 1, 4)), F.lit("a：b"), F.lit("x" * 30), F.lit("zzqq"), F.substring("text", 1, 4), F.lit("the"))
    return t.filter("i % 90 != 11").select("batch", "i", quote.alias("quote"), tags.alias("tags"))


def tag_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose quote is another row's."""
    return T.misplaced(_texts(spark, sf_dir), _returned(spark, sf_dir)).select("batch", "i")


def tag_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.accepted(_texts(spark, sf_dir), _returned(spark, sf_dir)).select("batch")


def tag_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    return T.refused(_returned(spark, sf_dir).join(t.select("batch", "i", "text"), ["batch", "i"]), "tags", "text")


def tagged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir)
    rules = t.select("batch", "i", F.substring("text", 1, 10).alias("quote"), F.array("lang").alias("tags"))
    return T.tagged(t, _returned(spark, sf_dir), rules).select("i", "quote", F.array_join("tags", "|").alias("tags"), "source")


def _rows_to_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    library = F.when(F.col("lang") == "en", "psychology").when(F.col("lang") == "fr", "literature").otherwise("poetry")
    return _texts(spark, sf_dir).select("batch", "i", library.alias("library"), "text")


def _model(spark: SparkSession, sf_dir: str):
    """A model that gives back no answer for a part with a document of poor quality, and tags right and wrong for others."""
    poor = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("i")).distinct()
    word = F.regexp_extract("text", "[A-Za-z]{2,8}", 0)
    item = F.struct(
        F.substring("text", 1, 30).alias("quote"), F.when(F.col("library") == "poetry", "诗").otherwise("nothing").alias("type"), F.concat("library", F.when(F.col("i") % 7 == 0, "：x").otherwise("")).alias("concept"),
        F.array(word, F.lit("x" * 30), F.lit("a：b"), F.lit("zzqqzz")).alias("keywords"), F.array(word).alias("imagery"), F.array(F.lit("平静"), F.lit("joy"), F.lit("平静")).alias("emotion"),
    )
    mixed = F.when(F.col("i") % 5 == 0, F.parse_json(F.concat(F.substring(F.to_json(item), 1, F.length(F.to_json(item)) - 1), F.lit(',"keywords2":1}')))).otherwise(F.parse_json(F.to_json(item)))

    def ask(parts: DataFrame, n: int) -> DataFrame:
        lost = parts.join(poor, "i", "left_semi").select("part").distinct()
        return parts.join(lost, "part", "left_anti").select("part", "i", mixed.alias("item"), F.lit(False).alias("cut"))

    return ask


def tag_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches in rounds: when each document's part was taken, or that none was, and what of its answer stayed."""
    rows = _rows_to_tag(spark, sf_dir)
    done, failed = R.in_rounds(rows, _model(spark, sf_dir), ("平静",), partial=True)
    told = done.select("i", "round", F.col("tags").isNotNull().alias("by_model"), F.col("tags.concept").alias("concept"), F.array_join("tags.keywords", "|").alias("keywords"), F.array_join("tags.imagery", "|").alias("imagery"), F.array_join("tags.emotion", "|").alias("emotion"), F.col("tags.type").alias("type"), F.array_join(F.array_sort("reasons"), "|").alias("reasons"))
    none = [F.lit(None).cast("string").alias(c) for c in ("concept", "keywords", "imagery", "emotion", "type", "reasons")]
    return told.unionByName(failed.select("i", "round", F.lit(False).alias("by_model"), *none))


def tag_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons for which something of the answers was not taken."""
    done, _ = R.in_rounds(_rows_to_tag(spark, sf_dir), _model(spark, sf_dir), ("平静",), partial=True)
    return R.refusals(done, len(R.REASONS))


def assembled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with rule tags as chunks: empty ones go, equal texts of a library become one."""
    library = F.when(F.col("lang") == "en", "psychology").when(F.col("lang") == "fr", "literature").otherwise("poetry")
    d = _docs(spark, sf_dir).withColumns({"library": library, "keyphrases": F.filter(F.array(F.substring("text", 1, 3)), lambda x: F.trim(x) != ""), "hint": F.lit(""), "work": F.col("source")})
    kept = T.assembled(T.lexical_tags(d, _FIRST, _SECOND), F.md5(F.concat_ws("|", "library", "text")), "doc_id")
    return kept.select("doc_id", "chunk_id", "concept", F.array_join("imagery", ",").alias("imagery"), F.array_join("emotion", ",").alias("emotion"), "type")


def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as answers of three shapes: bare, wrapped once or twice, or failed."""
    c = table(spark, sf_dir, "customer")
    row = F.to_json(F.struct(F.col("c_name").alias("title"), (F.col("c_custkey") % 3).alias("cursor"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("likes")))
    lists = F.to_json(F.array((F.col("c_custkey") % 7).cast("int"), F.lit(1)))
    bare = F.concat(F.lit('{"items":'), lists, F.lit(',"video":'), row, F.lit("}"))
    shape = F.when(F.col("c_custkey") % 4 == 0, bare).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('{"data":'), bare, F.lit(',"success":true}'))).when(F.col("c_custkey") % 4 == 2, row).otherwise(F.lit('{"success":false,"error":"busy"}'))
    p = c.select("c_custkey", F.parse_json(shape).alias("p"))
    inner = p.withColumns({"failure": J.failure(F.col("p")), "items": J.first_list(F.col("p"), ("data", "items")), "row": J.unwrapped(J.unwrapped(F.col("p"), ("data",)), ("video", "detail"))})
    return inner.select("c_custkey", "failure", F.to_json("items").alias("items"), J.first_present(F.col("row"), "title", "name").alias("title"), J.first_present(F.col("row"), "likes", "cursor", kind="bigint").alias("n"))


def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON as it is, in a fence, among words, cut off, or not at all."""
    o = table(spark, sf_dir, "orders")
    j = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    k = F.col("o_orderkey") % 6
    text = F.when(k == 0, F.concat(F.lit("  "), j, F.lit("\n"))).when(k == 1, F.concat(F.lit("```json\n"), j, F.lit("\n``` ok"))).when(k == 2, F.concat(F.lit("Here: "), j, F.lit(" as you asked"))).when(k == 3, F.substring(j, 1, 20)).when(k == 4, F.concat(F.lit("```"), j)).otherwise(F.lit("none"))
    v = J.repaired(text)
    return o.select("o_orderkey", F.try_variant_get(v, "$.o_orderkey", "bigint").alias("key"), F.try_variant_get(v, "$.o_orderstatus", "string").alias("status"))


def _hashed(c: Column) -> Column:
    return F.md5(c)


def full_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after a whole ingest: changed chunks are embedded and put in, and what the corpus no longer has is taken out."""
    c, r = _chunks(spark, sf_dir), _registry(spark, sf_dir)
    todo = I.diff(c, r).filter("action != 'skipped'")
    known = I.upserted(r.select("chunk_id", "source_file", "content_hash"), todo.select("chunk_id", "source_file", "content_hash"), ("chunk_id",))
    after = I.deleted(known, I.orphans(known, c, FILES), "chunk_id")
    vectors = todo.select("chunk_id", _hashed(F.col("content_hash")).alias("digest"))
    return after.join(vectors, "chunk_id", "left").select("chunk_id", "source_file", "content_hash", "digest")


def corpus_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry rows of one library that corpus files gave."""
    return _registry(spark, sf_dir).filter(F.col("source_file").isin(*FILES) & F.col("library").isin("en", "fr")).select("chunk_id")


def registry_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).filter(~F.col("library").isin("en")).select("chunk_id", "library")


def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 40 documents of a source."""
    d = table(spark, sf_dir, "documents").filter("source = 'src1'")
    return d.orderBy("doc_id").limit(40).select("doc_id", F.substring("text", 1, 120).alias("preview"))


def list_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_orderstatus")


def collection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by label once their number of dimensions is checked; another number ends the query."""
    return I.of_dimension(table(spark, sf_dir, "embeddings"), "embedding", 64).groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim"))


def new_poems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poems whose id is not known yet, equal ones once, from the first source in order."""
    d = _docs(spark, sf_dir).select(F.md5("text").alias("chunk_id"), "source", "doc_id")
    known = d.filter("doc_id % 3 = 0").select("chunk_id")
    return I.unseen(d, known, "chunk_id", F.struct("source", "doc_id")).select("chunk_id", "doc_id")


def page_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of overlapping pages, each once and without those seen before; ids may repeat in a page."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("comment_id"), "event_id")
    return I.unseen(e.filter("event_id % 4 != 0"), e.filter("event_id < 100"), "comment_id", F.col("event_id")).select("comment_id", "event_id")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    library = F.when(F.col("p_size") % 2 == 0, "psychology").otherwise("poetry")
    return p.select(F.col("p_partkey").alias("chunk_id"), library.alias("library"), F.col("p_name").alias("text"), F.array("p_brand").alias("imagery"), F.array("p_type").alias("emotion"), F.col("p_brand").alias("work"), F.col("p_type").alias("author"), F.when(F.col("p_size") > 20, F.col("p_type")).alias("concept"))


def chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunk_nodes(_nodes(spark, sf_dir)).select("chunk_id", "library", "snippet")


def work_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with the author of their first chunk."""
    return G.work_nodes(_nodes(spark, sf_dir), "chunk_id").select("work", "author")


def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.concept_edges(_nodes(spark, sf_dir)).select("src", "dst")


def detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by label before and after chunks are deleted with their edges; shared nodes stay."""
    n = _nodes(spark, sf_dir)
    gone = n.filter("chunk_id % 4 = 0").select("chunk_id")
    edges = G.derived_edges(n.withColumn("character", F.lit(None).cast("string")))
    kept = G.without_chunks(edges, gone)
    deleted = n.join(gone, "chunk_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("deleted").alias("name"), "n")
    return G.label_counts({"chunks": n.join(gone, "chunk_id", "left_anti").select("chunk_id"), "works": n.select("work")}).unionByName(deleted).unionByName(kept.groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n")))


QUERIES = {
    f.__name__: f
    for f in (
        first_sentence, tag_quotes, tag_batches, tag_refusals, tagged_chunks, tag_rounds, tag_reasons, assembled_chunks, payload_fields, json_repair, full_ingest, corpus_ids, registry_clear,
        source_documents, list_imports, collection_check, new_poems, page_unseen, chunk_nodes, work_nodes, concept_edges, detach_delete,
    )
}


_ROUNDS = """t as (select doc_id // 8 as batch, doc_id as i, coalesce(text, '') as text, case lang when 'en' then 'psychology' when 'fr' then 'literature' else 'poetry' end as library, row_number() over (partition by doc_id // 8 order by doc_id) - 1 as k,
    doc_id in (select doc_id from labels where quality = 0) as poor, trim(left(coalesce(text, ''), 30)) <> '' as quoted from documents),
  p(batch, lo, hi, round, i, bad) as (
    select batch, 0::bigint, count(*) over (partition by batch), 0, i, bool_or(poor) over (partition by batch) or not bool_or(quoted) over (partition by batch) from t
    union all
    select h.batch, h.lo, h.hi, h.round, t.i, bool_or(t.poor) over (partition by h.batch, h.lo) or not bool_or(t.quoted) over (partition by h.batch, h.lo)
      from (select distinct batch, round + 1 as round, unnest([lo, lo + (hi - lo) // 2]) as lo, unnest([lo + (hi - lo) // 2, hi]) as hi from p where bad and hi - lo > 1) h join t on t.batch = h.batch and t.k >= h.lo and t.k < h.hi),
  w as (select p.i, p.round, library, quoted, regexp_extract(text, '[A-Za-z]{2,8}') as word, p.i % 7 = 0 as odd from p join t using (i) where not bad),
  o as (select i, round, quoted as by_model, case when quoted then case when odd then '' else library end end as concept, case when quoted then word end as keywords, case when quoted then case when library = 'psychology' then '' else word end end as imagery,
    case when quoted then '平静' end as emotion, case when quoted then case when library = 'poetry' then '诗' else '' end end as type,
    case when not quoted then ['no quote'] else ['emotion', 'length', 'character', 'foreign'] || case when library <> 'poetry' then ['type'] else [] end || case when odd then ['character'] else [] end
      || case when word = '' then ['length', 'length'] when library = 'psychology' then ['imagery'] else [] end end as reasons from w)"""


def _sql_tags(lexicon: dict) -> str:
    found = ", ".join(f"(list_min(list_filter([{', '.join(f'''instr(text, '{f}')''' for f in forms)}], lambda p: p > 0)), '{t}')" for t, forms in lexicon.items())
    return f"array_to_string(list_transform(list_sort(list_filter([{found}], lambda x: x[1] is not null))[1:3], lambda x: x[2]), ',')"


_T = f"""t as (select doc_id // {_BATCH} as batch, doc_id as i, coalesce(text, '') as text, lang, source from documents),
  r as (select batch, i, text, case when i % 50 = 3 then left(coalesce(then_, 'none'), 60) when i % 11 = 5 then 'in no text' else left(text, 30) end as quote from (select *, lead(text) over (partition by batch order by i) as then_ from t) where i % 90 <> 11),
  m as (select distinct r.batch, r.i from r join t on t.batch = r.batch and t.i <> r.i where trim(quote) <> '' and not contains(r.text, trim(quote)) and contains(t.text, trim(quote))),
  a as (select batch from t group by 1 having count(*) = count(*) filter (i % 90 <> 11) and batch not in (select batch from m))"""
_TAG_ROWS = "select i, text, unnest([' ' || left(text, 4), 'a：b', repeat('x', 30), 'zzqq', left(text, 4), 'the']) as tag, generate_subscripts([1, 2, 3, 4, 5, 6], 1) as n from r"
_REFUSAL = "case when trim(tag) = '' or length(trim(tag)) > 20 then 'length' when regexp_matches(trim(tag), '[｜《》〈〉：、\\n\\r\\t]') then 'character' when not contains(text, trim(tag)) then 'foreign' end"
ORACLE_SQL = {
    "first_sentence": """with d as (select doc_id, translate(coalesce(text, ''), '.', '。') as text from documents), s as (select doc_id, text, regexp_extract(text, '[^。！？；…!?;]+[。！？；…!?;]?') as s from d)
      select doc_id, trim(left(case when s <> '' then s else text end, 40)) as quote from s""",
    "tag_quotes": f"with {_T} select batch, i from m",
    "tag_batches": f"with {_T} select batch from a",
    "tag_refusals": f"with {_T} select reason, count(*) as n from (select {_REFUSAL} as reason from ({_TAG_ROWS})) where reason is not null group by 1 order by n desc, reason limit 4",
    "tag_rounds": f"with recursive {_ROUNDS} select i, round, by_model, concept, keywords, imagery, emotion, type, array_to_string(list_sort(reasons), '|') as reasons from o union all select i, round, false, null, null, null, null, null, null from p where bad and hi - lo = 1",
    "tag_reasons": f"with recursive {_ROUNDS}, x as (select unnest(reasons) as reason from o) select reason, count(*) as n from x group by 1",
    "tagged_chunks": f"""with {_T}, g as (select i, trim(tag) as tag, min(n) as n from ({_TAG_ROWS}) where {_REFUSAL} is null group by 1, 2), k as (select i, array_to_string(list(tag order by n)[1:3], '|') as tags from g group by 1),
        ok as (select i, trim(quote) as quote from r where batch in (select batch from a) and trim(quote) <> '' and contains(text, trim(quote)))
      select i, quote, coalesce(tags, '') as tags, 'llm' as source from ok left join k using (i) union all select i, left(text, 10), lang, 'lexical' from t where i not in (select i from ok)""",
    "assembled_chunks": f"""with d as (select doc_id, source, coalesce(text, '') as text, case lang when 'en' then 'psychology' when 'fr' then 'literature' else 'poetry' end as library from documents),
        k as (select doc_id, md5(library || '|' || text) as chunk_id, library, case when library = 'psychology' then coalesce(nullif(case when trim(left(text, 3)) <> '' then left(text, 3) end, ''), nullif(left(source, 8), ''), '未命名概念') end as concept,
          case when library = 'psychology' then '' else {_sql_tags(_FIRST)} end as imagery, {_sql_tags(_SECOND)} as emotion, case library when 'psychology' then '论述' when 'literature' then '散文' else '诗' end as type from d),
        n as (select *, row_number() over (partition by chunk_id order by doc_id) as n from k where library = 'psychology' or imagery <> '' or emotion <> '')
      select doc_id, chunk_id, concept, imagery, emotion, type from n where n = 1""",
    "payload_fields": """select c_custkey, case when c_custkey % 4 = 3 then 'busy' end as failure, case when c_custkey % 4 in (0, 1) then '[' || (c_custkey % 7) || ',1]' else '[]' end as items,
      case when c_custkey % 4 <> 3 then c_name end as title, case when c_custkey % 4 <> 3 then (case when c_custkey % 5 <> 0 then c_nationkey else c_custkey % 3 end)::bigint end as n from customer""",
    "json_repair": "select o_orderkey, case when o_orderkey % 6 in (0, 1, 2, 4) then o_orderkey end as key, case when o_orderkey % 6 in (0, 1, 2, 4) then o_orderstatus end as status from orders",
    "full_ingest": f"""with {_R}, n as (select * from d where action <> 'skipped'), k as (select chunk_id, source_file, content_hash from r where chunk_id not in (select chunk_id from n) union all select chunk_id, source_file, content_hash from n)
      select k.chunk_id, k.source_file, k.content_hash, md5(n.content_hash) as digest from k left join n using (chunk_id) where not (coalesce(k.source_file, '') in ('src0', 'src1', 'src2') and k.chunk_id not in (select chunk_id from c))""",
    "corpus_ids": f"with {_R} select chunk_id from r where source_file in ('src0', 'src1', 'src2') and library in ('en', 'fr')",
    "registry_clear": f"with {_R} select chunk_id, library from r where library not in ('en')",
    "source_documents": "select doc_id, left(text, 120) as preview from documents where source = 'src1' order by doc_id limit 40",
    "list_imports": "select o_orderkey, o_orderstatus from orders order by o_orderdate desc, o_orderkey desc limit 20",
    "collection_check": "select label, count(*) as n, min(len(embedding)) as dim from embeddings group by 1",
    "new_poems": "with d as (select md5(coalesce(text, '')) as chunk_id, source, doc_id from documents) select chunk_id, arg_min(doc_id, (source, doc_id)) as doc_id from d where chunk_id not in (select chunk_id from d where doc_id % 3 = 0) group by 1",
    "page_unseen": "with e as (select user_id || '/' || event_type as comment_id, event_id from events) select comment_id, min(event_id) as event_id from e where event_id % 4 <> 0 and comment_id not in (select comment_id from e where event_id < 100) group by 1",
    "chunk_nodes": "select p_partkey as chunk_id, case when p_size % 2 = 0 then 'psychology' else 'poetry' end as library, case when length(p_name) > 60 then left(p_name, 60) || '…' else p_name end as snippet from part",
    "work_nodes": "select p_brand as work, arg_min(p_type, p_partkey) as author from part group by 1",
    "concept_edges": "select distinct p_type as src, p_partkey as dst from part where p_size % 2 = 0 and p_size > 20",
    "detach_delete": """with k as (select * from part where p_partkey % 4 <> 0)
      select 'chunks' as name, count(*) as n from k union all select 'works', count(distinct p_brand) from part union all select 'deleted', count(*) from part where p_partkey % 4 = 0
      union all select 'MENTIONS_IMAGERY', count(*) from k union all select 'EVOKES_EMOTION', count(*) from k union all select 'HAS_CHUNK', count(*) from k union all select 'HAS_CONCEPT', count(*) from k where p_size > 20""",
}
