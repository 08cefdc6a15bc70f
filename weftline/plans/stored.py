"""Queries of the tables that are written: each makes a table, changes it several times, and returns what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vectors import hashed_embedding
from weftline.operators import graph as G
from weftline.operators import incremental as I
from weftline.operators import persist as P
from weftline.operators.keyed import KeyedTable
from weftline.operators.library import EmbeddingCache, Library
from weftline.operators.storage import shared_dir
from weftline.sources.tables import table

_PREVIEW, _MODEL, _DIM = 120, "hash-4", 64


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder among the shared ones, which goes when the session ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def empty(like: DataFrame, name: str, key: tuple[str, ...], by: tuple[str, ...] | None = None, buckets: int = 8, **more) -> KeyedTable:
    """A new table with the columns of a DataFrame."""
    spark = like.sparkSession
    return KeyedTable.create(spark, scratch(spark, name), like.schema, key, by, buckets, **more)


def registry_rows(chunks: DataFrame) -> DataFrame:
    """chunks (chunk_id, library, origin, file, text) as the registry keeps them: where a chunk is from, its digest and the beginning of its text."""
    source = F.coalesce("origin", "file").alias("source_file")
    return chunks.select("chunk_id", "library", source, I.content_hash(F.col("text"), _MODEL, _DIM).alias("content_hash"), F.substring("text", 1, _PREVIEW).alias("preview"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("library"), F.when(F.length(text) > 500, F.col("source")).alias("origin"), F.lit("corpus.jsonl").alias("file"), text.alias("text"))


def stored_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are recorded; then those that labels cover come again with another text; then what a source gave is deleted."""
    chunks = _chunks(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")).distinct()
    t = empty(registry_rows(chunks), "registry", ("chunk_id",))
    t.upsert(registry_rows(chunks))
    t.upsert(registry_rows(chunks.join(labelled, "chunk_id").withColumn("text", F.concat(F.lit("again "), "text"))))
    t.delete(t.read().filter("source_file = 'src3'").select("chunk_id"))
    return t.read()


def stored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is an edge from its customer; those of 1995 and later are merged into the earlier ones."""
    o = table(spark, sf_dir, "orders")
    edges = o.select(F.col("o_custkey").cast("string").alias("source"), F.col("o_orderpriority").alias("relation"), F.col("o_orderstatus").alias("target"), F.col("o_totalprice").alias("weight"), "o_orderkey", "o_orderdate")
    merged = [G.merged_edges(edges.filter(x), "o_orderkey") for x in ("o_orderdate < '1995-01-01'", "o_orderdate >= '1995-01-01'")]
    t = empty(merged[0], "edges", ("source", "relation", "target"), ("source",))
    for rows in merged:
        t.upsert(rows)
    return t.read()


def stored_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as chunks: their derived edges are merged twice, which changes nothing, and the edges of one brand's chunks are deleted."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    chunks = p.select(F.col("p_partkey").alias("chunk_id"), words.alias("imagery"), F.array("p_type").alias("emotion"), F.concat(F.lit("size "), "p_size").alias("character"), F.col("p_brand").alias("work"), F.col("p_type").alias("concept"))
    edges = G.derived_edges(chunks)
    t = empty(edges, "graph", ("src", "relation", "dst"))
    t.upsert(edges)
    t.upsert(edges)
    gone = chunks.filter("work = 'Brand#11'").select(F.col("chunk_id").cast("string").alias("_id"))
    now = t.read()
    t.delete(now.join(gone, now["src"] == gone["_id"], "left_semi").unionByName(now.join(gone, now["dst"] == gone["_id"], "left_semi")))
    return t.read()


def stored_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all orders are written, and twice more those of urgent ones: versions go up but for those that a user edited."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("key"), "o_orderpriority", "o_custkey")
    first = o.select("run_id", "key", (F.col("o_custkey") % 5 + 1).alias("version"), F.col("o_orderpriority").alias("content"), (F.col("o_custkey") % 2 == 0).alias("edited"), F.lit(True).alias("stale"))
    t = empty(first, "sections", ("run_id", "key"), ("run_id",))
    t.upsert(first)
    urgent = o.filter("o_orderpriority = '1-URGENT'").select("run_id", "key", F.lit(None).cast("long").alias("version"), F.lit("second").alias("content"), F.lit(False).alias("edited"), F.lit(False).alias("stale"))
    for content in ("second", "third"):
        t.merge(urgent.withColumn("content", F.lit(content)), lambda old, new: P.versioned(old, new, ("run_id", "key")))
    return t.read()


def stored_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as what a step of a run left: runs that came back leave their discounted lines only, and runs of failed orders are deleted."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_discount")
    rows = l.select("run_id", "l_linenumber", "l_partkey", "l_quantity")
    again = l.filter("l_returnflag = 'R'").select("run_id").distinct()
    t = empty(rows, "outputs", ("run_id", "l_linenumber", "l_partkey"), ("run_id",))
    late = F.struct("l_quantity")
    t.replace(rows, late)
    t.replace(l.filter("l_discount > 0.05").join(again, "run_id", "left_semi"), late)
    t.delete(table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id")))
    return t.read()


def stored_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's profile and video are one row each: both come in two changes, which fill other columns of the row."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("profile"), F.lit(None).cast("string").alias("video"))
    t = empty(rows, "singletons", ("run_id",))
    t.upsert(rows)

    def filled(old: DataFrame, new: DataFrame) -> DataFrame:
        o, n = (x.select("run_id", F.struct("profile", "video").alias(name)) for x, name in ((old, "o"), (new, "n")))
        return o.join(n, "run_id", "full").select("run_id", *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in ("profile", "video")))

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("video"))
    t.merge(o.join(c, "o_custkey").select(F.col("o_orderkey").alias("run_id"), F.lit(None).alias("profile"), "video"), filled)
    return t.read()


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by id, with their number of dimensions checked: written, those of one label negated, those of another deleted."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    dim = F.size("embedding")
    t = empty(e, "vectors", ("vec_id",), dimensions={"embedding": _DIM})
    t.upsert(e.filter(dim == _DIM))
    t.upsert(e.filter("label = 1").withColumn("embedding", F.transform("embedding", lambda x: -x)))
    t.delete(e.filter("label = 2"))
    return t.read().select("vec_id", "label", F.col("embedding")[0].cast("double").alias("first"))


def _library_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("lang").alias("library"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("origin"), F.array("lang").alias("imagery"), F.array("source", "lang").alias("emotion"),
        F.lit(None).cast("string").alias("character"), F.col("source").alias("work"), F.lit(None).cast("string").alias("concept"),
    )


def ingest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library over its life: the corpus is ingested, labelled documents are imported, the corpus comes again with changed German texts and without
    one source, and the import of another source is rolled back. Of each chunk that is left: its registry row, and its vectors and edges."""
    every = _library_chunks(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")).distinct()
    corpus, imports = every.join(labelled, "chunk_id", "left_anti"), every.join(labelled, "chunk_id", "left_semi")
    files = {r[0]: f"{r[0]}.jsonl" for r in corpus.select("library").distinct().collect()}
    lib = Library.create(spark, scratch(spark, "library"), every.schema["chunk_id"].dataType.simpleString(), _MODEL, _DIM, lambda c: hashed_embedding(c, _DIM), buckets=8)
    lib.ingest(corpus, files)
    lib.index(imports)
    changed = F.when(F.col("library") == "de", F.concat("text", F.lit(" again"))).otherwise(F.col("text"))
    lib.ingest(corpus.filter("work <> 'src1'").withColumn("text", changed), files)
    lib.rollback("src2")
    counts = lib.registry.read()
    for name, t in (("vectors", lib.vectors), ("edges", lib.edges)):
        counts = counts.join(t.read().groupBy("chunk_id").agg(F.count("*").alias(name)), "chunk_id", "full")
    return counts.drop("preview")


def cached_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents are embedded, then again with those that labels cover changed: what each run asked for and what it had to compute, and whether equal texts have equal vectors."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit(" again").alias("more")).distinct()
    cache = EmbeddingCache.create(spark, scratch(spark, "cache"), _MODEL, _DIM, lambda c: hashed_embedding(c, _DIM), buckets=8)
    out, before = None, 0
    for run, rows in enumerate((d, d, d.join(labelled, "doc_id", "left").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.coalesce("more", F.lit(""))).alias("text")))):
        vectors = cache.embedded(rows)
        size = cache.table.read().count()
        one = vectors.agg(F.count("*").alias("asked")).select(F.lit(run).cast("long").alias("run"), "asked", F.lit(size - before).cast("long").alias("computed"))
        out, before = one if out is None else out.unionByName(one), size
    return out


QUERIES = {f.__name__: f for f in (ingest_chain, cached_embeddings, stored_registry, stored_edges, stored_graph, stored_sections, stored_outputs, stored_singletons, stored_vectors)}
ORACLE_SQL = {
    "ingest_chain": f"""with d as (select doc_id, lang, source, coalesce(text, '') as t, doc_id in (select doc_id from labels) as imported from documents),
      k as (select doc_id, lang, case when imported then source else lang || '.jsonl' end as source_file, case when not imported and lang = 'de' then t || ' again' else t end as t from d where case when imported then source <> 'src2' else source <> 'src1' end)
      select doc_id as chunk_id, lang as library, source_file, sha256(t || chr(0) || '{_MODEL}' || chr(0) || '{_DIM}') as content_hash, 1::bigint as vectors, 4::bigint as edges from k""",
    "cached_embeddings": """with a as (select distinct coalesce(text, '') as t from documents), b as (select distinct coalesce(text, '') || ' again' as t from documents where doc_id in (select doc_id from labels)), n as (select count(*) as n from documents)
      select 0::bigint as run, n as asked, (select count(*) from a) as computed from n union all select 1, n, 0 from n union all select 2, n, (select count(*) from b where t not in (select t from a)) from n""",
    "stored_registry": f"""with d as (select doc_id, lang, case when length(coalesce(text, '')) > 500 and source is not null then source else 'corpus.jsonl' end as source_file,
        case when doc_id in (select doc_id from labels) then 'again ' else '' end || coalesce(text, '') as text from documents)
      select doc_id as chunk_id, lang as library, source_file, sha256(text || chr(0) || '{_MODEL}' || chr(0) || '{_DIM}') as content_hash, substring(text, 1, {_PREVIEW}) as preview from d where source_file <> 'src3'""",
    "stored_edges": """with e as (select o_custkey::varchar as source, o_orderpriority as relation, o_orderstatus as target, o_totalprice as weight, o_orderdate >= '1995-01-01' as late, o_orderkey as k from orders)
      select source, relation, target, weight from e qualify row_number() over (partition by source, relation, target order by late desc, k desc) = 1""",
    "stored_graph": """with p as (select p_partkey::varchar as id, * from part), e as (
        select id as src, 'MENTIONS_IMAGERY' as relation, unnest(string_split(p_name, ' ')) as dst, p_brand from p union select id, 'EVOKES_EMOTION', p_type, p_brand from p
        union select 'size ' || p_size, 'FEATURES_CHARACTER', id, p_brand from p union select p_brand, 'HAS_CHUNK', id, p_brand from p union select p_type, 'HAS_CONCEPT', id, p_brand from p)
      select distinct src, relation, dst from e where p_brand <> 'Brand#11'""",
    "stored_sections": """select o_orderkey as run_id, o_orderstatus as key, o_custkey % 5 + 1 + case when o_orderpriority = '1-URGENT' and o_custkey % 2 <> 0 then 2 else 0 end as version,
        case when o_orderpriority = '1-URGENT' then 'third' else o_orderpriority end as content, o_custkey % 2 = 0 as edited, o_orderpriority <> '1-URGENT' or o_custkey % 2 = 0 as stale from orders""",
    "stored_outputs": """with a as (select distinct l_orderkey from lineitem where l_returnflag = 'R'), b as (select distinct l.l_orderkey from lineitem l join a using (l_orderkey) where l_discount > 0.05),
      k as (select l.* from lineitem l where l_orderkey not in (select l_orderkey from b) or l_discount > 0.05)
      select l_orderkey as run_id, l_linenumber::bigint as l_linenumber, l_partkey, max(l_quantity) as l_quantity from k where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F') group by all""",
    "stored_singletons": "select o_orderkey as run_id, o_orderpriority as profile, c_name as video from orders left join customer on o_custkey = c_custkey",
    "stored_vectors": f"select vec_id, label::bigint as label, case when label = 1 then -embedding[1] else embedding[1] end::double as first from embeddings where label <> 2 and len(embedding) = {_DIM}",
}
