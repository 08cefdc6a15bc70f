"""A library of chunks in stored tables: registry, vectors, graph edges and the embedding cache, kept together.

The tables are keyed (see keyed), so each step rewrites only the buckets of the chunks that changed; a job that dies between two
steps leaves tables that the next run of the same step brings in order: vectors and edges are written before the registry,
which tells what is done, and removed after it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.graph import derived_edges
from weftline.operators.incremental import content_hash, diff
from weftline.operators.keyed import BUCKETS, KeyedTable
from weftline.operators.storage import stored

#: Characters of a chunk's text that the registry shows.
PREVIEW = 120
#: Columns that chunks must have; imagery and emotion are arrays, origin is null for chunks of the corpus.
CHUNK = ("chunk_id", "library", "text", "origin", "imagery", "emotion", "character", "work", "concept")


class EmbeddingCache:
    """Vectors by a hash of their text and the model's name; what is computed once is kept."""

    def __init__(self, table: KeyedTable, model: str, compute: Callable[[Column], Column]):
        self.table, self.model, self.compute = table, model, compute

    @classmethod
    def create(cls, spark: SparkSession, path: str, model: str, dim: int, compute: Callable[[Column], Column], buckets: int = BUCKETS) -> EmbeddingCache:
        schema = spark.createDataFrame([], "digest string, vector array<double>").schema
        return cls(KeyedTable.create(spark, path, schema, ("digest",), buckets=buckets, dimensions={"vector": dim}), model, compute)

    def embedded(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """rows with vector. Only buckets of the texts' hashes are read, and each distinct text that is not there is computed once."""
        keyed = stored(rows.withColumn("_digest", F.sha2(F.concat_ws("\u0000", F.lit(self.model), F.coalesce(text, F.lit(""))), 256)), "texts")
        wanted = keyed.select(F.col("_digest").alias("digest")).distinct()
        missing = stored(wanted.join(self.table.lookup(wanted).select("digest"), "digest", "left_anti"), "missing")
        if not missing.isEmpty():  # texts that are known are not dealt out
            asked = keyed.join(missing.withColumnRenamed("digest", "_digest"), "_digest", "left_semi")
            some = asked.groupBy(F.col("_digest").alias("digest")).agg(F.first(F.coalesce(text, F.lit(""))).alias("_text"))
            self.table.upsert(some.select("digest", self.compute(F.col("_text")).alias("vector")))
        known = self.table.lookup(wanted).withColumnRenamed("digest", "_digest")
        return keyed.join(known, "_digest").drop("_digest")


class Library:
    """The tables of a library in one folder."""

    def __init__(self, spark: SparkSession, path: str, model: str, dim: int, compute: Callable[[Column], Column]):
        self.model, self.dim = model, dim
        self.registry, self.vectors, self.edges = (KeyedTable(spark, f"{path}/{t}") for t in ("registry", "vectors", "edges"))
        self.cache = EmbeddingCache(KeyedTable(spark, f"{path}/cache"), model, compute)

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, model: str, dim: int, compute: Callable[[Column], Column], buckets: int = BUCKETS) -> Library:
        """Empty tables; key is the type of chunk ids."""
        make = lambda t, ddl, keys, **more: KeyedTable.create(spark, f"{path}/{t}", spark.createDataFrame([], ddl).schema, keys, buckets=buckets, **more)
        make("registry", f"chunk_id {key}, library string, source_file string, content_hash string, preview string", ("chunk_id",))
        make("vectors", f"chunk_id {key}, library string, vector array<double>", ("chunk_id",), dimensions={"vector": dim})
        make("edges", f"chunk_id {key}, src string, relation string, dst string", ("chunk_id", "src", "relation", "dst"), by=("chunk_id",))
        EmbeddingCache.create(spark, f"{path}/cache", model, dim, compute, buckets)
        return cls(spark, path, model, dim, compute)

    def index(self, chunks: DataFrame, files: Mapping[str, str] | None = None, force: bool = False) -> DataFrame:
        """Puts chunks (CHUNK) into all tables; nothing else is touched. (library, action, n) of what was added, updated or skipped.

        files are the corpus files by library, which a chunk without an origin is from.
        """
        every = stored(chunks.select(*CHUNK, content_hash(F.col("text"), self.model, self.dim).alias("content_hash")), "chunks")
        plan = stored(diff(every, self.registry.lookup(every), force=force), "plan")
        todo = plan.filter("action <> 'skipped'")
        self.vectors.upsert(self.cache.embedded(todo))
        # the graph is written as a whole: an edge that is missing shows nowhere else
        edges = derived_edges(every).withColumn("_chunk", F.when(F.col("relation").isin("MENTIONS_IMAGERY", "EVOKES_EMOTION"), F.col("src")).otherwise(F.col("dst")))
        self.edges.replace(edges.withColumn("chunk_id", F.col("_chunk").cast(self.edges.schema["chunk_id"].dataType)), F.lit(0))
        file = F.create_map(*(F.lit(x) for pair in (files or {"": ""}).items() for x in pair))[F.col("library")]
        self.registry.upsert(todo.select("chunk_id", "library", F.coalesce("origin", file).alias("source_file"), "content_hash", F.substring("text", 1, PREVIEW).alias("preview")))
        return plan.groupBy("library", "action").agg(F.count("*").alias("n"))

    def ingest(self, corpus: DataFrame, files: Mapping[str, str], reset: bool = False, force: bool = False) -> DataFrame:
        """index of the corpus files' chunks, of whose libraries (the keys of files) none may be empty, and removal of what these files no longer hold.

        reset begins with empty vectors and edges and without the libraries' registry rows.
        """
        there = {r[0] for r in corpus.select("library").distinct().collect()}  # a row for each library
        if lost := sorted(set(files) - there):
            raise ValueError(f"no chunks of {', '.join(lost)}")
        corpus = corpus.filter(F.col("library").isin(*files)).withColumn("origin", F.lit(None).cast("string"))
        if reset:
            self.vectors.clear()
            self.edges.clear()
            self.registry.delete(self.registry.read().filter(F.col("library").isin(*files)).select("chunk_id"))
        told = self.index(corpus, files, force or reset)
        gone = self.registry.read().filter(F.col("library").isin(*files) & F.col("source_file").isin(*files.values())).join(corpus.select("chunk_id"), "chunk_id", "left_anti")
        self.remove(gone)
        return told

    def remove(self, chunks: DataFrame) -> int:
        """Takes chunks out of the registry, then of vectors and edges; their number."""
        ids = stored(chunks.select("chunk_id"), "gone")
        for t in (self.registry, self.vectors, self.edges):
            t.delete(ids)
        return ids.count()

    def rollback(self, source_file: str) -> int:
        """Takes out all that an import gave; the number of its chunks."""
        return self.remove(self.registry.read().filter(F.col("source_file") == source_file))
