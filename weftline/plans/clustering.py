"""Queries of clustering, over embeddings and their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vectors import normalised
from weftline.operators import clustering as C
from weftline.operators import density as D
from weftline.sources.tables import table


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 40).alias("run_id"), "vec_id", "label", (F.col("vec_id") % 3).alias("raw_count"))


def theme_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.theme_gate(_labels(spark, sf_dir)).select("vec_id", "label", "was")


def theme_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.theme_count(_labels(spark, sf_dir))


def cluster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    m = e.select((F.col("vec_id") % 7).alias("run_id"), F.col("vec_id").alias("id"), F.when(F.col("label") > 7, -1).otherwise(F.col("label")).alias("label"), (F.col("vec_id") % 4 != 0).alias("is_survivor"), (F.col("vec_id") % 11).alias("likes"), F.col("vec_id").cast("string").alias("text"))
    r = C.cluster_rows(m)
    return r.select("run_id", "cluster_key", "order_index", "size", "raw_size", "is_noise", F.array_join(F.transform("representative_ids", lambda x: x.cast("string")), ",").alias("ids"), F.array_join("representatives", ",").alias("texts"))


def kmeans_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of all embeddings: the rows of each label, and their mean cosine to the label's mean vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", normalised(F.col("embedding")).alias("v"))
    told = C.kmeans(v, 5)
    dims = F.posexplode("v").alias("d", "x")
    mean = told.select("label", dims).groupBy("label", "d").agg(F.avg("x").alias("m")).groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))
    return told.groupBy("label").agg(F.count("*").alias("n")).join(mean, "label").select("label", "n", F.round("length", 6).alias("fit"))


def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select((F.floor(F.col("vec_id") / 200)).alias("run_id"), "vec_id", F.col("embedding").alias("v"))
    return C.density_labels(e, "run_id", "vec_id").select("run_id", "vec_id", "label", "method")


def kmeans_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", C.kmeans_k(F.col("n") / 3).alias("k"))


def density_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one run, clustered block by block: the size and the least vector of every cluster, and of the noise."""
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("run_id"), "vec_id", F.col("embedding").alias("v"))
    labels = D.density_labels(e, "run_id", "vec_id")
    return labels.groupBy("label").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))


QUERIES = {f.__name__: f for f in (density_run, theme_gate, theme_count, cluster_rows, kmeans_sizes, density_clusters, kmeans_k)}

_LABELS = "l as (select vec_id % 40 as run_id, vec_id, label, vec_id % 3 as raw from embeddings)"
ORACLE_SQL = {
    "theme_gate": f"with {_LABELS} select vec_id, (case when sum(raw) over (partition by run_id, label) < 3 then -1 else label end)::bigint as label, label::bigint as was from l",
    "theme_count": f"with {_LABELS} select run_id, count(*) as themes from (select run_id, label from l group by 1, 2 having sum(raw) >= 3) group by 1",
    "cluster_rows": """with m as (select vec_id % 7 as run_id, vec_id as id, case when label > 7 then -1 else label end as label, vec_id % 4 <> 0 as s, vec_id % 11 as likes from embeddings),
      c as (select run_id, label, count(*) as n from m group by 1, 2), r as (select *, row_number() over (partition by run_id, label >= 0 order by n desc, label) as r, n / sum(n) over (partition by run_id) as share from c),
      k as (select run_id, label, case when label < 0 then 'noise' when r > 5 then 'tail' else 'c' || label end as cluster_key, case when label < 0 then 1000001 when r > 5 then 1000000 else r end as p from r where label >= 0 or share > 0.15),
      e as (select *, row_number() over (partition by run_id, cluster_key order by likes desc, id) as top from m join k using (run_id, label)),
      g as (select run_id, cluster_key, min(p) as p, sum(s::int)::bigint as size, count(*) as raw_size, string_agg(id::varchar, ',' order by top) filter (top <= 5) as ids, string_agg(id::varchar, ',' order by top) filter (top <= 3) as texts from e group by 1, 2)
      select run_id, cluster_key, (row_number() over (partition by run_id order by p) - 1)::bigint as order_index, size, raw_size, cluster_key = 'noise' as is_noise, ids, texts from g""",
    "kmeans_k": "select user_id, greatest(2, least(5, round_even((count(*) / 3.0 / 10)::decimal(18, 9), 0)))::bigint as k from events group by 1",
}
