"""A training corpus from raw documents: language, quality, near copies, mixture, tokens.

STAGES holds (name, function) pairs; each function takes (spark, docs, sf_dir)
and returns what goes on. All stages but the last return the columns of
documents; the mixing stage adds mix_pos, the place of the row in the mixture.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, language, mixing, near_dedup, quality
from weftline.llm.common import stored, table
from weftline.shipping import ship


#: Bytes of text in a block of the last stage; smaller blocks than the operator's own leave room beside the earlier stages' memory.
TOKEN_BLOCK_BYTES = 8 << 20
#: Columns of their own that stages add and drop again.
_KEY, _TOLD = "_weftline_key", "_weftline_told"


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts of which no language has LEAST_SHARE."""
    model = language.train(docs)
    told = docs.withColumn(_TOLD, language.language("text", model))
    return told.filter((F.col(f"{_TOLD}.lang_pred") != language.UNKNOWN) & (F.col(f"{_TOLD}.score") >= language.LEAST_SHARE)).select(*docs.columns)


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that the quality classifier scores under its threshold."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn(_TOLD, quality.quality_score("text", machine)).filter(F.col(_TOLD) >= quality.THRESHOLD).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five words a shingle, similarity 0.8 or more.

    Of a group the row with the smallest doc_id stays, of several with that id the text with the least
    hash, and one of rows that are equal in both. Rows without a doc_id or without words all stay.
    """
    keyed = docs.withColumn(_KEY, F.xxhash64("text"))
    groups = near_dedup.labelled(docs).filter(F.col("component").isNotNull())
    kept = groups.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("least")).select("least.doc_id", F.col("least.text_key").alias(_KEY))
    alone = F.col("doc_id").isNull() | F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    some = keyed.filter(~alone).join(kept, ["doc_id", _KEY], "left_semi").dropDuplicates(["doc_id", _KEY])
    return some.unionByName(keyed.filter(alone)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the mixture."""
    kept = [c for c in docs.columns if c != "mix_pos"]
    return mixing.mixed(docs).select(*kept, "mix_pos").orderBy("mix_pos")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document, with its place in the mixture."""
    import public_tokenizers

    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("source", "mix_pos"), block_bytes=TOKEN_BLOCK_BYTES)


def _ready(stage):
    """The stage, with the package on the executors first."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [("language", by_language), ("quality", by_quality), ("near copies", without_near_copies), ("mixture", mix_sources), ("tokens", to_tokens)]
STAGES = [(name, _ready(stage)) for name, stage in STAGES]

#: Models that are trained and byte-pair encoding can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{k}")
    return docs
