"""What a run leaves in its tables: sinks that replace, merge or version rows by run, and the reads that give it back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import fingerprint

# States that a run does not leave any more, and entries of a run's event stream that are kept.
TERMINAL = ("succeeded", "failed", "cancelled")
STREAM_KEPT = 2000


def without_runs(rows: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """rows but those of the given runs."""
    return rows.join(runs.select(run).distinct(), run, "left_anti").select(*rows.columns)


def replaced(old: DataFrame, new: DataFrame, run: str = "run_id") -> DataFrame:
    """A run that has new rows has only these; all other runs keep theirs."""
    return without_runs(old, new, run).unionByName(new.select(*old.columns))


def comment_rows(comments: DataFrame, text: str = "text") -> DataFrame:
    """comments as they are stored: the text's hash is made anew, and who wrote it is not kept."""
    return comments.withColumns({"text_hash": fingerprint(F.coalesce(F.col(text), F.lit(""))), "author_id": F.lit(None).cast("string")})


def with_cluster(comments: DataFrame, clusters: DataFrame, run: str = "run_id", comment: str = "comment_id") -> DataFrame:
    """comments with the cluster_key of the cluster that lists them; of several the last in order. clusters has (run, cluster_key, order_index, comment_ids)."""
    listed = clusters.select(run, "cluster_key", "order_index", F.explode("comment_ids").alias(comment))
    member = listed.groupBy(run, comment).agg(F.max_by("cluster_key", "order_index").alias("cluster_key"))
    return comments.join(member, [run, comment], "left")


def versioned(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, version, content, edited, stale of both tables' sections: new content replaces the old.

    A section that is not there yet has the version it brings, 1 without one; another has one more than the version
    it brings or had and is no longer stale, but for those that a user has edited, whose version and staleness stay.
    """
    o = old.select(*key, *(F.col(c).alias(f"_{c}") for c in ("version", "content", "edited", "stale")))
    both = o.withColumn("_had", F.lit(True)).join(new.select(*key, "version", "content", F.lit(True).alias("_has")), list(key), "full")
    had, has = F.coalesce("_had", F.lit(False)), F.coalesce("_has", F.lit(False))
    edited = had & F.coalesce("_edited", F.lit(False))
    version = F.when(~has | edited, F.col("_version")).when(had, F.coalesce("version", "_version", F.lit(1)) + 1).otherwise(F.coalesce("version", F.lit(1)))
    stale = F.when(~has | edited, F.col("_stale")).otherwise(F.lit(False))
    return both.select(*key, version.cast("long").alias("version"), F.when(has, F.col("content")).otherwise(F.col("_content")).alias("content"), edited.alias("edited"), stale.alias("stale"))


def stream_tail(log: DataFrame, kept: int = STREAM_KEPT, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """The run's last `kept` entries with their stream ids; seq has no gaps, so its largest value tells which they are."""
    top = log.groupBy(run).agg(F.max(seq).alias("_top"))
    return log.join(top, run).filter(F.col(seq) > F.col("_top") - kept).drop("_top").withColumn("entry_id", F.concat(F.col(seq).cast("string"), F.lit("-0")))


def listed(rows: DataFrame, *order: str | Column, run: str = "run_id") -> DataFrame:
    """rows with place, from 1 in each run in the given order."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(run).orderBy(*order)))


def snapshot(runs: DataFrame, children: Mapping[str, tuple[DataFrame, Sequence[Column], Sequence[str]]], run: str = "run_id") -> DataFrame:
    """runs with an array of structs for each child table, in its order and empty where a run has none.

    A child is (rows, order, columns). The rows of a run are a bounded list, so they fit in one row.
    """
    out = runs
    for name, (rows, order, columns) in children.items():
        keyed = rows.select(run, F.struct(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))).alias("o"), F.struct(*columns).alias("v")).alias("x"))
        lists = keyed.groupBy(run).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias(name))
        out = out.join(lists, run, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def over_live(stored: DataFrame, live: DataFrame, fields: Sequence[str], key: str = "run_id") -> DataFrame:
    """A stored snapshot over the live state: its fields where it has them; a terminal state and progress never go back."""
    a = stored.select(key, *(F.col(c).alias(f"a_{c}") for c in ("status", "progress", *fields)))
    b = live.select(key, *(F.col(c).alias(f"b_{c}") for c in ("status", "progress", *fields)))
    both = a.join(b, key, "full")
    status = F.when(F.col("b_status").isin(*TERMINAL), F.col("b_status")).otherwise(F.coalesce("a_status", "b_status"))
    progress = F.least(F.lit(100.0), F.greatest(F.coalesce("a_progress", F.lit(0.0)), F.coalesce("b_progress", F.lit(0.0))))
    return both.select(key, status.alias("status"), progress.alias("progress"), *(F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in fields))


def partial_fold(log: DataFrame, replaced: Sequence[str], appended: Sequence[str], run: str = "run_id") -> DataFrame:
    """The state after all partial results of a run, as maps and lists; log has (run, seq, kind, key, payload).

    Kinds that are replaced keep their last payload, kinds that are appended all payloads in order, comment pages
    each comment once, and sections the last payload of each key. A repeated seq counts once.
    """
    once = log.groupBy(run, "seq").agg(F.min(F.struct("kind", "key", "payload")).alias("e")).select(run, "seq", "e.*")
    last = [F.max_by(F.when(F.col("kind") == k, F.col("payload")), F.when(F.col("kind") == k, F.col("seq"))).alias(k) for k in replaced]
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("seq", "payload")))), lambda x: x["payload"]).alias(k) for k in appended]
    comments = F.count_distinct(F.when(F.col("kind") == "comment_page", F.col("key"))).alias("comments")
    sections = once.filter(F.col("kind") == "sections").groupBy(run, "key").agg(F.max_by("payload", "seq").alias("payload"))
    merged = sections.groupBy(run).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "payload")))).alias("sections"))
    return once.groupBy(run).agg(*last, *lists, comments).join(merged, run, "left")
