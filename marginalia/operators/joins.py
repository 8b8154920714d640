"""Keyed joins (JOIN-*), set operations (SET-*) and regrouping (AGG-5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import COMMENT_KEY, RECORD_KEY, same_key


def not_yet_done(todo: DataFrame, ledger: DataFrame, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """JOIN-1, JOIN-2: rows without a null-safe match in the ledger, whatever the ledger's error says."""
    done = ledger.select(*keys).distinct()
    return todo.join(done, same_key(todo, done, keys), "left_anti")


def prune(run: DataFrame, dataset: DataFrame) -> DataFrame:
    """JOIN-3: records missing from the dataset go, then comments missing from their record.

    A record that loses all its comments stays with an empty array.
    """
    keep = F.transform("target_comments", lambda c: F.struct(*(c[k].alias(k) for k in COMMENT_KEY)))
    held = dataset.select(*RECORD_KEY, F.coalesce(keep, F.array().cast("array<struct<type:string,start_line:int,end_line:int>>")).alias("held"))
    held = held.groupBy(*RECORD_KEY).agg(F.any_value("held").alias("held"))
    both = run.join(held, same_key(run, held, RECORD_KEY)).select(*(run[c] for c in run.columns), "held")
    kept = F.filter("comment_generations", lambda g: F.array_contains(F.col("held"), F.struct(*(g[k].alias(k) for k in COMMENT_KEY))))
    return both.withColumn("comment_generations", F.coalesce(kept, F.array().cast(run.schema["comment_generations"].dataType))).drop("held")


def reuse_scores(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JOIN-4: earlier scores where the key is known and the text is the same; others are to be scored."""
    before = previous.groupBy(*keys).agg(F.max_by(F.struct("comment_text", "scores"), F.col("pos")).alias("was"))
    rows = current.join(before, same_key(current, before, keys), "left").select(*(current[c] for c in current.columns), "was")
    same = F.col("was").isNotNull() & F.col("was.comment_text").eqNullSafe(F.col("comment_text"))
    return rows.withColumn("reused", same).withColumn("scores", F.when(same, F.col("was.scores"))).drop("was")


def regroup(results: DataFrame, record: Sequence[str], comment: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """AGG-5: results under their comment, comments under their record, both in order of first sight (``pos``)."""
    item = F.struct("pos", *fields)
    inner = results.groupBy(*record, *comment).agg(F.array_sort(F.collect_list(item)).alias("results"), F.min("pos").alias("first"))
    inner = inner.withColumn("results", F.transform("results", lambda r: F.struct(*(r[f].alias(f) for f in fields))))
    outer = inner.groupBy(*record).agg(F.array_sort(F.collect_list(F.struct("first", *comment, "results"))).alias("g"))
    return outer.withColumn("comment_generations", F.transform("g", lambda g: F.struct(*(g[c].alias(c) for c in (*comment, "results"))))).drop("g")


def missing_numbers(present: DataFrame, column: str, upper: int | None = None) -> DataFrame:
    """SET-2: numbers of ``range(upper)`` that do not occur, by default up to the largest that does."""
    if upper is None:
        largest = present.agg(F.max(F.col(column).cast("long"))).first()[0]
        upper = 0 if largest is None else largest + 1
    every = present.sparkSession.range(upper).toDF("task_id")
    return every.join(present.select(F.col(column).cast("long").alias("task_id")), "task_id", "left_anti")


def all_of(frames: Sequence[DataFrame]) -> DataFrame:
    """SET-1."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def distinct_union(frames: Sequence[DataFrame]) -> DataFrame:
    """SET-3."""
    return all_of(frames).distinct()


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """AGG-21, AGG-22, STM-3: the last row per key by ``order``; one aggregation, no sort per key."""
    rest = [c for c in log.columns if c != key]
    top = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return top.select(key, *(F.col(f"row.{c}").alias(c) for c in rest))
