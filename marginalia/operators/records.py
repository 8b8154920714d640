"""Unnesting, keys and record-level predicates (PRJ-*, FIL-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text

RECORD_KEY = ("repo_name", "new_path", "commit_hash")
COMMENT_KEY = ("type", "start_line", "end_line")
SCORES = ("bleu1", "bleu2", "bleu3", "bleu4", "rougeL", "bertscore_f1")
UNKNOWN_MODEL = "<unknown>"


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows delivered several times count once; only the columns asked for are carried."""
    return df.select(key, *(c for c in columns if c != key)).where(F.col(key).isNotNull()).dropDuplicates([key])


def same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of keys: records without a path still match each other."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where all keys are equal or both null; frames of one origin may meet."""
    renamed = right.select(*(F.col(k).alias(f"_same_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(renamed, on, how).drop(*(f"_same_{k}" for k in keys))


def model_name(model: Column) -> Column:
    return F.when(F.coalesce(model, F.lit("")) == "", UNKNOWN_MODEL).otherwise(model)


def target_comments(dataset: DataFrame, *fields: str) -> DataFrame:
    """PRJ-7 on files: one row per target comment of each file, in order."""
    files = once(dataset, "file_id", "repo_name", "target_comments")
    rows = files.select("file_id", "repo_name", F.posexplode("target_comments").alias("pos", "c"))
    return rows.select("file_id", "repo_name", "pos", *(F.col(f"c.{f}").alias(f) for f in fields))


def results(generated: DataFrame, *fields: str, **computed: Column) -> DataFrame:
    """PRJ-7 on a run: one row per result, those delivered twice once; see ``all_results``."""
    return all_results(generated, *fields, **computed).dropDuplicates(["result_id"])


def all_results(generated: DataFrame, *fields: str, **computed: Column) -> DataFrame:
    """A row for each result as often as it was delivered; ``fields`` are of the result or, with a dot, of its comment.

    ``computed`` columns are made of ``r`` and ``c`` before duplicates go, so that long texts need not be carried.
    """
    rows = generated.select("file_id", F.explode("comment_generations").alias("c")).select("file_id", "c", F.explode("c.results").alias("r"))
    picked = [F.col(f"c.{f[1:]}").alias(f[1:]) if f[0] == "." else F.col(f"r.{f}").alias(f) for f in fields]
    picked += [value.alias(name) for name, value in computed.items()]
    out = rows.select("file_id", F.col("r.result_id").alias("result_id"), model_name(F.col("r.model")).alias("model"), *picked)
    return out.where(F.col("result_id").isNotNull())


def eligible_files(suffix: str = ".py", change_types: Sequence[str] = ("MODIFY",)) -> Column:
    """FIL-1: suffix, kind of change, and nothing missing."""
    present = F.col("source_code").isNotNull() & F.col("previous_source_code").isNotNull() & F.col("commit_message").isNotNull()
    return F.coalesce(F.col("new_path").endswith(suffix) & F.col("change_type").isin(*change_types) & present, F.lit(False))


INTENTS = ("what", "why", "how")


def is_target(c: Column, intent: Column | None = None) -> Column:
    """FIL-8 on a comment struct; ``intent``, where comments are labelled, has to be one of INTENTS or null."""
    body = c["comment"]
    plain = ~text.is_directive(body) & text.has_letter(body) & ~text.is_separator(body) & text.is_ascii(body)
    return F.coalesce(c["type"].isin("inline", "block") & (c["status"] == "added") & body.isNotNull() & plain & (F.lit(True) if intent is None else intent.isNull() | intent.isin(*INTENTS)), F.lit(False))


def fits(prompt: Column, capacity: Column, reserve: int = 512, overhead: int = 8) -> Column:
    """FIL-9's bound: a token holds at least one byte, so what fits by bytes fits by tokens; others need ``tokens.token_counts``."""
    return F.octet_length(prompt) + overhead <= capacity - reserve


def is_finite(c: Column) -> Column:
    """FIL-16."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def is_scorable(error: Column, prediction: Column, reference: Column) -> Column:
    """FIL-18: no error, and something left of both sides after normalising."""
    left = (text.normalize_comment(prediction) != "") & (text.normalize_comment(reference) != "")
    return (F.coalesce(error, F.lit("")) == "") & F.coalesce(left, F.lit(False))


ANNOTATION_VIEWS = ("all", "todo", "done", "untagged")


def in_view(view: str, tag: str | None = None) -> Column:
    """FIL-21 on latest annotations with done and tags: one of ANNOTATION_VIEWS, or ``tag`` with the tag."""
    n_tags = F.coalesce(F.size("tags"), F.lit(0))
    done = F.coalesce(F.col("done"), F.lit(False))
    views = {"all": F.lit(True), "todo": ~done, "done": done, "untagged": n_tags <= 0}
    if view == "tag":
        return F.coalesce(F.array_contains("tags", tag), F.lit(False))
    if view not in views:
        raise ValueError(f"{view} is none of {', '.join(ANNOTATION_VIEWS)} or tag")
    return views[view]


def unpivot_scores(rows: DataFrame, *keep: str) -> DataFrame:
    """PRJ-8: one row per metric that has a value."""
    long = rows.select(*keep, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"scores.{m}").alias("score")) for m in SCORES))))
    return long.where(F.col("score").isNotNull() & ~F.isnan("score"))
