"""Whole stages: filtering files to targets, generating and regrouping, scoring and sampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import code, text, tokens, udfs
from marginalia.operators import aggregates as agg
from marginalia.operators import joins
from marginalia.operators import records as rec
from marginalia.sources.search import complete

TEMPLATE = "Repository: {repo_name}\nFile: {filepath}\nCommit message:\n{commit_message}\n\nWrite one {comment_type} comment in place of the marked line.\n{code_type_instruction}\n\n```python\n{code}\n```\n"
INSTRUCTIONS = {"inline": "Answer with one comment line.", "block": "Answer with one or more comment lines."}
RESERVE = 512


@dataclass
class Filtered:
    """``files`` has every file with its exit, counts and kept targets; ``funnel`` and ``kept`` are drawn from it."""

    files: DataFrame

    EXITS = ("wrong_metadata", "marked_message", "comment_parse_error", "no_target_comments", "prompt_code_error", "context_overflow")
    COUNTS = ("n_comments", "n_kept", "n_overflows")

    def funnel(self) -> DataFrame:
        """AGG-1, AGG-2: how many files left where; exits and kept files add up to all."""
        more = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in zip(self.COUNTS, ("num_comments", "num_target_comments", "num_target_comments_overflow"), strict=True)]
        return agg.funnel(self.files, [(e, F.col("exit") == e) for e in self.EXITS], *more)

    def kept(self) -> DataFrame:
        return self.files.where("exit = 'kept'").drop("exit", *self.COUNTS).withColumnRenamed("kept", "target_comments")


def filter_files(raw: DataFrame, markers: Sequence[str], capacity: int, template: str = TEMPLATE, counter: Callable | None = None, overhead: int = 8) -> Filtered:
    """Stage E1, in one pass over the files: each is parsed once for its comments and once for all its prompt codes.

    A file leaves by its first exit; one failing target drops the file.  Functions see only files that passed the native
    tests before them.  A prompt fits when its tokens and the overhead leave RESERVE of the capacity; they are counted,
    by ``counter`` (``tokens.vocabulary``) or the default vocabulary, only where its bytes alone do not show that.  Rows
    delivered twice are dropped at the end, so that no source text is moved.
    """
    first = F.when(~rec.eligible_files(), "wrong_metadata").when(text.contains_any("commit_message", markers), "marked_message")
    keys = ["file_id", "repo_name", "commit_hash", "new_path"]
    files = raw.select(*keys, "change_type", "commit_message", "source_code", "previous_source_code").where("file_id IS NOT NULL").withColumn("exit", first)
    left = files.where("exit IS NOT NULL").select(*keys, "exit")
    passed = files.where("exit IS NULL").select(*keys, "commit_message", "source_code", code.changed_comments("source_code", "previous_source_code").alias("c"))
    found = passed.select(*keys, "commit_message", "source_code", F.col("c.error").isNotNull().alias("bad"), F.greatest(F.size("c.comments"), F.lit(0)).alias("n_comments"), F.filter("c.comments", lambda c: rec.is_target(c)).alias("t"))
    codes = found.withColumn("p", code.prompt_codes(F.when(F.size("t") > 0, F.col("source_code")), "t")).drop("source_code")

    def prompt_of(t: Column, p: Column) -> Column:
        kind = F.when(t["type"] == "inline", INSTRUCTIONS["inline"]).otherwise(INSTRUCTIONS["block"])
        return text.fill_template(template, repo_name=F.col("repo_name"), filepath=F.col("new_path"), comment_type=t["type"], commit_message=F.col("commit_message"), code=p["code"], code_type_instruction=kind)

    def target(t: Column, p: Column) -> Column:
        return F.struct(t["comment"].alias("comment"), t["type"].alias("type"), t["start_line"].alias("start_line"), t["end_line"].alias("end_line"), t["anchor"].alias("anchor"), t["status"].alias("status"), p["code"].alias("prompt_code"), prompt_of(t, p).alias("prompt"))

    budget = F.lit(capacity - RESERVE)
    targets = codes.select(*keys, "bad", "n_comments", F.size("t").alias("n_targets"), F.exists("p", lambda p: p["error"].isNotNull()).alias("failed"), F.zip_with("t", "p", target).alias("all"))
    counted = targets.withColumn("n_tokens", tokens.array_token_counts(F.transform("all.prompt", lambda x: tokens.excess(x, budget, overhead)), counter))
    fits = lambda x, n: F.when(F.coalesce(n + overhead <= budget, F.lit(True)), x)
    fitting = counted.withColumn("kept", F.filter(F.zip_with("all", "n_tokens", fits), lambda x: x.isNotNull()))
    exit_ = F.when(F.col("bad"), "comment_parse_error").when(F.col("n_targets") <= 0, "no_target_comments").when(F.col("failed"), "prompt_code_error").when(F.size("kept") == 0, "context_overflow").otherwise("kept")
    fitting = fitting.withColumn("exit", exit_)
    kind = "array<struct<comment:string,type:string,start_line:int,end_line:int,anchor:string,status:string,prompt_code:string,prompt:string>>"
    none = F.array().cast(kind)
    stays, reached = F.col("exit") == "kept", F.col("exit").isin("kept", "context_overflow")
    n_kept = F.when(stays, F.size("kept")).otherwise(0)
    after = fitting.select(*keys, "exit", "n_comments", n_kept.alias("n_kept"), F.when(reached, F.col("n_targets") - F.size("kept")).otherwise(0).alias("n_overflows"), F.when(stays, F.col("kept").cast(kind)).otherwise(none).alias("kept"))
    zero = F.lit(0)
    before = left.select(*keys, "exit", zero.alias("n_comments"), zero.alias("n_kept"), zero.alias("n_overflows"), none.alias("kept"))
    return Filtered(before.unionByName(after).dropDuplicates(["file_id"]))


def drop_overflows(dataset: DataFrame, capacity: int, counter: Callable | None = None, overhead: int = 8) -> tuple[DataFrame, DataFrame]:
    """AGG-4: the late form of E1's last step: (files that keep a target, with those; one row of the counts it changes)."""
    budget = F.lit(capacity - RESERVE)
    counted = dataset.withColumn("_n", tokens.array_token_counts(F.transform("target_comments.prompt", lambda x: tokens.excess(x, budget, overhead)), counter))
    fits = lambda x, n: F.when(F.coalesce(n + overhead <= budget, F.lit(True)), x)
    left = F.filter(F.zip_with("target_comments", "_n", fits), lambda x: x.isNotNull())
    rows = counted.withColumn("_left", left).withColumn("_over", F.greatest(F.size("target_comments"), F.lit(0)) - F.greatest(F.size("_left"), F.lit(0)))
    stays = F.size("_left") > 0
    commit = F.struct("repo_name", "commit_hash")
    counts = rows.agg(
        F.count_if(~F.coalesce(stays, F.lit(False))).alias("num_files_context_overflow"), F.count_distinct(F.when(stays, F.col("repo_name"))).alias("num_repos"), F.count_distinct(F.when(stays, commit)).alias("num_commits"),
        F.count_if(stays).alias("num_files"), F.coalesce(F.sum(F.when(stays, F.size("_left"))), F.lit(0)).alias("num_target_comments"), F.coalesce(F.sum("_over"), F.lit(0)).alias("num_target_comments_context_overflow"),
    )
    return rows.where(stays).withColumn("target_comments", F.col("_left")).drop("_n", "_left", "_over"), counts


def generate(kept: DataFrame, models: Sequence[str], client: Callable, ledger: DataFrame | None = None) -> DataFrame:
    """Stage E2: every model on every target prompt not yet in the ledger (JOIN-1, PART-4)."""
    spark = kept.sparkSession
    each = kept.crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in models], "model string")))  # a parameter list
    if ledger is not None:
        each = joins.not_yet_done(each, ledger, [*rec.RECORD_KEY, "model"])
    rows = each.select("file_id", *rec.RECORD_KEY, "model", F.posexplode("target_comments").alias("pos", "c")).where("c.prompt IS NOT NULL")
    flat = rows.select("file_id", *rec.RECORD_KEY, "model", "pos", F.col("c.type").alias("type"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), *(F.col(f"c.{n}").alias(n) for n in ("status", "anchor", "comment", "prompt_code", "prompt")))
    return complete(flat, client)


def regroup_generations(flat: DataFrame) -> DataFrame:
    """AGG-5 on the output of ``generate``: one record per file with the results of all models under each comment."""
    return joins.regroup(flat, ["file_id", *rec.RECORD_KEY], rec.COMMENT_KEY, ["model", "raw_response", "comment_text", "error"])


def score(flat: DataFrame, scorer: Callable[[], Callable[[list[str], list[str]], Sequence[float | None]]] | None = None, previous: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Stage E3: TXT-1 to TXT-3 where both sides are scorable, null scores elsewhere (FIL-18).

    ``scorer`` gives ``bertscore_f1``, see ``udfs.external_scores``; without one it stays null.  With ``previous``, the
    rows of an earlier pass, scores of equal ``keys`` and equal text are taken over (TXT-5, JOIN-4, JOIN-5); of the
    earlier rows only those of this pass's records are read on, and only the rest is scored.
    """
    ok = rec.is_scorable(F.col("error"), F.col("comment_text"), F.col("comment"))
    if previous is not None:
        records = flat.select(*keys).distinct()
        mine = previous.where("scores IS NOT NULL").select(*keys, "comment_text", "scores", F.lit(0).alias("pos"))
        before = mine.join(records, rec.same_key(mine, records, keys), "left_semi")
        done = joins.reuse_scores(flat, before, keys).withColumn("reused", F.col("reused") & ok)
        rest = score(done.where("NOT reused").drop("reused", "scores"), scorer)
        return done.where("reused").drop("reused").select(*rest.columns).unionByName(rest)
    pair = F.when(ok, text.normalize_comment("comment_text")), F.when(ok, text.normalize_comment("comment"))
    f1 = udfs.external_scores(scorer)(*pair) if scorer else F.lit(None).cast("double")
    return flat.withColumn("s", udfs.pair_scores(*pair)).withColumn("f1", f1).withColumn("scores", F.when(ok, F.struct("s.bleu1", "s.bleu2", "s.bleu3", "s.bleu4", "s.rougeL", F.nanvl("f1", F.lit(None).cast("double")).alias("bertscore_f1")))).drop("s", "f1")


def sample_items(generated: DataFrame, metric: str, fraction: float, total: int, seed: int = 0, strict: bool = False) -> DataFrame:
    """PRJ-5, SAMP-1, SAMP-2: items at or below each model's cut-off, an equal quota per model, pseudo-models left out.

    ``strict`` raises where a model has fewer candidates than the quota (AGG-17).
    """
    g = generated.select(*rec.RECORD_KEY, F.explode("comment_generations").alias("c")).select(*rec.RECORD_KEY, "c", F.explode("c.results").alias("r"))
    items = g.select(
        *rec.RECORD_KEY, F.col("c.type").alias("type"), F.col("c.start_line").alias("start_line"), F.col("c.end_line").alias("end_line"), rec.model_name(F.col("r.model")).alias("model"),
        F.col("c.status").alias("status"), F.col("c.anchor").alias("anchor"), F.lit(metric).alias("metric"), F.col(f"r.scores.{metric}").alias("score"), F.col("r.scores").alias("scores"),
        F.col("c.comment").alias("reference_comment"), F.col("r.comment_text").alias("comment_text"), F.col("r.raw_response").alias("raw_response"), F.col("c.prompt_code").alias("prompt_code"), F.col("c.prompt").alias("prompt"),
        F.col("r.result_id").alias("result_id"),
    )
    items = items.where(F.col("score").isNotNull() & ~F.isnan("score") & ~F.col("model").startswith("<")).dropDuplicates(["result_id"])
    limit = agg.nearest_rank(items.select("model", "score"), ["model"], "score", fraction)
    quota = F.ceil(F.lit(total) / F.count("*").over(Window.partitionBy()))  # over the models, one row each
    limit = limit.select("model", "threshold", "n_candidates", quota.alias("quota"))
    if strict:
        agg.require_candidates(limit, "model", int((limit.agg(F.max("quota")).first() or [0])[0] or 0))
    below = items.join(limit.select("model", "threshold", "quota"), "model").where("score <= threshold").drop("threshold")
    picked = agg.seeded_sample(below, "model", "result_id", F.col("quota"), seed).drop("quota")
    return picked.withColumn("id", udfs.item_id("repo_name", "new_path", "commit_hash", "type", "start_line", "end_line", "model"))


def merge_shard_counts(manifests: DataFrame) -> DataFrame:
    """AGG-3: counters added up, repositories as a set; ``manifests`` has num_files and repo_names per shard."""
    names = manifests.select(F.explode("repo_names").alias("repo")).agg(F.count_distinct("repo").alias("num_repos"))
    return manifests.agg(F.sum("num_files").alias("num_files")).crossJoin(names)


def task_counts(n: int, per_task: int) -> int:
    """PART-5."""
    if per_task < 1:
        raise ValueError("a task needs at least one item")
    return max(1, -(-n // per_task))


def task_assignment(task: int, partitions: int, models: Sequence[str]) -> tuple[str, int]:
    """PART-4: the model and partition of a flat task number."""
    if not 0 <= task < partitions * len(models):
        raise ValueError(f"task {task} is not among {partitions * len(models)}")
    return models[task // partitions], task % partitions
