"""Counts, summaries, correlations, cut-offs and densities (AGG-*, WIN-*, SAMP-*)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from marginalia.functions import text
from marginalia.functions.tokens import token_counts
from marginalia.functions.udfs import p_value
from marginalia.plans.session import cut

from . import ranks
from .records import all_results, is_finite, join_same


def percent(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """A share of nothing is 0."""
    return F.coalesce(F.try_divide(part * F.lit(scale), whole), F.lit(0.0))


def funnel(files: DataFrame, exits: Sequence[tuple[str, Column]], *more: Column) -> DataFrame:
    """AGG-1, AGG-2: each file leaves by the first exit whose condition holds, or is kept; one pass.

    ``files`` has repo_name and commit_hash; ``more`` are further aggregates of the same pass.
    """
    why = F.coalesce(*(F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in exits), F.lit("kept"))
    commit = F.struct("repo_name", "commit_hash")
    rows = files.withColumn("exit", why)
    counts = [F.count_if(F.col("exit") == name).alias(f"n_{name}") for name, _ in exits]
    kept = F.col("exit") == "kept"
    return rows.agg(
        F.count("*").alias("raw_num_files"),
        *counts,
        F.count_if(kept).alias("num_files"),
        F.count_distinct("repo_name").alias("raw_num_repos"),
        F.count_distinct(commit).alias("raw_num_commits"),
        F.count_distinct(F.when(kept, F.col("repo_name"))).alias("num_repos"),
        F.count_distinct(F.when(kept, commit)).alias("num_commits"),
        *more,
    )


def failure_tally(results: DataFrame) -> DataFrame:
    """AGG-7, ORD-4: failures by reason with their share of failures; completions in every row."""
    failed = text.is_failed(F.col("error"), F.col("comment_text"))
    rows = results.select(F.when(failed, text.failure_reason("error")).alias("reason"))
    by = rows.groupBy("reason").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n").alias("completions"), F.coalesce(F.sum(F.when(F.col("reason").isNotNull(), F.col("n"))), F.lit(0)).alias("failures"))
    out = by.where(F.col("reason").isNotNull()).crossJoin(F.broadcast(total))  # one row
    return out.select("reason", "n", "completions", F.round(percent(F.col("n"), F.col("failures")), 6).alias("share_of_failures"), F.round(percent(F.col("failures"), F.col("completions")), 6).alias("failure_percentage"))


def token_totals(rows: DataFrame, group: str, tokens: str) -> DataFrame:
    """AGG-8: sum, count and mean per group and, with a null group, over all."""
    out = rows.rollup(group).agg(F.sum(tokens).alias("total_tokens"), F.count(tokens).alias("n"), F.avg(tokens).alias("average_tokens"))
    return out.withColumn("average_tokens", F.round("average_tokens", 6))


def token_stats(generated: DataFrame, count: Callable[[Column], Column] = token_counts) -> DataFrame:
    """AGG-8: per model and, with a null model, over all: tokens of outputs (once a result) and prompts (once a comment).

    Results without a raw response are failures; they have no tokens.  Texts are counted as they are read, and only the
    counts are moved.
    """
    comments = generated.select("file_id", F.explode("comment_generations").alias("c")).select("file_id", "c.type", "c.start_line", "c.end_line", F.md5("c.prompt").alias("h"), count(F.col("c.prompt")).alias("n"), F.col("c.prompt").isNotNull().alias("has"))
    prompts = comments.where("has").dropDuplicates(["file_id", "type", "start_line", "end_line", "h"]).agg(F.count("*").alias("n_prompts"), F.coalesce(F.sum("n"), F.lit(0)).alias("prompt_tokens"), F.avg("n").alias("average_prompt_tokens"))
    rows = all_results(generated, "raw_response").select("result_id", "model", F.col("raw_response").isNull().alias("failed"), count(F.col("raw_response")).alias("n")).dropDuplicates(["result_id"])
    outputs = rows.rollup("model").agg(F.count_if(~F.col("failed")).alias("n_outputs"), F.count_if("failed").alias("n_failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("output_tokens"), F.round(F.avg("n"), 6).alias("average_output_tokens"))
    return outputs.crossJoin(prompts).withColumn("average_prompt_tokens", F.round("average_prompt_tokens", 6))  # one row of prompts


def project_cost(stats: DataFrame, in_price: float, out_price: float) -> DataFrame:
    """AGG-9: a completion of mean length for every prompt, at prices per million; ``stats`` is the row over all of ``token_stats``."""
    into = F.col("prompt_tokens") / F.lit(1e6) * in_price
    out = F.try_divide(F.col("output_tokens"), F.col("n_outputs")) * F.col("n_prompts") / F.lit(1e6) * out_price
    return stats.select(F.round(into, 9).alias("input_cost"), F.round(F.coalesce(out, F.lit(0.0)), 9).alias("output_cost"), F.round(into + F.coalesce(out, F.lit(0.0)), 9).alias("total_cost"))


def estimate_cost(prompt: Column, n_prompts: Column, output: Column, in_price: float, out_price: float) -> Column:
    """AGG-9: mean tokens times prompts at prices per million."""
    return prompt * n_prompts / 1e6 * in_price + output * n_prompts / 1e6 * out_price


def overflow_tally(prompts: DataFrame, limits: DataFrame) -> DataFrame:
    """AGG-10, JOIN-13: prompts over each limit; ``prompts`` has new_path and n_tokens, ``limits`` is a parameter table."""
    over = F.col("n_tokens") - F.col("capacity")
    rows = prompts.crossJoin(limits).withColumn("over", F.when(over > 0, over))
    paths = F.count_distinct("new_path") + F.max(F.when(F.col("new_path").isNull(), 1).otherwise(0))
    overflown = F.count_distinct(F.when(F.col("over").isNotNull(), F.col("new_path"))) + F.max(F.when(F.col("over").isNotNull() & F.col("new_path").isNull(), 1).otherwise(0))
    key = ["window_name", "capacity"]
    tally = rows.groupBy(*key).agg(
        F.count("*").alias("n_comments"), F.count("over").alias("n_overflows"), F.round(percent(F.count("over"), F.count("*")), 6).alias("overflow_percentage"),
        F.max("over").cast("long").alias("worst_overflow"), paths.alias("n_paths"), overflown.alias("n_overflow_paths"),
    )
    middle = ranks.medians(rows, key, "over", "middle")
    both = join_same(tally, middle, key, "left")
    return both.select(*key, "n_comments", "n_overflows", "overflow_percentage", F.bround("middle", 0).cast("long").alias("median_overflow"), "worst_overflow", "n_paths", "n_overflow_paths")


def metric_summary(long: DataFrame, digits: int = 9) -> DataFrame:
    """AGG-12, ORD-7: count, mean and median of each metric per model, models in order."""
    key = ["model", "metric"]
    counts = ranks.running(ranks.counted(long, key, "score"), key, "score")
    total = F.col("_total")
    low, high = ranks.at_rank("score", F.floor((total + 1) / 2)), ranks.at_rank("score", F.floor(total / 2) + 1)
    n = F.sum("_n")
    out = counts.groupBy(*key).agg(n.alias("n"), F.round(F.sum(F.col("score") * F.col("_n")) / n, digits).alias("mean_score"), F.round((low + high) / 2, digits).alias("median_score"))
    return out.orderBy(*key)


def corpus_bleu(pairs: DataFrame, group: str, order: int = 4) -> DataFrame:
    """AGG-13: matches and possible n-grams summed over the corpus before they are combined."""
    sums = [F.sum(F.get("match", F.lit(k))).alias(f"m{k + 1}") for k in range(order)] + [F.sum(F.get("possible", F.lit(k))).alias(f"p{k + 1}") for k in range(order)]
    rows = pairs.groupBy(group).agg(F.sum("p_len").alias("c"), F.sum("r_len").alias("r"), *sums)
    brevity = F.when(F.col("c") > F.col("r"), 1.0).when(F.col("c") == 0, 0.0).otherwise(F.exp(1 - F.try_divide(F.col("r"), F.col("c"))))
    out = [group]
    for n in range(1, order + 1):
        none = F.lit(False)
        logs = F.lit(0.0)
        for k in range(1, n + 1):
            none = none | (F.col(f"m{k}") == 0) | (F.col(f"p{k}") == 0)
            logs = logs + F.log(F.try_divide(F.col(f"m{k}"), F.col(f"p{k}")))
        out.append(F.round(F.when(none, 0.0).otherwise(brevity * F.exp(logs / n)), 9).alias(f"bleu{n}_corpus"))
    return rows.select(*out)


def correlations(rows: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """AGG-14, FIL-16, WIN-3: Pearson and Spearman with two-sided p, and a status where they cannot be had."""
    return correlation_grid(rows, group, x, [y]).drop("y")


def correlation_grid(rows: DataFrame, group: Sequence[str], x: str, ys: Sequence[str]) -> DataFrame:
    """The same of ``x`` with each of the columns ``ys``, named in ``y``.

    Equal rows are counted first and the counts written, as ranks, means and sums all read them.  The ranks of ``x``
    among the rows that have a value of each ``y`` come from one pass, with a count for each.
    """
    number = lambda c: F.when(is_finite(F.col(c).cast("double")), F.col(c).cast("double"))
    names = [f"_y{k}" for k in range(len(ys))]
    good = rows.select(*group, number(x).alias("x"), *(number(c).alias(n) for c, n in zip(ys, names, strict=True))).where("x IS NOT NULL")
    held = cut(good.groupBy(*group, "x", *names).agg(F.count("*").alias("n")))
    n = F.col("n")
    each = [F.sum(F.when(F.col(c).isNotNull(), n).otherwise(0)).alias(f"_n{c}") for c in names]
    run = ranks.running(held.groupBy(*group, "x").agg(*each), group, "x", *(f"_n{c}" for c in names))
    rx = run.select(*group, "x", *((F.col(f"_n{c}_before") + (F.col(f"_n{c}") + 1) / 2).alias(f"_r{c}") for c in names))
    part = lambda *more: F.inline(F.array(*(F.struct(F.lit(y).alias("y"), F.col(c).alias("v"), *(F.col(f"{m}{c}").alias("rx") for m in more)) for y, c in zip(ys, names, strict=True))))
    on = [*group, "y"]
    plain = held.select(*group, "x", "n", part()).where("v IS NOT NULL")
    ry = ranks.average_ranks(ranks.counted(plain, on, "v", "n"), on, "v", "ry")
    ends = plain.groupBy(*on).agg((F.sum(F.col("x") * n) / F.sum(n)).alias("mx"), (F.sum(F.col("v") * n) / F.sum(n)).alias("mv"), (F.sum(n) / 2 + 0.5).alias("mr"), ((F.min("x") == F.max("x")) | (F.min("v") == F.max("v"))).alias("flat"))
    ranked = join_same(held, rx, [*group, "x"]).select(*group, "x", "n", part("_r")).where("v IS NOT NULL")
    ranked = join_same(join_same(ranked, ry, [*on, "v"]), ends, on)

    def r(a: str, b: str, ma: str, mb: str) -> Column:
        da, db = F.col(a) - F.col(ma), F.col(b) - F.col(mb)
        value = F.try_divide(F.sum(n * da * db), F.sqrt(F.sum(n * da * da)) * F.sqrt(F.sum(n * db * db)))
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))

    got = ranked.groupBy(*on).agg(F.sum("n").alias("n"), F.any_value("flat").alias("flat"), r("x", "v", "mx", "mv").alias("p"), r("rx", "ry", "mr", "mr").alias("s"))
    usable = (F.col("n") >= 2) & ~F.col("flat")
    status = F.when(F.col("n") < 2, "insufficient_data").when(F.col("flat"), "constant_input").when(F.col("n") == 2, "spearman_p_value_unavailable").otherwise("ok")
    pearson, spearman = F.when(usable, F.col("p")), F.when(usable, F.col("s"))
    return got.select(
        *on, "n", F.round(pearson, 9).alias("pearson_r"), F.round(p_value(pearson, "n"), 9).alias("pearson_p_value"),
        F.round(spearman, 9).alias("spearman_r"), F.when(F.col("n") > 2, F.round(p_value(spearman, "n"), 9)).alias("spearman_p_value"), status.alias("status"),
    )


def nearest_rank(long: DataFrame, group: Sequence[str], value: str, fraction: float) -> DataFrame:
    """AGG-16, FIL-20: the score of rank ``ceil(f n)`` and how many lie at or below it."""
    if not 0 < fraction <= 1:
        raise ValueError(f"a fraction lies above 0 and is 1 at most, not {fraction}")
    run = ranks.running(ranks.counted(long, group, value), group, value)
    hit = run.where(F.col("_before") + F.col("_n") >= F.ceil(F.lit(fraction) * F.col("_total")))
    return hit.groupBy(*group).agg(F.any_value("_total").alias("n"), F.min(value).alias("threshold"), F.min(F.col("_before") + F.col("_n")).alias("n_candidates"))


def require_candidates(limits: DataFrame, group: str, quota: int) -> None:
    """AGG-17: every group has at least ``quota`` candidates; raises with the first groups that have fewer."""
    few = limits.where(F.col("n_candidates") < quota).orderBy(group).select(group, "n_candidates").limit(20).collect()
    if few:
        raise ValueError("too few candidates: " + ", ".join(f"{r[0]} has {r[1]} of {quota}" for r in few))


def seeded_sample(rows: DataFrame, group: str, key: str, quota: int | Column, seed: int = 0) -> DataFrame:
    """SAMP-1, SAMP-2: exactly ``quota`` rows per group by a seeded hash; the same rows for any partitioning.

    Each partition of a salt first keeps its own best ``quota``, so no task sees a hot group whole.
    """
    order = [F.col("_h"), F.col(key)]
    salted = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    first = salted.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_k") <= quota)
    last = first.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= quota)
    return last.drop("_h", "_salt", "_k")


def density_histogram(long: DataFrame, bins: int = 50) -> DataFrame:
    """AGG-19, VIZ-1: shared bins per metric, density per model; empty bins are left out.

    The bin is the last whose edge ``lo + i * ((hi - lo) / bins)`` is not above the value.
    """
    ends = long.groupBy("metric").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    ends = ends.select("metric", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    total = long.groupBy("model", "metric").agg(F.count("*").alias("n"))
    counted = long.groupBy("model", "metric", "score").agg(F.count("*").alias("c")).join(ends, "metric")
    width = (F.col("hi") - F.col("lo")) / bins
    guess = F.floor((F.col("score") - F.col("lo")) / width).cast("int")
    near = F.array_max(F.filter(F.transform(F.sequence(F.greatest(guess - 2, F.lit(0)), F.greatest(guess + 2, F.lit(0))), lambda i: i), lambda i: F.col("score") >= F.col("lo") + i * width))
    rows = counted.withColumn("bin", F.least(F.coalesce(near, F.lit(0)), F.lit(bins - 1))).withColumn("width", width)
    by = rows.groupBy("model", "metric", "bin").agg(F.sum("c").alias("n_bin"), F.any_value("width").alias("width"))
    return by.join(total, ["model", "metric"]).select("model", "metric", "bin", "n_bin", F.round(F.col("n_bin") / (F.col("n") * F.col("width")), 6).alias("density"))


def islands(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """WIN-1, WIN-2: runs of consecutive integers as (first, last)."""
    placed = ranks.running(ranks.counted(rows, group, value).withColumn("_n", F.lit(1).cast("long")), group, value)
    marked = placed.select(*group, value, (F.col(value) - F.col("_before")).alias("_i"))
    return marked.groupBy(*group, "_i").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_i")


def array_spec(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """WIN-2: ``0-2,5,7-8``."""
    piece = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    runs = islands(rows, group, value).select(*group, F.struct("first", piece.alias("s")).alias("p"))
    return runs.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), ",").alias("spec"))


def top_k(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """ORD-3: the first ``k`` rows of each group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def greedy_f1(candidate: DataFrame, reference: DataFrame, pair: str, token: str, vector: str) -> DataFrame:
    """TXT-3: mean of each candidate token's best cosine (precision) and each reference token's (recall), and their F1.

    ``pair`` says which tokens are compared; pairs without tokens on both sides give no row.
    """
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    a = candidate.select(pair, F.col(token).alias("i"), F.col(vector).alias("v"), norm(F.col(vector)).alias("nv"))
    b = reference.select(pair, F.col(token).alias("j"), F.col(vector).alias("w"), norm(F.col(vector)).alias("nw"))
    dot = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosines = a.join(b, pair).select(pair, "i", "j", (dot / (F.col("nv") * F.col("nw"))).alias("c"))
    rows = cosines.groupBy(pair, "i").agg(F.max("c").alias("c")).groupBy(pair).agg(F.avg("c").alias("precision"))
    columns = cosines.groupBy(pair, "j").agg(F.max("c").alias("c")).groupBy(pair).agg(F.avg("c").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return rows.join(columns, pair).withColumn("f1", F.when(both != 0, 2 * F.col("precision") * F.col("recall") / both))


QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096


def _matrices(df: DataFrame, tag: str, vector: str, size: int) -> DataFrame:
    """(tags, m): rows of ``df`` gathered to blocks of at most ``size`` unit vectors; null and zero vectors are left out."""
    held = df.schema[tag].dataType
    kind = held.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of = to_arrow_type(held)
        tags: list = []
        rows: list = []

        def flush():
            m = np.array(rows, np.float64)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            return pa.RecordBatch.from_arrays([pa.array([tags], pa.list_(of)), pa.array([m.tobytes()], pa.binary())], names=["tags", "m"])

        for batch in batches:
            for t, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v and any(v):
                    tags.append(t)
                    rows.append(v)
                    if len(rows) == size:
                        yield flush()
                        tags, rows = [], []
        if rows:
            yield flush()

    return df.select(tag, vector).mapInArrow(run, f"tags array<{kind}>, m binary")


def best_cosines(queries: DataFrame, vectors: DataFrame, query_id: str, label: str, vector: str) -> DataFrame:
    """TXT-3's matching step: (query_id, label, best) of each query against all vectors, by products of blocks."""
    kinds = f"q {queries.schema[query_id].dataType.simpleString()}, l {vectors.schema[label].dataType.simpleString()}, best double"
    a = _matrices(queries, query_id, vector, QUERY_BLOCK).toDF("qs", "a")
    b = _matrices(vectors, label, vector, VECTOR_BLOCK).toDF("ls", "b")
    arrow = to_arrow_schema(T._parse_datatype_string(kinds))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for qs, left, ls, right in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                cosines = np.frombuffer(left, np.float64).reshape(len(qs), -1) @ np.frombuffer(right, np.float64).reshape(len(ls), -1).T
                place = {name: k for k, name in enumerate(dict.fromkeys(ls))}
                of = np.array([place[x] for x in ls])
                top = np.concatenate([cosines[:, of == k].max(axis=1) for k in place.values()])
                yield pa.RecordBatch.from_arrays([pa.array(qs * len(place), arrow.field(0).type), pa.array([name for name in place for _ in qs], arrow.field(1).type), pa.array(top)], schema=arrow)

    pairs = b.crossJoin(a).select("qs", "a", "ls", "b")  # a row for each two blocks
    return pairs.mapInArrow(run, kinds).groupBy(F.col("q").alias(query_id), F.col("l").alias(label)).agg(F.max("best").alias("best"))
