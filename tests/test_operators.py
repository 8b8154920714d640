import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from marginalia.operators import aggregates as agg
from marginalia.operators import joins
from marginalia.operators import records as rec
from marginalia.operators import reports


def test_resume_matches_null_keys(spark):
    todo = spark.createDataFrame([("r", None, "c"), ("r", "p", "c")], "repo_name string, new_path string, commit_hash string")
    done = spark.createDataFrame([("r", None, "c"), ("r", None, "c")], todo.schema)
    assert [r.new_path for r in joins.not_yet_done(todo, done).collect()] == ["p"]


def test_prune_keeps_empty_records(spark):
    c = "array<struct<type:string,start_line:int,end_line:int,x:string>>"
    run = spark.createDataFrame(
        [("r", "1", "c", [("b", 1, 1, "k"), ("b", 2, 2, "k")]), ("r", "2", "c", [("b", 1, 1, "k")]), ("r", None, "c", [("b", 9, 9, "k")])],
        f"repo_name string, new_path string, commit_hash string, comment_generations {c}",
    )
    data = spark.createDataFrame([("r", "1", "c", [("b", 2, 2)]), ("r", None, "c", None)], "repo_name string, new_path string, commit_hash string, target_comments array<struct<type:string,start_line:int,end_line:int>>")
    got = {r.new_path: [g.start_line for g in r.comment_generations] for r in joins.prune(run, data).collect()}
    assert got == {"1": [2], None: []}


def test_regroup_keeps_order_of_first_sight(spark):
    rows = [(0, "R", "c1", "M1"), (1, "R", "c2", "M1"), (2, "R", "c2", "M2"), (3, "R", "c3", "M2")]
    df = spark.createDataFrame(rows, "pos int, rec string, com string, model string")
    got = joins.regroup(df, ["rec"], ["com"], ["model"]).collect()[0].comment_generations
    assert [(g.com, [r.model for r in g.results]) for g in got] == [("c1", ["M1"]), ("c2", ["M1", "M2"]), ("c3", ["M2"])]


def test_reuse(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (None, "n")], "k int, comment_text string")
    old = spark.createDataFrame([(1, "a", 0.5, 0), (2, "z", 0.6, 1), (3, None, 0.7, 2), (None, "n", 0.8, 3)], "k int, comment_text string, scores double, pos int")
    got = {r.k: (r.reused, r.scores) for r in joins.reuse_scores(now, old, ["k"]).collect()}
    assert got == {1: (True, 0.5), 2: (False, None), 3: (True, 0.7), None: (True, 0.8)}


def test_latest_and_missing(spark):
    log = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (1, 2, "c")], "id int, pos int, v string")
    assert {r.id: r.v for r in joins.latest(log, "id", "pos").collect()} == {1: "c", 2: "b"}
    assert [r.task_id for r in joins.missing_numbers(spark.createDataFrame([(0,), (1,), (3,)], "t int"), "t", 4).collect()] == [2]


def test_funnel_adds_up(spark):
    files = spark.createDataFrame([("a", "1", 1), ("a", "1", 2), ("b", "2", 3), ("b", None, None)], "repo_name string, commit_hash string, k int")
    r = agg.funnel(files, [("one", F.col("k") == 1), ("odd", F.col("k") % 2 == 1)]).collect()[0]
    assert (r.raw_num_files, r.n_one, r.n_odd, r.num_files) == (4, 1, 1, 2)
    assert r.n_one + r.n_odd + r.num_files == r.raw_num_files and r.num_repos == 2


@pytest.mark.parametrize(("n", "f"), [(5, 0.2), (5, 0.5), (100, 0.07), (75, 0.28), (1, 1.0)])
def test_nearest_rank(spark, n, f):
    values = random.Random(n).sample(range(1000), n)
    df = spark.createDataFrame([("m", v / 10) for v in values], "g string, v double")
    r = agg.nearest_rank(df, ["g"], "v", f).collect()[0]
    rank = math.ceil(f * n)
    assert (r.threshold, r.n_candidates, r.n) == (sorted(values)[rank - 1] / 10, rank, n)


def test_correlations(spark):
    rows = [("f", 1.0, 2.0), ("f", 2.0, 1.0), ("f", 3.0, 5.0), ("f", 4.0, 4.0), ("f", 5.0, 3.0), ("f", None, 1.0), ("f", float("nan"), 1.0), ("f", float("inf"), 1.0)]
    rows += [("one", 1.0, 1.0), ("flat", 1.0, 1.0), ("flat", 1.0, 2.0), ("two", 1.0, 1.0), ("two", 2.0, 0.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r for r in agg.correlations(df, ["g"], "x", "y").collect()}
    assert (got["f"].n, got["f"].pearson_r, got["f"].spearman_r, got["f"].status) == (5, 0.5, 0.5, "ok")
    assert got["f"].pearson_p_value == pytest.approx(0.391002219, abs=1e-8)
    assert (got["one"].status, got["flat"].status, got["two"].status) == ("insufficient_data", "constant_input", "spearman_p_value_unavailable")
    assert (got["two"].pearson_r, got["two"].pearson_p_value, got["two"].spearman_p_value) == (-1.0, 1.0, None)


def test_histogram_bins(spark):
    df = spark.createDataFrame([("m", "x", k / 100) for k in range(11)], "model string, metric string, score double")
    assert sorted(r.bin for r in agg.density_histogram(df).collect()) == [0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 49]
    same = spark.createDataFrame([("m", "x", 0.5)] * 3, "model string, metric string, score double")
    assert [(r.n_bin, r.density) for r in agg.density_histogram(same).collect()] == [(3, 50.0)]


def test_array_spec(spark):
    df = spark.createDataFrame([(0, v) for v in (0, 1, 2, 5, 7, 8, 8)], "g int, v int")
    assert agg.array_spec(df, ["g"], "v").collect()[0].spec == "0-2,5,7-8"
    assert agg.array_spec(df.where("false"), ["g"], "v").collect() == []


def test_sample_is_exact_and_partition_free(spark):
    df = spark.createDataFrame([("a" if k % 3 else "b", k) for k in range(500)], "g string, k int")
    one = {(r.g, r.k) for r in agg.seeded_sample(df.repartition(1), "g", "k", 20, 1).collect()}
    many = {(r.g, r.k) for r in agg.seeded_sample(df.repartition(7), "g", "k", 20, 1).collect()}
    assert one == many and len(one) == 40


def test_overflow_rounds_half_to_even(spark):
    prompts = spark.createDataFrame([("p", 101), (None, 102), ("q", 5)], "new_path string, n_tokens int")
    limits = spark.createDataFrame([("w", 100)], "window_name string, capacity int")
    r = agg.overflow_tally(prompts, limits).collect()[0]
    assert (r.n_comments, r.n_overflows, r.median_overflow, r.worst_overflow, r.n_paths, r.n_overflow_paths) == (3, 2, 2, 2, 3, 2)


def test_summary_and_cost(spark):
    df = spark.createDataFrame([("m", "x", v) for v in (1.0, 2.0, 4.0, 10.0)], "model string, metric string, score double")
    r = agg.metric_summary(df).collect()[0]
    assert (r.n, r.mean_score, r.median_score) == (4, 4.25, statistics.median([1, 2, 4, 10]))
    cost = spark.range(1).select(agg.estimate_cost(F.lit(15.0), F.lit(2), F.lit(6.0), 2.0, 10.0).alias("c")).collect()[0].c
    assert cost == pytest.approx(1.8e-4)


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),), (None,)], "v double")
    assert [r.ok for r in df.select(F.coalesce(rec.is_finite(F.col("v")), F.lit(False)).alias("ok")).collect()] == [True, False, False, False]


def test_reports():
    assert reports.fence("a ``` b") == "````\na ``` b\n````"
    assert reports.page("n", [{"a": 1, "b": "x|y"}]) == "# n\n\n---\n\n## Record 1\n\n| Key | Value |\n| --- | --- |\n| a | 1 |\n| b | x\\|y |\n\n"
    assert list(reports.blocks([{"a": "x\ny"}, {}], 7, "k")) == ["**k 1**", "**a**", "```\nx\ny\n```", "---", "**k 2**", "{}"]
    assert reports.code_span("a`b") == "`` a`b ``" and reports.code_span("x") == "`x`" and list(reports.blocks("a\n```\n\nb", 1, "")) == ["> a\n> ```\n>\n> b"]
    assert [reports.looks_like_code(x) for x in ("# x", "a.b", "1.5", "a/b", "x == y", "plain words", "f()")] == [True, True, False, True, True, False, True]
    assert "No failures in 3" in reports.failure_report("r", [], 3) and "Every prompt fits all 1 models." in reports.context_report("d", [{"window_name": "w", "capacity": 1, "n_comments": 2, "n_overflows": 0, "overflow_percentage": 0.0, "median_overflow": None, "worst_overflow": None, "n_overflow_paths": 0}], 0)
    assert "[" not in reports.review({"repo_name": "r", "commit_hash": "c", "new_path": "p", "start_line": 1, "end_line": 2, "model": "m"})
    assert reports.with_comment("  # Add the comment here\nx", "# a\n# b", "block") == "  # a\n  # b\nx"
    assert reports.with_comment("y  # Add the comment here", "# a\n# b", "inline") == "y  # a # b"
    assert "–" in reports.report("t", [{"n": 0, "m": "x"}])


def test_parts_never_fall_as_values_rise(spark):
    from marginalia.operators import ranks

    rng = random.Random(3)
    values = sorted({0.0, 1.0, -1.0, 0.5, 2.0, 1e-300, 5e-324, 1e300, float("inf"), float("-inf"), *(rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(3000)), *(2.0**k for k in range(-60, 60)), *(math.nextafter(2.0**k, 0) for k in range(-60, 60))})
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ranks.value_part(F.col("v")).alias("p")).collect()
    parts = [r.p for r in sorted(rows, key=lambda r: r.v)]
    assert parts == sorted(parts) and len(set(parts)) > 2500


def test_running_counts_medians_and_ranks(spark):
    from marginalia.operators import ranks

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([round(rng.gauss(0, 1), 1), rng.lognormvariate(0, 3), 0.0])) for _ in range(700)] + [("n", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    by = {}
    for g, v in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    run = ranks.running(ranks.counted(df, ["g"], "v"), ["g"], "v").collect()
    assert all((r._before, r._n, r._total) == (sum(x < r.v for x in by[r.g]), by[r.g].count(r.v), len(by[r.g])) for r in run) and len(run) == sum(len(set(x)) for x in by.values())
    assert {r.g: r.m for r in ranks.medians(df, ["g"], "v", "m").collect()} == {g: statistics.median(x) for g, x in by.items()}
    mean = {(r.g, r.v): r.k for r in ranks.average_ranks(ranks.counted(df, ["g"], "v"), ["g"], "v", "k").collect()}
    assert all(k == sum(x < v for x in by[g]) + (by[g].count(v) + 1) / 2 for (g, v), k in mean.items())
    assert ranks.medians(df.where("false"), ["g"], "v", "m").collect() == []


def test_candidates_are_enough(spark):
    limits = spark.createDataFrame([("a", 5), ("b", 2)], "model string, n_candidates long")
    agg.require_candidates(limits, "model", 2)
    with pytest.raises(ValueError, match="b has 2 of 3"):
        agg.require_candidates(limits, "model", 3)


def test_views_of_annotations(spark):
    df = spark.createDataFrame([("a", ["x"], True), ("b", [], False), ("c", None, None)], "id string, tags array<string>, done boolean")
    ids = lambda *v: "".join(sorted(r.id for r in df.where(rec.in_view(*v)).collect()))
    assert [ids(v) for v in rec.ANNOTATION_VIEWS] == ["abc", "bc", "a", "bc"] and ids("tag", "x") == "a"
    with pytest.raises(ValueError):
        rec.in_view("other")


def test_intents(spark):
    c = "struct<type:string,status:string,comment:string,intent:string>"
    df = spark.createDataFrame([(("block", "added", "# keep", i),) for i in ("why", None, "todo")], f"c {c}")
    assert [r.ok for r in df.select(rec.is_target(F.col("c"), F.col("c.intent")).alias("ok")).collect()] == [True, True, False]


def test_token_counts(spark):
    from marginalia.functions import tokens

    texts = ["def f(a): return a", "", None, "<|endoftext|> Grüße 😀", "x" * 5000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    count = tokens.vocabulary()()
    want = [None if t is None else count([t])[0] for t in texts]
    got = {r.k: (r.n, list(r.a)) for r in df.select("k", tokens.token_counts(F.col("t")).alias("n"), tokens.array_token_counts(F.array("t", F.lit(None).cast("string"))).alias("a")).collect()}
    assert [got[k][0] for k in range(5)] == want and [got[k][1] for k in range(5)] == [[w, None] for w in want]
    assert want[1] == 0 and tokens.vocabulary("unknown")()(["a b"]) == count(["a b"])
    own = lambda: lambda x: [len(t) for t in x]
    assert [r.n for r in df.orderBy("k").select(tokens.token_counts(F.col("t"), own).alias("n")).collect()] == [18, 0, None, len(texts[3]), 5000]


def test_token_stats_and_cost(spark):
    g = "file_id long, comment_generations array<struct<type:string,start_line:int,end_line:int,prompt:string,results:array<struct<result_id:long,model:string,raw_response:string>>>>"
    rows = [(1, [("b", 1, 1, "aa", [(1, "m", "bbbb"), (2, "", None)]), ("b", 2, 2, "aaaa", [(3, "m", "bb")])])]
    df = spark.createDataFrame(rows + rows, g)
    by = {r.model: r for r in agg.token_stats(df, F.length).collect()}
    r = by[None]
    assert (r.n_prompts, r.prompt_tokens, r.n_outputs, r.n_failed, r.output_tokens, r.average_output_tokens) == (2, 6, 2, 1, 6, 3.0) and by["<unknown>"].n_failed == 1
    cost = agg.project_cost(agg.token_stats(df, F.length).where("model IS NULL"), 2.0, 10.0).collect()[0]
    assert cost.total_cost == pytest.approx(6 / 1e6 * 2 + 3 * 2 / 1e6 * 10)


def test_best_cosines_in_blocks(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice(["x", "y", None]), [rng.gauss(0, 1) for _ in range(5)]) for k in range(40)] + [(50, "x", None), (51, "x", [0.0] * 5), (52, "z", [])]
    df = spark.createDataFrame(rows, "i long, g string, v array<float>").repartition(3)
    got = {(r.i, r.g): r.best for r in agg.best_cosines(df.where("i < 6").select("i", "v"), df, "i", "g", "v").collect()}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {}
    for i, _, a in rows[:6]:
        for k, g, b in rows[:40]:
            want[i, g] = max(want.get((i, g), -2), cosine(a, b))
    assert got == pytest.approx(want, abs=1e-6) and len(got) == len(want)
    assert agg.best_cosines(df.where("false").select("i", "v"), df, "i", "g", "v").collect() == []


def test_greedy_f1(spark):
    a = spark.createDataFrame([("x", 1, [1.0, 0.0]), ("x", 2, [0.0, 2.0]), ("y", 1, [1.0, 0.0])], "p string, t int, v array<double>")
    b = spark.createDataFrame([("x", 1, [3.0, 0.0])], a.schema)
    got = agg.greedy_f1(a, b, "p", "t", "v").collect()
    assert len(got) == 1 and (got[0].precision, got[0].recall, got[0].f1) == (0.5, 1.0, pytest.approx(2 / 3))
