import pytest
from pyspark.sql import functions as F

from marginalia.functions import tokens
from marginalia.plans import pipelines

RAW = "file_id long, repo_name string, commit_hash string, new_path string, change_type string, commit_message string, source_code string, previous_source_code string"
OLD = "def f(a):\n    return a\n"
ONE = "def f(a):\n    # keep the copy open\n    return a\n"
TWO = 'def f(a):\n    # keep the copy open\n    x = """' + "y" * 3000 + '"""\n    return a\n\n\ndef g():\n    return 1  # the least\n'


def raw(spark):
    rows = [
        (1, "a", "1", "x.py", "ADD", "m", ONE, OLD), (2, "a", "1", "x.py", "MODIFY", "Co-written by a Bot", ONE, OLD), (3, "a", "2", "x.py", "MODIFY", "m", 'x = """', OLD), (4, "b", "3", "x.py", "MODIFY", "m", "x = 1  # noqa\n", "x = 1\n"),
        (5, "b", "3", "y.py", "MODIFY", "m", TWO, "def g():\n    return 1\n"), (6, "b", "4", "y.py", "MODIFY", "m", TWO.split("\n\n\ndef g")[0] + "\n", OLD), (7, None, None, None, None, None, None, None), (5, "b", "3", "y.py", "MODIFY", "m", TWO, "def g():\n    return 1\n"),
        (8, "b", "5", "z.py", "MODIFY", "m", "if x:\n    # alone in its block\n", "x = 1\n"),
    ]
    return spark.createDataFrame(rows, RAW)


by_bytes = tokens.by_bytes  # a token for each byte


def test_prompts_that_fit_by_tokens_are_kept(spark):
    """Bytes only spare the counting: three thousand equal letters are few tokens."""
    r = pipelines.filter_files(raw(spark), ["by a bot"], 2512).funnel().collect()[0]
    assert (r.n_context_overflow, r.num_files, r.num_target_comments, r.num_target_comments_overflow) == (0, 2, 3, 0)
    r = pipelines.filter_files(raw(spark), ["by a bot"], 640).funnel().collect()[0]
    assert (r.n_context_overflow, r.num_files, r.num_target_comments_overflow) == (1, 1, 2)


def test_late_overflow_filter(spark):
    kept = pipelines.filter_files(raw(spark), ["by a bot"], 99_999, counter=by_bytes).kept()
    left, counts = pipelines.drop_overflows(kept, 2512, by_bytes)
    assert [(r.file_id, len(r.target_comments)) for r in left.collect()] == [(5, 1)]
    assert tuple(counts.collect()[0]) == (1, 1, 1, 1, 1, 2)
    assert pipelines.drop_overflows(kept.where("false"), 2512, by_bytes)[1].collect()[0].num_files == 0


def test_earlier_scores_are_taken_over(spark):
    cols = "k int, comment_text string, comment string, error string"
    now = spark.createDataFrame([(1, "# keep it", "# keep it", None), (2, "# new", "# keep it", None), (3, None, "# keep it", "failed")], cols)
    s = "struct<bleu1:double,bleu2:double,bleu3:double,bleu4:double,rougeL:double,bertscore_f1:double>"
    old = spark.createDataFrame([(1, "# keep it", (9.0,) * 6), (2, "# old", (9.0,) * 6), (3, None, (9.0,) * 6), (7, "x", (9.0,) * 6)], f"k int, comment_text string, scores {s}")
    got = {r.k: r.scores for r in pipelines.score(now, previous=old, keys=["k"]).collect()}
    assert got[1].rougeL == 9.0 and got[2].rougeL == 0.0 and got[3] is None and len(got) == 3


def test_funnel_and_kept_files(spark):
    got = pipelines.filter_files(raw(spark), ["by a bot"], 2512, counter=by_bytes)
    r = got.funnel().collect()[0]
    assert (r.raw_num_files, r.n_wrong_metadata, r.n_marked_message, r.n_comment_parse_error, r.n_no_target_comments, r.n_context_overflow, r.num_files) == (8, 2, 1, 1, 1, 1, 1)
    assert r.n_prompt_code_error == 1
    assert sum(r[f"n_{e}"] for e in pipelines.Filtered.EXITS) + r.num_files == r.raw_num_files
    assert (r.num_target_comments, r.num_target_comments_overflow, r.num_repos) == (1, 2, 1)
    kept = got.kept().collect()[0]
    assert kept.file_id == 5 and [c.comment for c in kept.target_comments] == ["# the least"]
    assert "def g():\n    return 1  # Add the comment here" in kept.target_comments[0].prompt


def test_results_do_not_depend_on_partitions(spark):
    one = pipelines.filter_files(raw(spark).repartition(1), [], 2512, counter=by_bytes).funnel().collect()
    assert one == pipelines.filter_files(raw(spark).repartition(5), [], 2512, counter=by_bytes).funnel().collect()


def test_generate_resume_regroup_and_score(spark):
    kept = pipelines.filter_files(raw(spark), ["by a bot"], 2512, counter=by_bytes).kept()

    def client():
        return lambda model, prompt: "```python\n# the least value\n```" if model == "m1" else ""

    ledger = spark.createDataFrame([("b", "y.py", "3", "m3")], "repo_name string, new_path string, commit_hash string, model string")
    flat = pipelines.generate(kept, ["m1", "m2", "m3"], client, ledger)
    rows = {r.model: r for r in pipelines.score(flat).collect()}
    assert set(rows) == {"m1", "m2"}
    assert rows["m1"].scores.rougeL == pytest.approx(0.8) and rows["m1"].scores.bertscore_f1 is None
    assert rows["m2"].error == "Model returned an empty comment" and rows["m2"].scores is None
    again = pipelines.regroup_generations(flat.withColumn("pos", F.col("pos") * 2 + (F.col("model") == "m2").cast("int"))).collect()[0]
    assert [[r.model for r in c.results] for c in again.comment_generations] == [["m1", "m2"]]


def test_task_numbers():
    assert pipelines.task_assignment(5, 3, ["A", "B"]) == ("B", 2)
    assert pipelines.task_counts(0, 4) == 1 and pipelines.task_counts(9, 4) == 3
    with pytest.raises(ValueError):
        pipelines.task_assignment(6, 3, ["A", "B"])
    with pytest.raises(ValueError):
        pipelines.task_counts(1, 0)


def test_scorer_fills_the_embedding_score(spark):
    rows = [(1, "# keep it", "# keep it", None), (2, "# drop", "# keep it", None), (3, None, "# keep it", "failed")]
    flat = spark.createDataFrame(rows, "id long, comment_text string, comment string, error string")
    scorer = lambda: lambda p, r: [0.5 if a == b else None for a, b in zip(p, r, strict=True)]
    got = {r.id: r.scores for r in pipelines.score(flat, scorer).collect()}
    assert got[1].bertscore_f1 == 0.5 and got[2].bertscore_f1 is None and got[2].rougeL is not None and got[3] is None
