"""Stage drivers (CLI-1 to CLI-22): each reads a dataset's or run's folders, runs one job and leaves a manifest.

``python -m marginalia.plans.stages STAGE --root DIR ...``.  A dataset is a folder named by its time with ``raw``,
``dataset`` and manifests; its ``runs`` hold ``generated``, ``progress``, ``scored`` and what is drawn from them.
Tables are folders of JSON lines.  A manifest is written last: where it is, the rest is whole.  Work that other engines
cut into numbered tasks is one job here; filtering can still be done in shares of commits, which are then joined.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import code, text, tokens
from marginalia.operators import aggregates as agg
from marginalia.operators import joins, reports
from marginalia.operators import records as rec
from marginalia.plans import pipelines
from marginalia.sources import annotate, catalog, jsonl, mining, models, schemas, search

SCORE_KEYS = (*rec.RECORD_KEY, "type", "start_line", "end_line", "model")
_STAGES: dict[str, tuple[Callable, list[tuple[tuple, dict]]]] = {}


def stage(name: str, *arguments: tuple[tuple, dict]):
    def add(fn):
        _STAGES[name] = (fn, list(arguments))
        return fn

    return add


def _arg(*names: str, **how) -> tuple[tuple, dict]:
    return names, how


def positive(value: str) -> int:
    """FIL-22."""
    n = int(value)
    if n < 1:
        raise argparse.ArgumentTypeError(f"{value} is not a positive number")
    return n


def fraction(value: str) -> float:
    x = float(value)
    if not 0 < x <= 1:
        raise argparse.ArgumentTypeError(f"{value} does not lie above 0 and is 1 at most")
    return x


def _read(spark: SparkSession, folder: Path, name: str, schema: str) -> DataFrame:
    if not jsonl.exists(spark, str(folder / name)):
        raise SystemExit(f"{folder} has no {name}")
    return jsonl.read_lines(spark, str(folder / name), schema)


def _once(folder: Path, manifest: str) -> None:
    if (folder / manifest).exists():
        raise SystemExit(f"{folder.name} has {manifest} already")


def _row(df: DataFrame) -> dict:
    return df.first().asDict(recursive=True)


def _dataset(o) -> Path:
    return catalog.resolve(o.root, o.dataset)


def _run(o, make: bool = False) -> tuple[Path, Path]:
    return catalog.resolve_run(o.root, o.dataset, o.run, make)


def _stamp(**values) -> dict:
    return {"created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"), "git_commit": catalog.git_commit(), **values}


# ---- collect


@stage("collect.prepare", _arg("--repos-per-task", type=positive, default=1), _arg("--max-repos", type=positive, default=1000), _arg("--repo-min-stars", type=int, default=0), _arg("--transport", default="marginalia.sources.search:offline"))
def collect_prepare(spark, o):
    """CLI-1, SRC-18, ORD-6, PART-5: the list of repositories, stored once, and how many tasks it makes."""
    folder = catalog.resolve(o.root, o.dataset, make=True)
    found = lambda: [r.asDict() for r in search.search(spark, o.transport, [(o.repo_min_stars, 10**9)]).dropDuplicates(["id"]).orderBy(F.desc("stargazers_count"), "id").limit(o.max_repos).collect()]
    repos = catalog.cached(folder / "repos.jsonl", found)
    n = pipelines.task_counts(len(repos), o.repos_per_task)
    catalog.write_manifest(folder, "collect.json", **_stamp(num_repos=len(repos), num_tasks=n, repos_per_task=o.repos_per_task))
    return f"{len(repos)} repositories, {n} tasks"


@stage("collect.collect", _arg("--clones", required=True), _arg("--since", required=True), _arg("--to", required=True))
def collect_collect(spark, o):
    """CLI-2, SRC-19, SRC-20: mines local clones of what the ledger lacks."""
    folder = _dataset(o)
    repos = spark.read.schema(schemas.REPOSITORIES).json(str(folder / "repos.jsonl"))
    mining.mine_and_store(spark, repos, lambda: mining.git_miner(o.clones), o.since, o.to, str(folder / "mining"))
    return "mined"


@stage("collect.finalize")
def collect_finalize(spark, o):
    """CLI-3: files of repositories that the ledger holds become the raw table, numbered in order."""
    folder = _dataset(o)
    files = mining.mined_files(spark, str(folder / "mining"))
    key = F.concat_ws("\0", "repo_name", "commit_hash", F.coalesce("new_path", F.lit("")), "filename")
    numbered = files.withColumn("file_id", F.xxhash64(key)).select("file_id", *[c for c in files.columns if c != "file_id"])
    jsonl.write_records(numbered, str(folder / "raw"))
    n = jsonl.count_lines(spark, str(folder / "raw"))
    catalog.write_manifest(folder, "raw.json", **_stamp(num_files=n))
    return f"{n} files"


@stage("collect.filter", _arg("--task-id", type=int), _arg("--num-tasks", type=positive), _arg("--capacity", type=positive, default=8192), _arg("--marker", action="append", default=[]))
def collect_filter(spark, o):
    """CLI-4, PART-1: filters the raw files, or a share of their commits."""
    if (o.task_id is None) != (o.num_tasks is None) or (o.num_tasks and not 0 <= o.task_id < o.num_tasks):
        raise SystemExit("--task-id and --num-tasks go together, the former below the latter")
    folder = _dataset(o)
    raw = _read(spark, folder, "raw", f"file_id long, {schemas.RAW}")
    name = "dataset"
    if o.num_tasks:
        raw = raw.where(F.crc32(F.concat_ws("@", "repo_name", "commit_hash").cast("binary")) % o.num_tasks == o.task_id)
        name = jsonl.shard_name("dataset.shard", o.task_id, o.num_tasks)
    _once(folder, f"{name}.json")
    got = pipelines.filter_files(raw, o.marker, o.capacity)
    jsonl.write_records(got.kept(), str(folder / name))
    counts = _row(got.funnel())
    names = sorted(r[0] for r in got.files.where("exit = 'kept'").select("repo_name").distinct().collect()) if o.num_tasks else []
    catalog.write_manifest(folder, f"{name}.json", **_stamp(task_id=o.task_id, num_tasks=o.num_tasks, capacity=o.capacity, counts=counts, repo_names=names))
    return f"kept {counts['num_files']} of {counts['raw_num_files']} files"


@stage("collect.filter_finalize")
def collect_filter_finalize(spark, o):
    """CLI-5, SET-2, AGG-3: joins the shares of all tasks and their counts; a second call changes nothing."""
    folder = _dataset(o)
    if (folder / "dataset.json").exists():
        return "already joined"
    parts = [catalog.read_manifest(folder, p.name) for p in sorted(folder.glob("dataset.*.shard.json"))]
    if not parts or len({p["num_tasks"] for p in parts}) > 1:
        raise SystemExit("there are no shares, or they were filtered for different numbers of tasks")
    missing = sorted(set(range(parts[0]["num_tasks"])) - {p["task_id"] for p in parts})
    if missing:
        raise SystemExit(f"the shares of tasks {missing} are missing")
    names = [jsonl.shard_name("dataset.shard", p["task_id"], p["num_tasks"]) for p in parts]
    whole = joins.all_of([_read(spark, folder, n, schemas.KEPT) for n in names])
    jsonl.write_records(whole, str(folder / "dataset"))
    counts = {k: sum(p["counts"][k] for p in parts) for k in parts[0]["counts"] if not k.endswith("repos")}
    counts["num_repos"] = len({n for p in parts for n in p["repo_names"]})
    catalog.write_manifest(folder, "dataset.json", **_stamp(capacity=parts[0]["capacity"], counts=counts))
    return f"joined {len(parts)} shares"


@stage("collect.filter_context_overflow", _arg("--capacity", type=positive, required=True))
def collect_filter_context_overflow(spark, o):
    """CLI-6, AGG-4: drops prompts over a limit from a dataset that was filtered without one; refuses to do it twice."""
    folder = _dataset(o)
    manifest = catalog.read_manifest(folder, "dataset.json")
    if "context_limit" in manifest:
        raise SystemExit(f"{folder.name} is already filtered for a limit of {manifest['context_limit']}")
    data = _read(spark, folder, "dataset", schemas.KEPT)
    counts = _row(pipelines.drop_overflows(data, o.capacity)[1])
    jsonl.rewrite(spark, str(folder / "dataset"), schemas.KEPT, lambda d: pipelines.drop_overflows(d, o.capacity)[0])
    catalog.write_manifest(folder, "dataset.json", **{**manifest, "counts": {**manifest["counts"], **counts}, "context_limit": o.capacity})
    return f"kept {counts['num_target_comments']} comments in {counts['num_files']} files"


# ---- generate


@stage("generate.prepare", _arg("--max-generate", type=positive), _arg("--num-partitions", type=positive, default=1), _arg("--profile"))
def generate_prepare(spark, o):
    """CLI-7: freezes models and settings of a run; a run that exists has to have the same."""
    _, run = _run(o, make=True)
    settings = {"model_names": list(models.profile(o.profile).models), "num_partitions": o.num_partitions, "max_generate": o.max_generate}
    if (run / "run.json").exists():
        catalog.require_same(catalog.read_manifest(run, "run.json"), **settings)
    else:
        catalog.write_manifest(run, "run.json", **_stamp(**settings))
    return f"{run.name}: {o.num_partitions * len(settings['model_names'])} tasks"


@stage("generate.generate", _arg("--profile"), _arg("--retry-failed", action="store_true"))
def generate_generate(spark, o):
    """CLI-8, STM-1, STM-2, ORD-5: answers for what the ledger lacks; the ledger is written behind the answers."""
    folder, run = _run(o)
    manifest = catalog.read_manifest(run, "run.json")
    held = models.profile(o.profile)
    catalog.require_same(manifest, model_names=list(held.models))
    data = _read(spark, folder, "dataset", schemas.KEPT)
    if manifest["max_generate"]:
        data = data.orderBy("file_id").limit(manifest["max_generate"])
    ledger = jsonl.read_lines(spark, str(run / "progress"), schemas.PROGRESS) if jsonl.exists(spark, str(run / "progress")) else None
    if ledger is not None and o.retry_failed:
        ledger = ledger.groupBy(*rec.RECORD_KEY, "model").agg(F.min(F.coalesce("error", F.lit(""))).alias("error")).where("error = ''")
    flat = pipelines.generate(data, held.models, held.client, ledger)
    staged = f"{run}/staged"
    flat.write.mode("overwrite").parquet(staged)
    flat = spark.read.parquet(staged)
    jsonl.write_records(flat, str(run / "answers"), append=True)
    done = flat.groupBy(*rec.RECORD_KEY, "model").agg(F.max("error").alias("error"))
    jsonl.write_records(done, str(run / "progress"), append=True)
    return f"{flat.count()} answers"


@stage("generate.finalize")
def generate_finalize(spark, o):
    """CLI-9, AGG-5, AGG-6: the last answer of each model regrouped under its comment."""
    _, run = _run(o)
    kept = "file_id long, repo_name string, new_path string, commit_hash string, model string, pos int, type string, start_line int, end_line int, status string, anchor string, comment string, prompt_code string, prompt string, raw_response string, comment_text string, error string"
    flat = _read(spark, run, "answers", kept)
    key = ["file_id", "pos", "model"]
    last = joins.latest(flat.withColumn("ok", F.col("error").isNull()).withColumn("k", F.concat_ws("\0", *key)), "k", "ok", "comment_text").drop("k", "ok")
    order = F.row_number().over(agg.Window.partitionBy("file_id").orderBy("pos", "model")) - 1
    whole = last.withColumn("result_id", F.xxhash64(*key)).withColumn("pos", order)
    fields = ["type", "start_line", "end_line", "status", "anchor", "comment", "prompt_code", "prompt"]
    grouped = joins.regroup(whole, ["file_id", *rec.RECORD_KEY], fields, ["result_id", "model", "raw_response", "comment_text", "error"])
    jsonl.write_records(grouped, str(run / "generated"))
    counts = _row(_read(spark, run, "progress", schemas.PROGRESS).agg(F.count_if(F.coalesce("error", F.lit("")) == "").alias("completed"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed")))
    catalog.write_manifest(run, "generated.json", **_stamp(**counts))
    return str(counts)


def _generated(spark, run: Path) -> DataFrame:
    return _read(spark, run, "scored" if (run / "scored").exists() else "generated", schemas.GENERATED)


@stage("generate.audit", _arg("--task-ids", action="store_true"), _arg("--skip-failure-reason", action="append", default=[]))
def generate_audit(spark, o):
    """CLI-10, AGG-7, AGG-23, ORD-4, WIN-2: failures by reason, or the tasks that have work left."""
    folder, run = _run(o)
    g = _generated(spark, run)
    if o.task_ids:
        m = catalog.read_manifest(run, "run.json")
        n = jsonl.count_lines(spark, str(folder / "dataset"), m["max_generate"])
        keys = _read(spark, folder, "dataset", schemas.KEPT).orderBy("file_id").limit(n).select("file_id", *rec.RECORD_KEY)
        failed = text.is_failed(F.col("error"), F.col("comment_text"), o.skip_failure_reason)
        r = rec.all_results(g, "error", "comment_text").select("file_id", "model", failed.alias("failed")).groupBy("file_id", "model").agg(F.bool_or("failed").alias("failed"))
        named = spark.createDataFrame(list(enumerate(m["model_names"])), "k int, model string")
        todo = keys.crossJoin(F.broadcast(named)).join(r, ["file_id", "model"], "left").where(F.coalesce("failed", F.lit(True)))  # the models of a manifest
        tasks = todo.select((F.col("k") * m["num_partitions"] + F.pmod("file_id", F.lit(m["num_partitions"]))).alias("t")).distinct()
        spec = agg.array_spec(tasks.withColumn("g", F.lit(0)), ["g"], "t").first()
        return spec.spec if spec else ""
    r = rec.results(g, "error", "comment_text")
    rows = [x.asDict() for x in agg.failure_tally(r).collect()]
    return reports.failure_report(run.name, rows, rows[0]["completions"] if rows else r.count())


@stage("generate.cost", _arg("--tokenizer", default=tokens.DEFAULT), _arg("--input-price-per-million", type=float), _arg("--output-price-per-million", type=float))
def generate_cost(spark, o):
    """CLI-11, AGG-8, AGG-9."""
    _, run = _run(o)
    counter = tokens.vocabulary(o.tokenizer)
    rows = [r.asDict() for r in agg.token_stats(_generated(spark, run), lambda c: tokens.token_counts(c, counter)).collect()]
    whole = next(r for r in rows if r["model"] is None)
    out = reports.token_report(run.name, whole, [{"model": r["model"], "average_tokens": r["average_output_tokens"], "total_tokens": r["output_tokens"]} for r in rows if r["model"] is not None])
    if o.input_price_per_million is not None and o.output_price_per_million is not None:
        cost = _row(agg.project_cost(spark.createDataFrame([whole], "model string, n_outputs long, n_failed long, output_tokens long, average_output_tokens double, n_prompts long, prompt_tokens long, average_prompt_tokens double"), o.input_price_per_million, o.output_price_per_million))
        out += "\n" + reports.report("Cost", [{k: f"{v:.2f}" for k, v in cost.items()}])
    return out


@stage("generate.context_audit", _arg("--window", action="append", required=True, help="NAME=TOKENS"), _arg("--reserve-tokens", type=int, default=pipelines.RESERVE), _arg("--worst-prompts", type=int, default=5))
def generate_context_audit(spark, o):
    """CLI-12, AGG-10, AGG-11, ORD-3, PRJ-6: prompts over each window's limit, written and reported."""
    folder = _dataset(o)
    windows = spark.createDataFrame([(n, int(c) - o.reserve_tokens) for n, _, c in (w.partition("=") for w in o.window)], "window_name string, capacity int")
    data = _read(spark, folder, "dataset", schemas.KEPT)
    c = data.select("repo_name", "new_path", "commit_hash", F.explode("target_comments").alias("c")).where("c.prompt IS NOT NULL")
    rows = c.select("repo_name", "new_path", "commit_hash", "c.type", "c.start_line", "c.end_line", tokens.token_counts(F.col("c.prompt")).alias("prompt_tokens"))
    over = rows.crossJoin(F.broadcast(windows)).where("prompt_tokens > capacity").withColumn("overflow_tokens", F.col("prompt_tokens") - F.col("capacity"))  # a few windows, from the arguments
    jsonl.write_records(over.withColumnRenamed("window_name", "model").drop("capacity"), str(folder / "overflows"))
    tally = [r.asDict() for r in agg.overflow_tally(rows.withColumnRenamed("prompt_tokens", "n_tokens"), windows).orderBy("window_name").collect()]
    any_ = over.select(*rec.RECORD_KEY, *rec.COMMENT_KEY).distinct().count()
    worst: dict[str, list] = {}
    for r in agg.top_k(over, "window_name", o.worst_prompts, F.desc("prompt_tokens"), F.col("new_path"), F.col("start_line")).orderBy("window_name", F.desc("prompt_tokens")).collect():
        worst.setdefault(r.window_name, []).append(r.asDict())
    return reports.context_report(folder.name, tally, any_, worst)


@stage("generate.prune")
def generate_prune(spark, o):
    """CLI-13, JOIN-3: a run without the records and comments that its dataset no longer has."""
    folder, run = _run(o)
    data = _read(spark, folder, "dataset", schemas.KEPT)
    before = _row(_read(spark, run, "generated", schemas.GENERATED).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("comment_generations")), F.lit(0)).alias("c")))
    jsonl.rewrite(spark, str(run / "generated"), schemas.GENERATED, lambda g: joins.prune(g, data))
    after = _row(_read(spark, run, "generated", schemas.GENERATED).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("comment_generations")), F.lit(0)).alias("c")))
    return f"dropped {before['n'] - after['n']} records and {before['c'] - after['c']} comments"


# ---- score and analyse


@stage("eval.prepare", _arg("--num-tasks", type=positive, default=1))
def eval_prepare(spark, o):
    """CLI-14."""
    _, run = _run(o)
    catalog.write_manifest(run, "eval.json", **_stamp(num_tasks=o.num_tasks))
    return f"{o.num_tasks} tasks"


def _flat(generated: DataFrame) -> DataFrame:
    g = generated.select("file_id", *rec.RECORD_KEY, F.posexplode("comment_generations").alias("i", "c")).select("*", F.posexplode("c.results").alias("j", "r"))
    fields = [F.col(f"c.{n}").alias(n) for n in ("type", "status", "start_line", "end_line", "anchor", "comment", "prompt_code", "prompt")]
    return g.select("file_id", *rec.RECORD_KEY, *fields, (F.col("i") * 1000 + F.col("j")).alias("pos"), *(F.col(f"r.{n}").alias(n) for n in ("result_id", "model", "raw_response", "comment_text", "error", "scores")))


@stage("eval.eval", _arg("--force", action="store_true"))
def eval_eval(spark, o):
    """CLI-15, TXT-5: scores every result; those of an earlier pass stay where the text is the same."""
    _, run = _run(o)
    rows = _flat(_read(spark, run, "generated", schemas.GENERATED)).drop("scores")
    old = None if o.force or not (run / "scored").exists() else _flat(_read(spark, run, "scored", schemas.GENERATED))
    got = pipelines.score(rows, previous=old, keys=SCORE_KEYS)
    fields = ["type", "status", "start_line", "end_line", "anchor", "comment", "prompt_code", "prompt"]
    grouped = joins.regroup(got, ["file_id", *rec.RECORD_KEY], fields, ["result_id", "model", "raw_response", "comment_text", "error", "scores"])
    jsonl.write_records(grouped, str(run / "scored.new"))
    store, fresh = jsonl._store(spark, str(run / "scored.new"))
    store.delete(jsonl._store(spark, str(run / "scored"))[1], True)
    store.rename(fresh, jsonl._store(spark, str(run / "scored"))[1])
    return "scored"


@stage("eval.finalize")
def eval_finalize(spark, o):
    """CLI-16, AGG-12: count, mean and median of each metric per model, models in order."""
    _, run = _run(o)
    long = rec.unpivot_scores(rec.results(_read(spark, run, "scored", schemas.GENERATED), "scores"), "model")
    rows = [r.asDict() for r in agg.metric_summary(long).collect()]
    jsonl.write_result(rows, str(run / "metrics.json"))
    return reports.report("Scores", rows)


def _measured(spark, run: Path) -> DataFrame:
    g = _read(spark, run, "scored", schemas.GENERATED)
    flat = _flat(g).withColumn("m", code.complexity("prompt_code"))
    return flat.select("result_id", rec.model_name(F.col("model")).alias("model"), "scores", "m")


@stage("analyze.analyze")
def analyze_analyze(spark, o):
    """CLI-17, CODE-10: the metrics of each comment's prompt code."""
    _, run = _run(o)
    g = _read(spark, run, "scored", schemas.GENERATED)
    c = g.select("file_id", F.posexplode("comment_generations").alias("pos", "c")).select("file_id", "pos", code.complexity("c.prompt_code").alias("m"))
    jsonl.write_records(c.select("file_id", "pos", "m.*"), str(run / "complexity"))
    return "measured"


@stage("analyze.correlation")
def analyze_correlation(spark, o):
    """CLI-17, AGG-14, JSON-1."""
    _, run = _run(o)
    long = rec.unpivot_scores(_measured(spark, run).select("model", "scores", "m.*"), "model", *code.METRICS).withColumnRenamed("metric", "score_metric")
    got = agg.correlation_grid(long, ["model", "score_metric"], "score", code.METRICS).withColumnRenamed("y", "complexity_metric")
    rows = [r.asDict() for r in got.orderBy("model", "score_metric", "complexity_metric").collect()]
    jsonl.write_result(rows, str(run / "correlations.json"))
    return f"{len(rows)} correlations"


EXAMPLES = {
    "straight line": "def f(a):\n    b = a + 1\n    return b\n", "flat chain": "def f(a):\n    if a == 1:\n        return 1\n    elif a == 2:\n        return 2\n    else:\n        return 3\n", "nested": "def f(a):\n    if a:\n        if a > 1:\n            if a > 2:\n                return 3\n",
    "boolean runs": "def f(a, b, c):\n    return a and b and c or a\n", "loops with else": "def f(x):\n    for a in x:\n        while a:\n            a -= 1\n        else:\n            break\n", "methods": "class A:\n    def f(self):\n        return 1\n\n    def g(self):\n        return self.f()\n",
    "closure": "def f():\n    def g(a):\n        if a:\n            return 1\n    return g\n", "comprehensions": "def f(x):\n    return [a for a in x if a if a > 1]\n", "errors": "def f():\n    try:\n        g()\n    except ValueError:\n        pass\n    else:\n        h()\n    finally:\n        k()\n",
    "recursion": "def f(n):\n    return 1 if n < 2 else n * f(n - 1)\n", "match": "def f(x):\n    match x:\n        case 1:\n            return 1\n        case _:\n            return 0\n", "async": "async def f(x):\n    async for a in x:\n        await a\n", "module": "x = 1\nif x:\n    y = 2\n",
    "long and flat": "def f():\n" + "    g()\n" * 30, "tangled": "def f(a, b):\n    for x in a:\n        if x and b or not b:\n            try:\n                while x:\n                    x -= 1\n            except ValueError:\n                continue\n",
}


@stage("analyze.complexity")
def analyze_complexity(spark, o):
    """CLI-17, CODE-3, CODE-4: the metrics of fifteen situations."""
    return reports.report("Complexity", [{"example": k, **dict(zip(code.METRICS, code.code_metrics(v), strict=True))} for k, v in EXAMPLES.items()])


# ---- sample, show


@stage("sample.sample", _arg("--n", type=positive, required=True), _arg("--metric", choices=rec.SCORES, default="bertscore_f1"), _arg("--fraction", type=fraction, default=0.2), _arg("--seed", type=int, default=0))
def sample_sample(spark, o):
    """CLI-18, AGG-17, AGG-18: a sample below each model's cut-off, with its manifest."""
    _, run = _run(o)
    g = _read(spark, run, "scored", schemas.GENERATED)
    items = [r.asDict(recursive=True) for r in pipelines.sample_items(g, o.metric, o.fraction, o.n, o.seed, strict=True).drop("result_id").collect()]  # at most n and one a model
    folder = catalog.create(run / "samples")
    jsonl.write_result(items, str(folder / "items.json"))
    per = {}
    for i in items:
        per[i["repo_name"]] = per.get(i["repo_name"], 0) + 1
    catalog.write_manifest(folder, "sample.json", **_stamp(metric=o.metric, fraction=o.fraction, seed=o.seed, total=len(items), items_per_repo=dict(sorted(per.items(), key=lambda x: -x[1]))))
    return f"{folder.name}: {len(items)} items"


@stage("sample.annotate", _arg("--sample"), _arg("--port", type=int, default=8765))
def sample_annotate(spark, o):
    """CLI-19, SRC-25."""
    import json

    _, run = _run(o)
    folder = catalog.resolve(run / "samples", o.sample)
    server = annotate.service(json.loads((folder / "items.json").read_text(encoding="utf-8")), folder / "annotations.jsonl", o.port)
    print(f"http://127.0.0.1:{server.server_port}/", flush=True)
    server.serve_forever()


@stage("visualize.histogram")
def visualize_histogram(spark, o):
    """CLI-20, VIZ-1: the table of the plot; nothing is drawn."""
    _, run = _run(o)
    long = rec.unpivot_scores(rec.results(_read(spark, run, "scored", schemas.GENERATED), "scores"), "model")
    jsonl.write_records(agg.density_histogram(long).orderBy("metric", "model", "bin"), str(run / "histogram"))
    return "histogram"


@stage("visualize.scatter")
def visualize_scatter(spark, o):
    """CLI-20, VIZ-2, PRJ-9."""
    _, run = _run(o)
    flat = _measured(spark, run).select("model", "m.cognitive_complexity", "m.cyclomatic_complexity", *(F.col(f"scores.{m}").alias(m) for m in rec.SCORES))
    jsonl.write_records(flat.dropna(subset=["cognitive_complexity", "cyclomatic_complexity", *rec.SCORES]).orderBy("model"), str(run / "scatter"))
    return "scatter"


@stage("visualize.matrix")
def visualize_matrix(spark, o):
    """CLI-20, VIZ-3, SRC-29, JOIN-9: each model's matrix as text."""
    _, run = _run(o)
    got = {(r.model, r.score_metric, r.complexity_metric): r for r in jsonl.read_correlations(spark, str(run / "correlations.json")).select("*", text.star_cell(F.col("pearson_r"), F.col("pearson_p_value")).alias("cell")).collect()}
    out = []
    for model in sorted({k[0] for k in got}):
        rows = [{"score": s, **{c: got[model, s, c].cell if (model, s, c) in got else "—" for c in code.METRICS}} for s in rec.SCORES]
        out.append(reports.report(model, rows))
    return "\n\n".join(out)


@stage("visualize.jsonl_to_md", _arg("--file", required=True), _arg("--limit", type=positive))
def visualize_jsonl_to_md(spark, o):
    """CLI-21, STR-8, SRC-27: a file of records as Markdown beside it."""
    records = []
    cut = False
    for record in jsonl.iter_lines(o.file):
        if o.limit and len(records) == o.limit:
            cut = True
            break
        records.append(record)
    target = Path(o.file).with_suffix(".md")
    target.write_text(reports.page(Path(o.file).name, records, cut), encoding="utf-8")
    return str(target)


CHAINS = {
    "collect": ("collect.prepare", "collect.collect", "collect.finalize", "collect.filter"),
    "generate": ("generate.prepare", "generate.generate", "generate.finalize"),
    "eval": ("eval.prepare", "eval.eval", "eval.finalize"),
}


@stage("submit", _arg("chain", choices=sorted(CHAINS)), _arg("--set", action="append", default=[], help="STAGE:--flag=value"))
def submit(spark, o):
    """CLI-22: the stages of a chain one after another; a stage that fails ends it."""
    out = []
    for name in CHAINS[o.chain]:
        own = [x.partition(":")[2] for x in o.set if x.partition(":")[0] == name]
        given = [f"--root={o.root}"] + [f"--{k}={v}" for k, v in (("dataset", o.dataset), ("run", o.run)) if v]
        out.append(f"{name}: {main([name, *given, *own], spark)}")
    return "\n".join(out)


def main(argv: Sequence[str], spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="marginalia.plans.stages", description=__doc__.split("\n", 1)[0])
    sub = parser.add_subparsers(dest="stage", required=True)
    for name, (fn, arguments) in _STAGES.items():
        p = sub.add_parser(name, help=fn.__doc__.split("\n", 1)[0])
        p.add_argument("--root", required=True)
        p.add_argument("--dataset")
        p.add_argument("--run")
        for names, how in arguments:
            p.add_argument(*names, **how)
    o = parser.parse_args(argv)
    if spark is None:
        from marginalia.plans.session import get_spark

        spark = get_spark(o.stage)
    return _STAGES[o.stage][0](spark, o)


if __name__ == "__main__":
    print(main(sys.argv[1:]))
