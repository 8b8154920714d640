"""The stages one after another on clones made here, each with its manifest and guards."""

import json
import subprocess
import threading
import urllib.error
import urllib.request

import pytest

from marginalia.plans import stages
from marginalia.sources import annotate, jsonl, mining, models

OLD = "def f(a):\n    return a\n\n\ndef g(b):\n    return b\n"
NEW = "def f(a):\n    # keep the copy open\n    if a:\n        return a\n    return None\n\n\ndef g(b):\n    return b  # the least value\n"


def commit(folder, files, message, when):
    for name, text in files.items():
        path = folder / name
        if text is None:
            path.unlink()
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    env = {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "n", "GIT_AUTHOR_EMAIL": "e@x", "GIT_COMMITTER_NAME": "n", "GIT_COMMITTER_EMAIL": "e@x", "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(folder)}
    subprocess.run(["git", "-C", str(folder), "add", "-A"], check=True, env=env)
    subprocess.run(["git", "-C", str(folder), "commit", "-qm", message], check=True, env=env)


@pytest.fixture(scope="module")
def clones(tmp_path_factory):
    root = tmp_path_factory.mktemp("clones")
    for name in ("o/a", "o/b"):
        folder = root / name
        folder.mkdir(parents=True)
        subprocess.run(["git", "init", "-qb", "main", str(folder)], check=True)
        commit(folder, {"x.py": OLD, "notes.txt": "n"}, "first", "2024-01-05T10:00:00+00:00")
        commit(folder, {"x.py": NEW, "y.py": "y = 1\n"}, "second change", "2024-02-05T10:00:00+00:00")
        commit(folder, {"y.py": None}, "drop y", "2024-03-05T10:00:00+00:00")
        commit(folder, {"x.py": NEW + "\n# late\nz = 1\n"}, "too late", "2025-06-05T10:00:00+00:00")
    return root


def test_miner(clones):
    rows = list(mining.git_miner(str(clones))({"full_name": "o/a", "default_branch": "main"}, "2024-01-01", "2025-01-01"))
    assert [(r["filename"], r["change_type"], r["commit_message"]) for r in rows] == [("x.py", "ADD", "first"), ("x.py", "MODIFY", "second change"), ("y.py", "ADD", "second change"), ("y.py", "DELETE", "drop y")]
    second = rows[1]
    assert (second["source_code"], second["previous_source_code"]) == (NEW, OLD) and second["diff_parsed"]["added"][0] == {"line": 2, "text": "    # keep the copy open"}
    assert second["added_lines"] == len(second["diff_parsed"]["added"]) == 5 and second["deleted_lines"] == 2 and rows[3]["source_code"] is None and rows[0]["previous_source_code"] is None


def test_mining_ledger_and_retries(spark, clones, tmp_path):
    repos = spark.createDataFrame([(1, "o/a", "main", 5), (2, "o/none", "main", 1)], "id long, full_name string, default_branch string, size long")
    for _ in range(2):  # what is mined, with or without an error, is not mined again
        mining.mine_and_store(spark, repos, lambda: mining.git_miner(str(clones)), "2024-01-01", "2025-01-01", str(tmp_path), pause=0.0)
    ledger = {r.repo: r.error for r in spark.read.schema("repo string, error string").json(str(tmp_path / "mined")).collect()}
    assert ledger["o/a"] is None and ledger["o/none"] and len(ledger) == 2
    assert mining.mined_files(spark, str(tmp_path)).count() == 4
    (tmp_path / "raw" / "left.json").write_text(json.dumps({"repo_name": "o/c", "batch": "x"}) + "\n")
    assert mining.mined_files(spark, str(tmp_path)).count() == 4


@pytest.fixture(scope="module")
def chain(spark, clones, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    folder = root / "2024-05-01T00-00-00"
    folder.mkdir()
    repos = [{"id": k, "full_name": n, "html_url": "", "default_branch": "main", "size": 10 - k, "stargazers_count": k} for k, n in enumerate(("o/a", "o/b"))]
    (folder / "repos.jsonl").write_text("".join(json.dumps(r) + "\n" for r in repos))

    def client():
        return lambda model, prompt: "```python\n# keep the copy\n```" if model == "m1" else ("# the least value" if "return None" not in prompt else "")

    models.register("test", ("m1", "m2"), client)

    def run(stage, *more):
        return stages.main([stage, "--root", str(root), *more], spark)

    done = {"run": run, "root": root, "folder": folder}
    done["prepare"] = run("collect.prepare")
    run("collect.collect", "--clones", str(clones), "--since", "2024-01-01", "--to", "2025-01-01")
    done["raw"] = run("collect.finalize")
    for k in (0, 1):
        run("collect.filter", "--task-id", str(k), "--num-tasks", "2", "--marker", "written by a bot")
    done["joined"] = run("collect.filter_finalize")
    done["tasks"] = run("generate.prepare", "--profile", "test", "--num-partitions", "2")
    done["answers"] = run("generate.generate", "--profile", "test")
    done["again"] = run("generate.generate", "--profile", "test")
    done["counts"] = run("generate.finalize")
    return done


def test_collect_and_filter(chain):
    assert chain["prepare"] == "2 repositories, 2 tasks" and chain["raw"] == "8 files"
    m = json.loads((chain["folder"] / "dataset.json").read_text())
    c = m["counts"]
    assert (c["raw_num_files"], c["num_files"], c["n_wrong_metadata"], c["num_target_comments"], c["num_repos"]) == (8, 2, 6, 4, 2)
    assert chain["run"]("collect.filter_finalize") == "already joined"
    with pytest.raises(SystemExit):
        chain["run"]("collect.filter", "--task-id", "0", "--num-tasks", "2")
    with pytest.raises(SystemExit):
        chain["run"]("collect.filter", "--task-id", "2")


def test_missing_share_stops(spark, chain, tmp_path):
    folder = tmp_path / "2024-05-02T00-00-00"
    folder.mkdir()
    (folder / "dataset.0.shard.json").write_text(json.dumps({"task_id": 0, "num_tasks": 2, "counts": {}, "repo_names": []}))
    with pytest.raises(SystemExit, match="1"):
        stages.main(["collect.filter_finalize", "--root", str(tmp_path)], spark)


def test_generate_once_and_resume_guard(spark, chain):
    assert chain["answers"] == "8 answers" and chain["again"] == "0 answers"
    with pytest.raises(ValueError):
        chain["run"]("generate.prepare", "--profile", "test", "--num-partitions", "3")
    assert "0 failed" in chain["run"]("generate.cost") or "failed generations" in chain["run"]("generate.cost")
    assert "$" not in chain["run"]("generate.cost", "--input-price-per-million", "2", "--output-price-per-million", "10")
    run = next((chain["folder"] / "runs").iterdir())
    rows = jsonl.read_lines(spark, str(run / "generated"), "file_id long, comment_generations array<struct<results:array<struct<model:string,comment_text:string,error:string>>>>").collect()
    assert len(rows) == 2 and all([x.model for x in c.results] == ["m1", "m2"] for r in rows for c in r.comment_generations)


def test_audit_and_context(chain):
    report = chain["run"]("generate.audit")
    assert "Model returned an empty comment" in report and "of 8 completions failed" in report
    assert chain["run"]("generate.audit", "--task-ids")
    text = chain["run"]("generate.context_audit", "--window", "tiny=530", "--window", "large=9000")
    assert "tiny" in text and "exceed the limit" in text and "Longest prompts for tiny" in text
    assert chain["run"]("generate.prune") == "dropped 0 records and 0 comments"


def test_score_analyse_sample_show(chain, monkeypatch):
    run = chain["run"]
    run("eval.prepare", "--num-tasks", "2")
    run("eval.eval")
    run("eval.eval")  # takes the scores over
    assert "mean_score" in run("eval.finalize")
    run("analyze.analyze")
    n = int(run("analyze.correlation").split()[0])
    assert n > 0 and "cyclomatic_complexity" in run("analyze.complexity")
    assert "m1" in run("visualize.matrix")
    for name in ("histogram", "scatter"):
        run(f"visualize.{name}")
    with pytest.raises(ValueError, match="too few candidates"):
        run("sample.sample", "--n", "1000", "--metric", "rougeL")
    assert "items" in run("sample.sample", "--n", "2", "--metric", "rougeL", "--fraction", "1.0")
    with pytest.raises(SystemExit):
        run("sample.sample", "--n", "2", "--fraction", "0")


def test_late_overflow_filter(chain, tmp_path, spark):
    import shutil

    root = tmp_path / "r"
    shutil.copytree(chain["root"], root)
    got = stages.main(["collect.filter_context_overflow", "--root", str(root), "--capacity", "600"], spark)
    assert got.startswith("kept")
    with pytest.raises(SystemExit):
        stages.main(["collect.filter_context_overflow", "--root", str(root), "--capacity", "600"], spark)


def test_markdown_stage(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"a": 1, "b": "x|y"}\n{"a": {"k": "def f():\\n  pass"}, "l": ["x", "a/b"], "e": "", "n": null}\n{"a": 3}\n')
    stages.main(["visualize.jsonl_to_md", "--root", str(tmp_path), "--file", str(f), "--limit", "2"], spark)
    text = (tmp_path / "a.md").read_text()
    assert text.startswith("# a.jsonl\n\nShowing the first 2 records of the file.\n\n---\n\n## Record 1\n\n| Key | Value |\n| --- | --- |\n| a | 1 |\n| b | x\\|y |\n\n")
    assert "```\ndef f():\n  pass\n```" in text and "- x\n- `a/b`" in text and '### e\n\n""' in text and "### n\n\nnull" in text


def test_profiles_and_local_pipeline(monkeypatch):
    monkeypatch.setenv(models.VARIABLE, "nothing")
    with pytest.raises(ValueError):
        models.profile()
    monkeypatch.delenv(models.VARIABLE)
    assert models.profile().models == ("offline",)
    loaded = []
    ask = models.local(lambda m: loaded.append(m) or (lambda p, n: p.upper()), {"m": 520}, lambda: lambda texts: [len(t) for t in texts])()
    assert ask("m", "abc") == ask("m", "abc") == "ABC" and loaded == ["m"]
    with pytest.raises(ValueError, match="exceeds"):
        ask("m", "x" * 9)


def test_annotation_service(tmp_path):
    log = tmp_path / "log.jsonl"
    server = annotate.service([{"id": "a1"}], log)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(body):
        return json.loads(urllib.request.urlopen(urllib.request.Request(f"{base}/api/annotations", data=json.dumps(body).encode(), method="POST")).read())

    assert post({"id": "a1", "tags": [" Foo  Bar ", "foo bar", ""], "done": True})["tags"] == ["foo-bar"]
    post({"id": "a1", "notes": "later"})
    for bad in ({"id": "zz"}, {"id": "a1", "tags": "x"}, {"id": "a1", "done": 1}, [], None):
        with pytest.raises(urllib.error.HTTPError):
            post(bad)
    seen = json.loads(urllib.request.urlopen(f"{base}/api/items").read())
    assert seen["annotations"]["a1"]["notes"] == "later" and len(log.read_text().splitlines()) == 2
    assert b"<title>" in urllib.request.urlopen(base + "/").read()
    server.shutdown()
