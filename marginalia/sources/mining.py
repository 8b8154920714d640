"""Commits as a source of files (SRC-19, SRC-20, PRJ-1): a miner per repository, with retries and a ledger.

A miner is a function of a repository, a first and a last day that yields records of ``schemas.RAW``.  ``git_miner``
reads local clones with git's own commands; others, such as ones that clone over a network, are injected.
"""

from __future__ import annotations

import re
import subprocess
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jsonl, schemas

ATTEMPTS, PAUSE = 3, 3.0
Miner = Callable[[dict, str, str], Iterator[dict]]
_KINDS = {"A": "ADD", "M": "MODIFY", "D": "DELETE", "R": "RENAME", "C": "COPY"}
_HUNK = re.compile(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@")


def parse_diff(diff: str) -> dict:
    """Lines that a unified diff adds and deletes, with their numbers."""
    added, deleted = [], []
    old = new = 0
    for line in diff.split("\n"):
        m = _HUNK.match(line)
        if m:
            old, new = int(m.group(1)), int(m.group(2))
        elif line.startswith("+") and new:
            added.append({"line": new, "text": line[1:]})
            new += 1
        elif line.startswith("-") and old:
            deleted.append({"line": old, "text": line[1:]})
            old += 1
        elif line.startswith(" "):
            old, new = old + 1, new + 1
    return {"added": added, "deleted": deleted}


def git_miner(folder: str, suffix: str = ".py") -> Miner:
    """Mines the clone ``folder/full_name``: commits of its default branch in the range of days, merges aside.

    The range goes from midnight to midnight, so the last day itself is left out (DATE-2).
    """

    def mine(repo: dict, since: str, to: str) -> Iterator[dict]:
        clone = Path(folder, repo["full_name"])

        def git(*args: str) -> str:
            done = subprocess.run(["git", "-C", str(clone), *args], capture_output=True)
            if done.returncode:
                raise RuntimeError(done.stderr.decode(errors="replace").strip())
            return done.stdout.decode(errors="replace")

        def text_at(commit: str, path: str | None) -> str | None:
            return None if path is None else git("show", f"{commit}:{path}")

        branch = repo.get("default_branch") or "HEAD"
        listed = git("log", "--no-merges", "--reverse", f"--since={since}T00:00:00", f"--until={to}T00:00:00", "--format=%H%x09%cI", branch, "--")
        for row in listed.split("\n"):
            if not row:
                continue
            commit, when = row.split("\t")
            message = git("show", "-s", "--format=%B", commit).rstrip("\n")
            changed = git("diff-tree", "--root", "-r", "-M", "--no-commit-id", "--name-status", "-z", commit).split("\0")
            k = 0
            while k < len(changed) and changed[k]:
                kind = changed[k][0]
                old = changed[k + 1]
                new = changed[k + 2] if kind in "RC" else old
                k += 3 if kind in "RC" else 2
                if not (new if kind != "D" else old).endswith(suffix):
                    continue
                before, after = (None if kind == "A" else old), (None if kind == "D" else new)
                diff = git("diff-tree", "--root", "-p", "-M", "--no-commit-id", commit, "--", *dict.fromkeys([old, new]))
                diff = diff[diff.find("@@") :] if "@@" in diff else ""
                parsed = parse_diff(diff)
                yield {
                    "repo_name": repo["full_name"], "commit_hash": commit, "commit_datetime": when, "commit_message": message, "filename": Path(new).name, "new_path": after, "change_type": _KINDS.get(kind, "UNKNOWN"), "diff": diff, "diff_parsed": parsed,
                    "added_lines": len(parsed["added"]), "deleted_lines": len(parsed["deleted"]), "source_code": text_at(commit, after), "previous_source_code": text_at(f"{commit}^", before) if before else None,
                }

    return mine


def mine(repos: DataFrame, miner: Callable[[], Miner], since: str, to: str, attempts: int = ATTEMPTS, pause: float = PAUSE) -> DataFrame:
    """Rows of each repository's files (``file``) and one of the ledger (``repo``, ``error``) behind them.

    A repository whose mining fails each time leaves no files, only its error.
    """
    schema = T.StructType([T.StructField("repo", T.StringType()), T.StructField("error", T.StringType()), T.StructField("file", T._parse_datatype_string(f"struct<{_as_struct(schemas.RAW)}>"))])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        work = miner()
        for batch in batches:
            for repo in batch.to_pylist():
                rows: list[dict] = []
                error = None
                for attempt in range(1, attempts + 1):
                    try:
                        rows = [{"repo": repo["full_name"], "error": None, "file": r} for r in work(repo, since, to)]
                        error = None
                        break
                    except Exception as e:
                        rows, error = [], str(e) or type(e).__name__
                        if attempt < attempts:
                            time.sleep(pause)
                rows.append({"repo": repo["full_name"], "error": error, "file": None})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return repos.mapInArrow(run, schema)


def _as_struct(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (x.split(" ", 1) for x in re.split(r", (?=\w+ )", ddl)))


def mine_and_store(spark: SparkSession, repos: DataFrame, miner: Callable[[], Miner], since: str, to: str, folder: str, **how) -> None:
    """SRC-20: mines what the ledger lacks (JOIN-2) and stores files before their ledger rows.

    Repositories mined with an error count as mined.  A run that ends between both leaves files without a ledger row;
    ``mined_files`` does not show them, and they are mined again.
    """
    held = f"{folder}/mined"
    todo = repos.dropDuplicates(["full_name"])
    if jsonl.exists(spark, held):
        todo = todo.join(spark.read.schema(f"{schemas.MINED}, batch string").json(held).select(F.col("repo").alias("full_name")), "full_name", "left_anti")
    batch = uuid.uuid4().hex
    staged = f"{folder}/staged-{batch}"
    ordered = todo.repartitionByRange("size", "id") if {"size", "id"} <= set(todo.columns) else todo
    mine(ordered, miner, since, to, **how).write.parquet(staged)
    rows = spark.read.parquet(staged)
    jsonl.write_records(rows.where("file IS NOT NULL").select("file.*", F.lit(batch).alias("batch")), f"{folder}/raw", append=True)
    jsonl.write_records(rows.where("file IS NULL").select("repo", "error", F.lit(batch).alias("batch")), held, append=True)
    store, where = jsonl._store(spark, staged)
    store.delete(where, True)


def mined_files(spark: SparkSession, folder: str) -> DataFrame:
    """The stored files of repositories that the ledger holds (JOIN-12)."""
    files = spark.read.schema(f"{schemas.RAW}, batch string").json(f"{folder}/raw")
    ledger = spark.read.schema(f"{schemas.MINED}, batch string").json(f"{folder}/mined").select(F.col("repo").alias("repo_name"), "batch").distinct()
    return files.join(ledger, ["repo_name", "batch"], "left_semi").drop("batch")
