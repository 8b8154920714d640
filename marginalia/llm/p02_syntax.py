"""Problem 2: source files that do not parse.

Each file's tokens drive a memoised derivative parser (``derivative``, ``grammars``, ``syntax``).  The Python,
JSON and TOML grammars accept no more than their languages do, so every invalid file is rejected; a rejected one
is confirmed by the language's own parser.  For JavaScript the derivative parse alone decides.

Defined cases: null ids, texts or paths and extensions without a grammar give no rows; an empty .py, .js or
.toml file is valid, an empty .json is not; rows delivered twice count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import syntax
from .common import flat_map, sources, table

EXTENSIONS = tuple(syntax.PARSERS)


def _judge(file_id, repo_name, path, text):
    ext = path.rpartition(".")[2].lower()
    verdict = syntax.check(ext, text)
    if verdict is not None:
        yield file_id, repo_name, ext, verdict.valid, verdict.truncated, verdict.fail_line, verdict.fail_token


def _invalid(file_id, path, text):
    verdict = syntax.check(path.rpartition(".")[2].lower(), text)
    if verdict is not None and not verdict.valid:
        yield (file_id,)


def _with_path(df: DataFrame) -> DataFrame:
    return df.where(F.col("new_path").rlike(r"(?i)\.(?:" + "|".join(EXTENSIONS) + r")\z"))


def syntax_verdicts(dataset: DataFrame) -> DataFrame:
    """One row per file: valid, truncated, and the line and token at which the derivative became empty."""
    schema = "file_id long, repo_name string, language string, valid boolean, truncated boolean, fail_line int, fail_token string"
    return flat_map(_with_path(sources(dataset, "repo_name")), _judge, schema).dropDuplicates(["file_id"])


def invalid_files(dataset: DataFrame) -> DataFrame:
    """(file_id) of each file that is not valid in the language its extension announces."""
    return flat_map(_with_path(sources(dataset)), _invalid, "file_id long").distinct()


def invalid_rates(dataset: DataFrame) -> DataFrame:
    """(repo_name, language, n_files, n_invalid, n_truncated, invalid_rate)."""
    return (
        syntax_verdicts(dataset)
        .groupBy("repo_name", "language")
        .agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), F.count_if("truncated").alias("n_truncated"))
        .withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_files(table(spark, sf_dir, "dataset"))


def p2_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax_verdicts(table(spark, sf_dir, "dataset"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(table(spark, sf_dir, "dataset"))


QUERIES = {"p2_found": p2_found, "p2_verdicts": p2_verdicts, "p2_rates": p2_rates}
