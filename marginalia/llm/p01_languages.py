"""Problem 1: natural language hidden inside code.

Comments and string literals are taken out of each file; each is cut into runs of one language by dynamic
programming over per-word scores with a switching penalty (``langid``), and the runs' bytes are summed by file.  The
scores are learned from a bounded sample of the labelled documents.

Defined cases: null ids or texts give no rows; a null or unknown path is read by what the text looks like; an
empty text has no passages; rows delivered twice count once; other columns are ignored whatever their names.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lexing
from .common import flat_map, sources, table


def foreign_languages(text: str, model: langid.Model) -> list[str]:
    """The languages other than English in which ``text`` holds prose, in order of appearance; unknown ones have no name."""
    return list(dict.fromkeys(r.lang for r in model.segments(text) if r.lang not in ("en", langid.OTHER) and langid.is_prose(r)))


def _found(file_id, path, text, model):
    for p in lexing.passages(text, lexing.language_of(path, text)):
        for lang in foreign_languages(p.text, model):
            yield file_id, p.line, lang


def _with(model: langid.Model, df: DataFrame, fn):
    """``fn`` with the model, which is bounded by the sample it was learned from, sent to each worker once."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return lambda *row: fn(*row, shared.value)


def foreign_passages(dataset: DataFrame, model: langid.Model) -> DataFrame:
    """(file_id, start_line, lang): each passage with prose in a language other than English."""
    return flat_map(sources(dataset), _with(model, dataset, _found), "file_id long, start_line int, lang string").distinct()


def language_bytes(text: str, model: langid.Model, path: str | None = None) -> dict[str, int]:
    """UTF-8 bytes of the prose in each language, over all passages of a file."""
    total: dict[str, int] = {}
    for p in lexing.passages(text, lexing.language_of(path, text)):
        words = unicodedata.normalize("NFC", p.text)
        for r in model.segments(words):
            if langid.is_prose(r) or r.lang == langid.OTHER:
                total[r.lang] = total.get(r.lang, 0) + len(words[r.start : r.end].encode())
    return total


def _shares(file_id, path, text, model):
    counted = language_bytes(text, model, path)
    whole = sum(counted.values())
    for lang, n in sorted(counted.items()):
        yield file_id, lang, n, round(n / whole, 6)


def language_shares(dataset: DataFrame, model: langid.Model) -> DataFrame:
    """(file_id, lang, n_bytes, share): the share each language has in a file's prose; shares add up to 1.

    Words of a language that the model doesn't know are ``other``.
    """
    return flat_map(sources(dataset), _with(model, dataset, _shares), "file_id long, lang string, n_bytes long, share double").distinct()


def _comment(file_id, start_line, comment, model):
    for lang in foreign_languages(comment, model):
        yield file_id, start_line, lang


def foreign_target_comments(dataset: DataFrame, model: langid.Model) -> DataFrame:
    """(file_id, start_line, lang) of each target comment with prose in a language other than English."""
    rows = dataset.select("file_id", F.explode("target_comments").alias("c")).select("file_id", "c.start_line", "c.comment")
    rows = rows.where(F.col("comment").isNotNull() & F.col("file_id").isNotNull())
    return flat_map(rows, _with(model, dataset, _comment), "file_id long, start_line int, lang string").distinct()


def fitted(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "language_codes"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_passages(table(spark, sf_dir, "dataset"), fitted(spark, sf_dir))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_shares(table(spark, sf_dir, "dataset"), fitted(spark, sf_dir))


def p1_target_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return foreign_target_comments(table(spark, sf_dir, "dataset"), fitted(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_shares": p1_shares, "p1_target_comments": p1_target_comments}
