"""Queries over the survey's operators, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import code, text, tokens, udfs
from marginalia.operators import aggregates as agg
from marginalia.operators import joins
from marginalia.operators import records as rec
from marginalia.plans import pipelines
from marginalia.plans.session import apart, cut, widen

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
MARKERS = ("refactor", "hotfix", "wip")


def query(sql: str | None = None):
    def add(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# SQL fragments shared by the oracles
_FILES = "files AS (SELECT DISTINCT ON (file_id) * FROM dataset)"
_TARGETS = f"{_FILES}, targets AS (SELECT file_id, repo_name, i - 1 AS pos, target_comments[i] AS c FROM (SELECT file_id, repo_name, target_comments, unnest(range(1, len(target_comments) + 1)) AS i FROM files))"
_RESULTS = """comments AS (SELECT file_id, repo_name, new_path, commit_hash, unnest(comment_generations) AS c FROM generated_scored),
results AS (SELECT DISTINCT ON (r.result_id) file_id, c, r.result_id AS result_id, CASE WHEN coalesce(r.model, '') = '' THEN '<unknown>' ELSE r.model END AS model, r
            FROM (SELECT file_id, c, unnest(c.results) AS r FROM comments) WHERE r.result_id IS NOT NULL)"""
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT result_id, model, '{m}' AS metric, r.scores.\"{m}\" AS score FROM results WHERE r.scores.\"{m}\" IS NOT NULL AND NOT isnan(r.scores.\"{m}\")" for m in rec.SCORES) + ")"
_BLANK_SQL = r"[\s\p{Z}\x1c-\x1f\x{85}\x0b\x0c]"
_DIRECTIVE_SQL = rf"""list_bool_or(list_transform(regexp_split_to_array(c.comment, '\r\n|[\n\r\x0b\x0c]'), lambda ln:
  regexp_matches(ln, '^{_BLANK_SQL}*#!') OR regexp_matches(ln, '^{_BLANK_SQL}*#+{_BLANK_SQL}*%%') OR (regexp_matches(ln, '^{_BLANK_SQL}*#') AND regexp_matches(ln, '(?i)coding[:=]\s*[-\w.]+'))
  OR regexp_matches(ln, '(?i)^{_BLANK_SQL}*#+{_BLANK_SQL}*(?:(?:{"|".join(text.DIRECTIVE_WORDS)})(?:[^A-Za-z0-9]|$)|(?:{"|".join(text.DIRECTIVE_PREFIXES)}):)')))"""
_SEPARATOR_SQL = " OR ".join(f"contains(c.comment, '{(ch if ch != chr(39) else chr(39) * 2) * 5}')" for ch in "!\"$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_TARGET_SQL = f"""(c.type IN ('inline', 'block') AND c.status = 'added' AND c.comment IS NOT NULL AND NOT {_DIRECTIVE_SQL}
  AND regexp_matches(c.comment, '\\p{{L}}') AND NOT ({_SEPARATOR_SQL}) AND regexp_matches(c.comment, '^[\\x00-\\x7F]*$') AND NOT regexp_matches(c.comment, '[^\\x00-\\x7F]'))"""

def _plain_sql(x: str) -> str:
    """STR-1 in SQL."""
    strip = lambda y: f"regexp_replace({y}, '^{_BLANK_SQL}+|{_BLANK_SQL}+$', '', 'g')"
    lines = f"list_transform(regexp_split_to_array({x}, '\\r\\n|[\\n\\r\\x0b\\x0c]'), lambda ln: regexp_replace({strip('ln')}, '^#+', ''))"
    return strip(f"regexp_replace(array_to_string({lines}, ' '), '{_BLANK_SQL}+', ' ', 'g')")


_SCORABLE = f"""scorable AS (SELECT * FROM (SELECT result_id, model, {_plain_sql("coalesce(r.comment_text, '')")} AS p, {_plain_sql("coalesce(c.comment, '')")} AS q FROM results WHERE coalesce(r.error, '') = '') WHERE p <> '' AND q <> '')"""


def _tokens_sql(x: str) -> str:
    """The words of TXT-1 in SQL: punctuation apart, except between digits."""
    for a, b in (("<skipped>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{a}', '{b}')"
    x = f"' ' || {x} || ' '"
    for a, b in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return f"list_filter(regexp_split_to_array({x}, '{_BLANK_SQL}+'), lambda w: w <> '')"


def _grams_sql(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string({words}[i : i + {n} - 1], ' '))"


_BLEU_SQL = f"""{_SCORABLE}, words AS (SELECT result_id, model, {_tokens_sql("p")} AS a, {_tokens_sql("q")} AS b FROM scorable),
grams AS ({" UNION ALL ".join(f"SELECT result_id, {n} AS n, 1 AS own, unnest({_grams_sql('a', n)}) AS g FROM words UNION ALL SELECT result_id, {n}, 0, unnest({_grams_sql('b', n)}) FROM words" for n in range(1, 5))}),
counts AS (SELECT result_id, n, g, sum(own) AS x, sum(1 - own) AS y FROM grams GROUP BY ALL),
matches AS (SELECT result_id, n, sum(least(x, y)) AS m, sum(x) AS k FROM counts GROUP BY ALL),
wide AS (SELECT w.result_id, w.model, len(a) AS c, len(b) AS r, {", ".join(f"coalesce(max(m) FILTER (WHERE n = {n}), 0) AS m{n}, coalesce(max(k) FILTER (WHERE n = {n}), 0) AS k{n}" for n in range(1, 5))} FROM words w LEFT JOIN matches USING (result_id) GROUP BY ALL)"""


def _bleu_sql(n: int) -> str:
    """The score of one order from columns m1.., k1.., c and r."""
    none = " OR ".join(f"m{i} = 0 OR k{i} = 0" for i in range(1, n + 1))
    logs = " + ".join(f"ln(m{i}::DOUBLE / k{i})" for i in range(1, n + 1))
    return f"CASE WHEN {none} THEN 0.0 ELSE (CASE WHEN c > r THEN 1.0 ELSE exp(1 - r::DOUBLE / c) END) * exp(({logs}) / {n}) END"


# ---- filters


@query(f"WITH {_FILES} SELECT file_id FROM files WHERE new_path LIKE '%.py' AND change_type = 'MODIFY' AND source_code IS NOT NULL AND previous_source_code IS NOT NULL AND commit_message IS NOT NULL")
def fil1_eligible(spark, sf_dir):
    return _t(spark, sf_dir, "dataset").where(rec.eligible_files()).select("file_id").distinct()


@query(f"WITH {_FILES} SELECT repo_name, count(*) AS n_files FROM files WHERE " + " OR ".join(f"contains(lower(commit_message), '{m}')" for m in MARKERS) + " GROUP BY repo_name")
def fil2_marked_messages(spark, sf_dir):
    files = _t(spark, sf_dir, "dataset").where(text.contains_any("commit_message", MARKERS)).select("file_id", "repo_name").distinct()
    return files.groupBy("repo_name").agg(F.count("*").alias("n_files"))


@query(f"WITH {_TARGETS} SELECT file_id, c.start_line AS start_line, {_DIRECTIVE_SQL} AS directive FROM targets")
def fil3_directives(spark, sf_dir):
    c = rec.target_comments(_t(spark, sf_dir, "dataset"), "start_line", "comment")
    return c.select("file_id", "start_line", text.is_directive("comment").alias("directive"))


@query(f"WITH {_TARGETS} SELECT count(*) FILTER (WHERE regexp_matches(c.comment, '\\p{{L}}')) AS n_letters, count(*) FILTER (WHERE {_SEPARATOR_SQL}) AS n_separators, count(*) FILTER (WHERE NOT regexp_matches(c.comment, '[^\\x00-\\x7F]')) AS n_ascii, count(*) AS n FROM targets")
def fil5_to_7_shapes(spark, sf_dir):
    c = rec.target_comments(_t(spark, sf_dir, "dataset"), "comment")
    return c.agg(F.count_if(text.has_letter("comment")).alias("n_letters"), F.count_if(text.is_separator("comment")).alias("n_separators"), F.count_if(text.is_ascii("comment")).alias("n_ascii"), F.count("*").alias("n"))


@query(f"WITH {_TARGETS} SELECT file_id, count(*) AS n_targets FROM targets WHERE {_TARGET_SQL} GROUP BY file_id")
def fil8_targets(spark, sf_dir):
    files = rec.once(_t(spark, sf_dir, "dataset"), "file_id", "target_comments")
    return files.select("file_id", F.size(F.filter("target_comments", lambda c: rec.is_target(c))).cast("long").alias("n_targets")).where("n_targets > 0")


@query(f"WITH {_TARGETS} SELECT file_id, pos, bool_and(octet_length(encode(c.prompt)) + 8 <= w.capacity - 512) AS fits_all FROM targets, context_windows w WHERE c.prompt IS NOT NULL AND w.capacity > 512 GROUP BY file_id, pos")
def fil10_fits_every_window(spark, sf_dir):
    c = rec.target_comments(_t(spark, sf_dir, "dataset"), "prompt").where("prompt IS NOT NULL")
    windows = _t(spark, sf_dir, "context_windows").where("capacity > 512")
    return c.crossJoin(F.broadcast(windows)).groupBy("file_id", "pos").agg(F.bool_and(rec.fits(F.col("prompt"), F.col("capacity"))).alias("fits_all"))


@query(f"WITH {_RESULTS} SELECT model, count(*) AS n, count(*) FILTER (WHERE r.error IS NOT NULL OR r.comment_text IS NULL) AS n_failed, count(*) FILTER (WHERE (r.error IS NOT NULL OR r.comment_text IS NULL) AND NOT contains(lower(coalesce(r.error, 'No comment returned and no error recorded')), 'timed out')) AS n_not_skipped FROM results GROUP BY model")
def fil11_failed_completions(spark, sf_dir):
    r = rec.results(_t(spark, sf_dir, "generated_scored"), "error", "comment_text")
    e, t = F.col("error"), F.col("comment_text")
    return r.groupBy("model").agg(F.count("*").alias("n"), F.count_if(text.is_failed(e, t)).alias("n_failed"), F.count_if(text.is_failed(e, t, ["timed out"])).alias("n_not_skipped"))


@query("""SELECT DISTINCT file_id, list_bool_or(list_transform(comment_generations, lambda c: coalesce(len(c.results), 0) = 0
  OR coalesce(list_bool_or(list_transform(c.results, lambda r: r.error IS NOT NULL OR r.comment_text IS NULL)), false))) AS failed FROM generated_scored WHERE len(comment_generations) > 0""")
def fil13_failed_records(spark, sf_dir):
    bad = F.exists("comment_generations", lambda c: (F.coalesce(F.size(c["results"]), F.lit(0)) <= 0) | F.exists(c["results"], lambda r: r["error"].isNotNull() | r["comment_text"].isNull()))
    return _t(spark, sf_dir, "generated_scored").where(F.size("comment_generations") > 0).select("file_id", bad.alias("failed")).distinct()


@query(f"WITH {_RESULTS} SELECT model, count(*) AS n FROM results WHERE NOT starts_with(model, '<') AND r.scores.\"rougeL\" IS NOT NULL GROUP BY model")
def fil15_real_models(spark, sf_dir):
    r = rec.results(_t(spark, sf_dir, "generated_scored"), "scores")
    return r.where(~F.col("model").startswith("<") & F.col("scores.rougeL").isNotNull()).groupBy("model").agg(F.count("*").alias("n"))


_COMPLETE = " AND ".join(f'r.scores."{m}" IS NOT NULL AND NOT isnan(r.scores."{m}")' for m in rec.SCORES)


@query(f"WITH {_RESULTS} SELECT model, count(*) AS n_points FROM results WHERE {_COMPLETE} GROUP BY model")
def fil17_complete_cases(spark, sf_dir):
    r = rec.results(_t(spark, sf_dir, "generated_scored"), "scores").select("model", *(F.col(f"scores.{m}").alias(m) for m in rec.SCORES))
    return r.dropna(subset=list(rec.SCORES)).groupBy("model").agg(F.count("*").alias("n_points"))


@query(f"WITH {_RESULTS} SELECT model, count(*) FILTER (WHERE coalesce(r.error, '') = '' AND r.scores IS NOT NULL) AS n_scored, count(*) FILTER (WHERE r.scores IS NULL) AS n_unscored FROM results GROUP BY model")
def fil19_scored(spark, sf_dir):
    r = rec.results(_t(spark, sf_dir, "generated_scored"), "error", "scores")
    ok = (F.coalesce("error", F.lit("")) == "") & F.col("scores").isNotNull()
    return r.groupBy("model").agg(F.count_if(ok).alias("n_scored"), F.count_if(F.col("scores").isNull()).alias("n_unscored"))


_LATEST_SQL = "latest AS (SELECT id, x.tags AS tags, x.done AS done FROM (SELECT id, arg_max(struct_pack(tags := tags, done := done), (updated_at, coalesce(notes, ''), coalesce(done, false), coalesce(tags, []))) AS x FROM annotations GROUP BY id))"


def _latest_annotations(spark, sf_dir):
    log = _t(spark, sf_dir, "annotations").withColumn("n", F.coalesce("notes", F.lit(""))).withColumn("d", F.coalesce("done", F.lit(False))).withColumn("t", F.coalesce("tags", F.array().cast("array<string>")))
    return joins.latest(log.select("id", "tags", "done", "updated_at", "n", "d", "t"), "id", "updated_at", "n", "d", "t").select("id", "tags", "done")


@query(f"""WITH {_LATEST_SQL}, v AS (SELECT id, 'all' AS view FROM latest UNION ALL SELECT id, 'todo' FROM latest WHERE NOT coalesce(done, false) UNION ALL SELECT id, 'done' FROM latest WHERE done
UNION ALL SELECT id, 'untagged' FROM latest WHERE coalesce(len(tags), 0) = 0) SELECT view, id FROM v""")
def fil21_views(spark, sf_dir):
    """FIL-21, AGG-20: the annotated items of each view."""
    latest = _latest_annotations(spark, sf_dir)
    views = F.filter(F.array(*(F.when(rec.in_view(v), F.lit(v)) for v in rec.ANNOTATION_VIEWS)), lambda v: v.isNotNull())
    return latest.select(F.explode(views).alias("view"), "id")


# ---- unnesting


@query(f"WITH {_RESULTS}, {_LONG} SELECT model, metric, count(*) AS n, round(min(score), 9) AS low, round(max(score), 9) AS high FROM long GROUP BY model, metric")
def prj8_unpivot(spark, sf_dir):
    long = rec.unpivot_scores(rec.results(_t(spark, sf_dir, "generated_scored"), "scores"), "result_id", "model")
    return long.groupBy("model", "metric").agg(F.count("*").alias("n"), F.round(F.min("score"), 9).alias("low"), F.round(F.max("score"), 9).alias("high"))


# ---- joins


@query("""SELECT DISTINCT d.file_id FROM dataset d WHERE NOT EXISTS (SELECT 1 FROM run_progress p WHERE p.model = 'orrery-mini'
  AND p.repo_name IS NOT DISTINCT FROM d.repo_name AND p.new_path IS NOT DISTINCT FROM d.new_path AND p.commit_hash IS NOT DISTINCT FROM d.commit_hash)""")
def join1_resume(spark, sf_dir):
    todo = _t(spark, sf_dir, "dataset").select("file_id", *rec.RECORD_KEY)
    ledger = _t(spark, sf_dir, "run_progress").where("model = 'orrery-mini'")
    return joins.not_yet_done(todo, ledger).select("file_id").distinct()


@query("SELECT DISTINCT full_name FROM repos_cache WHERE full_name NOT IN (SELECT repo FROM mined_repos WHERE repo IS NOT NULL)")
def join2_unmined(spark, sf_dir):
    repos = _t(spark, sf_dir, "repos_cache").select(F.col("full_name").alias("repo"))
    return joins.not_yet_done(repos, _t(spark, sf_dir, "mined_repos"), ["repo"]).select(F.col("repo").alias("full_name")).distinct()


_HELD = "SELECT DISTINCT repo_name, new_path, commit_hash, c.type AS type, c.start_line AS start_line, c.end_line AS end_line FROM (SELECT repo_name, new_path, commit_hash, unnest(target_comments) AS c FROM dataset WHERE change_type = 'MODIFY')"


@query(f"""WITH held AS ({_HELD}), keys AS (SELECT DISTINCT repo_name, new_path, commit_hash FROM dataset WHERE change_type = 'MODIFY'),
run AS (SELECT DISTINCT ON (file_id) file_id, repo_name, new_path, commit_hash, comment_generations FROM generated_scored),
rows AS (SELECT r.* FROM run r JOIN keys k ON r.repo_name IS NOT DISTINCT FROM k.repo_name AND r.new_path IS NOT DISTINCT FROM k.new_path AND r.commit_hash IS NOT DISTINCT FROM k.commit_hash),
flat AS (SELECT file_id, repo_name, new_path, commit_hash, unnest(comment_generations) AS c FROM rows),
n AS (SELECT f.file_id, count(*) AS k FROM flat f JOIN held h ON f.repo_name IS NOT DISTINCT FROM h.repo_name AND f.new_path IS NOT DISTINCT FROM h.new_path
  AND f.commit_hash IS NOT DISTINCT FROM h.commit_hash AND f.c.type = h.type AND f.c.start_line = h.start_line AND f.c.end_line = h.end_line GROUP BY f.file_id)
SELECT r.file_id, coalesce(n.k, 0) AS n_kept FROM rows r LEFT JOIN n USING (file_id)""")
def join3_prune(spark, sf_dir):
    run = rec.once(_t(spark, sf_dir, "generated_scored"), "file_id", *rec.RECORD_KEY, "comment_generations")
    pruned = joins.prune(run, _t(spark, sf_dir, "dataset").where("change_type = 'MODIFY'"))
    return pruned.select("file_id", F.size("comment_generations").cast("long").alias("n_kept"))


@query(f"WITH {_RESULTS} SELECT model, count(*) AS n, count(*) FILTER (WHERE result_id % 3 <> 0 AND length(coalesce(r.comment_text, '')) > 20) AS n_reused FROM results GROUP BY model")
def join4_reuse(spark, sf_dir):
    """Against an earlier run that lacked every third result and had other text in the short ones."""
    now = rec.results(_t(spark, sf_dir, "generated_scored"), "comment_text", "scores").withColumn("comment_text", F.coalesce("comment_text", F.lit("")))
    old = now.where("result_id % 3 <> 0").withColumn("pos", F.col("result_id"))
    old = old.withColumn("comment_text", F.when(F.length("comment_text") > 20, F.col("comment_text")).otherwise("earlier"))
    done = joins.reuse_scores(now.drop("scores"), old, ["result_id"])
    return done.groupBy("model").agg(F.count("*").alias("n"), F.count_if("reused").alias("n_reused"))


@query("""WITH items AS (SELECT DISTINCT repo_name FROM dataset), a AS (SELECT repo AS repo_name, max(error) AS error FROM mined_repos GROUP BY repo)
SELECT i.repo_name, coalesce(a.error, 'none') AS error, a.repo_name IS NOT NULL AS mined FROM items i LEFT JOIN a USING (repo_name)""")
def join11_left_defaults(spark, sf_dir):
    items = _t(spark, sf_dir, "dataset").select("repo_name").distinct()
    a = _t(spark, sf_dir, "mined_repos").groupBy(F.col("repo").alias("repo_name")).agg(F.max("error").alias("error"), F.lit(True).alias("mined"))
    return items.join(a, "repo_name", "left").select("repo_name", F.coalesce("error", F.lit("none")).alias("error"), F.coalesce("mined", F.lit(False)).alias("mined"))


# ---- aggregates

_EXITS_SQL = f"""CASE WHEN NOT coalesce(new_path LIKE '%.py' AND change_type = 'MODIFY' AND source_code IS NOT NULL AND previous_source_code IS NOT NULL AND commit_message IS NOT NULL, false) THEN 'wrong_metadata'
  WHEN {" OR ".join(f"contains(lower(commit_message), '{m}')" for m in MARKERS)} THEN 'marked_message' WHEN coalesce(len(target_comments), 0) = 0 THEN 'no_target_comments' ELSE 'kept' END"""


@query(f"""WITH {_FILES}, x AS (SELECT repo_name, commit_hash, {_EXITS_SQL} AS e FROM files)
SELECT count(*) AS raw_num_files, count(*) FILTER (WHERE e = 'wrong_metadata') AS n_wrong_metadata, count(*) FILTER (WHERE e = 'marked_message') AS n_marked_message,
  count(*) FILTER (WHERE e = 'no_target_comments') AS n_no_target_comments, count(*) FILTER (WHERE e = 'kept') AS num_files, count(DISTINCT repo_name) AS raw_num_repos,
  count(DISTINCT (repo_name, commit_hash)) AS raw_num_commits, count(DISTINCT repo_name) FILTER (WHERE e = 'kept') AS num_repos, count(DISTINCT (repo_name, commit_hash)) FILTER (WHERE e = 'kept') AS num_commits FROM x""")
def agg1_funnel(spark, sf_dir):
    d = _t(spark, sf_dir, "dataset")
    flags = d.select("file_id", "repo_name", "commit_hash", rec.eligible_files().alias("eligible"), text.contains_any("commit_message", MARKERS).alias("marked"), F.coalesce(F.size("target_comments"), F.lit(0)).alias("targets"))
    files = flags.dropDuplicates(["file_id"])
    return agg.funnel(files, [("wrong_metadata", ~F.col("eligible")), ("marked_message", F.col("marked")), ("no_target_comments", F.col("targets") <= 0)])


@query(f"""WITH {_RESULTS}, inner_rows AS (SELECT file_id, c.type AS type, c.start_line AS start_line, c.end_line AS end_line, min(result_id) AS first, list(result_id ORDER BY result_id) AS ids FROM results GROUP BY ALL)
SELECT file_id, count(*) AS n_comments, string_agg(type || ':' || start_line || '-' || end_line || '=' || array_to_string(ids, '+'), ';' ORDER BY first) AS shape FROM inner_rows GROUP BY file_id""")
def agg5_regroup(spark, sf_dir):
    r = rec.results(_t(spark, sf_dir, "generated_scored"), ".type", ".start_line", ".end_line").withColumn("pos", F.col("result_id"))
    grouped = joins.regroup(r, ["file_id"], rec.COMMENT_KEY, ["result_id", "model"])
    one = F.transform("comment_generations", lambda g: F.concat(g["type"], F.lit(":"), g["start_line"].cast("string"), F.lit("-"), g["end_line"].cast("string"), F.lit("="), F.array_join(F.transform(g["results"], lambda x: x["result_id"].cast("string")), "+")))
    return grouped.select("file_id", F.size("comment_generations").cast("long").alias("n_comments"), F.array_join(one, ";").alias("shape"))


@query("""SELECT model, count(*) AS n_rows, count(DISTINCT (repo_name, new_path, commit_hash)) AS n_records, count(*) FILTER (WHERE coalesce(error, '') = '') AS n_completed,
  count(*) FILTER (WHERE coalesce(error, '') <> '') AS n_failed FROM run_progress GROUP BY model""")
def agg6_ledger_counts(spark, sf_dir):
    failed = F.coalesce("error", F.lit("")) != ""
    return _t(spark, sf_dir, "run_progress").groupBy("model").agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*rec.RECORD_KEY)).alias("n_records"), F.count_if(~failed).alias("n_completed"), F.count_if(failed).alias("n_failed"))


@query(rf"""WITH {_RESULTS}, f AS (SELECT r.error IS NOT NULL OR r.comment_text IS NULL AS failed, CASE WHEN r.error IS NULL THEN 'No comment returned and no error recorded'
    ELSE regexp_replace(trim(regexp_replace(split_part(trim(r.error, E' \n\t\r'), E'\n', 1), '\s+', ' ', 'g')), '\d+(\.\d+)?', 'N', 'g') END AS g FROM results),
n AS (SELECT CASE WHEN g = '' THEN 'Failed with an empty error message' WHEN length(g) <= 80 THEN g ELSE rtrim(substr(g, 1, 80)) || '...' END AS reason, failed FROM f),
t AS (SELECT count(*) AS completions, count(*) FILTER (WHERE failed) AS failures FROM n)
SELECT reason, count(*) AS n, any_value(t.completions) AS completions, round(100.0 * count(*) / any_value(t.failures), 6) AS share_of_failures, round(100.0 * any_value(t.failures) / any_value(t.completions), 6) AS failure_percentage
FROM n, t WHERE failed GROUP BY reason""")
def agg7_failure_tally(spark, sf_dir):
    return agg.failure_tally(rec.results(_t(spark, sf_dir, "generated_scored"), "error", "comment_text"))


@query(f"""WITH {_RESULTS}, k AS (SELECT model, CAST(ceil(octet_length(encode(r.raw_response)) / 4.0) AS BIGINT) AS tokens FROM results)
SELECT model, sum(tokens)::BIGINT AS total_tokens, count(tokens) AS n, round(avg(tokens), 6) AS average_tokens FROM k GROUP BY ROLLUP (model)""")
def agg8_output_tokens(spark, sf_dir):
    """A quarter of the bytes stands in for a tokenizer's count; ``token_totals`` takes any count."""
    r = rec.results(_t(spark, sf_dir, "generated_scored"), "raw_response")
    return agg.token_totals(r.withColumn("tokens", F.ceil(F.octet_length("raw_response") / 4)), "model", "tokens")


@query(f"""WITH {_TARGETS}, p AS (SELECT f.new_path, CAST(ceil(octet_length(encode(c.prompt)) / 2.0) AS BIGINT) AS n FROM targets t JOIN files f USING (file_id) WHERE c.prompt IS NOT NULL),
x AS (SELECT p.*, w.window_name, w.capacity, CASE WHEN n > w.capacity THEN n - w.capacity END AS over FROM p, context_windows w)
SELECT window_name, capacity, count(*) AS n_comments, count(over) AS n_overflows, round(100.0 * count(over) / count(*), 6) AS overflow_percentage, CAST(round_even(median(over), 0) AS BIGINT) AS median_overflow,
  max(over) AS worst_overflow, count(DISTINCT new_path) + max(CASE WHEN new_path IS NULL THEN 1 ELSE 0 END) AS n_paths,
  count(DISTINCT CASE WHEN over IS NOT NULL THEN new_path END) + max(CASE WHEN over IS NOT NULL AND new_path IS NULL THEN 1 ELSE 0 END) AS n_overflow_paths FROM x GROUP BY window_name, capacity""")
def agg10_overflow_tally(spark, sf_dir):
    files = rec.once(_t(spark, sf_dir, "dataset"), "file_id", "new_path", "target_comments")
    prompts = files.select("new_path", F.explode("target_comments.prompt").alias("prompt")).where("prompt IS NOT NULL")
    return agg.overflow_tally(prompts.select("new_path", F.ceil(F.octet_length("prompt") / 2).alias("n_tokens")), _t(spark, sf_dir, "context_windows"))


@query(f"WITH {_TARGETS}, p AS (SELECT file_id, pos, CAST(ceil(octet_length(encode(c.prompt)) / 2.0) AS BIGINT) AS n FROM targets WHERE c.prompt IS NOT NULL), w AS (SELECT min(capacity) AS cap FROM context_windows) SELECT count(*) AS n_comments, count(*) FILTER (WHERE n > cap) AS n_over_any, round(100.0 * count(*) FILTER (WHERE n > cap) / count(*), 6) AS share FROM p, w")
def agg11_over_any(spark, sf_dir):
    c = rec.target_comments(_t(spark, sf_dir, "dataset"), "prompt").where("prompt IS NOT NULL").select(F.ceil(F.octet_length("prompt") / 2).alias("n"))
    least = _t(spark, sf_dir, "context_windows").agg(F.min("capacity").alias("cap"))
    over = F.count_if(F.col("n") > F.col("cap"))
    return c.crossJoin(F.broadcast(least)).agg(F.count("*").alias("n_comments"), over.alias("n_over_any"), F.round(agg.percent(over, F.count("*")), 6).alias("share"))


@query(f"WITH {_RESULTS}, {_LONG} SELECT model, metric, count(*) AS n, round(avg(score), 9) AS mean_score, round(median(score), 9) AS median_score FROM long GROUP BY model, metric")
def agg12_metric_summary(spark, sf_dir):
    long = rec.unpivot_scores(rec.results(_t(spark, sf_dir, "generated_scored"), "scores"), "model")
    return agg.metric_summary(long)


def _pairs(spark, sf_dir):
    rows = rec.all_results(_t(spark, sf_dir, "generated_scored"), "error", "comment_text", ".comment")
    r = apart(rows, "result_id").where(rec.is_scorable(F.col("error"), F.col("comment_text"), F.col("comment")))
    return r.select("result_id", "model", udfs.pair_scores(text.normalize_comment("comment_text"), text.normalize_comment("comment")).alias("s")).select("result_id", "model", "s.*")


@query(f"""WITH {_RESULTS}, {_BLEU_SQL}, corpus AS (SELECT model, sum(c) AS c, sum(r) AS r, {", ".join(f"sum(m{n}) AS m{n}, sum(k{n}) AS k{n}" for n in range(1, 5))} FROM wide GROUP BY model)
SELECT model, {", ".join(f"round({_bleu_sql(n)}, 7) AS bleu{n}_corpus" for n in range(1, 5))} FROM corpus""")
def agg13_corpus_bleu(spark, sf_dir):
    got = agg.corpus_bleu(_pairs(spark, sf_dir), "model")
    return got.select("model", *(F.round(c, 7).alias(c) for c in got.columns if c != "model"))


def _code_metrics(generated):
    """(code_key, m): the metrics of each distinct prompt code, under its digest."""
    codes = generated.select(F.explode("comment_generations.prompt_code").alias("code")).where("code IS NOT NULL")
    return apart(codes.select(F.md5("code").alias("code_key"), "code"), "code_key").select("code_key", code.complexity("code").alias("m"))


def _scores_beside_metrics(spark, sf_dir):
    """(model, metric, score) of every result beside the metrics of its prompt code."""
    g = _t(spark, sf_dir, "generated_scored")
    r = rec.results(g, "scores", code_key=F.md5("c.prompt_code")).where("code_key IS NOT NULL")
    return rec.unpivot_scores(r.join(_code_metrics(g), "code_key").select("model", "scores", "m.*"), "model", *code.METRICS)


@query()
def agg14_correlations(spark, sf_dir):
    """Every model, every score, every code metric of the prompt code."""
    got = agg.correlation_grid(_scores_beside_metrics(spark, sf_dir), ["model", "metric"], "score", code.METRICS)
    return got.withColumnRenamed("y", "code_metric")


@query(f"""WITH {_RESULTS}, {_LONG}, codes AS (SELECT result_id, len(regexp_split_to_array(regexp_replace(c.prompt_code, '\n$', ''), '\n')) AS v FROM results WHERE c.prompt_code IS NOT NULL AND c.prompt_code <> ''),
x AS (SELECT l.model, l.metric, l.score AS x, v::DOUBLE AS y FROM long l JOIN codes USING (result_id)),
k AS (SELECT *, rank() OVER (PARTITION BY model, metric ORDER BY x) + (count(*) OVER (PARTITION BY model, metric, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY model, metric ORDER BY y) + (count(*) OVER (PARTITION BY model, metric, y) - 1) / 2.0 AS ry FROM x)
SELECT model, metric, count(*) AS n, CASE WHEN count(*) > 1 AND min(x) < max(x) AND min(y) < max(y) THEN round(corr(x, y), 7) END AS pearson_r, CASE WHEN count(*) > 1 AND min(x) < max(x) AND min(y) < max(y) THEN round(corr(rx, ry), 7) END AS spearman_r FROM k GROUP BY model, metric""")
def agg14_score_by_lines(spark, sf_dir):
    """The part of the grid that SQL can say: every model and score against the lines of the prompt code (CODE-5)."""
    c = agg.correlations(_scores_beside_metrics(spark, sf_dir), ["model", "metric"], "score", "lines_of_code")
    return c.select("model", "metric", "n", F.round("pearson_r", 7).alias("pearson_r"), F.round("spearman_r", 7).alias("spearman_r"))


@query("""WITH x AS (SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y FROM lineitem),
k AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY x) + (count(*) OVER (PARTITION BY l_returnflag, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY y) + (count(*) OVER (PARTITION BY l_returnflag, y) - 1) / 2.0 AS ry FROM x)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 7) AS pearson_r, round(corr(rx, ry), 7) AS spearman_r, 'ok' AS status FROM k GROUP BY l_returnflag""")
def agg14_correlation_of_lineitem(spark, sf_dir):
    c = agg.correlations(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return c.select("l_returnflag", "n", F.round("pearson_r", 7).alias("pearson_r"), F.round("spearman_r", 7).alias("spearman_r"), "status")


_NEAREST = f"""WITH {_RESULTS}, {_LONG}, k AS (SELECT *, row_number() OVER (PARTITION BY model, metric ORDER BY score) AS i, count(*) OVER (PARTITION BY model, metric) AS n FROM long),
cut AS (SELECT model, metric, n, score AS threshold FROM k WHERE i = ceil(0.2::DOUBLE * n))"""


@query(_NEAREST + " SELECT c.model, c.metric, c.n, c.threshold, count(*) FILTER (WHERE l.score <= c.threshold) AS n_candidates FROM cut c JOIN long l USING (model, metric) GROUP BY ALL")
def agg16_nearest_rank(spark, sf_dir):
    long = rec.unpivot_scores(rec.results(_t(spark, sf_dir, "generated_scored"), "scores"), "model")
    return agg.nearest_rank(long, ["model", "metric"], "score", 0.2)


@query(f"WITH {_FILES} SELECT repo_name, count(*) AS n_items FROM files WHERE file_id IS NOT NULL GROUP BY repo_name ORDER BY n_items DESC, repo_name")
def agg18_items_per_repo(spark, sf_dir):
    """AGG-18 for every repository, most common first."""
    return rec.once(_t(spark, sf_dir, "dataset"), "file_id", "repo_name").groupBy("repo_name").agg(F.count("*").alias("n_items")).orderBy(F.desc("n_items"), "repo_name")


_EDGES = """e AS (SELECT metric, min(score) AS lo, max(score) AS hi FROM long GROUP BY metric), edges AS (SELECT metric, lo, hi, i, lo + i * ((hi - lo) / 50) AS edge FROM e, range(50) t(i)),
tot AS (SELECT model, metric, count(*) AS n FROM long GROUP BY ALL), d AS (SELECT model, metric, score, count(*) AS c FROM long GROUP BY ALL),
b AS (SELECT d.model, d.metric, d.score, d.c, max(i) AS bin, any_value((hi - lo) / 50) AS width FROM d JOIN edges x ON d.metric = x.metric AND d.score >= x.edge GROUP BY ALL)"""


@query(f"WITH {_RESULTS}, {_LONG}, {_EDGES} SELECT b.model, b.metric, CAST(b.bin AS INT) AS bin, sum(b.c)::BIGINT AS n_bin, round(sum(b.c) / (any_value(tot.n) * any_value(b.width)), 6) AS density FROM b JOIN tot USING (model, metric) GROUP BY b.model, b.metric, b.bin")
def agg19_density_histogram(spark, sf_dir):
    return agg.density_histogram(rec.unpivot_scores(rec.results(_t(spark, sf_dir, "generated_scored"), "scores"), "model"))


_CLEAN_SQL = r"list_distinct(list_filter(list_transform(tags, lambda t: regexp_replace(lower(trim(t, E' \t\n\r')), '\s+', '-', 'g')), lambda t: t <> ''))"


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest({_CLEAN_SQL}) AS tag FROM annotations) GROUP BY tag")
def agg20_tag_counts(spark, sf_dir):
    return _t(spark, sf_dir, "annotations").select(F.explode(text.clean_tags("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT id, max(updated_at) AS updated_at, arg_max(coalesce(notes, ''), (updated_at, coalesce(notes, ''))) AS notes FROM annotations GROUP BY id")
def agg21_latest_annotation(spark, sf_dir):
    log = _t(spark, sf_dir, "annotations").select("id", "updated_at", F.coalesce("notes", F.lit("")).alias("notes"))
    return joins.latest(log, "id", "updated_at", "notes")


@query("SELECT id, max(stargazers_count) AS stargazers_count, count(*) AS n_rows FROM repos_cache GROUP BY id")
def agg22_dedup_repos(spark, sf_dir):
    repos = _t(spark, sf_dir, "repos_cache")
    n = repos.groupBy("id").agg(F.count("*").alias("n_rows"))
    return joins.latest(repos.select("id", "stargazers_count", "size"), "id", "stargazers_count", "size").select("id", "stargazers_count").join(n, "id")


@query("""WITH want AS (SELECT DISTINCT repo_name, new_path, commit_hash FROM dataset), p AS (SELECT model, repo_name, new_path, commit_hash, bool_or(coalesce(error, '') <> '') AS failed FROM run_progress GROUP BY ALL)
SELECT m.model, (SELECT count(*) FROM want) AS expected, count(p.model) AS committed, count(*) FILTER (WHERE p.failed) AS n_failed, count(p.model) < (SELECT count(*) FROM want) OR coalesce(bool_or(p.failed), false) AS needs_work
FROM (SELECT DISTINCT model FROM run_progress) m LEFT JOIN p ON p.model IS NOT DISTINCT FROM m.model GROUP BY m.model""")
def agg23_needs_work(spark, sf_dir):
    want = _t(spark, sf_dir, "dataset").select(*rec.RECORD_KEY).distinct().agg(F.count("*").alias("expected"))
    ledger = _t(spark, sf_dir, "run_progress").groupBy("model", *rec.RECORD_KEY).agg(F.bool_or(F.coalesce("error", F.lit("")) != "").alias("failed"))
    by = ledger.groupBy("model").agg(F.count("model").alias("committed"), F.count_if("failed").alias("n_failed"))
    return by.crossJoin(F.broadcast(want)).select("model", "expected", "committed", "n_failed", ((F.col("committed") < F.col("expected")) | (F.col("n_failed") > 0)).alias("needs_work"))


# ---- windows, order, sampling, partitioning


@query("""WITH k AS (SELECT DISTINCT l_orderkey % 10 AS g, l_orderkey // 10 AS v FROM lineitem), i AS (SELECT g, v, v - row_number() OVER (PARTITION BY g ORDER BY v) AS d FROM k),
r AS (SELECT g, min(v) AS a, max(v) AS b FROM i GROUP BY g, d) SELECT g, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS spec FROM r GROUP BY g""")
def win2_array_spec(spark, sf_dir):
    keys = _t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("g"), F.expr("l_orderkey div 10").alias("v"))
    return agg.array_spec(keys, ["g"], "v")


@query("SELECT DISTINCT k FROM (SELECT r.k, row_number() OVER (PARTITION BY m ORDER BY k) AS i FROM (SELECT o_orderkey AS k, o_orderpriority AS m FROM orders) r) WHERE i <= 5")
def ord3_top_k(spark, sf_dir):
    return agg.top_k(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority"), "o_orderpriority", 5, F.col("k")).select("k").distinct()


@query("SELECT id, full_name, row_number() OVER (ORDER BY size, id) - 1 AS pos, (row_number() OVER (ORDER BY size, id) - 1) % 4 AS task FROM (SELECT id, arg_max(full_name, stargazers_count) AS full_name, arg_max(size, stargazers_count) AS size FROM repos_cache GROUP BY id)")
def part3_size_stride(spark, sf_dir):
    """PART-3, ORD-1: positions by size over the whole list, by sorted ranges and not in one task."""
    repos = joins.latest(_t(spark, sf_dir, "repos_cache").select("id", "full_name", "size", "stargazers_count"), "id", "stargazers_count")
    ranked = repos.repartitionByRange("size", "id").sortWithinPartitions("size", "id").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    ranked = cut(ranked)
    heads = ranked.groupBy("part").agg(F.count("*").alias("n"), F.min("row").alias("head"))
    before = heads.alias("a").join(F.broadcast(heads.alias("b")), F.col("a.part") > F.col("b.part"), "left").groupBy(F.col("a.part").alias("part"), F.col("a.head").alias("head")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("skip"))
    pos = F.col("row") - F.col("head") + F.col("skip")
    return ranked.join(F.broadcast(before), "part").select("id", "full_name", pos.alias("pos"), (pos % 4).alias("task"))


_CRC_SQL = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(concat_ws('@', repo_name, commit_hash), ''), lambda ch: ord(ch)::BIGINT)),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, unused: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""


@query(f"SELECT DISTINCT file_id, ({_CRC_SQL} % 8)::BIGINT AS task FROM dataset WHERE repo_name IS NOT NULL AND commit_hash IS NOT NULL")
def part1_commit_hash(spark, sf_dir):
    """PART-1: tasks by CRC-32 of repository and commit."""
    task = F.crc32(F.concat_ws("@", "repo_name", "commit_hash").cast("binary")) % 8
    return _t(spark, sf_dir, "dataset").where("repo_name IS NOT NULL AND commit_hash IS NOT NULL").select("file_id", task.alias("task")).distinct()


@query(f"WITH {_FILES} SELECT file_id % 3 AS task, count(*) AS n FROM files WHERE file_id IS NOT NULL GROUP BY task")
def part2_stride(spark, sf_dir):
    """PART-2: every third position over all files; file_id is the position in the input."""
    files = _t(spark, sf_dir, "dataset").select("file_id").where("file_id IS NOT NULL").distinct()
    return files.groupBy((F.col("file_id") % 3).alias("task")).agg(F.count("*").alias("n"))


@query(f"WITH {_FILES} SELECT file_id, repo_name FROM files WHERE file_id IS NOT NULL ORDER BY file_id LIMIT 300")
def ord5_first_records(spark, sf_dir):
    """ORD-5, ORD-6: the first 300 records in input order, which is the feature (``max_generate``, ``max_repos``)."""
    return rec.once(_t(spark, sf_dir, "dataset"), "file_id", "repo_name").orderBy("file_id").limit(300)


@query(_NEAREST + ", cand AS (SELECT l.model, l.result_id FROM cut c JOIN long l USING (model, metric) WHERE metric = 'rougeL' AND l.score <= c.threshold AND NOT starts_with(model, '<')), z AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5('7:' || result_id), result_id) AS i FROM cand) SELECT model, result_id FROM z WHERE i <= 20")
def samp2_seeded_sample(spark, sf_dir):
    long = rec.unpivot_scores(rec.results(_t(spark, sf_dir, "generated_scored"), "scores"), "result_id", "model").where("metric = 'rougeL'")
    limit = agg.nearest_rank(long, ["model", "metric"], "score", 0.2).select("model", "threshold")
    candidates = long.join(limit, "model").where((F.col("score") <= F.col("threshold")) & ~F.col("model").startswith("<"))
    return agg.seeded_sample(candidates.select("model", "result_id"), "model", "result_id", 20, 7)


@query("SELECT task_id FROM (SELECT unnest(range(CAST((SELECT max(l_orderkey) + 1 FROM lineitem) AS BIGINT))) AS task_id) WHERE task_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)")
def set2_missing(spark, sf_dir):
    """SET-2: all numbers up to the largest that do not occur."""
    return joins.missing_numbers(_t(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT full_name AS repo FROM repos_cache UNION SELECT repo FROM mined_repos UNION SELECT repo_name FROM dataset")
def set3_all_repos(spark, sf_dir):
    frames = [_t(spark, sf_dir, t).select(F.col(c).alias("repo")) for t, c in (("repos_cache", "full_name"), ("mined_repos", "repo"), ("dataset", "repo_name"))]
    return joins.distinct_union(frames)


# ---- strings


@query(rf"""WITH {_TARGETS} SELECT file_id, pos, trim(regexp_replace(array_to_string(list_transform(regexp_split_to_array(c.comment, '\r\n|[\n\r\x0b\x0c]'), lambda ln: regexp_replace(trim(ln, E' \t\r\n'), '^#+', '')), ' '), '\s+', ' ', 'g')) AS plain FROM targets""")
def str1_normalize(spark, sf_dir):
    return rec.target_comments(_t(spark, sf_dir, "dataset"), "comment").select("file_id", "pos", text.normalize_comment("comment").alias("plain"))


def _peel_sql(x: str) -> str:
    """One layer of STR-2 in SQL: a fence, else a tag that is closed by its own name."""
    fenced = f"regexp_full_match({x}, '(?s)```[^\\n]*\\n.*?```')"
    inner = f"regexp_extract({x}, '(?s)^```[^\\n]*\\n(.*?)\\n?```$', 1)"
    tag = f"regexp_extract({x}, '^<([A-Za-z][\\w-]*)(?:\\s[^>]*)?>', 1)"
    body = f"regexp_extract({x}, '(?s)^<[A-Za-z][\\w-]*(?:\\s[^>]*)?>(.*)</[A-Za-z][\\w-]*>$', 1)"
    peeled = f"CASE WHEN {fenced} THEN {inner} WHEN {tag} <> '' AND ends_with({x}, '</' || {tag} || '>') THEN {body} ELSE {x} END"
    return f"regexp_replace({peeled}, '^{_BLANK_SQL}+|{_BLANK_SQL}+$', '', 'g')"


@query(f"""WITH {_RESULTS}, t0 AS (SELECT result_id, regexp_replace(r.raw_response, '^{_BLANK_SQL}+|{_BLANK_SQL}+$', '', 'g') AS t FROM results WHERE r.raw_response IS NOT NULL),
t1 AS (SELECT result_id, {_peel_sql("t")} AS t FROM t0), t2 AS (SELECT result_id, {_peel_sql("t")} AS t FROM t1), t3 AS (SELECT result_id, {_peel_sql("t")} AS t FROM t2), t4 AS (SELECT result_id, {_peel_sql("t")} AS t FROM t3)
SELECT result_id, md5(t) AS unwrapped FROM t4""")
def str2_unwrap(spark, sf_dir):
    """STR-2 to its fixpoint."""
    r = rec.results(_t(spark, sf_dir, "generated_scored"), "raw_response").where("raw_response IS NOT NULL")
    return r.select("result_id", F.md5(udfs.unwrap_all("raw_response")).alias("unwrapped"))


def _id_sql(model: str) -> str:
    """STR-6 in SQL."""
    texts = [f"coalesce(to_json({c})::VARCHAR, 'null')" for c in ("repo_name", "new_path", "commit_hash", "c.type", "c.start_line", "c.end_line", model)]
    return f"substr(sha1('[' || {' || chr(44) || chr(32) || '.join(texts)} || ']'), 1, 16)"


@query(f"""WITH comments AS (SELECT DISTINCT repo_name, new_path, commit_hash, c FROM (SELECT repo_name, new_path, commit_hash, unnest(comment_generations) AS c FROM generated_scored)),
items AS (SELECT repo_name, new_path, commit_hash, c, unnest(c.results).model AS model FROM comments), ids AS (SELECT DISTINCT {_id_sql("model")} AS id, model FROM items)
SELECT id, model FROM ids WHERE id IN (SELECT id FROM annotations)""")
def str6_item_ids(spark, sf_dir):
    """STR-6, STR-5: items that have an annotation, found by their id."""
    g = _t(spark, sf_dir, "generated_scored").select(*rec.RECORD_KEY, F.explode("comment_generations").alias("c")).select(*rec.RECORD_KEY, "c.type", "c.start_line", "c.end_line", F.explode("c.results.model").alias("model"))
    ids = g.distinct().withColumn("id", udfs.item_id("repo_name", "new_path", "commit_hash", "type", "start_line", "end_line", "model"))
    return ids.join(_t(spark, sf_dir, "annotations").select("id").distinct(), "id", "left_semi").select("id", "model").distinct()


@query(f"WITH {_TARGETS} SELECT file_id, pos, 'Fix the ' || c.type || ' comment at ' || c.start_line || ' in ' || repo_name AS prompt FROM targets WHERE repo_name IS NOT NULL AND c.type IS NOT NULL")
def str7_template(spark, sf_dir):
    c = rec.target_comments(_t(spark, sf_dir, "dataset"), "type", "start_line").where("repo_name IS NOT NULL AND type IS NOT NULL")
    filled = text.fill_template("Fix the {kind} comment at {line} in {repo}", repo=F.col("repo_name"), kind=F.col("type"), line=F.col("start_line").cast("string"))
    return c.select("file_id", "pos", filled.alias("prompt"))


# ---- text metrics


_LCS_SQL = """list_reduce(list_concat([list_transform(b, lambda w: 0)], list_transform(a, lambda w: list_transform(b, lambda v: (v = w)::INT))),
  lambda old, eq: list_transform(range(1, len(old) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(old[k], CASE WHEN eq[k] = 1 THEN (CASE WHEN k > 1 THEN old[k - 1] ELSE 0 END) + 1 ELSE 0 END)))))[-1]"""


def _words_sql(x: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f"WITH {_RESULTS}, {_BLEU_SQL} SELECT result_id, {', '.join(f'round({_bleu_sql(n)}, 7) AS bleu{n}' for n in range(1, 5))} FROM wide")
def txt1_pair_scores(spark, sf_dir):
    return _pairs(spark, sf_dir).select("result_id", *(F.round(c, 7).alias(c) for c in ("bleu1", "bleu2", "bleu3", "bleu4")))


@query(f"""WITH {_RESULTS}, {_SCORABLE}, words AS (SELECT result_id, {_words_sql("p")} AS a, {_words_sql("q")} AS b FROM scorable),
x AS (SELECT result_id, len(a) AS n, len(b) AS m, CASE WHEN len(a) > 0 AND len(b) > 0 THEN {_LCS_SQL} ELSE 0 END AS k FROM words)
SELECT result_id, CASE WHEN k = 0 THEN 0.0 ELSE round(2 * (k / n) * (k / m) / (k / n + k / m), 7) END AS rouge_l FROM (SELECT result_id, n, m, k::DOUBLE AS k FROM x)""")
def txt2_rouge_l(spark, sf_dir):
    return _pairs(spark, sf_dir).select("result_id", F.round("rougeL", 7).alias("rouge_l"))


@query()
def txt6_prompt_tokens(spark, sf_dir):
    """TXT-6, AGG-11: tokens of each target prompt by a public vocabulary."""
    c = rec.target_comments(_t(spark, sf_dir, "dataset"), "prompt").where("prompt IS NOT NULL")
    return c.select("file_id", "pos", tokens.token_counts(F.col("prompt")).alias("n_tokens"))


@query()
def agg8_token_stats(spark, sf_dir):
    """AGG-8: prompts once per comment, outputs once per result, failures apart; by a public vocabulary."""
    return agg.token_stats(_t(spark, sf_dir, "generated_scored"))


@query()
def agg10_context_tally(spark, sf_dir):
    """FIL-9, FIL-10, AGG-10: prompts that leave no room for an answer, their tokens counted where bytes do not decide."""
    files = rec.once(_t(spark, sf_dir, "dataset"), "file_id", "new_path", "target_comments")
    prompts = files.select("new_path", F.explode("target_comments.prompt").alias("prompt")).where("prompt IS NOT NULL")
    return agg.overflow_tally(prompts.select("new_path", tokens.token_counts(F.col("prompt")).alias("n_tokens")), _t(spark, sf_dir, "context_windows"))


@query(f"""WITH {_RESULTS}, o AS (SELECT count(*) AS n, avg(ceil(octet_length(encode(r.raw_response)) / 4.0)) AS mean FROM results WHERE r.raw_response IS NOT NULL),
c AS (SELECT DISTINCT file_id, c.type AS t, c.start_line AS a, c.end_line AS b, c.prompt AS prompt FROM comments), p AS (SELECT count(*) AS n, avg(ceil(octet_length(encode(prompt)) / 4.0)) AS mean FROM c WHERE prompt IS NOT NULL)
SELECT round(p.mean * p.n / 1e6 * 2.0, 9) AS input_cost, round(o.mean * p.n / 1e6 * 10.0, 9) AS output_cost, round(p.mean * p.n / 1e6 * 2.0 + o.mean * p.n / 1e6 * 10.0, 9) AS total_cost FROM p, o""")
def agg9_cost(spark, sf_dir):
    """AGG-9: a run projected at prices that are parameters, on a quarter of the bytes."""
    quarter = lambda c: F.ceil(F.octet_length(c) / 4)
    stats = agg.token_stats(_t(spark, sf_dir, "generated_scored"), lambda c: quarter(c)).where("model IS NULL")
    return agg.project_cost(stats, 2.0, 10.0)


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.label, list_cosine_similarity(q.v, e.v) AS c FROM q, e), best AS (SELECT query_id, label, max(c) AS top FROM s GROUP BY ALL)
SELECT query_id, label, round(top, 6) AS best_cosine FROM best""")
def txt3_greedy_cosine(spark, sf_dir):
    """TXT-3's matching step: each query vector's best cosine in every label, against all vectors; the F1 is ``txt3_greedy_f1``."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = agg.best_cosines(queries, e, "query_id", "label", "embedding")
    return got.select("query_id", "label", F.round("best", 6).alias("best_cosine"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.v, b.v) AS c FROM e a JOIN e b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
p AS (SELECT label, avg(m) AS p FROM (SELECT label, i, max(c) AS m FROM s GROUP BY ALL) GROUP BY label), r AS (SELECT label, avg(m) AS r FROM (SELECT label, j, max(c) AS m FROM s GROUP BY ALL) GROUP BY label)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM p JOIN r USING (label)""")
def txt3_greedy_f1(spark, sf_dir):
    """TXT-3's formula: in each label the even vectors are the candidate's tokens, the odd ones the reference's."""
    e = _t(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    got = agg.greedy_f1(e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1"), "label", "vec_id", "v")
    return got.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


# ---- source code


_ELIGIBLE_SQL = "new_path LIKE '%.py' AND change_type = 'MODIFY' AND source_code IS NOT NULL AND previous_source_code IS NOT NULL AND commit_message IS NOT NULL"


@query(f"WITH {_FILES} SELECT file_id, len(target_comments) AS n_found FROM files WHERE {_ELIGIBLE_SQL} AND len(target_comments) > 0")
def code1_comment_changes(spark, sf_dir):
    """CODE-1, JOIN-6, WIN-1, WIN-4, ORD-2: how many of the stored targets are among a file's new or changed comments, with the same place and anchor."""
    d = widen(_t(spark, sf_dir, "dataset").where(rec.eligible_files() & (F.size("target_comments") > 0))).select("file_id", "target_comments", code.changed_comments("source_code", "previous_source_code").alias("x"))
    same = lambda t: F.exists("x.comments", lambda c: (F.rtrim(F.split(c["comment"], "\n")[0]) == F.split(t["comment"], "\n")[0]) & (c["type"] == t["type"]) & (c["start_line"] == t["start_line"]) & (c["end_line"] == t["end_line"]) & F.rtrim(c["anchor"]).eqNullSafe(F.rtrim(t["anchor"])) & c["status"].isin("added", "modified"))
    counted = d.select("file_id", F.size(F.filter("target_comments", same)).cast("long").alias("n_found"))
    # a row's counts are those of its file, so the small result is deduplicated and no text is moved
    return counted.where("file_id IS NOT NULL").dropDuplicates(["file_id"])


@query()
def code1_statuses(spark, sf_dir):
    """JOIN-6: comments of each eligible file by status; files that do not tokenize apart."""
    d = widen(_t(spark, sf_dir, "dataset").where(rec.eligible_files())).select("file_id", code.changed_comments("source_code", "previous_source_code").alias("x"))
    n = lambda s: F.coalesce(F.size(F.filter("x.comments", lambda c: c["status"] == s)), F.lit(0))
    counts = [F.greatest(n(s), F.lit(0)).cast("long").alias(f"n_{s}") for s in ("added", "modified", "unchanged", "removed")]
    return d.select("file_id", F.col("x.error").isNotNull().alias("parse_error"), *counts).where("file_id IS NOT NULL").dropDuplicates(["file_id"])


_SCOPED = r"^(?:#[^\n]*\n)*(?:@|def |async def |class )"


@query(f"WITH {_TARGETS} SELECT t.file_id, pos, false AS failed, CASE WHEN regexp_matches(c.prompt_code, '{_SCOPED}') THEN md5(c.prompt_code) END AS code_md5 FROM targets t JOIN files f USING (file_id) WHERE f.source_code IS NOT NULL")
def code2_prompt_code(spark, sf_dir):
    """CODE-2, JOIN-7, WIN-6, T14: the prompt code of each target, against the stored one where that is of a function or class.

    A file is parsed once for all its targets; the small result is deduplicated, so no text is moved.
    """
    slim = F.transform("target_comments", lambda c: F.struct(c["type"].alias("type"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), c["anchor"].alias("anchor")))
    d = widen(_t(spark, sf_dir, "dataset").where(F.col("file_id").isNotNull() & F.col("source_code").isNotNull() & (F.size("target_comments") > 0)))
    coded = d.select("file_id", F.col("target_comments.prompt_code").alias("stored"), code.prompt_codes("source_code", slim).alias("p"))
    digests = F.zip_with("stored", "p", lambda s, p: F.struct(p["error"].isNotNull().alias("failed"), F.when(s.rlike(_SCOPED), F.md5(p["code"])).alias("code_md5")))
    small = coded.select("file_id", digests.alias("d")).dropDuplicates(["file_id"])
    return small.select("file_id", F.posexplode("d").alias("pos", "x")).select("file_id", "pos", "x.failed", "x.code_md5")


@query(f"WITH {_TARGETS} SELECT file_id, pos, len(regexp_split_to_array(regexp_replace(c.prompt_code, '\n$', ''), '\n')) AS lines_of_code FROM targets WHERE c.prompt_code IS NOT NULL AND c.prompt_code <> ''")
def code5_lines(spark, sf_dir):
    """CODE-5, T12."""
    c = rec.target_comments(_t(spark, sf_dir, "dataset"), "prompt_code").where("prompt_code IS NOT NULL AND prompt_code <> ''")
    return c.select("file_id", "pos", F.size(text.lines("prompt_code")).cast("long").alias("lines_of_code"))


@query()
def code3_complexity(spark, sf_dir):
    c = rec.target_comments(_t(spark, sf_dir, "dataset"), "prompt_code").where("prompt_code IS NOT NULL")
    keyed = c.select("file_id", "pos", F.md5("prompt_code").alias("code_key"), "prompt_code")
    codes = apart(keyed.select("code_key", "prompt_code"), "code_key").select("code_key", code.complexity("prompt_code").alias("m"))
    return keyed.select("file_id", "pos", "code_key").join(codes, "code_key").select("file_id", "pos", "m.*")


# ---- whole stages


@query()
def e1_filter_funnel(spark, sf_dir):
    return pipelines.filter_files(_t(spark, sf_dir, "dataset"), MARKERS, 8192).funnel()


@query()
def e1_kept_targets(spark, sf_dir):
    kept = pipelines.filter_files(_t(spark, sf_dir, "dataset"), MARKERS, 8192).kept()
    return kept.select("file_id", F.explode("target_comments").alias("c")).select("file_id", "c.type", "c.start_line", "c.end_line", F.md5("c.prompt_code").alias("code_md5"))


@query(f"""WITH {_FILES}, s AS (SELECT crc32_task AS task, repo_name FROM (SELECT file_id % 4 AS crc32_task, repo_name FROM files))
SELECT count(*) AS num_files, count(DISTINCT repo_name) AS num_repos FROM s""")
def agg3_merge_counts(spark, sf_dir):
    shards = rec.once(_t(spark, sf_dir, "dataset"), "file_id", "repo_name").groupBy((F.col("file_id") % 4).alias("task")).agg(F.count("*").alias("num_files"), F.collect_set("repo_name").alias("repo_names"))
    return pipelines.merge_shard_counts(shards)


@query(f"""WITH {_RESULTS}, s AS (SELECT result_id, model, r.scores.bertscore_f1 AS score FROM results WHERE r.scores.bertscore_f1 IS NOT NULL AND NOT isnan(r.scores.bertscore_f1) AND NOT starts_with(model, '<')),
k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score) AS i, count(*) OVER (PARTITION BY model) AS n FROM s), cut AS (SELECT model, score AS threshold FROM k WHERE i = ceil(0.2::DOUBLE * n)),
quota AS (SELECT ceil(100.0 / count(*)) AS q FROM cut), z AS (SELECT s.*, row_number() OVER (PARTITION BY s.model ORDER BY md5('0:' || result_id), result_id) AS i FROM s JOIN cut USING (model) WHERE score <= threshold),
picked AS (SELECT result_id, model, score FROM z, quota WHERE i <= q), keys AS (SELECT result_id, any_value({_id_sql("m")}) AS id FROM (SELECT DISTINCT ON (x.result_id) x.result_id AS result_id, repo_name, new_path, commit_hash, c, CASE WHEN coalesce(x.model, '') = '' THEN '<unknown>' ELSE x.model END AS m
  FROM (SELECT repo_name, new_path, commit_hash, c, unnest(c.results) AS x FROM comments)) GROUP BY result_id)
SELECT id, model, result_id, score FROM picked JOIN keys USING (result_id)""")
def prj5_sample_items(spark, sf_dir):
    return pipelines.sample_items(_t(spark, sf_dir, "generated_scored"), "bertscore_f1", 0.2, 100).select("id", "model", "result_id", "score")


@query(f"""WITH {_TARGETS}, p AS (SELECT t.file_id, f.new_path, f.commit_hash, c.type AS type, c.start_line AS start_line, CAST(ceil(octet_length(encode(c.prompt)) / 2.0) AS BIGINT) AS n FROM targets t JOIN files f USING (file_id) WHERE c.prompt IS NOT NULL)
SELECT w.window_name, p.file_id, p.new_path, p.commit_hash, p.type, p.start_line, p.n AS prompt_tokens, p.n - w.capacity AS overflow_tokens FROM p JOIN context_windows w ON p.n > w.capacity""")
def prj6_overflows(spark, sf_dir):
    files = rec.once(_t(spark, sf_dir, "dataset"), "file_id", "new_path", "commit_hash", "target_comments")
    c = files.select("file_id", "new_path", "commit_hash", F.explode("target_comments").alias("c")).where("c.prompt IS NOT NULL")
    rows = c.select("file_id", "new_path", "commit_hash", "c.type", "c.start_line", F.ceil(F.octet_length("c.prompt") / 2).alias("prompt_tokens"))
    over = rows.crossJoin(F.broadcast(_t(spark, sf_dir, "context_windows"))).where(F.col("prompt_tokens") > F.col("capacity"))
    return over.select("window_name", "file_id", "new_path", "commit_hash", "type", "start_line", "prompt_tokens", (F.col("prompt_tokens") - F.col("capacity")).alias("overflow_tokens"))


@query("SELECT id, count(*) AS n_versions, bool_and(updated_at IS NOT NULL AND id IS NOT NULL AND regexp_full_match(id, '[0-9a-f]{16}')) AS valid FROM annotations GROUP BY id")
def str5_valid_annotations(spark, sf_dir):
    ok = F.col("updated_at").isNotNull() & F.col("id").isNotNull() & F.col("id").rlike(r"\A[0-9a-f]{16}\z")
    return _t(spark, sf_dir, "annotations").groupBy("id").agg(F.count("*").alias("n_versions"), F.bool_and(ok).alias("valid"))


@query("SELECT CAST(commit_datetime[1:10] AS DATE) AS day, count(DISTINCT file_id) AS n_files FROM dataset WHERE commit_datetime[1:10] >= '2000-01-01' GROUP BY day")
def date1_commits_per_day(spark, sf_dir):
    """DATE-1, DATE-2: local days of commits, the offset left alone."""
    day = F.to_date(F.substring("commit_datetime", 1, 10))
    return _t(spark, sf_dir, "dataset").select("file_id", day.alias("day")).where("day >= DATE'2000-01-01'").groupBy("day").agg(F.count_distinct("file_id").alias("n_files"))


# ---- plots' tables


@query()
def viz2_scatter_points(spark, sf_dir):
    """FIL-17: complete cases of two complexities and all scores."""
    g = _t(spark, sf_dir, "generated_scored")
    r = rec.results(g, "scores", code_key=F.md5("c.prompt_code"))
    flat = r.join(_code_metrics(g), "code_key").select("result_id", "model", "m.cognitive_complexity", "m.cyclomatic_complexity", *(F.col(f"scores.{m}").alias(m) for m in rec.SCORES))
    return flat.dropna(subset=["cognitive_complexity", "cyclomatic_complexity", *rec.SCORES])


@query()
def viz3_matrix(spark, sf_dir):
    """JOIN-9, STR-9: the full grid with a cell text, a dash where there is no correlation."""
    got = agg14_correlations(spark, sf_dir)
    grid = spark.createDataFrame([(m, c) for m in rec.SCORES for c in code.METRICS], "metric string, code_metric string")
    full = got.select("model").distinct().join(F.broadcast(grid))
    return full.join(got, ["model", "metric", "code_metric"], "left").select("model", "metric", "code_metric", text.star_cell(F.col("pearson_r"), F.col("pearson_p_value")).alias("cell"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY event_type")
def agg_event_totals(spark, sf_dir):
    """Counts and sums by kind of event; ``streaming.ledger`` has the operators on streams."""
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
