"""Every registered query runs on the smallest tables; most are checked against SQL."""

import collections
import math
import statistics
import tokenize

import duckdb
import pytest

from marginalia.functions import code, tokens, udfs
from marginalia.plans import pipelines, registry


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con(sf_dir):
    from pathlib import Path

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def _codes(con):
    """(file_id, pos) and prompt code of each target, once."""
    files = con.execute("SELECT DISTINCT ON (file_id) file_id, target_comments FROM dataset WHERE target_comments IS NOT NULL").fetchall()
    return {(i, k): c for i, cs in files for k, c in enumerate(cs)}


def expect_tokens(rows, con):
    count = tokens.vocabulary()()
    want = {k: count([c["prompt"]])[0] for k, c in _codes(con).items() if c["prompt"] is not None}
    assert {(r.file_id, r.pos): r.n_tokens for r in rows} == want


def expect_token_stats(rows, con):
    count = tokens.vocabulary()()
    results = con.execute("SELECT DISTINCT ON (r.result_id) r.model, r.raw_response FROM (SELECT unnest(c.results) AS r FROM (SELECT unnest(comment_generations) AS c FROM generated_scored)) WHERE r.result_id IS NOT NULL").fetchall()
    sums = {}
    for model, raw in results:
        for key in (model or "<unknown>", None):
            s = sums.setdefault(key, [0, 0, 0])
            s[0 if raw is not None else 1] += 1
            s[2] += count([raw])[0] if raw is not None else 0
    assert {r.model: [r.n_outputs, r.n_failed, r.output_tokens] for r in rows} == sums


def expect_context_tally(rows, con):
    count = tokens.vocabulary()()
    held = [count([c["prompt"]])[0] for c in _codes(con).values() if c["prompt"] is not None]
    for r in rows:
        over = [n - r.capacity for n in held if n > r.capacity]
        assert (r.n_comments, r.n_overflows, r.worst_overflow) == (len(held), len(over), max(over, default=None))
        assert r.median_overflow == (round(statistics.median(over)) if over else None)


def expect_statuses(rows, con):
    files = {i: x for i, *x in con.execute(f"SELECT DISTINCT ON (file_id) file_id, source_code, previous_source_code FROM dataset WHERE {registry._ELIGIBLE_SQL}").fetchall()}
    assert {r.file_id for r in rows} == set(files)
    for r in rows:
        try:
            found = collections.Counter(c["status"] for c in code.diff_comments(*map(code.extract_comments, files[r.file_id])))
            assert (r.n_added, r.n_modified, r.n_unchanged, r.n_removed, r.parse_error) == (found["added"], found["modified"], found["unchanged"], found["removed"], False)
        except (SyntaxError, tokenize.TokenError):
            assert r.parse_error


def expect_complexity(rows, con):
    codes = {k: c["prompt_code"] for k, c in _codes(con).items() if c["prompt_code"] is not None}
    assert {(r.file_id, r.pos): tuple(r[m] for m in code.METRICS) for r in rows} == {k: code.code_metrics(t) for k, t in codes.items()}


def _grid(con):
    rows = con.execute("SELECT DISTINCT ON (r.result_id) r.result_id, CASE WHEN coalesce(r.model, '') = '' THEN '<unknown>' ELSE r.model END, r.scores, code FROM (SELECT c.prompt_code AS code, unnest(c.results) AS r FROM (SELECT unnest(comment_generations) AS c FROM generated_scored)) WHERE r.scores IS NOT NULL AND code IS NOT NULL AND r.result_id IS NOT NULL").fetchall()
    return [(i, model, scores, dict(zip(code.METRICS, code.code_metrics(text), strict=True))) for i, model, scores, text in rows]


def _pearson(x, y):
    mx, my = statistics.fmean(x), statistics.fmean(y)
    return sum((a - mx) * (b - my) for a, b in zip(x, y, strict=True)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))


def _ranks(v):
    return [sum(b < a for b in v) + (v.count(a) + 1) / 2 for a in v]


def expect_correlations(rows, con):
    pairs = collections.defaultdict(list)
    for _, model, scores, metrics in _grid(con):
        for s, a in scores.items():
            for m, b in metrics.items():
                if a is not None and b is not None and a == a:
                    pairs[model, s, m].append((a, float(b)))
    assert {(r.model, r.metric, r.code_metric) for r in rows} == set(pairs)
    for r in rows:
        x, y = (list(v) for v in zip(*pairs[r.model, r.metric, r.code_metric], strict=True))
        assert r.n == len(x)
        if r.status == "ok":
            assert r.pearson_r == pytest.approx(_pearson(x, y), abs=1e-7) and r.spearman_r == pytest.approx(_pearson(_ranks(x), _ranks(y)), abs=1e-7)
            assert r.pearson_p_value == pytest.approx(udfs.correlation_p(r.pearson_r, r.n), abs=1e-6)


def expect_scatter(rows, con):
    want = {i for i, _, s, m in _grid(con) if all(v is not None and v == v for v in s.values()) and m["cognitive_complexity"] is not None and m["cyclomatic_complexity"] is not None}
    assert {r.result_id for r in rows} == want


def expect_matrix(rows, con):
    models = {model for _, model, s, _ in _grid(con) if any(v is not None and v == v for v in s.values())}
    assert len(rows) == len(models) * 42 and all(r.cell == "—" or float(r.cell.rstrip("*")) <= 1 for r in rows)


def expect_funnel(rows, con):
    r = rows[0]
    assert sum(r[f"n_{e}"] for e in pipelines.Filtered.EXITS) + r.num_files == r.raw_num_files == con.execute("SELECT count(DISTINCT file_id) FROM dataset").fetchone()[0]


def expect_targets(rows, con):
    stored = {(i, c["start_line"], c["end_line"]) for (i, _), c in _codes(con).items()}
    assert rows and {(r.file_id, r.start_line, r.end_line) for r in rows} <= stored


#: Every query without SQL is held against a computation of its own.
EXPECTED = {
    "txt6_prompt_tokens": expect_tokens, "agg8_token_stats": expect_token_stats, "agg10_context_tally": expect_context_tally, "code1_statuses": expect_statuses, "code3_complexity": expect_complexity, "agg14_correlations": expect_correlations,
    "viz2_scatter_points": expect_scatter, "viz3_matrix": expect_matrix, "e1_filter_funnel": expect_funnel, "e1_kept_targets": expect_targets,
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, con, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql:
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
        assert got == want
    else:
        EXPECTED[name](df.collect(), con)


def test_entry_without_the_optional_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['marginalia.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('p1') and k[1:2].isdigit() and '_found' in k for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def written(spark, folder, table, sql):
    spark.sql(sql).write.parquet(str(folder / f"{table}.parquet"))
    return str(folder)


def test_every_repository_is_reported(spark, tmp_path):
    d = written(spark, tmp_path, "dataset", "SELECT id AS file_id, concat('r', id % 35) AS repo_name FROM range(70) UNION ALL SELECT 1, 'r1' UNION ALL SELECT 70, 'r3'")
    rows = registry.queries()["agg18_items_per_repo"](spark, d).collect()
    assert len(rows) == 35 and tuple(rows[0]) == ("r3", 3) and {r.n_items for r in rows[1:]} == {2}


def test_missing_numbers_and_stride_know_no_fixed_end(spark, tmp_path):
    written(spark, tmp_path, "lineitem", "SELECT id AS l_orderkey FROM range(40000) WHERE id NOT IN (7, 15000, 39000) UNION ALL SELECT NULL")
    d = written(spark, tmp_path, "dataset", "SELECT id AS file_id FROM range(1000) UNION ALL SELECT 999 UNION ALL SELECT NULL")
    assert sorted(r.task_id for r in registry.queries()["set2_missing"](spark, d).collect()) == [7, 15000, 39000]
    assert sorted(map(tuple, registry.queries()["part2_stride"](spark, d).collect())) == [(0, 334), (1, 333), (2, 333)]


def test_comment_changes_count_a_doubled_row_once(spark, tmp_path):
    row = "'a.py' AS new_path, 'MODIFY' AS change_type, 'm' AS commit_message, '# kept\\n# new\\nx = 1\\n\\n# more\\ny = 2\\n' AS source_code, 'x = 1\\ny = 2\\n' AS previous_source_code"
    bad = row.replace("'# kept", "'x = \"\"\"").replace("AS source_code", "AS source_code", 1)
    d = written(spark, tmp_path, "dataset", f"SELECT 1L AS file_id, {row} UNION ALL SELECT 1L, {row} UNION ALL SELECT 2L, {row} UNION ALL SELECT 3L, {bad}")
    got = {r.file_id: r for r in registry.queries()["code1_statuses"](spark, d).collect()}
    assert len(got) == 3 and got[1][1:] == got[2][1:] and got[1].n_added > 0 and not got[1].parse_error
    assert tuple(got[3])[1:] == (True, 0, 0, 0, 0)
