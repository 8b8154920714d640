import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text
from marginalia.functions.udfs import bleu_counts, bleu_score, correlation_p, rouge_l, unwrap_text


def run(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", expr.alias("out")).orderBy("i").collect()]


def test_normalize_fixtures(spark):
    got = run(spark, ["#  Foo   bar\n  ## baz ", "x = 1  # keep", "#\n#", "", None], text.normalize_comment("v"))
    assert got == ["Foo bar baz", "x = 1 # keep", "", "", None]


def test_normalize_agrees_with_plain_python(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("# ab\t\n\r\x0b\x0c\x1c\u00a0\u2028.") for _ in range(rng.randint(0, 30))) for _ in range(400)]

    def model(t):
        return " ".join(" ".join(ln.strip().lstrip("#") for ln in t.splitlines()).split())

    assert run(spark, values, text.normalize_comment("v")) == [model(v) for v in values]


DIRECTIVES = ["# noqa: E501", "# TODO_later", "# type: ignore", "#!/usr/bin/env python", "# %% cell", "# decoding: foo", "## FIXME now", "# plain\n# noqa"]
PLAIN = ["# noqable", "# type : x", "# Types: a", "x # noqa", "", "#"]


def test_directives(spark):
    assert run(spark, DIRECTIVES + PLAIN, text.is_directive("v")) == [True] * len(DIRECTIVES) + [False] * len(PLAIN)


def test_separators(spark):
    assert run(spark, ["# -----", "# _____", "# ----", "#####", "# --=--=--", "# - - - - -", "!!!!!"], text.is_separator("v")) == [True, True, False, False, False, False, True]


def test_ascii_and_letters(spark):
    assert run(spark, ["# a\n", "# é", "# 12"], text.is_ascii("v")) == [True, False, True]
    assert run(spark, ["# a\n", "# é", "# 12"], text.has_letter("v")) == [True, True, False]


def test_failure_reasons(spark):
    got = run(spark, [None, "", "CUDA error 12.5 at  0x7f\nmore", "e" * 90, " \n", "\n x 1"], text.failure_reason("v"))
    assert got == [text.MISSING_ERROR, text.BLANK_ERROR, "CUDA error N at NxNf", "e" * 80 + "...", text.BLANK_ERROR, "x N"]


def test_clean_tags(spark):
    assert run(spark, [[" Foo  Bar ", "foo bar", "", "X"], [], None], text.clean_tags("v"), "array<string>") == [["foo-bar", "x"], [], None]


WRAPPED = {
    "```python\n# a\n```": "# a", "<comment>\n# a\n</comment>": "# a", "<comment>\n```\n# b\n```\n</comment>": "# b",
    "<a>x</b>": "<a>x</b>", "``` # a ```": "``` # a ```", "": "", "  # c \n": "# c",
}


def test_unwrap(spark):
    assert [unwrap_text(w) for w in WRAPPED] == list(WRAPPED.values())
    assert run(spark, list(WRAPPED), text.unwrap("v")) == list(WRAPPED.values())


def test_template_replaces_in_order(spark):
    out = run(spark, ["{b}"], text.fill_template("{a}-{b}", a=F.col("v"), b=F.lit("z")))
    assert out == ["z-z"]


def test_bleu_and_rouge():
    match, possible, p, r = bleu_counts("the cat sat", "the cat sat down")
    assert [round(bleu_score(match, possible, p, r, n), 10) for n in (1, 2, 3, 4)] == [0.7165313106] * 3 + [0.0]
    assert rouge_l("the cat sat", "the cat sat down") == pytest.approx(6 / 7)
    assert rouge_l("a b c", "a b c") == 1.0


def test_rouge_against_a_table():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        n = rows[-1][-1]
        want = 2 * n / (len(a) + len(b)) if n else 0.0
        assert rouge_l(" ".join(a), " ".join(b)) == pytest.approx(want)


def test_correlation_probability():
    assert correlation_p(0.5, 5) == pytest.approx(0.3910022190, abs=1e-9)
    assert correlation_p(0.3, 2) == 1.0
    assert correlation_p(1.0, 9) == 0.0
    assert correlation_p(None, 9) is None
    assert correlation_p(0.0, 30) == pytest.approx(1.0)


def test_strip_is_unicode(spark):
    values = ["\u00a0a\u2003", "\x1c b \x1f", "c"]
    assert run(spark, values, text.strip("v")) == [re.sub(r"\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\Z", "", v) for v in values]
