"""What built-in expressions cannot say: Arrow-batched functions on whole columns."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCED = re.compile(r"```[^\n]*\n(.*?)\n?```", re.S)
_TAGGED = re.compile(r"<([A-Za-z][\w-]*)(?:\s[^>]*)?>(.*)</\1>", re.S)


def unwrap_text(text: str) -> str:
    """STR-2 without a limit: peels fences, then tags, until nothing changes."""
    text = text.strip()
    while m := _FENCED.fullmatch(text) or _TAGGED.fullmatch(text):
        text = m.group(m.lastindex).strip()
    return text


@F.pandas_udf(T.StringType())
def unwrap_all(text: pd.Series) -> pd.Series:
    return text.map(unwrap_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def item_id(repo: pd.Series, path: pd.Series, commit: pd.Series, kind: pd.Series, start: pd.Series, end: pd.Series, model: pd.Series) -> pd.Series:
    """STR-6: the first 16 hex digits of the SHA-1 of the key as a JSON list."""

    def one(*key):
        key = [None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else int(v) if isinstance(v, float) else v for v in key]
        return hashlib.sha1(json.dumps(key, ensure_ascii=False).encode()).hexdigest()[:16]

    return pd.Series([one(*k) for k in zip(repo, path, commit, kind, start, end, model, strict=True)])


# ---- text metrics, by their published definitions

_SPLIT = [
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
]


def bleu_tokens(text: str) -> list[str]:
    """mteval-13a: punctuation apart, except between digits."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(a, b)
    text = f" {text} "
    for pattern, by in _SPLIT:
        text = pattern.sub(by, text)
    return text.split()


def bleu_counts(prediction: str, reference: str, orders: int = 4) -> tuple[list[int], list[int], int, int]:
    """Clipped matches and possible n-grams by order, and both lengths: what corpus BLEU adds up."""
    p, r = bleu_tokens(prediction), bleu_tokens(reference)
    match, possible = [], []
    for n in range(1, orders + 1):
        mine = Counter(zip(*(p[k:] for k in range(n))))
        theirs = Counter(zip(*(r[k:] for k in range(n))))
        match.append(sum((mine & theirs).values()))
        possible.append(max(0, len(p) - n + 1))
    return match, possible, len(p), len(r)


def bleu_score(match, possible, p_len: int, r_len: int, order: int) -> float:
    """Geometric mean of the precisions times the brevity penalty, without smoothing."""
    if not p_len or any(m == 0 or n == 0 for m, n in zip(match[:order], possible[:order], strict=True)):
        return 0.0
    mean = math.exp(sum(math.log(m / n) for m, n in zip(match[:order], possible[:order], strict=True)) / order)
    return mean * (1.0 if p_len > r_len else math.exp(1 - r_len / p_len))


def rouge_l(prediction: str, reference: str) -> float:
    """F1 of the longest common subsequence of lower-case alphanumeric tokens."""
    p = re.sub(r"[^a-z0-9]+", " ", prediction.lower()).split()
    r = re.sub(r"[^a-z0-9]+", " ", reference.lower()).split()
    if not p or not r:
        return 0.0
    # bit-parallel longest common subsequence: one big integer holds a row of the table
    masks: dict[str, int] = {}
    for k, w in enumerate(r):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(r)) - 1
    row = full
    for w in p:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    common = len(r) - bin(row).count("1")
    if not common:
        return 0.0
    precision, recall = common / len(p), common / len(r)
    return 2 * precision * recall / (precision + recall)


_BLEU = ("bleu1", "bleu2", "bleu3", "bleu4", "rougeL")
_PAIR_SCORES = T.StructType([*(T.StructField(n, T.DoubleType()) for n in _BLEU), *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("match", "possible")), *(T.StructField(n, T.IntegerType()) for n in ("p_len", "r_len"))])


@F.pandas_udf(_PAIR_SCORES)
def pair_scores(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """TXT-1 and TXT-2 of each pair, with the counts AGG-13 adds up; null where either side is null or empty."""
    rows = []
    for p, r in zip(prediction, reference, strict=True):
        if not p or not r:
            rows.append((None,) * 9)
            continue
        match, possible, a, b = bleu_counts(p, r)
        rows.append((*(bleu_score(match, possible, a, b, n) for n in range(1, 5)), rouge_l(p, r), match, possible, a, b))
    return pd.DataFrame(rows, columns=_PAIR_SCORES.names).astype({"p_len": "Int32", "r_len": "Int32"})


# ---- probability of a correlation


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom; 1 for two points."""
    if r is None or n < 2:
        return None
    if n == 2:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def external_scores(scorer):
    """TXT-3, TXT-4: a column function of prediction and reference; ``scorer`` is called once per worker's stream.

    It returns a function of two lists of texts that gives one score, or none, for each pair.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        rate = None
        for predictions, references in batches:
            out = pd.Series([None] * len(predictions), dtype="float64")
            at = [i for i, (p, r) in enumerate(zip(predictions, references, strict=True)) if p and r]
            if at:
                rate = rate or scorer()
                got = list(rate([predictions.iloc[i] for i in at], [references.iloc[i] for i in at]))
                if len(got) != len(at):
                    raise ValueError(f"{len(got)} scores for {len(at)} pairs")
                out.iloc[at] = [math.nan if x is None else float(x) for x in got]
            yield out

    return F.pandas_udf(run, T.DoubleType())


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else correlation_p(float(a), int(b)) for a, b in zip(r, n, strict=True)], dtype="float64")
