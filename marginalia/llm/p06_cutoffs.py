"""Problem 6: the score cut-off per model and metric that keeps a target share of the results.

Every target's convex pinball loss is minimised by cutting planes.  A pass over all rows aggregates, for each part
of the line between the points asked, count, sum and both extremes; that gives the loss and its two subgradients at
every point.  The tangents at the ends of the bracket make the model of the loss: its minimiser, where they meet, is
the next point, and the model's level sets between its minimum and the best loss so far give six more, so that a
pass narrows the bracket from both sides.  The ends need no look of their own: a tangent holds until the neighbouring
score, to which the end snaps.  A pass brings a handful of numbers per target to the driver; it ends when a score is
proven to be the wanted order statistic.

Defined cases: a null or empty model counts as ``<unknown>``; null and NaN scores and null ids are left out;
results delivered twice count once; a target without results has a null cut-off and keeps none; ties are kept
whole; keep_pct 0 keeps the lowest score.
"""

from __future__ import annotations

import math
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.session import checkpoint_dir

from .common import table

METRICS = ("bleu1", "bleu2", "bleu3", "bleu4", "rougeL", "bertscore_f1")
MAX_TARGETS = 100_000
UNKNOWN = "<unknown>"
LARGEST = sys.float_info.max
LEVELS = (0.1, 0.3, 0.6)  # of the way from the model's minimum to the best loss seen
POINTS = 1 + 2 * len(LEVELS)


def scored_results(generated: DataFrame) -> DataFrame:
    """(result_id, model, scores) of each result once."""
    result = generated.select(F.explode("comment_generations").alias("c")).select(F.explode("c.results").alias("r"))
    model = F.when(F.coalesce(F.col("r.model"), F.lit("")) == "", UNKNOWN).otherwise(F.col("r.model"))
    rows = result.select(F.col("r.result_id").alias("result_id"), model.alias("model"), F.col("r.scores").alias("scores"))
    return rows.where(F.col("result_id").isNotNull() & F.col("scores").isNotNull()).dropDuplicates(["result_id"])


def _targets(keep_targets: DataFrame) -> list[tuple[int, str, str, int]]:
    rows = keep_targets.select("model", "metric", "keep_pct").dropna().orderBy("model", "metric", "keep_pct").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    return [(k, r.model or UNKNOWN, r.metric, r.keep_pct) for k, r in enumerate(rows)]


class _Bracket:
    """What is known of one target: the wanted rank, and the scores between which it lies.

    ``left`` and ``right`` hold an end of the bracket, the loss there and the slope towards the inside.
    """

    def __init__(self, n: int, low: float, high: float, total: float, percent: int) -> None:
        self.n, self.tau, self.total = n, percent / 100, total
        self.rank = max(1, -(-percent * n // 100))
        self.cutoff: float | None = None
        self.kept = self.passes = 0
        self._narrow(0, 0.0, n, total, low, high)

    def _narrow(self, below: int, sum_below: float, count: int, total: float, least: float, greatest: float) -> None:
        """The wanted score is one of ``count`` between ``least`` and ``greatest``."""
        if self.rank == below + count or least == greatest:
            self.cutoff, self.kept = greatest, below + count
            return
        self.below, self.under = below, sum_below
        ends = []
        for q, n, under in ((least, below, sum_below), (greatest, below + count, sum_below + total)):
            loss = (1 - self.tau) * (q * n - under) + self.tau * (self.total - under - q * (self.n - n))
            ends.append((q, loss, (1 - self.tau) * n - self.tau * (self.n - n)))
        self.left, self.right = ends

    def points(self) -> list[float]:
        """Where to look next: where the ends' tangents meet, and the model's level sets around it."""
        (a, fa, ga), (b, fb, gb) = self.left, self.right
        if not (math.isfinite(a) and math.isfinite(b)):
            return [-LARGEST] + [LARGEST] * (POINTS - 1)
        least = (fa - fb + gb * b - ga * a) / (gb - ga)
        floor = fa + ga * (least - a)
        levels = [floor + share * (min(fa, fb) - floor) for share in LEVELS]
        out = [least, *(a + (v - fa) / ga for v in levels if ga < 0), *(b + (v - fb) / gb for v in levels if gb > 0)]
        out = sorted({q for q in out if a <= q <= b}) or [a / 2 + b / 2]  # sums that overflow give no tangents
        return out + out[-1:] * (POINTS - len(out))

    def learn(self, parts: dict[int, tuple[int, float, float, float]]) -> None:
        """``parts`` has count, sum, least and greatest of the bracket's scores in each part that has any: 2k lies before point k, 2k + 1 on it."""
        self.passes += 1
        below, under = self.below, self.under
        for k in sorted(parts):
            count, total = parts[k][:2]
            if self.rank <= below + count:
                self._narrow(below, under, *parts[k])
                return
            below, under = below + count, under + total


def _finite_sum():
    return F.sum(F.when(F.abs("score") <= LARGEST, F.col("score")).otherwise(0.0))


def _part(n: int):
    """The part of the line in which ``score`` lies, for ``n`` points: parts before, on and behind each, in order."""
    s = F.col("score")
    return sum(((s > F.get("points", F.lit(k))).cast("int") + (s >= F.get("points", F.lit(k))).cast("int") for k in range(n)), F.lit(0))


def cutoffs(generated: DataFrame, keep_targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, metric, keep_pct, n_results, cutoff, n_kept) per target, and the rows (t, model, metric, result_id, score)."""
    spark = generated.sparkSession
    targets = _targets(keep_targets)
    wanted = [m for m in METRICS if any(m == t[2] for t in targets)]
    local = spark.createDataFrame(targets or [(-1, "", "", 0)], "t int, model string, metric string, keep_pct int")
    scores = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"scores.{m}").alias("score")) for m in wanted or METRICS))
    long = scored_results(generated).select("result_id", "model", F.inline(scores))
    long = long.where(F.col("score").isNotNull() & ~F.isnan("score"))
    rows = long.join(F.broadcast(local), ["model", "metric"]).select("t", "model", "metric", "result_id", "score")  # MAX_TARGETS rows at most
    folder = f"{checkpoint_dir(spark)}/cutoffs-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    rows = spark.read.schema("t int, model string, metric string, result_id long, score double").parquet(folder)

    ends = rows.groupBy("t").agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), _finite_sum().alias("total")).collect()
    state = {r.t: _Bracket(r.n, r.low, r.high, r.total, targets[r.t][3]) for r in ends}
    while asked := [(t, b.left[0], b.right[0], b.points()) for t, b in state.items() if b.cutoff is None]:
        at = F.broadcast(spark.createDataFrame(asked, "t int, low double, high double, points array<double>"))  # POINTS for each of MAX_TARGETS at most
        seen = rows.join(at, "t").where("score BETWEEN low AND high").select("t", "score", _part(POINTS).alias("part")).groupBy("t", "part")
        parts: dict[int, dict[int, tuple]] = {}
        for r in seen.agg(F.count("*"), _finite_sum(), F.min("score"), F.max("score")).collect():
            parts.setdefault(r[0], {})[r[1]] = tuple(r[2:])
        for t, *_ in asked:
            state[t].learn(parts[t])
    out = []
    for t, model, metric, percent in targets:
        b = state.get(t)
        out.append((t, model, metric, percent, b.n if b else 0, b.cutoff if b else None, b.kept if b else 0))
    return spark.createDataFrame(out, "t int, model string, metric string, keep_pct int, n_results long, cutoff double, n_kept long"), rows


def kept_results(generated: DataFrame, keep_targets: DataFrame) -> DataFrame:
    """(model, metric, result_id): every result at or below its target's cut-off."""
    found, rows = cutoffs(generated, keep_targets)
    return rows.join(F.broadcast(found.select("t", "cutoff")), "t").where("score <= cutoff").select("model", "metric", "result_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_results(table(spark, sf_dir, "generated_scored"), table(spark, sf_dir, "keep_targets"))


def p6_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoffs(table(spark, sf_dir, "generated_scored"), table(spark, sf_dir, "keep_targets"))[0].drop("t")


QUERIES = {"p6_found": p6_found, "p6_cutoffs": p6_cutoffs}

_SQL = """
WITH r AS (SELECT DISTINCT u.r.result_id AS result_id, u.r.model AS model, u.r.scores AS scores FROM (
       SELECT unnest(c.results) AS r FROM (SELECT unnest(comment_generations) AS c FROM generated_scored)) u),
one AS (SELECT result_id, CASE WHEN coalesce(model, '') = '' THEN '<unknown>' ELSE model END AS model, scores FROM r
        WHERE result_id IS NOT NULL AND scores IS NOT NULL),
long AS (SELECT result_id, model, 'bertscore_f1' AS metric, scores.bertscore_f1 AS score FROM one
         UNION ALL SELECT result_id, model, 'rougeL', scores."rougeL" FROM one),
ranked AS (SELECT t.model, t.metric, t.keep_pct, l.result_id, l.score,
             row_number() OVER (PARTITION BY t.model, t.metric, t.keep_pct ORDER BY l.score) AS k,
             count(*) OVER (PARTITION BY t.model, t.metric, t.keep_pct) AS n
           FROM keep_targets t JOIN long l USING (model, metric) WHERE l.score IS NOT NULL AND NOT isnan(l.score)),
cut AS (SELECT model, metric, keep_pct, n, score AS cutoff FROM ranked WHERE k = greatest(1, (keep_pct * n + 99) // 100))
"""
ORACLE = {
    "p6_found": _SQL + "SELECT DISTINCT r.model, r.metric, r.result_id FROM ranked r JOIN cut c USING (model, metric, keep_pct) WHERE r.score <= c.cutoff",
    "p6_cutoffs": _SQL + "SELECT r.model, r.metric, r.keep_pct, count(*) AS n_results, any_value(c.cutoff) AS cutoff, count(*) FILTER (WHERE r.score <= c.cutoff) AS n_kept "
    "FROM ranked r JOIN cut c USING (model, metric, keep_pct) GROUP BY ALL",
}
