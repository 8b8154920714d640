"""Problem 9: filling fixed-capacity containers with documents measured in tokens.

Documents are spread over groups by a hash; each group is packed by best-fit decreasing.  Dual feasible functions
give a lower bound that certifies a group's number of containers.  Groups with a gap release the documents of their
containers with more than ``SPARE`` of their room unused, exchange them with other such groups and pack again; the
result is taken only where it needs fewer containers.  The same bound over all sizes certifies the whole.

Defined cases: a document longer than the capacity is cut into full pieces and a rest; null and empty texts take no
room and get no container; capacities that are null or not positive are left out.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.session import cut

from .common import table
from .p08_tokens import TOKENIZERS, encode

GROUP = 4096
ROUNDS = 4
MERGE = 8
SPARE = 0.03

_ITEMS = "window_name string, capacity int, grp long, doc_id long, piece int, n_tokens int, container string, certified boolean"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The container of each item and how many there are; every item fits the capacity."""
    order = np.argsort(-sizes, kind="stable")
    rooms: list[int] = []  # sorted rooms that some open container has
    by_room: dict[int, list[int]] = {}
    where = np.empty(len(sizes), np.int64)
    count = 0
    for i in order:
        size = int(sizes[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            k, room = count, capacity
            count += 1
        else:
            room = rooms[at]
            k = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        where[i] = k
        left = room - size
        if left:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(k)
    return where, count


def lower_bound(sizes: np.ndarray, capacity: int, weights: np.ndarray | None = None) -> int:
    """The greatest bound of two families of dual feasible functions; ``weights`` counts equal sizes."""
    w = np.ones(len(sizes), np.int64) if weights is None else weights.astype(np.int64)
    if not len(sizes):
        return 0
    s = sizes.astype(np.int64)
    counts = np.bincount(s, weights=w, minlength=capacity + 1).astype(np.int64)
    mass = np.cumsum(counts * np.arange(capacity + 1))
    number = np.cumsum(counts)
    best = -(-int(mass[-1]) // capacity)
    k = np.arange(1, capacity // 2 + 1)  # sizes above C - k count whole, those under k not at all
    total = (number[-1] - number[capacity - k]) * capacity + mass[capacity - k] - mass[k - 1]
    if len(k):
        best = max(best, int((-(-total // capacity)).max()))
    sizes_present = np.flatnonzero(counts)
    for j in range(1, 41):  # rounding to j-ths of the capacity
        scaled = (j + 1) * sizes_present
        exact = scaled % capacity == 0
        value = np.where(exact, j * sizes_present, (scaled // capacity) * capacity)
        best = max(best, -(-int((value * counts[sizes_present]).sum()) // (j * capacity)))
    return best


def _pack(pdf: pd.DataFrame, label: str) -> pd.DataFrame:
    """Packs one group; keeps what it had if that needs no more containers."""
    if not len(pdf):
        return pdf
    capacity = int(pdf["capacity"].iloc[0])
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    sizes = pdf["n_tokens"].to_numpy()
    where, count = best_fit_decreasing(sizes, capacity)
    had = pdf["container"].nunique() if pdf["container"].notna().all() else None
    if had is None or count < had:
        prefix = f"{pdf['window_name'].iloc[0]}/{label}/{pdf['grp'].iloc[0]}/"
        pdf["container"] = [prefix + str(k) for k in where]
    count = count if had is None else min(count, had)
    pdf["certified"] = count == lower_bound(sizes, capacity)
    return pdf


def _packer(label: int):
    return lambda pdf: _pack(pdf, str(label))


def pieces(counts: DataFrame, windows: DataFrame) -> DataFrame:
    """(window_name, capacity, doc_id, piece, n_tokens): what has to be placed, for each capacity."""
    w = windows.where("capacity > 0").select("window_name", "capacity")
    rows = counts.where("n_tokens > 0").crossJoin(F.broadcast(w))  # context_windows is a fixed parameter table
    number = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int")
    rows = rows.select("window_name", "capacity", "doc_id", F.posexplode(F.sequence(F.lit(1), number)).alias("piece", "one"), F.col("n_tokens").alias("whole"))
    size = F.least(F.col("capacity").cast("long"), F.col("whole") - F.col("piece").cast("long") * F.col("capacity")).cast("int")
    return rows.select("window_name", "capacity", "doc_id", "piece", size.alias("n_tokens"))


def pack(counts: DataFrame, windows: DataFrame, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """(window_name, capacity, doc_id, piece, n_tokens, container): every piece with its container."""
    todo = cut(pieces(counts, windows))
    full = todo.where("n_tokens = capacity").withColumn("container", F.concat_ws("/", "window_name", F.lit("full"), "doc_id", "piece"))
    rest = todo.where("n_tokens < capacity")
    groups = max(1, -(-rest.groupBy("window_name").count().agg(F.max("count")).collect()[0][0] // group) if not rest.isEmpty() else 1)
    items = rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))).select(
        "window_name", "capacity", "grp", "doc_id", "piece", "n_tokens", F.lit(None).cast("string").alias("container"), F.lit(False).alias("certified")
    )
    packed = cut(items.groupBy("window_name", "grp").applyInPandas(_packer(0), _ITEMS))
    done = []
    for k in range(1, rounds):
        if groups == 1:
            break
        room = packed.groupBy("window_name", "container").agg(F.sum("n_tokens").alias("used"), F.max("capacity").alias("capacity"), F.max("certified").alias("certified"))
        loose = room.where(~F.col("certified") & (F.col("used") < (1 - SPARE) * F.col("capacity"))).select("window_name", "container")
        kept = packed.join(loose, ["window_name", "container"], "left_anti")
        moved = packed.join(loose, ["window_name", "container"], "left_semi")
        done.append(kept)
        groups = -(-groups // MERGE)
        moved = moved.withColumn("grp", F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(groups))).select(*_ITEMS_COLUMNS)
        packed = cut(moved.groupBy("window_name", "grp").applyInPandas(_packer(k), _ITEMS))
    out = packed
    for part in done:
        out = out.unionByName(part.select(*_ITEMS_COLUMNS))
    columns = ["window_name", "capacity", "doc_id", "piece", "n_tokens", "container"]
    return full.select(*columns).unionByName(out.select(*columns))


_ITEMS_COLUMNS = [c.split()[0] for c in _ITEMS.split(", ")]


def summary(packed: DataFrame) -> DataFrame:
    """(window_name, capacity, n_items, n_tokens, n_containers, lower_bound, unused_share)."""

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        least = lower_bound(pdf["n_tokens"].to_numpy(), int(pdf["capacity"].iloc[0]), pdf["n"].to_numpy())
        return pd.DataFrame({"window_name": pdf["window_name"].iloc[:1], "lower_bound": [least]})

    sizes = packed.groupBy("window_name", "capacity", "n_tokens").agg(F.count("*").alias("n"))  # at most capacity rows a window
    bounds = sizes.groupBy("window_name").applyInPandas(bound, "window_name string, lower_bound long")
    used = packed.groupBy("window_name", "capacity", "container").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("used"))
    total = used.groupBy("window_name", "capacity").agg(F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"), F.count("*").alias("n_containers"))
    share = F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6)
    return total.join(bounds, "window_name").withColumn("unused_share", share)


def p9_containers(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    return pack(encode(table(spark, sf_dir, "documents"), tokenizers, ids=False), table(spark, sf_dir, "context_windows"))


def p9_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(p9_containers(spark, sf_dir))


QUERIES = {"p9_containers": p9_containers, "p9_summary": p9_summary}
