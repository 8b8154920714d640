"""Problem 3: near-duplicate files, all pairs whose shingle similarity is at least a threshold.

The method (``by="pivots"``, query ``p3_method``): every distinct shingle set has a parity fingerprint, whose Hamming
distances never exceed the sets' own, and a row in the pivot table: its distances to PIVOTS reference fingerprints.
Sets are ordered by their distance to the empty fingerprint; blocks of that order within reach of each other propose
their pairs from the table, pairs with too great a difference in any coordinate are discarded (triangle inequality,
without loss), and survivors are verified by fingerprint and then on the whole sets.

Unrelated files of like size are about as far from any reference as each other, unless the reference is a near copy of
one of them; so the table alone leaves a share of all pairs that grows with the square of the files.  ``by="prefix"``,
behind ``p3_found`` and the other queries, therefore proposes pairs by an exact prefix join: shingles are ordered by how
often they occur, and two sets that are similar enough must share ``k`` of the rarest ``n - ceil(t n) + k`` shingles of
each (``k`` at most ``MEETINGS``).  Every index row carries the first JOIN_PIVOTS distances, by which pairs are discarded
as above.

Scale: texts are read once; shingle sets are written and read from there.  Exact copies collapse to one representative
first, pairs of copies are expanded in blocks.  The order comes from a count sketch and files are picked by Bloom
filters, both sized from the counted input up to a fixed most; beyond it the sketch's mean load is taken off its counts,
and files are picked by joins.  A frequent shingle is spread over a grid of block pairs, so no task gets a hot bucket
whole.

Defined cases: null ids or texts, files under ``min_chars`` code points and files under three words have no
pairs; rows delivered twice count once; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.plans.session import checkpoint_dir, cut, widen

from .common import sources, table

WIDTH = 3
PERCENT = 65
MIN_CHARS = 200
# Counters of the sketch: as many as bring LOAD shingles to each, within these powers of two (32 MB at most).
LOAD, LEAST_BITS, MOST_BITS = 16, 16, 24
BLOOM_BITS_EACH, MOST_BLOOM_BITS = 16, 29  # bits per id, and of a whole filter (64 MB)
BLOCK = 1 << 16
MERGE_AT_ONCE = 64
FINGERPRINT_WORDS = 64  # 4096 bits
PIVOTS, JOIN_PIVOTS = 64, 8
PIVOT_BLOCK, PIVOT_STEP = 4096, 128
COPIES_BLOCK = 500
HOT, HOT_BLOCK = 5000, 2500
MEETINGS = 12

_WORD = re.compile(r"[A-Za-z0-9_]+")
_U = np.uint64
_M1, _M2, _M3, _M4 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93)


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_HASH = _WordHash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _M4
    return x ^ (x >> _U(29))


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` consecutive words, case ignored."""
    words = " ".join(_WORD.findall(text)).lower().split(" ")
    n = len(words) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = _mix(h * _M1 + ids[k : k + n] * (_M2 if k % 2 else _M3) + _U(k))
    return np.unique(h)


def _fingerprint(sh: np.ndarray) -> np.ndarray:
    """Parity of the set's members in each of 4096 cells; its Hamming distances never exceed the sets' own."""
    cells = np.bincount((sh & _U(FINGERPRINT_WORDS * 64 - 1)).astype(np.int64), minlength=FINGERPRINT_WORDS * 64) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.uint64)


def _set_id(sh: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(sh.tobytes())


def _bloom_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = _mix(ids.astype(np.uint64) * _M1 + _M2)
    return np.stack([(h >> _U(s)) & _U((1 << bits) - 1) for s in (0, 20, 40)])


class Bloom:
    """A Bloom filter of fixed size over 64-bit ids; false positives only cost work."""

    def __init__(self, bits: int, cells: np.ndarray) -> None:
        self.bits, self.cells = bits, cells

    def holds(self, ids: np.ndarray) -> np.ndarray:
        """Whether each id may be among those of the filter."""
        return self.cells[_bloom_slots(ids, self.bits).astype(np.int64)].all(axis=0)

    @classmethod
    def of(cls, ids: DataFrame, n: int) -> Bloom | None:
        """For ``n`` ids, built block by block on the executors; none where its size would pass the most."""
        bits = max(BLOCK.bit_length() + 2, (BLOOM_BITS_EACH * max(n, 1)).bit_length())
        if bits > MOST_BLOOM_BITS:
            return None
        column = ids.columns[0]

        def partial(batches):
            cells = np.zeros(1 << bits, np.bool_)
            for pdf in batches:
                cells[_bloom_slots(pdf[column].to_numpy(), bits).ravel().astype(np.int64)] = True
            yield from _blocks(np.packbits(cells), BLOCK)

        cells = np.zeros((1 << bits) // 8, np.uint8)
        for row in _merge(ids.mapInPandas(partial, "block int, data binary"), "or").collect():
            part = np.frombuffer(row.data, np.uint8)
            cells[row.block * BLOCK : row.block * BLOCK + len(part)] = part
        return cls(bits, np.unpackbits(cells).astype(np.bool_))


def _blocks(values: np.ndarray, size: int):
    import pandas as pd

    for k in range(0, len(values), size):
        part = values[k : k + size]
        if part.any():
            yield pd.DataFrame({"block": np.array([k // size], np.int32), "data": [zlib.compress(part.tobytes(), 1)]})


def _merge(blocks: DataFrame, how: str) -> DataFrame:
    """Blocks of partial bit maps or counts combined; many partitions are combined in two steps."""

    def combine(last: bool):
        def run(pdf):
            import pandas as pd

            if how == "or":
                total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(d), np.uint8) for d in pdf["data"]])
            else:
                total = np.zeros(BLOCK, np.int64)
                for d in pdf["data"]:
                    total += np.frombuffer(zlib.decompress(d), np.int32)
                total = np.minimum(total, 2**31 - 1).astype(np.int32)
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "data": [total.tobytes() if last else zlib.compress(total.tobytes(), 1)]})

        return run

    parts = blocks.rdd.getNumPartitions()
    if parts > MERGE_AT_ONCE:
        salted = blocks.withColumn("salt", F.spark_partition_id() % F.lit(math.isqrt(parts)))
        blocks = salted.groupBy("block", "salt").applyInPandas(lambda pdf: combine(False)(pdf), "block int, data binary")
    return blocks.groupBy("block").applyInPandas(combine(True), "block int, data binary")


def _sets(batches, min_chars: int, width: int):
    """(file_id, set_id, n, sh) of every file with enough text."""
    import pyarrow as pa

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(i, sh) for i, text in zip(ids, texts, strict=True) if len(text) >= min_chars and len(sh := shingles(text, width))]
        columns = [pa.array([i for i, _ in rows], pa.int64()), pa.array([_set_id(sh) for _, sh in rows], pa.binary()), pa.array([len(sh) for _, sh in rows], pa.int32()), pa.array([sh.tobytes() for _, sh in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["file_id", "set_id", "n", "sh"])


def _survey(batches, bits: int):
    """Counts of this partition's shingles by block of the sketch, and its candidates for references."""
    import pyarrow as pa

    counts = np.zeros(1 << bits, np.int32)
    pivots: dict[bytes, bytes] = {}
    for batch in batches:
        for sid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sh = np.frombuffer(data, np.uint64)
            np.add.at(counts, _slot(sh, bits), 1)
            if len(pivots) < PIVOTS or sid < max(pivots):
                pivots[sid] = _fingerprint(sh).tobytes()
                if len(pivots) > PIVOTS:
                    del pivots[max(pivots)]
    rows = []
    for k in range(0, 1 << bits, BLOCK):
        part = counts[k : k + BLOCK]
        if part.any():
            rows.append((k // BLOCK, zlib.compress(part.tobytes(), 1)))
    rows += [(-1, sid + fp) for sid, fp in pivots.items()]
    for k in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + 64]], pa.int32()), pa.array([r[1] for r in rows[k : k + 64]], pa.binary())], names=["block", "data"])


class Sketch:
    """How often shingles occur at most, and how often about.

    ``load`` is the mean of a counter: what it holds of other shingles.  Under LOAD times two, counts are taken as they
    are; beyond, the load is taken off, so that only what is really frequent looks so.
    """

    def __init__(self, counts: np.ndarray, total: int) -> None:
        self.bits = len(counts).bit_length() - 1
        self.load = total / len(counts)
        self.exact = self.load <= 2 * LOAD
        self.counts = np.minimum(counts if self.exact else np.maximum(counts - int(self.load), 0), 65535).astype(np.uint16)
        self.hot = HOT if self.exact else HOT + 6 * math.isqrt(int(self.load))
        self.hot_block = HOT_BLOCK

    def of(self, sh: np.ndarray) -> np.ndarray:
        return self.counts[_slot(sh, self.bits)].astype(np.int64)


def _slot(sh: np.ndarray, bits: int) -> np.ndarray:
    return (sh >> _U(64 - bits)).astype(np.int64)


def _prefix_rows(file_id: int, sh: np.ndarray, sketch: Sketch, pivots: np.ndarray, percent: int):
    """Index rows (key, rep, n, side, piv) of one set as columns."""
    n = len(sh)
    c = sketch.of(sh)
    needed = -(-percent * n // 100)
    keep = n - needed + min(MEETINGS, needed)
    order = np.lexsort((sh, c))[:keep]
    if sketch.exact:
        order = order[c[order] > 1]  # counted once: no other file has it
    if not len(order):
        return None
    token, count = sh[order], c[order]
    piv = np.bitwise_count(_fingerprint(sh) ^ pivots).sum(axis=1).astype(np.uint16).tobytes()
    key, side = token.view(np.int64), np.zeros(len(token), np.int8)
    hot = np.flatnonzero(count > sketch.hot)
    if len(hot):
        keys, sides = [np.delete(key, hot)], [np.delete(side, hot)]
        for k in hot:
            grid = -(-int(count[k]) // sketch.hot_block)
            own = xxhash.xxh3_64_intdigest(file_id.to_bytes(8, "little", signed=True)) % grid
            other = np.arange(grid, dtype=np.int64)
            low, high = np.minimum(own, other), np.maximum(own, other)
            with np.errstate(over="ignore"):
                cell = _mix(token[k] + _mix((low.astype(np.uint64) << _U(32)) + high.astype(np.uint64) + _M1) * _M2)
            keys.append(cell.view(np.int64))
            sides.append(np.where(low == high, 0, np.where(low == own, 1, 2)).astype(np.int8))
        key, side = np.concatenate(keys), np.concatenate(sides)
    return key, file_id, n, side, piv


_INDEX = "key long, rep long, n int, side byte, piv binary"


def _index(batches, sketch, pivots, percent: int):
    """Index rows of sets; batches hold file_id and shingles."""
    import pyarrow as pa

    names = ["key", "rep", "n", "side", "piv"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int8()]
    for batch in batches:
        sets = ((i, np.frombuffer(sh, np.uint64)) for i, sh in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        parts = [r for r in (_prefix_rows(i, sh, sketch.value, pivots, percent) for i, sh in sets) if r]
        for k in range(0, len(parts), 500):
            some = parts[k : k + 500]
            sizes = [len(r[0]) for r in some]
            columns = [np.concatenate([r[0] for r in some]), np.repeat([r[1] for r in some], sizes), np.repeat([r[2] for r in some], sizes), np.concatenate([r[3] for r in some])]
            piv = pa.array([r[4] for r in some], pa.binary()).take(pa.array(np.repeat(np.arange(len(some)), sizes)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), piv], names=names)


def _pairs(batches, percent: int):
    """Candidate pairs of each key; rows come sorted by key, and a key may go on in the next batch."""
    import pyarrow as pa

    rest = None
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        columns.append(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint16).reshape(-1, JOIN_PIVOTS).astype(np.int32))
        if rest is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(rest, columns, strict=True)]
        key = columns[0]
        done = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
        rest = [c[done:] for c in columns]
        yield from _emit([c[:done] for c in columns], percent, pa)
    if rest is not None:
        yield from _emit(rest, percent, pa)


def _emit(columns, percent: int, pa):
    key, rep, n, side, piv = columns
    at, step = np.arange(len(key)), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        i, j = at, at + step
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (rep[i] != rep[j]) & (100 * low.astype(np.int64) >= percent * high.astype(np.int64))
        ok &= ((side[i] == 0) & (side[j] == 0)) | (side[i] + side[j] == 3)
        i, j = i[ok], j[ok]
        far = (100 - percent) * (n[i].astype(np.int64) + n[j]) // (100 + percent)
        near = np.abs(piv[i] - piv[j]).max(axis=1, initial=0) <= far
        i, j = i[near], j[near]
        if len(i):
            need = np.minimum(MEETINGS, -(-percent * np.minimum(n[i], n[j]).astype(np.int64) // 100)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j])), pa.array(need)], names=["a", "b", "need"])
        step += 1


def _distances(batches, references: np.ndarray):
    """(rep, n, d, fp, piv): size, distance to the empty fingerprint, fingerprint and row of the pivot table."""
    import pyarrow as pa

    for batch in batches:
        prints = [_fingerprint(np.frombuffer(sh, np.uint64)) for sh in batch.column(1).to_pylist()]
        sizes = [len(sh) // 8 for sh in batch.column(1).to_pylist()]
        rows = [np.bitwise_count(fp ^ references).sum(axis=1).astype(np.uint16).tobytes() for fp in prints]
        columns = [batch.column(0), pa.array(sizes, pa.int32()), pa.array([int(np.bitwise_count(fp).sum()) for fp in prints], pa.int32()), pa.array([fp.tobytes() for fp in prints], pa.binary()), pa.array(rows, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["rep", "n", "d", "fp", "piv"])


def _within_reach(percent: int):
    """Pairs of one cell, which holds one block or two, that neither the pivot table nor the fingerprints discard."""

    def run(pdf):
        import pandas as pd

        low = pdf["block"].to_numpy() == pdf["low"].to_numpy()
        same = bool((pdf["low"] == pdf["high"]).all())
        side = [np.flatnonzero(low), np.flatnonzero(~low) if not same else np.flatnonzero(low)]
        piv = np.frombuffer(b"".join(pdf["piv"]), np.uint16).reshape(-1, PIVOTS).astype(np.int16)
        fps = np.frombuffer(b"".join(pdf["fp"]), np.uint64).reshape(-1, FINGERPRINT_WORDS)
        d, n, rep = pdf["d"].to_numpy().astype(np.int16), pdf["n"].to_numpy().astype(np.int64), pdf["rep"].to_numpy()
        out = []
        b = side[1]
        for k in range(0, len(side[0]), PIVOT_STEP):
            a = side[0][k : k + PIVOT_STEP]
            far = (100 - percent) * (n[a][:, None] + n[b][None, :]) // (100 + percent)
            ok = 100 * np.minimum(n[a][:, None], n[b][None, :]) >= percent * np.maximum(n[a][:, None], n[b][None, :])
            ok &= np.abs(d[a][:, None] - d[b][None, :]) <= far
            if same:
                ok &= a[:, None] < b[None, :]
            i, j = np.nonzero(ok)
            reach = far[i, j]
            for p in range(0, PIVOTS, 8):  # coordinates in groups, each on what the last one left
                kept = np.abs(piv[a[i], p : p + 8] - piv[b[j], p : p + 8]).max(axis=1, initial=0) <= reach
                i, j, reach = i[kept], j[kept], reach[kept]
            for at in range(0, len(i), 1 << 15):
                x, y = a[i[at : at + (1 << 15)]], b[j[at : at + (1 << 15)]]
                near = np.bitwise_count(fps[x] ^ fps[y]).sum(axis=1, dtype=np.int64) <= reach[at : at + (1 << 15)]
                out.append((np.minimum(rep[x[near]], rep[y[near]]), np.maximum(rep[x[near]], rep[y[near]])))
        if not out:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        return pd.DataFrame({"a": np.concatenate([x for x, _ in out]), "b": np.concatenate([y for _, y in out])})

    return run


def _by_pivots(reps: DataFrame, references: np.ndarray, percent: int, n_sets: int, folder: str) -> DataFrame:
    """(a, b): the pairs that survive the pivot table and the fingerprints; ``reps`` has file_id and sh of each set once."""
    spark = reps.sparkSession
    table_of = reps.mapInArrow(lambda b: _distances(b, references), "rep long, n int, d int, fp binary, piv binary")
    blocks = max(1, -(-n_sets // PIVOT_BLOCK))
    table_of.repartitionByRange(blocks, "d", "rep").withColumn("block", F.spark_partition_id()).write.parquet(f"{folder}/pivots")
    rows = spark.read.schema("rep long, n int, d int, fp binary, piv binary, block int").parquet(f"{folder}/pivots")
    ends = rows.groupBy("block").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.max("n").alias("most"))
    far = F.expr(f"(x.most + y.most) * {100 - percent} div {100 + percent}")
    cells = ends.alias("x").join(ends.alias("y"), (F.col("x.block") <= F.col("y.block")) & (F.col("y.first") - F.col("x.last") <= far))
    cells = cells.select(F.col("x.block").alias("low"), F.col("y.block").alias("high"))  # one row for each PIVOT_BLOCK sets and block in reach
    placed = cells.withColumn("block", F.explode(F.array_distinct(F.array("low", "high")))).join(rows, "block")
    return placed.groupBy("low", "high").applyInPandas(_within_reach(percent), "a long, b long")


def _verify(batches, percent: int):
    import pyarrow as pa

    for batch in batches:
        a, b, sa, sb = (batch.column(k).to_pylist() for k in range(4))
        out = []
        for x, y, s, t in zip(a, b, sa, sb, strict=True):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            shared = len(np.intersect1d(s, t, assume_unique=True))
            union = len(s) + len(t) - shared
            if 100 * shared >= percent * union:
                out.append((x, y, shared / union))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["a", "b", "similarity"])


class NearCopies:
    """``links`` are the similar pairs of representatives, ``members`` gives every file's representative."""

    def __init__(self, members: DataFrame, links: DataFrame) -> None:
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """(file_id_a, file_id_b), smaller first: every pair, exact copies included.

        A class of many copies is cut into blocks, so that no task gets all pairs of a class.
        """
        blocks = F.ceil(F.col("copies") / COPIES_BLOCK).cast("int")
        m = self.members.select("file_id", "rep", F.pmod(F.xxhash64("file_id"), blocks).cast("int").alias("block"), blocks.alias("blocks"), "copies")
        classes = m.where("file_id = rep").select("rep", "blocks")
        links = self.links.select("a", "b").join(classes.toDF("a", "n"), "a").join(classes.toDF("b", "k"), "b")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        links = links.withColumn("i", F.explode(every("n"))).withColumn("j", F.explode(every("k")))
        across = links.join(m.select(F.col("rep").alias("a"), F.col("block").alias("i"), F.col("file_id").alias("file_a")), ["a", "i"])
        across = across.join(m.select(F.col("rep").alias("b"), F.col("block").alias("j"), F.col("file_id").alias("file_b")), ["b", "j"]).select("file_a", "file_b")
        copies = m.where("copies > 1")
        left = copies.select("rep", F.col("block").alias("i"), F.explode(every("blocks")).alias("j"), F.col("file_id").alias("file_a"))
        right = copies.select("rep", F.explode(every("blocks")).alias("i"), F.col("block").alias("j"), F.col("file_id").alias("file_b"))
        within = left.join(right, ["rep", "i", "j"]).where("file_a < file_b").select("file_a", "file_b")
        both = across.unionByName(within)
        return both.select(F.least("file_a", "file_b").alias("file_id_a"), F.greatest("file_a", "file_b").alias("file_id_b"))

    def per_file(self) -> DataFrame:
        """(file_id, class_id, n_copies, n_links): its class of exact copies and how many other classes are similar."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n"))
        return self.members.join(ends, "rep", "left").select("file_id", F.col("rep").alias("class_id"), F.col("copies").alias("n_copies"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))

    def groups(self) -> DataFrame:
        """(file_id, group_id): connected components of the links; alone, a file is its own group."""
        labels = components(self.links.select("a", "b"))
        return self.members.join(labels, F.col("rep") == F.col("node"), "left").select("file_id", F.coalesce("label", "rep").alias("group_id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component; minimum labels, doubled by pointer jumping."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.toDF("b", "other"), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("m"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", "m").alias("new"))
        jump = step.join(step.select(F.col("node").alias("new"), F.col("new").alias("far")), "new", "left")
        nxt = cut(jump.select("node", F.least("new", F.coalesce("far", "new")).alias("new"), "label"))
        if nxt.where("new <> label").isEmpty():
            return nxt.select("node", "label")
        labels = nxt.select("node", F.col("new").alias("label"))


def near_copies(dataset: DataFrame, percent: int = PERCENT, width: int = WIDTH, min_chars: int = MIN_CHARS, by: str = "prefix") -> NearCopies:
    """All files that are similar: shared runs of ``width`` words over all runs of both, at least ``percent`` / 100."""
    spark = dataset.sparkSession
    folder = f"{checkpoint_dir(spark)}/near-copies-{uuid.uuid4().hex}"
    texts = widen(sources(dataset).select("file_id", "source_code").where(F.length("source_code") >= min_chars))
    texts.mapInArrow(lambda b: _sets(b, min_chars, width), "file_id long, set_id binary, n int, sh binary").write.parquet(f"{folder}/sets")
    sets = spark.read.schema("file_id long, set_id binary, n int, sh binary").parquet(f"{folder}/sets")

    # which sets recur, and who stands for them
    rows = sets.select("file_id", "set_id")
    classes = rows.groupBy("set_id").agg(F.min("file_id").alias("rep"), F.count("*").alias("delivered"))
    members = cut(rows.distinct().join(classes, "set_id").select("file_id", "rep", "delivered"))
    repeated = members.where("delivered > 1").select("file_id", "rep")
    pairs_of = members.groupBy("rep").agg(F.count("*").alias("copies"))
    members_of = members.join(pairs_of, "rep").select("file_id", "rep", "copies")
    size = sets.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    n_repeated = repeated.count()
    several = Bloom.of(repeated.select("file_id"), n_repeated)
    picked = spark.sparkContext.broadcast(several)  # MOST_BLOOM_BITS at most

    # the sketch and the references
    bits = min(MOST_BITS, max(LEAST_BITS, int(size.n / LOAD).bit_length()))
    surveyed = sets.select("set_id", "sh").mapInArrow(lambda b: _survey(b, bits), "block int, data binary")
    surveyed.write.parquet(f"{folder}/survey")
    surveyed = spark.read.schema("block int, data binary").parquet(f"{folder}/survey")
    firsts = [r.data for r in surveyed.where("block = -1").select("data").distinct().orderBy("data").limit(PIVOTS).collect()]
    references = np.zeros((PIVOTS, FINGERPRINT_WORDS), np.uint64)
    for k, row in enumerate(firsts):
        references[k] = np.frombuffer(row[16:], np.uint64)

    # one row for each set: files that are surely the only ones with theirs, and the representatives of the others
    def of_several(batches, wanted: bool):
        import pyarrow as pa

        for batch in batches:
            held = picked.value
            if held is not None:
                yield batch.filter(pa.array(_mask_of(held, batch) == wanted))
            elif wanted:
                yield batch

    alone = sets.select("file_id", "sh").mapInArrow(lambda b: of_several(b, False), "file_id long, sh binary")
    again = sets.select("file_id", "sh").mapInArrow(lambda b: of_several(b, True), "file_id long, sh binary").dropDuplicates(["file_id"])
    again = again.join(repeated.where("file_id <> rep").select("file_id"), "file_id", "left_anti").select("file_id", "sh")

    if by == "pivots":
        reps = alone.unionByName(again)
        met = _by_pivots(reps, references, percent, size.n_rows, folder)
    else:
        counts = np.zeros(1 << bits, np.int32)
        for row in _merge(surveyed.where("block >= 0"), "add").collect():
            counts[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.data, np.int32)
        sketch = spark.sparkContext.broadcast(Sketch(counts, size.n))  # MOST_BITS at most
        few = references[:JOIN_PIVOTS]
        indexed = lambda df: df.mapInArrow(lambda b: _index(b, sketch, few, percent), _INDEX)
        index = indexed(alone).unionByName(indexed(again))  # apart, so that what is alone flows on without an exchange
        met = index.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _pairs(b, percent), "a long, b long, need int")
        met = met.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("need").alias("need")).where("met >= need").select("a", "b")
    met.write.parquet(f"{folder}/pairs")
    candidates = spark.read.schema("a long, b long").parquet(f"{folder}/pairs")

    # whole sets of both
    ends = candidates.select(F.explode(F.array("a", "b")).alias("file_id")).distinct()
    wanted = spark.sparkContext.broadcast(Bloom.of(ends, ends.count()))

    def of_pairs(batches):
        import pyarrow as pa

        for batch in batches:
            held = wanted.value
            yield batch if held is None else batch.filter(pa.array(_mask_of(held, batch)))

    kept = sets.select("file_id", "sh").mapInArrow(of_pairs, "file_id long, sh binary").dropDuplicates(["file_id"])
    both = candidates.join(kept.toDF("a", "sa"), "a").join(kept.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    links = cut(both.mapInArrow(lambda b: _verify(b, percent), "a long, b long, similarity double"))
    return NearCopies(members_of, links)


def _mask_of(bloom: Bloom, batch) -> np.ndarray:
    """Which rows of a batch have an id that the filter may hold."""
    return bloom.holds(batch.column(0).to_numpy(zero_copy_only=False))


def p3_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id_a, file_id_b): the pairs by the pivot table alone."""
    return near_copies(table(spark, sf_dir, "dataset"), by="pivots").pairs()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "dataset")).pairs()


def p3_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "dataset")).per_file()


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "dataset")).groups()


def p3_five_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with runs of five words and a similarity of 0.8."""
    return near_copies(table(spark, sf_dir, "dataset"), percent=80, width=5).per_file()


QUERIES = {"p3_method": p3_method, "p3_found": p3_found, "p3_files": p3_files, "p3_groups": p3_groups, "p3_five_words": p3_five_words}

ORACLE = {
    "p3_found": """WITH f AS (SELECT DISTINCT ON (file_id) file_id, source_code FROM dataset WHERE length(source_code) >= 200),
w AS (SELECT file_id, list_transform(regexp_extract_all(source_code, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM f),
s AS (SELECT DISTINCT file_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT file_id, count(*) AS n FROM s GROUP BY file_id),
p AS (SELECT a.file_id AS a, b.file_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.file_id < b.file_id GROUP BY ALL)
SELECT p.a AS file_id_a, p.b AS file_id_b FROM p JOIN n x ON x.file_id = p.a JOIN n y ON y.file_id = p.b WHERE 100 * k >= 65 * (x.n + y.n - k)"""
}
ORACLE["p3_method"] = ORACLE["p3_found"]
