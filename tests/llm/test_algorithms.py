"""Problems 3, 6, 8 and 9 against brute force, exact round trips and certified bounds."""

import random
import re

import numpy as np
import pytest

from marginalia.llm import p03_near_copies as p3
from marginalia.llm import p06_cutoffs as p6
from marginalia.llm import p08_tokens as p8
from marginalia.llm import p09_packing as p9

# ---- problem 3


def brute_pairs(texts, percent, width=3, least=200):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in re.findall("[A-Za-z0-9_]+", t or "")]
        runs = set(zip(*(w[k:] for k in range(width)), strict=False))
        if t and len(t) >= least and runs:
            sets[i] = runs
    out = set()
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                out.add((a, b))
    return out


def corpus(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = {}
    for g in range(n // 4):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        for k in range(4):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 6, 10, 14])):
                at = rng.randrange(len(words))
                rng.choice([lambda w=words, i=at: w.insert(i, "new"), lambda w=words, i=at: w.pop(i), lambda w=words, i=at: w.__setitem__(i, "X")])()
            texts[g * 10 + k] = " ".join(words)
    return texts


@pytest.mark.parametrize(("seed", "percent", "by"), [(1, 65, "prefix"), (2, 80, "prefix"), (1, 65, "pivots"), (5, 80, "pivots"), (1, 65, "saturated"), (2, 65, "joins")])
def test_all_pairs_are_found(spark, seed, percent, by, monkeypatch):
    texts = corpus(seed) | {900: None, 901: "", 902: "a b", 903: "short text under the limit", 904: "!" * 300}
    rows = [(i, t, "x") for i, t in texts.items()] + [(0, texts[0], "y"), (10, texts[10], "y")]
    df = spark.createDataFrame([(i, None, t, o) for i, t, o in rows] + [(None, None, texts[0], "z")], "file_id long, new_path string, source_code string, rep string").repartition(3)
    monkeypatch.setattr(p3, "HOT", 5)  # so that the grid of block pairs is used as well
    monkeypatch.setattr(p3, "HOT_BLOCK", 2)
    monkeypatch.setattr(p3, "PIVOT_BLOCK", 7)
    monkeypatch.setattr(p3, "COPIES_BLOCK", 2)
    monkeypatch.setattr(p3, "MERGE_AT_ONCE", 1)
    if by == "saturated":
        monkeypatch.setattr(p3, "LOAD", 0.001)
        monkeypatch.setattr(p3, "MOST_BITS", 16)
    if by == "joins":
        monkeypatch.setattr(p3, "MOST_BLOOM_BITS", 4)
    got = p3.near_copies(df, percent=percent, by="pivots" if by == "pivots" else "prefix")
    pairs = [(r.file_id_a, r.file_id_b) for r in got.pairs().collect()]
    want = brute_pairs(texts, percent)
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and want
    links = {r.file_id: r.n_links + r.n_copies - 1 for r in got.per_file().collect()}
    assert {i for i, n in links.items() if n} == {i for p in want for i in p}
    group = {r.file_id: r.group_id for r in got.groups().collect()}
    assert all(group[a] == group[b] for a, b in want)


def test_a_full_sketch_adds_no_index_rows():
    """With counters that hold millions of other shingles, a set keeps its prefix; only what is really frequent is spread."""
    rng = np.random.default_rng(2)
    load = 2_400_000
    counts = rng.poisson(load, 1 << 16).astype(np.int32)
    sh = np.unique(rng.integers(0, 2**63, 347).astype(np.uint64))
    often = sh[100]
    counts[p3._slot(np.array([often]), 16)[0]] += 500_000
    sketch = p3.Sketch(counts, int(counts.sum()))
    assert not sketch.exact
    pivots = np.zeros((p3.JOIN_PIVOTS, p3.FINGERPRINT_WORDS), np.uint64)
    rows = len(p3._prefix_rows(7, sh, sketch, pivots, 65)[0])
    prefix = len(sh) - -(-65 * len(sh) // 100) + p3.MEETINGS
    assert rows <= prefix  # the frequent shingle comes last in the order
    few = p3.Sketch(np.full(1 << 16, 2, np.int32), 2 << 16)
    assert few.exact and len(p3._prefix_rows(7, sh, few, pivots, 65)[0]) == prefix
    assert p3._prefix_rows(7, sh, p3.Sketch(np.ones(1 << 16, np.int32), 1 << 16), pivots, 65) is None


def test_classes_of_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(p3, "COPIES_BLOCK", 3)
    base = corpus(6)
    texts = {k: base[0] for k in range(25)} | {100 + k: base[1] for k in range(11)}
    df = spark.createDataFrame([(i, None, t) for i, t in texts.items()], "file_id long, new_path string, source_code string")
    got = [tuple(r) for r in p3.near_copies(df).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, 65)


def test_a_third_of_exact_copies(spark):
    texts = corpus(3) | {1000 + k: corpus(4)[0] for k in range(20)}
    df = spark.createDataFrame([(i, None, t) for i, t in texts.items()], "file_id long, new_path string, source_code string")
    assert {tuple(r) for r in p3.near_copies(df).pairs().collect()} == brute_pairs(texts, 65)


def test_no_files(spark):
    df = spark.createDataFrame([], "file_id long, new_path string, source_code string")
    got = p3.near_copies(df)
    assert got.pairs().collect() == [] and got.groups().collect() == [] and got.per_file().collect() == []


def test_fingerprints_never_exceed_the_sets_distance():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[: len(a) // 2], b]))
        h = int(np.bitwise_count(p3._fingerprint(a) ^ p3._fingerprint(b)).sum())
        assert h <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (103, 102)]
    got = {r.node: r.label for r in p3.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(31)} == {0} and got[101] == 100 and got[103] == 102


# ---- problem 6

SCORED = "file_id long, model string, comment_generations array<struct<results:array<struct<result_id:long,model:string,scores:struct<bleu1:double,bleu2:double,bleu3:double,bleu4:double,rougeL:double,bertscore_f1:double>>>>>"


@pytest.mark.parametrize("seed", range(4))
def test_cutoffs_against_sorting(spark, seed):
    rng = random.Random(seed)
    results, values = [], {}
    for k in range(300):
        model = rng.choice(["a", "b", None, ""])
        v = rng.choice([None, float("nan"), round(rng.random(), rng.choice([1, 2, 9])), 0.5, -1e9 if seed == 3 else 0.25])
        results.append((k, model, (None, None, None, None, v, 0.5)))
        if v is not None and v == v:
            values.setdefault(model or "<unknown>", []).append((v, k))
    df = spark.createDataFrame([(1, "x", [(results,), (None,)]), (1, "x", [(results,)]), (2, "x", None)], SCORED)
    targets = [(m, "rougeL", p) for m, p in zip(("a", "b", "<unknown>", "none"), (rng.randint(1, 99), 100, rng.choice([1, 50]), 10), strict=True)] + [("a", "bertscore_f1", 30)]
    t = spark.createDataFrame(targets, "model string, metric string, keep_pct int")
    found, _ = p6.cutoffs(df, t)
    kept = {tuple(r) for r in p6.kept_results(df, t).collect()}
    for r in found.collect():
        if r.metric == "rougeL" and r.model != "none":
            have = sorted(values[r.model])
            cutoff = have[max(1, -(-r.keep_pct * len(have) // 100)) - 1][0]
            assert (r.n_results, r.cutoff, r.n_kept) == (len(have), cutoff, sum(v <= cutoff for v, _ in have))
            assert {k for m, x, k in kept if (m, x) == (r.model, r.metric)} == {k for v, k in have if v <= cutoff}
        elif r.model == "none":
            assert (r.n_results, r.cutoff, r.n_kept) == (0, None, 0)
        else:
            assert r.cutoff == 0.5 and r.n_kept == r.n_results


def searched(values, percent):
    """Cut-off, kept number and passes of the search over one target, its aggregates taken with numpy."""
    finite = lambda v: float(v[np.isfinite(v)].sum())
    b = p6._Bracket(len(values), float(values.min()), float(values.max()), finite(values), percent)
    while b.cutoff is None:
        inside = values[(values >= b.left[0]) & (values <= b.right[0])]
        part = sum((inside > q).astype(int) + (inside >= q) for q in b.points())
        b.learn({int(k): (int((part == k).sum()), finite(inside[part == k]), float(inside[part == k].min()), float(inside[part == k].max())) for k in np.unique(part)})
        assert b.passes < 60
    return b.cutoff, b.kept, b.passes


@pytest.mark.parametrize("percent", [1, 20, 50, 90, 100])
@pytest.mark.parametrize("kind", ["normal", "lognormal", "pareto", "ties", "outliers", "infinite", "two values"])
def test_few_passes(kind, percent):
    rng = np.random.default_rng(5)
    v = rng.random(20_000)
    v = {
        "normal": rng.normal(size=20_000), "lognormal": rng.lognormal(0, 2, 20_000), "pareto": rng.pareto(0.5, 20_000), "ties": np.round(v, 2), "outliers": np.append(v, [1e12, -1e12]),
        "infinite": np.append(v, [np.inf, -np.inf]), "two values": (v > 0.3).astype(float),
    }[kind]
    cutoff, kept, passes = searched(v, percent)
    assert cutoff == np.sort(v)[max(1, -(-percent * len(v) // 100)) - 1] and kept == (v <= cutoff).sum() and passes <= 10


def test_the_next_point_minimises_the_model():
    """The tangents meet at the mean of the bracket's scores, and the loss there is no less than the model's."""
    v = np.random.default_rng(6).gamma(2.0, size=500)
    b = p6._Bracket(len(v), v.min(), v.max(), v.sum(), 30)
    (a, fa, ga), (c, fc, gc) = b.left, b.right
    meet = (fa - fc + gc * c - ga * a) / (gc - ga)
    loss = lambda q: float(np.where(v > q, 0.3 * (v - q), 0.7 * (q - v)).sum())
    assert meet == pytest.approx(v.mean()) and fa == pytest.approx(loss(a)) and fc == pytest.approx(loss(c))
    for q in np.linspace(v.min(), v.max(), 40):
        assert max(fa + ga * (q - a), fc + gc * (q - c)) <= loss(q) + 1e-9


def test_no_results_and_no_targets(spark):
    df = spark.createDataFrame([], SCORED)
    t = spark.createDataFrame([("a", "rougeL", 10)], "model string, metric string, keep_pct int")
    assert p6.kept_results(df, t).collect() == [] and p6.cutoffs(df, t.where("false"))[0].collect() == []


# ---- problem 8


def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, p8.read_vocabulary().splitlines())}
    return tiktoken.Encoding("own", pat_str=p8.PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library():
    rng = random.Random(7)
    pool = ["the ", "merge", "é", "日本", " \n", "  ", "'s", "<|endoftext|>", "\U0001f600", "123", "aaaa", "x_y.", "‍", "ไทย", "\t", "don't"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["a" * 5000, "ab" * 3000, " " * 999, "é" * 2000, ""]
    enc, own = reference(), p8.Encoder(p8.read_vocabulary())
    got = [[i for w in t for i in w] for t in own.batch(texts)]
    assert got == [enc.encode_ordinary(t) for t in texts]
    assert [enc.decode(g) for g in got] == texts


def test_p8_frames(spark):
    df = spark.createDataFrame([(1, "The lock <|endoftext|>", 9), (2, "", 9), (3, None, 9)], "doc_id long, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in p8.encode(df).collect()}
    assert got == {1: reference().encode_ordinary("The lock <|endoftext|>"), 2: [], 3: []}
    assert {r.doc_id: r.n_tokens for r in p8.encode(df, ids=False).collect()} == {k: len(v) for k, v in got.items()}
    assert p8.encode(df.where("false")).collect() == []


# ---- problem 9


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(5, 40)
        bins, sizes = rng.randint(1, 6), []
        for _ in range(bins):  # full bins cut at random: the optimum is known
            left = capacity
            while left:
                s = rng.randint(1, left)
                sizes.append(s)
                left -= s
        s = np.array(sizes)
        where, count = p9.best_fit_decreasing(s, capacity)
        assert p9.lower_bound(s, capacity) == bins <= count
        assert np.bincount(where, weights=s).max() <= capacity and len(set(where)) == count
    assert p9.lower_bound(np.array([6, 6, 6]), 10) == 3 and p9.lower_bound(np.array([], int), 10) == 0
    assert p9.lower_bound(np.array([4, 4, 4, 4, 4]), 10) == 3


def test_packing(spark):
    rng = random.Random(3)
    counts = [(k, rng.choice([0, 1, 3, 7, 20, 45, 100, 101, 250])) for k in range(600)]
    df = spark.createDataFrame(counts, "doc_id long, n_tokens long").repartition(3)
    windows = spark.createDataFrame([("w", 100), ("v", 50), ("bad", 0), (None, None)], "window_name string, capacity int")
    packed = p9.pack(df, windows, group=64)
    rows = packed.collect()
    for name, capacity in (("w", 100), ("v", 50)):
        mine = [r for r in rows if r.window_name == name]
        total, used = {}, {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            used[r.container] = used.get(r.container, 0) + r.n_tokens
            assert r.n_tokens == capacity or dict(counts)[r.doc_id] % capacity == r.n_tokens
        assert total == {k: n for k, n in counts if n} and max(used.values()) <= capacity
        assert len({(r.doc_id, r.piece) for r in mine}) == len(mine)
    for r in p9.summary(packed).collect():
        assert r.lower_bound <= r.n_containers <= 1.05 * r.lower_bound + 1
    assert {r.window_name for r in rows} == {"w", "v"}


def test_packing_nothing(spark):
    windows = spark.createDataFrame([("w", 100)], "window_name string, capacity int")
    assert p9.pack(spark.createDataFrame([(1, 0)], "doc_id long, n_tokens long"), windows).collect() == []
    assert p9.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), windows).collect() == []
