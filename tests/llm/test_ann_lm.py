"""Nearest neighbours against brute force; language-model scores against brute counts and exact sums."""

import math
import zlib
from collections import Counter

import numpy as np

from tarnlake.llm import ann, lm


def brute_neighbours(ids, x, k=20):
    out = {}
    for i, q in zip(ids, x, strict=True):
        if i % 20 == 0:
            s = x @ q
            order = sorted((-a, j) for j, a in zip(ids, s, strict=True) if j != i)[:k]
            out[i] = [(j, -a) for a, j in order]
    return out


def test_recall_and_exact_scores(spark):
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    want = brute_neighbours(ids, x)
    got = {}
    for r in ann.op3_ann(spark, d).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    at = {i: k for k, i in enumerate(ids)}
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1)) and [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        assert all(math.isclose(f[2], float(x[at[q]] @ x[at[f[1]]]), rel_tol=1e-9, abs_tol=1e-12) for f in found)
        hits += len({f[1] for f in found} & {j for j, _ in want[q]})
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_neighbour_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 2.0]), (1, [1.0, 0.0, 2.0]), (2, None), (3, [0.0, 0.0, 0.0]), (20, [1.0, None, 1.0]), (40, [nan, 1.0, 1.0]), (60, [inf, 1.0, 1.0]), (80, [-1.0, 1.0, 0.5]), (5, []), (6, [1.0]), (1, [1.0, 0.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, list string")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [tuple(r) for r in ann.op3_ann(spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 1, 5.0), (0, 3, 80, 0.0), (80, 1, 0, 0.0), (80, 2, 1, 0.0), (80, 3, 1, 0.0)]
    df.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert ann.op3_ann(spark, f"{tmp_path}/none").count() == 0


def tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def check_scores(rows, got):
    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if held(i) is False for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    key = lambda r: str(r[:3])
    for a, b in zip(sorted(want, key=key), sorted((tuple(r)[:6] for r in got), key=key), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_scores(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = lm.op2_lm_score(spark, sf).collect()
    check_scores(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_edges(spark):
    rows = [(1, None), (2, ""), (3, "The cat\x1cx É é"), (None, "the"), (3, "The cat\x1cx É é"), (4, "w " * 30000), (36, "unseen")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, held string")
    check_scores(rows, lm.score_texts(df, lm.crc_mod(10) == 0).collect())
    assert lm.score_texts(df.limit(0), lm.crc_mod(10) == 0).count() == 0
    check_scores(rows[-1:], lm.score_texts(df.filter("doc_id = 36"), lm.F.lit(zlib.crc32(b"36") % 10 == 0)).collect())


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 90, lm.SYMBOLS)
    net = lm.Network.start(counts)
    sym = rng.integers(0, lm.SYMBOLS, 4000).astype(np.int32)
    begin = np.array([0, 1000, 1001, 1003])
    one, two = lm.contexts(sym, begin)
    assert one[1001] == two[1001] == lm.SYMBOLS and (one[1002], two[1002]) == (sym[1001], lm.SYMBOLS) and (one[1003], two[1004]) == (lm.SYMBOLS, lm.SYMBOLS) and two[2000] == sym[1998]
    net.train(iter([((one, two), sym)]), counts)
    net = lm.Network.load(net.dump())
    table = np.full((lm.SYMBOLS + 1) ** 2, np.nan, np.float32)
    every = np.arange(lm.SYMBOLS, dtype=np.int32)
    for a, b in ((5, 7), (lm.SYMBOLS, lm.SYMBOLS), (0, lm.SYMBOLS)):
        p = net.log_probabilities((np.full(lm.SYMBOLS, a, np.int32), np.full(lm.SYMBOLS, b, np.int32)), every, table)
        assert math.isclose(float(np.exp(p.astype(float)).sum()), 1, abs_tol=1e-3)


def test_scores_by_brute_force(spark, monkeypatch):
    """The column score: each token's probability by a full softmax over all symbols, and its share of its class."""
    rng = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "éa") for b in ("n", "st", "ng", "")] + ["The", "END"]
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 30)))) for k in range(60)] + [(77, None), (78, "neverseen ka")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.append(train(*a)) or kept[-1])
    got = {r.doc_id: r for r in lm.score_texts(df, lm.crc_mod(10) == 0).collect()}
    p = kept[0].p
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    top = {w: k + 1 for k, (w, _) in enumerate(sorted(((w, n) for w, n in c.items() if w), key=lambda x: (-x[1], x[0]))[: lm.WORDS])}
    symbol = lambda w: 0 if not w else top.get(w) or 1 + lm.WORDS + zlib.crc32(w[-2:]) % lm.CLASSES
    n_class, v_class = Counter(), Counter()
    for w, n in c.items():
        n_class[symbol(w)] += n
        v_class[symbol(w)] += 1
    for i, t in rows:
        want, before = 0.0, (lm.SYMBOLS, lm.SYMBOLS)
        for w in tokens(t):
            k = symbol(w)
            z = (p["q"][before[0]] * p["s"][0] + p["q"][before[1]] * p["s"][1]).astype(float) @ p["r"].T.astype(float) + p["b"].astype(float)
            want += (z[k] - np.log(np.exp(z - z.max()).sum()) - z.max()) / math.log(10)
            if k > lm.WORDS:
                want += math.log10((c[w] + 0.1) / (n_class[k] + 0.1 * (v_class[k] + 1)))
            before = (k, before[0])
        assert math.isclose(got[i].score, want, rel_tol=1e-4, abs_tol=1e-3), i


def test_noise_is_each_round_and_tasks_own():
    counts = np.full(lm.SYMBOLS, 5)
    sym = np.arange(lm.SYMBOLS, dtype=np.int32)
    one = (np.full(lm.SYMBOLS, 3, np.int32), np.full(lm.SYMBOLS, 4, np.int32))
    nets = []
    for seed in ((0, 1), (0, 1), (0, 2), (1, 1)):
        net = lm.Network.start(counts)
        net.train(iter([(one, sym)]), counts, seed)
        nets.append(net.dump())
    assert nets[0] == nets[1] and len(set(nets)) == 3
