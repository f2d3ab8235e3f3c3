"""Neighbours within large groups of equal and nearly equal vectors, against brute force."""

import numpy as np

from tarnlake.llm import ann


def test_neighbours_in_groups_of_equal_and_near_vectors(spark, tmp_path):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(2, 16))
    x = np.concatenate([np.repeat(base[:1], 1500, axis=0), base[1] + 1e-4 * rng.normal(size=(1500, 16)), rng.normal(size=(1000, 16))])
    x = (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(len(x))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    vectors = ann.usable(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    index, table, sizes = ann.build(vectors)
    got = {}
    queries = table.filter("vec_id % 50 = 0").selectExpr("row", "vec_id AS query_id", "v")
    for r in ann.search(index, table, sizes, queries, probes=len(sizes)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits, near = 0, 0
    for i in range(0, len(x), 50):
        s = (x[i] * x).sum(axis=1)
        s[i] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20].tolist()
        if s[want[-1]] == s[want[0]]:  # within the group of equal vectors: ties to smaller ids, all of them
            assert got[i] == want
        hits, near = hits + len(set(got[i]) & set(want)), near + 20
    assert hits >= 0.95 * near


def table_of(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_rows_of_a_repeated_id_ask_and_answer_each(spark, tmp_path):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [1.0, 0.0]), (3, [0.9, 0.1]), (4, [0.1, 0.8])]
    got = [tuple(r) for r in ann.op3_ann(spark, table_of(spark, tmp_path, rows)).collect()]
    want = []
    for k, (q, v) in enumerate(rows):
        if q == 20:
            near = sorted((-(v[0] * w[0] + v[1] * w[1]), i) for j, (i, w) in enumerate(rows) if j != k)
            want += [(20, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    assert sorted(got) == sorted(want)


def test_all_candidates_where_the_first_lists_hold_too_few(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(60, 8)))]
    vectors = ann.usable(spark.read.parquet(f"{table_of(spark, tmp_path, rows)}/embeddings.parquet"))
    index, table, sizes = ann.build(vectors, lists=30)
    queries = table.filter("vec_id % 20 = 0").selectExpr("row", "vec_id AS query_id", "v")
    got = {}
    for r in ann.search(index, table, sizes, queries, probes=1).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: len(set(v) - {q}) for q, v in got.items()} == {0: 20, 20: 20, 40: 20}
    few = ann.search(index, table, sizes, queries, k=100, probes=1).collect()
    assert len(few) == 3 * 59


def test_recall_where_lists_are_skipped_and_few_are_scored(spark, tmp_path, monkeypatch):
    """Vectors in loose clusters: most lists are not visited, and a small share of all pairs is scored exactly."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 24))
    x = (centres[rng.integers(0, 300, 20_000)] + 0.45 * rng.normal(size=(20_000, 24)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = ann.usable(spark.read.parquet(f"{table_of(spark, tmp_path, [(i, v.tolist()) for i, v in enumerate(x)])}/embeddings.parquet"))
    index, table, sizes = ann.build(vectors)
    assert len(sizes) > 60 and index.wide < 0.5 * len(sizes)
    got = {}
    for r in ann.search(index, table, sizes, table.filter("vec_id % 200 = 0").selectExpr("row", "vec_id AS query_id", "v")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, len(x), 200):
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * len(got)
    at, codes, err = index.encode(x)
    q = x[::200]
    floor = index.floor(q, 20, index.probes(q, index.wide, np.array([sizes.get(i, 0) for i in range(len(index.coarse))]), 21))
    scored = 0
    for i in range(len(index.coarse)):  # vectors that a query would have scored exactly, of all
        m = at == i
        books = index.tables(q)
        approx = (index.pad(q) @ index.coarse[i])[:, None] + sum(books[:, k, :][:, codes[m, k]] for k in range(ann.SUBSPACES))
        scored += int((approx + err[m] >= floor[:, None]).sum())
    assert scored < 0.1 * len(q) * len(x)
