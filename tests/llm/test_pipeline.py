"""The pipeline: each stage on planted cases, and the whole against its stages."""

import random

import corpus_pipeline as P
from tarnlake.llm import quality, simhash
from tarnlake.llm.common import PIECES, written

D = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rk string"


def words(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else "".join(rng.choice(["an", "er", "st", "ou", "ti", "re"]) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def test_one_of_each_group_stays(spark):
    rng = random.Random(8)
    rows, groups = [], []
    for g in range(30):
        w = words(rng, rng.choice([150, 250, 400]))
        ids = []
        for k in range(rng.choice([1, 2, 5])):
            v = list(w)
            for _ in range((k > 1) * max(1, len(w) // 120)):  # the first two of a group are alike but for spaces
                v[rng.randrange(len(v))] = "edited"
            ids.append(len(rows))
            rows.append((len(rows), (" " if k % 2 else "\n").join(v), "en", "s", 1, "x"))
        groups.append(ids)
    n = len(rows)
    rows += [(n, None, None, None, None, None), (n + 1, "", "en", "s", 0, "x"), (None, rows[0][1], "en", "s", 1, "x"), (groups[1][0], rows[groups[1][0]][1], "en", "s", 1, "x")]
    got = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()]
    first, copies = {g[0] for g in groups} | {n}, {g[1] for g in groups if len(g) > 1} | {None, n + 1}
    edited = {i for g in groups for i in g[2:]}
    assert first <= set(got) and not copies & set(got) and len(set(got)) == len(got)
    assert len(edited & set(got)) <= 0.1 * len(edited)  # SimHash proposes nearly all pairs, not all
    assert simhash.keep_one(spark.createDataFrame([], COLUMNS)).count() == 0


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    want, now = docs.count(), docs
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    for name, stage in P.STAGES[:-1]:
        now = written(stage(spark, now, D), f"t-{name}")
        assert now.columns == docs.columns and 0 < now.count() <= want
        want = now.count()
        if name == "quality":
            left = {r.doc_id for r in now.collect()}
            bad, good = [i for i, q in labels.items() if not q], [i for i, q in labels.items() if q]
            assert sum(i not in left for i in bad) >= 0.95 * len(bad) and sum(i in left for i in good) >= 0.98 * len(good)
    pieces = P.STAGES[-1][1](spark, now, D).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in now.collect()}
    key = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows)
    total = lambda rows: sorted({(r.doc_id, r.doc_tokens) for r in rows})
    again = P.run(spark, D).collect()
    assert total(again) == total(pieces) and len(key(again)) >= len(total(again))


def test_pack_keeps_smaller_tables_than_op7(spark, monkeypatch):
    """By then near_dedup has filled the executors' heaps."""
    asked, pack = [], P.packing.pack_documents
    monkeypatch.setattr(P.packing, "pack_documents", lambda *a, **b: asked.append(b.get("known", PIECES)) or pack(*a, **b))
    assert P.STAGES[-1][1](spark, spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), D).count() == 1
    assert asked == [P.PACK_KNOWN] and PIECES >= 5 * P.PACK_KNOWN


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None, "x"), (None, "a b c", "en", "s", 5, "x"), (2, "", "en", "s", 0, "y"), (3, "token = abcdefgh " + "fine words here " * 20, "en", "s", 9, "z")]
    docs = spark.createDataFrame(rows, COLUMNS)
    for name, stage in P.STAGES:
        for d in (docs, docs.limit(0)):
            got = stage(spark, d, D)
            found = got.collect()
            if name == "pack":  # a row for each piece: the pieces of each document are all of its tokens
                assert {r.doc_id: r.doc_tokens for r in found} == {i: sum(r.length for r in found if r.doc_id == i) for i in {r.doc_id for r in found}}
                assert len({r.doc_id for r in found}) == d.count()
            else:
                assert got.columns == docs.columns and len(found) <= 4
    assert quality.keep_good(docs, quality.fit_rows([], quality.np.zeros(0))).count() == 4
