"""Contamination against brute force, on both join forms."""

import hashlib
import random
import re

import pytest

from tarnlake.llm import decontam


def brute(docs, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = [(str(i), tuple(w[k : k + 13])) for i, t in items for w in [cut(t)] if w for k in range(max(1, len(w) - 12))]
    out = []
    for i, t in docs:
        w, hit, names = cut(t), set(), set()
        for item, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit.update(range(k, k + len(g)))
                    names.add(item)
        said = ",".join(sorted(names))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(said.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_against_brute_force(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "Été", "x1", "B", "Çà"] + [f"r{k}" for k in range(40)])
    items = [(k, " ".join(word() for _ in range(rng.randint(14, 40)))) for k in range(12)] + [(50, "short Item of five words"), (51, ""), (52, None), (9, "the the the the the the the the the the the the the the"), (60, "short item, OF five words")]
    docs = [(1, None), (2, ""), (3, "... --"), (4, "The " * 30), (5, "a short ITEM of-five words b " + "z " * 400), (None, items[0][1])]
    for k in range(40):
        t = [word() for _ in range(rng.randint(5, 300))]
        if k % 3:
            s = items[rng.randrange(12)][1].split()
            a = rng.randrange(len(s))
            t[k % len(t) : k % len(t)] = s[a : a + rng.randint(8, 30)] * rng.randint(1, 3)
        docs.append((10 + k, rng.choice([" ", ", ", "\n"]).join(t)))
    docs.append(docs[-1])
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, w int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, decontam.op8_decontamination(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in decontam.contamination(docs, none).collect()] == [(2, 0, False)]
    assert decontam.contamination(docs.limit(0), none).count() == 0
