"""Repeated passages against brute force over all strings of SPAN bytes."""

import hashlib
import random
from collections import Counter

import pytest

from tarnlake.llm import suffix


def brute(rows):
    n = suffix.SPAN
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + n] for t in texts for k in range(len(t) - n + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if seen[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [1024, 3])
def test_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "FILE_BYTES", 20_000)
    monkeypatch.setattr(suffix, "PART_BYTES", 6_000)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["an", "er", "é", "st", "ou"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (25, 30, 45, 60, 120)]
    rows = [(1, None), (2, ""), (3, "x" * 199), (4, "x" * 200), (5, "y" * 201), (None, "z" * 900), (6, "ab" * 300)]
    for k in range(40):
        t = text(rng.randint(5, 120))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            c = rng.randrange(len(s) // 2)
            p = rng.randrange(len(t))
            t = t[:p] + s[c : c + rng.randint(150, 700)] + t[p:]
        rows.append((10 + k, t))
    rows += [(60, rows[-1][1]), (61, rows[-1][1]), (61, rows[-1][1]), (70, shared[4] + " " + shared[4])]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, file string").repartition(3)
    got = suffix.remove_repeats(df).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, suffix.op10_suffix_dedup(spark, sf).collect()), key=str) == brute(rows)
