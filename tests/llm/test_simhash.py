"""Fingerprints and classes against all-pairs brute force."""

import random

import xxhash

from tarnlake.llm import simhash
from tarnlake.llm.common import written


def brute_fp(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows):
    root = {f: f for _, f in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    low = {}
    for i, f in rows:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return [(i, low.get(find(f))) for i, f in rows]


def key(rows):
    return sorted(((-1 if i is None else i), c if c is not None else -1) for i, c in rows)


def test_fingerprints(spark):
    rows = [(1, None), (2, ""), (3, "One"), (4, "ONE two"), (5, "a b c"), (6, "É a  b\tc\nd \x0b e É"), (7, " ".join(f"w{k % 700}" for k in range(30000))), (7, "x\x1cy x")]
    got = simhash.fingerprints(spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, fp string")).collect()
    assert [(r.doc_id, r.fp & (1 << 64) - 1) for r in got] == [(i, brute_fp(t)) for i, t in rows]


def test_classes_with_chains_crowds_and_copies(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    chain = [rng.getrandbits(64)]
    for _ in range(60):
        x = chain[-1]
        for b in rng.sample(range(64), 3):
            x ^= 1 << b
        chain.append(x)
    center = rng.getrandbits(64)
    crowd = []
    for _ in range(120):
        x = center
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        crowd.append(x)
    rows = list(enumerate(fps + chain[::-1] + crowd + [crowd[0]] * 40 + [0, 0, 7, (1 << 64) - 1]))
    rng.shuffle(rows)
    rows.append((None, crowd[3]))
    rows.append((None, 0x5555AAAA5555AAAA))
    df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in rows], "doc_id long, fp long")
    got = df.join(simhash.classes(written(df, "t")), "fp", "left").collect()
    assert key((r.doc_id, r.component_id) for r in got) == key(brute_classes(rows))
    assert simhash.classes(df.limit(0)).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, brute_fp(r.text)) for r in docs.collect()]
    got = simhash.op6_simhash(spark, sf).collect()
    assert key((r.doc_id, r.component_id) for r in got) == key(brute_classes(rows))
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in rows}
