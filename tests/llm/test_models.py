"""Language identification and quality: exact identities, held-out accuracy and edge cases."""

import math
import zlib
from itertools import combinations
from collections import Counter

import numpy as np
import pytest

from tarnlake.llm import langid, quality


def brute_followers(docs, order, share):
    """For each context (bytes, up to `order`, those common enough) how often each byte follows it."""
    tree, size = {}, sum(map(len, docs))
    for t in docs:
        padded = bytes(order) + t
        for i in range(order, len(padded)):
            for d in range(order + 1):
                tree.setdefault(padded[i - d : i], Counter())[padded[i]] += 1
    return {c: n for c, n in tree.items() if sum(n.values()) * share >= size}


def brute_shares(tree, context):
    """The probability of every byte, by escapes from the longest context in the tree to shorter ones, without what those have seen."""
    while context and context not in tree:
        context = context[1:]
    seen = tree[context]
    inner = brute_shares(tree, context[1:]) if context else [1 / 256] * 256
    total = sum(seen.values()) + (0 if len(seen) == 256 else len(seen))
    left = sum(inner[b] for b in range(256) if b not in seen)
    return [seen[b] / total if b in seen else len(seen) / total * inner[b] / left for b in range(256)]


def brute_share(tree, context, byte):
    return brute_shares(tree, context)[byte]


def model_of(docs):
    counts = {}
    for d in range(langid.ORDER + 1):
        key, n = np.unique(langid.grams(docs)[0] & np.uint64((1 << 8 * (d + 1)) - 1), return_counts=True)
        context, which = np.unique(key >> np.uint64(8), return_inverse=True)
        keep = (np.bincount(which, weights=n) * langid.SHARE >= sum(map(len, docs)))[which]
        counts[d] = (key[keep], n[keep])
    return langid.Tree([counts[d] for d in range(langid.ORDER + 1)])


TEXTS = [b"abracadabra abra", "éa über".encode(), b"aa", b"", bytes(range(256)) * 2]


def test_code_lengths_by_walking_the_contexts(monkeypatch):
    monkeypatch.setattr(langid, "SHARE", 300)  # so that some contexts are in the tree and some are not
    tree, brute = model_of(TEXTS), brute_followers(TEXTS, langid.ORDER, 300)
    assert 0 < sum(len(c) == langid.ORDER for c in brute) < 400
    for text in (b"abra", b"xyz", "ü".encode(), b"\x00\xff", b"cadabra"):
        padded = bytes(langid.ORDER) + text
        want = [-math.log2(brute_share(brute, padded[i - langid.ORDER : i], padded[i])) for i in range(langid.ORDER, len(padded))]
        assert np.allclose(tree.lengths(langid.grams([text])[0]), want, rtol=1e-9)


def test_code_lengths_are_a_distribution():
    tree = model_of(TEXTS[:3])
    for context in (0, 0x61627261, 0x7A7A7A7A, 0x20616272):
        key = np.arange(256, dtype=np.uint64) | np.uint64(context << 8)
        assert math.isclose(np.exp2(-tree.lengths(key)).sum(), 1, rel_tol=1e-9)


def test_texts_are_coded_apart_and_tables_may_be_small(monkeypatch):
    trees = [model_of(TEXTS[:2]), model_of(TEXTS[2:])]
    alone = np.array([[t.lengths(langid.grams([x])[0]).sum() for t in trees] for x in TEXTS])
    monkeypatch.setattr(langid, "PART", 37)
    for power in (22, 1):
        costs = langid.Costs(trees)
        costs.power = power
        costs.keys, costs.bits = np.full(1 << power, (1 << 64) - 1, np.uint64), np.zeros((1 << power, 2), np.float32)
        for _ in range(2):
            assert np.allclose(langid.text_bits(TEXTS, costs), alone, rtol=1e-5)


def test_predictions_by_brute_force(spark):
    rng = np.random.default_rng(3)
    words = {"x": ["das", "und", "über", "nicht"], "y": ["the", "and", "over", "not"], "z": ["кот", "и", "над", "не"]}
    rows = [(k, " ".join(rng.choice(words[lang], 12)), lang) for k, lang in enumerate("xyzyx" * 5)] + [(90, "not und", None), (91, "кот the and", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    trees = {lang: brute_followers([t.encode() for _, t, x in rows if x == lang], langid.ORDER, langid.SHARE) for lang in "xyz"}
    for i, t, _ in rows[:6] + rows[-2:]:
        padded = bytes(langid.ORDER) + t.encode()
        bits = {x: -sum(math.log2(brute_share(tree, padded[j - langid.ORDER : j], padded[j])) for j in range(langid.ORDER, len(padded))) for x, tree in trees.items()}
        best = min(bits, key=bits.get)
        assert got[i].lang_pred == best and math.isclose(got[i].score, 1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel_tol=1e-4)


def test_language_id(spark, sf):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.op4_language_id(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(docs) and sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(spark):
    rows = [(1, "the cat sat", "en", 1), (2, "der hund lief über", "de", 1), (3, None, "en", 1), (4, "12 34 !", "de", 1), (5, "", None, 1), (None, "the dog", None, 1), (6, "über " * 20000, None, 1), (6, "Ж", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(docs, langid.fit(docs)).collect()]
    assert got[:7] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (6, "de")] and got[7][1] in ("en", "de")
    none = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), none).count() == 0


def test_pairwise_identity():
    rng = np.random.default_rng(2)
    dims = quality.WORDS + quality.STATS
    m = quality.Machine(0.3, rng.normal(size=dims), rng.normal(size=(dims, 3)), np.zeros(quality.STATS, np.float32), np.ones(quality.STATS, np.float32))
    rows = [(np.array([5, 9, 70], np.uint16), np.array([0.5, 0.2, 0.1], np.float32), rng.normal(size=quality.STATS).astype(np.float32) / 9), (np.zeros(0, np.uint16), np.zeros(0, np.float32), np.zeros(quality.STATS, np.float32))]
    for (i, v, s), got in zip(rows, m.scores(rows), strict=True):
        x = {**dict(zip(i.tolist(), v.astype(float), strict=True)), **{quality.WORDS + k: float(a) for k, a in enumerate(m.scaled(s))}}
        z = m.bias + sum(m.w[k] * a for k, a in x.items()) + sum(m.v[a] @ m.v[b] * x[a] * x[b] for a, b in combinations(x, 2))
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-6)


def brute_features(text):
    """Word buckets with their values, and the statistics, by their definitions."""
    raw = text.encode()
    words = raw.lower().split()
    counts = Counter(zlib.crc32(w) & 4095 for w in words)
    v = {b: math.log1p(n) for b, n in counts.items()}
    norm = max(1e-6, math.sqrt(sum(x * x for x in v.values())))
    signs = b".,&%$#*|!?<>/="

    def kind(b):
        if 97 <= b <= 122 or 65 <= b <= 90 or 48 <= b <= 57:
            return 0 if b >= 97 else 1 if b >= 65 else 2
        if b in b"\t \n\r":
            return 3 if b in b"\t " else 4
        return 5 + signs.index(b) if b in signs else 5 + len(signs) if b < 128 else 6 + len(signs)

    share = Counter(map(kind, raw))
    n, m, lines = max(1, len(raw)), max(1, len(words)), raw.split(b"\n")
    top = sorted(counts.values())[-3:] or [0]
    buckets = [zlib.crc32(w) & 4095 for w in words]
    stats = [share[k] / n for k in range(7 + len(signs))]
    stats += [math.log1p(len(raw)), math.log1p(len(words)), len(raw) / m / 10, len(set(words)) / m, top[-1] / m, sum(top) / m]
    stats += [sum(a == b for a, b in zip(buckets, buckets[1:])) / m, 1 - len(set(lines)) / len(lines), len(lines) / m]
    return {b: x / norm for b, x in v.items()}, stats


def test_quality_scores_by_brute_force(spark, sf):
    """The registered query's model on whole texts: every pair's product, one by one."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: (r.text or "")[:300] for r in docs.limit(12).collect()} | {-1: "", -2: "Ünï = <b>1</b>\n\n&&& &&& the the"}
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), machine).collect()}
    for i, t in texts.items():
        words, stats = brute_features(t)
        x = words | {quality.WORDS + k: min(4, max(-4, (s - machine.mean[k]) / machine.scale[k])) / 4 for k, s in enumerate(stats)}
        z = machine.bias + sum(machine.w[k] * a for k, a in x.items()) + sum(float(machine.v[a] @ machine.v[b]) * x[a] * x[b] for a, b in combinations(x, 2))
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-3, abs_tol=1e-6), (i, got[i], 1 / (1 + math.exp(-z)))


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in quality.op5_quality(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("labels", [[], [(1, 1), (2, 1)], [(1, None), (None, 0)]])
def test_quality_edges(spark, labels):
    docs = spark.createDataFrame([(1, "a b", 1), (2, None, 1), (3, "", 1), (None, "x " * 90000, 1), (1, "a b", 1)], "doc_id long, text string, score int")
    m = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = [r.score for r in quality.score(docs, m).collect()]
    assert len(got) == 5 and all(0 <= x <= 1 for x in got)
    assert quality.score(docs.limit(0), m).count() == 0
