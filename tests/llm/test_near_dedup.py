"""keep_one: rows that repeat an id, large groups and pairs near the threshold, against brute force."""

import random
from collections import Counter

import pytest

from tarnlake.llm import simhash

COLUMNS = "doc_id long, text string, n_chars long"


def test_repeated_ids_go_only_within_their_group(spark):
    rows = [(None, "", 0), (None, "", 0), (None, "one text of a null id", 1), (None, "another text with no id at all", 2)]
    rows += [(7, "alpha beta gamma", 3), (7, "Alpha beta  gamma", 4), (7, "quite other words here", 5), (9, "alpha beta gamma", 6)]
    got = [(r.doc_id, " ".join((r.text or "").lower().split())) for r in simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()]
    key = lambda r: str(r)
    want = [(None, ""), (None, "one text of a null id"), (None, "another text with no id at all"), (7, "alpha beta gamma"), (7, "quite other words here")]
    assert sorted(got, key=key) == sorted(want, key=key)


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = t.lower().split()
        out.append({" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) > n else {" ".join(w)})
    return out


def alike(a, b):
    both = len(a & b)
    return both * 5 >= 4 * (len(a) + len(b) - both)


def prose(rng, n):
    return ["".join(rng.choice(["an", "er", "st", "ou", "ti", "re", "lo", "ka"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def check(spark, texts, most=None):
    """Against all pairs: who went is alike to one that stayed, and no two that stayed are alike."""
    rows = [(i, t, len(t)) for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect())
    sets = sets_of(texts)
    assert len(set(got)) == len(got)
    for i in got:
        assert not any(alike(sets[i], sets[j]) for j in got if j < i), i
    for i in set(range(len(texts))) - set(got):
        assert any(alike(sets[i], sets[j]) for j in got), i
    assert most is None or len(got) <= most
    return got


@pytest.mark.parametrize("block", [1 << 23, 3000])
def test_common_shingles_are_counted_over_all_rows(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    monkeypatch.setattr(simhash, "TOGETHER", 9000, raising=False)
    rng = random.Random(5)
    lines = ["all rows may hold this line", "fewer rows hold this other line", "and this one hardly any holds"]
    texts = [" ".join([f"w{i}", *(x for x, p in zip(lines, (0.6, 0.01, 0.0002), strict=True) if rng.random() < p), f"v{i}"]) for i in range(61_000)]
    want = Counter(s for t in texts for s in simhash.shingles(simhash.word_hashes(t.encode().split())).tolist())
    docs = spark.createDataFrame(list(enumerate(texts)), "rk long, text string").repartition(9)
    keys, counts = simhash.common_shingles(docs)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {s: n for s, n in want.items() if n * 20_000 >= 3 * len(texts)}


def test_few_shingles_are_counted_that_are_not_common(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 100_000)
    rng = random.Random(8)
    texts = [" ".join(["all rows may hold this line"] * (i % 2) + [f"w{rng.randrange(10**9)}" for _ in range(60)]) for i in range(20_000)]
    docs = simhash.written(spark.createDataFrame(list(enumerate(texts)), "rk long, text string"), "docs")
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: sum(e.totalShuffleWrite() for e in (x.apply(k) for x in [store.executorList(False)] for k in range(x.size())))
    start = moved()
    keys, _ = simhash.common_shingles(docs)
    assert len(keys) == 2
    assert moved() - start < 5 << 20


def test_prefixes_and_sets_take_no_more_disk_than_they_must(spark, monkeypatch):
    """Tables that hold prefixes go once met is written, and sets of shingles are not dealt out before they are written."""
    rng = random.Random(12)
    texts = []
    for _ in range(150):
        w = prose(rng, 2000)
        texts += [" ".join(w), " ".join([*w[:-1], "edited"])]
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: sum(e.totalShuffleWrite() for e in (x.apply(k) for x in [store.executorList(False)] for k in range(x.size())))
    plain, tables, held, most = simhash.written, [], set(), {}

    def watched(df, name, *more):
        start = moved()
        if any(n == "met" for n, _ in tables) and name not in ("bits", "slim"):
            held.update(n for n, t in tables if "parts" in t.columns and there(spark, t))
        out = plain(df, name, *more)
        tables.append((name, out))
        most[name] = max(most.get(name, 0), moved() - start)
        return out

    monkeypatch.setattr(simhash, "written", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        check(spark, texts, most=150)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not held
    assert most["sets"] < 8 * sum(map(len, sets_of(texts)))


def there(spark, table):
    at = spark._jvm.org.apache.hadoop.fs.Path(table._tl_path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def test_large_groups_that_meet_only_at_their_base(spark):
    rng = random.Random(3)
    texts = []
    for size in (12, 60, 150):
        base = prose(rng, 200)
        copies = []
        for _ in range(size):
            v = list(base)
            for _ in range(rng.randint(3, 4)):  # alike to the base, most not to each other
                v[rng.randrange(len(v))] = f"edit{rng.randrange(10**9)}"
            copies.append(" ".join(v))
        copies.insert(rng.randrange(size), " ".join(base))
        texts += copies
    rng.shuffle(texts)
    check(spark, texts, most=3)


def test_chains_leave_one_for_each_stretch(spark):
    """Neighbours are alike, ends are not: a text goes only for one that it is itself alike to."""
    rng = random.Random(9)
    texts = []
    for length in (12, 40):
        w = prose(rng, 300)
        for k in range(length):
            texts.append(" ".join(w))
            for j in range(2):
                w[(k * 37 + j * 150) % 300] = f"step{rng.randrange(10**9)}"
    got = check(spark, texts)
    assert 4 <= len(got) <= 30


def test_many_clusters_in_one_chain(spark):
    """Clusters of mutually alike texts, tied to each other by texts between them."""
    rng = random.Random(10)
    w, texts = prose(rng, 200), []
    for _ in range(9):
        for _ in range(8):
            v = list(w)
            v[rng.randrange(200)] = f"own{rng.randrange(10**9)}"
            texts.append(" ".join(v))
        for _ in range(5):
            w[rng.randrange(200)] = f"on{rng.randrange(10**9)}"
    rng.shuffle(texts)
    check(spark, texts)


def test_equal_texts_keep_the_smallest_id_and_colliding_hashes_stay(spark, monkeypatch):
    rows = [(5, "a b c d e f g", 1), (3, "A b c  d e f g", 1), (None, "a b c d e f g", 1), (3, "a b c d e f g", 1), (8, "other text", 1)]
    assert sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, COLUMNS)).collect()) == [3, 8]


def test_appended_passages_and_scattered_edits_near_the_threshold(spark):
    rng = random.Random(4)
    line = prose(rng, 25)
    texts = []
    for k in range(120):
        n = rng.choice([9, 40, 120, 400, 1500])
        w = prose(rng, n) + line * (k % 3 == 0)
        v = list(w)
        if k % 2:
            v += prose(rng, round(len(w) * rng.uniform(0.15, 0.3)))
        else:
            for _ in range(max(1, round(len(w) * rng.uniform(0.01, 0.03)))):
                v[rng.randrange(len(v))] = "edited"
        texts += [" ".join(w), " ".join(v)]
    check(spark, texts)


def test_similarity_is_exact_at_the_threshold(spark):
    rng = random.Random(6)
    texts = []
    for k in range(60):  # of 1000 shingles and 250 or 251 more: a similarity of 0.8 or just less
        w = [f"w{rng.randrange(10**12)}" for _ in range(1004 + 250 + k % 2)]
        texts += [" ".join(w[:1004]), " ".join(w)]
    assert len(check(spark, texts)) == 90
