"""SimHash near-duplicates by meeting in the middle.

A fingerprint has 64 bits, each set if it is set in over half of the 64-bit hashes of a text's word shingles.
Two fingerprints link at 3 or fewer differing bits. Links are found without comparing pairs at large:

1. Every distinct fingerprint emits, for each of some blocks of its bits, the fingerprint without that block
   and all its variants of one flipped bit (33 keys for each of 2 blocks, 44 for each of 3). Of three differing
   bits one can be hidden by leaving out its block; the other two meet in the middle. So linked fingerprints
   share a key. There are as many blocks as keep keys from being shared by chance: 2 up to 8 million
   fingerprints, 3 up to billions, 4 beyond; the links are the same.
2. Fingerprints that share a key with few others are verified with those. Where many share a key, no pairs are
   made: those fingerprints emit all variants within one flip, and all of two flips in one half of the bits
   (of three differing bits two lie in one half). Whoever shares a variant with one that is within one flip of
   it is within three bits of that one, so each links to the smallest such: a star in place of all pairs, with
   the same components.
3. Components of those links give each fingerprint its class; copies have one fingerprint from the start.

Defined results: a null or wordless text has fingerprint 0, which links like any other; a null doc_id is kept
and gets its class, and never is a class's smallest unless all are null; repeated rows stay repeated; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import bit_table, docs_of, forget, marked, prepare, release, texts, written
from tarnlake.llm.graph import components

RADIUS = 3
NEXT = 7  # a key of at most NEXT + 1 fingerprints has its pairs compared; others go by stars


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(n: int) -> list[int]:
    """Blocks of bits such that a fingerprint among n shares a key of a block with about one other by chance at most."""
    k = 2
    while k < 4 and n * (64 - 64 // k) ** 2 / 2 > 2 ** (64 - 64 // k):
        k += 1
    cuts = [64 * j // k for j in range(k + 1)]
    return [sum(1 << b for b in range(x, y)) for x, y in zip(cuts, cuts[1:], strict=False)]


HALVES = [range(0, 32), range(32, 64)]
ONES = [0, *(1 << b for b in range(64))]
TWOS = [1 << a | 1 << b for half in HALVES for a, b in combinations(half, 2)]


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Of one text in UTF-8; see fingerprints."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        count += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text): A-Z lower-cased, words between ASCII white space, XXH64 with seed 42."""
    prepare(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs_of(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def flipped(c, masks: list[int]):
    """Array of a long column with each mask's bits flipped."""
    return F.transform(F.array(*(F.lit(signed(m)) for m in masks)), lambda m: c.bitwiseXOR(m))


def links(distinct: DataFrame, blocks: list[int] | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that keep all components of links; each is a link."""
    keys = []
    for block in blocks or blocks_for(distinct.count()):
        keep = ~block & (1 << 64) - 1
        tag = block & -block  # in the bits left out: which block it was
        masks = [tag, *(tag | 1 << b for b in range(64) if not block >> b & 1)]
        keys.append(flipped(F.col("fp").bitwiseAND(F.lit(signed(keep))), masks))
    meet = distinct.select("fp", F.explode(F.concat(*keys)).alias("key"))
    w = Window.partitionBy("key").orderBy("fp")
    before = [F.lag("fp", k).over(w).alias(f"b{k}") for k in range(1, NEXT + 1)]
    half = NEXT // 2 + 1
    near = meet.select("fp", *before, F.lead("fp", 1).over(w).alias("after"), F.lead("fp", half).over(w).alias("far"))
    near = written(near.filter("b1 IS NOT NULL OR after IS NOT NULL"), "meet")
    pairs = near.select("fp", F.explode(F.array(*(f"b{k}" for k in range(1, NEXT + 1)))).alias("b")).filter(F.col("b").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= RADIUS))
    crowd = near.filter(F.col("far").isNotNull() | F.col(f"b{half}").isNotNull()).select("fp").distinct()
    ball = crowd.select("fp", F.lit(True).alias("one"), F.explode(flipped(F.col("fp"), ONES)).alias("v")).unionAll(crowd.select("fp", F.lit(False), F.explode(flipped(F.col("fp"), TWOS))))
    hub = F.min(F.when(F.col("one"), F.col("fp"))).over(Window.partitionBy("v"))
    stars = ball.select("fp", hub.alias("b")).filter("b <> fp")
    return pairs.select(F.col("fp").alias("a"), "b").unionAll(stars.select(F.col("fp").alias("a"), "b")).distinct()


def classes(fps: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint in fps (doc_id, fp); the id is the class's smallest doc_id."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct))
    whole = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = whole.groupBy("root").agg(F.min("first").alias("component_id"))
    return whole.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row of docs."""
    fps = written(fingerprints(docs, shingle), "fps")
    return fps.join(classes(fps), "fp", "left").select("doc_id", "fp", "component_id")


LEAST = 4  # bytes of a word that counts in keep_one's fingerprints (of texts that have such): shorter ones are alike in all texts of a language
SHINGLE = 5
ALIKE = (4, 5)  # texts are alike if the similarity of their sets of shingles is this fraction or more
COMMON = (3, 20_000)  # shingles that this share of all rows or more hold, and three rows, go last in prefixes: any order finds all that are alike
TOGETHER = 14_000  # rows, about, whose shingles a task counts together
BLOCK = 1 << 21  # shingles that may be common, about, that a task counts exactly at once
COUNTERS = 1 << 24  # a power of two: counters of shingles, each of which many shingles share
SLICES = 256  # parts of them that tasks add up apart
TOP = 128  # levels of a counter
PARITY = 16  # longs of parities of a set of shingles: sets of few differences differ in no more of these bits
SMALL = 500  # shingles a part, up to twice as many: more would fill the bits of their parities
CENTRES = 6  # rounds, at most, in which a group's texts are compared with one centre; what is left then is compared by pairs
FEW = 2000  # texts left by centres that are compared by pairs at once; either way tells the same of every pair

_rng = np.random.Generator(np.random.PCG64(77))
PLACES = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(w: np.ndarray) -> np.ndarray:
    """The distinct 64-bit hashes, in order, of a text's runs of SHINGLE words, from hashes of its words; of fewer words, that of all."""
    n = len(w)
    if n <= SHINGLE:
        return mixed(np.array([int((w * PLACES[:n]).sum()) ^ n], np.uint64))
    run = w[: n - SHINGLE + 1] * PLACES[0]
    for k in range(1, SHINGLE):
        run += w[k : n - SHINGLE + 1 + k] * PLACES[k]
    return np.unique(mixed(run))


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Those of the shingles s of which a text shares one with every text alike: all but as many as it must share, and
    one more, in an order that is the same for all texts (rare ones first, by their counts if common and else by their levels)."""
    need = -(-ALIKE[0] * len(s) // ALIKE[1])
    many = np.zeros(len(s), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        many = np.where(common[at] == s, counts[at], 0)
    s = s[np.lexsort((s, level(s, table), many))]
    return s[: len(s) - need + 1]


def parities(s: np.ndarray) -> np.ndarray:
    """Whether the shingles s with each remainder by 64 * PARITY are odd in number, as PARITY longs."""
    odd = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def parts(s: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """A text's shingles in numbered parts by their remainders, one part of few shingles, of more a power of two.

    If two sets are alike then so are the parts of one remainder at least, as shares of the whole average out; so texts
    that are alike have a part alike, and parts of a size are all that need be searched. How many parts a text has
    follows from its size. Where a text that is alike may be small enough to have half as many, both cuts are there.
    """
    n, out = len(s), []
    power = max(0, (n // SMALL).bit_length() - 1)
    for c in {power, max(0, power - 1)} if n * ALIKE[0] < SMALL * ALIKE[1] << power else {power}:
        if c == 0:
            out.append((1, s))
        else:
            which = (s >> np.uint64(40)).astype(np.int64) & ((1 << c) - 1)
            out += [((1 << c) | j, s[which == j]) for j in range(1 << c)]
    return [(part, x) for part, x in out if len(x)]


def least_of(n: int) -> int:
    """How many of n rows hold a common shingle at least."""
    return max(3, -(-COMMON[0] * n // COMMON[1]))


def together(docs: DataFrame, n: int) -> DataFrame:
    return docs.select("text").coalesce(max(1, n // TOGETHER))


def levels(docs: DataFrame, n: int) -> np.ndarray:
    """Of COUNTERS counters, one of which each shingle raises in all of the n rows of docs (text) that hold it, how far they get:
    TOP where they reach what makes a shingle common, and shares of that below. So a shingle's level is never less than its own rows make
    it. How far the others that share its counter add to it does not grow with the rows, as a share of TOP.
    """
    least, most, slices = least_of(n), COUNTERS, min(SLICES, COUNTERS // 64)
    each = most // slices

    def raised(batches: Iterator) -> Iterator:
        """The task's counters by slices, of integers as narrow as a slice can do with."""
        import pyarrow as pa

        release()
        table = np.zeros(most, np.uint32)
        for b in batches:
            for t in texts(b):
                np.add.at(table, (shingles(word_hashes(t.lower().split())) & np.uint64(most - 1)).astype(np.int64), 1)
        for k in range(slices):
            own = table[k * each : (k + 1) * each]
            if (top := own.max()) > 0:
                data = zlib.compress(own.astype(np.min_scalar_type(top)).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["slice", "data"])

    def total(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("slice").to_pylist(), b.column("data").to_pylist(), strict=True):
                raw = zlib.decompress(data)
                own = sums.setdefault(k, np.zeros(each, np.int64))
                own += np.frombuffer(raw, f"u{len(raw) // each}")
        for k, own in sums.items():
            data = zlib.compress(np.minimum(own * TOP // least, TOP).astype(np.uint8).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["slice", "data"])

    found = written(together(docs, n).mapInArrow(raised, "slice int, data binary").repartition("slice").mapInArrow(total, "slice int, data binary"), "levels")
    out = np.zeros(most, np.uint8)
    for r in found.toArrow().to_pylist():  # a row for each slice
        out[r["slice"] * each : (r["slice"] + 1) * each] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    forget(found)
    return out


def level(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[(s & np.uint64(len(table) - 1)).astype(np.int64)]


def common_shingles(docs: DataFrame, n: int | None = None, sent=None) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that least_of(n) or more of the n rows of docs (text) hold, and how many rows do.

    Counts are of all rows, and exact; levels (sent: a broadcast of theirs) tell which shingles need be counted. There are at most as many as a row
    has shingles, divided by COMMON.
    """
    n = docs.count() if n is None else n
    least, most = least_of(n), BLOCK
    sent = docs.sparkSession.sparkContext.broadcast(levels(docs, n)) if sent is None else sent

    def exact(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def counted(held: list[np.ndarray]) -> Iterator:
            keys, count = np.unique(np.concatenate(held), return_counts=True)
            for k in range(0, len(keys), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + (1 << 16)].view(np.int64)), pa.array(count[k : k + (1 << 16)], pa.int64())], names=["key", "count"])

        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            for t in texts(b):
                s = shingles(word_hashes(t.lower().split()))
                held.append(s[level(s, sent.value) == TOP])
                size += len(held[-1])
                if size >= most:
                    yield from counted(held)
                    held, size = [], 0
        if held:
            yield from counted(held)

    counts = written(together(docs, n).mapInArrow(exact, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")).filter(F.col("count") >= least), "common")
    got = counts.toArrow()
    forget(counts)
    key, n_rows = got.column("key").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(key)
    return key[order], n_rows[order]


PARTS = "array<struct<part:int,n:int,keys:array<bigint>,odd:array<bigint>>>"


def sketches(docs: DataFrame) -> DataFrame:
    """Of docs (rk, doc_id, text): th and th2, hashes of the words; the fingerprint of the words of LEAST or more bytes;
    the number of distinct shingles, and their parities; and for each part of them the number, the prefix and parities.
    """
    n, spark = docs.count(), docs.sparkSession
    held = spark.sparkContext.broadcast(levels(docs, n))
    common = spark.sparkContext.broadcast(common_shingles(docs, n, held))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        longs = pa.list_(pa.int64())
        release()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), longs, pa.list_(pa.struct([("part", pa.int32()), ("n", pa.int32()), ("keys", longs), ("odd", longs)]))]
        for b in batches:
            out: list[tuple] = []
            for t in texts(b):
                words = t.lower().split()
                joined = b" ".join(words)
                w = word_hashes(words)
                long = np.fromiter(map(len, words), np.int32, len(words)) >= LEAST
                x = w[long] if long.any() else w
                count = np.zeros(64, np.int64)
                for k in range(0, len(x), 8192):
                    count += np.unpackbits(x[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
                fp = int(np.packbits(count * 2 > len(x), bitorder="little").view(np.int64)[0])
                s = shingles(w)
                mine = [{"part": k, "n": len(y), "keys": prefix(y, *common.value, held.value).view(np.int64), "odd": parities(y)} for k, y in parts(s)]
                out.append((signed(xxhash.xxh64_intdigest(joined)), signed(xxhash.xxh64_intdigest(joined, 1)), fp, len(s), parities(s), mine))
            yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True))], names=["rk", "doc_id", "th", "th2", "fp", "n", "odd", "parts"])

    return docs.mapInArrow(run, f"rk long, doc_id long, th long, th2 long, fp long, n int, odd array<long>, parts {PARTS}")


DIFFER = " + ".join(f"bit_count(odd_a[{k}] ^ odd_b[{k}])" for k in range(PARITY))
CAN = f"{ALIKE[1]} * least(n_a, n_b) >= {ALIKE[0]} * greatest(n_a, n_b) AND {sum(ALIKE)} * ({DIFFER}) <= {ALIKE[1] - ALIKE[0]} * (n_a + n_b)"


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that can be alike by their numbers of shingles and the parities that differ."""
    x, y = (nodes.select(F.col("th").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}")) for c in "ab")
    return pairs.join(x, "a").join(y, "b").filter(CAN).select("a", "b")


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes (th, rk), those whose texts in docs (rk, text) are alike, told of all their shingles."""

    def whole(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("th"), pa.array([shingles(word_hashes(t.lower().split())).tobytes() for t in texts(b)], pa.binary())], names=["th", "s"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both * ALIKE[1] >= ALIKE[0] * (len(x) + len(y) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    pairs = written(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    need = pairs.select(F.explode(F.array("a", "b")).alias("th")).distinct()
    need = written(nodes.join(need, "th", "left_semi").select("th", "rk"), "need")
    texts_of = marked(docs, "rk", bit_table(need)).filter("__tl_maybe").select("rk", "text").dropDuplicates(["rk"])
    # the texts lie by rk from here on, so only need is dealt out; sets of shingles are larger, and move no more than they must
    sets = written(texts_of.join(need, "rk").select("th", "text").mapInArrow(whole, "th long, s binary"), "sets")
    x, y = (sets.select(F.col("th").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    out = written(pairs.join(x, "a").join(y, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "alike")
    forget(pairs, need, sets)
    return out


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of unequal nodes once each, the smaller first."""
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def proposed(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes by linked fingerprints, at most one a node; what they leave apart, later pairs join."""
    stands = written(nodes.groupBy("fp").agg(F.min("th").alias("stand")), "stands")
    same = nodes.select("th", "fp").join(stands, "fp").filter("th <> stand").select(F.col("th").alias("a"), F.col("stand").alias("b"))
    edges = links(stands.select("fp")).groupBy("a").agg(F.min("b").alias("b"))
    x, y = (stands.select(F.col("fp").alias(c), F.col("stand").alias(f"s{c}")) for c in "ab")
    return same.unionAll(edges.join(x, "a").join(y, "b").select("sa", "sb"))


def apart(met: DataFrame, place: DataFrame, bits: DataFrame) -> DataFrame:
    """All pairs (a, b) that share a key of met (key, th, part, n, pos), are of different groups of place (th, root), and have
    a part that can be alike by its numbers of shingles, the places of that key, and the parities (of bits) that differ."""
    rows = met.join(place.select("th", "root"), "th")
    w = Window.partitionBy("key", "part")
    by_n, (p, q) = w.orderBy("n"), ALIKE
    rows = rows.withColumn("less", F.lag("n").over(by_n)).withColumn("more", F.lead("n").over(by_n))
    rows = rows.withColumn("low", F.min("root").over(w)).withColumn("high", F.max("root").over(w)).filter("low <> high")
    # who is too unlike in size to the next smaller and the next larger is so to all
    rows = rows.filter(f"{q} * less >= {p} * n OR {q} * n >= {p} * more")
    rows = written(rows.select("key", "th", "part", "root", "n", "pos").join(bits, ["th", "part"]), "apart")
    x, y = (rows.select("key", "part", *(F.col(c).alias(f"{c}_{s}") for c in ("th", "root", "n", "pos", "odd"))) for s in "ab")
    can = f"{CAN} AND {p + q} * (least(pos_a, pos_b) + least(n_a - pos_a, n_b - pos_b)) >= {p} * (n_a + n_b)"
    out = written(ordered(x.join(y, ["key", "part"]).filter(f"th_a < th_b AND root_a <> root_b AND {can}").select(F.col("th_a").alias("a"), F.col("th_b").alias("b"))), "pairs")
    forget(rows)
    return out


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def independent(edges: DataFrame) -> DataFrame:
    """(th) of the nodes of edges (a, b) that go, so that those that stay are no one's neighbours and all that go have a
    neighbour that stays: each round keeps whoever has more neighbours than all of its own that are left."""
    both = written(both_ways(edges).distinct(), "edges")
    rank = both.groupBy("a").agg(F.struct(F.count("*").alias("n"), F.col("a").alias("th")).alias("rank"))
    both = written(both.join(rank, "a").join(rank.select(F.col("a").alias("b"), F.col("rank").alias("other")), "b"), "edges")
    gone = []
    while not both.isEmpty():
        keep = both.groupBy("a").agg(F.max("other").alias("top"), F.first("rank").alias("rank")).filter("rank > top").select("a")
        out = written(both.join(keep, "a").select(F.col("b").alias("th")).distinct(), "gone")
        gone.append(out)
        done = out.unionAll(keep)
        now = written(both.join(done, both.a == done.th, "left_anti").join(done, both.b == done.th, "left_anti"), "edges")
        forget(both)
        both = now
    return reduce(DataFrame.unionAll, gone) if gone else edges.select(F.col("a").alias("th")).limit(0)


def meetings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes (th, parts), written: met (th, n, part, key, pos, many), the keys of which `many` parts of a number share one, two or more;
    and bits (th, part, odd), the parities of all parts. With these, nodes can do without their parts.

    All keys are shuffled once. Their columns are few, and ordered so that what rows of one part have in common is in one piece, which compresses.
    """
    each = nodes.select("th", F.explode("parts").alias("x")).select("th", "x.n", "x.part", "x.keys", "x.odd")
    keys = each.select("th", "n", "part", F.posexplode("keys").alias("pos", "key")).select("th", "n", "part", "key", "pos")
    met = written(keys.withColumn("many", F.count("*").over(Window.partitionBy("key", "part"))).filter("many > 1"), "met")
    return met, written(each.select("th", "part", "odd"), "bits")


def that_go(nodes: DataFrame, met: DataFrame, bits: DataFrame, docs: DataFrame) -> DataFrame:
    """(th) of the nodes (th, first, rk, fp, n, odd) that are alike to one that stays; no two that stay are alike. met and bits: see meetings.

    Alike texts have a part alike, and so share a shingle of its prefixes: the pairs that share one are all there can be. Not all need
    be compared. Groups come first: each node is compared with the one under its keys whose own keys are shared
    most (a base of edited copies keeps all keys that they have), and with what fingerprints propose; of the pairs
    left, those that lie in one component of alike pairs by then do not change the groups, and all others are compared.
    Then each group gets a centre, the node that is alike to most; who is alike to it goes, told by an own comparison,
    and the centre stays. A node that only a chain ties to the centre is not alike to it, and is left for a next
    round, with a next centre. When FEW are left, or after CENTRES rounds, they are compared by all pairs of theirs.
    """
    long = F.first("n") - F.ceil(F.first("n") * ALIKE[0] / ALIKE[1]) + 1  # of a part's prefix
    share = met.groupBy("th", "part").agg((F.sum(F.log("many")) / long).alias("share"))
    hub = F.max(F.struct("share", "th")).over(Window.partitionBy("key", "part"))
    hubs = met.select("key", "th", "part").join(share, ["th", "part"]).select("th", hub.alias("hub")).filter("hub.th <> th").groupBy("th").agg(F.max("hub").alias("hub"))
    pairs = ordered(proposed(nodes).unionAll(hubs.select("th", "hub.th")))
    first = similar(possible(pairs, nodes), nodes, docs)
    groups = components(first)
    place = nodes.join(groups, nodes.th == groups.node, "left").select("th", F.coalesce("root", "th").alias("root"))
    rest = apart(met, place, bits)
    more = similar(rest, nodes, docs)
    edges = written(first.unionAll(more).distinct(), "alike")
    # groups that later pairs join: their roots are nodes of a graph of their own, as small as those pairs are few
    ends = more.select("a", "b").join(place.select(F.col("th").alias("a"), F.col("root").alias("ra")), "a").join(place.select(F.col("th").alias("b"), F.col("root").alias("rb")), "b")
    joined = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("old"), F.col("root").alias("new"))
    roots = place.join(both_ways(edges).select(F.col("a").alias("th")).distinct(), "th").join(joined, F.col("root") == F.col("old"), "left").select(F.col("th").alias("node"), F.coalesce("new", "root").alias("root"))
    degree = both_ways(edges).groupBy("a").agg(F.count("*").alias("degree"))
    left = written(roots.join(degree, roots.node == degree.a).join(nodes.select("th", "first"), roots.node == F.col("th")).select("th", "root", "degree", "first"), "left")
    gone = []
    for turn in range(CENTRES):
        if left.count() <= (FEW if turn else 0):
            break
        best = F.struct("degree", F.coalesce(-F.col("first"), F.lit(-(1 << 62))).alias("id"), "th")  # of equals the smaller doc_id
        centres = left.groupBy("root").agg(F.max(best).alias("best")).select(F.col("root").alias("croot"), F.col("best.th").alias("centre"))
        to = written(left.join(centres, left.root == centres.croot).filter("th <> centre").select("th", "root", "degree", "first", "centre", F.least("th", "centre").alias("a"), F.greatest("th", "centre").alias("b")), "to")
        unknown = similar(possible(to.join(edges, ["a", "b"], "left_anti").select("a", "b"), nodes), nodes, docs)
        alike = edges.unionAll(unknown).distinct()
        gone.append(written(to.join(alike, ["a", "b"], "left_semi").select("th"), "gone"))
        now = written(to.join(gone[-1], "th", "left_anti").select("th", "root", "degree", "first"), "left")
        forget(left, to)
        left = now
    if not left.isEmpty():
        pairs = apart(met, left.select("th", F.col("th").alias("root")), bits)
        gone.append(independent(similar(pairs, nodes, docs)))
    out = written(reduce(DataFrame.unionAll, gone), "gone") if gone else nodes.select("th").limit(0)
    forget(met, bits)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near-duplicates; all columns stay.

    A row goes only if its text has the words of one that stays, or if the two sets of shingles of SHINGLE words have a
    similarity of 0.8 or more; no two rows that stay are so alike. Which one stays: the text of a group that is alike to
    most of it, and of rows with the same words the one of the smallest doc_id (null last), once. So a group of
    copies of one base leaves one row, and a chain of ever more changed texts one for each stretch of alike ones. Null
    texts are empty, and alike. Texts whose 64-bit hashes meet by chance stay, all of them.
    """
    spark = docs.sparkSession
    prepare(spark)
    rk = F.xxhash64(F.coalesce("text", F.lit("")))
    plain = docs.select(rk.alias("rk"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(sketches(plain), "sketches")
    held = ["fp", "n", "odd", "parts"]
    nodes = rows.groupBy("th").agg(F.min("doc_id").alias("first"), F.count("*").alias("times"), F.min("rk").alias("rk"), *(F.first(c).alias(c) for c in held), (F.min("th2") == F.max("th2")).alias("one"))
    nodes = written(nodes.filter("one").drop("one"), "nodes")
    # prefixes and parities are most of these tables: each goes as soon as what is read of it later is written apart
    ids = written(rows.select("rk", "doc_id", "th"), "ids")
    forget(rows)
    met, bits = meetings(nodes)
    slim = written(nodes.drop("parts"), "slim")
    forget(nodes)
    gone = that_go(slim, met, bits, plain)
    # rows that go: those of a text that goes, and of one that stays all but those of its smallest doc_id
    fate = slim.select("th", "first", "times").join(gone.select("th", F.lit(True).alias("goes")), "th", "left").filter("goes OR times > 1")
    of = written(ids.join(fate.select("th", "first", "goes"), "th"), "fate")
    forget(ids, slim)
    drop = written(of.filter("goes OR NOT doc_id <=> first").select(F.col("rk").alias("__tl_drk"), F.col("doc_id").alias("__tl_id")).distinct(), "drop")
    low = of.filter("goes IS NULL AND doc_id <=> first").groupBy("th", "doc_id", "rk").count()
    more = Window.partitionBy("th", "doc_id")  # an id may repeat with other texts, whose rows are not these
    twice = written(low.withColumn("n", F.sum("count").over(more)).filter("n > 1").select(F.col("rk").alias("__tl_trk"), F.col("doc_id").alias("__tl_id"), F.col("th").alias("__tl_root")), "twice")
    # texts are shuffled only where a table of bits says that they may have to go
    table = bit_table(drop.select(F.col("__tl_drk").alias("rk")).unionAll(twice.select("__tl_trk")))
    held = marked(docs.withColumn("__tl_rk", rk), "__tl_rk", table)
    stay = held.filter(~F.col("__tl_maybe")).select(docs.columns)
    look = held.filter("__tl_maybe").join(drop, (F.col("__tl_rk") == F.col("__tl_drk")) & F.col("doc_id").eqNullSafe(F.col("__tl_id")), "left_anti")
    if not twice.isEmpty():
        look = look.join(twice, (F.col("__tl_rk") == F.col("__tl_trk")) & F.col("doc_id").eqNullSafe(F.col("__tl_id")), "left")
        look = look.filter("__tl_root IS NULL").select(docs.columns).unionAll(look.filter("__tl_root IS NOT NULL").dropDuplicates(["__tl_root", "doc_id"]).select(docs.columns))
    return stay.unionAll(look.select(docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
