"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of variable order, 0 to ORDER, counts which byte follows. A context is a node of
the tree if it is at least one in SHARE of the language's bytes, so that trees are deep where text is dense and
bounded at every size of the corpus. A byte's code length comes from the longest context before it that is in the
tree: if the byte was seen there, its share; if not, an escape (as likely as the context has distinct followers, method
C) and the next shorter context, without the bytes already ruled out, down to all bytes alike. Statistics are
frozen after learning, so every text's code length is exact and independent of the others; the shortest wins.

Contexts are of the bytes themselves; before a text stand ORDER zero bytes. Counts are of all learned texts, summed on
the cluster; the code lengths of a context, a node or not, and a byte are worked out once and kept in a table.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text where nothing
could be learned; ties go to the smaller name; a null doc_id is kept and counts as held out neither way
(held_out is null, not learned from); repeated rows each count; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import crc_mod, prepare, texts, written

ORDER = 4
SHARE = 5000  # a context of one in so many bytes or more is in the tree
TABLE_BYTES = 64 << 20  # of a task's table of code lengths
PART = 1 << 19  # bytes of text that are scored at once
UND = "und"
ODD = np.uint64(0x9E3779B97F4A7C15)

IS_ASCII_LETTER = np.zeros(256, bool)
IS_ASCII_LETTER[ord("a") : ord("z") + 1] = IS_ASCII_LETTER[ord("A") : ord("Z") + 1] = True


def grams(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts with the ORDER before it (the byte lowest, then the nearest), and the texts' sizes."""
    pad = bytes(ORDER)
    buf = np.frombuffer(pad + pad.join(parts), np.uint8)
    size = np.array([len(p) for p in parts], np.int64)
    key = np.zeros(len(buf) - ORDER, np.uint64)
    for k in range(ORDER + 1):
        key |= buf[ORDER - k : len(buf) - k].astype(np.uint64) << np.uint64(8 * k)
    at = np.concatenate([[0], np.cumsum(size + ORDER)])[:-1]
    own = np.zeros(len(key) + 1, np.int32)  # the zero bytes between texts are context, and no byte to be coded
    np.add.at(own, at, 1)
    np.add.at(own, at + size, -1)
    return key[np.cumsum(own[:-1]) > 0], size


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def learn_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over all rows of docs (text, lang): how often each byte follows each ORDER bytes."""
    prepare(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[str, list] = {}
        rows = 0

        def out():
            for lang, found in held.items():
                key, n = merged(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], names=["lang", "key", "n"])
            held.clear()

        for b in batches:
            by: dict[str, list[bytes]] = {}
            for t, lang in zip(texts(b), b.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, parts in by.items():
                mine = held.setdefault(lang, [])
                mine.append(np.unique(grams(parts)[0], return_counts=True))
                rows += len(mine[-1][0])
                if len(mine) > 8:
                    mine[:] = [merged(mine)]
            if rows > 4_000_000:
                yield from out()
                rows = 0
        yield from out()

    got = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, key long, n long")
    return got.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def nodes(counts: DataFrame) -> DataFrame:
    """(lang, depth, key, n) of the followers of all contexts that are in the trees."""
    masks = F.array(*(F.struct(F.lit(k).alias("depth"), F.lit((1 << 8 * (k + 1)) - 1).alias("mask")) for k in range(ORDER + 1)))
    each = counts.select("lang", "key", "n", F.explode(masks).alias("m")).select("lang", F.col("m.depth").alias("depth"), F.col("key").bitwiseAND(F.col("m.mask")).alias("key"), "n")
    each = written(each.groupBy("lang", "depth", "key").agg(F.sum("n").alias("n")), "followers")
    total = each.filter("depth = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    context = each.groupBy("lang", "depth", F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("times"))
    kept = context.join(F.broadcast(total), "lang").filter(F.col("times") * SHARE >= F.col("total")).select("lang", "depth", "context")
    return each.withColumn("context", F.shiftright("key", 8)).join(kept, ["lang", "depth", "context"], "left_semi").select("lang", "depth", "key", "n")


class Tree:
    """Code lengths of one language: by depth the contexts, what an escape from each costs, and its followers with their costs."""

    def __init__(self, by_depth: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[tuple[np.ndarray, ...]] = []
        for depth, (key, n) in enumerate(by_depth):
            order = np.argsort(key)
            key, n = key[order], n[order].astype(float)
            context, first, kinds = np.unique(key >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) if len(n) else n
            which = np.repeat(np.arange(len(context)), kinds)
            every = kinds == 256
            shares = n / (total + np.where(every, 0, kinds))[which]
            below = np.exp2(-self.lengths(key, depth - 1))  # what the shorter contexts say of the bytes seen here
            left = 1 - np.add.reduceat(below, first) if len(n) else n
            escape = np.where(every, 1, kinds / (total + kinds)) / np.maximum(left, 1e-300)
            self.levels.append((context, -np.log2(escape), key, -np.log2(shares)))

    def lengths(self, key: np.ndarray, depth: int = ORDER) -> np.ndarray:
        """Bits of the lowest byte of each key after the bytes above it, by contexts of at most `depth` bytes."""
        bits = np.zeros(len(key))
        left = np.arange(len(key))
        for d in range(depth, -1, -1):
            context, escape, followers, cost = self.levels[d]
            if not len(context) or not len(left):
                continue
            own = key[left] & np.uint64((1 << 8 * (d + 1)) - 1)
            node = np.minimum(np.searchsorted(context, own >> np.uint64(8)), len(context) - 1)
            here = context[node] == own >> np.uint64(8)
            at = np.minimum(np.searchsorted(followers, own), len(followers) - 1)
            seen = here & (followers[at] == own)
            bits[left[seen]] += cost[at[seen]]
            gone = here & ~seen
            bits[left[gone]] += escape[node[gone]]
            left = left[~seen]
        bits[left] += 8  # all bytes alike
        return bits


def fit(docs: DataFrame) -> tuple[list[str], list[Tree]]:
    """Names and trees of the languages in docs (text, lang); the counts are summed on the cluster, nodes come to the driver."""
    t = nodes(written(learn_counts(docs), "grams")).toArrow()
    lang, depth, key, n = (t.column(c).to_numpy(zero_copy_only=False) if c == "lang" else t.column(c).to_numpy() for c in ("lang", "depth", "key", "n"))
    names = sorted(set(lang.tolist()))
    trees = []
    for name in names:
        mine = lang == name
        trees.append(Tree([(key[mine & (depth == d)].astype(np.uint64), n[mine & (depth == d)]) for d in range(ORDER + 1)]))
    return names, trees


class Costs:
    """Code lengths in all languages of grams, kept by a slot of their own hash; what finds no slot is worked out anew."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.power = min(22, max(10, (TABLE_BYTES // (8 + 4 * len(trees))).bit_length() - 1))
        self.keys = np.full(1 << self.power, (1 << 64) - 1, np.uint64)  # no gram has so many bytes
        self.bits = np.zeros((1 << self.power, len(trees)), np.float32)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key * ODD) >> np.uint64(64 - self.power)

    def work_out(self, key: np.ndarray) -> np.ndarray:
        return np.stack([t.lengths(key) for t in self.trees], axis=1).astype(np.float32)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        slot = self.slot(key)
        miss = self.keys[slot] != key
        if miss.any():
            new = np.unique(key[miss])
            at = self.slot(new)
            self.keys[at] = new
            self.bits[at] = 0
            got = self.work_out(new)
            last = self.keys[at] == new  # of grams that share a slot one has it
            self.bits[at[last]] = got[last]
            miss = self.keys[slot] != key
        out = self.bits[slot]
        if miss.any():
            i = np.flatnonzero(miss)
            new, inverse = np.unique(key[i], return_inverse=True)
            out[i] = self.work_out(new)[inverse]
        return out


def lettered(t: bytes) -> bool:
    return bool(IS_ASCII_LETTER[np.frombuffer(t, np.uint8)].any()) or any(map(str.isalpha, t.decode("utf-8", "replace")))


def text_bits(parts: list[bytes], costs: Costs) -> np.ndarray:
    """Code lengths of texts (rows) in all languages (columns)."""
    out = np.zeros((len(parts), len(costs.trees)))
    key, size = grams(parts)
    end = np.cumsum(size)
    text = np.repeat(np.arange(len(parts)), size)
    for a in range(0, len(key), PART):
        z = min(a + PART, len(key))
        bits = costs(key[a:z])
        first = np.concatenate([[0], np.flatnonzero(np.diff(text[a:z])) + 1])
        np.add.at(out, text[a:z][first], np.add.reduceat(bits, first, axis=0, dtype=np.float64))
    assert not len(end) or end[-1] == len(key)
    return out


def predict(docs: DataFrame, model: tuple[list[str], list[Tree]]) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names, trees = sent.value
        costs = Costs(trees) if names else None
        for b in batches:
            parts = texts(b)
            said, score = [UND] * len(parts), np.zeros(len(parts))
            if costs is not None and parts:
                bits = text_bits(parts, costs)
                best = bits.argmin(1)
                sure = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                for k, t in enumerate(parts):
                    if lettered(t):
                        said[k], score[k] = names[best[k]], sure[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(said, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32 modulo 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(crc_mod(4) != 2))
    return predict(docs, model).select("doc_id", (crc_mod(4) == 2).alias("held_out"), "lang_pred", "score")
