"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Symbols are the end of a text, the most frequent words, and classes of all other words by their last two bytes.
A log-bilinear network predicts a symbol from the CONTEXT before it: the predicted vector is the sum of the
context's vectors, each scaled by its position; its products with all symbols' vectors, plus a bias, give
log-probabilities that one batched matrix product normalises exactly. A word of a class has the symbol's
probability times its smoothed share of the class's training tokens, in which one share stands for unseen words.

The work is cut into blocks of text. Each block is read once into a file of word numbers in the shared folder
and a table of its distinct words with their counts. Counts are summed over the corpus, each task's first, and the most
frequent words of the corpus become symbols; then each block's words are joined with the sums (a frequent word has a
row for each block, and a join can be split where that is skewed), which return to a second file. Training
passes over every training token of every block once, in ROUNDS rounds: in each, all tasks go through a part of each of
their blocks from common start values, and their parameters are averaged in a tree to be the next round's start.
Scoring is a pass over the same files.

Defined results: a null text is empty and has the end alone; a null doc_id is scored and counts as held out
neither way (held_out is null, and the text is not learned from); with no training token at all, every word is
unknown; repeated rows count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import chunks, crc_mod, docs_of, get_bytes, partitions, prepare, put_bytes, spread, work_path, written

WORDS = 1023  # frequent words with a symbol of their own, after the end
CLASSES = 384
SYMBOLS = 1 + WORDS + CLASSES
CONTEXT = 2
DIM = 16
NOISE = 24
BATCH = 2048
BLOCK_BYTES = 16 << 20
ROUNDS = 3
SMOOTH = 0.1


class Numbers(dict):
    """Numbers of words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def read_blocks(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text, held) as files of word numbers; (block, idx, token, n) of each block's words.

    Number 0 is the end of a text, as the token of no bytes; n counts a word in training texts.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, rows in enumerate(chunks(batches, BLOCK_BYTES, ["doc_id", "held"])):
            block = part << 32 | k
            number = Numbers({b"": 0})
            seqs = [np.fromiter(map(number.__getitem__, t.lower().split()), np.uint32) for t, _, _ in rows]
            learn = np.array([h is False for _, _, h in rows])
            sizes = np.array([len(s) for s in seqs], np.int64)
            flat = np.concatenate(seqs)
            n = np.bincount(flat[np.repeat(learn, sizes)], minlength=len(number)).astype(np.int64)
            n[0] = learn.sum()
            ids = np.array([0 if i is None else i for _, i, _ in rows], "<i8")
            flags = np.array([(i is None) | (h is not False) << 1 | (h is None) << 2 for _, i, h in rows], np.uint8)
            put_bytes(f"{path}/{block:016x}.seq", struct.pack("<q", len(rows)) + ids.tobytes() + sizes.tobytes() + flags.tobytes() + zstandard.ZstdCompressor(level=1).compress(flat.astype("<u4").tobytes()))
            words = list(number)
            for a in range(0, len(words), 20_000):
                z = min(len(words), a + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(z - a, block)), pa.array(np.arange(a, z, dtype=np.int32)), pa.array(words[a:z], pa.binary()), pa.array(n[a:z])], names=["block", "idx", "token", "n"])

    return written(docs.mapInArrow(run, "block long, idx int, token binary, n long"), "words")


class Block:
    """A block's texts as word numbers (without ends), and per word number its count and symbol."""

    def __init__(self, path: str, block: int):
        import zstandard

        raw = bytes(get_bytes(f"{path}/{block:016x}.seq"))
        (n,) = struct.unpack_from("<q", raw)
        ids = np.frombuffer(raw, "<i8", n, 8)
        self.sizes = np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        flags = np.frombuffer(raw, np.uint8, n, 8 + 16 * n)
        self.ids = [None if f & 1 else int(i) for i, f in zip(ids, flags, strict=True)]
        self.learn = (flags & 2) == 0
        self.held = [None if f & 4 else bool(f & 2) for f in flags]
        total = int(self.sizes.sum())
        self.flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8 + 17 * n :], max_output_size=max(1, 4 * total)), "<u4") if total else np.zeros(0, np.uint32)
        self.counts, self.symbols = np.zeros(0, np.int64), np.zeros(0, np.int32)
        raw = bytes(get_bytes(f"{path}/{block:016x}.map"))
        (n,) = struct.unpack_from("<q", raw)
        self.counts, self.symbols = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i4", n, 8 + 8 * n)

    def parts(self, most: int = 1 << 19) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Texts in runs of about `most` words: which, their words with an end after each, and each text's begin."""
        begin = np.concatenate([[0], np.cumsum(self.sizes)])
        k = 0
        while k < len(self.sizes):
            j = max(k + 1, int(np.searchsorted(begin, begin[k] + most, "right")) - 1)
            size = self.sizes[k:j] + 1
            at = np.cumsum(size) - size
            words = np.zeros(int(size.sum()), np.uint32)
            inner = np.ones(len(words), bool)
            inner[at + size - 1] = False
            words[inner] = self.flat[begin[k] : begin[j]]
            yield slice(k, j), words, at
            k = j


def counted(words: DataFrame) -> DataFrame:
    """(token, c, symbol) of all words, with counts c over the corpus."""
    spark = words.sparkSession
    sums = written(words.groupBy("token").agg(F.sum("n").alias("c")), "sums")
    often = sums.filter((F.length("token") > 0) & (F.col("c") > 0)).orderBy(F.desc("c"), "token").limit(WORDS)
    top = [bytes(r.token) for r in often.collect()]  # WORDS rows at most
    known = spark.createDataFrame([(t, k + 1) for k, t in enumerate(top)], "token binary, symbol int")
    other = F.lit(1 + WORDS) + (F.crc32(F.expr("substring(token, -2, 2)")) % CLASSES).cast("int")
    x = sums.join(F.broadcast(known), "token", "left")
    return x.select("token", "c", F.when(F.length("token") == 0, 0).otherwise(F.coalesce("symbol", other)).alias("symbol"))


def return_counts(words: DataFrame, sums: DataFrame, path: str) -> DataFrame:
    """Writes the counts and symbols of each block's words beside its texts; (block)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, held = None, []

        def put() -> pa.RecordBatch:
            c, s = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("c", "symbol"))
            put_bytes(f"{path}/{now:016x}.map", struct.pack("<q", len(c)) + c.astype("<i8").tobytes() + s.astype("<i4").tobytes())
            return pa.RecordBatch.from_pydict({"block": [now]})

        for b in batches:
            f = b.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(f[1:] != f[:-1]) + 1).tolist(), len(f)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x < y:
                    if now is not None and f[x] != now:
                        yield put()
                        held = []
                    now = int(f[x])
                    held.append(b.slice(x, y - x))
        if held:
            yield put()

    met = written(words.select("block", "idx", "token").join(sums, "token").select("block", "idx", "c", "symbol"), "counted")
    rows = met.repartition(partitions(words.sparkSession), "block").sortWithinPartitions("block", "idx")
    return written(rows.mapInArrow(run, "block long"), "blocks")


class Network:
    """The log-bilinear network: vectors of symbols as context (one more for before a text) and as target, position scales, biases."""

    NAMES = ("q", "r", "s", "b")

    def __init__(self, p: dict[str, np.ndarray], sums: dict[str, np.ndarray] | None = None):
        self.p = p
        self.sums = sums or {k: np.full_like(v, 0.02) for k, v in p.items()}  # of squared gradients: the steps' sizes

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        rng = np.random.Generator(np.random.PCG64(3))
        share = (counts + 0.5) / (counts + 0.5).sum()
        shape = lambda n: rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        return cls({"q": shape(SYMBOLS + 1), "r": shape(SYMBOLS), "s": np.ones((CONTEXT, DIM), np.float32), "b": np.log(share).astype(np.float32)})

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], counts: np.ndarray, seed: tuple[int, ...] = (), rate: float = 0.15) -> int:
        """AdaGrad steps over (context, target) batches against noise of the symbols' frequencies; targets seen.

        Each call needs noise of its own (seed): what is drawn twice over is pushed down twice, and the rest never.
        """
        rng = np.random.Generator(np.random.PCG64([5, *seed]))
        share = (counts + 0.5) / (counts + 0.5).sum()
        edges = np.cumsum(share)
        lift = np.log(NOISE * share).astype(np.float32)
        p, sums = self.p, self.sums
        seen = 0

        def scatter(i, g, n):
            return np.stack([np.bincount(i, weights=g[:, f], minlength=n) for f in range(DIM)], axis=1).astype(np.float32)

        for ctx, target in batches:
            n = len(target)
            seen += n
            vectors = [p["q"][c] for c in ctx]
            h = sum(v * p["s"][k] for k, v in enumerate(vectors))
            noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), SYMBOLS - 1)
            rt, rn = p["r"][target], p["r"][noise]
            own = 1 / (1 + np.exp((h * rt).sum(1) + p["b"][target] - lift[target]))  # 1 - P(data)
            other = 1 / (1 + np.exp(lift[noise] - h @ rn.T - p["b"][noise]))  # P(data)
            g = {"r": scatter(target, own[:, None] * h, SYMBOLS), "b": np.bincount(target, weights=own, minlength=SYMBOLS).astype(np.float32)}
            np.subtract.at(g["r"], noise, other.T @ h)
            np.subtract.at(g["b"], noise, other.sum(0))
            gh = own[:, None] * rt - other @ rn
            g["s"] = np.stack([(gh * v).sum(0) for v in vectors])
            g["q"] = sum(scatter(c, gh * p["s"][k], SYMBOLS + 1) for k, c in enumerate(ctx))
            for k, v in g.items():
                v /= n / 64
                sums[k] += v * v
                p[k] += (rate if k != "s" else rate / 10) * v / np.sqrt(sums[k])
        return seen

    def normaliser(self, pairs: np.ndarray) -> np.ndarray:
        """Log of the sum over all symbols, for contexts given as one number each."""
        p, out = self.p, np.zeros(len(pairs), np.float32)
        for k in range(0, len(pairs), 4096):
            a, b = np.divmod(pairs[k : k + 4096], SYMBOLS + 1)
            z = (p["q"][b] * p["s"][0] + p["q"][a] * p["s"][1]) @ p["r"].T + p["b"]
            top = z.max(1, keepdims=True)
            out[k : k + 4096] = top[:, 0] + np.log(np.exp(z - top).sum(1))
        return out

    def log_probabilities(self, ctx: tuple, target: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of targets; table keeps normalisers by context, NaN where unknown yet."""
        p = self.p
        pair = ctx[1].astype(np.int64) * (SYMBOLS + 1) + ctx[0]
        new = np.unique(pair[np.isnan(table[pair])])
        table[new] = self.normaliser(new)
        out = np.empty(len(target), np.float32)
        for k in range(0, len(target), 1 << 16):
            x = slice(k, k + (1 << 16))
            h = p["q"][ctx[0][x]] * p["s"][0] + p["q"][ctx[1][x]] * p["s"][1]
            out[x] = np.einsum("ij,ij->i", h, p["r"][target[x]]) + p["b"][target[x]]
        return out - table[pair]

    def dump(self) -> bytes:
        return b"".join(x[k].astype("<f4").tobytes() for x in (self.p, self.sums) for k in self.NAMES)

    @classmethod
    def load(cls, raw: bytes) -> Network:
        shapes = {"q": (SYMBOLS + 1, DIM), "r": (SYMBOLS, DIM), "s": (CONTEXT, DIM), "b": (SYMBOLS,)}
        both, at = [], 0
        for _ in range(2):
            out = {}
            for k in cls.NAMES:
                n = math.prod(shapes[k])
                out[k] = np.frombuffer(raw, "<f4", n, at).reshape(shapes[k]).copy()
                at += 4 * n
            both.append(out)
        return cls(*both)


def contexts(sym: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two before each; SYMBOLS stands before a text's begin."""
    one, two = np.empty_like(sym), np.empty_like(sym)
    one[1:], two[2:] = sym[:-1], sym[:-2]
    one[begin] = two[begin] = SYMBOLS
    after = begin[begin + 1 < len(sym)] + 1
    two[after] = SYMBOLS  # also where the next text begins at once
    return one, two


def train(blocks: DataFrame, path: str, counts: np.ndarray) -> Network:
    """One pass over all training tokens, in ROUNDS; after each the tasks' networks are averaged by their tokens, 32 at a time."""
    spark = blocks.sparkSession
    form = "weight long, raw binary"
    net = Network.start(counts)

    def mean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, weight = None, 0
        for b in batches:
            for w, raw in zip(b.column("weight").to_pylist(), b.column("raw").to_pylist(), strict=True):
                x = np.frombuffer(raw, "<f4").astype(float) * w
                total, weight = x if total is None else total + x, weight + w
        if weight:
            yield pa.RecordBatch.from_pydict({"weight": pa.array([weight], pa.int64()), "raw": pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())})

    def part(turn: int, sent):
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            raw, counts = sent.value
            net = Network.load(raw)

            ids = [k for b in batches for k in b.column("block").to_pylist()]

            def data():
                for k in ids:
                    block, at = Block(path, k), 0
                    for which, words, begin in block.parts():
                        learn = np.repeat(block.learn[which], block.sizes[which] + 1)
                        sym = block.symbols[words]
                        one, two = contexts(sym, begin)
                        one, two, sym = one[learn], two[learn], sym[learn]
                        for a in range(0, len(sym), BATCH):
                            if at % ROUNDS == turn:
                                z = slice(a, a + BATCH)
                                yield (one[z], two[z]), sym[z]
                            at += 1

            seen = net.train(data(), counts, (turn, *ids[:1]))
            yield pa.RecordBatch.from_pydict({"weight": pa.array([seen], pa.int64()), "raw": pa.array([net.dump()], pa.binary())})

        return run

    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((net.dump(), counts))
        nets = written(spread(blocks).mapInArrow(part(turn, sent), form), "nets").filter("weight > 0")
        n = nets.count()
        while n > 1:
            n = -(-n // 32)
            nets = written(nets.repartition(n).mapInArrow(mean, form), "nets")
            n = min(n, nets.count())
        found = nets.collect()  # one network
        net = Network.load(bytes(found[0].raw)) if found else net
    return net


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(blocks: DataFrame, path: str, net: Network, totals: dict) -> DataFrame:
    """A row for each text of the blocks."""
    sent = blocks.sparkSession.sparkContext.broadcast((net.dump(), totals))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        raw, t = sent.value
        net = Network.load(raw)
        table = np.full((SYMBOLS + 1) ** 2, np.nan, np.float32)
        floor = math.log10(t["n"] + SMOOTH * (t["v"] + 1))
        share = np.log10(t["class_n"] + SMOOTH * (t["class_v"] + 1))
        for b in batches:
            for k in b.column("block").to_pylist():
                block = Block(path, k)
                log = np.log10(block.counts + SMOOTH)
                in_class = np.where(block.symbols > WORDS, log - share[np.maximum(block.symbols - 1 - WORDS, 0)], 0)
                known = block.counts > 0
                for which, words, at in block.parts():
                    sym = block.symbols[words]
                    own = net.log_probabilities(contexts(sym, at), sym, table) / math.log(10)
                    size = block.sizes[which] + 1
                    cols = [
                        pa.array(block.ids[which], pa.int64()), pa.array(block.held[which], pa.bool_()), pa.array(size), pa.array(np.add.reduceat(known[words].astype(np.int64), at)),
                        pa.array(np.full(len(size), t["n"])), pa.array(np.add.reduceat(log[words], at) - floor * size), pa.array(np.add.reduceat(own + in_class[words], at, dtype=np.float64)),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in OUT.split(", ")])

    return spread(blocks).mapInArrow(run, OUT)


def score_texts(docs: DataFrame, held) -> DataFrame:
    """Scores every row of docs (doc_id, text); rows where the boolean column held is false are learned from."""
    spark = docs.sparkSession
    prepare(spark)
    path = work_path(spark, "lm")
    x = docs_of(docs, held.alias("held")).select(F.col("doc_id").cast("long"), "text", "held")
    words = read_blocks(x, path)
    sums = counted(words)
    blocks = return_counts(words, sums, path)
    per = sums.filter("c > 0").groupBy("symbol").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # SYMBOLS rows at most
    counts, kinds = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
    for r in per:
        counts[r.symbol], kinds[r.symbol] = r.n, r.v
    net = train(blocks, path, counts)
    return score(blocks, path, net, {"n": int(counts.sum()), "v": int(kinds.sum()), "class_n": counts[1 + WORDS :], "class_v": kinds[1 + WORDS :]})


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose crc32 modulo 10 is not 0."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), crc_mod(10) == 0)
