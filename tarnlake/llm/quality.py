"""Quality scores by a factorisation machine.

A text's features are its hashed words (log counts, of unit length together), structure statistics (shares of
character classes, repeats, lengths) and its size as metadata. Score: the sigmoid of bias, linear terms and all
pairwise interactions of rank RANK, these in linear time by the sum-of-squares identity
    sum over pairs <v_i, v_j> x_i x_j = half the sum over f of ((sum v_if x_i)^2 - sum v_if^2 x_i^2).

The machine is fitted on the driver on at most MAX_TRAIN labelled rows, those of the smallest hashes of their
id; every document is scored. Defined results: a null text is empty and scored like any other; rows with a null
label teach nothing; where nothing, or one class alone, was learned, all scores are the share of label 1 (0.5
without labels); a null doc_id is kept, never taught; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import crc_mod, docs_of, prepare, release, texts

WORDS = 4096
RANK = 4
MAX_TRAIN = 6000
ROWS = 1024  # rows of which a step's gradient is taken at once

#: Character classes: lower, upper, digit, space, line end, each of some signs, other ASCII, beyond ASCII.
SIGNS = b".,&%$#*|!?<>/="
CLASS = np.full(256, 5 + len(SIGNS), np.uint8)
CLASS[ord("a") : ord("z") + 1], CLASS[ord("A") : ord("Z") + 1], CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
CLASS[[9, 32]], CLASS[[10, 13]] = 3, 4
for _k, _c in enumerate(SIGNS):
    CLASS[_c] = 5 + _k
CLASS[128:] = 6 + len(SIGNS)
CLASSES = 7 + len(SIGNS)
STATS = CLASSES + 9


class Features:
    """Features of one text: word buckets, their values, and statistics. Buckets of words are kept in a bounded table."""

    NUMBERS = list(range(WORDS))

    def __init__(self, most: int = 100_000):
        release()
        self.most, self.known = most, {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = text.lower().split()
        known = self.known
        got = list(map(known.get, words))
        if None in got:
            if len(known) > self.most:
                known.clear()
            got = [known[w] if w in known else known.setdefault(w, self.NUMBERS[zlib.crc32(w) & WORDS - 1]) for w in words]
        stats = np.zeros(STATS, np.float32)
        buf = np.frombuffer(text, np.uint8)
        n, m = max(1, len(buf)), max(1, len(words))
        stats[:CLASSES] = np.bincount(CLASS[buf], minlength=CLASSES) / n
        b = np.array(got, np.int64)
        counts = np.bincount(b, minlength=WORDS)
        i = np.flatnonzero(counts)
        top = np.sort(counts[i])[-3:] if len(i) else np.zeros(1)
        lines = text.split(b"\n")
        stats[CLASSES:] = (
            np.log1p(len(buf)), np.log1p(len(words)), len(buf) / m / 10, len(set(words)) / m, top[-1] / m, top.sum() / m,
            np.count_nonzero(b[1:] == b[:-1]) / m, 1 - len(set(lines)) / len(lines), len(lines) / m,
        )
        v = np.log1p(counts[i]).astype(np.float32)
        return i.astype(np.uint16), v / max(1e-6, float(np.sqrt((v * v).sum()))), stats


@dataclass
class Machine:
    bias: float
    w: np.ndarray  # of words, then statistics
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4) / 4

    def scores(self, rows: list[tuple]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        size = np.array([len(r[0]) for r in rows])
        i = np.concatenate([r[0] for r in rows]).astype(np.int64)
        x = np.concatenate([r[1] for r in rows]).astype(np.float64)
        row = np.repeat(np.arange(len(rows)), size)
        s = self.scaled(np.stack([r[2] for r in rows])).astype(np.float64)
        add = lambda a: np.bincount(row, weights=a, minlength=len(rows))
        out = self.bias + add(self.w[i] * x) + s @ self.w[WORDS:]
        for f in range(self.v.shape[1]):
            t = self.v[i, f] * x
            u = self.v[WORDS:, f]
            out += 0.5 * ((add(t) + s @ u) ** 2 - add(t * t) - (s * s) @ (u * u))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_rows(rows: list[tuple], y: np.ndarray, steps: int = 150, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam over all rows at once; a tenth of them picks the step that is kept."""
    rng = np.random.Generator(np.random.PCG64(seed))
    dims = WORDS + STATS
    share = float(y.mean()) if len(y) else 0.5
    still = Machine(float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))), np.zeros(dims), np.zeros((dims, RANK)), np.zeros(STATS, np.float32), np.ones(STATS, np.float32))
    if not len(rows) or not 0 < share < 1:
        return still
    stats = np.stack([r[2] for r in rows])
    still.mean, still.scale = stats.mean(0), np.maximum(stats.std(0), 1e-4)
    test = np.arange(len(rows)) % 10 == 9
    if len(rows) < 50 or not 0 < y[test].mean() < 1:
        test[:] = False
    order = np.argsort(test, kind="stable")  # the rows that pick the step come last; both parts are views of one matrix
    x = np.zeros((len(rows), dims), np.float32)
    for k, r in enumerate(order.tolist()):
        x[k, rows[r][0]] = rows[r][1]
    x[:, WORDS:] = still.scaled(stats)[order]
    y = y[order].astype(np.float32)
    n = int((~test).sum())
    yt, yv = y[:n], y[n:]
    p = [np.array([still.bias], np.float32), np.zeros(dims, np.float32), rng.normal(0, 0.02, (dims, RANK)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    best, least = None, np.inf

    def margin(a, a2):
        q = a @ p[2]
        return p[0] + a @ p[1] + 0.5 * ((q * q).sum(1) - a2 @ (p[2] * p[2]).sum(1)), q

    def gradients() -> list[np.ndarray]:
        """Summed over blocks of rows, so that nothing of the matrix's size is made beside it."""
        out = [np.zeros(1, np.float32), decay * p[1], decay * p[2]]
        for k in range(0, n, ROWS):
            a = x[k : min(k + ROWS, n)]
            a2 = a * a
            z, q = margin(a, a2)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - yt[k : k + ROWS]) / n
            out[0] = out[0] + e.sum(keepdims=True)
            out[1] = out[1] + a.T @ e
            out[2] = out[2] + a.T @ (e[:, None] * q) - p[2] * (a2.T @ e)[:, None]
        return out

    for step in range(1, steps + 1):
        for k, g in enumerate(gradients()):
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        if step % 10 == 0 or step == steps:
            if len(yv):
                z = np.concatenate([margin(x[k : k + ROWS], x[k : k + ROWS] ** 2)[0] for k in range(n, len(x), ROWS)])
                loss = float(np.mean(np.logaddexp(0, np.where(yv > 0, -z, z))))
            else:
                loss = -step
            if loss < least:
                least, best = loss, [a.copy() for a in p]
    return Machine(float(best[0][0]), best[1].astype(float), best[2].astype(float), still.mean, still.scale)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Machine:
    """Fits on docs (doc_id, text) that labels (doc_id, quality) names; at most `most` labelled rows."""
    prepare(docs.sparkSession)
    taught = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("_id"), (F.col("quality") > 0).cast("int").alias("y"))
    picked = taught.orderBy(F.xxhash64("_id"), "_id", "y").limit(most)
    rows = docs_of(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "y")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = Features()
        for b in batches:
            got = [make(t) for t in texts(b)]
            cols = [[a.tobytes() for a in c] for c in zip(*got, strict=True)] if got else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast("int64"), b.column("y"), *(pa.array(c, pa.binary()) for c in cols)], names=["doc_id", "y", "i", "v", "s"])

    got = rows.mapInArrow(run, "doc_id long, y int, i binary, v binary, s binary").toArrow()  # at most `most` rows, and repeats of their ids
    order = sorted(range(got.num_rows), key=lambda k, ids=got.column("doc_id").to_pylist(): ids[k] * 0x9E3779B97F4A7C15 % (1 << 64))
    cols = [got.column(c).to_pylist() for c in ("i", "v", "s")]
    data = [(np.frombuffer(cols[0][k], np.uint16), np.frombuffer(cols[1][k], np.float32), np.frombuffer(cols[2][k], np.float32)) for k in order][:most]
    y = np.array(got.column("y").to_pylist(), float)[order][:most] if order else np.zeros(0)
    return fit_rows(data, y)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = Features()
        for b in batches:
            rows = [make(t) for t in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.scores(rows), pa.float64())], ["doc_id", "score"])

    return docs_of(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, machine: Machine, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all columns, that score at least `least`."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        make = Features()
        for b in batches:
            yield b.filter(pa.array(sent.value.scores([make(t) for t in texts(b)]) >= least))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, taught by labels whose crc32 modulo 3 is not 1."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    machine = fit(docs, labels.filter(crc_mod(3) != 1))
    return score(docs, machine).select("doc_id", (crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
