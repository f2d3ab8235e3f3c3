"""Approximate nearest neighbours by largest inner product: an inverted file with product-quantised residuals.

Coarse centroids and codebooks are fitted on the driver on at most SAMPLE vectors (those of the smallest hashes
of their ids); every vector is indexed. A vector belongs to the list of its nearest centroid, and its residual
is kept as one byte a subspace. A query visits the lists whose centroids have the largest inner product
with it, as many as hold COVER of the nearest of TRIED sampled vectors in the sample, and more where these hold fewer
vectors than are asked for. There its asymmetric distance tables score all codes. The sample also gives each query a
floor, which at least as many vectors reach as are asked for; only vectors whose score by codes comes so near
to the floor that the error of their codes may hide the rest are scored exactly, in double precision on the original
vectors, which lie beside the codes. That error is known for each vector; it points along the query as a random
direction does, so WIDTH standard deviations of it are allowed for. No number of vectors is set: where many tie, as in a
group of equal vectors, all of them are scored, and no order among equal codes is made up.

Lists are cut into blocks of at most about BLOCK vectors, each with the queries that visit its list, so that a list of
a third of all vectors is many groups, and no group grows with the input. Rows are told apart by numbers of their own:
of a repeated vec_id each row is a candidate, and each that asks gets its own answers, without itself alone.

Defined results: vectors that are null, empty, zero, of another dimension than most, or that hold null or non-finite
components take no part, nor do null ids; ties go to the smaller vec_id; where there are fewer candidates than asked
for, all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import prepare, written

SAMPLE = 16_000
LIST = 256  # vectors a list, about
MOST_LISTS = 2048
SUBSPACES = 16
WIDTH = 2.0  # standard deviations of the error of codes that exact scores allow for
BLOCK = 1024
HELD = 400_000  # answers that a task gathers before it sends them on
TRIED = 256  # vectors of the sample on which the number of probes is set
COVER = 0.97  # share of their nearest in the sample that the probed lists are to hold


def kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    """Centroids of x by Lloyd's rounds from distinct points of it; an empty one moves to a random point."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        s = np.stack([np.bincount(a, weights=x[:, f], minlength=len(c)) for f in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))]).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([(x[k : k + 4096] @ c.T - half).argmax(1) for k in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


@dataclass
class Index:
    """Coarse centroids, and codebooks (subspace, 256, width) of residuals; vectors are padded to whole subspaces."""

    coarse: np.ndarray
    books: np.ndarray
    dims: int
    sample: np.ndarray
    sample_at: np.ndarray  # lists of the sampled vectors
    wide: int = 1  # lists that a query visits

    @classmethod
    def fit(cls, x: np.ndarray, total: int, lists: int | None = None, seed: int = 9) -> Index:
        rng = np.random.Generator(np.random.PCG64(seed))
        width = -(-x.shape[1] // SUBSPACES)
        dims = x.shape[1]
        x = np.pad(x.astype(np.float32), ((0, 0), (0, width * SUBSPACES - dims)))
        k = lists or int(np.clip(-(-total // LIST), 1, MOST_LISTS))
        coarse = kmeans(x, min(k, len(x)), 12, rng)
        at = nearest(x, coarse)
        rest = x - coarse[at]
        books = np.zeros((SUBSPACES, 256, width), np.float32)
        for m in range(SUBSPACES):
            b = kmeans(rest[:, m * width : (m + 1) * width], min(256, len(x)), 8, rng)
            books[m, : len(b)] = b
            books[m, len(b) :] = b[0]
        index = cls(coarse, books, dims, x, at)
        index.wide = index.tuned(x[:TRIED], x)
        return index

    def tuned(self, q: np.ndarray, x: np.ndarray, k: int = 20) -> int:
        """The fewest lists to visit that hold COVER of the k nearest of q in x. A sample is sparser than all
        vectors, so its nearest lie farther away, and the number errs to the safe side."""
        s = q @ x.T
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return len(self.coarse)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        order = np.argsort(-(q @ self.coarse.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        at = np.take_along_axis(place, nearest(x, self.coarse)[near], 1)
        return int(np.ceil(np.quantile(at, COVER))) + 1

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x.astype(np.float32), ((0, 0), (0, self.coarse.shape[1] - x.shape[1])))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List and codes of each vector, and how far it lies from what they say (with room for rounding)."""
        given = np.linalg.norm(x, axis=1)
        x = self.pad(x)
        at = nearest(x, self.coarse)
        rest = x - self.coarse[at]
        w = self.books.shape[2]
        codes = np.stack([nearest(rest[:, m * w : (m + 1) * w], self.books[m]) for m in range(SUBSPACES)], axis=1).astype(np.uint8)
        said = np.concatenate([self.books[m][codes[:, m]] for m in range(SUBSPACES)], axis=1)
        far = np.linalg.norm((rest - said).astype(float), axis=1)
        return at, codes, far * min(1.0, WIDTH / np.sqrt(self.dims)) + 1e-5 * (given + np.linalg.norm(self.coarse[at].astype(float), axis=1))

    def floor(self, q: np.ndarray, k: int, visited: list[np.ndarray]) -> np.ndarray:
        """A score that k vectors of the visited lists, beside the query itself, reach: sampled ones. Minus infinity, if these are fewer."""
        if len(self.sample) <= k:
            return np.full(len(q), -np.inf)
        there = np.zeros((len(q), len(self.coarse)), bool)
        for i, lists in enumerate(visited):
            there[i, lists] = True
        s = np.where(there[:, self.sample_at], self.pad(q) @ self.sample.T, -np.inf)
        return np.partition(s, len(self.sample) - k - 1, axis=1)[:, len(self.sample) - k - 1].astype(float) - 1e-5 * np.linalg.norm(q, axis=1) * np.linalg.norm(self.sample, axis=1).max()

    def probes(self, q: np.ndarray, n: int, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists each query visits, by the centroids' inner products: n, or as many more as hold `least` vectors."""
        order = np.argsort(-(self.pad(q) @ self.coarse.T), axis=1, kind="stable")
        enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
        return [row[: max(n, int(e))] for row, e in zip(order, enough, strict=True)]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(query, subspace, code) inner products."""
        q = self.pad(q).reshape(len(q), SUBSPACES, -1)
        return np.einsum("qmw,mcw->qmc", q, self.books)


    def settle(self, own: np.ndarray, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, err: np.ndarray, at: int, asks: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Of a block of list `at` (row numbers, ids, vectors, codes, errors), each query's k best: query's place, row number, id, score."""
        books = self.tables(q)
        approx = np.repeat((self.pad(q) @ self.coarse[at])[:, None], len(ids), axis=1)
        for m in range(SUBSPACES):
            approx += books[:, m, :][:, codes[:, m]]
        may = approx + np.linalg.norm(q, axis=1)[:, None] * err[None, :] >= floor[:, None]
        may &= asks[:, None] != own[None, :]
        i, j = np.nonzero(may)
        # sums of one pair each: their last bits do not hang on what else is in the block, so ties are ties
        score = np.concatenate([(q[i[s : s + 32768]] * v[j[s : s + 32768]]).sum(axis=1) for s in range(0, len(i), 32768)] or [np.zeros(0)])
        return best([(i, own[j], ids[j], score)], k)


def best(parts: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """Of answers (query, row, id, score) the k best of each query."""
    who, own, ids, score = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((own, ids, -score, who))
    who, own, ids, score = who[order], own[order], ids[order], score[order]
    new = np.ones(len(who), bool)
    new[1:] = who[1:] != who[:-1]
    at = np.flatnonzero(new)
    keep = np.arange(len(who)) - np.repeat(at, np.diff([*at, len(who)])) < k
    return who[keep], own[keep], ids[keep], score[keep]


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part, whatever their dimension."""
    e = "embedding"
    good = f"vec_id IS NOT NULL AND {e} IS NOT NULL AND NOT exists({e}, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists({e}, x -> x <> 0)"
    return df.filter(F.expr(f"coalesce({good}, false)")).select(F.col("vec_id").cast("long"), F.col(e).cast("array<double>").alias("v"))


def matrix(column, dims: int) -> np.ndarray:
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def build(vectors: DataFrame, lists: int | None = None) -> tuple[Index | None, DataFrame, dict[int, int]]:
    """The index of vectors (vec_id, v), its table (row, vec_id, v, list, codes, err), and the vectors of each list."""
    spark = vectors.sparkSession
    prepare(spark)
    form = "vec_id long, v array<double>, list int, codes binary, err double"
    by_dims = {r.n: r["count"] for r in vectors.groupBy(F.size("v").alias("n")).count().collect()}  # a row for each dimension there is
    if not by_dims:
        return None, spark.createDataFrame([], "row long, " + form), {}
    dims = min(by_dims, key=lambda n: (-by_dims[n], n))
    vectors = vectors.filter(F.size("v") == dims)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    index = Index.fit(matrix(sample.column("v"), dims), by_dims[dims], lists)
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                at, codes, err = sent.value.encode(matrix(b.column("v"), dims))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err)], names=["vec_id", "v", "list", "codes", "err"])

    table = written(vectors.mapInArrow(run, form).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "list", "codes", "err"), "index")
    sizes = {r["list"]: r["count"] for r in table.groupBy("list").count().collect()}  # MOST_LISTS rows at most
    return index, table, sizes


def search(index: Index, table: DataFrame, sizes: dict[int, int], queries: DataFrame, k: int = 20, probes: int | None = None) -> DataFrame:
    """The k nearest of each row of queries (row, query_id, v) but the row of its own number: row, query_id, rank, vec_id, score."""
    spark = table.sparkSession
    blocks = {x: -(-n // BLOCK) for x, n in sizes.items()}
    base, at = {}, 0
    for x in sorted(blocks):
        base[x], at = at, at + blocks[x]
    held = np.zeros(len(index.coarse), np.int64)
    held[list(sizes)] = list(sizes.values())
    sent = spark.sparkContext.broadcast((index, base, blocks, held))
    lists = spark.createDataFrame([(x, base[x], blocks[x]) for x in sorted(blocks)], "list int, base int, n int")
    items = table.join(F.broadcast(lists), "list").select((F.col("base") + F.pmod(F.xxhash64("row"), F.col("n")).cast("int")).alias("gid"), F.lit(False).alias("ask"), "row", F.col("vec_id").alias("id"), "v", "list", "codes", "err")
    form = "gid int, ask boolean, row long, id long, v array<double>, list int, codes binary, err double"  # of a query, err is its floor

    def visit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, base, blocks, held = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column("v"), index.dims)
            to = index.probes(q, probes or index.wide, held, k + 1)
            floor = np.concatenate([index.floor(q[s : s + 256], k, to[s : s + 256]) for s in range(0, len(q), 256)])
            pairs = [(r, base[x] + j, x) for r, row in enumerate(to) for x in row.tolist() if x in base for j in range(blocks[x])]
            for a in range(0, len(pairs), 10_000):
                r, gid, at = (np.array(c, np.int32) for c in zip(*pairs[a : a + 10_000], strict=True))
                i = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(gid), pa.array(np.ones(len(r), bool)), *(b.column(c).take(i) for c in ("row", "id", "v")), pa.array(at), pa.nulls(len(r), pa.binary()), pa.array(floor[r])], names=["gid", "ask", "row", "id", "v", "list", "codes", "err"])

    asked = queries.select("row", F.col("query_id").alias("id"), "v").filter(F.size("v") == index.dims).mapInArrow(visit, form)
    met = items.unionAll(asked).repartition("gid").sortWithinPartitions("gid", "ask")

    def answer(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = sent.value[0]
        names = ["row", "query_id", "own", "vec_id", "score"]
        gid, block, waiting = None, [], []
        numbers: dict[int, int] = {}  # of the queries a task has met: their row numbers, and ids
        known: list[tuple[int, int]] = []
        parts, gathered = [], 0

        def batch(part: tuple):
            who, own, ids, score = part
            at = np.array(known, np.int64).reshape(-1, 2)[who]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (at[:, 0].copy(), at[:, 1].copy(), own, ids, score)], names=names)

        def flush():
            """Answers are combined over the task's blocks, and go out when HELD of them have gathered."""
            nonlocal waiting, parts, gathered
            if block and waiting:
                own, ids, v, codes, err = (np.concatenate([x[c] for x in block]) for c in range(5))
                for rows, qids, q, floor, at in waiting:
                    for s in range(0, len(rows), 128):
                        z = slice(s, s + 128)
                        who, *rest = index.settle(own, ids, v, codes, err, at, rows[z], q[z], floor[z], k)
                        place = np.empty(len(rows[z]), np.int64)
                        for x, (r, i) in enumerate(zip(rows[z].tolist(), qids[z].tolist(), strict=True)):
                            if r not in numbers:
                                numbers[r] = len(known)
                                known.append((r, i))
                            place[x] = numbers[r]
                        parts.append((place[who], *rest))
                        gathered += len(who)
                if gathered > HELD:
                    parts = [best(parts, k)]
                    gathered = len(parts[0][0])
                    if gathered > HELD // 2:
                        yield batch(parts[0])
                        parts, gathered = [], 0
                        numbers.clear()
                        known.clear()
            waiting = []

        for b in batches:
            if not b.num_rows:
                continue
            g = b.column("gid").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if g[x] != gid:
                    yield from flush()
                    gid, block = g[x], []
                s = b.slice(x, y - x)
                n = int((~s.column("ask").to_numpy(zero_copy_only=False)).sum())
                rows, ids, vectors, err = s.column("row").to_numpy(), s.column("id").to_numpy(), matrix(s.column("v"), index.dims), s.column("err").to_numpy()
                if n:
                    codes = np.frombuffer(b"".join(s.column("codes").slice(0, n).to_pylist()), np.uint8).reshape(n, SUBSPACES)
                    block.append((rows[:n], ids[:n], vectors[:n], codes, err[:n]))
                if n < len(rows):
                    waiting.append((rows[n:], ids[n:], vectors[n:], err[n:], s.column("list")[0].as_py()))
                    if sum(len(w[0]) for w in waiting) > 8192:
                        yield from flush()
        yield from flush()
        if parts:
            yield batch(best(parts, k))

    found = met.mapInArrow(answer, "row long, query_id long, own long, vec_id long, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "own")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("row", "query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all."""
    vectors = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    index, table, sizes = build(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asks = table.filter("vec_id % 20 = 0").select("row", F.col("vec_id").alias("query_id"), "v")
    return search(index, table, sizes, asks).select("query_id", "rank", "vec_id", "score")
