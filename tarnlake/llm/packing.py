"""Vector bin packing into training sequences, by the dot-product heuristic.

An example asks for a vector of tokens, one segment, and loss-bearing tokens; a sequence has a limit on each.
It goes to the open sequence where it fits and where the dot product of what it asks for and what the sequence
has left, both as shares of the limits, is largest; so long examples go where tokens are left, and many short
ones where segments are. Where cutting is allowed, an example that fits nowhere fills the sequence with the most
tokens left and goes on elsewhere; at the end what is open is cut into full sequences and the rest into
sequences whose lengths are powers of two, so that only the segment limit can cause padding.

Each partition of the input is packed by itself in one pass without a shuffle; sequence ids hold the
partition's number in the upper bits. Defined results: a null text is empty and has its end id alone; a null
example is kept with its null id; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import PIECES, docs_of, encoder, prepare

END = 0


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 256
    loss: int = 1024
    open: int = 64  # sequences that are kept open at once


@dataclass
class Piece:
    """length units of an example from start; loss of them bear loss. body: what cut() slices along."""

    key: object
    start: int
    length: int
    loss: int
    body: object = None

    def cut(self, n: int) -> tuple[Piece, Piece]:
        """Two pieces, the first of n tokens; loss-bearing tokens are at the end of an example or all of it."""
        first = n if self.loss == self.length else max(0, self.loss - (self.length - n))
        b = self.body
        return (
            Piece(self.key, self.start, n, first, None if b is None else b[:n]),
            Piece(self.key, self.start + n, self.length - n, self.loss - first, None if b is None else b[n:]),
        )


@dataclass
class Packer:
    limits: Limits
    may_cut: bool
    bins: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self):
        import numpy as np

        lim = self.limits
        self.full = np.array([lim.tokens, lim.segments, lim.loss], float)
        self.left = np.zeros((0, 3))

    def _close(self, k: int) -> list[Piece]:
        import numpy as np

        self.left = np.delete(self.left, k, axis=0)
        return self.bins.pop(k)

    def _place(self, k: int, p: Piece) -> list[list[Piece]]:
        self.bins[k].append(p)
        self.left[k] -= (p.length, 1, p.loss)
        return [self._close(k)] if (self.left[k, :2] <= 0).any() else []

    def _open(self, p: Piece) -> list[list[Piece]]:
        import numpy as np

        self.bins.append([])
        self.left = np.vstack([self.left, self.full])
        return self._place(len(self.bins) - 1, p)

    def add(self, p: Piece) -> list[list[Piece]]:
        """Places a piece; the sequences that are complete."""
        lim, done = self.limits, []
        if p.length > lim.tokens or p.loss > lim.loss:
            if not self.may_cut:
                return [[p]]  # alone, as it is: callers see that it is over the limits
            most = min(lim.tokens, lim.loss)
            while p.length >= most:
                head, p = p.cut(most)
                done.append([head])
            if not p.length:
                return done
        while True:
            ask = (p.length, 1, p.loss)
            if len(self.bins):
                fits = (self.left >= ask).all(axis=1)
                if fits.any():
                    gain = (self.left / self.full) @ (ask / self.full)
                    gain[~fits] = -1
                    return done + self._place(int(gain.argmax()), p)
            if len(self.bins) < lim.open:
                return done + self._open(p)
            k = int(self.left[:, 0].argmax())
            room = int(min(self.left[k, 0], self.left[k, 2])) if p.loss == p.length else 0
            if self.may_cut and room > 0:
                head, p = p.cut(room)
                done += self._place(k, head)
            else:
                done.append(self._close(int(self.left[:, 0].argmin())))

    def finish(self) -> list[list[Piece]]:
        """The sequences that are still open; where cutting is allowed, made full."""
        rest, self.bins = self.bins, []
        if not self.may_cut or self.limits.loss < self.limits.tokens:
            return rest
        out, now, left = [], [], self.limits.tokens
        total = sum(p.length for b in rest for p in b)
        for p in (p for b in rest for p in b):
            while p is not None:
                if not now:
                    left = self.limits.tokens if total >= self.limits.tokens else 1 << (total.bit_length() - 1)
                n = min(left, p.length)
                head, p = p.cut(n) if n < p.length else (p, None)
                now.append(head)
                left -= n
                total -= n
                if not left or len(now) == self.limits.segments:
                    out.append(now)
                    now = []
        return [*out, now] if now else out


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = END, known: int = PIECES) -> DataFrame:
    """Documents (doc_id, text) as ids with an end id, cut freely into pieces in sequences: a row for each piece.

    known: the size of the encoders' tables, which is memory of each worker against time; ids do not hang on it.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        kinds = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
        encode, packer = encoder(tokenizer, known), Packer(limits, True)
        base, n = TaskContext.get().partitionId() << 40, 0
        rows: list[tuple] = []

        def emit(done: list[list[Piece]]) -> None:
            nonlocal n
            for seq in done:
                at = 0
                for p in seq:
                    doc_id, whole = p.key
                    rows.append((doc_id, p.start, p.length, zlib.crc32(p.body.tobytes()), whole, base + n, at))
                    at += p.length
                n += 1

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], schema=kinds)
            rows.clear()
            return out

        end = np.array([end_id], "<u4")
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.concatenate([encode(text), end])
                emit(packer.add(Piece((doc_id, len(ids)), 0, len(ids), len(ids), ids)))
            yield batch()
        emit(packer.finish())
        yield batch()

    return docs_of(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_examples(examples: DataFrame, limits: Limits) -> DataFrame:
    """Whole examples (example_id, n_tokens, n_loss; nulls count as 0) in sequences: sequence_id, slot and offset.

    An example that exceeds a limit by itself gets a sequence of its own, with fits false.
    """
    prepare(examples.sparkSession)
    n = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    x = examples.select(F.col("example_id").cast("long"), n("n_tokens").alias("n_tokens"), n("n_loss").alias("n_loss"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        packer, base, n = Packer(limits, False), TaskContext.get().partitionId() << 40, 0
        names = ["example_id", "n_tokens", "n_loss", "sequence_id", "slot", "offset", "fits"]

        def rows(done):
            nonlocal n
            for seq in done:
                at = 0
                for slot, p in enumerate(seq):
                    yield p.key, p.length, p.loss, base + n, slot, at, p.length <= limits.tokens and p.loss <= limits.loss
                    at += p.length
                n += 1

        def batch(done):
            got = list(rows(done))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True) if got else [[]] * 7, [pa.int64()] * 6 + [pa.bool_()], strict=True)], names=names)

        for b in batches:
            rows_in = zip(*(b.column(c).to_pylist() for c in names[:3]), strict=True)  # of a batch, the largest first
            yield batch([s for key, length, loss in sorted(rows_in, key=lambda r: -max(r[1] / limits.tokens, r[2] / limits.loss)) for s in packer.add(Piece(key, 0, length, loss))])
        yield batch(packer.finish())

    return x.mapInArrow(run, "example_id long, n_tokens long, n_loss long, sequence_id long, slot long, offset long, fits boolean")


INSTRUCTIONS = Limits(tokens=1024, segments=8, loss=512)


def conversation_examples(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Examples of instruction data from conversations (conv_id, role, text): the ids of all turns, each with an end id, of
    which those of the assistant's turns bear loss. A null text is its end id alone; a null conv_id is one example."""
    prepare(turns.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(tokenizer)
        width = int(encode.kind[-1])
        for b in batches:
            n = [len(encode.packed(t)) // width + 1 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(n, pa.int64()), b.column("loss")], names=["conv_id", "n", "loss"])

    x = turns.select(F.col("conv_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    counted = x.mapInArrow(run, "conv_id long, n long, loss boolean")
    return counted.groupBy(F.col("conv_id").alias("example_id")).agg(F.sum("n").alias("n_tokens"), F.coalesce(F.sum(F.when(F.col("loss"), F.col("n"))), F.lit(0)).alias("n_loss"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, whole, in sequences of at most 1024 tokens, 8 segments and 512 loss-bearing tokens."""
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return pack_examples(conversation_examples(turns, public_tokenizers.path("byte_bpe_50k.json")), INSTRUCTIONS)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
