"""What the operators of this package share: the shared folder, written stages, blocks and tokenizers."""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.session import ensure_workers, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches small in rows and bytes, so that long texts fit Python workers, which can import this package."""
    ensure_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df as a Parquet table in the shared folder, reread: lineage is cut, and a lost executor costs no recomputation.

    What the write shuffled is not needed once it is done, and goes at its end.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    held = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if held is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, held)
    out = spark.read.schema(df.schema).parquet(path)
    out._tl_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written that nothing reads any more."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._tl_path)
        at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def local_path(path: str) -> str | None:
    """The path on a mounted file system, or None for a remote store."""
    m = re.match(r"^(?:file:(?://)?)?(/.*)$", path)
    return m[1] if m else None


def put_bytes(path: str, data) -> None:
    """Writes a file whole: under another name first, then renamed; a repeated task writes the same again."""
    at = local_path(path)
    if at is not None:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        tmp = f"{at}.{uuid.uuid4().hex[:8]}.tmp"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, at)
        return
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(os.path.dirname(inner), recursive=True)
    with store.open_output_stream(inner) as f:
        f.write(data)


def get_bytes(path: str):
    """A file's bytes, memory-mapped where the path is mounted."""
    import numpy as np

    at = local_path(path)
    if at is not None:
        return np.memmap(at, dtype=np.uint8, mode="r") if os.path.getsize(at) else np.zeros(0, np.uint8)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    with store.open_input_file(inner) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


def docs_of(df: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of a table, and the named other columns; whatever else it has is left unread."""
    return df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def texts(batch, column: str = "text") -> list[bytes]:
    """A string column of an Arrow batch as bytes, undecoded; nulls are empty."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def chunks(batches: Iterator, most_bytes: int, columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of Arrow batches as lists of tuples (text first, as bytes) of at most most_bytes, or one long text."""
    out: list[tuple] = []
    held = 0
    for b in batches:
        rest = [b.column(b.schema.get_field_index(c)).to_pylist() for c in columns]
        for row in zip(texts(b), *rest, strict=True):
            if out and held + len(row[0]) > most_bytes:
                yield out
                out, held = [], 0
            out.append(row)
            held += len(row[0]) + 64
    if out:
        yield out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Range-partitioned and sorted by keys."""
    return df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)


def spread(df: DataFrame) -> DataFrame:
    """A small table of work items dealt out evenly."""
    return df.repartition(partitions(df.sparkSession))


def ascii_lower(c):
    """A-Z in lower case; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def crc_mod(n: int, c: str = "doc_id"):
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(c).cast("string")) % n


BITS = 1 << 23


def bit_table(rks: DataFrame, most: int = BITS) -> DataFrame:
    """A table of `most` bits, of bounded size, of those that stand for hashes rk."""
    bits = rks.select(F.pmod("rk", F.lit(most)).alias("bit"))
    return bits.groupBy(F.floor(F.col("bit") / 64).alias("__tl_word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("__tl_bits"))


def marked(df: DataFrame, rk: str, table: DataFrame) -> DataFrame:
    """df with __tl_maybe: whether the bit of its hash rk is set in table, as it is for all hashes that made it."""
    held = df.join(F.broadcast(table), F.floor(F.pmod(rk, F.lit(BITS)) / 64) == F.col("__tl_word"), "left")
    return held.withColumn("__tl_maybe", F.coalesce(F.expr(f"(shiftright(__tl_bits, cast(pmod({rk}, {BITS}) % 64 as int)) & 1) = 1"), F.lit(False)))


#: Fixed by the byte-level scheme: printable bytes stand for themselves, the others for code points from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


#: Pieces in each of an encoder's two tables.
PIECES = 500_000


class WordEncoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, encoding each distinct piece once.

    The ids are those of the library's encode with add_special_tokens=False. The byte-level pattern always breaks before
    a space that follows a non-space character, so a text may be cut there and its pieces encoded apart. A piece of
    Latin letters, digits, ASCII signs and line ends is cut by the same pattern here and goes to the library's model at
    once; any other goes through the whole library, and so does a text that holds one of the file's added tokens, which
    the library finds before it cuts. Pieces are kept in two tables of at most `most` each: when the newer is
    full it becomes the older, from which pieces that are met again move up; long pieces are not kept.
    """

    CUT = re.compile("(?<=[^\\s\x1c-\x1f\u180e\u200b\ufeff])(?= )")
    SIMPLE = re.compile("[\\n !-~À-ÖØ-öø-ɏ]*")
    PARTS = re.compile("'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\\s0-9A-Za-zÀ-ÖØ-öø-ɏ]+|\\s+(?!\\S)|\\s+")
    LAST = re.compile("[!-~À-ÖØ-öø-ɏ]")
    WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\\[-`{-~]*)")
    LONG = 64

    def __init__(self, name: str, most: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(name)
        self.model, self.most = self.t.model, most
        self.added = [str(x.content) for x in self.t.get_added_tokens_decoder().values()]
        self.after: dict[str, bytes] = {}  # pieces with a space before them, of which the last character is no space
        self.older: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.kind, code = ("<u2", "H") if self.t.get_vocab_size() <= 65536 else ("<u4", "I")
        self.packers = [struct.Struct(f"<{n}{code}").pack for n in range(24)]
        self.code = code

    def _bytes(self, ids: list[int]) -> bytes:
        return self.packers[len(ids)](*ids) if len(ids) < 24 else struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _part(self, part: str) -> bytes:
        """Ids of what the pattern leaves whole."""
        if not part.isascii() or not part.isalpha():
            part = part.encode().decode("latin-1").translate(BYTE_CHARS)
        return self._bytes([t.id for t in self.model.tokenize(part)])

    def _encode(self, piece: str) -> bytes:
        if self.SIMPLE.fullmatch(piece):
            return b"".join(map(self._part, self.PARTS.findall(piece)))
        return self._bytes(self.t.encode(piece, add_special_tokens=False).ids)

    def _spaced(self, word: str) -> bytes:
        """Ids of a Latin word after a space."""
        return self._bytes([t.id for t in self.model.tokenize("Ġ" + (word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_CHARS)))])

    def _word(self, p: str) -> bytes:
        """Ids of a piece after a space: a Latin word, one with signs after it, or anything else."""
        m = self.WORD.fullmatch(p)
        if m is None:
            return self._encode(" " + p)
        word, tail = m.groups()
        if not tail:
            return self._spaced(p)
        known = self.after.get(word) or self.older.get(word)
        if known is None:
            known = self._keep(word, self._spaced(word))
        if (sign := self.signs.get(tail)) is None:
            sign = self._part(tail)
            if len(tail) < 4:  # so there are few
                self.signs[tail] = sign
        return known + sign

    def _keep(self, p: str, ids: bytes) -> bytes:
        if len(p) < self.LONG:
            self.after[p] = ids
        return ids

    def __call__(self, text: str):
        """uint32 ids of the text, without an end id."""
        import numpy as np

        return np.frombuffer(self.packed(text), self.kind).astype("<u4")

    def packed(self, text: str) -> bytes:
        """The ids as little-endian integers of the width of `kind`."""
        for x in self.added:
            if x in text:
                return self._bytes(self.t.encode(text, add_special_tokens=False).ids)
        if len(self.after) > self.most:
            self.older, self.after = self.after, {}
        first, *pieces = text.split(" ")
        after, older = self.after, self.older
        got = list(map(after.get, pieces))
        if None in got:
            clean = self.LAST.match
            for k, g in enumerate(got):
                if g is None:
                    p = pieces[k]
                    if (known := after.get(p)) is not None:
                        got[k] = known
                    elif (known := older.get(p)) is not None:
                        got[k] = after[p] = known
                    elif p and clean(p[-1]):
                        got[k] = self._keep(p, self._word(p))
                    else:  # a run of spaces, a line end before a space, or other characters
                        return self._slow(text)
        if pieces and not (first and self.LAST.match(first[-1])):
            return self._slow(text)
        got.insert(0, self._encode(first))
        return b"".join(got)

    def _slow(self, text: str) -> bytes:
        out = []
        for p in self.CUT.split(text):
            key = p[1:]
            spaced = p[:1] == " " and key and key[0] != " " and self.LAST.match(key[-1])
            ids = (self.after.get(key) or self.older.get(key)) if spaced else None
            if ids is None:
                ids = self._word(key) if spaced else self._encode(p)
                if spaced:
                    self._keep(key, ids)
            out.append(ids)
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def release() -> None:
    """Frees the encoders' tables: for workers that turn to other work of their own size."""
    _ENCODERS.clear()


def encoder(name: str, most: int = PIECES) -> WordEncoder:
    """The process's encoder for a tokenizer file: later tasks of a worker find the pieces of earlier ones.

    One that was made with tables of another size gives way.
    """
    if name not in _ENCODERS or _ENCODERS[name].most != most:
        _ENCODERS.pop(name, None)  # before the other is made, so that the two are never held at once
        _ENCODERS[name] = WordEncoder(name, most)
    return _ENCODERS[name]
