"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A folder holds for each partition k part-k.bin (little-endian unsigned ids, 16 bits wide if the vocabulary
fits, else 32) and part-k.idx (int64: the number of documents n, n doc_ids, n+1 offsets in ids; then n bytes,
1 where the doc_id is null), and manifest.json with the width and each partition's documents, ids and base:
the prefix sums of the ids before it. Documents ascend by doc_id over all parts (null first; ties by text).

Defined results: a null text is empty and has the end id alone; an empty table gives files without ids.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from itertools import accumulate

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import docs_of, encoder, get_bytes, local_path, prepare, put_bytes, work_path

END = 0
OUT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Sink:
    """A file that appears under its name only when it is whole."""

    def __init__(self, path: str):
        self.at, self.path = local_path(path), path
        if self.at is not None:
            os.makedirs(os.path.dirname(self.at), exist_ok=True)
            self.tmp = f"{self.at}.{uuid.uuid4().hex[:8]}.tmp"
            self.f = open(self.tmp, "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            store.create_dir(os.path.dirname(inner), recursive=True)
            self.f = store.open_output_stream(inner)  # stores of objects show a file when it is closed

    def write(self, data) -> None:
        self.f.write(data)

    def close(self) -> None:
        self.f.close()
        if self.at is not None:
            os.replace(self.tmp, self.at)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END) -> dict:
    """Encodes docs (doc_id, text), writes the folder and returns its manifest."""
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs_of(docs).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def put(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        k = TaskContext.get().partitionId()
        encode, sink = encoder(tokenizer), Sink(f"{path}/part-{k:06d}.bin")
        ids, offsets = [], [0]
        end = np.array([end_id], encode.kind).tobytes()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = encode.packed(text)
                sink.write(got)
                sink.write(end)
                ids.append(doc_id)
                offsets.append(offsets[-1] + len(got) // len(end) + 1)
        sink.close()
        head = np.array([len(ids), *(0 if x is None else x for x in ids), *offsets], "<i8").tobytes()
        put_bytes(f"{path}/part-{k:06d}.idx", head + bytes(x is None for x in ids))
        yield pa.RecordBatch.from_pydict({"part": [k], "docs": [len(ids)], "ids": [offsets[-1]], "width": [int(encode.kind[-1])]})

    found = {r["part"]: r for r in dealt.mapInArrow(put, "part long, docs long, ids long, width long").collect()}  # a row for each partition
    rows = [found[k] for k in sorted(found)]
    bases = [0, *accumulate(r["ids"] for r in rows)]
    manifest = {"format": 1, "width": max([2, *(r["width"] for r in rows)]), "parts": [{"part": r["part"], "docs": r["docs"], "ids": r["ids"], "base": b} for r, b in zip(rows, bases, strict=False)], "ids": bases[-1]}
    put_bytes(f"{path}/manifest.json", json.dumps(manifest).encode())
    return manifest


def read_part(path: str, part: dict, width: int) -> Iterator[tuple]:
    """(doc_id, start over all parts, ids) of the documents of a part, from its mapped files."""
    import numpy as np

    k = part["part"]
    raw = get_bytes(f"{path}/part-{k:06d}.idx")
    n = int(raw[:8].view("<i8")[0])
    ids = raw[8 : 8 + 8 * n].view("<i8")
    offsets = raw[8 + 8 * n : 16 + 16 * n].view("<i8")
    null = raw[16 + 16 * n : 16 + 17 * n]
    flat = get_bytes(f"{path}/part-{k:06d}.bin").view(f"<u{width}")
    for j in range(n):
        a, b = int(offsets[j]), int(offsets[j + 1])
        yield (None if null[j] else int(ids[j])), part["base"] + a, np.asarray(flat[a:b])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """start, length and crc32 of each document, read back from a folder that write_tokens has written."""
    manifest = json.loads(bytes(get_bytes(f"{path}/manifest.json")))
    parts = {p["part"]: p for p in manifest["parts"] if p["docs"]}
    width = manifest["width"]

    def get(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for b in batches:
            for k in b.column("part").to_pylist():
                out: list[tuple] = []
                for doc_id, start, ids in read_part(path, parts[k], width):
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), kind, strict=True)], schema=kind)

    if not parts:
        return spark.createDataFrame([], OUT)
    last = max(parts) + 1
    have = sorted(parts)
    return spark.range(0, last, 1, last).select(F.col("id").cast("int").alias("part")).filter(F.col("part").isin(have) if len(have) < last else F.lit(True)).mapInArrow(get, OUT)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written to the shared folder and read back."""
    import public_tokenizers

    path = work_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
