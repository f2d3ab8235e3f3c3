"""Removal of repeated passages by a sparse suffix array.

A byte goes if a string of SPAN bytes covers it that also starts somewhere else. Sorting every suffix would
move SPAN bytes for each byte of text, so only chosen suffixes are sorted. Each window of SPAN bytes owns the
place of least hash among its first WIN starts; the choice depends on the window's bytes alone, so equal windows
own suffixes that agree in the LEAD bytes after that place. About one place in WIN / 2 is owned. The steps:

1. Texts are written once, compressed, to files of about FILE_BYTES in the shared folder; later steps read
   these files in place and never shuffle text. Each file also gives a few of its owned suffixes as a sample.
2. Each owned suffix becomes a row: its LEAD bytes as KEYS numbers of 8 bytes each, a 128-bit digest of the whole
   stretch that its windows cover, and where it is. Splitters from the sample range-partition the rows by these bytes
   (among equal suffixes then by digest and place, so that a suffix of a third of all rows is many buckets).
3. Each bucket is sorted by multikey quicksort on numbers of 8 bytes: by the first; then only those rows that are equal
   so far by the next; and so on. So buckets, one after the other, are the suffix array to LEAD bytes, and rows that
   are equal there are runs. Equal stretches in a run (told by their 128-bit digests) are repeats as a whole. Runs
   of unequal stretches, and runs at a bucket's edges (which may go on in the next), go to step 4, cut into groups of at
   most GROUP rows.
4. Groups are compared by the bytes of their stretches, window by window: equal hashes propose, bytes decide. Windows
   of a run that is cut into groups, or crosses a boundary, and that their own group leaves single, are looked up over
   all groups, by buckets of their 128-bit digest.
5. The windows found are laid over each text, and what they cover is left out.

Defined results: a null text is empty; a text of fewer than SPAN bytes stays; repeated rows are repeats of each other; a
null doc_id keeps its row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import chunks, dealt, docs_of, get_bytes, partitions, prepare, put_bytes, spread, work_path, written

SPAN = 200  # bytes of a repeat
WIN = 161  # starts among which a window chooses its place
LEAD = SPAN - WIN + 1  # bytes from that place that lie in the window whatever the choice
KEYS = LEAD // 8
NAMES = [f"k{i}" for i in range(KEYS)]
FILE_BYTES = 16 << 20
PART_BYTES = 1 << 20  # of text that is hashed at once
GROUP = 1024
SAMPLED = 32  # suffixes that a file gives for the splitters
SAMPLES = 4096  # files, at most, whose samples are read
FILES = 2  # of text a bucket, about

_rng = np.random.Generator(np.random.PCG64(20240229))
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any substring of a buffer, from prefix sums of a polynomial modulo 2**64 over random byte values."""

    powers: dict = {}

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        if len(self.powers.get("up", ())) < n + 1:
            size = max(n + 1, 1 << 20)
            for name, base in (("up", BASE), ("down", BASE_INV)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                self.powers[name] = np.multiply.accumulate(p)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[buf] * self.powers["up"][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.powers["down"][start])


def eights(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, as one number; len(buf) - 7 of them."""
    x = buf.astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def owned(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Owned places of texts that end at ends in buf: place, first and last start of the windows that own it, keys."""
    n = len(buf)
    none = np.zeros(0, np.int64)
    nothing = none, none, none, np.zeros((KEYS, 0), np.uint64)
    if n < SPAN:
        return nothing
    lead = eights(buf)
    m = (mix(lead) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(lead), dtype=np.uint64)
    held = 1
    while held * 2 <= WIN:
        m = np.minimum(m[:-held], m[held:])
        held *= 2
    if held < WIN:
        m = np.minimum(m[: held - WIN], m[WIN - held :])
    place = (m[: n - SPAN + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    good = np.ones(len(place), bool)
    for e in ends.tolist():  # windows that would leave their text
        good[max(0, e - SPAN + 1) : e] = False
    starts = np.flatnonzero(good)
    if not len(starts):
        return nothing
    place = place[starts]
    # a place's windows follow each other, within one text
    first = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    a = np.flatnonzero(first)
    b = np.concatenate([a[1:], [len(starts)]]) - 1
    return place[a], starts[a], starts[b], np.stack([lead[place[a] + 8 * i] for i in range(KEYS)])


def pack_file(rows: list[tuple]) -> bytes:
    """(text, doc_id) rows as one file: n, ids, nulls, lengths, and all texts in one zstd frame."""
    import zstandard

    ids = np.array([0 if i is None else i for _, i in rows], "<i8").tobytes()
    nulls = bytes(i is None for _, i in rows)
    lengths = np.array([len(t) for t, _ in rows], "<i8").tobytes()
    return struct.pack("<q", len(rows)) + ids + lengths + nulls + zstandard.ZstdCompressor(level=3).compress(b"".join(t for t, _ in rows))


class TextFile:
    """A file of pack_file: buf holds all texts, which end at ends."""

    def __init__(self, path: str):
        self.read(bytes(get_bytes(path)))

    @classmethod
    def of(cls, raw: bytes) -> TextFile:
        out = cls.__new__(cls)
        out.read(raw)
        return out

    def read(self, raw: bytes) -> None:
        import zstandard

        (n,) = struct.unpack_from("<q", raw)
        ids, lengths = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
        nulls = raw[8 + 16 * n : 8 + 17 * n]
        self.ids = [None if x else int(i) for i, x in zip(ids, nulls, strict=True)]
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.bytes = zstandard.ZstdDecompressor().decompress(raw[8 + 17 * n :], max_output_size=max(1, int(lengths.sum()))) if n else b""
        self.buf = np.frombuffer(self.bytes, np.uint8)

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The texts in runs of about PART_BYTES: offset, bytes, ends."""
        k = 0
        while k < len(self.ends):
            base = int(self.starts[k])
            j = max(k + 1, int(np.searchsorted(self.ends, base + PART_BYTES, "right")))
            yield base, self.buf[base : int(self.ends[j - 1])], self.ends[k:j] - base
            k = j


def by_file(batches: Iterator, path: str) -> Iterator[tuple[int, TextFile, list]]:
    """(file id, file, Arrow slices of its rows) of batches that are sorted by file."""
    import pyarrow as pa

    now, held = None, []
    for b in batches:
        f = b.column("file").to_numpy()
        cuts = [0, *(np.flatnonzero(f[1:] != f[:-1]) + 1).tolist(), len(f)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            if now is not None and f[x] != now:
                yield now, TextFile(f"{path}/{now:016x}"), pa.Table.from_batches(held)
                held = []
            now = int(f[x])
            held.append(b.slice(x, y - x))
    if now is not None:
        yield now, TextFile(f"{path}/{now:016x}"), pa.Table.from_batches(held)


def digests(raw: bytes, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """128-bit digests of raw[a:z], as two columns of 64 bits."""
    import xxhash

    view, h = memoryview(raw), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(h(view[x:y]) for x, y in zip(a.tolist(), z.tolist(), strict=True)), np.uint64).reshape(-1, 2)


def rows_of(t: TextFile, base: int, buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """Owned suffixes of a part of a file: keys, digests (two columns), first and last start of their windows in the file."""
    p, a, z, keys = owned(buf, ends)
    if not len(p):
        return None
    return keys, digests(t.bytes, a + base, z + base + SPAN), a + base, z + base


def sortable(keys: np.ndarray, full: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Rows as strings whose order is that of their keys, then of their digests, then of tie."""
    return np.ascontiguousarray(np.vstack([keys, full[:, :1].T, tie[None, :]]).T.astype(">u8")).view(f"S{8 * (KEYS + 2)}").ravel()


def store(docs: DataFrame, path: str) -> DataFrame:
    """Writes docs to files under path; (file, sample) of each."""

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa

        k = TaskContext.get().partitionId()
        for n, rows in enumerate(chunks(batches, FILE_BYTES, ["doc_id"])):
            f = k << 32 | n
            raw = pack_file(rows)
            put_bytes(f"{path}/{f:016x}", raw)
            some = b""
            t = TextFile.of(raw)
            for base, buf, ends in t.parts():
                got = rows_of(t, base, buf, ends)
                if got is not None:
                    keys, full, first, _ = got
                    step = max(1, len(first) // SAMPLED)
                    some = sortable(keys[:, ::step], full[::step], mix(first[::step].astype(np.uint64) ^ np.uint64(f))).tobytes()
                    break
            yield pa.RecordBatch.from_pydict({"file": pa.array([f], pa.int64()), "sample": pa.array([some], pa.binary())})

    return written(docs.mapInArrow(put, "file long, sample binary"), "files")


SUFFIX = f"bucket int, {', '.join(f'{k} long' for k in NAMES)}, full long, more long, file long, first int, last int"


def splitters(files: DataFrame, buckets: int) -> np.ndarray:
    """buckets - 1 suffixes that cut the sampled ones into equal parts; of at most SAMPLES files."""
    got = files.select("sample").orderBy(F.xxhash64("file")).limit(SAMPLES).collect()
    raw = np.sort(np.frombuffer(b"".join(r.sample for r in got), f"S{8 * (KEYS + 2)}"))
    return raw[[len(raw) * k // buckets for k in range(1, buckets)]] if len(raw) else raw


def suffixes(files: DataFrame, path: str, cuts: np.ndarray) -> DataFrame:
    sent = files.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for f in b.column("file").to_pylist():
                t = TextFile(f"{path}/{f:016x}")
                for base, buf, ends in t.parts():
                    got = rows_of(t, base, buf, ends)
                    if got is None:
                        continue
                    keys, full, first, last = got
                    n = len(first)
                    tie = mix(first.astype(np.uint64) ^ np.uint64(f))
                    bucket = np.searchsorted(sent.value, sortable(keys, full, tie), "right") if len(sent.value) else np.zeros(n)
                    cols = [bucket.astype(np.int32), *keys.view(np.int64), *(np.ascontiguousarray(full[:, c]).view(np.int64) for c in (0, 1)), np.full(n, f, np.int64), first.astype(np.int32), last.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["bucket", *NAMES, "full", "more", "file", "first", "last"])

    return files.select("file").mapInArrow(run, SUFFIX)


def multikey(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by keys: by the first, then rows that are equal so far by the next, and so on."""
    order = np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)  # whether a row differs from the one before, so far
    now = keys[0][order]
    new[1:] = now[1:] != now[:-1]
    for key in keys[1:]:
        one = new.copy()
        one[:-1] &= new[1:]
        open_ = np.flatnonzero(~one)  # places of rows that some other equals so far
        if not len(open_):
            break
        group = np.cumsum(new)[open_]
        inner = np.lexsort((key[order[open_]], group))
        order[open_] = order[open_[inner]]
        now = key[order]
        new[1:] |= now[1:] != now[:-1]
    return order


FOUND = "file long, first int, last int, gid long, many boolean, sure boolean"


def scan(dealt_rows: DataFrame) -> DataFrame:
    """Sorts each bucket and finds its runs of equal suffixes.

    Rows with gid -1: the windows from first to last are repeats. Others are a group's members; sure: its windows
    are known to be repeats, and the member is there for others to be compared with; many: the run has more groups.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        k = TaskContext.get().partitionId()
        groups = 0

        def settle(t: dict):
            """Rows of a sorted bucket; its first and last run touch its edges."""
            nonlocal groups
            n = len(t["file"])
            new = np.ones(n, bool)
            new[1:] = np.any([t[c][1:] != t[c][:-1] for c in NAMES], axis=0)
            run_of = np.cumsum(new) - 1
            alike = np.ones(n, bool)
            alike[1:] = new[1:] | (t["full"][1:] != t["full"][:-1]) | (t["more"][1:] != t["more"][:-1])  # first rows of equal stretches
            full_of = np.cumsum(alike) - 1
            copies = np.bincount(full_of)[full_of] > 1
            kinds = np.bincount(run_of, weights=alike).astype(np.int64)  # unequal stretches of each run
            edge = np.zeros(len(kinds), bool)
            edge[0] = edge[-1] = True
            member = alike & ((kinds > 1) | edge)[run_of]
            # the members of a run, in order, in groups of at most GROUP
            nth = np.cumsum(member) - 1
            at = np.flatnonzero(new)
            base = np.concatenate([[0], np.cumsum(member)])[at]
            inside = (nth - base[run_of]) // GROUP
            per_run = np.maximum(1, -(-np.bincount(run_of, weights=member).astype(np.int64) // GROUP))
            gid = (k << 40) + groups + (np.cumsum(per_run) - per_run)[run_of] + inside
            groups += int(per_run.sum())
            many = ((per_run > 1) | edge)[run_of]
            for rows, ids in ((copies, None), (member, gid)):
                i = np.flatnonzero(rows)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(t["file"][i]), pa.array(t["first"][i]), pa.array(t["last"][i]), pa.array(np.full(len(i), -1) if ids is None else ids[i]), pa.array(many[i]), pa.array(copies[i])], names=["file", "first", "last", "gid", "many", "sure"])

        held = [b for b in batches if b.num_rows]
        if held:
            whole = pa.Table.from_batches(held)
            del held
            cols = {c: whole.column(c).to_numpy() for c in ("bucket", *NAMES, "full", "more", "file", "first", "last")}
            del whole
            order = multikey([cols["bucket"], *(cols[c].view(np.uint64) for c in (*NAMES, "full", "more"))])
            cols = {c: x[order] for c, x in cols.items()}
            cuts = [0, *(np.flatnonzero(cols["bucket"][1:] != cols["bucket"][:-1]) + 1).tolist(), len(order)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                yield from settle({c: v[x:y] for c, v in cols.items()})

    return dealt_rows.mapInArrow(run, FOUND)


MEMBER = "gid long, many boolean, sure boolean, file long, first int, stretch binary"


def stretches(members: DataFrame, path: str) -> DataFrame:
    """Members with the bytes that their windows cover."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, t, rows in by_file(batches, path):
            first, last = rows.column("first").to_numpy(), rows.column("last").to_numpy()
            for x in range(0, len(first), 20_000):
                s = rows.slice(x, 20_000).combine_chunks()
                got = [t.bytes[a:z] for a, z in zip(first[x : x + 20_000].tolist(), (last[x : x + 20_000] + SPAN).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(s.column(c).combine_chunks() for c in ("gid", "many", "sure", "file", "first")), pa.array(got, pa.binary())], names=["gid", "many", "sure", "file", "first", "stretch"])

    return members.mapInArrow(run, MEMBER)


WINDOW = "file long, first int, last int, bucket int, open binary"
OPEN = np.dtype([("hash", "<u8", 2), ("file", "<i8"), ("first", "<i4"), ("single", "u1")])


def equal_windows(buf: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows of SPAN bytes of buf from start, class numbers that are equal for equal bytes in one group, and how often each is.

    Hashes propose classes; in each, every window is compared with the one before it, byte for byte. Where hashes have
    met by chance, the windows of that class are told apart by their bytes.
    """
    h = mix(group.astype(np.uint64)) ^ Hashes(buf).of(start, start + SPAN)
    _, inv, count = np.unique(h, return_inverse=True, return_counts=True)
    order = np.argsort(inv, kind="stable")
    x, y = order[:-1], order[1:]
    pair = inv[x] == inv[y]
    x, y = x[pair], y[pair]
    words = eights(buf)
    bad = np.zeros(len(x), bool)
    for k in range(0, SPAN, 8):
        bad |= words[start[x] + k] != words[start[y] + k]
    bad |= group[x] != group[y]
    if bad.any():
        for c in np.unique(inv[x[bad]]).tolist():
            found: dict[tuple, int] = {}
            for i in np.flatnonzero(inv == c).tolist():
                inv[i] = found.setdefault((int(group[i]), buf[start[i] : start[i] + SPAN].tobytes()), len(count) + len(found))
            count = np.concatenate([count, np.zeros(len(found), count.dtype)])
        _, inv, count = np.unique(inv, return_inverse=True, return_counts=True)
    return inv, count


def compare(grouped: DataFrame, buckets: int) -> DataFrame:
    """Windows of groups, compared in each group. Rows without a bucket: the windows from first to last are repeats.

    Rows with one are what groups of runs with more groups hold, packed (OPEN) by buckets of their hash: a window
    that its group leaves single, or one row for those that it holds repeatedly.
    """

    names = ["file", "first", "last", "bucket", "open"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def settle(rows: list[tuple]):
            buf = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
            size = np.array([len(r[5]) for r in rows])
            at = np.cumsum(size) - size
            n = size - SPAN + 1  # windows of each
            row = np.repeat(np.arange(len(rows)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = at[row] + inside
            many, sure = (np.array([r[k] for r in rows])[row] for k in (1, 2))
            file, first = np.array([r[3] for r in rows])[row], np.array([r[4] for r in rows])[row] + inside
            # within a group (gid) only, for the counts over groups to hold
            inv, count = equal_windows(buf, start, np.array([r[0] for r in rows], np.int64)[row])
            weight = np.bincount(inv, weights=sure) + count  # copies count twice
            twice = weight[inv] >= 2
            hit = twice & ~sure
            i = np.flatnonzero(hit)
            if len(i):
                new = np.concatenate([[True], (row[i][1:] != row[i][:-1]) | (i[1:] != i[:-1] + 1)])
                a = i[new]
                z = i[np.concatenate([new[1:], [True]])]
                yield pa.RecordBatch.from_arrays([pa.array(file[a]), pa.array(first[a].astype(np.int32)), pa.array(first[z].astype(np.int32)), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())], names=names)
            if many.any():
                once = np.zeros(len(inv), bool)
                once[np.unique(inv, return_index=True)[1]] = True
                i = np.flatnonzero(many & once)
                rec = np.zeros(len(i), OPEN)
                h = digests(buf.tobytes(), start[i], start[i] + SPAN)
                rec["hash"], rec["file"], rec["first"], rec["single"] = h, file[i], first[i], ~twice[i]
                b = (h[:, 0] >> np.uint64(33)).astype(np.int64) % buckets
                order = np.argsort(b, kind="stable")
                rec, b = rec[order], b[order]
                cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
                packed = [rec[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)]
                n = len(packed)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(b[cuts[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], names=names)

        held: list[tuple] = []
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("gid", "many", "sure", "file", "first", "stretch")), strict=True))
            held += rows
            if len(held) > 2 * GROUP:
                last = held[-1][0]
                cut = len(held)
                while cut and held[cut - 1][0] == last:
                    cut -= 1
                if cut:
                    yield from settle(held[:cut])
                    held = held[cut:]
        if held:
            yield from settle(held)

    return grouped.mapInArrow(run, WINDOW)


def over_groups(packed: DataFrame) -> DataFrame:
    """Of packed windows (bucket, open), sorted by bucket: those single in their group that another group holds."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def settle(held: list[bytes]):
            rec = np.frombuffer(b"".join(held), OPEN)
            rec = rec[np.lexsort((rec["hash"][:, 1], rec["hash"][:, 0]))]
            new = np.ones(len(rec), bool)
            new[1:] = (rec["hash"][1:] != rec["hash"][:-1]).any(axis=1)
            run_of = np.cumsum(new) - 1
            hit = rec[(np.bincount(run_of)[run_of] > 1) & (rec["single"] > 0)]
            first = pa.array(hit["first"].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(hit["file"].astype(np.int64)), first, first], names=["file", "first", "last"])

        now, held = None, []
        for b in batches:
            for k, x in zip(b.column("bucket").to_pylist(), b.column("open").to_pylist(), strict=True):
                if k != now and held:
                    yield settle(held)
                    held = []
                now = k
                held.append(x)
        if held:
            yield settle(held)

    return packed.mapInArrow(run, "file long, first int, last int")


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


def cut_out(laid: DataFrame, path: str, texts: bool) -> DataFrame:
    """laid: (file, first, last) sorted by file, first of which is -1 in a row that each file has."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for _, t, rows in by_file(batches, path):
            first, last = rows.column("first").to_numpy(), rows.column("last").to_numpy()
            first, last = first[first >= 0], last[first >= 0]
            diff = np.bincount(first, minlength=len(t.buf) + 1).astype(np.int32)
            diff -= np.bincount(last + SPAN, minlength=len(t.buf) + 1).astype(np.int32)
            gone = np.cumsum(diff[: len(t.buf)]) > 0
            out = []
            for i, a, z in zip(t.ids, t.starts.tolist(), t.ends.tolist(), strict=True):
                g = gone[a:z]
                removed = int(np.count_nonzero(g))
                kept = t.bytes[a:z]
                spans = 0
                if removed:
                    spans = int(g[0]) + int(np.count_nonzero(g[1:] & ~g[:-1]))
                    kept = t.buf[a:z][~g].tobytes()
                out.append((i, z - a, removed, spans, kept if texts else None, hashlib.sha256(kept).hexdigest()))
                if len(out) == 2000:
                    yield batch(pa, out)
                    out = []
            if out:
                yield batch(pa, out)

    def batch(pa, out):
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return laid.mapInArrow(run, OUT)


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): bytes, removed bytes, removed runs, the kept bytes (if texts) and their SHA-256.

    What is kept is bytes, as a cut may fall within a character.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = work_path(spark, "texts")
    files = store(docs_of(docs).select(F.col("doc_id").cast("long"), "text"), path)
    buckets = max(partitions(spark), -(-files.count() // FILES))
    cuts = splitters(files, buckets)
    found = written(scan(suffixes(spread(files), path, cuts).repartitionById(buckets, F.col("bucket"))), "found")
    members = found.filter("gid >= 0")
    grouped = stretches(dealt(members.select("file", "first", "last", "gid", "many", "sure"), "file"), path).repartition("gid").sortWithinPartitions("gid")
    compared = written(compare(grouped, 8 * partitions(spark)), "windows")
    over = over_groups(compared.filter("bucket IS NOT NULL").select("bucket", "open").repartition("bucket").sortWithinPartitions("bucket"))
    laid = files.select("file", F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    for x in (found.filter("gid < 0"), compared.filter("bucket IS NULL"), over):
        laid = laid.unionAll(x.select("file", "first", "last"))
    return cut_out(dealt(laid, "file"), path, texts)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
