"""Secret scans by an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. A ledger table keeps which
(blob, rule version) pairs have been scanned and what was found there; a run scans only pairs that the ledger
lacks, each blob once, and joins the findings back to all paths and versions that hold the blob.

Defined results: a null text is the empty blob; a null path or version keeps its row; repeated rows stay
repeated; an empty table gives no rows; other columns are ignored. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import bit_table, docs_of, marked, prepare, work_path, written

SPANS = "array<struct<kind:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """Matches of pattern are leftmost and do not overlap; those whose group is shorter than least are dropped after."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def find(self, text: str, compiled: dict = {}) -> list[tuple[int, int]]:  # noqa: B006
        if (p := compiled.get(self)) is None:
            p = compiled[self] = re.compile(self.pattern, re.A | (re.I if self.any_case else 0))
        g, least = self.group, self.least
        return [m.span() for m in p.finditer(text) if m.end(g) - m.start(g) >= least]


#: The base rules, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # the same as runs after AKIA cut at 20 characters: a shorter rest of a run fails too
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)
#: Further kinds with a form of their own.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


@dataclass(frozen=True)
class RuleSet:
    version: str
    rules: tuple[Rule, ...]

    @property
    def key(self) -> str:
        """The version with a hash of the rules: rules that change under one name are scanned anew."""
        return f"{self.version}:{hashlib.sha256(repr(self.rules).encode()).hexdigest()[:16]}"

    def scan(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all spans, by start and then the rules' order."""
        found = [(s, k, r.kind, e) for k, r in enumerate(self.rules) for s, e in r.find(text)]
        return [(kind, s, e) for s, _, kind, e in sorted(found)]


DEFAULT = RuleSet("2", BASE + MORE)
BASE_KINDS = tuple(r.kind for r in BASE)


class BlobLedger:
    """The table of scanned (blob, rule version) pairs at a path of the shared storage, append-only."""

    SCHEMA = f"rule_version string, blob binary, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        prepare(spark)

    def table(self) -> DataFrame:
        """What is scanned so far. Repeated pairs of runs at the same time collapse."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def update(self, versions: DataFrame, rules: RuleSet) -> None:
        """Scans the blobs of versions (blob, text) that the ledger lacks under these rules, each once."""
        seen = self.table().filter(F.col("rule_version") == rules.key).select("blob")
        # copies collapse within each task first, so that a blob of many paths is shuffled once a task, not once a path
        once = versions.groupBy("blob").agg(F.first("text").alias("text")).join(seen, "blob", "left_anti")

        key = rules.key

        def scan(batches: Iterator) -> Iterator:
            import pyarrow as pa

            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            for b in batches:
                got = [[dict(zip(("kind", "start", "end"), x, strict=True)) for x in rules.scan(t)] for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.string()), b.column("blob"), pa.array(got, kind)], ["rule_version", "blob", "spans"])

        once.select("blob", "text").mapInArrow(scan, self.SCHEMA).write.mode("append").option("compression", "zstd").parquet(self.path)

    def scan(self, history: DataFrame, rules: RuleSet = DEFAULT) -> DataFrame:
        """Findings of every row of history (any key columns, and text): the key columns, blob and spans.

        Key columns that are named blob or spans give way to the ledger's own.
        """
        keys = [F.col(f"`{c}`") for c in history.columns if c not in ("text", "blob", "spans")]
        text = F.coalesce("text", F.lit(""))
        blob = F.unhex(F.sha2(text, 256)).alias("blob")
        self.update(history.select(blob, text.alias("text")), rules)
        found = self.table().filter((F.col("rule_version") == rules.key) & (F.size("spans") > 0)).dropDuplicates(["blob"])
        # written: both sides of the join are then plain exchanges, of which Spark can split a blob of many paths
        found = written(found.select(F.col("blob").alias("__tl_blob"), F.col("spans").alias("__tl_spans")), "found")
        none = F.array().cast(SPANS)
        held = history.select(*keys, blob)
        return held.join(found, F.col("blob") == F.col("__tl_blob"), "left").select(*keys, "blob", F.coalesce("__tl_spans", none).alias("spans"))


def joined(kinds: tuple[str, ...] | None = None):
    """The column spans as kind:start:end, comma-joined; of the named kinds only."""
    x = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and list of spans by row."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(BASE_KINDS), 256).alias("base_sha256"), joined().alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a new ledger in the shared folder."""
    docs = docs_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digest(BlobLedger(spark, work_path(spark, "ledger")).scan(docs))


def redact(spark: SparkSession, docs: DataFrame, ledger: str, rules: RuleSet = DEFAULT, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span's text replaced by mark, overlapping spans as one; n_chars follows. Other columns stay."""
    led = BlobLedger(spark, ledger)
    led.update(docs.select(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"), F.coalesce("text", F.lit("")).alias("text")), rules)
    found = led.table().filter((F.col("rule_version") == rules.key) & (F.size("spans") > 0)).select("blob", "spans").dropDuplicates(["blob"])
    found = written(found, "found")

    @F.pandas_udf("string")
    def cut(text, spans):
        out = []
        for t, ss in zip(text, spans, strict=True):
            if t is not None and ss is not None and len(ss):
                parts, at = [], 0
                for s in sorted(ss, key=lambda s: s["start"]):
                    if s["start"] >= at:
                        parts += [t[at : s["start"]], mark]
                    at = max(at, s["end"])
                t = "".join(parts) + t[at:]
            out.append(t)
        import pandas as pd

        return pd.Series(out, dtype=object)

    columns = docs.columns
    x = docs.withColumn("__tl_blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    # texts go to the join only where a bounded table of bits says that they may hold a secret; the others stay in place
    held = marked(x.withColumn("__tl_rk", F.xxhash64("__tl_blob")), "__tl_rk", bit_table(found.select(F.xxhash64("blob").alias("rk"))))
    spans = found.select(F.col("blob").alias("__tl_own"), F.col("spans").alias("__tl_spans"))
    some = held.filter("__tl_maybe").join(spans, F.col("__tl_blob") == F.col("__tl_own"), "left")
    some = some.withColumn("text", F.when(F.col("__tl_spans").isNull(), F.col("text")).otherwise(cut("text", "__tl_spans")))
    if "n_chars" in columns:
        some = some.withColumn("n_chars", F.when(F.col("__tl_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return held.filter(~F.col("__tl_maybe")).select(*(F.col(f"`{c}`") for c in columns)).unionAll(some.select(*(F.col(f"`{c}`") for c in columns)))
