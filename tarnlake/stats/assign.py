"""Which statistic each (table, block, column) gets under a budget of bytes.

Options are rows (place, kind, size, prunes): a place is any hashable, prunes how many queries of a tuning workload
skip its block by that kind. At most one kind a place. Three assigners run on the driver; priced runs on the cluster.
Tune and evaluate on different queries.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Hashable, Iterable
from typing import NamedTuple


class Option(NamedTuple):
    place: Hashable
    kind: str
    size: int
    prunes: int


def by_place(options: Iterable[Option]) -> dict[Hashable, list[Option]]:
    """Options that prune, per place, by size; one that costs no less and prunes no more than another goes."""
    out: dict[Hashable, list[Option]] = defaultdict(list)
    for o in sorted((o for o in options if o.prunes > 0), key=lambda o: (o.size, -o.prunes, o.kind)):
        if not out[o.place] or o.prunes > out[o.place][-1].prunes:
            out[o.place].append(o)
    return {k: v for k, v in out.items() if v}


def greedy_simple(options: Iterable[Option], budget: int) -> dict[Hashable, Option]:
    """Most prunes first; what fits is taken, and its place is settled."""
    taken: dict[Hashable, Option] = {}
    for o in sorted(options, key=lambda o: (-o.prunes, o.size, str(o.place), o.kind)):
        if o.prunes > 0 and o.place not in taken and o.size <= budget:
            taken[o.place] = o
            budget -= o.size
    return taken


def greedy(options: Iterable[Option], budget: int) -> dict[Hashable, Option]:
    """The step with most prunes gained per byte first, where a step may replace a place's kind by a larger one.

    A better kind of equal size never costs anything, so by_place has dropped the worse one.
    """
    places = by_place(options)
    taken: dict[Hashable, Option] = {}
    heap: list = []

    def offer(place) -> None:
        have = taken.get(place)
        size, prunes = (have.size, have.prunes) if have else (0, 0)
        better = [o for o in places[place] if o.prunes > prunes]
        if better:
            o = max(better, key=lambda o: ((o.prunes - prunes) / max(1, o.size - size), -o.size))
            heapq.heappush(heap, (-(o.prunes - prunes) / max(1, o.size - size), str(place), o.kind, o, have))

    for place in places:
        offer(place)
    while heap:
        *_, o, seen = heapq.heappop(heap)
        have = taken.get(o.place)
        if have is not seen:
            continue
        cost = o.size - (have.size if have else 0)
        if cost <= budget:
            taken[o.place] = o
            budget -= cost
            offer(o.place)
        else:  # a smaller step of this place may still fit
            places[o.place] = [x for x in places[o.place] if x.size < o.size]
            if places[o.place]:
                offer(o.place)
    return taken


def exact(options: Iterable[Option], budget: int) -> dict[Hashable, Option]:
    """Most prunes within the budget: a knapsack with one choice a place, over budgets in bytes. For small inputs."""
    import numpy as np

    places = by_place(options)
    best = np.zeros(budget + 1, np.int64)
    picks = []
    for place in sorted(places, key=str):
        now, pick = best.copy(), np.full(budget + 1, -1, np.int32)
        for i, o in enumerate(places[place]):
            if o.size <= budget:
                with_o = np.full(budget + 1, -1, np.int64)
                with_o[o.size :] = best[: budget + 1 - o.size] + o.prunes
                hit = with_o > now
                now[hit], pick[hit] = with_o[hit], i
        picks.append((place, pick))
        best = now
    taken, left = {}, budget
    for place, pick in reversed(picks):
        if pick[left] >= 0:
            taken[place] = places[place][pick[left]]
            left -= taken[place].size
    return taken


ASSIGNERS = {"greedy_simple": greedy_simple, "greedy": greedy, "exact": exact}


def measured(df, stats, filters: list[tuple]):
    """(block, col, kind, bytes, prunes) of the statistics beyond ranges: for how many filters of a tuning workload each
    skips its block where the range alone does not. One pass where the statistics are."""
    from collections.abc import Iterator

    from pyspark.sql import functions as F

    from tarnlake.stats.blocks import columns_of, evaluate, keyed

    fs = [(f[1], keyed(df.schema, f)) for f in filters]
    held = F.collect_list(F.struct("col", "kind", "n", "nulls", "low", "high", "bytes", "payload"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for rows in b.column("rows").to_pylist():
                for r in rows:
                    known, plain = columns_of([r]), columns_of([r | {"payload": None}])
                    out.append((r["col"], r["kind"], r["bytes"], sum(c == r["col"] and evaluate(f, known).skips and not evaluate(f, plain).skips for c, f in fs)))
            size = [len(x) for x in b.column("rows").to_pylist()]
            block = [x for x, n in zip(b.column("block").to_pylist(), size, strict=True) for _ in range(n)]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([block, *(zip(*out, strict=True) if out else [[]] * 4)], kinds, strict=True)], names=["block", "col", "kind", "bytes", "prunes"])

    return stats.filter("payload IS NOT NULL").groupBy("block").agg(held.alias("rows")).select("block", "rows").mapInArrow(run, "block long, col string, kind string, bytes long, prunes long")


def measure(df, stats, filters: list[tuple]) -> list[Option]:
    """The options of measured on the driver, for assigners that run there: for tables whose blocks fit it."""
    return [Option((r.block, r.col), r.kind, r.bytes, r.prunes) for r in measured(df, stats, filters).collect()]


def priced(options, budget: int, rounds: int = 40):
    """(block, col, kind) by one price for all: each place takes the kind with most prunes left after paying for its
    bytes, and the price is the lowest, by bisection, at which all fits the budget. options: (block, col, kind, bytes,
    prunes). Every round is one aggregate, so that the places need not fit the driver.
    """
    from pyspark.sql import functions as F

    useful = options.filter("prunes > 0 AND bytes > 0").persist()
    best = F.max_by(F.struct("kind", "bytes", "prunes", "worth"), F.struct("worth", -F.col("bytes"), "kind"))

    def at(price: float):
        worth = useful.withColumn("worth", F.col("prunes") - F.lit(price) * F.col("bytes")).filter("worth > 0")
        return worth.groupBy("block", "col").agg(best.alias("b")).select("block", "col", "b.kind", "b.bytes")

    def cost(price: float) -> int:
        return at(price).agg(F.sum("bytes")).first()[0] or 0

    low, high = 0.0, float(useful.agg(F.max(F.col("prunes") / F.col("bytes"))).first()[0] or 0)
    if cost(low) > budget:
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (low, mid) if cost(mid) <= budget else (mid, high)
        low = high
    useful.unpersist()
    return at(low).select("block", "col", "kind")


def chosen(stats, taken):
    """The rows of a statistics table that an assignment (of an assigner, or of priced) keeps, and all of min_max."""
    spark = stats.sparkSession
    keep = spark.createDataFrame([(b, c, o.kind) for (b, c), o in taken.items()], "block long, col string, kind string") if isinstance(taken, dict) else taken
    return stats.filter("kind = 'min_max'").unionByName(stats.filter("kind <> 'min_max'").join(keep, ["block", "col", "kind"], "left_semi"))
