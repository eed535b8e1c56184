"""Mixing sources to target weights by Pfair scheduling.

Weights are whole shares p of a period H (their sum). Block j (from 0) of a source with weight w = p / H
is released at slot floor(j / w) and due by slot ceil((j + 1) / w); each slot goes to the released
block with the earliest deadline. As weights add up to one, every deadline is met, so at any slot each
source has had its weight's worth of blocks to within less than one.

Allocations are exact at every multiple of H, so the schedule repeats: one period is worked out on
the driver, and block j of a source lies at slot (j div p) * H + place[j mod p], for any number of
blocks. When a source runs out it leaves, and the others go on, with shares over a shorter period, from
the next slot: so all documents are kept, and the bound holds within each phase.

Lanes are what is scheduled: a lane is a source while there are few. Where there are many, the largest stay
lanes of their own and all others are dealt by a hash into lanes of several sources, whose weight is the sum
of theirs; the same schedule, worked out in a task for each such lane, orders the blocks within it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored


def period(shares: list[int]) -> list[int]:
    """The source of each slot of one period: earliest deadline first among the released blocks."""
    total = sum(shares)
    waiting = [(0, s, 0) for s, p in enumerate(shares) if p]
    ready: list[tuple[int, int, int, int]] = []
    heapq.heapify(waiting)
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            p = shares[s]
            due = -(-(j + 1) * total // p)
            # Ties: a deadline that cuts into the next block's window comes first, then the heavier source.
            heapq.heappush(ready, (due, -((j + 1) * total % p > 0), -p, s * total + j))
        *_, code = heapq.heappop(ready)
        s, j = divmod(code, total)
        out.append(s)
        if j + 1 < shares[s]:
            heapq.heappush(waiting, ((j + 1) * total // shares[s], s, j + 1))
    return out


def reduced(shares: list[int], alive: list[int]) -> list[int]:
    common = math.gcd(*[shares[s] for s in alive])
    out = [0] * len(shares)
    for s in alive:
        out[s] = shares[s] // common
    return out


def phases(shares: list[int], blocks: list[int]) -> Iterator[tuple[int, int, list[int], dict[int, tuple[int, int]]]]:
    """(first slot, period, its sources by slot, {source: (first block, blocks)}) of each phase."""
    done, start = [0] * len(shares), 0
    alive = [s for s, n in enumerate(blocks) if n]
    while alive:
        own = reduced(shares, alive)
        order = period(own)
        total = len(order)
        place: dict[int, list[int]] = {s: [] for s in alive}
        for slot, s in enumerate(order):
            place[s].append(slot)
        ends = {s: (n - 1) // own[s] * total + place[s][(n - 1) % own[s]] + 1 for s in alive if (n := blocks[s] - done[s])}
        length = min(ends.values())
        rounds, rest = divmod(length, total)
        got = {s: rounds * own[s] + sum(x < rest for x in place[s]) for s in alive}
        yield start, total, order, {s: (done[s], got[s]) for s in alive if got[s]}
        for s in alive:
            done[s] += got[s]
        alive = [s for s in alive if done[s] < blocks[s]]
        start += length


def target_shares(counts: list[int], total: int = 1000, power: float = 0.5) -> list[int]:
    """Shares by counts to a power, rounded to add up to about ``total``; one at least for each."""
    raw = [c**power for c in counts]
    return [max(1, round(total * r / sum(raw))) for r in raw] if raw else []


def lane_order(sources: pd.DataFrame) -> pd.DataFrame:
    """source, block, q: the place of each block in the lane that these sources (source, blocks, weight) share."""
    sources = sources.sort_values("source", na_position="first", kind="stable")
    names, blocks = sources["source"].tolist(), sources["blocks"].astype(int).tolist()
    parts = []
    for start, total, order, got in phases(target_shares(sources["weight"].tolist(), power=1.0), blocks):
        place: dict[int, list[int]] = {}
        for slot, s in enumerate(order):
            place.setdefault(s, []).append(slot)
        for s, (first, many) in got.items():
            turn, own = np.arange(many), np.array(place[s])
            q = start + turn // len(own) * total + own[turn % len(own)]
            parts.append(pd.DataFrame({"source": pd.Series([names[s]] * many, dtype=object), "block": first + turn, "q": q}))
    return pd.concat(parts, ignore_index=True)


def mix_sources(documents: DataFrame, weights: dict[str, int] | None = None, block_rows: int = 64, key: str = "doc_id", source: str = "source", keep: list[str] | None = None, cell_rows: int = 1024, most_lanes: int = 500) -> DataFrame:
    """``keep`` columns (key and source by default) plus block, slot and place (``block_rows`` places a slot).

    ``weights`` are whole shares by source; without them shares follow the square root of the sources'
    counts over all rows. A source without a weight gets the least share given. Null sources form a
    source of their own. Rows of a source are ordered by a hash of the key, then the key, so a null or
    repeated key is just another row; ties between equal rows don't matter. Only a source's last block may
    be short. Order by ``place`` to read the mixture. Empty tables give no rows.

    Row numbers come from cells of some ``cell_rows`` rows, so no source meets in one task. Any number of
    sources is mixed. Up to ``most_lanes`` each is a lane, within one block of its weight at every slot.
    Beyond, so are the largest half of ``most_lanes``; each other source w in a lane of weight W stays within
    1 + w / W blocks, and takes over its lane's weight from sources that ended there. The driver holds lanes
    only; a task holds one lane's sources and one number for each of their blocks.
    """
    spark = documents.sparkSession
    keep = keep or [key, source]
    name = F.col(f"`{source}`").cast("string")
    rows = documents.select(*[F.col(f"`{c}`") for c in keep], name.alias("__source"), F.xxhash64(F.col(f"`{key}`")).alias("__hash"), F.col(f"`{key}`").alias("__key"))
    n = documents.count()
    cells = max(1, 1 << math.ceil(math.log2(max(1, n / cell_rows))))
    rows = rows.withColumn("__cell", F.shiftrightunsigned(F.col("__hash"), 64 - int(math.log2(cells))).cast("int") if cells > 1 else F.lit(0))
    counts = rows.groupBy("__source", "__cell").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "cells")
    before = Window.partitionBy("__source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("__source").alias("__s"), F.col("__cell").alias("__c"), "__before")
    inside = Window.partitionBy("__source", "__cell").orderBy("__hash", "__key")
    numbered = rows.withColumn("__n", F.row_number().over(inside) - 1)
    same = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__cell") == F.col("__c"))
    numbered = numbered.join(offsets, same).withColumn("__at", F.col("__n") + F.col("__before")).withColumn("block", F.floor(F.col("__at") / block_rows))

    per_source = counts.groupBy("__source").agg(F.sum("n").alias("n"))
    sizes = per_source.orderBy(F.desc("n"), F.col("__source").asc_nulls_first()).limit(most_lanes + 1).collect()
    least = min((weights or {}).values(), default=1)
    if len(sizes) <= most_lanes:
        sizes.sort(key=lambda r: (r[0] is not None, r[0]))
        lanes, blocks = [r[0] for r in sizes], [-(-r[1] // block_rows) for r in sizes]
        shares = [max(1, int(weights.get(s, least))) for s in lanes] if weights else target_shares([r[1] for r in sizes])
        numbered = numbered.withColumn("__lane", F.col("__source")).withColumn("__q", F.col("block"))
    else:
        half = most_lanes // 2
        single = spark.createDataFrame([(r[0], f"{i}") for i, r in enumerate(sizes[:half])], "__one string, __own string")
        weight = F.sqrt("n")
        if weights:
            given = spark.createDataFrame([(s, float(max(1, int(w)))) for s, w in weights.items()], "__w string, __weight double")
            per_source = per_source.join(given, F.col("__source") == F.col("__w"), "left")
            weight = F.coalesce("__weight", F.lit(float(max(1, int(least)))))
        dealt = F.concat(F.lit("lane "), F.pmod(F.xxhash64("__source"), F.lit(most_lanes - half)).cast("string"))
        per_source = per_source.join(F.broadcast(single), F.col("__source").eqNullSafe(F.col("__one")), "left")
        per_source = stored(per_source.select(F.col("__source").alias("source"), F.coalesce("__own", dealt).alias("lane"), F.col("__own").isNull().alias("shared"), F.ceil(F.col("n") / block_rows).alias("blocks"), weight.alias("weight")), "sources")
        # At most most_lanes rows.
        found = per_source.groupBy("lane").agg(F.sum("blocks"), F.sum("weight")).orderBy("lane").collect()
        lanes, blocks = [r[0] for r in found], [r[1] for r in found]
        shares = target_shares([r[2] for r in found], power=1.0)
        inner = per_source.where("shared").groupBy("lane").applyInPandas(lambda k, p: lane_order(p).assign(lane=k[0]), "source string, block long, q long, lane string")
        inner = stored(inner, "lanes").select(F.col("source").alias("__is"), F.col("block").alias("__ib"), F.col("q").alias("__iq"), F.col("lane").alias("__il"))
        numbered = numbered.join(F.broadcast(single), F.col("__source").eqNullSafe(F.col("__one")), "left")
        numbered = numbered.join(inner, F.col("__source").eqNullSafe(F.col("__is")) & (F.col("block") == F.col("__ib")), "left")
        numbered = numbered.withColumn("__lane", F.coalesce("__il", "__own")).withColumn("__q", F.coalesce("__iq", "block"))

    spans, places = [], []
    for phase, (start, total, order, got) in enumerate(phases(shares, blocks)):
        seen: dict[int, int] = {}
        for slot, s in enumerate(order):
            if s in got:
                places.append((phase, lanes[s], seen.get(s, 0), slot))
            seen[s] = seen.get(s, 0) + 1
        spans += [(phase, lanes[s], first, first + many, start, total, seen[s]) for s, (first, many) in got.items()]
    phase_frame = spark.createDataFrame(spans, "__phase int, __ps string, __first long, __until long, __start long, __period long, __share long")
    place_frame = spark.createDataFrame(places, "__qp int, __qs string, __turn long, __step long")
    # Both have a bounded number of rows: lanes times phases, and a period's slots times phases.
    q = F.col("__q")
    out = numbered.join(F.broadcast(phase_frame), F.col("__lane").eqNullSafe(F.col("__ps")) & (q >= F.col("__first")) & (q < F.col("__until")))
    turn = (q - F.col("__first")) % F.col("__share")
    out = out.join(F.broadcast(place_frame), F.col("__lane").eqNullSafe(F.col("__qs")) & (F.col("__phase") == F.col("__qp")) & (turn == F.col("__turn")))
    slot = F.col("__start") + F.floor((q - F.col("__first")) / F.col("__share")) * F.col("__period") + F.col("__step")
    out = out.withColumn("slot", slot).withColumn("place", F.col("slot") * block_rows + F.col("__at") % block_rows)
    taken = [c for c in keep if c not in ("block", "slot", "place")]
    return out.select(*[F.col(f"`{c}`") for c in taken], F.col("block").cast("long").alias("block"), F.col("slot").cast("long").alias("slot"), F.col("place").cast("long").alias("place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
