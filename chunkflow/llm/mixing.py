"""Mixing sources to target weights by Pfair scheduling. DataFrame operations only.

The documents of a source, in a keyed random order, form blocks of BLOCK documents. With target share w, block i of a
source is released at slot floor(i / w) and due at ceil((i + 1) / w). In every slot the released block with the earliest
deadline goes first, so as long as no source has run out, each source has had w * t blocks after t slots, to less than
one block. Weights are whole numbers and the schedule repeats after their sum.

Sources with a weight of their own are scheduled one by one. All others weigh the same: together they are one task of
the schedule and take its turns in a circle, which keeps each of them within one block too. So the schedule is as long
as the list of given weights, however many sources there are.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

#: Documents of a block, and of a part of all sources that is numbered by itself (about); parts at most.
BLOCK, PART, MOST_PARTS = 8, 256, 65_536
#: Target weights of the registered query; sources that are not named weigh 1.
TARGETS = {"src0": 3, "src1": 2, "src2": 2, "src3": 2}
SEED = "mix-1"


def schedule(weights: list[int], rest: int = 0) -> list[list[int]]:
    """Slots of each task's blocks in one period of sum(weights) + rest slots, earliest deadline first.

    rest: weight of a task more, which gets all slots that are not listed. Ties go to the task that stands first. The
    rest's runs are jumped over, so the time depends on the weights alone.
    """
    period = sum(weights) + rest
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, s) for s in range(len(weights))]  # by release
    ready: list[tuple[int, int]] = []  # by deadline
    t = k = 0  # the slot, and the blocks that the rest has had
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // weights[s]), s))
        if rest:
            run = -(-((t + 1) * rest - k * period) // (period - rest))  # until its next block is not released
            if ready:
                run = min(run, (ready[0][0] - 1) * rest // period - k)  # or is not due first
            if waiting:
                run = min(run, waiting[0][0] - t)
            run = min(run, rest - k)
            if run > 0:
                t, k = t + run, k + run
                continue
        if not ready:
            raise AssertionError("no block is released")
        s = heapq.heappop(ready)[1]
        slots[s].append(t)
        t += 1
        if (n := len(slots[s])) < weights[s]:
            heapq.heappush(waiting, (n * period // weights[s], s))
    return slots


def _numbers(rows: DataFrame, group: list[str], order: list, part: Column, name: str) -> DataFrame:
    """Adds name, the place from 0 of each row among the rows of its group, without gathering a group in one task.

    part: number of a part of the group that goes on where the one before ends; a part is one task's, and their sizes
    are added up.
    """
    d = rows.withColumn("_p", part)
    sizes = d.groupBy(*group, "_p").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*group, "_p", before.alias("_before"))
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(*order)))
    d = d.join(sizes, [*group, "_p"])
    return d.withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_p", "_n", "_before")


def _digest(c: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), c).cast("binary"))


def _part_of(digest: Column, parts: int) -> Column:
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * parts / F.lit(2**32)).cast("long")


def mix(docs: DataFrame, weights: dict[str, int], key: str, default: int = 1, seed: str = SEED) -> DataFrame:
    """Adds mix_block (number of the block within its source), mix_slot and mix_rank to every row, dropping none.

    mix_slot orders the blocks; mix_rank orders the rows of a block. Rows of one source are ordered by a hash of seed
    and key, ties by key (repeated keys: any order). A null source is a source of its own, of the default weight. When
    a source has run out its slots stay empty; a named source without rows has none. Empty input gives no rows. Columns
    that are called like a new one are replaced. Rows are shuffled once, by source and part.
    """
    if any(int(w) != w or w < 1 for w in (*weights.values(), default)):
        raise ValueError("weights are whole numbers from 1")
    new = ("mix_block", "mix_slot", "mix_rank")
    rows = docs.select(F.struct(*[c for c in docs.columns if c not in new]).alias("_row"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_s"), F.col(key).alias("_k"))
    rows = rows.withColumn("_h", _digest(F.coalesce(F.col("_k").cast("string"), F.lit("")), seed))
    counts = saved(rows.groupBy("_s").count(), "sources")
    named = {f"={s}": int(w) for s, w in weights.items()}
    given = counts.where(F.col("_s").isin(list(named)))
    there = sorted(r["_s"] for r in given.collect())  # as many as there are weights, at most
    others = counts.where(~F.col("_s").isin(there))
    total, sources = (counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], others.count())
    rest = default * sources
    slots = schedule([named[s] for s in there], rest)
    period = sum(named[s] for s in there) + rest

    circle = others.select("_s", _digest(F.col("_s"), seed).alias("_d"))
    circle = _numbers(circle, [], ["_d", "_s"], _part_of(F.col("_d"), max(1, min(MOST_PARTS, sources // PART))), "_turn").select("_s", "_turn")
    parts = max(1, min(MOST_PARTS, total // PART))
    d = _numbers(rows, ["_s"], ["_h", "_k"], _part_of(F.col("_h"), parts), "_at")
    d = d.withColumn("mix_block", F.floor(F.col("_at") / BLOCK))

    turn = F.col("mix_block") * sources + F.col("_turn")
    taken = sorted(x for s in slots for x in s)
    jumped = F.size(F.filter(F.lit([x - i for i, x in enumerate(taken)]).cast("array<long>"), lambda x: x <= turn % rest))
    slot = F.floor(turn / rest) * period + turn % rest + jumped if rest else F.lit(None)
    own = F.lit(None).cast("long")
    for s, places in zip(there, slots):
        own = F.when(F.col("_s") == s, F.floor(F.col("mix_block") / named[s]) * period + F.element_at(F.lit(places).cast("array<long>"), (F.col("mix_block") % named[s] + 1).cast("int"))).otherwise(own)
    d = d.join(circle, "_s", "left").withColumn("mix_slot", F.coalesce(own, slot).cast("long"))
    return d.select("_row.*", "mix_block", "mix_slot", (F.col("_at") % BLOCK).alias("mix_rank"))


def written_order(mixed: DataFrame) -> DataFrame:
    """The rows dealt and sorted by slot, so that files written from them follow the mix."""
    return mixed.repartitionByRange("mix_slot", "mix_rank").sortWithinPartitions("mix_slot", "mix_rank")


def op5_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs, TARGETS, "doc_id")


SQL = f"""
WITH RECURSIVE n AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id), doc_id) - 1 AS n FROM documents
),
g AS (
  SELECT s, CASE s {" ".join(f"WHEN '{s}' THEN {w}" for s, w in TARGETS.items())} END AS wt FROM (SELECT DISTINCT source AS s FROM documents)
),
o AS (SELECT s, row_number() OVER (ORDER BY md5('{SEED}:' || coalesce('=' || s, '')), s NULLS FIRST) - 1 AS turn, CAST(count(*) OVER () AS BIGINT) AS many FROM g WHERE wt IS NULL),
w AS (
  SELECT s, wt, rest, row_number() OVER (ORDER BY rest, s) AS k, CAST(sum(wt) OVER () AS BIGINT) AS period
  FROM (SELECT s, wt, false AS rest FROM g WHERE wt IS NOT NULL UNION ALL SELECT DISTINCT NULL, many, true FROM o)
),
t(slot, done, pick) AS (
  SELECT 0::BIGINT, list_transform(range(0, (SELECT count(*) FROM w)), lambda x: 0::BIGINT), NULL::BIGINT
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, i: CASE WHEN i = c THEN x + 1 ELSE x END), c
  FROM (
    SELECT slot, done, (SELECT w.k FROM w WHERE t.done[w.k] < w.wt AND (t.done[w.k] * w.period) // w.wt <= t.slot
      ORDER BY ((t.done[w.k] + 1) * w.period + w.wt - 1) // w.wt, w.k LIMIT 1) AS c
    FROM t WHERE slot < (SELECT max(period) FROM w)
  )
),
p AS (SELECT pick AS k, slot - 1 AS at, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS i FROM t WHERE pick IS NOT NULL),
b AS (
  SELECT n.doc_id, n.source, n.n // {BLOCK} AS mix_block, n.n % {BLOCK} AS mix_rank, o.turn IS NOT NULL AS rest,
    CASE WHEN o.turn IS NULL THEN n.n // {BLOCK} ELSE (n.n // {BLOCK}) * o.many + o.turn END AS nth
  FROM n LEFT JOIN o ON o.s IS NOT DISTINCT FROM n.source
)
SELECT b.doc_id, b.source, b.mix_block, (b.nth // w.wt) * w.period + p.at AS mix_slot, b.mix_rank
FROM b JOIN w ON w.rest = b.rest AND (w.rest OR w.s = b.source) JOIN p ON p.k = w.k AND p.i = b.nth % w.wt
"""
