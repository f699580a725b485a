"""Mixing sources to target weights by Pfair scheduling (operator 7).

Time is cut into slots of one block each. A source of weight w may run its k-th block (from 0) from slot floor(k / w) on
and must have run it by slot ceil((k + 1) / w). In every slot the released block with the earliest deadline runs. As the
weights sum to one, every block meets its deadline, so at every slot each source has had its weight's share of the slots
but for less than one block. Weights are whole numbers and all of this is integer arithmetic, so nothing drifts.

What has run by slot t does not need the slots before to be gone through: blocks due by t have run, and of each source
at most one more, its open block. Which of the open blocks have run follows from the slots that are left between their
releases and t (state). So the schedule is cut into stretches that tasks work out on their own, each from its state.

When a source has no rows left its slots stay empty, and the others go on in proportion. From the slot by which sources of
half the weight must have ended, a new phase begins, with the sources and blocks that are left and slots from 0, so
at most about half of the slots are empty. Within a phase the bound of one block holds for what is left when it begins.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLACE, located, unfolded, written
from .common import whole as whole_rows

#: Rows in a block.
BLOCK = 64
#: The largest weight as a whole number. A weight counts as at least one of so many parts of all weights.
WHOLE, PARTS = 1 << 40, 1 << 22
#: A mix of more sources than this is refused: the driver and every task know each source's weight and rows.
MOST_SOURCES = 10_000
#: Weights of the sources, without others given: their rows to this power.
FLATTEN = 0.5
#: Slots that a task works out at a time.
STRETCH = 1 << 16
#: Rows of a source that are numbered together, about; at least 16**2 parts.
TOGETHER = 1 << 18


def whole(weights: list[float]) -> list[int]:
    """The weights in proportion as whole numbers, the largest as WHOLE."""
    top = max(weights)
    if any(not w > 0 for w in weights) or not math.isfinite(top):
        raise ValueError("weights must be finite and above zero")
    a = [math.floor(w / top * WHOLE) for w in weights]
    return [max(x, sum(a) // PARTS) for x in a]


def state(a: list[int], t: int) -> list[int]:
    """Blocks of each source that have run before slot t, for weights a."""
    total = sum(a)
    done = [x * t // total for x in a]  # due by t
    spare = t - sum(done)
    if not spare:
        return done
    # open blocks, the latest release first: release, deadline, source
    waiting = sorted(((k * total // x, -((k + 1) * total // -x), s) for s, (x, k) in enumerate(zip(a, done)) if x * t % total), reverse=True)
    first = waiting[-1][0]
    due = np.zeros(t - first, np.int64)  # blocks due by t, by release
    for x, end in zip(a, done):
        begin = -(first * x // -total)
        if begin < end:
            (q, r), i = divmod(begin * total, x), np.arange(end - begin)
            due += np.bincount(q - first + i * (total // x) + (r + i * (total % x)) // x, minlength=len(due))
    room = np.arange(t - first, 0, -1) - np.cumsum(due[::-1])[::-1]  # slots from here to t, but for those blocks
    # from t back: if more open blocks are released from here on than there is room, those with the latest deadlines wait
    kept: list[tuple[int, int]] = []
    upto = len(room)

    def checked(at: int) -> None:
        nonlocal upto
        if at < upto:
            least = room[at:upto].min()
            while len(kept) > least:
                heapq.heappop(kept)
            upto = at

    for release, deadline, s in waiting:
        checked(release - first + 1)
        heapq.heappush(kept, (-deadline, -s))
    checked(0)
    while len(kept) > spare:
        heapq.heappop(kept)
    for _, s in kept:
        done[-s] += 1
    return done


@dataclass(frozen=True)
class Phase:
    """From slot begin on, so many slots: weights of the sources (0: none left), blocks that ran before, blocks left."""

    begin: int
    slots: int
    weights: list[int]
    ran: list[int]
    left: list[int]


def phases(a: list[int], blocks: list[int]) -> list[Phase]:
    """a: weights; blocks: how many each source has."""
    begin, ran, out = 0, [0] * len(a), []
    while any(left := [b - r for b, r in zip(blocks, ran)]):
        now = [x if n else 0 for x, n in zip(a, left)]
        total, gone = sum(now), 0
        for end, x in sorted((-(n * total // -x), x) for x, n in zip(now, left) if n):  # the last block's deadline
            gone += x
            if 2 * gone >= total:
                break
        out.append(Phase(begin, end, now, ran, left))
        of = [s for s, x in enumerate(now) if x]
        done = dict(zip(of, state([now[s] for s in of], end)))
        ran, begin = [r + min(n, done.get(s, 0)) for s, (r, n) in enumerate(zip(ran, left))], begin + end
    return out


def stretch(phase: Phase, rows: list[int], block: int, t: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(source, block, slot, position of its first row) of the blocks that run in slots t to end of a phase."""
    of = [s for s, x in enumerate(phase.weights) if x]
    a, total = [phase.weights[s] for s in of], sum(phase.weights)
    done, released, waiting = state(a, t), [], []
    so_far = dict(zip(of, done))
    position = sum(min(n, block * (r + min(left, so_far.get(s, 0)))) for s, (n, r, left) in enumerate(zip(rows, phase.ran, phase.left)))
    for i, (x, k) in enumerate(zip(a, done)):
        heapq.heappush(waiting, (k * total // x, i))
    for now in range(t, end):
        while waiting and waiting[0][0] <= now:
            _, i = heapq.heappop(waiting)
            heapq.heappush(released, (-((done[i] + 1) * total // -a[i]), i))
        deadline, i = heapq.heappop(released)
        if deadline <= now:
            raise AssertionError("a block missed its deadline")
        s, k = of[i], done[i]
        if k < phase.left[s]:
            yield s, phase.ran[s] + k, phase.begin + now, position
            position += min(block, rows[s] - block * (phase.ran[s] + k))
        done[i] += 1
        heapq.heappush(waiting, (done[i] * total // a[i], i))


def schedule(spark: SparkSession, names: list[str], rows: list[int], a: list[int], block: int, size: int = STRETCH) -> DataFrame:
    """__source, __block, __slot, __first (position of its first row) of every block."""
    plan = phases(a, [-(-n // block) for n in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, i in zip(batch.phase.tolist(), batch.i.tolist()):
                found = list(stretch(plan[p], rows, block, i * size, min(plan[p].slots, (i + 1) * size)))
                if found:
                    yield pd.DataFrame([(names[s], *x) for s, *x in found], columns=["__source", "__block", "__slot", "__first"])

    numbers = [(p, -(-phase.slots // size)) for p, phase in enumerate(plan)]
    # from an Arrow table, as a list would start a second set of Python workers on the executors
    table = pa.table({"phase": pa.array((p for p, _ in numbers), pa.int32()), "n": pa.array((n for _, n in numbers), pa.int64())})
    todo = spark.createDataFrame(table).select("phase", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    if (n := sum(n for _, n in numbers)) > 1:
        todo = todo.repartition(min(n, 10_000), "phase", "i")
    return todo.mapInPandas(run, "__source string, __block long, __slot long, __first long")


def numbered(rows: DataFrame, most: int) -> DataFrame:
    """rows (__source, __hash, PLACE) with __nth: the place, from 0, within the source in the order of the hash.

    A source is split by the hash into parts that are numbered each on its own and moved on by the rows of the parts
    before, so that a source with most of all rows is numbered by many tasks. most: rows of the largest source.
    """
    digits = max(2, math.ceil(math.log(max(1, most / TOGETHER), 16)))
    rows = rows.withColumn("__part", F.substring("__hash", 1, digits))
    sizes = rows.groupBy("__source", "__part").agg(F.count("*").alias("n"))
    before = sizes.select("__source", "__part", (F.sum("n").over(Window.partitionBy("__source").orderBy("__part")) - F.col("n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__source", "__part").orderBy("__hash", *PLACE)) - 1
    return rows.withColumn("__in", inside).join(written(before), ["__source", "__part"]).withColumn("__nth", F.col("__before") + F.col("__in"))


def _placed(docs: DataFrame, weights: dict[str, float] | None, source_col: str, id_col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """The whole rows of docs with PLACE, and (PLACE, __block, __slot, __position) of each of them."""
    spark = docs.sparkSession
    docs = located(docs, whole_rows(docs), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").cast("string").alias("id"))
    # rows without an id are spread by their place
    key = F.coalesce("id", F.concat_ws("#", *PLACE))
    rows = docs.select(*PLACE, F.coalesce("source", F.lit("")).alias("__source"), F.md5(key.cast("binary")).alias("__hash"))
    sizes = {r["__source"]: r.n for r in rows.groupBy("__source").agg(F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()}
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if not sizes:
        nothing = F.lit(0).cast("long")
        return docs, rows.select(*PLACE, nothing.alias("__block"), nothing.alias("__slot"), nothing.alias("__position"))
    weights = weights or {s: n**FLATTEN for s, n in sizes.items()}
    if missing := sorted(set(sizes) - set(weights)):
        raise ValueError(f"no weight for sources {missing[:5]}")
    names = sorted(sizes)
    blocks = schedule(spark, names, [sizes[s] for s in names], whole([weights[s] for s in names]), block)
    at = numbered(rows, max(sizes.values())).withColumn("__block", F.floor(F.col("__nth") / block)).join(blocks, ["__source", "__block"])
    return docs, at.select(*PLACE, "__block", "__slot", (F.col("__first") + F.col("__nth") - F.col("__block") * block).alias("__position"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """docs with block (number within the source), slot and position (from 0, the row's place in the mix) at the end.

    weights: target weight by source; without it, the sources' rows to the power FLATTEN. Every row stays. Null sources
    are the source ''; a source that has rows and no weight is an error. Within a source rows come in the order of the
    MD5 of the id; rows with the same id, and rows without one, in an order that their place in the input files decides.
    Texts are not read. An empty table gives an empty result. Columns of docs that have these names are replaced.
    """
    rows, at = _placed(docs, weights, source_col, id_col, block)
    out = rows.drop("source", "id").join(at.hint("shuffle_hash"), PLACE)
    kept = [F.col("__whole").getField(c).alias(c) for c in docs.columns if c not in ("block", "slot", "position")]
    return out.select(*kept, F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """docs in the order of the mix: sorted ranges of positions, one for each partition; columns as before.

    The positions are worked out on narrow rows and written; the whole rows are joined to them once. Null sources are the
    source ''; rows that repeat an id, and rows without one, come in an order that their place in the files decides. An
    empty table gives an empty one. Columns may have any names.
    """
    rows, at = _placed(docs, weights, "source", "doc_id", BLOCK)
    out = rows.drop("source", "id").join(written(at).hint("shuffle_hash"), PLACE)
    return unfolded(out.repartitionByRange("__position").sortWithinPartitions("__position"), docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "block", "slot", "position")


#: Slot by slot. run: phase weights a, blocks that ran before, blocks left, end of the phase, first slot of it; in it, blocks done before slot t.
_END = """list_min(list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN b[i] > 0 THEN (b[i] * list_sum(w) + w[i] - 1) // greatest(w[i], 1) END),
  lambda e: 2 * list_sum(list_transform(range(1, n + 1), lambda i: CASE WHEN b[i] > 0 AND (b[i] * list_sum(w) + w[i] - 1) // greatest(w[i], 1) <= e THEN w[i] ELSE 0 END)) >= list_sum(w)))"""

OP7_SQL = f"""
WITH RECURSIVE src AS (SELECT coalesce(source, '') AS s, count(*) AS n, floor(sqrt(count(*)) / max(sqrt(count(*))) OVER () * {WHOLE})::HUGEINT AS a0 FROM documents GROUP BY ALL
), par AS (
  SELECT count(*) AS n, list(greatest(a0, least) ORDER BY s) AS a, list(n ORDER BY s) AS rows, list(((n + {BLOCK} - 1) // {BLOCK})::HUGEINT ORDER BY s) AS blocks, list(s ORDER BY s) AS names
  FROM (SELECT *, (sum(a0) OVER () // {PARTS})::HUGEINT AS least FROM src)
), run AS (
  SELECT 0::BIGINT AS slot, 0::HUGEINT AS t, {_END} AS e, w, list_transform(range(1, n + 1), lambda i: 0::HUGEINT) AS ran, b, list_transform(range(1, n + 1), lambda i: 0::HUGEINT) AS k, NULL::BIGINT AS pick
  FROM (SELECT n, a AS w, blocks AS b FROM par)
  UNION ALL
  SELECT slot + 1, t, e, w, ran, b, k, list_sort(list_transform(list_filter(range(1, n + 1), lambda i: w[i] > 0 AND k[i] * list_sum(w) // greatest(w[i], 1) <= t), lambda i: {{'deadline': ((k[i] + 1) * list_sum(w) + w[i] - 1) // greatest(w[i], 1), 'i': i}}))[1].i
  FROM (
    SELECT slot, n, CASE WHEN e0 = t0 THEN 0 ELSE t0 END AS t, CASE WHEN e0 = t0 THEN {_END} ELSE e0 END AS e, w, ran, b, k FROM (
      SELECT *, list_transform(range(1, n + 1), lambda i: CASE WHEN b[i] > 0 OR e0 <> t0 THEN w0[i] ELSE 0 END) AS w FROM (
        SELECT slot, n, t0, e0, w0, CASE WHEN e0 = t0 THEN list_transform(range(1, n + 1), lambda i: ran[i] + least(b[i], k1[i])) ELSE ran END AS ran, CASE WHEN e0 = t0 THEN list_transform(range(1, n + 1), lambda i: b[i] - least(b[i], k1[i])) ELSE b END AS b, CASE WHEN e0 = t0 THEN list_transform(range(1, n + 1), lambda i: 0::HUGEINT) ELSE k1 END AS k
        FROM (SELECT slot, n, e AS e0, w AS w0, ran, b, CASE WHEN pick IS NULL THEN t ELSE t + 1 END AS t0, list_transform(range(1, n + 1), lambda i: k[i] + CASE WHEN i = pick THEN 1 ELSE 0 END) AS k1 FROM run, par)
      )))
  WHERE list_sum(b) > 0
), plan AS (SELECT slot - 1 AS slot, pick, (ran[pick] + k[pick])::BIGINT AS block, list_transform(range(1, n + 1), lambda i: least(rows[i], {BLOCK} * (ran[i] + least(b[i], k[i])))) AS before FROM run, par WHERE pick IS NOT NULL AND k[pick] < b[pick]
), docs AS (SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(doc_id::VARCHAR)) - 1 AS nth FROM documents)
SELECT doc_id, source, block, slot, list_sum(before)::BIGINT + nth - block * {BLOCK} AS position
FROM docs CROSS JOIN par JOIN plan ON names[pick] = s AND block = nth // {BLOCK}
"""
