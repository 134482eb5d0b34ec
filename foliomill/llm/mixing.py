"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are put in a fixed random order (by a hash of the id) and cut into blocks of `block` documents. A
source with weight w out of the total W gets its j-th block's window: released at slot floor(j * W / w), due by slot
ceil((j + 1) * W / w). In every slot the released block with the earliest deadline goes out, so that after t slots each source
has had t * w / W blocks, give or take less than one. The schedule repeats after W slots; at most one period is computed on
the driver. When a source has no more blocks, a new phase begins with the weights of those left. All rows are kept.

Sources of one weight have the same windows and go out in turn, so a phase is scheduled by weights, and only as far as it lasts: all
phases together have no more spans and no more slots than there are blocks, however many sources end one after another. What comes
to the driver is a count for each source. Spans and slots are broadcast while there are at most MOST_SHARED; more are written
into the shared folder, PART at a time, and joined.

Edge cases: a null source is a source of its own; a source without a weight gets weight 1; weights must be positive integers; repeated rows
are each scheduled, ties ordered by a hash of the text; an empty table gives an empty schedule; other columns are kept,
whatever their names, but columns named mix_block, mix_slot and mix_position are replaced, and names that begin with mix__ are the operator's own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import shared_folder, table

BLOCK = 16
#: Spans or slots that are broadcast, and those of one part of a larger schedule.
MOST_SHARED, PART = 200_000, 1_000_000
#: Rows of one source that are numbered in one task, about.
ROWS = 20_000
#: The production weights; any other source has weight 1.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2, "src5": 2}


def one_period(weights: dict) -> list:
    """The source of each slot of a period, earliest deadline first among released blocks; ties by name."""
    total = sum(weights.values())
    name = {s: ("" if s is None else str(s)) for s in weights}
    waiting = [(0, name[s], s, 0) for s in weights]  # (release, name, source, j)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, object, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, n, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[s]), n, s, j))
        _, n, s, j = heapq.heappop(ready)
        out.append(s)
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], n, s, j + 1))
    return out


def _turns(classes: list[tuple[int, list[str]]], goals: list[int | None], period: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each slot, number in its class) of one period, or of its beginning up to the slot in which a class reaches its goal.

    A class is (weight, names of its members in order). Its blocks go out one block of each member after another.
    """
    if len(classes) == 1:
        n = period if goals[0] is None else goals[0] + 1
        return np.zeros(n, np.int64), np.arange(n)
    done, line, numbers = [0] * len(classes), [], []
    for slot in range(period):
        best = None
        for c, (w, names) in enumerate(classes):
            j, rank = divmod(done[c], len(names))
            if j < w and j * period // w <= slot:
                best = min(best or (period + 1,), (-(-(j + 1) * period // w), names[rank], c))
        c = best[2]
        line.append(c)
        numbers.append(done[c])
        if done[c] == goals[c]:
            break
        done[c] += 1
    return np.array(line, np.int64), np.array(numbers, np.int64)


def phases(blocks: dict, weights: dict) -> Iterator[tuple[pa.Table, pa.Table]]:
    """The schedule in parts of about PART rows: spans (phase, s, class, rank, members, w, first_block, blocks, first_slot, period) and slots (p, c, k, at).

    Block n of a span (from 0) is number n * members + rank of its class in the phase; k is that number in its period.
    """
    if any(not isinstance(w, int) or w < 1 for w in (weights.get(s, 1) for s, n in blocks.items() if n)):
        raise ValueError("weights must be positive integers")
    sources = sorted((s for s, n in blocks.items() if n), key=lambda s: ("" if s is None else str(s), s is not None))
    text, names = pa.array(sources, pa.string()), ["" if s is None else str(s) for s in sources]
    left, done = np.array([blocks[s] for s in sources], np.int64), np.zeros(len(sources), np.int64)
    of = np.array([weights.get(s, 1) for s in sources], np.int64)
    members = {int(w): np.flatnonzero(of == w) for w in np.unique(of)}
    listed = {w: [names[i] for i in m] for w, m in members.items()}
    spans, slots, size, start, phase = [], [], 0, 0, 0

    def part() -> tuple[pa.Table, pa.Table]:
        a = [np.concatenate([x[i] for x in spans]) if spans else np.zeros(0, np.int64) for i in range(10)]
        b = [np.concatenate([x[i] for x in slots]) if slots else np.zeros(0, np.int64) for i in range(4)]
        a[1] = text.take(pa.array(a[1], pa.int64()))
        return pa.table(a, ["phase", "s", "class", "rank", "members", "w", "first_block", "blocks", "first_slot", "period"]), pa.table(b, ["p", "c", "k", "at"])

    while members:
        common = reduce(gcd, members)
        classes = [(w // common, m) for w, m in members.items()]
        period = sum(w * len(m) for w, m in classes)
        # the last block of the member that ends first in each class: (member, period, number in the period)
        last = []
        for w, m in classes:
            rank = int(np.argmin(left[m]))
            last.append((rank, *divmod((int(left[m[rank]]) - 1) * len(m) + rank, w * len(m))))
        early = min(x[1] for x in last)
        line, numbers = _turns([(w, listed[k]) for (w, _), k in zip(classes, members, strict=True)], [x[2] if x[1] == 0 else None for x in last], period)
        at = [np.flatnonzero(line == c) for c in range(len(classes))]
        end, ends = min((early * period + int(at[c][x[2]]) + 1, c) for c, x in enumerate(last) if x[1] == early and x[2] < len(at[c]))
        slots.append((np.full(len(line), phase), line, numbers, np.arange(len(line))))
        size += len(line)
        for c, (w, m) in enumerate(classes):
            sent = end // period * w * len(m) + int(np.searchsorted(at[c], end % period))
            n = sent // len(m) + (np.arange(len(m)) < sent % len(m))
            rank = np.flatnonzero(n)
            same = lambda x: np.full(len(rank), x)  # noqa: B023, E731
            spans.append((same(phase), m[rank], same(c), rank, same(len(m)), same(w), done[m[rank]], n[rank], same(start), same(period)))
            done[m] += n
            left[m] -= n
            size += len(rank)
        key, rank = list(members)[ends], last[ends][0]
        members[key] = np.delete(members[key], rank)
        del listed[key][rank]
        if not len(members[key]):
            del members[key], listed[key]
        start, phase = start + end, phase + 1
        if size >= PART:
            yield part()
            spans, slots, size = [], [], 0
    yield part()


def _schedule(spark, parts: Iterator[tuple[pa.Table, pa.Table]]) -> tuple[DataFrame, DataFrame, bool]:
    """(spans, slots, whether both are small enough to broadcast)."""
    first = next(parts)
    more = next(parts, None)
    if more is None and max(t.num_rows for t in first) <= MOST_SHARED:
        return *(spark.createDataFrame(t) for t in first), True
    folders = [shared_folder(spark, f"mix-{x}") for x in ("spans", "slots")]
    while first is not None:
        for t, folder in zip(first, folders, strict=True):
            spark.createDataFrame(t).write.mode("append").parquet(folder)
        first, more = more, next(parts, None)
    return *(spark.read.parquet(f) for f in folders), False


def mix(docs: DataFrame, weights: dict | None = None, *, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", order_rows: bool = False) -> DataFrame:
    """docs with mix_block (number in its source), mix_slot (number in the mix) and mix_position (place in the block)."""
    spark = docs.sparkSession
    weights = WEIGHTS if weights is None else weights
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    sized = docs.withColumn("mix__source", F.col(source_col).cast("string")).withColumn("mix__order", F.xxhash64(F.lit("mix"), F.col(id_col)))
    # never null, so that what is joined by it stays where the numbering put it
    sized = sized.withColumn("mix__key", F.coalesce(F.concat(F.lit("s"), "mix__source"), F.lit("")))
    counts = {r[0]: r[1] for r in sized.groupBy("mix__source").count().collect()}
    span, slot, small = _schedule(spark, phases({s: -(-n // block) for s, n in counts.items()}, {s: weights.get(s, 1) for s in counts}))
    # Every column of the schedule gets a name that no column of docs has.
    span, slot = (t.toDF(*(f"mix__{c}" for c in t.columns)) for t in (span, slot))
    # A row's number in its source: the rows of the ranges before its own, and its number in the range.
    ranges = max(64, -(-max(counts.values(), default=0) // ROWS))
    sized = sized.withColumn("mix__range", F.floor((F.shiftrightunsigned("mix__order", 33) * ranges) / (1 << 31)).cast("int"))
    before = sized.groupBy("mix__key", "mix__range").count().withColumn("mix__before", F.sum("count").over(Window.partitionBy("mix__key").orderBy("mix__range").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    before = before.select(F.col("mix__key").alias("mix__s_"), F.col("mix__range").alias("mix__r_"), F.coalesce("mix__before", F.lit(0)).alias("mix__before"))
    own = Window.partitionBy("mix__key", "mix__range").orderBy("mix__order", id_col, F.xxhash64(text_col))
    numbered = sized.withColumn("mix__row", F.row_number().over(own) - 1)
    numbered = numbered.join(before, (F.col("mix__key") == F.col("mix__s_")) & (F.col("mix__range") == F.col("mix__r_")), "left")
    numbered = numbered.withColumn("mix__row", F.col("mix__row") + F.col("mix__before")).withColumn("mix_block", F.floor(F.col("mix__row") / block)).withColumn("mix_position", (F.col("mix__row") % block).cast("int"))
    n = F.col("mix__number") - F.col("mix__first_block")
    number = n * F.col("mix__members") + F.col("mix__rank")
    in_period = F.col("mix__w") * F.col("mix__members")
    here = (F.col("mix__phase") == F.col("mix__p")) & (F.col("mix__class") == F.col("mix__c")) & (number % in_period == F.col("mix__k"))
    its_slot = F.col("mix__first_slot") + F.floor(number / in_period) * F.col("mix__period") + F.col("mix__at")
    if small:
        # An equality join to all phases of the source and a residual range, both on broadcast tables of bounded size.
        rows = numbered.withColumn("mix__number", F.col("mix_block"))
        placed = rows.join(F.broadcast(span), F.col("mix__source").eqNullSafe(F.col("mix__s")) & (F.col("mix__number") >= F.col("mix__first_block")) & (F.col("mix__number") < F.col("mix__first_block") + F.col("mix__blocks")))
        placed = placed.join(F.broadcast(slot), here).withColumn("mix_slot", its_slot)
    else:
        # One row for each block, so that no row meets the other phases of its source.
        each = span.withColumn("mix__number", F.explode(F.sequence("mix__first_block", F.col("mix__first_block") + F.col("mix__blocks") - 1)))
        each = each.join(slot, here).select("mix__s", "mix__number", its_slot.alias("mix_slot"))
        placed = numbered.join(each, F.col("mix__source").eqNullSafe(F.col("mix__s")) & (F.col("mix_block") == F.col("mix__number")))
    out = placed.select(*[F.col(c) for c in docs.columns], "mix_block", "mix_slot", "mix_position")
    return out.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_position") if order_rows else out


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("").alias("text"))
    return mix(docs).drop("text")
