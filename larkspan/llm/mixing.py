"""Mixing sources to target weights by exact token lengths.

Documents are counted by (source, exact length). For each source a plan says
how many documents of each length are taken once more than in the whole passes
over the source: shares in proportion first, then a bounded-knapsack dynamic
programme over lengths for what remains of the budget. Which documents of a
length those are follows from a seeded hash of their ids.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.shared import fresh, materialize
from larkspan.llm.textkernel import words

#: Sources by code point get these weights in turn.
WEIGHTS = (3.0, 1.0, 2.0)
#: Half of it is left at least to the dynamic programme, which fits what remains of the budget exactly.
EXACT_BUDGET = 1 << 14
#: Sources with longer documents leave it so many of the longest.
LONGEST = 4
#: Bits of the sums that one programme holds, 8 sums at least; more steps are worked out again instead.
CELLS = 1 << 29
#: Documents of one length that are ranked in one task.
RANKED = 1_000


def measure(df: DataFrame, doc: str, text: str, source: str) -> DataFrame:
    """doc_id, text_hash, source, size: words `[^\\x20\\x09-\\x0D]+` of the whole text, 0 if it is null."""

    def work(batches):
        for b in batches:
            sizes = [np.diff(w.offsets) for w in words(b.column(3))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.concatenate(sizes).astype(np.int64) if sizes else np.empty(0, np.int64))], names=["doc_id", "text_hash", "source", "size"])

    content = F.col(text).cast("string")
    return df.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(content).alias("text_hash"), F.col(source).cast("string").alias("source"), content.alias("text")).mapInArrow(work, "doc_id long, text_hash long, source string, size long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source: `share` of all tokens by weight, none above `most` times its own size.

    What a capped source can't take is shared among the others by weight until
    none is above its cap.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * size[s]
        left, open_ = left - sum(out[s] for s in full), [s for s in open_ if s not in out]
    return out


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take so that the sum comes as close to the budget from below as it can.

    Reachable sums are the bits of one integer; a count is split into powers of
    two. The steps are walked back to find the counts. As many integers are kept
    for that as CELLS bits hold, 8 at least; for further steps the later half is
    walked first and the sums before it are worked out again. Lengths are spread
    over the order of the steps, which ends where the budget is reached.
    """
    take = np.zeros(len(lengths), np.int64)
    falling = np.argsort(-lengths, kind="stable")
    stride = math.isqrt(len(lengths)) or 1
    mask = (1 << (budget + 1)) - 1
    reached, steps = 1, []
    for i in (i for k in range(stride) for i in falling[k::stride] if lengths[i] > 0):
        size = int(lengths[i])
        n, k = min(int(counts[i]), budget // size), 1
        while n > 0 and not reached >> budget & 1:
            k = min(k, n)
            steps.append((i, k, size * k))
            reached |= (reached << (size * k)) & mask
            n -= k
            k *= 2
        if reached >> budget & 1:
            break

    def reach(reached: int, first: int, last: int, most: int) -> tuple[int, int]:
        """Sums up to `most` after the steps from first to last, and the step at which `most` was among them."""
        mask = (1 << (most + 1)) - 1
        reached &= mask
        while first < last and not reached >> most & 1:
            reached |= (reached << steps[first][2]) & mask
            first += 1
        return reached, first

    at, most = reached.bit_length() - 1, max(8, CELLS // (budget + 1))
    del reached
    parts = [(0, len(steps), 1)]  # steps still to be walked back, the latest on top, and the sums before them
    while parts:
        first, last, before = parts.pop()
        if last - first > most:
            middle = (first + last) // 2
            half, end = reach(before, first, middle, at)
            # if the sum is reached within the first half, the other steps are not taken
            parts += [(first, end, before)] if half >> at & 1 else [(first, middle, before), (middle, last, half)]
            continue
        sums = [before]
        for j in range(first, last):
            sums.append(reach(sums[-1], j, j + 1, at)[0])
        for j in range(last - 1, first - 1, -1):
            i, k, total = steps[j]
            if not sums[j - first] >> at & 1:
                take[i] += k
                at -= total
    return take


def exact(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """knapsack() over all lengths up to the budget, in units of their common divisor."""
    some = np.flatnonzero((lengths > 0) & (lengths <= budget) & (counts > 0))
    take = np.zeros(len(lengths), np.int64)
    if len(some):
        unit = int(np.gcd.reduce(lengths[some]))
        take[some] = knapsack(lengths[some] // unit, counts[some], budget // unit)
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """Counts to take of each length, at most `counts`, with a sum as close to the budget as can be found.

    Every length is taken in proportion, rounded down, less a reserve; long
    documents fill the rest down to the reserve, for which the exact programme
    has all that is left of every length.
    """
    budget = int(round(budget))
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros(len(lengths), np.int64)
    reserve = max(EXACT_BUDGET // 2, LONGEST * int(lengths[counts > 0].max()))
    take = np.floor(counts * (max(0, budget - reserve) / total)).astype(np.int64)
    left = budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= reserve or lengths[i] <= 0:
            break
        n = min(int(counts[i] - take[i]), max(0, (left - reserve // 2) // int(lengths[i])))
        take[i] += n
        left -= n * int(lengths[i])
    if left > 0:
        more = exact(lengths, counts - take, left)
        take += more
        left -= int((more * lengths).sum())
    if left > 0:  # one document beyond the budget, where that comes closer
        free = np.flatnonzero((counts > take) & (lengths > 0))
        if len(free):
            i = free[np.argmin(np.abs(lengths[free] - left))]
            if abs(left - int(lengths[i])) < left:
                take[i] += 1
    return take


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) as targets() gives them, whatever the number of sources.

    Sources are sorted by ranges; a source's place is its place in its range
    behind all ranges before it. In each round the sources above their cap join
    the full ones, and two sums of the others give the next round's share for a
    weight; nothing but sums and a count for each range comes to the driver.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = materialize(by.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()), "mix-sources")
    counts = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect())
    before = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(counts) for x in (k, sum(n for _, n in counts[:i]))] or [F.lit(0), F.lit(0)])
    place = F.element_at(before, F.col("range")) + F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    weighed = materialize(ranged.select("source", "source_size", weight.alias("weight")), "mix-weights")
    whole = weighed.agg(F.sum("source_size")).first()[0] or 0
    cap, full, before_full = most * F.col("source_size"), F.lit(False), -1
    while True:
        sums = weighed.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if not sums["open"] or sums["n"] == before_full:
            return weighed.select("source", "source_size", F.when(full, cap).otherwise(F.lit(share * whole - (sums["taken"] or 0.0)) * F.col("weight") / F.lit(sums["open"] or 1.0)).alias("target"))
        before_full = sums["n"]
        full = full | (F.lit(share * whole - sums["taken"]) * F.col("weight") / F.lit(sums["open"]) > cap)


def plan(sizes: DataFrame, target: DataFrame) -> DataFrame:
    """(source, size, n, source_size, target, passes, extra): whole passes over a source, and documents of each length taken once more.

    `target` is as of source_targets(). One task fits one source from its
    counts by length; those are as many as the source has different lengths,
    whatever its number of documents.
    """
    counted = sizes.groupBy("source", "size").agg(F.count("*").alias("n")).alias("c")
    t = target.alias("t")
    counted = counted.join(t, F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.source", "size", "n", "source_size", "target")

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size").reset_index(drop=True)
        whole, goal = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        passes = min(int(goal // whole), 2) if whole else 0
        extra = fit(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), goal - passes * whole) if passes < 2 else np.zeros(len(rows), np.int64)
        return rows.assign(passes=passes, extra=extra)

    return counted.groupBy("source").applyInPandas(work, "source string, size long, n long, source_size long, target double, passes int, extra long")


def mix_sources(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per row of df: doc_id, text_hash, source, size, source_size, target, taken, times.

    `times` is how often the mix takes the document (0, 1 or 2), `taken` its
    words times that. Targets are as in targets(); null is a source of its own
    and comes last. The choice among documents of one length depends on the
    seed and doc_id only, so reruns agree whatever the order of the rows; rows that share an
    id are interchangeable. Null or empty texts have size 0 and are taken 0
    words. Other columns are ignored; an empty table gives no rows. Neither
    sources nor lengths nor documents are held on the driver.
    """
    sizes = materialize(measure(df, doc, text, source), "mix-sizes")
    plans = materialize(plan(sizes, source_targets(sizes, weights, share, most)), "mix-plan")
    s, p = sizes.alias("s"), plans.hint("merge").alias("p")  # the plan grows with the sources and their lengths, so it is never broadcast
    joined = s.join(p, F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.size") == F.col("p.size"))).select("s.doc_id", "s.text_hash", "s.source", "s.size", "n", "source_size", "target", "passes", "extra")
    kept = ("doc_id", "text_hash", "source", "size", "source_size", "target")
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("n")) & (F.col("size") > 0)
    settled = joined.filter(~some).select(*kept, (F.col("passes") + (F.col("extra") > 0).cast("int")).alias("times"))
    # large groups of one length are ranked in parts by the leading bits of the hash; what stands in earlier parts is counted
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))
    ranked = joined.filter(some).withColumn("h", h).withColumn("part", F.floor((F.shiftrightunsigned(F.col("h"), 33) * F.ceil(F.col("n") / RANKED)) / (1 << 31)).cast("long"))
    ranked = materialize(ranked, "mix-ranked")
    parts = ranked.groupBy("source", "size", "part").agg(F.count("*").alias("k"))
    before = parts.withColumn("before", F.coalesce(F.sum("k").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r, b = ranked.alias("r"), before.alias("b")
    placed = r.join(b, F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.size") == F.col("b.size")) & (F.col("r.part") == F.col("b.part"))).select("r.*", "before")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("h", "doc_id"))
    chosen = placed.withColumn("rank", rank).select(*kept, (F.col("passes") + (F.col("rank") <= F.col("extra")).cast("int")).alias("times"))
    return settled.unionByName(chosen).select(*kept, (F.col("size") * F.col("times")).alias("taken"), "times")


def take_mix(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """df with only the rows that the mix takes, and as last column mix_times, how often.

    Rows that repeat id, text and source are taken alike, as often as the least
    of them; of one source and length at most one such set is cut short by
    that. If df has a column mix_times, it stays and the last column has the
    first free name of mix_times_, mix_times__, ... Nulls, empty texts and an
    empty table are as in mix_sources().
    """
    key, content, origin, times = (fresh(df, c) for c in ("_mix_id", "_mix_hash", "_mix_source", "mix_times"))
    verdict = mix_sources(df, doc, text, source, **options).groupBy("doc_id", "text_hash", "source").agg(F.min("times").alias("n")).filter("n > 0")
    v = verdict.select(F.col("doc_id").alias(key), F.col("text_hash").alias(content), F.col("source").alias(origin), F.col("n").alias(times))
    same = F.col(f"`{doc}`").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(f"`{text}`").cast("string")) == F.col(content)) & F.col(f"`{source}`").cast("string").eqNullSafe(F.col(origin))
    return df.join(v, same).drop(key, content, origin)
