"""Mixing sources to target weights by entropy balancing.

Primal: document rates r_i in [0, cap] nearest in (bounded) entropy to one copy each, with one token constraint a source,
sum(size_i * r_i) = target_s.  The convex dual has one multiplier a source, and its solution tilts each document's odds
exponentially in its size: r_i / (cap - r_i) = exp(lambda_s * z_i) / (cap - 1), z_i = size_i / mean size.  Newton iterations
solve it: each is one distributed aggregation (gradient and curvature of every source) over the exact histogram of sizes,
and the multipliers, one a source, stay on the driver.  A bracket around each multiplier makes a step that leaves it a
bisection, so that the iterations can't diverge.

Rounding: documents of one source and size are exchangeable, so copies are given to such cells, largest sizes first,
carrying what is left over to the next cell; the total misses its target by no more than the smallest sizes can't mend.
Within a cell, the documents that get one copy more are the first in an order of hashes (``common.ranked``), so reruns
agree and no group meets in one task.

Defined results: a null text has size 0 and takes nothing; null is a source like others; a source whose target reaches
cap times its size takes every document cap times; an empty table gives an empty table; rows that repeat count each.
Bounds: sources are held on the driver (one number each), and the distinct document sizes of one source in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import WORD, ranked, repeated, unused, written

#: (source, size) pairs of the targets' table.
Targets = dict[str | None, float]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def share_targets(sizes: dict[str | None, int], weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, cap: float = 2.0) -> Targets:
    """Targets of each source: ``weights`` repeat over the sources by code point (null last) and share ``total_share`` of
    all sizes; a target above ``cap`` times its source's size stops there and the excess is shared anew."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: Targets = {}
    left = total_share * sum(sizes.values())
    while open_ := [s for s in order if s not in out]:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > cap * sizes[s]]
        for s in full or open_:
            out[s] = float(cap * sizes[s] if full else unit * weight[s])
        if not full:
            break
        left -= sum(out[s] for s in full)
    return out


def _table(spark, values: dict[str | None, tuple], names: str) -> DataFrame:
    return spark.createDataFrame([(s, *v) for s, v in values.items()], f"_s string, {names}")


def solve_multipliers(cells: DataFrame, sizes: dict[str | None, tuple[int, int]], targets: Targets, cap: float, tolerance: float = 1e-9) -> dict[str | None, float]:
    """Newton on the dual, until every source meets its target or its bracket can't be halved.  cells: source, size, n; sizes:
    (total size, rows) by source.  Only sources between 0 and their cap."""
    spark = cells.sparkSession
    live = {s: [0.0, -math.inf, math.inf] for s, (total, _) in sizes.items() if 0 < targets[s] < cap * total}
    done: dict[str | None, float] = {}
    rounds = 0
    while live:
        rounds += 1
        at = _table(spark, {s: (v[0], sizes[s][0] / max(1, sizes[s][1])) for s, v in live.items()}, "_l double, _m double")
        z = F.col("size") / F.col("_m")
        p = 1 / (1 + F.lit(cap - 1) * F.exp(-F.col("_l") * z))
        sums = cells.join(at, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(
            F.sum(F.col("n") * F.col("size") * F.lit(cap) * p).alias("tokens"), F.sum(F.col("n") * F.col("size") * F.lit(cap) * p * (1 - p) * z).alias("slope"))
        for s, tokens, slope in sums.collect():
            now, low, high = live[s]
            gap = tokens - targets[s]
            if abs(gap) <= tolerance * targets[s]:
                done[s] = live.pop(s)[0]
                continue
            low, high = (low, now) if gap > 0 else (now, high)
            step = now - gap / slope if slope > 0 else math.nan
            if not low < step < high or rounds % 4 == 0 and math.isfinite(low + high):  # halvings among the steps end any run
                step = (low + high) / 2 if math.isfinite(low + high) else now - math.copysign(max(1.0, abs(now)), gap)
            if not low < step < high:
                done[s] = now
                live.pop(s)
            else:
                live[s] = [step, low, high]
    return done


def _round_source(cap: float):
    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False, kind="stable")
        copies, due = [], 0.0
        for n, size, rate in zip(cells["n"], cells["size"], cells["rate"], strict=True):
            due += n * size * rate
            k = min(max(math.floor(due / size + 0.5), 0), int(cap) * n) if size else 0
            due -= k * size
            copies.append(k)
        return cells[["source", "size", "n"]].assign(copies=copies)

    return run


def mix(sized: DataFrame, order: list[str], weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, cap: int = 2) -> DataFrame:
    """Copies of every row of ``sized`` (source, size and the columns ``order`` that identify rows): those columns with
    source_size, target and copies (long, 0 to ``cap``)."""
    spark = sized.sparkSession
    sized = written(sized.select("source", "size", *order))
    cells = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sums = {s: (int(t), int(n)) for s, t, n in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")), F.sum("n")).collect()}
    targets = share_targets({s: t for s, (t, _) in sums.items()}, weights, total_share, cap)
    multipliers = solve_multipliers(cells, sums, targets, cap)
    plan = _table(spark, {s: (multipliers.get(s), t / max(1, n), targets[s] >= cap * t, t, targets[s]) for s, (t, n) in sums.items()}, "_l double, _m double, _full boolean, source_size long, target double")
    rate = F.when(F.col("_full"), F.lit(float(cap))).when(F.col("_l").isNull(), 0.0).otherwise(F.lit(float(cap)) / (1 + F.lit(float(cap - 1)) * F.exp(-F.col("_l") * F.col("size") / F.col("_m"))))
    rated = cells.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select("source", "size", "n", rate.alias("rate"))
    given = rated.groupBy("source").applyInPandas(_round_source(cap), "source string, size long, n long, copies long")
    given = given.select(F.col("source").alias("_gs"), F.col("size").alias("_gz"), F.expr("copies div n").alias("_each"), F.expr("copies % n").alias("_more"))
    out = ranked(sized, ["source", "size"], order, "_rank").join(given, F.col("source").eqNullSafe(F.col("_gs")) & (F.col("size") == F.col("_gz")))
    out = out.withColumn("copies", F.col("_each") + (F.col("_rank") < F.col("_more")).cast("long"))
    return out.join(plan, F.col("source").eqNullSafe(F.col("_s"))).select(*order, "source", "size", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), total_share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mixed corpus: every row of ``docs`` (doc_id, text, source and any further columns that can be grouped by, whatever
    their names) as often as the mix takes it.  Rows that repeat entirely are one row whose copies add up."""
    cols = docs.columns
    plain = [F.col(c).cast("string") for c in cols]
    digest = [F.xxhash64(*plain), F.xxhash64(F.lit(1), *plain)]  # 128 bits name a row
    h, g, n, i, j = unused(cols, "_h", "_g", "_copies", "_i", "_j")
    rows = docs.select(*cols, digest[0].alias(h), digest[1].alias(g)).dropDuplicates([h, g])
    sized = docs.select("source", n_words(F.col("text")).alias("size"), digest[0].alias("_h"), digest[1].alias("_g"))
    copies = mix(sized, ["_h", "_g"], weights, total_share, cap).groupBy(F.col("_h").alias(i), F.col("_g").alias(j)).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    out = rows.join(copies, (F.col(h) == F.col(i)) & (F.col(g) == F.col(j))).select(*cols, n)
    return repeated(out, n)
