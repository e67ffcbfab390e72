"""As-of join: the last value on or before a row's day, by equi-joins alone.

Days are cut into slots of ``SLOT_DAYS``.  A key's values become one short array a slot (one value a day at most), with the
value carried over from the slots before; slots without values inside the key's span have the carried one.  A row meets the
one array of its key and slot, so work grows with the sum of rows and values, and a hot key is many slots, of which a large one
can be split by Spark as any skewed join (the side of the values is unique).  Rows behind a key's last slot meet its last value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT_DAYS = 32


def _slot(day: Column, days: int) -> Column:
    return F.floor(F.unix_date(day) / days)


def as_of(rows: DataFrame, key: str, day: str, values: DataFrame, value_key: str, value_day: str, value: str, name: str, slot_days: int = SLOT_DAYS) -> DataFrame:
    """``rows`` with ``name``: the value of the same key on the last day not after the row's; null without one, or where the row's key
    or day is null.  Of several values of one day the largest counts; rows that repeat stay."""
    known = values.where(F.col(value_key).isNotNull() & F.col(value_day).isNotNull()).groupBy(F.col(value_key).alias("_k"), F.col(value_day).alias("_d")).agg(F.max(value).alias("_v"))
    slots = known.groupBy("_k", _slot(F.col("_d"), slot_days).alias("_s")).agg(F.array_sort(F.collect_list(F.struct("_d", "_v"))).alias("_own"))
    w = Window.partitionBy("_k").orderBy("_s")
    last = F.element_at("_own", -1)["_v"]
    slots = slots.withColumn("_before", F.lag(last).over(w)).withColumn("_next", F.lead("_s").over(w)).withColumn("_last", last)
    none = F.filter("_own", lambda x: F.lit(False))
    every = slots.select("_k", "_own", "_before", "_last", F.col("_s").alias("_first"), F.explode(F.sequence(F.col("_s"), F.coalesce(F.col("_next") - 1, F.col("_s")))).alias("_s"))
    every = every.select("_k", "_s", F.when(F.col("_s") == F.col("_first"), F.col("_own")).otherwise(none).alias("_own"), F.when(F.col("_s") == F.col("_first"), F.col("_before")).otherwise(F.col("_last")).alias("_before"))
    ends = slots.where(F.col("_next").isNull()).select(F.col("_k").alias("_e"), F.col("_s").alias("_end"), F.col("_last").alias("_after"))
    at = _slot(F.col(day), slot_days)
    j = rows.join(every, (F.col(key) == F.col("_k")) & (at == F.col("_s")), "left").join(ends, F.col(key) == F.col("_e"), "left")
    inside = F.get(F.filter("_own", lambda x: x["_d"] <= F.col(day)), F.size(F.filter("_own", lambda x: x["_d"] <= F.col(day))) - 1)["_v"]
    return j.withColumn(name, F.when(at > F.col("_end"), F.col("_after")).otherwise(F.coalesce(inside, F.col("_before")))).select(*rows.columns, name)
