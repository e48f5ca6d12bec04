"""Exact rolling admission, where only admitted rows count against the limit.

The verdict of a row depends on earlier verdicts, so rows are folded in time order.
A key's history is first cut where a whole slot as long as the window holds no row:
nothing admitted before such a silence counts after it.  The parts are independent.
Parts of no more than ``limit`` rows are admitted without a fold; the others stream,
sorted by Spark, past a state of at most ``limit`` times, and rows that meet a full
state are passed over by search up to the moment the next place is free.

All keys take this one path.  Times are microseconds and never pass through Python's
dates, so no time zone matters.  Rows without a time are denied and count for
nothing; rows without a key are one key of their own.
"""

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators.recency import micros


def length_micros(length):
    return pd.Timedelta(length) // pd.Timedelta("1us")


def judge(held, moment, limit, length, inclusive):
    """Verdict for a row; ``held`` is the sorted list of counted times and is kept current.

    A late row takes its place among the times; later ones count against it too.
    """
    expired = bisect_left if inclusive else bisect_right
    del held[: expired(held, moment - length)]
    if len(held) >= limit:
        return False
    insort(held, moment)
    return True


def judge_sorted(held, moments, limit, length, inclusive):
    """Verdicts for the sorted times of one key, passing over rows that meet a full state."""
    admitted = np.zeros(len(moments), bool)
    side = "right" if inclusive else "left"
    at = 0
    while at < len(moments) and limit > 0:
        if judge(held, int(moments[at]), limit, length, inclusive):
            admitted[at] = True
            at += 1
        else:
            at = max(at + 1, int(np.searchsorted(moments, held[0] + length, side)))
    return admitted


def _fold(rows, key, order, limit, window, inclusive):
    """Judge the rows of each (key, part) in time order; needs ``_at`` and ``_part``."""

    def fold(batches):
        current, held = None, []
        for batch in batches:
            moments = batch.column("_at").to_numpy()
            names = list(zip(batch.column(key).to_pylist(), batch.column("_part").to_pylist()))
            admitted = np.zeros(len(names), bool)
            at = 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if current is None or names[at] != current:
                    current, held = names[at], []
                admitted[at:end] = judge_sorted(held, moments[at:end], limit, window, inclusive)
                at = end
            kept = batch.drop_columns(["_at", "_part"])
            yield kept.append_column("admitted", pa.array(admitted))

    shape = rows.drop("_at", "_part").schema.add("admitted", "boolean")
    return (
        rows.repartition(key, "_part")
        .sortWithinPartitions(key, "_part", "_at", *order)
        .mapInArrow(fold, shape)
    )


def _parts(timed, key):
    """(key, slot) to the part of the key's history it lies in, and that part's rows."""
    slots = timed.groupBy(key, "_slot").agg(F.count("*").alias("_n"))
    by_slot = Window.partitionBy(key).orderBy("_slot")
    silent = F.col("_slot") - F.lag("_slot").over(by_slot) > 1
    cut = slots.withColumn("_silent", F.coalesce(silent.cast("long"), F.lit(0)))
    parted = cut.withColumn("_part", F.sum("_silent").over(by_slot))
    whole = Window.partitionBy(key, "_part")
    return parted.select(
        F.col(key).alias("_key"),
        F.col("_slot").alias("_its_slot"),
        "_part",
        F.sum("_n").over(whole).alias("_rows"),
    )


def admit(attempts, key, ts, order, limit, length, inclusive=False):
    """(key, ts, *order, admitted) for every attempt; ``order`` identifies a row of a key."""
    window = length_micros(length)
    narrow = attempts.select(key, ts, *order)
    timeless = narrow.filter(F.col(ts).isNull()).withColumn("admitted", F.lit(False))
    present = narrow.filter(F.col(ts).isNotNull())
    timed = present.withColumn("_at", micros(present, ts)).withColumn(
        "_slot", F.floor(F.col("_at") / F.lit(window)).cast("long")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_its_slot"))
    parted = timed.join(_parts(timed, key), same).drop("_key", "_its_slot", "_slot")
    small = F.col("_rows") <= limit
    easy = parted.filter(small).select(*narrow.columns, F.lit(True).alias("admitted"))
    busy = parted.filter(~small).drop("_rows")
    folded = _fold(busy, key, order, limit, window, inclusive)
    return folded.unionByName(easy).unionByName(timeless)
