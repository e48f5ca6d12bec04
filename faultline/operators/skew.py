"""Joins against a keyed side when a few keys hold much of the other side."""

from functools import reduce

from pyspark.sql import functions as F

MAX_HOT_KEYS = 10_000
MIN_HOT_ROWS = 100_000


def hot_keys(df, keys, max_hot=MAX_HOT_KEYS, min_rows=MIN_HOT_ROWS):
    """Keys holding more than 1/``max_hot`` of all rows, with a split count.

    By that definition there are fewer than ``max_hot`` of them at any scale, so
    the result is safe to broadcast.  Counting is combined before the shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    share = counts.agg(
        F.greatest(F.sum("_rows") / F.lit(max_hot), F.lit(float(min_rows))).alias("share")
    ).scalar()
    return counts.filter(F.col("_rows") > share).select(
        *keys, F.ceil(F.col("_rows") / share).cast("int").alias("_splits")
    )


def join_spreading_hot_keys(
    big,
    keyed,
    keys,
    spread_on,
    how="inner",
    max_hot=MAX_HOT_KEYS,
    min_rows=MIN_HOT_ROWS,
    *,
    small=None,
):
    """Join a side that may be skewed with one that has few rows per key.

    Rows of a hot key are spread over several salted copies of the keyed rows.  A keyed
    side counted to have at most ``small`` rows is broadcast instead.
    In a ``left`` or ``left_anti`` join the rows without a key match nothing; they
    pass by instead of gathering in one task.
    """
    if small is not None and keyed.limit(small + 1).count() <= small:
        return big.join(F.broadcast(keyed), keys, how)
    if how == "inner":
        return _spread_join(big, keyed, keys, spread_on, how, max_hot, min_rows)
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    joined = _spread_join(big.filter(has_key), keyed, keys, spread_on, how, max_hot, min_rows)
    return joined.unionByName(big.filter(~has_key), allowMissingColumns=True)


def _spread_join(big, keyed, keys, spread_on, how, max_hot, min_rows):
    hot = F.broadcast(hot_keys(big, keys, max_hot, min_rows))
    splits = F.coalesce(F.col("_splits"), F.lit(1))
    left = (
        big.join(hot, keys, "left")
        .withColumn("_part", F.pmod(F.xxhash64(spread_on), splits).cast("int"))
        .drop("_splits")
    )
    right = (
        keyed.join(hot, keys, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), splits - 1)))
        .drop("_splits")
    )
    return left.join(right, [*keys, "_part"], how).drop("_part")
