"""Newest-first ordering and per-key cuts that survive hot keys."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000
SALTS = 64
#: Spark's default for ``spark.sql.optimizer.windowGroupLimitThreshold``.
CUT_BEFORE_SHUFFLE = 1000


def micros(df, column):
    """Microseconds of a timestamp column, without touching the session zone."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.unix_micros(value)
    seconds = F.hour(value) * 3600 + F.minute(value) * 60
    within = F.extract(F.lit("SECOND"), value) * 1_000_000
    return (
        F.unix_date(value.cast("date")) * F.lit(MICROS_PER_DAY)
        + seconds.cast("bigint") * 1_000_000
        + within.cast("bigint")
    )


def recency_key(df, column):
    """A number that sorts newest first with missing times in front."""
    return F.coalesce(-micros(df, column), F.lit(-(1 << 63)).cast("bigint"))


def newest_per_key(df, keys, order, limit, salt_on):
    """First ``limit`` rows per key in ``order``.

    Up to ``CUT_BEFORE_SHUFFLE`` each task cuts its own rows before they travel, so a
    key sends at most ``limit`` rows a task, whatever its share of all rows.  Of longer
    limits a first cut runs on (key, salt), so that such a key is spread over many tasks;
    the second sees at most ``SALTS * limit`` rows of any key.
    """
    if limit > CUT_BEFORE_SHUFFLE:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)))
        df = _first(salted, [*keys, "_salt"], order, limit).drop("_salt")
    return _first(df, keys, order, limit)


def _first(df, keys, order, limit):
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", place).filter(F.col("_n") <= limit).drop("_n")


def newest(df, limit, order):
    """The globally newest rows (a distributed top-n, never a full sort)."""
    return df.orderBy(*order).limit(limit)
