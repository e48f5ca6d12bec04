"""Helpers that the operators of this subpackage share."""

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import stage

__all__ = ["Memo", "blank_cut", "drawn", "own_prefix", "read", "small_batches", "stage", "text_columns"]

#: Rows in one Arrow batch of texts: bounds what a Python worker holds at a time.
BATCH_ROWS = 256
#: Entries a worker-side cache may hold before it is emptied.
MEMO_ENTRIES = 300_000

_CUT = re.compile(r"(?= \S)")
_WIDE_BLANK = re.compile(r" (?:\s|\Z)")


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_prefix(df):
    """A prefix that no column of ``df`` has, for columns beside those given."""
    prefix = "_"
    while any(name.startswith(prefix) for name in df.columns):
        prefix += "_"
    return prefix


def small_batches(spark):
    """Short Arrow batches, as single texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


ARROW = {
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
}


def below_share(share, *keys):
    """Whether a row's hash of ``keys`` lies in the lowest ``share`` of all hashes."""
    bound = F.least(F.lit(share) if isinstance(share, float) else share, F.lit(1.0))
    return F.xxhash64(*keys).cast("double") < (bound * 2.0 - 1.0) * float(1 << 63)


def drawn(rows, size, *keys):
    """About ``size`` of the rows by the hash of ``keys``, all if there are no more.

    The share follows from the count, so no task meets more than its own rows; rows of
    equal keys are drawn together, and the limit bounds that.
    """
    total = rows.count()
    if total <= size:
        return rows
    return rows.filter(below_share(size / total, *keys)).limit(2 * size)


def _values(column):
    return column.to_pylist()


def text_columns(df, columns, compute, source="text", rows=_values):
    """``df`` without its column ``text`` (or ``source``) but with ``columns`` made from it.

    ``columns`` maps names to types; ``compute`` gets the texts of a batch and gives
    one list for each column.  Other columns pass unchanged, nulls included; one with
    the name of a made column is replaced by it.
    """
    small_batches(df.sparkSession)
    rest = [name for name in df.columns if name != source and name not in columns]
    shape = T.StructType([df.schema[name] for name in rest])
    for name, kind in columns.items():
        shape = shape.add(name, T.DataType.fromDDL(kind))

    def run(batches):
        for batch in batches:
            made = compute(rows(batch.column(source)))
            arrays = [batch.column(name) for name in rest]
            arrays += [
                pa.array(values, ARROW[kind])
                for values, kind in zip(made, columns.values(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, *columns])

    return df.select(*rest, source).mapInArrow(run, shape)


def blank_cut(text):
    """The text before its first cut, and the words behind each cut without their blank.

    A cut lies before every blank that a non-blank follows.  The token patterns of
    this subpackage never match across such a place, so both sides can be encoded
    alone: a run of white space gives its last blank to the next word.
    """
    if _WIDE_BLANK.search(text) is None:
        first, *rest = text.split(" ")
    else:
        first, *rest = _CUT.split(text)
        rest = [word[1:] for word in rest]
    return first, rest


class Memo(dict):
    """A bounded cache of a function's values, kept while the worker lives."""

    def __init__(self, function, entries=MEMO_ENTRIES):
        super().__init__()
        self.function, self.entries = function, entries

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.clear()
        value = self[key] = self.function(key)
        return value
