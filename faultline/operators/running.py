"""Running values per key by a prefix scan over ranges of the order.

A key's rows run in one window unless the key is hot: unless it holds more than one in
``MAX_HOT`` of all rows.  A hot key is cut into ranges of the whole order, so also among
rows of one time, at bounds from a hash sample of its places; values run inside each range
and the totals of the ranges before are added.  Only hot keys have bounds and totals, about
``2 * MAX_HOT`` of them at any size, so both are broadcast and the input is shuffled once,
by key and range.  Only rows equal in every order column are sure to meet in one task.
Rows without a key are one key of their own.
"""

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

#: A key is hot if it holds more than one in so many rows, and at least ``MIN_HOT_ROWS``.
MAX_HOT = 10_000
MIN_HOT_ROWS = 200_000
#: Places sampled for each range of a hot key.
PER_RANGE = 32
#: Bounds in one run: a row meets the first bound of each run, then those of its run.
RUN = 64


def _same(keys):
    """Equal keys, null ones included; the other side's begin with ``_k_``."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])


def _beside(df, keys):
    """A side of a bounded number of rows, to be met with ``_same``."""
    return F.broadcast(df.withColumnsRenamed({k: f"_k_{k}" for k in keys}))


def _hot(df, keys):
    """The rows a range should hold, and the hot keys (None without any)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total, largest = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    share = max((total or 0) / MAX_HOT, MIN_HOT_ROWS)
    if (largest or 0) <= share:
        return share, None
    return share, counts.filter(F.col("_rows") > share).select(*keys)


def _runs(df, keys, order, share, hot):
    """The bounds of each hot key, ascending, in runs."""
    places = df.select(*keys, F.struct(*order).alias("_place")).join(
        _beside(hot, keys), _same(keys), "left_semi"
    )
    low = (min(PER_RANGE / share, 1.0) * 2.0 - 1.0) * float(1 << 63)
    drawn = places.filter(F.xxhash64(*keys, "_place").cast("double") < low)
    bounds = F.filter(
        F.sort_array(F.collect_set("_place")), lambda _, i: i % PER_RANGE == PER_RANGE - 1
    )
    starts = F.sequence(F.lit(1), F.size("_bounds"), F.lit(RUN))
    return (
        drawn.groupBy(*keys)
        .agg(bounds.alias("_bounds"))
        .filter(F.size("_bounds") > 0)
        .select(*keys, F.transform(starts, lambda i: F.slice("_bounds", i, RUN)).alias("_runs"))
    )


def in_ranges(df, keys, order):
    """The rows of ``df`` ready for running values over ``keys`` and ``order``."""
    share, hot = _hot(df, keys)
    if hot is None:
        return Ranged(df.withColumn("_range", F.lit(None).cast("int")), keys, order, False)
    runs = _runs(df, keys, order, share, hot)
    place = F.struct(*order)

    def upto(bounds):
        return F.size(F.filter(bounds, lambda bound: bound <= place))

    in_run = F.transform(
        F.array(upto(F.transform("_runs", lambda run: run[0]))),
        lambda n: F.when(n == 0, 0).otherwise(
            (n - 1) * RUN + upto(F.element_at("_runs", F.greatest(n, F.lit(1))))
        ),
    )[0]
    placed = df.join(_beside(runs, keys), _same(keys), "left").select(
        *df.columns, F.when(F.col("_runs").isNotNull(), in_run).alias("_range")
    )
    return Ranged(placed, keys, order, True)


class Ranged:
    """Rows whose column ``_range`` numbers the ranges of a hot key and is null for others.

    All running values added to one object run in the same shuffle and sort.
    """

    def __init__(self, rows, keys, order, cut):
        self.rows, self.keys, self.order, self.cut = rows, keys, order, cut

    def _carried(self, staged, folds):
        """What the earlier ranges of a hot key give."""
        per_range = [*self.keys, "_range"]
        totals = staged.filter(F.col("_range").isNotNull()).groupBy(*per_range).agg(
            *[fold(f"_v_{name}").alias(f"_v_{name}") for name, fold in folds.items()]
        )
        earlier = (
            Window.partitionBy(*self.keys)
            .orderBy("_range")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        return totals.select(
            *per_range,
            *[fold(f"_v_{name}").over(earlier).alias(f"_c_{name}") for name, fold in folds.items()],
        )

    def add(self, sums=None, maxes=None, before=False):
        """Add running sums and running maxima (named expressions).

        ``before=True`` leaves the current row out.  Sums start at 0, maxima at null.
        """
        sums, maxes = sums or {}, maxes or {}
        folds = {**dict.fromkeys(sums, F.sum), **dict.fromkeys(maxes, F.max)}
        per_range = [*self.keys, "_range"]
        staged = self.rows.withColumns(
            {f"_v_{name}": value for name, value in {**sums, **maxes}.items()}
        )
        inside = (
            Window.partitionBy(*per_range)
            .orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
        )
        local = staged.select(
            *self.rows.columns,
            *[fold(f"_v_{name}").over(inside).alias(f"_l_{name}") for name, fold in folds.items()],
        )
        results = {
            name: F.coalesce(F.col(f"_l_{name}"), F.lit(0)) if name in sums else F.col(f"_l_{name}")
            for name in folds
        }
        if self.cut:
            carried = _beside(self._carried(staged, folds), per_range)
            local = local.join(carried, _same(per_range), "left")
            for name in sums:
                results[name] += F.coalesce(F.col(f"_c_{name}"), F.lit(0))
            for name in maxes:
                results[name] = F.greatest(results[name], F.col(f"_c_{name}"))
        return Ranged(
            local.select(*self.rows.columns, *[v.alias(n) for n, v in results.items()]),
            self.keys,
            self.order,
            self.cut,
        )


def running(df, keys, order, sums=None, maxes=None, before=False):
    """Running values of one kind; see ``Ranged.add``."""
    return in_ranges(df, keys, order).add(sums, maxes, before).rows.drop("_range")


def rolling_count(df, key, ts, order, length, name, counted=None, inclusive=False):
    """Earlier counted rows of the key within the trailing ``length``.

    Every counted row enters at its own time and leaves ``length`` later; the
    running balance is the count, so the cost is linear in the rows and does not
    depend on how many fall into one window.  ``inclusive`` keeps a row that is
    exactly ``length`` old.  ``order`` breaks ties between equal times.
    """
    counts = F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))
    entry = F.struct(F.col(ts).alias("_at"), F.lit(1).alias("_turn"), counts.cast("int").alias("_delta"))
    leave = F.struct(
        (F.col(ts) + F.expr(f"INTERVAL '{length}'")).alias("_at"),
        F.lit(2 if inclusive else 0).alias("_turn"),
        F.lit(-1).alias("_delta"),
    )
    moves = F.when(counts, F.array(entry, leave)).otherwise(F.array(entry))
    # an exit carries its key and order only
    rest = [c for c in df.columns if c not in (key, *order)]
    timeline = df.select("*", F.inline(moves)).withColumns(
        {c: F.when(F.col("_turn") == 1, F.col(c)) for c in rest}
    )
    balance = running(timeline, [key], ["_at", "_turn", *order], sums={name: F.col("_delta")})
    return balance.filter(F.col("_turn") == 1).select(
        *df.columns, (F.col(name) - F.col("_delta")).alias(name)
    )


def first_position(df, keys, position, condition):
    """The lowest position per key among rows meeting a condition."""
    return df.filter(condition).groupBy(*keys).agg(F.min(position).alias("first_position"))
