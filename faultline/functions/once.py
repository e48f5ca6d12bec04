"""Costly columns that later filters and projections must not compute again."""

from pyspark.sql import functions as F


def once(**columns):
    """Columns computed exactly once per row.

    The optimizer copies an ordinary column into every filter and projection that
    uses it.  The output of a generator is never copied, so the columns leave
    through one.  Select it beside ``"*"``.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return F.inline(F.array(row))
